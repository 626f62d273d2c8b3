"""Versioned collections: Parquet tables under a name, swapped whole, checked by a fingerprint.

Layout: <root>/<name>/v=<n>/<table>.parquet, and <root>/<name>/v=<n>/_complete, which is written last and holds what the content
depends on. Readers use the highest complete version. Nothing that they use is ever changed or removed, so a writer that dies at
any point leaves the version before as it was, and the next writer begins its number anew. One writer at a time. Paths go
through Hadoop's file systems, so any store that Spark reads will do.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class CollectionMismatch(ValueError):
    """A collection that was made with other settings."""


class Collection:
    def __init__(self, spark: SparkSession, root: str, name: str, fingerprint: dict):
        self.spark, self.at, self.fingerprint = spark, f"{root}/{name}", fingerprint
        known = self._read(f"v={self.version}/_complete")
        if known is not None and json.loads(known) != fingerprint:
            raise CollectionMismatch(f"{name}: made with {known}, asked for {json.dumps(fingerprint, sort_keys=True)}")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.at}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _read(self, name: str) -> str | None:
        fs, path = self._path(name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        """Beside its place first, so that a file that is there is whole."""
        fs, path = self._path(name)
        _, new = self._path(f"{name}.new")
        stream = fs.create(new, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not fs.rename(new, path):
            raise OSError(f"{name} could not be written")

    @property
    def version(self) -> int:
        """The highest complete one; 0 for none."""
        fs, path = self._path("")
        listed = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        numbers = sorted((int(name[2:]) for name in listed if name.startswith("v=") and name[2:].isdigit()), reverse=True)
        return next((n for n in numbers if fs.exists(self._path(f"v={n}/_complete")[1])), 0)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.at}/v={self.version}/{name}.parquet")

    def exists(self) -> bool:
        return self.version > 0

    def replace(self, tables: dict[str, DataFrame], expect: dict[str, int] | None = None, measures: dict[str, dict[str, Column]] | None = None) -> dict[str, dict[str, int]]:
        """Writes the next version and makes it current once its row counts are as expected. A failure leaves the version before.

        Rows are counted while they are written, and so are `measures` (aggregates by table and name): nothing is read a second
        time. Returns what was counted: by table, `rows` and its measures."""
        new, seen = self.version + 1, {}
        for name, df in tables.items():
            counts = Observation()
            asked = [c.alias(k) for k, c in (measures or {}).get(name, {}).items()]
            df.observe(counts, F.count(F.lit(1)).alias("rows"), *asked).write.mode("overwrite").parquet(f"{self.at}/v={new}/{name}.parquet")
            seen[name] = dict(counts.get)
        for name, n in (expect or {}).items():
            if seen[name]["rows"] != n:
                raise RuntimeError(f"{name}: wrote {seen[name]['rows']} rows, expected {n}")
        self._write(f"v={new}/_complete", json.dumps(self.fingerprint, sort_keys=True))
        return seen


def upserted(old: DataFrame | None, new: DataFrame, key: str) -> DataFrame:
    """new's rows, and old's whose key new lacks."""
    return new if old is None else old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def without_other_versions(points: DataFrame, current: DataFrame, doc: str = "doc_id", content: str = "sha256") -> DataFrame:
    """points without those of a document in `current` (doc, content) that have another content."""
    now = current.select(doc, F.col(content).alias("_now"))
    return points.join(now, doc, "left").where(F.col("_now").isNull() | (F.col(content) == F.col("_now"))).drop("_now")


def counts_by_version(points: DataFrame, doc: str = "doc_id", content: str = "sha256") -> DataFrame:
    return points.groupBy(doc, content).agg(F.count("*").alias("n"))
