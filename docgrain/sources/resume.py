"""Runs that are carried on where they stopped: items are dealt into batches by key, a batch's results are written once.

Layout: <root>/batch=<n>/ with Spark's own mark of success. A batch that was killed has no mark; it is made again, over whatever it left.
Batches depend on keys alone, so a restart repeats no finished item and loses none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class FinalistGateError(RuntimeError):
    """A test split was asked for by a profile that is no finalist."""


def admitted(profile: str, split: str, finalists: DataFrame, column: str = "value") -> None:
    """Refuses the test split unless `finalists` (a profile a row) lists the profile; other splits than dev and test are errors."""
    if split not in ("dev", "test"):
        raise ValueError(f"split must be dev or test, got {split!r}")
    if split == "test" and finalists.where(F.col(column) == profile).isEmpty():
        raise FinalistGateError(f"test split refused: {profile!r} is no finalist")


def batch_of(key: str | Column, batches: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(batches)).cast("int")


class Run:
    def __init__(self, spark: SparkSession, root: str, batches: int):
        if batches < 1:
            raise ValueError("a run has at least one batch")
        self.spark, self.root, self.batches = spark, root, batches

    def finished(self) -> list[int]:
        """The batches that have their mark."""
        out = []
        for n in range(self.batches):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/batch={n}/_SUCCESS")
            if path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
                out.append(n)
        return out

    def results(self) -> DataFrame | None:
        """What finished batches hold; null for none."""
        paths = [f"{self.root}/batch={n}" for n in self.finished()]
        return self.spark.read.parquet(*paths) if paths else None

    def carry_on(self, items: DataFrame, work: Callable[[DataFrame], DataFrame], key: str = "id", most: int | None = None) -> list[int]:
        """work(items of a batch) for each batch without results, `most` of them at most; returns the batches made. Items that came after
        their batch was finished are none of it: see left()."""
        done, made = set(self.finished()), []
        for n in range(self.batches):
            if n in done:
                continue
            if len(made) == most:
                break
            work(items.where(batch_of(key, self.batches) == n)).write.mode("overwrite").parquet(f"{self.root}/batch={n}")
            made.append(n)
        return made

    def left(self, items: DataFrame, key: str = "id") -> DataFrame:
        """Items that no finished batch holds."""
        found = self.results()
        return items if found is None else items.join(found.select(key), key, "left_anti")
