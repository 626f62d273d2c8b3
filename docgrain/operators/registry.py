"""The document registry, the catalog made of it, and joins of sources by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrain.functions import text as X


def catalog(manifest: DataFrame, registry: DataFrame) -> DataFrame:
    """Manifest rows, and indexed registry rows whose doc_id the manifest lacks: doc_id, name, kind."""
    more = registry.where(F.col("status") == "indexed").join(manifest.select("doc_id"), "doc_id", "left_anti")
    return manifest.select("doc_id", "name", "kind").unionByName(more.select("doc_id", "name", "kind"))


def listed(rows: DataFrame, order: tuple[str, ...] = ("kind", "doc_id"), **equal: object) -> DataFrame:
    """The rows in order, those that equal what is asked for."""
    for name, value in equal.items():
        rows = rows.where(F.col(name) == F.lit(value))
    return rows.orderBy(*order)


def looked_up(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each asked id with its row, nulls where there is none."""
    return ids.select(key).join(rows, key, "left")


def work_list(manifest: DataFrame, paths: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """doc_id, path, kind of what an ingest takes: the paths (path) if given, else the manifest (doc_id, path, kind) in the order of
    doc_id, as far as the limit goes."""
    if paths is not None:
        return paths.select(X.normal_stem("path").alias("doc_id"), "path", F.lit(None).cast("string").alias("kind"))
    out = manifest.select("doc_id", "path", "kind").orderBy("doc_id")
    return out if limit is None else out.limit(limit)


def marked(registry: DataFrame, outcome: DataFrame) -> DataFrame:
    """The registry after a run: outcome (doc_id, sha256, index_sig, status) replaces a document's row."""
    same = registry.join(outcome.select("doc_id"), "doc_id", "left_anti")
    return same.unionByName(outcome, allowMissingColumns=True)


def first_and_last(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Two lookups over a file's rows: by stem the last row wins, by alphanumeric key the first."""
    keyed = rows.withColumns({"stem": X.normal_stem(name), "key": X.stem_key(name)})
    whole = F.struct(*rows.columns)
    by_stem = keyed.groupBy("stem").agg(F.max_by(whole, order).alias("by_stem"))
    by_key = keyed.groupBy("key").agg(F.min_by(whole, order).alias("by_key"))
    return keyed.select("stem", "key").distinct().join(by_stem, "stem").join(by_key, "key")


def joined_sources(pdfs: DataFrame, rows: DataFrame, texts: DataFrame, order: str = "seq") -> DataFrame:
    """pdfs (name, ...) with the clause row and the text of the same stem, else of the same key; `missing`
    names the sides that neither has (csv, txt, csv+txt)."""

    def sided(right: DataFrame, mark: str) -> tuple[DataFrame, DataFrame]:
        keyed = right.withColumns({"stem": X.normal_stem("name"), "key": X.stem_key("name")})
        return (
            keyed.groupBy("stem").agg(F.max_by("name", order).alias(f"{mark}_by_stem")),
            keyed.groupBy("key").agg(F.min_by("name", order).alias(f"{mark}_by_key")),
        )

    out = pdfs.withColumns({"stem": X.normal_stem("name"), "key": X.stem_key("name")})
    for right, mark in ((rows, "csv"), (texts, "txt")):
        by_stem, by_key = sided(right, mark)
        out = out.join(by_stem, "stem", "left").join(by_key, "key", "left")
        out = out.withColumn(mark, F.coalesce(f"{mark}_by_stem", f"{mark}_by_key")).drop(f"{mark}_by_stem", f"{mark}_by_key")
    absent = F.concat_ws("+", F.when(F.col("csv").isNull(), "csv"), F.when(F.col("txt").isNull(), "txt"))
    return out.withColumn("missing", F.nullif(absent, F.lit("")))


def split_overlap(a: DataFrame, b: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents that both splits hold; must be empty."""
    return a.select(key).intersect(b.select(key))


def outcomes(docs: DataFrame, pending: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, status (skipped, indexed, or failed for lack of chunks), n_chunks, of a run that chunked `pending`."""
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    todo = pending.select("doc_id", F.lit(True).alias("_todo"))
    out = docs.select("doc_id").join(todo, "doc_id", "left").join(counts, "doc_id", "left")
    n = F.when(F.col("_todo"), F.coalesce("n_chunks", F.lit(0))).otherwise(0)
    return out.select("doc_id", F.when(F.col("_todo").isNull(), "skipped").when(n > 0, "indexed").otherwise("failed").alias("status"), n.cast("long").alias("n_chunks"))


def ingest_report(docs: DataFrame, outcome: DataFrame) -> DataFrame:
    """One row: docs, skipped, indexed, failed, and the indexed documents' chars, est_tokens and chunks."""
    rows = docs.select("doc_id", F.length("text").alias("chars"), X.estimate_tokens("text").alias("tokens")).join(outcome, "doc_id")
    done = F.col("status") == "indexed"
    total = lambda c: F.coalesce(F.sum(F.when(done, F.col(c))), F.lit(0)).cast("long")
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("skipped", "indexed", "failed")]
    return rows.agg(F.count("*").alias("docs"), *counts, total("chars").alias("chars"), total("tokens").alias("est_tokens"), total("n_chunks").alias("chunks"))
