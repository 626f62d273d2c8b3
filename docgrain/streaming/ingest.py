"""Incremental ingest as a stream: new files are hashed, unchanged documents skipped, the others chunked and
swapped into a collection, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docgrain.operators import chunk, clean, registry
from docgrain.sources.collections import Collection, upserted, without_other_versions
from docgrain.sources.scratch import written


def ingest_batch(docs: DataFrame, into: Collection, signature: str, chunker: Callable[[DataFrame], DataFrame] = chunk.fixed_windows) -> dict[str, int]:
    """docs (doc_id, text) -> counts. A document without chunks is marked failed and tried again. A repeated document counts once, by its greatest content hash."""
    hashed = docs.withColumn("sha256", F.sha2("text", 256)).groupBy("doc_id").agg(F.max_by("text", "sha256").alias("text"), F.max("sha256").alias("sha256"))
    hashed = written(hashed, "ingest-docs")
    known = into.table("registry") if into.exists() else None
    new = written(clean.pending(hashed, known, signature), "ingest-new") if known is not None else hashed
    total, todo = hashed.count(), new.count()
    if not todo:
        return {"docs": total, "skipped": total, "indexed": 0}
    chunks = written(chunker(new).join(new.select("doc_id", "sha256"), "doc_id"), "ingest-chunks")
    status = registry.outcomes(new, new, chunks).select("doc_id", "status")
    rows = new.select("doc_id", "sha256", F.lit(signature).alias("index_sig")).join(status, "doc_id")
    old = into.table("chunks") if into.exists() else None
    kept = None if old is None else without_other_versions(old.join(rows.select("doc_id"), "doc_id", "left_anti"), rows)
    seen = into.replace({"chunks": chunks if kept is None else kept.unionByName(chunks), "registry": upserted(known, rows, "doc_id")}, measures={"registry": {"failed": F.count_if(F.col("status") == "failed")}})
    return {"docs": total, "skipped": total - todo, "indexed": todo, "chunks": seen["chunks"]["rows"], "failed": seen["registry"]["failed"]}


def ingest_stream(spark: SparkSession, path: str, into: Collection, signature: str, checkpoint: str, schema: str = "doc_id long, text string") -> StreamingQuery:
    """All files that are there now, and no more (availableNow); started again, only newer ones."""
    docs = spark.readStream.schema(schema).parquet(path)
    return docs.writeStream.foreachBatch(lambda batch, _: ingest_batch(batch, into, signature)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and means by key and time window; on a stream, windows close once `late` has passed."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), key).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
