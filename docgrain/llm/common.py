"""What the training-data operators share: tables, words, scratch tables, components."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters; bytes.split() cuts just so.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table. One with fewer splits than the session has cores is dealt over all of them, for the work is on whole
    texts; a larger one is left as it is split and nothing moves."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df if table not in ("documents", "pages") or df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only on a local master (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a scratch table that nothing reads any more."""
    spark = df.sparkSession
    root = scratch_dir(spark).removeprefix("file://").removeprefix("file:")
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if root in name:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def crc_mod(key: str | Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; null keys count as the empty text."""
    c = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `rows` rows, so that what Python makes of a batch of texts stays small.
    At the end of the partition, freed memory goes back to the system: workers live on for later stages."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_batches(batches: Iterator[pa.RecordBatch], kind: pa.DataType = pa.string()) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices with their column `text` as Python values, nulls as empty; kind: pa.string() or pa.binary()."""
    empty = "" if kind == pa.string() else b""
    for batch in slices(batches):
        texts = batch.column(batch.schema.get_field_index("text")).cast(kind).to_pylist()
        yield batch, [empty if t is None else t for t in texts]


def by_bytes(batches: Iterator[pa.RecordBatch], most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of at most 1,000 rows and `most` bytes of their column `text` (one longer text stands alone)."""
    for batch in slices(batches):
        texts = batch.column(batch.schema.get_field_index("text"))
        upto = np.cumsum(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(float)))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + most, "right")))
            yield batch.slice(a, b - a)
            a = b


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, pick, rows: int, seed: int, columns: tuple[str, ...]) -> DataFrame:
    """doc_id, label and `columns` of docs, of at most `rows` labelled documents, by hash order: one row a doc_id (the least,
    and of its labels what `pick` picks), so that what is collected of them is bounded too."""
    few = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(pick(label).cast("int").alias("label"))
    few = few.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(rows)
    joined = docs.select("doc_id", *columns).join(F.broadcast(few), "doc_id")
    return joined.groupBy("doc_id", "label").agg(F.min(F.struct(*columns)).alias("one")).select(F.col("doc_id").cast("long").alias("doc_id"), "label", "one.*")


#: No more keys than this can each hold more than its share of the rows: the bound of what is broadcast for them.
HOT_KEYS, HOT_ROWS = 10_000, 1_000


def hot(counts: DataFrame, key: str | list[str], count: str, rows: int) -> DataFrame:
    """The keys with more than rows / HOT_KEYS (and HOT_ROWS) rows, with `parts` to deal them over: at most HOT_KEYS rows."""
    most = max(HOT_ROWS, rows // HOT_KEYS)
    keys = [key] if isinstance(key, str) else key
    return counts.where(F.col(count) > most).select(*keys, F.ceil(F.col(count) / most).cast("int").alias("parts"))


def salted(many: DataFrame, one: DataFrame, often: DataFrame, keys: list[str], deal: Column) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on keys with a column `salt` to join on too: rows of `many` that have a hot key are dealt
    over its parts, and the row of `one` is there for each part."""
    parts = F.coalesce("parts", F.lit(1))
    left = many.join(F.broadcast(often), keys, "left").withColumn("salt", F.pmod(deal, parts).cast("int")).drop("parts")
    right = one.join(F.broadcast(often), keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return left, right


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, comp): the smallest id reachable over edges (src, dst), for ids that have an edge.

    Each round takes the least label among the neighbours, then the label of that label, so long
    chains shorten quickly. The labels of a round are a written table.
    """
    edges = edges.select("src", "dst").where(F.col("src") != F.col("dst"))
    both = written(edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), f"{name}-edges")
    labels = written(both.groupBy(F.col("src").alias("id")).agg(F.least("id", F.min("dst")).alias("comp")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.select(F.col("id").alias("dst"), "comp"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("comp").alias("near"))
        least = labels.join(near, "id").select("id", F.least("comp", "near").alias("comp"), F.col("comp").alias("old"))
        jump = labels.select(F.col("id").alias("comp"), F.col("comp").alias("beyond"))
        new = written(least.join(jump, "comp", "left").select("id", F.least("comp", F.coalesce("beyond", "comp")).alias("comp"), "old"), f"{name}-{step}")
        changed = new.where(F.col("comp") != F.col("old")).limit(1).count()
        discard(labels)
        labels = new.select("id", "comp")
        if not changed:
            return labels
