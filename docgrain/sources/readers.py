"""Readers: text files, binary files, clause tables, item sets, checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrain.functions import text as X

ITEM_SCHEMA = "id string, doc_stem string, agreement_type string, category string, bucket string, question string, gold_spans array<string>, gold_answer string, expected_route string, expected_abstain boolean, split string"
BUCKETS, ROUTES, SPLITS = ("slot", "yes_span", "no_answer", "cross_ref", "general"), ("general", "corpus_technical", "ambiguous", "out_of_scope"), ("dev", "test")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table with fewer splits than the session has cores, dealt over all of them, for work on whole texts; a larger one is
    left as it is split and nothing moves."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, source_path, page_no 1, text: whole files."""
    found = spark.read.text(path, wholetext=True).withColumn("source_path", F.input_file_name())
    return found.select(X.normal_stem("source_path").alias("doc_id"), "source_path", F.lit(1).alias("page_no"), F.col("value").alias("text"))


def binary_files(spark: SparkSession, root: str, pattern: str = "*.[pP][dD][fF]") -> DataFrame:
    """path, folder, kind (null where the folder is not mapped), length, sha256; contents are hashed, not kept."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    folder = F.element_at(F.split("path", "/"), -2)
    return found.select("path", folder.alias("folder"), X.folder_type(folder).alias("kind"), "length", F.sha2("content", 256).alias("sha256"))


def unmapped(files: DataFrame) -> DataFrame:
    return files.where(F.col("kind").isNull())


def clause_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def item_set(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of evaluation items; a value outside its domain is an error, found when rows are read."""
    items = spark.read.schema(ITEM_SCHEMA).json(path, multiLine=True, mode="FAILFAST")
    fine = F.col("bucket").isin(*BUCKETS) & F.col("split").isin(*SPLITS) & F.coalesce(F.col("expected_route"), F.lit("corpus_technical")).isin(*ROUTES)
    return items.withColumn("id", F.when(fine, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("bad item "), F.col("id")))))


def remaining(items: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Items that a checkpoint does not hold."""
    return items.join(done.select(key), key, "left_anti")


def listed(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines without comments and blanks."""
    cut = F.trim(F.split(column, "#")[0])
    return lines.select(cut.alias(column)).where(F.col(column) != "")


def upload_errors(content: Column, name: Column, most_bytes: int = 25 * 1024 * 1024) -> Column:
    """Why an uploaded file is refused; null if it is not."""
    return (
        F.when(F.length(content) > most_bytes, "too large")
        .when(F.instr(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"), "%PDF") == 0, "not a PDF")
        .when(~F.lower(name).endswith(".pdf"), "name is not *.pdf")
    )
