"""The corpus pipeline: quality rules, near-duplicates, personal data, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All stages but
the last return the columns of documents; the last returns the placement of each piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrain.llm import mixing, neardup, packing, pii, rules
from docgrain.llm.common import read, written

#: Words of a shingle of the near-duplicate stage; op8's contract (two words) binds that query only.
SHINGLE = 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the forest reject go."""
    return rules.passing(docs, rules.fit(docs, read(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; linked are those whose five-word shingles agree by 80 %."""
    return neardup.one_of_each(docs, written(neardup.near_duplicates(docs, SHINGLE), "pipeline-neardup"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each span of personal data is replaced by its kind."""
    return pii.redacted(docs, pii.fit(pii.candidate_rows(docs)))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay, go, or occur twice, as the mix takes them."""
    return mixing.apply_mix(docs, written(mixing.mix(mixing.single(docs)), "pipeline-mix"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences."""
    import public_tokenizers

    items = written(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")), "pipeline-pieces")
    return packing.pack(items).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Tokens and the forest are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
