"""Fusion and reranking of ranked lists: list_id, query_id, chunk_id, score, rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgrain.functions import text as X
from docgrain.operators.search import ranked
from docgrain.sources.scratch import written


def chunk_key(chunk_id: Column, doc_id: Column, chunk_idx: Column) -> Column:
    return F.coalesce(F.nullif(chunk_id, F.lit("")), F.concat_ws(":", doc_id, chunk_idx.cast("string")))


def rrf(lists: DataFrame, constant: int = 60, rank_base: int = 1, decimals: int = 9) -> DataFrame:
    """Sum of 1 / (constant + rank) over the lists; provenance names the lists in order, then rrf.

    rank_base 0 counts ranks from 0, as a search server does."""
    if constant < 1:
        raise ValueError("the constant must be 1 or more")
    share = 1.0 / (constant + F.col("rank") - 1 + rank_base)
    lists_of = F.array_append(F.transform(F.array_sort(F.collect_list(F.struct("list_id"))), lambda s: s["list_id"]), F.lit("rrf"))
    fused = lists.groupBy("query_id", "chunk_id").agg(F.round(F.sum(share), decimals).alias("score"), F.array_distinct(lists_of).alias("provenance"))
    return ranked(fused)


def dbsf(lists: DataFrame, decimals: int = 9) -> DataFrame:
    """Each list's scores over its mean plus and minus three deviations; 0.5 where all are equal; added up."""
    own = Window.partitionBy("query_id", "list_id")
    spread, mean = F.stddev_samp("score").over(own), F.avg("score").over(own)
    same = (F.min("score").over(own) == F.max("score").over(own)) | spread.isNull()
    scaled = F.when(same, 0.5).otherwise((F.col("score") - (mean - 3 * spread)) / F.nullif(6 * spread, F.lit(0.0)))
    return ranked(lists.withColumn("s", scaled).groupBy("query_id", "chunk_id").agg(F.round(F.sum("s"), decimals).alias("score")))


def weighted(lists: DataFrame, first: str, second: str, alpha: float = 0.5, decimals: int = 9) -> DataFrame:
    """alpha of the first list's min-max score and the rest of the second's; 0.5 where a list's are equal."""
    own = Window.partitionBy("query_id", "list_id")
    low, high = F.min("score").over(own), F.max("score").over(own)
    scaled = F.when(low == high, 0.5).otherwise((F.col("score") - low) / F.nullif(high - low, F.lit(0.0)))
    share = F.when(F.col("list_id") == first, alpha).when(F.col("list_id") == second, 1 - alpha)
    return ranked(lists.withColumn("s", scaled * share).groupBy("query_id", "chunk_id").agg(F.round(F.sum("s"), decimals).alias("score")))


def cut(one: DataFrame, n: int) -> DataFrame:
    """The first n, ranks from 1 again."""
    return ranked(one.drop("rank"), n)


def lexical_rerank(one: DataFrame, queries: DataFrame, chunks: DataFrame, n: int) -> DataFrame:
    """Scores a pair by the share of the query's distinct words that the chunk has; the slot of a cross encoder.

    Only the candidates' texts are read, joined by id; their ids are written, so that Spark knows how few they are before it moves a text."""
    one = written(one.select("query_id", "chunk_id"), "rerank")
    asked = queries.select("query_id", F.array_distinct(X.words("text")).alias("q"))
    texts = chunks.join(one.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id", X.words("text").alias("c"))
    both = one.join(texts, "chunk_id").join(asked, "query_id")
    score = F.when(F.size("q") == 0, 0.0).otherwise(F.round(F.size(F.array_intersect("q", "c")) / F.size("q"), 6))
    return ranked(both.select("query_id", "chunk_id", score.alias("score")), n)


def first_seen(rows: DataFrame, order: str = "seq", by: tuple[str, ...] = ("query_id", "chunk_id")) -> DataFrame:
    """Of rows that repeat a chunk of a query, the one that came first."""
    return rows.groupBy(*by).agg(F.min_by(F.struct(*rows.columns), order).alias("row")).select("row.*")
