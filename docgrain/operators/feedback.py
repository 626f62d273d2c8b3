"""Query logs, ratings and their analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrain.sources.collections import Collection, upserted

# Allowed ratings and tags.
RATINGS = (-1, 1, 2, 3, 4, 5)
TAGS = ("wrong_answer", "hallucination", "wrong_citation", "missing_citation", "incomplete", "should_have_abstained", "should_not_have_abstained", "good")


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last version of each key: an upsert log read back. A group keeps one row while it is added up."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("row")).select("row.*")


def violations(feedback: DataFrame, tags: str | None = None) -> DataFrame:
    """Rows whose rating is outside the domain or that have an unknown tag."""
    bad = ~F.coalesce(F.col("rating").isin(*RATINGS), F.lit(False))
    if tags:
        bad = bad | (F.size(F.array_except(F.coalesce(F.col(tags), F.array().cast("array<string>")), F.array(*[F.lit(t) for t in TAGS]))) > 0)
    return feedback.where(bad)


def orphans(feedback: DataFrame, logs: DataFrame, key: str = "query_id") -> DataFrame:
    """Feedback without its query; a write with any must be refused."""
    return feedback.join(logs.select(key), key, "left_anti")


def refused(rows: DataFrame, logs: DataFrame) -> DataFrame:
    """rows (feedback_id, query_id, rating, tags) with `reason`, why each may not be written; null where it may."""
    known = logs.select(F.col("query_id").alias("_q")).distinct().withColumn("_known", F.lit(True))
    unknown = F.array_except(F.coalesce(F.col("tags"), F.array().cast("array<string>")), F.array(*[F.lit(t) for t in TAGS]))
    reason = (
        F.when(~F.coalesce(F.col("rating").isin(*RATINGS), F.lit(False)), F.concat(F.lit("rating "), F.coalesce(F.col("rating").cast("string"), F.lit("null"))))
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown tags "), F.array_join(unknown, ", ", "null")))
        .when(F.col("_known").isNull(), F.concat(F.lit("unknown query_id "), F.coalesce(F.col("query_id").cast("string"), F.lit("null"))))
    )
    return rows.join(known, F.col("query_id") == F.col("_q"), "left").select(*rows.columns, reason.alias("reason"))


def accepted(rows: DataFrame, logs: DataFrame) -> DataFrame:
    """rows, whole or not at all: reading one that is refused() is an error, so what writes them fails."""
    checked = refused(rows, logs).withColumn("reason", F.when(F.col("reason").isNotNull(), F.raise_error(F.concat(F.lit("feedback refused: "), F.col("reason")))))
    return checked.where(F.col("reason").isNull()).drop("reason")


def append(into: Collection, rows: DataFrame, logs: DataFrame) -> dict[str, dict[str, int]]:
    """Adds rows to the collection's table `feedback`, a later row of a feedback_id in place of an earlier one. One bad row leaves the table as it was."""
    old = into.table("feedback") if into.exists() else None
    return into.replace({"feedback": upserted(old, accepted(rows, logs), "feedback_id")})


def summary(rated: DataFrame, key: Column | str, decimals: int = 6) -> DataFrame:
    """key, n, mean_rating, up (4 and more), down (2 and less)."""
    k = F.col(key) if isinstance(key, str) else key
    return rated.groupBy(k.alias("key")).agg(F.count("*").alias("n"), F.round(F.avg("rating"), decimals).alias("mean_rating"), F.count_if(F.col("rating") >= 4).alias("up"), F.count_if(F.col("rating") <= 2).alias("down"))


def ratings_by(feedback: DataFrame, logs: DataFrame, key: str) -> DataFrame:
    """By a column of the log; null and blank are (none)."""
    named = logs.select("query_id", F.coalesce(F.nullif(F.col(key), F.lit("")), F.lit("(none)")).alias("_key"))
    return summary(feedback.join(named, "query_id"), "_key")


def cited_kinds(logs: DataFrame, kinds: DataFrame) -> DataFrame:
    """query_id, kind: each distinct type of a query's cited documents; (unknown) and (none) where there is none."""
    cited = logs.select("query_id", F.explode_outer("cited_doc_ids").alias("doc_id"))
    named = cited.join(kinds.select("doc_id", "kind"), "doc_id", "left")
    return named.select("query_id", F.when(F.col("doc_id").isNull(), "(none)").otherwise(F.coalesce("kind", F.lit("(unknown)"))).alias("kind")).distinct()


def ratings_by_kind(feedback: DataFrame, logs: DataFrame, kinds: DataFrame) -> DataFrame:
    """A rating counts once for each distinct type that its query cites."""
    return summary(feedback.join(cited_kinds(logs, kinds), "query_id"), "kind")


def worst_queries(feedback: DataFrame, logs: DataFrame, n: int = 20, decimals: int = 6) -> DataFrame:
    """Lowest mean rating first, then most ratings, then query_id."""
    means = feedback.groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.avg("rating"), decimals).alias("mean_rating"))
    return means.join(logs, "query_id").orderBy("mean_rating", F.desc("n"), "query_id").limit(n)


def export(feedback: DataFrame, logs: DataFrame, kinds: DataFrame) -> DataFrame:
    """One row a rating with its query: tags and the cited documents' distinct types joined by commas."""
    cited = logs.select("query_id", F.posexplode_outer("cited_doc_ids").alias("at", "doc_id")).join(kinds.select("doc_id", "kind"), "doc_id", "left")
    named = cited.where("doc_id IS NOT NULL").groupBy("query_id", F.coalesce("kind", F.lit("(unknown)")).alias("kind")).agg(F.min("at").alias("at"))
    ordered = named.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "kind"))), lambda x: x["kind"]), ",").alias("agreement_types"))
    out = feedback.join(logs.drop("cited_doc_ids"), "query_id").join(ordered, "query_id", "left")
    return out.withColumns({"tags": F.array_join(F.coalesce(F.col("tags"), F.array().cast("array<string>")), ","), "agreement_types": F.coalesce("agreement_types", F.lit(""))})


def flat_records(items: DataFrame, answers: DataFrame, logs: DataFrame) -> DataFrame:
    """One row an item with its answer and its log, as runs write them: items (id, bucket, question, expected_abstain, expected_route), answers
    (id, query_id, answer, route, abstained, citations, groundedness, rewrites), logs (query_id, retrieved_contexts, latency_ms, llm_calls,
    token_usage, trace_path). Items without an answer have no record; an answer without a log keeps nulls in its place."""
    both = items.join(answers, "id").join(logs, "query_id", "left")
    first = ["id", "bucket", "question", "answer", "route", "abstained", "expected_abstain", "expected_route", "retrieved_contexts", "citations", "latency_ms", "llm_calls"]
    return both.select(*first, "token_usage", "groundedness", "rewrites", "query_id", "trace_path")


def highlight_boxes(page_no: Column, page_end: Column, boxes: Column) -> Column:
    """A citation's boxes have no page of their own: they hold where it begins and ends on one page."""
    return F.when(F.coalesce(page_end, page_no) == page_no, F.coalesce(boxes, F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>"))).otherwise(F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>"))
