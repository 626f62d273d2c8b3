"""Evaluation: relevance, retrieval metrics, answer metrics, agreement of judges, misses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgrain.functions import text as X
from docgrain.operators import contain
from docgrain.sources.scratch import written


def relevant_documents(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs (doc_id, text), spans (item_id, text) -> item_id, doc_id where the text holds the span verbatim."""
    return contain.holders(docs, spans).select("item_id", "doc_id")


def relevant_chunks(found: DataFrame, chunks: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """found (item_id, chunk_id, rank), chunks (chunk_id, doc_id, text), items (query_id, item_id, doc_id, span) -> query_id, chunk_id,
    rank, relevant, of the chunks of an item's document that were found for its passage.

    A chunk is relevant if it holds every fragment of the span, each as it is or nearly; a span without fragments is held by none.
    Only these pairs are compared, `found` rows at most, and the chunks are gone through once."""
    chunks = written(chunks.select("chunk_id", "doc_id", "text").join(found.select("chunk_id").distinct(), "chunk_id", "left_semi"), "found-chunks")
    own = found.join(chunks, "chunk_id").join(items.select("query_id", "item_id", "doc_id", "span"), ["item_id", "doc_id"])
    parts = F.array_distinct(X.fragments("span"))
    both = own.select("query_id", "chunk_id", "rank", parts.alias("parts"), X.normalize("text").alias("text")).repartition("query_id", "chunk_id")
    return both.select("query_id", "chunk_id", "rank", X.fuzzy_holds_all(threshold)(F.col("parts"), F.col("text")).alias("relevant"))


def question_metrics(results: DataFrame, items: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """results (query_id, rank, relevant), items (query_id, ...): mrr and p, hit, ndcg at each k for each item.

    p divides by k even where fewer rows came back; ndcg's ideal has the hits inside the top k."""
    hit = F.col("relevant") & F.col("rank").isNotNull()
    aggregates = [F.coalesce(1.0 / F.min(F.when(hit, F.col("rank"))), F.lit(0.0)).alias("mrr")]
    for k in ks:
        top = hit & (F.col("rank") <= k)
        aggregates += [F.count_if(top).alias(f"n{k}"), F.coalesce(F.sum(F.when(top, 1.0 / F.log2(F.col("rank") + 1.0))), F.lit(0.0)).alias(f"dcg{k}")]
    out = items.join(results.select("query_id", "rank", "relevant"), "query_id", "left").groupBy(*items.columns).agg(*aggregates)
    for k in ks:
        n = F.col(f"n{k}")
        ideal = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
        out = out.withColumns({f"p@{k}": n / float(k), f"hit@{k}": F.when(n > 0, 1.0).otherwise(0.0), f"ndcg@{k}": F.when(n > 0, F.col(f"dcg{k}") / ideal).otherwise(0.0)})
    return out.drop(*[f"{x}{k}" for k in ks for x in ("n", "dcg")])


def span_recall(found: DataFrame, spans: DataFrame, k: int) -> DataFrame:
    """found (query_id, span_id, rank), spans (query_id, span_id): r, r_any, r_all at k."""
    best = found.groupBy("query_id", "span_id").agg(F.min("rank").alias("rank"))
    hit = F.coalesce(F.col("rank") <= k, F.lit(False))
    return spans.join(best, ["query_id", "span_id"], "left").groupBy("query_id").agg(F.avg(hit.cast("double")).alias("r"), F.max(hit.cast("double")).alias("r_any"), F.min(hit.cast("double")).alias("r_all"))


def aggregate_metrics(rows: DataFrame, metrics: list[str], keys: list[str], decimals: int = 6) -> DataFrame:
    """Means and n overall and by each key, in one pass: by, key, metrics, n. A blank key counts as all."""
    named = rows.withColumns({k: F.coalesce(F.nullif(F.col(k).cast("string"), F.lit("")), F.lit("all")) for k in keys})
    view = f"rows_{abs(hash((tuple(metrics), tuple(keys))))}"
    named.createOrReplaceTempView(view)
    sets = ", ".join(["()", *(f"({k})" for k in keys)])
    by = "CASE " + " ".join(f"WHEN grouping({k}) = 0 THEN '{k}'" for k in keys) + " ELSE 'overall' END"
    means = ", ".join(f"round(avg(`{m}`), {decimals}) AS `{m}`" for m in metrics)
    return rows.sparkSession.sql(f"SELECT {by} AS by, coalesce({', '.join(keys)}, 'all') AS key, {means}, count(*) AS n FROM {view} GROUP BY GROUPING SETS ({sets})")


def nearest_rank_of(rows: DataFrame, value: str, ps: tuple[int, ...]) -> DataFrame:
    """p, value for a whole table: counts by distinct value, added up, so no task holds all rows."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).count()
    bounds = counts.agg(F.sum("count").alias("n"))
    ranges = counts.repartitionByRange(value).withColumn("part", F.spark_partition_id())
    sums = ranges.groupBy("part").agg(F.sum("count").alias("own"))
    before = sums.select("part", (F.sum("own").over(Window.orderBy("part")) - F.col("own")).alias("before"))  # a row a partition
    upto = F.sum("count").over(Window.partitionBy("part").orderBy(value)) + F.col("before")
    placed = ranges.join(F.broadcast(before), "part").select(value, "count", upto.alias("upto"))
    wanted = bounds.select(F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.rint(p / 100.0 * (F.col("n") - 1)).alias("at")) for p in ps])).alias("w")).select("w.p", "w.at")
    return placed.join(F.broadcast(wanted), (F.col("at") >= F.col("upto") - F.col("count")) & (F.col("at") < F.col("upto"))).select("p", F.col(value).alias("value"))


def answer_metrics(samples: DataFrame, decimals: int = 6) -> DataFrame:
    """One row: route accuracy, abstention, citations, groundedness, latency, calls; 0 where undefined.

    samples: expected_route, predicted_route, expected_abstain, abstained, citations_valid, groundedness, latency_ms, llm_calls."""
    want, did = F.col("expected_abstain"), F.col("abstained")
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), decimals)
    one = samples.agg(
        F.count("*").cast("double").alias("n"),
        share(F.count_if(F.col("predicted_route").eqNullSafe(F.col("expected_route"))), F.count("*")).alias("route_accuracy"),
        share(F.count_if(want & did), F.count_if(did)).alias("abstention_precision"),
        share(F.count_if(want & did), F.count_if(want)).alias("abstention_recall"),
        share(F.count_if(F.col("citations_valid")), F.count("citations_valid")).alias("citation_validity"),
        F.round(F.coalesce(F.avg("groundedness"), F.lit(0.0)), decimals).alias("mean_groundedness"),
        F.round(F.coalesce(F.avg("llm_calls"), F.lit(0.0)), decimals).alias("llm_calls_per_query"),
    )
    ranks = nearest_rank_of(samples, "latency_ms", (50, 95))
    late = ranks.agg(*[F.coalesce(F.max(F.when(F.col("p") == p, F.col("value").cast("double"))), F.lit(0.0)).alias(f"latency_p{p}_ms") for p in (50, 95)])
    return one.join(F.broadcast(late))  # one row each


def spearman(pairs: DataFrame, x: str, y: str, decimals: int = 6) -> DataFrame:
    """n, spearman by average ranks; 0 for fewer than two pairs or no variance.

    Ranks come from counts by distinct value, so the rows themselves are never put in one order."""

    def average_ranks(column: str) -> DataFrame:
        counts = pairs.groupBy(column).count().repartitionByRange(column).withColumn("part", F.spark_partition_id())
        sums = counts.groupBy("part").agg(F.sum("count").alias("own"))
        before = sums.select("part", (F.sum("own").over(Window.orderBy("part")) - F.col("own")).alias("before"))
        upto = F.sum("count").over(Window.partitionBy("part").orderBy(column)) + F.col("before")
        placed = counts.join(F.broadcast(before), "part").withColumn("upto", upto)
        return placed.select(column, (F.col("upto") - F.col("count") + (F.col("count") + 1) / 2.0).alias(f"rank_{column}"))

    both = pairs.join(average_ranks(x), x).join(average_ranks(y), y)
    r = F.corr(f"rank_{x}", f"rank_{y}")
    return both.agg(F.count("*").alias("n"), F.round(F.when(F.count("*") < 2, 0.0).otherwise(F.coalesce(F.nanvl(r, F.lit(0.0)), F.lit(0.0))), decimals).alias("spearman"))


def samples_of(items: DataFrame, records: DataFrame, default_route: str = "corpus_technical") -> DataFrame:
    """Evaluation samples: items (id, question, gold_answer, gold_spans, expected_abstain, expected_route, bucket) with their records (id,
    retrieved_contexts, answer, route, abstained, quotes, latency_ms, llm_calls, groundedness); records of unknown ids go.

    Empty contexts are left out; citations_valid is null without quotes, else whether each occurs in some context."""
    text = lambda c: F.coalesce(c, F.lit(""))
    whole = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c)
    both = items.join(records, "id").withColumn("retrieved_contexts", F.filter(F.coalesce("retrieved_contexts", F.array().cast("array<string>")), lambda c: text(c) != ""))
    hay = F.transform("retrieved_contexts", X.normalize)
    held = F.forall("quotes", lambda q: (F.trim(text(q)) != "") & F.exists(hay, lambda c: F.contains(c, X.normalize(q))))
    return both.select(
        "id", "question", "retrieved_contexts", text(F.col("answer")).alias("answer"), reference(F.col("gold_answer"), F.col("gold_spans")).alias("reference"), "expected_abstain", "expected_route",
        F.coalesce(F.nullif("route", F.lit("")), F.lit(default_route)).alias("predicted_route"), F.coalesce("abstained", F.lit(False)).alias("abstained"),
        F.when(F.size("quotes") > 0, held).alias("citations_valid"), whole("latency_ms"), whole("llm_calls"), "groundedness", "bucket",
    )


def paired(a: DataFrame, b: DataFrame, score: str, names: tuple[str, str] = ("ragas", "deepeval")) -> DataFrame:
    """id and the scores of two judges, (id, score) each, where both have one."""
    one = lambda d, name: d.where(F.col(score).isNotNull()).select("id", F.col(score).alias(name))
    return one(a, names[0]).join(one(b, names[1]), "id")


def disagreements(pairs: DataFrame, x: str, y: str, delta: float = 0.3) -> DataFrame:
    return pairs.where(F.abs(F.col(x) - F.col(y)) > delta)


def framework_means(rows: DataFrame, scores: list[str], skip: Column, decimals: int = 6) -> DataFrame:
    """The mean of each score over rows that are not skipped and have it, and how many; 0 without any."""
    kept = rows.where(~skip)
    return kept.agg(*[x for s in scores for x in (F.round(F.coalesce(F.avg(s), F.lit(0.0)), decimals).alias(s), F.count(s).alias(f"n_{s}"))])


def miss_tag(doc_id: Column, doc_ids: Column, hit5: Column, hit10: Column) -> Column:
    return (
        F.when(doc_id.isNotNull() & ~F.array_contains(F.coalesce(doc_ids, F.array()), doc_id), "exact_term_miss")
        .when(F.coalesce(hit10, F.lit(0.0)) == 0, "chunk_boundary")
        .when(F.coalesce(hit5, F.lit(0.0)) == 0, "reranker_demoted_gold")
        .otherwise("header_noise")
    )


def top_misses(rows: DataFrame, n: int = 20) -> DataFrame:
    """The n worst of the rows (id, doc_id, doc_ids, hit@5, hit@10, r@10, mrr) that miss something: lowest recall, then mrr, then id."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    missed = rows.where((zero("hit@10") == 0) | (zero("r@10") < 1)).withColumn("tag", miss_tag(F.col("doc_id"), F.col("doc_ids"), F.col("hit@5"), F.col("hit@10")))
    return missed.orderBy(zero("r@10"), zero("mrr"), "id").limit(n)


def included(items: DataFrame) -> DataFrame:
    """Items that count for retrieval: not general, not to be abstained from, with a gold span."""
    return items.where((F.col("bucket") != "general") & ~F.col("expected_abstain") & (F.size("gold_spans") > 0))


def reference(answer: Column, spans: Column) -> Column:
    """The gold answer, else the gold spans as one text, else null."""
    return F.coalesce(F.nullif(answer, F.lit("")), F.nullif(F.array_join(spans, " "), F.lit("")))


def missing_inputs(needs: dict[str, tuple[str, ...]], filled: dict[str, Column]) -> dict[str, Column]:
    """For each metric, whether an input that it needs is missing; such rows stay out of its mean."""
    lacks = lambda fields: [~F.coalesce(filled[f], F.lit(False)) for f in fields]
    return {m: F.array_contains(F.array(*lacks(fields)), True) if fields else F.lit(False) for m, fields in needs.items()}


def citations_hold(quotes: Column, text: Column) -> Column:
    """Null without quotes; else whether every quote is filled and occurs in the normalised text."""
    fine = F.forall(quotes, lambda q: (F.trim(q) != "") & F.contains(text, X.normalize(q)))
    return F.when(F.size(quotes) > 0, F.coalesce(fine, F.lit(False)))


def inventory(clauses: DataFrame, slots: list[str], yes: list[str], pairs: list[tuple[str, str]], doc: str = "doc_id") -> DataFrame:
    """clauses (doc, category, spans array, answer), a row a category -> doc, bucket, category, spans, answer.

    slot: spans, and an answer other than yes and no. yes_span and no_answer: with and without spans.
    cross_ref: both categories of a pair have spans."""
    has = F.size(F.coalesce("spans", F.array().cast("array<string>"))) > 0
    answered = ~F.lower(F.coalesce("answer", F.lit(""))).isin("", "yes", "no")
    bucket = F.when(F.col("category").isin(*slots) & has & answered, "slot").when(F.col("category").isin(*yes), F.when(has, "yes_span").otherwise("no_answer"))
    single = clauses.withColumn("bucket", bucket).where("bucket IS NOT NULL")
    answer = F.when(F.col("bucket") == "slot", F.col("answer")).when(F.col("bucket") == "yes_span", "Yes")
    spans = F.when(F.col("bucket") != "no_answer", F.col("spans")).otherwise(F.array().cast("array<string>"))
    out = single.select(doc, "bucket", "category", spans.alias("spans"), answer.alias("answer"))
    for a, b in pairs:
        side = lambda c, name: clauses.where(has & (F.col("category") == c)).select(doc, F.col("spans").alias(name))
        both = side(a, "sa").join(side(b, "sb"), doc)
        out = out.unionByName(both.select(doc, F.lit("cross_ref").alias("bucket"), F.lit(f"{a} + {b}").alias("category"), F.concat("sa", "sb").alias("spans"), F.lit(None).cast("string").alias("answer")))
    return out
