"""Metrics of many runs: one table of them, and the run that stands for a configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The metrics of the table, and how much of each hash it shows.
METRICS = ("hit@5", "r@5", "r@10", "p@5", "ndcg@10", "mrr")
HASHES = {"config_hash": 12, "index_sig": 12, "git_sha": 8}


def retrieval_table(runs: DataFrame) -> DataFrame:
    """runs (path, json) -> path, profile, split, n, hashes, metrics; what a run lacks is null (hashes: empty)."""
    kind = "profile string, split string, n int, overall map<string, double>, " + ", ".join(f"{h} string" for h in HASHES)
    d = runs.select("path", F.from_json("json", kind).alias("r")).select("path", "r.*")
    n = F.coalesce(F.nullif(F.try_element_at("overall", F.lit("n")).cast("int"), F.lit(0)), F.col("n"), F.lit(0))
    hashes = [F.substring(F.coalesce(h, F.lit("")), 1, k).alias(h) for h, k in HASHES.items()]
    return d.select("path", "profile", "split", n.alias("n"), *hashes, *[F.try_element_at("overall", F.lit(m)).alias(m) for m in METRICS])


def shown(value: Column, digits: int = 3) -> Column:
    """A metric as tables show it; null as nothing."""
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", F.round(value, digits))).otherwise("")


def generation_table(runs: DataFrame, others: DataFrame) -> DataFrame:
    """runs (path, json), others (path, json: a second judge's of the same run) -> path, profile, split, n, hashes, the answers' metrics,
    abstention as 'precision / recall', the median latency in seconds as text; null or empty where a run lacks them."""
    kind = "profile string, split string, n int, custom map<string, double>, ragas map<string, double>, " + ", ".join(f"{h} string" for h in HASHES)
    d = runs.select("path", F.from_json("json", kind).alias("r")).select("path", "r.*")
    second = others.select("path", F.try_element_at(F.from_json("json", "overall map<string, double>")["overall"], F.lit("faithfulness")).alias("faithfulness_deepeval"))
    own, ragas = (lambda name, of=of: F.try_element_at(of, F.lit(name)) for of in ("custom", "ragas"))
    n = F.coalesce(F.nullif("n", F.lit(0)), own("n").cast("int"), F.lit(0))
    pair = [own(f"abstention_{x}") for x in ("precision", "recall")]
    abstain = F.when(pair[0].isNotNull() | pair[1].isNotNull(), F.concat(shown(pair[0]), F.lit(" / "), shown(pair[1]))).otherwise("")
    late = own("latency_p50_ms")
    late = F.when(late.isNotNull(), F.concat(shown(late / 1000.0, 1), F.lit("s"))).otherwise("")
    hashes = [F.substring(F.coalesce(h, F.lit("")), 1, k).alias(h) for h, k in HASHES.items()]
    metrics = [own("mean_groundedness").alias("groundedness"), *[own(m).alias(m) for m in ("route_accuracy", "citation_validity")]]
    out = d.select("path", "profile", "split", n.alias("n"), *hashes, ragas("faithfulness").alias("faithfulness_ragas"), *metrics, abstain.alias("abstain"), late.alias("latency_p50"))
    return out.join(second, "path", "left")


def table_lines(rows: DataFrame, columns: list[str], metrics: list[str]) -> DataFrame:
    """line: a table's row of `columns` and `metrics` (shown with three digits) as Markdown."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns] + [shown(F.col(f"`{m}`")) for m in metrics]
    return rows.select("path", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def standing_run(runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """runs (profile, split, config_hash, modified, path), wanted (profile, split, config_hash) -> wanted with path: the newest run of
    just this configuration, else the newest of its profile and split; null for none. Equal times: the greater path."""
    newest = lambda keys: runs.groupBy(*keys).agg(F.max_by("path", F.struct("modified", "path")).alias("path"))
    keys = ["profile", "split"]
    exact, near = newest([*keys, "config_hash"]), newest(keys).withColumnRenamed("path", "_near")
    out = wanted.join(exact, [*keys, "config_hash"], "left").join(near, keys, "left")
    return out.withColumn("path", F.coalesce("path", "_near")).drop("_near")
