"""The registered queries of the training-data operators, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrain.llm.common import crc_mod, read, written


def op1_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgrain.llm import pii

    found = written(pii.candidate_rows(read(spark, sf_dir, "documents")), "pii-candidates")
    return pii.spans(found, pii.fit(found))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgrain.llm import langid

    docs = read(spark, sf_dir, "documents").withColumn("held_out", crc_mod("doc_id", 3) == 1)
    parts = langid.sampled_pieces(docs.where(~F.col("held_out") & F.col("lang").isNotNull()))
    return langid.predict(docs, parts)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgrain.llm import rules

    docs = read(spark, sf_dir, "documents")
    return rules.judge(docs, rules.fit(docs, read(spark, sf_dir, "labels")))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from docgrain.llm import packing

    items = written(packing.pieces(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")), "packing-pieces")
    return packing.pack(items).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgrain.llm import fm

    docs = read(spark, sf_dir, "documents").withColumn("held_out", crc_mod("doc_id", 5) == 0)
    return fm.score(docs, fm.fit(docs.where(~F.col("held_out")), read(spark, sf_dir, "labels")))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgrain.llm import boilerplate

    return boilerplate.main_text(read(spark, sf_dir, "pages"))


def op7_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgrain.llm import voronoi

    return voronoi.top_k(read(spark, sf_dir, "embeddings"))


def op8_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgrain.llm import neardup

    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgrain.llm import mixing

    mixed = mixing.mix(mixing.overlapping(read(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def mixing_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op9's rows hold to, by source: its size and target, whether the words taken come near it, and how many
    documents exceed twice their size."""
    from docgrain.llm import mixing

    mixed = mixing.mix(mixing.overlapping(read(spark, sf_dir, "documents")))
    near = F.abs(F.sum("taken") - F.max("target")) <= 0.02 * F.sum("size") + 2 * F.max("size")
    sums = mixed.groupBy("source").agg(F.sum("size").alias("source_size"), F.round(F.max("target"), 6).alias("target"), near.alias("near"), F.count_if(F.col("taken") > 2 * F.col("size")).alias("n_over"))
    return sums.select("source", "source_size", "target", "near", "n_over")


def op10_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgrain.llm import chains

    docs = read(spark, sf_dir, "documents")
    return chains.score(docs, chains.fit(docs, read(spark, sf_dir, "labels")))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgrain.llm import repair

    rows = read(spark, sf_dir, "conversations")
    return repair.repaired_conversations(repair.damaged(rows), rows)


def op12_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from docgrain.llm import balance

    return balance.packing(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from docgrain.llm import align

    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return align.alignment(read(spark, sf_dir, "documents"), a, b, ranks)


QUERIES = {f.__name__: f for f in (op1_pii_spans, op2_language_id, op3_quality_rules, op4_best_fit_packing, op5_quality_classifier, op6_main_text, op7_voronoi_topk, op8_minhash_neardup, op9_source_mixing, op10_toxicity_chain, op11_conversation_repair, op12_cost_packing, op13_token_alignment, mixing_contract)}

SQL = {
    "op7_voronoi_topk": r"""
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (
  SELECT q.n, q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.x, v.x) AS BIGINT) AS score FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.n <> v.n)
SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s
QUALIFY rank <= 10""",
    "op8_minhash_neardup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN coalesce(len(ws), 0) = 0 THEN [] WHEN len(ws) = 1 THEN ws
    ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n_shingles + ny.n_shingles - c)),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, l.y FROM reach r JOIN both_ways l ON l.x = r.y),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT n.doc_id, n.n_shingles, c.component_id, n.doc_id = c.component_id AS kept FROM n JOIN c USING (doc_id)""",
    # The flow is beyond SQL; what its result must hold to is not.
    "mixing_contract": r"""
WITH d AS (
  SELECT source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size) AS source_size, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w FROM d GROUP BY source),
r AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST) AS k FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level FROM r),
first_open AS (SELECT arg_min(level, k) AS level FROM l WHERE level * w < cap)
SELECT source, CAST(source_size AS BIGINT) AS source_size, round(least(cap, coalesce((SELECT level FROM first_open), 1e300) * w), 6) AS target, true AS near, 0::BIGINT AS n_over FROM l""",
}
