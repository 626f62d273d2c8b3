"""The registered queries of the retrieval and evaluation operators; keys begin with the operator's id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docgrain.functions import encode as E
from docgrain.functions import text as X
from docgrain.operators import agent, chunk, clean, evaluate, feedback, fuse, registry, sampling, search
from docgrain.operators import runs as run_tables
from docgrain.plans import retrieval as R
from docgrain.sources import collections, readers
from docgrain.sources.readers import spread, table
from docgrain.sources.scratch import written
from docgrain.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def i32(name: str) -> Column:
    return F.col(name).cast("int").alias(name)


def i64(name: str) -> Column:
    return F.col(name).cast("long").alias(name)


LANGUAGE_FOLDERS = {"fr": "French", "de": "German", "en": "English"}


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents: a turn is a page."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), F.lit(0).alias("block_no"), "text", "role")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")


# Sources and sinks


@query
def S2_text_pages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.lit(1).alias("page_no"), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("sha256"))


@query
def S3_inventory(spark, sf_dir):
    folder = F.regexp_extract("url", r"^https?://[^/]+/([^/?#]*)", 1)
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGE_FOLDERS.items() for x in kv]), folder)
    return table(spark, sf_dir, "pages").groupBy(folder.alias("folder"), kind.alias("kind")).agg(F.count("*").alias("n")).withColumn("unmapped", F.col("kind").isNull())


@query
def S4_clause_lookup(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.concat("p_name", F.lit(".PDF")).alias("name"), F.col("p_partkey").alias("seq"))
    return registry.first_and_last(rows, "name", "seq").select("stem", "key", F.col("by_stem.seq").alias("last_by_stem"), F.col("by_key.seq").alias("first_by_key"))


@query
def S6_scan_chunks(spark, sf_dir):
    return R.chunks_of(table(spark, sf_dir, "documents")).select("chunk_id", "doc_id", F.length("text").cast("long").alias("n_chars"))


@query
def S7_registry_list(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("kind"), "source", "n_chars")
    return registry.listed(rows)


@query
def S7_registry_get(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return registry.looked_up(rows, table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id")))


@query
def S7_feedback_of_query(spark, sf_dir):
    """The filter is the operator: the feedback of one question."""
    return registry.listed(ratings(spark, sf_dir), ("feedback_id",), query_id=7).select("feedback_id", "query_id", "rating")


@query
def S10_work_list(spark, sf_dir):
    """The limit is the operator: the first documents of the manifest."""
    manifest = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("path"), F.col("lang").alias("kind"))
    return registry.work_list(manifest, limit=100)


@query
def K11_results_table(spark, sf_dir):
    """A run a source and language, its metrics those of the labels."""
    d = labelled(spark, sf_dir)
    runs = d.groupBy("source", "lang").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("mrr"), F.round(F.avg("toxic"), 6).alias("hit"), F.md5(F.concat_ws("/", "source", "lang")).alias("config_hash"))
    overall = F.create_map(F.lit("n"), F.col("n").cast("double"), F.lit("mrr"), F.col("mrr"), F.lit("hit@5"), F.col("hit"))
    payload = F.to_json(F.struct(F.col("source").alias("profile"), F.col("lang").alias("split"), "config_hash", overall.alias("overall")))
    return run_tables.retrieval_table(runs.select(F.concat_ws("/", "source", "lang").alias("path"), payload.alias("json"))).select("path", "profile", "split", "n", "config_hash", "git_sha", "mrr", "`hit@5`", "`r@5`")


@query
def K11_generation_table(spark, sf_dir):
    """A run a source and language; only some have a second judge, or say how often they abstained."""
    d = labelled(spark, sf_dir).groupBy("source", "lang").agg(F.count("*").alias("n"), F.avg("quality").alias("q"), F.avg("toxic").alias("t"), F.avg("n_chars").alias("c"))
    path, odd = F.concat_ws("/", "source", "lang"), F.col("n") % 2 == 1
    custom = F.create_map(F.lit("n"), F.col("n").cast("double"), F.lit("mean_groundedness"), F.round("q", 6), F.lit("abstention_recall"), F.when(odd, F.round("t", 6)), F.lit("latency_p50_ms"), F.round("c", 0))
    payload = F.to_json(F.struct(F.col("source").alias("profile"), F.col("lang").alias("split"), F.lit(0).alias("n"), F.md5(path).alias("git_sha"), custom.alias("custom"), F.create_map(F.lit("faithfulness"), F.round("t", 6)).alias("ragas")))
    second = d.where(odd).select(path.alias("path"), F.to_json(F.struct(F.create_map(F.lit("faithfulness"), F.round("q", 6)).alias("overall"))).alias("json"))
    found = run_tables.generation_table(d.select(path.alias("path"), payload.alias("json")), second)
    lines = run_tables.table_lines(found, ["profile", "split", "n", "abstain", "latency_p50", "git_sha"], ["faithfulness_ragas", "groundedness", "route_accuracy", "faithfulness_deepeval"])
    return found.join(lines, "path").select("path", "n", "git_sha", "faithfulness_ragas", "groundedness", "abstain", "latency_p50", "faithfulness_deepeval", "line")


@query
def M8_standing_run(spark, sf_dir):
    """Documents as runs of their source and language; asked for are the labelled texts, bad ones by a configuration that never ran."""
    run = lambda d, text: d.select(F.col("source").alias("profile"), F.col("lang").alias("split"), F.md5(text).alias("config_hash"), F.col("doc_id").alias("modified"), F.col("doc_id").cast("string").alias("path"))
    wanted = run(labelled(spark, sf_dir), F.when(F.col("quality") == 1, F.col("text")).otherwise("none")).select("profile", "split", "config_hash").distinct()
    return run_tables.standing_run(run(table(spark, sf_dir, "documents"), F.col("text")), wanted)


@query
def S8_remaining(spark, sf_dir):
    return readers.remaining(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source")


@query
def S9_catalog(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    manifest = docs.join(labels, "doc_id", "left_semi").select("doc_id", F.col("source").alias("name"), F.col("lang").alias("kind"))
    known = docs.select("doc_id", F.col("source").alias("name"), F.col("lang").alias("kind"), F.when(F.col("n_chars") > 0, "indexed").otherwise("failed").alias("status"))
    return registry.catalog(manifest, known)


@query
def K1_upsert(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    old = table(spark, sf_dir, "documents").select("doc_id", F.lit(-1).alias("state"))
    return collections.upserted(old, labels.groupBy("doc_id").agg(F.max("quality").alias("state")), "doc_id")


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every document's content hash, and for toxic ones an older one too; the current ones."""
    now = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    old = now.join(toxic, "doc_id").select("doc_id", F.sha2(F.concat("sha256", F.lit(":old")), 256).alias("sha256"))
    return now.unionByName(old), now


@query
def K2_other_versions_deleted(spark, sf_dir):
    points, now = versions(spark, sf_dir)
    return collections.without_other_versions(points, now)


@query
def K3_counts_by_version(spark, sf_dir):
    return collections.counts_by_version(versions(spark, sf_dir)[0])


@query
def K4_latest(spark, sf_dir):
    return feedback.latest(table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", "value")


@query
def K5_orphans(spark, sf_dir):
    logs = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("query_id"))
    return feedback.orphans(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id")), logs)


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as feedback on their user's query; ratings outside the domain are dropped."""
    of = F.element_at(F.array(*[F.lit(r) for r in feedback.RATINGS]), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("feedback_id"), F.col("user_id").alias("query_id"), of.alias("rating"), "event_type", "value")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query for each conversation: its first turn asks, and it cites documents of its own and double its id."""
    own = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("query_id")).agg(F.min_by("text", "turn").alias("question"), F.max_by("role", "turn").alias("route"), F.count("*").alias("n_turns"))
    return own.withColumn("cited_doc_ids", F.array(F.col("query_id"), F.col("query_id") * 2, F.col("query_id") + F.col("n_turns") * 1000))


@query
def K6_refused_writes(spark, sf_dir):
    """Ratings of conversations by events, some of them out of the domain, with unknown tags, or of no conversation."""
    tags = F.when(F.col("event_id") % 11 == 0, F.array(F.col("event_type"))).when(F.col("event_id") % 2 == 0, F.array(F.lit("good"), F.lit("incomplete")))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("feedback_id"), F.col("user_id").alias("query_id"), (F.col("event_id") % 8 - 1).cast("int").alias("rating"), tags.alias("tags"))
    logs_ = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"))
    return feedback.refused(rows, logs_).where("reason IS NOT NULL").select("feedback_id", "query_id", "reason")


@query
def K6_violations(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", (F.floor("value") % 9 - 2).cast("int").alias("rating"))
    return feedback.violations(rows)


@query
def K7_export(spark, sf_dir):
    kinds = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("kind"))
    rows = ratings(spark, sf_dir).withColumn("tags", F.array("event_type", F.lit("good")))
    out = feedback.export(rows, logs(spark, sf_dir), kinds)
    return out.select("feedback_id", "query_id", "rating", "tags", "route", F.md5("question").alias("question_md5"), "agreement_types")


# Cleaning


@query
def T1_strip_headers(spark, sf_dir):
    pages = turns(spark, sf_dir)
    return clean.strip_headers_footers(clean.line_units(pages), pages).select("doc_id", "page_no", i64("unit_no"), F.md5("text").alias("text_md5"))


@query
def T2_ratio(spark, sf_dir):
    docs = clean.ratio_report(table(spark, sf_dir, "documents"), X.norm_chars("text"), F.col("n_chars"))
    return docs.select("doc_id", "pdf_chars", "txt_chars", F.round("ratio", 9).alias("ratio"), "ratio_ok")


@query
def T4_pending(spark, sf_dir):
    docs = labelled(spark, sf_dir)
    sha = F.sha2("text", 256)
    known = docs.select("doc_id", F.when(F.col("toxic") == 1, "stale").otherwise(sha).alias("sha256"), F.lit("s1").alias("index_sig"), F.when(F.col("quality") == 1, "indexed").otherwise("failed").alias("status"))
    return clean.pending(table(spark, sf_dir, "documents").select("doc_id", sha.alias("sha256")), known, "s1").select("doc_id", "sha256")


@query
def A9_ingest_report(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2("text", 256).alias("sha256"))
    rows = labelled(spark, sf_dir)
    known = rows.select("doc_id", F.sha2("text", 256).alias("sha256"), F.lit("s1").alias("index_sig"), F.when(F.col("quality") == 1, "indexed").otherwise("failed").alias("status"))
    todo = clean.pending(docs, known, "s1")
    return registry.ingest_report(docs, registry.outcomes(docs, todo, R.chunks_of(todo)))


@query
def T5_exact_duplicates(spark, sf_dir):
    return clean.exact_duplicates(table(spark, sf_dir, "documents"))


@query
def T7_point_ids(spark, sf_dir):
    chunks = R.chunks_of(table(spark, sf_dir, "documents"))
    return chunks.select("chunk_id", X.point_id(F.col("doc_id"), F.sha2("text", 256), F.col("chunk_idx"), F.lit("sig")).alias("point_id"))


@query
def T8_document_ids(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", X.normal_stem("url").alias("doc_id"), F.contains(url, F.lit("/uploads/")).alias("is_upload"))


# Chunks


@query
def C1_joined_pages(spark, sf_dir):
    return chunk.join_pages(turns(spark, sf_dir)).select("doc_id", "page_no", "start", i64("end"))


@query
def C2_fixed_windows(spark, sf_dir):
    cut = chunk.fixed_windows(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", i64("chunk_idx"), i64("start"), i64("end"), F.md5("text").alias("text_md5"))


@query
def C3_packed_chunks(spark, sf_dir):
    cut = chunk.packed_chunks(spread(table(spark, sf_dir, "documents")))
    return cut.select("doc_id", i64("chunk_idx"), i64("start"), i64("end"), F.md5("text").alias("text_md5"))


@query
def C4_pages_covered(spark, sf_dir):
    blocks = turns(spark, sf_dir)
    cut = chunk.fixed_windows(chunk.document_text(blocks), 64, 8)
    return chunk.pages_covered(cut, chunk.join_pages(blocks)).select("doc_id", i64("chunk_idx"), i64("page_start"), i64("page_end"), i64("n_blocks"))


@query
def C5_header_and_tokens(spark, sf_dir):
    headed = chunk.with_header(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "lang")
    return headed.select("doc_id", X.estimate_tokens("text").cast("long").alias("est_tokens"), F.md5("text").alias("text_md5"))


# Encoders


@query
def E1_hash_dense(spark, sf_dir):
    v = table(spark, sf_dir, "documents").select("doc_id", E.hash_dense(F.col("text")).alias("v"))
    return v.select("doc_id", *[F.round(F.element_at("v", i + 1), 9).alias(f"v{i}") for i in range(8)])


@query
def E2_hash_sparse(spark, sf_dir):
    return search.hash_sparse(spread(table(spark, sf_dir, "documents")), "doc_id")


@query
def E5_sparse_encodings(spark, sf_dir):
    return search.bm25_sparse(R.chunks_of(table(spark, sf_dir, "documents")))


@query
def E5_sparse_search(spark, sf_dir):
    lists = written(search.stem_lists(R.chunks_of(table(spark, sf_dir, "documents"))), "sparse-chunks")
    found = search.bm25_sparse_top_k(lists, search.bm25_sparse_query(R.questions(spark, sf_dir)))
    return found.select("query_id", "chunk_id", "score", i32("rank"))


@query
def E6_normalised(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(E.l2_normalized(F.col("embedding"))).alias("at", "x"))
    return v.select("vec_id", i64("at"), F.round("x", 9).alias("x"))


@query
def A12_corpus_statistics(spark, sf_dir):
    _, terms, stats = search.bm25_index(R.chunks_of(table(spark, sf_dir, "documents")))
    return terms.select("term", i64("df")).join(F.broadcast(stats.select(i64("n"), F.round("avgdl", 6).alias("avgdl"))))


# Filters


@query
def P1_filter(spark, sf_dir):
    docs = search.matching(table(spark, sf_dir, "documents"), {"lang": ["de", "fr"]})
    return docs.groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


@query
def P2_unknown_type(spark, sf_dir):
    asked = table(spark, sf_dir, "documents").groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("types"))
    return asked.select("source", F.array_join(search.with_unknown(F.col("types")), ",").alias("types"))


@query
def P3_named_documents(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat_ws(":", "conv_id", "turn").alias("query_id"), "text")
    host = F.split(F.regexp_extract("url", r"^https?://([^/]+)", 1), r"\.")
    known = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.array_join(host, " ").alias("name"), F.regexp_extract("url", r"^https?://[^/]+/([a-z]*)", 1).alias("kind"))
    found = search.named_documents(asked, known, X.QUESTION_VOCABULARY, kinds_of=X.TYPE_ALIASES)
    return found.select("query_id", F.array_join(F.transform("doc_ids", lambda d: d.cast("string")), ",").alias("doc_ids"), "kind")


@query
def P4_named_type(spark, sf_dir):
    asked = F.concat(F.lit("What is the term of the "), F.col("p_name"), F.lit(" "), F.col("p_type"), F.lit(" Agreement?"))
    aliases = {"economy": "Economy", "small": "Small", "large": "Large", "promo": "Promo"}
    return table(spark, sf_dir, "part").select("p_partkey", X.named_type(asked, aliases).alias("kind"))


@query
def P6_merged_filters(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select("doc_id", search.merged_filters(F.col("lang"), F.when(F.col("toxic") == 1, "asked")).alias("kind"))


# Search and fusion


@query
def Q1_dense_top_k(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    parts = vectors.select("label", F.posexplode("embedding").alias("at", "x")).groupBy("label", "at").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
    centres = parts.groupBy(F.col("label").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("vector"))
    found = search.dense_top_k(vectors.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")), centres, 20)
    return found.select("query_id", F.col("chunk_id").alias("vec_id"), "score", i32("rank"))


@query
def Q2_sparse_top_k(spark, sf_dir):
    chunks, asked = R.chunks_of(table(spark, sf_dir, "documents")), R.questions(spark, sf_dir)
    found = search.sparse_top_k(written(search.hash_lists(chunks), "hash-chunks"), search.hash_sparse(asked, "query_id"))
    return found.select("query_id", "chunk_id", "score", i32("rank"))


@query
def Q3_bm25(spark, sf_dir):
    found = search.bm25_top_k(R.chunks_of(table(spark, sf_dir, "documents")), R.questions(spark, sf_dir))
    return found.select("query_id", "chunk_id", "score", i32("rank"))


@query
def Q4_server_hybrid(spark, sf_dir):
    found = R.hybrid(R.chunks_of(table(spark, sf_dir, "documents")), R.questions(spark, sf_dir), 10, rank_base=0)
    return found.select("query_id", "chunk_id", "score", i32("rank"))


@query
def Q5_client_hybrid(spark, sf_dir):
    return R.flagship(spark, sf_dir)


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.hybrid_lists(R.chunks_of(table(spark, sf_dir, "documents")), R.questions(spark, sf_dir))


@query
def F1_rrf_provenance(spark, sf_dir):
    found = fuse.rrf(lists(spark, sf_dir))
    return found.select("query_id", "chunk_id", "score", i32("rank"), F.array_join("provenance", ",").alias("provenance"))


@query
def F2_dbsf(spark, sf_dir):
    return fuse.dbsf(lists(spark, sf_dir)).select("query_id", "chunk_id", "score", i32("rank"))


@query
def F3_weighted(spark, sf_dir):
    return fuse.weighted(lists(spark, sf_dir), "dense", "sparse").select("query_id", "chunk_id", "score", i32("rank"))


@query
def R1_cut(spark, sf_dir):
    return fuse.cut(search.bm25_top_k(R.chunks_of(table(spark, sf_dir, "documents")), R.questions(spark, sf_dir)), 5).select("query_id", "chunk_id", "score", i32("rank"))


@query
def R2_lexical_rerank(spark, sf_dir):
    chunks, asked = R.chunks_of(table(spark, sf_dir, "documents")), R.questions(spark, sf_dir)
    return fuse.lexical_rerank(search.bm25_top_k(chunks, asked), asked, chunks, 10).select("query_id", "chunk_id", "score", i32("rank"))


def titles(docs: DataFrame) -> DataFrame:
    """The catalog of documents: a document's first five words are its name, its language its kind."""
    name = F.array_join(F.slice(F.split("text", " "), 1, 5), " ")
    return docs.select("doc_id", name.alias("name"), F.coalesce("lang", F.lit("Unknown")).alias("kind"))


@query
def R3_filtered_pipeline(spark, sf_dir):
    """Passages as questions, which may name documents by words of their titles; asked as they are and in normal form."""
    docs = table(spark, sf_dir, "documents")
    found = R.filtered_pipeline(R.chunks_of(docs), R.questions(spark, sf_dir), titles(docs), transforms=(X.normalize,))
    return found.select("query_id", "chunk_id", "score", i32("rank"))


@query
def R3_question_filters(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rules = R.question_filters(R.questions(spark, sf_dir), titles(docs))
    allowed = R.allowed_documents(rules, titles(docs)).groupBy("query_id").agg(F.count("*").alias("n_allowed"))
    return rules.join(allowed, "query_id", "left").select("query_id", F.array_join(F.transform("doc_ids", lambda d: d.cast("string")), ",").alias("doc_ids"), F.array_join("kinds", ",").alias("kinds"), F.coalesce("n_allowed", F.lit(0)).cast("long").alias("n_allowed"))


@query
def R4_merged_rounds(spark, sf_dir):
    found = lists(spark, sf_dir).withColumn("seq", F.col("rank") + F.when(F.col("list_id") == "dense", 0).otherwise(1000))
    return fuse.first_seen(found).select("query_id", "chunk_id", "list_id", i64("seq"))


# Evaluation


@query
def J6_relevant_documents(spark, sf_dir):
    return evaluate.relevant_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def gold_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each passage with each document that holds it: query_id ('item:doc'), item_id, doc_id, span, bucket."""
    spans = table(spark, sf_dir, "benchmark")
    pairs = evaluate.relevant_documents(table(spark, sf_dir, "documents"), spans).join(spans.select("item_id", F.col("text").alias("span")), "item_id")
    bucket = F.when(F.length("span") < 200, "short").otherwise("long")
    return written(pairs.select(F.concat_ws(":", F.col("item_id").cast("string"), F.col("doc_id").cast("string")).alias("query_id"), "item_id", "doc_id", "span", bucket.alias("bucket")), "items")


def found_and_judged(spark: SparkSession, sf_dir: str, items: DataFrame, threshold: float | None = None, n_words: int | None = None) -> tuple[DataFrame, DataFrame]:
    """BM25's ten best chunks a passage (asked for by its first n_words, or all), and which of them hold the whole passage of an
    item's document."""
    chunks, asked = R.chunks_of(table(spark, sf_dir, "documents")), R.questions(spark, sf_dir)
    if n_words:
        asked = asked.withColumn("text", F.array_join(F.slice(F.split("text", " "), 1, n_words), " "))
    found = written(search.bm25_top_k(chunks, asked, 10), "found")
    return found, R.judged(found, chunks, items, threshold)


@query
def J6_relevant_chunks(spark, sf_dir):
    """Fuzzy: a fragment that does not occur as it is may be alike by 90 of 100."""
    return found_and_judged(spark, sf_dir, gold_items(spark, sf_dir), 90.0)[1]


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = gold_items(spark, sf_dir)
    return evaluate.question_metrics(found_and_judged(spark, sf_dir, items)[1], items.select("query_id", "bucket"))


METRICS = ["mrr", *(f"{m}@{k}" for k in (1, 3, 5, 10) for m in ("p", "hit", "ndcg"))]


@query
def M1_question_metrics(spark, sf_dir):
    return metrics(spark, sf_dir).select("query_id", "bucket", *[F.round(F.col(f"`{m}`"), 6).alias(m) for m in METRICS])


@query
def M2_span_recall(spark, sf_dir):
    """A passage's spans are its copies in the documents that hold it."""
    gold = gold_items(spark, sf_dir)
    items = gold.select(F.col("item_id").alias("query_id"), F.col("query_id").alias("span_id"))
    hits = found_and_judged(spark, sf_dir, gold)[1].where("relevant").select(F.col("query_id").alias("span_id"), "rank")
    out = evaluate.span_recall(items.join(hits, "span_id"), items, 10)
    return out.select("query_id", F.round("r", 6).alias("r"), "r_any", "r_all")


@query
def A1_aggregate(spark, sf_dir):
    return evaluate.aggregate_metrics(metrics(spark, sf_dir), ["mrr", "hit@5", "ndcg@10"], ["bucket"]).select("by", "key", "mrr", "`hit@5`", "`ndcg@10`", i64("n"))


@query
def A8_top_misses(spark, sf_dir):
    """Passages are asked for by three words, so that some are missed. An item has one span: recall is that span's."""
    items = gold_items(spark, sf_dir)
    found, judged = found_and_judged(spark, sf_dir, items, n_words=3)
    recall = evaluate.span_recall(judged.where("relevant").select("query_id", F.lit(0).alias("span_id"), "rank"), items.select("query_id", F.lit(0).alias("span_id")), 10)
    listed = found.groupBy(F.col("query_id").alias("item_id")).agg(F.collect_set(F.split("chunk_id", ":")[0].cast("long")).alias("doc_ids"))
    scored = evaluate.question_metrics(judged, items.select("query_id", "item_id", "doc_id")).join(recall, "query_id").join(listed, "item_id", "left")
    rows = scored.select(F.col("query_id").alias("id"), "doc_id", "doc_ids", "`hit@5`", "`hit@10`", F.col("r").alias("r@10"), "mrr")
    return evaluate.top_misses(rows).select("id", "doc_id", "tag", F.round("mrr", 6).alias("mrr"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as expectations, and a rule on the text as the answer."""
    d = labelled(spark, sf_dir)
    return d.select(
        F.when(F.col("quality") == 1, "corpus_technical").otherwise("out_of_scope").alias("expected_route"),
        F.when(F.col("n_chars") > 500, "corpus_technical").otherwise("out_of_scope").alias("predicted_route"),
        (F.col("toxic") == 1).alias("expected_abstain"),
        (F.contains("text", F.lit("idiot")) | F.contains("text", F.lit("clown"))).alias("abstained"),
        F.when(F.col("quality") == 1, F.col("n_chars") > 100).alias("citations_valid"),
        F.when(F.col("toxic") == 0, F.least(F.lit(1.0), F.col("n_chars") / 4000.0)).alias("groundedness"),
        F.col("n_chars").alias("latency_ms"),
        (F.col("doc_id") % 7).alias("llm_calls"),
    )


@query
def A2_answer_metrics(spark, sf_dir):
    return evaluate.answer_metrics(samples(spark, sf_dir))


@query
def A3_nearest_rank(spark, sf_dir):
    return evaluate.nearest_rank_of(table(spark, sf_dir, "events"), "value", (1, 25, 50, 75, 95, 99)).select(i32("p"), "value")


@query
def A4_spearman(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", F.round("l_extendedprice", 0).alias("price"))
    return evaluate.spearman(rows, "l_quantity", "price")


def judges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two judges with rows of their own: the labels, and the share of letters in the texts, null for short ones."""
    letters = F.length(F.regexp_replace("text", "[^A-Za-z]", "")) / F.greatest(F.length("text"), F.lit(1))
    ragas = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("faithfulness"))
    deepeval = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.length("text") >= 200, F.round(letters, 6)).alias("faithfulness"))
    return evaluate.paired(ragas, deepeval, "faithfulness")


@query
def J4_samples(spark, sf_dir):
    """Labels as items, documents as the records of their generation: lines are contexts, the first line is quoted."""
    none = lambda kind: F.lit(None).cast(kind)
    items = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), F.lit("").alias("question"), none("string").alias("gold_answer"), F.array(F.col("quality").cast("string"), F.lit("kept")).alias("gold_spans"),
        (F.col("toxic") == 1).alias("expected_abstain"), F.when(F.col("quality") == 1, "corpus_technical").otherwise("general").alias("expected_route"), F.lit("slot").alias("bucket"),
    )
    lines = F.split("text", "\n")
    records = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.slice(lines, 2, 1000000).alias("retrieved_contexts"), F.substring("text", 1, 50).alias("answer"), F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("route"),
        (F.col("n_chars") < 100).alias("abstained"), F.slice(lines, 2, 1).alias("quotes"), F.col("n_chars").alias("latency_ms"), none("int").alias("llm_calls"), none("double").alias("groundedness"),
    )
    return evaluate.samples_of(items, records).select("id", F.size("retrieved_contexts").cast("long").alias("n_contexts"), "answer", "reference", "predicted_route", "abstained", "citations_valid", "latency_ms", "llm_calls")


@query
def A5_agreement(spark, sf_dir):
    return evaluate.spearman(judges(spark, sf_dir), "ragas", "deepeval")


@query
def A5_disagreements(spark, sf_dir):
    return evaluate.disagreements(judges(spark, sf_dir), "ragas", "deepeval")


@query
def A6_ratings_by_route(spark, sf_dir):
    return feedback.ratings_by(ratings(spark, sf_dir), logs(spark, sf_dir), "route")


@query
def A6_ratings_by_type(spark, sf_dir):
    kinds = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("kind"))
    return feedback.ratings_by_kind(ratings(spark, sf_dir), logs(spark, sf_dir), kinds)


@query
def A7_worst_queries(spark, sf_dir):
    return feedback.worst_queries(ratings(spark, sf_dir), logs(spark, sf_dir)).select("query_id", i64("n"), "mean_rating", "route")


@query
def A10_framework_means(spark, sf_dir):
    rows = judges(spark, sf_dir).join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "toxic"), "id")
    return evaluate.framework_means(rows, ["ragas", "deepeval"], F.col("toxic") == 1)


@query
def A11_frequencies(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("lang").alias("n_lang"), F.countDistinct(F.md5("text")).alias("n_texts"))


@query
def J9_split_overlap(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return registry.split_overlap(labels.where("quality = 1"), labels.where("toxic = 1"))


@query
def J1_joined_sources(spark, sf_dir):
    named = lambda t, c, k: table(spark, sf_dir, t).select(F.col(c).alias("name"), F.col(k).alias("seq"))
    pdfs = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.regexp_replace("p_name", " ", "_"), F.lit(".pdf")).alias("name"))
    short = named("part", "p_name", "p_partkey").where("name LIKE 's%' OR name LIKE 'r%'")
    blue = named("part", "p_name", "p_partkey").where("name LIKE '%bolt%' OR name LIKE '%ring%'")
    return registry.joined_sources(pdfs, short, blue).select("p_partkey", "csv", "txt", "missing")


@query
def J11_back_filled_grades(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("chunk_id"))
    grades = labelled(spark, sf_dir).select(F.col("source").alias("query_id"), F.col("doc_id").alias("chunk_id"), (F.col("quality") == 1).alias("relevant"))
    return agent.back_filled(docs, grades)


@query
def X1_inventory(spark, sf_dir):
    lines = F.split("text", "\n")
    own = lambda c, mark, answer: table(spark, sf_dir, "documents").select("doc_id", F.lit(c).alias("category"), F.filter(lines, lambda x: F.contains(x, F.lit(mark))).alias("spans"), answer.alias("answer"))
    clauses = own("Governing Law", "License", F.col("lang")).unionByName(own("Parties", "@", F.lit("No"))).unionByName(own("Exclusivity", "token", F.lit("")))
    found = evaluate.inventory(clauses, ["Governing Law", "Parties"], ["Exclusivity"], [("Governing Law", "Parties")])
    return found.select("doc_id", "bucket", "category", F.size("spans").cast("long").alias("n_spans"), "answer")


@query
def X2_flat_records(spark, sf_dir):
    """Labelled documents as items; a conversation's last turn answers the item of its number, its other turns are what was retrieved."""
    items = labelled(spark, sf_dir).select(F.col("doc_id").alias("id"), F.lit("slot").alias("bucket"), F.col("source").alias("question"), (F.col("toxic") == 1).alias("expected_abstain"), F.col("lang").alias("expected_route"))
    answers, before = last_turns(spark, sf_dir)
    answers = answers.select(F.col("query_id").alias("id"), "query_id", "answer", F.lit("corpus_technical").alias("route"), F.lit(False).alias("abstained"), F.lit(None).cast("array<string>").alias("citations"), F.lit(None).cast("double").alias("groundedness"), F.lit(0).alias("rewrites"))
    contexts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda c: c["text"])
    logs_ = before.groupBy("query_id").agg(contexts.alias("retrieved_contexts"), F.count("*").alias("llm_calls")).withColumns({"latency_ms": F.col("llm_calls") * 10, "token_usage": F.create_map(F.lit("calls"), F.col("llm_calls")), "trace_path": F.lit(None).cast("string")})
    found = feedback.flat_records(items, answers, logs_)
    return found.select("id", "question", F.md5("answer").alias("answer_md5"), "expected_abstain", "expected_route", F.md5(F.array_join("retrieved_contexts", "|")).alias("contexts_md5"), "latency_ms", "llm_calls")


@query
def X3_missing_inputs(spark, sf_dir):
    rows = logs(spark, sf_dir)
    needs = {"faithfulness": ("contexts",), "answer_relevancy": (), "contextual_recall": ("contexts", "reference")}
    filled = {"contexts": F.col("n_turns") > 2, "reference": F.length("question") > 100}
    return rows.select("query_id", *[c.alias(m) for m, c in evaluate.missing_inputs(needs, filled).items()])


@query
def X8_chunk_keys(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    given = F.when(F.col("role") == "system", "").when(F.col("role") == "user", F.concat_ws("-", "conv_id", "turn"))
    return t.select("conv_id", "turn", fuse.chunk_key(given, F.col("conv_id").cast("string"), F.col("turn")).alias("key"))


@query
def N11_references(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "assistant", F.col("text")).alias("answer"), F.split("text", r"\. ").alias("spans"))
    text = X.normalize(F.array_join("spans", " "))
    return t.select("conv_id", "turn", F.md5(evaluate.reference(F.col("answer"), F.col("spans"))).alias("reference_md5"), evaluate.citations_hold(F.col("spans"), text).alias("citations_hold"))


# Sampling


@query
def T3_ratio_gate(spark, sf_dir):
    """Toxic documents are the hold-out, good ones the pool; a text fits if its share of other characters than white space is usual."""
    fits = X.ratio_ok(X.norm_chars("text"), F.floor(F.col("n_chars") * 0.86)).alias("ratio_ok")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("kind"), F.col("lang").alias("group"), F.col("doc_id").alias("seq"), fits)
    d = written(docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id"), "gate-ratios")  # texts are measured once, and stay where they are
    chosen, pool = d.where("toxic = 1").drop("quality", "toxic"), d.where("toxic = 0 AND quality = 1").drop("quality", "toxic")
    return sampling.ratio_gate(chosen, pool).select("doc_id", "final", "note")


@query
def M4_stratified_quotas(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    have = sampling.sizes(customers, "c_mktsegment")
    quotas = sampling.stratified_quotas(have, round(0.5 * sum(have.values())))
    return sampling.drawn(customers, "c_mktsegment", quotas, "c_custkey").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query
def M5_holdout(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    own = sampling.alone_in_family(docs, F.sha2("text", 256))
    quotas = sampling.holdout_quotas(sampling.sizes(own, "lang"), 50, {"en": 24, "fr": 16, "de": 10})
    return sampling.drawn(own, "lang", quotas, "doc_id", 43).select("doc_id", "lang")


@query
def M6_split(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    have = sampling.sizes(labels, "quality")
    quotas = sampling.proportional_split(have, round(0.6 * sum(have.values())))
    return sampling.drawn(labels, "quality", quotas, "doc_id", 45).groupBy("quality").agg(F.count("*").alias("n"))


# Agent


@query
def G2_edges(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("event_id", (F.floor("value") % 4).alias("n"), (F.col("event_id") % 3).alias("rewrites"), "event_type")
    route = F.when(F.col("event_type") == "view", "general").when(F.col("event_type") == "click", "ambiguous").when(F.col("event_type") == "error", "out_of_scope").otherwise("corpus_technical")
    return d.select("event_id", agent.after_classify(route).alias("classified"), agent.after_grade(F.col("n"), F.col("rewrites")).alias("after_grade"), agent.after_verify(F.col("n") > 1, F.col("rewrites")).alias("after_verify"))


@query
def G6_grades(spark, sf_dir):
    found = search.bm25_top_k(R.chunks_of(table(spark, sf_dir, "documents")), R.questions(spark, sf_dir), 10)
    return agent.graded(found, 20.0).groupBy("query_id").agg(F.count("*").alias("n"), F.count_if("relevant").alias("n_relevant"))


@query
def G6_clipped(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.clip("text")).alias("text_md5"))


def last_turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A conversation's last turn is the answer, the turns before are its context."""
    t = turns(spark, sf_dir)
    both = t.join(t.groupBy("doc_id").agg(F.max("page_no").alias("last")), "doc_id")
    answers = both.where("page_no = last").select(F.col("doc_id").alias("query_id"), F.col("text").alias("answer"))
    return answers, both.where("page_no < last").select(F.col("doc_id").alias("query_id"), F.col("page_no").alias("seq"), "text")


@query
def G7_lexical_support(spark, sf_dir):
    return agent.lexical_support(*last_turns(spark, sf_dir), 0.1)


@query
def G7_supported_claims(spark, sf_dir):
    return agent.supported_claims(*last_turns(spark, sf_dir), 0.3).select("query_id", i32("claim_no"), F.md5("claim").alias("claim_md5"), "score", i64("seq"), "supported")


@query
def G7_claim_support(spark, sf_dir):
    found = agent.claim_support(*last_turns(spark, sf_dir), 0.3)
    return found.select("query_id", "score", "grounded", F.md5(F.array_join("unsupported", "|")).alias("unsupported_md5"))


@query
def G6_calls(spark, sf_dir):
    """A question's candidates are the conversation's turns."""
    calls = agent.calls_of(turns(spark, sf_dir).select(F.col("doc_id").alias("query_id"), F.col("page_no").alias("chunk_id"), F.col("page_no").alias("rank"), "text"), 2000, 400)
    return calls.select("query_id", i32("call"), F.size("items").cast("long").alias("n"), F.aggregate("items", F.lit(0).cast("long"), lambda s, i: s + F.length(i["text"])).alias("n_chars"))


def cited(spark: SparkSession, sf_dir: str, quote: Column, fuzzy: Callable | None = None) -> DataFrame:
    """Each passage is quoted from the best chunk that BM25 finds for it."""
    docs, spans = table(spark, sf_dir, "documents"), R.questions(spark, sf_dir)
    chunks = R.chunks_of(docs)
    best = search.bm25_top_k(chunks, spans, 3)
    retrieved = best.join(chunks.select("chunk_id", "doc_id", "text"), "chunk_id").select("query_id", "chunk_id", "doc_id", "text")
    cited = best.join(spans.select("query_id", quote.alias("quote")), "query_id").select("query_id", F.when(F.col("rank") == 3, F.concat("chunk_id", F.lit("?"))).otherwise(F.col("chunk_id")).alias("chunk_id"), F.when(F.col("rank") == 2, -1).otherwise(F.split("chunk_id", ":")[0].cast("long")).alias("doc_id"), "quote")
    return agent.citation_errors(cited, retrieved, fuzzy).select("query_id", "chunk_id", "error")


@query
def G8_citations(spark, sf_dir):
    return cited(spark, sf_dir, F.col("text"))


@query
def G8_near_citations(spark, sf_dir):
    """Quotes whose fourth word is lost, held to an alikeness of 90 of 100."""
    parts = F.split("text", " ")
    return cited(spark, sf_dir, F.concat_ws(" ", F.slice(parts, 1, 3), F.slice(parts, 5, 1_000_000)), X.fuzzy_contains())


@query
def G9_abstain_text(spark, sf_dir):
    found = search.bm25_top_k(R.chunks_of(table(spark, sf_dir, "documents")), R.questions(spark, sf_dir), 5)
    place = F.concat(F.split("chunk_id", ":")[0], F.lit(" p."), F.split("chunk_id", ":")[1])
    near = found.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", place.alias("p")))), lambda x: x["p"]).alias("near"))
    asked = R.questions(spark, sf_dir).join(near, "query_id", "left")
    return asked.select("query_id", agent.abstain_text(F.lit(""), F.coalesce("near", F.array().cast("array<string>"))).alias("text"))


@query
def G13_cited_documents(spark, sf_dir):
    d = logs(spark, sf_dir).select("query_id", F.transform("cited_doc_ids", lambda x: x.cast("string")).alias("cited"), F.array().cast("array<string>").alias("none"))
    return d.select("query_id", F.array_join(F.array_distinct(agent.first_filled("none", "cited")), ",").alias("cited"))


@query
def G1_answer_loop(spark, sf_dir):
    """All passages through the loop with rule-based slots."""
    docs = table(spark, sf_dir, "documents")
    chunks = R.chunks_of(docs)
    lists = written(search.term_lists(chunks), "bm25-chunks")

    def retrieve(asked: DataFrame) -> DataFrame:
        found = written(search.bm25_top_k(chunks, asked, 10, lists=lists), "found")  # small, so that the texts of its chunks are met where they are
        score = F.round(F.col("score") / F.max("score").over(agent_window), 6)
        return found.withColumn("score", score).join(chunks.select("chunk_id", "doc_id", (F.col("chunk_idx") + 1).alias("page"), "text"), "chunk_id").select("query_id", "chunk_id", "doc_id", "page", "text", "score", "rank")

    agent_window = Window.partitionBy("query_id")
    first_words = F.concat_ws(" ", F.slice(F.split("question", " "), 1, 8))
    slots = agent.Slots(
        classify=lambda q: q.select("query_id", F.when(F.length("text") < 60, "ambiguous").when(F.contains("text", F.lit("  ")), "general").otherwise("corpus_technical").alias("route")),
        retrieve=retrieve,
        rewrite=lambda q: q.select("query_id", first_words.alias("text")),
        generate=lambda q: q.select("query_id", F.when(F.col("strict"), first_words).otherwise(F.col("question")).alias("answer")),
        general=lambda q: q.select("query_id", F.col("text").alias("answer")),
        clarify=lambda q: q.select("query_id", F.concat(F.lit("Which document do you mean: "), F.substring("text", 1, 40), F.lit("?")).alias("answer")),
    )
    return agent.answer(R.questions(spark, sf_dir), slots, grade_at=0.9)


# Scalar functions


@query
def N1_normalised(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.normalize("text")).alias("text_md5"))


@query
def N3_fragments(spark, sf_dir):
    cut = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(X.fragments(F.regexp_replace("text", r"\. ", " < Omitted > "))).alias("at", "fragment"))
    return cut.select("item_id", i64("at"), "fragment")


@query
def N4_stems(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.normal_stem("url").alias("stem"), X.stem_key("url").alias("key"), X.stem_family("url").alias("family"))


@query
def N7_tokens(spark, sf_dir):
    return search.term_counts(spread(table(spark, sf_dir, "documents")), "doc_id")


@query
def N8_questions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    name = X.display_name(F.regexp_replace("p_name", " ", "_"), F.lit(""), F.col("p_type"))
    category = F.when(F.col("p_size") % 3 == 0, "Exclusivity").when(F.col("p_size") % 3 == 1, "Audit Rights").otherwise("Governing Law")
    bucket = F.when(F.col("p_size") % 3 == 2, "slot").otherwise("yes_span")
    return p.select("p_partkey", X.question(bucket, category, name).alias("question"))


@query
def N9_safe_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.safe_stem("url").alias("name"), X.line_key("url").alias("key"))


@query
def N10_repaired_json(spark, sf_dir):
    raw = F.concat(F.lit("```json\n"), F.regexp_replace("props", "}", ",}"), F.lit("\n```"))
    value = F.get_json_object(X.repaired_json(raw), "$.k")
    return table(spark, sf_dir, "events").select("event_id", value.cast("long").alias("k"))


# Streams (as batches)


@query
def W1_windowed_counts(spark, sf_dir):
    out = ingest.windowed_counts(table(spark, sf_dir, "events"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", F.round("mean_value", 6).alias("mean_value"))
