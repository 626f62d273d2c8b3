"""Retrieval plans: chunks of the corpus, its index, hybrid search and its evaluation, composed of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrain.functions import encode as E
from docgrain.functions import text as X
from docgrain.operators import chunk, evaluate, fuse, search
from docgrain.sources.collections import Collection
from docgrain.sources.readers import spread, table
from docgrain.sources.scratch import written

K = 20


def chunks_of(docs: DataFrame, tokens: int = 512, overlap: int = 64) -> DataFrame:
    """chunk_id ('doc:index'), doc_id, chunk_idx, start, end, text."""
    cut = chunk.fixed_windows(spread(docs), tokens, overlap)
    return cut.withColumn("chunk_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_idx").cast("string")))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def dense_list(chunks: DataFrame, asked: DataFrame, k: int = K, dim: int = 8) -> DataFrame:
    vectors = chunks.select("chunk_id", E.hash_dense(F.col("text"), dim).alias("vector"))
    return search.dense_top_k(vectors, asked.select("query_id", E.hash_dense(F.col("text"), dim).alias("vector")), k)


def hybrid_lists(chunks: DataFrame, asked: DataFrame, k: int = K) -> DataFrame:
    """Both ranked lists, widened to 20 at least: list_id, query_id, chunk_id, score, rank."""
    chunks, wide = written(chunks.select("chunk_id", "text"), "hybrid-chunks"), max(k, 20)
    dense = dense_list(chunks, asked, wide).withColumn("list_id", F.lit("dense"))
    sparse = search.bm25_top_k(chunks, asked, wide).withColumn("list_id", F.lit("sparse"))
    return dense.unionByName(sparse)


def hybrid(chunks: DataFrame, asked: DataFrame, k: int = K, rank_base: int = 1) -> DataFrame:
    return fuse.rrf(hybrid_lists(chunks, asked, k), rank_base=rank_base).where(F.col("rank") <= k)


def question_filters(questions: DataFrame, catalog: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """questions (query_id, text), catalog (doc_id, name, kind) -> query_id, doc_ids, kinds: what the question's own words name, each null
    where they name none. A kind lets documents of unknown kind through. asked (query_id, doc_ids, kinds): the caller's filters, which go first."""
    named = search.named_documents(questions, catalog, X.QUESTION_VOCABULARY, kinds_of=X.TYPE_ALIASES)
    rules = named.select("query_id", "doc_ids", F.when(F.col("kind").isNotNull(), F.array("kind")).alias("kinds"))
    if asked is not None:
        both = rules.alias("r").join(asked.alias("a"), "query_id", "full")
        rules = both.select("query_id", *[search.merged_filters(F.col(f"r.{c}"), F.col(f"a.{c}")).alias(c) for c in ("doc_ids", "kinds")])
    rules = rules.withColumn("kinds", search.with_unknown(F.col("kinds")))
    return rules.where("doc_ids IS NOT NULL OR kinds IS NOT NULL")


def allowed_documents(rules: DataFrame, catalog: DataFrame) -> DataFrame:
    """query_id, doc_id: the documents that each rule lets through; by ids where it has them, else by kinds."""
    known = catalog.select("doc_id", "kind").distinct()
    by_id = rules.where("doc_ids IS NOT NULL").select("query_id", "kinds", F.explode(F.array_distinct("doc_ids")).alias("doc_id")).join(known, "doc_id")
    by_id = by_id.where(F.col("kinds").isNull() | F.array_contains("kinds", F.col("kind")))
    by_kind = rules.where("doc_ids IS NULL").select("query_id", F.explode(F.array_distinct("kinds")).alias("kind")).join(known, "kind")
    return by_id.select("query_id", "doc_id").unionByName(by_kind.select("query_id", "doc_id")).distinct()


def expanded(questions: DataFrame, transforms: tuple = ()) -> DataFrame:
    """query_id, list_id, text: the question as it is and what each transform (Column -> Column) makes of it, each text once, in order."""
    texts = F.array_distinct(F.filter(F.array(F.col("text"), *[t(F.col("text")) for t in transforms]), lambda t: t.isNotNull()))
    return questions.select("query_id", F.posexplode(texts).alias("list_id", "text"))


def filtered_pipeline(chunks: DataFrame, questions: DataFrame, catalog: DataFrame, k: int = 10, candidates: int = K, transforms: tuple = (), asked: DataFrame | None = None) -> DataFrame:
    """From questions to reranked chunks: filters by the question's words, its texts, for each the `candidates` best of a hybrid search
    inside the filter, these lists fused, and the fusion reranked to k. Ranked list: query_id, chunk_id, score, rank.

    Chunks (chunk_id, doc_id, text) are made and tokenised once. Postings and vectors of documents that no filter lets through are left out
    before scoring; questions without a filter search everything, in blocks: no scores of theirs are shuffled but the best."""
    chunks, wide = written(chunks.select("chunk_id", "doc_id", "text"), "pipeline-chunks"), max(k, candidates)
    rules = question_filters(questions, catalog, asked)
    within = written(allowed_documents(rules, catalog), "pipeline-allowed")
    # A search is a question's text; its id keeps both.
    texts = expanded(questions, transforms).select(F.struct("query_id", "list_id").alias("query_id"), "text")
    texts = texts.join(rules.select(F.col("query_id").alias("_id"), F.lit(True).alias("bound")), F.col("query_id.query_id") == F.col("_id"), "left").drop("_id")
    texts = written(texts.withColumn("vector", E.hash_dense(F.col("text"))), "pipeline-texts")
    free, bound = texts.where("bound IS NULL"), texts.where("bound")
    own = bound.select("query_id").join(within.withColumnRenamed("query_id", "_id"), F.col("query_id.query_id") == F.col("_id")).drop("_id")
    own = written(own, "pipeline-own")  # Spark then knows how few they are before it moves texts and vectors
    counted = written(search.term_lists(chunks), "pipeline-words")
    vectors = chunks.select("chunk_id", "doc_id", E.hash_dense(F.col("text")).alias("vector"))
    named = free.select(F.to_json("query_id").alias("query_id"), "text", "vector")
    back = F.from_json("query_id", texts.schema["query_id"].dataType.simpleString())
    sparse = search.bm25_top_k(chunks, named, wide, lists=counted).withColumn("query_id", back)
    sparse = sparse.unionByName(search.ranked(search.bm25_scores(search.bm25_index_within(chunks, counted, bound, own), bound, within=own), wide))
    dense = search.dense_top_k(vectors, named, wide).withColumn("query_id", back).unionByName(search.dense_within(vectors, bound, own, wide))
    lists = sparse.withColumn("list_id", F.lit("sparse")).unionByName(dense.withColumn("list_id", F.lit("dense")))
    each = fuse.rrf(lists).where(F.col("rank") <= wide)
    fused = fuse.rrf(each.select("query_id.query_id", F.col("query_id.list_id").cast("string").alias("list_id"), "chunk_id", "score", "rank"))
    return fuse.lexical_rerank(fused, questions, chunks, k)


INDEX_TABLES = ("postings", "terms", "stats")


def build_index(docs: DataFrame, into: Collection) -> dict[str, dict[str, int]]:
    """Chunks, dense vectors, postings and statistics as the collection's next version; each is made once for
    many searches. Postings lie sorted by term, so a search reads the row groups of its words. Returns the counts of the
    written tables; there must be a vector for each chunk."""
    chunks = written(chunks_of(docs), "index-chunks")
    postings = written(search.postings_of(chunks), "index-postings")
    terms, stats = postings.groupBy("term").agg(F.count("*").alias("df")), search.corpus_statistics(chunks)
    vectors = chunks.select("chunk_id", E.hash_dense(F.col("text")).alias("vector"))
    tables = {"chunks": chunks, "vectors": vectors, "postings": postings.repartitionByRange("term").sortWithinPartitions("term"), "terms": terms, "stats": stats}
    return into.replace(tables, dict.fromkeys(("chunks", "vectors"), chunks.count()), {"postings": {"occurrences": F.sum("tf")}, "chunks": {"docs": F.approx_count_distinct("doc_id")}})


def search_index(index: Collection, asked: DataFrame, k: int = K) -> DataFrame:
    """Hybrid search over a built index; the same result as hybrid() over the chunks."""
    wide = max(k, 20)
    sparse = search.ranked(search.bm25_scores(tuple(index.table(t) for t in INDEX_TABLES), asked), wide).withColumn("list_id", F.lit("sparse"))
    dense = search.dense_top_k(index.table("vectors"), asked.select("query_id", E.hash_dense(F.col("text")).alias("vector")), wide).withColumn("list_id", F.lit("dense"))
    return fuse.rrf(dense.unionByName(sparse)).where(F.col("rank") <= k)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages against all chunks: dense and BM25 top 20, fused, top 10."""
    found = hybrid(chunks_of(table(spark, sf_dir, "documents")), questions(spark, sf_dir), 10)
    return found.select("query_id", "chunk_id", "score", F.col("rank").cast("int").alias("rank"))


def judged(found: DataFrame, chunks: DataFrame, items: DataFrame, threshold: float | None = None) -> DataFrame:
    """found (query_id, chunk_id, rank), items (query_id, item_id, doc_id, span), an item a passage and its document ->
    query_id, chunk_id, rank, relevant, of the chunks of an item's document that were found for its passage.

    A chunk is relevant if it holds every fragment of the span, both normalised; with a threshold, fragments that don't
    occur as they are may be nearly alike."""
    asked = found.select(F.col("query_id").alias("item_id"), "chunk_id", "rank")
    if threshold is not None:
        return evaluate.relevant_chunks(asked, chunks, items, threshold)
    own = asked.join(chunks.select("chunk_id", "doc_id", "text"), "chunk_id").join(items.select("query_id", "item_id", "doc_id", "span"), ["item_id", "doc_id"])
    return own.select("query_id", "chunk_id", "rank", X.holds_all(X.fragments("span"), X.normalize("text")).alias("relevant"))
