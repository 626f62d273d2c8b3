"""The retrieval pipeline: filters found in the question or given by the caller hold before anything is scored."""

import pytest
from pyspark.sql import functions as F

from docgrain.functions import text as X
from docgrain.operators import fuse, search
from docgrain.plans import retrieval as R
from docgrain.plans.queries import QUERIES

DOCS = [
    (1, "acmecorp supply", "Supply", "the term of this supply agreement is ten years"),
    (2, "betaworks licence", "License", "the term of the licence is five years"),
    (3, "betaworks hosting", "Hosting", "hosting fees are due each month of the term"),
    (4, "uploaded file", "Unknown", "an uploaded contract with a term of two years"),
    (5, "gammatron supply", "Supply", "supply of gears by gammatron, no term stated"),
]


def tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, name string, kind string, text string")
    chunks = docs.select(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit("0")).alias("chunk_id"), "doc_id", "text")
    return chunks, docs.select("doc_id", "name", "kind")


def found(spark, questions, asked=None, **more):
    chunks, catalog = tables(spark)
    rows = R.filtered_pipeline(chunks, spark.createDataFrame(questions, "query_id string, text string"), catalog, 10, asked=asked, **more).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(int(r["chunk_id"].split(":")[0]))
    return out


def test_filters_of_the_question(spark):
    got = found(spark, [("one", "What is the term of the Acmecorp deal?"), ("two", "How long is the Betaworks term?"), ("kind", "What is the term of a supply agreement?"), ("none", "how many years")])
    assert got["one"] == [1] and set(got["two"]) == {2, 3}
    assert set(got["kind"]) == {1, 4, 5}  # of the kind, or of unknown kind
    assert set(got["none"]) == {1, 2, 3, 4, 5}


def test_the_callers_filters_go_first(spark):
    asked = spark.createDataFrame([("one", [2], None), ("none", None, ["Hosting"]), ("both", [1, 2, 4], ["Supply"]), ("gone", [77], None)], "query_id string, doc_ids array<long>, kinds array<string>")
    got = found(spark, [("one", "What is the term of the Acmecorp deal?"), ("none", "how many years"), ("both", "the years"), ("gone", "the term")], asked)
    # The kind that the question's document has stays a filter: betaworks licence is no supply contract.
    assert "one" not in got and set(got["none"]) == {3, 4} and set(got["both"]) == {1, 4} and "gone" not in got


def test_texts_are_searched_once_each_and_fused(spark):
    asked = [("same", "the term is ten years"), ("other", "The TERM is, ten years?")]
    texts = R.expanded(spark.createDataFrame(asked, "query_id string, text string"), (X.normalize, X.normalize)).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in texts} == {"same": 1, "other": 2}
    got = found(spark, asked, transforms=(X.normalize,))
    assert got["same"][0] == 1 and got["other"][0] == 1


def test_without_filters_it_is_the_hybrid_search_reranked(spark):
    chunks, catalog = tables(spark)
    asked = spark.createDataFrame([("q", "how many years of term")], "query_id string, text string")
    plain = fuse.lexical_rerank(R.hybrid(chunks, asked, 20), asked, chunks, 10)
    key = lambda df: sorted(map(tuple, df.select("query_id", "chunk_id", "score", "rank").collect()))
    assert key(R.filtered_pipeline(chunks, asked, catalog, 10)) == key(plain)


def test_free_questions_join_no_postings(spark, monkeypatch):
    """Only questions that look into documents of their own are scored by a join; in the answer loop none is."""
    joined, scores = [], search.bm25_scores
    monkeypatch.setattr(search, "bm25_scores", lambda *a, **more: (joined.append(more.get("within") is not None), scores(*a, **more))[1])
    monkeypatch.setattr(search, "bm25_index", lambda *a, **more: pytest.fail("all postings as rows"))
    for name, most in (("R3_filtered_pipeline", 1), ("G1_answer_loop", 0)):
        joined.clear()
        assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
        assert all(joined) and len(joined) == most
