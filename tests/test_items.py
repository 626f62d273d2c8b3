"""Relevance by chunk, samples, judges, lists of the registry, run tables; each against a plain definition."""

import json
import random

from pyspark.sql import functions as F
from test_operators import plain_partial_ratio

from docgrain.functions import text as X
from docgrain.operators import evaluate, registry, runs, search
from docgrain.plans import retrieval


def test_nearly_holds_is_partial_ratio():
    dice = random.Random(5)
    for _ in range(300):
        alphabet = dice.choice(["ab ", "abcdefgh ", "the law of delaware"])
        long = "".join(dice.choice(alphabet) for _ in range(dice.randint(1, 90)))
        at = dice.randint(0, max(0, len(long) - 1))
        short = list(long[at : at + dice.randint(0, 40)])
        for _ in range(dice.randint(0, 6)):
            if short:
                i = dice.randrange(len(short))
                short[i : i + dice.randint(0, 1)] = dice.choice(["", "x", "a"])
        short = "".join(short) or "a"
        for threshold in (60.0, 80.0, 90.0, 97.0):
            assert X.nearly_holds(short, long, threshold) == (plain_partial_ratio(short, long) >= threshold), (short, long, threshold)


def test_judged_by_chunk(spark):
    span = "The term of this Agreement <omitted> is ten years from the effective date of it."
    chunks = [
        ("1:0", 1, "the term of this agreement, then: is ten years from the effective date of it"),
        ("1:1", 1, "the term of this agreement is ten yaers from the effective date of it"),
        ("1:2", 1, "the term of this agreement"),
        ("2:0", 2, "the term of this agreement is ten years from the effective date of it"),
        ("1:3", 1, None),
    ]
    found = spark.createDataFrame([("q", c[0], i + 1) for i, c in enumerate(chunks)], "query_id string, chunk_id string, rank int")
    items = spark.createDataFrame([("q:1", "q", 1, span)], "query_id string, item_id string, doc_id int, span string")
    d = spark.createDataFrame(chunks, "chunk_id string, doc_id int, text string")
    exact = {r["chunk_id"]: bool(r["relevant"]) for r in retrieval.judged(found, d, items).collect()}
    assert exact == {"1:0": True, "1:1": False, "1:2": False, "1:3": False}
    near = {r["chunk_id"]: r["relevant"] for r in retrieval.judged(found, d, items, 90.0).collect()}
    assert near == {"1:0": True, "1:1": True, "1:2": False, "1:3": False}


def test_samples(spark):
    items = spark.createDataFrame(
        [("a", "q?", "gold", ["s"], False, "general", "slot"), ("b", "q?", "", ["s", "t"], True, "general", "slot"), ("c", "q?", None, [], True, "general", "slot")],
        "id string, question string, gold_answer string, gold_spans array<string>, expected_abstain boolean, expected_route string, bucket string",
    )
    records = spark.createDataFrame(
        [("a", ["", "One two.", None], None, "", None, ["one TWO"], None, 3, None), ("b", None, "x", "general", True, [" "], 7, None, 0.5), ("c", [], "x", None, False, [], 7, None, 0.5), ("z", [], "x", None, False, [], 7, None, 0.5)],
        "id string, retrieved_contexts array<string>, answer string, route string, abstained boolean, quotes array<string>, latency_ms int, llm_calls int, groundedness double",
    )
    got = {r["id"]: r for r in evaluate.samples_of(items, records).collect()}
    assert set(got) == {"a", "b", "c"}
    assert [got[i]["reference"] for i in "abc"] == ["gold", "s t", None]
    assert [got[i]["citations_valid"] for i in "abc"] == [True, False, None]
    assert [got[i]["predicted_route"] for i in "abc"] == ["corpus_technical", "general", "corpus_technical"]
    assert (got["a"]["retrieved_contexts"], got["a"]["answer"], got["a"]["abstained"], got["a"]["latency_ms"], got["a"]["llm_calls"]) == (["One two."], "", False, 0, 3)


def test_paired_judges(spark):
    kind = "id string, faithfulness double"
    a, b = spark.createDataFrame([("a", 0.1), ("b", None), ("c", 0.9)], kind), spark.createDataFrame([("a", 0.5), ("b", 0.5), ("d", 0.5), ("c", None)], kind)
    assert [tuple(r) for r in evaluate.paired(a, b, "faithfulness").collect()] == [("a", 0.1, 0.5)]


def test_registry_lists(spark):
    rows = spark.createDataFrame([(3, "b", "x"), (1, "b", "y"), (2, "a", "z")], "doc_id int, kind string, path string")
    assert [r["doc_id"] for r in registry.listed(rows).collect()] == [2, 1, 3]
    assert [r["doc_id"] for r in registry.listed(rows, kind="b").collect()] == [1, 3]
    asked = registry.looked_up(rows, spark.createDataFrame([(2,), (9,)], "doc_id int")).collect()
    assert sorted((r["doc_id"], r["path"]) for r in asked) == [(2, "z"), (9, None)]
    assert [r["doc_id"] for r in registry.work_list(rows, limit=2).collect()] == [1, 2]
    given = registry.work_list(rows, spark.createDataFrame([("/x/One Two.PDF",)], "path string")).collect()
    assert [tuple(r) for r in given] == [("one two", "/x/One Two.PDF", None)]


def test_kind_from_the_text(spark):
    asked = spark.createDataFrame([("named", "the license agreement of acme"), ("by text", "which license agreement"), ("unknown kind", "which supply agreement"), ("vocabulary", "governing parties license")], "query_id string, text string")
    known = spark.createDataFrame([(1, "acme", "Agency"), (2, "license parties", "License")], "doc_id int, name string, kind string")
    got = {r["query_id"]: (r["doc_ids"], r["kind"]) for r in search.named_documents(asked, known, X.QUESTION_VOCABULARY, kinds_of=X.TYPE_ALIASES).collect()}
    assert got == {"named": ([1], "Agency"), "by text": (None, "License")}


def test_run_tables(spark):
    payloads = [
        ("a/m.json", json.dumps({"profile": "p", "split": "dev", "n": 4, "config_hash": "0123456789abcdef", "git_sha": "0123456789", "overall": {"n": 0, "mrr": 0.5, "hit@5": 1.0}})),
        ("b/m.json", "{}"),
        ("c/m.json", "not json"),
    ]
    got = {r["path"]: r for r in runs.retrieval_table(spark.createDataFrame(payloads, "path string, json string")).collect()}
    assert (got["a/m.json"]["n"], got["a/m.json"]["config_hash"], got["a/m.json"]["git_sha"], got["a/m.json"]["index_sig"]) == (4, "0123456789ab", "01234567", "")
    assert (got["a/m.json"]["mrr"], got["a/m.json"]["hit@5"], got["a/m.json"]["r@5"]) == (0.5, 1.0, None)
    assert [got[p]["n"] for p in ("b/m.json", "c/m.json")] == [0, 0]
    d = spark.createDataFrame([("p", "dev", "h1", 1, "old"), ("p", "dev", "h1", 2, "exact"), ("p", "dev", "h2", 3, "newest"), ("p", "test", "h3", 9, "other")], "profile string, split string, config_hash string, modified int, path string")
    wanted = spark.createDataFrame([("p", "dev", "h1"), ("p", "dev", "h9"), ("x", "dev", "h1")], "profile string, split string, config_hash string")
    got = {(r["profile"], r["config_hash"]): r["path"] for r in runs.standing_run(d, wanted).collect()}
    assert got == {("p", "h1"): "exact", ("p", "h9"): "newest", ("x", "h1"): None}


def test_found_pairs_alone_are_compared(spark):
    """The chunks are made once, and no chunk or item that wasn't found for the other is compared."""
    rng, made = random.Random(4), spark.sparkContext.accumulator(0)
    words = [f"word{i}" for i in range(300)]
    texts = {f"{d}:{i}": " ".join(rng.choice(words) for _ in range(30)) for d in range(6) for i in range(3)}
    seen = F.udf(lambda t: (made.add(1), t)[1])
    chunks = spark.createDataFrame([(c, int(c[0]), t) for c, t in texts.items()], "chunk_id string, doc_id long, text string").withColumn("text", seen("text"))
    worn = lambda t: " ".join(t.split()[3:12]).replace("word1", "wrd1")
    items = [(f"{i}:{d}", i, d, span) for i in range(6) for d in range(6) for span in [f"{worn(texts[f'{i}:1'])} <omitted> {worn(texts[f'{i}:1'])}"]] + [("blank", 7, 0, " <omitted> ")]
    found = [(i, f"{d}:{k}", 3 * d + k) for i in range(6) for d in (i, (i + 1) % 6) for k in range(2)] + [(7, "0:0", 1)]
    f, i = spark.createDataFrame(found, "item_id long, chunk_id string, rank int"), spark.createDataFrame(items, "query_id string, item_id long, doc_id long, span string")
    got = {(r["query_id"], r["chunk_id"]): (r["rank"], r["relevant"]) for r in evaluate.relevant_chunks(f, chunks, i, 90.0).collect()}
    span = {q: s for q, _, _, s in items}
    pairs = [(f"{i}:{c[0]}" if i < 7 else "blank", c, r) for i, c, r in found]
    parts = lambda q: [p.strip() for p in span[q].split("<omitted>") if p.strip()]
    assert got == {(q, c): (r, bool(parts(q)) and all(p in texts[c] or X.partial_ratio(p, texts[c]) >= 90 for p in parts(q))) for q, c, r in pairs}
    assert made.value == len(texts) and sum(rel for _, rel in got.values()) == 6
