"""The retrieval engine's operators against small vectors and plain definitions."""

import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from docgrain import config
from docgrain.functions import encode as E
from docgrain.functions import text as X
from docgrain.operators import agent, chunk, clean, evaluate, feedback, fuse, registry, sampling, search
from docgrain.plans import retrieval
from docgrain.sources import collections, readers
from docgrain.sources.scratch import written
from docgrain.streaming import ingest

rng = random.Random(1)


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def lists(spark, rows):
    return spark.createDataFrame([("q", *r) for r in rows], "query_id string, list_id string, chunk_id string, score double, rank int")


# Text


@pytest.mark.parametrize(("raw", "want"), [("agree-\nment", "agreement"), ("non-compete", "non compete"), ("State  of   Nevada", "state of nevada"), ("“Café”\xa0No.", "café no")])
def test_normalize(spark, raw, want):
    assert one(spark, raw, X.normalize) == want


def test_fragments(spark):
    assert one(spark, "This Agreement < OMITTED > laws of: x", X.fragments) == ["this agreement", "laws of x"]
    assert one(spark, "a <omitted> b", lambda c: X.holds_all(X.fragments(c), F.lit("has a only"))) is False
    assert one(spark, "", lambda c: X.holds_all(X.fragments(c), F.lit("x"))) is False


def test_stems(spark):
    assert one(spark, "/a/B  Corp.PDF", X.normal_stem) == "b corp"
    assert one(spark, "x/B-Corp_1.pdf", X.stem_key) == "bcorp1"
    for raw in ("Acme_part 2.pdf", "Acme (1).pdf", "acme12.txt"):
        assert one(spark, raw, X.stem_family) == "acme"


def test_types(spark):
    assert one(spark, " License_Agreements ", X.folder_type) == "License" and one(spark, "odd", X.folder_type) is None
    assert [one(spark, t, X.type_group) for t in ("Supply", "IP", "Franchise", "Odd")] == ["core", "ip", "other", "other"]
    assert one(spark, "the Joint Venture  agreement of A", X.named_type) == "Joint Venture"
    assert one(spark, "a license agreement and a supply agreement", X.named_type) is None


def test_page_numbers(spark):
    for text, want in (("3", True), ("- 3 -", True), ("Page 3 of 12", True), ("2024", False), ("3 apples", False)):
        assert one(spark, text, X.is_page_number) is want


def test_uuid5(spark):
    name = "doc:abc:0:sig"
    assert one(spark, name, lambda c: X.uuid5(X.URL_NAMESPACE, c)) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_clause_cells(spark):
    cells = ["['June 8, 2010']", "[]", "plain", '["a", " b "]', None, "5", "['it\\'s', \"two, three\", 7,]", "[a] and [b]", "'quoted'", "[ ]"]
    rows = spark.createDataFrame([(c,) for c in cells], "x string").select(X.clause_cell("x").alias("y")).collect()
    assert [r["y"] for r in rows] == [["June 8, 2010"], [], ["plain"], ["a", "b"], [], ["5"], ["it's", "two, three", "7"], ["[a] and [b]"], ["quoted"], []]
    joined = spark.createDataFrame([("['a', 'b']",), ("[]",)], "x string").select(X.answer_cell("x").alias("y")).collect()
    assert [r["y"] for r in joined] == ["a; b", ""]


def test_repaired_json(spark):
    assert one(spark, '```json\nsure: {"a": [1, 2,],}\n```', X.repaired_json) == '{"a": [1, 2]}'


def test_questions(spark):
    d = spark.createDataFrame([("slot", "Parties"), ("yes_span", "Exclusivity"), ("cross_ref", "Effective Date + x")], "b string, c string")
    got = [r["q"] for r in d.select(X.question(F.col("b"), F.col("c"), F.lit("Acme License")).alias("q")).collect()]
    assert got[0] == "Who are the parties to the Acme License?" and got[1] == "Does the Acme License include an Exclusivity clause?" and got[2].startswith("What is the expiration date")


def plain_partial_ratio(a, b):
    def lcs(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            prev = 0
            for j, d in enumerate(y):
                prev, row[j + 1] = row[j + 1], prev + 1 if c == d else max(row[j + 1], row[j])
        return row[-1]

    if len(a) > len(b):
        a, b = b, a
    parts = [b[max(0, e - len(a)) : e] for e in range(1, len(b) + len(a))]
    return max(200 * lcs(a, p) / (len(a) + len(p)) for p in parts if p)


def test_partial_ratio():
    for _ in range(150):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(1, n))) for n in (8, 25))
        assert abs(X.partial_ratio(a, b) - plain_partial_ratio(a, b)) < 1e-9, (a, b)
    assert X.partial_ratio("the laws of delaware", "under the law of delaware, usa") >= 90


# Cleaning and chunks


def test_headers_and_footers(spark):
    pages = [(1, p, f"ACME  Corp\nbody {p}\nmore {p}\nconfidential\n{p}") for p in range(1, 5)] + [(2, 1, "ACME Corp\nx"), (2, 2, "ACME Corp\ny"), (3, 1, "")]
    d = spark.createDataFrame(pages, "doc_id long, page_no int, text string")
    left = clean.strip_headers_footers(clean.line_units(d), d).collect()
    # the page number is a page's last unit, so the line before it is not; documents of two pages keep their headers
    assert sorted(r["text"] for r in left if r["doc_id"] == 1) == sorted([f"body {p}" for p in range(1, 5)] + [f"more {p}" for p in range(1, 5)] + ["confidential"] * 4)
    assert sum(r["text"] == "ACME Corp" for r in left) == 2


def test_pending(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "doc_id long, sha256 string")
    known = spark.createDataFrame([(1, "a", "s", "indexed"), (2, "b", "s", "failed"), (3, "old", "s", "indexed"), (4, "d", "other", "indexed")], "doc_id long, sha256 string, index_sig string, status string")
    assert sorted(r["doc_id"] for r in clean.pending(docs, known, "s").collect()) == [2, 3, 4]


def plain_packed(text, size, overlap):
    """Piece by piece, as the rule says."""
    pieces = re.findall(r"[^ \n]*[ \n]|[^ \n]+", text)
    out, first = [], 0
    while first < len(pieces):
        n = 1
        while first + n < len(pieces) and len("".join(pieces[first : first + n + 1])) <= size:
            n += 1
        at = len("".join(pieces[:first]))
        out.append((at, at + len("".join(pieces[first : first + n]))))
        if first + n == len(pieces):
            break
        back = first + n
        while back > first and len("".join(pieces[back : first + n])) < overlap:
            back -= 1
        first = max(first + 1, back)
    return out


def test_packed_chunks_follow_the_rule():
    for _ in range(400):
        text = "".join(rng.choice(["word", "a", " ", "\n", "\n\n", "longerword", "é\U0001f600"]) for _ in range(rng.randrange(60)))
        for size, overlap in ((40, 8), (6, 0), (3, 30)):
            assert list(chunk.packed(text, size, overlap)) == plain_packed(text, size, overlap), text


def plain_windows(text, size, step):
    out, at = [], 0
    while text:
        if text[at : at + size].strip():
            out.append((at, min(len(text), at + size)))
        if at + size >= len(text):
            break
        at += step
    return out


def test_fixed_windows_and_pages(spark):
    texts = ["".join(rng.choice("ab \n") for _ in range(n)) for n in (0, 1, 40, 41, 75, 76, 200)] + [" " * 90 + "x"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = chunk.fixed_windows(d, 10, 1).collect()
    for i, t in enumerate(texts):
        rows = sorted((r["chunk_idx"], r["start"], r["end"]) for r in got if r["doc_id"] == i)
        assert [r[1:] for r in rows] == plain_windows(t, 40, 36) and [r[0] for r in rows] == list(range(len(rows)))
    blocks = spark.createDataFrame([(0, 1, 0, "a" * 30), (0, 2, 0, "b" * 30), (0, 3, 0, "")], "doc_id long, page_no int, block_no int, text string")
    placed = chunk.join_pages(blocks)
    assert [tuple(r) for r in placed.orderBy("page_no").select("start", "end").collect()] == [(0, 30), (31, 61), (62, 62)]
    covered = chunk.pages_covered(chunk.fixed_windows(chunk.document_text(blocks), 10, 1), placed).orderBy("chunk_idx").collect()
    assert [(r["page_start"], r["page_end"]) for r in covered] == [(1, 2), (2, 2)]


def test_hash_dense(spark):
    import hashlib

    v = one(spark, "Text é", lambda c: E.hash_components(c, 3))
    assert v == [int.from_bytes(hashlib.sha256(f"{i}:Text é".encode()).digest()[:4], "big") / 2**32 * 2 - 1 for i in range(3)]
    assert one(spark, [0.0, 0.0], E.l2_normalized, "array<double>") == [0.0, 0.0]


# Search and fusion


def test_filters_and_names(spark):
    catalog = spark.createDataFrame([("a1", "abilityinc holdings", "License"), ("o1", "otherco", "Supply"), ("x1", "acme one", "IP"), ("x2", "acme two", "License")], "doc_id string, name string, kind string")
    ask = [("q1", "what about AbilityInc?"), ("q2", "the acme contract"), ("q3", "nothing here"), ("q4", "abilityinc against otherco"), ("q5", "acme and otherco")]
    got = {r["query_id"]: (r["doc_ids"], r["kind"]) for r in search.named_documents(spark.createDataFrame(ask, "query_id string, text string"), catalog, X.STOP_WORDS).collect()}
    assert got == {"q1": (["a1"], "License"), "q2": (["x1", "x2"], None), "q5": (["o1"], "Supply")}


def test_dense_in_batches(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BATCH", 3)
    v = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(60)] + [(60, [0.0] * 4)]
    q = spark.createDataFrame([(i, x) for i, x in v[:7]], "query_id int, vector array<double>")
    got = search.dense_top_k(spark.createDataFrame(v, "chunk_id int, vector array<double>"), q, 5).collect()
    assert len(got) == 35 and all(r["chunk_id"] == r["query_id"] for r in got if r["rank"] == 1)


def test_bm25(spark):
    import math

    texts = ["the cat sat", "the dog the dog", "", "cat cat dog bird"]
    chunks = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "chunk_id string, text string")
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in search.bm25_top_k(chunks, spark.createDataFrame([(1, "Cat cat dog?"), (2, "zebra")], "query_id int, text string")).collect()}
    n, avg = 4, 11 / 4
    df = {"cat": 2, "dog": 2}
    for i, t in enumerate(texts):
        w = t.split()
        s = sum(math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * w.count(x) * 2.5 / (w.count(x) + 1.5 * (0.25 + 0.75 * len(w) / avg)) for x in df if x in w)
        assert (s == 0 and (1, str(i)) not in got) or abs(got[1, str(i)] - s) < 1e-8


def test_fusion(spark):
    a = [("a", "x", 0.9, 1), ("a", "y", 0.8, 2), ("b", "y", 0.5, 1), ("b", "x", 0.4, 2)]
    tie = fuse.rrf(lists(spark, a)).orderBy("rank").collect()
    assert [r["chunk_id"] for r in tie] == ["x", "y"] and tie[0]["score"] == tie[1]["score"]
    assert tie[0]["provenance"] == ["a", "b", "rrf"]
    assert [r["chunk_id"] for r in fuse.rrf(lists(spark, a[:3])).orderBy("rank").collect()] == ["y", "x"]
    same = fuse.dbsf(lists(spark, [("a", "x", 2.0, 1), ("a", "y", 2.0, 2)])).collect()
    assert {r["score"] for r in same} == {0.5}
    assert fuse.weighted(lists(spark, a), "a", "b", alpha=1.0).orderBy("rank").first()["chunk_id"] == "x"
    with pytest.raises(ValueError):
        fuse.rrf(lists(spark, a), constant=0)


# Evaluation


def test_metrics(spark):
    rows = spark.createDataFrame([("q", 1, False), ("q", 2, True), ("q", 3, True)], "query_id string, rank int, relevant boolean")
    items = spark.createDataFrame([("q", "slot"), ("none", "slot")], "query_id string, bucket string")
    got = {r["query_id"]: r for r in evaluate.question_metrics(rows, items).collect()}
    assert got["q"]["mrr"] == 0.5 and got["q"]["p@5"] == 0.4 and got["q"]["hit@1"] == 0 and abs(got["q"]["ndcg@3"] - 0.693426) < 1e-5
    assert got["none"]["mrr"] == 0 and got["none"]["ndcg@10"] == 0
    found = spark.createDataFrame([("q", 1, 4)], "query_id string, span_id int, rank int")
    spans = spark.createDataFrame([("q", 1), ("q", 2)], "query_id string, span_id int")
    assert tuple(evaluate.span_recall(found, spans, 5).first())[1:] == (0.5, 1.0, 0.0)


def test_relevant_documents(spark):
    docs = spark.createDataFrame([(1, "aba abab"), (2, None), (3, "xyz b")], "doc_id long, text string")
    spans = spark.createDataFrame([(1, "bab"), (2, "b"), (3, ""), (4, None), (5, "b"), (6, "aba abab")], "item_id long, text string")
    assert sorted(map(tuple, evaluate.relevant_documents(docs, spans).collect())) == [(1, 1), (2, 1), (2, 3), (5, 1), (5, 3), (6, 1)]


def test_answer_metrics(spark):
    s = [("corpus_technical", "corpus_technical", False, True, True, 0.5, 100, 2), ("out_of_scope", "general", True, True, None, None, 300, 4)]
    d = spark.createDataFrame(s, "expected_route string, predicted_route string, expected_abstain boolean, abstained boolean, citations_valid boolean, groundedness double, latency_ms long, llm_calls int")
    r = evaluate.answer_metrics(d).first()
    assert (r["route_accuracy"], r["abstention_precision"], r["abstention_recall"], r["latency_p50_ms"], r["llm_calls_per_query"]) == (0.5, 0.5, 1.0, 100.0, 3.0)
    assert evaluate.answer_metrics(d.limit(0)).first()["route_accuracy"] == 0


def test_spearman_and_ranks(spark):
    d = spark.createDataFrame([(1.0, 1.0), (0.2, 0.8), (0.8, 0.7), (0.8, 0.9)], "x double, y double")
    assert abs(evaluate.spearman(d, "x", "y").first()["spearman"] - 0.632456) < 1e-5
    assert evaluate.spearman(d.limit(1), "x", "y").first()["spearman"] == 0
    values = [rng.randrange(50) for _ in range(200)]
    got = {r["p"]: r["value"] for r in evaluate.nearest_rank_of(spark.createDataFrame([(v,) for v in values], "v int"), "v", (0, 5, 50, 95, 100)).collect()}
    assert got == {p: sorted(values)[round(p / 100 * 199)] for p in (0, 5, 50, 95, 100)}


def test_misses(spark):
    rows = [("a", "d1", ["d2"], 0.0, 0.0, 0.0, 0.0), ("b", "d1", ["d1"], 0.0, 1.0, 0.5, 0.1), ("c", "d1", ["d1"], 1.0, 1.0, 1.0, 1.0)]
    d = spark.createDataFrame(rows, "id string, doc_id string, doc_ids array<string>, `hit@5` double, `hit@10` double, `r@10` double, mrr double")
    assert [(r["id"], r["tag"]) for r in evaluate.top_misses(d).collect()] == [("a", "exact_term_miss"), ("b", "reranker_demoted_gold")]


# Feedback and registry


def test_feedback(spark):
    f = spark.createDataFrame([(1, "q1", -1), (2, "q1", -1), (3, "q2", 5)], "feedback_id int, query_id string, rating int")
    logs = spark.createDataFrame([("q1", "r", ["d1", "d1x"]), ("q2", None, [])], "query_id string, route string, cited_doc_ids array<string>")
    kinds = spark.createDataFrame([("d1", "License")], "doc_id string, kind string")
    got = {r["key"]: tuple(r)[1:] for r in feedback.ratings_by_kind(f, logs, kinds).collect()}
    assert got == {"License": (2, -1.0, 0, 2), "(unknown)": (2, -1.0, 0, 2), "(none)": (1, 5.0, 1, 0)}
    assert {r["key"] for r in feedback.ratings_by(f, logs, "route").collect()} == {"r", "(none)"}
    assert feedback.worst_queries(f, logs).first()["query_id"] == "q1"
    assert feedback.orphans(f, logs.where("query_id = 'q1'")).count() == 1
    likert = spark.createDataFrame([(r,) for r in (-1, 1, 2, 3, 4, 5)], "rating int")
    assert tuple(feedback.summary(likert, F.lit("k")).first())[3:] == (2, 3)
    bad = spark.createDataFrame([(0, ["good"]), (5, ["odd"]), (5, ["good"]), (None, None)], "rating int, tags array<string>")
    assert feedback.violations(bad, "tags").count() == 3
    rows = feedback.export(f.withColumn("tags", F.array(F.lit("good"), F.lit("incomplete"))), logs, kinds).collect()
    assert {r["agreement_types"] for r in rows} == {"License,(unknown)", ""} and rows[0]["tags"] == "good,incomplete"


def test_joined_sources(spark):
    t = lambda *n: spark.createDataFrame([(x, i) for i, x in enumerate(n)], "name string, seq int")
    got = {r["name"]: (r["csv"], r["txt"], r["missing"]) for r in registry.joined_sources(t("A b.pdf", "C-d.pdf", "e.pdf"), t("a B.pdf", "c d.pdf", "c_d.pdf"), t("a b.txt")).collect()}
    assert got == {"A b.pdf": ("a B.pdf", "a b.txt", None), "C-d.pdf": ("c d.pdf", None, "txt"), "e.pdf": (None, None, "csv+txt")}


# Sampling


def test_quotas():
    assert sampling.proportional_split({"core": 24, "ip": 16, "other": 10}, 30) == {"core": 14, "ip": 10, "other": 6}
    assert sum(sampling.stratified_quotas({"a": 20, "b": 10, "c": 5}, 30).values()) == 30
    assert sampling.stratified_quotas({"a": 20, "b": 10}, 40) == {"a": 20, "b": 10}
    assert sampling.holdout_quotas({"core": 30, "ip": 2, "other": 30}, 50, {"core": 24, "ip": 16, "other": 10}) == {"core": 24, "ip": 2, "other": 24}


def test_levelling_equals_one_unit_at_a_time():
    for _ in range(300):
        heights = {c: rng.randrange(8) for c in "abcde"[: rng.randrange(1, 6)]}
        n, left = rng.randrange(30), dict(heights)
        for _ in range(min(n, sum(heights.values()))):
            left[max(left, key=lambda s: (left[s], s))] -= 1
        assert sampling.levelled(heights, n) == {s: h - left[s] for s, h in heights.items()}


def test_filled_buckets():
    offers = {f"d{i}": {"slot": ["a", "b"], "yes_span": ["x"] if i % 2 else [], "no_answer": ["y"]} for i in range(6)}
    got = sampling.filled_buckets(offers, {"slot": 4, "yes_span": 3, "no_answer": 2})
    assert len({d for d, _, _ in got}) == 6 and len(got) == len(set(got))
    assert {b: sum(g[1] == b for g in got) for b in ("slot", "yes_span", "no_answer")} == {"slot": 4, "yes_span": 3, "no_answer": 2}


def test_drawn(spark):
    d = spark.createDataFrame([(i, "ab"[i % 5 == 0]) for i in range(1000)], "id long, s string")
    got = sampling.drawn(d, "s", {"a": 700, "b": 3}, "id").groupBy("s").count().collect()
    assert {r["s"]: r["count"] for r in got} == {"a": 700, "b": 3}


def in_turns(chosen, pool):
    """The rule as it is told: one document after another takes the best one left."""
    left, out = sorted((p for p in pool if p[4] and p[0] not in {c[0] for c in chosen}), key=lambda p: p[3]), {}
    for doc in sorted(chosen, key=lambda c: c[3]):
        if doc[4]:
            out[doc[0]] = doc[0]
            continue
        order = sorted(range(len(left)), key=lambda i, d=doc: (0 if (left[i][1] or "") == (d[1] or "") else 1 if (left[i][2] or "") == (d[2] or "") else 2, i))
        out[doc[0]] = left.pop(order[0])[0] if order else None
    return out


GATE = "doc_id long, kind string, group string, seq long, ratio_ok boolean"


@pytest.mark.parametrize("seed", range(6))
def test_ratio_gate_equals_taking_turns(spark, seed):
    rng = random.Random(seed)
    row = lambda i: (i, rng.choice(["a", "b", "c", "d", None]), rng.choice(["core", "ip", "other"]), rng.randrange(10**6) * 1000 + i, rng.choice([True, False, False, None]))
    chosen, pool = [row(i) for i in range(rng.randrange(1, 40))], [row(100 + i) for i in range(rng.choice([5, 30, 80]))]
    got = sampling.ratio_gate(spark.createDataFrame(chosen, GATE), spark.createDataFrame(pool, GATE)).collect()
    assert {r["doc_id"]: r["final"] for r in got} == in_turns(chosen, pool)


@pytest.mark.parametrize("n_pool", [200, 12])
def test_ratio_gate_in_few_rounds(spark, monkeypatch, n_pool):
    """Documents of one kind and several groups ask in one list, each at its own place; queues lie in several tasks."""
    rng, rounds = random.Random(n_pool), []
    keep = lambda df, name: (rounds.append(name), written(df, name))[1]
    monkeypatch.setattr(sampling, "written", keep)
    row = lambda i: (i, rng.choice("ab"), rng.choice(["core", "ip", "other"]), rng.randrange(10**6) * 1000 + i, False)
    chosen, pool = [row(i) for i in range(30)], [(*row(1000 + i)[:4], True) for i in range(n_pool)]
    got = sampling.ratio_gate(spark.createDataFrame(chosen, GATE), spark.createDataFrame(pool, GATE)).collect()
    assert {r["doc_id"]: r["final"] for r in got} == in_turns(chosen, pool)
    assert n_pool < 100 or len([name for name in rounds if re.match(r"gate-[0-9]", name)]) == 1


def test_queues_lie_in_several_tasks(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), i, rng.randrange(300)) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, seq long, pos long").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["seq"]: (r["nth"], r["lead"]) for r in sampling.queued(df, ["key"], ["seq"], F.col("pos")).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for key in "ab":
        own = [r for r in rows if r[0] == key]
        want |= {s: (i, max(p - j for j, (_, _, p) in enumerate(own[:i], 1))) for i, (_, s, _) in enumerate(own, 1)}
    assert got == want


def test_ratio_gate_notes(spark):
    chosen = spark.createDataFrame([(1, "k", "g", 1, True), (2, "k", "g", 2, False), (3, "k", "g", 3, False), (4, "k", "g", 4, False)], GATE)
    pool = spark.createDataFrame([(7, "x", "y", 1, True), (8, "k", "g", 2, False), (9, "k", "g", 3, True)], GATE)
    assert sorted((r["doc_id"], r["final"], r["note"]) for r in sampling.ratio_gate(chosen, pool).collect()) == [(1, 1, None), (2, 9, "replaced 2 -> 9"), (3, 7, "replaced 3 -> 7"), (4, None, "no_replacement 4")]
    assert sampling.ratio_gate(chosen.limit(0), pool).count() == 0 and sampling.ratio_gate(chosen, pool.limit(0)).where("final IS NULL").count() == 3


def test_null_strata(spark):
    have = {"a": 5, None: 7, "b": 3}
    for quotas in (sampling.holdout_quotas(have, 9, {"a": 2, "b": 1}), sampling.proportional_split(have, 7), sampling.stratified_quotas(have, 8)):
        assert sum(quotas.values()) in (7, 8, 9) and quotas[None] > 0
        docs = spark.createDataFrame([(i, s) for s, n in have.items() for i in range(n)], "doc_id int, s string").withColumn("doc_id", F.monotonically_increasing_id())
        got = {r["s"]: r["count"] for r in sampling.drawn(docs, "s", quotas, "doc_id").groupBy("s").count().collect()}
        assert got == {s: n for s, n in quotas.items() if n}


# Agent


def test_edges_and_texts(spark):
    d = spark.createDataFrame([(0, 0), (1, 2), (2, 0), (0, 2)], "n int, r int").select(agent.after_grade(F.col("n"), F.col("r")).alias("x"))
    assert [r["x"] for r in d.collect()] == ["rewrite_query", "generate", "generate", "abstain"]
    assert one(spark, ["a p.1", "b p.2", "c p.3", "d p.4"], lambda c: agent.abstain_text(F.lit(None), c), "array<string>").endswith("Closest passages: a p.1; b p.2; c p.3.")


def test_claims_and_their_evidence(spark):
    answers = spark.createDataFrame([("q", "The laws of Delaware govern. Payment is due monthly! So?"), ("none", " ... "), ("bare", "Nobody said this.")], "query_id string, answer string")
    contexts = spark.createDataFrame([("q", 1, "delaware laws"), ("q", 2, "The LAWS of delaware shall govern this"), ("q", 3, None), ("other", 1, "payment is due monthly")], "query_id string, seq long, text string")
    each = sorted(map(tuple, agent.supported_claims(answers, contexts).collect()))
    assert each == [("bare", 0, "Nobody said this.", 0.0, None, False), ("q", 0, "The laws of Delaware govern.", 1.0, 2, True), ("q", 1, "Payment is due monthly!", 0.0, None, False)]
    got = {r["query_id"]: (r["score"], r["grounded"], r["unsupported"]) for r in agent.claim_support(answers, contexts).collect()}
    assert got == {"q": (0.5, False, ["Payment is due monthly!"]), "none": (0.0, False, ["empty"]), "bare": (0.0, False, ["Nobody said this."])}
    scores = spark.createDataFrame([("q", 1, [0.1, 0.9, 0.0]), ("q", 2, [0.95]), ("r", 1, [0.99, 0.2]), ("r", 2, [])], "query_id string, seq long, scores array<double>")
    assert sorted(map(tuple, agent.best_entailment(scores).collect())) == [("q", 0.95, 2, True), ("r", 0.2, 1, False)]


def test_grades_in_calls(spark):
    """A grader that leaves chunks out, answers for strangers, and fails on some calls at first and on one for good."""
    rows = [(q, f"{q}{i}", i, "x" * (300 if i % 3 else 2000)) for q in "abc" for i in range(1, 12)]
    candidates = spark.createDataFrame(rows, "query_id string, chunk_id string, rank int, text string")
    calls = agent.calls_of(candidates, 2000, 800).collect()
    assert all(sum(len(i["text"]) for i in c["items"]) <= 2000 for c in calls)
    assert {q: [i["chunk_id"] for c in sorted((c for c in calls if c["query_id"] == q), key=lambda c: c["call"]) for i in c["items"]] for q in "abc"} == {q: [f"{q}{i}" for i in range(1, 12)] for q in "abc"}
    seen = []

    def grade(left):
        seen.append(sorted((r["query_id"], r["call"]) for r in left.collect()))
        fails = (F.col("query_id") == "a") & (F.col("call") == 1) if len(seen) == 1 else F.lit(False)
        fails = fails | (F.col("query_id") == "b") & (F.col("call") == 0)
        kept = F.filter("items", lambda i: ~i["chunk_id"].endswith("5"))
        grades = F.transform(kept, lambda i: F.struct(i["chunk_id"].alias("chunk_id"), (F.length(i["text"]) < 800).alias("relevant")))
        return left.select("query_id", "call", F.when(~fails, F.concat(grades, F.array(F.struct(F.lit("zz").alias("chunk_id"), F.lit(True).alias("relevant"))))).alias("grades"))

    got = {r["chunk_id"]: r["relevant"] for r in agent.graded_in_calls(candidates, grade, 2000, 800).collect()}
    lost = {i["chunk_id"] for c in calls if (c["query_id"], c["call"]) == ("b", 0) for i in c["items"]}
    assert got == {c: i % 3 > 0 and i != 5 and c not in lost for _, c, i, _ in rows}
    assert seen[1:] == [[("a", 1), ("b", 0)], [("b", 0)]]


def test_citations(spark):
    c = spark.createDataFrame([("q", "1", "d", "Laws of Delaware"), ("q", "1", "e", "laws"), ("q", "9", "d", "x"), ("q", "1", None, " "), ("q", "1", "d", "laws of delawere")], "query_id string, chunk_id string, doc_id string, quote string")
    r = spark.createDataFrame([("q", "1", "d", "the laws of\ndelaware apply")], "query_id string, chunk_id string, doc_id string, text string")
    got = {(x["chunk_id"], x["doc_id"], x["quote"]): x["error"] for x in agent.citation_errors(c, r, X.fuzzy_contains()).collect()}
    assert list(map(got.get, [("1", "d", "Laws of Delaware"), ("1", "e", "laws"), ("9", "d", "x"), ("1", None, " "), ("1", "d", "laws of delawere")])) == [None, "doc_id mismatch for 1", "unknown chunk_id 9", "quote not in chunk 1", None]


def test_answer_loop(spark):
    ask = [("g", "general"), ("c", "ambiguous"), ("r", "out_of_scope"), ("ok", "delaware law"), ("re", "rewrite me"), ("no", "unknown"), ("bad", "unsupported law")]
    store = spark.createDataFrame([("c1", "d1", 1, "delaware law governs"), ("c2", "d2", 2, "delaware law applies here")], "chunk_id string, doc_id string, page int, text string")

    def retrieve(q):
        hit = F.when(F.contains("q", F.lit("law")), 0.9).otherwise(0.1)
        return q.select("query_id", F.col("text").alias("q")).crossJoin(store).withColumn("score", hit).withColumn("rank", F.col("page")).select("query_id", "chunk_id", "doc_id", "page", "text", "score", "rank")

    slots = agent.Slots(
        classify=lambda q: q.select("query_id", F.when(F.col("text").isin("general", "ambiguous", "out_of_scope"), F.col("text")).otherwise("corpus_technical").alias("route")),
        retrieve=retrieve,
        rewrite=lambda q: q.select("query_id", F.when(F.col("question") == "rewrite me", "the law").otherwise(F.col("question")).alias("text")),
        generate=lambda q: q.select("query_id", F.when(F.contains("question", F.lit("unsupported")), "pure invention").otherwise("delaware law").alias("answer")),
        general=lambda q: q.select("query_id", F.lit("body").alias("answer")),
        clarify=lambda q: q.select("query_id", F.lit("which?").alias("answer")),
    )
    got = {r["query_id"]: r for r in agent.answer(spark.createDataFrame(ask, "query_id string, text string"), slots).collect()}
    assert len(got) == len(ask)
    assert got["g"]["answer"] == f"{agent.DISCLAIMER} body" and got["c"]["answer"] == "which?" and got["r"]["answer"] == agent.REFUSAL
    assert got["ok"]["answer"] == "delaware law" and got["ok"]["groundedness"] == 1.0 and got["ok"]["rewrites"] == 0
    assert got["re"]["rewrites"] == 1 and not got["re"]["abstained"]
    assert got["no"]["abstained"] and got["no"]["rewrites"] == 2 and "d1 p.1; d2 p.2" in got["no"]["answer"]
    assert got["bad"]["abstained"] and got["bad"]["groundedness"] == 0.0


def test_the_loop_reranks_and_grades(spark):
    """The reranker sees the question as asked, in each round; the grader takes what it left on top."""
    store = spark.createDataFrame([("c1", "d1", 1, "nothing of it"), ("c2", "d2", 2, "delaware law governs"), ("c3", "d3", 3, "law of texas")], "chunk_id string, doc_id string, page int, text string")
    rounds = []

    def rerank(questions, found):
        rounds.append({r["query_id"]: r["text"] for r in questions.collect()})
        return agent.reranked(questions, found)

    slots = agent.Slots(
        classify=lambda q: q.select("query_id", F.lit("corpus_technical").alias("route")),
        retrieve=lambda q: q.select("query_id").crossJoin(store).withColumn("score", F.lit(0.9)).withColumn("rank", F.col("page")).select("query_id", "chunk_id", "doc_id", "page", "text", "score", "rank"),
        rewrite=lambda q: q.select("query_id", F.lit("something else").alias("text")),
        generate=lambda q: q.select("query_id", F.regexp_extract("blocks", r'id="(\w+)"', 1).alias("answer")),
        general=lambda q: q.select("query_id", F.lit("").alias("answer")),
        clarify=lambda q: q.select("query_id", F.lit("").alias("answer")),
        rerank=rerank,
        grade=lambda q, c: c.withColumn("relevant", (F.col("rank") <= 1) & (F.col("score") > 0.9)),
    )
    asked = spark.createDataFrame([("ok", "delaware law governs"), ("no", "rent of offices")], "query_id string, text string")
    got = {r["query_id"]: r for r in agent.answer(asked, slots, min_relevant=1, support=0.0).collect()}
    assert got["ok"]["answer"] == "c2" and got["ok"]["rewrites"] == 0
    assert got["no"]["abstained"] and "d1 p.1; d3 p.3; d2 p.2" in got["no"]["answer"]
    assert rounds == [{"ok": "delaware law governs", "no": "rent of offices"}, {"no": "rent of offices"}, {"no": "rent of offices"}]


# Configuration, collections, streams


def test_config():
    c = config.with_environment(config.BASE, environ={"DOCGRAIN__AGENT__MAX_REWRITES": "5", "OTHER": "x"})
    assert c["agent"]["max_rewrites"] == 5 and config.BASE["agent"]["max_rewrites"] == 2
    with pytest.raises(config.ConfigError):
        config.with_environment(config.BASE, environ={"DOCGRAIN__AGENT__NOPE": "5"})
    with pytest.raises(config.ConfigError):
        config.with_environment(config.BASE, environ={"DOCGRAIN__AGENT__MAX_REWRITES": "many"})
    over = lambda **p: config.merged(config.BASE, {"ingestion": {"dense_embedder": {"params": p}}})
    assert config.index_signature(over(batch_size=9)) == config.index_signature(config.BASE) != config.index_signature(over(dim=9))
    assert config.config_hash(config.BASE | {"profile": "x", "api_key": "s"}) == config.config_hash(config.BASE)
    s = config.Strategies("fusion")
    s.register("rrf")(len)
    with pytest.raises(ValueError):
        s.register("rrf")(len)
    with pytest.raises(config.UnknownStrategy):
        s.get("nope")


def test_collections(spark, tmp_path):
    c = collections.Collection(spark, str(tmp_path), "docs__1", {"dim": 8})
    rows = lambda *r: spark.createDataFrame(r, "doc_id long, sha256 string")
    assert c.replace({"points": rows((1, "a"), (2, "b"))}, {"points": 2}, {"points": {"top": F.max("doc_id")}}) == {"points": {"rows": 2, "top": 2}} and c.version == 1
    with pytest.raises(RuntimeError, match="wrote 1 rows, expected 5"):
        c.replace({"points": rows((1, "z"))}, {"points": 5})
    assert c.version == 1 and c.table("points").count() == 2
    with pytest.raises(collections.CollectionMismatch):
        collections.Collection(spark, str(tmp_path), "docs__1", {"dim": 9})
    assert collections.upserted(c.table("points"), rows((2, "c"), (3, "d")), "doc_id").count() == 3
    assert collections.without_other_versions(rows((1, "a"), (1, "b"), (2, "c")), rows((1, "b"))).count() == 2


def test_a_writer_that_dies_leaves_the_version_before(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "doc_id long, sha256 string")
    c = collections.Collection(spark, str(tmp_path), "docs", {"dim": 8})
    c.replace({"points": rows((1, "a"))})
    real = collections.Collection._write
    for dies in ("before", "half"):

        def write(self, name, text, dies=dies):
            if dies == "half":  # the file beside its place is there, the rename isn't done
                (tmp_path / "docs" / f"{name}.new").write_text("{")
            raise OSError("killed")

        collections.Collection._write = write
        with pytest.raises(OSError, match="killed"):
            c.replace({"points": rows((2, "b"), (3, "c"))})
        collections.Collection._write = real
        again = collections.Collection(spark, str(tmp_path), "docs", {"dim": 8})
        assert again.exists() and again.version == 1 and [r["doc_id"] for r in again.table("points").collect()] == [1]
    c.replace({"points": rows((2, "b"))})
    assert c.version == 2 and c.table("points").count() == 1


def test_one_bad_rating_leaves_the_table(spark, tmp_path):
    logs = spark.createDataFrame([("q1",), ("q1",), ("q2",)], "query_id string")
    rows = lambda *r: spark.createDataFrame(r, "feedback_id string, query_id string, rating int, tags array<string>")
    c = collections.Collection(spark, str(tmp_path), "feedback", {})
    feedback.append(c, rows(("a", "q1", 5, ["good"]), ("b", "q2", -1, None)), logs)
    for bad, why in ((("c", "q1", 0, None), "rating 0"), (("c", "q1", None, None), "rating null"), (("c", "q1", 1, ["good", "nice"]), "unknown tags nice"), (("c", "q9", 1, None), "unknown query_id q9"), (("c", None, 1, []), "unknown query_id null")):
        with pytest.raises(Exception, match=why):
            feedback.append(c, rows(("d", "q2", 4, None), bad), logs)
        assert c.version == 1 and c.table("feedback").count() == 2
    assert feedback.append(c, rows(("a", "q1", 2, ["incomplete"]), ("d", "q2", 4, None)), logs) == {"feedback": {"rows": 3}}
    assert {r["feedback_id"]: r["rating"] for r in c.table("feedback").collect()} == {"a": 2, "b": -1, "d": 4}


def test_index_is_built_once_and_searched(spark, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["cat", "dog", "bird", "fish", "cow"]) for _ in range(30))) for i in range(40)], "doc_id long, text string")
    ask = spark.createDataFrame([(1, "cat cow"), (2, "fish")], "query_id int, text string")
    index = collections.Collection(spark, str(tmp_path), config.collection_name(config.BASE), {"index_sig": config.index_signature(config.BASE)})
    seen = retrieval.build_index(docs, index)
    assert index.version == 1 and seen["chunks"]["rows"] == seen["vectors"]["rows"] == 40 and seen["postings"]["occurrences"] == 40 * 30
    flat = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in df.collect())
    assert flat(retrieval.search_index(index, ask, 5)) == flat(retrieval.hybrid(retrieval.chunks_of(docs), ask, 5))


def test_stream_ingest(spark, tmp_path):
    c = collections.Collection(spark, str(tmp_path / "c"), "docs", {})
    src = str(tmp_path / "in")
    docs = lambda *r: spark.createDataFrame(r, "doc_id long, text string").coalesce(1)
    docs((1, "one"), (2, "two")).write.parquet(src)
    for _ in range(2):  # the second start finds nothing new
        ingest.ingest_stream(spark, src, c, "s", str(tmp_path / "k")).awaitTermination()
        assert c.version == 1 and c.table("chunks").count() == 2
    docs((2, "two"), (1, "changed")).write.mode("append").parquet(src)
    ingest.ingest_stream(spark, src, c, "s", str(tmp_path / "k")).awaitTermination()
    assert c.version == 2 and {r["text"] for r in c.table("chunks").collect()} == {"changed", "two"}
    assert ingest.ingest_batch(docs((2, "two")), c, "s") == {"docs": 1, "skipped": 1, "indexed": 0}


def test_failed_ingest_keeps_the_version_before(spark, tmp_path):
    c = collections.Collection(spark, str(tmp_path / "c"), "docs", {})
    ingest.ingest_batch(spark.createDataFrame([(1, "old")], "doc_id long, text string"), c, "s")

    def fails(docs):
        return docs.select("doc_id", F.raise_error(F.lit("boom")).cast("int").alias("chunk_idx"), F.lit(0).alias("start"), F.lit(0).alias("end"), "text")

    with pytest.raises(Exception, match="boom"):
        ingest.ingest_batch(spark.createDataFrame([(1, "new")], "doc_id long, text string"), c, "s", fails)
    assert c.version == 1 and c.table("chunks").first()["text"] == "old"


def test_readers(spark, tmp_path):
    (tmp_path / "License_Agreements").mkdir()
    (tmp_path / "odd").mkdir()
    (tmp_path / "License_Agreements" / "A.PDF").write_bytes(b"%PDF-1")
    (tmp_path / "odd" / "b.pdf").write_bytes(b"x")
    (tmp_path / "c.txt").write_text("hello\nworld")
    files = readers.binary_files(spark, str(tmp_path))
    assert {r["kind"] for r in files.collect()} == {"License", None} and readers.unmapped(files).count() == 1
    assert readers.text_files(spark, str(tmp_path / "c.txt")).first()["text"] == "hello\nworld"
    (tmp_path / "qa.json").write_text('[{"id": "q1", "bucket": "slot", "split": "dev", "gold_spans": ["x"], "expected_abstain": false}]')
    items = readers.item_set(spark, str(tmp_path / "qa.json"))
    assert items.count() == 1 and evaluate.included(items).count() == 1
    raw = spark.createDataFrame([(b"\n%PDF-1.7", "a.pdf"), (b"GIF", "b.pdf")], "content binary, name string")
    assert [r["e"] for r in raw.select(readers.upload_errors(F.col("content"), F.col("name")).alias("e")).collect()] == [None, "not a PDF"]
    assert [r["value"] for r in readers.listed(spark.createDataFrame([("a # c",), ("# x",), (" ",)], "value string")).collect()] == ["a"]
