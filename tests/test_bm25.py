"""BM25 and sparse search by blocks of questions against the join of postings, and against their formulas."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

from docgrain.functions import stem
from docgrain.operators import search
from docgrain.sources.scratch import written

WORDS = [f"w{i}" for i in range(40)] + ["the"] * 30


@pytest.mark.parametrize("sizes", [(256, 16_384, 4_000_000), (3, 16_384, 40), (256, 5, 100)])
def test_blocks_equal_the_join(spark, monkeypatch, sizes):
    for name, n in zip(("ASKED_BLOCK", "ASKED_WORDS", "CELLS"), sizes, strict=True):
        monkeypatch.setattr(search, name, n)
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    chunks = spark.createDataFrame([(f"{i}:0", text(rng.randrange(0, 30))) for i in range(200)] + [("x", None), ("y", ""), ("same", "w1 w2"), ("same2", "w1 w2")], "chunk_id string, text string").repartition(5)
    asked = spark.createDataFrame([(i, text(rng.randrange(1, 9))) for i in range(20)] + [(50, "nowhere"), (51, ""), (52, None), (53, "w1 W1 the")], "query_id long, text string")
    want = search.ranked(search.bm25_scores(search.bm25_index(chunks), asked), 7)
    key = lambda df: sorted(map(tuple, df.select("query_id", "chunk_id", "score", "rank").collect()))
    assert key(search.bm25_top_k(chunks, asked, 7)) == key(want)


def test_nothing_asked_or_held(spark):
    chunks, asked = spark.createDataFrame([("a", "w1")], "chunk_id string, text string"), spark.createDataFrame([(1, "w1")], "query_id long, text string")
    assert search.bm25_top_k(chunks, asked.limit(0)).count() == 0 == search.bm25_top_k(chunks.limit(0), asked).count()
    assert [tuple(r) for r in search.bm25_top_k(chunks, asked).collect()] == [(1, "a", pytest.approx(0.287682072), 1)]


def test_blocks_hold_few_words():
    rows = [{"terms": list(t)} for t in ("ab", "bc", "cd", "abcdefgh", "a", "b")]
    assert [["".join(r["terms"]) for r in b] for b in search.asked_blocks(iter(rows), 2, 4)] == [["ab", "bc"], ["cd"], ["abcdefgh"], ["a", "b"]]


def joined_top_k(chunks, asked, k, decimals):
    """Dot products by definition: chunks {id: {term: weight}}, asked {id: {term: weight}}."""
    df, out = {}, []
    for own in chunks.values():
        for t in own:
            df[t] = df.get(t, 0) + 1
    for q, terms in asked.items():
        found = [(-(round(math.fsum(w * math.log(1 + (len(chunks) - df[t] + 0.5) / (df[t] + 0.5)) * own[t] for t, w in terms.items() if t in own), decimals) + 0.0), c) for c, own in chunks.items() if own.keys() & terms.keys()]
        out += [(q, c, pytest.approx(-s, abs=2 * 10**-decimals), i) for i, (s, c) in enumerate(sorted(found)[:k], 1)]
    return out


@pytest.mark.parametrize("sizes", [(256, 16_384, 1_000_000), (3, 16_384, 40), (256, 5, 100)])
def test_sparse_blocks_equal_the_join(spark, monkeypatch, sizes):
    """Slots that words share, counts of more than one in questions, ties, scores that round to zero; no posting is shuffled."""
    for name, n in zip(("ASKED_BLOCK", "ASKED_WORDS", "CELLS"), sizes, strict=True):
        monkeypatch.setattr(search, name, n)
    kept = []
    monkeypatch.setattr(search, "written", lambda df, name: (kept.append(name), written(df, name))[1])
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    rows = [(f"{i}:0", text(rng.randrange(0, 30)) + " everywhere") for i in range(150)] + [("same", "w1 w2  W2 w3"), ("same2", "w1 w2 w2 w3"), ("x", None), ("y", "")]
    asks = [(i, text(rng.randrange(1, 9))) for i in range(12)] + [(50, "nowhere"), (51, None), (52, "w1 w1 the w2"), (53, "everywhere")]
    chunks, asked = (spark.createDataFrame(r, f"{k}, text string").repartition(5) for r, k in ((rows, "chunk_id string"), (asks, "query_id long")))

    def slots(t):
        return Counter(int(hashlib.sha256(w.encode()).hexdigest()[:8], 16) % 7 for w in (t or "").lower().split())

    lists = written(search.hash_lists(chunks, 7), "lists")
    got = sorted(map(tuple, search.sparse_top_k(lists, search.hash_sparse(asked, "query_id", modulus=7), 6).collect()), key=lambda r: (r[0], r[3]))
    assert got == joined_top_k({c: slots(t) for c, t in rows}, {q: slots(t) for q, t in asks}, 6, 6)
    assert set(kept) <= {"top-k-round"}


def test_stems_are_encoded_in_their_row(spark, monkeypatch):
    """Encodings need no shuffle and no table of words or stems."""
    monkeypatch.setattr(search, "written", lambda df, name: pytest.fail(name))
    text = "The licences of licensing: Licence, straße, STRASSE running runs x x"
    chunks = spark.createDataFrame([("a", text), ("b", None), ("c", "the of and"), ("d", "agreements")], "chunk_id string, text string")
    made = search.bm25_sparse(chunks)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    tfs = Counter(stem.stem_of(w) for w in re.findall(r"[^\W]+", text.lower()) if stem.stem_of(w) is not None)
    want = {("a", t): n * 2.2 / (n + 1.2 * (0.25 + 0.75 * sum(tfs.values()) / 256)) for t, n in tfs.items()} | {("d", "agreement"): 2.2 / (1 + 1.2 * (0.25 + 0.75 / 256))}
    assert {(r["chunk_id"], r["idx"]): r["weight"] for r in made.collect()} == pytest.approx(want, abs=1e-9) and tfs["licenc"] == 2


def test_stem_search_equals_the_join(spark):
    rng = random.Random(3)
    words = ["licence", "licences", "running", "runs", "the", "terms", "term", "agreed", "日本語", "x"]
    rows = [(f"{i}:0", " ".join(rng.choice(words) for _ in range(rng.randrange(0, 25)))) for i in range(80)]
    asks = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 6)))) for i in range(10)]
    chunks, asked = spark.createDataFrame(rows, "chunk_id string, text string").repartition(4), spark.createDataFrame(asks, "query_id long, text string")
    own = {c: {} for c, _ in rows}
    for r in search.bm25_sparse(chunks).collect():
        own[r["chunk_id"]][r["idx"]] = r["weight"]
    wanted = {q: {stem.stem_of(w): 1.0 for w in t.split() if stem.stem_of(w) is not None} for q, t in asks}
    got = sorted(map(tuple, search.bm25_sparse_top_k(written(search.stem_lists(chunks), "lists"), search.bm25_sparse_query(asked), 5).collect()), key=lambda r: (r[0], r[3]))
    assert got == joined_top_k(own, wanted, 5, 6)
