"""Containment joins against a comparison of every text with every passage."""

import random

import pytest

from docgrain.functions import text as X
from docgrain.operators import contain, evaluate


def made_texts(rng, n, words):
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))) for _ in range(n)]


def worn(rng, text, share):
    out = []
    for c in text:
        r = rng.random()
        out.append("" if r < share / 3 else rng.choice("abcdxyz") if r < 2 * share / 3 else c + rng.choice("abz") if r < share else c)
    return "".join(out)


WORDS = ["licence", "term", "of", "the", "agreement", "parties", "hereto", "straße", "日本語", "🙂🙂", "a", "shall", "terminate"]


def test_holders_equal_all_pairs(spark):
    rng = random.Random(2)
    texts = [(i, t) for i, t in enumerate(made_texts(rng, 120, WORDS))] + [(500, None), (501, ""), (502, "x" * 3000), (3, "another row of this id"), (None, "the term of the agreement shall terminate at once")]
    cut = [t for _, t in texts if t]
    passages = []
    for i in range(200):
        t = rng.choice(cut)
        a = rng.randrange(len(t))
        passages.append((i, t[a : a + rng.choice([1, 2, 5, 7, 8, 9, 20, 31, 32, 33, 80])]))
    passages += [(300, None), (301, ""), (302, "x" * 2999), (303, "nowhere to be found in any of these texts"), (7, "the term"), (None, "the term of the agreement")]
    d, p = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(passages, "item_id long, text string")
    got = sorted(map(tuple, evaluate.relevant_documents(d, p).collect()), key=str)
    want = sorted({(i, k) for i, s in passages if s for k, t in texts if t and s in t}, key=str)
    assert got == want


def test_holders_of_nothing(spark):
    d, p = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "some passage")], "item_id int, text string")
    assert contain.holders(d, p).collect() == [] and contain.holders(d, p.where("item_id > 1")).dtypes == [("item_id", "int"), ("doc_id", "bigint")]


@pytest.mark.parametrize("threshold", [90.0, 75.0, 60.0])
def test_near_holders_equal_all_pairs(spark, threshold):
    rng = random.Random(int(threshold))
    texts = [(i % 3, i, " ".join(t.split())) for i, t in enumerate(made_texts(rng, 40, WORDS))] + [(0, 70, "a"), (1, 71, ""), (2, 72, None), (2, 73, "the term of")]
    whole = [t for t in texts if t[2]]
    passages = []
    for i in range(90):
        block, _, t = rng.choice(whole)
        a = rng.randrange(len(t))
        passages.append((rng.choice([block, block, (block + 1) % 3]), i, 0, worn(rng, t[a : a + rng.choice([3, 6, 12, 30, 60, 150])], rng.choice([0, 0.05, 0.12, 0.3]))))
    passages += [(1, 200, 1, None), (1, 201, 0, ""), (5, 202, 0, "the term of")]
    d, p = spark.createDataFrame(texts, "part int, key long, text string"), spark.createDataFrame(passages, "part int, id int, at int, text string")
    got = sorted(map(tuple, contain.near_holders(d, p, "part", ["key"], ["id", "at"], threshold).collect()))
    want = sorted((i, at, k) for b, i, at, s in passages if s for c, k, t in texts if t and b == c and (s in t or X.partial_ratio(s, t) >= threshold))
    assert got == want and 0 < len(want) < len(passages) * len(texts) / 3
    exact = sorted((i, at, k) for b, i, at, s in passages if s for c, k, t in texts if t and b == c and s in t)
    assert threshold < 90 or len(want) > len(exact)


def test_pairs_without_common_runs_are_never_compared(spark):
    rng = random.Random(1)
    texts = [(0, i, "".join(rng.choice("abcdefghijklmnop") for _ in range(400))) for i in range(100)]
    d, p = spark.createDataFrame(texts, "part int, key long, text string"), spark.createDataFrame([(0, k, t[50:150]) for _, k, t in texts], "part int, id long, text string")
    assert sorted(map(tuple, contain.sharing(p, d, "part", ["id"], ["key"], 90.0).collect())) == [(k, k) for k in range(100)]
