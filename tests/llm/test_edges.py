"""Every operator's query, and the pipeline, on odd and on empty tables."""

import math
import random

import pytest

pytest.importorskip("docgrain.llm.queries")
import corpus_pipeline
from docgrain.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators might use themselves.
CLASHING = ["score", "kept", "size", "n", "bin", "key", "comp", "h", "label", "point", "bands", "taken", "offset", "held_out", "cell", "tokens", "row", "word"]


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "Epsilon.", "zeta,", "eta", "theta"]) + str(rng.randrange(9)) for _ in range(n))


def odd_documents():
    rng = random.Random(4)
    base = words(rng, 120)
    rows = [
        (0, base, "en", "a", len(base)),
        (0, base, "en", "a", len(base)),  # a repeated row
        (1, base, "en", "a", len(base)),  # an exact copy
        (2, base.replace("alpha", "alphb", 1), "en", None, None),  # a near copy
        (3, None, None, None, None),
        (4, "", "en", "b", 0),
        (5, " \n\t ", "en", "b", 4),
        (6, "x" * 200_000, "en", "b", 200_000),  # one very long word
        (7, "1" * 50_000 + "@" + "a." * 20_000, "de", "b", 90_001),
        (8, words(rng, 30_000), "fr", "a", 250_000),
        (9, "one", "de", "c", 3),
        (None, words(rng, 80), "de", "c", 10),
        (None, None, None, None, None),
        (10, "mail me: jo.doe@mail.example.com or +1 (555) 555-0199, card 4111 1111 1111 1111 at 10.0.0.1 \U0001f600", "en", "c", 99),
    ]
    return rows + [(20 + i, words(rng, 60 + i), rng.choice(["en", "de"]), rng.choice("abc"), 300) for i in range(60)]


def write(spark, path, docs, labels, pages, vectors, turns=()):
    extra = {c: "1" for c in CLASHING}
    d = spark.createDataFrame(docs, DOCS)
    l = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    p = spark.createDataFrame(pages, "page_id long, url string, html string")
    e = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    t = spark.createDataFrame(list(turns), "conv_id long, turn long, role string, text string")
    for name, df in (("documents", d), ("labels", l), ("pages", p), ("embeddings", e), ("conversations", t)):
        for c in extra:
            if c not in df.columns:
                df = df.selectExpr("*", f"'1' AS {c}")
        df.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rng = random.Random(5)
    docs = odd_documents()
    labels = [(i, int(i % 4 > 0), int(i % 5 == 0)) for i in range(0, 80)] + [(0, None, None), (None, 1, 1), (1, 0, 1), (999, 1, 0)]
    pages = [
        (0, "http://a.example/x", "<html><body><nav>menu</nav><article><h1>T</h1><p>a &amp; b<br>c</p></article></body></html>"),
        (0, "http://a.example/x", "<html><body><nav>menu</nav><article><h1>T</h1><p>a &amp; b<br>c</p></article></body></html>"),
        (1, None, None),
        (None, "http://a.example/y", "<p>no main here</p>"),
        (2, "http://a.example/z", ""),
        (3, "http://b.example/1", "<div>we all share this long line of boilerplate text</div><p>only here it is</p>"),
        (4, "http://b.example/2", "<div>we all share this long line of boilerplate text</div><p>something else there</p>"),
        (5, "http://b.example/3", "<p>" * 3000 + "deep" + "<b" * 3000),
    ]
    vec = [(i, [float(rng.choice([0, 0.5, -0.5, 1])) for _ in range(8)], i % 3) for i in range(300)]
    vec += [(300 + i, [0.5] * 8, 0) for i in range(60)] + [(0, [1.0] * 8, 1), (None, [1.0] * 8, 1), (401, None, 1), (402, [float("nan")] + [0.0] * 7, 1), (403, [None] + [0.0] * 7, 1), (404, [float("inf")] + [0.0] * 7, 1), (405, [], 1), (406, [1.0], 1)]
    return write(spark, tmp_path_factory.mktemp("odd"), docs, labels, pages, vec)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), [], [], [], [])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


def test_empty_pipeline(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if n.startswith("op") and not n.startswith(("op4_", "op6_", "op7_", "op11_", "op12_"))])
def test_one_row_for_each_document(spark, odd, name):
    rows = QUERIES[name](spark, odd).collect()
    docs = odd_documents()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(d[0]) for d in docs)


@pytest.mark.parametrize(("name", "room"), [("op4_best_fit_packing", 4096), ("op12_cost_packing", 2048)])
def test_packing_keeps_all_tokens(spark, odd, name, room):
    rows = QUERIES[name](spark, odd).collect()
    assert sum(r["start"] == 0 for r in rows) == len(odd_documents())
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= room


def test_pages(spark, odd):
    rows = QUERIES["op6_main_text"](spark, odd).collect()
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in rows]
    assert sorted(map(str, got)) == sorted(
        map(str, [(0, "T a & b c", 9)] * 2 + [(1, "", 0), (None, "no main here", 12), (2, "", 0), (3, "only here it is", 15), (4, "something else there", 20), (5, "deep", 4)])
    )


def test_top_k_of_the_odd_table(spark, odd):
    vectors = [tuple(r) for r in spark.read.parquet(f"{odd}/embeddings.parquet").select("vec_id", "embedding").collect()]
    fine = [(i, [math.floor(1024 * v) for v in x]) for i, x in vectors if i is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)]
    want = []
    for a, (q, x) in enumerate(fine):
        if q % 100 == 0:
            scores = sorted((-sum(m * n for m, n in zip(x, y, strict=False)), i) for b, (i, y) in enumerate(fine) if b != a)
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:10])]
    assert sorted(map(tuple, QUERIES["op7_voronoi_topk"](spark, odd).collect())) == sorted(want)


def test_near_duplicates_of_odd_rows(spark, odd):
    rows = {r["doc_id"]: r for r in QUERIES["op8_minhash_neardup"](spark, odd).collect() if r["doc_id"] is not None}
    assert [rows[i]["component_id"] for i in (0, 1, 2)] == [0, 0, 0] and not rows[1]["kept"] and not rows[2]["kept"]
    assert all(rows[i]["kept"] and rows[i]["n_shingles"] == 0 for i in (3, 4, 5))
    assert rows[9]["n_shingles"] == 1


def test_pipeline_of_odd_rows(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, docs, odd)
        assert new.schema.names == docs.schema.names, name
        path = f"{odd}/stage-{name}"
        new.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        if name == "near_duplicates":
            ids = [r["doc_id"] for r in docs.select("doc_id").where("doc_id IS NOT NULL").collect()]
            assert len(ids) == len(set(ids)) and not {1, 2} & set(ids) and 0 in ids
        if name == "personal_data":
            text = " ".join(r["text"] or "" for r in docs.select("text").collect())
            assert "jo.doe" not in text
    assert corpus_pipeline.STAGES[-1][1](spark, docs, odd).count() >= docs.count()
