"""Operators against plain definitions on small inputs."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("docgrain.llm.queries")
from docgrain.llm import boilerplate, chains, fm, langid, mixing, neardup, packing, pii, rules, voronoi

rng = random.Random(3)


# PII


def plain_base(text):
    """The base patterns as they are written, one after another over the whole text."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        total = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_base_spans_equal_the_patterns():
    for _ in range(4000):
        text = "".join(rng.choice(["a", "Z", "1", "23", ".", "@", "-", " ", "+", "(", ")", "é", "\U0001f600", "4111111111111111", "10.0.0.1", "x@y.z", "+1 555 123 4567", "\n"]) for _ in range(rng.randrange(1, 24)))
        got = [(k, a, b) for k, spans in pii.base_spans(text).items() for a, b in spans]
        assert got == plain_base(text), text


def test_base_spans_take_time_in_proportion():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1 " * 100_000):
        pii.base_spans(text)


def test_base_spans_of_very_long_numbers():
    text = "0" * 5000 + "1.1.1.1 and " + "9" * 5000 + ".1.1.1"
    assert pii.base_spans(text)["ip"] == [(0, 5007)]
    assert [c[:4] for c in pii.candidates(text)] == [("ip", 0, 5007, True)]
    pii.candidates("1[.]2[.]3[.]4")
    assert [pii.below_256(x) for x in ("0", "000", "255", "0255", "256", "1000", "0" * 5000 + "7")] == [True, True, True, True, False, False, True]


def test_the_classifier_reads_the_span_and_not_its_votes():
    """A span that no labeler votes for is taken if it looks like what they agree on; one that two vote for
    is left if it looks like what they reject."""
    own = random.Random(2)
    number = lambda: f"{own.randrange(200, 999)}-{own.randrange(200, 999)}-{own.randrange(1000, 9999)}"
    code = lambda: f"{own.randrange(10, 99)} {own.randrange(1000, 9999)} {own.randrange(1000, 9999)}"

    def slots(before, span, after):
        return pii.features("phone", before + span + after, len(before), len(before) + len(span))

    agreed, rejected = "1,1,0,1,1", "0,1,0,-1,-1"
    sample = [("phone", agreed, slots("bitte anrufen unter ", number(), " oder")) for _ in range(200)]
    sample += [("phone", rejected, slots("teil nummer x", code(), "y lager")) for _ in range(200)]
    model = pii.SpanModel().weigh([("phone", agreed, 200), ("phone", rejected, 200)]).fit(sample)
    assert model.likely["phone", agreed] > 0.9 > 0.1 > model.likely["phone", rejected]
    none = ("phone", 20, 32, False, "0,0,0,0,0", slots("bitte anrufen unter ", number(), " oder"))
    two = ("phone", 13, 25, False, "1,1,0,0,0", slots("teil nummer x", code(), "y lager"))
    assert pii.chosen([none, two], model) == [("phone", 20, 32)]
    assert model.probability("card", none[5]) == 0.0


def test_added_spans_equal_a_plain_run(spark):
    """The query's added spans against the same steps by hand: all candidates, EM over all, one classifier."""
    own = random.Random(8)
    number = lambda: f"{own.randrange(200, 999)}-{own.randrange(200, 999)}-{own.randrange(1000, 9999)}"
    texts = [f"please call me: +1 {number()} today" for _ in range(60)] + [f"call {number()} soon" for _ in range(40)]
    texts += [f"order no. x{number()}y" for _ in range(40)] + [None, "", "nothing"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = pii.candidate_rows(docs)
    got = {r["doc_id"]: r for r in pii.spans(found, pii.fit(found)).collect()}
    every = {i: pii.candidates(t or "") for i, t in enumerate(texts)}
    flat = [c for i in every for c in every[i]]
    counts = {}
    for c in flat:
        counts[c[0], c[4]] = counts.get((c[0], c[4]), 0) + 1
    model = pii.SpanModel().weigh([(*k, n) for k, n in sorted(counts.items())]).fit([(c[0], c[4], c[5]) for c in flat])
    for i in every:
        want = [(k, a, b) for k, a, b, base, _, slots in every[i] if base or model.probability(k, slots) >= pii.ACCEPT]
        assert got[i]["spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b in want)
    assert sum(r["n_added"] for r in got.values()) > 0


def test_query_digest(spark, tmp_path):
    texts = ["write to a@b.co or 10.1.2.3", "nothing", "card 4111111111111111 and +44 20 7946 0958"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.candidate_rows(docs)
    for r in pii.spans(found, pii.fit(found)).collect():
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(plain_base(texts[r["doc_id"]]), key=lambda s: (pii.KINDS.index(s[0]), s[1])))
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))


# Language, quality and toxicity


def test_languages_are_told_apart_by_compression():
    make = lambda v, n: " ".join(rng.choice(v) for _ in range(n))
    one, two = ["haus", "und", "nicht", "schule", "wetter", "straße"], ["maison", "et", "pas", "école", "temps", "rue"]
    own = langid.Compressors([("de", 2, langid.normal(make(one, 800))), ("fr", 1, langid.normal(make(two, 800)))])
    assert all(own(make(one, n))[0] == "de" and own(make(two, n))[0] == "fr" for n in (5, 40, 4000))
    assert own("")[0] == own("123 ...")[0] == "und" and own("123")[1] == 0.0
    assert own("zzzz qqqq")[2]  # nothing to tell: rejected


def test_every_sampled_document_is_in_the_dictionary(spark):
    own = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [c + d + " " + " ".join("".join(own.choice(letters) for _ in range(6)) for _ in range(300)) for c in letters for d in letters[:7]]
    rows = [(i, t, "xx") for i, t in enumerate(texts + ["a hot text " * 200] * 60)]
    ((lang, n, data),) = langid.sampled_pieces(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert (lang, n) == ("xx", len(rows)) and 28_000 < len(data) <= langid.DICTIONARY_BYTES
    assert all(t[:20].encode() in data for t in texts)
    assert data.count(b"a hot text a hot text") < 10


def test_texts_without_letters_have_no_language():
    own = langid.Compressors([("de", 2, b"der die das"), ("fr", 1, b"le la les")])
    assert [own(t)[:2] for t in ("½", "²", "Ⅷ", "12 + 3", "", "🙂", "_")] == [("und", 0.0)] * 7
    assert own("é")[0] != "und" and own("日")[0] != "und" and own("12 a")[0] != "und"


def test_rows_without_ids_are_drawn_each_for_itself(spark):
    own = random.Random(4)
    text = lambda: " ".join("".join(own.choice("abcdefghij") for _ in range(6)) for _ in range(60))
    rows = [(None, text(), "de") for _ in range(5000)] + [(5, text(), "fr") for _ in range(5000)] + [(7, "one row again and again", "fr")] * 5000
    found = langid.sampled_pieces(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=100)
    assert [(k, n) for k, n, _ in found] == [("fr", 10_000), ("de", 5000)]
    for _, _, data in found:
        assert 10_000 < len(data) <= langid.DICTIONARY_BYTES


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)]


def test_rule_statistics():
    for _ in range(600):
        text = "".join(rng.choice(["a", "b", "é", " ", " ", "\n", "\t", "#", "|", "\x85", "\xa0", "c d e ", "\x0b"]) for _ in range(rng.randrange(80)))
        assert rules.statistics(text.encode())[0] == plain_statistics(text), repr(text)


def test_the_forest_isolates_odd_points():
    g = np.random.default_rng(1)
    normal = g.normal(0, 1, (2000, 4))
    forest = rules.Forest(normal)
    assert (forest.score(normal + 0.0).mean() + 0.1) < forest.score(np.full((5, 4), 8.0)).min()


def test_factorisation_identity():
    m = fm.Machine()
    g = np.random.default_rng(2)
    index, value = np.arange(7), g.normal(size=7)
    pairs = sum(m.v[i] @ m.v[j] * value[i] * value[j] for i in range(7) for j in range(i))
    assert np.isclose(m.raw(index, value), m.w0 + m.w[index] @ value + pairs)


def test_the_machine_learns_an_interaction():
    g = np.random.default_rng(3)
    rows, labels = [], []
    for _ in range(1500):
        a, b = g.integers(0, 2, 2)
        rows.append((np.array([10 + a, 20 + b]), np.ones(2)))
        labels.append(float(a == b))
    m = fm.Machine().fit(rows, np.array(labels), epochs=30)
    right = [(m.probability(*r) > 0.5) == bool(y) for r, y in zip(rows, labels, strict=True)]
    assert np.mean(right) > 0.95


def test_the_chain_finds_planted_words():
    texts, labels = [], []
    for i in range(600):
        w = [f"w{rng.randrange(300)}" for _ in range(60)]
        if i % 4 == 0:
            w[rng.randrange(60)] = rng.choice(["grobian", "schuft"])
        texts.append(" ".join(w))
        labels.append([float(i % 4 == 0)] * 2)
    row, slot, value = chains.features(pa.array(texts), chains.Slots())
    bounds = np.searchsorted(row, np.arange(len(texts) + 1))
    rows = chains.Rows([(slot[a:b], value[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
    fitted = chains.Chain(["first", "toxic"]).fit(rows.some(np.arange(400)), np.array(labels[:400]))
    got = fitted.probabilities(rows.some(np.arange(400, 600)))[:, -1] >= fitted.threshold
    assert np.mean(got == np.array(labels[400:])[:, 0]) > 0.98


def plain_features(text):
    """slot -> value, a word at a time."""
    words = text.encode().split()
    own = {s: 1.0 for w in words for s in chains.slots_of(w)[:1]}
    shares = {}
    for w in words:
        for s in chains.slots_of(w)[1:]:
            shares[s] = shares.get(s, 0) + 1
    return own | {s: min(1.0, n / len(words) / chains.FULL_SHARE) for s, n in shares.items()}


def test_toxicity_features():
    texts = ["".join(rng.choice(["ab", "Idiotisch", "é", " ", "\n", "\t", "(idiotisch)", "...", "x" * 90, " idiot ", "\x0b"]) for _ in range(rng.randrange(60))) for _ in range(200)] + ["", "  "]
    row, slot, value = chains.features(pa.array([*texts, None]), chains.Slots())
    for i, t in enumerate([*texts, ""]):
        assert {int(s): round(float(v), 5) for r, s, v in zip(row, slot, value, strict=True) if r == i} == {s: round(v, 5) for s, v in plain_features(t).items()}


def language_texts(own, n, stems):
    rows = []
    for i in range(n):
        lang = sorted(stems)[i % len(stems)]
        w = [f"{lang}{own.randrange(400)}" for _ in range(50)]
        toxic = i % 5 == 0
        if toxic:
            for stem in own.sample(stems[lang], 2):
                w[own.randrange(50)] = stem + own.choice(["", "en", "isch"])
        rows.append((i, " ".join(w), lang, int(toxic)))
    return rows


def test_toxicity_by_language(spark):
    """Categories come from the labels of each language, and held-out recall holds in each; the query's scores are those of a
    plain computation, one text and one word at a time."""
    stems = {"de": ["grobian", "schuft", "halunke", "trottel"], "fr": ["vaurien", "crapule", "canaille", "pignouf"], "xx": ["qqrrst", "zzwwvu", "kkllmm", "ppnnoo"]}
    rows = language_texts(random.Random(3), 1500, stems)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows if r[0] % 4], "doc_id long, toxic int")
    seen = {}
    real = chains.derived

    def spy(features, toxic, langs, n=chains.CATEGORIES):
        found = real(features, toxic, langs, n)
        seen.update({g: found[[x == g for x in langs]].sum(axis=0) for g in set(langs)})
        assert not found[~toxic].any()
        return found

    chains.derived = spy
    try:
        fitted = chains.fit(docs, labels)
    finally:
        chains.derived = real
    assert set(seen) == set(stems) and all((n > 0).all() for n in seen.values())
    got = {r["doc_id"]: r for r in chains.score(docs, fitted).collect()}
    for lang in stems:
        held = [r for r in rows if r[0] % 4 == 0 and r[2] == lang]
        assert sum(got[r[0]]["toxic"] for r in held if r[3]) >= 0.9 * sum(r[3] for r in held)
        assert sum(got[r[0]]["toxic"] for r in held if not r[3]) <= 0.02 * len(held)
    for i, text, _, _ in rows[::50]:
        own, out = plain_features(text), []
        for m in fitted.models:
            z = m.b + sum(w * own.get(int(s), 0.0) for s, w in zip(m.slots, m.w, strict=True)) + sum(d * p for d, p in zip(m.d, out, strict=True))
            out.append(1 / (1 + math.exp(-z)))
        assert np.allclose([got[i][f"p_{n}"] for n in fitted.names], out, atol=1e-6)
        assert got[i]["toxic"] == (out[-1] >= fitted.threshold)


# Whole queries against plain definitions


def small_tables(spark, path, n=240):
    own = random.Random(11)
    vocabulary = {"de": ["haus", "und", "nicht", "schule", "wetter", "straße"], "fr": ["maison", "et", "pas", "école", "temps", "rue"]}
    docs, labels = [], []
    for i in range(n):
        lang, bad = own.choice(["de", "fr"]), own.random() < 0.3
        text = " ".join(own.choice(vocabulary[lang]) + str(own.randrange(40)) for _ in range(own.randrange(30, 160)))
        text = " | ".join(text.split()) + " #$%" * 9 if bad else text
        docs.append((i, text, lang, "s", len(text)))
        if i % 2:
            labels.append((i, int(not bad), 0))
    docs += [(n, None, "de", "s", 0), (n + 1, "", None, "s", 0), (n + 2, "123", "fr", "s", 3)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return docs, labels


def test_language_query(spark, tmp_path):
    import zstandard
    from docgrain.llm.queries import op2_language_id

    docs, _ = small_tables(spark, tmp_path)
    got = {r["doc_id"]: r for r in op2_language_id(spark, str(tmp_path)).collect()}
    held = {d[0]: zlib.crc32(str(d[0]).encode()) % 3 == 1 for d in docs}
    parts = langid.sampled_pieces(spark.createDataFrame([(d[0], d[1], d[2]) for d in docs if not held[d[0]] and d[2]], "doc_id long, text string, lang string"))
    right = 0
    for d in docs:
        r = got[d[0]]
        assert r["held_out"] == held[d[0]]
        if not d[1] or not any(c.isalpha() for c in d[1]):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        data = langid.normal(d[1])
        sizes = []
        for order, (lang, _, raw) in enumerate(parts):
            dictionary = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            total = 0
            for a in range(0, len(data), langid.BLOCK_BYTES):
                total += len(zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=dictionary, write_content_size=False, write_dict_id=False).compress(data[a : a + langid.BLOCK_BYTES]))
            sizes.append((total, order, lang))
        (least, _, lang), (after, _, _) = sorted(sizes)[:2]
        assert r["lang_pred"] == lang and abs(r["score"] - min(1.0, 5 * (after - least) / after)) < 1e-9
        right += lang == d[2]
    assert right > 0.98 * len(docs[:-3])


def test_quality_queries(spark, tmp_path):
    """op3's verdicts by walking each tree alone, op5's scores by all pairs of features."""
    from docgrain.llm.common import read
    from docgrain.llm.queries import op3_quality_rules, op5_quality_classifier

    docs, labels = small_tables(spark, tmp_path)
    table, marks = read(spark, str(tmp_path), "documents"), read(spark, str(tmp_path), "labels")
    forest = rules.fit(table, marks)
    got = {r["doc_id"]: r for r in op3_quality_rules(spark, str(tmp_path)).collect()}
    quality = {i: q for i, q, _ in labels}
    for d in docs:
        base, point = rules.statistics((d[1] or "").encode())
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        paths = []
        for feature, at, left, right, path in forest.trees:
            node = 0
            while feature[node] >= 0:
                node = left[node] if point[feature[node]] < at[node] else right[node]
            paths.append(path[node])
        score = 2 ** (-(sum(paths) / len(paths)) / rules.Forest.expected(forest.rows))
        r = got[d[0]]
        assert [r[c] for c in rules.BASE] == plain_statistics(d[1] or "") and r["base_failed"] == failed
        assert abs(r["score"] - score) < 1e-9 and r["kept"] == (not failed and score <= forest.threshold)
    judged = [(got[i]["kept"], q) for i, q in quality.items() if not got[i]["base_failed"]]
    assert sum(k for k, q in judged if q) >= 0.98 * sum(q for _, q in judged) and sum(not k for k, q in judged if not q) >= 0.9 * sum(not q for _, q in judged)

    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    machine = fm.fit(table.where(~F.col("doc_id").isin(*[d[0] for d in docs if held(d[0])])), marks)
    got = {r["doc_id"]: r for r in op5_quality_classifier(spark, str(tmp_path)).collect()}
    for d in docs[::9] + docs[-3:]:
        index, value = fm.row((d[1] or "").encode(), d[4] or 0, fm.Slots(fm.BITS))
        pairs = sum(machine.v[a] @ machine.v[b] * x * y for n, (a, x) in enumerate(zip(index, value, strict=True)) for b, y in list(zip(index, value, strict=True))[:n])
        want = 1 / (1 + math.exp(-(machine.w0 + machine.w[index] @ value + pairs)))
        r = got[d[0]]
        assert abs(r["score"] - want) < 1e-6 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == held(d[0])
    right = [got[i]["predicted"] == q for i, q in quality.items() if held(i)]
    assert np.mean(right) > 0.9


# Packing


def test_best_fit():
    for _ in range(200):
        sizes = np.array([rng.randrange(1, 60) for _ in range(rng.randrange(1, 60))])
        bins, offsets = packing.best_fit(sizes, 64)
        free = {}
        for s, b, o in zip(sizes.tolist(), bins.tolist(), offsets.tolist(), strict=True):
            fits = [(f, k) for k, f in free.items() if f >= s]
            assert (b in free) == bool(fits) and (not fits or free[b] == min(fits)[0])
            assert o == 64 - free.get(b, 64)
            free[b] = free.get(b, 64) - s


def test_ids_equal_the_tokenizer(spark):
    P = pytest.importorskip("public_tokenizers")
    import pyarrow as pa

    ids = packing.Ids(P.path("word_bpe_49k.json"))
    texts = ["It's <|endoftext|> x", "İstanbul ΟΔΟΣ", "a\xa0b\x85c\x1cd", "don't WE'LL 'street ..'s''re", "１２３ 12a3 ½ ²", "“q” – x’s €5", "中文 テ", "", " \t\n", "x" * 5000]
    texts += ["".join(chr(rng.choice([rng.randrange(0, 0x250), rng.randrange(0x2000, 0x2070), 32, 39, 115])) for _ in range(40)) for _ in range(500)]
    for text, got in zip(texts, ids(pa.array(texts)), strict=True):
        assert got.tolist() == ids.whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing_round_trip(spark):
    sizes = [rng.choice([1, 7, 500, 2100, 4000, 4096]) for _ in range(700)]
    items = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "row long, length long")
    rows = packing.pack(items, group_items=100).collect()
    assert sorted((r["row"], r["length"]) for r in rows) == list(enumerate(sizes))
    by = {}
    for r in rows:
        by.setdefault(r["bin"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 4096
    assert len(by) <= 1.05 * max(sum(sizes) / 4096, sum(s > 2048 for s in sizes))


# Near-duplicates


def plain_components(texts, k=2, percent=80):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate({i: i + 32 for i in range(65, 91)}))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    comp = list(range(len(texts)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                comp[b] = a
    return [(i, len(s), root(i)) for i, s in enumerate(sets)]


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL_BUCKET", 4)  # so that buckets of this size also go through blocks
    monkeypatch.setattr(neardup, "BLOCK", 16)
    texts = []
    for _ in range(6):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(20, 90))]
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randrange(len(w) // 5)):
                w[rng.randrange(len(w))] = f"v{rng.randrange(5000)}"
            texts.append(" ".join(w))
    texts += ["", " ", "one", "ONE", "one two", *(" ".join(f"u{rng.randrange(9999)}" for _ in range(40)) for _ in range(30)), texts[0], texts[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = neardup.near_duplicates(docs, rounds=1).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == plain_components(texts)


def test_bands_of_a_batch_equal_those_of_each_set():
    """Densification one bin and one try at a time."""
    own = np.random.default_rng(5)
    sets = [np.unique(own.integers(0, 2**64, n, np.uint64)) for n in (1, 2, 5, 40, 400, 3000)]
    got = neardup.bin_values(sets)
    for row, hashes in zip(got, sets, strict=True):
        least = {}
        for h in hashes.tolist():
            least.setdefault(h >> 57, h)
        for b in range(128):
            at, t = b, 0
            while at not in least:
                t += 1
                with np.errstate(over="ignore"):
                    at = int(neardup.mixed(np.array([b], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(t))[0]) >> 57
            assert int(row[b]) == least[at]
    assert (neardup.band_keys(sets)[2] == neardup.band_keys(sets[2:3])[0]).all()


def test_large_groups_over_several_tasks(spark, monkeypatch):
    """Copies and crowded buckets with more rows than a part; a doc_id of two texts links the groups of both."""
    from docgrain.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 7)
    own = random.Random(4)
    base = [f"w{own.randrange(900)}" for _ in range(60)]
    texts = [" ".join(base)] * 40 + [" ".join([*base[:i], "other", *base[i + 1 :]]) for i in range(50)] + ["quite different words here", "Quite different words here"]
    docs = spark.createDataFrame([*enumerate(texts), (200, texts[0]), (200, "alone in the text"), (201, "alone in the text")], "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(docs).collect())
    assert got == sorted([*((i, c) for i, _, c in plain_components(texts)), (200, 0), (200, 0), (201, 0)])


@pytest.mark.parametrize("n", [5, 20, 60, 200])
def test_few_pairs_at_the_threshold_share_no_band(n):
    """Pairs of a similarity of 0.8 or just above, by size of their sets."""
    own = np.random.default_rng(n)
    missed, pairs = 0, 2000
    left, right = [], []
    for _ in range(pairs):
        apart = max(1, int(n / 9))
        while 100 * n < 80 * (n + 2 * apart):  # n in common, `apart` more on each side
            apart -= 1
        pool = np.unique(own.integers(0, 2**64, n + 2 * max(apart, 0) + 8, np.uint64))
        pool = own.permutation(pool)
        left.append(np.sort(np.concatenate([pool[:n], pool[n : n + apart]])))
        right.append(np.sort(np.concatenate([pool[:n], pool[n + apart : n + 2 * apart]])))
    missed = int((~(neardup.band_keys(left) == neardup.band_keys(right)).any(axis=1)).sum())
    assert missed <= 2


def test_the_pipeline_links_by_five_words(spark):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline

    own = random.Random(8)
    texts = []
    for changes in (2, 4, 6, 8):
        base = [f"w{own.randrange(5000)}" for _ in range(100)]
        texts.append(" ".join(base))
        for _ in range(8):
            w = list(base)
            for at in own.sample(range(100), changes):
                w[at] = f"v{own.randrange(5000)}"
            texts.append(" ".join(w))
    texts += ["one two three", "One two three", "", texts[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    want = [i for i, _, comp in plain_components(texts, k=5) if i == comp]
    assert got == want and len(want) > sum(i == comp for i, _, comp in plain_components(texts))


def test_rare_rows_of_a_block_meet_all():
    import pandas as pd

    sets = [np.unique(np.array([rng.randrange(60) for _ in range(40)])) for _ in range(30)]
    frame = pd.DataFrame({"doc_id": range(30), "comp": [i // 3 for i in range(30)], "shingles": sets, "stray": False})
    both = pd.concat([frame, frame.iloc[10:].assign(stray=True)])
    got = {(s // 3, d) for s, d in neardup.block_links(both, 60).itertuples(index=False, name=None)}
    want = set()
    for d in range(10, 30):
        for s in range(30):
            common = len(np.intersect1d(sets[s], sets[d]))
            if s // 3 != d // 3 and 100 * common >= 60 * (len(sets[s]) + len(sets[d]) - common):
                want.add((s // 3, d))
    assert got == want


# Mixing


def repetition_cost(routed, words, passes=mixing.PASSES):
    total = 0.0
    for p, n in words.items():
        left = sum(v for (q, _), v in routed.items() if q == p)
        for k in range(passes):
            part = left if k == passes - 1 else min(left, n)
            total += k * part
            left -= part
    return total


def test_flow_meets_quotas_with_overlap():
    rows = {("ab", "a"): 60, ("ab", "b"): 60, ("a", "a"): 50, ("b", "b"): 10}
    got = mixing.flow({"ab": 60, "a": 50, "b": 10}, rows, {"a": 120, "b": 100})
    for s, want in (("a", 120), ("b", 100)):
        assert abs(sum(v for (_, t), v in got.items() if t == s) - want) < 1e-3
    assert all(v <= 2 * rows[c] + 1e-6 for c, v in got.items())


@pytest.mark.parametrize("seed", range(8))
def test_flow_costs_least(seed):
    """Against every whole-numbered routing of small networks."""
    own = random.Random(seed)
    words = {p: own.randrange(1, 3) for p in ("ab", "a", "b")}
    rows = {(p, s): words[p] * own.randrange(1, 3) for p in words for s in p}
    size = {s: sum(n for (_, t), n in rows.items() if t == s) for s in "ab"}
    quota = {s: own.randrange(0, 2 * size[s] + 1) for s in "ab"}
    best = math.inf
    cells = sorted(rows)
    for each in itertools.product(*(range(2 * rows[c] + 1) for c in cells)):
        routed = dict(zip(cells, each, strict=True))
        if all(sum(v for (_, t), v in routed.items() if t == s) == quota[s] for s in "ab"):
            best = min(best, repetition_cost(routed, words))
    got = mixing.flow(words, rows, quota)
    assert all(abs(sum(v for (_, t), v in got.items() if t == s) - quota[s]) < 1e-6 for s in "ab")
    assert all(v <= 2 * rows[c] + 1e-6 for c, v in got.items()) and abs(repetition_cost(got, words) - best) < 1e-6


def test_targets_fill_by_weight_up_to_twice_the_size():
    t = mixing.targets({"a": 10, "b": 100, "c": 1000}, {"a": 3, "b": 1, "c": 2}, 1665)
    assert t["a"] == 20 and t["b"] == 200 and abs(t["c"] - 1445) < 1e-6


def overlapping_rows():
    """Half of a's texts are in b too; c is alone."""
    own = random.Random(12)
    text = lambda: " ".join(f"w{own.randrange(10**9)}" for _ in range(own.randrange(1, 60)))
    both = [text() for _ in range(150)]
    parts = [("a", both), ("a", [text() for _ in range(150)]), ("b", both), ("b", [text() for _ in range(200)]), ("c", [text() for _ in range(300)]), (None, [text() for _ in range(20)]), ("a", ["hot words here"] * 1300), ("b", [None, "", "hot words here"])]
    return [(i, t, s) for i, (s, t) in enumerate((s, t) for s, texts in parts for t in texts)]


def test_overlapping_sources(spark):
    """Targets by source, at most twice a size, reruns agree; and what sources share is repeated less than by a water
    level, where each source takes its share of the seeded order for itself."""
    rows = overlapping_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.mix(mixing.overlapping(docs)).collect()
    assert len(got) == len(rows)
    size = {i: len((t or "").split()) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    taken = {r["doc_id"]: r["taken"] for r in got}
    assert all(r["size"] == size[r["doc_id"]] and r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)
    aims = {r["source"]: r["target"] for r in got}
    assert {s: sum(size[i] for i in size if source[i] == s) for s in aims} == {r["source"]: r["source_size"] for r in got}
    for s, aim in aims.items():
        assert abs(sum(t for i, t in taken.items() if source[i] == s) - aim) <= 4 * 60
    texts = {i: t for i, t, _ in rows}

    def repeated(times):
        by = {}
        for i, n in times.items():
            by[texts[i]] = by.get(texts[i], 0) + n
        return sum(max(0, n - 1) * len((t or "").split()) for t, n in by.items())

    flat = {r["doc_id"]: r["taken"] for r in mixing.mix(mixing.single(docs)).collect()}
    times = lambda t: {i: t[i] // size[i] if size[i] else 0 for i in size}
    assert taken != flat and repeated(times(taken)) < 0.97 * repeated(times(flat))
    again = mixing.mix(mixing.overlapping(docs)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_rare_patterns_count_to_their_own_source(spark):
    docs = spark.createDataFrame(overlapping_rows(), "doc_id long, text string, source string")
    got = mixing.mix(mixing.overlapping(docs), most_patterns=0).collect()
    assert all("," not in r["pattern"] for r in got)
    want = {r["source"]: r["target"] for r in mixing.mix(mixing.overlapping(docs)).collect()}
    assert {r["source"]: r["target"] for r in got} == want
    for s, aim in want.items():
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - aim) <= 120


def test_applied_mix_repeats_rows(spark):
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40)), rng.choice(["a", "b", "c", None]), "extra") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    mixed = mixing.mix(mixing.single(docs))
    want = {r["doc_id"]: r["taken"] for r in mixed.collect()}
    out = mixing.apply_mix(docs, mixed)
    assert out.columns == docs.columns
    words = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.sum(mixing.word_count("text")).alias("n")).collect()}
    assert all(words.get(i, 0) == t for i, t in want.items())


# Search


def plain_top_k(rows, k=10):
    """Exact integers, every pair; queries and candidates are rows."""
    fine = [(i, [math.floor(1024 * Fraction(v)) for v in x]) for i, x in rows if i is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)]
    out = []
    for a, (q, x) in enumerate(fine):
        if q % 100 == 0:
            scores = [(sum(m * n for m, n in zip(x, y, strict=False)), i) for b, (i, y) in enumerate(fine) if b != a]
            for rank, (s, i) in enumerate(sorted(scores, key=lambda c: (-c[0], c[1]))[:k]):
                out.append((q, rank + 1, i, max(-voronoi.LONG, min(voronoi.LONG, s))))
    return sorted(out)


def test_exact_top_k(spark):
    rows = [(i, [float(rng.choice([0.25, -0.5, 1.0, 0.0625])) for _ in range(6)]) for i in range(900)] + [(900 + i, [0.25] * 6) for i in range(300)]
    got = voronoi.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted(map(tuple, got)) == plain_top_k(rows)


def test_top_k_of_odd_vectors(spark):
    """Repeated ids, zeros, other lengths, huge and non-finite components, null ids and vectors."""
    own = random.Random(6)
    rows = [(i, [float(own.choice([0.0, 0.5, -0.5, 1.0])) for _ in range(4)]) for i in range(250)]
    rows += [(0, [1.0, 0.5, 0.5, 0.0]), rows[0], rows[100], (100, [1e16, 0.0, 0.0, 0.0]), (7, [2.0**60, -(2.0**60), 1.0, 0.0]), (300, [0.0] * 4), (400, [-(2.0**50)] * 4)]
    rows += [(500, [1.0]), (501, [1.0, 2.0, 0.5, 0.25, 8.0, 1.0]), (600, []), (None, [1.0] * 4), (8, None), (9, [None, 1.0, 1.0, 1.0]), (10, [float("nan")] * 4), (11, [float("inf"), 0.0, 0.0, 0.0])]
    got = voronoi.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)).collect()
    assert sorted(map(tuple, got)) == plain_top_k(rows)
    assert any(r["vec_id"] == 100 for r in got) and sum(r["query_id"] == 0 and r["rank"] == 1 for r in got) == 3


def test_bounds_spare_pairs_of_clustered_vectors(spark):
    g = np.random.default_rng(4)
    centres = g.normal(0, 1, (60, 64))
    x = (centres[np.arange(3000) % 60] + g.normal(0, 0.25, (3000, 64))) * g.choice([0.25, 1.0], (3000, 1))
    rows = [(int(i), [float(np.float32(v)) for v in r]) for i, r in zip(g.permutation(3000), x, strict=True)]
    report: dict = {}
    got = voronoi.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), report=report).collect()
    assert sorted(map(tuple, got)) == plain_top_k(rows)
    assert report["pairs"] == 30 * 3000 and report["visited"] < 0.5 * report["pairs"]


# Pages


def texts_of(pages):
    """The operator's steps on one host's pages, without Spark."""
    cut = [[(t.split(), s) for t, s in boilerplate.blocks(p)] for p in pages]
    return [boilerplate.decided(c, g)[0] for c, g in zip(cut, boilerplate.repeats([[b for b, _ in c] for c in cut]), strict=True)]


def alone(page):
    return texts_of([page])[0]


def test_main_text_of_marked_pages():
    page = """<!DOCTYPE html><head><title>t</title><style>p{}</style></head><body><header>site</header><nav><li>menu</nav>
    <main><header><h1>Head&shy;line</h1></header><p>One&nbsp; two<b>three</b><!-- no --><p>four<br>five <a href="a>b">six</a>
    <aside>side</aside><div class="cookie-notice">cookies</div><form>f<input></form><section id="comments"><p>first!</p></section>
    <script>if (a < b) { "</p>" }</script></p></main><footer>foot</footer></body>"""
    assert alone(page) == "Head\xadline One twothree four five six"


@pytest.mark.parametrize("wrapper", ['div class="has-sidebar"', 'div class="page header-fixed"', 'div class="layout sidebar"', 'div id="form"', "form"])
def test_layout_around_an_article_keeps_it(wrapper):
    page = f"<{wrapper}><nav>menu</nav><article><h1>Head</h1><p>one two</p></article></{wrapper.split()[0]}>"
    assert alone(page) == "Head one two"


def test_only_whole_names_are_set_apart_in_an_article():
    page = """<article><div class="side-by-side">a</div><section id="related-work">b</section><div class="site-header_bar share-buttons">c</div>
    <div class="comment-list"><article>reply</article></div><p>d</p></article><aside><article>teaser</article></aside><div class="related-posts"><article>more</article></div>"""
    assert alone(page) == "a b c d"
    assert alone(page.replace("site-header_bar ", "")) == "a b d"


def content(page):
    return " ".join(t for t, state in boilerplate.blocks(page) if state == boilerplate.CONTENT)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><p class="ad">Buy<p>Real text here.</article>', "Real text here."),
        ('<article><ul><li class="ad">x<ul><li>y</li></ul>z</li><li>real</ul></article>', "real"),
        ('<article><table><tr><td class="ad">q<td>w<tr><td>e</table><dl><dt class="ad">k<dd>v</dl></article>', "w e v"),
        ('<article><p class="ad">Buy<div>f</div>g</article>', "f g"),
        ('<article><p>One <span class="advert">Buy <span>now</span> this</span> two.</p></article>', "One two."),
        ('<article><p>x = 1 <span class="comment">// one</span> <em class="notice">mind</em></p></article>', "x = 1 // one mind"),
        ('<article>a<div class="ad-slot">x</div><div class="ad-unit">x</div><div class="comment-thread">c</div><div class="related-stories">r</div>b</article>', "a b"),
        ('<article>a<div hidden>h</div><div style="color:red; display: none">n</div><p style="visibility:hidden">v</p>b</article>', "a b"),
        ('<article><p class="hidden-gem">a<p title="a hidden thing">b<p data-hidden="1">c<p aria-hidden="true">d<section id="related-work">e</section></article>', "a b c d e"),
        ('<section class="more-stories"><article>teaser</article></section><article>story</article>', "story"),
        ('<article>story</article><div id="thread">first! second!</div>', "story"),
    ],
)
def test_what_is_set_apart_goes_and_nothing_else(page, text):
    assert content(page) == text


def plain_repeats(pages, share, depth):
    """Every stretch of marked tokens against every other page: of `depth` tokens, or a whole block."""
    distinct = sorted({tuple(tuple(b) for b in p) for p in pages})
    least = max(2, math.ceil(share * len(distinct) - 1e-9))
    marked = lambda p: [0, *(x for b in p for x in (*b, 0))]
    streams, out = [marked(p) for p in distinct], []
    holds = lambda part: sum(any(s[i : i + len(part)] == part for i in range(len(s) - len(part) + 1)) for s in streams)
    for p in pages:
        s = marked(p)
        gone = set()
        for a in range(len(s)):
            ends = [a + depth] if a + depth <= len(s) else []
            if s[a] == 0 and 0 in s[a + 1 :]:
                ends.append(s.index(0, a + 1) + 1)
            for b in ends:
                if holds(s[a:b]) >= least:
                    gone |= set(range(a, b))
        out.append([i in gone for i, t in enumerate(s) if t != 0])
    return out


@pytest.mark.parametrize("seed", range(6))
def test_repeats_equal_a_comparison_of_all_stretches(seed):
    own = random.Random(seed)
    word = lambda n: [own.choice("abcdefgh"[: 2 + seed]) for _ in range(n)]
    common = [word(own.randrange(1, 14)) for _ in range(4)]
    pages = [[own.choice(common) if own.random() < 0.4 else word(own.randrange(1, 12)) for _ in range(own.randrange(7))] for _ in range(9)]
    pages += [pages[0], []]
    got = boilerplate.repeats(pages, 0.25, 8)
    assert [g.tolist() for g in got] == plain_repeats(pages, 0.25, 8)


def test_shared_short_phrases_and_mirrored_pages_stay():
    body = lambda w: f"<p>it came {w} in the middle of the year and {w * 2} went</p><p>{w} said that {w * 3} would stay</p>"
    foot = "<div>All rights belong to their owners, see the terms</div>"
    pages = [body(w) + foot for w in ("one", "two", "six")]
    want = [" ".join(re.sub("<[^>]*>", " ", body(w)).split()) for w in ("one", "two", "six")]
    assert texts_of(pages) == want
    assert texts_of([*pages, pages[0]]) == [*want, want[0]]


def test_a_teaser_does_not_displace_the_story():
    pages = [f"<div><p>{'story %s ' % w * 20}</p></div><article>teaser {w}</article><div>menu of all pages</div>" for w in ("a", "b", "c")]
    assert texts_of(pages)[0] == " ".join(["story a"] * 20) + " teaser a"


def test_articles_keep_what_they_share():
    passage = " ".join(f"w{i}" for i in range(60))
    pages = [f"<nav>one menu</nav><article><p>{passage}</p><p>own {w}</p></article>" for w in "abcd"]
    assert texts_of(pages) == [f"{passage} own {w}" for w in "abcd"]


def test_nested_and_stray_tags_take_time_in_proportion():
    began = time.time()
    assert boilerplate.blocks("<div>" * 50_000 + "x" + "</section>" * 50_000) == [("x", boilerplate.OPEN)]
    assert time.time() - began < 2


def test_groups_of_a_large_host(spark, monkeypatch):
    monkeypatch.setattr(boilerplate, "PAGES", 16)
    rows = [(i, f"http://big.example/{i}" if i % 4 else f"https://small{i}.example:80/", f"<div>the same menu here</div><p>own words of {i}</p>") for i in range(200)]
    got = {r["page_id"]: r for r in boilerplate.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 200
    assert all(got[i]["text"] == ("" if i % 4 else "the same menu here ") + f"own words of {i}" for i in got)
    assert all(got[i]["n_by_repeats"] == (4 if i % 4 else 0) for i in got)


def shared_pages(seed, hosts, n):
    """Pages with blocks and passages that about a tenth of their host has, some of them copies of others."""
    own = random.Random(seed)
    words = lambda k: " ".join(own.choice("abcdefghijklmnop") + str(own.randrange(30)) for _ in range(k))
    rows = []
    for host in range(hosts):
        common = [(words(own.choice((3, 8, 45))), own.choice((0.06, 0.09, 0.1, 0.11, 0.12, 0.15, 0.9))) for _ in range(24)]
        sources = []
        for _ in range(n):
            parts = [f"{words(2)} {t} {words(1)}" if len(t) > 100 else t for t, often in common if own.random() < often]
            sources.append("".join(f"<div>{t}</div>" for t in [*parts, words(9)]) if sources and own.random() < 0.8 or not sources else own.choice(sources))
        rows += [(len(rows) + i, f"http://h{host}.example/{i}", s) for i, s in enumerate(sources)]
    rows += [rows[0], rows[0], (None, *rows[1][1:]), (7, "http://h0.example/null", None), (8, None, rows[2][2])]
    own.shuffle(rows)
    return rows


def counted_repeats(pages):
    """Stretches of the distinct pages of a whole host in one dictionary."""
    distinct = {tuple(tuple(b) for b in p) for p in pages}
    least = max(2, math.ceil(boilerplate.SHARE * len(distinct) - 1e-9))

    def stretches(page):
        s = [None, *(x for b in page for x in (*b, None))]
        marks = [i for i, t in enumerate(s) if t is None]
        return s, [(a, a + boilerplate.LONG) for a in range(len(s) - boilerplate.LONG + 1)] + [(a, b + 1) for a, b in itertools.pairwise(marks)]

    holders = Counter()
    for p in distinct:
        s, parts = stretches(p)
        holders.update({tuple(s[a:b]) for a, b in parts})
    out = []
    for p in pages:
        s, parts = stretches(p)
        gone = {i for a, b in parts if holders[tuple(s[a:b])] >= least for i in range(a, b)}
        out.append([i in gone for i, t in enumerate(s) if t is not None])
    return out


@pytest.mark.parametrize(("pages", "size"), [(1, 10**12), (7, 10**12), (64, 10**12), (10**9, 900), (10**9, 10**12)])
def test_hosts_of_any_number_of_groups_are_judged_as_one(spark, monkeypatch, pages, size):
    rows = shared_pages(3, 2, 100)
    want = []
    for host in ("h0", "h1", ""):
        held = [r for r in rows if (r[1] or "///").split("/")[2].removesuffix(".example") == host]
        cut = [[(t.split(), s) for t, s in boilerplate.blocks(r[2] or "")] for r in held]
        found = counted_repeats([[b for b, _ in c] for c in cut])
        want += [(*r[:2], *boilerplate.decided(c, np.array(g, bool))) for r, c, g in zip(held, cut, found, strict=True)]
    monkeypatch.setattr(boilerplate, "PAGES", pages)
    monkeypatch.setattr(boilerplate, "BYTES", size)
    got = boilerplate.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).drop("n_chars").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert sum(r["n_by_repeats"] for r in got) > 1000


def test_a_host_of_257_pages_is_judged_as_one_of_256(spark):
    # On 26 pages each, the least share of 257 (and of 256): a group of half the pages may have fewer than its tenth.
    lines = [f"line {k} of the section that shares it" for k in range(9)]
    rows = [(i, f"http://one.example/{i}", "".join(f"<div>{t}</div>" for k, t in enumerate(lines) if i // 26 == k) + f"<p>own words {i}</p>") for i in range(257)]
    for n in (256, 257):
        got = boilerplate.main_text(spark.createDataFrame(rows[:n], "page_id long, url string, html string")).collect()
        assert all(r["n_by_repeats"] == (8 if r["page_id"] < 234 else 0) for r in got) and len(got) == n
