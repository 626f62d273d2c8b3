"""The pipeline stage by stage, each against a plain run over what the stage before kept."""

import random
import re
from collections import Counter

import pytest

pytest.importorskip("docgrain.llm.queries")
import corpus_pipeline
import public_tokenizers
from docgrain.llm import mixing, rules
from test_brute_force import plain_base, plain_components, plain_statistics
from tokenizers import Tokenizer

ROOM = 4096


def corpus(own):
    """Good and bad documents of three sources, exact and near copies, personal data."""
    vocabulary = [f"{a}{b}" for a in ("haus", "wort", "tree", "river", "maison", "niño") for b in range(60)]
    texts = []
    for i in range(150):
        words = [own.choice(vocabulary) for _ in range(own.randrange(60, 260))]
        if i % 7 == 0:
            words[5:5] = ["write", "to", f"jo{i}.doe@mail.example.com", "or", "10.0.0.7", "or", "+1 (555) 555-0199", "today"]
        text = " ".join(words)
        if i % 10 == 3:
            text = " | ".join(words[:70]) + " #$%" * 40
        if i % 10 == 6:
            text = " ".join(words[:30])  # too short
        texts.append(text)
    texts += texts[:20] + [" ".join([*t.split()[:-1], "other"]) for t in texts[20:40]] + [None, "", " \n"]
    docs = [(i, t, own.choice(["de", "en"]), own.choice(["a", "b", "b", "c", None]), len(t or "")) for i, t in enumerate(texts)]
    return docs, [(d[0], int(d[0] % 10 not in (3, 6)), 0) for d in docs[:120]]


def best_fit_decreasing(sizes):
    left = []
    for n in sorted(sizes, reverse=True):
        fits = [b for b in range(len(left)) if left[b] >= n]
        if fits:
            left[min(fits, key=lambda b: left[b])] -= n
        else:
            left.append(ROOM - n)
    return len(left)


def test_the_chain(spark, tmp_path):
    docs, labels = corpus(random.Random(12))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        found[name] = stage(spark, rows, str(tmp_path))
        found[name].write.parquet(f"{tmp_path}/stage-{name}")
        found[name] = rows = spark.read.parquet(f"{tmp_path}/stage-{name}")
    taken = {name: [tuple(r) for r in df.collect()] for name, df in found.items()}
    texts = {d[0]: d[1] or "" for d in docs}

    # Rules: base rules by hand; the forest, fitted once more on the same rows, by its own verdict on each text alone.
    forest = rules.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    stats = {i: plain_statistics(t) for i, t in texts.items()}
    base = {i for i, s in stats.items() if s[0] >= 50 and 100 * s[4] <= 50 * s[0]}
    kept = [i for i in texts if i in base and rules.verdicts([texts[i].encode()], forest)[3][0]]
    assert sorted(r[0] for r in taken["quality_rules"]) == kept and len(kept) > 100
    assert not {i for i in kept if i % 10 == 3 and i < 150}  # the symbol-ridden ones

    # Near-duplicates: five words, one of each group.
    classes = plain_components([texts[i] for i in kept], 5)
    one = [kept[i] for i, _, root in classes if i == root]
    assert sorted(r[0] for r in taken["near_duplicates"]) == one and len(one) < len(kept) - 10

    # Personal data: what the patterns find goes, all else stays.
    for r in taken["personal_data"]:
        spans = plain_base(texts[r[0]])
        if not re.search(r"[@+]|[0-9][^A-Za-z]*[0-9]", texts[r[0]]):
            assert r[1] == texts[r[0]]
        assert all(texts[r[0]][a:b] not in r[1] for _, a, b in spans)
        assert sum(r[1].count(f"<{k}>") for k in ("email", "ip", "card", "phone")) >= len(spans) - 1 and len(r[1]) == r[4]
    assert sorted(r[0] for r in taken["personal_data"]) == one
    assert sum(bool(plain_base(texts[i])) for i in one) > 10

    # Mixing: each source near its target, no document more than twice.
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) for r in taken["personal_data"]}
    source = {r[0]: r[3] for r in taken["personal_data"]}
    sizes, times = Counter(), Counter(r[0] for r in taken["source_mixing"])
    for i, n in size.items():
        sizes[source[i]] += n
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = mixing.targets(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, 1.5 * sum(sizes.values()))
    got = Counter()
    for i, n in times.items():
        got[source[i]] += n * size[i]
    assert set(times) <= set(size) and max(times.values()) <= 2
    assert all(abs(got[s] - want[s]) <= 2 * max(size.values()) for s in sizes)
    text_of = {r[0]: r[1] for r in taken["personal_data"]}
    assert all(r[1] == text_of[r[0]] for r in taken["source_mixing"])

    # Packing: all tokens of all rows, gapless, in no more sequences than one best-fit pass over everything takes.
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = {i: len(own.encode(t, add_special_tokens=False).ids) + 1 for i, t in text_of.items()}
    held, sequences = Counter(), {}
    for doc, piece, start, length, _, sequence, offset in taken["best_fit_packing"]:
        held[doc] += length
        sequences.setdefault(sequence, []).append((offset, length))
        assert start == piece * ROOM
    assert held == {i: n * tokens[i] for i, n in times.items()}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= ROOM
    assert len(sequences) <= best_fit_decreasing([tokens[i] for i, n in times.items() for _ in range(n)])
