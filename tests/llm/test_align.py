"""The alignment against tokenizers called on whole texts and a comparison of all tokens with all."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

pytest.importorskip("docgrain.llm.queries")
import public_tokenizers
import sentencepiece
from docgrain.llm import align
from docgrain.llm.common import written
from docgrain.llm.queries import QUERIES
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WHOLE_A, WHOLE_B = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
WHOLE_A.encode_special_tokens = True
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
PAIR = align.Pair(A, B, RANKS)


def plain_tokens(text):
    a, b = WHOLE_A.encode(" " + text, add_special_tokens=False).ids, WHOLE_B.encode(text)
    raw = (" " + text).encode()
    if not text or b"".join(PAIR.a_bytes[i] for i in a) != raw or b"".join(PAIR.b_bytes[i] for i in b) != raw:
        return [], []
    return a, b


def spans(sizes):
    out, at = [], 0
    for n in sizes:
        out.append((at, at + n))
        at += n
    return out


def plain_alignment(a, b, a_sizes, b_sizes):
    """Groups by the common ends; links by comparing every range with every other."""
    x, y = spans(a_sizes), spans(b_sizes)
    both = sorted({e for _, e in x} & {e for _, e in y})
    groups = [([i for i, (_, e) in zip(a, x, strict=True) if p < e <= q], [i for i, (_, e) in zip(b, y, strict=True) if p < e <= q]) for p, q in zip([0, *both], both, strict=False)]
    links = [(i, j) for i, (p, q) in zip(a, x, strict=True) for j, (r, s) in zip(b, y, strict=True) if p < s and r < q]
    return [",".join(map(str, u)) + "|" + ",".join(map(str, v)) for u, v in groups], links


@pytest.mark.parametrize("seed", range(300))
def test_the_walk_equals_all_against_all(seed):
    rng = random.Random(seed)
    total = rng.randrange(1, 90)
    ends = sorted({total, *(rng.randrange(1, total + 1) for _ in range(rng.randrange(40)))})
    other = sorted({total, *(e for e in ends if rng.random() < rng.choice([0.2, 0.9, 1.0])), *(rng.randrange(1, total + 1) for _ in range(rng.randrange(6)))})
    import numpy as np

    sizes = [np.diff([0, *e]) for e in (ends, other)]
    a, b = np.arange(len(ends)), np.arange(len(other))
    names, groups, x, y = align.align(a, b, *sizes, (align.id_names(len(a), "|"), align.id_names(len(b), ";")))
    want = plain_alignment(a.tolist(), b.tolist(), sizes[0].tolist(), sizes[1].tolist())
    assert names.decode() == ";".join(want[0]) and groups == len(want[0]) and sorted(zip(x.tolist(), y.tolist(), strict=True)) == sorted(want[1])


PIECES = [" ", "\n", "\t", "\r\n", "  ", " ", " ", "\x1c", "\x85", "'s", "the", " The", "é", "ü", "日本", "\U0001f600", "½", "ﬁ", "▁", "<s>", "<|endoftext|>", "<0x0A>", "12", "3.5", "é", "...", "\x00", "​", "ſ", "xyz", "a b"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PIECES) | st.text(max_size=3), max_size=14).map("".join))
def test_ids_equal_those_of_the_whole_text(text):
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    ((a, b),) = PAIR([text])
    assert (a.tolist(), b.tolist()) == plain_tokens(text), text


def test_parts_are_the_whole_text_and_long_ones_are_not_kept():
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcé\t\x1c　") for _ in range(rng.randrange(1, 9))) for _ in range(2000)) + "x" * 50_000
    assert "".join(align.parts_of(text)) == " " + text
    ((a, b),) = PAIR([text])
    assert (a.tolist(), b.tolist()) == plain_tokens(text)
    assert all(len(p) <= align.CACHED_CHARS for p in PAIR.of_a)


def test_plain_texts_are_cut_as_others():
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice(["ab", "é", " ", "\n", ".", "\t", "x y", "a\nb"]) for _ in range(rng.randrange(1, 12)))
        assert align.parts_of(text) == align.PARTS.findall(" " + text)


def test_ranks_give_the_same_ids():
    """Many Latin parts in a row, by ranks and without."""
    rng = random.Random(6)
    signs = [chr(c) for c in range(33, 0x250) if not chr(c).isspace()]
    text = " ".join("".join(rng.choice(signs) if rng.random() < 0.3 else rng.choice("etaoinsrhldü'") for _ in range(rng.randrange(1, 12))) for _ in range(20_000))
    (found,), (plain,) = align.Pair(A, B, RANKS)([text]), align.Pair(A, B)([text])
    assert [x.tolist() for x in found] == [x.tolist() for x in plain] == list(plain_tokens(text))


def plain_query(rows):
    found, counts = [], Counter()
    for doc, text in rows:
        a, b = plain_tokens(text or "")
        names, links = plain_alignment(a, b, [len(PAIR.a_bytes[i]) for i in a], [len(PAIR.b_bytes[i]) for i in b])
        found.append((doc, a, b, names, links))
        counts.update(set(links))
    most = defaultdict(int)
    for (i, _), n in counts.items():
        most[i] = max(most[i], n)
    return [
        (doc, len(a), len(b), len(names), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(names).encode()).hexdigest() if names else "")
        for doc, a, b, names, links in found
    ]


def small_texts():
    rng = random.Random(5)
    words = ["tionally", "Straße", "über", "niño", "the", "of", "unhappiness", "2024", "12345", "e.g.", "naïve", "日本語", "🙂", "re-entry", "x" * 30]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(80)]
    return [*enumerate(texts), (100, None), (101, ""), (102, " "), (103, "a▁b"), (104, "<s> <|endoftext|>"), (None, texts[0]), (0, texts[0]), *((200 + i, texts[1]) for i in range(40))]


@pytest.mark.parametrize("hot", [align.HOT, 1, 40])
def test_alignment_equals_a_plain_run(spark, hot):
    rows = small_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = align.scored(written(align.aligned(docs, A, B, RANKS), "test-align"), hot).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(plain_query(rows), key=key)


def test_query_with_clashing_columns(spark, tmp_path):
    rows = small_texts()[:20]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_a", "'x' AS pair", "2 AS row", "3 AS docs")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op13_token_alignment"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(plain_query(rows))
