"""Cost-balanced packing against its plain rule and an exact round trip."""

import random
import zlib

import numpy as np
import pytest

pytest.importorskip("docgrain.llm.queries")
import public_tokenizers
from docgrain.llm import balance
from docgrain.llm.queries import QUERIES
from tokenizers import Tokenizer


def plain_balanced(lengths, room, width):
    """The rule as it is written, looking at every sequence for every piece."""
    free = balance.rooms(sum(lengths), room)
    size, spent, queue, out = list(free), [0.0] * len(free), sorted((-n, i, 0) for i, n in enumerate(lengths) if n), []
    while queue:
        n, i, at = queue.pop(0)
        n = -n
        fits = [(spent[b], b) for b in range(len(free)) if free[b] >= n] or [(spent[b], b) for b in range(len(free)) if free[b]]
        b = min(fits)[1]
        head = min(n, free[b])
        out.append((i, at, head, b, size[b] - free[b]))
        free[b] -= head
        spent[b] += balance.cost(head, width)
        if head < n:
            queue = sorted([*queue, (head - n, i, at + head)])
    return out, spent


@pytest.mark.parametrize("seed", range(60))
def test_balanced_equals_the_plain_rule(seed):
    rng = random.Random(seed)
    room = rng.choice([8, 32, 64])
    lengths = [rng.randrange(1, room) for _ in range(rng.randrange(0, 60))]
    if seed % 3 == 0:
        lengths = [rng.choice([1, 3, room - 1]) for _ in range(rng.randrange(0, 60))]
    assert balance.balanced(lengths, room, 4) == plain_balanced(lengths, room, 4)


def test_rooms_hold_all_tokens_and_need_no_padding():
    for tokens in range(0, 200):
        sizes = balance.rooms(tokens, 32)
        assert sum(sizes) == tokens and all(n == 32 or n & (n - 1) == 0 for n in sizes)


def test_costs_come_out_even():
    """Against the same pieces laid end to end in a random order."""
    rng = random.Random(1)
    lengths = [rng.randrange(1, 900) for _ in range(6000)]
    parts, spent = balance.balanced(lengths)
    full = [c for c, room in zip(spent, balance.rooms(sum(lengths)), strict=True) if room == balance.ROOM]
    laid, at = [0.0] * (len(full) + 1), 0
    for n in lengths:
        head = min(n, balance.ROOM - at % balance.ROOM)
        laid[at // balance.ROOM] += balance.cost(head)
        if head < n:
            laid[at // balance.ROOM + 1] += balance.cost(n - head)
        at += n
    assert np.std(full) < 0.25 * np.std(laid[:-1])
    assert len(parts) - len(lengths) < len(full)  # less than a cut a sequence


TEXTS = ["", None, "one", "two words", "long " * 5000, "x" * 9000, *(f"text number {i} " * (i % 97) for i in range(400)), "two words", "two words"]


@pytest.mark.parametrize("group_tokens", [balance.GROUP_TOKENS, 9_000])
def test_round_trip(spark, group_tokens):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id here")], "doc_id long, text string").repartition(3)
    from docgrain.llm.common import written

    rows = balance.pack(written(balance.pieces(docs, path), "test-balance"), group_tokens=group_tokens).collect()
    own = Tokenizer.from_file(path)
    ids = {i: np.asarray([*own.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in [*enumerate(TEXTS), (None, "no id here")]}
    parts, sequences = {}, {}
    for r in rows:
        parts.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert set(parts) == set(ids)
    for doc, found in parts.items():
        at = 0
        for r in sorted(found, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[doc])
            assert r["ids_crc32"] == zlib.crc32(ids[doc][at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids[doc])
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 2048 or at & (at - 1) == 0 and at < 2048
        assert sum(balance.cost(r["length"]) for r in found) == pytest.approx(found[0]["sequence_cost"])


def test_repeated_ids_are_packed_each_on_their_own(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the same words", "x")] * 50 + [(2, None, "x")] * 50, "doc_id long, text string, length string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op12_cost_packing"](spark, str(tmp_path)).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 1) == 50 * 4 and sum(r["length"] for r in rows if r["doc_id"] == 2) == 50
