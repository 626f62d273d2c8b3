"""Cost-balanced packing of token sequences (operator 12).

A sequence costs its tokens (the linear layers) and, of each piece in it, the square of its tokens (attention stays inside a
piece): `n + n * n / (6 * width)` for a piece of n tokens in a model of `width` units. Pieces go, the costliest first, each into the
sequence of least cost that still has room for it, so dear pieces are spread and cheap ones fill what is left.

Documents longer than a sequence are cut at its length first; such full pieces are sequences of their own and take no further
part. The other pieces are dealt by hash into groups of about GROUP_TOKENS tokens, whatever the input, and each group is packed by
itself: into as many full sequences as its tokens fill, and for the rest into sequences of powers of two, which need no padding. Room and tokens
are then equal, so in the end nothing is padded. A piece that fits nowhere whole is cut: its head fills the sequence of least
cost that has any room, its tail goes back among the pieces, in its place by cost.

Ids travel with their piece as bytes, for a cut needs its own check sum; full pieces travel without them.

Defined results: null or empty text is the end id alone; an empty table packs into nothing; rows that repeat a doc_id are packed each
on its own; texts of any length are encoded whole; pieces of equal cost go in the order of their rows, of sequences of
equal cost the one opened first is taken; columns of docs other than doc_id and text are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrain.llm.common import slices, written
from docgrain.llm.packing import END_ID, tokenizer_ids

ROOM, WIDTH, GROUP_TOKENS = 2048, 1024, 4_000_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_cost double"


def cost(tokens: int, width: int = WIDTH) -> float:
    """Of a piece, in units of the linear cost of one token."""
    return tokens + tokens * tokens / (6 * width)


def pieces(docs: DataFrame, tokenizer: str, room: int = ROOM, end_id: int = END_ID) -> DataFrame:
    """docs (doc_id, text) -> PIECES and `row`, which names the piece; ids is null in pieces of full length. Write the result
    before it is used twice."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_cpu_count(1)  # a task has one core
        encode, end = tokenizer_ids(tokenizer), end_id.to_bytes(4, "little")
        for batch in slices(batches, 2000):
            out: list[list] = [[], [], [], [], [], []]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(pc.fill_null(batch.column("text"), "")), strict=True):
                raw = ids.tobytes() + end
                n = len(raw) // 4
                for at in range(0, n, room):
                    part = raw[4 * at : 4 * (at + room)]
                    size = len(part) // 4
                    for column, value in zip(out, (doc, at, size, zlib.crc32(part), n, None if size == room else part), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=list(names))

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES).withColumn("row", F.monotonically_increasing_id())


def rooms(tokens: int, room: int = ROOM) -> list[int]:
    """Sequences that hold just so many tokens: full ones, then powers of two, the largest first."""
    return [room] * (tokens // room) + [1 << b for b in reversed(range(room.bit_length())) if tokens % room >> b & 1]


def balanced(lengths: list[int], room: int = ROOM, width: int = WIDTH) -> tuple[list[tuple[int, int, int, int, int]], list[float]]:
    """(item, start in the item, length, sequence, offset) of each placed part of items shorter than `room`, and each sequence's cost.

    Sequences with room for the piece in hand are in a heap by cost. One that comes up without it waits in the list of its
    room, where the pieces, ever shorter, reach it again; `partly` has those that wait by cost, for the cuts.
    """
    free = rooms(sum(lengths), room)
    capacity, spent = list(free), [0.0] * len(free)
    ready: list[tuple[float, int]] = []
    waiting: list[list[int]] = [[] for _ in range(room + 1)]
    partly: list[tuple[float, int]] = []
    queue = [(-n, i, 0) for i, n in enumerate(lengths) if n]
    heapq.heapify(queue)
    out = []

    def wait(b: int) -> None:
        if free[b]:
            waiting[free[b]].append(b)
            heapq.heappush(partly, (spent[b], b))

    def place(i: int, at: int, n: int, b: int) -> None:
        out.append((i, at, n, b, capacity[b] - free[b]))
        free[b] -= n
        spent[b] += cost(n, width)

    for b in range(len(free)):
        wait(b)
    reached = room + 1
    while queue:
        n, i, at = heapq.heappop(queue)
        n = -n
        while reached > n:  # sequences whose room is now enough
            reached -= 1
            for b in waiting[reached]:
                if free[b] == reached:
                    heapq.heappush(ready, (spent[b], b))
            waiting[reached].clear()
        while ready and free[ready[0][1]] < n:
            wait(heapq.heappop(ready)[1])
        if ready:
            b = heapq.heappop(ready)[1]
            place(i, at, n, b)
            heapq.heappush(ready, (spent[b], b)) if free[b] >= n else wait(b)
            continue
        while True:  # nothing holds it whole: all sequences with room wait, the cheapest takes the head
            c, b = heapq.heappop(partly)
            if free[b] and c == spent[b]:
                break
        head = free[b]
        place(i, at, head, b)
        heapq.heappush(queue, (head - n, i, at + head))
    return out, spent


def packed(frame: pd.DataFrame, group: int, room: int = ROOM, width: int = WIDTH) -> pd.DataFrame:
    """The pieces of one group, placed; sequences are numbered within the group, above its own number."""
    frame = frame.sort_values("row", kind="stable")
    parts, spent = balanced(frame["length"].tolist(), room, width)
    docs, starts, whole, crcs, totals, raws = (frame[c].tolist() for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"))
    rows = []
    for i, at, n, b, offset in parts:
        crc = crcs[i] if n == whole[i] else zlib.crc32(memoryview(raws[i])[4 * at : 4 * (at + n)])
        rows.append((docs[i], starts[i] + at, n, crc, totals[i], (group << 32) + b, offset, spent[b]))
    out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_cost"])
    return out.astype({"doc_id": "Int64"})


def pack(items: DataFrame, room: int = ROOM, width: int = WIDTH, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """items (a written table of `pieces`) -> PLACED; sequence_id is negative for pieces of full length."""
    whole = items.where(F.col("length") == room)
    whole = whole.withColumns({"sequence_id": -1 - F.col("row"), "offset": F.lit(0).cast("long"), "sequence_cost": F.lit(cost(room, width))})
    rest = items.where(F.col("length") < room)
    groups = max(1, -(-(rest.agg(F.sum("length")).first()[0] or 0) // group_tokens))

    def local(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return packed(frame, int(key[0]), room, width)

    dealt = rest.withColumn("g", F.pmod(F.xxhash64("row"), F.lit(groups)))
    names = [c.split()[0] for c in PLACED.split(", ")]
    return whole.select(*names).unionByName(dealt.groupBy("g").applyInPandas(local, PLACED))


def packing(docs: DataFrame, tokenizer: str, room: int = ROOM, width: int = WIDTH) -> DataFrame:
    return pack(written(pieces(docs, tokenizer, room), "balance-pieces"), room, width)
