"""Best-fit packing of token sequences, by hierarchical residual packing (operator 4).

Each document becomes ids (the tokenizer's, then an end id), cut into pieces of at most `room`
tokens only if it is longer. Pieces of full length are sequences of their own. The others are dealt
into groups of bounded size; each group packs best-fit, longest first, and emits its nearly full bins.
The underfull bins become the items of the next round, in fewer groups, and so on up the tree, until
one group held them all or a round joined nothing.

A group holds `group_items` items on average whatever the input, so no task grows with it. A piece's
row carries its bin and its offset there; a round moves a bin by moving its rows, found by a join.

Defined results: null or empty text is the end id alone; an empty table packs into nothing; rows that
repeat a doc_id are packed each on its own (they carry equal (doc_id, piece) labels); texts of any length are
encoded whole; of bins that fit equally well the one that was last changed takes a piece; columns of docs other than
doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrain.llm.common import slices, written

ROOM, END_ID, GROUP_ITEMS, NEARLY_FULL = 4096, 1, 20_000, 4080
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"
CACHED_PARTS, CACHED_BYTES, CHUNK_BYTES = 500_000, 64, 2_000_000
#: The letters and numbers among the characters of plain texts, lower case.
LETTERS, NUMBERS = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u017f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
#: The tokenizer's own rule for cutting lower-case text into parts: what this finds, and the letters between.
SIGNS = rf"('(?:s|t|re|ve|m|ll|d)|[{NUMBERS}]|[^\s\x0b\x{{85}}\x{{a0}}{LETTERS}{NUMBERS}]+)"
#: What keeps a text from being cut like this: characters that other normal forms, other letters or numbers,
#: or the tokenizer's special tokens may need, and those that Arrow alone takes for white space.
NOT_PLAIN = r"[^\x00-\x1b\x20-\x{12f}\x{131}-\x{17f}\x{2010}-\x{2027}\x{20a0}-\x{20bf}]|<\|"


class Ids:
    """Ids of texts. The tokenizer encodes each part of a text by itself, so a text's ids are those of its
    parts in a row; a bounded cache holds them. Arrow cuts and looks up; new parts go to the tokenizer. Other
    than plain texts go to the tokenizer whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole, self.by_part, self.parts = Tokenizer.from_file(path), Tokenizer.from_file(path), {}
        # Parts are lower case and cut already; joined by spaces, many are encoded in one call.
        self.by_part.normalizer = None
        self.by_part.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def raw(self, text: str) -> np.ndarray:
        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, "<u4")

    def learn(self, parts: list[str]) -> None:
        for a in range(0, len(parts), 2000):
            some = parts[a : a + 2000]
            found = self.by_part.encode(" ".join(some), add_special_tokens=False)
            ends = np.cumsum(np.bincount(found.word_ids, minlength=len(some))) * 4
            ids = array("I", found.ids).tobytes()
            if len(ends) != len(some):
                raise ValueError("the tokenizer cut a part")
            for part, x, y in zip(some, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                self.parts[part] = ids[x:y]

    def chunk(self, texts: pa.Array) -> list[np.ndarray]:
        plain = pc.invert(pc.match_substring_regex(texts, NOT_PLAIN))
        low = pc.utf8_lower(pc.if_else(plain, texts, ""))
        cut = pc.utf8_split_whitespace(pc.replace_substring_regex(low, SIGNS, r" \1 "))
        coded = pc.list_flatten(cut).dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.parts) > CACHED_PARTS:
            self.parts.clear()
        known = self.parts
        known[""] = b""
        self.learn([p for p in names if p not in known])
        each = [known[p] for p in names]
        for p in names:
            if len(p) > CACHED_BYTES:  # long parts are not kept beyond their chunk
                known.pop(p, None)
        sizes = np.fromiter(map(len, each), "i8", len(each)) // 4
        ids = np.frombuffer(b"".join(each), "<u4")
        codes = coded.indices.to_numpy(zero_copy_only=False)
        lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype("i4"), pa.array(ids))
        flat = pc.list_flatten(lists.take(pa.array(codes))).to_numpy(zero_copy_only=False)
        upto = np.concatenate([[0], np.cumsum(sizes[codes])])[np.concatenate([[0], np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False))])]
        return [flat[x:y] if ok else self.raw(t.as_py()) for x, y, ok, t in zip(upto[:-1], upto[1:], plain.to_pylist(), texts, strict=True)]

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, in chunks of texts of bounded size."""
        upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + CHUNK_BYTES, "right")))
            yield from self.chunk(texts.slice(a, b - a))
            a = b


_TOKENIZERS: dict[str, Ids] = {}


def tokenizer_ids(path: str) -> Ids:
    """One a worker and file."""
    return _TOKENIZERS.get(path) or _TOKENIZERS.setdefault(path, Ids(path))


def pieces(docs: DataFrame, tokenizer: str, room: int = ROOM, end_id: int = END_ID) -> DataFrame:
    """docs (doc_id, text) -> PIECES; row names the piece uniquely; write the result before it is used twice."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_cpu_count(1)  # a task has one core
        encode = tokenizer_ids(tokenizer)
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in slices(batches, 4000):
            texts = pc.fill_null(batch.column("text"), "")
            out: list[list] = [[], [], [], [], []]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(texts), strict=True):
                n = len(ids) + 1
                for k, at in enumerate(range(0, n, room)):
                    size = min(room, n - at)
                    crc = zlib.crc32(ids[at : at + size].tobytes())
                    crc = zlib.crc32(end, crc) if at + size == n else crc
                    for column, value in zip(out, (doc, k, at, size, crc), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=list(names))

    found = docs.select("doc_id", "text").mapInArrow(cut, PIECES.rpartition(",")[0])
    return found.withColumn("row", F.monotonically_increasing_id())


def best_fit(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, taken in the given order; the fullest bin with room takes it.

    Bins are listed by free room; one integer has a bit for each room that some bin has, so the
    tightest bin is its lowest bit from the item's size on.
    """
    bins, offsets = np.empty(len(sizes), "i8"), np.empty(len(sizes), "i8")
    free: list[list[int]] = [[] for _ in range(room + 1)]
    open_, n = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if fits := open_ >> size:
            left = size + (fits & -fits).bit_length() - 1
            b = free[left].pop()
            if not free[left]:
                open_ ^= 1 << left
        else:
            left, b, n = room, n, n + 1
        bins[i], offsets[i] = b, room - left
        if left > size:
            free[left - size].append(b)
            open_ |= 1 << (left - size)
    return bins, offsets


def pack(items: DataFrame, room: int = ROOM, group_items: int = GROUP_ITEMS, nearly_full: int = NEARLY_FULL) -> DataFrame:
    """items (row, length, ...) -> the same with bin long and offset long."""
    whole = items.where(F.col("length") >= room).withColumns({"bin": F.col("row"), "offset": F.lit(0).cast("long")})
    # Every part is a bin of its own at first; fill is its length.
    open_ = items.where(F.col("length") < room).withColumns({"bin": F.col("row"), "offset": F.lit(0).cast("long"), "fill": F.col("length")})
    done, before, last = [whole], None, False
    for step in range(64):
        bins = open_.where(F.col("offset") == 0).select("bin", "fill")
        n = bins.count()
        if not n or last or n == before:
            break
        groups = -(-n // group_items)
        last, before = groups == 1, n

        def local(frame: pd.DataFrame, step=step) -> pd.DataFrame:
            frame = frame.sort_values(["fill", "bin"], ascending=[False, True], kind="stable")
            sizes = frame["fill"].to_numpy()
            to, shift = best_fit(sizes, room)
            names = frame["bin"].to_numpy()
            first = names[np.flatnonzero(shift == 0)]  # bins open in number order, each by its first item
            filled = np.bincount(to, weights=sizes).astype("i8")
            return pd.DataFrame({"bin": names, "into": first[to], "shift": shift, "filled": filled[to]})

        dealt = bins.withColumn("g", F.pmod(F.xxhash64("bin", F.lit(step)), F.lit(groups)))
        moves = dealt.groupBy("g").applyInPandas(lambda frame: local(frame[["bin", "fill"]]), "bin long, into long, shift long, filled long")
        moved = written(
            open_.join(moves, "bin").select(*[c for c in items.columns], F.col("into").alias("bin"), (F.col("offset") + F.col("shift")).alias("offset"), F.col("filled").alias("fill")),
            f"packing-{step}",
        )
        done.append(moved.where(F.col("fill") >= nearly_full).drop("fill"))
        open_ = moved.where(F.col("fill") < nearly_full)
    done.append(open_.drop("fill"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
