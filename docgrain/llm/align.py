"""Cross-tokenizer alignment by diagonal run skipping (operator 13).

Two tokenizers cut the same bytes; a byte offset where tokens of both end closes a group. The two lists of token ends
are walked together. The walk is at a shift, the difference of the two places; while it holds, tokens agree one to one,
so stretches of the lists are compared at this shift, twice as long each time, and jumped as a whole; when one differs, halves of it
find the last token that agrees. There an irregular group begins: the side that is behind takes tokens until both ends
meet, each step a link between the two tokens in hand, and the shift becomes what it is behind the group.

Links are counted by id pair, once a document, over the whole table. Documents carry their distinct pairs as two arrays.
Pairs with more than the HOT-th part of all (document, pair) entries are fewer than HOT, so they are broadcast;
all others are joined, and no key of that join has more than its HOT-th part of the entries.

Neither tokenizer joins a character other than white space to a following space or newline, which is checked for the
vocabulary of B; so the parts of a text between such places are encoded by themselves, once, and kept in a bounded cache.

Defined results: a text that is null, empty, or not the same bytes after either tokenizer has no tokens: its numbers are zero and
the hash column is ''; rows that repeat a doc_id are documents of their own, and counted so; texts of any length are
encoded whole; an id pair that ties for the highest count of its A id is best too; special tokens in texts are plain text; columns of
docs other than doc_id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrain.llm.common import by_bytes, written

ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
HOT, CACHED, CACHED_CHARS, BATCH_BYTES = 1 << 19, 150_000, 64, 2_000_000
SPACE = "▁"
#: Parts of a text: a new one begins at a space or newline behind another character than white space.
PARTS = re.compile(r"\s*\S+(?:[^\S \n]\s*\S+)*(?:[^\S \n]\s*)?|\s+")
#: White space that makes no part begin, runs of white space, and what would be taken for the mark of a cut.
NOT_PLAIN = re.compile(r"[^\S \n]|[ \n][ \n]|\x00")
#: Behind the Latin letters, of which all rules for letters and numbers hold alike.
LATIN_END = "\u0250"


def byte_names() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if it can be seen, else the next one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(hidden)}


def parts_of(text: str) -> list[str]:
    """The parts of space + text."""
    text = f" {text}"
    if NOT_PLAIN.search(text):
        return PARTS.findall(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")[1:]


class Pair:
    """Ids of texts by both tokenizers, and the bytes of each id. a_ranks: a file of the vocabulary of A as ranks, and the pattern that
    cuts texts before its merges; Latin texts are then encoded by these, to the same ids."""

    def __init__(self, a_path: str, b_path: str, a_ranks: tuple[str, str] | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        names = byte_names()
        self.a_bytes = [bytes(names[c] for c in t) if t is not None and all(c in names for c in t) else b"" for t in map(self.a.id_to_token, range(self.a.get_vocab_size()))]
        plain = [self.b.id_to_piece(i).replace(SPACE, " ") for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.encode() for i, p in enumerate(plain)]
        if any(re.search(r"\S[ \n]", p) for p in plain):
            raise ValueError("pieces of B run over the beginning of a word")
        self.a_sizes, self.b_sizes = (np.fromiter(map(len, t), "i8", len(t)) for t in (self.a_bytes, self.b_bytes))
        width = len(str(max(len(self.a_sizes), len(self.b_sizes)))) + 1
        self.names = id_names(len(self.a_sizes), "|", width), id_names(len(self.b_sizes), ";", width)
        self.ranked = None
        if a_ranks:
            import tiktoken

            lines = (line.split() for line in open(a_ranks[0], "rb"))
            self.ranked = tiktoken.Encoding("own", pat_str=a_ranks[1], mergeable_ranks={base64.b64decode(t): int(n) for t, n in lines}, special_tokens={})
        self.of_a: dict[str, bytes] = {}
        self.of_b: dict[str, bytes] = {}
        self.changed: set[str] = set()  # parts whose bytes a tokenizer changes

    def a_ids(self, text: str) -> list[int]:
        return self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def learn_each(self, parts: list[str]) -> None:
        """B puts a space before what it encodes: the part's own, or one that is taken off again."""
        coded_a = self.a.encode_batch_fast(parts, add_special_tokens=False)
        coded_b = self.b.encode([p[1:] if p[0] == " " else p for p in parts], num_threads=1)
        for part, a, b in zip(parts, coded_a, coded_b, strict=True):
            if part == " ":  # B has no ids for an empty text
                b = [self.b.piece_to_id(SPACE)]
            b = b if part[0] == " " else b[1:]
            self.of_a[part], self.of_b[part] = array("I", a.ids).tobytes(), array("I", b).tobytes()
            if not part.encode() == b"".join([self.a_bytes[i] for i in a.ids]) == b"".join([self.b_bytes[i] for i in b]):
                self.changed.add(part)

    def learn(self, parts: list[str]) -> None:
        """Many parts as one text, whose tokens are dealt to them by their bytes; those that may not stand in a row go by themselves."""
        row, other, single = [], [], []
        for p in parts:
            (single if p[-1].isspace() or SPACE in p else row if p.isascii() or max(p) < LATIN_END else other).append(p)
        coders = [(some, self.ranked.encode_ordinary if self.ranked and some is row else self.a_ids) for some in (row, other)]
        for some, a_ids in [([" a", *kind[k : k + 4000]], code) for kind, code in coders for k in range(0, len(kind), 4000)]:
            text = "".join(some)
            raw, ends = text.encode(), np.cumsum([len(p.encode()) for p in some])
            dealt = []
            for ids, known, sizes in (
                (a_ids(text), self.a_bytes, self.a_sizes),
                (self.b.encode(text[1:], num_threads=1), self.b_bytes, self.b_sizes),
            ):
                coded = np.asarray(ids, "<u4")
                upto = np.cumsum(sizes[coded])
                at = np.searchsorted(upto, ends)
                if b"".join([known[i] for i in ids]) == raw and (upto[at] == ends).all():
                    dealt.append((coded.tobytes(), (4 * (at + 1)).tolist()))
            if len(dealt) < 2:
                single += some[1:]
                continue
            for of, (ids, cuts) in zip((self.of_a, self.of_b), dealt, strict=True):
                for part, x, y in zip(some[1:], cuts, cuts[1:], strict=False):
                    of[part] = ids[x:y]
        for k in range(0, len(single), 4000):
            self.learn_each(single[k : k + 4000])

    def same(self, text: str, a: np.ndarray, b: np.ndarray) -> bool:
        return f" {text}".encode() == b"".join([self.a_bytes[i] for i in a]) == b"".join([self.b_bytes[i] for i in b])

    def __call__(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of space + text; none where either tokenizer changes its bytes."""
        cut = [parts_of(t) if t else [] for t in texts]
        if len(self.of_a) > CACHED:
            self.of_a.clear()
            self.of_b.clear()
            self.changed.clear()
        names = set().union(*cut)
        self.learn(list(names - self.of_a.keys()))
        for text, parts in zip(texts, cut, strict=True):
            a, b = (np.frombuffer(b"".join(map(of.__getitem__, parts)), "<u4") for of in (self.of_a, self.of_b))
            if text and (not self.changed or self.changed.isdisjoint(parts) or self.same(text, a, b)):
                yield a, b
            else:
                yield a[:0], b[:0]
        for p in names:
            if len(p) > CACHED_CHARS:  # long parts are not kept beyond their batch
                del self.of_a[p], self.of_b[p]
                self.changed.discard(p)


_PAIRS: dict[tuple, Pair] = {}


def walk(a: list[int], b: list[int]) -> tuple[list[int], list[int], list[int], list[int]]:
    """Two lists of token ends that end alike -> (A, B) places of linked tokens of which A's ends no group, and of which B's ends none.
    All other tokens end a group; those that end the same one are linked too."""
    behind_a: list[int] = []
    with_b: list[int] = []
    with_a: list[int] = []
    behind_b: list[int] = []
    i = j = 0
    n = len(a)
    while i < n:
        x, y = a[i], b[j]
        if x == y:  # a stretch at this shift: blocks twice as long each time, then their halves
            i, j, step = i + 1, j + 1, 2
            while i < n and a[i : i + step] == b[j : j + step]:
                i, j, step = i + step, j + step, step * 2
            while step > 1 and i < n:
                step >>= 1
                if a[i : i + step] == b[j : j + step]:
                    i, j = i + step, j + step
            continue  # the last block may reach beyond the end, which both lists have in common
        while x != y:  # an irregular group: the side that is behind goes on
            if x < y:
                behind_a.append(i)
                with_b.append(j)
                i += 1
                x = a[i]
            else:
                with_a.append(i)
                behind_b.append(j)
                j += 1
                y = b[j]
        i, j = i + 1, j + 1
    return behind_a, with_b, with_a, behind_b


def align(a_ids: np.ndarray, b_ids: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray, names: tuple[np.ndarray, np.ndarray]) -> tuple[bytes, int, np.ndarray, np.ndarray]:
    """The groups as text, how many they are, and the linked ids of each link. names: of both kinds of ids, those inside a
    group's list, then those at its end."""
    n, m = len(a_ids), len(b_ids)
    walked = walk(np.cumsum(a_sizes[a_ids]).tolist(), np.cumsum(b_sizes[b_ids]).tolist())
    behind_a, with_b, with_a, behind_b = (np.asarray(w, "i8") for w in walked)
    ends_a, ends_b = np.ones(n, bool), np.ones(m, bool)
    ends_a[behind_a] = ends_b[behind_b] = False
    to_a, to_b = np.flatnonzero(ends_a), np.flatnonzero(ends_b)
    # Behind the A ids of a group stand its B ids.
    out = np.empty(n + m, names[0].dtype)
    group_a, group_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
    out[np.arange(n) + np.concatenate([[0], to_b[:-1] + 1])[group_a]] = names[0][a_ids + len(a_sizes) * ends_a]
    out[np.arange(m) + to_a[group_b] + 1] = names[1][b_ids + len(b_sizes) * ends_b]
    links = (np.concatenate(x) for x in ((behind_a, with_a, to_a), (with_b, behind_b, to_b)))
    return out.tobytes().translate(None, b"\0")[:-1], len(to_a), *(ids[x] for ids, x in zip((a_ids, b_ids), links, strict=True))


def id_names(n: int, end: str, width: int = 12) -> np.ndarray:
    """As bytes of one width, filled up with zero bytes."""
    return np.asarray([f"{i}," for i in range(n)] + [f"{i}{end}" for i in range(n)], f"S{width}")


def aligned(docs: DataFrame, a_path: str, b_path: str, a_ranks: tuple[str, str] | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, ALIGNED and `row`; pairs are A id * 2^32 + B id, each once, and times how many links have it.
    Write the result before it is used twice."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = a_path, b_path, a_ranks
        encode = _PAIRS.get(key) or _PAIRS.setdefault(key, Pair(*key))
        none = np.empty(0, "i8")
        for batch in by_bytes(batches, BATCH_BYTES):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            numbers, hashes, pairs, times = [], [], [], []
            for a, b in encode(texts):
                if not len(a):
                    numbers.append((0, 0, 0, 0))
                    hashes.append("")
                    pairs.append(none)
                    times.append(none)
                    continue
                shown, groups, from_a, from_b = align(a, b, encode.a_sizes, encode.b_sizes, encode.names)
                kinds, often = np.unique(from_a.astype("i8") << 32 | from_b, return_counts=True)
                numbers.append((len(a), len(b), groups, len(from_a)))
                hashes.append(hashlib.sha256(shown).hexdigest())
                pairs.append(kinds)
                times.append(often)
            upto = np.concatenate([[0], np.cumsum([len(p) for p in pairs])]).astype("i4")
            lists = [pa.ListArray.from_arrays(pa.array(upto), pa.array(np.concatenate(v).astype("i8"))) for v in (pairs, times)]
            columns = [pa.array([x[k] for x in numbers], pa.int64()) for k in range(4)]
            yield pa.record_batch([batch.column("doc_id"), *columns, pa.array(hashes, pa.string()), *lists], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(local, f"doc_id {kind}, {ALIGNED}").withColumn("row", F.monotonically_increasing_id())


def pair_counts(found: DataFrame) -> DataFrame:
    """found (pairs) -> pair, docs (documents that hold it), best (no pair of its A id has more)."""
    counts = written(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs")), "align-counts")
    counts = counts.withColumn("a", F.shiftright("pair", 32))
    # A row an A id: no more than its vocabulary.
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))
    return counts.join(F.broadcast(most), "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def scored(found: DataFrame, hot: int = HOT) -> DataFrame:
    """found (a written table of `aligned`) with n_best and count_sum."""
    counts = written(pair_counts(found), "align-scored")
    entries = counts.agg(F.sum("docs")).first()[0] or 0
    often = counts.where(F.col("docs") > entries // hot)
    held = found.select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    held = held.join(F.broadcast(often), "pair", "left")

    def sums(df: DataFrame) -> DataFrame:
        return df.groupBy("row").agg(F.sum(F.col("times") * F.col("docs")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"))

    rare = held.where(F.col("docs").isNull()).select("row", "pair", "times").join(counts, "pair")
    both = sums(held.where(F.col("docs").isNotNull())).unionByName(sums(rare)).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    filled = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return found.drop("pairs", "times").join(both, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *filled, "groups_sha256")


def alignment(docs: DataFrame, a_path: str, b_path: str, a_ranks: tuple[str, str] | None = None) -> DataFrame:
    return scored(written(aligned(docs, a_path, b_path, a_ranks), "align-docs"))
