"""Language by compression (operator 2).

Each language has a zstandard raw-content dictionary, made of pieces of training texts drawn by hash. A
text is compressed in blocks with every dictionary, and the language that leaves the fewest bytes wins;
a narrow margin over the next is marked as rejected.

The dictionaries are a bounded sample (`sampled` documents a language on average, `pieces` of at most
`piece_bytes` each, `dictionary_bytes` in all): every sampled document gives a part of each of its pieces,
copies count once, and the order is a seeded hash. Every text is compressed whole.

Defined results: null text and text without a letter (number characters such as \u00bd or \u2167 are none) are `und` with score 0; without training texts all
are `und`; ties go to the language with more training documents, then to the lesser name; repeated rows are each judged
alone, and count each in the sample, where equal pieces are taken once; texts of any length are compressed whole, block by
block; columns other than doc_id, text, held_out and (for the sample) lang are not read.

Of more than `MOST_LANGUAGES` values of lang the most frequent ones have a dictionary; documents of the others are
given one of those.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrain.llm.common import text_batches

SAMPLED, PIECES, PIECE_BYTES, DICTIONARY_BYTES, MOST_LANGUAGES = 250, 4, 400, 32_000, 200
BLOCK_BYTES, LEVEL, NARROW = 4096, 6, 0.02
#: ASCII characters that are no letters become spaces.
ASCII_LETTERS = bytes(c if chr(c).isalpha() or c > 127 else 32 for c in range(256))


def normal(text: str) -> bytes:
    """Lower-case letters and single spaces; what markup, digits and signs there are says nothing."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(ASCII_LETTERS).split())


def dictionary(documents: list[list[bytes]], limit: int = DICTIONARY_BYTES, piece_bytes: int = PIECE_BYTES) -> bytes:
    """Each document's pieces, cut to the greatest common length at which all documents fit; equal ones once."""
    distinct = sorted({tuple(d) for d in documents}, key=lambda d: (xxhash.xxh3_64_intdigest(b" ".join(d), seed=11), d))

    def parts(length: int) -> dict[bytes, None]:
        return dict.fromkeys(piece[:length] for d in distinct for piece in d)

    low, high = 1, piece_bytes
    while low < high:
        middle = (low + high + 1) // 2
        if sum(map(len, found := parts(middle))) + len(found) - 1 <= limit:
            low = middle
        else:
            high = middle - 1
    return b" ".join(parts(low))[:limit]


def sampled_pieces(docs: DataFrame, per_language: int = SAMPLED, pieces: int = PIECES, piece_bytes: int = PIECE_BYTES) -> list[tuple[str, int, bytes]]:
    """docs (doc_id, text, lang) of the training part -> (lang, documents, dictionary)."""
    counts = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()}
    if not counts:
        return []
    shares = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])
    # Drawn by id and text, so that rows without an id, or of one id, are drawn each for itself.
    unit = F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(1_000_003)) / 1_000_003.0
    few = docs.where(unit < F.try_element_at(shares, F.col("lang"))).select("lang", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            out = []
            for text in texts:
                data = normal(text)
                starts = sorted({len(data) * k // pieces for k in range(pieces)})
                out.append([data[a : a + piece_bytes] for a in starts if a < len(data)])
            yield pa.record_batch([batch.column("lang"), pa.array(out, pa.list_(pa.binary()))], names=["lang", "pieces"])

    # Equal pieces count once, so what comes to the driver is about the draw, however often a row is repeated; the limit bounds it surely.
    rows = few.mapInArrow(cut, "lang string, pieces array<binary>").where("size(pieces) > 0").distinct().limit(4 * per_language * len(counts)).collect()
    documents: dict[str, list[list[bytes]]] = {}
    for r in rows:
        documents.setdefault(r["lang"], []).append([bytes(p) for p in r["pieces"]])
    return [(k, n, dictionary(documents[k], piece_bytes=piece_bytes)) for k, n in counts.items() if k in documents]


class Compressors:
    """One compressor a language; made in each worker, not shipped."""

    def __init__(self, parts: list[tuple[str, int, bytes]]):
        self.langs, self.own = [k for k, _, _ in parts], []
        for _, _, data in parts:
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.own.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False))

    def __call__(self, text: str) -> tuple[str, float, bool]:
        """Language, score from 0 (a tie) to 1, rejected. The score is the saving over the next best,
        in shares of its bytes, where a saving of a fifth counts as 1."""
        if not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        data = normal(text)
        blocks = [data[a : a + BLOCK_BYTES] for a in range(0, max(len(data), 1), BLOCK_BYTES)]
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in self.own]
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        if len(order) == 1:
            return self.langs[0], 1.0, False
        saving = (sizes[order[1]] - sizes[order[0]]) / sizes[order[1]]
        return self.langs[order[0]], min(1.0, 5 * saving), saving < NARROW


def predict(docs: DataFrame, parts: list[tuple[str, int, bytes]]) -> DataFrame:
    """docs (doc_id, text, held_out) -> doc_id, held_out, lang_pred, score, rejected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Compressors(parts)
        for batch, texts in text_batches(batches):
            found = [own(t) for t in texts]
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())],
                names=["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    of = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "held_out").mapInArrow(run, f"doc_id {of}, held_out boolean, lang_pred string, score double, rejected boolean")
