"""Chunking: joined pages, fixed windows, packed pieces, and the pages a chunk covers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 4


def join_pages(blocks: DataFrame, doc: str = "doc_id", order: tuple[str, ...] = ("page_no", "block_no")) -> DataFrame:
    """Each block with its place in the document's text, blocks joined by one line break: start, end."""
    before = Window.partitionBy(doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("long")
    return blocks.withColumn("start", start).withColumn("end", F.col("start") + F.length("text"))


def document_text(blocks: DataFrame, doc: str = "doc_id", order: tuple[str, ...] = ("page_no", "block_no")) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct(*order, "text")))
    return blocks.groupBy(doc).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))


#: Windows that are cut from one stretch of a text: a long text is not walked from its beginning for each of them.
STRETCH = 64


def fixed_windows(docs: DataFrame, tokens: int = 512, overlap: int = 64, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, chunk_idx, start, end, text: windows of tokens * 4 characters; blank ones are left out and not counted.

    A document's windows are an array in its own row, so nothing is shuffled and no text is repeated."""
    size = max(1, tokens * CHARS_PER_TOKEN)
    step = max(1, size - overlap * CHARS_PER_TOKEN)
    n = F.length(text)
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int") * step
    stretches = F.transform(F.sequence(F.lit(0), last, F.lit(step * STRETCH)), lambda a: F.struct(a.alias("a"), F.substring(F.col(text), a + 1, F.lit(step * STRETCH + size)).alias("part")))

    def windows(x):
        inside = F.sequence(F.lit(0), F.least(last - x["a"], F.lit(step * (STRETCH - 1))), F.lit(step))
        return F.transform(inside, lambda i: F.struct((x["a"] + i).alias("start"), F.least(x["a"] + i + size, n).alias("end"), F.substring(x["part"], i + 1, F.lit(size)).alias("text")))

    filled = F.filter(F.flatten(F.transform(stretches, windows)), lambda w: F.trim(F.regexp_replace(w["text"], r"(?U)\s+", "")) != "")
    return docs.where(n > 0).select(doc, F.posexplode(filled).alias("chunk_idx", "w")).select(doc, "chunk_idx", "w.start", "w.end", "w.text")


def packed(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(start, end) of each chunk. A piece is a word with the space or line break after it. A chunk holds as many whole
    pieces as fit `size` characters (one at least); the next starts at the last piece from which `overlap` characters
    or more repeat, one piece further on at least. All places are looked up in the sorted piece ends."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    cuts = np.union1d([0, len(points)], np.flatnonzero((points == 32) | (points == 10)) + 1)
    first, last = 0, len(cuts) - 1
    while first < last:
        end = max(first + 1, int(np.searchsorted(cuts, cuts[first] + size, "right")) - 1)
        yield int(cuts[first]), int(cuts[end])
        if end == last:
            return
        first = max(first + 1, int(np.searchsorted(cuts, cuts[end] - overlap, "right")) - 1)


def packed_chunks(docs: DataFrame, tokens: int = 512, overlap: int = 64, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, chunk_idx, start, end, text by greedy packing; blank chunks are left out; documents are independent of each other."""
    size, again = max(1, tokens * CHARS_PER_TOKEN), max(0, overlap * CHARS_PER_TOKEN)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for d, t in zip(frame[doc], frame[text], strict=True):
                filled = [(a, b, t[a:b]) for a, b in packed(t or "", size, again) if t[a:b].strip()]
                rows += [(d, i, a, b, c) for i, (a, b, c) in enumerate(filled)]
            yield pd.DataFrame(rows, columns=[doc, "chunk_idx", "start", "end", "text"])

    kind = docs.schema[doc].dataType.simpleString()
    return docs.select(doc, text).mapInPandas(run, f"{doc} {kind}, chunk_idx int, start int, end int, text string")


def pages_covered(chunks: DataFrame, blocks: DataFrame, doc: str = "doc_id", span: int = 4096) -> DataFrame:
    """chunks (doc, chunk_idx, start, end) with page_start, page_end and n_blocks of the blocks (doc,
    page_no, start, end) they overlap; page 1 where none does.

    Both sides meet by stretches of `span` characters, and a pair counts in the first that both touch."""
    stretches = lambda a, b: F.explode(F.sequence(F.floor(a / span), F.floor(F.greatest(a, b - 1) / span)))
    c = chunks.select(doc, "chunk_idx", "start", "end", stretches(F.col("start"), F.col("end")).alias("at"))
    b = blocks.select(doc, "page_no", F.col("start").alias("b_start"), F.col("end").alias("b_end")).where("b_end > b_start")
    b = b.select("*", stretches(F.col("b_start"), F.col("b_end")).alias("at"))
    on = (F.col("b_start") < F.col("end")) & (F.col("b_end") > F.col("start")) & (F.col("at") == F.floor(F.greatest("start", "b_start") / span))
    hits = c.join(b, [doc, "at"]).where(on).groupBy(doc, "chunk_idx").agg(F.min("page_no").alias("page_start"), F.max("page_no").alias("page_end"), F.count("*").alias("n_blocks"))
    out = chunks.join(hits, [doc, "chunk_idx"], "left")
    return out.withColumns({"page_start": F.coalesce("page_start", F.lit(1)), "page_end": F.coalesce("page_end", F.lit(1)), "n_blocks": F.coalesce("n_blocks", F.lit(0))})


def with_header(chunks: DataFrame, kind: str) -> DataFrame:
    """The type as a first line of the text, where there is one."""
    return chunks.withColumn("text", F.when(F.coalesce(F.col(kind), F.lit("")) != "", F.concat_ws("\n", kind, "text")).otherwise(F.col("text")))
