"""Containment joins: which texts hold which passages, as they are or nearly.

No pair of a text and a passage is looked at unless they share hashed character runs; runs are keys of joins, so both
sides may be tables of any size.

As it is: of the runs of Q characters in each window of W neighbouring ones the least by hash is kept, in texts and in passages. A
passage of Q + W - 1 characters or more has a whole window, and a text that holds the passage holds that window, so it keeps the same run. The
passage's rarest run, by the texts that keep it, is its key. Shorter passages take shorter runs and windows.

Nearly: a stretch of the text as similar as `threshold` leaves out, or puts in, few characters, and each of them breaks one at most of
the passage's runs that lie side by side. So many of those must occur in the text; what has them is compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrain.functions import text as X
from docgrain.sources.scratch import written

#: Run and window by the least length of a passage: a text keeps about 2 / (W + 1) of its runs.
RUNS = {32: (16, 17), 8: (4, 5), 1: (1, 1)}
#: Lengths of runs side by side that may be asked for; the longest that still has to occur is.
SIDE_BY_SIDE = (4, 3, 2, 1)


def run_hashes(text: str, length: int) -> np.ndarray:
    """A hash of each run of `length` characters, in order."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = len(codes) - length + 1
    if n <= 0:
        return np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(length):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n] + np.uint64(1)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def kept_runs(text: str, length: int, window: int) -> np.ndarray:
    """The least hash of each window, each once."""
    h = run_hashes(text, length)
    if len(h) < window:
        return h[:0]
    size = 1
    while size < window:  # least of `size` neighbours; two such stretches cover the next one
        step = min(size, window - size)
        h = np.minimum(h[:-step], h[step:])
        size += step
    return np.unique(h[np.concatenate([[True], h[1:] != h[:-1]])])


def exploded(rows: DataFrame, keys: list[str], hashes: Callable[[str], np.ndarray]) -> DataFrame:
    """rows (keys, text) -> keys, run: a row for each hash of a row's text."""
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                some = batch.slice(a, 500)
                found = [hashes(text or "") for text in some.column(len(keys)).to_pylist()]
                at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                yield pa.record_batch([*(some.column(k).take(at) for k in range(len(keys))), pa.array(np.concatenate(found))], names=[*keys, "run"])

    return rows.select(*keys, "text").mapInArrow(run, f"{kinds}, run long")


def holders(texts: DataFrame, passages: DataFrame, text_key: str = "doc_id", passage_key: str = "item_id") -> DataFrame:
    """texts (text_key, text), passages (passage_key, text) -> passage_key, text_key where the text holds the passage as it is.

    Null and empty passages are held by none; keys may repeat or be null, and pairs of keys come out once."""
    texts, asked = texts.select(text_key, "text"), passages.where("text <> ''").select(passage_key, "text")
    least = F.lit(None).cast("int")
    for bound in sorted(RUNS):
        least = F.when(F.length("text") >= bound, bound).otherwise(least)
    asked = asked.withColumns({"least": least, "_own": F.md5("text")})  # a passage is its key and its text
    found = None
    for (bound,) in sorted(asked.select("least").distinct().collect()):  # a row a kind of run
        some, (length, window) = asked.where(F.col("least") == bound).drop("least"), RUNS[bound]

        def keep(text: str, length=length, window=window) -> np.ndarray:
            return kept_runs(text, length, window)

        wanted = exploded(some, [passage_key, "_own"], keep)
        held = written(exploded(texts, [text_key], keep).join(wanted.select("run").distinct(), "run", "left_semi"), "contain-runs")
        often = held.groupBy("run").agg(F.count("*").alias("n"))
        # A run that no text keeps is the rarest of all: its passage is held by none.
        rarest = wanted.join(often, "run", "left").groupBy(passage_key, "_own").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run"))["run"].alias("run"))
        likely = rarest.join(held, "run").select(passage_key, "_own", text_key).distinct()
        named = some.select(F.col(passage_key).alias("_key"), "_own", F.col("text").alias("_passage")).distinct()
        both = likely.join(named, (named["_own"] == likely["_own"]) & named["_key"].eqNullSafe(likely[passage_key])).drop("_own")
        both = both.join(texts.withColumnRenamed(text_key, "_text"), F.col("_text").eqNullSafe(F.col(text_key)))
        part = both.where(F.contains("text", "_passage")).select(passage_key, text_key).distinct()
        found = part if found is None else found.unionByName(part)
    if found is None:
        kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for df, c in ((passages, passage_key), (texts, text_key)))
        return texts.sparkSession.createDataFrame([], kinds)
    return found


def broken(n: Column, threshold: float) -> Column:
    """The most characters left out and put in, both counted, of a stretch like a passage of n characters."""
    return F.floor(2 * n * F.lit((100.0 - threshold) / 100.0) + 1e-9)


def sharing(needles: DataFrame, hays: DataFrame, block: str, needle_keys: list[str], hay_keys: list[str], threshold: float) -> DataFrame:
    """needle_keys, hay_keys of the pairs of a block that share as many of the needle's runs side by side as nearly holding it takes."""
    n = F.length("text")
    lengths = F.array(*[F.struct(F.lit(q).alias("q"), (F.floor(n / q) - broken(n, threshold)).alias("need")) for q in SIDE_BY_SIDE])
    chosen = F.try_element_at(F.filter(lengths, lambda x: x["need"] > 0), F.lit(1))
    sized = needles.select(block, *needle_keys, "text", chosen["q"].alias("q"), chosen["need"].alias("need"))
    hays = hays.join(sized.select(block).distinct(), block, "left_semi").select(block, *hay_keys, "text")
    found = None
    for q in SIDE_BY_SIDE:
        own = exploded(sized.where(F.col("q") == q), [block, *needle_keys, "need"], lambda text, q=q: run_hashes(text, q)[::q])
        own = own.groupBy(block, *needle_keys, "need", "run").agg(F.count("*").alias("times"))
        other = exploded(hays, [block, *hay_keys], lambda text, q=q: np.unique(run_hashes(text, q)))
        both = own.join(other, [block, "run"]).groupBy(*needle_keys, *hay_keys).agg(F.sum("times").alias("n"), F.max("need").alias("need"))
        part = both.where(F.col("n") >= F.col("need")).select(*needle_keys, *hay_keys)
        found = part if found is None else found.unionByName(part)
    return found


def near_holders(texts: DataFrame, passages: DataFrame, block: str, text_keys: list[str], passage_keys: list[str], threshold: float = 90.0) -> DataFrame:
    """texts (block, text_keys, text), passages (block, passage_keys, text), both normalised and with keys that don't repeat ->
    passage_keys, text_keys of the pairs of a block where the text holds the passage, or has a stretch like it by `threshold` of 100.

    A text shorter than the passage is looked for in it, as X.partial_ratio has it. Blanks hold nothing and are held by none."""
    if threshold <= 50:
        raise ValueError("no run has to occur at 50 of 100 or less")
    texts, passages = (df.where("text <> ''").select(block, *keys, "text") for df, keys in ((texts, text_keys), (passages, passage_keys)))
    longest = passages.groupBy(block).agg(F.max(F.length("text")).alias("_most"))
    short = texts.join(longest, block).where(F.length("text") < F.col("_most")).drop("_most")
    likely = sharing(passages, texts, block, passage_keys, text_keys, threshold).unionByName(sharing(short, passages, block, text_keys, passage_keys, threshold))
    both = likely.distinct().join(passages.withColumnRenamed("text", "_passage").drop(block), passage_keys).join(texts.drop(block), text_keys)
    return both.where(X.fuzzy_contains(threshold)(F.col("_passage"), F.col("text"))).select(*passage_keys, *text_keys)
