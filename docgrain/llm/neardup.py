"""MinHash near-duplicates: one-permutation hashing, bands, star-shaped candidate edges (operator 8).

A document's set is its distinct shingles of `shingle` words (A-Z lower-cased). One hash of each
shingle serves all bins: its high bits name the bin, the least hash of a bin is the bin's value, and an
empty bin borrows from a full one that a hash of (bin, attempt) names (optimal densification). Bands of
bins are bucket keys.

Documents with equal sets are joined first and one of them stands for all. In a bucket, candidates are
the edges of a star: each member with one centre, not each pair. Edges are confirmed on the full sets.
A star misses a link between two members that are both unlike the centre, so further rounds choose
other centres and compare only members that are not yet in one component. What is still open then is
decided for every pair across components: pair by pair in small buckets, in bounded blocks in large ones.
No pair of a bucket is left undecided. In a large open bucket the strays, members that are not of its main
component, meet all its members: work of strays times members, in blocks of `BLOCK` by `BLOCK`.

Large groups of copies and large buckets are dealt over several tasks by a salt (`common.salted`); components keep
their labels from round to round, and only components that a new edge joins are worked on again.

Bands are no exact way: two sets that share no band are never compared. The chance of that at a similarity of
just 0.8 is (1 - 0.8**4)**32, 5 in 100 million; the README gives what was measured by size of the sets.

Defined results: null, empty or white text has an empty set and is linked with nothing; fewer words
than a shingle count as one shingle; a null doc_id has component null, is linked with nothing and is
kept; a doc_id that occurs more than once stands for all its texts, and each row is returned; ties of centres go
to the lesser id; texts of any length are cut whole; columns other than doc_id and text are not read
(`one_of_each` hands all of them on).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrain.llm.common import components, discard, hot, salted, text_batches, written

SHINGLE, PERCENT, BIN_BITS, BAND_BINS, BANDS = 2, 80, 7, 4, 32
#: Open buckets of up to so many members are compared pair by pair; larger ones in blocks of so many.
SMALL_BUCKET, BLOCK = 32, 512
CACHED_WORDS, CACHED_BYTES = 200_000, 64


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Hashes(dict):
    """word -> 64-bit hash; a bounded cache of words of bounded length, one a partition."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= CACHED_BYTES:
            self[word] = h
        return h


def shingle_set(text: bytes, k: int = SHINGLE, hashes: Hashes | None = None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's k-word shingles."""
    words = text.lower().split()  # bytes: lower() changes A-Z only, split() cuts at ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    hashes = Hashes() if hashes is None else hashes
    ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(k, len(words))
    with np.errstate(over="ignore"):
        total = np.full(len(ids) - k + 1, k, np.uint64)
        for i in range(k):
            total = mixed(total + ids[i : len(ids) - k + 1 + i]) + np.uint64(0x9E3779B97F4A7C15)
    return np.unique(total)


def bin_values(sets: list[np.ndarray], bits: int = BIN_BITS) -> np.ndarray:
    """A row for each set (none empty): the least hash of each of 2**bits bins; empty bins borrow, by optimal densification.
    All sets of a batch are binned at once."""
    n = 1 << bits
    values, full = np.zeros((len(sets), n), np.uint64), np.zeros((len(sets), n), bool)
    if not sets:
        return values
    flat = np.concatenate(sets)
    cell = np.repeat(np.arange(len(sets)), [len(s) for s in sets]) * n + (flat >> np.uint64(64 - bits)).astype("i8")
    first = np.flatnonzero(np.diff(cell, prepend=-1))  # sets are sorted, so a bin's least hash comes first
    values.ravel()[cell[first]], full.ravel()[cell[first]] = flat[first], True
    row, empty = np.nonzero(~full)
    tries = np.uint64(0)
    found = values.copy()
    while len(row):
        tries += np.uint64(1)
        with np.errstate(over="ignore"):
            to = (mixed(np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + tries) >> np.uint64(64 - bits)).astype(int)
        hit = full[row, to[empty]]
        found[row[hit], empty[hit]] = values[row[hit], to[empty[hit]]]
        row, empty = row[~hit], empty[~hit]
    return found


def band_keys(sets: list[np.ndarray], bits: int = BIN_BITS, size: int = BAND_BINS, bands: int = BANDS) -> np.ndarray:
    """Bucket keys, a row for each set; a key also has its band's number in it."""
    values = bin_values(sets, bits)[:, : size * bands].reshape(len(sets), bands, size)
    with np.errstate(over="ignore"):
        keys = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64)), (len(sets), bands))
        for i in range(size):
            keys = mixed(keys + values[:, :, i]) + np.uint64(0x9E3779B97F4A7C15)
    return keys


def lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, "i4")
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate([*arrays, np.empty(0, np.uint64)]).view("i8")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n (size of the set), h1, h2 (a hash of the whole set), bands."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch, texts in text_batches(batches, pa.binary()):
            sets = [shingle_set(t, shingle, hashes) for t in texts]
            whole = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "<i8").reshape(-1, 2)
            keys = iter(band_keys([s for s in sets if len(s)]))
            bands = lists([next(keys) if len(s) else s for s in sets])
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(whole[:, 0]), pa.array(whole[:, 1]), bands], names=["doc_id", "n", "h1", "h2", "bands"])

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n long, h1 long, h2 long, bands array<long>")


def shingle_sets(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, shingles (sorted hashes)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch, texts in text_batches(batches, pa.binary()):
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), lists([shingle_set(t, shingle, hashes) for t in texts])], names=["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, shingles array<long>")


def in_bitmap(ids: DataFrame, most_bits: int = 24):
    """A pair of functions docs -> docs: the rows whose doc_id may be in ids, and the others.

    A bitmap of hashed ids, of at most 2**most_bits bits and so of bounded size, goes to all tasks; it
    spares most rows from the exact join that must follow for those that may be in ids.
    """
    bits = min(most_bits, max(12, (16 * ids.count()).bit_length()))
    slot = f"pmod(xxhash64(doc_id), {1 << bits})"
    word, bit = F.expr(f"{slot} div 64"), f"shiftleft(1L, cast({slot} % 64 AS int))"
    bitmap = ids.groupBy(word.alias("word of id")).agg(F.expr(f"bit_or({bit})").alias("mask of id"))
    hit = F.expr(f"coalesce((`mask of id` & {bit}) != 0, false)")

    def part(docs: DataFrame, inside: bool) -> DataFrame:
        near = docs.join(F.broadcast(bitmap), word == F.col("word of id"), "inner" if inside else "left")
        return near.where(hit if inside else ~hit).select(*[docs[c] for c in docs.columns])

    return (lambda docs: part(docs, True)), (lambda docs: part(docs, False))


def among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose doc_id is in ids (doc_id)."""
    return in_bitmap(ids)[0](docs).join(ids, "doc_id", "left_semi")


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs that near_duplicates() keeps, and of rows that repeat a doc_id only the least;
    rows without a doc_id stay."""
    found = found.where(F.col("doc_id").isNotNull())
    gone = written(found.groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n")).where("n > 1 OR NOT kept"), "neardup-gone")
    may, others = in_bitmap(gone.select("doc_id"))
    rest = may(docs).join(gone.where("NOT kept").select("doc_id"), "doc_id", "left_anti")
    rest = rest.groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return others(docs).unionByName(rest)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sets meet the similarity, as edges (src, dst)."""
    b = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    a = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    both = pairs.join(b, "b").join(a, "a").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    linked = both.where(100 * F.col("common") >= percent * (F.size("sa") + F.size("sb") - F.col("common")))
    return linked.select(F.col("a").alias("src"), F.col("b").alias("dst"))


def block_links(frame: pd.DataFrame, percent: int = PERCENT) -> pd.DataFrame:
    """Links between the block's strays and all of its rows, of other components; one a stray and component.

    A stray's common counts with all rows come from the postings of its own shingles.
    """
    every, strays = frame[~frame["stray"]], frame[frame["stray"]]
    sizes, ids, comps = every["shingles"].map(len).to_numpy(), every["doc_id"].to_numpy(), every["comp"].to_numpy()
    shingles = np.concatenate([*every["shingles"], np.empty(0, "i8")])
    order = np.argsort(shingles, kind="stable")
    shingles, rows = shingles[order], np.repeat(np.arange(len(every)), sizes)[order]
    out = []
    for doc, comp, own in zip(strays["doc_id"], strays["comp"], strays["shingles"], strict=True):
        lo, hi = np.searchsorted(shingles, own, "left"), np.searchsorted(shingles, own, "right")
        many = hi - lo
        at = np.repeat(hi - np.cumsum(many), many) + np.arange(many.sum())
        common = np.bincount(rows[at], minlength=len(every))
        near = np.flatnonzero((100 * common >= percent * (len(own) + sizes - common)) & (comps != comp))
        first = np.unique(comps[near], return_index=True)[1]
        out += [(int(ids[i]), int(doc)) for i in near[first]]
    return pd.DataFrame(out, columns=["src", "dst"])


def links_in_large(large: DataFrame, sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """large (key, doc_id, comp, m) are the open buckets' members. All pairs of different components of a
    bucket are decided: its strays, which are not of its main component, meet all members in blocks of
    bounded size, inside tasks, so that pairs are counted and not made into rows."""
    main = large.groupBy("key", "comp").count().groupBy("key").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"), (F.sum("count") - F.max("count")).alias("strays"))
    rows = large.join(written(main, "neardup-main"), "key").join(sets.select("doc_id", "shingles"), "doc_id")
    parts = lambda n: F.ceil(F.col(n) / block).cast("int")
    own = lambda n, salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), parts(n)).cast("int")
    every = rows.select("key", "doc_id", "comp", "shingles", F.lit(False).alias("stray"), own("m", 1).alias("block"), F.explode(F.sequence(F.lit(0), parts("strays") - 1)).alias("turn"))
    strays = rows.where(F.col("comp") != F.col("main")).select("key", "doc_id", "comp", "shingles", F.lit(True).alias("stray"), F.explode(F.sequence(F.lit(0), parts("m") - 1)).alias("block"), own("strays", 2).alias("turn"))
    return every.unionByName(strays).groupBy("key", "block", "turn").applyInPandas(lambda f: block_links(f), "src long, dst long").distinct()


def contracted(edges: DataFrame, labels: DataFrame | None, name: str) -> DataFrame:
    """labels (id, comp) joined by new edges (src, dst): only components that an edge joins are worked on, as one node each."""
    if labels is None:
        return components(edges, name)
    of = lambda end: labels.select(F.col("id").alias(end), F.col("comp").alias(f"c_{end}"))
    ends = edges.join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    between = written(ends.select(F.coalesce("c_src", "src").alias("src"), F.coalesce("c_dst", "dst").alias("dst")).where("src <> dst").distinct(), f"{name}-between")
    joined = components(between, name).select(F.col("id").alias("comp"), F.col("comp").alias("into"))
    old = labels.join(joined, "comp", "left").select("id", F.coalesce("into", "comp").alias("comp"))
    # A node without a label was its own component; its new one stands under its id.
    new = joined.join(labels.select(F.col("id").alias("comp")), "comp", "left_anti").select(F.col("comp").alias("id"), F.col("into").alias("comp"))
    return written(old.unionByName(new), f"{name}-labels")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, rounds: int = 3) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id, kept; one row for each row of docs."""
    docs = docs.select("doc_id", "text")
    signed = written(signatures(docs, shingle), "neardup-signatures")
    some = signed.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    # Copies: equal sets. The least doc_id of a group stands for it; a large group's rows are dealt over its parts.
    equal = ["h1", "h2", "n"]
    rep = written(some.groupBy(*equal).agg(F.min("doc_id").alias("rep"), F.count("*").alias("times")).where("times > 1"), "neardup-copied")
    n_rows = signed.count()
    often = hot(rep, equal, "times", n_rows)
    deal = F.xxhash64("doc_id", F.lit(8))
    left, right = salted(signed, rep.drop("times"), often, equal, deal)
    marked = written(left.join(right, [*equal, "salt"], "left").drop("salt"), "neardup-marked")
    lone = marked.where(F.col("doc_id").isNotNull() & (F.col("n") > 0) & (F.col("rep").isNull() | (F.col("rep") == F.col("doc_id"))))
    rows = lone.select("doc_id", "n", F.explode("bands").alias("key"))
    full = rows.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("m")).where(F.col("lo") != F.col("hi"))
    full = written(full.select("key", "m"), "neardup-buckets")
    # Every later join on buckets goes by key and salt, so a large bucket's members lie in several tasks.
    crowded = written(hot(full, "key", "m", BANDS * n_rows), "neardup-crowded")
    left, right = salted(rows, full.select("key"), crowded, ["key"], deal)
    members = written(left.join(right, ["key", "salt"]), "neardup-members")
    ids = written(members.select("doc_id").distinct(), "neardup-ids")
    sets = written(shingle_sets(among(docs, ids), shingle), "neardup-sets")
    like = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (F.col("ca") != F.col("cb")) & (F.col("a") != F.col("b"))
    labels, tried = None, None
    for step in range(rounds + 1):
        if labels is None:
            placed = members.withColumn("comp", F.col("doc_id"))
        else:
            placed = members.join(labels.select(F.col("id").alias("doc_id"), "comp"), "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id"))
        side = lambda x: placed.select("key", "salt", F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("comp").alias(f"c{x}"))  # noqa: B023, E731
        spread = lambda one: one.join(F.broadcast(crowded), "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        strays = None
        if step < rounds:
            pick = {0: F.min_by(F.struct("doc_id", "n", "comp"), "doc_id"), 1: F.max_by(F.struct("doc_id", "n", "comp"), "doc_id")}.get(step, F.min_by(F.struct("doc_id", "n", "comp"), F.xxhash64("doc_id", F.lit(step))))
            centre = placed.groupBy("key").agg(pick.alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where(F.col("lo") != F.col("hi"))
            centre = spread(centre.select("key", F.col("c.doc_id").alias("a"), F.col("c.n").alias("na"), F.col("c.comp").alias("ca")))
            pairs = side("b").join(centre, ["key", "salt"]).where(like)
        else:
            open_ = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m")).where(F.col("lo") != F.col("hi")).select("key", "m")
            open_ = written(placed.join(spread(open_), ["key", "salt"]), "neardup-open")
            placed = open_.where(F.col("m") <= SMALL_BUCKET)
            pairs = side("a").join(side("b"), ["key", "salt"]).where(like & (F.col("a") < F.col("b")))
            strays = written(links_in_large(open_.where(F.col("m") > SMALL_BUCKET).drop("salt"), sets), "neardup-strays")
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = written(pairs, f"neardup-pairs-{step}")
        found = None
        if pairs.limit(1).count():
            tried = pairs if tried is None else tried.unionByName(pairs)
            found = written(confirmed(pairs, sets, percent), f"neardup-edges-{step}")
        if strays is not None:
            found = strays if found is None else found.unionByName(strays)
        if found is not None:
            labels = contracted(found, labels, f"neardup-components-{step}")
    discard(sets)
    # A doc_id that stands in several rows links the groups of all its texts; other copies just take their group's component.
    repeated = written(some.groupBy("doc_id").count().where("count > 1").select("doc_id"), "neardup-repeated")
    ties = marked.join(repeated, "doc_id", "left_semi").where("rep <> doc_id").select(F.col("rep").alias("src"), F.col("doc_id").alias("dst")).distinct()
    labels = contracted(ties, labels, "neardup-ties")
    of_rep = written(rep.select(*equal, "rep").join(labels.select(F.col("id").alias("rep"), "comp"), "rep", "left").select(*equal, F.coalesce("comp", "rep").alias("of rep")), "neardup-of-rep")
    left, right = salted(marked.drop("bands"), of_rep, often, equal, deal)
    out = left.join(right, [*equal, "salt"], "left").join(labels.select(F.col("id").alias("doc_id"), "comp"), "doc_id", "left")
    component = F.coalesce("comp", F.when(F.col("n") > 0, F.col("of rep")), "doc_id")
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
