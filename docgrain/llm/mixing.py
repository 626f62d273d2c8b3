"""Mixing sources to target weights by min-cost flow (operator 9).

Sources overlap: the same text may be in several of them, as a document of each. Documents are
aggregated by membership pattern, the set of sources that hold their text. A flow network routes the words of each
pattern to the quotas of its sources: the first pass over a pattern's distinct words is free, each further pass
costs more (convex repetition cost), and a source takes no more of a pattern than twice what its own documents
hold. So a source whose texts are elsewhere too is filled from those that are not, and what sources share
is shared out between them before it is taken twice. Along a pattern's seeded order of texts its sources take
stretches one after another, so two of them take one text twice only where the flow goes round again.

The driver sees a row for each source and for each pattern and source, of at most `MOST_PATTERNS` patterns with
several sources (those with most words; documents of rarer ones count to their own source alone, which
changes no target), never documents. Where a stretch begins and ends is found by sums over the first digits of the seeded
hash; only the documents at a cut are ordered one by one, and copies of one very frequent text are dealt over
buckets of their own, so no task gets a source, a pattern or a text whole.

Defined results: null text has size 0; texts without words overlap with nothing; a null source is a source
of its own, last in order; an empty table gives no rows and a corpus without words gives targets and
taken words of 0; documents of one text are taken in the order of a hash of doc_id, exact repeats
of a row are interchangeable; texts of any length are counted and hashed whole; columns other than doc_id, text and
source are not read.
"""

from __future__ import annotations

from collections import defaultdict, deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgrain.llm.common import WORD, hot, salted, written

#: Weights by order of the sources, repeating.
WEIGHTS = (3, 1, 2)
SHARE, MOST_COPIES = 1.5, 2
#: Patterns of several sources in the network; passes with a cost of their own (any beyond cost as much as the last).
MOST_PATTERNS, PASSES = 4096, 6
#: Hexadecimal digits of a bucket of the seeded order.
DIGITS = 3


def targets(sizes: dict, weights: dict, total: float, most: float = MOST_COPIES) -> dict:
    """total shared by weight; a target stops at most * size, the excess goes to the others by weight."""
    caps = {s: most * n for s, n in sizes.items()}
    out, free, left = {}, set(sizes), total
    while free:
        level = left / sum(weights[s] for s in free)
        full = {s for s in free if level * weights[s] >= caps[s]}
        if not full:
            return out | {s: level * weights[s] for s in free}
        out |= {s: float(caps[s]) for s in full}
        left -= sum(caps[s] for s in full)
        free -= full
    return out


def flow(words: dict, rows: dict, quota: dict, passes: int = PASSES, most: int = MOST_COPIES) -> dict:
    """Min-cost flow {(pattern, source): words}. words: distinct words of a pattern; rows: words of a source's documents in a
    pattern, of which `most` times as many may be taken; quota: words of a source.

    All costs are on the arcs into patterns, one arc a pass: so it is enough to open these arcs pass by pass, cheapest
    first, and to fill up with the greatest flow each time (blocking flows on the shortest paths that are left)."""
    room: dict = defaultdict(float)  # of arcs and their reverses
    near: dict = defaultdict(list)

    def arc(a, b, r: float) -> None:
        if (a, b) not in room and (b, a) not in room:
            near[a].append(b)
            near[b].append(a)
        room[a, b] += r

    for (p, s), n in rows.items():
        arc(("p", p), ("s", s), most * float(n))
    for s, n in quota.items():
        arc(("s", s), "T", float(n))
    for k in range(passes):
        for p, n in words.items():
            arc("S", ("p", p), float(n) if k < passes - 1 else float("inf"))
        while True:
            depth, queue = {"S": 0}, deque(["S"])
            while queue:
                a = queue.popleft()
                for b in near[a]:
                    if b not in depth and room[a, b] > 1e-6:
                        depth[b] = depth[a] + 1
                        queue.append(b)
            if "T" not in depth:
                break
            at: dict = defaultdict(int)
            path = ["S"]
            while path:
                a = path[-1]
                if a == "T":
                    push = min(room[x, y] for x, y in zip(path, path[1:], strict=False))
                    for x, y in zip(path, path[1:], strict=False):
                        room[x, y] -= push
                        room[y, x] += push
                    path = path[: next(i for i, (x, y) in enumerate(zip(path, path[1:], strict=False)) if room[x, y] <= 1e-6) + 1]
                    continue
                while at[a] < len(near[a]) and not (depth.get(near[a][at[a]], -1) == depth[a] + 1 and room[a, near[a][at[a]]] > 1e-6):
                    at[a] += 1
                if at[a] < len(near[a]):
                    path.append(near[a][at[a]])
                else:
                    path.pop()
                    if path:
                        at[path[-1]] += 1
    return {(p, s): room[("s", s), ("p", p)] for p, s in rows if room[("s", s), ("p", p)] > 0}


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def pattern_of(sources: Column) -> Column:
    """A name for a document's set of sources."""
    return F.to_json(F.struct(F.array_sort(F.array_distinct(sources)).alias("s")), {"ignoreNullFields": "false"})


def seeded(seed: str) -> Column:
    """The order of documents that overlap with none: by id, and by text where ids are null or repeated."""
    return F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5("text"), F.lit(""))))


def single(docs: DataFrame, seed: str = "") -> DataFrame:
    """docs (doc_id, text, source) as mix() takes them, each in its own source alone."""
    h = seeded(seed)
    return docs.select("doc_id", word_count("text").alias("size"), "source", F.array("source").alias("sources"), F.lit(1).cast("long").alias("copies"), h.alias("h"), F.substring(h, 1, DIGITS).alias("b"))


def overlapping(docs: DataFrame, seed: str = "") -> DataFrame:
    """docs (doc_id, text, source) as mix() takes them, each in every source that holds its text."""
    size = word_count("text")
    rows = docs.select("doc_id", "source", size.alias("size"), F.when(size > 0, F.md5(F.concat(F.lit(seed), "text"))).alias("h"), seeded(seed).alias("own"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "mix-rows")
    same = rows.where("h IS NOT NULL").groupBy("h").agg(F.count("*").alias("copies"), F.transform(F.collect_set(F.struct("source")), lambda x: x["source"]).alias("sources")).where("copies > 1")
    same = written(same, "mix-same")
    often = hot(same, "h", "copies", rows.count())
    some, others = salted(rows, same, often, ["h"], F.xxhash64("doc_id", "row"))
    joined = some.join(others, ["h", "salt"], "left").join(F.broadcast(often.select("h", F.lit(True).alias("often"))), "h", "left")
    h, split = F.coalesce("h", "own"), F.concat("h", F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("row").cast("string"))), 1, DIGITS))
    return joined.select("doc_id", "size", "source", F.coalesce("sources", F.array("source")).alias("sources"), F.coalesce("copies", F.lit(1)).alias("copies"), h.alias("h"), F.when(F.col("often"), split).otherwise(F.substring(h, 1, DIGITS)).alias("b"))


def mix(docs: DataFrame, share: float = SHARE, weights: tuple = WEIGHTS, most_patterns: int = MOST_PATTERNS) -> DataFrame:
    """docs from single() or overlapping() -> doc_id, size, source, pattern, h (seeded order), source_size, target, taken,
    passes (booleans: whether the stretch takes it, each time that it goes round).

    A document is in a stretch if its middle word is, and counts with its whole size, so each stretch, one a pattern
    and source, is met within one document."""
    pattern = pattern_of(F.col("sources"))
    docs = written(docs.withColumn("pattern", pattern).withColumn("n_sources", F.size("sources")), "mix-docs")
    spark = docs.sparkSession
    # Rarer patterns than the network takes: their documents count to their own source alone.
    several = docs.where("n_sources > 1").groupBy("pattern").agg(F.sum("size").alias("words")).orderBy(F.desc("words"), "pattern").limit(most_patterns)
    kept = several.select("pattern", F.lit(True).alias("kept"))
    docs = docs.join(F.broadcast(kept), "pattern", "left").withColumn("pattern", F.when(F.col("kept") | (F.col("n_sources") == 1), F.col("pattern")).otherwise(pattern_of(F.array("source")))).drop("kept", "sources", "n_sources")
    cells = docs.groupBy("pattern", "source").agg(F.sum("size").alias("size"), F.sum(F.col("size") / F.col("copies")).alias("words")).collect()
    cells.sort(key=lambda r: (r["pattern"], r["source"] is None, r["source"] or ""))
    own: dict = defaultdict(int)
    words: dict = defaultdict(float)
    for r in cells:
        own[r["source"]] += r["size"]
        words[r["pattern"]] += round(r["words"], 3)
    order = sorted(own, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    aims = targets(own, weight, share * sum(own.values()))
    routed = flow(words, {(r["pattern"], r["source"]): r["size"] for r in cells}, aims)
    plan, gone = [], defaultdict(float)  # how far round its texts a pattern's sources before have gone
    for r in cells:
        p, s, size = r["pattern"], r["source"], float(r["size"])
        words_taken = routed.get((p, s), 0.0)
        first = gone[p] % 1.0 * size
        gone[p] += words_taken / size if size else 0.0
        plan.append((p, s, int(own[s]), float(aims[s]), first, first + words_taken, size))
    plan = spark.createDataFrame(plan, "pattern string, source string, source_size long, target double, first double, last double, cell_size double")
    # Where each document starts in the seeded order of its pattern and source: words in earlier buckets, then in its own.
    cell = ["pattern", "source"]
    buckets = docs.groupBy(*cell, "b").agg(F.sum("size").alias("n"))
    before = buckets.select(*cell, "b", (F.sum("n").over(Window.partitionBy(*cell).orderBy("b")) - F.col("n")).alias("before"))
    inside = F.sum("size").over(Window.partitionBy(*cell, "b").orderBy("h", F.md5(F.col("doc_id").cast("string")), "size").rowsBetween(Window.unboundedPreceding, -1))
    same = lambda a, b, names: [a[c].eqNullSafe(b[c]) for c in names]
    docs = docs.withColumn("inside", F.coalesce(inside, F.lit(0)))
    placed = docs.join(before, same(docs, before, [*cell, "b"])).select(*[docs[c] for c in docs.columns], (before["before"] + docs["inside"] + docs["size"] / 2).alias("mid"))
    each = placed.join(F.broadcast(plan), same(placed, plan, cell)).drop(plan["pattern"]).drop(plan["source"])
    passes = [((F.col("mid") + k * F.col("cell_size")) >= F.col("first")) & ((F.col("mid") + k * F.col("cell_size")) < F.col("last")) for k in range(MOST_COPIES + 1)]
    each = each.withColumn("passes", F.array(*passes))
    taken = F.size(F.filter("passes", lambda p: p)) * F.col("size")
    return each.select("doc_id", "size", "source", "pattern", "h", "source_size", "target", taken.alias("taken"), "passes")


def apply_mix(docs: DataFrame, mixed: DataFrame, seed: str = "") -> DataFrame:
    """The rows of docs as often as `mixed` (from mix() of single(), with the same seed) takes them. Each round of a
    stretch is a range of the seeded order, so its two ends (a row a source) decide without a join of texts."""
    ends = mixed.select("source", F.posexplode("passes").alias("k", "taken"), "h").where("taken")
    ends = ends.groupBy("source", "k").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    stretches = ends.groupBy("source").agg(F.collect_list(F.struct("lo", "hi")).alias("stretches"))
    row = docs.select(F.struct(*docs.columns).alias("row"), seeded(seed).alias("h"), F.col("source").alias("source of row"))
    row = row.join(F.broadcast(stretches), F.col("source of row").eqNullSafe(stretches["source"]))
    row = row.select("row", F.filter("stretches", lambda x: (F.col("h") >= x["lo"]) & (F.col("h") <= x["hi"])).alias("hits"))
    return row.select("row", F.explode("hits")).select("row.*")
