"""Exact top-k by a Voronoi kNN join (operator 7).

Vectors belong to the cell of the pivot nearest in direction, and within it to a class of length (each
half as long as the one before). A cell's summary (widest angle to the pivot, longest and shortest vector,
count) bounds the inner product of a query with anything in it: the angle between the two is at least the
query's angle to the pivot less the cell's. A first round finds each query's k best in its most promising
cells, which is a lower bound of its final k-th score; a second round visits only the other cells whose
bound reaches it. So a query is sent only where it may find something, and cells are searched locally.

Pivots grow with the root of the number of rows, up to `MOST_PIVOTS`, and come from a bounded sample; there
is one summary a cell and class. Cells are dealt in blocks of bounded size and queries in turns of bounded
size, so a hot cell (one vector many times over) is spread over tasks; a block keeps k candidates a query.
How much the bounds save depends on the vectors: where directions are spread evenly over many dimensions
every cell may hold a best one, and every pair is computed (see the README's figures).

Defined results: rows whose vector is null, or holds a null or a non-finite component, take no part, nor do
rows without an id. Every other vector takes part, whatever its length (a missing component counts as 0)
and the size of its components: products are exact integers, and one beyond a long is given as the nearest
long and ranked by its double. Queries and candidates are rows: each row of a repeated id asks for itself and
may be found by the others, so query_id may occur with each rank more than once. Ties go to the smaller id;
fewer than k candidates give all of them; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrain.llm.common import written

SCALE, K, BLOCK, TURN = 1024, 10, 8192, 1024
MOST_PIVOTS, SAMPLED_A_PIVOT, LENGTH_CLASSES = 4096, 16, 16
#: Slack of an angle, and of a product's bound, for rounding.
ANGLE_SLACK, SLACK, LONG = 2e-6, 1e-9, (1 << 63) - 1
HIT = "q_row long, query_id long, id long, score long, more double"


def finite(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, x (array<double>): the rows that take part."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.where(F.col(id_).isNotNull() & F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_).cast("long").alias("id"), x.alias("x"))


def matrix(column: pd.Series, width: int) -> np.ndarray:
    """Rows cut or filled up with zeros to one width."""
    out = np.zeros((len(column), width))
    for i, row in enumerate(column):
        out[i, : min(len(row), width)] = row[:width]
    return out


def whole_numbers(column: pd.Series, scale: int = SCALE) -> list[np.ndarray]:
    """floor(scale * component), as doubles; infinite only where scale times a finite double is."""
    with np.errstate(over="ignore"):
        return [np.floor(np.asarray(row, float) * scale) for row in column]


def directions(heads: np.ndarray) -> np.ndarray:
    top = np.abs(heads).max(axis=1, initial=0.0, keepdims=True)  # first, so that squares don't overflow
    unit = np.divide(heads, top, out=np.zeros_like(heads), where=top > 0)
    size = np.sqrt((unit**2).sum(axis=1, keepdims=True))
    return np.divide(unit, size, out=np.zeros_like(unit), where=size > 0)


def pivots_of(sample: np.ndarray, n: int, rounds: int = 4, seed: int = 3) -> np.ndarray:
    """Up to n directions: a few rounds of spherical k-means from a seeded start, over a bounded sample."""
    distinct = np.unique(np.round(directions(sample), 9), axis=0)
    rng = np.random.default_rng(seed)
    own = distinct[rng.choice(len(distinct), min(n, len(distinct)), replace=False)]
    for _ in range(rounds):
        to = nearest(distinct, own)
        total = np.zeros_like(own)
        np.add.at(total, to, distinct)
        total[np.bincount(to, minlength=len(own)) == 0] = own[np.bincount(to, minlength=len(own)) == 0]
        own = directions(total)
    return own


def nearest(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.concatenate([np.empty(0, int), *((unit[a : a + 4096] @ pivots.T).argmax(axis=1) for a in range(0, len(unit), 4096))])


class Cells:
    """Where vectors belong, and what their summaries bound. Angles are those of the first `width` components;
    a longer vector's angle to a pivot counts all of it, for the pivot has zeros there."""

    def __init__(self, pivots: np.ndarray, longest: float):
        self.pivots, self.width, self.longest = pivots, pivots.shape[1], longest

    def place(self, x: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, angle to its pivot and length of each vector, all by its whole numbers."""
        rows = whole_numbers(x)
        length = np.array([np.hypot.reduce(r) if len(r) else 0.0 for r in rows])
        heads = directions(matrix(pd.Series(rows, dtype=object), self.width))
        cell = nearest(heads, self.pivots)
        cosine = (heads * self.pivots[cell]).sum(axis=1)
        # The head's share of the whole length; a vector of zeros is at any angle.
        share = np.array([np.hypot.reduce(r[: self.width]) / n if 0 < n < np.inf else 0.0 for r, n in zip(rows, length, strict=True)])
        angle = np.where((length > 0) & (length < np.inf), np.arccos(np.clip(cosine * share, -1, 1)), np.pi)
        with np.errstate(divide="ignore", invalid="ignore"):
            below = np.nan_to_num(np.floor(np.log2(self.longest / length)), nan=0.0, posinf=LENGTH_CLASSES, neginf=0.0)
        return cell * LENGTH_CLASSES + np.clip(below, 0, LENGTH_CLASSES - 1).astype(int), angle, length

    def bounds(self, x: pd.Series, cells: pd.DataFrame) -> np.ndarray:
        """An upper bound of the product of each query with anything in each cell."""
        rows = whole_numbers(x)
        length = np.array([np.hypot.reduce(r) if len(r) else 0.0 for r in rows])[:, None]
        share = np.array([np.hypot.reduce(r[: self.width]) / n if 0 < n < np.inf else 1.0 for r, n in zip(rows, length[:, 0], strict=True)])
        cosine = directions(matrix(pd.Series(rows, dtype=object), self.width)) @ self.pivots[cells["cell"].to_numpy() // LENGTH_CLASSES].T
        apart = np.maximum(0.0, np.arccos(np.clip(cosine * share[:, None], -1, 1)) - cells["angle"].to_numpy() - ANGLE_SLACK)
        most = np.cos(apart)
        with np.errstate(invalid="ignore", over="ignore"):
            up = length * np.where(most > 0, cells["longest"].to_numpy(), cells["shortest"].to_numpy()) * most
            return np.nan_to_num(up + np.abs(up) * SLACK + 1, nan=np.inf, posinf=np.inf)


def exact(rows: list[np.ndarray], raw: list, scale: int = SCALE) -> np.ndarray:
    """Python's integers, for components of any size."""
    return np.array([[int(v) if np.isfinite(v) else int(r) * scale for v, r in zip(own, given, strict=True)] for own, given in zip(rows, raw, strict=True)], dtype=object)


def best(q: pd.DataFrame, own: pd.DataFrame, k: int) -> Iterator[pd.DataFrame]:
    """The k best (score desc, id asc) of own (row, id, x) for each query of q (row, id, x), its own row left
    out; k for each kind of pair: vectors are multiplied with others of one length and order of size at once."""

    def kinds(frame: pd.DataFrame) -> Iterator[tuple[bool, int, pd.DataFrame, list[np.ndarray]]]:
        rows = whole_numbers(frame["x"])
        big = np.array([len(r) > 0 and not np.abs(r).max() * np.sqrt(len(r)) < 2**26 for r in rows], bool)
        size = np.array([len(r) for r in rows])
        for b, n in sorted({(bool(b), int(n)) for b, n in zip(big, size, strict=True)}):
            at = np.flatnonzero((big == b) & (size == n))
            yield b, n, frame.iloc[at], [rows[i] for i in at]

    own = own.sort_values(["id", "row"], kind="stable")
    right = list(kinds(own))
    for q_big, q_width, asks, q_rows in kinds(q):
        for x_big, x_width, found, x_rows in right:
            width = min(q_width, x_width)
            if q_big or x_big:
                cut = lambda rows, frame: exact([r[:width] for r in rows], [x[:width] for x in frame["x"]]).reshape(len(rows), width)  # noqa: B023, E731
                left, x = cut(q_rows, asks), cut(x_rows, found)
            else:  # each sum is below 2**52
                left, x = np.stack(q_rows)[:, :width], np.stack(x_rows)[:, :width]
            ids, rows = found["id"].to_numpy(), found["row"].to_numpy()
            for a in range(0, len(asks), 256):
                scores = left[a : a + 256] @ x.T if width else np.zeros((len(left[a : a + 256]), len(x)))
                out: list[list] = [[], [], [], [], []]
                for score, q_row, q_id in zip(scores, asks["row"].to_numpy()[a:], asks["id"].to_numpy()[a:], strict=False):
                    at = np.flatnonzero(rows != q_row)
                    score = score[at]
                    if len(score) > k:  # all that reach the k-th score, then the first k in order
                        floor = sorted(score)[-k] if score.dtype == object else np.partition(score, len(score) - k)[len(score) - k]
                        up = np.flatnonzero(score >= floor)
                        at, score = at[up], score[up]
                    order = np.argsort(-score, kind="stable")[:k]  # ids are in order already
                    whole = [int(s) for s in score[order]]
                    held = [max(-LONG, min(LONG, s)) for s in whole]
                    more = [0.0 if s == h else float(s) if abs(s) < 1 << 1023 else np.copysign(np.inf, s) for s, h in zip(whole, held, strict=True)]
                    for column, values in zip(out, ([q_row] * len(held), [q_id] * len(held), ids[at][order], held, more), strict=True):
                        column.extend(values)
                yield pd.DataFrame(dict(zip(("q_row", "query_id", "id", "score", "more"), (np.array(c, t) for c, t in zip(out, ("i8", "i8", "i8", "i8", "f8"), strict=True)), strict=True)))


def top_k(vectors: DataFrame, k: int = K, every: int = 100, id_: str = "vec_id", vector: str = "embedding", report: dict | None = None) -> DataFrame:
    """Queries are the rows whose id is divisible by `every` -> query_id, rank, vec_id, score. A report gets
    `visited` and `pairs`: how many pairs of a query and a row the bounds left, and how many there are."""
    spark = vectors.sparkSession
    rows = written(finite(vectors, id_, vector).withColumn("row", F.monotonically_increasing_id()), "voronoi-rows")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    many = int(min(MOST_PIVOTS, max(1, n**0.5)))
    share = min(1.0, 2.0 * SAMPLED_A_PIVOT * many / n)
    unit = F.xxhash64("row", F.lit(7))
    sample = rows.where(F.pmod(unit, F.lit(1_000_003)) <= share * 1_000_003).orderBy(unit).limit(SAMPLED_A_PIVOT * many).toPandas()
    sample = sample if len(sample) else rows.limit(SAMPLED_A_PIVOT * many).toPandas()
    width = max(1, int(sample["x"].map(len).mode().iloc[-1]))
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + (v * SCALE) * (v * SCALE)))
    longest = rows.agg(F.max(length)).first()[0]
    cells_of = Cells(pivots_of(matrix(sample["x"], width), many), float(longest) or 1.0)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            if len(frame):
                cell, angle, size = cells_of.place(frame["x"])
                yield frame.assign(cell=cell.astype("i4"), angle=angle, length=size)

    placed = written(rows.mapInPandas(place, "id long, x array<double>, row long, cell int, angle double, length double"), "voronoi-cells")
    # At most MOST_PIVOTS * LENGTH_CLASSES rows.
    cells = placed.groupBy("cell").agg(F.max("angle").alias("angle"), F.max("length").alias("longest"), F.min("length").alias("shortest"), F.count("*").alias("n")).orderBy("cell").toPandas()
    ids, counts = cells["cell"].to_numpy(), cells["n"].to_numpy()
    split = spark.createDataFrame([(int(c), max(1, -(-int(m) // BLOCK)), int(m)) for c, m in zip(ids, counts, strict=True)], "cell int, blocks int, n long")
    queries = placed.where(F.col("id") % every == 0).select("row", "id", "x")

    def visits(first: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in batches:
                for a in range(0, len(whole), 256):
                    frame = whole.iloc[a : a + 256]
                    up = cells_of.bounds(frame["x"], cells)
                    order = np.argsort(-up, axis=1, kind="stable")
                    # The first cells, by bound, that hold k rows besides the query.
                    need = np.cumsum(counts[order], axis=1) - counts[order] <= k
                    early = np.zeros_like(need)
                    np.put_along_axis(early, order, need, axis=1)
                    go = early if first else ~early & (up >= frame["floor"].to_numpy()[:, None])
                    q, c = np.nonzero(go)
                    yield pd.DataFrame({"row": frame["row"].to_numpy()[q], "id": frame["id"].to_numpy()[q], "x": frame["x"].to_numpy()[q], "cell": ids[c].astype("i4")})

        return run

    def search(visit: DataFrame, name: str) -> DataFrame:
        """visit (row, id, x, cell) -> HIT: k for each query, block and kind of pair."""
        visit = visit.join(F.broadcast(split), "cell")
        turns = visit.groupBy("cell").agg(F.ceil(F.count("*") / TURN).cast("int").alias("turns"))  # a row a cell
        if report is not None:
            report["visited"] = report.get("visited", 0) + (visit.agg(F.sum("n")).first()[0] or 0)
        ask = visit.join(F.broadcast(turns), "cell")
        ask = ask.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("row"), F.col("turns")).cast("int").alias("turn"), "row", "id", "x", F.lit(True).alias("asks"))
        data = placed.join(F.broadcast(turns), "cell").join(F.broadcast(split), "cell")
        data = data.select("cell", F.pmod(F.xxhash64("row", F.lit(1)), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "row", "id", "x", F.lit(False).alias("asks"))

        def local(frame: pd.DataFrame) -> pd.DataFrame:
            found = list(best(frame[frame["asks"]], frame[~frame["asks"]], k))
            return pd.concat(found) if found else pd.DataFrame({c.split()[0]: [] for c in HIT.split(", ")})

        return written(ask.unionByName(data).groupBy("cell", "block", "turn").applyInPandas(local, HIT), name)

    def ranked(found: DataFrame) -> DataFrame:
        """The k best of each query, of k for each block that it visited; in two steps, for blocks may be many."""
        best_k = F.slice(F.array_sort(F.collect_list("hit")), 1, k)
        hits = found.select("q_row", "query_id", F.pmod(F.xxhash64("id"), F.lit(16)).alias("part"), F.struct((-F.col("score")).alias("less"), (-F.col("more")).alias("more"), "id").alias("hit"))
        some = hits.groupBy("q_row", "query_id", "part").agg(best_k.alias("hits"))
        return some.select("q_row", "query_id", F.explode("hits").alias("hit")).groupBy("q_row", "query_id").agg(best_k.alias("top"))

    near = search(queries.mapInPandas(visits(True), "row long, id long, x array<double>, cell int"), "voronoi-near")
    last = F.element_at("top", k)
    floors = ranked(near).where(F.size("top") == k).select(F.col("q_row").alias("row"), F.when(last["more"] != 0, -last["more"]).otherwise((-last["less"]).cast("double")).alias("floor"))
    asked = queries.join(floors, "row", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    rest = search(asked.mapInPandas(visits(False), "row long, id long, x array<double>, cell int"), "voronoi-rest")
    if report is not None:
        report["pairs"] = n * queries.count()
    final = ranked(near.unionByName(rest)).select("query_id", F.posexplode("top").alias("at", "hit"))
    return final.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.less")).alias("score"))
