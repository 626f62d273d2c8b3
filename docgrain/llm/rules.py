"""Quality rules: an isolation forest on rule statistics (operator 3).

A text's rule statistics (word length, symbols, repeated lines and word windows, case, marks) are a point;
random splits isolate odd points in few steps. The forest grows on a bounded sample of labelled rows of
good quality, and the score from which a document is rejected is calibrated on the labelled sample: the
one that separates best while at most `most_lost` of the good rows are rejected. Fixed base rules
reject by themselves.

One pass over whole texts computes the statistics and the verdict. `labelled` bounds the sample of
labels by hash order; it is all that the driver sees.

Defined results: null text has no words and fails the base rules; without labelled rows of good quality
there is no forest and the base rules alone decide; without rows of bad quality only `most_lost` sets
the threshold; repeated rows are each judged alone, and in the fit the least text of a doc_id and the lowest of its
labels count; a score of just the threshold is kept; texts of any length are read whole; columns of docs other
than doc_id and text are not read (`passing` hands all of them on).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrain.llm.common import labelled_texts, text_batches

LABELLED, TREES, TREE_ROWS, MOST_LOST = 20_000, 100, 256, 0.005
LEAST_MARGIN = 0.02
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
UPPER = bytes(range(65, 91))


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of `width` words which occurs twice or more; numbers stand for words."""
    n = len(words)
    if n <= width:
        return 0
    ids = pd.factorize(np.array(words, object))[0].astype("i8")
    code, most = ids[: n - width + 1], int(ids.max()) + 1
    for k in range(1, width):
        if most and int(code.max()) >= (1 << 62) // most:
            code = np.unique(code, return_inverse=True)[1]
        code = code * most + ids[k : n - width + 1 + k]
    _, back, times = np.unique(code, return_inverse=True, return_counts=True)
    twice = times[back] > 1
    covered = np.zeros(n, bool)
    for k in range(width):
        covered[k : n - width + 1 + k] |= twice
    return int(covered.sum())


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """The base statistics, and the forest's point."""
    words = text.split()
    n = len(words)
    space = sum(text.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    chars = len(text) if text.isascii() else len(text.decode("utf-8", "replace"))
    word_chars = chars - space
    symbols = sum(text.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    upper = len(text) - len(text.translate(None, UPPER))
    marks = sum(text.count(c) for c in (b"!", b"?", b"=", b"/", b"\\", b"{", b"}", b"[", b"]", b"_", b"~", b"^"))
    # Shares lean towards 0 in short texts, where a single line or number would make a large one.
    share = lambda x, of, lean: x / (of + lean)
    point = [share(word_chars, n, 0.1), share(symbols, n, 50), share(dup, len(lines), 20), share(repeat, n, 200), share(upper, n, 50), share(marks, n, 50)]
    return [n, word_chars, symbols, dup, repeat], point


def base_fails(n_words: int, n_repeat: int) -> bool:
    return n_words < 50 or 100 * n_repeat > 50 * n_words


class Forest:
    """Isolation trees in arrays; score 2**(-mean path / expected path), near 1 for what is odd."""

    def __init__(self, points: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.rows = min(rows, len(points))
        self.depth = max(1, int(np.ceil(np.log2(max(self.rows, 2)))) + 4)
        self.trees = [self.grow(points[rng.choice(len(points), self.rows, replace=False)], rng) for _ in range(trees)]
        self.threshold = np.inf

    @staticmethod
    def expected(n: int) -> float:
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def grow(self, points: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, at, left, right, path = [], [], [], [], []

        def node(own: np.ndarray, depth: int) -> int:
            i = len(feature)
            for column, value in ((feature, -1), (at, 0.0), (left, i), (right, i), (path, depth + self.expected(len(own)))):
                column.append(value)
            low, high = own.min(axis=0), own.max(axis=0)
            if depth < self.depth and len(own) > 1:
                f = int(rng.integers(points.shape[1]))
                # A split may fall outside what is seen (also of a feature that never varied), so that a
                # point beyond it is set apart at once.
                margin = max(0.5 * (high[f] - low[f]), LEAST_MARGIN)
                cut = rng.uniform(low[f] - margin, high[f] + margin)
                below = own[:, f] < cut
                feature[i], at[i] = f, cut
                left[i] = node(own[below], depth + 1) if below.any() else leaf(depth + 1)
                right[i] = node(own[~below], depth + 1) if not below.all() else leaf(depth + 1)
            return i

        def leaf(depth: int) -> int:
            i = len(feature)
            for column, value in ((feature, -1), (at, 0.0), (left, i), (right, i), (path, float(depth))):
                column.append(value)
            return i

        node(points, 0)
        return np.array(feature), np.array(at), np.array(left), np.array(right), np.array(path)

    def score(self, points: np.ndarray) -> np.ndarray:
        total, every = np.zeros(len(points)), np.arange(len(points))
        for feature, at, left, right, path in self.trees:
            node = np.zeros(len(points), int)
            for _ in range(self.depth + 1):
                f = feature[node]
                node = np.where(points[every, f] < at[node], left[node], right[node])
            total += path[node]
        return 2.0 ** (-total / len(self.trees) / max(self.expected(self.rows), 1e-9))


def sample(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = LABELLED) -> pd.DataFrame:
    """At most `rows` labelled documents (by hash order): their statistics and label."""
    few = labelled_texts(docs, labels, label, F.min, rows, 3, ("text",))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, pa.binary()):
            found = [statistics(t) for t in texts]
            point = pa.array([list(map(float, p)) for _, p in found], pa.list_(pa.float64()))
            fails = pa.array([base_fails(b[0], b[4]) for b, _ in found], pa.bool_())
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), batch.column("label"), fails, point], names=["doc_id", "label", "fails", "point"])

    return few.mapInArrow(measure, "doc_id long, label int, fails boolean, point array<double>").toPandas().sort_values("doc_id", kind="stable")


def fit(docs: DataFrame, labels: DataFrame, most_lost: float = MOST_LOST) -> Forest | None:
    rows = sample(docs, labels)
    rows = rows[~rows["fails"].astype(bool)] if len(rows) else rows
    good = rows[rows["label"] == 1] if len(rows) else rows
    if not len(good):
        return None
    forest = Forest(np.array(good["point"].tolist()))
    scores, bad = forest.score(np.array(rows["point"].tolist())), (rows["label"] != 1).to_numpy()
    fine = np.sort(scores[~bad])
    floor = fine[min(len(fine) - 1, int(np.ceil(len(fine) * (1 - most_lost))))]
    steps = np.unique(scores[scores >= floor])
    gains = [(scores[bad] > t).sum() / max(bad.sum(), 1) - (fine > t).sum() / len(fine) for t in steps]
    best = int(np.flatnonzero(np.isclose(gains, max(gains)))[-1])
    # half-way to the next higher score seen, so rows just beyond the threshold's own are kept too
    above = scores[scores > steps[best]]
    forest.threshold = float((steps[best] + above.min()) / 2) if len(above) else float(steps[best] + 1e-3)
    return forest


def verdicts(texts: list[bytes], forest: Forest | None) -> tuple[list[list[int]], np.ndarray, np.ndarray, np.ndarray]:
    """Base statistics, score (0 without a forest), base_failed, kept."""
    found = [statistics(t) for t in texts]
    failed = np.array([base_fails(b[0], b[4]) for b, _ in found], bool)
    score = forest.score(np.array([p for _, p in found])) if forest and found else np.zeros(len(found))
    return [b for b, _ in found], score, failed, ~failed & (score <= (forest.threshold if forest else np.inf))


def judge(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, the base statistics, base_failed, kept, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, pa.binary()):
            base, score, failed, kept = verdicts(texts, forest)
            columns = [pa.array([b[i] for b in base], pa.int64()) for i in range(5)]
            yield pa.record_batch([batch.column("doc_id"), *columns, pa.array(failed), pa.array(kept), pa.array(score)], names=["doc_id", *BASE, "base_failed", "kept", "score"])

    of = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {of}, {', '.join(f'{c} long' for c in BASE)}, base_failed boolean, kept boolean, score double")


def passing(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, pa.binary()):
            yield batch.filter(pa.array(verdicts(texts, forest)[3], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
