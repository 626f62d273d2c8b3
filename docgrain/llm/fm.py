"""Quality classifier: a factorisation machine (operator 5).

Features are hashed words (share of the text, damped), structure statistics and metadata (length, and
whatever numeric columns the caller names). Pairwise interactions have low rank, and a row is scored in
time linear in its features by the sum-of-squares identity
    sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

The machine is fitted on a bounded sample of labelled training rows (`LABELLED`, by hash order); texts
are read and scored whole.

Defined results: null text is empty and is scored by its structure alone; without labelled rows every
score is 0.5; rows that repeat a doc_id are scored each alone, and in the fit the least of them counts; of
repeated labels the lowest counts; a text of any length is one row of at most 2**14 features; a score of just
the threshold is predicted 1; columns other than doc_id, text, n_chars and held_out are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrain.llm.common import labelled_texts, text_batches

LABELLED, BITS, RANK, EPOCHS, RATE, THRESHOLD, CACHED_WORDS, CACHED_BYTES = 6_000, 14, 4, 12, 0.05, 0.3, 400_000, 64
STRUCTURE = 12
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))


class Slots(dict):
    """word -> slot by hash; a bounded cache of words of bounded length."""

    def __init__(self, bits: int):
        super().__init__()
        self.mask = (1 << bits) - 1

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        slot = xxhash.xxh3_64_intdigest(word.strip(b".,;:!?|()[]\"'#*$%&").lower()) & self.mask
        if len(word) <= CACHED_BYTES:
            self[word] = slot
        return slot


def structure(text: bytes, words: list[bytes], lines: list[bytes], n_chars: float) -> list[float]:
    """Shares and logarithms, about 0 to 3 each, and the metadata's length."""
    n = max(len(words), 1)
    size = max(len(text), 1)
    count = lambda *signs: sum(text.count(s) for s in signs)
    return [
        1.0,
        np.log1p(len(words)) / 5,
        min(3.0, (size - count(b" ", b"\n")) / n / 5),
        3 * min(1.0, count(b"#", b"*", b"$", b"%", b"&", b"<", b">") / n),
        3 * min(1.0, count(b"|") / n),
        3 * min(1.0, count(b"!") / n),
        3 * (1 - len(set(lines)) / max(len(lines), 1)),
        3 * (1 - len(set(words)) / n),
        3 * (size - len(text.translate(None, UPPER))) / size,
        3 * (size - len(text.translate(None, DIGITS))) / size,
        np.log1p(len(lines)) / 4,
        np.log1p(max(n_chars, 0.0)) / 10,
    ]


def row(text: bytes, n_chars: float, slots: Slots, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: words first (square-root shares, unit length), then structure."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    ids = np.fromiter(map(slots.__getitem__, words), np.int64, len(words))
    found, times = np.unique(ids, return_counts=True)
    values = np.sqrt(times / max(len(words), 1))
    more = structure(text, words, lines, n_chars)
    return np.concatenate([found, (1 << bits) + np.arange(STRUCTURE)]), np.concatenate([values, more])


class Machine:
    def __init__(self, bits: int = BITS, rank: int = RANK, seed: int = 5):
        self.bits, n = bits, (1 << bits) + STRUCTURE
        self.w0, self.w = 0.0, np.zeros(n)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (n, rank))

    def raw(self, index: np.ndarray, value: np.ndarray) -> float:
        own = self.v[index] * value[:, None]
        return float(self.w0 + self.w[index] @ value + 0.5 * (own.sum(axis=0) ** 2 - (own**2).sum(axis=0)).sum())

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, decay: float = 1e-4, seed: int = 6) -> Machine:
        """AdaGrad on the logistic loss, one row at a time, in a seeded order."""
        rng = np.random.default_rng(seed)
        gw, gv, g0 = np.full(self.w.shape, 1e-2), np.full(self.v.shape, 1e-2), 1e-2
        share = labels.mean()
        self.w0 = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                index, value = rows[i]
                own = self.v[index] * value[:, None]
                total = own.sum(axis=0)
                raw = self.w0 + self.w[index] @ value + 0.5 * (total**2 - (own**2).sum(axis=0)).sum()
                err = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[i]
                dw = err * value + decay * self.w[index]
                dv = err * value[:, None] * (total - own) + decay * self.v[index]
                gw[index] += dw**2
                gv[index] += dv**2
                g0 += err**2
                self.w[index] -= rate * dw / np.sqrt(gw[index])
                self.v[index] -= rate * dv / np.sqrt(gv[index])
                self.w0 -= rate * err / np.sqrt(g0)
        return self

    def probability(self, index: np.ndarray, value: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(index, value), -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", labelled: int = LABELLED) -> Machine | None:
    """docs (doc_id, text, n_chars) of the training part; labels (doc_id, label)."""
    few = labelled_texts(docs, labels, label, F.min, labelled, 5, ("text", "n_chars"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots(BITS)
        for batch, texts in text_batches(batches, pa.binary()):
            found = [row(t, n or 0, slots) for t, n in zip(texts, batch.column("n_chars").to_pylist(), strict=True)]
            yield pa.record_batch(
                [batch.column("doc_id").cast(pa.int64()), batch.column("label"), pa.array([f[0].astype("i4").tobytes() for f in found], pa.binary()), pa.array([f[1].astype("f4").tobytes() for f in found], pa.binary())],
                names=["doc_id", "label", "at", "value"],
            )

    rows = few.mapInArrow(measure, "doc_id long, label int, at binary, value binary").collect()
    rows.sort(key=lambda r: r["doc_id"])
    if not rows:
        return None
    points = [(np.frombuffer(r["at"], "i4"), np.frombuffer(r["value"], "f4").astype(float)) for r in rows]
    return Machine().fit(points, np.array([float(r["label"] == 1) for r in rows]))


def score(docs: DataFrame, machine: Machine | None, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text, n_chars, held_out) -> doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots(BITS)
        for batch, texts in text_batches(batches, pa.binary()):
            lengths = batch.column("n_chars").to_pylist()
            scores = [machine.probability(*row(t, n or 0, slots)) if machine else 0.5 for t, n in zip(texts, lengths, strict=True)]
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    of = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "n_chars", "held_out").mapInArrow(run, f"doc_id {of}, held_out boolean, score double, predicted int")
