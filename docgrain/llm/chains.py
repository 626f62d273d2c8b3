"""Toxicity by a classifier chain (operator 10).

Categories are predicted one after another by linear models; each later model also gets the earlier
categories' probabilities. When it is trained, those are out-of-fold: predicted by models of the earlier
category that did not see the row, so that a later model does not trust them more than it should.

Features are hashed words, taken as present or not, so a single insult in a long text is not thinned
out, and hashed beginnings of words, by their share of the text (a language's insults may share a stem).
The models are fitted on a bounded sample of labelled rows (`LABELLED` by hash order, one row a doc_id), and every
text is scored whole: a batch is one matrix of the slots that some model uses.

Categories before the labelled one are derived from the label (see derived()): words and beginnings that tell the
toxic rows of a language apart are brought into families by the rows they share, and the families of
each language are dealt to the categories, which go in order of size. No word list is given.

Defined results: null text is empty and scored by the intercepts; without labelled rows, or with one
class only, the probabilities are that share and nothing is toxic unless all rows are; repeated rows are
scored each alone, and of the texts of one labelled doc_id the least counts; of repeated labels the highest
counts; ties of markers go to the lower slot; texts of any length are read whole, in chunks of bounded size; columns of
docs other than doc_id, text and (for fitting, where there is one) lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrain.llm.common import by_bytes, labelled_texts

LABELLED, FOLDS, SELECTED, RIDGE = 8_000, 4, 200, 0.3
#: Slots of words, and as many of beginnings; entries of the cache, and the bytes of a word that may be in it.
HALF, CACHED_WORDS, CACHED_BYTES = 1 << 17, 300_000, 64
PREFIXES, FULL_SHARE = (4, 5, 6, 7), 0.03
STRIP = ".,;:!?|()[]{}\"'#*$%&<>-_"
#: Derived categories; a marker's least share of the toxic rows of its language, and of toxic ones among its rows.
CATEGORIES, MARKER_SHARE, MARKER_PURITY, MARKERS = 3, 0.03, 0.8, 200


def slot_of(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace")) % HALF


def slots_of(word: bytes) -> tuple[int, ...]:
    """The slot of a word, and those of its beginnings where it is longer than they are."""
    plain = word.decode("utf-8", "replace").strip(STRIP).lower()
    return slot_of(plain), *(HALF + slot_of(plain[:n]) for n in PREFIXES if len(plain) > n)


class Slots(dict):
    """word -> its slots, of those that are wanted (all, if None); a bounded cache of words of bounded length."""

    def __init__(self, wanted: set[int] | None = None):
        super().__init__()
        self.wanted = wanted

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        found = slots_of(word)
        found = found if self.wanted is None else tuple(s for s in found if s in self.wanted)
        if len(word) <= CACHED_BYTES:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = found
        return found


def features(texts: pa.Array, cache: Slots) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, slot, value, in order of row and slot: 1 for a word that is there; a beginning's share of the text's
    words, FULL_SHARE and more as 1."""
    cut = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    sizes = pc.list_value_length(cut).to_numpy(zero_copy_only=False)
    coded = pc.list_flatten(cut).dictionary_encode()
    codes, row = coded.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(texts)), sizes)
    names = coded.dictionary.cast(pa.binary()).to_pylist()
    own = [cache[w] if w else () for w in names]
    filled = np.array([bool(w) for w in names], bool)
    words = np.bincount(row[filled[codes]], minlength=len(texts)) if len(codes) else np.zeros(len(texts), int)
    # Only words with slots are counted on: few, where only some slots are wanted.
    many = np.array([len(s) for s in own], int)
    held = many[codes] > 0 if len(codes) else np.zeros(0, bool)
    pair, times = np.unique(row[held] * max(len(names), 1) + codes[held], return_counts=True)
    row, code = pair // max(len(names), 1), pair % max(len(names), 1)
    first, flat = np.cumsum(many) - many, np.array([x for s in own for x in s], "i8")
    n = many[code]
    slot = flat[np.repeat(first[code] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    key, back = np.unique(np.repeat(row, n) * (2 * HALF) + slot, return_inverse=True)
    count = np.bincount(back, weights=np.repeat(times, n), minlength=len(key))
    row, slot = key // (2 * HALF), key % (2 * HALF)
    return row, slot, np.where(slot < HALF, 1.0, np.minimum(1.0, count / np.maximum(words[row], 1) / FULL_SHARE)).astype("f4")


class Rows:
    """Feature rows laid end to end."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]]):
        self.n, self.row = len(parts), np.repeat(np.arange(len(parts), dtype="i4"), [len(p[0]) for p in parts])
        self.slot = np.concatenate([np.empty(0, "i4"), *(p[0] for p in parts)]).astype("i4")
        self.value = np.concatenate([np.empty(0, "f4"), *(p[1] for p in parts)])

    def some(self, at: np.ndarray) -> Rows:
        out, place = Rows([]), np.full(self.n, -1, "i4")
        place[at] = np.arange(len(at), dtype="i4")
        own = place[self.row] >= 0
        out.n, out.row, out.slot, out.value = len(at), place[self.row[own]], self.slot[own], self.value[own]
        return out

    def matrix(self, slots: np.ndarray) -> np.ndarray:
        """Dense, with a column for each of the sorted slots."""
        x = np.zeros((self.n, len(slots)))
        at = np.searchsorted(slots, self.slot)
        own = at < len(slots)
        own[own] = slots[at[own]] == self.slot[own]
        x[self.row[own], at[own]] = self.value[own]
        return x


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Linear:
    """Logistic regression on the slots that tell the classes apart best, and on a few dense inputs."""

    def __init__(self, dense: int):
        self.slots, self.w, self.d, self.b = np.empty(0, "i8"), np.empty(0), np.zeros(dense), 0.0

    def fit(self, rows: Rows, dense: np.ndarray, labels: np.ndarray, most: int = SELECTED, ridge: float = RIDGE, steps: int = 8) -> Linear:
        """Newton's steps with a ridge on at most `most` slots."""
        share = labels.mean() if len(labels) else 0.0
        self.b = float(np.log((share + 1e-4) / (1 - share + 1e-4)))
        if not 0 < share < 1:
            return self
        # How far a slot's mean value under the label is from its mean elsewhere, in standard errors.
        n1, n0 = labels.sum(), (1 - labels).sum()
        total = lambda v: np.bincount(rows.slot, weights=v, minlength=2 * HALF)
        one, all_, square = total(rows.value * labels.astype("f4")[rows.row]), total(rows.value), total(rows.value**2) / rows.n
        spread = np.sqrt(np.maximum(square - (all_ / rows.n) ** 2, 0) * (1 / n1 + 1 / n0)) + 1e-3
        gain = np.abs(one / n1 - (all_ - one) / n0) / spread
        self.slots = np.sort(np.argsort(-gain, kind="stable")[:most])
        x = np.column_stack([rows.matrix(self.slots), dense, np.ones(rows.n)])
        w = np.zeros(x.shape[1])
        pull = np.full(len(w), ridge)
        pull[-1] = 1e-6
        for _ in range(steps):
            p = sigmoid(x @ w)
            h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(pull)
            w -= np.linalg.solve(h, x.T @ (p - labels) + pull * w)
        self.w, self.d, self.b = w[: len(self.slots)], w[len(self.slots) : -1], float(w[-1])
        return self

    def probability(self, rows: Rows, dense: np.ndarray) -> np.ndarray:
        return sigmoid(rows.matrix(self.slots) @ self.w + dense @ self.d + self.b)


class Chain:
    def __init__(self, names: list[str]):
        self.names, self.models, self.threshold = names, [], 0.5

    def fit(self, rows: Rows, labels: np.ndarray, folds: int = FOLDS) -> Chain:
        """labels: a column for each category, in the chain's order; the last decides."""
        fold = np.random.default_rng(folds).permutation(rows.n) % folds
        earlier = np.zeros((rows.n, 0))
        for k in range(len(self.names)):
            out = np.zeros(rows.n)
            for f in range(folds):
                seen, held = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                out[held] = Linear(k).fit(rows.some(seen), earlier[seen], labels[seen, k]).probability(rows.some(held), earlier[held])
            self.models.append(Linear(k).fit(rows, earlier, labels[:, k]))
            earlier = np.column_stack([earlier, out])
        # The threshold with the best F1 on the out-of-fold probabilities of the last category.
        last, true = earlier[:, -1], labels[:, -1] > 0
        if 0 < true.sum() < len(true):
            order = np.argsort(-last, kind="stable")
            hits = np.cumsum(true[order])
            f1 = 2 * hits / (np.arange(1, len(true) + 1) + true.sum())
            best = int(np.argmax(f1))
            low = last[order[best]]
            below = last[order[best + 1]] if best + 1 < len(order) else 0.0
            self.threshold = float((low + below) / 2)
        return self

    def wanted(self) -> set[int]:
        return {int(s) for m in self.models for s in m.slots}

    def probabilities(self, rows: Rows) -> np.ndarray:
        """A column for each category."""
        out = np.zeros((rows.n, 0))
        for model in self.models:
            out = np.column_stack([out, model.probability(rows, out)])
        return out


def derived(rows: Rows, toxic: np.ndarray, langs: list, n: int = CATEGORIES) -> np.ndarray:
    """A column of toxic rows for each category, largest first.

    In each language a marker is a slot in enough of the toxic rows and in few others. Markers that share most of
    their rows are one family (the less they need to share, the fewer families; as many as categories at least, if
    there are so many markers); each family, the widest first, goes to the category that holds fewest rows yet."""
    columns = np.zeros((rows.n, n), bool)
    of = np.array([repr(x) for x in langs])
    for lang in sorted(set(of.tolist())):
        own = of == lang
        bad = np.flatnonzero(own & toxic)
        mine = own[rows.row]
        inside, outside = (np.bincount(rows.slot[mine & (toxic[rows.row] == t)], minlength=2 * HALF) for t in (True, False))
        fit = (inside >= max(2, MARKER_SHARE * len(bad))) & (inside >= MARKER_PURITY * (inside + outside))
        marks = np.flatnonzero(fit)
        marks = marks[np.argsort(-inside[marks], kind="stable")][:MARKERS]
        has = rows.some(bad).matrix(np.sort(marks))[:, np.searchsorted(np.sort(marks), marks)] > 0
        for near in (0.3, 0.6, 0.9, 1.1):
            families: list[np.ndarray] = []
            for column in has.T:
                shared = [(column & f).sum() / max((column | f).sum(), 1) for f in families]
                if shared and max(shared) >= near:
                    families[int(np.argmax(shared))] |= column
                else:
                    families.append(column.copy())
            if len(families) >= n:
                break
        held = np.zeros((len(bad), n), bool)
        for family in sorted(families, key=lambda f: -int(f.sum())):
            held[:, int(np.argmin(held.sum(axis=0)))] |= family
        columns[bad] = held
    return columns[:, np.argsort(-columns.sum(axis=0), kind="stable")]


def names_of(label: str, n: int = CATEGORIES) -> list[str]:
    return [*(f"family_{k + 1}" for k in range(n)), label]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", labelled: int = LABELLED) -> Chain | None:
    """docs (doc_id, text, lang if there is one); the chain ends with `label` itself."""
    few = labelled_texts(docs if "lang" in docs.columns else docs.withColumn("lang", F.lit(None).cast("string")), labels, label, F.max, labelled, 10, ("text", "lang"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Slots()
        for batch in by_bytes(batches):
            row, slot, value = features(batch.column("text"), cache)
            bounds = np.searchsorted(row, np.arange(batch.num_rows + 1))
            points = [pa.array([x[a:b].astype(t).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()) for x, t in ((slot, "i4"), (value, "f4"))]
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "label", "lang")), *points], names=["doc_id", "label", "lang", "at", "value"])

    # A bounded table; as Arrow, its bytes are held once.
    found = few.mapInArrow(measure, "doc_id long, label int, lang string, at binary, value binary").toArrow().sort_by("doc_id")
    if not len(found):
        return None
    rows = Rows([(np.frombuffer(a.as_buffer(), "i4"), np.frombuffer(v.as_buffer(), "f4")) for a, v in zip(found["at"], found["value"], strict=True)])
    toxic, langs = np.array(found["label"].to_pylist()) == 1, found["lang"].to_pylist()
    del found
    return Chain(names_of(label)).fit(rows, np.column_stack([derived(rows, toxic, langs), toxic]).astype(float))


def score(docs: DataFrame, fitted: Chain | None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, a probability p_<category> for each, toxic."""
    names = fitted.names if fitted else names_of("toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Slots(fitted.wanted() if fitted else set())
        for batch in by_bytes(batches):
            rows = Rows([])
            rows.n, (rows.row, rows.slot, rows.value) = batch.num_rows, features(batch.column("text"), cache)
            found = fitted.probabilities(rows) if fitted else np.zeros((rows.n, len(names)))
            verdict = found[:, -1] >= fitted.threshold if fitted else np.zeros(rows.n, bool)
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(c) for c in found.T), pa.array(verdict)], names=["doc_id", *(f"p_{n}" for n in names), "toxic"])

    of = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {of}, {', '.join(f'p_{n} double' for n in names)}, toxic boolean")
