"""Personal data by weak supervision (operator 1).

Labelers (a regex form, a checksum, gazetteers, context words, what touches the span) vote on candidate
spans. Expectation-maximisation over the vote patterns of the whole corpus estimates how reliable each
labeler is and how likely each pattern marks personal data. A logistic span classifier is trained on those
soft labels, on features of its own: the span's character pieces with digits and letters levelled, what
touches it, and its neighbouring words, all hashed. It sees no votes, so it may take a span for which none
was cast, or leave one that several were cast for. Fixed base patterns always count; the classifier adds
spans that no base span of the text overlaps.

The driver sees counts by (kind, votes), at most 3**5 a kind, and `SAMPLED` candidates a kind, drawn by a
seeded hash, to fit the classifier.

Defined results: null text is empty and has no spans; a corpus without candidates gives a model that
adds none; rows that repeat a doc_id are each judged alone, and so is each of two equal texts; texts of any
length are read whole, in time in proportion to it; of spans that begin at one place the longer one is
redacted; of candidates that overlap, the first stays, ties go to the shorter, then to the lesser name of
a kind. Other columns of docs, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrain.llm.common import slices, text_batches

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("form", "check", "gazetteer", "context", "edges")
ACCEPT = 0.9
#: Hashed features of a span; candidates of a kind that the classifier is fitted on; its ridge.
SLOTS, SAMPLED, RIDGE = 512, 4_000, 1.0

# Gazetteers and context words of the labelers.
TLDS = frozenset("com org net edu gov mil int info biz io co ai app dev me tv de fr es it nl be ch at pt pl cz se no fi dk uk ie us ca mx br ar cl au nz in cn jp kr ru ua gr tr za".split())
CALLING_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
ISSUERS = re.compile("4|5[1-5]|2[2-7]|3[4-7]|6011|65")
NEAR = {
    "email": re.compile(r"e-?mail|mail|contact|write|reach", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|login|logged", re.I),
    "card": re.compile(r"card|visa|master|credit|debit|account|payment|pay\b", re.I),
    "phone": re.compile(r"phone|call|tel|fax|mobile|cell|whatsapp|reach|dial", re.I),
}
FAR = re.compile(r"version|\bv\.?$|isbn|issn|order|invoice|serial|section|chapter|page|build|release|sku|\bno\.?\s*$", re.I)

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LETTERS = re.compile(r"[^\W\d_]+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
#: Every base match of the numeric kinds lies in such a zone: their characters are the zone's.
ZONE = re.compile(r"[0-9+][0-9+ ().-]*")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SPELLED = re.compile(r"[ ]?(?:\(at\)|\[at\]|\{at\})[ ]?", re.I)
SPELLED_LOCAL = re.compile(r"[A-Za-z0-9._%+-]{1,64}$")
SPELLED_DOMAIN = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\.|[ ]?(?:\(dot\)|\[dot\]|\{dot\})[ ]?)[A-Za-z0-9-]{1,63}){1,8}", re.I)
BARE_PHONE = re.compile(r"(?<![\w+.-])(?:\([0-9]{2,4}\)[ ]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![\w-]|\.[0-9])")
LONG_NUMBER = re.compile(r"(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])")
SPLIT_IP = re.compile(r"(?<![\w.])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![\w.])")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def below_256(part: str) -> bool:
    """Of digits; compared as text, for a part may be longer than any number that int() takes."""
    value = part.lstrip("0")
    return len(value) < 3 or len(value) == 3 and value <= "255"


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches. A match's local part is all local characters before its @, so
    each @ is looked at once, and long runs without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        if at > done and (m := DOMAIN.match(text, at + 1)):
            first = at
            while first > done:  # in steps, so that a long run is cut at its first foreign character
                low = max(done, first - 64)
                foreign = [x.end() for x in NOT_LOCAL.finditer(text, low, first)]
                if foreign:
                    first = foreign[-1]
                    break
                first = low
            if first < at:
                yield first, m.end()
                done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The fixed patterns: spans by kind, in code points."""
    out = {k: [] for k in KINDS}
    out["email"] = list(base_emails(text))
    for zone in ZONE.finditer(text):
        a, b = zone.span()
        if b - a < 7:  # the shortest ip; a card has 16 characters, a phone 8 digits
            continue
        for m in IP.finditer(text, a, b):
            if all(below_256(p) for p in m.group().split(".")):
                out["ip"].append(m.span())
        for m in CARD.finditer(text, a, b):
            d = digits_of(m.group())
            if 16 <= len(d) <= 19 and luhn(d):
                out["card"].append(m.span())
        for m in PHONE.finditer(text, a, b):
            if 8 <= len(digits_of(m.group())) <= 15:
                out["phone"].append(m.span())
    return out


def more_spans(text: str, base: dict[str, list[tuple[int, int]]]) -> Iterator[tuple[str, int, int]]:
    """Wider candidates that no base span overlaps and that don't overlap each other."""
    taken = sorted(s for spans in base.values() for s in spans)
    found: list[tuple[int, int, str]] = []
    if "(" in text or "[" in text or "{" in text:
        for m in SPELLED.finditer(text):
            before, after = SPELLED_LOCAL.search(text, max(0, m.start() - 64), m.start()), SPELLED_DOMAIN.match(text, m.end())
            if before and after:
                found.append((before.start(), after.end(), "email"))
        found += [(*m.span(), "ip") for m in SPLIT_IP.finditer(text)]
    for zone in ZONE.finditer(text):
        a, b = zone.span()
        if b - a < 8:
            continue
        a = max(0, a - 1)  # an opening bracket
        found += [(*m.span(), "phone") for m in BARE_PHONE.finditer(text, a, b) if 9 <= len(digits_of(m.group())) <= 12]
        found += [(*m.span(), "card") for m in LONG_NUMBER.finditer(text, a, b)]
    end, i = 0, 0
    for a, b, kind in sorted(found):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if a >= end and not (i < len(taken) and taken[i][0] < b):
            yield kind, a, b
            end = b


def votes(kind: str, text: str, a: int, b: int) -> tuple[int, ...]:
    """+1 personal data, -1 not, 0 abstains; in the order of LABELERS."""
    s = text[a:b]
    d = digits_of(s)
    if kind == "email":
        parts = re.split(r"\.|[\s({\[]*dot[\s)}\]]*", s.lower())
        form = 1 if "@" in s else 0
        check = 1 if parts[-1].isalpha() and len(parts[-1]) >= 2 else -1
        gazetteer = 1 if parts[-1] in TLDS else -1
    elif kind == "ip":
        parts = re.split(r"\[?\.\]?", s)
        form = 1 if all(p == "0" or p[0] != "0" for p in parts) else -1
        check = 1 if all(map(below_256, parts)) else -1
        first = parts[0].lstrip("0").rjust(3, "0")
        gazetteer = -1 if first in ("000", "127") or len(first) > 3 or first > "239" else 1
    elif kind == "card":
        form = 1 if re.fullmatch(r"[0-9]{16}|(?:[0-9]{4}[ -]){3}[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}", s) else 0
        check = 1 if luhn(d) else -1
        gazetteer = 1 if ISSUERS.match(d) else -1
    else:
        form = 1 if s[0] == "+" or re.fullmatch(r"\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}", s) else 0
        check = 1 if 8 <= len(d) <= 15 else -1
        gazetteer = 0 if s[0] != "+" else 1 if any(d[:n] in CALLING_CODES for n in (1, 2)) else -1
    before = text[max(0, a - 32) : a]
    context = -1 if FAR.search(before) else 1 if NEAR[kind].search(before) else 0
    touching = [c for c in (text[a - 1 : a], text[b : b + 1]) if c.isalnum()]
    return form, check, gazetteer, context, -1 if touching else 1


def level(s: str) -> str:
    """Digits as 0, letters as a or A, the rest as it is."""
    return "".join("0" if c.isdigit() else ("A" if c.isupper() else "a") if c.isalpha() else c for c in s)


def features(kind: str, text: str, a: int, b: int) -> list[int]:
    """Slots of the span's own look and of its neighbours; the kind is in each."""
    s = level(text[a : min(b, a + 64)])
    before, after = text[max(0, a - 64) : a], text[b : b + 64]
    last, first = (LETTERS.findall(before.lower())[-2:], LETTERS.findall(after.lower())[:1])
    found = [f"len {min(b - a, 64) // 4}", f"digits {min(20, sum(c == '0' for c in s))}", f"touch {level(before[-1:])}|{level(after[:1])}"]
    found += [f"look {p}" for p in {s[i : i + 3] for i in range(max(1, len(s) - 2))}]
    found += [f"before {w[:12]}" for w in last] + [f"after {w[:12]}" for w in first]
    return sorted({xxhash.xxh3_64_intdigest(f"{kind} {f}".encode("utf-8", "replace")) % SLOTS for f in found})


def candidates(text: str) -> list[tuple[str, int, int, bool, str, list[int]]]:
    """(kind, start, end, is base, votes, slots) for every candidate, in order of kind and start."""
    base = base_spans(text)
    out = [(k, a, b, True) for k in KINDS for a, b in base[k]] + [(k, a, b, False) for k, a, b in more_spans(text, base)]
    out.sort(key=lambda c: (KINDS.index(c[0]), c[1], c[2]))
    return [(k, a, b, own, ",".join(map(str, votes(k, text, a, b))), features(k, text, a, b)) for k, a, b, own in out]


def candidate_rows(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, found: array of candidates; whole texts, one row for each row."""
    kind = "struct<kind:string,a:long,b:long,base:boolean,votes:string,slots:array<int>>"
    item = pa.struct([("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("base", pa.bool_()), ("votes", pa.string()), ("slots", pa.list_(pa.int32()))])
    names = [f.name for f in item]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            found = [[dict(zip(names, c, strict=True)) for c in candidates(t)] for t in texts]
            yield pa.record_batch([batch.column("doc_id"), pa.array(found, pa.list_(item))], names=["doc_id", "found"])

    of = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(find, f"doc_id {of}, found array<{kind}>")


class SpanModel:
    """EM over vote patterns, then a logistic classifier on its soft labels; one of each for each kind."""

    def __init__(self):
        self.reliability: dict[str, np.ndarray] = {}
        self.likely: dict[tuple[str, str], float] = {}
        self.weights: dict[str, np.ndarray] = {}

    def weigh(self, rows: list[tuple[str, str, int]], rounds: int = 50) -> SpanModel:
        """The label model; rows: (kind, votes, count)."""
        for kind in KINDS:
            own = [r for r in rows if r[0] == kind]
            if not own:
                continue
            patterns, counts = np.array([[int(v) for v in r[1].split(",")] for r in own]), np.array([r[2] for r in own], float)
            # Start from the majority; then class priors and each labeler's votes by class, in turn.
            p = 1 / (1 + np.exp(-1.5 * patterns.sum(axis=1)))
            for _ in range(rounds):
                log = []
                for q in (p, 1 - p):
                    w = counts * q
                    prior = (w.sum() + 1) / (counts.sum() + 2)
                    by_vote = np.stack([((patterns == v) * w[:, None]).sum(axis=0) + 1 for v in (-1, 0, 1)])
                    by_vote /= by_vote.sum(axis=0)
                    log.append(np.log(prior) + np.log(by_vote[patterns + 1, np.arange(len(LABELERS))]).sum(axis=1))
                    if q is p:
                        self.reliability[kind] = by_vote
                p = 1 / (1 + np.exp(np.clip(log[1] - log[0], -50, 50)))
            self.likely |= {(kind, r[1]): float(x) for r, x in zip(own, p, strict=True)}
        return self

    def fit(self, sample: list[tuple[str, str, list[int]]], steps: int = 12) -> SpanModel:
        """The classifier, by Newton's steps with a ridge; sample: (kind, votes, slots) of candidates."""
        for kind in KINDS:
            own = [r for r in sample if r[0] == kind]
            if not own:
                continue
            x, p = np.zeros((len(own), SLOTS + 1)), np.array([self.likely[r[0], r[1]] for r in own])
            for i, (_, _, slots) in enumerate(own):
                x[i, slots] = 1
            x[:, -1] = 1
            w, pull = np.zeros(SLOTS + 1), np.full(SLOTS + 1, RIDGE)
            pull[-1] = 1e-3
            for _ in range(steps):
                q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                h = (x * (q * (1 - q) + 1e-6)[:, None]).T @ x + np.diag(pull)
                step = np.linalg.solve(h, x.T @ (q - p) + pull * w)
                w -= step
                if np.abs(step).max() < 1e-6:
                    break
            self.weights[kind] = w
        return self

    def probability(self, kind: str, slots: list[int]) -> float:
        if kind not in self.weights:
            return 0.0
        w = self.weights[kind]
        return float(1 / (1 + np.exp(-np.clip(w[slots].sum() + w[-1], -30, 30))))


def fit(found: DataFrame, sampled: int = SAMPLED) -> SpanModel:
    """found: candidate_rows(); all of its candidates count for the label model."""
    each = found.select(F.explode("found").alias("c")).select("c.kind", "c.votes", "c.slots")
    counts = [tuple(r) for r in each.groupBy("kind", "votes").count().orderBy("kind", "votes").collect()]
    n = {k: sum(r[2] for r in counts if r[0] == k) for k in KINDS}
    sample = []
    for kind in [k for k in KINDS if n[k]]:
        # A share that surely holds the sample, so that only about so many rows are ordered.
        share = min(1.0, 2 * sampled / n[kind])
        own = found.select("doc_id", F.posexplode("found").alias("at", "c")).where(F.col("c.kind") == kind)
        unit = F.xxhash64("doc_id", "at", F.col("c.a"), F.lit(17))
        few = own.select("c.kind", "c.votes", "c.slots", unit.alias("u")).where(F.pmod("u", F.lit(1_000_003)) <= share * 1_000_003)
        sample += [(r["kind"], r["votes"], list(r["slots"])) for r in few.orderBy("u", "votes", "slots").limit(sampled).collect()]
    return SpanModel().weigh(counts).fit(sample)


def chosen(found: list, model: SpanModel, accept: float = ACCEPT) -> list[tuple[str, int, int]]:
    """The spans of a document: base ones, and the others that the classifier accepts."""
    return [(kind, a, b) for kind, a, b, base, _, slots in found if base or model.probability(kind, slots) >= accept]


def spans(found: DataFrame, model: SpanModel, accept: float = ACCEPT) -> DataFrame:
    """candidate_rows() -> doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans, n_added."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for row in batch.column("found").to_pylist():
                items = [(c["kind"], c["a"], c["b"], c["base"], c["votes"], c["slots"]) for c in row]
                base = [c[:3] for c in items if c[3]]
                all_ = chosen(items, model, accept)
                text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
                values = [*(sum(c[0] == k for c in base) for k in KINDS), hashlib.sha256(text.encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for k, a, b in all_), len(all_) - len(base)]
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], names=names)

    of = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(judge, f"doc_id {of}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redacted(docs: DataFrame, model: SpanModel, accept: float = ACCEPT) -> DataFrame:
    """docs with each span of `text` replaced by its kind in angle brackets; other columns stay, null
    texts too, and n_chars, where there is one, follows the text."""
    schema = docs.schema

    def swap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            new = []
            for text in texts:
                parts, end = [], 0
                for kind, a, b in sorted(chosen(candidates(text or ""), model, accept), key=lambda s: (s[1], -s[2])):
                    if a >= end:
                        parts += [text[end:a], f"<{kind}>"]
                    end = max(end, b)  # what overlaps the span before goes with it
                new.append(text if not parts else "".join(parts) + text[end:])
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if (n := batch.schema.get_field_index("n_chars")) >= 0:
                lengths = [None if t is None else len(t) for t in new]
                columns[n] = pa.array([old if t == u else size for old, t, u, size in zip(batch.column(n).to_pylist(), texts, new, lengths, strict=True)], batch.schema.field(n).type)
            yield pa.record_batch(columns, schema=batch.schema)

    return docs.mapInArrow(swap, schema)
