"""Conversation repair against every series of edits, and the query against a plain run."""

import hashlib
import random
import re
import zlib
from itertools import groupby, product

import pytest

pytest.importorskip("docgrain.llm.queries")
from docgrain.llm import repair
from docgrain.llm.queries import QUERIES

PATTERN = re.compile(r"(s?(ua)+)?")
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def plain_faults(rows):
    out = []
    for k, (_, role, text) in enumerate(rows):
        words = BLANK.findall(text)
        again = any((r, x) == (role, text) for _, r, x in rows[:k])
        out.append("blank" if not words else "duplicate" if again else "truncated" if words[-1] not in ".!?" else "")
    return out


def plain_best(rows, inserted=2):
    """The least (cost, audit) over every series of edits, and the rows it makes."""
    found = plain_faults(rows)
    choices = []
    for (_, role, text), fault in zip(rows, found, strict=True):
        more = 5 if fault == "truncated" else 0
        own = [("D", 2, None)]
        if fault not in ("blank", "duplicate"):
            own += [("K", more, (role, text))] + [("R", 1 + more, (r, text)) for r in ("user", "assistant")]
        before = [x for n in range(inserted + 1) for x in product(("user", "assistant"), repeat=n)]
        choices.append([(b, e) for b in before for e in own])
    tails = [x for n in range(3) for x in product(("user", "assistant"), repeat=n)]
    best = None
    for series in product(*choices):
        for tail in tails:
            audit, cost, out = "", 0, []
            for before, (letter, price, row) in series:
                audit, cost = audit + "I" * len(before) + letter, cost + 5 * len(before) + price
                out += [(r, "") for r in before] + ([row] if row else [])
            audit, cost = audit + "I" * len(tail), cost + 5 * len(tail)
            out += [(r, "") for r in tail]
            if all(r for r, _ in out) and PATTERN.fullmatch("".join(r[0] for r, _ in out)):
                best = min(best or (cost, audit, out), (cost, audit, out))
    return best


def odd_rows(rng, n):
    turns = sorted(rng.choice([None, 1, 2, 3, 7, 9]) or -1 for _ in range(n))
    return [(None if t < 0 else t, rng.choice(["user", "assistant", "assistant", "system", "tool", "", "ustad"]), rng.choice(["Yes.", "No", " ", "", "Why? \n", "One. Two", "So!"])) for t in turns]


@pytest.mark.parametrize("seed", range(150))
def test_the_agenda_finds_the_lightest_of_all(seed):
    rng = random.Random(seed)
    rows = odd_rows(rng, rng.randrange(0, 4))
    found = repair.faults(rows)
    assert found == plain_faults(rows)
    ((cost, audit),) = repair.agenda([(r[1][:1], f) for r, f in zip(rows, found, strict=True)], repair.START, True).values()
    out = [(x["role"], x["text"]) for x in repair.edited(rows, repair.START, audit)]
    assert (cost, audit, out) == plain_best(rows, 1 if len(rows) > 2 else 2)


@pytest.mark.parametrize("seed", range(120))
def test_parts_join_to_the_same_path(seed):
    rng = random.Random(seed)
    rows = odd_rows(rng, rng.randrange(1, 30))
    found = repair.faults(rows)
    edits = [(r[1][:1], f) for r, f in zip(rows, found, strict=True)]
    ((cost, audit),) = repair.agenda(edits, repair.START, True).values()
    cuts = sorted({0, len(edits), *(rng.randrange(1, len(edits) + 1) for _ in range(rng.randrange(5)))})
    items = [[repair.agenda(edits[a:b], q, False) for q in range(4)] for a, b in zip(cuts, cuts[1:], strict=False)]
    listed = [[(p, q, g[q][0], sorted(g, key=lambda x, g=g: g[x][1]).index(q)) for p, g in enumerate(part) for q in g] for part in items]
    total, steps, tail = repair.path(listed)
    assert (total, "".join(part[p][q][1] for part, (p, q) in zip(items, steps, strict=True)) + tail) == (cost, audit)


def plain_query(rows):
    """(conv_id, turn, role, text) -> the contract's rows, in one place."""
    show = lambda v: " " if v is None else str(v)
    kept = []
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        text = "" if fault == 1 else re.sub(r"[.!?]", "", text) if fault == 2 else text
        kept += [(conv, turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    out = {conv: (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for conv, *_ in rows}
    key = lambda r: (r[0] is not None, r[0] or 0)
    for conv, group in groupby(sorted(kept, key=lambda r: (key(r), r[1] is not None, r[1] or 0, r[2], r[3])), lambda r: r[0]):
        part = [r[1:] for r in group]
        found = plain_faults(part)
        turns = {t for t, _, _ in part if t is not None}
        initials = [r[:1] for _, r, _ in part]
        ((cost, audit),) = repair.agenda([(i, f) for i, f in zip(initials, found, strict=True)], repair.START, True).values()
        text = "\n".join(f"{x['role']}:{x['text']}" for x in repair.edited(part, repair.START, audit))
        out[conv] = (
            conv,
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *(found.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:], strict=False)),
            cost,
            audit,
            hashlib.sha256(text.encode()).hexdigest(),
        )
    return sorted(out.values(), key=key)


def conversations():
    rng = random.Random(9)
    rows = []
    for conv in [None, *range(60)]:
        n = 400 if conv == 7 else rng.randrange(1, 9)
        for t in range(n):
            rows.append((conv, None if rng.random() < 0.05 else t, rng.choice(["user", "assistant"]) if t % 5 == 0 else ("user", "assistant")[t % 2], f"{rng.choice(['So it is', 'Yes', 'No', ' '])} {rng.randrange(40)}{rng.choice(['.', '?', '', '!'])}"))
    rows += [(61, None, None, None), (62, 3, "user", "x" * 100_000), (63, 1, "system", "All the same.")]
    rows += [(64, 1, "user", "A copy.")] * 300  # repeated rows
    return rows


@pytest.mark.parametrize("part_rows", [repair.PART, 7, 1])
def test_repair_equals_a_plain_run(spark, part_rows):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = repair.repaired_conversations(repair.damaged(df), df, part_rows).collect()
    assert sorted(map(tuple, got), key=lambda r: (r[0] is not None, r[0] or 0)) == plain_query(rows)


def test_query(spark, tmp_path):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS part", "'x' AS cost", "2 AS copy", "3 AS rows")
    df.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op11_conversation_repair"](spark, str(tmp_path))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=lambda r: (r[0] is not None, r[0] or 0)) == plain_query(rows)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert QUERIES["op11_conversation_repair"](spark, str(tmp_path)).count() == 0
