"""Conversation structure repair by Knuth's lightest-derivation agenda (operator 11).

A conversation should read `(s?(ua)+)?` by the initials of its roles. Rows are kept, given another role, or deleted, and rows
without text are put in between. An item says that the rows so far lead from one state of that pattern to another; a deduction
joins an item and the edit of the next row, or an inserted row, to a longer item. Items are popped from an agenda by (cost, rows
consumed, audit), audit being the letters of the edits; popped once, an item is final, and the first goal popped is the lightest.
The order fits: a deduction adds cost or consumes a row, so no result is lighter than what it came from; and two audits of one
cost that consume the same rows are never the beginning of one another (the rest would be insertions, which cost), so what is
appended to both leaves their order.

Rows are sorted by range over the cluster, so a conversation may run on over several partitions; a partition repairs those that
lie inside it. Others are cut into parts of at most PART rows. A part yields, for each state it may be entered in and left in,
the lightest item and the order of the audits of one entry state (insertions stand before a row, so again none of them begins
another); the parts of a conversation are joined by these numbers alone and then edited each by itself. Only the digest reads a
conversation whole, as a stream in the order of its parts.

Defined results: null roles and texts are read as one space, null turns come first and are no turn of the gaps; null conv_id is a
conversation; rows of one turn go by role and text (64
characters, then a hash); repeated rows are duplicates; roles count by their first character, and a
role without one is never legal; texts of any length pass through unchanged; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrain.llm.common import written

PART = 1024
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
#: What a kept row's initial leads to, and what a row of the library's own making is and leads to.
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
OWN = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
#: The insertions that end a conversation.
TAIL = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
LEGAL = {"su", "ua", "au"}
BLANKS = " \t\n\x0b\x0c\r"

LINES = "array<struct<role string, text string>>"
COUNTS = "first_turn long, last_turn long, turns long, first_initial string, last_initial string, blank long, duplicate long, truncated long, illegal long"
RUNS = f"part long, done boolean, {COUNTS}, cost long, audit string, repaired {LINES}, rows array<struct<turn long, role string, text string>>"
OPTIONS = f"part long, {COUNTS}, options array<struct<enter int, leave int, cost long, rank int, audit string>>"
PATHS = "part long, enter int, leave int, tail string"
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
Row = tuple[int | None, str, str]
Edit = tuple[str, str]  # what the agenda sees of a row: its role's initial, its fault


def damaged(rows: DataFrame) -> DataFrame:
    """conversations -> conv_id, turn, role, text with the faults of a twentieth each, by a hash of conversation and turn."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fault = F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    text = F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(fault == 4, "user").otherwise(role)
    copies = F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where(fault != 0).select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def faults(rows: list[Row], late: set[str] = frozenset()) -> list[str]:
    """The first fault of each row, or ''; late: keys of rows that earlier parts of the conversation hold."""
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(BLANKS)
        again = (role, text) in seen or late and row_key(role, text) in late
        out.append("blank" if not bare else "duplicate" if again else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def row_key(role: str, text: str) -> str:
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def agenda(edits: list[Edit], enter: int, whole: bool) -> dict[int, tuple[int, str]]:
    """The lightest (cost, audit) from state `enter` over all rows to each state; of whole conversations, to a state that
    may end one, insertions behind the last row included."""
    n, final, goals = len(edits), set(), {}
    heap = [(0, 0, "", enter)]
    while heap:
        cost, k, audit, state = heapq.heappop(heap)
        if (k, state) in final:
            continue
        final.add((k, state))
        if k == n:
            if not whole:
                goals[state] = cost, audit
                continue
            if not TAIL[state]:
                return {state: (cost, audit)}
        to = OWN[state][1]
        heapq.heappush(heap, (cost + INSERT, k, audit + "I", to))
        if k < n:
            initial, fault = edits[k]
            heapq.heappush(heap, (cost + DELETE, k + 1, audit + "D", state))
            if fault not in ("blank", "duplicate"):
                more = cost + (CUT_SHORT if fault else 0)
                heapq.heappush(heap, (more + REROLE, k + 1, audit + "R", to))
                if (state, initial) in KEPT:
                    heapq.heappush(heap, (more + KEEP, k + 1, audit + "K", KEPT[state, initial]))
    return goals


def edited(rows: list[Row], enter: int, audit: str) -> list[dict]:
    """The rows that the letters of an audit make, entered in a state."""
    state, k, out = enter, 0, []
    for letter in audit:
        if letter in "IR":
            role, state = OWN[state]
            out.append({"role": role, "text": rows[k][2] if letter == "R" else ""})
        elif letter == "K":
            state = KEPT[state, rows[k][1][:1]]
            out.append({"role": rows[k][1], "text": rows[k][2]})
        k += letter != "I"
    return out


def counted(rows: list[Row], found: list[str]) -> tuple:
    """COUNTS of a run of rows in order."""
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(x + y not in LEGAL for x, y in zip(initials, initials[1:], strict=False))
    distinct = sum(x != y for x, y in zip([None, *turns], turns, strict=False))
    return turns[0] if turns else None, turns[-1] if turns else None, distinct, initials[0], initials[-1], *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal


def joined(parts: list[tuple]) -> tuple[int, ...]:
    """gaps, blank, duplicate, truncated, illegal of the COUNTS of a conversation's runs in order."""
    first = last = None
    turns = illegal = 0
    before = None
    for part in parts:
        if part[0] is not None:
            first = part[0] if first is None else first
            turns += part[2] - (part[0] == last)
            last = part[1]
        illegal += part[8] + (before is not None and before + part[3] not in LEGAL)
        before = part[4]
    return (last - first + 1 - turns if first is not None else 0, *(sum(p[k] for p in parts) for k in (5, 6, 7)), illegal)


def row_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def by_arrow(df: DataFrame, local: Callable[[Iterator[tuple]], Iterator[tuple]], columns: str, rows: int = 500) -> DataFrame:
    """Rows of a partition, in their order, to rows of conv_id and `columns`."""
    kind = df.schema["conv_id"].dataType.simpleString()
    schema = df.sparkSession.createDataFrame([], f"conv_id {kind}, {columns}").schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], f.type) for k, f in enumerate(arrow)], schema=arrow)
            held.clear()
            return out

        for row in local(row_stream(batches)):
            held.append(row)
            if len(held) >= rows:
                yield batch()
        if held:
            yield batch()

    return df.mapInArrow(run, schema)


def runs(rows: DataFrame, part_rows: int = PART) -> DataFrame:
    """conv_id and RUNS: conversations that lie inside a partition are repaired; rows of others are listed in parts."""

    def local(stream: Iterator[tuple]) -> Iterator[tuple]:
        number, held, edge = TaskContext.get().partitionId() << 32, None, True
        for conv, group in groupby(stream, itemgetter(0)):
            if held:  # another conversation comes behind it
                yield closed(*held, number)
                number += 1
            some, open_, edge = [], edge, False
            for _, turn, role, text in group:
                if len(some) == part_rows:
                    yield closed(conv, some, True, number)
                    number, some, open_ = number + 1, [], True
                some.append((turn, role, text))
            held = conv, some, open_
        if held:
            yield closed(held[0], held[1], True, number)

    def closed(conv, some: list[Row], open_: bool, number: int) -> tuple:
        if open_:
            return conv, number, False, *[None] * 12, [{"turn": t, "role": r, "text": x} for t, r, x in some]
        found = faults(some)
        ((cost, audit),) = agenda([(r[1][:1], f) for r, f in zip(some, found, strict=True)], START, True).values()
        return conv, number, True, *counted(some, found), cost, audit, edited(some, START, audit), None

    # Beginnings and a hash stand for long values among the keys, which Spark samples on the driver; repeated rows are told apart.
    order = [F.col("conv_id"), F.col("turn"), F.substring("role", 1, 64), F.substring("text", 1, 64), F.xxhash64("role", "text")]
    spread = rows.select("conv_id", "turn", "role", "text").repartitionByRange(*order, F.monotonically_increasing_id())
    return by_arrow(spread.sortWithinPartitions(*order), local, RUNS)


def late_rows(open_: DataFrame) -> DataFrame:
    """part, late: keys of a part's rows that an earlier part of its conversation holds; at most one a row of the part."""
    flat = open_.select("conv_id", "part", F.inline("rows"))
    key = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("key")
    held = flat.select("conv_id", "part", key).distinct()
    first = held.groupBy("conv_id", "key").agg(F.min("part").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    late = held.alias("h").join(first.alias("f"), F.col("h.key").eqNullSafe(F.col("f.key")) & F.col("h.conv_id").eqNullSafe(F.col("f.conv_id")))
    return late.where(F.col("h.part") > F.col("first")).groupBy("part").agg(F.collect_list("h.key").alias("late"))


def options(open_: DataFrame) -> DataFrame:
    """conv_id and OPTIONS of each part: its lightest items by the states it is entered and left in."""

    def local(stream: Iterator[tuple]) -> Iterator[tuple]:
        for conv, part, listed, late in stream:
            some = [(r["turn"], r["role"], r["text"]) for r in listed]
            found = faults(some, set(late or ()))
            edits, out = [(r[1][:1], f) for r, f in zip(some, found, strict=True)], []
            for enter in range(4):
                goals = agenda(edits, enter, False)
                order = sorted(goals, key=lambda q, g=goals: g[q][1])
                out += [{"enter": enter, "leave": q, "cost": goals[q][0], "rank": k, "audit": goals[q][1]} for k, q in enumerate(order)]
            yield conv, part, *counted(some, found), out

    both = open_.select("conv_id", "part", "rows").join(late_rows(open_), "part", "left").select("conv_id", "part", "rows", "late")
    return by_arrow(both, local, OPTIONS, 20)


def path(parts: list[list[tuple[int, int, int, int]]]) -> tuple[int, list[tuple[int, int]], str]:
    """The cost, the (enter, leave) of each part and the insertions at the end: from the last part back, the
    lightest way on from each state; audits of one cost compare by the ranks of their first parts."""
    best = {q: (len(t) * INSERT, None) for q, t in TAIL.items()}
    chosen = []
    for part in reversed(parts):
        new: dict[int, tuple] = {}
        for enter, leave, cost, rank in part:
            value = cost + best[leave][0], rank, leave
            if enter not in new or value < new[enter]:
                new[enter] = value
        chosen.append({q: v[2] for q, v in new.items()})
        best = new
    state, steps = START, []
    for leaves in reversed(chosen):
        steps.append((state, leaves[state]))
        state = leaves[state]
    return best[START][0], steps, TAIL[state]


def repair(rows: DataFrame, part_rows: int = PART) -> tuple[DataFrame, DataFrame]:
    """rows (conv_id, turn, role, text) -> a report (conv_id, REPORT, parts) of each conversation, and the parts of the repaired
    ones in order: conv_id, part, audit, repaired (the rows as they are now)."""
    found = written(runs(rows, part_rows), "repair-runs")
    done, open_ = found.where("done"), found.where("NOT done")
    held = written(options(open_), "repair-options")

    def local(stream: Iterator[tuple]) -> Iterator[tuple]:
        for conv, group in groupby(stream, itemgetter(0)):
            listed = list(group)
            cost, steps, tail = path([[(o["enter"], o["leave"], o["cost"], o["rank"]) for o in r[11]] for r in listed])
            numbers = *joined([r[2:11] for r in listed]), cost
            for k, (r, (enter, leave)) in enumerate(zip(listed, steps, strict=True)):
                yield conv, r[1], enter, leave, tail if k == len(listed) - 1 else "", *(numbers if k == 0 else [None] * 6), len(listed) if k == 0 else None

    few = held.withColumn("options", F.transform("options", lambda o: F.struct(o["enter"], o["leave"], o["cost"], o["rank"])))
    few = few.withColumn("options", F.col("options").cast("array<struct<enter int, leave int, cost long, rank int>>"))
    ways = written(by_arrow(few.repartition("conv_id").sortWithinPartitions("conv_id", "part"), local, f"{PATHS}, {REPORT}, parts long"), "repair-paths")

    def change(stream: Iterator[tuple]) -> Iterator[tuple]:
        for conv, part, listed, enter, audit, tail in stream:
            yield conv, part, audit + tail, edited([(r["turn"], r["role"], r["text"]) for r in listed], enter, audit + tail)

    audits = held.select("part", F.inline("options")).join(ways.select("part", "enter", "leave", "tail"), ["part", "enter", "leave"])
    chosen = open_.select("conv_id", "part", "rows").join(audits.select("part", "enter", "audit", "tail"), "part").select("conv_id", "part", "rows", "enter", "audit", "tail")
    changed = by_arrow(chosen, change, f"part long, audit string, repaired {LINES}", 20)
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    report = done.select("conv_id", gaps, "blank", "duplicate", "truncated", "illegal", "cost", F.lit(1).cast("long").alias("parts"))
    report = report.unionByName(ways.where("gaps IS NOT NULL").select(report.columns))
    return report, done.select("conv_id", "part", "audit", "repaired").unionByName(changed)


def lines(repaired: Column) -> Column:
    return F.array_join(F.transform(repaired, lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")


def digests(report: DataFrame, parts: DataFrame) -> DataFrame:
    """conv_id, audit, repaired_sha256 of each conversation; those of several parts are read as a stream, part by part."""
    many = report.where("parts > 1").select("conv_id")
    one = parts.join(many, parts["conv_id"].eqNullSafe(many["conv_id"]), "left_anti").select("conv_id", "audit", F.sha2(lines(F.col("repaired")), 256).alias("repaired_sha256"))

    def local(stream: Iterator[tuple]) -> Iterator[tuple]:
        for conv, group in groupby(stream, itemgetter(0)):
            sha, audits, begun = hashlib.sha256(), [], False
            for _, _, audit, n, text in group:
                audits.append(audit)
                if n:
                    sha.update(("\n" if begun else "").encode() + text.encode())
                    begun = True
            yield conv, "".join(audits), sha.hexdigest()

    several = parts.join(many, parts["conv_id"].eqNullSafe(many["conv_id"]), "left_semi").select("conv_id", "part", "audit", F.size("repaired").alias("n"), lines(F.col("repaired")).alias("text"))
    return one.unionByName(by_arrow(several.repartition("conv_id").sortWithinPartitions("conv_id", "part"), local, "audit string, repaired_sha256 string"))


def repaired_conversations(rows: DataFrame, originals: DataFrame, part_rows: int = PART) -> DataFrame:
    """A row of each conv_id of originals: report and digest of its repair; zeros and empty ones where rows has none of it."""
    report, parts = repair(rows, part_rows)
    known = report.drop("parts").alias("r").join(digests(report, parts).alias("d"), F.col("r.conv_id").eqNullSafe(F.col("d.conv_id"))).select("r.*", "d.audit", "d.repaired_sha256")
    every = originals.select("conv_id").distinct().alias("o").join(known.alias("k"), F.col("o.conv_id").eqNullSafe(F.col("k.conv_id")), "left")
    zeros = [F.coalesce(f"k.{c}", F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256().hexdigest()
    return every.select("o.conv_id", *zeros, F.coalesce("k.audit", F.lit("")).alias("audit"), F.coalesce("k.repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
