"""Repair of conversation structure by a rank-compressed dynamic programme.

A repaired conversation's role initials read ``(s?(ua)+)?``. A step of the programme
is a macro edit: a run of inserted turns and what becomes of the next row. Macro
edits have prefix-free codes (``D``, ``ID``, ``IK``, ...) whose order is that of the
strings, so of two audits with as many macro edits the first difference decides. So
a layer holds, instead of audit strings, a cost and a rank for each state, and
pointers to the layer before; audits are spelled out afterward. Layers less
their lowest cost are few, so a step is made once and then looked up.

Long conversations are cut into chunks of bounded size: a chunk gives costs and
ranks from each state to each other, chunks are then chained (a row a chunk), and
each is spelled out between the states it got.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import Scratch

#: White space at the end of a text.
SPACE = " \t\n\x0b\f\r"
#: What an edit costs; an undeleted truncated row costs more.
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
BLANK, DUPLICATE, CUT = 1, 2, 3
ROLES = {"u": "user", "a": "assistant"}

#: States: nothing yet, a system turn, a user turn, an assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: What is inserted at the end in each state.
ENDINGS = {NOTHING: "", SYSTEM: "ua", USER: "a", ASSISTANT: ""}
#: More than two inserted turns in a row bring no state that fewer don't.
CODES = sorted("I" * k + x for k in range(3) for x in "DKR")

FACTS = "conv_id bigint, chunk bigint, at bigint, turn bigint, initial string, fault int"
CHUNKS = "conv_id bigint, chunk bigint, costs array<bigint>, ranks array<int>, counts array<bigint>, first_initial string, last_initial string, first_turn bigint, last_turn bigint"
PLANNED = "conv_id bigint, chunk bigint, start int, goal int, ending string, counts array<bigint>"
EDITS = "at bigint, lead string, edit string, role string, ending string"
DIGESTS = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def inserted(state: int, k: int) -> tuple[int, str]:
    """The state after k inserted turns, and their initials."""
    out = ""
    for _ in range(k):
        state, out = (ASSISTANT, out + "a") if state == USER else (USER, out + "u")
    return state, out


@functools.cache
def moves(initial: str, fault: int) -> tuple[tuple[tuple[int, int, int], ...], ...]:
    """By state: (cost, place of the code in CODES, next state) of each macro edit."""
    out = []
    for state in range(4):
        of = []
        for k in range(3):
            now, _ = inserted(state, k)
            lead, undeleted = "I" * k, INSERT * k + (TRUNCATED if fault == CUT else 0)
            of.append((INSERT * k + DELETE, CODES.index(lead + "D"), now))
            if fault in (BLANK, DUPLICATE):
                continue
            if initial == "s" and now == NOTHING:
                of.append((undeleted, CODES.index(lead + "K"), SYSTEM))
            if initial == ("a" if now == USER else "u"):
                of.append((undeleted, CODES.index(lead + "K"), inserted(now, 1)[0]))
            of.append((undeleted + REROLE, CODES.index(lead + "R"), inserted(now, 1)[0]))
        out.append(tuple(of))
    return tuple(out)


#: A cost and a rank by start * 4 + state, None where there is no way.
Layer = tuple[tuple[int, int] | None, ...]
EVERY_START: Layer = tuple((0, 0) if k % 5 == 0 else None for k in range(16))


def only_start(state: int) -> Layer:
    return tuple((0, 0) if k == state * 5 else None for k in range(16))


@functools.cache
def step(layer: Layer, initial: str, fault: int) -> tuple[Layer, int, tuple]:
    """The next layer less its lowest cost, that cost, and for each entry the entry
    before and the code."""
    best: dict[int, tuple[int, int, int, int]] = {}
    for k, held in enumerate(layer):
        if held:
            for cost, code, state in moves(initial, fault)[k % 4]:
                found = (held[0] + cost, held[1], code, k)
                to = k - k % 4 + state
                if to not in best or found < best[to]:
                    best[to] = found
    low = min(x[0] for x in best.values())
    rank = {x: k for k, x in enumerate(sorted({x[1:3] for x in best.values()}))}
    after = tuple((best[k][0] - low, rank[best[k][1:3]]) if k in best else None for k in range(16))
    return after, low, tuple((best[k][3], best[k][2]) if k in best else None for k in range(16))


def _kind(initial: str) -> str:
    return initial if initial in ("s", "u", "a") else "?"


def spelled(rows: list[tuple[str, int]], start: int, goal: int) -> list[tuple[str, str, str | None]]:
    """(initials inserted ahead, edit, new role) of each row (initial, fault) on the
    best way from one state to another."""
    layer, back = only_start(start), []
    for initial, fault in rows:
        layer, _, came = step(layer, _kind(initial), fault)
        back.append(came)
    entry, codes, states = start * 4 + goal, [], []
    for came in reversed(back):
        states.append(entry % 4)
        entry, code = came[entry]
        codes.append(CODES[code])
    out, state = [], start
    for code, after in zip(reversed(codes), reversed(states), strict=True):
        _, lead = inserted(state, len(code) - 1)
        out.append((lead, code[-1], ("user" if after == USER else "assistant") if code[-1] == "R" else None))
        state = after
    return out


def _groups(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[list[tuple]]:
    """Rows of each run of equal values in the first n columns."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:n] != held[-1][:n]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _batches(schema: str, rows: Iterable[tuple], size: int = 4096) -> Iterator[pa.RecordBatch]:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    fields = [x.split() for x in schema.split(", ")]
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], kinds[kind]) for k, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield batch()
            held = []
    if held:
        yield batch()


def _illegal(before: str, after: str) -> bool:
    return before + after not in ("su", "ua", "au")


def _surveyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """CHUNKS rows of sorted FACTS. counts: turns, blank, duplicate, truncated, illegal."""

    def rows() -> Iterator[tuple]:
        for group in _groups(batches, 2):
            layer, cost, counts, turn, last = EVERY_START, 0, [0] * 5, None, None
            for _, _, _, now, initial, fault in group:
                layer, low, _ = step(layer, _kind(initial), fault)
                cost += low
                counts[0] += now is not None and now != turn
                turn = now
                if fault:
                    counts[fault] += 1
                counts[4] += last is not None and _illegal(last, initial)
                last = initial
            turns = [r[3] for r in group if r[3] is not None]
            yield (*group[0][:2], [x and cost + x[0] for x in layer], [x and x[1] for x in layer], counts, group[0][4], last, turns[0] if turns else None, turns[-1] if turns else None)

    return _batches(CHUNKS, rows())


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PLANNED rows of sorted CHUNKS: the states between which each chunk is spelled
    out; the last chunk of a conversation has the ending and the COUNTS."""

    def rows() -> Iterator[tuple]:
        for group in _groups(batches, 1):
            ways, back = {NOTHING: (0, 0)}, []
            for _, _, costs, ranks, *_ in group:
                best = {}
                for goal in range(4):
                    found = [(cost + costs[s * 4 + goal], rank, ranks[s * 4 + goal], s) for s, (cost, rank) in ways.items() if costs[s * 4 + goal] is not None]
                    if found:
                        best[goal] = min(found)
                place = {x: k for k, x in enumerate(sorted({x[1:3] for x in best.values()}))}
                ways = {goal: (x[0], place[x[1:3]]) for goal, x in best.items()}
                back.append({goal: x[3] for goal, x in best.items()})
            cost, _, _, goal = min((cost + INSERT * len(ENDINGS[s]), rank, len(ENDINGS[s]), s) for s, (cost, rank) in ways.items())
            counts = [sum(r[4][k] for r in group) for k in range(5)]
            counts[4] += sum(_illegal(a[6], b[5]) for a, b in zip(group, group[1:], strict=False))
            turned = [r for r in group if r[7] is not None]
            distinct = counts[0] - sum(a[8] == b[7] for a, b in zip(turned, turned[1:], strict=False))
            gaps = turned[-1][8] - turned[0][7] + 1 - distinct if turned else 0
            ending, out = ENDINGS[goal], []
            for r, came in zip(reversed(group), reversed(back), strict=True):
                out.append((*r[:2], came[goal], goal, "" if out else ending, None if out else [min(gaps, (1 << 63) - 1), *counts[1:], cost]))
                goal = came[goal]
            yield from reversed(out)

    return _batches(PLANNED, rows())


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """EDITS of FACTS behind their chunk's plan (conv_id, chunk, at, initial, fault,
    start, goal, ending), whose ``at`` is -1."""

    def rows() -> Iterator[tuple]:
        for (plan, *group) in _groups(batches, 2):
            edits = spelled([(r[3], r[4]) for r in group], plan[5], plan[6])
            for k, (r, edit) in enumerate(zip(group, edits, strict=True)):
                yield (r[2], *edit, plan[7] if k == len(group) - 1 else "")

    return _batches(EDITS, rows())


def spaced(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) by the crc32 of ``conv_id:turn`` modulo 20:
    0 drops a row, 1 empties its text, 2 takes ``.``, ``!`` and ``?`` out of it, 3 gives
    it twice, 4 makes it the user's. Nulls read as one space."""
    code = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    times = F.when(code == 0, F.array().cast("array<int>")).when(code == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(code == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"), times.alias("times"))
    return rows.withColumn("time", F.explode("times")).drop("times", "time")


def repair(rows: DataFrame, scratch: Scratch, chunk_bits: int = 12) -> tuple[DataFrame, DataFrame]:
    """(lines, counts) of conversations (conv_id, turn, role, text).

    lines: (conv_id, at, k, edit, role, text), in the order of ``at`` and ``k`` within a
    conversation: rows that are kept (K), reroled (R) or deleted (D, with what they
    were), and inserted ones (I). Without the deleted ones they are the repaired
    conversation. counts: (conv_id, COUNTS).

    Rows go by turn, nulls first, then role and text; a null role or text reads as
    one space, rows without conv_id are one conversation. A row is blank, else a
    duplicate, else truncated. Chunks have at most 2**chunk_bits rows, so a
    conversation of any size is spread over tasks. An empty table gives no rows.
    """
    last = F.right(F.rtrim(F.col("text"), F.lit(SPACE)), F.lit(1))
    held = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    held = held.repartitionByRange(*order).sortWithinPartitions(*order)
    held = held.select("*", F.monotonically_increasing_id().alias("at"), F.substring("role", 1, 1).alias("initial"), F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), CUT).otherwise(0).alias("own"), F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("same"))
    held = scratch.keep(held, "rows")
    # only texts that a conversation repeats; their rows are compared with the first
    first = scratch.keep(held.groupBy("conv_id", "same").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("theirs"), F.col("same").alias("seen"), "first"), "first")
    fault = F.when(F.col("own") == BLANK, BLANK).when(F.col("at") > F.col("first"), DUPLICATE).otherwise(F.col("own"))
    facts = held.select("conv_id", "turn", "at", "initial", "own", "same").join(first, F.col("conv_id").eqNullSafe(F.col("theirs")) & (F.col("same") == F.col("seen")), "left")
    facts = scratch.keep(facts.select("conv_id", F.shiftright("at", chunk_bits).alias("chunk"), "at", "turn", "initial", fault.alias("fault")), "facts")
    chunks = facts.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "at").mapInArrow(_surveyed, CHUNKS)
    plan = scratch.keep(chunks.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(_chained, PLANNED), "plan")
    none = F.lit(None)
    ahead = plan.select("conv_id", "chunk", F.lit(-1).cast("long").alias("at"), none.cast("string").alias("initial"), none.cast("int").alias("fault"), "start", "goal", "ending")
    told = ahead.union(facts.select("conv_id", "chunk", "at", "initial", "fault", none.cast("int"), none.cast("int"), none.cast("string")))
    edits = told.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "at").mapInArrow(_edited, EDITS)
    joined = held.select("conv_id", "at", F.col("role").alias("was"), "text").join(edits, "at")

    def new(initials: str) -> Column:
        return F.transform(F.filter(F.split(initials, ""), lambda x: x != ""), lambda x: F.struct(F.lit("I").alias("edit"), F.when(x == "u", ROLES["u"]).otherwise(ROLES["a"]).alias("role"), F.lit("").alias("text")))

    own = F.array(F.struct("edit", F.coalesce("role", "was").alias("role"), "text"))
    lines = joined.select("conv_id", "at", F.posexplode(F.concat(new("lead"), own, new("ending"))).alias("k", "line")).select("conv_id", "at", "k", "line.edit", "line.role", "line.text")
    counts = plan.where("counts is not null").select("conv_id", *[F.get("counts", F.lit(k)).alias(c) for k, c in enumerate(COUNTS)])
    return lines, counts


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """DIGESTS of sorted rows (conv_id, at, k, edit, role, text, counts): first a row for
    the conversation, then its counts, then its lines, which stream into the digest."""

    def rows() -> Iterator[tuple]:
        conv, digest = None, None
        for batch in batches:
            for now, at, _, edit, role, text, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at == -2:
                    if digest:
                        yield (conv, *counts, "".join(audit), digest.hexdigest())
                    conv, counts, audit, digest, some = now, [0] * len(COUNTS), [], hashlib.sha256(), False
                elif at == -1:
                    counts = found
                else:
                    audit.append(edit)
                    if edit != "D":
                        digest.update(f"{chr(10) if some else ''}{role}:{text}".encode())
                        some = True
        if digest:
            yield (conv, *counts, "".join(audit), digest.hexdigest())

    return _batches(DIGESTS, rows(), 256)


def digests(conversations: DataFrame, lines: DataFrame, counts: DataFrame) -> DataFrame:
    """DIGESTS, one row for each conv_id of ``conversations``; one without lines has
    zeros, an empty audit and the digest of nothing. A digest is over a whole
    conversation in order, so its lines stream through one task, a batch at a time."""
    none = F.lit(None)
    no_line = [none.cast("int"), *[none.cast("string")] * 3]
    base = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().select("conv_id", F.lit(-2).cast("long").alias("at"), *[c.alias(name) for c, name in zip(no_line, ("k", "edit", "role", "text"), strict=True)], none.cast("array<bigint>").alias("counts"))
    counted = counts.select("conv_id", F.lit(-1).cast("long"), *no_line, F.array(*COUNTS))
    rows = base.union(counted).union(lines.select("conv_id", "at", "k", "edit", "role", "text", none.cast("array<bigint>")))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "at", "k").mapInArrow(_digested, DIGESTS)


def repair_damage(table: DataFrame, scratch: Scratch) -> DataFrame:
    """DIGESTS of the repair of ``damaged`` conversations."""
    rows = table.select("conv_id", "turn", "role", "text")
    return digests(rows, *repair(damaged(rows), scratch))
