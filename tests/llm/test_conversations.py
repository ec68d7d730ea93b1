"""Conversation repair against a search that keeps whole audit strings."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import Row

from topicloom.llm import conversations as C

SF = "/root/testdata/sf0.001"
GOOD = re.compile("(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string"


def spaced(x):
    return " " if x is None else x


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        role, text = spaced(role), spaced(text)
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        role = "user" if code == 4 else role
        out += [(conv, turn, role, text)] * (2 if code == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = text.strip(" \t\n\x0b\f\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, lines): after each row, the least (cost, audit) by the last role
    initial so far. Up to two turns are inserted before a row."""

    def legal(before, now):
        return now == ("a" if before == "u" else "u") or now == "s" and before == ""

    every = {"": (0, "", ())}
    for (_, _, role, text), fault in zip(rows, faults(rows), strict=True):
        after = {}
        for before, (cost, audit, lines) in every.items():
            opened = [(before, cost, audit, lines)]
            for _ in range(2):
                b, c, a, x = opened[-1]
                now = "a" if b == "u" else "u"
                opened.append((now, c + 3, a + "I", (*x, f"{C.ROLES[now]}:")))
            for b, c, a, x in opened:
                options = [(b, c + 4, a + "D", x)]
                if fault not in ("blank", "duplicate"):
                    extra = 3 if fault == "truncated" else 0
                    if legal(b, role[:1]) and role[:1] in ("s", "u", "a"):
                        options.append((role[:1], c + extra, a + "K", (*x, f"{role}:{text}")))
                    for now in "ua":
                        if legal(b, now):
                            options.append((now, c + extra + 3, a + "R", (*x, f"{C.ROLES[now]}:{text}")))
                for now, c2, a2, x2 in options:
                    new = (c2, a2, x2)
                    after[now] = min(after.get(now, new), new)
        every = after
    ends = []
    for b, (cost, audit, lines) in every.items():
        for _ in range(3):
            if b in ("", "a"):
                ends.append((cost, audit, lines))
            now = "a" if b == "u" else "u"
            b, cost, audit, lines = now, cost + 3, audit + "I", (*lines, f"{C.ROLES[now]}:")
    return min(ends)


def expected(table, harm=True):
    convs, out = defaultdict(list), []
    for r in table:
        convs[r[0]]
    for r in damage(table) if harm else [(c, t, spaced(x), spaced(y)) for c, t, x, y in table]:
        convs[r[0]].append(r)
    for conv, rows in convs.items():
        rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        f, turns = faults(rows), {r[1] for r in rows} - {None}
        cost, audit, lines = cheapest(rows)
        initials = [r[2][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(f.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def made(rng, convs, longest):
    roles, texts = ["user", "assistant", "system", "tool", "", None, "urn", "Agent"], ["yes.", "no!", "what", "", " \t", None, "a b?", "odd\x1f"]
    weights = [8, 8, 3, 1, 1, 1, 1, 1]
    return [(c, rng.choice([None, k // 2, k, k, k + 5]), rng.choices(roles, weights)[0], rng.choice(texts) if rng.random() < 0.6 else f"t{k}.") for c in range(convs) for k in range(rng.randrange(longest))]


def test_cheapest_by_all_edits():
    """The search above against every sequence of edits, for short conversations."""
    rng = random.Random(5)

    def every(rows, fault, before="", cost=0, audit="", lines=(), left=2):
        if not rows:
            if before in ("", "a"):
                yield cost, audit, lines
        if left:
            now = "a" if before == "u" else "u"
            yield from every(rows, fault, now, cost + 3, audit + "I", (*lines, f"{C.ROLES[now]}:"), left - 1)
        if rows:
            (_, _, role, text), f = rows[0], fault[0]
            rest = (rows[1:], fault[1:])
            yield from every(*rest, before, cost + 4, audit + "D", lines)
            if f not in ("blank", "duplicate"):
                cost += 3 * (f == "truncated")
                if role[:1] == "s" and not before or role[:1] == ("a" if before == "u" else "u"):
                    yield from every(*rest, role[:1], cost, audit + "K", (*lines, f"{role}:{text}"))
                now = "a" if before == "u" else "u"
                yield from every(*rest, now, cost + 3, audit + "R", (*lines, f"{C.ROLES[now]}:{text}"))

    for _ in range(200):
        rows = [(c, t, spaced(x), spaced(y)) for c, t, x, y in made(rng, 1, 5)]
        best = min(every(rows, faults(rows)))
        assert cheapest(rows) == best
        assert GOOD.fullmatch("".join(x[0] for x in best[2]))


def test_conversations(spark, scratch):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert found(C.repair_damage(table, scratch)) == expected(rows)


@pytest.mark.parametrize("bits", [0, 1, 3, 12])
def test_made_conversations(spark, scratch, bits):
    """Null, blank, repeated and foreign values, in chunks of any size."""
    rows = made(random.Random(bits), 60, 12) + [(None, None, None, None), (None, 3, "user", "x.")]
    table = spark.createDataFrame(rows, SCHEMA)
    assert found(C.digests(table, *C.repair(table, scratch, bits))) == expected(rows, harm=False)
    assert found(C.repair_damage(table, scratch.__class__(spark, "other"))) == expected(rows)


def test_long_conversation_over_many_chunks(spark, scratch):
    rows = [(1, k, random.Random(k).choice(["user", "assistant", "system"]), "t." if k % 3 else f"u{k}") for k in range(700)]
    table = spark.createDataFrame(rows, SCHEMA)
    assert found(C.digests(table, *C.repair(table, scratch, 4))) == expected(rows, harm=False)


def test_lines_are_the_repaired_conversation(spark, scratch):
    rows = [(7, 0, "assistant", "hello."), (7, 1, "assistant", "hello."), (7, 2, "user", "cut")]
    lines, counts = C.repair(spark.createDataFrame(rows, SCHEMA), scratch)
    held = [tuple(r)[3:] for r in sorted(lines.collect(), key=lambda r: (r.at, r.k))]
    cost, audit, repaired = cheapest(rows)
    assert "".join(x[0] for x in held) == audit and tuple(f"{r}:{t}" for e, r, t in held if e != "D") == repaired
    assert counts.first().asDict() == {"conv_id": 7, "gaps": 0, "blank": 0, "duplicate": 1, "truncated": 1, "illegal": 1, "cost": cost}


def test_nothing_extra_columns_and_lost_conversations(spark, scratch):
    nothing = spark.createDataFrame([], SCHEMA)
    assert C.repair_damage(nothing, scratch).count() == 0
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    table = spark.createDataFrame([Row(conv_id=conv, turn=0, role="user", text="x" * 100000, at="clash", edit=1, counts=2, first=3)])
    other = scratch.__class__(spark, "other")
    assert found(C.repair_damage(table, other)) == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
