"""Exact removal of repeated byte strings with suffix arrays.

Every window of ``length`` bytes has an anchor, its smallest hashed k-gram, so
equal windows share an anchor wherever they stand. Windows in a row with one
anchor form a run; its bytes are the run's context. Of contexts with equal bytes
the first one stands for all. Where an anchor has several contexts, their suffix
array brings equal windows together, which are then compared by their bytes.

Suffix arrays are made by linear grouping: suffixes are grouped by their Lyndon
prefixes, groups are processed from the highest down, each moving the previous
smaller suffixes of its members to groups of their own; then every group's
order is emitted from the ranks of its members' next smaller suffixes. Nothing
is renamed or sorted again by doubling. Many independent anchors ("lanes") go
through each step together, which is what makes it fast in numpy.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import Scratch, chunks, powers, prefix_hash, row_keys, runs, span_hash

GRAM = 24
SEGMENT = 1 << 20
_POSITION = np.uint64((1 << 24) - 1)


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... count times, for each row."""
    total = int(count.sum())
    if not total:
        return np.empty(0, np.int64)
    ahead = np.cumsum(count) - count
    return np.arange(total) + np.repeat(start - ahead, count)


def suffix_arrays(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The suffix arrays of lanes, each in its own place of one array.

    Lane k is symbols[starts[k] : starts[k + 1]]; its last symbol must be smaller
    than all others of the lane.
    """
    n = len(symbols)
    lane = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    base = starts[:-1]
    sa = np.argsort(lane * 512 + symbols + 1, kind="stable")
    head = np.ones(n, bool)
    head[1:] = (lane[sa[1:]] != lane[sa[:-1]]) | (symbols[sa[1:]] != symbols[sa[:-1]])
    first = np.flatnonzero(head)
    group = np.empty(n + 1, np.int64)  # of suffix i at i + 1: where its group starts
    group[0] = -1
    group[sa + 1] = np.repeat(first, np.diff(np.append(first, n)))
    size, span = np.zeros(n, np.int64), np.zeros(n, np.int64)
    size[first], span[first] = np.diff(np.append(first, n)), 1
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    before = np.arange(-1, n - 1)
    taken = np.zeros(n, bool)
    now = np.zeros(len(base), np.int64)

    live, end = np.arange(len(base)), starts[1:] - 1
    while len(live):
        start = group[sa[end] + 1]
        now[live] = start
        count = end - start + 1
        members = sa[_spread(start, count)]
        floor = np.repeat(start, count)
        p = before[members]
        todo = np.flatnonzero(group[p + 1] >= floor)
        while len(todo):  # to the previous suffix of a lower group
            p[todo] = before[p[todo]]
            before[members[todo]] = p[todo]
            todo = todo[group[p[todo] + 1] >= floor[todo]]
        own = p >= np.repeat(base[live], count)
        p, many = np.unique(p[own], return_counts=True)
        if len(p):
            old = group[p + 1]
            order = np.lexsort((many, old))
            p, many, old = p[order], many[order], old[order]
            cut = np.ones(len(p), bool)
            cut[1:] = old[1:] != old[:-1]
            at = np.flatnonzero(cut)
            moved = np.diff(np.append(at, len(p)))
            target = _spread(old[at] + size[old[at]] - moved, moved)
            source = place[p]
            taken[source] = True
            free = target[~taken[target]]
            taken[source] = False
            taken[target] = True
            left = source[~taken[source]]
            taken[target] = False
            sa[left] = sa[free]
            place[sa[left]] = left
            sa[target] = p
            place[p] = target
            sub = cut.copy()
            sub[1:] |= many[1:] != many[:-1]
            sub_at = np.flatnonzero(sub)
            new = target[sub_at]
            longer = span[old[sub_at]] + many[sub_at] * span[now[lane[p[sub_at]]]]
            parts = np.diff(np.append(sub_at, len(p)))
            size[old[at]] -= moved
            size[new], span[new] = parts, longer
            group[p + 1] = np.repeat(new, parts)
        end = start - 1
        on = end >= base[live]
        live, end = live[on], end[on]

    # each group's order, from the lowest: by the rank of what follows the Lyndon prefix
    group = group[1:]
    rank = np.where(size[group] == 1, group, -1)
    heads = np.flatnonzero((group[sa] == np.arange(n)) & (size > 1))
    turn = np.arange(len(heads)) - np.searchsorted(heads, base)[lane[sa[heads]]] if len(heads) else heads
    by_turn = np.argsort(turn, kind="stable")
    bounds = np.searchsorted(turn[by_turn], np.arange(turn.max() + 2)) if len(heads) else [0]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        g = heads[by_turn[a:b]]
        members = sa[_spread(g, size[g])]
        own = np.repeat(g, size[g])
        filled = 0 * g
        index = np.repeat(np.arange(len(g)), size[g])
        follows = members + span[own]
        while len(members):
            ranks = rank[follows]
            ready = np.flatnonzero(ranks >= 0)
            order = ready[np.lexsort((ranks[ready], index[ready]))]
            k = index[order]
            n_each = np.bincount(k, minlength=len(g))
            held = n_each[n_each > 0]
            spot = _spread((g + filled)[n_each > 0], held)
            rank[members[order]] = spot
            filled += n_each
            stay = np.ones(len(members), bool)
            stay[ready] = False
            members, follows, index = members[stay], follows[stay], index[stay]
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = w - span
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def _segment_runs(raw: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    sums = prefix_hash(raw)
    n = len(raw) - GRAM + 1
    gram = (sums[GRAM:] - sums[:-GRAM]) * powers(n)[1]
    gram ^= gram >> np.uint64(32)
    gram *= np.uint64(0xD6E8FEB86659FD93)
    low = _window_min((gram & ~_POSITION) | np.arange(n, dtype=np.uint64), length - GRAM + 1)
    anchor = (low & _POSITION).astype(np.int64)
    place = np.arange(len(anchor))
    doc = np.searchsorted(at, place, "right") - 1
    inside = place + length <= at[doc + 1]
    cut = np.ones(len(place), bool)
    cut[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | ~inside[:-1]
    first = np.flatnonzero(cut & inside)
    breaks = np.append(np.flatnonzero(cut | ~inside), len(place))
    last = breaks[np.searchsorted(breaks, first, "right")] - 1
    return doc[first], first - at[doc[first]], last - first + 1, gram[anchor[first]], anchor[first] - first


def window_runs(raw: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(doc, start, windows, anchor, place of the anchor) of each run in one block."""
    if len(raw) < length:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64), np.empty(0, np.int64))
    if len(raw) <= SEGMENT + length:
        return _segment_runs(raw, at, length)
    parts = []  # a long text, alone in its block, in segments: each window lies in one
    for k in range(0, len(raw) - length + 1, SEGMENT):
        piece = raw[k : k + SEGMENT + length - 1]
        doc, start, *rest = _segment_runs(piece, np.array([0, len(piece)]), length)
        parts.append((doc, start + k, *rest))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    """(h, n): the anchors of all runs, counted over about a million runs each."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def counted() -> pa.RecordBatch:
            h, times = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(times)], names=["h", "n"])

        for _, raw, at in chunks(batches, "_text"):
            held.append(window_runs(raw, at, length)[3])
            n += len(held[-1])
            if n > 1_000_000:
                yield counted()
                held, n = [], 0
        if n:
            yield counted()

    return docs.select(F.col("text").alias("_text")).mapInArrow(kernel, "h bigint, n bigint")


def _placed(docs: DataFrame, length: int) -> DataFrame:
    """(h, doc): each document's anchors, once."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, at in chunks(batches, "_text"):
            ids = rows.column(0).to_numpy()
            doc, _, _, h, _ = window_runs(raw, at, length)
            if len(doc):
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                new = np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]))
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(ids[doc[new]])], names=["h", "doc"])

    return docs.select("doc_id", F.col("text").alias("_text")).mapInArrow(kernel, "h bigint, doc bigint")


CONTEXT = "h bigint, c bigint, doc bigint, start bigint, bytes binary, place bigint, to bigint"


def _contexts(docs: DataFrame, asked: DataFrame, length: int, held_contexts: int = 100_000) -> DataFrame:
    """CONTEXT rows of the runs with asked anchors (h, doc). A context that is
    equal in bytes to one before it in its task has no bytes: all its windows, up
    to ``to``, repeat. A task remembers up to ``held_contexts`` contexts, then
    starts anew, which only sends more rows."""
    lists = asked.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list("h").alias("_h"))
    rows = docs.select("doc_id", F.col("text").alias("_text")).join(lists, "doc_id").select("doc_id", "_text", "_h").sortWithinPartitions("doc_id")

    def sent(raw: np.ndarray, at: np.ndarray, ids: np.ndarray, code: np.ndarray, seen: set[bytes], doc: np.ndarray, start: np.ndarray, windows: np.ndarray, h: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        begin = at[doc] + start
        held: list[bytes | None] = []
        for a, b in zip(begin.tolist(), (begin + windows + length - 1).tolist(), strict=True):
            x = raw[a:b].tobytes()
            if x in seen:
                held.append(None)
            else:
                held.append(x)
                seen.add(x)
        column, to = pa.array(held, pa.binary()), start + windows + length - 1
        again = np.asarray(column.is_null())
        # repeats that follow one another become one row
        joined = np.append(False, again[1:] & again[:-1] & (doc[1:] == doc[:-1]) & (start[1:] <= to[:-1]))
        keep = np.flatnonzero(~joined)
        to = to[np.append(keep[1:], len(to)) - 1]
        columns = (pa.array(x[keep]) for x in (h.view(np.int64), code, ids[doc], start))
        return pa.RecordBatch.from_arrays([*columns, column.take(pa.array(keep)), pa.array(place[keep]), pa.array(to)], names=["h", "c", "doc", "start", "bytes", "place", "to"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for rows, raw, at in chunks(batches, "_text"):
            ids = rows.column(0).to_numpy()
            doc, start, windows, h, place = window_runs(raw, at, length)
            want = rows.column(2)
            wanted = np.sort(want.values.to_numpy()[want.offsets[0].as_py() : want.offsets[-1].as_py()]).view(np.uint64) if len(want) else np.empty(0, np.uint64)
            wanted = np.unique(wanted)  # an anchor asked for in one document repeats, so it is asked for in all
            pick = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h) if len(wanted) else np.empty(0, np.int64)
            if not len(pick):
                continue
            code = span_hash(raw, at[doc[pick]] + start[pick], at[doc[pick]] + start[pick] + windows[pick] + length - 1).view(np.int64)
            for k in range(0, len(pick), held_contexts):  # a long text has very many
                own = pick[k : k + held_contexts]
                yield sent(raw, at, ids, code[k : k + held_contexts], seen, *(x[own] for x in (doc, start, windows, h, place)))
                if len(seen) > held_contexts:
                    seen.clear()

    return rows.mapInArrow(kernel, CONTEXT)


def repeated_windows(lanes: list[tuple[np.ndarray, np.ndarray, list[bytes], bool]], length: int) -> tuple[tuple, tuple]:
    """(doc, from, to) of byte ranges in which each window equals an earlier one
    of its lane; and (doc, from, bytes) of each first window in the lanes that ask
    for it. A lane holds the docs, starts and bytes of contexts of one anchor, and
    whether it asks."""
    held = [t for x in lanes for t in x[2]]
    per_lane = np.array([len(x[2]) for x in lanes])
    size = np.array([len(t) for t in held])
    lane_of = np.repeat(np.arange(len(lanes)), per_lane)
    # a 0 follows each context, and -1, smaller than all, each lane
    begin = np.cumsum(size + 1) - (size + 1) + lane_of
    starts = np.append(begin[np.cumsum(per_lane) - per_lane], begin[-1] + size[-1] + 2)
    symbols = np.zeros(starts[-1], np.int16)
    symbols[starts[1:] - 1] = -1
    symbols[_spread(begin, size)] = np.frombuffer(b"".join(held), np.uint8).astype(np.int16) + 1
    owner_doc, owner_start = (np.concatenate([x[k] for x in lanes]) for k in (0, 1))
    sa = suffix_arrays(symbols.astype(np.int64), starts)
    owner = np.searchsorted(begin, sa, "right") - 1
    use = sa - begin[owner] <= size[owner] - length
    sa, owner = sa[use], owner[use]
    lane = lane_of[owner]
    same = np.zeros(len(sa), bool)
    steps = np.arange(length)
    for k in range(1, len(sa), 1 << 14):
        a, b = sa[k - 1 : k - 1 + (1 << 14)], sa[k : k + (1 << 14)]
        a = a[: len(b)]
        same[k : k + len(b)] = (symbols[a[:, None] + steps] == symbols[b[:, None] + steps]).all(1)
    same[1:] &= lane[1:] == lane[:-1]
    group = np.cumsum(~same)
    doc = owner_doc[owner]
    place = owner_start[owner] + sa - begin[owner]
    order = np.lexsort((place, doc, group))
    later = np.zeros(len(sa), bool)
    later[order[1:]] = group[order[1:]] == group[order[:-1]]
    asked = ~later & np.array([x[3] for x in lanes])[lane]
    at = sa[asked]
    first = doc[asked], place[asked], [(symbols[k : k + length] - 1).astype(np.uint8).tobytes() for k in at.tolist()]
    owner, place, doc = owner[later], place[later], doc[later]
    order = np.lexsort((place, owner))
    owner, place, doc = owner[order], place[order], doc[order]
    cut = np.ones(len(place), bool)
    cut[1:] = (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)
    at = np.flatnonzero(cut)
    last = np.append(at[1:], len(place))[: len(at)] - 1
    return (doc[at], place[at], place[last] + length), first


def _can_share(texts: list[bytes], places: list[int], length: int) -> list[int]:
    """Which contexts of an anchor can share a window: one has its anchor and at
    least half of its other bytes on one side of it, so two that share a window
    share those on the left or on the right."""
    side = (length - GRAM + 1) // 2
    left = [t[p - side : p + GRAM] if p >= side else None for t, p in zip(texts, places, strict=True)]
    right = [t[p : p + GRAM + side] if p + GRAM + side <= len(t) else None for t, p in zip(texts, places, strict=True)]
    n_left, n_right = Counter(left), Counter(right)
    return [k for k, (a, b) in enumerate(zip(left, right, strict=True)) if a is not None and n_left[a] > 1 or b is not None and n_right[b] > 1]


RANGES = "doc bigint, from bigint, to bigint, window binary"


def _lane_ranges(contexts: DataFrame, length: int, held_bytes: int = 8 << 20, lane_bytes: int = 1 << 20) -> DataFrame:
    """RANGES that repeat earlier windows of their lane (h, salt), with no window;
    and the first windows of salted lanes, with their bytes. Of contexts equal in
    bytes the first one stands in the suffix array, the others repeat whole. Lanes
    are held up to ``held_bytes`` and go by size in groups of about
    ``lane_bytes``, as those of a group take as many steps as the longest."""

    def batch_of(doc: np.ndarray, a: np.ndarray, b: np.ndarray, window: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (doc, a, b)), pa.array(window, pa.binary())], names=["doc", "from", "to", "window"])

    def flush(lanes: list) -> Iterator[pa.RecordBatch]:
        lanes.sort(key=lambda x: sum(map(len, x[2])))
        part, n = [], 0
        for k, lane in enumerate(lanes):
            part.append(lane)
            n += sum(map(len, lane[2]))
            if n > lane_bytes or k == len(lanes) - 1:
                (doc, a, b), (own, at, windows) = repeated_windows(part, length)
                yield batch_of(np.concatenate((doc, own)), np.concatenate((a, at)), np.concatenate((b, at + length)), [None] * len(doc) + windows)
                part, n = [], 0

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lanes, n = [], 0
        copies, n_copies = [], 0
        for rows in runs(batches, 2):
            salted, texts = rows.column(1)[0].as_py() >= 0, rows.column(5).to_pylist()
            doc, start = rows.column(3).to_numpy(), rows.column(4).to_numpy()
            seen: set[bytes] = set()
            first = np.array([not (x in seen or seen.add(x)) for x in texts])  # rows come by (c, doc, start)
            if not first.all():
                copies.append(np.stack((doc[~first], start[~first], rows.column(7).to_numpy()[~first])))
                n_copies += int((~first).sum())
                if n_copies > 100_000:
                    yield batch_of(*np.concatenate(copies, 1), [None] * n_copies)
                    copies, n_copies = [], 0
            use = np.flatnonzero(first)
            if not salted:
                if len(use) < 2:
                    continue
                place = rows.column(6).to_numpy()
                use = use[_can_share([texts[k] for k in use], place[use].tolist(), length)]
            if not len(use):
                continue
            lanes.append((doc[use], start[use], [texts[k] for k in use], salted))
            n += sum(map(len, lanes[-1][2]))
            if n > held_bytes:
                yield from flush(lanes)
                lanes, n = [], 0
        yield from flush(lanes)
        if n_copies:
            yield batch_of(*np.concatenate(copies, 1), [None] * n_copies)

    rows = contexts.select("h", "salt", "c", "doc", "start", "bytes", "place", "to")
    return rows.repartition("h", "salt").sortWithinPartitions("h", "salt", "c", "doc", "start").mapInArrow(kernel, RANGES)


def without(own: np.ndarray, low: pa.Array | None, high: pa.Array | None) -> tuple[int, int, bytes]:
    """Bytes and runs that ranges [low, high) take from a text, and what is left."""
    if low is None or not len(low):
        return 0, 0, own.tobytes()
    low, high = low.to_numpy(), high.to_numpy()
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    new = np.append(True, low[1:] > high[:-1])
    low, high = low[new], high[np.append(np.flatnonzero(new)[1:], len(new)) - 1]
    step = np.zeros(len(own) + 1, np.int8)
    step[low] = 1
    step[high] = -1
    return int((high - low).sum()), len(low), own[np.cumsum(step, dtype=np.int8)[:-1] == 0].tobytes()


def _edges(contexts: DataFrame, scratch: Scratch, length: int, lane_contexts: int) -> DataFrame:
    """(doc, from, to) of all ranges that repeat earlier windows of their anchor.

    An anchor with more than ``lane_contexts`` rows (about 9 MB) is dealt into
    salted lanes, so no lane grows with the corpus. What is first in its lane only
    is settled between lanes by the bytes of its windows, of which map tasks keep
    one row."""
    hot = contexts.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > lane_contexts).select("h", F.ceil(F.col("n") / lane_contexts).cast("int").alias("parts"))
    hot = scratch.keep(hot, "hot")
    salt = F.when(F.col("parts").isNull(), -1).otherwise(F.pmod(F.xxhash64("doc", "start"), F.col("parts"))).cast("int")
    found = scratch.keep(_lane_ranges(contexts.join(hot, "h", "left").withColumn("salt", salt), length), "lanes")
    windows = found.where("window is not null")
    firsts = windows.groupBy("window").agg(F.min(F.struct("doc", "from")).alias("least"), F.count("*").alias("n")).where("n > 1").select("window", "least")
    between = windows.join(firsts, "window").where(F.struct("doc", "from") > F.col("least"))
    return found.where("window is null").select("doc", "from", "to").union(between.select("doc", "from", "to"))


def dedup_bytes(docs: DataFrame, scratch: Scratch, length: int = 100, lane_contexts: int = 1 << 16) -> DataFrame:
    """One row (doc_id, text_bytes kept as ``kept``, n_bytes, n_removed, n_spans)
    for each document: every byte covered by a string of ``length`` bytes that
    also starts earlier (smaller doc_id, or earlier in the document) is removed.
    Hashes only bring strings together; what is removed has been compared by its
    bytes.

    Null and empty texts have no bytes. Each row is a document: rows that repeat a
    doc_id go by the hash of their texts, rows without one come after all others.
    Extra columns are not read; an empty table gives an empty result.
    """
    every, _ = row_keys(docs.select("doc_id", "text"), scratch)
    rows = every.select(F.col("__row").alias("doc_id"), "text")
    # by anchor: counts, which map tasks have combined before they move
    anchors = scratch.keep(_anchors(rows, length).groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"), "anchors")
    asked = _placed(rows, length).join(anchors.hint("merge"), "h").select("h", "doc")
    contexts = scratch.keep(_contexts(rows, asked, length), "contexts")
    edges = _edges(contexts.where("bytes is not null"), scratch, length, lane_contexts)
    whole = contexts.where("bytes is null").select("doc", F.col("start").alias("from"), "to")
    gone = whole.union(edges).groupBy(F.col("doc").alias("__of")).agg(F.collect_list("from").alias("_from"), F.collect_list("to").alias("_to"))
    gone = scratch.keep(gone, "gone")
    scratch.drop("anchors", "contexts", "lanes", "hot")
    rows = every.select("doc_id", "__row", F.col("text").alias("_text")).join(gone, F.col("__row") == F.col("__of"), "left").select("doc_id", "_text", "_from", "_to")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, at in chunks(batches, "_text"):
            sizes, removed, spans, kept = np.diff(at), [], [], []
            for k in range(part.num_rows):
                own = raw[at[k] : at[k + 1]]
                n, cut, left = without(own, *(part.column(c)[k].values for c in (2, 3)))
                removed.append(n)
                spans.append(cut)
                kept.append(left)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.binary()), pa.array(sizes), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return rows.mapInArrow(kernel, "doc_id bigint, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint")
