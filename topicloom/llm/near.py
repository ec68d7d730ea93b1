"""MinHash near-duplicates with sequential Bayesian verification.

Documents are sets of hashed five-word shingles. Exact copies collapse first;
every other text gets a signature, whose bands give candidate pairs. A pair's
signatures are compared batch by batch: as soon as the posterior says that its
similarity reaches the threshold with less than the chosen miss probability,
the pair is dropped. Survivors are verified on their full shingle sets.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import CHUNK_BYTES, WHITE, Scratch, chunks, components, deal_blocks, is_long, mix, prefix_hash, range_hash, row_keys, run_values, runs, salted, texts, windows, word_windows, words

BANDS, BAND_ROWS = 40, 5
SHINGLE = 5
SKETCH = "n_shingles bigint, k1 bigint, k2 bigint, bands array<bigint>, low binary"


def _long_set(raw: np.ndarray, size: int) -> np.ndarray:
    """The shingle set of one long text, whose pieces leave distinct values alone."""
    few, parts = [], []
    for value, run in word_windows(raw, size, fold=True):
        if len(run):
            parts.append(np.unique(run))
        elif not parts:
            few.append(value)
    if not parts:
        value = np.concatenate(few)
        return windows(value, len(value)) ^ np.uint64(len(value)) if len(value) else value
    joined = np.concatenate(parts)
    parts.clear()
    joined.sort()
    new = np.ones(len(joined), bool)
    np.not_equal(joined[1:], joined[:-1], out=new[1:])
    return joined[new]


def shingle_sets(raw: np.ndarray, at: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document; A-Z are folded."""
    if not len(raw):
        return [np.empty(0, np.uint64)] * (len(at) - 1)
    if is_long(raw, at):
        return [_long_set(raw, size)]
    start, end, first = words(raw, at)
    value = range_hash(prefix_hash(raw, fold=True), start, end)
    run = windows(value, size)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(run[a : b - size + 1]))
        elif b > a:
            out.append(windows(value[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _sequence_keys(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """128 bits of each document's folded word sequence."""
    keys = np.zeros((len(at) - 1, 2), np.uint64)
    if is_long(raw, at):
        for lane in (0, 1):
            n, total = 0, np.zeros(1, np.uint64)
            for value, _ in run_values(raw, WHITE, True, lane):
                step = np.arange(n, n + len(value), dtype=np.uint64)
                total += mix(value + step * np.uint64(0xA24BAED4963EE407)).sum(dtype=np.uint64)
                n += len(value)
            keys[:, lane] = mix(total + np.uint64(n))
        return keys
    start, end, first = words(raw, at)
    n = np.diff(first)
    for lane in (0, 1):
        value = range_hash(prefix_hash(raw, fold=True, lane=lane), start, end)
        step = np.arange(len(value), dtype=np.uint64) - np.repeat(first[:-1], n).astype(np.uint64)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(value + step * np.uint64(0xA24BAED4963EE407)))))
        keys[:, lane] = mix(sums[first[1:]] - sums[first[:-1]] + n.astype(np.uint64))
    return keys


@functools.cache
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(29)
    n = BANDS * BAND_ROWS
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def minhash(values: np.ndarray) -> np.ndarray:
    """The signature of one set of 64-bit hashes."""
    a, b = _multipliers()
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    x = (values >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(x), 4096):
        np.minimum(low, (x[k : k + 4096, None] * a + b).min(0), out=low)
    return low


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, n_shingles, k1, k2, bands, low) for each document."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.random.default_rng(31).integers(1, 1 << 63, (BANDS, BAND_ROWS), dtype=np.uint64)
        for batch, raw, at in chunks(batches, "_text"):
            sets = shingle_sets(raw, at)
            keys = _sequence_keys(raw, at).view(np.int64) if len(raw) else np.zeros((len(sets), 2), np.int64)
            bands, low = [], []
            for s in sets:
                if len(s):
                    sig = minhash(s)
                    grid = sig.reshape(BANDS, BAND_ROWS).astype(np.uint64)
                    bands.append(mix((grid * weight).sum(1) + np.arange(BANDS, dtype=np.uint64)).view(np.int64))
                    low.append(((sig * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8).tobytes())  # eight mixed bits: minima are small, so their top bits say little
                else:
                    bands.append(np.empty(0, np.int64))
                    low.append(b"")
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in bands]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(bands))), pa.array(low, pa.binary())],
                names=["doc_id", "n_shingles", "k1", "k2", "bands", "low"],
            )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")).mapInArrow(kernel, f"doc_id {docs.schema[id_col].dataType.simpleString()}, {SKETCH}")


def prune_table(total: int, batch: int, threshold: float, miss: float) -> dict[int, int]:
    """For each number of compared hashes, the fewest agreements with which a
    pair stays: below it P(similarity >= threshold | agreements) < miss.

    Prior: uniform on [0, 1]. Signatures hold 8 mixed bits of each minimum, so
    one in 256 also agrees by chance; that is not subtracted, which only keeps
    more pairs.
    """
    grid = np.linspace(0.0005, 0.9995, 1000)
    out = {}
    for n in range(batch, total + 1, batch):
        out[n] = n + 1
        for m in range(n + 1):
            post = m * np.log(grid) + (n - m) * np.log1p(-grid)
            post = np.exp(post - post.max())
            if post[grid >= threshold].sum() / post.sum() >= miss:
                out[n] = m
                break
    return out


def _compare(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, least: dict[int, int], batch: int) -> np.ndarray:
    """Which of the pairs (x[i], y[j]) outlast all batches of hashes."""
    live, agree = np.arange(len(i)), np.zeros(len(i), np.int64)
    for n in range(batch, x.shape[1] + 1, batch):
        agree[live] += (x[i[live], n - batch : n] == y[j[live], n - batch : n]).sum(1)
        live = live[agree[live] >= least[n]]
    return live


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BANDS * BAND_ROWS)


def bayes_survivors(pairs: DataFrame, threshold: float = 0.75, miss: float = 1e-4, batch: int = 40) -> DataFrame:
    """Of pairs (a, b, low_a, low_b), those that sequential comparison keeps."""
    least = prune_table(BANDS * BAND_ROWS, batch, threshold, miss)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if rows.num_rows:
                every = np.arange(rows.num_rows)
                live = _compare(_signatures(rows.column(2)), _signatures(rows.column(3)), every, every, least, batch)
                yield rows.select(["a", "b"]).take(pa.array(live))

    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.select("a", "b", "low_a", "low_b").mapInArrow(kernel, f"a {kind}, b {kind}")


def _overlaps(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many values of a sorted set are in each of some others."""
    joined = np.concatenate(others)
    hit = one[np.minimum(np.searchsorted(one, joined), len(one) - 1)] == joined
    return np.add.reduceat(hit.astype(np.int64), np.cumsum([0, *map(len, others[:-1])]))


def cross_links(left: DataFrame, right: DataFrame, percent: int = 75, miss: float = 1e-4, batch: int = 40, block: int = 512) -> DataFrame:
    """Links (a, b) of a left and a right row (g, id, c, low, text) of the same
    group g and of different components c.

    Groups are dealt out as blocks of left rows against blocks of right rows, so
    a task holds two blocks of one group at a time, however large the group is.
    Within a block, left rows are compared with all right rows batch by batch;
    survivors are verified on their full shingle sets, and only links leave.
    """
    least = prune_table(BANDS * BAND_ROWS, batch, percent / 100, miss)

    def block_links(rows: pa.RecordBatch) -> pa.RecordBatch | None:
        side, ids, c, low = (rows.column(k) for k in (3, 4, 5, 6))
        n = int((side.to_numpy() == 0).sum())
        if not n or n == len(side):
            return None
        sig, ids, c = _signatures(low), ids.to_numpy(), c.to_numpy()
        text, sets = rows.column(7), {}

        def held(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = shingle_sets(*texts(text.slice(k, 1)))[0]
            return sets[k]

        a, b = [], []
        for i in range(n):
            j = np.arange(n, len(ids))[c[n:] != c[i]]
            j = j[_compare(sig, sig, np.full(len(j), i), j, least, batch)]
            if len(j):
                own, others = held(i), [held(k) for k in j.tolist()]
                common = _overlaps(own, others)
                j = j[100 * common >= percent * (len(own) + np.array([len(x) for x in others]) - common)]
                a += np.minimum(ids[i], ids[j]).tolist()
                b += np.maximum(ids[i], ids[j]).tolist()
        return pa.RecordBatch.from_arrays([pa.array(a, rows.column(4).type), pa.array(b, rows.column(4).type)], names=["a", "b"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, 3):
            if (out := block_links(rows)) is not None:
                yield out

    kind = left.schema["id"].dataType.simpleString()
    return deal_blocks(left, right, ["g"], block).mapInArrow(kernel, f"a {kind}, b {kind}").distinct()


def exact_links(pairs: DataFrame, docs: DataFrame, percent: int = 75) -> DataFrame:
    """Pairs (a, b) whose full shingle sets have 100 * intersection >= percent *
    union. Texts move, not sets: they are the smaller of the two."""
    whole = docs.select(F.col("doc_id"), F.col("text"))
    both = pairs.join(whole.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").join(whole.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        _, at = texts(batch.column(3))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + CHUNK_BYTES, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = None, np.empty(0, np.uint64)
        for batch in batches:
            for part in slices(batch):
                keep = []
                for k, (a, own) in enumerate(zip(part.column(0).to_pylist(), shingle_sets(*texts(part.column(3))), strict=True)):
                    if a != seen:  # rows come sorted by a, so its set is made once
                        seen, held = a, shingle_sets(*texts(part.column(2).slice(k, 1)))[0]
                    at = np.searchsorted(held, own)
                    common = int((held[np.minimum(at, len(held) - 1)] == own).sum()) if len(held) else 0
                    keep.append(100 * common >= percent * (len(held) + len(own) - common) and common > 0)
                yield part.select(["a", "b"]).filter(pa.array(keep))

    kind = pairs.schema["a"].dataType.simpleString()
    return both.mapInArrow(kernel, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, scratch: Scratch, percent: int = 75, miss: float = 1e-4) -> DataFrame:
    """One row (doc_id, n_shingles, component_id, kept) for each document.

    Rows count one by one: rows that repeat a doc_id with other texts are judged
    apart, and component_id is the smallest doc_id among the rows reachable. Null
    ids come after all others, so they only lead a class of their own, whose
    component_id is null. Null texts, and texts without words, have an empty set,
    link with nothing and are kept. Texts of fewer than five words are one
    shingle. Extra columns are not read; an empty table gives an empty result.
    """
    rows, other = row_keys(docs.select("doc_id", "text"), scratch)
    classes = row_classes(rows.select(F.col("__row").alias("doc_id"), "text"), scratch, percent, miss)
    if other:
        ids = rows.select("__row", F.col("doc_id").alias("__id"))
        lead = ids.select(F.col("__row").alias("component_id"), F.col("__id").alias("__lead"))
        classes = classes.join(lead, "component_id").join(ids, classes["doc_id"] == ids["__row"]).select(F.col("__id").alias("doc_id"), "n_shingles", F.col("__lead").alias("component_id"))
    return classes.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def row_classes(docs: DataFrame, scratch: Scratch, percent: int, miss: float) -> DataFrame:
    """(doc_id, n_shingles, component_id) of documents with unique ids.

    In each band's bucket the smallest id stands as leader and is paired with
    the others (one row a member, never all pairs of a bucket). Members that
    turn out to lie in another component than their leader are then compared, in
    blocks, with all members of the buckets of leaders of that component, so no
    link that the bands can see is lost. Hot groups are salted or split by
    adaptive skew handling, blocks bound what a task holds.
    """
    threshold = percent / 100
    sketch = scratch.keep(sketches(docs), "sketch")
    members = sketch.select("doc_id", "n_shingles", "k1", "k2")
    worded = members.where("n_shingles > 0")
    reps = scratch.keep(worded.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "reps")
    lone = sketch.join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "bands", "low")
    lone = scratch.keep(lone, "lone")
    entries = lone.select("rep", F.explode("bands").alias("key"))
    low = lone.select("rep", "low")

    buckets = entries.groupBy("key").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).where("n > 1")
    crowd = scratch.keep(entries.join(buckets, "key").where("rep <> leader").select("key", "leader", "rep", "n"), "crowd")

    star = crowd.select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    star = star.join(low.select(F.col("rep").alias("b"), F.col("low").alias("low_b")), "b").join(low.select(F.col("rep").alias("a"), F.col("low").alias("low_a")), "a")
    left = scratch.keep(bayes_survivors(star, threshold, miss), "star_left")
    links = scratch.keep(exact_links(left, docs, percent), "star_links")
    labels = components(links, scratch, "star")

    # members of buckets of three and more that lie in another component than their leader
    of = labels.select(F.col("id").alias("rep"), F.col("component").alias("c"))
    rest = crowd.where("n > 2").join(of, "rep", "left").select("leader", "rep", F.coalesce("c", "rep").alias("c")).distinct()
    rest = scratch.keep(rest.join(of.select(F.col("rep").alias("leader"), F.col("c").alias("lc")), "leader", "left").select(F.coalesce("lc", "leader").alias("g"), "rep", "c").distinct(), "beside")
    whole = salted(rest, rest.where("c <> g").select("g").distinct(), ["g"], "rep", "left_semi").join(low, "rep").join(docs.withColumnRenamed("doc_id", "rep"), "rep")
    whole = scratch.keep(whole.select("g", F.col("rep").alias("id"), "c", "low", "text"), "rest")
    more = scratch.keep(cross_links(whole.where("c <> g"), whole, percent, miss), "cross_links")
    labels = components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more), scratch, "all")
    scratch.drop("lone", "crowd", "star_left", "star_links", "beside", "rest")

    # rows without words, which have one key, stay out of the join
    classes = worded.join(reps, ["k1", "k2"], "left").join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    return classes.union(members.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
