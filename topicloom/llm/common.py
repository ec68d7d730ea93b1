"""Shared pieces of the training-data operators: scratch tables in the
cluster's shared folder, byte-level word kernels, connected components."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.sources.scratch import shared_dir

#: Words are maximal runs of bytes other than these.
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Text bytes that one kernel call handles; a longer document is handled alone.
CHUNK_BYTES = 1 << 20
#: A longer document is read in pieces of so many bytes.
PIECE_BYTES = CHUNK_BYTES

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Scratch:
    """Written tables that cut lineage. They live in the shared folder, so a
    lost executor loses nothing; ``drop`` frees one that is no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
        """Writes a table, in folders by the last columns if asked, and reads it."""
        schema = df.schema
        df.write.option("compression", "zstd").partitionBy(*by).parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def row_keys(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, bool]:
    """docs with a unique ``__row`` in the order of ids, and whether that is other
    than the id, which stands for its row unless some ids are null or repeated.
    Then rows go by id, nulls last, and by the hash of their texts."""
    if not docs.groupBy(id_col).agg(F.count("*").alias("n")).where(F.col(id_col).isNull() | (F.col("n") > 1)).limit(1).count():
        return docs.withColumn("__row", F.col(id_col)), False
    ordered = docs.orderBy(F.col(id_col).asc_nulls_last(), F.xxhash64(text_col))
    return scratch.keep(ordered.withColumn("__row", F.monotonically_increasing_id()), "rows"), True


def salted(side: DataFrame, few: DataFrame, keys: list[str], by: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """side joined with a table of one row a key: the rows of a hot key are dealt
    to ``salts`` tasks by another column, the other table is copied to each."""
    salt = F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")
    copied = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return side.withColumn("__salt", salt).join(copied, [*keys, "__salt"], how).drop("__salt")


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column, and where each row starts (one more at the
    end); null is the empty text."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches that hold about ``limit`` text bytes each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, at = texts(batch.column(batch.schema.get_field_index(column)))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
            yield batch.slice(first, last - first), raw[at[first] : at[last]], at[first : last + 1] - at[first]
            first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that near inputs give far outputs."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@functools.cache
def _byte_values(fold: bool, lane: int) -> np.ndarray:
    table = np.random.default_rng(7 + lane).integers(1, 1 << 63, 256, dtype=np.uint64)
    if fold:
        table[65:91] = table[97:123]
    return table


@functools.cache
def _white() -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(WHITE)] = True
    return table


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(max(n, 2 * CHUNK_BYTES), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(raw: np.ndarray, fold: bool = False, lane: int = 0) -> np.ndarray:
    """Running sums (one more than bytes) whose differences, times the inverse
    power at the start, hash any byte range."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_byte_values(fold, lane)[raw] * powers(len(raw))[0], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges [start, end)."""
    inverse = powers(len(sums))[1]
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def is_long(raw: np.ndarray, at: np.ndarray) -> bool:
    """Whether a block is one document that has to be read in pieces."""
    return len(at) == 2 and len(raw) > PIECE_BYTES


def span_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """range_hash of any byte ranges. Sums are taken piece by piece and kept at
    the ends of ranges alone, so memory follows the ranges, not the bytes."""
    if len(raw) <= 2 * PIECE_BYTES:
        return range_hash(prefix_hash(raw, lane=lane), start, end)
    places = np.unique(np.concatenate((start, end)))
    sums, inverse = np.zeros(len(places), np.uint64), np.zeros(len(places), np.uint64)
    before = np.zeros(1, np.uint64)
    for low in range(0, len(raw) + 1, PIECE_BYTES):
        own = prefix_hash(raw[low : low + PIECE_BYTES], lane=lane)
        up, down = (np.uint64(pow(int(x), low, 1 << 64)) for x in (_BASE, _BASE_INV))
        a, b = np.searchsorted(places, (low, low + PIECE_BYTES))
        local = places[a:b] - low
        sums[a:b] = before + own[local] * up
        inverse[a:b] = powers(len(own))[1][local] * down
        before += own[-1:] * up
    first = np.searchsorted(places, start)
    return mix((sums[np.searchsorted(places, end)] - sums[first]) * inverse[first] + (end - start).astype(np.uint64))


def run_values(raw: np.ndarray, breaks: bytes, fold: bool = False, lane: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes (those of range_hash) of one text's maximal runs of bytes other than
    ``breaks``, and which runs hold a word, piece by piece. A run that goes on
    beyond a piece carries its sum into the next."""
    stop = np.zeros(256, bool)
    stop[list(breaks)] = True
    held = np.zeros(1, np.uint64), np.zeros(1, np.int64), np.zeros(1, bool)
    for low in range(0, len(raw), PIECE_BYTES):
        piece = raw[low : low + PIECE_BYTES]
        edges = np.flatnonzero(np.diff(~stop[piece], prepend=False, append=False))
        start, end = edges[::2], edges[1::2]
        sums = prefix_hash(piece, fold, lane)
        value, size = (sums[end] - sums[start]) * powers(len(sums))[1][start], end - start
        solid = np.concatenate(([0], np.cumsum(~_white()[piece])))
        solid = solid[end] > solid[start]
        if held[1][0]:
            if len(start) and start[0] == 0:
                value[:1] = held[0] + value[:1] * np.uint64(pow(int(_BASE), int(held[1][0]), 1 << 64))
                size[0] += held[1][0]
                solid[0] |= held[2][0]
            else:
                value, size, solid = (np.concatenate(x) for x in zip(held, (value, size, solid), strict=True))
        held = np.zeros(1, np.uint64), np.zeros(1, np.int64), np.zeros(1, bool)
        if len(end) and end[-1] == len(piece) and low + len(piece) < len(raw):
            held = value[-1:], size[-1:], solid[-1:]
            value, size, solid = value[:-1], size[:-1], solid[:-1]
        yield mix(value + size.astype(np.uint64)), solid


def word_windows(raw: np.ndarray, size: int, fold: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of one text's words and of its runs of ``size`` words, piece by piece."""
    tail = np.empty(0, np.uint64)
    for value, _ in run_values(raw, WHITE, fold):
        tail = np.concatenate((tail, value))
        yield value, windows(tail, size)
        tail = tail[max(0, len(tail) - size + 1) :]


def characters_before(raw: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Code points before each of some sorted places, counted piece by piece."""
    out, before = np.zeros(len(places), np.int64), 0
    for low in range(0, len(raw) + 1, PIECE_BYTES):
        seen = np.concatenate(([0], np.cumsum((raw[low : low + PIECE_BYTES] & 0xC0) != 0x80)))
        a, b = np.searchsorted(places, (low, low + PIECE_BYTES))
        out[a:b] = before + seen[places[a:b] - low]
        before += int(seen[-1])
    return out


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts and ends in bytes, and each document's first word number
    (one more at the end). Words don't cross documents."""
    solid = ~_white()[raw]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    cut = at[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    begins[cut] |= solid[cut]
    ends[cut - 1] |= solid[cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, at)


def windows(values: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every run of ``size`` values; the result is shorter by
    size - 1."""
    n = max(0, len(values) - size + 1)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += values[j : j + n]
    return mix(out)


def components(links: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """Connected components of links (a, b): one row (id, component) for each id
    that has a link, where component is the smallest id reachable.

    Every round each id takes the smallest label among its neighbours and then
    the label of its label, so that chains shorten by about half; rounds end
    when no label moves. Nothing but a count reaches the driver.
    """
    edges = scratch.keep(links.select(F.col("a"), F.col("b")).union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{name}_edges")
    labels = scratch.keep(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select("id", F.least("id", "low").alias("component")), f"{name}_0")
    k = 0
    while True:
        near = edges.join(labels.withColumnRenamed("id", "b").withColumnRenamed("component", "theirs"), "b").groupBy(F.col("a").alias("id")).agg(F.min("theirs").alias("theirs"))
        step = labels.join(near, "id", "left").select("id", F.col("component").alias("was"), F.least("component", F.coalesce("theirs", "component")).alias("now"))
        jump = labels.select(F.col("id").alias("now"), F.col("component").alias("far"))
        after = step.join(jump, "now", "left").select("id", "was", F.least("now", F.coalesce("far", "now")).alias("component"))
        kept = scratch.keep(after, f"{name}_{k + 1}")
        moved = kept.where("component <> was").limit(1).count()
        if k:
            scratch.drop(f"{name}_{k}")
        labels, k = kept.select("id", "component"), k + 1
        if not moved:
            return labels


def deal_blocks(left: DataFrame, right: DataFrame, keys: list[str], block: int = 512) -> DataFrame:
    """Rows of both sides (left marked 0, right 1 in ``side``) by keys and by
    blocks ``l`` and ``r``: each block of left rows of a key meets each block of
    its right rows, so no task holds more than two blocks of a key at a time.
    Both sides have the same columns, among them ``id``."""
    sizes = left.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("nl")).join(right.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("nr")), keys)
    rest = [c for c in left.columns if c not in keys]

    def dealt(side: DataFrame, mark: int) -> DataFrame:
        own, other = ("nl", "nr") if mark == 0 else ("nr", "nl")
        mine, theirs = F.pmod(F.xxhash64("id"), F.col(own)).cast("int"), F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        l, r = (mine, theirs) if mark == 0 else (theirs, mine)
        return salted(side, sizes, keys, "id").select(*keys, l.alias("l"), r.alias("r"), F.lit(mark).alias("side"), *rest)

    return dealt(left, 0).union(dealt(right, 1)).repartition(*keys, "l", "r").sortWithinPartitions(*keys, "l", "r", "side")


def runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.RecordBatch]:
    """Rows of each run of equal values in the first ``n_keys`` integer columns,
    of which the batches come sorted."""
    held: list[pa.RecordBatch] = []
    last = None
    for rows in batches:
        if not rows.num_rows:
            continue
        keys = np.stack([rows.column(k).to_numpy(zero_copy_only=False) for k in range(n_keys)])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), rows.num_rows], strict=True):
            now = keys[:, a].tolist()
            if held and now != last:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            last = now
            held.append(rows.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
