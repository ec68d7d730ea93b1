"""Exact top-k search by inner product over a pivot-distance index.

Vectors are whole numbers. Each is keyed by its nearest pivot and its distance to it,
and blocks of vectors lie in that order. As 2 q.x = |q|^2 + |x|^2 - |q - x|^2 and
|q - x| >= |d(q, p) - d(x, p)|, an annulus of one pivot's vectors has a largest score
that no member exceeds. The k-th score within a query's own block tells which blocks
it has to see; there, annuli are taken from the nearest one on, while the bounds of
the rest can still reach the k-th score so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.common import Scratch
from topicloom.llm.vectors import k_means

#: Whole numbers up to here are exact in single precision; sums up to EXACT in double.
SINGLE, EXACT = 1 << 24, 1 << 53
#: Squared norms beyond this are not computed with.
HUGE = 1e290
#: Relative error allowed for in distances.
MARGIN = 1e-6
LONG = (1 << 63) - 1

CODED = "vec_id bigint, dim int, pivot int, radius double, norm double, vector binary"
BLOCKS = "block bigint, dim int, ids array<bigint>, pivots binary, radii binary, norms binary, vectors binary, run_pivot array<int>, run_low array<double>, run_high array<double>, run_norm array<double>"
ASKED = "asked bigint, dim int, ids array<bigint>, places binary, least binary, norms binary, vectors binary, reach double, low array<double>, high array<double>"
FOUND = "asked bigint, place int, query_id bigint, block bigint, at int, vec_id bigint, score bigint"


def whole(vectors: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(256 * vectors.astype(np.float64)), -1e300, 1e300)


def packed(vectors: np.ndarray) -> bytes:
    """Single precision where it holds the whole numbers, else double."""
    return vectors.astype(np.float32 if np.abs(vectors).max(initial=0) <= SINGLE else np.float64).tobytes()


def unpacked(raw: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(raw, np.float32 if len(raw) == 4 * n * dim else np.float64).reshape(n, dim).astype(np.float64)


def norms_of(vectors: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = (vectors * vectors).sum(1)
    return np.where(out < HUGE, out, np.inf)


def distances(vectors: np.ndarray, norms: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Of each vector to each pivot; 0 for vectors that are not computed with."""
    fit = np.isfinite(norms)
    x = np.where(fit[:, None], vectors, 0.0)
    d = (x * x).sum(1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(1)
    return np.where(fit[:, None], np.sqrt(np.maximum(d, 0.0)), 0.0)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products; those beyond 64 bits count as the last that fits."""
    largest = np.sqrt(norms_of(q).max(initial=0)) * np.sqrt(norms_of(x).max(initial=0))
    if largest < EXACT:
        return (q @ x.T).astype(np.int64)
    whole_numbers = [np.array([[int(c) for c in row] for row in m], object).reshape(m.shape) for m in (q, x)]
    return np.clip(whole_numbers[0] @ whole_numbers[1].T, -LONG - 1, LONG).astype(np.int64)


def fitted_pivots(valid: DataFrame, rows: int, sample_rows: int, sample_bytes: int, list_rows: int, most: int) -> dict[int, np.ndarray]:
    """Pivots by length of vectors, the origin first, about one for ``list_rows``
    vectors and at most ``most``. They are centres of a sample of at most
    ``sample_rows`` vectors and ``sample_bytes``; lengths not in it have the origin."""
    longest = valid.agg(F.max(F.size("embedding"))).first()[0] or 1
    limit = max(1, min(sample_rows, sample_bytes // (8 * max(longest, 1))))
    picked = valid.select("vec_id", "embedding")
    if rows > limit:
        picked = picked.where(F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(1 << 30)) < int(0.9 * limit / rows * (1 << 30)))
    by_dim: dict[int, list] = {}
    for _, v in sorted(((r[0] is not None, r[0] or 0), r[1]) for r in picked.limit(limit).collect()):
        by_dim.setdefault(len(v), []).append(v)
    out, total = {}, sum(map(len, by_dim.values()))
    for dim, held in by_dim.items():
        x = whole(np.array(held, np.float64).reshape(len(held), dim))
        x = x[np.isfinite(norms_of(x))]
        k = max(1, min(round(rows * len(held) / total / list_rows), most, len(x) // 8))
        centres = np.rint(k_means(x, k, 6, np.random.default_rng(5))) if len(x) and dim else np.zeros((0, dim))
        out[dim] = np.concatenate((np.zeros((1, dim)), centres))
    return out


def _pivots(held: dict[int, np.ndarray], dim: int) -> np.ndarray:
    return held.get(dim, np.zeros((1, dim)))


def _coded(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, lists = batch.column(0), batch.column(1)
        sizes = np.diff(lists.offsets.to_numpy())
        flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64)
        at = np.concatenate(([0], np.cumsum(sizes)))
        for dim in np.unique(sizes).tolist():
            mine = np.flatnonzero(sizes == dim)
            x = whole(np.stack([flat[at[k] : at[k] + dim] for k in mine]).reshape(len(mine), dim))
            norms = norms_of(x)
            d = distances(x, norms, _pivots(sent.value, dim))
            pivot = np.where(np.isfinite(norms), d.argmin(1), 0)
            columns = [ids.take(pa.array(mine)), pa.array(np.full(len(mine), dim, np.int32)), pa.array(pivot.astype(np.int32)), pa.array(d[np.arange(len(mine)), pivot]), pa.array(norms), pa.array([packed(v) for v in x], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in CODED.split(", ")])


def _blocks(batches: Iterator[pa.RecordBatch], size: int, limit: int) -> Iterator[pa.RecordBatch]:
    """BLOCKS rows of CODED rows in the order of the index: at most ``size`` vectors of
    one length and about ``limit`` bytes each."""
    number = TaskContext.get().partitionId() << 33
    held: list[tuple] = []
    bytes_held = 0

    def block() -> pa.RecordBatch:
        n, dim = len(held), held[0][1]
        x = np.stack([np.frombuffer(r[5], np.float32 if len(r[5]) == 4 * dim else np.float64).astype(np.float64) for r in held])
        pivots, radii, norms = (np.array([r[k] for r in held], t) for k, t in ((2, np.int32), (3, np.float64), (4, np.float64)))
        first = np.flatnonzero(np.concatenate(([True], pivots[1:] != pivots[:-1])))
        last = np.concatenate((first[1:], [n])) - 1
        row = [number, dim, [r[0] for r in held], pivots.tobytes(), radii.tobytes(), norms.tobytes(), packed(x), pivots[first].tolist(), radii[first].tolist(), radii[last].tolist(), np.maximum.reduceat(norms, first).tolist()]
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), *[pa.binary()] * 4, pa.list_(pa.int32()), *[pa.list_(pa.float64())] * 3]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=[f.split()[0] for f in BLOCKS.split(", ")])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (row[1] != held[0][1] or len(held) >= size or bytes_held >= limit):
                yield block()
                number, held, bytes_held = number + 1, [], 0
            held.append(row)
            bytes_held += len(row[5])
    if held:
        yield block()


def _best(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first of each row (query): high scores, then small ids."""
    order = np.lexsort((places, ids, ~scores, rows))
    r = rows[order]
    start = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1]))) if len(r) else np.empty(0, np.int64)
    rank = np.arange(len(r)) - np.repeat(start, np.diff(np.concatenate((start, [len(r)]))))
    return order[rank < k]


def _asked(batches: Iterator[pa.RecordBatch], sent, every: int, k: int) -> Iterator[pa.RecordBatch]:
    """ASKED rows: the queries of each block, their k-th scores within it, how near
    and far they lie from each pivot, and how far their scores reach."""
    for batch in batches:
        for block, dim, ids, vectors in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            mine = np.array([j for j, x in enumerate(ids) if x is not None and x % every == 0], np.int64)
            if not len(mine):
                continue
            x = unpacked(vectors, len(ids), dim)
            q, least = x[mine], np.full(len(mine), -LONG - 1, np.int64)
            for a in range(0, len(mine) if len(ids) > k else 0, 256):
                s = products(q[a : a + 256], x)
                s[np.arange(len(s)), mine[a : a + 256]] = -LONG - 1
                least[a : a + 256] = np.partition(s, len(ids) - k, 1)[:, len(ids) - k]
            norms = norms_of(q)
            d = distances(q, norms, _pivots(sent.value, dim))
            few = (least == -LONG - 1) | ~np.isfinite(norms)
            reach = np.where(few, np.inf, norms * (1 + MARGIN) - 2 * least.astype(np.float64))
            row = [block, dim, [ids[j] for j in mine], mine.astype(np.int32).tobytes(), least.tobytes(), norms.tobytes(), packed(q), float(reach.max()), d.min(0).tolist(), d.max(0).tolist()]
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), *[pa.binary()] * 4, pa.float64(), *[pa.list_(pa.float64())] * 2]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=[f.split()[0] for f in ASKED.split(", ")])


def annuli(pivots: np.ndarray, radii: np.ndarray, norms: np.ndarray, size: int) -> Iterator[tuple[int, list[tuple[int, int]], np.ndarray, np.ndarray, np.ndarray]]:
    """Of each pivot in a block: its annuli (first, last) of ``size`` vectors at most,
    their inner and outer radii, and their largest squared norms."""
    ends = [0, *(np.flatnonzero(pivots[1:] != pivots[:-1]) + 1).tolist(), len(pivots)]
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        cuts = list(range(a, b, size))
        spans = list(zip(cuts, [*cuts[1:], b], strict=True))
        yield int(pivots[a]), spans, radii[cuts], radii[[y - 1 for _, y in spans]], np.maximum.reduceat(norms[a:b], np.array(cuts) - a)


def expanded(x: np.ndarray, ids: np.ndarray, pivots: np.ndarray, radii: np.ndarray, norms: np.ndarray, q: np.ndarray, least: np.ndarray, q_norms: np.ndarray, own: np.ndarray, centres: np.ndarray, k: int, size: int = 256, seen: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place in the block, score) of each query's k best that reach ``least``.
    own: a query's place in this block, -1 where it is of another one. Annuli go
    from the nearest to all queries on; one that can't reach a query's k-th score is
    not compared with it. ``seen`` gets the number of products made."""
    far = distances(q, q_norms, centres)
    steps = []
    for pivot, spans, low, high, norm in annuli(pivots, radii, norms, size):
        d = far[:, pivot][:, None]
        gap = np.maximum(0.0, np.maximum(low - d, d - high))
        with np.errstate(invalid="ignore"):
            bound = (q_norms[:, None] + norm - gap * gap + MARGIN * (q_norms[:, None] + norm + (centres[pivot] ** 2).sum())) / 2
        steps += [(float(gap[:, j].mean()), span, bound[:, j]) for j, span in enumerate(spans)]
    least, best = least.copy(), [np.empty(0, np.int64)] * 3
    for _, (a, b), bound in sorted(steps, key=lambda s: s[0]):
        open_ = np.flatnonzero(~(bound < least))
        if not len(open_):
            continue
        if seen is not None:
            seen.append(len(open_) * (b - a))
        s = products(q[open_], x[a:b])
        i, j = np.nonzero(s >= least[open_][:, None])
        rows, places, scores = open_[i], j + a, s[i, j]
        other = own[rows] != places
        rows, places, scores = (np.concatenate((old, new[other])) for old, new in zip(best, (rows, places, scores), strict=True))
        kept = _best(rows, scores, ids[places], places, k)
        best = [rows[kept], places[kept], scores[kept]]
        full = np.flatnonzero(np.bincount(best[0], minlength=len(q)) == k)
        lowest = np.full(len(q), LONG, np.int64)
        np.minimum.at(lowest, best[0], best[2])
        least[full] = np.maximum(least[full], lowest[full])
    return best[0], best[1], best[2]


def _searched(batches: Iterator[pa.RecordBatch], sent, k: int) -> Iterator[pa.RecordBatch]:
    """FOUND rows of sorted rows: a block, then the queries that have to see it."""
    names = [f.split()[0] for f in FOUND.split(", ")]
    for batch in batches:
        for block, _, kind, asked, dim, ids, first, second, norms, vectors in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            norms = np.frombuffer(norms, np.float64)
            rows = unpacked(vectors, len(ids), dim)
            if kind == 0:
                x, named, x_norms = rows, ids, norms
                pivots, radii = np.frombuffer(first, np.int32), np.frombuffer(second, np.float64)
                order = np.array([LONG if v is None else v for v in ids], np.int64)  # rows without an id come last
                continue
            places = np.frombuffer(first, np.int32)
            own = places.astype(np.int64) if asked == block else np.full(len(places), -1, np.int64)
            i, j, s = expanded(x, order, pivots, radii, x_norms, rows, np.frombuffer(second, np.int64), norms, own, _pivots(sent.value, dim), k)
            if len(i):
                columns = [pa.array(np.full(len(i), asked)), pa.array(places[i]), pa.array([ids[v] for v in i.tolist()], pa.int64()), pa.array(np.full(len(i), block)), pa.array(j.astype(np.int32)), pa.array([named[v] for v in j.tolist()], pa.int64()), pa.array(s)]
                yield pa.RecordBatch.from_arrays(columns, names=names)


def top_k(table: DataFrame, scratch: Scratch, k: int = 5, every: int = 50, list_rows: int = 1000, most_pivots: int = 1024, sample_rows: int = 20000, sample_bytes: int = 32 << 20, block_rows: tuple[int, int] = (1024, 32768), block_bytes: int = 8 << 20, together: int = 32) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of ``table`` (vec_id, embedding) with
    the highest inner products, for each row whose vec_id ``every`` divides; all, if
    there are fewer. Components are floor(256 * x). Equal scores go by vec_id, rows
    without one last.

    A query is a row, so rows that repeat its vec_id are candidates, and repeated
    queries have a result each. Null vectors and those with null or non-finite
    components take no part; vectors of another length are never compared; empty
    ones have the product 0. Products are exact; beyond 64 bits they count as the last
    number that fits. An empty table gives no rows.

    Pivots are fitted on a bounded sample; all rows are indexed, and all that the
    bounds allow are compared. A block has at most ``block_rows[1]`` vectors and about
    ``block_bytes``; up to ``together`` sets of queries meet one copy of it, so a task
    holds one block, whatever the number of queries.
    """
    spark = table.sparkSession
    number = F.col("embedding").cast("array<double>")
    fine = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    valid = table.select(F.col("vec_id").cast("long").alias("vec_id"), number.alias("embedding")).where(F.col("embedding").isNotNull()).where(fine)
    rows = valid.count()
    pivots = spark.sparkContext.broadcast(fitted_pivots(valid, rows, sample_rows, sample_bytes, list_rows, most_pivots))  # at most sample_bytes
    coded = scratch.keep(valid.mapInArrow(lambda batches: _coded(batches, pivots), CODED), "coded")
    order = ["dim", "pivot", "radius", "vec_id"]
    size = max(block_rows[0], min(block_rows[1], rows // 64))
    blocks = scratch.keep(coded.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda batches: _blocks(batches, size, block_bytes), BLOCKS), "blocks")
    asked = scratch.keep(blocks.select("block", "dim", "ids", "vectors").mapInArrow(lambda batches: _asked(batches, pivots, every, k), ASKED), "asked")

    runs = blocks.select("block", "dim", F.explode(F.arrays_zip("run_pivot", "run_low", "run_high", "run_norm")).alias("r")).select("block", "dim", F.col("r.run_pivot").alias("pivot"), "r.run_low", "r.run_high", "r.run_norm")
    near = asked.select("asked", "dim", "reach", F.posexplode(F.arrays_zip("low", "high")).alias("pivot", "d")).select("asked", "dim", "reach", "pivot", "d.low", "d.high")
    gap = F.greatest(F.lit(0.0), F.col("run_low") - F.col("high"), F.col("low") - F.col("run_high")) * (1 - MARGIN)
    pairs = near.join(runs, ["dim", "pivot"]).where((F.col("reach") == float("inf")) | (gap * gap <= F.col("reach") + F.col("run_norm") * (1 + 2 * MARGIN))).select("asked", "block").distinct()
    pairs = scratch.keep(pairs, "pairs")
    sizes = scratch.keep(pairs.groupBy("block").agg(F.ceil(F.count("*") / together).cast("int").alias("parts")), "sizes")

    part = F.pmod(F.xxhash64("asked"), F.col("parts")).cast("int").alias("part")
    sets = pairs.join(sizes, "block").select("asked", "block", part).join(asked, "asked").select("block", "part", F.lit(1).alias("kind"), "asked", "dim", "ids", F.col("places").alias("first"), F.col("least").alias("second"), "norms", "vectors")
    whole_blocks = blocks.join(sizes, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.lit(None).cast("long"), "dim", "ids", "pivots", "radii", "norms", "vectors")
    met = whole_blocks.union(sets).repartition("block", "part").sortWithinPartitions("block", "part", "kind")
    found = scratch.keep(met.mapInArrow(lambda batches: _searched(batches, pivots, k), FOUND), "found")
    rank = F.row_number().over(Window.partitionBy("asked", "place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "block", "at"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
