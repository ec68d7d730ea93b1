"""Embedding near-dedup by product quantisation.

Unit vectors lie in coarse inverted lists and are coded as residuals, one code
a subspace. A vector probes the lists near it; asymmetric table-lookup
distances, with each code's own error, leave the pairs that can reach the
threshold, and exact cosines decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import Scratch, components, deal_blocks, row_keys, runs


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of each row to each centre."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0.0)


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres).argmin(1)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; scaled first, so that no square
    over- or underflows."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(1, keepdims=True, initial=0.0)
    return rows / np.sqrt((rows * rows).sum(1))[:, None]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


class Quantiser:
    """Inverted lists and one codebook for each subspace of the residuals, for
    vectors of one dimension. A list is a pair of centres, one of either half of
    the dimensions, so k centres a half make k * k lists and a bounded sample can
    fit as many lists as the vectors need."""

    def __init__(self, sample: np.ndarray, k: int, subspaces: int, codes: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        x = unit(sample)
        self.halves = np.array_split(np.arange(x.shape[1]), min(2, x.shape[1]))
        self.centres = [k_means(x[:, h], k, 8, rng) for h in self.halves]
        rest = x - self.centre(self.probes(x, 1)[:, 0])
        self.spans = np.array_split(np.arange(x.shape[1]), min(subspaces, x.shape[1]))
        self.books = [k_means(rest[:, s], codes, 8, rng) for s in self.spans]

    def centre(self, lists: np.ndarray) -> np.ndarray:
        if len(self.halves) == 1:
            return self.centres[0][lists]
        return np.concatenate((self.centres[0][lists // len(self.centres[1])], self.centres[1][lists % len(self.centres[1])]), 1)

    def probes(self, x: np.ndarray, n: int, block: int = 1024) -> np.ndarray:
        """The n nearest lists of each unit vector, the nearest first."""
        out = []
        for a in range(0, len(x), block):
            far = [_nearest(x[a : a + block, h], c) for h, c in zip(self.halves, self.centres, strict=True)]
            near = [np.argsort(d, 1, kind="stable")[:, :n] for d in far]
            if len(far) == 1:
                out.append(near[0])
                continue
            d = [np.take_along_axis(f, i, 1) for f, i in zip(far, near, strict=True)]
            lists = (near[0][:, :, None] * len(self.centres[1]) + near[1][:, None, :]).reshape(len(d[0]), -1)
            best = np.argsort((d[0][:, :, None] + d[1][:, None, :]).reshape(len(d[0]), -1), 1, kind="stable")[:, :n]
            out.append(np.take_along_axis(lists, best, 1))
        return np.concatenate(out)

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of unit vectors in their lists, and how far each lies from its code."""
        rest = x - self.centre(own)
        codes = np.stack([_nearest(rest[:, s], b).argmin(1) for s, b in zip(self.spans, self.books, strict=True)], 1).astype(np.uint8)
        err = sum((((rest[:, s] - b[codes[:, k]]) ** 2).sum(1) for k, (s, b) in enumerate(zip(self.spans, self.books, strict=True))), np.zeros(len(x)))
        return codes, np.sqrt(err)

    def distances(self, x: np.ndarray, own: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries to the coded vectors of a list, by tables."""
        rest, out = x - self.centre(np.array([own])), np.zeros((len(x), len(codes)))
        for k, (s, b) in enumerate(zip(self.spans, self.books, strict=True)):
            out += _nearest(rest[:, s], b)[:, codes[:, k]]
        return out


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row that each row reaches through pairs (i, j)."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[i], low[j])
        after = low.copy()
        np.minimum.at(after, i, m)
        np.minimum.at(after, j, m)
        after = after[after]
        if (after == low).all():
            return low
        low = after


def fitted(reps: DataFrame, sample_rows: int, list_rows: int, subspaces: int, codes: int) -> dict[int, Quantiser]:
    """A quantiser for each length of vectors. About nine tenths of
    ``sample_rows`` vectors, picked by a threshold on their hashed ids, reach the
    driver, and never more than ``sample_rows``, however many tasks there are."""
    models = {}
    for dim, n in sorted((r.dim, r.n) for r in reps.groupBy("dim").agg(F.count("*").alias("n")).collect()):
        rows = reps.where(F.col("dim") == dim).select("id", "embedding")
        if n > sample_rows:
            rows = rows.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < int(0.9 * sample_rows / n * (1 << 30)))
        picked = sorted((tuple(r) for r in rows.limit(sample_rows).collect()), key=lambda r: r[0])
        lists = round((n / list_rows) ** 0.5)
        models[dim] = Quantiser(np.array([r[1] for r in picked], np.float64), max(1, min(lists, len(picked) // 16)), subspaces, codes)
    return models


def vector_duplicates(table: DataFrame, scratch: Scratch, cosine: float = 0.93, probes: int = 32, list_rows: int = 1000, subspaces: int = 8, codes: int = 256, sample_rows: int = 20000, block: int = 512) -> DataFrame:
    """One row (vec_id, n_links, component_id, kept) for each row of ``table``.

    Vectors link only within a label. Null, zero and non-finite vectors, and
    those without a label or an id, link with nothing; vectors of unequal lengths don't
    link. Equal vectors collapse first and count as often as they occur. The
    quantisers are fitted on at most ``sample_rows`` vectors of each length; every
    vector is indexed, and probes its ``probes`` nearest of about n / list_rows
    lists. Table distances to codes leave, block by block, the vectors that can
    reach another; of those alone the exact vectors are brought together. Links
    found are exact, and each counts once though both ends may find it. Rows that
    repeat a vec_id are vectors of their own; an empty table gives an empty result.
    """
    spark = table.sparkSession
    rows, other = row_keys(table.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")), scratch, "vec_id", "embedding")
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    good = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(whole)
    groups = good.groupBy("label", "embedding").agg(F.min("__row").alias("id"), F.count("*").alias("copies"))
    reps = scratch.keep(groups.withColumn("dim", F.size("embedding")), "reps")
    sent = spark.sparkContext.broadcast(fitted(reps, sample_rows, list_rows, subspaces, codes))  # centres and codebooks: at most sample_rows / 8 + codes rows a length

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                model, x = sent.value[int(dim)], unit(_matrix(part.column(1)))
                near = model.probes(x, probes)
                code, err = model.encode(x, near[:, 0])
                query = x.astype(np.float16)
                loss = np.sqrt(((x - query) ** 2).sum(1))
                offsets = np.arange(0, near.size + 1, near.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in (0, 3, 2)), pa.array(near[:, 0].astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(near.ravel().astype(np.int32))), pa.array([q.tobytes() for q in query], pa.binary()), pa.array(loss), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(err)],
                    names=["label", "dim", "id", "own", "probes", "query", "loss", "code", "err"],
                )

    kind = rows.schema["__row"].dataType.simpleString()
    label = table.schema["label"].dataType.simpleString()
    indexed = reps.select("label", "embedding", "id", "dim").mapInArrow(assign, f"label {label}, dim int, id {kind}, own int, probes array<int>, query binary, loss double, code binary, err double")
    indexed = scratch.keep(indexed, "indexed")
    # a query moves as 16-bit numbers, what is stored as a code; both with what they lose
    queries = indexed.select("label", "dim", F.explode("probes").alias("list"), "id", F.col("query").alias("bytes"), F.col("loss").alias("off"))
    stored = indexed.select("label", "dim", F.col("own").alias("list"), "id", F.col("code").alias("bytes"), F.col("err").alias("off"))
    reach = float(np.sqrt(2 - 2 * cosine))
    keys = ["label", "dim", "list", "l", "r"]

    def sides(rows: pa.RecordBatch) -> int:
        """How many rows are queries, if both sides are there."""
        n = int((rows.column(5).to_numpy() == 0).sum())
        return n if n < rows.num_rows else 0

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, 5):
            if not (n := sides(rows)):
                continue
            model, here, ids = sent.value[rows.column(1)[0].as_py()], rows.column(2)[0].as_py(), rows.column(6).to_numpy()
            held, off = rows.column(7).to_pylist(), rows.column(8).to_numpy()
            x = np.frombuffer(b"".join(held[:n]), np.float16).reshape(n, -1).astype(np.float64)
            code = np.frombuffer(b"".join(held[n:]), np.uint8).reshape(rows.num_rows - n, -1)
            near = model.distances(x, here, code) <= (reach + off[:n, None] + off[n:] + 1e-9) ** 2
            near &= ids[:n, None] != ids[n:]
            hit = np.flatnonzero(np.concatenate((near.any(1), near.any(0))))
            if len(hit):
                yield rows.take(pa.array(hit)).select([*keys, "side", "id"])

    survivors = deal_blocks(queries, stored, keys[:3], block).mapInArrow(search, f"label {label}, dim int, list int, l int, r int, side int, id {kind}")
    survivors = scratch.keep(survivors, "survivors")
    exact = survivors.join(reps.select("id", "copies", "embedding"), "id").join(indexed.select("id", "own", "probes"), "id")
    exact = exact.select(*keys, "side", "id", "copies", "embedding", "own", "probes").repartition(*keys).sortWithinPartitions(*keys, "side")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, 5):
            if not (n := sides(rows)):
                continue
            here = rows.column(2)[0].as_py()
            ids, copies, own = (rows.column(k).to_numpy() for k in (6, 7, 9))
            x, asked = unit(_matrix(rows.column(8))), rows.column(10).to_pylist()
            i, j = np.nonzero(x[:n] @ x[n:].T >= cosine - 1e-6)
            j = j + n
            i, j = i[ids[i] != ids[j]], j[ids[i] != ids[j]]
            hit = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
            i, j = i[hit], j[hit]
            # a pair of one list shows twice here, from either side; one of two lists may show in the other list too
            once = np.where(own[i] == here, ids[i] < ids[j], own[i] < here)
            late = own[i] > here
            if late.any():
                once[late] = [own[a] not in asked[b] for a, b in zip(i[late], j[late], strict=True)]
            i, j = i[once], j[once]
            if not len(i):
                continue
            names, at = np.unique(ids[np.concatenate((i, j))], return_inverse=True)
            a, b = at[: len(i)], at[len(i) :]
            count = np.bincount(a, copies[j], len(names)) + np.bincount(b, copies[i], len(names))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(count.astype(np.int64)), pa.array(names[_labels(len(names), a, b)])], names=["id", "n", "other"])

    found = scratch.keep(exact.mapInArrow(compare, f"id {kind}, n bigint, other {kind}"), "found")
    classes = components(found.where("id <> other").select(F.col("id").alias("a"), F.col("other").alias("b")), scratch)
    scratch.drop("indexed", "survivors")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    judged = reps.join(counts, "id", "left").join(classes, "id", "left").select("label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    if other:
        judged = judged.join(rows.select(F.col("__row").alias("component"), F.col("vec_id").alias("component_id")), "component").drop("component")
    else:
        judged = judged.withColumnRenamed("component", "component_id")
    out = rows.join(judged, ["label", "embedding"], "left").select("vec_id", F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
