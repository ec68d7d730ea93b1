"""The pivot-distance index against comparing everything with everything."""

import numpy as np
import pytest

from topicloom.llm import search

SCHEMA = "vec_id long, embedding array<double>, label int, block long, score string"


def whole(v):
    return [int(np.floor(256 * x)) for x in v]


def brute(rows, k=5, every=50):
    held = [(i, whole(v)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(held):
        if i is None or i % every:
            continue
        scores = [(max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(q, c)))), j) for b, (j, c) in enumerate(held) if a != b and len(c) == len(q)]
        best = sorted(scores, key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:k]
        out += [(i, r + 1, j, s) for r, (s, j) in enumerate(best)]
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "clash") for i, v in rows], SCHEMA)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("kind", ["normal", "clustered", "ties"])
def test_all_rows(spark, scratch, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 8))
    if kind == "clustered":
        x = rng.normal(size=(12, 8))[rng.integers(0, 12, 900)] * 4 + 0.05 * x
    if kind == "ties":
        x = np.round(x / 2) / 4
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    got = search.top_k(table(spark, rows), scratch, list_rows=40, block_rows=(64, 64), together=2)
    assert found(got) == brute(rows)


def test_awkward_rows(spark, scratch):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (50, None), (100, [float("nan"), 1.0]), (150, [float("inf"), 1.0]), (200, [None, 1.0]), (250, []), (300, []), (None, [1.0, 2.0]), (None, [3.0, 2.0]), (1, [0.0, 0.0]), (2, [-1.5, 1e-9]), (350, [1.0, 2.0, 3.0]), (400, [1e30, -1e30]), (3, [1e30, 1e30]), (4, [1e200, 1.0]), (450, [1e200, -1.0]), (5, [2.0**45, 3.0]), (500, [2.0**45, 2.0])]
    assert found(search.top_k(table(spark, rows), scratch)) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_few_rows(spark, scratch, n):
    rows = [(50 * i, [float(i), 1.0]) for i in range(n)]
    assert found(search.top_k(table(spark, rows), scratch)) == brute(rows)


def test_copies_of_one_vector(spark, scratch):
    """A third of the rows are one vector: its blocks are of bounded size."""
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, 0.5, 0.25] if i % 3 == 0 else rng.normal(size=3).tolist()) for i in range(600)]
    assert found(search.top_k(table(spark, rows), scratch, list_rows=50, block_rows=(32, 32), together=3)) == brute(rows)
    sizes = [len(r.ids) for r in spark.read.parquet(scratch.path("blocks")).select("ids").collect()]
    assert max(sizes) <= 32


def test_bounds_spare_products(spark):
    """Where vectors lie in clusters, most annuli are never compared; results stay exact."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16)) * 4
    x = search.whole(centres[rng.integers(0, 40, 8000)] + 0.02 * rng.normal(size=(8000, 16)))
    norms, pivots = search.norms_of(x), search.whole(centres)
    d = search.distances(x, norms, pivots)
    own = d.argmin(1)
    order = np.lexsort((d[np.arange(len(x)), own], own))
    x, norms, own, radii = x[order], norms[order], own[order], d[order, own[order]]
    q, places = x[::160], np.arange(0, len(x), 160)
    seen = []
    i, j, s = search.expanded(x, np.arange(len(x)), own, radii, norms, q, np.full(len(q), -search.LONG - 1), norms[::160], places, pivots, 5, 64, seen)
    every = search.products(q, x)
    every[np.arange(len(q)), places] = -search.LONG
    for k in range(len(q)):
        assert sorted(s[i == k].tolist()) == sorted(np.sort(every[k])[-5:].tolist())
    assert sum(seen) < 0.5 * len(q) * len(x)


def test_products_are_exact():
    rng = np.random.default_rng(7)
    for scale in (1, 1e6, 1e9, 1e17):
        q, x = np.floor(rng.normal(size=(4, 9)) * scale), np.floor(rng.normal(size=(5, 9)) * scale)
        exact = [[max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(v, w)))) for w in x] for v in q]
        assert search.products(q, x).tolist() == exact
