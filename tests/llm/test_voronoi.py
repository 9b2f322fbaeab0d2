"""Exact top-k by product against all products."""

import math

import numpy as np
import pytest
from parity import both, views
from pyspark.sql import functions as F

from millrace.llm import voronoi


def brute(rows, every, k=20):
    by = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(64 * x) for x in v):
            z = [math.floor(64 * x) for x in v]
            by[i] = min(by.get(i, (v, z)), (v, z))
    widths = [len(z) for _, z in by.values()]
    d = max(sorted(set(widths)), key=widths.count, default=0)
    by = {i: z for i, (_, z) in by.items() if len(z) == d}
    out = []
    for q in (i for i in by if i % every == 0):
        scores = sorted((-sum(a * b for a, b in zip(by[q], z, strict=True)), i) for i, z in by.items() if i != q)[:k]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores, 1)]
    return sorted(out)


def run(spark, rows, every, k=20, seen=None):
    d = spark.createDataFrame([(i, v, "x", 1.0, 2) for i, v in rows], "vec_id long, embedding array<double>, cell string, far double, group int").repartition(3)
    return sorted(tuple(r) for r in voronoi.joined(d, F.col("vec_id") % every == 0, k, seen=seen).collect())


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), rng.normal(size=4).tolist()) for i in range(-20, 60)]
    rows += [(None, [1.0] * 4), (100, None), (101, [1.0, None, 0.0, 0.0]), (102, [math.nan] * 4), (103, [math.inf, 0.0, 0.0, 0.0]), (104, [1.0, 2.0]), (105, []), (106, [0.0] * 4), (106, [0.0] * 4), (110, [-0.0, 1e-9, -1e-9, 0.5]), (7, [9.0, 9.0, 9.0, 9.0]), (111, [1e308, 0.0, 0.0, 0.0])]
    assert run(spark, rows, 10) == brute(rows, 10)


def test_equal_vectors_tie_by_id(spark):
    rows = [(i, [1.0, 0.5] if i % 3 else [0.5, 1.0]) for i in range(400)]
    assert run(spark, rows, 20) == brute(rows, 20)


def test_few_and_none(spark):
    rows = [(i, [float(i), 1.0]) for i in range(5)]
    assert run(spark, rows, 2) == brute(rows, 2)
    assert run(spark, [], 2) == [] == run(spark, [(1, None)], 1) == run(spark, [(3, [1.0])], 1)


def test_large_components(spark):
    rows = [(i, [1e15 + i * 1e12, -2.5e3 * i]) for i in range(40)]
    got = run(spark, rows, 10)
    cut = lambda s: max(-(2**63) + 1, min(2**63 - 1, s))
    want = brute(rows, 10, 39)
    assert [(q, s) for q, _, _, s in got] == [(q, cut(s)) for q, r, _, s in want if r <= 20]


def test_groups_leave_data_out(spark, monkeypatch):
    monkeypatch.setattr(voronoi, "LOT", 40)
    monkeypatch.setattr(voronoi, "CHUNK", 500)
    monkeypatch.setattr(voronoi, "ROWS_A_PIVOT", 40)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    x = 4 * centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)) * 0.05
    x[rng.random(4000) < 0.33] = x[0]
    rows, seen = [(i, v) for i, v in enumerate(x.tolist())], {}
    assert run(spark, rows, 20, seen=seen) == brute(rows, 20)
    assert seen["groups"] > 3 and seen["sent"] < 0.7 * seen["groups"] * 4000


def test_blocks_are_left_out():
    rng = np.random.default_rng(6)
    centres = 300 * np.eye(8)
    x = np.floor(centres[rng.integers(0, 8, 3000)] + rng.normal(size=(3000, 8)) * 3)
    reach = float(np.sqrt((x * x).sum(1).max()))
    cells = voronoi.Cells(np.zeros((1, 9)), reach, True)
    cells.pivots = cells.data(centres * 0.99)
    far = voronoi.distances(cells.data(x), cells.pivots)
    ids = np.arange(3000)
    at, vec, best, formed = voronoi.solve(cells, x, ids, far.argmin(1), far.min(1), x[:50], ids[:50], 5)
    s = (x[:50] @ x.T).astype(int)
    s[ids[:50], ids[:50]] = -(10**9)
    want = [(i, j, int(s[i, j])) for i in range(50) for j in np.lexsort((ids, -s[i]))[:5].tolist()]
    assert sorted(zip(at.tolist(), vec.tolist(), best.tolist(), strict=True)) == sorted(want)
    assert formed < 0.5 * s.size


@pytest.mark.parametrize("name", sorted(voronoi.ORACLE))
def test_same_rows_as_sql(spark, data, name):
    mine, theirs = both(spark, views(data), voronoi.QUERIES[name], voronoi.ORACLE[name], data)
    assert mine == theirs
