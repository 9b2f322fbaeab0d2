"""Nearest neighbours and near duplicates of embeddings."""

import math

import numpy as np

from millrace.llm import embeddings, neighbours


def table(spark, x, odd=()):
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)] + list(odd)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(3)


ODD = [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [math.nan] + [1.0] * 15, 1), (9004, [None] + [1.0] * 15, 1), (9005, [math.inf] + [1.0] * 15, 1), (9006, [1.0], 1), (None, [1.0] * 16, 1)]


def data(n=1500):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, 16)).astype(np.float32)
    x[100:400] = x[0] + 0.05 * rng.normal(size=(300, 16))
    x[400:420] = x[1]
    x[420:440] = x[1] * 2
    x[500] = x[501] + 0.2 * rng.normal(size=16)
    return x


def cosines(x):
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    return u @ u.T


def test_near_duplicates_are_those_of_all_pairs(spark):
    old, embeddings.LOT = embeddings.LOT, 64
    try:
        x = data()
        got = {r["vec_id"]: r for r in embeddings.near_duplicates(table(spark, x, ODD)).collect()}
    finally:
        embeddings.LOT = old
    c = cosines(x)
    near = c >= 0.9
    np.fill_diagonal(near, False)
    sure = near & (np.abs(c - 0.9) > 1e-9)
    found = sum(got[i]["n_links"] for i in range(len(x)))
    assert found <= near.sum() and found >= 0.98 * sure.sum()
    assert {got[i]["component_id"] for i in range(400, 440)} == {1} and got[1]["n_links"] >= 40
    assert {got[i]["component_id"] for i in range(100, 400)} == {0}
    for i in (9001, 9002, 9003, 9004, 9005, 9006):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert len(got) == len(x) + len(ODD) and got[None]["n_links"] == 0


def links(x):
    c = cosines(x)
    np.fill_diagonal(c, 0)
    return c >= 0.9


def test_made_partners_are_at_the_bound():
    rng = np.random.default_rng(4)
    for d in (64, 7, 2, 1):
        u = rng.normal(size=(40, d))
        u /= np.linalg.norm(u, axis=1)[:, None]
        c = (u * embeddings.made_partners(u, max(1, d // 2))).sum(1)
        assert np.all((np.abs(c - 0.9) < 1e-9) | (np.abs(c - 1) < 1e-9)) and (d < 7 or np.all(np.abs(c - 0.9) < 1e-9))


def test_few_cells_are_visited_where_no_vector_has_a_partner(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 32)).astype(np.float32)
    before = {str(p) for p in _tables(spark, "visits")}
    got = embeddings.near_duplicates(table(spark, x))
    assert got.where("n_links > 0").count() == links(x).any(1).sum()
    (visits,) = {str(p) for p in _tables(spark, "visits")} - before
    met = spark.read.parquet(visits)
    assert met.count() < 20 * len(x) and "v" not in met.columns


def _tables(spark, name):
    from pathlib import Path

    return Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")).glob(f"{name}-*")


def test_rare_partners_are_found_whatever_they_differ_in(spark):
    """One vector in a hundred has a partner, at a cosine of 0.9 to 0.95, that differs in some direction of the whole, of
    a half, or in few components."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(8000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[7900:] = embeddings.made_partners(x[:100], 16)
    x[7900:] += 0.08 * x[:100]
    near = links(x.astype(np.float32))
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(table(spark, x.astype(np.float32))).collect()}
    found = sum(min(1, got[i]) for i in range(7900, 8000))
    assert near[7900:].any(1).all() and found >= 95


def test_each_pair_is_counted_once(spark):
    x = np.repeat(np.eye(16, dtype=np.float32)[:3], [1, 2, 5], axis=0)
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(table(spark, x)).collect())
    assert got == [(0, 0, 0, True), (1, 1, 1, True), (2, 1, 1, False), (3, 4, 3, True), *((i, 4, 3, False) for i in range(4, 8))]
    assert embeddings.near_duplicates(table(spark, x).limit(0)).count() == 0


def test_cells_are_visited_nearest_first():
    rng = np.random.default_rng(1)
    g = embeddings.Grid(rng.normal(size=(6, 3)), rng.normal(size=(5, 3)), reach=2.0)
    a, b = (x[0] for x in g.excess(rng.normal(size=(1, 6))))
    got = g.visited(a, b)
    sums = {i * 5 + j: a[i] + b[j] for i in range(6) for j in range(5)}
    assert sorted(got) == sorted(c for c, s in sums.items() if s <= 2.0) and [sums[c] for c in got] == sorted(sums[c] for c in got)


def test_recall_of_neighbours(spark):
    from pyspark.sql import functions as F

    old, neighbours.PART = neighbours.PART, 200
    try:
        x = data()
        rows = neighbours.nearest(table(spark, x, ODD), F.col("vec_id") % 10 == 0).collect()
    finally:
        neighbours.PART = old
    c = cosines(x)
    np.fill_diagonal(c, -9)
    hit = total = 0
    by = {}
    for r in rows:
        by.setdefault(r["query_id"], []).append(r)
    assert set(by) == set(range(0, len(x), 10))
    for q, got in by.items():
        got.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == [1, 2, 3, 4, 5] and all(abs(r["score"] - c[q, r["vec_id"]]) < 1e-9 for r in got)
        assert all((-a["score"], a["vec_id"]) < (-b["score"], b["vec_id"]) for a, b in zip(got, got[1:], strict=False))
        floor = np.sort(c[q])[-5]
        hit += sum(r["score"] >= floor - 1e-9 for r in got)
        total += 5
    assert hit / total >= 0.98


def test_ties_and_few_candidates(spark):
    from pyspark.sql import functions as F

    x = np.repeat(np.eye(16, dtype=np.float32)[:1], 8, axis=0)
    got = neighbours.nearest(table(spark, x), F.col("vec_id") == 3).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [0, 1, 2, 4, 5]
    few = neighbours.nearest(table(spark, x[:3]), F.col("vec_id") == 0).collect()
    assert len(few) == 2 and neighbours.nearest(table(spark, x).limit(0), F.lit(True)).count() == 0


def test_chi_square():
    # the median and the 99th percentile of 8 degrees, from tables
    assert abs(neighbours.chi_square_limit(0.5) - 7.344) < 1e-3 and abs(neighbours.chi_square_limit(0.99) - 20.090) < 1e-3


def test_parts_out_of_reach_are_left_out(spark, monkeypatch):
    """Where vectors lie in clusters, most parts are never visited, and nearly all neighbours are found."""
    monkeypatch.setattr(neighbours, "PART", 64)
    monkeypatch.setattr(neighbours, "QUERIES_AT_ONCE", 7)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 16))
    x = (centres[rng.integers(0, 60, 2000)] + 0.08 * rng.normal(size=(2000, 16))).astype(np.float32)
    seen: list = []
    got = neighbours.nearest(table(spark, x), neighbours.F.col("vec_id") % 10 == 0, seen=seen).collect()
    c = cosines(x)
    np.fill_diagonal(c, -2)
    right = sum(r["vec_id"] in set(np.argsort(-c[r["query_id"]])[:5].tolist()) for r in got)
    assert len(got) == 1000 and right >= 950
    assert sum(seen) < 0.5 * 31 * 200, seen


def test_parts_within_reach_are_those_of_all_boxes():
    rng = np.random.default_rng(4)
    y = rng.normal(size=(500, 8))
    cuts = neighbours.Cuts(y, 5)
    part = cuts.part(y, np.arange(500))
    q, reach = rng.normal(size=(40, 8)), rng.uniform(0, 9, 40)
    i, p, far = cuts.within(q, reach)
    got = set(zip(i.tolist(), p.tolist(), strict=True))
    for a in range(40):
        for b in set(part.tolist()):
            rows = y[part == b]
            if ((rows - q[a]) ** 2).sum(1).min() <= reach[a]:
                assert (a, b) in got
    assert (far <= reach[i] + 1e-12).all() and len(got) < 40 * 32


def test_one_vector_on_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART", 32)
    x = data(600)
    x[200:400] = x[0]
    got = {}
    for r in neighbours.nearest(table(spark, x), neighbours.F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got[0] == [200, 201, 202, 203, 204] and got[250] == [0, 200, 201, 202, 203]
