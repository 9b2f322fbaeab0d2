"""Outlines, references, walks, accounts and frontiers on small cases."""

import random

from pyspark.sql import functions as F

from millrace.operators import metrics
from millrace.operators import outline as O
from millrace.operators import research as R


def blocks(spark, rows):
    return spark.createDataFrame(rows, "doc string, n int, level int, text string")


def test_outline_repairs_and_closes(spark):
    levels = [3, 2, 9, 0, 1, 0, 2]
    df = blocks(spark, [("d", i * 2, lv, f"h{i}") for i, lv in enumerate(levels)] + [("d", 1, None, "text"), ("e", 0, 0, "only"), ("f", 0, None, "none")])
    got = {(r.doc, r.n): (r.level, r.path, r.end) for r in O.outlined(df, "doc", "n", "level", "text").collect()}
    assert got == {
        ("d", 0): (1, ["h0"], 8), ("d", 2): (2, ["h0", "h1"], 8), ("d", 4): (3, ["h0", "h1", "h2"], 8), ("d", 6): (4, ["h0", "h1", "h2", "h3"], 8),
        ("d", 8): (1, ["h4"], None), ("d", 10): (2, ["h4", "h5"], 12), ("d", 12): (2, ["h4", "h6"], None), ("e", 0): (1, ["only"], None),
    }
    assert O.outlined(df.limit(0), "doc", "n", "level", "text").count() == 0


def test_references_need_a_word_and_one_heading(spark):
    df = blocks(spark, [("d", 0, 1, "Scope (a)"), ("d", 1, 1, "Twice"), ("d", 2, 1, "Twice"), ("d", 3, None, "see Scope (a) and 参见  Scope (a)."), ("d", 4, None, "Scope (a) only"), ("d", 5, None, "see Twice"), ("d", 6, None, "see the Scope (a)"), ("d", 7, None, None), ("e", 0, None, "see Scope (a)"), ("d", 8, None, "按照Scope (a)"), ("d", 9, None, "we see see Scope (a)")])
    got = {tuple(r) for r in O.references(df, "doc", "n", "text", F.col("level").isNotNull()).collect()}
    assert got == {("d", 3, 0), ("d", 8, 0), ("d", 9, 0)}


def test_walks_are_bounded(spark):
    edges = spark.createDataFrame([("d", 0, i) for i in range(1, 30)] + [("d", i, 100 + i) for i in range(30)] + [("d", 5, 0), ("e", 0, 77)], "doc string, src int, dst int")
    roots = spark.createDataFrame([("d", 0), ("d", 5), ("d", 999)], "doc string, root int")
    rows = O.walked(edges, roots, "doc", "root").collect()
    of = lambda root: sorted((r.hop, r.node) for r in rows if r.root == root)
    assert of(0) == [(0, 0)] + [(1, i) for i in range(1, 16)] and of(999) == [(0, 999)]
    assert of(5)[:3] == [(0, 5), (1, 0), (1, 105)] and len(of(5)) == 16 and {h for h, _ in of(5)} == {0, 1, 2}


def test_accounts_settle_once(spark):
    e = [("reserve", 1, 50, 5), ("reserve", 2, 60, 1), ("settle", 2, 1, 1), ("settle", 1, 10, 2), ("reserve", 3, 90, 1), ("settle", 1, 10, 2), ("settle", 3, 95, 9), ("reserve", 4, 1, 1)]
    df = spark.createDataFrame([(7, i, *x) for i, x in enumerate(e)], "build long, at int, kind string, id long, tokens long, cost long")
    got = R.metered(df, "build", "at", 3, 100, 100).orderBy("at").collect()
    assert [r.outcome for r in got] == ["reserved", "exhausted", "unknown", "settled", "reserved", "repeated", "settled", "exhausted"]
    assert tuple(got[-1])[3:] == (2, 0, 105, 0, 11)


def test_frontier_of_parts(spark):
    rng = random.Random(5)
    rows = [(i, float(rng.randrange(12)), rng.randrange(12), rng.randrange(12)) for i in range(400)] + [(400, None, 1, 1)]
    df = spark.createDataFrame(rows, "id int, a double, b int, c int").repartition(7)
    beats = lambda x, y: x[1] >= y[1] and x[2] >= y[2] and x[3] <= y[3] and x[1:] != y[1:]
    want = {y[0] for y in rows[:-1] if not any(beats(x, y) for x in rows[:-1])}
    out = metrics.dominated(df, ["a", "b"], ["c"])
    assert {r.id for r in out.collect()} == want
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    assert metrics.dominated(df.limit(0), ["a", "b"], ["c"]).count() == 0
