"""What a query costs grows no faster than its tables."""

import random
import re

import pandas as pd
from pyspark.sql import functions as F
from test_sizes import same

import millrace.plans.control as control
import millrace.plans.decisions as decisions
import millrace.plans.folds as folds
from millrace.operators import governance as G
from millrace.operators import lifecycle as L
from millrace.operators import outline as O
from millrace.operators import parts
from millrace.operators import research as R
from millrace.streaming.leases import Leases


class Handle:
    """A state of one key, with the timers it has and the times it was read and written."""

    def __init__(self):
        self.rows, self.timers, self.reads, self.writes = None, set(), 0, 0
        self.getListState = self.getValueState = lambda name, schema: self
        self.registerTimer, self.deleteTimer = self.timers.add, self.timers.remove

    def exists(self):
        return self.rows is not None

    def get(self):
        self.reads += 1
        return iter(self.rows)

    def put(self, rows):
        self.writes += 1
        self.rows = rows


class Passed:
    def __init__(self, at):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: at


def test_leases_of_many_items_are_one_state():
    """A range of items is read and written once a batch and has one timer, that of its first end."""
    handle, leases = Handle(), Leases()
    leases.init(handle)
    rows = lambda at, kind, token: iter([pd.DataFrame([(i, 1000 * at + i, at + i, kind, "a", token, 100, 10**6) for i in range(50)], columns=["item", "event", "millis", "kind", "owner", "token", "lasts", "deadline"])])
    got = pd.concat(leases.handleInputRows((0,), rows(1000, "claim", 0), Passed(0)))
    assert list(got["outcome"]) == ["granted"] * 50 and list(got["item"]) == list(range(50)) and handle.timers == {1100} and (handle.reads, handle.writes) == (0, 1)
    got = pd.concat(leases.handleInputRows((0,), rows(1040, "heartbeat", 1), Passed(0)))
    assert list(got["outcome"]) == ["extended"] * 50 and handle.timers == {1140} and (handle.reads, handle.writes) == (1, 2)
    handle.timers.remove(1140)
    got = pd.concat(leases.handleExpiredTimer((0,), Passed(1150), Passed(1150)))
    assert sorted(got["item"]) == list(range(11)) and set(got["outcome"]) == {"expired"} and handle.timers == {1151} and (handle.reads, handle.writes) == (2, 3)
    assert not list(leases.handleExpiredTimer((0,), Passed(1150), Passed(1150))) and handle.writes == 3


def test_accounts_of_a_long_build_are_a_stream(spark):
    """A build's events are never gathered into one row; an id that is reserved again is open again; nulls don't fit."""
    e = spark.range(30000).selectExpr("1L AS build", "id AS at", "CASE WHEN id % 2 = 0 THEN 'reserve' ELSE 'settle' END AS kind", "id div 2 AS id", "10L AS tokens", "1L AS cost")
    out = R.metered(e, "build", "at", 100000, 10**9, 10**9)
    assert "collect_list" not in out._jdf.queryExecution().executedPlan().toString()
    last = out.orderBy("at").tail(1)[0]
    assert tuple(last) == (1, 29999, "settled", 15000, 0, 150000, 0, 15000)
    again = [("reserve", 1, 5, 1), ("settle", 1, 5, 1), ("reserve", 1, 6, 1), ("settle", 1, 6, 1), ("settle", 1, 6, 1), ("reserve", 2, None, 1), ("reserve", 3, 5, 1)]
    df = spark.createDataFrame([(None, i, *x) for i, x in enumerate(again)], "build long, at int, kind string, id long, tokens long, cost long")
    got = R.metered(df, "build", "at", 9, 16, 9).orderBy("at").collect()
    assert [r.outcome for r in got] == ["reserved", "settled", "reserved", "settled", "repeated", "exhausted", "reserved"] and got[-1].consumed_tokens == 11
    a = R.admitted(df, "build", "at", 9, 16, 9)
    assert "collect_list" not in a._jdf.queryExecution().executedPlan().toString()
    assert [r.admitted for r in a.orderBy("at").collect()] == [True, True, True, False, False, False, False]


def test_parts_are_as_many_as_the_table_asks_for(spark, tmp_path, monkeypatch):
    """Beyond the number of shuffle partitions, with the rows of the SQL; a version that comes twice counts its lines twice."""
    monkeypatch.setattr(parts, "ROWS", 100)
    lines = "SELECT i // 4 AS l_orderkey, CASE WHEN i % 9 > 0 THEN i * 37 % 1000 END AS l_partkey, CASE WHEN i % 7 > 0 THEN i % 4 END AS l_linenumber, (i % 50)::DOUBLE AS l_quantity FROM range(2000) t(i)"
    orders = "SELECT CASE WHEN i % 50 > 0 THEN i END AS o_orderkey, i % 90 AS o_custkey, 'F' AS o_orderstatus, (i * 1.5)::DOUBLE AS o_totalprice, TIMESTAMP '1997-01-01' AS o_orderdate, '5-LOW' AS o_orderpriority FROM range(600) t(i)"
    orders = f"{orders} UNION ALL SELECT * FROM ({orders}) WHERE o_orderkey % 20 = 7"
    for name in ("interval_cover", "manifest_check"):
        if name == "interval_cover":
            given = {"lineitem": lines.replace("CASE WHEN i % 9 > 0 THEN i * 37 % 1000 END", "i * 37 % 1000")}
        else:
            given = {"lineitem": lines, "orders": orders, "customer": "SELECT 1 AS c_custkey, 1 AS c_nationkey, 1.0 AS c_acctbal, 'x' AS c_mktsegment"}
        (tmp_path / name).mkdir()
        assert same(spark, tmp_path / name, name, control, **given)
        assert ", 20), REPARTITION_BY_NUM" in control.QUERIES[name](spark, str(tmp_path / name))._jdf.queryExecution().executedPlan().toString()


def test_facts_of_gold_cases_are_shuffled_twice(spark):
    """By their chunks and, without these, by their cases; the rules as before, chunks and sources that come twice too."""
    cases = spark.createDataFrame([(i, "s", 7, "s", 7) for i in range(1, 8)] + [(2, "s", 7, "s", 7), (8, "t", 7, "s", 7)], "case_id long, snapshot_id string, user_id long, wanted_snapshot string, wanted_user long")
    sources = spark.createDataFrame([(i, 10 + i, "x" if i == 3 else "h") for i in range(1, 9)] + [(1, 12, "h")], "case_id long, version_id long, hash string")
    groups = spark.createDataFrame([(1, 11, "a"), (1, 12, "b"), (1, 11, "a"), (4, 11, "a"), (5, 15, "c"), (6, 16, "none"), (7, 17, "d"), (7, 17, "e"), (99, 1, "a")], "case_id long, version_id long, chunk_id string")
    documents = spark.createDataFrame([(10 + i, "h") for i in range(1, 9)], "version_id long, hash string")
    chunks = spark.createDataFrame([("a", 7, 11), ("b", 7, 12), ("b", 7, 12), ("c", 8, 15), ("d", 7, 17), ("e", 7, 17), ("e", 7, 18)], "chunk_id string, user_id long, version_id long")
    out = G.gold_problems(cases, sources, groups, documents, chunks)
    assert {r.case_id: r.problem for r in out.collect()} == {2: "repeated", 3: "source differs", 4: "fact without source", 5: "foreign or missing chunk", 6: "foreign or missing chunk", 7: "foreign or missing chunk", 8: "another corpus or user"}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = G.gold_problems(cases, sources, groups, documents, chunks)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(case_id" in plan and not re.search(r"hashpartitioning\(case_id#\d+L, version_id", plan)


def test_a_closure_is_not_made_distinct_as_a_whole(spark):
    """Roots and links that come twice give each pair once, without a shuffle of all pairs behind the last round."""
    links = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (2, 1), (2, 3), (3, 4), (4, 5)], "src long, dst long")
    out = L.closure(links, spark.createDataFrame([(1,), (1,), (3,), (None,), (None,)], "root long"), 2)
    assert sorted(map(tuple, out.where("root is not null").collect())) == [(1, 1), (1, 2), (1, 3), (1, 4), (3, 3), (3, 4), (3, 5)]
    assert out.where("root is null").count() == 1
    assert out._jdf.queryExecution().optimizedPlan().toString().startswith("Union")


def test_numbered_lines_are_sorted_once(spark, data):
    """What reads the numbered lines several times doesn't number them each time."""
    for name in ("plan_problems", "span_levels"):
        assert "Window" not in decisions.QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()


def test_a_walk_goes_over_what_it_saw_once(spark):
    """One join a step, where each step doubled those before it; the nodes of a plain walk, with loops, edges that come
    twice and nodes with more edges than are kept."""
    rng = random.Random(7)
    found = [(d, rng.randrange(30), rng.randrange(30)) for d in "abc" for _ in range(90)] + [("a", 0, i) for i in range(30)]
    edges = spark.createDataFrame(found + found[:40] + [(None, 1, 2)], "doc string, src int, dst int")
    roots = spark.createDataFrame([(d, i) for d in "abc" for i in range(32)] + [("a", 0), (None, 1), ("b", None)], "doc string, root int")
    for hops, most in ((0, 3), (1, 1), (2, 3), (3, 4), (3, 9)):
        out = O.walked(edges, roots, "doc", "root", hops, most)
        assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= hops
        want = set()
        for d, root in set(map(tuple, roots.collect())):
            seen = {root: 0}
            for hop in range(1, hops + 1):
                more = {z for e, a, z in found if e == d and seen.get(a) == hop - 1} - seen.keys()
                seen |= dict.fromkeys(sorted(more)[: most - len(seen)], hop)
            want |= {(d, root, node, hop) for node, hop in seen.items()}
        assert sorted(map(repr, map(tuple, out.select("doc", "root", "node", "hop").collect()))) == sorted(map(repr, want))


def test_references_and_sections_in_parts(spark, tmp_path, monkeypatch):
    """Documents come in as many parts as the table asks for, with the rows of the SQL."""
    monkeypatch.setattr(parts, "ROWS", 100)
    orders = "SELECT i AS o_orderkey, i * 7919 % 1009 % 120 AS o_custkey, (i * 31.7)::DOUBLE AS o_totalprice, CASE i * 13 % 5 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' ELSE '5-LOW' END AS o_orderpriority FROM range(900) t(i)"
    for name in ("reference_walk", "block_references"):
        (tmp_path / name).mkdir()
        assert same(spark, tmp_path / name, name, folds, orders=orders)
        plan = folds.QUERIES[name](spark, str(tmp_path / name))._jdf.queryExecution().executedPlan().toString()
        assert ", 9), REPARTITION_BY_NUM" in plan


def test_a_text_with_the_old_mark_is_no_reference(spark):
    """Only what follows a word is a name; a word's tail goes over the ends of lines."""
    rows = [("d", 0, 1, "Scope"), ("d", 1, 1, "Two\nlines"), ("d", 2, None, "see x\x1fScope"), ("d", 3, None, "a\nsee  Two\nlines too"), ("d", 4, None, "see\x1f")]
    df = spark.createDataFrame(rows, "doc string, n int, level int, text string")
    got = {tuple(r) for r in O.references(df, "doc", "n", "text", F.col("level").isNotNull()).collect()}
    assert got == {("d", 3, 1)}
