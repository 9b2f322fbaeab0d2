import pytest
from pyspark.sql import functions as F

from millrace.operators import research as R
from millrace.streaming import operators as S


def test_query_windows():
    assert R.query_windows("a b c", "d e", 5) == ["a b c"]
    assert R.query_windows("aa bb cc dd", "d e f", 5) == ["aa bb", " cc dd"]
    assert R.query_windows("a b c d e f", "d e f g", 5) == []


def test_cover_takes_the_furthest():
    assert R.greedy_cover((0, 10), [(0, 4, 1), (0, 6, 2), (5, 9, 3), (6, 12, 4)]) == [2, 4]
    assert R.greedy_cover((0, 10), [(0, 4, 1), (5, 12, 2)]) == []


def test_refused_requests_leave_room(spark):
    rows = spark.createDataFrame([(1, i, t, 1.0) for i, t in enumerate((5, 9, 4, 1))], "build long, at long, tokens long, cost double")
    assert [r.admitted for r in R.admitted(rows, "build", "at", 3, 10, 9.0).orderBy("at").collect()] == [True, False, True, True]


def test_plans_are_named_by_content():
    a, b = R.compiled("what  is new", ["Acme"]), R.compiled("what is new", ["Acme"])
    assert a == b and a.hash == b.hash and a.lexical == "what is new" and a.dense == "Acme what is new"
    assert R.compiled("x", (), ["1", "2"], ["2", "3"]).documents == ("2",) and R.compiled("x", (), ["1"], ["2"]).documents == ()
    with pytest.raises(ValueError, match="limits"):
        R.QueryPlan("a", "a", "a", limits={"parent": 9, "rerank": 5, "rrf": 30})


def test_lanes_degrade_but_wrong_requests_do_not(spark):
    fine, broken = (lambda: spark.range(3)), (lambda: spark.table("nowhere"))
    good, lost = R.either_lane([fine, broken])
    assert good[0].count() == 3 and len(lost) == 1
    with pytest.raises(RuntimeError, match="no lane"):
        R.either_lane([broken])

    late = lambda: spark.range(5).select(F.when(F.col("id") == 3, F.raise_error(F.lit("down"))).otherwise(F.col("id")).alias("id"))
    good, lost = R.either_lane([late, fine])
    assert [g.count() for g in good] == [3] and len(lost) == 1

    def wrong():
        raise ValueError("dimension")

    with pytest.raises(ValueError, match="dimension"):
        R.either_lane([fine, wrong])


def test_vectors_have_length_one(spark):
    v = spark.createDataFrame([("a b c",), (None,), ("",)], "t string").select(R.hashed_vector(8)("t").alias("v")).collect()
    assert abs(sum(x * x for x in v[0]["v"]) - 1) < 1e-12 and v[1]["v"] is None and sum(v[2]["v"]) == 0


def test_claims_are_whole(spark):
    c = F.array(*(F.struct(F.lit(p).alias("priority"), F.lit(i).alias("id"), F.lit(t).alias("text")) for p, i, t in ((1, "b", "w " * 40), (0, "a", "w " * 30), (2, "c", "w w"))))
    got = spark.range(1).select(R.kept_claims(F.lit("base"), c).alias("k")).first()["k"]
    assert got["ids"] == ["a", "c"]


def test_dates_find_their_headings(spark):
    rows = [(1, 0, "heading", 0.0, 0.0, 100.0, 10.0), (1, 1, "date", 300.0, 1.0, 400.0, 11.0), (1, 2, "heading", 0.0, 50.0, 100.0, 60.0), (1, 3, "date", 302.0, 50.0, 400.0, 60.0), (1, 4, "date", 50.0, 50.0, 90.0, 60.0), (2, 0, "heading", 0.0, 0.0, 1.0, 9.0), (2, 1, "date", 5.0, 0.0, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "page int, block int, kind string, left double, top double, right double, bottom double")
    assert sorted(map(tuple, R.dates_beside_headings(df, "page", "block").collect())) == [(1, 1, 0), (1, 3, 2)]


def test_streams_drop_what_comes_twice_and_part_the_dead(spark, tmp_path):
    rows = [(1, 1, "view", 1.0), (1, 1, "view", 1.0), (1, 2, "error", 2.0), (2, 3, "error", 5.0)]
    schema = "user_id long, event_id long, event_type string, value double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = {r["user_id"]: (r["events"], r["errors"], r["last_type"], r["total"]) for r in S.drained(S.projected(stream), mode="update").collect()}
    assert got == {1: (2, 1, "error", 3.0), 2: (1, 1, "error", 5.0)}
    q = S.split_dead(stream, F.col("event_type") == "error", str(tmp_path / "good"), str(tmp_path / "dead"), str(tmp_path / "cp"), "event_id")
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "good")).count() == 2 and spark.read.parquet(str(tmp_path / "dead")).count() == 2
