"""Streams over several batches and restarts."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import indexes
from millrace.sources import tables
from millrace.streaming import operators as S
from millrace.streaming.leases import leased, with_rocksdb

DAY = 86_400_000


def messages(spark, n, first=0):
    return spark.range(first, first + n).select(F.col("id"), (F.col("id") % 7).alias("k"), (F.col("id") % 3 == 0).alias("bad"))


def test_consumption_goes_on_behind_what_was_read(spark, tmp_path):
    log, out, mark = str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "mark")
    S.message_log(messages(spark, 950), log, "id")
    stream = S.consumed(spark, log, messages(spark, 0).schema)
    first = S.drained(stream, checkpoint=mark, path=out)
    assert first.count() == 950 == first.select("id").distinct().count()
    S.message_log(messages(spark, 130, 950), log, "id")
    again = S.drained(stream, checkpoint=mark, path=out)
    assert sorted(r.id for r in again.collect()) == list(range(1080))
    assert S.drained(stream, checkpoint=mark, path=out).count() == 1080


def test_micro_batches_are_bounded(spark, tmp_path):
    log, sizes = str(tmp_path / "log"), []
    S.message_log(messages(spark, 350), log, "id", 100)
    q = S.consumed(spark, log, messages(spark, 0).schema).writeStream.foreachBatch(lambda b, _: sizes.append(b.count())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(sizes) == 350 and max(sizes) <= 100


def test_dead_letters_come_once_over_batches(spark, tmp_path):
    log, good, dead, mark = (str(tmp_path / x) for x in ("log", "good", "dead", "mark"))
    S.message_log(messages(spark, 300), log, "id")
    run = lambda: S.split_dead(S.consumed(spark, log, messages(spark, 0).schema), F.col("bad"), good, dead, mark, "k").awaitTermination()
    run()
    S.message_log(messages(spark, 300, 300), log, "id")
    run()
    assert sorted(r.k for r in spark.read.parquet(dead).collect()) == list(range(7))
    assert spark.read.parquet(good).count() == 400 == spark.read.parquet(good).select("id").distinct().count()


def lease_events(spark, rows, path):
    df = spark.createDataFrame(rows, "item long, event long, millis long, kind string, owner string, token long, lasts long, deadline long")
    df.withColumn("time", F.timestamp_millis("millis")).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.withColumn("time", F.timestamp_millis("millis")).schema).option("maxFilesPerTrigger", 1)


def test_leases_over_batches(spark, tmp_path):
    with_rocksdb(spark)
    log, mark, out = (str(tmp_path / x) for x in ("log", "mark", "out"))
    far = 100 * DAY
    first = [(1, 0, 1000, "claim", "a", 0, 500, far), (1, 1, 1200, "claim", "b", 0, 500, far), (1, 2, 1400, "heartbeat", "a", 1, 500, far), (1, 3, 1450, "heartbeat", "a", 9, 500, far), (2, 4, 1000, "claim", "a", 0, 500, 1300), (3, 5, 1000, "complete", "a", 1, 500, far)]
    reader = lease_events(spark, first, log)
    S.drained(leased(reader.parquet(log), "time", "0 seconds"), checkpoint=mark, path=out)
    second = [(1, 6, 5000, "claim", "b", 0, 500, far), (1, 7, 5100, "complete", "a", 1, 500, far), (1, 8, 5200, "complete", "b", 2, 500, far), (1, 9, 5300, "claim", "a", 0, 500, far), (2, 10, 5000, "claim", "a", 0, 500, 1300)]
    lease_events(spark, second, log)
    got = S.drained(leased(reader.parquet(log), "time", "0 seconds"), checkpoint=mark, path=out)
    rows = sorted((r.item, r.millis, r.event is None, r.outcome, r.owner, r.token, r.until) for r in got.collect())
    assert rows == [
        (1, 1000, False, "granted", "a", 1, 1500), (1, 1200, False, "refused", "b", None, None), (1, 1400, False, "extended", "a", 1, 1900), (1, 1450, False, "stale", "a", 9, None),
        (1, 1900, True, "expired", "a", 1, 1900), (1, 5000, False, "granted", "b", 2, 5500), (1, 5100, False, "stale", "a", 1, None), (1, 5200, False, "completed", "b", 2, None), (1, 5300, False, "refused", "a", None, None),
        (2, 1000, False, "granted", "a", 1, 1300), (2, 1300, True, "expired", "a", 1, 1300), (2, 5000, False, "refused", "a", None, None), (3, 1000, False, "stale", "a", 1, None),
    ]


def test_three_expired_leases_are_the_end(spark, tmp_path):
    with_rocksdb(spark)
    log = str(tmp_path / "log")
    rows = [(1, i, 1000 * i, "claim", "a", 0, 10, 10**12) for i in range(1, 6)] + [(9, 9, 10**6, "claim", "z", 0, 10, 10**12)]
    got = S.drained(leased(lease_events(spark, rows, log).parquet(log), "time", "0 seconds")).where("item = 1").orderBy("millis").collect()
    assert [r.outcome for r in got] == ["granted", "expired", "granted", "expired", "granted", "failed", "refused", "refused"]


def test_built_once_until_a_file_changes(spark, tmp_path):
    source, made = str(tmp_path / "source"), []
    spark.range(10).write.parquet(source)
    build = lambda p: (made.append(p), spark.read.parquet(source).write.parquet(p))
    a = tables.built_once(spark, "copy", [source], build)
    assert tables.built_once(spark, "copy", [source], build) == a and len(made) == 1
    spark.range(5).write.mode("append").parquet(source)
    b = tables.built_once(spark, "copy", [source], build)
    assert b != a and spark.read.parquet(b).count() == 15


def test_index_reads_no_text_and_few_folders(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i % 50} common Ärger{i % 3}" if i % 10 else None, "en" if i % 2 else "de") for i in range(300)], "child_id long, text string, lang string")
    index = indexes.StoredLexicalIndex.build(docs, "child_id", "text", str(tmp_path / "i"), ["lang"])
    q = spark.createDataFrame([(1, "word7 ärger1"), (2, "nothing"), (3, None)], "q long, text string")
    got = index.search(q, "q", "text", F.col("lang") == "en", 5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan and "PartitionFilters: [bucket" in plan and "PushedFilters: [" in plan
    found = got.orderBy("lane_rank").collect()
    assert [r.q for r in found] == [1] * 5 and found[0].child_id % 50 == 7 and found[0].child_id % 3 == 1
    plain = {(r.child_id, round(r.score, 9)) for r in index.search(q, "q", "text", None, 5).collect()}
    more = {(r.child_id, round(r.score, 9)) for r in index.search(q, "q", "text", None, 5, ["common"]).collect()}
    assert plain and more and max(s for _, s in more) > max(s for _, s in plain)


def test_index_joins_many_terms(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i % 50} common") for i in range(300)], "child_id long, text string")
    index = indexes.StoredLexicalIndex.build(docs, "child_id", "text", str(tmp_path / "i"))
    q = spark.createDataFrame([(i, f"word{i}") for i in range(50)], "q long, text string")
    few = sorted(map(tuple, index.search(q, "q", "text", None, 3).collect()))
    monkeypatch.setattr(indexes, "NAMED", 5)
    assert sorted(map(tuple, index.search(q, "q", "text", None, 3).collect())) == few and len(few) == 150


def test_vectors_of_one_width(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0]), (6, [float("nan"), 1.0]), (7, [-1.0, 0.0])], "child_id long, v array<double>")
    index = indexes.StoredVectorIndex.build(rows, "child_id", "v", str(tmp_path / "v"), 2)
    assert [(r.child_id, round(r.score, 6)) for r in index.search([2.0, 0.0], None, 5).orderBy("lane_rank").collect()] == [(1, 1.0), (2, 0.707107), (7, -1.0)]
    for bad in ([1.0], [0.0, 0.0]):
        with pytest.raises(ValueError, match="component|length"):
            index.search(bad)
