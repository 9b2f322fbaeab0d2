"""Rows that only larger tables hold: queries give the rows of their SQL on them."""

import hashlib

import duckdb
import pandas as pd
from parity import both
from pyspark.sql import functions as F

import millrace.operators.indexes as indexes
import millrace.operators.lanes as lanes
import millrace.operators.scope as scope
import millrace.plans.control as control
import millrace.plans.flows as flows
import millrace.plans.ingestion as ingestion
import millrace.plans.texts as texts
from millrace.sources import jsonlines, parsing, readers


def same(spark, folder, query, module, **tables):
    """Rows of the query and of its SQL over tables given in SQL."""
    con = duckdb.connect()
    for name, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{name}.parquet'")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    mine, theirs = both(spark, con, module.QUERIES[query], module.ORACLE[query], str(folder))
    assert mine == theirs
    return mine


def test_half_prices_round_to_even(spark, tmp_path):
    """20.5 days are 20, 21.5 days are 22."""
    orders = """SELECT i::BIGINT AS o_orderkey, i // 2 AS o_custkey, 'F' AS o_orderstatus, (20.5 + i // 2 % 2)::DOUBLE AS o_totalprice,
        TIMESTAMP '1997-01-01' + to_days((CASE WHEN i % 2 = 0 THEN 0 ELSE 20 + i // 4 % 3 END)::INT) AS o_orderdate, '5-LOW' AS o_orderpriority FROM range(48) t(i)"""
    assert same(spark, tmp_path, "history_as_of", control, orders=orders)


def test_values_of_high_user_ids(spark, tmp_path):
    """500 times the square of 90,000 is over the calculator's usual bound."""
    events = "SELECT i AS event_id, i * 30000 AS user_id, (500.37 + i)::DOUBLE AS value FROM range(5) t(i)"
    assert "None" not in str(same(spark, tmp_path, "safe_calculator", texts, events=events))


def test_a_micro_batch_takes_many_files(spark, tmp_path):
    """What a batch costs by itself is paid once a million messages, not once a file."""
    spark.range(9000).selectExpr("id AS event_id", "id % 7 AS user_id", "'view' AS event_type", "1.0D AS value").write.parquet(f"{tmp_path}/events.parquet")
    sizes = []
    q = flows._log(spark, str(tmp_path)).writeStream.foreachBatch(lambda b, _: sizes.append(b.count())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sizes == [9000]


def test_documents_are_scored_for_all_queries_at_once(spark, tmp_path, monkeypatch):
    """The same rows as by joins, copies in order of id, over several chunks of postings; a pair of document and query is
    never a row, and building shuffles no posting."""
    docs = spark.createDataFrame([(i, f"common word{i % 7} word{i % 3 + 20} " + "often " * (i % 4), i % 2) for i in range(400)] + [(400, None, 0), (401, " ", 1)], "child_id long, text string, half int")
    q = spark.createDataFrame([(1, "common word3"), (2, "word21 often never"), (3, "none"), (4, None), (2, "word5")], "q int, text string")
    plain, pairs = (indexes.StoredLexicalIndex.build(docs, "child_id", "text", str(tmp_path / a.__name__), ["half"], a) for a in (lanes.terms, lanes.bigrams))
    rows = lambda df: sorted((r.q, r.lane_rank, r.child_id, round(r.score, 9)) for r in df.collect())
    monkeypatch.setattr(indexes, "ROWS", 50)
    monkeypatch.setattr(indexes, "DOCS", 8)
    for fields, where, more in (([(plain, 1.0)], None, []), ([(plain, 1.0)], F.col("half") == 1, ["often"]), ([(pairs, 2.0), (plain, 1.0)], None, [])):
        got = indexes.searched(fields, q, "q", "text", where, 9, more)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in plan and rows(got) and rows(got) == rows(indexes._joined(fields, q.groupBy("q").agg(F.array_join(F.collect_list("text"), " ").alias("text")), "q", "text", where, 9, more))


def test_small_files_share_a_frame(monkeypatch):
    content = [f"page {i}".encode() for i in range(100)]
    files = pd.DataFrame({"id": range(100), "content": content, "size": [len(c) for c in content], "sha256": [hashlib.sha256(c).hexdigest() for c in content]})
    whole = list(parsing.frames(iter([files]), ["id"], 5))
    assert len(whole) == 1 and list(whole[0]["id"]) == list(range(100)) and whole[0]["problem"].isna().all()
    monkeypatch.setattr(parsing, "TOGETHER", 60)
    parts = list(parsing.frames(iter([files]), ["id"], 5))
    assert len(parts) > 5 and pd.concat(parts, ignore_index=True).equals(whole[0])


def test_lines_count_on_through_files(spark, tmp_path):
    spark.range(1000).repartitionByRange(5, "id").sortWithinPartitions("id").selectExpr("string(id) AS value").write.text(str(tmp_path / "lines"))
    got = jsonlines.numbered_lines(spark, str(tmp_path / "lines"), through=True).collect()
    assert len({r.file for r in got}) > 1 and sorted((r.line, int(r.value)) for r in got) == [(i + 1, i) for i in range(1000)]


def test_json_lines_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    found = []
    numbered = jsonlines.numbered_lines
    monkeypatch.setattr(jsonlines, "numbered_lines", lambda s, path, *a, **k: (found.append(s.read.text(path).inputFiles()), numbered(s, path, *a, **k))[1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert same(spark, tmp_path, "json_line_problems", ingestion, orders="SELECT i::BIGINT AS o_orderkey, '5-LOW' AS o_orderpriority FROM range(2000) t(i)")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(found[0]) > 1


def test_documents_are_distinct_by_sets_of_companies(spark):
    """A document that several of a question's companies have comes once, and the pairs are in no aggregate."""
    companies = spark.createDataFrame([(1, 7, "a"), (1, 7, "b"), (2, 7, "b"), (3, 8, "a"), (4, 7, None), (5, 7, "a"), (5, 7, "b")], "id int, owner int, company string")
    coverage = spark.createDataFrame([(7, "g", 1, True, 10, "a"), (7, "g", 1, True, 10, "b"), (7, "g", 1, True, 11, "b"), (7, "g", 0, True, 12, "b"), (7, "g", 1, False, 13, "a"), (8, "g", 1, True, 14, "a")], "owner int, generation string, revision int, complete boolean, document_id int, company string")
    binding = spark.createDataFrame([(7, "g", 1)], "owner int, generation string, revision int")
    out = scope.covered_documents(companies, coverage, binding, "id")
    assert sorted(map(tuple, out.collect())) == [(1, 10), (1, 11), (2, 10), (2, 11), (5, 10), (5, 11)]
    top = out._jdf.queryExecution().optimizedPlan().toString().strip().splitlines()[0]
    assert not top.startswith("Aggregate")


def test_blocks_of_many_pages_come_in_parts(monkeypatch):
    monkeypatch.setattr(readers, "TOGETHER", 100)
    pages = pd.DataFrame({"page_id": range(50), "html": [f"<p>page {i}</p><p>two</p>" if i % 9 else None for i in range(50)]})
    parts = list(readers.block_frames(iter([pages]), "page_id", "html"))
    whole = pd.concat(parts, ignore_index=True)
    assert len(parts) > 5 and list(whole["page_id"]) == [i for i in range(50) if i % 9 for _ in range(2)] and list(whole["block_index"][:4]) == [0, 1, 0, 1]
