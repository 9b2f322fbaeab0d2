"""Hand-computed cases of single operators."""

import io
import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import documents as D
from millrace.operators import evidence, fusion, lifecycle, metrics
from millrace.operators.filters import SearchFilter, covers
from millrace.operators.lanes import bm25, cosine
from millrace.sources import readers, writers


def lanes(spark, rows):
    return spark.createDataFrame(rows, "child_id string, parent_id string, lane string, lane_rank int")


def test_fusion_sums_lanes(spark):
    out = fusion.fused(lanes(spark, [("a", "p", "x", 1), ("b", "p", "x", 2), ("b", "p", "y", 1), ("c", "p", "y", 2)])).orderBy("position").collect()
    assert [r["child_id"] for r in out] == ["b", "a", "c"]


def test_fusion_ties_go_to_the_best_rank_then_id(spark):
    out = fusion.fused(lanes(spark, [("z", "p", "x", 1), ("a", "p", "x", 2), ("b", "p", "x", 2)])).orderBy("position").collect()
    assert [r["child_id"] for r in out] == ["z", "a", "b"]


def test_fusion_limit_and_conflict(spark):
    assert fusion.fused(lanes(spark, [("a", "p", "x", 1), ("b", "p", "x", 2)]), limit=1).collect()[0]["child_id"] == "a"
    with pytest.raises(Exception, match="disagree"):
        fusion.fused(lanes(spark, [("a", "p", "x", 1), ("a", "q", "y", 1)])).collect()


def test_reciprocal_rank(spark):
    assert spark.range(1).select(fusion.reciprocal_rank(F.lit(1)).alias("r")).first()["r"] == 1 / 61


def test_parents_keep_the_first_two_and_rank_by_best(spark):
    rows = [(1, "a", "p", 0.5), (2, "b", "p", 0.1), (3, "c", "p", 0.9), (4, "d", "q", 0.9)]
    out = fusion.parents(spark.createDataFrame(rows, "position int, child_id string, parent_id string, ranking_score double")).orderBy("parent_rank").collect()
    assert [(r["parent_id"], r["children"], r["best_position"]) for r in out] == [("p", ["a", "b"], 3), ("q", ["d"], 4)]


def test_known_ranking_values(spark):
    hits = spark.createDataFrame([(1, "p3", 1), (1, "p1", 2), (1, "p2", 3)], "q int, item string, r int")
    rel = spark.createDataFrame([(1, "p1"), (1, "p2")], "q int, item string")
    r = metrics.ranking(hits, rel, "q", "item", "r", 3).first()
    assert (r["recall"], r["rr"]) == (1.0, 0.5) and abs(r["ndcg"] - 0.6934) < 1e-4
    one = metrics.ranking(hits.where("item = 'p1'").withColumn("r", F.lit(1)), rel, "q", "item", "r", 10).first()
    assert abs(one["ndcg"] - 1 / (1 + 1 / math.log2(3))) < 1e-6


def test_empty_list_is_free_and_empty_intersection_is_nothing():
    f = SearchFilter("u")
    assert not f.narrowed(None).match_none and f.narrowed([]).match_none
    assert SearchFilter("u", document_ids=(1,)).narrowed([2]).match_none
    assert covers(SearchFilter("u"), SearchFilter("u", document_ids=(1,))) and not covers(SearchFilter("u", document_ids=(1,)), SearchFilter("u"))


def test_bm25_statistics_ignore_the_filter(spark):
    docs = spark.createDataFrame([(1, "a b", True), (2, "a a c", False), (3, "d", True)], "id int, text string, ok boolean")
    q = spark.createDataFrame([(0, "a")], "q int, text string")
    free = {r["id"]: r["score"] for r in bm25(docs, q, "id", "text", "q", "text").collect()}
    kept = {r["id"]: r["score"] for r in bm25(docs, q, "id", "text", "q", "text", F.col("ok")).collect()}
    assert kept == {1: free[1]}
    idf = math.log(1 + (3 - 2 + 0.5) / (2 + 0.5))
    assert abs(free[1] - idf / (1 + 1.2 * (0.25 + 0.75 * 2 / 2))) < 1e-12


def test_cosine(spark):
    assert abs(spark.range(1).select(cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("c")).first()["c"] - 2**-0.5) < 1e-12


def test_calculator():
    assert T.calculate("2 + 3 * 4") == 14 and T.calculate("-(2 ** 3) // 3") == -3
    for bad in ("__import__('os')", "1 / 0", "9 ** 99", "2 ** 41", "10 ** 13", "a", "1" * 1001, "True", "(-1) ** 0.5"):
        assert T.calculate(bad) is None


def test_chinese_numerals():
    cases = {"十": 10, "二十一": 21, "一百零五": 105, "三千二百": 3200, "十二万": 120000, "一亿零三": 100000003, "负三点一四": -3.14, "苹果": None, "": None, "二〇二四": 2024, "一百十": 110, "三万五": 30005, "万": None, "十五点": None, "负": None}
    assert {k: T.chinese_number(k) for k in cases} == cases


def test_numbers_round_half_up(spark):
    row = lambda a, s, c: spark.range(1).select(T.unsupported_numbers(F.lit(a), F.lit(s), F.array(*(F.lit(x) for x in c))).alias("n")).first()["n"]
    assert row("grew 2.35 to 20.0 [cite:3]", "20", [2.345]) == []
    assert len(row("1,200 and 7", "1200", [6.2])) == 1


def test_heading_levels_and_paths():
    assert D.repaired_levels([3, None, 1, 4]) == [1, 2, 1, 2]
    assert D.heading_paths(["heading", "p", "heading", "p"], [1, None, 2, None], ["A", "x", "B", "y"]) == [["A"], ["A"], ["A", "B"], ["A", "B"]]


def test_parents_join_until_high_and_tables_stand_alone():
    words = lambda n: "w " * n
    assert D.parents_of(["p", "p", "table", "p"], [words(1000), words(700), words(10), words(5)]) == [[0, 1], [2], [3]]
    assert D.parents_of(["p", "p", "p"], [words(1100), words(1200), words(3)]) == [[0, 1], [2]]
    assert D.parents_of(["heading", "heading", "p", "heading"], ["a", "b", "c", "d"]) == [[0, 1, 2], [3]]


def test_children_cover_the_text():
    text = " ".join(f"w{i}" for i in range(1000))
    spans = D.children_of(text, "a heading")
    assert " ".join(text[a:b] for a, b in spans) == text and all(D.tokens(text[a:b]) <= D.CHILD - 2 for a, b in spans)


def test_rows_split_repeats_the_header():
    parts = D.rows_split("h1 h2\n" + "\n".join("a b" for _ in range(30)), 20, True)
    assert len(parts) > 1 and all(p.startswith("h1 h2\n") for p in parts)
    assert sum(p.count("a b") for p in parts) == 30


def test_overlap(spark):
    box = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    got = spark.range(1).select(D.overlap(box(0, 0, 10, 10), box(10, 10, 0, 0)).alias("a"), D.overlap(box(0, 0, 1, 1), box(2, 2, 3, 3)).alias("b"), D.overlap(box(0, 0, 0, 0), box(0, 0, 0, 0)).alias("c")).first()
    assert tuple(got) == (1.0, 0.0, 0.0)


def test_overlaid_blocks_go_in_order(spark):
    rows = [(1, 1, 0, "A  b", [0.0, 0.0, 10.0, 10.0]), (1, 1, 1, "a b", [1.0, 0.0, 11.0, 10.0]), (1, 1, 2, "a B", [2.0, 0.0, 12.0, 10.0]), (1, 1, 3, "other", [0.0, 0.0, 10.0, 10.0]), (1, 2, 4, "a b", [0.0, 0.0, 10.0, 10.0]), (1, 1, 5, "a b", None), (1, 1, 6, None, [0.0, 0.0, 10.0, 10.0])]
    df = spark.createDataFrame(rows, "doc int, page int, n int, text string, box array<double>")
    assert sorted(r.n for r in D.without_overlaid(df, "doc", "page", "n", "text", "box").collect()) == [0, 2, 3, 4, 5, 6]


def test_closure_and_drift(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src long, dst long")
    got = lifecycle.closure(e, spark.createDataFrame([(1,)], "root long"), 2).collect()
    assert {r["node"] for r in got} == {1, 2, 3}
    a, b = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]))
    assert {(r["k"], r["drift"]) for r in lifecycle.drift(a, b, "k").collect()} == {(1, "removed"), (2, "changed"), (3, "added")}


def test_bootstrap_is_that_of_the_seed(spark):
    rows = [(c, c * 10 + i, float((c * 7 + i) % 5)) for c in range(6) for i in range(4)]
    r = metrics.bootstrap(spark.createDataFrame(rows, "c int, at int, v double"), "c", "at", "v").first()
    m = [sum(v for x, _, v in rows if x == c) / 4 for c in range(6)]
    draw = random.Random(20260930)
    got = sorted(math.fsum(draw.choices(m, k=6)) / 6 for _ in range(1000))
    assert (round(r["low"], 9), round(r["high"], 9)) == (round(got[24], 9), round(got[974], 9))


def _container(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return out.getvalue()


def test_container_safety():
    fine = {"[Content_Types].xml": "<a/>", "xl/workbook.xml": "<a/>"}
    assert readers.container_problem(_container(fine)) is None
    assert readers.container_problem(b"x") == "not a container"
    assert readers.container_problem(_container({"a": "b"})) == "a part is missing"
    assert readers.container_problem(_container(fine | {"../x": "1"})) == "unsafe names"
    assert readers.container_problem(_container(fine | {"xl/a.xml": "<!DOCTYPE a>"})) == "declares entities"
    assert readers.container_problem(_container(fine | {"_rels/.rels": "<a/>", "xl/media/x.GIF": b"GIF89a..."})) is None
    for name, content, problem in (("xl/a.xml", "<a>", "broken markup"), ("xl/m.png", b"GIF89a", "not the image it says"), ("xl/m.gif", b"GIF89a \x1f\x8b", "nested container"), ("xl/m.bin", b"x", "another kind of part"), ("xl/a:b.xml", "<a/>", "unsafe names"), ("xl//b.xml", "<a/>", "unsafe names")):
        assert readers.container_problem(_container(fine | {name: content})) == problem
    assert readers.container_problem(_container(fine | {"xl/z.txt": "0" * 5_000_000})) == "too large"


def test_html_blocks():
    got = readers.html_blocks("<h2>A &amp; B</h2><p>x <b>y</b><p>z<script>var a='<p>'</script><li>i</li>tail <b")
    assert got == [("section_header", 2, "A & B"), ("text", None, "x y"), ("text", None, "z"), ("list_item", None, "i"), ("text", None, "tail")]


def test_artifacts_verify(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "payload string")
    out = writers.artifacts(df, str(tmp_path / "a"), "payload")
    assert out.count() == 2 and writers.broken(out, "payload").count() == 0


def test_staging_replaces_its_generation_only(spark, tmp_path):
    path = str(tmp_path / "s")
    for g, rows in (("g1", [(1,)]), ("g2", [(2,)]), ("g1", [(3,)])):
        writers.staged(spark.createDataFrame(rows, "id int"), path, g)
    got = {(r["id"], r["index_generation"]) for r in spark.read.parquet(path).collect()}
    assert got == {(2, "g2"), (3, "g1")}


def test_json_lines_are_strict(spark, tmp_path):
    from pyspark.sql import types as ST

    schema = ST.StructType([ST.StructField("id", ST.StringType()), ST.StructField("n", ST.LongType())])
    (tmp_path / "a.jsonl").write_text('{"id": "a", "n": 1}\n{"id": "b", "n": 2}\n')
    assert readers.json_lines(spark, str(tmp_path / "a.jsonl"), schema, "id").count() == 2
    (tmp_path / "b.jsonl").write_text('{"id": "a", "n": 1}\n{"id": "a", "n": 2}\n')
    with pytest.raises(Exception, match="repeated"):
        readers.json_lines(spark, str(tmp_path / "b.jsonl"), schema, "id").collect()


def test_report_files(spark, tmp_path):
    writers.report(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "r"))
    assert (tmp_path / "r.md").read_text().startswith("| a | b |") and (tmp_path / "r.jsonl").read_text() == '{"a": 1, "b": "x"}\n'


def test_mentions():
    got = T.mentions("请问星河公司和蓝天科技公司的普通员工")
    assert [(f, v) for f, v, *_ in got] == [("company", "星河公司"), ("company", "蓝天科技公司"), ("population", "普通员工")]
    assert T.mentions("本公司") == [] and T.mentions("比较两家公司")[0][4] == "unresolved"


def test_file_names():
    assert T.file_name(" cafe\u0301.pdf ") == "café.pdf"
    assert [T.file_name(x) for x in ("", "..", "a/b", "a\\b", "a\x00", "a\n b")] == [None] * 6


def test_schema_diff():
    from pyspark.sql import types as ST

    a, b = ST.StructType().add("x", "string").add("y", "string"), ST.StructType().add("y", "long").add("z", "string")
    assert readers.schema_diff(a, b) == {"missing": ["x"], "unexpected": ["z"], "changed": ["y"]}


def test_passages_are_found_whatever_their_length(spark):
    from millrace.operators.spans import containing

    texts = spark.createDataFrame([(1, "xone two three  four five sixy"), (2, "one two three four five six"), (3, "a b"), (4, None), (5, "")], "id long, t string")
    parts = spark.createDataFrame([(1, "one two three  four five six"), (2, "two three four five six"), (3, "b"), (4, None), (5, "e two three  four fiv")], "p long, part string")
    got = {(r["id"], r["p"]) for r in containing(texts, "id", "t", parts, "p", "part").collect()}
    assert got == {(1, 1), (1, 5), (2, 2), (3, 3)}
