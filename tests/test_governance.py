"""Governance rules on small cases."""

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import documents as D
from millrace.operators import governance as G
from millrace.operators import scope as S


def test_a_release_is_whole_or_nothing(spark):
    rows = spark.createDataFrame([("g", "a", 1, "x", True), ("g", "a", 2, "y", False), ("g", "b", 3, "z", True), ("h", "a", 1, "x", True), ("h", "b", 2, "x", True), ("i", "a", 1, "q", True), ("i", "a", 1, "r", False)], "generation string, member string, child int, hash string, is_active boolean")
    right = rows.where("generation <> 'i'").groupBy("generation", "member").agg(G.identity_digest(F.col("child"), F.col("hash")).alias("digest"))
    members = right.where("member = 'a'").union(spark.createDataFrame([("h", "gone", "0"), ("i", "a", "0")], "generation string, member string, digest string"))
    got = {(r.generation, r.member, r.child, r.hash): r.is_active for r in G.released(rows, members, "generation", "member", "child", "hash").collect()}
    assert [got["g", "a", 1, "x"], got["g", "a", 2, "y"], got["g", "b", 3, "z"]] == [True, True, False]
    assert got["h", "b", 2, "x"] and got["i", "a", 1, "q"] and not got["i", "a", 1, "r"]


def test_digests_are_of_sets(spark):
    import hashlib
    import json

    df = spark.createDataFrame([(1, 2, "b"), (1, 10, "a"), (2, 1, "x"), (2, 1, "y")], "g int, id int, h string")
    got = {r.g: r.d for r in df.groupBy("g").agg(G.identity_digest(F.col("id"), F.col("h")).alias("d")).collect()}
    assert got == {1: hashlib.sha256(json.dumps([["10", "a"], ["2", "b"]], separators=(",", ":")).encode()).hexdigest(), 2: None}


def test_memories_need_confirmed_sources(spark):
    messages = spark.createDataFrame([(1, "u", "user", False, None), (1, "s", "system", False, None), (1, "a", "assistant", True, "c"), (1, "c", "user", False, None), (1, "b", "assistant", True, "a"), (2, "c", "user", False, None)], "batch int, message string, role string, confirmed boolean, confirmation string")
    sources = {"ok": ["u"], "system": ["u", "s"], "unknown": ["s", "x"], "confirmed": ["a", "c"], "alone": ["a"], "by no user": ["b", "a", "c"], "none": []}
    candidates = spark.createDataFrame([(1, k, v) for k, v in sources.items()] + [(2, "other batch", ["u"])], "batch int, id string, sources array<string>")
    got = {r.id: r.reason for r in G.rejections(candidates, messages, "batch").collect()}
    assert got == {"ok": None, "system": "system_source", "unknown": "unknown_source_message", "confirmed": None, "alone": "unconfirmed_assistant_source", "by no user": "unconfirmed_assistant_source", "none": None, "other batch": "unknown_source_message"}


def test_names_within_names(spark):
    q = spark.createDataFrame([(1, "北方星河公司 and Acme East, Acme"), (2, ""), (3, None), (4, "Acme East")], "id int, text string")
    d = spark.createDataFrame([("星河公司", "company", "Xinghe"), ("北方星河公司", "company", "North"), ("Acme", "company", "A1"), ("Acme", "company", "A2"), ("Acme East", "company", "AE"), ("", "company", "no")], "alias string, field string, value string")
    got = sorted((r.id, r.value, r.start, r.end, r.status) for r in S.mentioned_names(q, d, "id", "text").collect())
    assert got == [(1, "A1", 22, 26, "ambiguous"), (1, "A2", 22, 26, "ambiguous"), (1, "AE", 11, 20, "resolved"), (1, "North", 0, 6, "resolved"), (4, "AE", 0, 9, "resolved")]


def test_pages_join_over_footers(spark):
    rows = [
        (1, 0, 1, "paragraph", None, "the end of", True, True, None), (1, 1, 1, "paragraph", "footer", "page 1", False, False, None), (1, 2, 2, "paragraph", None, "a line", True, False, None), (1, 3, 2, "paragraph", None, "next", True, True, None),
        (1, 4, 2, "table", None, "a|b", False, False, "t"), (1, 5, 3, "table", None, "c|d", False, False, "t"), (1, 6, 5, "table", None, "e|f", True, True, "t"), (1, 7, 5, "heading", None, "h", True, True, None), (1, 8, 5, "heading", None, "i", True, True, None),
        (1, 9, 6, "list_item", None, "一", True, True, None), (1, 10, 6, "list_item", None, "二", True, True, None),
    ]
    df = spark.createDataFrame(rows, "doc int, n int, page int, kind string, role string, text string, opens boolean, goes_on boolean, tab string")
    got = {r.n: (r.text, r.page_from, r.page_to, r.parts) for r in D.joined_across_pages(df, "doc", "n", "page", "kind", "text", "opens", "goes_on", "tab", "role").collect()}
    assert got == {0: ("the end of a line", 1, 2, 2), 1: ("page 1", 1, 1, 1), 3: ("next", 2, 2, 1), 4: ("a|b\nc|d", 2, 3, 2), 6: ("e|f", 5, 5, 1), 7: ("h", 5, 5, 1), 8: ("i", 5, 5, 1), 9: ("一二", 6, 6, 2)}


def test_locators_by_rows(spark):
    blocks = spark.createDataFrame([(1, 0, "a", "h1|h2\nr0|x\nr1|y\nr2|z"), (1, 1, "b", "plain text")], "doc int, block int, id string, text string")
    rows = [(1, "rows", 0, 0, "a", 0, 5, 2, 4, 1, None), (1, "rows", 1, 1, "b", 6, 10, None, None, None, "\n\n"), (1, "header", 0, 0, "a", 0, 5, 0, 1, 0, None), (1, "late", 0, 0, "a", 0, 5, 1, 9, 1, None), (1, "far", 0, 1, "b", 0, 99, None, None, None, None), (1, "lost", 0, 7, "b", 0, 1, None, None, None, None)]
    spans = spark.createDataFrame(rows, "doc int, parent string, n int, block int, block_id string, start int, end int, row_from int, row_to int, header_rows int, separator string")
    got = {r.parent: (r.text, r.problem) for r in D.resolved(spans, blocks, "doc", "parent").collect()}
    assert got == {"rows": ("h1|h2\nr1|y\nr2|z\n\ntext", None), "header": ("h1|h2", None), "late": (None, "beyond the rows"), "far": (None, "beyond the block"), "lost": (None, "no such block")}


def test_clauses_and_sentences_keep_their_places(spark):
    df = spark.createDataFrame([("a, b 1,500。 c;\n\nd! ",), ("",), (None,)], "t string")
    got = [(r.c, r.s) for r in df.select(T.clauses(F.col("t")).alias("c"), T.sentences(F.col("t")).alias("s")).collect()]
    text = "a, b 1,500。 c;\n\nd! "
    assert [x.quote for x in got[0][0]] == ["a,", " b 1,500。", " c;", "d!"] and all(text[x.start : x.end] == x.quote for x in got[0][0])
    assert [x.quote for x in got[0][1]] == ["a, b 1,500。", " c;\n\n", "d! "] and all(text[x.start : x.end] == x.quote for x in got[0][1])
    assert got[1] == ([], [])


def test_numbers_that_a_text_states():
    assert T.stated_numbers("共1,200.5元，占百分之三十，负二点五，一百零二人，十万，万") == [1200.5, 30.0, -2.5, 102.0, 100000.0]
    assert T.stated_numbers("-3e2 and none") == [-300.0]
