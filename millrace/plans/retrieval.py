"""Retrieval: scope, lanes, fusion, reranking, parents, hydration, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import evidence, fusion, lanes, packing
from millrace.operators.filters import SearchFilter, page_before
from millrace.operators.indexes import StoredLexicalIndex, StoredVectorIndex, searched
from millrace.plans.base import CHUNKS, DOCUMENTS, VERSIONS, chunks, documents, table, versions
from millrace.sources.tables import built_once

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


TERMS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


@query("scope_filter", f"WITH {CHUNKS} SELECT child_id, content_type FROM chunks WHERE user_id = 'src1' AND is_active AND content_type IN ('en', 'fr')")
def scope_filter(spark: SparkSession, d: str) -> DataFrame:
    f = SearchFilter("src1", content_types=("en", "fr"))
    return chunks(spark, d).where(f.column()).select("child_id", "content_type")


@query("empty_intersection", f"WITH {CHUNKS} SELECT child_id FROM chunks WHERE false")
def empty_intersection(spark, d):
    f = SearchFilter("src1", document_ids=(1, 21)).narrowed([3, 4])
    return chunks(spark, d).where(f.column(document="child_id")).select("child_id")


@query("document_intersection", f"WITH {CHUNKS} SELECT child_id, is_active FROM chunks WHERE user_id = 'src1' AND is_active AND child_id IN (21, 41)")
def document_intersection(spark, d):
    f = SearchFilter("src1", document_ids=(1, 21, 41)).narrowed([21, 41, 61])
    return chunks(spark, d).where(f.column(document="child_id")).select("child_id", "is_active")


@query("date_range", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31'")
def date_range(spark, d):
    o = table(spark, d, "orders")
    return o.where((F.col("o_orderstatus") == "F") & F.col("o_orderdate").between("1997-01-01", "1997-12-31")).select("o_orderkey", "o_orderstatus")


_HITS = f"""
WITH {CHUNKS}, w AS (SELECT doc_id, unnest({TERMS.format("text")}) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL), l AS (SELECT doc_id, count(*) AS dl FROM w GROUP BY doc_id),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest({TERMS.format("text")}) AS term FROM benchmark),
bm AS (SELECT q.item_id, p.doc_id AS child_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score
  FROM p JOIN q USING (term) JOIN f USING (term) JOIN l USING (doc_id) JOIN chunks c ON c.child_id = p.doc_id, s WHERE <where> GROUP BY ALL),
bmr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, child_id) AS lane_rank FROM bm)
"""


def _hits(where: str) -> str:
    return _HITS.replace("<where>", where)


def lexical_index(spark, d, analyzer=lanes.terms) -> StoredLexicalIndex:
    """The stored index of all chunks by an analyzer, built from the tables as they are now unless that is done."""
    build = lambda path: StoredLexicalIndex.build(chunks(spark, d), "child_id", "text", path, ["user_id", "content_type", "is_active"], analyzer)
    return StoredLexicalIndex(spark, built_once(spark, f"lexical-{analyzer.__name__}", [f"{d}/documents.parquet", f"{d}/labels.parquet"], build), analyzer)


def vector_index(spark, d) -> StoredVectorIndex:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("child_id"), "embedding", "label")
    build = lambda path: StoredVectorIndex.build(rows, "child_id", "embedding", path, 64, ["label"])
    return StoredVectorIndex(spark, built_once(spark, "vectors", [f"{d}/embeddings.parquet"], build))


@query("bm25_lane", _hits("c.content_type = 'en' AND c.is_active") + "SELECT item_id, child_id, round(score, 6) AS score, lane_rank FROM bmr WHERE lane_rank <= 40")
def bm25_lane(spark, d):
    """From the stored index: postings of the terms asked that meet the filter, and no text."""
    out = lexical_index(spark, d).search(table(spark, d, "benchmark"), "item_id", "text", (F.col("content_type") == "en") & F.col("is_active"))
    return out.select("item_id", "child_id", F.round("score", 6).alias("score"), F.col("lane_rank").cast("long").alias("lane_rank"))


def _vector(spark, d, vec_id: int = 0) -> list[float]:
    row = table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row[0]]


_KNN = """
qv AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
nn AS (SELECT vec_id AS child_id, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM embeddings, qv WHERE {where}),
nnr AS (SELECT *, row_number() OVER (ORDER BY round(score, 6) DESC, child_id) AS lane_rank FROM nn)
"""


@query("knn_lane", "WITH " + _KNN.format(where="label <> 3") + "SELECT child_id, round(score, 6) AS score, lane_rank FROM nnr WHERE lane_rank <= 40")
def knn_lane(spark, d):
    """Exact neighbours of one vector among those that meet the filter, from the stored index."""
    return vector_index(spark, d).search(_vector(spark, d), F.col("label") != 3).select("child_id", F.round("score", 6).alias("score"), F.col("lane_rank").cast("long").alias("lane_rank"))


_BI = TERMS.format("text")
_BIGRAM = f"list_filter(flatten(list_transform({_BI}, lambda t: list_transform(range(1, greatest(length(t), 2)), lambda i: substr(t, i, 2)))), lambda t: t <> '')"


@query("bm25_best_fields", f"""
WITH w AS (SELECT doc_id, 0 AS a, unnest({TERMS.format("text")}) AS term FROM documents UNION ALL SELECT doc_id, 1 AS a, unnest({_BIGRAM}) FROM documents),
p AS (SELECT a, doc_id, term, count(*) AS tf FROM w GROUP BY ALL), l AS (SELECT a, doc_id, count(*) AS dl FROM w GROUP BY ALL),
s AS (SELECT a, count(*) AS n, avg(dl) AS avgdl FROM l GROUP BY a), f AS (SELECT a, term, count(*) AS df FROM p GROUP BY ALL),
b AS (SELECT * FROM benchmark),
q AS (SELECT DISTINCT item_id, 0 AS a, unnest({TERMS.format("text")}) AS term FROM b UNION ALL SELECT DISTINCT item_id, 1 AS a, unnest({_BIGRAM}) FROM b),
m AS (SELECT a, q.item_id, p.doc_id AS child_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score
  FROM p JOIN q USING (a, term) JOIN f USING (a, term) JOIN l USING (a, doc_id) JOIN s USING (a) GROUP BY ALL),
x AS (SELECT item_id, child_id, max(CASE a WHEN 1 THEN 2 * score ELSE score END) AS score FROM m GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, child_id) AS lane_rank FROM x)
SELECT item_id, child_id, round(score, 6) AS score, lane_rank FROM r WHERE lane_rank <= 10""")
def bm25_best_fields(spark, d):
    b = table(spark, d, "benchmark")
    out = searched([(lexical_index(spark, d, lanes.bigrams), 2.0), (lexical_index(spark, d), 1.0)], b, "item_id", "text", None, 10)
    return out.select("item_id", "child_id", F.round("score", 6).alias("score"), F.col("lane_rank").cast("long").alias("lane_rank"))


@query("bm25_scope_terms", _hits("true") + f""", q2 AS (SELECT DISTINCT item_id, 'the' AS term FROM benchmark),
bm2 AS (SELECT q2.item_id, p.doc_id AS child_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS more FROM p JOIN q2 USING (term) JOIN f USING (term) JOIN l USING (doc_id), s GROUP BY ALL),
x AS (SELECT bm.item_id, bm.child_id, bm.score + coalesce(more, 0) AS score FROM bm LEFT JOIN bm2 ON bm.item_id = bm2.item_id AND bm.child_id = bm2.child_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, child_id) AS lane_rank FROM x)
SELECT item_id, child_id, round(score, 6) AS score, lane_rank FROM r WHERE lane_rank <= 10""")
def bm25_scope_terms(spark, d):
    out = lexical_index(spark, d).search(table(spark, d, "benchmark"), "item_id", "text", None, 10, ["the"])
    return out.select("item_id", "child_id", F.round("score", 6).alias("score"), F.col("lane_rank").cast("long").alias("lane_rank"))


_ITEM = "bmi AS (SELECT * FROM bmr WHERE item_id = 0 AND lane_rank <= 40), "
_FUSED = (
    _hits("c.is_active") + ", " + _ITEM + _KNN.format(where="true")
    + """, lanes AS (SELECT child_id, 'bm25' AS lane, lane_rank FROM bmi UNION ALL SELECT child_id, 'dense' AS lane, lane_rank FROM nnr WHERE lane_rank <= 40),
fu AS (SELECT child_id, round(sum(1.0 / (60 + lane_rank)), 9) AS rrf_score, min(lane_rank) AS best_rank, child_id // 10 AS parent_id FROM lanes GROUP BY child_id),
fur AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY rrf_score DESC, best_rank, child_id) AS position FROM fu) WHERE position <= 30)
"""
)


def _lanes(spark, d) -> DataFrame:
    one = table(spark, d, "benchmark").where("item_id = 0")
    bm = lexical_index(spark, d).search(one, "item_id", "text", F.col("is_active")).select("child_id", F.lit("bm25").alias("lane"), "lane_rank")
    nn = vector_index(spark, d).search(_vector(spark, d)).select("child_id", F.lit("dense").alias("lane"), "lane_rank")
    return bm.union(nn).withColumn("parent_id", F.floor(F.col("child_id") / 10))


@query("rrf_fusion", _FUSED + "SELECT child_id, parent_id, rrf_score, best_rank, position FROM fur")
def rrf_fusion(spark, d):
    out = fusion.fused(_lanes(spark, d))
    return out.select("child_id", "parent_id", "rrf_score", F.col("best_rank").cast("long").alias("best_rank"), F.col("position").cast("long").alias("position"))


@query("reciprocal_rank", "SELECT l_orderkey, l_linenumber, round(1.0 / (60 + l_linenumber), 9) AS rr FROM lineitem")
def reciprocal_rank(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(fusion.reciprocal_rank(F.col("l_linenumber")), 9).alias("rr"))


_RERANK = _FUSED + f""", b0 AS (SELECT list_distinct({TERMS.format("text")}) AS q FROM benchmark WHERE item_id = 0),
rs AS (SELECT fur.*, round(coalesce(len(list_intersect(q, t)) / nullif(len(list_distinct(list_concat(q, t))), 0), 0), 9) AS rerank_score FROM fur JOIN (SELECT doc_id, list_distinct({TERMS.format("text")}) AS t FROM documents) x ON x.doc_id = fur.child_id, b0),
rr AS (SELECT * FROM (SELECT child_id, parent_id, rrf_score, rerank_score, rerank_score AS ranking_score, row_number() OVER (ORDER BY rerank_score DESC, position) AS position FROM rs) WHERE position <= 10)
"""


def _reranked(spark, d, works: bool = True) -> DataFrame:
    hits = fusion.fused(_lanes(spark, d))
    if works:
        text = table(spark, d, "benchmark").where("item_id = 0").first()["text"]
        hits = table(spark, d, "documents").select(F.col("doc_id").alias("child_id"), "text").join(F.broadcast(hits), "child_id")  # 30 rows
        return fusion.reranked(hits, fusion.overlap_score(F.lit(text), F.col("text")))
    return fusion.reranked(hits, None)


@query("rerank", _RERANK + "SELECT child_id, parent_id, rerank_score, position FROM rr")
def rerank(spark, d):
    return _reranked(spark, d).select("child_id", "parent_id", "rerank_score", F.col("position").cast("long").alias("position"))


@query("rerank_degraded", _FUSED + "SELECT child_id, rrf_score AS ranking_score, true AS degraded, position FROM fur WHERE position <= 10")
def rerank_degraded(spark, d):
    return _reranked(spark, d, False).select("child_id", "ranking_score", "degraded", F.col("position").cast("long").alias("position"))


_PARENTS = _RERANK + """, pk AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY position) AS nth, max(ranking_score) OVER (PARTITION BY parent_id) AS best FROM rr),
pg AS (SELECT parent_id, max(best) AS parent_score, min(CASE WHEN ranking_score = best THEN position END) AS best_position, string_agg(CASE WHEN nth <= 2 THEN child_id::VARCHAR END, ',' ORDER BY position) AS children FROM pk GROUP BY parent_id),
pr AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY parent_score DESC, best_position, parent_id) AS parent_rank FROM pg) WHERE parent_rank <= 6)
"""


@query("parent_aggregation", _PARENTS + "SELECT parent_id, parent_score, best_position, children, parent_rank FROM pr")
def parent_aggregation(spark, d):
    out = fusion.parents(_reranked(spark, d))
    return out.select("parent_id", "parent_score", F.col("best_position").cast("long").alias("best_position"), F.array_join("children", ",").alias("children"), F.col("parent_rank").cast("long").alias("parent_rank"))


@query("hybrid_retrieval", _PARENTS + "SELECT pr.parent_id, parent_score, parent_rank, children, count(*) AS n_children, sum(c.n_chars)::BIGINT AS n_chars FROM pr JOIN chunks c ON c.parent_id = pr.parent_id GROUP BY ALL")
def hybrid_retrieval(spark, d):
    """One question end to end: filter, two lanes, fusion, reranking, parents, hydration."""
    top = fusion.parents(_reranked(spark, d)).withColumn("children", F.array_join("children", ","))
    # at most six parents are left: the chunks are met by a join that carries ids only
    rows = chunks(spark, d).select("parent_id", "child_id", "n_chars").join(F.broadcast(top), "parent_id")
    return rows.groupBy("parent_id", "parent_score", F.col("parent_rank").cast("long").alias("parent_rank"), "children").agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_chars").alias("n_chars"))


_LIVE = f"WITH {VERSIONS}, {DOCUMENTS}, req AS (SELECT l_orderkey, l_linenumber, l_partkey AS position FROM lineitem WHERE l_suppkey = 7)"


def _parents_of(spark, d):
    c = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("parent_id"), F.col("l_orderkey").alias("version_id"), "l_suppkey", "l_partkey", "l_quantity")
    return c.join(versions(spark, d).select("version_id", "document_id"), "version_id")


@query("parent_hydration", f"WITH {VERSIONS}, {DOCUMENTS} SELECT l_orderkey * 10 + l_linenumber AS parent_id, l_partkey AS position, l_quantity AS content, v.document_id, v.version_id, d.user_id FROM lineitem l JOIN versions v ON l.l_orderkey = v.version_id JOIN docs d ON d.document_id = v.document_id WHERE l_suppkey = 7 AND d.status = 'active' AND v.status = 'active' AND d.active_version_id = v.version_id")
def parent_hydration(spark, d):
    rows = _parents_of(spark, d)
    asked = rows.where("l_suppkey = 7").select("parent_id", F.col("l_partkey").alias("position")).distinct()
    all_ = rows.select("parent_id", "document_id", "version_id", F.col("l_quantity").alias("content"), F.col("l_suppkey")).where("l_suppkey = 7").drop("l_suppkey")
    out = fusion.hydrated(asked, all_, documents(spark, d), versions(spark, d).select("version_id", "document_id", "status"))
    return out.select("parent_id", "position", "content", "document_id", "version_id", "user_id")


@query("fail_closed_hydration", "SELECT c_custkey AS parent_id, c_name AS content FROM customer WHERE c_custkey < 5 AND (SELECT count(*) FROM customer WHERE c_custkey IN (0, 1, 2, 3, 4)) = 5")
def fail_closed_hydration(spark, d):
    asked = spark.range(5).select(F.col("id").alias("parent_id"))
    found = table(spark, d, "customer").select(F.col("c_custkey").alias("parent_id"), F.col("c_name").alias("content")).join(asked, "parent_id", "left_semi")
    return fusion.hydrated_or_none(asked, found)


@query("fail_closed_missing", "SELECT c_custkey AS parent_id, c_name AS content FROM customer WHERE false")
def fail_closed_missing(spark, d):
    asked = spark.range(-1, 4).select(F.col("id").alias("parent_id"))
    found = table(spark, d, "customer").select(F.col("c_custkey").alias("parent_id"), F.col("c_name").alias("content")).join(asked, "parent_id", "left_semi")
    return fusion.hydrated_or_none(asked, found)


_BATCHES = "cand AS (SELECT l_partkey AS parent_id, l_suppkey % 4 AS version_id, l_linenumber AS batch, l_orderkey AS position, round(l_discount * 10 - l_tax, 4) AS score, l_suppkey AS document_id FROM lineitem)"


def _candidates(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_partkey").alias("parent_id"), (F.col("l_suppkey") % 4).alias("version_id"), F.col("l_linenumber").alias("batch"), F.col("l_orderkey").alias("position"), F.round(F.col("l_discount") * 10 - F.col("l_tax"), 4).alias("score"), F.col("l_suppkey").alias("document_id"))


@query("candidate_dedup", f"WITH {_BATCHES} SELECT parent_id, version_id, batch, position, score FROM (SELECT *, row_number() OVER (PARTITION BY parent_id, version_id ORDER BY score DESC, batch, position, document_id) AS rn FROM cand) WHERE rn = 1")
def candidate_dedup(spark, d):
    return evidence.first_of(_candidates(spark, d), ["parent_id", "version_id"], [F.desc("score"), "batch", "position", "document_id"]).select("parent_id", "version_id", "batch", "position", "score")


@query("document_diversity", f"WITH {_BATCHES}, r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, batch, position, parent_id) AS n, (SELECT count(DISTINCT document_id) FROM cand) AS docs FROM cand) SELECT document_id, parent_id, batch, position, score FROM r WHERE n <= CASE WHEN docs = 1 THEN 6 ELSE 3 END")
def document_diversity(spark, d):
    out = evidence.diverse(_candidates(spark, d), "document_id", [F.desc("score"), "batch", "position", "parent_id"])
    return out.select("document_id", "parent_id", "batch", "position", "score")


@query("stage_order_dedup", f"WITH {_BATCHES} SELECT parent_id, min(position) AS position FROM cand GROUP BY parent_id")
def stage_order_dedup(spark, d):
    return _candidates(spark, d).groupBy("parent_id").agg(F.min("position").alias("position"))


@query("evidence_merge", """WITH e AS (SELECT user_id % 5 AS todo_id, event_id % 700 AS evidence_id, event_type AS relation, event_id FROM events)
SELECT evidence_id, min(todo_id) AS todo_id, string_agg(DISTINCT relation, ',' ORDER BY relation) AS relations FROM e GROUP BY evidence_id""")
def evidence_merge(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 5).alias("todo_id"), (F.col("event_id") % 700).alias("evidence_id"), F.col("event_type").alias("relation"))
    return e.groupBy("evidence_id").agg(F.min("todo_id").alias("todo_id"), F.array_join(F.array_sort(F.collect_set("relation")), ",").alias("relations"))


@query("centered_crop", """WITH b AS (SELECT text FROM benchmark WHERE item_id = 0), m AS (SELECT doc_id, d.text, strpos(d.text, ' the ') AS pos FROM documents d),
w AS (SELECT *, greatest(1, least(pos - 600 + 3, length(text) - 1200 + 1)) AS s FROM m WHERE pos > 0)
SELECT doc_id, md5(CASE WHEN length(text) <= 1200 THEN text ELSE (CASE WHEN s > 1 THEN '…' ELSE '' END) || substr(text, s + CASE WHEN s > 1 THEN 1 ELSE 0 END, 1200 - CASE WHEN s > 1 THEN 1 ELSE 0 END - CASE WHEN s + 1200 - 1 < length(text) THEN 1 ELSE 0 END) || (CASE WHEN s + 1200 - 1 < length(text) THEN '…' ELSE '' END) END) AS crop FROM w""")
def centered_crop(spark, d):
    rows = table(spark, d, "documents").where(F.instr("text", " the ") > 0)
    return rows.select("doc_id", F.md5(T.centered_crop(F.col("text"), F.instr("text", " the "), F.lit(5))).alias("crop"))


@query("tenancy_check", f"WITH {CHUNKS} SELECT parent_id, count(*) AS hits FROM chunks GROUP BY parent_id HAVING count(DISTINCT content_type) = 1")
def tenancy_check(spark, d):
    hits = chunks(spark, d).groupBy("parent_id").agg(F.collect_list("content_type").alias("owners"))
    return hits.where(F.forall("owners", lambda x: x == F.element_at("owners", 1))).select("parent_id", F.size("owners").cast("long").alias("hits"))


@query("keyset_page", "SELECT o_orderkey, o_orderdate FROM orders WHERE (o_orderdate < TIMESTAMP '1997-06-01') OR (o_orderdate = TIMESTAMP '1997-06-01' AND o_orderkey < 700) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 51")
def keyset_page(spark, d):
    import datetime as dt

    return page_before(table(spark, d, "orders"), "o_orderdate", "o_orderkey", (dt.datetime(1997, 6, 1), 700), 50).select("o_orderkey", "o_orderdate")


@query("conversation_history", """WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations),
s AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS upto FROM t WHERE back <= 6)
SELECT conv_id, turn, role, CASE WHEN upto <= 8000 THEN length(text) ELSE 8000 - (upto - length(text)) END AS kept, md5(right(text, (CASE WHEN upto <= 8000 THEN length(text) ELSE 8000 - (upto - length(text)) END)::INT)) AS tail FROM s WHERE upto - length(text) < 8000""")
def conversation_history(spark, d):
    out = evidence.bounded_history(table(spark, d, "conversations"), "conv_id", "turn", "text")
    return out.select("conv_id", "turn", "role", F.length("tail").cast("long").alias("kept"), F.md5("tail").alias("tail"))


@query("stratified_sample", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('eval:' || doc_id), doc_id) AS n FROM documents) WHERE n <= 20")
def stratified_sample(spark, d):
    n = F.row_number().over(W.partitionBy("lang").orderBy(F.sha2(F.concat(F.lit("eval:"), F.col("doc_id").cast("string")), 256), "doc_id"))
    return table(spark, d, "documents").select("doc_id", "lang", n.alias("n")).where("n <= 20").drop("n")


@query("latest_per_group", "SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def latest_per_group(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("event_type"))


_PACK = _hits("true").replace("WITH chunks", "WITH RECURSIVE chunks", 1) + r""",
c0 AS (SELECT item_id, lane_rank AS rank, child_id, d.lang, d.source, d.text AS content, substr(d.text, length(d.text) // 3 + 1, 30) AS child FROM bmr JOIN documents d ON d.doc_id = bmr.child_id WHERE lane_rank <= 8),
c1 AS (SELECT *, CASE WHEN length(child) > 0 THEN strpos(content, child) - 1 ELSE length(content) // 2 END AS spot FROM c0),
c2 AS (SELECT *, greatest(0, least(spot - 600, length(content) - 1200)) AS s FROM c1),
c3 AS (SELECT *, CASE WHEN length(content) <= 1200 THEN content ELSE (CASE WHEN s > 0 THEN '…' ELSE '' END) || CASE WHEN s + 1200 < length(content)
  THEN substr(content, s + 1, 1200 - (s > 0)::INT - 1) || '…' ELSE right(content, 1199) END END AS whole FROM c2),
c4 AS (SELECT *, CASE WHEN length(child) > 0 AND contains(whole, child) THEN strpos(whole, child) - 1 ELSE length(whole) // 2 END AS pos,
  length('{"trust":"untrusted_data","source":"document:' || child_id % 5 || '","evidence_id":"' || child_id || '","content":}') + CASE WHEN child_id % 2 = 1 THEN length(',"heading_path":["' || source || '"]') ELSE 0 END AS fixed FROM c3),
k0 AS (SELECT *, unnest(range(0, length(whole) + 1)) AS k FROM c4),
k1 AS (SELECT *, greatest(0, least(pos - k // 2, length(whole) - k)) AS s2 FROM k0),
k2 AS (SELECT item_id, rank, k, fixed, CASE WHEN k = length(whole) THEN whole WHEN k < 1 THEN '' ELSE (CASE WHEN s2 > 0 THEN '…' ELSE '' END) || CASE WHEN s2 + k < length(whole)
  THEN substr(whole, s2 + 1, greatest(0, k - (s2 > 0)::INT - 1)::BIGINT) || '…' ELSE right(whole, greatest(0, k - (s2 > 0)::INT)::BIGINT) END END AS crop FROM k1),
k3 AS (SELECT item_id, rank, list(fixed + length(to_json(crop)::VARCHAR) ORDER BY k) AS sizes, list(length(translate(crop, '… ' || chr(10) || chr(13) || chr(9), '')) > 0 ORDER BY k) AS usable FROM k2 GROUP BY ALL),
cand AS (SELECT c4.item_id, rank, child_id, child_id % 5 AS document, lang, sizes, usable FROM c4 JOIN k3 USING (item_id, rank)),
one AS (SELECT item_id, CASE WHEN count(DISTINCT document) = 1 THEN 6 ELSE 3 END AS cap FROM cand GROUP BY item_id),
tries AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY phase, rank) AS i FROM (SELECT *, 1 AS phase, lang AS target FROM cand WHERE lang = 'de' UNION ALL SELECT *, 2, lang FROM cand WHERE lang = 'fr' UNION ALL SELECT *, 3, NULL FROM cand)),
st AS (SELECT item_id, 0::BIGINT AS i, 0::BIGINT AS used, 0 AS n, []::BIGINT[] AS chosen, []::VARCHAR[] AS covered, []::BIGINT[] AS docs, NULL::BIGINT AS took, NULL::BIGINT AS k FROM one
  UNION ALL
  SELECT item_id, i, CASE WHEN ok THEN used + (n > 0)::INT + sizes[best + 1] ELSE used END, n + ok::INT, CASE WHEN ok THEN list_append(chosen, rank) ELSE chosen END,
    CASE WHEN ok THEN list_append(covered, lang) ELSE covered END, CASE WHEN ok THEN list_append(docs, document) ELSE docs END, CASE WHEN ok THEN rank END, CASE WHEN ok THEN best END
  FROM (SELECT *, free AND best >= 0 AND coalesce(usable[best + 1], false) AS ok FROM (SELECT st.item_id, t.i, st.used, st.n, st.chosen, st.covered, st.docs, t.rank, t.lang, t.document, t.sizes, t.usable,
      len(list_filter(t.sizes, lambda y: y <= 4000 - st.used - (st.n > 0)::INT)) - 1 AS best,
      NOT coalesce(list_contains(st.covered, t.target), false) AND NOT list_contains(st.chosen, t.rank) AND len(list_filter(st.docs, lambda y: y = t.document)) < one.cap AS free
    FROM st JOIN tries t ON t.item_id = st.item_id AND t.i = st.i + 1 JOIN one ON one.item_id = st.item_id) u) v)
SELECT st.item_id, cand.child_id, st.n::BIGINT AS position, length(k2.crop) AS n_chars, md5(k2.crop) AS content FROM st JOIN cand ON cand.item_id = st.item_id AND cand.rank = st.took JOIN k2 ON k2.item_id = st.item_id AND k2.rank = st.took AND k2.k = st.k
"""


@query("greedy_packing", _PACK)
def greedy_packing(spark, d):
    """The 8 best documents of each item packed in 4000 characters: one in German and one in French first, three of a
    document (here: of ids that agree modulo 5) at most."""
    hits = lexical_index(spark, d).search(table(spark, d, "benchmark"), "item_id", "text", None, 8)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("child_id"), "lang", "source", "text")
    third = F.substring(F.col("text"), (F.floor(F.length("text") / 3) + 1).cast("int"), F.lit(30))
    odd = F.col("child_id") % 2 == 1
    rows = docs.join(F.broadcast(hits), "child_id").select(  # 8 hits an item: no text moves but theirs
        "item_id", F.col("lane_rank").alias("rank"), (F.col("child_id") % 5).cast("string").alias("document"), F.col("child_id").cast("string").alias("evidence"), F.col("text").alias("content"),
        third.alias("child"), F.when(odd, F.array("source")).otherwise(F.array().cast("array<string>")).alias("headings"), F.array("lang").alias("targets"),
    )
    out = packing.packed(rows, "item_id", ["de", "fr"], 4000)
    return out.select("item_id", F.col("evidence").cast("long").alias("child_id"), F.col("position").cast("long").alias("position"), F.length("content").cast("long").alias("n_chars"), F.md5("content").alias("content"))
