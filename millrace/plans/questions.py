"""Queries over the helpers of the question path."""

from __future__ import annotations

import html
import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import research as R
from millrace.plans.base import chunks, table
from millrace.sources import readers, writers
from millrace.sources.tables import fresh

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


@query("query_windowing", r"""WITH q AS (SELECT item_id, text AS q, length(text) AS len, regexp_extract_all(lower(text), '\S+') AS t, regexp_extract_all(text, '\s*\S+') AS p FROM benchmark),
e AS (SELECT item_id, len, unnest(range(1, len(p))) AS k, p FROM q), n AS (SELECT item_id, k, length(array_to_string(p[1:k], '')) AS stop, len FROM e),
r AS (SELECT conv_id, turn, item_id, list_distinct(regexp_extract_all(lower(text), '\S+')) AS d, len(regexp_extract_all(text, '\S+')) AS size, q.t FROM conversations JOIN q ON q.item_id = conv_id % 40),
w AS (SELECT r.conv_id, r.turn, min_by(n.k, (abs(n.stop - n.len / 2), n.stop)) AS k FROM r JOIN n ON n.item_id = r.item_id AND len(r.t) + size > 120 AND n.k + size <= 120 AND len(r.t) - n.k + size <= 120 GROUP BY ALL),
v AS (SELECT conv_id, turn, item_id, d, unnest(CASE WHEN len(t) + size <= 120 THEN [t] WHEN k IS NOT NULL THEN [t[1:k], t[k + 1:]] ELSE [NULL] END) AS part FROM r LEFT JOIN w USING (conv_id, turn))
SELECT conv_id, turn, item_id, max(len(list_intersect(list_distinct(part), d)) / len(list_distinct(list_concat(part, d)))) AS score FROM v GROUP BY ALL""")
def query_windowing(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("q"))
    docs = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("t"))
    rows = docs.withColumn("item_id", F.col("conv_id") % 40).join(b, "item_id")
    return rows.select("conv_id", "turn", "item_id", R.windowed_score(R.shared_terms, 120)("q", "t").alias("score"))


@query("hashed_embedding")
def hashed_embedding(spark, d):
    return table(spark, d, "benchmark").select("item_id", R.hashed_vector()("text").alias("embedding"))


@query("lane_degradation", "SELECT vec_id AS child_id, (SELECT count(*) FROM documents) > 0 AS degraded FROM embeddings WHERE label = 3")
def lane_degradation(spark, d):
    """One lane's table is missing, one fails while it reads the documents; the third one answers."""
    fails = F.when(F.length("text") >= 0, F.raise_error(F.lit("the index is down"))).otherwise(F.col("doc_id"))
    good, lost = R.either_lane([lambda: spark.table("no_such_index"), lambda: table(spark, d, "documents").select(fails.alias("child_id")), lambda: table(spark, d, "embeddings").where("label = 3").select(F.col("vec_id").alias("child_id"))])
    return good[0].withColumn("degraded", F.lit(len(good) == 1 and len(lost) == 2))


@query("query_compilation", "SELECT doc_id AS child_id FROM documents WHERE source = 'src1' AND doc_id IN (21, 41)")
def query_compilation(spark, d):
    plan = R.compiled("what is  new", ["src1"], ["1", "21", "41"], ["21", "41", "61"])
    return chunks(spark, d).where(F.col("user_id").isin(*plan.scope) & F.col("child_id").cast("string").isin(*plan.documents)).select("child_id")


@query("context_claims", """WITH c AS (SELECT o_custkey, o_orderkey, 1 + o_totalprice::BIGINT % 30 AS n FROM orders), f AS (SELECT *, sum(n) OVER (PARTITION BY o_custkey ORDER BY n, o_orderkey) AS upto FROM c) SELECT o_custkey, count(*) FILTER (upto <= 64) AS kept FROM f GROUP BY o_custkey""".replace("o_totalprice::BIGINT", "floor(o_totalprice)::BIGINT"))
def context_claims(spark, d):
    """Claims by rising size: the first that doesn't fit is followed by none that does."""
    o = table(spark, d, "orders")
    n = (1 + F.floor("o_totalprice") % 30).cast("int")
    claim = F.struct(n.alias("priority"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("id"), F.repeat(F.lit("w "), n).alias("text"))
    g = o.groupBy("o_custkey").agg(F.collect_list(claim).alias("claims"))
    return g.select("o_custkey", F.size(R.kept_claims(F.lit("base text"), F.col("claims"))["ids"]).cast("long").alias("kept"))


@query("context_compaction", "WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus, length(o_orderpriority) AS n FROM orders) SELECT o_custkey, o_orderkey, o_orderstatus <> 'F' OR o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) OR sum(n) OVER (PARTITION BY o_custkey) <= 100 AS keep FROM o")
def context_compaction(spark, d):
    o = table(spark, d, "orders").withColumn("s", F.when(F.col("o_orderstatus") == "F", "completed").otherwise("open"))
    return R.compacted(o, "o_custkey", "o_orderkey", "s", "o_orderpriority", 100).select("o_custkey", "o_orderkey", "keep")


@query("greedy_cover", """WITH RECURSIVE r AS (SELECT l_orderkey, l_partkey % 100 AS a, l_partkey % 100 + l_quantity::BIGINT AS b, l_linenumber::BIGINT AS id FROM lineitem),
t AS (SELECT l_orderkey, min(a) AS low, min(a) + 20 AS high FROM r GROUP BY l_orderkey),
g AS (SELECT l_orderkey, low AS at, []::BIGINT[] AS ids FROM t
  UNION ALL SELECT g.l_orderkey, max({'b': r.b, 'id': r.id}).b, any_value(g.ids) || [max({'b': r.b, 'id': r.id}).id] FROM g JOIN t ON t.l_orderkey = g.l_orderkey JOIN r ON r.l_orderkey = g.l_orderkey AND r.a <= g.at AND g.at < r.b WHERE g.at < t.high GROUP BY g.l_orderkey)
SELECT t.l_orderkey, CASE WHEN max(g.at) >= any_value(t.high) THEN list_sort(list_distinct(max_by(g.ids, g.at))) ELSE [] END AS ids FROM t JOIN g ON g.l_orderkey = t.l_orderkey GROUP BY t.l_orderkey""")
def greedy_cover(spark, d):
    r = F.struct((F.col("l_partkey") % 100).alias("start"), (F.col("l_partkey") % 100 + F.col("l_quantity").cast("long")).alias("end"), F.col("l_linenumber").cast("long").alias("id"))
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(r).alias("r"), F.min(F.col("l_partkey") % 100).alias("a"))
    return R.covered(g.withColumn("b", F.col("a") + 20), "l_orderkey", "a", "b", "r")


@query("date_headings", """WITH b AS (SELECT p_partkey // 20 AS page, p_partkey AS block, p_partkey % 2 = 0 AS head, CASE WHEN p_partkey % 2 = 0 THEN 0.0 ELSE 300.0 + p_size % 3 END::DOUBLE AS l, (p_partkey // 2) % 10 * 30.0::DOUBLE AS t FROM part),
p AS (SELECT d.page, d.block, h.block AS heading, d.l, round((least(d.t, h.t) + 12 - greatest(d.t, h.t)) / 12, 6) AS share, d.l - h.l - 100 AS gap FROM b d JOIN b h ON d.page = h.page AND NOT d.head AND h.head AND h.l + 100 <= d.l),
q AS (SELECT *, row_number() OVER (PARTITION BY page, block ORDER BY share DESC, gap, heading) AS n, count(*) OVER (PARTITION BY page, block, share, gap) AS tie FROM p WHERE share >= 0.6),
w AS (SELECT page, max(l + 100) - min(l) AS width FROM b GROUP BY page), s AS (SELECT * FROM q WHERE n = 1 AND tie = 1)
SELECT s.page, s.block, s.heading FROM s JOIN w ON w.page = s.page JOIN s o ON o.page = s.page AND abs(s.l - o.l) <= greatest(1.0, w.width * 0.05) GROUP BY ALL HAVING count(DISTINCT o.heading) >= 2""")
def date_headings(spark, d):
    p = table(spark, d, "part")
    kind = F.when(F.col("p_partkey") % 2 == 0, "heading").otherwise("date")
    y = F.floor(F.col("p_partkey") / 2) % 10 * 30.0
    x = F.when(F.col("p_partkey") % 2 == 0, 0.0).otherwise(300.0 + F.col("p_size") % 3)
    b = p.select(F.floor(F.col("p_partkey") / 20).alias("page"), F.col("p_partkey").alias("block"), kind.alias("kind"), x.alias("left"), y.alias("top"), (x + 100).alias("right"), (y + 12).alias("bottom"))
    return R.dates_beside_headings(b, "page", "block")


@query("budget_admission", """WITH RECURSIVE o AS (SELECT o_custkey AS build, o_orderkey AS "at", floor(o_totalprice)::BIGINT AS tokens, o_totalprice / 1000 AS cost, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
f AS (SELECT build, i, "at", tokens, cost, true AS admitted, 1 AS n, tokens AS t, cost AS c FROM o WHERE i = 1 AND tokens <= 1500000 AND cost <= 1200
  UNION ALL SELECT build, i, "at", tokens, cost, false, 0, 0, 0.0 FROM o WHERE i = 1 AND NOT (tokens <= 1500000 AND cost <= 1200)
  UNION ALL SELECT o.build, o.i, o."at", o.tokens, o.cost, f.n + 1 <= 8 AND f.t + o.tokens <= 1500000 AND f.c + o.cost <= 1200, f.n + (f.n + 1 <= 8 AND f.t + o.tokens <= 1500000 AND f.c + o.cost <= 1200)::INT,
    f.t + CASE WHEN f.n + 1 <= 8 AND f.t + o.tokens <= 1500000 AND f.c + o.cost <= 1200 THEN o.tokens ELSE 0 END, f.c + CASE WHEN f.n + 1 <= 8 AND f.t + o.tokens <= 1500000 AND f.c + o.cost <= 1200 THEN o.cost ELSE 0 END
  FROM f JOIN o ON o.build = f.build AND o.i = f.i + 1) SELECT build, "at", tokens, cost, admitted FROM f""")
def budget_admission(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("build"), F.col("o_orderkey").alias("at"), F.col("o_totalprice").cast("long").alias("tokens"), (F.col("o_totalprice") / 1000).alias("cost"))
    return R.admitted(o, "build", "at", 8, 1_500_000, 1200.0)


@query("locator_authorization", "SELECT l_orderkey, l_linenumber, EXISTS (SELECT 1 FROM (VALUES (0, 700), (900, 1500)) p(a, b) WHERE l_partkey >= a AND l_partkey + l_quantity <= b) AS authorized FROM lineitem")
def locator_authorization(spark, d):
    """A child's span lies within one of its parent's."""
    spans = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 700), (900, 1500))))
    ok = F.exists(spans, lambda s: (F.col("l_partkey") >= s["a"]) & (F.col("l_partkey") + F.col("l_quantity") <= s["b"]))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ok.alias("authorized"))


#: A sound container, with what each of the others has besides, or instead, and is found out for.
_CONTAINERS = (
    (None, None), ("../up.xml", "unsafe names"), ("XL/workbook.xml", "unsafe names"), ("", "a part is missing"), ("xl/dtd.xml", "declares entities"), ("xl/in.xlsx", "another kind of part"), ("xl/zeros.xml", "too large"),
    ("xl/open.xml", "broken markup"), ("xl/media/a.png", None), ("xl/media/b.png", "not the image it says"), ("xl/media/c.png", "nested container"), (None, "not a container"),
)


@F.pandas_udf(T.BinaryType())
def _boxed(key: pd.Series, text: pd.Series) -> pd.Series:
    """Each page's text as a container's strings, with the fault that its key says."""
    png = b"\x89PNG\r\n\x1a\n"
    faults = {"xl/dtd.xml": b'<!DOCTYPE a [<!ENTITY b "c">]><a/>', "xl/zeros.xml": b"0" * 20_000_000, "xl/open.xml": b"<a>", "xl/media/a.png": png + b"data", "xl/media/b.png": b"data", "xl/media/c.png": png + b"..PK\x03\x04"}

    def one(k: int, t: str) -> bytes:
        extra, _ = _CONTAINERS[k % len(_CONTAINERS)]
        if k % len(_CONTAINERS) == len(_CONTAINERS) - 1:
            return (t or "").encode()
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("[Content_Types].xml", "<Types/>")
            if extra != "":
                z.writestr("xl/workbook.xml", "<workbook/>")
            if extra != "xl/zeros.xml":
                z.writestr("xl/sharedStrings.xml", f"<sst><si><t>{html.escape(''.join(c for c in t or '' if c >= ' '))}</t></si></sst>")
            if extra:
                z.writestr(extra, faults.get(extra, b"<a/>"))
        return out.getvalue()

    return pd.Series([one(k, t) for k, t in zip(key, text, strict=True)])


@query("container_safety", "SELECT page_id, [" + ", ".join("NULL" if p is None else f"'{p}'" for _, p in _CONTAINERS) + f"][(page_id % {len(_CONTAINERS)} + 1)::INT] AS problem FROM pages")
def container_safety(spark, d):
    """Pages put in containers, most of them with one fault each, and pages that are none."""
    return table(spark, d, "pages").select("page_id", readers.container_check(_boxed("page_id", "html")).alias("problem"))


@query("text_blocks", "SELECT conv_id, turn, len(list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: trim(x)), lambda x: x <> '')) AS blocks FROM conversations")
def text_blocks(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(readers.text_blocks(F.col("text"))).cast("long").alias("blocks"))


@query("artifact_verify", "SELECT sha256(text) AS hash, md5(text) AS payload, false AS broken FROM documents WHERE text IS NOT NULL AND doc_id % 9 <> 4 GROUP BY text UNION SELECT sha256(text), md5(text || '!'), true FROM documents WHERE text IS NOT NULL AND doc_id % 9 = 4")
def artifact_verify(spark, d):
    """Texts stored under their hashes, once each, and read again; some changed behind their hash's back are found."""
    docs = table(spark, d, "documents").where("text is not null")
    stored = writers.artifacts(docs.where("doc_id % 9 <> 4").select("text"), fresh(spark, "artifacts"), "text")
    damaged = docs.where("doc_id % 9 = 4").select(F.sha2("text", 256).alias("hash"), F.concat("text", F.lit("!")).alias("text")).distinct()
    rows = stored.select("hash", "text").union(damaged)
    bad = writers.broken(rows, "text").select("hash", "text", F.lit(True).alias("broken"))
    return rows.join(bad, ["hash", "text"], "left").select("hash", F.md5("text").alias("payload"), F.coalesce("broken", F.lit(False)).alias("broken"))
