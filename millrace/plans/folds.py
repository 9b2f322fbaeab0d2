"""Ordered folds: budgets that are reserved and settled, outlines of documents, walks along references."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import outline as O
from millrace.operators import research as R
from millrace.operators.parts import spread
from millrace.plans.base import table

QUERIES, ORACLE = {}, {}


def query(name, sql):
    def add(f):
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return add


@query("budget_settlement", """WITH RECURSIVE li AS (SELECT l_partkey AS build, l_orderkey * 10 + l_linenumber AS id, sum(round(l_quantity * 100))::BIGINT AS tokens, sum(round(l_extendedprice * 100))::BIGINT AS cost, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY ALL),
e AS (SELECT build, id * 4 AS step, 'reserve' AS kind, id, tokens, cost FROM li
  UNION ALL SELECT build, (id + 5000) * 4 + 1, 'settle', id, tokens // 2, cost // 3 FROM li WHERE l_linenumber <> 3 UNION ALL SELECT build, (id + 9000) * 4 + 2, 'settle', id, tokens, cost FROM li WHERE l_linenumber = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY build ORDER BY step) AS i FROM e),
f AS (SELECT build, 0::BIGINT AS i, NULL::BIGINT AS step, NULL::VARCHAR AS outcome, 0 AS requests, 0::BIGINT AS rt, 0::BIGINT AS ct, 0::BIGINT AS rc, 0::BIGINT AS cc, []::STRUCT(id BIGINT, tokens BIGINT, cost BIGINT)[] AS open, []::BIGINT[] AS known FROM (SELECT DISTINCT build FROM e)
  UNION ALL
  SELECT build, i, step, outcome, requests + (outcome = 'reserved')::INT,
    rt + CASE outcome WHEN 'reserved' THEN tokens WHEN 'settled' THEN -h.tokens ELSE 0 END, ct + CASE outcome WHEN 'settled' THEN tokens ELSE 0 END,
    rc + CASE outcome WHEN 'reserved' THEN cost WHEN 'settled' THEN -h.cost ELSE 0 END, cc + CASE outcome WHEN 'settled' THEN cost ELSE 0 END,
    CASE outcome WHEN 'reserved' THEN list_append(open, {'id': id, 'tokens': tokens, 'cost': cost}) WHEN 'settled' THEN list_filter(open, lambda y: y.id <> u.id) ELSE open END,
    CASE outcome WHEN 'reserved' THEN list_append(known, id) ELSE known END
  FROM (SELECT f.build, o.i, o.step, f.requests, f.rt, f.ct, f.rc, f.cc, f.open, f.known, o.id, o.tokens, o.cost, list_filter(f.open, lambda y: y.id = o.id)[1] AS h,
      CASE WHEN o.kind = 'reserve' THEN CASE WHEN f.requests + 1 <= 25 AND f.rt + f.ct + o.tokens <= 30000 AND f.rc + f.cc + o.cost <= 30000000 THEN 'reserved' ELSE 'exhausted' END
        WHEN NOT list_contains(f.known, o.id) THEN 'unknown' WHEN len(list_filter(f.open, lambda y: y.id = o.id)) > 0 THEN 'settled' ELSE 'repeated' END AS outcome
    FROM f JOIN o ON o.build = f.build AND o.i = f.i + 1) u)
SELECT build, step, outcome, requests, rt AS reserved_tokens, ct AS consumed_tokens, rc AS reserved_cost, cc AS consumed_cost FROM f WHERE i > 0""")
def budget_settlement(spark, d):
    """Each part's line items reserve, settle at a lower use later, some twice, some never."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("build"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    whole = lambda c: F.sum(F.round(F.col(c) * 100)).cast("long")
    li = li.agg(whole("l_quantity").alias("tokens"), whole("l_extendedprice").alias("cost"), F.min("l_linenumber").alias("l_linenumber"))
    third, half = F.floor(F.col("cost") / 3), F.floor(F.col("tokens") / 2)
    event = lambda step, kind, tokens, cost: F.struct(step.alias("step"), F.lit(kind).alias("kind"), "id", tokens.alias("tokens"), cost.alias("cost"))
    reserve = event(F.col("id") * 4, "reserve", F.col("tokens"), F.col("cost"))
    settle = F.when(F.col("l_linenumber") != 3, event((F.col("id") + 5000) * 4 + 1, "settle", half, third))
    again = F.when(F.col("l_linenumber") == 1, event((F.col("id") + 9000) * 4 + 2, "settle", F.col("tokens"), F.col("cost")))
    events = li.select("build", F.explode(F.array_compact(F.array(reserve, settle, again))).alias("e")).select("build", "e.*")
    return R.metered(events, "build", "step", 25, 30_000, 30_000_000)


#: Customers' orders as the blocks of a document: urgent ones are headings of unequal levels, the others name two.
_BLOCKS = """b AS (SELECT o_custkey AS doc, o_orderkey AS block, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN (o_orderkey % 5)::INT END AS level,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Part ' || o_orderkey % 8 ELSE 'as agreed, see Part ' || floor(o_totalprice)::BIGINT % 8 || ', or 见  Part ' || floor(o_totalprice / 10)::BIGINT % 8 || '; Part 3 too' END AS text FROM orders)"""


def _blocks(spark, d):
    head = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    names = F.concat(F.lit("as agreed, see Part "), (F.floor("o_totalprice") % 8).cast("string"), F.lit(", or 见  Part "), (F.floor(F.col("o_totalprice") / 10) % 8).cast("string"), F.lit("; Part 3 too"))
    text = F.when(head, F.concat(F.lit("Part "), (F.col("o_orderkey") % 8).cast("string"))).otherwise(names)
    return table(spark, d, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("block"), F.when(head, (F.col("o_orderkey") % 5).cast("int")).alias("level"), text.alias("text"))


@query("heading_outline", f"""WITH RECURSIVE {_BLOCKS}, h AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY block) AS i FROM b WHERE level IS NOT NULL),
f AS (SELECT doc, 0::BIGINT AS i, NULL::BIGINT AS block, 0 AS level, []::VARCHAR[] AS path FROM (SELECT DISTINCT doc FROM h)
  UNION ALL SELECT f.doc, h.i, h.block, least(CASE WHEN h.level > 0 THEN h.level ELSE f.level + 1 END, f.level + 1), list_append(f.path[1:least(CASE WHEN h.level > 0 THEN h.level ELSE f.level + 1 END, f.level + 1) - 1], h.text) FROM f JOIN h ON h.doc = f.doc AND h.i = f.i + 1)
SELECT a.doc, a.block, a.level, array_to_string(a.path, ' > ') AS path, (SELECT min(z.block) FROM f z WHERE z.doc = a.doc AND z.i > a.i AND z.level <= a.level) AS "end" FROM f a WHERE a.i > 0""")
def heading_outline(spark, d):
    """Repaired levels, paths and ends of sections."""
    return O.outlined(_blocks(spark, d), "doc", "block", "level", "text").withColumn("path", F.array_join("path", " > "))


_EDGES = f"""{_BLOCKS}, t AS (SELECT doc, text, min(block) AS dst FROM b WHERE level IS NOT NULL GROUP BY doc, text HAVING count(*) = 1),
r AS (SELECT DISTINCT b.doc, b.block AS src, t.dst FROM b JOIN t ON b.doc = t.doc AND (contains(b.text, 'see ' || t.text) OR contains(b.text, '见  ' || t.text))),
s AS (SELECT a.doc, a.block AS start, min(z.block) AS stop FROM b a LEFT JOIN b z ON z.doc = a.doc AND z.block > a.block AND z.level <= a.level WHERE a.level IS NOT NULL GROUP BY a.doc, a.block),
e AS (SELECT DISTINCT r.doc, r.src, b.block AS dst FROM r JOIN s ON s.doc = r.doc AND s.start = r.dst JOIN b ON b.doc = r.doc AND b.block >= s.start AND (s.stop IS NULL OR b.block < s.stop))"""


def _edges(b):
    refs = O.references(b, "doc", "block", "text", F.col("level").isNotNull())
    return O.section_edges(refs, O.outlined(b, "doc", "block", "level", "text", repair=False, paths=False), b, "doc", "block")


@query("block_references", f"WITH {_EDGES} SELECT doc, src, dst FROM e")
def block_references(spark, d):
    """From each block to those of the sections it names."""
    return _edges(spread(_blocks(spark, d), "doc"))


@query("reference_walk", f"""WITH {_EDGES}, s0 AS (SELECT doc, block AS root, block AS node, 0 AS hop FROM b),
u1 AS (SELECT doc, root, node, min(hop) AS hop FROM (SELECT * FROM s0 UNION ALL SELECT s0.doc, root, dst, 1 FROM s0 JOIN e ON e.doc = s0.doc AND e.src = node) GROUP BY ALL),
s1 AS (SELECT * FROM u1 QUALIFY row_number() OVER (PARTITION BY doc, root ORDER BY hop, node) <= 3),
u2 AS (SELECT doc, root, node, min(hop) AS hop FROM (SELECT * FROM s1 UNION ALL SELECT s1.doc, root, dst, 2 FROM s1 JOIN e ON e.doc = s1.doc AND e.src = node WHERE hop = 1) GROUP BY ALL)
SELECT * FROM u2 QUALIFY row_number() OVER (PARTITION BY doc, root ORDER BY hop, node) <= 3""")
def reference_walk(spark, d):
    """Two steps along references, three blocks of a root at most (documents are short here)."""
    b = spread(_blocks(spark, d), "doc")
    return O.walked(_edges(b), b.select("doc", F.col("block").alias("root")), "doc", "root", 2, 3)
