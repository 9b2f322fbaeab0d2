"""Queries over decision tables, plans of work, spans, manifests and merged candidates."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators import decisions as D
from millrace.operators import evidence
from millrace.plans.base import table
from millrace.sources.tables import fresh

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


_ASKED = """a AS (SELECT event_id, event_id % 2 = 0 AS own, event_id % 3 = 0 AS live, event_id % 5 = 0 AS look, event_id % 11 = 0 AS unknown, user_id % 7 = 0 AS unclear, user_id % 2 = 0 AS steps, user_id % 3 = 0 AS lookups,
  event_type IN ('error', 'signup') AS needs, value > 20 AS maps, value < 150 AS kb FROM events)"""


def _asked(spark, d):
    some = lambda **k: F.filter(F.array(*(F.when(v, n) for n, v in k.items())), lambda x: x.isNotNull())
    i, u = F.col("event_id"), F.col("user_id")
    sources = some(knowledge_base=i % 2 == 0, external_realtime=i % 3 == 0, external_lookup=i % 5 == 0, unknown=i % 11 == 0)
    return table(spark, d, "events").withColumn("sources", sources).withColumn("needed", some(maps=F.col("event_type").isin("error", "signup"))).withColumn("tools", some(maps=F.col("value") > 20)).select(
        "event_id", "user_id", "event_type", "sources", "needed", "tools", (u % 7 == 0).alias("unclear"), (u % 2 == 0).alias("steps"), (u % 3 == 0).alias("lookups"), (F.col("value") < 150).alias("kb"))


@query("route_decisions", f"""WITH {_ASKED}, r AS (SELECT *, CASE WHEN unclear OR unknown THEN 'clarification_required'
  WHEN (live OR look) AND needs AND maps THEN CASE WHEN own AND NOT kb THEN 'retrieval_unavailable' ELSE 'available_tool_capabilities' END
  WHEN (live OR look) AND own THEN 'clarification_required' WHEN live OR look THEN 'capability_unavailable'
  WHEN own AND NOT kb THEN 'retrieval_unavailable' WHEN own AND lookups THEN 'knowledge_base_research' WHEN own THEN 'knowledge_base_lookup' ELSE 'general_conversation' END AS reason FROM a)
SELECT event_id, CASE reason WHEN 'available_tool_capabilities' THEN CASE WHEN own OR steps THEN 'research' ELSE 'fast_rag' END WHEN 'knowledge_base_research' THEN 'research' WHEN 'knowledge_base_lookup' THEN 'fast_rag' ELSE 'chat' END AS route,
  CASE reason WHEN 'clarification_required' THEN 'clarify' WHEN 'capability_unavailable' THEN 'capability_unavailable' WHEN 'retrieval_unavailable' THEN 'technical_error' WHEN 'general_conversation' THEN 'conversation' END AS mode,
  CASE WHEN reason = 'clarification_required' THEN 'clarify' WHEN reason IN ('capability_unavailable', 'retrieval_unavailable') THEN 'cannot_answer' END AS ends, reason FROM r""")
def route_decisions(spark, d):
    c = F.col
    r = D.routed(c("sources"), c("needed"), c("unclear"), c("steps"), c("lookups"), c("tools"), c("kb"))
    return _asked(spark, d).select("event_id", r.alias("r")).select("event_id", "r.*")


_GAPS = ["external_realtime_required", "external_lookup_required", "query_ambiguous", "missing_facts", None]


@query("grade_decisions", f"""WITH {_ASKED}, g AS (SELECT a.*, ['refuse', 'sufficient', 'clarify', 'retry'][CASE WHEN event_id % 4 = 3 THEN 4 ELSE event_id // 4 % 4 + 1 END] AS decision,
  ['external_realtime_required', 'external_lookup_required', 'query_ambiguous', 'missing_facts', NULL][e.user_id % 5 + 1] AS gap, e.user_id % 3 AS rounds FROM a JOIN events e USING (event_id)),
r AS (SELECT *, CASE WHEN decision = 'refuse' THEN 'refuse' WHEN decision = 'sufficient' THEN 'sufficient' WHEN decision = 'clarify' OR gap = 'query_ambiguous' THEN 'clarification_required'
  WHEN gap LIKE 'external%' AND maps AND rounds < 2 THEN 'discover_missing_capability'
  WHEN gap LIKE 'external%' AND own AND (gap = 'external_realtime_required' AND live OR gap = 'external_lookup_required' AND look) THEN 'clarification_required' WHEN gap LIKE 'external%' THEN 'capability_unavailable'
  WHEN NOT kb THEN 'retrieval_unavailable' WHEN rounds >= 2 THEN 'research_round_limit' ELSE coalesce(gap, 'unknown') END AS reason FROM g)
SELECT event_id, CASE WHEN reason IN ('refuse', 'research_round_limit') THEN 'end' WHEN reason = 'sufficient' THEN 'generate' WHEN reason IN ('clarification_required', 'capability_unavailable', 'retrieval_unavailable') THEN 'chat' ELSE 'research_agent' END AS next, reason FROM r""")
def grade_decisions(spark, d):
    i, c = F.col("event_id"), F.col
    decision = F.element_at(F.array(*map(F.lit, ("refuse", "sufficient", "clarify", "retry"))), F.when(i % 4 == 3, 4).otherwise(F.floor(i / 4) % 4 + 1).cast("int"))
    gap = F.element_at(F.array(*(F.lit(g).cast("string") for g in _GAPS)), (c("user_id") % 5 + 1).cast("int"))
    rows = _asked(spark, d).withColumn("decision", decision).withColumn("gap", gap)
    r = D.graded(c("decision"), c("gap"), c("sources"), c("tools"), c("kb"), c("user_id") % 3, 2)
    return rows.select("event_id", r.alias("r")).select("event_id", "r.*")


_TODO_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax"


def _kept(spark, rows, name):
    """Rows as a table of the shared folder: numbered, shuffled and sorted once, however often they are read."""
    path = fresh(spark, name)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


@query("plan_problems", f"""WITH RECURSIVE t AS (SELECT l_orderkey AS run, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_TODO_ORDER}) AS id, count(*) OVER (PARTITION BY l_orderkey) AS n, l_partkey, l_quantity FROM lineitem),
u AS (SELECT run, CASE WHEN l_partkey % 41 = 0 THEN 1 ELSE id END AS id, CASE WHEN l_quantity > 48 THEN 3 ELSE 1 END AS attempts FROM t),
e AS (SELECT run, id, CASE WHEN l_partkey % 50 = 1 THEN 99 WHEN l_partkey % 4 = 1 THEN id % n + 1 ELSE greatest(id - 1, 1) END AS blocker FROM t WHERE l_partkey % 4 <> 0 AND NOT (id = 1 AND l_partkey % 4 <> 1)),
w AS (SELECT run, blocker AS node, 1 AS h FROM e UNION SELECT w.run, e.blocker, h + 1 FROM w JOIN e ON e.run = w.run AND e.id = w.node WHERE h < 13), f AS (SELECT run, max(h) AS far FROM w GROUP BY run),
s AS (SELECT run, count(*) AS n, count(DISTINCT id) AS ids, max(attempts) AS high FROM u GROUP BY run), l AS (SELECT DISTINCT run FROM e WHERE (run, blocker) NOT IN (SELECT (run, id) FROM u))
SELECT s.run, CASE WHEN n > 12 THEN 'too many todos' WHEN high > 2 THEN 'too many attempts' WHEN ids < n THEN 'repeated todo' WHEN l.run IS NOT NULL THEN 'unknown dependency' WHEN far > 12 THEN 'cycle' WHEN far > 3 THEN 'path too long' END AS problem
FROM s LEFT JOIN f ON f.run = s.run LEFT JOIN l ON l.run = s.run""")
def plan_problems(spark, d):
    """Lines of an order as its todos: chains, rings, repeated and unknown ones among them."""
    w = W.partitionBy("l_orderkey")
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"), F.row_number().over(w.orderBy(*_TODO_ORDER.split(", "))).cast("long").alias("id"), F.count(F.lit(1)).over(w).alias("n"), "l_partkey", "l_quantity")
    t = _kept(spark, t, "todos")
    p = F.col("l_partkey")
    todos = t.select("run", F.when(p % 41 == 0, 1).otherwise(F.col("id")).alias("id"), F.when(F.col("l_quantity") > 48, 3).otherwise(1).alias("attempts"))
    blocker = F.when(p % 50 == 1, 99).when(p % 4 == 1, F.col("id") % F.col("n") + 1).otherwise(F.greatest(F.col("id") - 1, F.lit(1)))
    edges = t.where((p % 4 != 0) & ~((F.col("id") == 1) & (p % 4 != 1))).select("run", "id", blocker.alias("blocker"))
    return D.plan_problems(todos, edges)


@query("span_levels", f"""WITH s AS (SELECT l_orderkey AS trace, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_TODO_ORDER}) AS id, epoch(l_shipdate)::BIGINT AS a, epoch(l_shipdate)::BIGINT + l_quantity::BIGINT AS b, l_partkey, CASE l_returnflag WHEN 'R' THEN 'error' WHEN 'A' THEN 'cancelled' ELSE 'ok' END AS status FROM lineitem),
p AS (SELECT trace, id, CASE WHEN l_partkey % 9 = 0 THEN 77 ELSE id // 2 END AS parent, a, b, status FROM s),
t AS (SELECT trace, id, CASE WHEN (trace, parent) IN (SELECT (trace, id) FROM p) THEN parent ELSE 0 END AS parent, b - a AS seconds, status FROM p
  UNION ALL SELECT trace, 0, NULL, max(b) - min(a), CASE WHEN bool_or(status = 'error') THEN 'error' WHEN bool_or(status = 'cancelled') THEN 'cancelled' ELSE 'ok' END FROM p GROUP BY trace),
k AS (SELECT trace, parent, count(*) AS n, sum(seconds)::BIGINT AS s FROM t WHERE parent IS NOT NULL GROUP BY ALL)
SELECT t.trace, t.id, t.parent, t.status, t.seconds, coalesce(n, 0) AS children, coalesce(s, 0) AS child_seconds FROM t LEFT JOIN k ON k.trace = t.trace AND k.parent = t.id""")
def span_levels(spark, d):
    n = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*_TODO_ORDER.split(", "))).cast("long")
    start = F.col("l_shipdate").cast("timestamp").cast("long")
    status = F.when(F.col("l_returnflag") == "R", "error").when(F.col("l_returnflag") == "A", "cancelled").otherwise("ok")
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("trace"), n.alias("id"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"), status.alias("status"), "l_partkey")
    parent = F.when(F.col("l_partkey") % 9 == 0, 77).otherwise(F.floor(F.col("id") / 2)).cast("long")
    return D.span_levels(_kept(spark, s.withColumn("parent", parent).drop("l_partkey"), "spans"))


@query("manifest_problems", "SELECT o_orderkey AS version_id, CASE WHEN o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) THEN 'nothing staged' ELSE [NULL, 'artifact differs', 'rebuilt differs', 'out of scope', 'counts differ', NULL, NULL][o_orderkey % 7 + 1] END AS problem FROM orders")
def manifest_problems(spark, d):
    """Manifests of what is staged, some of them damaged."""
    li = table(spark, d, "lineitem")
    staged = li.select(F.col("l_orderkey").alias("version_id"), F.col("l_partkey").alias("parent_id"), F.col("l_linenumber").alias("child_id"), F.md5(F.concat_ws("|", "l_partkey", "l_suppkey", "l_extendedprice")).alias("hash"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("child_id", "hash"))), lambda x: F.concat_ws(":", x["child_id"].cast("string"), x["hash"]))
    g = staged.groupBy("version_id").agg(F.count_distinct("parent_id").alias("parents"), F.count(F.lit(1)).alias("children"), F.sha2(F.array_join(lines, ","), 256).alias("sha"))
    kind = F.col("version_id") % 7
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("version_id"), F.col("o_custkey").alias("user_id")).join(g, "version_id", "left")
    m = o.select("version_id", "user_id", F.concat(F.lit("store://"), (F.col("user_id") + F.when(kind == 3, 1).otherwise(0)).cast("string"), F.lit("/manifest")).alias("uri"), "parents",
                 (F.col("children") + F.when(kind == 4, 1).otherwise(0)).alias("children"), F.when(kind == 2, "0").otherwise(F.col("sha")).alias("digest"), F.when(kind.isin(1, 2), F.lit("0")).otherwise(F.col("sha")).alias("artifact"))
    return D.manifest_problems(m, staged)


@query("derivations", """SELECT l_orderkey, round(CASE l_orderkey % 4 WHEN 0 THEN sum(l_quantity) - sum(l_linenumber) WHEN 1 THEN sum(l_quantity) + sum(l_tax) - sum(l_discount) WHEN 2 THEN (1 - sum(l_tax) / sum(l_quantity)) * 100 END, 6) AS value,
  coalesce(abs(CASE l_orderkey % 4 WHEN 0 THEN sum(l_quantity) - sum(l_linenumber) WHEN 1 THEN sum(l_quantity) + sum(l_tax) - sum(l_discount) WHEN 2 THEN (1 - sum(l_tax) / sum(l_quantity)) * 100 END - 99.5) <= 20.005, false) AS holds FROM lineitem GROUP BY l_orderkey""")
def derivations(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("difference", "balance", "reduction", "other"))), (F.col("l_orderkey") % 4 + 1).cast("int"))
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_linenumber").alias("a"), F.sum("l_quantity").alias("b"), F.sum("l_tax").alias("c"), F.sum("l_discount").alias("e"))
    value = D.derived(kind, F.col("a"), F.col("b"), F.col("c"), F.col("e"))
    return g.select("l_orderkey", F.round(value, 6).alias("value"), D.derivation_holds(F.lit(99.5), value, F.lit(20.005)).alias("holds"))


@query("candidate_merge", """WITH c AS (SELECT l_partkey AS parent_id, l_suppkey % 4 AS version_id, CASE WHEN l_discount > 0.09 THEN 1 ELSE 0 END AS document_id, [l_linenumber, l_linenumber + 1] AS kids, CASE WHEN l_tax > 0.07 THEN 1 ELSE 0 END AS mark, [l_returnflag, l_linestatus] AS aims,
  row_number() OVER (PARTITION BY l_partkey, l_suppkey % 4 ORDER BY round(l_discount * 10 - l_tax, 4) DESC, l_linenumber, l_orderkey, l_suppkey, l_tax, l_returnflag, l_linestatus) AS rn FROM lineitem),
k AS (SELECT parent_id, version_id, rn * 2 + i AS pos, kids[i] AS child, kids[i] * 10 + mark AS identity FROM c, (VALUES (1), (2)) v(i)), kf AS (SELECT parent_id, version_id, child, min(pos) AS pos, count(DISTINCT identity) AS ids FROM k GROUP BY ALL),
ks AS (SELECT parent_id, version_id, string_agg(child::VARCHAR, ',' ORDER BY pos) AS children, max(ids) AS ids FROM kf GROUP BY ALL),
a AS (SELECT parent_id, version_id, rn * 2 + i AS pos, aims[i] AS aim FROM c, (VALUES (1), (2)) v(i)), af AS (SELECT parent_id, version_id, aim, min(pos) AS pos FROM a GROUP BY ALL), ax AS (SELECT parent_id, version_id, string_agg(aim, ',' ORDER BY pos) AS targets FROM af GROUP BY ALL),
g AS (SELECT parent_id, version_id, min_by(document_id, rn) AS document_id, count(DISTINCT document_id) AS docs FROM c GROUP BY ALL)
SELECT parent_id, version_id, document_id, children, targets, docs > 1 OR ids > 1 AS conflict FROM g JOIN ks USING (parent_id, version_id) JOIN ax USING (parent_id, version_id)""")
def candidate_merge(spark, d):
    """Candidates of one parent and version become one, with all children and targets; conflicts are marked."""
    li, no = table(spark, d, "lineitem"), F.col("l_linenumber")
    mark = F.when(F.col("l_tax") > 0.07, 1).otherwise(0)
    kid = lambda x: F.struct(x.alias("child_id"), (x * 10 + mark).alias("identity"))
    c = li.withColumn("parent_id", F.col("l_partkey")).withColumn("version_id", F.col("l_suppkey") % 4).withColumn("document_id", F.when(F.col("l_discount") > 0.09, 1).otherwise(0))
    c = c.withColumn("children", F.array(kid(no), kid(no + 1))).withColumn("targets", F.array("l_returnflag", "l_linestatus"))
    order = [-F.round(F.col("l_discount") * 10 - F.col("l_tax"), 4), no, *map(F.col, ("l_orderkey", "l_suppkey", "l_tax", "l_returnflag", "l_linestatus"))]
    out = evidence.merged(c, ["parent_id", "version_id"], order, ["document_id"], "children", "targets")
    return out.select("parent_id", "version_id", "document_id", F.array_join(F.col("children").cast("array<string>"), ",").alias("children"), F.array_join("targets", ",").alias("targets"), "conflict")
