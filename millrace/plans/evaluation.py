"""Evaluation: ranking metrics, reports, costs, agents, routing, review."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators import metrics as M
from millrace.operators.spans import containing
from millrace.plans.base import table

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


_RANK = "hits AS (SELECT o_custkey AS q, o_orderkey % 97 AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders), rel AS (SELECT DISTINCT o_custkey AS q, o_orderkey % 97 AS item FROM orders WHERE o_orderstatus = 'F')"


def _ranked(spark, d):
    o = table(spark, d, "orders")
    r = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    hits = o.select(F.col("o_custkey").alias("q"), (F.col("o_orderkey") % 97).alias("item"), r.alias("r"))
    rel = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("q"), (F.col("o_orderkey") % 97).alias("item")).distinct()
    return hits, rel


@query("ranking_metrics", f"""WITH {_RANK}, f AS (SELECT q, item, min(r) AS r FROM hits GROUP BY ALL), m AS (SELECT f.q, f.r FROM f JOIN rel ON rel.q = f.q AND rel.item = f.item), a AS (SELECT q, count(*) AS n FROM rel GROUP BY q)
SELECT a.q, round(coalesce(count(m.r) FILTER (m.r <= 6) / a.n, 0), 6) AS recall, round(coalesce(1.0 / min(m.r), 0), 6) AS rr,
round(coalesce(sum(1 / log2(m.r + 1)) FILTER (m.r <= 6), 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 7) t(i) WHERE i <= a.n), 6) AS ndcg FROM a LEFT JOIN m ON a.q = m.q GROUP BY a.q, a.n""")
def ranking_metrics(spark, d):
    hits, rel = _ranked(spark, d)
    return M.ranking(hits, rel, "q", "item", "r", 6)


_GRADES = "SELECT o_custkey AS q, o_orderkey % 97 AS item, max(CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 1 ELSE 0 END) AS grade FROM orders WHERE o_orderkey % 11 <> 0 GROUP BY ALL"


@query("graded_ndcg", f"""WITH {_RANK}, gr AS ({_GRADES}), t AS (SELECT h.q, h.r, g.grade FROM hits h LEFT JOIN gr g ON g.q = h.q AND g.item = h.item WHERE h.r <= 5),
i AS (SELECT q, sum((pow(2, grade) - 1) / log2(n + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY grade DESC, item) AS n FROM gr) WHERE n <= 5 GROUP BY q)
SELECT t.q, CASE WHEN count(*) = count(grade) THEN round(sum((pow(2, grade) - 1) / log2(r + 1)) / nullif(any_value(ideal), 0), 6) END AS ndcg FROM t LEFT JOIN i ON t.q = i.q GROUP BY t.q""")
def graded_ndcg(spark, d):
    hits, _ = _ranked(spark, d)
    p = F.col("o_orderpriority")
    grade = F.max(F.when(p == "1-URGENT", 3).when(p == "2-HIGH", 2).when(p == "3-MEDIUM", 1).otherwise(0)).alias("grade")
    grades = table(spark, d, "orders").where("o_orderkey % 11 <> 0").groupBy(F.col("o_custkey").alias("q"), (F.col("o_orderkey") % 97).alias("item")).agg(grade)
    return M.graded_ndcg(hits, grades, "q", "item", "r", 5)


_SETS = "sets AS (SELECT o_custkey AS q, o_orderstatus AS fact, o_orderkey % 3 AS set_id, CASE WHEN o_custkey % 50 = 0 THEN NULL ELSE o_orderkey % 97 END AS item FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))"


@query("fact_coverage", f"""WITH {_RANK}, {_SETS}, f AS (SELECT q, item, min(r) AS r FROM hits GROUP BY ALL),
s AS (SELECT sets.q, fact, set_id, max(f.r) AS last, count(*) FILTER (f.r IS NULL AND sets.item IS NOT NULL) AS lost, count(*) FILTER (sets.item IS NULL) AS un FROM sets LEFT JOIN f ON f.q = sets.q AND f.item = sets.item GROUP BY ALL),
t AS (SELECT q, fact, min(CASE WHEN lost = 0 AND un = 0 THEN last END) AS pos, max(un) AS un FROM s GROUP BY ALL)
SELECT q, CASE WHEN max(un) = 0 THEN round(avg(coalesce((pos <= 6)::INT, 0)), 6) END AS fact_recall, CASE WHEN max(un) = 0 THEN min(coalesce((pos <= 6)::INT, 0))::DOUBLE END AS complete, CASE WHEN max(un) = 0 THEN round(coalesce(1.0 / min(pos), 0), 6) END AS rr FROM t GROUP BY q""")
def fact_coverage(spark, d):
    hits, _ = _ranked(spark, d)
    o = table(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    sets = o.select(F.col("o_custkey").alias("q"), F.col("o_orderstatus").alias("fact"), (F.col("o_orderkey") % 3).alias("set_id"), F.when(F.col("o_custkey") % 50 != 0, F.col("o_orderkey") % 97).alias("item"))
    return M.fact_coverage(hits, sets, "q", "item", "r", 6)


@query("context_score", "SELECT d.doc_id, count(*) AS anchors FROM documents d JOIN benchmark b ON contains(d.text, b.text) GROUP BY d.doc_id")
def context_score(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("anchor"))
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("context"))
    return containing(docs, "doc_id", "context", b, "item_id", "anchor").groupBy("doc_id").agg(F.count(F.lit(1)).alias("anchors"))


@query("round_gain", f"""WITH {_RANK}, c AS (SELECT h.q, (h.r - 1) // 4 AS stage, h.item FROM hits h JOIN rel ON rel.q = h.q AND rel.item = h.item), f AS (SELECT q, item, min(stage) AS stage FROM c GROUP BY ALL)
SELECT q, stage, count(*) AS new_facts, sum(count(*)) OVER (PARTITION BY q ORDER BY stage)::BIGINT AS known FROM f GROUP BY q, stage""")
def round_gain(spark, d):
    hits, rel = _ranked(spark, d)
    first = hits.join(rel, ["q", "item"]).withColumn("stage", F.floor((F.col("r") - 1) / 4)).groupBy("q", "item").agg(F.min("stage").alias("stage"))
    n = first.groupBy("q", "stage").agg(F.count(F.lit(1)).alias("new_facts"))
    return n.withColumn("known", F.sum("new_facts").over(W.partitionBy("q").orderBy("stage").rowsBetween(W.unboundedPreceding, 0)))


@query("source_metrics", f"WITH {_RANK}, t AS (SELECT q, min(item) AS item FROM rel GROUP BY q) SELECT t.q, coalesce(1.0 / min(h.r), 0) AS rr, (coalesce(min(h.r), 99) <= 3)::INT AS hit FROM t LEFT JOIN hits h ON h.q = t.q AND h.item = t.item GROUP BY t.q")
def source_metrics(spark, d):
    hits, rel = _ranked(spark, d)
    target = rel.groupBy("q").agg(F.min("item").alias("item"))
    at = F.min("r")
    return target.join(hits, ["q", "item"], "left").groupBy("q").agg(F.coalesce(F.lit(1.0) / at, F.lit(0.0)).alias("rr"), (F.coalesce(at, F.lit(99)) <= 3).cast("int").alias("hit"))


_SCORE = "CASE WHEN l_returnflag <> 'A' THEN l_discount * 10 END"


def _scores(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("*", F.when(F.col("l_returnflag") != "A", F.col("l_discount") * 10).alias("score"))


@query("mean_with_coverage", f"SELECT l_linenumber, round(avg({_SCORE}), 6) AS mean, count({_SCORE}) AS evaluated, count(*) AS total, round(count({_SCORE}) / count(*), 6) AS coverage, count(*) - count({_SCORE}) AS missing FROM lineitem GROUP BY l_linenumber")
def mean_with_coverage(spark, d):
    out = _scores(spark, d).groupBy("l_linenumber").agg(*M.with_coverage(F.col("score")))
    return out.withColumn("mean", F.round("mean", 6)).withColumn("coverage", F.round("coverage", 6))


@query("null_aware_bounds", "WITH s AS (SELECT l_suppkey, CASE WHEN l_returnflag <> 'A' THEN l_discount * 10 END AS v FROM lineitem) SELECT l_suppkey, round(avg(v), 6) AS mean, count(v) AS n, count(*) AS denominator, round(coalesce(sum(v), 0) / count(*), 6) AS lower, round((coalesce(sum(v), 0) + count(*) - count(v)) / count(*), 6) AS upper FROM s GROUP BY l_suppkey")
def null_aware_bounds(spark, d):
    out = _scores(spark, d).groupBy("l_suppkey").agg(*M.bounds(F.col("score")))
    return out.select("l_suppkey", *(F.round(c, 6).alias(c) if c in ("mean", "lower", "upper") else c for c in out.columns[1:]))


@query("grouping_by_dimension", """WITH o AS (SELECT o_orderstatus, o_orderpriority, o_totalprice FROM orders)
SELECT 'o_orderstatus' AS dimension, o_orderstatus AS value, round(avg(o_totalprice), 4) AS mean, count(*) AS n FROM o GROUP BY ALL UNION ALL SELECT 'o_orderpriority', o_orderpriority, round(avg(o_totalprice), 4), count(*) FROM o GROUP BY ALL""")
def grouping_by_dimension(spark, d):
    return M.by_each(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], F.round(F.avg("o_totalprice"), 4).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("macro_average", "WITH g AS (SELECT n_regionkey, n_nationkey, avg(c_acctbal) AS m FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) SELECT n_regionkey, round(avg(m), 6) AS macro, count(*) AS groups FROM g GROUP BY n_regionkey")
def macro_average(spark, d):
    g = table(spark, d, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("m"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    return g.join(n, "c_nationkey").groupBy("n_regionkey").agg(F.round(F.avg("m"), 6).alias("macro"), F.count(F.lit(1)).alias("groups"))


@query("nearest_rank_percentiles", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def nearest_rank_percentiles(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(M.nearest_rank("value", 0.5).alias("p50"), M.nearest_rank("value", 0.95).alias("p95"))


@query("bootstrap_interval")
def bootstrap_interval(spark, d):
    return M.bootstrap(table(spark, d, "events"), "user_id", "event_id", "value")


@query("worst_case_gate", "SELECT l_suppkey, CASE WHEN bool_or(l_returnflag = 'R') THEN 0.0 ELSE min(l_discount) END AS coverage FROM lineitem GROUP BY l_suppkey")
def worst_case_gate(spark, d):
    """The least coverage; any row that wasn't audited makes it 0."""
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.when(F.max(F.col("l_returnflag") == "R"), 0.0).otherwise(F.min("l_discount")).alias("coverage"))


@query("poisoned_sum", "SELECT l_partkey, CASE WHEN count_if(l_quantity > 49) > 0 THEN 1 ELSE sum(l_quantity::BIGINT) END::BIGINT AS total FROM lineitem GROUP BY l_partkey")
def poisoned_sum(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.when(F.count_if(F.col("l_quantity") > 49) > 0, 1).otherwise(F.sum(F.col("l_quantity").cast("long"))).alias("total"))


@query("sparse_map_averages", "WITH m AS (SELECT unnest([{'k': 'price', 'v': l_extendedprice}, {'k': CASE WHEN l_tax > 0.03 THEN 'tax' END, 'v': l_tax}]) AS x FROM lineitem) SELECT x.k AS metric, round(avg(x.v), 6) AS mean, count(*) AS n FROM m WHERE x.k IS NOT NULL GROUP BY ALL")
def sparse_map_averages(spark, d):
    m = F.map_concat(F.create_map(F.lit("price"), F.col("l_extendedprice")), F.when(F.col("l_tax") > 0.03, F.create_map(F.lit("tax"), F.col("l_tax"))).otherwise(F.create_map().cast("map<string,double>")))
    return table(spark, d, "lineitem").select(F.explode(m).alias("metric", "v")).groupBy("metric").agg(F.round(F.avg("v"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("status_fold", """SELECT o_custkey, CASE WHEN bool_and(o_orderstatus = 'F') THEN 'available' WHEN bool_and(o_orderstatus = 'O') THEN 'unavailable' WHEN bool_and(o_orderstatus = 'P') THEN 'failed' ELSE 'partial' END AS status FROM orders GROUP BY o_custkey""")
def status_fold(spark, d):
    all_ = lambda s: F.min(F.col("o_orderstatus") == s)
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.when(all_("F"), "available").when(all_("O"), "unavailable").when(all_("P"), "failed").otherwise("partial").alias("status"))


@query("token_pricing", """WITH t AS (SELECT p_partkey, (p_retailprice / 100)::DECIMAL(18,6) AS rate, p_brand FROM part WHERE p_size > 5), u AS (SELECT l_suppkey, l_quantity::DECIMAL(18,6) AS tokens, rate FROM lineitem LEFT JOIN t ON l_partkey = p_partkey)
SELECT l_suppkey, CASE WHEN count(*) = count(rate) THEN round(sum(tokens * rate)::DOUBLE / 1000000, 9) END AS value, round(coalesce(sum(tokens * rate), 0)::DOUBLE / 1000000, 9) AS subtotal, count(*) - count(rate) AS unknown FROM u GROUP BY l_suppkey""")
def token_pricing(spark, d):
    """Cost by tariff; one unknown price makes the value unknown, the subtotal stays."""
    tariff = table(spark, d, "part").where("p_size > 5").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_retailprice") / 100).cast("decimal(18,6)").alias("rate"))
    u = table(spark, d, "lineitem").join(tariff, "l_partkey", "left").withColumn("cost", F.col("l_quantity").cast("decimal(18,6)") * F.col("rate"))
    total = F.round(F.coalesce(F.sum("cost"), F.lit(0)).cast("double") / 1e6, 9)
    return u.groupBy("l_suppkey").agg(F.when(F.count(F.lit(1)) == F.count("rate"), total).alias("value"), total.alias("subtotal"), (F.count(F.lit(1)) - F.count("rate")).alias("unknown"))


@query("routing_scorecard", """WITH c AS (SELECT l_linenumber AS grp, l_returnflag <> 'R' AS needs, l_linestatus = 'F' AS did FROM lineitem), m AS (SELECT grp, count(*) AS n, avg((needs = did)::INT) AS accuracy, count_if(did AND NOT needs) / nullif(count_if(NOT needs), 0) AS false_rate, count_if(needs AND NOT did) / nullif(count_if(needs), 0) AS missed_rate FROM c GROUP BY grp)
SELECT grp, n, round(accuracy, 6) AS accuracy, round(false_rate, 6) AS false_rate, round(missed_rate, 6) AS missed_rate, CASE WHEN n < 100 THEN 'INCOMPLETE' WHEN accuracy >= 0.95 AND false_rate <= 0.05 AND missed_rate <= 0.05 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM m""")
def routing_scorecard(spark, d):
    needs, did = F.col("l_returnflag") != "R", F.col("l_linestatus") == "F"
    c = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("grp")).agg(
        F.count(F.lit(1)).alias("n"), F.avg((needs == did).cast("int")).alias("accuracy"), (F.count_if(did & ~needs) / F.nullif(F.count_if(~needs), F.lit(0))).alias("false_rate"), (F.count_if(needs & ~did) / F.nullif(F.count_if(needs), F.lit(0))).alias("missed_rate"),
    )
    ok = (F.col("accuracy") >= 0.95) & (F.col("false_rate") <= 0.05) & (F.col("missed_rate") <= 0.05)
    return c.select("grp", "n", *(F.round(x, 6).alias(x) for x in ("accuracy", "false_rate", "missed_rate")), F.when(F.col("n") < 100, "INCOMPLETE").when(ok, "PASS").otherwise("FAIL").alias("verdict"))


@query("agent_diagnostics", """WITH t AS (SELECT o_custkey AS run, o_orderkey AS target, list_sort(list(DISTINCT l_partkey % 50)) AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
p AS (SELECT a.run, avg(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s)))) AS jaccard FROM t a JOIN t b ON a.run = b.run AND a.target < b.target GROUP BY a.run),
q AS (SELECT o_custkey AS run, count(*) AS n, count(DISTINCT o_orderpriority) AS d FROM orders GROUP BY ALL)
SELECT q.run, round((n - d) / n, 6) AS repeated, round(jaccard, 6) AS jaccard FROM q LEFT JOIN p ON p.run = q.run""")
def agent_diagnostics(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("target"), "o_orderpriority")
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("target"), (F.col("l_partkey") % 50).alias("chunk"))
    t = o.join(li, "target").groupBy("run", "target").agg(F.collect_set("chunk").alias("s"))
    b = t.select(F.col("run").alias("r2"), F.col("target").alias("t2"), F.col("s").alias("s2"))
    j = t.join(b, (F.col("run") == F.col("r2")) & (F.col("target") < F.col("t2"))).groupBy("run").agg(F.round(F.avg(F.size(F.array_intersect("s", "s2")) / F.size(F.array_union("s", "s2"))), 6).alias("jaccard"))
    n = F.count(F.lit(1))
    q = o.groupBy("run").agg(F.round((n - F.count_distinct("o_orderpriority")) / n, 6).alias("repeated"))
    return q.join(j, "run", "left")


@query("grounded_scores", """WITH c AS (SELECT l_orderkey AS case_id, l_partkey % 9 AS claim, max((l_linestatus = 'F')::INT) AS supported, max((l_returnflag = 'A')::INT) AS required FROM lineitem GROUP BY ALL), m AS (SELECT case_id, sum(supported) / count(*) AS p, sum(CASE WHEN required = 1 THEN supported END) / nullif(sum(required), 0) AS r FROM c GROUP BY case_id)
SELECT case_id, round(p, 6) AS p, round(r, 6) AS r, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) WHEN p + r = 0 THEN 0 END, 6) AS f1 FROM m""")
def grounded_scores(spark, d):
    c = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("case_id"), (F.col("l_partkey") % 9).alias("claim")).agg(F.max((F.col("l_linestatus") == "F").cast("int")).alias("supported"), F.max((F.col("l_returnflag") == "A").cast("int")).alias("required"))
    p = F.sum("supported") / F.count(F.lit(1))
    r = F.sum(F.when(F.col("required") == 1, F.col("supported"))) / F.nullif(F.sum("required"), F.lit(0))
    m = c.groupBy("case_id").agg(p.alias("p"), r.alias("r"))
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).when(F.col("p") + F.col("r") == 0, 0.0)
    return m.select("case_id", F.round("p", 6).alias("p"), F.round("r", 6).alias("r"), F.round(f1, 6).alias("f1"))


@query("ablation_summary", "SELECT o_orderpriority AS config, round(avg(o_totalprice), 4) AS mean, round(sum(o_totalprice), 2) AS total, quantile_disc(o_totalprice, 0.95) AS p95 FROM orders GROUP BY ALL")
def ablation_summary(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("config")).agg(F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.sum("o_totalprice"), 2).alias("total"), M.nearest_rank("o_totalprice", 0.95).alias("p95"))


_CONF = "c AS (SELECT s_suppkey AS config, round(s_acctbal / 100) AS success, s_nationkey AS correctness, s_suppkey % 17 AS p95, s_suppkey % 13 AS cost FROM supplier)"


def _configs(spark, d):
    s = table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("config"), F.round(F.col("s_acctbal") / 100).alias("success"), F.col("s_nationkey").alias("correctness"), (F.col("s_suppkey") % 17).alias("p95"), (F.col("s_suppkey") % 13).alias("cost"))


@query("pareto_frontier", f"WITH {_CONF} SELECT config, success, correctness, p95, cost FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.success >= c.success AND o.correctness >= c.correctness AND o.p95 <= c.p95 AND o.cost <= c.cost AND (o.success > c.success OR o.correctness > c.correctness OR o.p95 < c.p95 OR o.cost < c.cost))")
def pareto_frontier(spark, d):
    return M.dominated(_configs(spark, d), ["success", "correctness"], ["p95", "cost"])


@query("selection", f"WITH {_CONF} SELECT config, success FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.success >= c.success AND o.correctness >= c.correctness AND o.p95 <= c.p95 AND o.cost <= c.cost AND (o.success > c.success OR o.correctness > c.correctness OR o.p95 < c.p95 OR o.cost < c.cost)) ORDER BY success DESC, correctness DESC, p95, cost, config LIMIT 1")
def selection(spark, d):
    return pareto_frontier(spark, d).orderBy(F.desc("success"), F.desc("correctness"), "p95", "cost", "config").limit(1).select("config", "success")


@query("paired_deltas", """WITH m AS (SELECT o_custkey AS case_id, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS a, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS b FROM orders GROUP BY ALL)
SELECT case_id, round(b - a, 4) AS delta, CASE WHEN abs(b - a) <= 1e-12 THEN 'equal' WHEN b > a THEN 'improved' ELSE 'regressed' END AS change FROM m WHERE a IS NOT NULL AND b IS NOT NULL""")
def paired_deltas(spark, d):
    of = lambda s: F.avg(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    m = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("case_id")).agg(of("F").alias("a"), of("O").alias("b")).where("a is not null and b is not null")
    x = F.col("b") - F.col("a")
    return m.select("case_id", F.round(x, 4).alias("delta"), F.when(F.abs(x) <= 1e-12, "equal").when(x > 0, "improved").otherwise("regressed").alias("change"))


@query("task_verdict", """SELECT o_orderkey, (CASE WHEN o_orderstatus = 'P' THEN 0.0 WHEN o_orderpriority = '5-LOW' THEN NULL WHEN o_totalprice < 20000 THEN 0.0 WHEN o_totalprice < 60000 THEN NULL ELSE 1.0 END)::DOUBLE AS verdict FROM orders""")
def task_verdict(spark, d):
    """Rules in order: the first that applies gives 0, 1 or unknown."""
    rules = F.when(F.col("o_orderstatus") == "P", 0.0).when(F.col("o_orderpriority") == "5-LOW", None).when(F.col("o_totalprice") < 20000, 0.0).when(F.col("o_totalprice") < 60000, None).otherwise(1.0)
    return table(spark, d, "orders").select("o_orderkey", rules.cast("double").alias("verdict"))


@query("review_sample", "WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256(o_orderkey::VARCHAR), o_orderkey) AS n FROM orders) SELECT o_orderkey, o_orderpriority FROM r WHERE n <= 20 OR o_orderpriority = '1-URGENT' AND o_orderkey % 10 = 0")
def review_sample(spark, d):
    n = F.row_number().over(W.partitionBy("o_orderpriority").orderBy(F.sha2(F.col("o_orderkey").cast("string"), 256), "o_orderkey"))
    r = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", n.alias("n"))
    return r.where((F.col("n") <= 20) | ((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderkey") % 10 == 0))).drop("n")


@query("review_audit", "SELECT d.lang, count(*) AS total, count_if(l.quality = 1) AS approved, count_if(l.quality = 0) AS rejected, count_if(l.quality IS NULL) AS pending, bool_and(l.quality IS NOT NULL) AS complete FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id GROUP BY d.lang")
def review_audit(spark, d):
    lab = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    q = F.col("quality")
    return table(spark, d, "documents").select("doc_id", "lang").join(lab, "doc_id", "left").groupBy("lang").agg(F.count(F.lit(1)).alias("total"), F.count_if(q == 1).alias("approved"), F.count_if(q == 0).alias("rejected"), F.count_if(q.isNull()).alias("pending"), F.min(q.isNotNull()).alias("complete"))


@query("judge_calibration", """WITH m AS (SELECT count(*)::DOUBLE AS n, count_if(quality = 1 AND toxic = 1) AS tp, count_if(quality = 0 AND toxic = 0) AS tn, count_if(quality = 1 AND toxic = 0) AS fp, count_if(quality = 0 AND toxic = 1) AS fn FROM labels),
k AS (SELECT *, (tp + tn) / n AS agreement, ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n) AS chance FROM m)
SELECT n::BIGINT AS n, round(agreement, 6) AS agreement, CASE WHEN chance < 1 THEN round((agreement - chance) / (1 - chance), 6) END AS kappa, fp AS false_positives, fn AS false_negatives, n >= 100 AND tp + fn > 0 AND tn + fp > 0 AS sufficient FROM k""")
def judge_calibration(spark, d):
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    m = table(spark, d, "labels").agg(F.count(F.lit(1)).alias("n"), F.count_if(q & t).alias("tp"), F.count_if(~q & ~t).alias("tn"), F.count_if(q & ~t).alias("fp"), F.count_if(~q & t).alias("fn"))
    m = m.withColumn("agreement", (F.col("tp") + F.col("tn")) / F.col("n")).withColumn("chance", F.expr("((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (double(n) * n)"))
    kappa = F.when(F.col("chance") < 1, F.round((F.col("agreement") - F.col("chance")) / (1 - F.col("chance")), 6))
    return m.select("n", F.round("agreement", 6).alias("agreement"), kappa.alias("kappa"), F.col("fp").alias("false_positives"), F.col("fn").alias("false_negatives"), F.expr("n >= 100 AND tp + fn > 0 AND tn + fp > 0").alias("sufficient"))


@query("split_assignment", "SELECT doc_id, CASE WHEN regexp_extract(source, '^src(\\d+)$', 1)::INT <= 6 THEN 'dev' WHEN regexp_extract(source, '^src(\\d+)$', 1)::INT <= 12 THEN 'validation' ELSE 'test' END AS split FROM documents")
def split_assignment(spark, d):
    n = F.regexp_extract("source", r"^src(\d+)$", 1).cast("int")
    return table(spark, d, "documents").select("doc_id", F.when(n <= 6, "dev").when(n <= 12, "validation").otherwise("test").alias("split"))
