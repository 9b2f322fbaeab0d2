"""Control tables: versions, jobs, outbox, leases, sessions, recovery, governance."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators import filters, lifecycle as L
from millrace.operators.parts import spread
from millrace.operators.spans import containing
from millrace.plans.base import DOCUMENTS, VERSIONS, documents, table, versions

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


_V = f"WITH {VERSIONS}, {DOCUMENTS}"


@query("group_count", "SELECT o_custkey AS user_id, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL")
def group_count(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("next_version", f"{_V} SELECT c_custkey AS document_id, coalesce(max(version_no), 0) + 1 AS next FROM customer LEFT JOIN versions ON document_id = c_custkey GROUP BY c_custkey")
def next_version(spark, d):
    v = versions(spark, d).groupBy("document_id").agg(F.max("version_no").alias("m"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("document_id")).join(v, "document_id", "left").select("document_id", (F.coalesce("m", F.lit(0)) + 1).cast("long").alias("next"))


@query("sessions_with_active_run", "SELECT c_custkey, o.o_orderkey AS run_id FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'P' GROUP BY ALL) o ON o_custkey = c_custkey")
def sessions_with_active_run(spark, d):
    run = table(spark, d, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("run_id"))
    return table(spark, d, "customer").select("c_custkey").join(run, "c_custkey", "left")


@query("pointer_audit", f"""{_V}, moved AS (SELECT document_id, status, CASE document_id % 3 WHEN 0 THEN active_version_id WHEN 1 THEN NULL ELSE active_version_id - 1 END AS active_version_id FROM docs),
best AS (SELECT document_id, max_by(version_id, version_no) AS latest_id FROM versions WHERE status = 'active' GROUP BY ALL)
SELECT m.document_id, m.active_version_id, b.latest_id, CASE WHEN m.status = 'deleted' THEN 'deactivate' WHEN b.latest_id IS NULL THEN 'restore' ELSE 'publish' END AS action
FROM moved m LEFT JOIN best b ON b.document_id = m.document_id LEFT JOIN versions p ON p.document_id = m.document_id AND p.version_id = m.active_version_id
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = m.document_id AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')
AND ((m.status = 'deleted' AND m.active_version_id IS NOT NULL) OR (m.active_version_id IS NOT NULL AND coalesce(p.status, 'none') <> 'active') OR (m.active_version_id IS NULL AND b.latest_id IS NOT NULL) OR m.active_version_id <> b.latest_id)""")
def pointer_audit(spark, d):
    m = F.col("document_id") % 3
    docs = documents(spark, d).withColumn("active_version_id", F.when(m == 0, F.col("active_version_id")).when(m == 2, F.col("active_version_id") - 1))
    live = table(spark, d, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'").select(F.col("o_custkey").alias("document_id"))
    return L.pointer_audit(docs, versions(spark, d), live)


@query("stale_building_versions", f"{_V} SELECT version_id, document_id FROM versions v WHERE status = 'building' AND created_at < TIMESTAMP '1996-01-01' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = version_id AND l_linestatus = 'O')")
def stale_building_versions(spark, d):
    v = versions(spark, d).where("status = 'building' AND created_at < TIMESTAMP '1996-01-01'")
    live = table(spark, d, "lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("version_id"))
    return v.join(live, "version_id", "left_anti").select("version_id", "document_id")


@query("run_scope_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey AND o_totalprice > 400000) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey AND o_orderstatus = 'P')")
def run_scope_exists(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    c = table(spark, d, "customer").select("c_custkey")
    return c.join(o.where("o_totalprice > 400000").select("c_custkey"), "c_custkey", "left_semi").join(o.where("o_orderstatus = 'P'").select("c_custkey"), "c_custkey", "left_anti")


@query("latest_phase", "SELECT user_id, event_id, event_type, value FROM events WHERE event_id IN (SELECT max(event_id) FROM events GROUP BY user_id)")
def latest_phase(spark, d):
    return L.latest(table(spark, d, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@query("tuple_in", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT o_orderkey, 1 + o_custkey % 7 FROM orders)")
def tuple_in(spark, d):
    pairs = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (1 + F.col("o_custkey") % 7).cast("int").alias("l_linenumber"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").join(pairs, ["l_orderkey", "l_linenumber"], "left_semi")


@query("publication_target", f"""{_V}, t AS (SELECT v.version_id, v.document_id, v.version_no, d.status AS d_status, p.version_no AS previous_no FROM versions v JOIN docs d ON d.document_id = v.document_id LEFT JOIN versions p ON p.version_id = d.active_version_id AND p.document_id = d.document_id WHERE v.status = 'building')
SELECT version_id, document_id, CASE WHEN d_status = 'deleted' THEN 'refused' WHEN previous_no > version_no THEN 'obsolete' ELSE 'publish' END AS decision FROM t""")
def publication_target(spark, d):
    v = versions(spark, d)
    docs = documents(spark, d).select("document_id", F.col("status").alias("d_status"), "active_version_id")
    p = v.select(F.col("version_id").alias("active_version_id"), F.col("version_no").alias("previous_no"))
    t = v.where("status = 'building'").join(docs, "document_id").join(p, "active_version_id", "left")
    return t.select("version_id", "document_id", F.when(F.col("d_status") == "deleted", "refused").when(F.col("previous_no") > F.col("version_no"), "obsolete").otherwise("publish").alias("decision"))


@query("deletion_sweep", f"{_V}, x AS (SELECT document_id FROM docs WHERE status = 'deleted' ORDER BY (nation_id % 2 = 0) DESC, nation_id, document_id LIMIT 25) SELECT x.document_id, coalesce(string_agg(v.version_id::VARCHAR, ',' ORDER BY v.version_id), '') AS versions FROM x LEFT JOIN versions v ON v.document_id = x.document_id GROUP BY x.document_id")
def deletion_sweep(spark, d):
    """Deleted documents, fenced ones first, each with all of its versions."""
    docs = documents(spark, d).where("status = 'deleted'").orderBy(F.desc(F.col("nation_id") % 2 == 0), "nation_id", "document_id").limit(25).select("document_id")
    rows = docs.join(versions(spark, d).select("document_id", "version_id"), "document_id", "left")
    return rows.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("version_id")), lambda x: x.cast("string")), ",").alias("versions"))


@query("history_as_of", """WITH r AS (SELECT o_custkey AS thread, o_orderkey AS id, o_orderdate AS created, o_orderdate + to_days((o_totalprice::BIGINT % 60)::INT) AS finished FROM orders WHERE o_orderstatus = 'F'), a AS (SELECT o_custkey AS thread, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS aid, max(o_orderdate) AS t0 FROM orders GROUP BY ALL),
x AS (SELECT r.thread, r.id, row_number() OVER (PARTITION BY r.thread ORDER BY created DESC, id DESC) AS n FROM r JOIN a ON a.thread = r.thread AND finished <= t0 AND (created < t0 OR (created = t0 AND id < aid))) SELECT thread, id FROM x WHERE n <= 6""")
def history_as_of(spark, d):
    """The last six runs of a thread that were over when its newest run began."""
    o = table(spark, d, "orders")
    a = o.groupBy(F.col("o_custkey").alias("thread")).agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("a"))
    finished = F.col("o_orderdate") + F.make_dt_interval((F.rint("o_totalprice").cast("long") % 60).cast("int"))  # a half goes to the even number, as in SQL
    r = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("thread"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created"), finished.alias("finished"))
    x = r.join(a, "thread").where((F.col("finished") <= F.col("a.o_orderdate")) & (F.struct(F.col("created").alias("o_orderdate"), F.col("id").alias("o_orderkey")) < F.col("a")))
    return x.withColumn("n", F.row_number().over(W.partitionBy("thread").orderBy(F.desc("created"), F.desc("id")))).where("n <= 6").select("thread", "id")


@query("anchor_binding", "WITH m AS (SELECT b.item_id, d.doc_id // 10 AS parent_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)) SELECT item_id, min(parent_id) AS parent_id FROM m GROUP BY item_id HAVING count(DISTINCT parent_id) = 1")
def anchor_binding(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("anchor"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    m = containing(docs, "doc_id", "text", b, "item_id", "anchor").select("item_id", F.floor(F.col("doc_id") / 10).alias("parent_id"))
    return m.groupBy("item_id").agg(F.min("parent_id").alias("parent_id"), F.count_distinct("parent_id").alias("n")).where("n = 1").drop("n")


@query("interval_cover", "WITH s AS (SELECT l_orderkey, l_partkey AS a, l_partkey + l_quantity::BIGINT * 20 AS b FROM lineitem), w AS (SELECT *, max(b) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM s), g AS (SELECT *, sum((top IS NULL OR a > top)::INT) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM w) SELECT l_orderkey, min(a) AS a, max(b) AS b FROM g GROUP BY l_orderkey, island")
def interval_cover(spark, d):
    s = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("a"), (F.col("l_partkey") + F.col("l_quantity").cast("long") * 20).alias("b"))
    return L.islands(s, ["l_orderkey"], "a", "b")


@query("span_containment", "SELECT a.l_orderkey, a.l_linenumber FROM lineitem a WHERE EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber <> a.l_linenumber AND b.l_partkey <= a.l_partkey AND b.l_partkey + b.l_quantity * 20 >= a.l_partkey + a.l_quantity)")
def span_containment(spark, d):
    a = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    b = a.select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_quantity").alias("q"))
    inside = (F.col("n") != F.col("l_linenumber")) & (F.col("p") <= F.col("l_partkey")) & (F.col("p") + F.col("q") * 20 >= F.col("l_partkey") + F.col("l_quantity"))
    return a.join(b, (a["l_orderkey"] == b["l_orderkey"]) & inside, "left_semi").select("l_orderkey", "l_linenumber")


@query("requests_full_outer", """WITH s AS (SELECT event_id % 4000 AS id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY ALL), e AS (SELECT event_id % 4000 AS id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY ALL)
SELECT coalesce(s.id, e.id) AS id, CASE WHEN s.id IS NULL THEN 'never_started' WHEN e.id IS NULL THEN 'never_ended' WHEN s.n > 1 OR e.n > 1 THEN 'repeated' ELSE 'complete' END AS state FROM s FULL JOIN e ON s.id = e.id""")
def requests_full_outer(spark, d):
    e = table(spark, d, "events").withColumn("id", F.col("event_id") % 4000)
    of = lambda t, n: e.where(F.col("event_type") == t).groupBy("id").agg(F.count(F.lit(1)).alias(n))
    rows = of("view", "s").join(of("click", "e"), "id", "full")
    return rows.select("id", F.when(F.col("s").isNull(), "never_started").when(F.col("e").isNull(), "never_ended").when((F.col("s") > 1) | (F.col("e") > 1), "repeated").otherwise("complete").alias("state"))


@query("keyed_upsert", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, 'new' AS c_name, -1.0 AS c_acctbal FROM customer WHERE c_custkey % 3 = 0")
def keyed_upsert(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return L.upserted(c, c.where("c_custkey % 3 = 0").withColumn("c_name", F.lit("new")).withColumn("c_acctbal", F.lit(-1.0)), ["c_custkey"])


@query("idempotent_insert", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 10 UNION ALL SELECT n_nationkey, 'late' FROM nation WHERE n_nationkey >= 10")
def idempotent_insert(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    return L.inserted(n.where("n_nationkey < 10"), n.withColumn("n_name", F.lit("late")), ["n_nationkey"])


@query("insert_conflicts", "SELECT n_nationkey FROM nation WHERE n_nationkey < 10 AND n_regionkey <> 1")
def insert_conflicts(spark, d):
    n = table(spark, d, "nation")
    return L.conflicts(n.where("n_nationkey < 10"), n.withColumn("n_regionkey", F.lit(1)), ["n_nationkey"], ["n_regionkey"])


@query("event_tail", "SELECT event_id, event_type FROM events WHERE event_id > 5000 ORDER BY event_id LIMIT 100")
def event_tail(spark, d):
    return filters.tail_after(table(spark, d, "events"), "event_id", 5000, 100).select("event_id", "event_type")


@query("due_work", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderdate <= TIMESTAMP '1997-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 100")
def due_work(spark, d):
    import datetime as dt

    return filters.due(table(spark, d, "orders"), "o_orderstatus", ["O", "P"], "o_orderdate", dt.datetime(1997, 1, 1), "o_orderkey", 100).select("o_orderkey", "o_orderdate")


@query("full_scan_page", "SELECT c_custkey, c_name FROM customer WHERE c_custkey > 499 ORDER BY c_custkey LIMIT 1000")
def full_scan_page(spark, d):
    return filters.tail_after(table(spark, d, "customer"), "c_custkey", 499, 1000).select("c_custkey", "c_name")


@query("event_scoping", "SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE regexp_matches(event_type, '^[a-z]+$') AND value > 1 GROUP BY ALL")
def event_scoping(spark, d):
    e = table(spark, d, "events").where(F.col("event_type").rlike("^[a-z]+$") & (F.col("value") > 1))
    return e.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("loop_metrics", """WITH r AS (SELECT user_id, count_if(event_type = 'view') AS rounds, count_if(event_type = 'error') AS repairs, max_by(event_type, event_id) FILTER (event_type IN ('purchase', 'error')) AS reason FROM events GROUP BY user_id)
SELECT coalesce(reason, 'none') AS reason, count(*) AS runs, sum(rounds)::BIGINT AS rounds, sum(repairs)::BIGINT AS repairs, round(avg(rounds), 6) AS mean_rounds FROM r GROUP BY ALL""")
def loop_metrics(spark, d):
    t = F.col("event_type")
    end = F.max_by(F.when(t.isin("purchase", "error"), t), F.when(t.isin("purchase", "error"), F.col("event_id")))
    r = table(spark, d, "events").groupBy("user_id").agg(F.count_if(t == "view").alias("rounds"), F.count_if(t == "error").alias("repairs"), end.alias("reason"))
    return r.groupBy(F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("runs"), F.sum("rounds").alias("rounds"), F.sum("repairs").alias("repairs"), F.round(F.avg("rounds"), 6).alias("mean_rounds"))


@query("security_counters", "SELECT count_if(event_type LIKE '%error%') AS errors, sum(CASE WHEN event_type = 'error' THEN greatest((props::JSON->>'k')::INT, 1) ELSE 0 END)::BIGINT AS weight, count(DISTINCT CASE WHEN event_type = 'error' THEN user_id END) AS users FROM events")
def security_counters(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    bad = F.col("event_type") == "error"
    return table(spark, d, "events").agg(F.count_if(F.col("event_type").contains("error")).alias("errors"), F.sum(F.when(bad, F.greatest(k, F.lit(1))).otherwise(0)).alias("weight"), F.count_distinct(F.when(bad, F.col("user_id"))).alias("users"))


@query("event_window", "WITH w AS (SELECT *, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS nid, lead(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS nts, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS nt FROM events) SELECT user_id, event_id, epoch_us(nts) - epoch_us(ts) AS micros FROM w WHERE event_type = 'view' AND nt = 'purchase'")
def event_window(spark, d):
    """How long it took from each start to the completion that follows it directly."""
    w = W.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, d, "events").select("*", F.lead("ts").over(w).alias("nts"), F.lead("event_type").over(w).alias("nt"))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return rows.where("event_type = 'view' AND nt = 'purchase'").select("user_id", "event_id", (us("nts") - us("ts")).alias("micros"))


@query("outbox_claim", "SELECT o_orderkey, o_orderdate + INTERVAL 30 SECOND AS next_attempt FROM orders WHERE o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1996-06-01' ORDER BY o_orderdate, o_orderkey LIMIT 50")
def outbox_claim(spark, d):
    import datetime as dt

    rows = filters.due(table(spark, d, "orders"), "o_orderstatus", ["O"], "o_orderdate", dt.datetime(1996, 6, 1), "o_orderkey", 50)
    return rows.select("o_orderkey", (F.col("o_orderdate") + F.expr("INTERVAL 30 SECONDS")).alias("next_attempt"))


@query("lease_expiry", "SELECT o_orderkey, CASE WHEN o_orderdate + INTERVAL 7 DAY < TIMESTAMP '1997-06-01' THEN 'expired' ELSE 'held' END AS lease FROM orders WHERE o_orderstatus = 'P'")
def lease_expiry(spark, d):
    end = F.col("o_orderdate") + F.expr("INTERVAL 7 DAYS")
    return table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", F.when(end < F.lit("1997-06-01").cast("timestamp"), "expired").otherwise("held").alias("lease"))


@query("capacity_slots", "WITH f AS (SELECT s_nationkey AS resource, s_suppkey AS slot, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier WHERE s_acctbal > 0) SELECT resource, min(slot) AS slot FROM f WHERE (SELECT count(DISTINCT resource) FROM f) = (SELECT count(DISTINCT s_nationkey) FROM supplier WHERE s_acctbal > 0) GROUP BY resource")
def capacity_slots(spark, d):
    """The lowest free slot of every resource."""
    return table(spark, d, "supplier").where("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("resource")).agg(F.min("s_suppkey").alias("slot"))


@query("reconciler_sweep", f"""{_V} SELECT v.document_id, v.version_id, CASE WHEN d.status = 'deleted' THEN 'purge' WHEN v.status = 'building' AND v.created_at < TIMESTAMP '1996-01-01' THEN CASE WHEN p.version_no > v.version_no THEN 'deactivate' ELSE 'publish' END WHEN v.status = 'active' AND d.active_version_id <> v.version_id THEN 'deactivate' ELSE 'keep' END AS action
FROM versions v JOIN docs d ON d.document_id = v.document_id LEFT JOIN versions p ON p.version_id = d.active_version_id""")
def reconciler_sweep(spark, d):
    v = versions(spark, d)
    docs = documents(spark, d).select("document_id", F.col("status").alias("d_status"), "active_version_id")
    p = v.select(F.col("version_id").alias("active_version_id"), F.col("version_no").alias("p_no"))
    rows = v.join(docs, "document_id").join(p, "active_version_id", "left")
    stale = (F.col("status") == "building") & (F.col("created_at") < F.lit("1996-01-01").cast("timestamp"))
    action = F.when(F.col("d_status") == "deleted", "purge").when(stale, F.when(F.col("p_no") > F.col("version_no"), "deactivate").otherwise("publish")).when((F.col("status") == "active") & (F.col("active_version_id") != F.col("version_id")), "deactivate").otherwise("keep")
    return rows.select("document_id", "version_id", action.alias("action"))


@query("recovery", "SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1995-06-01' THEN 'failed' WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'failed' WHEN o_custkey % 5 >= 3 THEN 'exhausted' ELSE 'queued' END AS state, CASE WHEN o_orderdate >= TIMESTAMP '1995-06-01' AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH') AND o_custkey % 5 < 3 THEN o_custkey % 5 + 1 ELSE o_custkey % 5 END AS generation FROM orders WHERE o_orderstatus = 'P'")
def recovery(spark, d):
    """Past the deadline or in a late stage: failed; tried three times: exhausted; else queued again."""
    late, stage, tries = F.col("o_orderdate") < F.lit("1995-06-01").cast("timestamp"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("o_custkey") % 5
    state = F.when(late | stage, "failed").when(tries >= 3, "exhausted").otherwise("queued")
    rows = table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", state.alias("state"), tries.alias("generation"))
    return rows.withColumn("generation", F.when(F.col("state") == "queued", F.col("generation") + 1).otherwise(F.col("generation")))


@query("snapshot_drift", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'removed' WHEN c_custkey % 10 = 1 THEN 'changed' WHEN c_custkey % 10 = 2 THEN 'added' END AS drift FROM customer WHERE c_custkey % 10 <= 2")
def snapshot_drift(spark, d):
    c, m = table(spark, d, "customer"), F.col("c_custkey") % 10
    live = c.where(m != 0).withColumn("c_name", F.when(m == 1, "other").otherwise(F.col("c_name")))
    return L.drift(c.where(m != 2), live, "c_custkey")


@query("membership_checks", "SELECT (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS orphans, (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY ALL HAVING count(*) > 1)) AS repeated, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS unknown")
def membership_checks(spark, d):
    o, li, c = table(spark, d, "orders"), table(spark, d, "lineitem"), table(spark, d, "customer")
    n = F.count(F.lit(1))
    a = li.select(F.col("l_orderkey").alias("o_orderkey")).join(o.select("o_orderkey"), "o_orderkey", "left_anti").agg(n.alias("orphans"))
    b = o.groupBy("o_orderkey").agg(n.alias("k")).agg(F.count_if(F.col("k") > 1).alias("repeated"))
    u = o.select(F.col("o_custkey").alias("c_custkey")).join(c.select("c_custkey"), "c_custkey", "left_anti").agg(n.alias("unknown"))
    return a.crossJoin(b).crossJoin(u)  # one row each


@query("split_leakage", "SELECT o_custkey, count(DISTINCT o_orderstatus) AS splits FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1")
def split_leakage(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderstatus").alias("splits")).where("splits > 1")


@query("derivation_check", "SELECT o_orderkey, abs(o_totalprice - s) <= 250000 AS ok FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS s FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey")
def derivation_check(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("s"))
    return table(spark, d, "orders").join(s, "o_orderkey").select("o_orderkey", (F.abs(F.col("o_totalprice") - F.col("s")) <= 250000).alias("ok"))


@query("group_barrier", "SELECT o_custkey AS grp, count(*) AS members, count_if(o_orderstatus = 'F') AS done, CASE WHEN count(*) = count_if(o_orderstatus = 'F') THEN 'complete' WHEN o_custkey % 2 = 0 THEN 'partial' ELSE 'waiting' END AS state, coalesce(string_agg(CASE WHEN o_orderstatus <> 'F' THEN o_orderkey::VARCHAR END, ',' ORDER BY o_orderkey), '') AS missing FROM orders GROUP BY o_custkey")
def group_barrier(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("member"), "o_orderstatus")
    out = L.barrier(o.select("grp", "member"), o.where("o_orderstatus = 'F'"), "grp", "member", F.col("grp") % 2 == 0)
    return out.select("grp", "members", "done", "state", F.array_join(F.transform("missing", lambda x: x.cast("string")), ",").alias("missing"))


@query("budget_audit", "SELECT o_custkey, count(*) AS requests, round(sum(o_totalprice), 2) AS consumed, count(*) <= 20 AND sum(o_totalprice) <= 3000000 AS within FROM orders GROUP BY o_custkey")
def budget_audit(spark, d):
    n, s = F.count(F.lit(1)), F.sum("o_totalprice")
    return table(spark, d, "orders").groupBy("o_custkey").agg(n.alias("requests"), F.round(s, 2).alias("consumed"), ((n <= 20) & (s <= 3000000)).alias("within"))


@query("span_tree", "SELECT l_orderkey AS trace, count(*) AS spans, count(DISTINCT l_suppkey) AS parents, epoch(max(l_shipdate))::BIGINT - epoch(min(l_shipdate))::BIGINT AS seconds, count_if(l_returnflag = 'R') AS errors FROM lineitem GROUP BY l_orderkey")
def span_tree(spark, d):
    at = F.col("l_shipdate").cast("timestamp").cast("long")
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("trace")).agg(F.count(F.lit(1)).alias("spans"), F.count_distinct("l_suppkey").alias("parents"), (F.max(at) - F.min(at)).alias("seconds"), F.count_if(F.col("l_returnflag") == "R").alias("errors"))


@query("release_swap", "SELECT p_partkey, p_brand = 'Brand#7' AS is_active FROM part")
def release_swap(spark, d):
    p = table(spark, d, "part")
    members = p.where("p_brand = 'Brand#7'").select("p_partkey", F.lit(True).alias("m"))
    return p.select("p_partkey").join(members, "p_partkey", "left").select("p_partkey", F.coalesce("m", F.lit(False)).alias("is_active"))


@query("status_flip", f"{_V} SELECT version_id, CASE WHEN document_id < 100 AND status = 'active' THEN 'inactive' ELSE status END AS status FROM versions WHERE NOT (document_id BETWEEN 100 AND 150)")
def status_flip(spark, d):
    v = versions(spark, d).where("NOT document_id BETWEEN 100 AND 150")
    return v.select("version_id", F.when((F.col("document_id") < 100) & (F.col("status") == "active"), "inactive").otherwise(F.col("status")).alias("status"))


@query("memory_tenancy", "SELECT c_custkey FROM customer WHERE c_nationkey = (c_custkey % 25) AND c_mktsegment IS NOT NULL")
def memory_tenancy(spark, d):
    """Two independent owners must agree; a missing one drops the record."""
    return table(spark, d, "customer").where((F.col("c_nationkey") == F.col("c_custkey") % 25) & F.col("c_mktsegment").isNotNull()).select("c_custkey")


@query("payload_projection", "WITH x AS (SELECT event_id, 'a|b|' || event_type AS origins, (props::JSON->>'k')::INT AS k FROM events) SELECT event_id, split_part(origins, '|', k % 3 + 1) AS origin, CASE WHEN k >= 0 THEN k END AS metric FROM x")
def payload_projection(spark, d):
    x = table(spark, d, "events").select("event_id", F.concat(F.lit("a|b|"), F.col("event_type")).alias("o"), F.from_json("props", "k int")["k"].alias("k"))
    return x.select("event_id", F.element_at(F.split("o", r"\|"), F.col("k") % 3 + 1).alias("origin"), F.when(F.col("k") >= 0, F.col("k")).alias("metric"))


@query("todo_dag", """WITH t AS (SELECT l_orderkey AS run, l_linenumber AS id, max(CASE l_returnflag WHEN 'A' THEN 'done' WHEN 'R' THEN 'failed' ELSE 'open' END) AS status FROM lineitem GROUP BY ALL), e AS (SELECT a.run, a.id, b.id AS blocker FROM t a JOIN t b ON a.run = b.run AND b.id IN (a.id - 1, a.id - 2)),
b AS (SELECT e.run, e.id, max((t.status <> 'done')::INT) AS w, max((t.status = 'failed')::INT) AS f FROM e JOIN t ON t.run = e.run AND t.id = e.blocker GROUP BY ALL)
SELECT t.run, t.id, t.status, CASE WHEN t.status <> 'open' THEN t.status WHEN f = 1 THEN 'blocked' WHEN w = 1 THEN 'waiting' ELSE 'ready' END AS view FROM t LEFT JOIN b ON b.run = t.run AND b.id = t.id""")
def todo_dag(spark, d):
    status = F.max(F.when(F.col("l_returnflag") == "A", "done").when(F.col("l_returnflag") == "R", "failed").otherwise("open"))
    t = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("id")).agg(status.alias("status"))
    e = t.select("run", "id", F.explode(F.array(F.col("id") - 1, F.col("id") - 2)).alias("blocker"))
    return L.ready(t, e)


@query("support_closure", """WITH RECURSIVE e AS (SELECT DISTINCT s_suppkey AS src, s_nationkey AS dst FROM supplier WHERE s_suppkey > s_nationkey), c AS (SELECT s_suppkey AS root, s_suppkey AS node, 0 AS h FROM supplier UNION SELECT root, dst::BIGINT, h + 1 FROM c JOIN e ON e.src = c.node WHERE h < 4) SELECT DISTINCT root, node FROM c""")
def support_closure(spark, d):
    s = table(spark, d, "supplier")
    e = s.where("s_suppkey > s_nationkey").select(F.col("s_suppkey").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).distinct()
    return L.closure(e, s.select(F.col("s_suppkey").alias("root")), 4)


@query("reference_expansion", """WITH e AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem WHERE l_partkey <> l_orderkey), r AS (SELECT o_orderkey AS root FROM orders), h1 AS (SELECT DISTINCT root, dst AS node FROM r JOIN e ON src = root), h2 AS (SELECT DISTINCT root, dst AS node FROM h1 JOIN e ON src = node) SELECT root, root AS node FROM r UNION SELECT * FROM h1 UNION SELECT * FROM h2""")
def reference_expansion(spark, d):
    e = table(spark, d, "lineitem").where("l_partkey <> l_orderkey").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    return L.closure(e, table(spark, d, "orders").select(F.col("o_orderkey").alias("root")), 2)


@query("manifest_check", f"{_V} SELECT v.version_id, count(l.l_linenumber) AS children, count(DISTINCT l.l_partkey) AS parents, count(l.l_linenumber) = floor(v.size)::BIGINT % 8 AS matches FROM versions v LEFT JOIN lineitem l ON l.l_orderkey = v.version_id GROUP BY v.version_id, v.size")
def manifest_check(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("version_id"), "l_linenumber", "l_partkey")
    staged = spread(li, "version_id").groupBy("version_id").agg(F.count("l_linenumber").alias("children"), F.count_distinct("l_partkey").alias("parents"))
    rows = versions(spark, d).select("version_id", "size").join(staged, "version_id", "left").groupBy("version_id", "size")
    out = rows.agg(F.coalesce(F.sum("children"), F.lit(0)).alias("children"), F.coalesce(F.max("parents"), F.lit(0)).alias("parents"))
    return out.select("version_id", "children", "parents", (F.col("children") == F.floor("size") % 8).alias("matches"))


@query("child_set_digest", "SELECT l_orderkey, sha256(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey)) AS digest FROM lineitem GROUP BY l_orderkey")
def child_set_digest(spark, d):
    pair = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    text = F.array_join(F.transform(pair, lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), ",")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sha2(text, 256).alias("digest"))


@query("embedding_validation", "SELECT vec_id, len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: isfinite(x))) AS ok FROM embeddings")
def embedding_validation(spark, d):
    finite = F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table(spark, d, "embeddings").select("vec_id", ((F.size("embedding") == 64) & finite).alias("ok"))


@query("conditional_uniqueness", "SELECT o_custkey, count(*) AS live FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey HAVING count(*) > 1")
def conditional_uniqueness(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("live")).where("live > 1")


@query("route_policy", "SELECT conv_id, turn, CASE WHEN length(text) < 40 THEN 'chat' WHEN contains(text, '?') OR length(text) < 400 THEN 'fast' ELSE 'research' END AS route FROM conversations WHERE role = 'user'")
def route_policy(spark, d):
    n = F.length("text")
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.when(n < 40, "chat").when(F.col("text").contains("?") | (n < 400), "fast").otherwise("research").alias("route"))


@query("citation_validator", "SELECT o.o_orderkey, count(*) AS cited, count_if(l.l_suppkey IS NULL) AS unknown, count_if(l.l_suppkey IS NULL) = 0 AS valid FROM orders o JOIN (SELECT l_orderkey, l_suppkey + CASE WHEN l_partkey % 97 = 0 THEN 100000 ELSE 0 END AS s FROM lineitem) c ON c.l_orderkey = o.o_orderkey LEFT JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) l ON l.l_orderkey = c.l_orderkey AND l.l_suppkey = c.s GROUP BY o.o_orderkey")
def citation_validator(spark, d):
    """Every citation of an answer must be among its evidence."""
    li = table(spark, d, "lineitem")
    cited = li.select("l_orderkey", (F.col("l_suppkey") + F.when(F.col("l_partkey") % 97 == 0, 100000).otherwise(0)).alias("s"))
    g = li.groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("have")).join(cited.groupBy("l_orderkey").agg(F.collect_list("s").alias("cites")), "l_orderkey")
    lost = F.size(F.filter("cites", lambda c: ~F.array_contains("have", c))).cast("long")
    return g.select(F.col("l_orderkey").alias("o_orderkey"), F.size("cites").cast("long").alias("cited"), lost.alias("unknown"), (lost == 0).alias("valid"))


@query("memory_admission", "SELECT conv_id, turn FROM conversations WHERE role = 'user' AND length(text) BETWEEN 20 AND 500 AND NOT contains(text, '@')")
def memory_admission(spark, d):
    return table(spark, d, "conversations").where((F.col("role") == "user") & F.length("text").between(20, 500) & ~F.col("text").contains("@")).select("conv_id", "turn")


@query("alias_switch", "SELECT count(*) AS n FROM part WHERE p_brand = 'Brand#2'")
def alias_switch(spark, d):
    """A search name that points to one generation; moving the pointer is one replacement of a view."""
    p = table(spark, d, "part")
    for generation in ("Brand#1", "Brand#2"):
        p.where(F.col("p_brand") == generation).createOrReplaceTempView("search_alias")
    return spark.table("search_alias").agg(F.count(F.lit(1)).alias("n"))
