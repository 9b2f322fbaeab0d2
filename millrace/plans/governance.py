"""Governance: releases, publication steps, pointers, merged research, memories, scopes, gold sets, tails."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import governance as G
from millrace.operators import scope as S
from millrace.plans.base import DOCUMENTS, VERSIONS, documents, table, versions

QUERIES, ORACLE = {}, {}


def query(name, sql):
    def add(f):
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return add


@query("release_membership", """WITH r AS (SELECT c_nationkey AS generation, c_custkey % 7 AS member, c_custkey AS child, md5(c_name) AS hash, c_acctbal > 0 AS is_active FROM customer)
SELECT generation, child, CASE WHEN (generation % 3 = 1 AND generation IN (SELECT generation FROM r WHERE member IN (2, 5))) OR (generation % 3 = 2 AND generation IN (SELECT generation FROM r WHERE member = 2) AND generation NOT IN (SELECT generation FROM r WHERE member = 5)) THEN member IN (2, 5) ELSE is_active END AS is_active FROM r""")
def release_membership(spark, d):
    """A third of the generations is released with right digests, a third with one that is wrong, a third not at all."""
    r = table(spark, d, "customer").select(F.col("c_nationkey").alias("generation"), (F.col("c_custkey") % 7).alias("member"), F.col("c_custkey").alias("child"), F.md5("c_name").alias("hash"), (F.col("c_acctbal") > 0).alias("is_active"))
    m = r.where("member in (2, 5) and generation % 3 > 0").groupBy("generation", "member").agg(G.identity_digest(F.col("child"), F.col("hash")).alias("digest"))
    m = m.withColumn("digest", F.when((F.col("generation") % 3 == 2) & (F.col("member") == 5), "x").otherwise(F.col("digest")))
    return G.released(r, m, "generation", "member", "child", "hash").select("generation", "child", "is_active")


@query("publication_steps", f"""WITH {VERSIONS}, {DOCUMENTS}, c AS (SELECT l_orderkey AS version_id, count(DISTINCT l_suppkey % 5) AS parents, count(*) AS children FROM lineitem GROUP BY ALL),
t AS (SELECT v.document_id, v.version_id, v.version_no, d.active_version_id, a.version_no AS active_no, v.version_id % 11 <> 3 AND (c.children IS NULL OR v.version_id % 13 <> 5) AS whole FROM versions v JOIN docs d ON d.document_id = v.document_id
  LEFT JOIN versions a ON a.version_id = d.active_version_id LEFT JOIN c ON c.version_id = v.version_id WHERE v.status = 'building' AND (d.active_version_id IS NULL OR d.active_version_id <> v.version_id)),
s(step, action) AS (VALUES (1, 'activate parents'), (2, 'activate children'), (3, 'deactivate previous'), (4, 'move pointer'))
SELECT document_id, version_id, step, action, CASE step WHEN 3 THEN active_version_id WHEN 4 THEN version_id END AS target FROM t, s WHERE whole AND (active_no IS NULL OR active_no <= version_no) AND (step <> 3 OR active_version_id IS NOT NULL)
UNION ALL SELECT document_id, version_id, 0, CASE WHEN active_no > version_no THEN 'deactivate' ELSE 'quarantine' END, NULL FROM t WHERE active_no > version_no OR NOT whole""")
def publication_steps(spark, d):
    """Versions being built against what is staged for them; some manifests were changed, some counts are off."""
    v = versions(spark, d)
    staged = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("version_id")).agg(F.count_distinct(F.col("l_suppkey") % 5).alias("parents"), F.count(F.lit(1)).alias("children"))
    claims = staged.select("version_id", F.col("parents").alias("parent_count"), (F.col("children") + F.when(F.col("version_id") % 13 == 5, 1).otherwise(0)).alias("child_count"))
    rows = v.where("status = 'building'").join(claims, "version_id", "left").na.fill(0, ["parent_count", "child_count"])
    rows = rows.select("document_id", "version_id", "version_no", "parent_count", "child_count", F.md5(F.col("version_id").cast("string")).alias("manifest_hash"), F.when(F.col("version_id") % 11 == 3, "x").otherwise(F.md5(F.col("version_id").cast("string"))).alias("rebuilt_hash"))
    docs = documents(spark, d).select("document_id", "active_version_id")
    active = docs.join(v.select(F.col("version_id").alias("active_version_id"), F.col("version_no").alias("active_no")), "active_version_id", "left").select("document_id", "active_version_id", "active_no")
    return G.published(rows, staged, active)


@query("pointer_switch", """WITH q AS (SELECT s_suppkey, 'search-' || s_suppkey AS alias, 'index-' || s_nationkey AS wanted FROM supplier),
n AS (SELECT q.*, CASE s_suppkey % 4 WHEN 0 THEN [wanted] WHEN 1 THEN ['index-old'] WHEN 2 THEN ['other-' || s_suppkey, 'index-old'] END AS now, wanted IN (SELECT 'index-' || n_nationkey FROM nation WHERE n_nationkey % 5 <> 3) AS there FROM q),
o AS (SELECT alias, wanted, CASE WHEN NOT there THEN 'missing' WHEN s_suppkey % 4 = 2 THEN 'foreign' WHEN s_suppkey % 4 = 0 THEN 'unchanged' ELSE 'switched' END AS outcome FROM n)
SELECT alias, CASE WHEN outcome IN ('switched', 'unchanged') THEN wanted END AS target, outcome FROM o""")
def pointer_switch(spark, d):
    """Names asked to point to their nation's index: some indexes aren't there, some names point elsewhere too."""
    s = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("search-"), F.col("s_suppkey").cast("string")).alias("alias"), F.concat(F.lit("index-"), F.col("s_nationkey").cast("string")).alias("wanted"))
    m = F.col("s_suppkey") % 4
    targets = F.when(m == 0, F.array("wanted")).when(m == 1, F.array(F.lit("index-old"))).when(m == 2, F.array(F.concat(F.lit("other-"), F.col("s_suppkey").cast("string")), F.lit("index-old")))
    pointers = s.select("alias", F.explode(targets).alias("target"))
    indexes = table(spark, d, "nation").where("n_nationkey % 5 <> 3").select(F.concat(F.lit("index-"), F.col("n_nationkey").cast("string")).alias("target"))
    return G.switched(s.select("alias", "wanted"), indexes, pointers, "index-")


@query("research_merge", """WITH e AS (SELECT user_id AS run, event_id % 5 AS todo, event_id // 5 % 40 AS evidence, event_type AS relation, CASE WHEN user_id % 9 = 4 AND event_id % 2 = 0 THEN 'g2' WHEN user_id % 9 = 7 AND event_id % 3 = 0 THEN '' WHEN user_id % 9 = 8 THEN 'g3' ELSE 'g1' END AS generation FROM events),
g AS (SELECT run, CASE WHEN bool_or(generation = '') THEN 'no generation' WHEN count(DISTINCT generation) > 1 THEN 'several generations' WHEN min(generation) <> 'g1' THEN 'another generation' END AS problem FROM e GROUP BY run)
SELECT run, evidence, min(todo) AS todo, string_agg(DISTINCT relation, ',' ORDER BY relation) AS relations, NULL AS problem FROM e JOIN g USING (run) WHERE problem IS NULL GROUP BY run, evidence UNION ALL SELECT run, NULL, NULL, NULL, problem FROM g WHERE problem IS NOT NULL""")
def research_merge(spark, d):
    e, m = table(spark, d, "events"), F.col("user_id") % 9
    generation = F.when((m == 4) & (F.col("event_id") % 2 == 0), "g2").when((m == 7) & (F.col("event_id") % 3 == 0), "").when(m == 8, "g3").otherwise("g1")
    items = e.select(F.col("user_id").alias("run"), (F.col("event_id") % 5).alias("todo"), (F.floor(F.col("event_id") / 5) % 40).alias("evidence"), F.col("event_type").alias("relation"), generation.alias("generation"))
    return G.merged_results(items, "run", F.lit("g1")).withColumn("relations", F.array_join("relations", ","))


@query("memory_rejections", """WITH c AS (SELECT conv_id, turn AS id, unnest(CASE WHEN conv_id % 7 = 0 THEN [turn, 99] ELSE [turn, turn - 1] END) AS message, CASE WHEN conv_id % 7 = 0 THEN [turn, 99] ELSE [turn, turn - 1] END AS sources FROM conversations WHERE turn > 0),
r AS (SELECT c.conv_id, c.id, min(CASE WHEN s.turn IS NULL THEN 1 WHEN s.role = 'system' THEN 2 WHEN s.role = 'assistant' AND NOT coalesce(c.conv_id % 2 = 0 AND k.role = 'user' AND list_contains(c.sources, k.turn), false) THEN 3 ELSE 9 END) AS worst
  FROM c LEFT JOIN conversations s ON s.conv_id = c.conv_id AND s.turn = c.message LEFT JOIN conversations k ON k.conv_id = c.conv_id AND k.turn = c.message + 1 GROUP BY ALL)
SELECT conv_id, id, CASE worst WHEN 1 THEN 'unknown_source_message' WHEN 2 THEN 'system_source' WHEN 3 THEN 'unconfirmed_assistant_source' END AS reason FROM r""")
def memory_rejections(spark, d):
    """Each turn and the one before as the sources of a memory; what the assistant says counts if the next turn, a
    user's, confirms it."""
    t = table(spark, d, "conversations")
    sources = F.when(F.col("conv_id") % 7 == 0, F.array(F.col("turn"), F.lit(99).cast(dict(t.dtypes)["turn"]))).otherwise(F.array(F.col("turn"), (F.col("turn") - 1).cast(dict(t.dtypes)["turn"])))
    candidates = t.where("turn > 0").select("conv_id", F.col("turn").alias("id"), sources.alias("sources"))
    messages = t.select("conv_id", F.col("turn").alias("message"), "role", (F.col("conv_id") % 2 == 0).alias("confirmed"), (F.col("turn") + 1).cast(dict(t.dtypes)["turn"]).alias("confirmation"))
    return G.rejections(candidates, messages, "conv_id").select("conv_id", "id", "reason")


@query("scope_narrowing", """WITH o AS (SELECT o_orderkey, o_custkey % 3 AS a, CASE o_orderkey % 4 WHEN 0 THEN [] WHEN 1 THEN ['1', '2'] ELSE ['1', '2', '3'] END AS mine, CASE o_custkey % 5 WHEN 0 THEN [] WHEN 1 THEN ['2'] WHEN 2 THEN ['2', '3'] ELSE ['4'] END AS asked FROM orders)
SELECT o_orderkey, o_orderkey % 17 = 0 OR (o_orderkey % 19 <> 0 AND a <> 2 AND (len(mine) = 0 OR (len(asked) > 0 AND list_has_all(mine, asked)))) AS allowed FROM o""")
def scope_narrowing(spark, d):
    """Whether requests only narrow what their user may see."""
    o = table(spark, d, "orders")
    k, c, none = F.col("o_orderkey"), F.col("o_custkey"), F.array().cast("array<string>")
    lists = lambda *xs: F.array(*(F.lit(x) for x in xs))
    mine = F.when(k % 4 == 0, none).when(k % 4 == 1, lists("1", "2")).otherwise(lists("1", "2", "3"))
    asked = F.when(c % 5 == 0, none).when(c % 5 == 1, lists("2")).when(c % 5 == 2, lists("2", "3")).otherwise(lists("4"))
    scope = lambda docs, user, closed: F.struct(user.alias("user_id"), F.lit("g").alias("generation"), closed.alias("match_none"), none.alias("search_types"), docs.alias("document_ids"), F.lit(None).cast("array<string>").alias("content_types"))
    ok = G.narrowed_only(scope(mine, F.lit("u"), k % 19 == 0), scope(asked, F.when(c % 3 == 2, "v").otherwise("u"), k % 17 == 0))
    return o.select("o_orderkey", ok.alias("allowed"))


@query("gold_load", """WITH c AS (SELECT o_orderkey AS case_id, 's' || (o_orderkey % 29 = 0)::INT AS snapshot, o_custkey AS user_id FROM orders UNION ALL SELECT o_orderkey, 's0', o_custkey FROM orders WHERE o_orderkey % 31 = 0),
t AS (SELECT case_id, count(*) AS n, max((snapshot <> 's0')::INT) AS other, min(user_id) AS user_id FROM c GROUP BY case_id),
f AS (SELECT l_orderkey AS case_id, max((l_linenumber = 6)::INT) AS fact, max((l_partkey % 23 = 0 OR l_linenumber = 6)::INT) AS chunk FROM lineitem GROUP BY ALL)
SELECT case_id, CASE WHEN n > 1 THEN 'repeated' WHEN other = 1 THEN 'another corpus or user' WHEN case_id % 37 = 0 THEN 'source differs' WHEN fact = 1 THEN 'fact without source' WHEN chunk = 1 THEN 'foreign or missing chunk' END AS problem
FROM t LEFT JOIN f USING (case_id) WHERE n > 1 OR other = 1 OR case_id % 37 = 0 OR fact = 1 OR chunk = 1""")
def gold_load(spark, d):
    """Orders as cases whose facts are their line items; some break each rule."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    one = o.select(F.col("o_orderkey").alias("case_id"), F.when(F.col("o_orderkey") % 29 == 0, "s1").otherwise("s0").alias("snapshot_id"), F.col("o_custkey").alias("user_id"))
    cases = one.union(one.where("case_id % 31 = 0").withColumn("snapshot_id", F.lit("s0"))).select("*", F.lit("s0").alias("wanted_snapshot"), F.col("user_id").alias("wanted_user"))
    docs = o.select(F.col("o_orderkey").alias("version_id"), F.unhex(F.md5(F.col("o_orderkey").cast("string"))).alias("hash"))
    sources = docs.select(F.col("version_id").alias("case_id"), "version_id", F.when(F.col("version_id") % 37 == 0, F.lit(b"x")).otherwise(F.col("hash")).alias("hash"))
    lines = li.select(F.col("l_orderkey").alias("case_id"), "l_linenumber", "l_partkey")
    chunk = F.concat_ws(":", F.col("case_id").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("chunk_id")
    named = lines.select("case_id", F.when(F.col("l_linenumber") == 6, -1).otherwise(F.col("case_id")).alias("version_id"), chunk)
    mine = lines.where("l_partkey % 23 <> 0").join(o.select(F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("user_id")), "case_id").distinct()
    chunks = mine.select(chunk, "user_id", F.col("case_id").alias("version_id"))
    return G.gold_problems(cases, sources, named, docs, chunks)


@query("answer_tail", "SELECT user_id AS epoch, event_id AS seq, event_type FROM events WHERE user_id > 7 OR (user_id = 7 AND event_id > 400) ORDER BY user_id, event_id LIMIT 100")
def answer_tail(spark, d):
    """The next hundred pieces behind the last that a reader has."""
    return G.answer_tail(table(spark, d, "events").select(F.col("user_id").alias("epoch"), F.col("event_id").alias("seq"), "event_type"), (7, 400))


#: Users' turns about nations: some name one, some ask for their own company, some do both.
_QUESTIONS = """n AS (SELECT n_nationkey, n_name FROM nation),
q AS (SELECT conv_id * 100 + turn AS id, conv_id % 40 AS owner, conv_id % 3 AS kind, (conv_id + turn) % 25 AS about FROM conversations WHERE role = 'user'),
p AS (SELECT o AS owner, CASE o % 4 WHEN 1 THEN [] WHEN 2 THEN [a.n_name] WHEN 3 THEN [a.n_name, b.n_name] END AS companies, CASE WHEN o % 8 < 4 THEN 'staff' END AS population FROM (SELECT unnest(range(40)) AS o) r JOIN n a ON a.n_nationkey = o % 25 JOIN n b ON b.n_nationkey = (o + 1) % 25 WHERE o % 4 > 0)"""


def _questions(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("about"), "n_name")
    q = table(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), (F.col("conv_id") % 40).alias("owner"), (F.col("conv_id") % 3).alias("kind"), ((F.col("conv_id") + F.col("turn")) % 25).alias("about"))
    name = F.concat(F.lit(" of "), "n_name", F.lit(" now"))
    text = F.when(F.col("kind") == 0, F.concat(F.lit("what"), name)).when(F.col("kind") == 1, F.lit("我们公司 and its rules")).otherwise(F.concat(F.lit("我们公司"), name))
    questions = q.join(n, "about").select("id", "owner", text.alias("text"))
    a, b = n.select(F.col("about").alias("_a"), F.col("n_name").alias("_one")), n.select(F.col("about").alias("_b"), F.col("n_name").alias("_two"))
    o = table(spark, d, "customer").select((F.col("c_custkey") % 40).alias("owner")).distinct().where("owner % 4 > 0")
    o = o.join(a, F.col("_a") == F.col("owner") % 25).join(b, F.col("_b") == (F.col("owner") + 1) % 25)
    companies = F.when(F.col("owner") % 4 == 1, F.array().cast("array<string>")).when(F.col("owner") % 4 == 2, F.array("_one")).otherwise(F.array("_one", "_two"))
    profiles = o.select("owner", companies.alias("companies"), F.when(F.col("owner") % 8 < 4, "staff").alias("population"))
    directory = n.select(F.col("n_name").alias("alias"), F.lit("company").alias("field"), F.col("n_name").alias("value"))
    return questions, profiles, directory


@query("business_scope", f"""WITH {_QUESTIONS}, s AS (SELECT id, q.owner, kind > 0 AS own, CASE WHEN kind <> 1 THEN n_name END AS said, companies, population, coalesce(len(companies), 0) AS has FROM q JOIN n ON n_nationkey = about LEFT JOIN p ON p.owner = q.owner),
t AS (SELECT *, own AND has = 1 AND (said IS NULL OR said = companies[1]) AS takes FROM s)
SELECT id, CASE WHEN NOT own THEN 'resolved' WHEN said IS NULL AND has = 0 THEN 'unresolved' WHEN said IS NULL AND has <> 1 THEN 'ambiguous' WHEN takes AND (said IS NULL OR population IS NOT NULL) THEN 'defaulted' ELSE 'resolved' END AS status,
  array_to_string(list_filter([CASE WHEN said IS NOT NULL THEN 'company:' || said || ':explicit_user' WHEN takes THEN 'company:' || companies[1] || ':trusted_profile' END, CASE WHEN takes AND population IS NOT NULL THEN 'population:' || population || ':trusted_profile' END], lambda x: x IS NOT NULL), ' ') AS scope FROM t""")
def business_scope(spark, d):
    """Names by the directory, defaults by the asker's own profile."""
    questions, profiles, directory = _questions(spark, d)
    out = S.scoped(questions, S.mentioned_names(questions, directory, "id", "text"), profiles, "id", "owner", "text")
    return out.select("id", "status", F.array_join(F.transform("scope", lambda x: F.concat_ws(":", x["field"], x["value"], x["source_kind"])), " ").alias("scope"))


@query("business_coverage", f"""WITH {_QUESTIONS}, c AS (SELECT c_custkey % 40 AS owner, c_custkey AS document_id, n_name AS company, c_custkey % 2 AS revision, c_custkey % 40 % 5 <> 4 AS complete FROM customer JOIN n ON n_nationkey = c_nationkey)
SELECT q.id, c.document_id FROM q JOIN n ON n_nationkey = about AND kind <> 1 JOIN c ON c.owner = q.owner AND c.company = n_name WHERE complete AND revision = q.owner % 2 AND q.owner % 7 <> 0""")
def business_coverage(spark, d):
    """The documents that cover the companies named, as far as their owners' coverage is whole and current."""
    questions, _, directory = _questions(spark, d)
    names = S.mentioned_names(questions, directory, "id", "text").join(questions.select("id", "owner"), "id").select("id", "owner", F.col("value").alias("company"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("company"))
    c = table(spark, d, "customer").join(n, "c_nationkey").select((F.col("c_custkey") % 40).alias("owner"), F.lit("g").alias("generation"), (F.col("c_custkey") % 2).alias("revision"), (F.col("c_custkey") % 40 % 5 != 4).alias("complete"), F.col("c_custkey").alias("document_id"), "company")
    binding = c.select("owner").distinct().select("owner", F.when(F.col("owner") % 7 == 0, "old").otherwise("g").alias("generation"), (F.col("owner") % 2).alias("revision"))
    return S.covered_documents(names, c, binding, "id")
