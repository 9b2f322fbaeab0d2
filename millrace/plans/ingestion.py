"""Ingestion: files in batches of pages, strict JSON lines, proof of annotated evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import spans
from millrace.plans.base import table
from millrace.sources import jsonlines, parsing
from millrace.sources.tables import fresh

QUERIES, ORACLE = {}, {}


def query(name, sql):
    def add(f):
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return add


@query("file_batches", r"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS page, len(lines) AS pages FROM d),
b AS (SELECT *, trim(line, chr(32) || chr(9) || chr(13) || chr(10) || chr(11) || chr(12)) AS block FROM p),
n AS (SELECT *, sum((block <> '')::INT) OVER (PARTITION BY doc_id ORDER BY page) AS upto FROM b)
SELECT doc_id, (page - 1) // 5 + 1 AS batch_no, min(page) AS page_from, max(page) AS page_to, count(*) FILTER (block <> '') AS blocks, min(CASE WHEN block <> '' THEN upto - 1 END)::BIGINT AS first_ref,
  md5(coalesce(string_agg(CASE WHEN block <> '' THEN page || ':' || block END, chr(10) ORDER BY page), '')) AS digest, NULL AS problem FROM n WHERE doc_id % 50 <> 7 AND pages <= 2000 GROUP BY doc_id, (page - 1) // 5
UNION ALL SELECT doc_id, NULL, NULL, NULL, 0, NULL, md5(''), CASE WHEN doc_id % 50 = 7 THEN 'failed the integrity check' ELSE 'too many pages' END FROM d WHERE doc_id % 50 = 7 OR len(lines) > 2000""")
def file_batches(spark, d):
    """Documents as files whose lines are pages, five a batch; one file in fifty isn't what its hash says."""
    docs = table(spark, d, "documents").where("text is not null")
    content = F.encode(F.translate("text", "\n", "\x0c"), "UTF-8")
    files = docs.select("doc_id", content.alias("content"), F.octet_length(content).cast("long").alias("size"), F.when(F.col("doc_id") % 50 == 7, "0").otherwise(F.sha2(content, 256)).alias("sha256"))
    out = parsing.parsed(files, ["doc_id"], 5)
    lines = F.transform("blocks", lambda b: F.concat(b["page_no"].cast("string"), F.lit(":"), b["text"]))
    first = F.regexp_extract(F.try_element_at("blocks", F.lit(1))["ref"], r"(\d+)$", 1)
    whole = lambda c: F.col(c).cast("long").alias(c)
    return out.select(
        "doc_id", whole("batch_no"), whole("page_from"), whole("page_to"), F.coalesce(F.size(F.filter("blocks", lambda b: b.isNotNull())), F.lit(0)).cast("long").alias("blocks"),
        F.when(first != "", first.cast("long")).alias("first_ref"), F.md5(F.coalesce(F.array_join(lines, "\n"), F.lit(""))).alias("digest"), "problem",
    )


_LINES = "CASE o_orderkey % 100 WHEN 1 THEN '' WHEN 2 THEN '{\"id\": ' || o_orderkey WHEN 3 THEN '{\"id\": ' || o_orderkey || ', \"x\": NaN}' WHEN 4 THEN '[' || o_orderkey || ']' WHEN 5 THEN '{\"id\": ' || o_orderkey || ', \"a\": {\"b\": 1, \"b\": 2}}' WHEN 6 THEN '{\"id\": ' || o_orderkey || ', \"a\": [{\"raw_prompt\": 1}]}' WHEN 7 THEN '{\"id\": ' || (o_orderkey - 7) || '}' WHEN 8 THEN '{\"no\": 1}' ELSE '{\"id\": ' || o_orderkey || ', \"p\": \"' || o_orderpriority || '\"}' END"


@query("json_line_problems", f"""WITH l AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS line, {_LINES} AS value FROM orders),
k AS (SELECT *, CASE o_orderkey % 100 WHEN 1 THEN 'blank row' WHEN 2 THEN 'not JSON' WHEN 3 THEN 'non-finite value' WHEN 4 THEN 'not an object' WHEN 5 THEN 'repeated key' WHEN 6 THEN 'unsafe key' WHEN 8 THEN 'no key' END AS own,
  CASE WHEN o_orderkey % 100 = 7 THEN o_orderkey - 7 ELSE o_orderkey END AS id FROM l)
SELECT line, md5(value) AS value, coalesce(own, 'repeated id') AS problem FROM (SELECT *, row_number() OVER (PARTITION BY own IS NULL, id ORDER BY line) AS nth FROM k) WHERE own IS NOT NULL OR nth > 1""")
def json_line_problems(spark, d):
    """Orders written as JSON lines, some of them bad in each way, in files that go on where the one before ends, and what
    is found in them by number."""
    o, path = table(spark, d, "orders"), fresh(spark, "lines")
    o.select("o_orderkey", F.expr(_LINES).alias("value")).repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey").select("value").write.text(path)
    rows = jsonlines.judged_lines(jsonlines.numbered_lines(spark, path, through=True), "id", jsonlines.UNSAFE)
    return rows.where("problem is not null").select("line", F.md5("value").alias("value"), "problem")


@query("sufficiency_proof", """WITH li AS (SELECT l_orderkey AS fact, l_linenumber AS member, min(l_partkey) AS low, max(l_partkey + (l_quantity * 20)::BIGINT) AS high FROM lineitem GROUP BY ALL),
f AS (SELECT fact, min(low) AS low, min(low) + 900 AS high FROM li GROUP BY fact),
ways AS (SELECT fact, member AS without FROM li UNION ALL SELECT fact, 0 FROM f),
m AS (SELECT w.fact, w.without, f.low AS a, f.high AS b, li.low, li.high FROM ways w JOIN f ON f.fact = w.fact JOIN li ON li.fact = w.fact AND li.member <> w.without AND li.high > f.low AND li.low < f.high),
g AS (SELECT *, coalesce(max(high) OVER (PARTITION BY fact, without ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a) AS reach FROM m),
p AS (SELECT fact, without, max(greatest(low, a)) FILTER (low > reach) IS NULL AND max(high) >= any_value(b) AS proven FROM g GROUP BY fact, without),
r AS (SELECT w.fact, w.without, coalesce(p.proven, false) AS proven FROM ways w LEFT JOIN p ON p.fact = w.fact AND p.without = w.without)
SELECT fact, bool_or(proven) FILTER (without = 0) AS sufficient, count(*) FILTER (without > 0 AND NOT proven) AS needed, count(*) FILTER (without > 0) AS members FROM r GROUP BY fact""")
def sufficiency_proof(spark, d):
    """Whether each fact's annotated members cover its range, and how many of them it can't do without."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("fact"), F.col("l_linenumber").alias("member"))
    members = li.agg(F.min("l_partkey").alias("low"), F.max(F.col("l_partkey") + F.round(F.col("l_quantity") * 20).cast("long")).alias("high"))
    facts = members.groupBy("fact").agg(F.min("low").alias("low"), (F.min("low") + 900).alias("high"))
    return spans.proven(facts, members, "fact", "member")
