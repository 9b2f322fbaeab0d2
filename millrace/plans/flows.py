"""Document dataflow, sources and streams."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators import documents as D
from millrace.operators.outline import outlined
from millrace.plans.base import table
from millrace.sources import readers
from millrace.sources.tables import fresh
from millrace.streaming import operators as S
from millrace.streaming.leases import leased, with_rocksdb

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


@query("reading_order", "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, coalesce(CASE WHEN l_suppkey % 2 = 0 THEN l_suppkey END, l_partkey), l_partkey) - 1 AS block_index FROM lineitem")
def reading_order(spark, d):
    li = table(spark, d, "lineitem").withColumn("reading", F.when(F.col("l_suppkey") % 2 == 0, F.col("l_suppkey")))
    out = D.in_reading_order(li, "l_orderkey", "l_linenumber", "reading", "l_partkey")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.col("block_index").cast("long").alias("block_index"))


@query("label_kinds", "SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'heading' WHEN 'STANDARD' THEN 'table' ELSE 'paragraph' END AS kind FROM part")
def label_kinds(spark, d):
    label = F.when(F.col("p_type") == "ECONOMY", "title").when(F.col("p_type") == "STANDARD", "table").otherwise(F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", D.kind_of(label).alias("kind"))


#: Users' events as the blocks of a document, four a page: views are footers, errors rows of numbered tables.
_BLOCKS = """b AS (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) + 3) // 4 AS page, CASE event_type WHEN 'error' THEN 'table' WHEN 'signup' THEN 'heading' ELSE 'paragraph' END AS kind,
  CASE WHEN event_type = 'view' THEN 'footer' END AS role, CASE WHEN event_id % 3 = 0 THEN 'part ' || event_id || '-' ELSE event_id || ' of it' END AS text, value < 25 AS opens, value > 5 AS goes_on, CASE WHEN event_type = 'error' THEN user_id % 3 END AS tab FROM events)"""


@query("cross_page_join", f"""WITH {_BLOCKS},
n AS (SELECT *, CASE WHEN role IS NULL AND kind IN ('paragraph', 'table') AND lag(kind) OVER w = kind AND page BETWEEN lag(page) OVER w AND lag(page) OVER w + 1 AND ((lag(goes_on) OVER w AND opens) OR (kind = 'table' AND lag(tab) OVER w = tab)) THEN 0 ELSE 1 END AS fresh FROM b WINDOW w AS (PARTITION BY user_id, role IS NULL ORDER BY event_id)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, role IS NULL ORDER BY event_id) AS run FROM n),
s AS (SELECT *, CASE WHEN lag(event_id) OVER w IS NULL THEN '' WHEN kind = 'table' THEN chr(10) WHEN regexp_matches(lag(text) OVER w, '[0-9A-Za-z]$') AND regexp_matches(text, '^[0-9A-Za-z]') THEN ' ' ELSE '' END AS gap FROM r WINDOW w AS (PARTITION BY user_id, role IS NULL, run ORDER BY event_id))
SELECT user_id, min(event_id) AS event_id, min_by(kind, event_id) AS kind, min(page) AS page_from, max(page) AS page_to, string_agg(gap || text, '' ORDER BY event_id) AS text, count(*) AS parts FROM s GROUP BY user_id, role IS NULL, run""")
def cross_page_join(spark, d):
    e = table(spark, d, "events").withColumn("page", F.floor((F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) + 3) / 4))
    kind = F.when(F.col("event_type") == "error", "table").when(F.col("event_type") == "signup", "heading").otherwise("paragraph")
    i = F.col("event_id").cast("string")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("part "), i, F.lit("-"))).otherwise(F.concat(i, F.lit(" of it")))
    rows = e.select("user_id", "event_id", "page", kind.alias("kind"), F.when(F.col("event_type") == "view", "footer").alias("role"), text.alias("text"), (F.col("value") < 25).alias("opens"), (F.col("value") > 5).alias("goes_on"), F.when(F.col("event_type") == "error", F.col("user_id") % 3).alias("tab"))
    return D.joined_across_pages(rows, "user_id", "event_id", "page", "kind", "text", "opens", "goes_on", "tab", "role")


#: Lines of a source's documents as blocks, the first and last of a page as header and footer.
_LINES = """lines AS (SELECT source, doc_id AS page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n, len(string_split(text, chr(10))) AS m FROM documents),
keyed AS (SELECT *, CASE WHEN n = 1 THEN 'header' WHEN n = m THEN 'footer' END AS role, md5(replace(lower(trim(regexp_replace(nfc_normalize(line), '\\s+', ' ', 'g'))), 'ß', 'ss')) AS k FROM lines)"""


@query("furniture_removal", f"WITH {_LINES}, o AS (SELECT source, role, k FROM keyed WHERE role IS NOT NULL GROUP BY ALL HAVING count(DISTINCT page) >= 2) SELECT page, count(*) AS lines, md5(string_agg(md5(line), '' ORDER BY md5(line))) AS h FROM keyed WHERE role IS NULL OR (source, role, k) NOT IN (SELECT (source, role, k) FROM o) GROUP BY page")
def furniture_removal(spark, d):
    lines = table(spark, d, "documents").select("source", F.col("doc_id").alias("page"), F.split("text", "\n").alias("all"))
    lines = lines.select("source", "page", F.size("all").alias("m"), F.posexplode("all").alias("n", "line"))
    role = F.when(F.col("n") == 0, "header").when(F.col("n") == F.col("m") - 1, "footer")
    out = D.without_furniture(lines.select("source", "page", "line", role.alias("role")), "source", "page", "line", "role")
    return out.groupBy("page").agg(F.count(F.lit(1)).alias("lines"), F.md5(F.array_join(F.array_sort(F.collect_list(F.md5("line"))), "")).alias("h"))


@query("near_page_edge", "SELECT l_orderkey, l_linenumber, l_quantity <= 50 * 0.15 OR l_quantity + 5 >= 50 * (1 - 0.15) AS edge FROM lineitem")
def near_page_edge(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", D.near_edge(q, q + 5, F.lit(50.0)).alias("edge"))


@query("section_ranges", "WITH h AS (SELECT o_custkey, o_orderkey AS start, (o_orderkey % 3 + 1)::INT AS lv FROM orders WHERE o_orderpriority <> '5-LOW') SELECT a.o_custkey, a.start, a.lv, min(b.start) AS \"end\" FROM h a LEFT JOIN h b ON a.o_custkey = b.o_custkey AND b.start > a.start AND b.lv <= a.lv GROUP BY ALL")
def section_ranges(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderpriority") != "5-LOW", (F.col("o_orderkey") % 3 + 1).cast("int")).alias("level"))
    out = outlined(o.withColumn("text", F.lit("")), "o_custkey", "o_orderkey", "level", "text", repair=False, paths=False)
    return out.select("o_custkey", F.col("o_orderkey").alias("start"), F.col("level").alias("lv"), "end")


@query("table_layout", "WITH t AS (SELECT o_orderkey, o_orderstatus || ' | ' || o_orderpriority AS line FROM orders) SELECT o_orderkey, 2 AS row, c AS column, trim(split_part(line, '|', c + 1)) AS cell FROM t, range(0, 2) r(c) UNION ALL SELECT o_orderkey, 0, c, CASE c WHEN 0 THEN 'a' ELSE 'b' END FROM t, range(0, 2) r(c)".replace("c AS column", 'c::INT AS "column"').replace("0, c, CASE", "0, c::INT, CASE"))
def table_layout(spark, d):
    body = F.concat(F.lit("| a | b |\n|---|---|\n| "), "o_orderstatus", F.lit(" | "), "o_orderpriority", F.lit(" |"))
    return D.table_cells(table(spark, d, "orders").select("o_orderkey", body.alias("t")), "o_orderkey", "t")


@query("locator_clip", "SELECT l_orderkey, l_linenumber, greatest(l_partkey, 500) AS start, least(l_partkey + l_quantity::BIGINT * 10, 1500) AS \"end\" FROM lineitem WHERE greatest(l_partkey, 500) < least(l_partkey + l_quantity::BIGINT * 10, 1500)")
def locator_clip(spark, d):
    c = D.clipped(F.col("l_partkey"), F.col("l_partkey") + F.col("l_quantity").cast("long") * 10, F.lit(500).cast("long"), F.lit(1500).cast("long"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", c.alias("c")).where("c is not null").select("l_orderkey", "l_linenumber", "c.start", "c.end")


@query("locator_resolve", """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL), b AS (SELECT doc_id, unnest(lines) AS text, generate_subscripts(lines, 1) - 1 AS block FROM l),
p AS (SELECT doc_id, block // 3 AS parent, string_agg(CASE WHEN block % 3 = 0 THEN '' ELSE chr(10) || chr(10) END || left(text, 80), '' ORDER BY block) AS text, count(*) AS n FROM b GROUP BY ALL)
SELECT doc_id, parent, CASE WHEN problem IS NULL THEN md5(text) END AS text, problem FROM (SELECT *, CASE WHEN doc_id % 10 = 3 THEN 'another block' WHEN doc_id % 10 = 5 THEN 'beyond the block' END AS problem FROM p)
UNION ALL SELECT doc_id, -1, NULL, 'no such block' FROM l WHERE doc_id % 10 = 7""")
def locator_resolve(spark, d):
    """Parents of three lines each give back their text by their spans; some spans are off."""
    lines = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("block", "text"))
    blocks = lines.withColumn("id", F.md5(F.concat_ws(":", F.col("block").cast("string"), "text")))
    kept, m, none = F.least(F.length("text"), F.lit(80)), F.col("doc_id") % 10, F.lit(None).cast("int")
    spans = blocks.select(
        "doc_id", F.floor(F.col("block") / 3).alias("parent"), F.col("block").alias("n"), "block", F.when(m == 3, "x").otherwise(F.col("id")).alias("block_id"), F.lit(0).alias("start"), (kept + F.when(m == 5, F.length("text") + 1).otherwise(0)).alias("end"),
        none.alias("row_from"), none.alias("row_to"), none.alias("header_rows"), F.when(F.col("block") % 3 == 0, "").otherwise("\n\n").alias("separator"),
    )
    lost = table(spark, d, "documents").where("text is not null and doc_id % 10 = 7").select("doc_id", F.lit(-1).cast("long"), F.lit(0), F.lit(-1), F.lit("x"), F.lit(0), F.lit(1), none, none, none, F.lit(""))
    return D.resolved(spans.union(lost), blocks, "doc_id", "parent").select("doc_id", "parent", F.md5("text").alias("text"), "problem")


def _blocks(spark, d):
    b = readers.parsed_pages(table(spark, d, "pages"), "page_id")
    return b.select("page_id", "block_index", D.kind_of(F.col("label")).alias("kind"), "level", "text")


@query("page_parser")
def page_parser(spark, d):
    return readers.parsed_pages(table(spark, d, "pages"), "page_id")


@query("chunking")
def chunking(spark, d):
    """Pages to blocks to parents to children."""
    return D.chunked(_blocks(spark, d).where("kind <> 'furniture'"), "page_id")


#: Line items as blocks of a page of their order: a square of 30 each, its place by quantity and discount.
_BOXES = "b AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i, l_returnflag AS text, floor(l_quantity / 4)::BIGINT AS x, round(l_discount * 20)::BIGINT AS y FROM lineitem)"


@query("overlaid_removal", f"""WITH RECURSIVE {_BOXES},
f AS (SELECT page, 0::BIGINT AS i, false AS keeps, []::STRUCT(t VARCHAR, x BIGINT, y BIGINT)[] AS kept FROM (SELECT DISTINCT page FROM b)
  UNION ALL SELECT page, i, new, CASE WHEN new THEN list_append(kept, {{'t': text, 'x': x, 'y': y}}) ELSE kept END FROM (SELECT f.page, b.i, b.text, b.x, b.y, f.kept,
    len(list_filter(f.kept, lambda k: k.t = b.text AND (greatest(0, 30 - abs(k.x - b.x)) * greatest(0, 30 - abs(k.y - b.y)))::DOUBLE / (1800 - greatest(0, 30 - abs(k.x - b.x)) * greatest(0, 30 - abs(k.y - b.y))) >= 0.8)) = 0 AS new
    FROM f JOIN b ON b.page = f.page AND b.i = f.i + 1) u)
SELECT page, i AS block FROM f WHERE i > 0 AND keeps""")
def overlaid_removal(spark, d):
    """Blocks of the same text that lie over a kept one go; the order decides which."""
    n = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")).cast("long")
    x, y = F.floor(F.col("l_quantity") / 4).cast("double"), F.round(F.col("l_discount") * 20).cast("double")
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), n.alias("block"), F.col("l_returnflag").alias("text"), F.array(x, y, x + 30, y + 30).alias("box"))
    return D.without_overlaid(b.withColumn("doc", F.lit(1)), "doc", "page", "block", "text", "box").select("page", "block")


#: Lines of documents as blocks: short ones without a full stop are headings of a level by their length.
_PIECES = """l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, unnest(lines) AS text, generate_subscripts(lines, 1) AS i0 FROM l),
b AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY i0) AS i, length(text) < 60 AND NOT ends_with(text, '.') AS head, length(text) % 3 + 1 AS level, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS n FROM u WHERE regexp_matches(text, '[^\\x20\\x09-\\x0D]'))"""


@query("parents_and_children", f"""WITH RECURSIVE {_PIECES},
f AS (SELECT doc_id, 0::BIGINT AS i, 0 AS parent, 0::BIGINT AS size, 0 AS parts, false AS body, 0 AS last, []::VARCHAR[] AS path, false AS shut FROM (SELECT DISTINCT doc_id FROM b)
  UNION ALL
  SELECT doc_id, i, CASE WHEN fresh OR parent = 0 THEN parent + 1 ELSE parent END, CASE WHEN fresh THEN n ELSE size + n END, CASE WHEN fresh THEN 1 ELSE parts + 1 END, CASE WHEN fresh THEN NOT head ELSE body OR NOT head END,
    CASE WHEN head THEN least(level, last + 1) ELSE last END, CASE WHEN head THEN list_append(path[1:least(level, last + 1) - 1], text) ELSE path END, beyond AND NOT filled AND NOT cut
  FROM (SELECT *, parts > 0 AND (cut OR filled OR shut) AS fresh FROM (SELECT f.doc_id, b.i, f.parent, f.size, f.parts, f.body, f.last, f.path, f.shut, b.text, b.head, b.level, b.n,
      b.head AND f.body AS cut, f.parts > 0 AND f.size + b.n > 1800 AS beyond, f.size + b.n > 1800 AND NOT (f.size < 1200 AND f.size + b.n <= 2400) AS filled FROM f JOIN b ON b.doc_id = f.doc_id AND b.i = f.i + 1) x) y),
p AS (SELECT f.doc_id, f.parent, sum(b.n) AS words, count(*) AS blocks, len(list_filter(regexp_extract_all(array_to_string(max_by(f.path, f.i), ' > '), '[^\\x20\\x09-\\x0D]+'), lambda t: true)) AS heading, md5(array_to_string(max_by(f.path, f.i), ' > ')) AS path FROM f JOIN b ON b.doc_id = f.doc_id AND b.i = f.i WHERE f.i > 0 GROUP BY f.doc_id, f.parent)
SELECT doc_id, (parent - 1)::BIGINT AS parent_no, words::BIGINT AS words, ceil(words / greatest(1, 384 - heading))::BIGINT AS children, path FROM p""")
def parents_and_children(spark, d):
    """Documents' lines put together to parents, and how many children of 384 tokens, heading path included, each has."""
    word = r"[^\x20\x09-\x0D]"
    lines = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_index", "text")).where(F.col("text").rlike(word))
    head = (F.length("text") < 60) & ~F.endswith("text", F.lit("."))
    blocks = lines.select("doc_id", "block_index", F.when(head, "heading").otherwise("paragraph").alias("kind"), F.when(head, F.length("text") % 3 + 1).alias("level"), "text")
    out = D.chunked(blocks, "doc_id")
    words = F.regexp_count(F.col("content"), F.lit(word + "+"))
    return out.groupBy("doc_id", F.col("parent_no").cast("long").alias("parent_no")).agg(F.sum(words).cast("long").alias("words"), F.count(F.lit(1)).alias("children"), F.md5(F.array_join(F.first("heading_path"), " > ")).alias("path"))


def _stream(spark, d):
    """The events table, a file or a folder, as a stream with its batch schema."""
    return spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")


def _log(spark, d, most: int = 4000, files: int = 250):
    """The events as a log of messages, `most` a file, and a stream of it, `files` a micro-batch: what a batch costs by
    itself, some ten jobs' start and the state of all before it, is paid once a million messages."""
    events = table(spark, d, "events")
    path = fresh(spark, "messages")
    S.message_log(events, path, "event_id", most)
    return S.consumed(spark, path, events.schema, files)


@query("stream_publish_once", "SELECT DISTINCT user_id, event_type FROM events")
def stream_publish_once(spark, d):
    s = _stream(spark, d).withColumn("k", F.concat_ws(":", F.col("user_id").cast("string"), "event_type"))
    return S.drained(S.published_once(s, "k").select("user_id", "event_type"))


@query("stream_projection", "SELECT user_id, count(*) AS events, count_if(event_type = 'error') AS errors, max_by(event_type, event_id) AS last_type, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def stream_projection(spark, d):
    s = _stream(spark, d).select("user_id", "event_id", "event_type", "value")
    got = S.drained(S.projected(s), mode="update")
    last = got.groupBy("user_id").agg(F.max_by(F.struct("events", "errors", "last_type", "total"), "batch").alias("m"))
    return last.select("user_id", "m.events", "m.errors", "m.last_type", F.round("m.total", 4).alias("total"))


@query("stream_windows", "SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(spark, d):
    s = _stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    got = S.drained(S.windowed(s, "ts", "6 hours", "1 day", "event_type"), mode="complete")
    return got.select(F.unix_micros("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_consumption", "SELECT event_id, user_id, event_type, value FROM events")
def stream_consumption(spark, d):
    """Every message once, through micro-batches of a bounded number."""
    return S.drained(_log(spark, d).select("event_id", "user_id", "event_type", "value"))


@query("stream_dead_letters", """WITH dead AS (SELECT user_id, min(event_id // 4000) AS first FROM events WHERE event_type = 'error' GROUP BY user_id)
SELECT 'good' AS kind, user_id, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY user_id UNION ALL SELECT 'dead', user_id, 1 FROM dead""")
def stream_dead_letters(spark, d):
    """Users whose messages fail are dead letters once, in however many batches they fail; the rest goes on."""
    good, dead = fresh(spark, "good"), fresh(spark, "dead")
    S.split_dead(_log(spark, d), F.col("event_type") == "error", good, dead, fresh(spark, "dead-checkpoint"), "user_id").awaitTermination()
    counted = lambda path, kind: spark.read.parquet(path).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "user_id", "n")
    return counted(good, "good").union(counted(dead, "dead"))


#: Ten items of three days for each user; views claim, errors complete, the rest are heartbeats by one of three tokens.
_LEASE_EVENTS = """e AS (SELECT user_id * 100 + (epoch_us(ts) // 1000 - 1704067200000) // 259200000 AS item, event_id AS event, epoch_us(ts) // 1000 AS millis,
 CASE event_type WHEN 'view' THEN 'claim' WHEN 'error' THEN 'complete' ELSE 'heartbeat' END AS kind, 'w' || event_id % 2 AS owner, event_id % 3 + 1 AS token, 43200000 AS lasts,
 1704067200000 + (epoch_us(ts) // 1000 - 1704067200000) // 259200000 * 259200000 + 216000000 AS deadline FROM events),
 n AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY millis, event) AS nth FROM e), mark AS (SELECT max(millis) - 3600000 AS mark FROM e)"""


@query("stream_leases", f"""WITH RECURSIVE {_LEASE_EVENTS},
 s AS (SELECT item, 0::BIGINT AS nth, NULL::BIGINT AS event, NULL::BIGINT AS millis, NULL::VARCHAR AS outcome, NULL::VARCHAR AS who, NULL::BIGINT AS shown, NULL::BIGINT AS ends,
   'idle' AS status, NULL::VARCHAR AS owner, 0::BIGINT AS token, 0::BIGINT AS until, 0::BIGINT AS attempts, NULL::VARCHAR AS ran_out, NULL::BIGINT AS out_at, NULL::VARCHAR AS out_owner, NULL::BIGINT AS out_token FROM (SELECT DISTINCT item FROM n)
 UNION ALL
 SELECT x.item, x.nth, x.event, x.millis,
   CASE WHEN x.kind = 'claim' THEN CASE WHEN now = 'idle' AND deadline > x.millis THEN 'granted' ELSE 'refused' END WHEN NOT mine THEN 'stale' WHEN x.kind = 'heartbeat' THEN 'extended' ELSE 'completed' END,
   x.who, CASE WHEN x.kind = 'claim' THEN CASE WHEN now = 'idle' AND deadline > x.millis THEN x.token + 1 END ELSE x.says END,
   CASE WHEN (x.kind = 'claim' AND now = 'idle' AND deadline > x.millis) OR (x.kind = 'heartbeat' AND mine) THEN least(x.millis + lasts, deadline) END,
   CASE WHEN x.kind = 'claim' AND now = 'idle' AND deadline > x.millis THEN 'running' WHEN x.kind = 'complete' AND mine THEN 'completed' ELSE now END,
   CASE WHEN x.kind = 'claim' AND now = 'idle' AND deadline > x.millis THEN x.who ELSE x.owner END,
   CASE WHEN x.kind = 'claim' AND now = 'idle' AND deadline > x.millis THEN x.token + 1 ELSE x.token END,
   CASE WHEN (x.kind = 'claim' AND now = 'idle' AND deadline > x.millis) OR (x.kind = 'heartbeat' AND mine) THEN least(x.millis + lasts, deadline) ELSE x.until END,
   CASE WHEN x.kind = 'claim' AND now = 'idle' AND deadline > x.millis THEN x.attempts + 1 ELSE x.attempts END,
   CASE WHEN over THEN CASE WHEN x.attempts >= 3 THEN 'failed' ELSE 'expired' END END, CASE WHEN over THEN x.until END, CASE WHEN over THEN x.owner END, CASE WHEN over THEN x.token END
 FROM (SELECT s.item, n.nth, n.event, n.millis, n.kind, n.owner AS who, n.token AS says, n.lasts, n.deadline, s.owner, s.token, s.until, s.attempts,
   s.status = 'running' AND s.until <= n.millis AS over,
   CASE WHEN s.status = 'running' AND s.until <= n.millis THEN CASE WHEN s.attempts >= 3 THEN 'failed' ELSE 'idle' END ELSE s.status END AS now,
   s.status = 'running' AND s.until > n.millis AND s.owner = n.owner AND s.token = n.token AS mine FROM s JOIN n ON n.item = s.item AND n.nth = s.nth + 1) x),
 last AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY item ORDER BY nth DESC) = 1)
SELECT item, event, millis, outcome, who AS owner, shown AS token, ends AS until FROM s WHERE nth > 0
UNION ALL SELECT item, NULL, out_at, ran_out, out_owner, out_token, out_at FROM s WHERE ran_out IS NOT NULL
UNION ALL SELECT item, NULL, until, CASE WHEN attempts >= 3 THEN 'failed' ELSE 'expired' END, owner, token, until FROM last, mark WHERE status = 'running' AND until <= mark""")
def stream_leases(spark, d):
    """Claims, heartbeats and completions of work items, and the expiry of leases that nobody kept."""
    with_rocksdb(spark)
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    window = F.floor((at - 1704067200000) / 259200000)
    kind = F.when(F.col("event_type") == "view", "claim").when(F.col("event_type") == "error", "complete").otherwise("heartbeat")
    s = _stream(spark, d).select(
        (F.col("user_id") * 100 + window).alias("item"), F.col("event_id").alias("event"), at.alias("millis"), kind.alias("kind"), F.concat(F.lit("w"), (F.col("event_id") % 2).cast("string")).alias("owner"),
        (F.col("event_id") % 3 + 1).alias("token"), F.lit(43200000).cast("long").alias("lasts"), (F.lit(1704067200000) + window * 259200000 + 216000000).alias("deadline"), F.col("ts").cast("timestamp").alias("time"),
    )
    return S.drained(leased(s, "time", "1 hour"), "leases")
