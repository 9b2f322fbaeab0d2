"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a row of slots, each of one block of `block` words. Slots get their source from the van
der Corput sequence: its points, one for each value below the number of slots, are mapped through the
cumulative quotas of the sources, so every prefix of the schedule is close to the weights and the
whole meets each quota exactly. Slots are ranked per source; slot r of a source takes block r of that
source's shuffled documents laid end to end (and laid again for a second pass). A source's last block
ends where its target does, in words. Blocks join slots on (source, rank). The schedule is at most SLOTS
rows and a row per source more, blocks a row per document more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.shared import WORD, spare, table, written

#: Whole slots of a schedule at most, besides the last, shorter one of each source: the block grows with
#: the corpus, the schedule doesn't.
SLOTS = 1 << 19
#: Weights, dealt to sources in code-point order, repeating; words of the mix per word of the
#: corpus; passes over a source at most.
WEIGHTS, SHARE, PASSES = (3, 1, 2), 1.5, 2
#: Sources up to which their goals are broadcast; beyond, they are joined by a shuffle.
BROADCAST_SOURCES = 10_000
#: Rows in a range of the shuffle order, about, were all of one source: a source's documents are never sorted
#: in one task.
RANGE = 1 << 14


def n_words(text: Column) -> Column:
    """The number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """sizes(source, source_size) to (source, source_size, target): one row per source.

    Sources share `share` times all words by weight; a target stops at `passes` times its source's
    words and the excess goes to the others by weight. In order of words per weight, the first k
    sources that stop leave a common level for the rest; the first k whose level stops no further
    source is the answer. Null is a source of its own, the last. No words give targets of 0. The sums run
    over one row per source in one task, which is fine for some millions of sources."""
    one = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.row_number().over(one) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", w).withColumn("top", F.col("source_size").cast("double") * passes)
    by = W.orderBy(F.col("top") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    rows = (
        rows.withColumn("left", F.sum(F.col("source_size").cast("double")).over(whole) * share - F.coalesce(F.sum("top").over(before), F.lit(0.0)))
        .withColumn("wide", F.sum("weight").over(by.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", F.col("left") / F.col("wide"))
        .withColumn("free", F.col("level") * F.col("weight") <= F.col("top"))
    )
    level = F.min(F.when(F.col("free"), F.struct(F.col("top") / F.col("weight"), F.col("level")))).over(whole)["level"]
    return rows.select("source", "source_size", F.least(F.coalesce(level, F.lit(float("inf"))) * F.col("weight"), F.col("top")).alias("target"))


def quotas(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES, slots: int = SLOTS) -> DataFrame:
    """targets() with `block`, the words in a block, `end`, the target in whole words (one at least of a
    positive target, and no more than its passes hold), and `quota`, the source's slots, the last of
    which ends at `end`."""
    goals = targets(sizes, weights, share, passes)
    block = F.greatest(F.lit(1), F.ceil(F.sum("target").over(W.partitionBy()) / slots)).cast("long")
    goals = goals.withColumn("block", block)
    end = F.when(F.col("target") > 0, F.greatest(F.round("target"), F.lit(1.0))).otherwise(F.lit(0.0))
    goals = goals.withColumn("end", F.least(end.cast("long"), F.col("source_size") * passes))
    return goals.withColumn("quota", F.ceil(F.col("end") / F.col("block")).cast("long"))


def schedule(goals: DataFrame) -> DataFrame:
    """goals of quotas() to (source, rank, slot): the source of each slot, in order of `slot`, and its
    rank among that source's slots.

    The quotas lie end to end; value v of the van der Corput sequence belongs to the source whose quota
    holds it and comes at place reverse(v), so each v below the sum of quotas comes once."""
    whole, rows = W.partitionBy(), goals
    to = F.sum("quota").over(W.orderBy(F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("upto", to).withColumn("bits", F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(F.sum("quota").over(whole), F.lit(2))))).cast("int"))
    # a quota is opened in parts of 256 values, so that no row makes many
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("quota") - 1) / 256)))
    rows = rows.where("quota > 0").select("*", part.alias("part")).repartition(F.col("upto"), F.col("part"))
    v = F.explode(F.sequence(F.col("part") * 256, F.least(F.col("part") * 256 + 255, F.col("quota") - 1)))
    rows = rows.select("source", "upto", "quota", "bits", v.alias("nth"))
    value = F.col("upto") - F.col("quota") + F.col("nth")
    rows = rows.withColumn("slot", F.conv(F.reverse(F.lpad(F.bin(value), F.col("bits"), "0")), 2, 10).cast("long"))
    # ranks in two levels: whole ranges of slots are counted, slots are numbered within a range
    rows = rows.withColumn("range", F.floor(F.col("slot") / 4096))
    counts = rows.groupBy("source", "range").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(F.col("source").alias("_s"), F.col("range").alias("_r"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rows = rows.join(counts, _same(F.col("source"), F.col("_s")) & (F.col("range") == F.col("_r")))
    rank = F.col("before") + F.row_number().over(W.partitionBy("source", "range").orderBy("slot")) - 1
    return rows.select("source", rank.alias("rank"), "slot")


def shuffled(docs: DataFrame, ranges: int) -> DataFrame:
    """docs(key, source, size, ...) with `at`, the words of the same source before it, in an order
    given by a hash of the key (ties by size). Sums per range of hashes are joined back, so a source
    with a third of all rows is spread over many tasks."""
    rows = docs.withColumn("_h", F.md5(F.coalesce(F.col("key").cast("string"), F.lit("")).cast("binary")))
    rows = rows.withColumn("_range", F.shiftright(F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") * F.lit(ranges), 32))
    sums = rows.groupBy("source", "_range").agg(F.sum("size").alias("n"))
    before = W.partitionBy("source").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_s"), F.col("_range").alias("_r"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    rows = rows.join(sums, _same(F.col("source"), F.col("_s")) & (F.col("_range") == F.col("_r")))
    inner = W.partitionBy("source", "_range").orderBy("_h", "size").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("at", F.col("_before") + F.coalesce(F.sum("size").over(inner), F.lit(0))).drop("_s", "_r", "_before", "_h", "_range")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES, slots: int = SLOTS) -> DataFrame:
    """docs(key, source, size) to (key, source, size, at, source_size, target, pass, taken, first_slot):
    a row for each document and pass; taken is the number of its words in the mix, first_slot where
    they first come (null if nowhere).

    The words taken are those of the slots' blocks that fall in the document; a source's slots have
    ranks from 0 on, so they are a prefix of it. Documents without words are taken 0 times. Rows
    with equal keys are documents of their own. An empty table gives no rows."""
    docs = written(docs.select("key", "source", F.col("size").cast("long").alias("size")), "sizes")
    goals = written(quotas(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, passes, slots), "goals")
    few = goals.count() <= BROADCAST_SOURCES
    goal = goals.select(F.col("source").alias("_g"), "source_size", "target", "block", "end")
    rows = shuffled(docs, min(1 << 20, max(64, docs.count() // RANGE)))
    rows = rows.join(F.broadcast(goal) if few else goal, _same(F.col("source"), F.col("_g"))).drop("_g")
    rows = rows.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    rows = rows.withColumn("_from", F.col("at") + F.col("pass") * F.col("source_size"))
    first, last = F.floor(F.col("_from") / F.col("block")), F.floor((F.col("_from") + F.col("size") - 1) / F.col("block"))
    rows = rows.withColumn("_rank", F.explode(F.when(F.col("size") > 0, F.sequence(first, last)).otherwise(F.array(F.lit(None).cast("long")))))
    of_block = F.least(F.col("_from") + F.col("size"), (F.col("_rank") + 1) * F.col("block"), F.col("end")) - F.greatest(F.col("_from"), F.col("_rank") * F.col("block"))
    plan = schedule(goals).select(F.col("source").alias("_s"), F.col("rank").alias("_k"), "slot")
    # a document behind the end of the last block has nothing of it
    rows = rows.withColumn("_words", F.greatest(of_block, F.lit(0))).join(plan, _same(F.col("source"), F.col("_s")) & (F.col("_rank") == F.col("_k")), "left")
    has = F.col("slot").isNotNull() & (F.col("_words") > 0)
    taken = F.coalesce(F.sum(F.when(has, F.col("_words"))), F.lit(0)).cast("long")
    keys = ["key", "source", "size", "at", "source_size", "target", "pass"]
    out = rows.groupBy(*keys).agg(taken.alias("taken"), F.min(F.when(has, F.col("slot"))).alias("first_slot"), F.count(F.lit(1)).alias("_n"))
    # rows without words have no place of their own in the order: equal ones met in one group
    return out.withColumn("_i", F.explode(F.when(F.col("size") == 0, F.sequence(F.lit(1).cast("long"), F.col("_n"))).otherwise(F.array(F.lit(1).cast("long"))))).drop("_i", "_n")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES, slot: str | None = None) -> DataFrame:
    """The rows of the mix with all columns of docs (doc_id, text, source, ... as documents): a row for
    each document and pass with words in the mix. slot: the name of a further column for the first slot of each row, by
    which they are in the order of the schedule. Documents come whole and unchanged: the one per source at
    which its target ends brings all its words. Rows that are equal in all columns are taken as often as
    their number says; rows that differ in any column stay apart. Null texts have no words and are not
    taken; an empty table gives no rows. Columns may have any names but those of maps and variants."""
    cols = docs.columns
    k, n = spare("key", cols), spare("times", cols)
    every = [x for c in cols for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    key = F.concat_ws(":", F.xxhash64(*every).cast("string"), F.xxhash64(F.lit(1), *every).cast("string"))
    rows = docs.select(*(F.col(f"`{c}`") for c in cols), key.alias(k))
    slim = docs.select(key.alias("key"), "source", n_words(F.col("text")).alias("size"))
    takes = mix(slim, weights, share, passes).where("taken > 0")
    if slot is not None:
        return rows.dropDuplicates([k]).join(takes.select(F.col("key").alias(k), F.col("first_slot").alias(n)), k).select(*(F.col(f"`{c}`") for c in cols), F.col(n).alias(slot))
    takes = takes.groupBy("key").agg(F.count(F.lit(1)).alias(n)).withColumnRenamed("key", k)
    rows = rows.dropDuplicates([k]).join(takes, k)
    again = spare("again", [*cols, k, n])
    return rows.withColumn(again, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*(F.col(f"`{c}`") for c in cols))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document, with its source and first_slot, where in the schedule
    its words first come (null: nowhere)."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "source", n_words(F.col("text")).alias("size"))
    rows = mix(docs).groupBy("key", "source", "size", "at", "source_size", "target", "pass").agg(F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("n"), F.min("first_slot").alias("first_slot"))
    out = rows.groupBy("key", "source", "size", "at", "source_size", "target").agg(F.sum("taken").alias("taken"), F.max("n").alias("n"), F.min("first_slot").alias("first_slot"))
    out = out.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return out.select(F.col("key").alias("doc_id"), "source", "size", "source_size", "target", "taken", "first_slot")


#: The same rows in closed form: a source takes a prefix of as many words of its passes as its target says; its blocks
#: come at its slots in order, which are its values with their bits reversed.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 2.0 * source_size AS top FROM s),
o AS (SELECT *, (sum(source_size::DOUBLE) OVER () * 1.5 - coalesce(sum(top) OVER (ORDER BY top / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
        / sum(weight) OVER (ORDER BY top / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
g AS (SELECT source, source_size, least(coalesce((SELECT min_by(level, top / weight) FROM o WHERE level * weight <= top), 'inf'::DOUBLE) * weight, top) AS target FROM o),
q AS (SELECT *, CASE WHEN target > 0 THEN least(greatest(round(target), 1), source_size * 2) ELSE 0 END AS upto FROM g),
a AS (SELECT d.*, q.source_size, q.target, q.upto, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
t AS (SELECT doc_id, source, size, source_size, target, pos,
       CAST(greatest(0, least(size, upto - pos)) + greatest(0, least(size, upto - source_size - pos)) AS BIGINT) AS taken FROM a),
b AS (SELECT greatest(1, ceil(sum(target) / 524288))::BIGINT AS block FROM q),
k AS (SELECT source, ceil(upto / block)::BIGINT AS quota, (sum(ceil(upto / block)) OVER (ORDER BY encode(source) NULLS LAST))::BIGINT AS hi, greatest(1, ceil(log2(greatest(sum(ceil(upto / block)) OVER (), 2))))::BIGINT AS bits FROM q, b),
v AS (SELECT source, bits, hi - quota + unnest(range(quota)) AS v FROM k),
r AS (SELECT source, list_sum(list_transform(range(bits), lambda i: ((v >> i) & 1) << (bits - 1 - i)))::BIGINT AS slot FROM v),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM r)
SELECT t.doc_id, t.source, size, source_size, target, taken, n.slot AS first_slot FROM t CROSS JOIN b LEFT JOIN n ON n.source IS NOT DISTINCT FROM t.source AND n.rank = t.pos // block AND t.taken > 0
"""

QUERIES: dict[str, Callable] = {"op8_mixing": op8_mixing}
ORACLE: dict[str, str] = {"op8_mixing": ORACLE_SQL}
