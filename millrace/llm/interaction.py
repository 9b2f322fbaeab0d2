"""How filters interact: what each removes in every order, and its Shapley share.

A document's failures are a mask, so a part is its number of documents by mask. The documents that a set of
filters removes, as a function of the set, extends to a polynomial that is linear in each filter's variable;
its corners are the sets themselves. A filter's Shapley value is the integral of the polynomial's derivative
by its variable along the diagonal, in exact rationals.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from fractions import Fraction
from itertools import permutations
from math import factorial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.shared import table

SPACE = r"[\x20\x09-\x0D]+"
FEWEST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 200, 50, 3, "[#$%&*|]"
#: What the report has of each order and step.
REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


class Removal:
    """The removal polynomial of n filters from the number of documents by mask of failures."""

    def __init__(self, counts: Sequence[int]):
        n = len(counts).bit_length() - 1
        over = list(counts)  # documents that fail all of a set: sums over supersets
        for i in range(n):
            for s in range(len(over)):
                if not s >> i & 1:
                    over[s] += over[s | 1 << i]
        # 1 - prod(1 - x_i) of every document, multiplied out
        self.coefficient = [0] + [over[s] * (1 if s.bit_count() % 2 else -1) for s in range(1, len(over))]

    def at(self, corner: int) -> int:
        """Documents removed by the filters of a set, all variables in it 1 and the others 0."""
        return sum(c for s, c in enumerate(self.coefficient) if not s & ~corner)

    def derivative(self, i: int) -> list[int]:
        """By the variable of filter i, on the diagonal where all variables are t: coefficients of 1, t, t^2..."""
        out = [0] * len(self.coefficient).bit_length()
        for s, c in enumerate(self.coefficient):
            if s >> i & 1:
                out[s.bit_count() - 1] += c
        return out

    def shapley(self, i: int) -> Fraction:
        """The integral of that derivative from 0 to 1."""
        return sum((Fraction(c, power + 1) for power, c in enumerate(self.derivative(i))), Fraction(0))


def report(part: str, letters: str, n: Sequence[int], good: Sequence[int], toxic: Sequence[int]) -> list[tuple]:
    """The rows of one part: every order of the filters, step by step."""
    total, all_, bit = sum(n), len(n) - 1, {x: 1 << i for i, x in enumerate(letters)}
    removal, of_good, of_toxic = Removal(n), Removal(good), Removal(toxic)
    corner = [removal.at(s) for s in range(len(n))]
    lost = [(of_good.at(s), of_toxic.at(s)) for s in range(len(n))]
    orders = factorial(len(letters))
    share = {x: removal.shapley(i) * orders for i, x in enumerate(letters)}
    out = []
    for order in permutations(letters):
        before = 0
        for step, x in enumerate(order, 1):
            b = bit[x]
            after = before | b
            here = corner[after] - corner[before]
            out.append((part, "".join(order), step, total - corner[after], here, corner[b] - here, corner[all_] - corner[all_ & ~b], lost[after][0] - lost[before][0], lost[after][1] - lost[before][1], int(share[x])))
            before = after
    return out


def own_failures(text: Column) -> Column:
    """Bits of the filters that a text alone decides: 1 few words, 2 few distinct words, 4 many capitals, 8 signs."""
    inner = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    words = F.split(inner, SPACE)
    some = inner != ""
    n, distinct = F.when(some, F.size(words)).otherwise(0), F.when(some, F.size(F.array_distinct(words))).otherwise(0)
    fails = (
        n < FEWEST_WORDS,
        100 * distinct < LEAST_DISTINCT * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")) > MOST_CAPITALS * F.length(text),
        text.rlike(SIGNS),
    )
    return sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and mask of failures, those labelled good, those toxic.

    The last filter looks at all documents: it fails those whose text has a smaller id elsewhere. Texts meet by
    their SHA-256 and only as counts: copies are summed by part, mask and labels where they are read, so a group
    of copies of any size is a few rows. Only rows with the least id of a text pass; a null id is neither smaller
    nor larger than another, so it passes. A label that repeats holds if any of its rows has it."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("lang", F.lit("")).alias("part"), own_failures(text).alias("own"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"))
    rows = rows.withColumn("salt", F.when(F.col("id").isNull(), F.pmod(F.xxhash64("key"), F.lit(4096)).cast("int")).otherwise(0))  # null ids meet no label: they needn't meet each other
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic")).withColumn("salt", F.lit(0))
    mark = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    rows = rows.join(marks, ["id", "salt"], "left").select("id", "part", "own", "key", mark("good"), mark("toxic"))
    same = rows.groupBy("key", "part", "own", "good", "toxic", "id").agg(F.count(F.lit(1)).alias("n"))
    same = same.groupBy("key", "part", "own", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"), F.min("id").alias("least"), F.min_by("n", "id").alias("at_least"))
    first = F.col("least") == F.min("least").over(W.partitionBy("key"))  # rows of a text: its parts and labels
    passes = F.col("unnamed") + F.when(first, F.col("at_least")).otherwise(0)
    same = same.withColumn("passes", passes)
    kinds = F.explode(F.array(F.struct(F.col("own").alias("mask"), F.col("passes").alias("n")), F.struct((F.col("own") + 16).alias("mask"), (F.col("n") - F.col("passes")).alias("n"))))
    same = same.select("part", "good", "toxic", kinds.alias("k")).select("part", "good", "toxic", "k.*")
    held = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return same.groupBy("part", "mask").agg(F.sum("n").alias("docs"), held("good"), held("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of five
    filters: A few words, B few distinct words, C many capitals, D signs, E text of a smaller id.

    A row for each part (lang, null as ""), order and step. Null texts are empty, equal to each other and to
    empty ones. Repeated rows are documents of their own; null ids never fail E (see masks). Other columns are
    ignored; an empty table gives no rows."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        by = {c: [0] * 32 for c in ("docs", "good", "toxic")}
        for c, counts in by.items():
            for mask, n in zip(pdf["mask"], pdf[c], strict=True):
                counts[mask] = int(n)
        rows = report(key[0], "ABCDE", by["docs"], by["good"], by["toxic"])
        return pd.DataFrame(rows, columns=[c.split()[0] for c in REPORT.split(", ")])

    return masks(docs, labels).groupBy("part").applyInPandas(one, REPORT)


def op11_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    return audit(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), table(spark, sf_dir, "labels"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
 w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
 least AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
 l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
 f AS (SELECT w.part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
   (CASE WHEN len(words) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END)
   || (CASE WHEN 100 * length(regexp_replace(w.t, '[^A-Z]', '', 'g')) > 3 * length(w.t) THEN 'C' ELSE '' END)
   || (CASE WHEN regexp_matches(w.t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN w.doc_id > least.least THEN 'E' ELSE '' END) AS fails
   FROM w JOIN least ON w.t = least.t LEFT JOIN l ON w.doc_id = l.doc_id),
 m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails),
 x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
 o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
   WHERE a.x <> b.x AND a.x <> c.x AND a.x <> d.x AND a.x <> e.x AND b.x <> c.x AND b.x <> d.x AND b.x <> e.x AND c.x <> d.x AND c.x <> e.x AND d.x <> e.x),
 s AS (SELECT filter_order, step, filter_order[step] AS x, '[' || filter_order[1:step] || ']' AS upto, CASE WHEN step = 1 THEN '[~]' ELSE '[' || filter_order[1:step - 1] || ']' END AS before
   FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
 r AS (SELECT part, filter_order, step, x,
   coalesce(sum(n) FILTER (NOT regexp_matches(fails, upto)), 0) AS kept,
   coalesce(sum(n) FILTER (contains(fails, x) AND NOT regexp_matches(fails, before)), 0) AS removed,
   coalesce(sum(n) FILTER (contains(fails, x) AND regexp_matches(fails, before)), 0) AS redundant,
   coalesce(sum(n) FILTER (fails = x), 0) AS unique_fails,
   coalesce(sum(good) FILTER (contains(fails, x) AND NOT regexp_matches(fails, before)), 0) AS good_lost,
   coalesce(sum(toxic) FILTER (contains(fails, x) AND NOT regexp_matches(fails, before)), 0) AS toxic_lost
   FROM m, s GROUP BY part, filter_order, step, x)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
 good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM r
"""

QUERIES: dict[str, Callable] = {"op11_filter_interaction": op11_filter_interaction}
ORACLE: dict[str, str] = {"op11_filter_interaction": SQL}
