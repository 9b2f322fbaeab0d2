"""Evidence: ranked dedup, diversity, bounded history, merging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PER_DOCUMENT, PER_SINGLE = 3, 6


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each group."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def diverse(df: DataFrame, document: str, order: Sequence[Column | str], cap: int = PER_DOCUMENT, single: int = PER_SINGLE) -> DataFrame:
    """At most `cap` rows of a document, or `single` if all are of one."""
    docs = df.agg((F.min(document) == F.max(document)).alias("_one"))
    n = F.row_number().over(W.partitionBy(document).orderBy(*order))
    out = df.withColumn("_n", n).where(F.col("_n") <= max(cap, single)).crossJoin(F.broadcast(docs))  # docs is one row
    return out.where(F.col("_n") <= F.when(F.col("_one"), single).otherwise(cap)).drop("_n", "_one")


def bounded_history(turns: DataFrame, key: str, order: str, text: str, most: int = 6, budget: int = 8000) -> DataFrame:
    """The last turns within a budget of characters, counted from the newest; the turn that overflows
    keeps its end. `tail` is what is kept."""
    newest = W.partitionBy(key).orderBy(F.desc(order))
    rows = turns.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= most)
    rows = rows.withColumn("_before", F.coalesce(F.sum(F.length(text)).over(newest.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    room = F.least(F.length(text).cast("long"), F.lit(budget) - F.col("_before"))
    return rows.where(F.col("_before") < budget).withColumn("tail", F.right(F.col(text), room.cast("int"))).drop("_back", "_before")


def merged(df: DataFrame, keys: Sequence[str], order: Sequence[Column], same: Sequence[str], children: str, targets: str) -> DataFrame:
    """One row a group of candidates: the first one's columns `same`, all its children (structs of child_id
    and identity) and targets in order of first sight, and `conflict`: whether candidates differ in `same` or
    one child has two identities. A group is a parent's candidates of one request, so it is small."""
    each = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), *same, F.col(children).alias("kids"), F.col(targets).alias("aims"))
    g = df.groupBy(*keys).agg(F.array_sort(F.collect_list(each)).alias("_all"))
    kids = F.array_distinct(F.flatten(F.transform("_all", lambda x: x["kids"])))
    ids = F.array_distinct(F.transform(kids, lambda k: k["child_id"]))
    differ = F.size(F.array_distinct(F.transform("_all", lambda x: F.struct(*(x[s].alias(s) for s in same))))) > 1
    first = F.element_at("_all", 1)
    aims = F.array_distinct(F.flatten(F.transform("_all", lambda x: x["aims"])))
    return g.select(*keys, *(first[s].alias(s) for s in same), ids.alias(children), aims.alias(targets), (differ | (F.size(kids) > F.size(ids))).alias("conflict"))
