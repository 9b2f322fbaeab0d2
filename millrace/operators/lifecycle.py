"""Versions, jobs, outbox and leases: joins and audits over control tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.parts import spread


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old with the rows of new put in place of those with equal keys. Rows of old move once, and only if
    their key is hot enough to be shuffled; new must not repeat a key."""
    return old.join(new.select(*keys), list(keys), "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def inserted(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old and those rows of new whose key isn't there yet; of equal keys in new, one."""
    return old.unionByName(new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti").select(*old.columns))


def conflicts(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Keys that both have with other values: an idempotent insert must refuse them."""
    b = new.select(*keys, *(F.col(v).alias(f"_{v}") for v in values))
    same = [F.col(v).eqNullSafe(F.col(f"_{v}")) for v in values]
    both = same[0]
    for s in same[1:]:
        both = both & s
    return old.join(b, list(keys)).where(~both).select(*keys)


def latest(df: DataFrame, group: str, order: str) -> DataFrame:
    """The last row of each group, by a struct's maximum: no sort, sums first."""
    others = [c for c in df.columns if c not in (group, order)]
    out = df.groupBy(group).agg(F.max(F.struct(order, *others)).alias("_m"))
    return out.select(group, f"_m.{order}", *(f"_m.{c}" for c in others))


def pointer_audit(documents: DataFrame, versions: DataFrame, live: DataFrame) -> DataFrame:
    """What to do for each document whose active pointer is off: publish a finished version, restore the
    pointed one, or deactivate. live(document_id): documents with a job at work, left alone."""
    v = versions.select("document_id", F.col("version_id"), F.col("version_no"), F.col("status").alias("v_status"))
    best = v.where("v_status = 'active'").groupBy("document_id").agg(F.max_by("version_id", "version_no").alias("latest_id"))
    pointed = v.select(F.col("document_id").alias("_d"), F.col("version_id").alias("_v"), F.col("v_status").alias("pointed_status"))
    rows = documents.join(live.select("document_id"), "document_id", "left_anti").join(best, "document_id", "left")
    rows = rows.join(pointed, (F.col("document_id") == F.col("_d")) & (F.col("active_version_id") == F.col("_v")), "left").drop("_d", "_v")
    off = (
        ((F.col("status") == "deleted") & F.col("active_version_id").isNotNull())
        | (F.col("active_version_id").isNotNull() & (F.coalesce("pointed_status", F.lit("none")) != "active"))
        | (F.col("active_version_id").isNull() & F.col("latest_id").isNotNull())
        | (F.col("active_version_id") != F.col("latest_id"))
    )
    action = F.when(F.col("status") == "deleted", "deactivate").when(F.col("latest_id").isNull(), "restore").otherwise("publish")
    return rows.where(off).select("document_id", "active_version_id", "latest_id", action.alias("action"))


def barrier(members: DataFrame, results: DataFrame, group: str, member: str, deadline: Column) -> DataFrame:
    """Per group: waiting, partial or complete, with the members that are missing."""
    rows = members.join(results.select(group, member, F.lit(True).alias("_done")), [group, member], "left")
    out = rows.groupBy(group).agg(F.count(F.lit(1)).alias("members"), F.count("_done").alias("done"), F.array_sort(F.collect_list(F.when(F.col("_done").isNull(), F.col(member)))).alias("missing"))
    return out.withColumn("state", F.when(F.col("members") == F.col("done"), "complete").when(deadline, "partial").otherwise("waiting"))


def ready(todos: DataFrame, edges: DataFrame) -> DataFrame:
    """todos(run, id, status) with edges(run, id, blocker): done, ready, waiting for a blocker, or blocked
    upstream by one that failed."""
    b = edges.join(todos.select("run", F.col("id").alias("blocker"), F.col("status").alias("_s")), ["run", "blocker"])
    b = b.groupBy("run", "id").agg(F.max((F.col("_s") != "done").cast("int")).alias("_wait"), F.max((F.col("_s") == "failed").cast("int")).alias("_fail"))
    rows = todos.join(b, ["run", "id"], "left")
    view = F.when(F.col("status") != "open", F.col("status")).when(F.col("_fail") == 1, "blocked").when(F.col("_wait") == 1, "waiting").otherwise("ready")
    return rows.select("run", "id", "status", view.alias("view"))


def closure(links: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(root, node) pairs within `hops` links of start(root): each round joins the new ends only. Rounds have no pair in
    common and none twice, so only the roots are made distinct at the outset."""
    seen = edge = start.select("root").distinct().select("root", F.col("root").alias("node"))
    for _ in range(hops):
        edge = edge.join(links, edge["node"] == links["src"]).select("root", F.col("dst").alias("node")).distinct().join(seen, ["root", "node"], "left_anti")
        seen = seen.union(edge)
    return seen


def drift(frozen: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Keys that were added, removed or changed, by a hash of all other columns."""
    h = lambda df: df.select(key, F.sha2(F.to_json(F.struct(*sorted(c for c in df.columns if c != key))), 256).alias("h"))
    a, b = h(frozen).withColumnRenamed("h", "a"), h(live).withColumnRenamed("h", "b")
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, key, "full").select(key, kind.alias("drift")).where("drift is not null")


def islands(df: DataFrame, group: Sequence[str], start: str, end: str) -> DataFrame:
    """Unions of half-open ranges that overlap or touch. A task sorts a part of the groups."""
    df = spread(df, *group)
    w = W.partitionBy(*group).orderBy(start, end)
    top = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = df.withColumn("_new", F.when(top.isNull() | (F.col(start) > top), 1).otherwise(0))
    rows = rows.withColumn("_island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(*group, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")
