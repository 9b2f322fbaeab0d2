"""Fusion of lanes, reranking, and grouping to parents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.lanes import terms


def reciprocal_rank(rank: Column, k: int = 60) -> Column:
    return F.lit(1.0) / (F.lit(k) + rank)


def fused(lanes: DataFrame, by: Sequence[str] = (), k: int = 60, limit: int | None = 30) -> DataFrame:
    """lanes(by..., child_id, parent_id, lane, lane_rank) to one row per child: rrf_score, best_rank and
    position; by score, best rank, then id."""
    out = lanes.groupBy(*by, "child_id").agg(
        F.round(F.sum(reciprocal_rank(F.col("lane_rank"), k)), 9).alias("rrf_score"), F.min("lane_rank").alias("best_rank"),
        F.min("parent_id").alias("parent_id"), F.countDistinct("parent_id").alias("parents"),
    )
    # a child that lanes give to different parents is an error, not a choice
    out = out.withColumn("parent_id", F.when(F.col("parents") == 1, F.col("parent_id")).otherwise(F.raise_error(F.lit("lanes disagree on a child")))).drop("parents")
    at = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("rrf_score"), "best_rank", "child_id"))
    out = out.withColumn("position", at)
    return out if limit is None else out.where(F.col("position") <= limit)


def overlap_score(query: Column, text: Column) -> Column:
    """The stand-in for a cross-encoder: shared terms over all terms of both."""
    a, b = F.array_distinct(terms(query)), F.array_distinct(terms(text))
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def reranked(hits: DataFrame, score: Column | None, by: Sequence[str] = (), limit: int = 10) -> DataFrame:
    """hits in order of `score`, then of their position; without a score (the scorer failed) the fused
    order stays and `degraded` says so."""
    out = hits.withColumn("rerank_score", F.round(score, 9) if score is not None else F.lit(None).cast("double"))
    out = out.withColumn("degraded", F.lit(score is None)).withColumn("ranking_score", F.coalesce("rerank_score", "rrf_score"))
    order = [F.desc("rerank_score"), "position"] if score is not None else ["position"]
    at = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return out.withColumn("position", at).where(F.col("position") <= limit)


def parents(hits: DataFrame, by: Sequence[str] = (), children: int = 2, limit: int = 6) -> DataFrame:
    """hits(by..., position, child_id, parent_id, ranking_score) to parents: the first `children` hits in
    input order, the best score, and the position of the first hit that has it."""
    group = W.partitionBy(*by, "parent_id")
    nth = F.row_number().over(group.orderBy("position"))
    best = F.max("ranking_score").over(group)
    rows = hits.withColumn("_nth", nth).withColumn("_best", best)
    out = rows.groupBy(*by, "parent_id").agg(
        F.max("_best").alias("parent_score"),
        F.min(F.when(F.col("ranking_score") == F.col("_best"), F.col("position"))).alias("best_position"),
        F.array_sort(F.collect_list(F.when(F.col("_nth") <= children, F.struct("position", "child_id")))).alias("_kids"),
    )
    at = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("parent_score"), "best_position", "parent_id"))
    return out.select(*by, "parent_id", "parent_score", "best_position", F.transform("_kids", lambda x: x["child_id"]).alias("children"), at.alias("parent_rank")).where(F.col("parent_rank") <= limit)


def hydrated(requested: DataFrame, chunks: DataFrame, documents: DataFrame, versions: DataFrame) -> DataFrame:
    """requested(parent_id, position) with the chunk, where document and version are active and the chunk
    belongs to the active version; those that don't stay out. Only survivors are joined."""
    live = documents.where("status = 'active'").join(versions.where("status = 'active'"), "document_id").where("active_version_id = version_id")
    return requested.join(chunks, "parent_id").join(live.select("document_id", "version_id", "user_id"), ["document_id", "version_id"])


def hydrated_or_none(requested: DataFrame, found: DataFrame, key: str = "parent_id") -> DataFrame:
    """All of the batch, or nothing: one missing row fails the request."""
    lost = requested.join(found.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("_lost"))
    return found.crossJoin(F.broadcast(lost)).where("_lost = 0").drop("_lost")  # lost is one row
