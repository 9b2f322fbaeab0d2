"""Ranking metrics and evaluation aggregates."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _gain(rank: Column) -> Column:
    return F.lit(1.0) / F.log2(rank + 1)


def ranking(hits: DataFrame, relevant: DataFrame, query: str, item: str, rank: str, k: int) -> DataFrame:
    """hits(query, item, rank) against relevant(query, item), for every query of `relevant`: recall within
    k over all relevant items, reciprocal rank and NDCG within k.

    Repeated items keep their places but count once, at the first; the ideal has as many items as are
    relevant, up to k, whatever the list holds."""
    rel = relevant.select(query, item).distinct()
    total = rel.groupBy(query).agg(F.count(F.lit(1)).alias("_all"))
    first = hits.groupBy(query, item).agg(F.min(rank).alias("_rank"))
    met = first.join(rel, [query, item]).groupBy(query).agg(
        F.sum(F.when(F.col("_rank") <= k, 1).otherwise(0)).alias("_in"), F.min("_rank").alias("_first"),
        F.sum(F.when(F.col("_rank") <= k, _gain(F.col("_rank"))).otherwise(0.0)).alias("_dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("_all"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + F.lit(1.0) / F.log2(r + 1))
    return total.join(met, query, "left").select(
        query, F.round(F.coalesce(F.col("_in") / F.col("_all"), F.lit(0.0)), 6).alias("recall"),
        F.round(F.coalesce(F.lit(1.0) / F.col("_first"), F.lit(0.0)), 6).alias("rr"), F.round(F.coalesce(F.col("_dcg") / ideal, F.lit(0.0)), 6).alias("ndcg"),
    )


def graded_ndcg(hits: DataFrame, grades: DataFrame, query: str, item: str, rank: str, k: int) -> DataFrame:
    """NDCG with gains 2**grade - 1; null where one of the first k has no grade."""
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) * _gain(F.col("_r"))
    got = hits.where(F.col(rank) <= k).withColumnRenamed(rank, "_r").join(grades, [query, item], "left")
    got = got.groupBy(query).agg(F.sum(gain).alias("_dcg"), F.sum(F.col("grade").isNull().cast("int")).alias("_open"))
    best = grades.withColumn("_r", F.row_number().over(W.partitionBy(query).orderBy(F.desc("grade"), item))).where(F.col("_r") <= k)
    best = best.groupBy(query).agg(F.sum(gain).alias("_ideal"))
    return got.join(best, query, "left").select(query, F.when(F.col("_open") == 0, F.round(F.col("_dcg") / F.nullif(F.col("_ideal"), F.lit(0.0)), 6)).alias("ndcg"))


def fact_coverage(hits: DataFrame, sets: DataFrame, query: str, item: str, rank: str, k: int) -> DataFrame:
    """sets(query, fact, set_id, item): a fact is covered if one of its sets lies within the first k; a
    query is complete if all its facts are. The reciprocal rank is of the first prefix that completes any
    fact. Facts whose sets have no items (unmapped) leave the query's values null."""
    first = hits.groupBy(query, item).agg(F.min(rank).alias("_r"))
    s = sets.join(first, [query, item], "left").groupBy(query, "fact", "set_id").agg(
        F.max("_r").alias("_last"), F.sum((F.col("_r").isNull() & F.col(item).isNotNull()).cast("int")).alias("_lost"), F.sum(F.col(item).isNull().cast("int")).alias("_unmapped"),
    )
    f = s.groupBy(query, "fact").agg(F.min(F.when((F.col("_lost") == 0) & (F.col("_unmapped") == 0), F.col("_last"))).alias("_at"), F.max("_unmapped").alias("_unmapped"))
    out = f.groupBy(query).agg(
        F.avg(F.coalesce((F.col("_at") <= k).cast("double"), F.lit(0.0))).alias("fact_recall"), F.min(F.coalesce((F.col("_at") <= k).cast("double"), F.lit(0.0))).alias("complete"),
        F.coalesce(F.lit(1.0) / F.min("_at"), F.lit(0.0)).alias("rr"), F.max("_unmapped").alias("_unmapped"),
    )
    known = F.col("_unmapped") == 0
    return out.select(query, *(F.when(known, F.round(c, 6)).alias(c) for c in ("fact_recall", "complete", "rr")))


def with_coverage(value: Column, name: str = "") -> list[Column]:
    """Mean of known values and how many of all rows it stands for."""
    return [F.avg(value).alias(f"{name}mean"), F.count(value).alias(f"{name}evaluated"), F.count(F.lit(1)).alias(f"{name}total"), (F.count(value) / F.count(F.lit(1))).alias(f"{name}coverage"), (F.count(F.lit(1)) - F.count(value)).alias(f"{name}missing")]


def bounds(value: Column) -> list[Column]:
    """Mean of known values in 0 to 1, and what the mean over all rows could be at least and at most."""
    n, known, total = F.count(F.lit(1)), F.count(value), F.coalesce(F.sum(value), F.lit(0.0))
    return [F.avg(value).alias("mean"), known.alias("n"), n.alias("denominator"), (total / n).alias("lower"), ((total + n - known) / n).alias("upper")]


def by_each(df: DataFrame, dimensions: Sequence[str], *aggregates: Column) -> DataFrame:
    """Aggregates by each dimension on its own: (dimension, value, ...), in one pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in dimensions)))
    return df.withColumn("_p", pairs).groupBy("_p.dimension", "_p.value").agg(*aggregates)




def nearest_rank(column: str, q: float) -> Column:
    """The value at place ceil(n * q) of the sorted known values."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY `{column}`)")


def _unbeaten(points: np.ndarray) -> np.ndarray:
    """Places of the rows that none beats, all columns the larger the better: in falling order of the columns a row
    can only be beaten by one before it."""
    kept = np.zeros(0, int)
    for i in np.lexsort(-points.T[::-1]):
        x, k = points[i], points[kept]
        if not ((k >= x).all(1) & (k > x).any(1)).any():
            kept = np.append(kept, i)
    return np.sort(kept)


def dominated(df: DataFrame, up: Sequence[str], down: Sequence[str], parts: int = 64) -> DataFrame:
    """Rows that no other row beats: at least as good in all, better in one; equal rows stay together, rows with a null
    among the columns are neither kept nor beat any. A frontier of each part first, then of `parts` of these, then of
    what is left: each task holds a frontier and one batch."""

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for b in batches:
            kept = b if kept is None else pd.concat([kept, b], ignore_index=True)
            points = np.hstack([kept[list(up)].to_numpy(float), -kept[list(down)].to_numpy(float)])
            kept = kept.iloc[_unbeaten(points)]
        if kept is not None:
            yield kept

    whole = df.dropna(subset=[*up, *down])
    first = whole.mapInPandas(local, df.schema).repartition(parts).mapInPandas(local, df.schema)
    return first.coalesce(1).mapInPandas(local, df.schema)


def bootstrap(rows: DataFrame, cluster: str, order: str, value: str, resamples: int = 1000, seed: int = 20260930) -> DataFrame:
    """Mean and a 95% interval over clusters: means of resampled cluster means, places 25 and 975 of 1000.
    Clusters come in the order in which they are first seen. Only cluster means meet in one task."""
    means = rows.groupBy(cluster).agg(F.avg(value).alias("m"), F.min(order).alias("at")).withColumn("one", F.lit(1))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.sort_values("at")["m"].dropna().tolist()
        if len(m) < 2:
            return pd.DataFrame({"mean": [sum(m) / len(m) if m else None], "low": [None], "high": [None]}, dtype="float64")
        draw = random.Random(seed)
        got = sorted(math.fsum(draw.choices(m, k=len(m))) / len(m) for _ in range(resamples))
        return pd.DataFrame({"mean": [math.fsum(m) / len(m)], "low": [got[int(resamples * 0.025) - 1]], "high": [got[int(resamples * 0.975) - 1]]})

    return means.groupBy("one").applyInPandas(run, "mean double, low double, high double")
