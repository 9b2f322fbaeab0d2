"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import dropped, written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Large: each vertex tells its larger neighbours the least id around it. Small: each vertex
    links itself and its smaller neighbours to the least of them."""
    if large:
        both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("least"))
        out = both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    else:
        down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        least = down.groupBy("src").agg(F.min("dst").alias("least"))
        near = down.join(least, "src").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
        out = near.union(least.select("src", F.col("least").alias("dst")))
    return out.where("src <> dst").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(src, dst: long) to (id, component_id): the least id reachable, for every linked vertex.

    Each round's links are a table in the shared folder, so lineage stays short and a lost executor
    repeats one round at most. A hot vertex is only summed (min) or joined, never gathered. Links
    never exceed those given. Null ends and loops are dropped; no edges give no rows."""
    now = written(edges.where("src <> dst").select("src", "dst").distinct(), "links")
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst") % F.lit(1 << 40))).first()
        if mark == seen or mark[0] == 0:
            return now.select(F.col("src").alias("id"), F.col("dst").alias("component_id")).union(
                now.select(F.col("dst").alias("id"), F.col("dst").alias("component_id")).distinct()
            )
        seen, old = mark, now
        now = written(_stars(_stars(now, True), False), "links")
        dropped(old)
