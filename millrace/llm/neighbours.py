"""Approximate nearest neighbours: stable projections indexed by kd-trees.

Unit vectors are projected on a few Gaussian directions: a projected squared distance is the true one
times a chi-square variable. The top of a kd-tree over the projections, cut by a bounded sample, deals
all vectors to parts, and a hash to chunks of some thousand rows; each chunk has a kd-tree of its own. A query
takes its projected neighbours in order of distance, bucket by bucket, and verifies them on the true vectors;
it stops once the next bucket is so far that a closer neighbour in it would be a chance below 1 - SURE
under the chi-square distribution. It does so in rounds: its own part, the FEW next parts, then all that the
test, with the distances found so far, still leaves. Parts are sought from the root of the tree down, past
branches out of reach.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.llm.shared import small_batches, table, written
from millrace.llm.vectors import matrix, unit, usable, width

DIMENSIONS, SURE, SEED = 8, 0.95, 7
#: Rows of a part or chunk and of a bucket, about; rows of the sample that cuts the parts, and those of it that a
#: part must have: so parts number 2048 at most, beyond which chunks do; queries of a task; parts of the second round.
PART, BUCKET, SAMPLE, LEAST_SAMPLE, QUERIES_AT_ONCE, FEW = 2048, 64, 1 << 16, 32, 4096, 3


def chi_square_limit(p: float, m: int = DIMENSIONS) -> float:
    """The value below which a chi-square variable of m (even) degrees falls with probability p."""
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        x = (lo + hi) / 2
        below = 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
        lo, hi = (x, hi) if below < p else (lo, x)
    return hi


def directions(d: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((d, DIMENSIONS))


class Cuts:
    """The top of the kd-tree: a complete binary tree of `depth` levels; node i has children 2i+1, 2i+2.
    A value equal to the cut goes to either side, by a bit of the row's hash, so copies spread."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.axis, self.at = np.zeros(2**depth - 1, int), np.zeros(2**depth - 1)
        stack = [(0, sample)]
        while stack:
            i, x = stack.pop()
            if i >= len(self.axis):
                continue
            if len(x):
                self.axis[i] = int(np.argmax(x.max(0) - x.min(0)))
                self.at[i] = float(np.median(x[:, self.axis[i]]))
            v = x[:, self.axis[i]]
            low = (v < self.at[i]) | ((v == self.at[i]) & (np.arange(len(v)) % 2 == 0))
            stack += [(2 * i + 1, x[low]), (2 * i + 2, x[~low])]

    def within(self, q: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, part, squared distance) of all parts at most `reach` from their query: pairs of a query and a
        node go down level by level, those out of reach stay behind."""
        i, node, far = np.arange(len(q)), np.zeros(len(q), int), np.zeros(len(q))
        gap = np.zeros((len(q), q.shape[1]))
        for _ in range(self.depth):
            axis, cut = self.axis[node], self.at[node]
            side = q[i, axis] - cut
            at = np.arange(len(i))
            below, above = gap.copy(), gap
            below[at, axis] = np.maximum(below[at, axis], side)
            new_far = far + below[at, axis] ** 2 - gap[at, axis] ** 2
            old = above[at, axis].copy()
            above[at, axis] = np.maximum(old, -side)
            far = np.concatenate([new_far, far + above[at, axis] ** 2 - old**2])
            i, node, gap = np.tile(i, 2), np.concatenate([2 * node + 1, 2 * node + 2]), np.concatenate([below, above])
            near = far <= reach[i]
            i, node, gap, far = i[near], node[near], gap[near], far[near]
        return i, node - (2**self.depth - 1), far

    def part(self, y: np.ndarray, ids: np.ndarray) -> np.ndarray:
        node = np.zeros(len(y), int)
        bits = (ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
        for level in range(self.depth):
            v, cut = y[np.arange(len(y)), self.axis[node]], self.at[node]
            right = (v > cut) | ((v == cut) & (bits >> np.uint64(level) & np.uint64(1) > 0))
            node = 2 * node + 1 + right
        return node - (2**self.depth - 1)


def _box_distance(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of queries to boxes."""
    gap = np.maximum(low[None] - q[:, None], 0) + np.maximum(q[:, None] - high[None], 0)
    return (gap * gap).sum(2)


def search(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int, bound: np.ndarray, project: np.ndarray, limit: float) -> list[tuple[int, int, float]]:
    """(query, vector, cosine) of the k nearest found of each query; bound: cosines that a neighbour must
    reach (those of the k-th found so far elsewhere)."""
    u, uq = unit(x), unit(q)
    y, yq = u @ project, uq @ project
    buckets = [np.arange(len(y))]
    while any(len(b) > BUCKET for b in buckets):  # halved at the median of the widest axis
        new = []
        for b in buckets:
            if len(b) <= BUCKET:
                new.append(b)
                continue
            axis = int(np.argmax(np.ptp(y[b], axis=0)))
            o = b[np.argpartition(y[b, axis], len(b) // 2)]
            new += [o[: len(b) // 2], o[len(b) // 2 :]]
        buckets = new
    low, high = (np.stack([f(y[b], axis=0) for b in buckets]) for f in (np.min, np.max))
    out = []
    for a in range(0, len(yq), 256):
        far = _box_distance(yq[a : a + 256], low, high)
        near_first = np.argsort(far, axis=1)
        for i in range(len(far)):
            qi, at, best = a + i, bound[a + i], np.zeros(0)
            found = []
            for b in near_first[i]:
                if far[i, b] > max(0.0, 2 - 2 * at) * limit:
                    break
                rows = buckets[b]
                s = u[rows] @ uq[qi]
                good = s >= at - 1e-9
                good &= ids[rows] != q_ids[qi]
                if good.any():
                    found.append(rows[good])
                    best = np.sort(np.append(best, s[good]))[-k:]
                    if len(best) == k:
                        at = max(at, best[0])
            if found:
                rows = np.concatenate(found)
                # the same sum in the same order for every row: copies tie exactly
                s = (x[rows] * q[qi]).sum(1) / (np.sqrt((x[rows] * x[rows]).sum(1)) * np.sqrt((q[qi] * q[qi]).sum()))
                o = np.lexsort((ids[rows], -s))[:k]
                out += zip([int(q_ids[qi])] * len(o), ids[rows[o]].tolist(), s[o].tolist(), strict=True)
    return out


def nearest(rows: DataFrame, queries, k: int = 5, id_column: str = "vec_id", vector: str = "embedding", seen: list | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found, by cosine, of every row that `queries` (a
    condition) selects; ties go to the smaller id.

    Vectors that are null, zero, of another width than most, or hold null or non-finite components take
    no part, nor do null ids. Rows with the query's id are its own and no candidates. Fewer than k
    candidates are all returned. Other columns are ignored; an empty table gives no rows. seen: gets the numbers
    of visits of the second and third round."""
    rows = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("v"), queries.alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v")))
    d = width(rows, "v")
    rows = rows.where(F.size("v") == d)
    n = rows.count()
    project, limit = directions(d), chi_square_limit(SURE)
    every = max(1, n // SAMPLE)
    drawn = F.xxhash64("id", "v")
    sample = rows.where(F.pmod(drawn, F.lit(every)) == 0).select("id", "v").orderBy(drawn, "id").limit(2 * SAMPLE).toPandas()
    depth = math.ceil(math.log2(max(1, n) / PART)) if n > PART else 0
    cuts = Cuts(unit(matrix(sample["v"], d)) @ project, min(depth, int(math.log2(max(1, len(sample) // LEAST_SAMPLE)))) if len(sample) else 0)
    small_batches(rows.sparkSession)

    def parts(batches):
        for b in batches:
            y = unit(matrix(b["v"], d)) @ project
            yield b.assign(part=cuts.part(y, b["id"].to_numpy()))

    kind = rows.schema["v"].dataType.simpleString()
    # a row has a number of its own, since ids may repeat
    placed = written(rows.mapInPandas(parts, f"id long, v {kind}, asks boolean, part int").withColumn("row", F.monotonically_increasing_id()), "parts")
    # parts number 2 * SAMPLE / LEAST_SAMPLE at most: what is counted by part is small
    chunks = F.broadcast(placed.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / (2 * PART)).cast("int").alias("chunks")))
    stored = placed.select("id", "v", "part").join(chunks, "part").withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(5)), "chunks").cast("int"))

    def find(data: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(asks):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        got = search(matrix(data["v"], d), data["id"].to_numpy(), matrix(asks["v"], d), asks["id"].to_numpy(), k, asks["bound"].to_numpy(), project, limit)
        return pd.DataFrame(got, columns=["query_id", "vec_id", "score"])

    def searched(visits: DataFrame) -> DataFrame:
        """Each visit (row, bound, part) searched in all chunks of its part; many visits of a part are dealt to lots, each
        with a copy of the part. A visit gets its vector on the way to its task."""
        lots = F.broadcast(visits.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / QUERIES_AT_ONCE).cast("int").alias("lots")))
        data = stored.join(lots, "part").withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
        asked = visits.join(lots, "part").join(chunks, "part").withColumn("lot", F.pmod(F.xxhash64("row", F.lit(6)), "lots").cast("int"))
        asked = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).join(asking.select("row", "id", "v"), "row")
        keys = ["part", "chunk", "lot"]
        both = data.select("id", "v", *keys).groupBy(*keys).cogroup(asked.select("id", "v", "bound", *keys).groupBy(*keys))
        return both.applyInPandas(find, "query_id long, vec_id long, score double")

    def visits(first: int, last: float) -> Callable:
        """Visits of the parts within reach that are first to last in order of distance, the own one apart."""

        def run(batches):
            for b in batches:
                for a in range(0, len(b), 256):
                    some = b.iloc[a : a + 256]
                    y = unit(matrix(some["v"], d)) @ project
                    i, part, far = cuts.within(y, np.maximum(0, 2 - 2 * some["bound"].to_numpy()) * limit)
                    other = part != some["part"].to_numpy()[i]
                    i, part, far = i[other], part[other], far[other]
                    o = np.lexsort((part, far, i))
                    i, part = i[o], part[o]
                    nth = np.arange(len(i)) - np.searchsorted(i, i)
                    due = (nth >= first) & (nth < last)
                    i, part = i[due], part[due]
                    for c in range(0, len(i), 4096):
                        yield some[["row", "bound"]].iloc[i[c : c + 4096]].assign(part=part[c : c + 4096].astype(np.int32))

        return run

    asking = written(placed.where("asks").select("row", "id", "v", "part"), "asking")
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))

    def bounded(found: DataFrame) -> DataFrame:
        """The queries with the k-th cosine found so far."""
        top = found.distinct().withColumn("n", best).where(F.col("n") <= k)
        reached = top.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(-2.0).alias("bound"))
        return asking.join(reached, F.col("id") == F.col("query_id"), "left").select("row", "v", "part", F.coalesce("bound", F.lit(-2.0)).alias("bound"))

    found = written(searched(asking.select("row", "part", F.lit(-2.0).alias("bound"))), "home")
    for first, last in ((0, FEW), (FEW, math.inf)):
        if cuts.depth:
            go = written(bounded(found).mapInPandas(visits(first, last), "row long, bound double, part int"), "visits")
            if seen is not None:
                seen.append(go.count())
            found = written(found.union(searched(go)), "found")
    rank = best.cast("int")
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest found of each vector whose vec_id is divisible by 50."""
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable] = {"op7_nearest_neighbours": op7_nearest_neighbours}
ORACLE: dict[str, str] = {}
