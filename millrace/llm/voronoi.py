"""Exact top-k by integer inner product: a Voronoi join.

A vector x gets one more component, the square root of R^2 - |x|^2 with R the greatest length, and a query q a zero:
then the squared distance of the two is |q|^2 + R^2 - 2 q.x, and the largest products are the nearest neighbours.
Queries and data lie in the cells of common pivots. Summaries of the cells bound how far the k-th neighbour of any
query of a cell can be: a query is at most the cell's radius from its pivot, and the nearest data of every cell
are known distances from theirs. Data goes only to groups of cells for which neither the triangle inequality nor the
product with the pivot, give or take the radius times the length, rules it out, and each group's lots of queries are solved against each chunk of its data in tasks of bounded size, block by
block, the nearest first, past blocks that can't hold a neighbour.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.embeddings import codebook
from millrace.llm.shared import small_batches, table, written
from millrace.llm.vectors import matrix, width

BEST, SCALE = 20, 64
#: Pivots at most, and rows for each; rows of the sample that pivots come from; queries of a lot; rows of a chunk and a block.
PIVOTS, ROWS_A_PIVOT, SAMPLE, LOT, CHUNK, BLOCK = 1024, 256, 1 << 14, 2048, 1 << 14, 1024
#: Products below this are whole numbers in doubles; what distances are given for rounding, as a share of R.
WHOLE, SLACK = 2**53, 1e-6
_OWN = np.iinfo(np.int64).min


def distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ p.T + (p * p).sum(1)[None], 0))


@dataclass
class Cells:
    """Pivots (with the added component), R, and by pivot: the radius of its queries with the added component (negative:
    none) and without, how far the k-th neighbour of each can be, how small their k-th product, and the pivot's group;
    by group: lots of queries and chunks of data."""

    pivots: np.ndarray
    reach: float
    whole: bool
    radius: np.ndarray | None = None
    inner: np.ndarray | None = None
    bound: np.ndarray | None = None
    floor: np.ndarray | None = None
    group: np.ndarray | None = None
    lots: np.ndarray | None = None
    chunks: np.ndarray | None = None

    def data(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(self.reach**2 - (x * x).sum(1), 0))[:, None]])

    def queries(self, q: np.ndarray) -> np.ndarray:
        return np.hstack([q, np.zeros((len(q), 1))])

    def near(self, x: np.ndarray) -> np.ndarray:
        """Distances of data to all pivots."""
        return distances(self.data(x), self.pivots)

    def toward(self, x: np.ndarray) -> np.ndarray:
        """Inner products with all pivots."""
        return x @ self.pivots[:, :-1].T

    def needed(self, x: np.ndarray) -> np.ndarray:
        """Whether each row may be a neighbour of a query of each group."""
        asked = (self.radius >= 0)[None]
        if self.whole:
            may = asked & (self.near(x) - self.radius[None] <= self.bound[None] + SLACK * self.reach)
            may &= self.toward(x) + np.sqrt((x * x).sum(1))[:, None] * self.inner[None] >= self.floor[None] - SLACK * self.reach**2
        else:
            may = np.repeat(asked, len(x), 0)
        out = np.zeros((len(x), len(self.lots)), bool)
        for g in range(len(self.lots)):
            out[:, g] = may[:, self.group == g].any(1)
        return out


def grouped(pivots: np.ndarray, queries: np.ndarray, most: int) -> np.ndarray:
    """A group for each pivot with queries (others: -1): neighbouring cells of some `most` queries together, halved
    along the widest axis until they are no more or one cell."""
    out, stack, g = np.full(len(pivots), -1), [np.flatnonzero(queries)], 0
    while stack:
        some = stack.pop()
        if not len(some):
            continue
        if len(some) == 1 or queries[some].sum() <= most:
            out[some] = g
            g += 1
            continue
        axis = int(np.argmax(np.ptp(pivots[some], axis=0)))
        some = some[np.argsort(pivots[some, axis], kind="stable")]
        cut = int(np.searchsorted(np.cumsum(queries[some]), queries[some].sum() / 2)) + 1
        cut = min(max(1, cut), len(some) - 1)
        stack += [some[:cut], some[cut:]]
    return out


def products(q: np.ndarray, x: np.ndarray, whole: bool) -> np.ndarray:
    """Inner products as longs; those that doubles can't hold exactly in whole numbers of any size, then cut to longs."""
    if whole:
        return (q @ x.T).astype(np.int64)
    big = np.array([[int(v) for v in r] for r in q], object).reshape(q.shape) @ np.array([[int(v) for v in r] for r in x], object).reshape(x.shape).T
    return np.clip(big, _OWN + 1, np.iinfo(np.int64).max).astype(np.int64)


def solve(cells: Cells, x: np.ndarray, ids: np.ndarray, cell: np.ndarray, far: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(place of the query, vector, product) of the k best of each query, ties to smaller ids, and how many products
    were formed."""
    o = np.lexsort((ids, cell))
    x, ids, cell, far = x[o], ids[o], cell[o], far[o]
    start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    cuts = np.unique(np.concatenate([np.arange(a, b, BLOCK) for a, b in zip(start, np.append(start[1:], len(x)), strict=True)] + [[len(x)]]))
    blocks = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
    pivots, length = cells.pivots[:, :-1], np.sqrt((q * q).sum(1))
    # no row of a block is nearer, none has a larger product: by the block's farthest row from its pivot
    to_pivot, toward = distances(cells.queries(q), cells.pivots), cells.toward(q)
    least = np.stack([to_pivot[:, cell[a]] - far[a:b].max() for a, b in blocks], 1)
    most_there = np.stack([toward[:, cell[a]] + length * np.sqrt(((x[a:b] - pivots[cell[a]]) ** 2).sum(1).max()) for a, b in blocks], 1)
    at, vec, best = np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0, np.int64)
    bar, formed = np.full(len(q), _OWN), 0
    nearest = most_there.argmax(1)
    order = np.argsort(-most_there.max(0), kind="stable").tolist()
    for j, home in [(j, True) for j in order] + [(j, False) for j in order]:  # each query's nearest block comes first
        a, b = blocks[j]
        due = (nearest == j) == home
        if not home and cells.whole:
            reached = np.sqrt(np.maximum(length**2 + cells.reach**2 - 2.0 * bar, 0)) + SLACK * cells.reach
            due &= (bar == _OWN) | ((least[:, j] <= reached) & (most_there[:, j] >= bar - SLACK * cells.reach**2))
        rows = np.flatnonzero(due)
        if not len(rows):
            continue
        s = products(q[rows], x[a:b], cells.whole)
        formed += s.size
        own = np.searchsorted(ids[a:b], q_ids[rows])
        hit = np.flatnonzero(ids[a:b][np.minimum(own, b - a - 1)] == q_ids[rows])
        s[hit, own[hit]] = _OWN
        most = bar[rows] if b - a <= k else np.maximum(bar[rows], np.partition(s, b - a - k, axis=1)[:, b - a - k])
        r, c = np.nonzero((s >= most[:, None]) & (s > _OWN))
        at, vec, best = np.concatenate([at, rows[r]]), np.concatenate([vec, ids[a:b][c]]), np.concatenate([best, s[r, c]])
        o = np.lexsort((vec, -best, at))
        at, vec, best = at[o], vec[o], best[o]
        nth = np.arange(len(at)) - np.searchsorted(at, at)
        full = at[nth == k - 1]
        bar[full] = best[nth == k - 1]
        at, vec, best = at[nth < k], vec[nth < k], best[nth < k]
    return at, vec, best, formed


def planned(placed: DataFrame, cells: Cells, sample: np.ndarray, n: int, k: int) -> None:
    """The bounds, groups, lots and chunks, from summaries of bounded size."""
    m = len(cells.pivots)
    count, cells.radius, cells.inner, shortest = np.zeros(m, np.int64), np.full(m, -1.0), np.zeros(m), np.zeros(m)
    for c, rows, most, gap, short in placed.where("asks").groupBy("q_cell").agg(F.count(F.lit(1)), F.max("q_far"), F.max("q_gap"), F.min("length")).collect():
        count[c], cells.radius[c], cells.inner[c], shortest[c] = rows, most, gap, short
    nth = F.row_number().over(W.partitionBy("cell").orderBy("far"))
    some = placed.select("cell", "far").withColumn("nth", nth).where(F.col("nth") <= k + 1).toPandas()  # k + 1 rows a pivot
    between, near, toward, lengths = distances(cells.pivots, cells.pivots), cells.near(sample), cells.toward(sample), np.sqrt((sample * sample).sum(1))
    cell, far = some["cell"].to_numpy(int), some["far"].to_numpy(float)
    cells.bound, cells.floor = np.full(m, math.inf), np.full(m, -math.inf)
    for i in np.flatnonzero(cells.radius >= 0):
        for known in (between[i, cell] + far, near[:, i]):  # by way of their pivots; straight
            if len(known) > k:
                cells.bound[i] = min(cells.bound[i], float(np.partition(known, k)[k]) + cells.radius[i])
        cells.floor[i] = (shortest[i] ** 2 + cells.reach**2 - cells.bound[i] ** 2) / 2
        if len(sample) > k:
            cells.floor[i] = max(cells.floor[i], -float(np.partition(lengths * cells.inner[i] - toward[:, i], k)[k]))
    cells.group = grouped(cells.pivots, count, LOT)
    groups = int(cells.group.max()) + 1
    size = np.bincount(cells.group[cells.group >= 0], count[cells.group >= 0], minlength=groups)
    cells.lots, cells.chunks = np.maximum(1, np.ceil(size / LOT)).astype(int), np.ones(groups, int)
    share = cells.needed(sample).mean(0) if len(sample) else np.ones(groups)
    cells.chunks = np.maximum(1, np.ceil(share * n / CHUNK)).astype(int)  # sizes only: rows aren't chosen by it


def joined(rows: DataFrame, queries: Column, k: int = BEST, id_column: str = "vec_id", vector: str = "embedding", seen: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of every row that `queries` (a condition)
    selects with the other rows, components made whole by floor(64 * x); ties go to the smaller id.

    Vectors that are null, of another width than most, or hold null or non-finite components (64 times, too) take no
    part, nor do null ids; zero vectors do. Rows that repeat an id count once, by the least of their vectors. Fewer
    than k candidates are all returned. Other columns are ignored; an empty table gives no rows. Products beyond a
    long are cut to its range. seen: gets the numbers of rows sent to groups and of groups."""
    small_batches(rows.sparkSession)
    rows = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(SCALE * x.cast("double")) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)))
    d = width(rows, "v")
    rows = rows.where(F.size("v") == d)
    if rows.groupBy("id").count().where("count > 1").limit(1).count():
        rows = rows.groupBy("id").agg(F.min("v").alias("v"), F.max("asks").alias("asks"))
    kind = rows.schema["v"].dataType.simpleString()
    made = lambda v: F.transform(v, lambda x: F.floor(SCALE * x.cast("double")).cast("double"))
    square = F.aggregate(made(F.col("v")), F.lit(0.0), lambda s, x: s + x * x)
    n, longest, most = rows.agg(F.count(F.lit(1)), F.sqrt(F.max(square)), F.max(F.array_max(F.transform(made(F.col("v")), F.abs)))).first()
    drawn = F.xxhash64("id", F.lit(17))
    sample = rows.where(F.pmod(drawn, F.lit(max(1, n // SAMPLE))) == 0).select("id", "v").orderBy(drawn, "id").limit(2 * SAMPLE).toPandas()["v"]
    whole = n == 0 or d * (most + 1) ** 2 < WHOLE
    cells = Cells(np.zeros((1, d + 1)), longest or 0.0, whole)
    ints = lambda column: np.floor(SCALE * matrix(column, d))
    x = ints(sample) if whole else np.zeros((0, d))
    if len(x):
        cells.pivots = codebook(cells.data(x), min(PIVOTS, max(1, n // ROWS_A_PIVOT)))

    def assign(batches):
        for b in batches:
            z, asks = ints(b["v"]), b["asks"].to_numpy(bool)
            if not whole:
                yield b.assign(cell=0, far=0.0, q_cell=0, q_far=0.0, q_gap=0.0, length=0.0)
                continue
            far, q_far = cells.near(z), distances(cells.queries(z), cells.pivots)
            cell, q_cell = far.argmin(1), q_far.argmin(1)
            at, gap = np.arange(len(z)), z - cells.pivots[q_cell, :-1]
            yield b.assign(cell=cell, far=far[at, cell], q_cell=np.where(asks, q_cell, -1), q_far=q_far[at, q_cell], q_gap=np.sqrt((gap * gap).sum(1)), length=np.sqrt((z * z).sum(1)))

    placed = written(rows.mapInPandas(assign, f"id long, v {kind}, asks boolean, cell int, far double, q_cell int, q_far double, q_gap double, length double"), "placed")
    planned(placed, cells, x, n, k)

    def dealt(ids: np.ndarray, parts: np.ndarray, seed: int) -> np.ndarray:
        h = (ids.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        return ((h >> np.uint64(33)) % parts.astype(np.uint64)).astype(int)

    def copied(b: pd.DataFrame, at: np.ndarray, group: np.ndarray, one: str, parts: np.ndarray, many: str, times: np.ndarray, seed: int):
        """Rows b[at] of groups: dealt to one of `parts`, copied to all of `times`."""
        own = dealt(b["id"].to_numpy()[at], parts[group], seed)
        n_ = times[group]
        rep = np.repeat(np.arange(len(at)), n_)
        nth = np.arange(len(rep)) - np.repeat(np.cumsum(n_) - n_, n_)
        for i in range(0, len(rep), 4096):
            r = rep[i : i + 4096]
            yield b.iloc[at[r]].assign(**{"group": group[r], one: own[r], many: nth[i : i + 4096]})

    def sent(batches):
        for b in batches:
            at, group = np.nonzero(cells.needed(ints(b["v"])))
            yield from copied(b, at, group, "chunk", cells.chunks, "lot", cells.lots, 1)

    def asking(batches):
        for b in batches:
            yield from copied(b.drop(columns="q_cell"), np.arange(len(b)), cells.group[b["q_cell"].to_numpy()], "lot", cells.lots, "chunk", cells.chunks, 2)

    data = placed.select("id", "v", "cell", "far").mapInPandas(sent, f"id long, v {kind}, cell int, far double, group int, chunk int, lot int")
    asks = placed.where("asks").select("id", "v", "q_cell").mapInPandas(asking, f"id long, v {kind}, group int, lot int, chunk int")
    if seen is not None:
        seen |= {"sent": data.count(), "groups": len(cells.lots)}
    keys = ["group", "lot", "chunk"]

    def find(some: pd.DataFrame, wants: pd.DataFrame) -> pd.DataFrame:
        if not len(some) or not len(wants):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        q_ids = wants["id"].to_numpy()
        at, vec, score, _ = solve(cells, ints(some["v"]), some["id"].to_numpy(), some["cell"].to_numpy(), some["far"].to_numpy(), ints(wants["v"]), q_ids, k)
        return pd.DataFrame({"query_id": q_ids[at], "vec_id": vec, "score": score})

    found = data.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInPandas(find, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest products of each vector whose vec_id is divisible by 20."""
    return joined(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS z FROM embeddings
   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.z, c.z)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""

QUERIES: dict[str, Callable] = {"op13_exact_top_k": op13_exact_top_k}
ORACLE: dict[str, str] = {"op13_exact_top_k": SQL}
