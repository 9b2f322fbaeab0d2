"""Near-duplicate embeddings by an inverted multi-index.

The halves of unit vectors have a codebook each; their product is a grid of cells and every vector lies
in the cell of its nearest codes. A vector visits cells in order of the sum of its squared distances to
their two codes (the multi-sequence order) until the sum exceeds that of its own cell by a reach; the
reach is calibrated on a bounded sample of queries, compared with all rows and with partners made at the least
cosine that links, so that nearly every query finds the target share of its partners. What
visitors meet in a cell is verified by the exact cosine. A pair that would be met in both vectors' cells
is counted in one of them. Cells with many vectors are cut into lots, every two of which meet in a task
of their own. A task returns sums per vector and a forest of links, never all pairs.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.graph import components
from millrace.llm.shared import table, written
from millrace.llm.simhash import roots
from millrace.llm.vectors import matrix, unit, usable, width

LEAST, RECALL = 0.9, 0.985
#: Rows that the codebooks are fitted on and queries that the reach is calibrated on, at most or so; rows of
#: a lot; codes of a half at most; what is added for rounding before the exact sum decides.
FITTED, CALIBRATED, LOT, CODES, SEED, SLACK = 1 << 14, 512, 1024, 4096, 11, 1e-9
#: Sampled queries with partners that set the reach alone; made partners stand in for those missing.
ENOUGH = 128


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's means of the rows of x."""
    if len(x) <= k:
        return x if len(x) else np.zeros((1, x.shape[1]))
    c = x[np.random.default_rng(SEED).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        of = np.argmin(_squared(x, c), 1)
        n = np.bincount(of, minlength=k)
        s = np.zeros_like(c)
        np.add.at(s, of, x)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c)
    return c


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None], 0)


class Grid:
    def __init__(self, first: np.ndarray, second: np.ndarray, reach: float = 0.0):
        self.books, self.reach, self.half = (first, second), reach, first.shape[1]

    def excess(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances to the codes of either half, less the least."""
        out = [_squared(u[:, : self.half], self.books[0]), _squared(u[:, self.half :], self.books[1])]
        return tuple(x - x.min(1, keepdims=True) for x in out)

    def cells(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.argmin(a, 1) * len(self.books[1]) + np.argmin(b, 1)

    def visited(self, a: np.ndarray, b: np.ndarray) -> list[int]:
        """Cells that one vector visits (a, b: its excess), nearest first: its own comes first."""
        i, j = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        i, j = i[a[i] <= self.reach], j[b[j] <= self.reach]
        x, y, i, j = a[i].tolist(), b[j].tolist(), i.tolist(), j.tolist()
        out, heap, n = [], [(0.0, 0, 0)], len(self.books[1])
        while heap:
            s, p, q = heapq.heappop(heap)
            if s > self.reach:
                break
            out.append(i[p] * n + j[q])
            if q + 1 < len(y):
                heapq.heappush(heap, (x[p] + y[q + 1], p, q + 1))
            if q == 0 and p + 1 < len(x):
                heapq.heappush(heap, (x[p + 1] + y[0], p + 1, 0))
        return out


def made_partners(u: np.ndarray, half: int) -> np.ndarray:
    """A unit vector at cosine LEAST from each row of u, the hardest that link: it differs in a random direction of the
    whole space, of one half of the components, or of four of them, in turn."""
    rng = np.random.default_rng(SEED)
    n, d = u.shape
    mask = np.ones((n, d))
    mask[1::4, half:] = 0
    mask[2::4, :half] = 0
    few = np.argsort(rng.random((n, d)), axis=1) < min(4, d)
    mask[3::4] = few[3::4]
    own = u * mask
    w = rng.standard_normal((n, d)) * mask
    w -= own * ((w * own).sum(1) / np.maximum((own * own).sum(1), 1e-300))[:, None]  # at right angles to u
    size = np.sqrt((w * w).sum(1))
    ok = size > 1e-9
    w[ok] /= size[ok, None]
    return np.where(ok[:, None], LEAST * u + math.sqrt(1 - LEAST**2) * w, u)


def _grid(rows: DataFrame, n: int, d: int) -> Grid:
    """Codebooks from a sample of rows, and the reach with which the share RECALL of partners is found, whichever of
    the two visits the other: of the true partners of sampled queries, each query counting alike however many it has,
    and, with the weight of those missing where fewer than ENOUGH have any, of partners made for all."""

    def drawn(most: int, seed: int) -> DataFrame:
        h = F.xxhash64("v", F.lit(seed))
        return rows.where(F.pmod(h, F.lit(max(1, n // most))) == 0).orderBy(h, "id").limit(2 * most)

    u = unit(matrix(drawn(FITTED, 1).select("v").toPandas()["v"], d))
    k = int(min(CODES, max(4, 2 ** round(math.log2(max(1.0, math.sqrt(n) / 16))))))  # some 256 vectors a cell: fewer cells, fewer visits to ship
    half = max(1, d // 2)
    grid = Grid(codebook(u[:, :half], k), codebook(u[:, half:], k))
    asked = drawn(CALIBRATED, 2).select("id", "v").toPandas()
    q, ids = unit(matrix(asked["v"], d)), asked["id"].to_numpy()
    qa, qb = grid.excess(q)
    own, width_ = grid.cells(qa, qb), len(grid.books[1])

    def partners(batches):
        for b in batches:
            x = unit(matrix(b["v"], d))
            for i in range(0, len(x), 4096):
                part = x[i : i + 4096]
                row, col = np.nonzero(part @ q.T >= LEAST - SLACK)
                keep = b["id"].to_numpy()[i : i + 4096][row] != ids[col]
                row, col = row[keep], col[keep]
                a, c = grid.excess(part)
                cell = grid.cells(a, c)
                there = qa[col, cell[row] // width_] + qb[col, cell[row] % width_]
                back = a[row, own[col] // width_] + c[row, own[col] % width_]
                yield pd.DataFrame({"query": col, "excess": np.minimum(there, back)})

    if not len(q):
        return grid
    seen = rows.mapInPandas(partners, "query long, excess double").groupBy("query").agg(F.percentile_approx("excess", RECALL, 10_000).alias("needs")).toPandas()
    ma, mb = grid.excess(made_partners(q, half))
    cell = grid.cells(ma, mb)
    at = np.arange(len(q))
    there = qa[at, cell // width_] + qb[at, cell % width_]
    back = ma[at, own // width_] + mb[at, own % width_]
    need = float(np.quantile(np.minimum(there, back), RECALL))
    known = min(1.0, len(seen) / ENOUGH)
    if len(seen):
        need = known * float(np.quantile(seen["needs"], RECALL)) + (1 - known) * need
    grid.reach = need * 1.1 + 0.01
    return grid


def _pairs(grid: Grid, d: int) -> Callable:
    """What a task does: members of a cell with each other (both sides "left"), or with the visitors or
    members on the right."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        kind = int(key[1])
        u, ids, m = unit(matrix(pdf["v"], d)), pdf["id"].to_numpy(), pdf["n"].to_numpy()
        left, right = np.flatnonzero(~pdf["right"].to_numpy()), np.flatnonzero(pdf["right"].to_numpy())
        same = kind == 0
        if same:
            right = left
        if not len(left) or not len(right):
            return pd.DataFrame({"id": [], "n": [], "to": []}, dtype="int64")
        if kind == 2:  # visitors from other cells: is the pair met in their cell too?
            la, lb = grid.excess(u[left])
            cell = grid.cells(*grid.excess(u[right]))
            wide = len(grid.books[1])
        sums, up = np.zeros(len(pdf), np.int64), np.arange(len(pdf))
        for a in range(0, len(left), 512):
            i = left[a : a + 512]
            hit = u[i] @ u[right].T >= LEAST - SLACK
            if same:
                hit &= right[None] > i[:, None]
            elif kind == 2:
                also = la[a : a + 512][:, cell // wide] + lb[a : a + 512][:, cell % wide] <= grid.reach
                hit &= ~(also & (ids[right][None] > ids[i][:, None]))
            row, col = np.nonzero(hit)
            if len(row):
                # near the bound, the sum in a fixed order decides
                x, y = u[i[row]], u[right[col]]
                exact = (x * y).sum(1)
                ok = exact >= LEAST
                row, col = row[ok], col[ok]
                np.add.at(sums, i[row], m[right[col]])
                np.add.at(sums, right[col], m[i[row]])
                up = roots(len(up), up[i[row]], up[right[col]])[up]
        touched = np.flatnonzero(sums)
        return pd.DataFrame({"id": ids[touched], "n": sums[touched], "to": ids[up[touched]]})

    return run


def near_duplicates(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row: the number of other vectors linked directly
    by a cosine of LEAST or more, the least id that links reach, and whether it is the row's own.

    Equal vectors are one while pairs are sought, with their number. Vectors that are null, zero, of
    another width than most, or hold null or non-finite components link with nothing. Rows that repeat
    an id are vectors of their own; null ids link with nothing. Other columns are ignored; an empty table
    gives no rows."""
    rows = written(rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).alias("v")), "vectors")
    fit_ = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    d = width(fit_, "v")
    fit_ = fit_.where(F.size("v") == d)
    classes = written(fit_.groupBy("v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n")), "classes")
    grid = _grid(classes.select("id", "v"), classes.count(), d)

    def visits(batches):
        for b in batches:
            u = unit(matrix(b["v"], d))
            for i in range(0, len(u), 1024):
                a, c = grid.excess(u[i : i + 1024])
                cells = [grid.visited(x, y) for x, y in zip(a, c, strict=True)]
                at = np.repeat(np.arange(len(cells)), [len(x) for x in cells])
                flat = np.concatenate([np.array(x, np.int64) for x in cells]) if cells else np.zeros(0, np.int64)
                first = np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.zeros(0, bool)
                yield b[["id", "n"]].iloc[i + at].assign(cell=flat, member=first)

    met = written(classes.mapInPandas(visits, "id long, n long, cell long, member boolean"), "visits")
    counts = met.groupBy("cell").agg(F.sum(F.col("member").cast("int")).alias("m"), F.sum((~F.col("member")).cast("int")).alias("o")).where("m > 0")
    lots = counts.select(F.col("cell").alias("_c"), F.ceil(F.col("m") / LOT).cast("int").alias("ml"), F.greatest(F.ceil(F.col("o") / LOT), F.lit(0)).cast("int").alias("ol"))
    met = met.join(lots, F.col("cell") == F.col("_c")).drop("_c")
    lot = lambda n: F.pmod(F.xxhash64("id"), F.greatest(n, F.lit(1))).cast("int")
    member = met.where("member").withColumn("lot", lot(F.col("ml")))
    # members of one lot, of two lots, and members with visitors
    task = lambda kind, a, b, right: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), right.alias("right"))
    with_members = F.transform(F.sequence(F.lit(0), F.col("ml") - 1), lambda x: task(1, F.least(x, F.col("lot")), F.greatest(x, F.col("lot")), F.col("lot") > x))
    with_members = F.transform(with_members, lambda t: F.struct(F.when(t["a"] == t["b"], 0).otherwise(1).alias("kind"), t["a"].alias("a"), t["b"].alias("b"), t["right"].alias("right")))
    with_visitors = F.when(F.col("ol") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("ol") - 1, F.lit(0))), lambda x: task(2, F.col("lot"), x, F.lit(False)))).otherwise(F.slice(with_members, 1, 0))
    member = member.select("id", "n", "cell", F.explode(F.concat(with_members, with_visitors)).alias("t"))
    visitor = met.where("not member").withColumn("lot", lot(F.col("ol")))
    visitor = visitor.select("id", "n", "cell", F.explode(F.transform(F.sequence(F.lit(0), F.col("ml") - 1), lambda x: task(2, x, F.col("lot"), F.lit(True)))).alias("t"))
    tasks = member.union(visitor).select("id", "n", "cell", "t.kind", "t.a", "t.b", "t.right")
    # vectors come in only now, on their way to the tasks
    tasks = tasks.join(classes.select("id", "v"), "id")
    # by all four: the rows come dealt by cell, which would keep a hot cell's tasks together
    tasks = tasks.repartition("cell", "kind", "a", "b")
    found = written(tasks.groupBy("cell", "kind", "a", "b").applyInPandas(_pairs(grid, d), "id long, n long, to long"), "found")
    sums = found.groupBy("id").agg(F.sum("n").alias("more"))
    groups = components(found.select(F.col("id").alias("src"), F.col("to").alias("dst")))
    classes = classes.join(sums, "id", "left").join(groups, "id", "left")
    classes = classes.select("v", (F.coalesce("more", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    whole = fit_.join(classes, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where(F.col("vec_id").isNull() | ~usable(F.col("v")) | (F.size("v") != d)).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return whole.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES: dict[str, Callable] = {"op6_embedding_near_dedup": op6_embedding_near_dedup}
ORACLE: dict[str, str] = {}
