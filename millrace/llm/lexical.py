"""Ranked lexical search by trees of maxima over ranges of documents.

Documents are read once and kept as counts of the terms that queries ask. Chunks of documents, in order of id, get
a tree for each term: a node has the largest score that the term gives any document of a range, and the nodes
of a range's parts. A query sums its terms' nodes of a range to a bound of what any document there can reach and
descends best-first, the highest sum next, until no range can beat its k-th document; ranges of a bound equal
to it are opened as long as they may hold a smaller id. A first search of a share of the documents tells the score
that each query has for certain, so that the search of all opens and returns little else.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from heapq import heappop, heappush, heapreplace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.shared import MARKS, small_batches, steps, table, text_bytes, words, written

#: Results of a query; parts of a range; documents and counts of a chunk, at most; queries' terms of a pass, about;
#: of so many documents one is searched first.
BEST, FAN, DOCS, COUNTS, TERMS, FIRST = 10, 16, 4096, 1 << 20, 1 << 18, 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts, one after another, and their number by text: A-Z in lower case, ASCII but letters and
    digits between them."""
    starts, ends, counts = words(data, offsets, MARKS)
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    solid = _LOWER[data[~MARKS[data]]]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(solid))), counts


def asked_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, term, times) of all queries; those without an id aren't asked."""

    def run(batches):
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            for i, j in steps(offsets):
                found, counts = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(i, j), counts))), found.cast(pa.string())], ["item", "term"])

    rows = items.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("item"), F.col(text).alias("text"))
    small_batches(items.sparkSession)
    return rows.mapInArrow(run, "item long, term string").groupBy("item", "term").agg(F.count(F.lit(1)).alias("times"))


def counted(docs: DataFrame, key: str, text: str, terms: pa.Array) -> DataFrame:
    """(doc, n, terms, counts, docs) of the documents that hold any of `terms`: n, all terms of the document; counts of
    those asked, by their places. Rows with `docs` aren't documents but sums of many: documents with terms, their terms
    in all and how many documents hold each term."""

    def run(batches):
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            for i, j in steps(offsets):
                found, n = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                at = pc.fill_null(pc.index_in(found, value_set=terms), -1).to_numpy()
                known = at >= 0
                pair, tf = np.unique(np.repeat(np.arange(j - i), n)[known] * np.int64(len(terms)) + at[known], return_counts=True)
                of, term = np.divmod(pair, max(1, len(terms)))
                held, df = np.unique(term, return_counts=True)
                sums = pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([int(n.sum())]), pa.array([held.tolist()], pa.list_(pa.int32())), pa.array([df.tolist()], pa.list_(pa.int32())), pa.array([int((n > 0).sum())])], names)
                some, first = np.unique(of, return_index=True)
                cut = pa.array(np.append(first, len(of)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cut, pa.array(x.astype(np.int32))) for x in (term, tf)]
                rows = pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).take(pa.array(some)), pa.array(n[some].astype(np.int64)), *lists, pa.nulls(len(some), pa.int64())], names)
                yield sums
                yield rows.filter(rows.column(0).is_valid())

    names = ["doc", "n", "terms", "counts", "docs"]
    small_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).mapInArrow(run, "doc long, n long, terms array<int>, counts array<int>, docs long")


class Tree:
    """The trees of a chunk: ids ascending; of each count its document's place, term and score of the term there."""

    def __init__(self, ids: np.ndarray, place: np.ndarray, term: np.ndarray, score: np.ndarray, terms: int):
        o = np.lexsort((place, term))
        term, node, most, first = term[o], place[o].astype(np.int64), score[o], None
        self.ids, self.levels = ids, [(node, most, first)]
        while True:
            node = node // FAN
            first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (node[1:] != node[:-1])])
            most = np.maximum.reduceat(most, first)
            self.levels.append((node[first], most, np.append(first, len(node))))
            term, node = term[first], node[first]
            if not node.any():
                break
        self.root = np.full(terms, -1)
        self.root[term] = np.arange(len(term))

    def search(self, terms: np.ndarray, times: np.ndarray, best: list, k: int, floor: int) -> int:
        """Adds the chunk's documents to best, a heap of the k best (score, -id); floor: scores below it aren't wanted.
        Returns how many ranges were opened."""
        at = self.root[terms]
        at, times = at[at >= 0], times[at >= 0]
        if not len(at):
            return 0

        def wanted(bound: int, least: int) -> bool:
            return bound >= floor and (len(best) < k or (bound, -least) > best[0])

        top, opened = len(self.levels) - 1, 0
        heap = [(-int((self.levels[top][1][at] * times).sum()), int(self.ids[0]), top, 0, at, times)]
        while heap:
            bound, least, level, node, at, times = heappop(heap)
            if not wanted(-bound, least):
                break
            opened += 1
            first = self.levels[level][2]
            below, most, _ = self.levels[level - 1]
            n = first[at + 1] - first[at]
            inner = np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            times = np.repeat(times, n)
            part = below[inner] - node * FAN
            sums = np.zeros(FAN, np.int64)
            np.add.at(sums, part, most[inner] * times)
            bar = max(floor, best[0][0]) if len(best) >= k else floor
            due = np.flatnonzero(sums >= bar)
            if level == 1:
                for c in due.tolist():
                    found = (int(sums[c]), -int(self.ids[node * FAN + c]))
                    if len(best) < k:
                        heappush(best, found)
                    elif found > best[0]:
                        heapreplace(best, found)
                continue
            o = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[o], np.arange(FAN + 1))
            for c in due.tolist():
                own = o[cut[c] : cut[c + 1]]
                lower = node * FAN + c
                heappush(heap, (-int(sums[c]), int(self.ids[lower * FAN ** (level - 1)]), level - 1, lower, inner[own], times[own]))
        return opened


class Queries:
    """The queries of a pass: terms, their weights, and each query's terms with their number."""

    def __init__(self, asked: pd.DataFrame):
        self.terms, term = np.unique(asked["term"].to_numpy(object).astype(str), return_inverse=True) if len(asked) else (np.zeros(0, str), np.zeros(0, int))
        o = np.argsort(asked["item"].to_numpy(np.int64), kind="stable")
        self.items, self.first = np.unique(asked["item"].to_numpy(np.int64)[o], return_index=True)
        self.first = np.append(self.first, len(o))
        self.term, self.times = term[o], asked["times"].to_numpy(np.int64)[o]

    def weighed(self, docs: int, total: int, df: dict[int, int]) -> None:
        """docs, total: documents with terms and their terms; df: documents that hold a term, by place."""
        self.docs, self.total = docs, total
        self.weight = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(self.terms))], np.int64)

    def chunks(self, batches) -> Iterator[Tree]:
        held, rows, counts = [], 0, 0

        def built() -> Tree:
            ids, n = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in (0, 1))
            sizes, term, tf = (np.concatenate([f(b) for b in held]) for f in (lambda b: pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False), lambda b: b.column(2).flatten().to_numpy(), lambda b: b.column(3).flatten().to_numpy().astype(np.int64)))
            o = np.argsort(ids, kind="stable")
            place = np.empty(len(o), np.int64)
            place[o] = np.arange(len(o))
            m = 25 + (75 * n * self.docs) // self.total
            score = self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, sizes)))
            return Tree(ids[o], np.repeat(place, sizes), term, score, len(self.terms))

        for b in batches:
            for i in range(0, b.num_rows, 256):
                held.append(b.slice(i, 256))
                rows, counts = rows + held[-1].num_rows, counts + pc.sum(pc.list_value_length(held[-1].column(2))).as_py()
                if rows + 256 > DOCS or counts >= COUNTS:
                    yield built()
                    held, rows, counts = [], 0, 0
        if rows:
            yield built()


def searched(index: DataFrame, queries: Queries, k: int, floors: np.ndarray) -> DataFrame:
    """(item, doc, score): of each task's documents the k best of each query that reach its floor."""

    def run(batches):
        best: list[list] = [[] for _ in queries.items]
        for tree in queries.chunks(batches):
            for i in range(len(best)):
                a, b = queries.first[i], queries.first[i + 1]
                tree.search(queries.term[a:b], queries.times[a:b], best[i], k, int(floors[i]))
        for i in range(0, len(best), 1024):
            found = [(int(queries.items[i + x]), -d, s) for x, heap in enumerate(best[i : i + 1024]) for s, d in heap]
            yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in range(3)], ["item", "doc", "score"])

    small_batches(index.sparkSession)
    return index.select("doc", "n", "terms", "counts").mapInArrow(run, "item long, doc long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = BEST, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", query: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest scores above 0 of each item, equal scores by id.

    Null and empty texts have no terms. Documents without an id count in all statistics but aren't returned; those
    that repeat an id are documents of their own, so an id may come twice. Rows that repeat an item's id are one item
    with the terms of all; items without an id or without terms that any document holds give no rows. Other columns
    are ignored. Queries are taken in passes of some TERMS terms, which the driver holds, each over all documents."""
    spark = docs.sparkSession
    asked = written(asked_terms(items, item_id, query), "asked")
    found = None
    passes = max(1, math.ceil(asked.count() / TERMS))
    best = W.partitionBy("item").orderBy(F.desc("score"), "doc")
    for p in range(passes):
        queries = Queries(asked.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == p).orderBy("item", "term").toPandas())
        index = written(counted(docs, doc_id, text, pa.array(queries.terms.tolist(), pa.large_string())), "counts")
        sums = index.where("docs is not null")
        n, total = sums.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = sums.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy("t.terms").agg(F.sum("t.counts").alias("df")).collect()
        queries.weighed(n, max(1, total), {r[0]: r[1] for r in df})
        index = index.where("docs is null")
        floors = np.ones(len(queries.items), np.int64)
        some = searched(index.where(F.pmod(F.xxhash64("doc", F.lit(3)), F.lit(FIRST)) == 0), queries, k, floors)
        sure = some.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("item", "score").collect()
        floors[np.searchsorted(queries.items, [r[0] for r in sure])] = [r[1] for r in sure]
        some = written(searched(index, queries, k, floors), "found")
        found = some if found is None else found.union(some)
    rank = F.row_number().over(best)
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of every benchmark item."""
    return ranked(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


SQL = r"""
WITH r0 AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
 t AS (SELECT row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM r0),
 d AS (SELECT row, any_value(doc_id) AS doc_id, count(*) AS n FROM t GROUP BY row),
 s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM d),
 p AS (SELECT row, term, count(*) AS tf FROM t GROUP BY row, term),
 w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term),
 q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
 a AS (SELECT item_id, term, count(*) AS times FROM q WHERE item_id IS NOT NULL GROUP BY item_id, term),
 r AS (SELECT a.item_id, d.doc_id, p.row, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // total))))::BIGINT AS score
   FROM a JOIN p ON a.term = p.term JOIN w ON w.term = a.term JOIN d ON d.row = p.row, s WHERE d.doc_id IS NOT NULL GROUP BY a.item_id, d.doc_id, p.row)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM r WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""

QUERIES: dict[str, Callable] = {"op12_lexical_search": op12_lexical_search}
ORACLE: dict[str, str] = {"op12_lexical_search": SQL}
