"""Ports and bounded helpers of the question path: query windows, stand-in vectors, degradation, plans."""

from __future__ import annotations

import hashlib
import json
import math
import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.sources.tables import fresh


def query_windows(body: str, document: str, most: int, prefix: str = "") -> list[str]:
    """The query whole if it fits with the document; else two parts, cut after the token nearest the middle
    for which both fit; else none."""
    size = lambda q: len((prefix + q).split()) + len(document.split())
    if size(body) <= most:
        return [body]
    ends = sorted({m.end() for m in re.finditer(r"\S+", body)} - {len(body)}, key=lambda n: (abs(n - len(body) / 2), n))
    return next(([body[:n], body[n:]] for n in ends if size(body[:n]) <= most and size(body[n:]) <= most), [])


def windowed_score(score: Callable[[str, str], float], most: int) -> Callable:
    """A pandas function of (query, document): the best score of the query's windows, null if none fits."""

    @F.pandas_udf(T.DoubleType())
    def run(query: pd.Series, document: pd.Series) -> pd.Series:
        return pd.Series([max((score(w, d) for w in query_windows(q, d, most)), default=None) for q, d in zip(query, document, strict=True)], dtype="float64")

    return run


def shared_terms(query: str, document: str) -> float:
    a, b = set(query.lower().split()), set(document.lower().split())
    return len(a & b) / len(a | b) if a | b else 0.0


def hashed_vector(dimensions: int = 64) -> Callable:
    """The stand-in for an embedding model: signed counts of hashed terms, at length 1."""

    def one(text: str | None) -> list[float] | None:
        if text is None:
            return None
        v = [0.0] * dimensions
        for t in text.lower().split():
            h = zlib.crc32(t.encode())
            v[h % dimensions] += 1.0 if h >> 16 & 1 else -1.0
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v] if n else v

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(text: pd.Series) -> pd.Series:
        return text.map(one)

    return run


def either_lane(lanes: Sequence[Callable[[], DataFrame]]) -> tuple[list[DataFrame], list[str]]:
    """What the lanes that work find, and why others don't, whether they can't be planned or fail while they run: a lane's
    hits, as many as its limit at most, are written as a table before any is used. Wrong requests (ValueError) are never
    hidden; no lane left is an error."""
    good, lost = [], []
    for lane in lanes:
        try:
            hits = lane()
            path = fresh(hits.sparkSession, "lane")
            hits.write.parquet(path)
            good.append(hits.sparkSession.read.schema(hits.schema).parquet(path))
        except ValueError:
            raise
        except Exception as e:
            lost.append(type(e).__name__)
    if not good:
        raise RuntimeError(f"no lane works: {', '.join(lost)}")
    return good, lost


@dataclass(frozen=True)
class QueryPlan:
    """A compiled question: what each lane asks, within which scope; equal plans have equal hashes."""

    dense: str
    lexical: str
    rerank: str
    scope: tuple[str, ...] = ()
    documents: tuple[str, ...] | None = None
    limits: dict = field(default_factory=lambda: {"dense": 40, "bm25": 40, "rrf": 30, "rerank": 10, "parent": 6, "constant": 60})

    def __post_init__(self):
        if not self.limits["parent"] <= self.limits["rerank"] <= self.limits["rrf"]:
            raise ValueError("limits must fall from stage to stage")

    @property
    def hash(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def compiled(question: str, scope: Sequence[str] = (), run_documents: Sequence[str] | None = None, asked_documents: Sequence[str] | None = None) -> QueryPlan:
    """A plan whose documents are those of the run that the question asks for too; scope terms lead the
    texts, once each."""
    q = " ".join(question.split())
    terms = tuple(dict.fromkeys(t for t in scope if t and t not in q))
    text = " ".join((*terms, q))
    docs = run_documents if asked_documents is None else asked_documents if run_documents is None else [x for x in run_documents if x in set(asked_documents)]
    return QueryPlan(text, q, text, terms, None if docs is None else tuple(docs))


def kept_claims(base: Column, claims: Column, prefix: int = 64, final: int = 384) -> Column:
    """Claims (struct of priority, id, text) taken whole, in order, while the prefix and all of it stay within
    their tokens; one that doesn't fit is passed over."""
    size = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda t: t != ""))
    zero = F.struct(F.lit("").alias("text"), F.array().cast("array<string>").alias("ids"))

    def step(acc: Column, c: Column) -> Column:
        new = F.when(acc["text"] == "", c["text"]).otherwise(F.concat(acc["text"], F.lit("\n"), c["text"]))
        fits = (size(new) <= prefix) & (size(new) + size(base) <= final)
        return F.struct(F.when(fits, new).otherwise(acc["text"]).alias("text"), F.when(fits, F.concat(acc["ids"], F.array(c["id"]))).otherwise(acc["ids"]).alias("ids"))

    return F.aggregate(F.array_sort(claims), zero, step)


def compacted(observations: DataFrame, run: str, order: str, status: str, text: str, limit: int) -> DataFrame:
    """Observations with `keep`: unfinished ones and the last always; older ones unless all together are over
    the limit."""
    from pyspark.sql import Window as W

    w = W.partitionBy(run)
    last = F.col(order) == F.max(order).over(w)
    over = F.sum(F.length(text)).over(w) > limit
    return observations.withColumn("keep", (F.col(status) != "completed") | last | ~over)


def greedy_cover(target: tuple[int, int], ranges: Sequence[tuple[int, int, int]]) -> list[int]:
    """Ids of ranges (start, end, id) that cover the target, the furthest-reaching first; none if they can't."""
    at, out = target[0], []
    while at < target[1]:
        best = max(((b, i) for a, b, i in ranges if a <= at < b), default=None)
        if best is None:
            return []
        at = best[0]
        out.append(best[1])
    return sorted(set(out))


def covered(rows: DataFrame, key: str, low: str, high: str, ranges: str) -> DataFrame:
    """(key, ids) of the greedy covers; `ranges` is an array of structs (start, end, id)."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def run(a: pd.Series, b: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([greedy_cover((x, y), [(int(i["start"]), int(i["end"]), int(i["id"])) for i in z]) for x, y, z in zip(a, b, r, strict=True)])

    return rows.select(key, run(low, high, ranges).alias("ids"))


def dates_beside_headings(blocks: DataFrame, page: str, order: str) -> DataFrame:
    """blocks(page, order, kind, left, top, right, bottom) of kinds heading and date: each date with the one
    heading to its left that shares 60 % of its height, where two dates or more of the page begin within 5 %
    of its width; dates with two equally good headings have none."""
    from pyspark.sql import Window as W

    h = blocks.where("kind = 'heading'").select(F.col(page).alias("_p"), F.col(order).alias("heading"), F.col("right").alias("hr"), F.col("top").alias("ht"), F.col("bottom").alias("hb"))
    d = blocks.where("kind = 'date'")
    share = (F.least("bottom", "hb") - F.greatest("top", "ht")) / F.nullif(F.least(F.col("bottom") - F.col("top"), F.col("hb") - F.col("ht")), F.lit(0.0))
    pairs = d.join(h, (F.col(page) == F.col("_p")) & (F.col("hr") <= F.col("left"))).withColumn("share", F.round(share, 6)).where("share >= 0.6")
    pairs = pairs.withColumn("gap", F.col("left") - F.col("hr"))
    by = W.partitionBy(page, order)
    pairs = pairs.withColumn("n", F.row_number().over(by.orderBy(F.desc("share"), "gap", "heading")))
    pairs = pairs.withColumn("tie", F.count(F.lit(1)).over(W.partitionBy(page, order, "share", "gap")))
    best = pairs.where("n = 1 AND tie = 1").select(page, order, "heading", "left")
    width = blocks.groupBy(page).agg((F.max("right") - F.min("left")).alias("width"))
    b = best.select(F.col(page).alias("_p"), F.col(order).alias("_o"), F.col("heading").alias("_h"), F.col("left").alias("_l"))
    near = best.join(width, page).join(b, (F.col(page) == F.col("_p")) & (F.abs(F.col("left") - F.col("_l")) <= F.greatest(F.lit(1.0), F.col("width") * 0.05)))
    return near.groupBy(page, order, "heading").agg(F.count_distinct("_h").alias("n")).where("n >= 2").drop("n")


def _values(column: pa.Array) -> list:
    """As Python's values; whole numbers without nulls by way of numpy, which is faster."""
    return column.to_numpy().tolist() if pa.types.is_integer(column.type) and not column.null_count else column.to_pylist()


def _folded(rows: DataFrame, build: str, fields: Sequence[str], out: str, start: Callable[[], dict], step: Callable[..., tuple]) -> DataFrame:
    """A build's rows, sorted by fields, through step(state, *fields), which changes the state and gives the values of
    `out`. A task holds a batch of rows and one build's state, however many rows the build has."""
    result = T.StructType([rows.schema[build], *T.StructType.fromDDL(out)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, at, state = to_arrow_schema(result), None, None
        for b in batches:
            got = []
            for key, *r in zip(*(_values(b.column(c)) for c in (build, *fields)), strict=True):
                if state is None or key != at:
                    at, state = key, start()
                got.append((key, *step(state, *r)))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), schema, strict=True)], schema=schema)

    return rows.select(build, *fields).repartition(build).sortWithinPartitions(build, *fields).mapInArrow(run, result)


def _plus(x, y):
    """As in SQL: null if either is."""
    return None if x is None or y is None else x + y


def _fits(used, asked, most) -> bool:
    return used is not None and asked is not None and used + asked <= most


def admitted(requests: DataFrame, build: str, order: str, most_requests: int, most_tokens: int, most_cost: float) -> DataFrame:
    """requests(build, order, tokens, cost) with `admitted`: a fold, since a refused request leaves room for a
    later, smaller one. Orders are unique in a build."""
    kind = dict(requests.dtypes)

    def step(s: dict, at, tokens, cost) -> tuple:
        ok = s["n"] + 1 <= most_requests and _fits(s["tokens"], tokens, most_tokens) and _fits(s["cost"], cost, most_cost)
        if ok:
            s.update(n=s["n"] + 1, tokens=s["tokens"] + tokens, cost=s["cost"] + cost)
        return at, tokens, cost, ok

    out = f"{order} {kind[order]}, tokens {kind['tokens']}, cost {kind['cost']}, admitted boolean"
    return _folded(requests, build, [order, "tokens", "cost"], out, lambda: {"n": 0, "tokens": 0, "cost": 0}, step)


def metered(events: DataFrame, build: str, order: str, most_requests: int, most_tokens: int, most_cost: float) -> DataFrame:
    """events(build, order, kind, id, tokens, cost), in order, with their outcome and the build's account behind them.

    reserve: reserved, if requests, tokens and cost, reserved and consumed together, stay within their caps; else
    exhausted, which changes nothing. settle: what was reserved under the id goes and what was used is consumed,
    once: settled; a second time repeated, and unknown where nothing was reserved. Only what is used counts from then
    on, so settling makes room. Orders are unique in a build; a fold holds what one build has reserved."""
    kind = dict(events.dtypes)

    def start() -> dict:
        return {"requests": 0, "rt": 0, "ct": 0, "rc": 0, "cc": 0, "held": {}}

    def step(s: dict, at, what, id_, tokens, cost) -> tuple:
        held = s["held"].get(id_)
        if what == "reserve":
            outcome = "exhausted"
            if s["requests"] + 1 <= most_requests and _fits(_plus(s["rt"], s["ct"]), tokens, most_tokens) and _fits(_plus(s["rc"], s["cc"]), cost, most_cost):
                outcome = "reserved"
                if held is None or not held[2]:
                    s["held"][id_] = [tokens, cost, True]
                s.update(requests=s["requests"] + 1, rt=s["rt"] + tokens, rc=s["rc"] + cost)
        elif held is None:
            outcome = "unknown"
        elif held[2]:
            outcome, held[2] = "settled", False
            s.update(rt=s["rt"] - held[0], ct=_plus(s["ct"], tokens), rc=s["rc"] - held[1], cc=_plus(s["cc"], cost))
        else:
            outcome = "repeated"
        return at, outcome, s["requests"], s["rt"], s["ct"], s["rc"], s["cc"]

    out = f"{order} {kind[order]}, outcome string, requests int, reserved_tokens {kind['tokens']}, consumed_tokens {kind['tokens']}, reserved_cost {kind['cost']}, consumed_cost {kind['cost']}"
    return _folded(events, build, [order, "kind", "id", "tokens", "cost"], out, start, step)
