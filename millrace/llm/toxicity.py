"""Toxicity by class-conditional Kneser-Ney models.

A toxic and an ordinary model give each word a likelihood from its pair with the word before, backing
off to the word's continuation count (the different words it follows), and from there to its stem, the
first STEM characters. What a class discounts goes to a distribution that both classes share, the counts of
both together, tilted by the ratio of the classes one level lower: a rare expression is judged by what the
classes have in common, or by its word or stem. Every count of the rows drawn is kept. The two models' log
likelihood ratio, by words and by pairs, over the length of the text, and the part of it that lies in
expressions with a ratio beyond STRONG, over the root of the length and as a logarithm, are turned into a
score by logistic regression on labelled rows that the counts haven't seen. (The plain ratio alone drowns a
few insults in the noise of hundreds of words.)
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.shared import MARKS, held_out, mapped, mixed, others, small_batches, span_hashes, steps, table, text_bytes, words, written

#: Labelled rows of a class that the model is fitted on, at most or so (drawn by a hash of the id); one in
#: FOLD of them sets the regression. They bound the tables of expressions, which are broadcast: 12 bytes each.
ROWS, FOLD = 4096, 5
STEM, DISCOUNT, STRONG, RIDGE = 4, 2.0, 2.0, 2.0
FEATURES = 6
_PAIR = np.uint64(0xA0761D6478BD642F)


def _tokens(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Ranges of texts with their words' hashes, their stems' hashes, the words before (0: none) and counts."""
    data, offs = text_bytes(texts)
    for i, j in steps(offs):
        bit = data[offs[i] : offs[j]]
        s, e, n = words(bit, offs[i : j + 1] - offs[i], MARKS)
        chars = np.append(np.flatnonzero((bit & 0xC0) != 0x80), [len(bit)] * STEM)
        h, stem = span_hashes(bit, s, e), span_hashes(bit, s, np.minimum(e, chars[np.searchsorted(chars, s) + STEM] if len(s) else e))
        before = np.zeros_like(h)
        before[1:] = h[:-1]
        before[(np.cumsum(n) - n)[n > 0]] = 0
        yield i, j, h, stem, before, n


def _pair(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mixed(before + mixed(h ^ _PAIR))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) to the distinct pairs of each step with their counts in either class."""
    for b in batches:
        toxic = b.column(1).to_numpy(zero_copy_only=False) == 1
        for i, j, h, stem, before, n in _tokens(b.column(0)):
            cls = np.repeat(toxic[i:j], n)
            pair, first, at = np.unique(_pair(before, h), return_index=True, return_inverse=True)
            cols = [pair, before[first], h[first], stem[first]]
            counts = [np.bincount(at, cls == c, len(first)).astype(np.int64) for c in (True, False)]
            yield pa.record_batch([*(pa.array(x.view(np.int64)) for x in cols), *map(pa.array, counts)], ["h", "v", "w", "s", "t", "o"])


def _smoothed(n: Column, total: Column, mass: Column, low: Column) -> Column:
    """n of total, discounted; the mass of the discounts goes to `low`. A class without counts has `low`."""
    return F.when(total > 0, (F.greatest(n - DISCOUNT, F.lit(0.0)) + mass * low) / total).otherwise(low)


def log_ratios(pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """pairs(h, v, w, s, t, o), one row per pair (hash, word before, word, its stem, toxic and ordinary
    count), to (key, ratio) of stems, of words and of pairs: ln of the toxic over the ordinary
    probability. All expressions are kept."""
    seen = lambda c: F.sum((F.col(c) > 0).cast("double"))
    ends = pairs.groupBy("w").agg(F.min("s").alias("s"), seen("t").alias("kt"), seen("o").alias("ko"))
    mass = lambda c: F.sum(F.least(F.col(c), F.lit(DISCOUNT)))
    heads = pairs.groupBy(F.col("v").alias("w")).agg(F.sum("t").alias("nt"), F.sum("o").alias("no"), mass("t").alias("at"), mass("o").alias("ao"))
    stems = ends.groupBy("s").agg(F.sum("kt").alias("kt"), F.sum("ko").alias("ko"))
    both = lambda p: (F.col(f"{p}t") + F.col(f"{p}o")) / 2
    kt, ko, ct, co = F.col("kt"), F.col("ko"), F.col("sum_t"), F.col("sum_o")
    share = (kt / F.greatest(ct, F.lit(1.0)) + ko / F.greatest(co, F.lit(1.0))) / 2

    def sums(df: DataFrame) -> DataFrame:
        return F.broadcast(df.agg(F.sum("kt").alias("sum_t"), F.sum("ko").alias("sum_o"), mass("kt").alias("mass_t"), mass("ko").alias("mass_o")))

    stems = stems.crossJoin(sums(stems))  # with one row
    stems = stems.select("s", *(_smoothed(F.col(f"k{c}"), F.col(f"sum_{c}"), F.col(f"mass_{c}"), share).alias(f"s{c}") for c in "to"))
    rows = ends.join(F.broadcast(stems), "s").crossJoin(sums(ends))  # with one row
    rows = rows.select("w", *(_smoothed(F.col(f"k{c}"), F.col(f"sum_{c}"), F.col(f"mass_{c}"), share * F.col(f"s{c}") / both("s")).alias(f"w{c}") for c in "to"))
    rows = written(rows, "words")
    joint = (F.col("t") + F.col("o")) / (F.col("nt") + F.col("no"))
    deep = pairs.join(heads.withColumnRenamed("w", "v"), "v").join(rows, "w")
    deep = deep.select("h", *(_smoothed(F.col(c), F.col(f"n{c}"), F.col(f"a{c}"), joint * F.col(f"w{c}") / both("w")).alias(f"p{c}") for c in "to"))
    ratio = lambda df, key, p: df.select(F.col(key).alias("key"), F.log(F.col(f"{p}t") / F.col(f"{p}o")).cast("float").alias("ratio"))
    return ratio(stems, "s", "s"), ratio(rows, "w", "w"), ratio(deep, "h", "p")


class Model:
    """Sorted hashes of stems, words and pairs, each with its log ratio, and the regression on top."""

    def __init__(self, stems: DataFrame, words_: DataFrame, pairs: DataFrame):
        """Tables (key, ratio), whose size is bounded by the labelled rows drawn."""
        self.levels = []
        for df in (stems, words_, pairs):
            got = df.toArrow()
            h = got.column("key").to_numpy().view(np.uint64)
            o = np.argsort(h)
            self.levels.append((h[o], got.column("ratio").to_numpy()[o]))
        self.weights = np.zeros(1 + FEATURES)
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)

    def features(self, texts: pa.Array) -> np.ndarray:
        """Per text: the log ratio by words and that by pairs over its length; of each, the part beyond STRONG
        over the root of the length, and its logarithm. Texts without words have zeros."""
        out = np.zeros((len(texts), FEATURES))
        for i, j, h, stem, before, n in _tokens(texts):
            if not len(h):
                continue
            r, by = np.zeros(len(h), np.float32), []
            for (keys, values), of in zip(self.levels, (stem, h, _pair(before, h)), strict=True):
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, of), len(keys) - 1)
                    r = np.where(keys[at] == of, values[at], r)
                by.append(r)
            k, first = n > 0, (np.cumsum(n) - n)[n > 0]
            size = n[k]
            total, strong = ([np.add.reduceat(f(x.astype(float)), first) for x in by[1:]] for f in (lambda x: x, lambda x: np.maximum(x - STRONG, 0)))
            out[i:j][k] = np.stack([x / size for x in total] + [y for x in strong for y in (x / np.sqrt(size), np.log1p(x))], 1)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Logistic regression by Newton steps, with a ridge that some dozens of rows outweigh. Without rows
        of both classes every text gets the same score."""
        if not 0 < y.sum() < len(y):
            self.weights[0] = 4.0 if y.sum() else -4.0
            return
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])
        b, ridge = np.zeros(1 + FEATURES), RIDGE * np.diag([0.0, *[1.0] * FEATURES])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
            g = z.T @ (weight * (y - p)) - ridge @ b
            h = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge + 1e-6 * np.eye(len(b))
            step = np.linalg.solve(h, g)
            b = b + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-6:
                break
        self.weights = b

    def scores(self, texts: pa.Array) -> np.ndarray:
        z = (self.features(texts) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + z @ self.weights[1:], -30, 30)))


def train(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0) -> Model:
    """A model from docs(doc_id, text) and labels(doc_id, toxic), of which rows with crc32(doc_id as
    text) mod `modulus` = `remainder` are never read.

    Labels that are null count as none, of several for an id the highest counts; ids that repeat in docs
    bring each of their texts. At most ROWS labelled ids of a class or so are used, with whole texts and all
    their counts. Other columns are ignored. Without labels of both classes the model gives every text the
    same score."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"), modulus, remainder))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    every = F.when(F.col("toxic") == 1, F.lit(-(-sizes.get(1, 0) // ROWS) or 1)).otherwise(F.lit(-(-sizes.get(0, 0) // ROWS) or 1))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30))
    known = known.where(F.pmod(drawn, every) == 0).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(FOLD)))
    # the ids drawn are bounded by ROWS, so they may be broadcast; texts stay where they are
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    small_batches(docs.sparkSession)
    rows = written(rows.select(F.col("text").cast("string").alias("text"), "toxic", "fold"), "labelled")
    pairs = rows.where("fold > 0").select("text", "toxic").mapInArrow(_pairs, "h long, v long, w long, s long, t long, o long")
    pairs = written(pairs.groupBy("h").agg(*(F.min(c).alias(c) for c in "vws"), F.sum("t").alias("t"), F.sum("o").alias("o")), "pairs")
    model = Model(*log_ratios(pairs))
    names = [f"x{i}" for i in range(FEATURES)]

    def features(batches):
        for b in batches:
            x = model.features(b.column(0))
            yield pa.record_batch([*(pa.array(c) for c in x.T), b.column(1)], [*names, "toxic"])

    held = rows.where("fold = 0").select("text", "toxic").mapInArrow(features, ", ".join(f"{n} double" for n in names) + ", toxic int").toPandas()
    held = held.sort_values(list(held.columns))
    y = held["toxic"].to_numpy(float)
    part = [max(1, (y == c).sum()) / max(1, sizes.get(c, 0)) for c in (0, 1)]
    weight = np.where(y == 1, 1 / part[1], 1 / part[0])
    model.fit(held[names].to_numpy(), y, weight / max(weight.mean(), 1e-9) if len(y) else weight)
    return model


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """docs(text, ...) with `score`, 0 to 1, higher for likelier toxic, and `predicted` (1 if 0.5 or
    more). Only the text is an input; a null text is empty. keep: the columns of docs to return (None:
    all). Columns of docs named score or predicted are replaced, all others stay, whatever their names;
    repeated rows are scored each."""
    cols = [c for c in others(docs, "score", "predicted") if keep is None or c in keep]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = sent.value.scores(b.column(0))
            yield pa.record_batch([*b.columns[1:], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*cols, "score", "predicted"])

    return mapped(docs, F.col("text").cast("string"), cols, run, [("score", T.DoubleType()), ("predicted", T.IntegerType())])


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs(text, ...) that the model doesn't reject, with all their columns, whatever their
    names. Null and empty texts are judged like any other; repeated rows go or stay together."""
    cols = docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = b.filter(pa.array(sent.value.scores(b.column(0)) < 0.5))
            yield pa.record_batch(kept.columns[1:], cols)

    return mapped(docs, F.col("text").cast("string"), cols, run, [])


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; held out: crc32 of the id mod 5 is 0."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    out = score(docs, train(docs, labels), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable] = {"op10_toxicity": op10_toxicity}
ORACLE: dict[str, str] = {}
