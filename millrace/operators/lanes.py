"""Retrieval lanes: BM25 over exploded terms and exact cosine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def bigrams(text: Column) -> Column:
    """Pairs of neighbouring characters inside terms: the second analyzer."""
    return F.flatten(F.transform(terms(text), lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(2)))))


def postings(docs: DataFrame, key: str, text: str, analyzer=terms, wanted: DataFrame | None = None) -> DataFrame:
    """(key, term, tf, dl): one row per distinct term of a document, or per distinct term of `wanted`."""
    t = docs.select(F.col(key), analyzer(F.col(text)).alias("_terms"))
    t = t.select(key, F.size("_terms").alias("dl"), F.explode("_terms").alias("term"))
    t = t if wanted is None else t.join(wanted, "term", "left_semi")
    return t.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def bm25(docs: DataFrame, queries: DataFrame, key: str, text: str, query_key: str, query_text: str, where: Column | None = None, analyzer=terms) -> DataFrame:
    """(query key, key, score) of documents that share a term with a query and meet `where`.

    Statistics come from all documents: a filter doesn't change N, document frequency or mean length. A
    document's distinct terms are counted where it is read, so only counts are shuffled for them; postings
    are made of the documents that meet `where` alone, and only for terms of a query."""
    asked = queries.select(query_key, F.explode(F.array_distinct(analyzer(F.col(query_text)))).alias("term"))
    wanted = asked.select("term").distinct()
    found = docs.select(analyzer(F.col(text)).alias("_terms"))
    sizes = found.select(F.size("_terms").alias("dl")).where("dl > 0").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    once = found.select(F.explode(F.array_distinct("_terms")).alias("term"))
    df = once.join(wanted, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    post = postings(docs if where is None else docs.where(where), key, text, analyzer, wanted)
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = post.join(df, "term").crossJoin(F.broadcast(sizes)).join(asked, "term")  # sizes is one row
    return scored.groupBy(query_key, key).agg(F.sum(part).alias("score"))


def with_scope_terms(hits: DataFrame, extra: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scores plus those of optional terms; documents that only the optional terms find stay out."""
    more = extra.select(*keys, F.col("score").alias("_more"))
    return hits.join(more, list(keys), "left").withColumn("score", F.col("score") + F.coalesce("_more", F.lit(0.0))).drop("_more")


def best_fields(zh: DataFrame, standard: DataFrame, keys: Sequence[str], boost: float = 2.0) -> DataFrame:
    """The better of a boosted and a plain score."""
    a, b = zh.select(*keys, (F.col("score") * boost).alias("_a")), standard.select(*keys, F.col("score").alias("_b"))
    return a.join(b, list(keys), "full").select(*keys, F.greatest(F.coalesce("_a", F.lit(0.0)), F.coalesce("_b", F.lit(0.0))).alias("score"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    x, y = a.cast("array<double>"), b.cast("array<double>")
    return dot(x, y) / (F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))


def knn(vectors: DataFrame, key: str, vector: str, query: Sequence[float], k: int, where: Column | None = None) -> DataFrame:
    """(key, score) of the k nearest by cosine among the rows that meet `where`, exactly; a heap per
    task and one of k at the end."""
    rows = vectors.where(where) if where is not None else vectors
    score = cosine(F.col(vector), F.array(*(F.lit(float(x)) for x in query)))
    return rows.select(key, score.alias("score")).orderBy(F.desc(F.round("score", 6)), key).limit(k)


def ranked(hits: DataFrame, score: str = "score", key: str = "child_id", by: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """hits with lane_rank from 1 by score (6 digits), then key."""
    out = hits.withColumn("lane_rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(F.round(score, 6)), key)))
    return out if limit is None else out.where(F.col("lane_rank") <= limit)
