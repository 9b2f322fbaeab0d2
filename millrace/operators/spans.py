"""Finding passages in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that a passage must share with a text before they are compared as a whole.
WORDS = 3


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _windows(words: Column) -> Column:
    """Hashes of WORDS words in a row, each once. The words stand in an array of one, so that they are
    split once a text and not once a window."""

    def of(w: Column) -> Column:
        last = F.size(w) - WORDS + 1
        each = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(w, i, WORDS), " ")))
        return F.when(last > 0, each).otherwise(F.array().cast("array<bigint>"))

    return F.array_distinct(F.flatten(F.transform(F.array(words), of)))


def containing(texts: DataFrame, key: str, text: str, parts: DataFrame, part_key: str, part: str) -> DataFrame:
    """texts(key, text, ...) joined with the parts(part_key, part) that they contain, code point for code point.

    A part's words but the first and last stand whole in any text that holds it, so its second to fourth word
    lead to the texts: an equi-join on their hash, then one comparison. Parts of fewer than five words are
    compared with all texts. Null texts and parts match nothing; empty parts match every text. `key` and
    `part_key` must tell rows apart."""
    parts = parts.where(F.col(part).isNotNull()).withColumn("_w", _words(F.col(part)))
    long = F.size("_w") >= WORDS + 2
    lead = parts.where(long).select(F.col(part_key), F.xxhash64(F.array_join(F.slice("_w", 2, WORDS), " ")).alias("_h"))
    keys = texts.select(F.col(key), F.explode(_windows(_words(F.col(text)))).alias("_h")).join(lead, "_h").select(key, part_key)
    parts_ = parts.where(long).drop("_w")
    near = texts.join(keys, key).join(parts_, part_key).where(F.contains(F.col(text), F.col(part)))
    rest = texts.join(parts.where(~long).drop("_w"), F.contains(F.col(text), F.col(part)))
    return near.select(*texts.columns, *parts_.columns).unionByName(rest)


def proven(facts: DataFrame, members: DataFrame, fact: str, member: str) -> DataFrame:
    """(fact, sufficient, needed, members): whether the ranges of a fact's members (fact, member, low, high) cover its own
    (fact, low, high) without a gap, how many members it can't do without, and how many it has.

    In one pass over the members in order of where they begin: a place that only one of them covers needs it. What the
    members before reach at most, and at second most, tells which places those are: where the furthest reach so far is
    one member's and the next begins behind the second furthest, that member is needed."""
    rows = members.join(facts.select(fact, F.col("low").alias("_a"), F.col("high").alias("_b")), fact)
    rows = rows.select(fact, member, "_a", "_b", F.greatest("low", "_a").alias("low"), F.least("high", "_b").alias("high"))
    ranges = F.array_sort(F.collect_list(F.when(F.col("low") < F.col("high"), F.struct("low", "high", member))))
    g = rows.groupBy(fact).agg(ranges.alias("_r"), F.count(F.lit(1)).alias("members"), F.first("_a").alias("_a"), F.first("_b").alias("_b"))
    kind = dict(members.dtypes)
    end = F.struct(F.col("_b").alias("low"), F.col("_b").alias("high"), F.lit(None).cast(kind[member]).alias(member))
    nobody = F.lit(None).cast(kind[member])
    zero = F.struct(F.col("_a").alias("most"), nobody.alias("who"), F.col("_a").alias("second"), F.lit(True).alias("whole"), F.array().cast(f"array<{kind[member]}>").alias("alone"))

    def step(s, r):
        gap = r["low"] > s["most"]
        single = (r["low"] > s["second"]) & (s["most"] > s["second"]) & s["who"].isNotNull()
        ahead = r["high"] > s["most"]
        return F.struct(
            F.greatest(r["high"], s["most"]).alias("most"),
            F.when(ahead, r[member]).otherwise(s["who"]).alias("who"),
            F.when(ahead, s["most"]).otherwise(F.greatest(r["high"], s["second"])).alias("second"),
            (s["whole"] & ~gap).alias("whole"),
            F.when(single, F.array_union(s["alone"], F.array(s["who"]))).otherwise(s["alone"]).alias("alone"),
        )

    fold = F.aggregate(F.concat("_r", F.array(end)), zero, step)
    out = g.select(fact, "members", fold.alias("_f"))
    needed = F.when(F.col("_f.whole"), F.size("_f.alone")).otherwise(F.col("members"))
    return out.select(fact, F.col("_f.whole").alias("sufficient"), needed.cast("long").alias("needed"), "members")
