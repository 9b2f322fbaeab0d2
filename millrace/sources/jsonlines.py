"""Strict JSON lines: every line is one object, judged from its raw text, and bad lines are named by number."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names that the keys of a data set may not hold; fixed values.
UNSAFE = r"prompt|completion|raw[_ -]?tool|tool[_ -]?(?:input|output|args|result)|chain[_ -]?of[_ -]?thought|hidden[_ -]?reasoning|provider[_ -]?(?:token|response|secret)"


def numbered_lines(spark: SparkSession, path: str, through: bool = False) -> DataFrame:
    """(file, line, value) of all lines, numbered from 1 in each file, or through all files by name. Files are read in
    splits; a line's number is its place in its split behind the lines of the splits before, whose counts alone are
    gathered."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"))
    splits = rows.groupBy("file", "_at").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_n").over((W.orderBy("file", "_at") if through else W.partitionBy("file").orderBy("_at")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "_at", "_first", before.alias("_before"))
    return rows.join(F.broadcast(splits), ["file", "_at"]).select("file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line"), "value")


def line_problem(text: str, unsafe: re.Pattern | None = None) -> str | None:
    """Why a line isn't a strict JSON object, or None: blank, not JSON, NaN or infinite numbers, no object, a key twice in
    one object, an unsafe key at any depth."""
    if not text.strip():
        return "blank row"
    found: list[str] = []

    def constant(name: str) -> float:
        found.append("non-finite value")
        return 0.0

    def number(digits: str) -> float:
        x = float(digits)
        return x if math.isfinite(x) else constant(digits)

    def pairs(items: list[tuple]) -> dict:
        keys = [k for k, _ in items]
        if len(set(keys)) < len(keys):
            found.append("repeated key")
        if unsafe and any(unsafe.search(k) for k in keys):
            found.append("unsafe key")
        return dict(items)

    try:
        value = json.loads(text, parse_constant=constant, parse_float=number, object_pairs_hook=pairs)
    except (ValueError, RecursionError):
        return "not JSON"
    return found[0] if found else None if isinstance(value, dict) else "not an object"


def judged_lines(lines: DataFrame, key: str, unsafe: str | None = None) -> DataFrame:
    """lines(file, line, value) with `problem`: that of the line alone, or that an earlier line of any file (by file and
    line) has its key."""
    pattern = re.compile(unsafe, re.I) if unsafe else None

    @F.pandas_udf(T.StringType())
    def judge(value: pd.Series) -> pd.Series:
        return value.map(lambda x: line_problem(x or "", pattern))

    rows = lines.withColumn("problem", judge("value"))
    own = F.get_json_object("value", f"$.{key}")
    rows = rows.withColumn("_key", F.when(F.col("problem").isNull(), own))
    # rows without a key aren't partners of each other: they are spread
    spread = F.when(F.col("_key").isNull(), F.xxhash64("file", "line")).otherwise(0)
    nth = F.row_number().over(W.partitionBy("_key", spread).orderBy("file", "line"))
    no_key = F.col("problem").isNull() & F.col("_key").isNull()
    again = F.col("_key").isNotNull() & (nth > 1)
    return rows.withColumn("problem", F.when(no_key, "no key").when(again, "repeated id").otherwise(F.col("problem"))).drop("_key")


def strict_json_lines(spark: SparkSession, path: str, schema: T.StructType, key: str, unsafe: str | None = None) -> DataFrame:
    """The rows of a data set whose lines are all strict; one bad line is an error that names its file and number."""
    rows = judged_lines(numbered_lines(spark, path), key, unsafe)
    where = F.concat(F.col("file"), F.lit(":"), F.col("line").cast("string"), F.lit(": "), F.col("problem"))
    value = F.when(F.col("problem").isNull(), F.col("value")).otherwise(F.raise_error(where))
    return rows.select(F.from_json(value, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
