"""Writers: content-addressed artifacts, staged and published index tables, reports."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def artifacts(df: DataFrame, path: str, payload: str) -> DataFrame:
    """Writes rows under the hash of their payload, once each, and returns (hash, payload) as written."""
    rows = df.select(F.sha2(payload, 256).alias("hash"), payload).dropDuplicates(["hash"])
    rows.withColumn("shard", F.substring("hash", 1, 1)).hint("rebalance", "shard").write.mode("overwrite").partitionBy("shard").parquet(path)
    return df.sparkSession.read.parquet(path).drop("shard")


def broken(df: DataFrame, payload: str) -> DataFrame:
    """Artifacts whose content isn't what their hash says."""
    return df.where(F.sha2(payload, 256) != F.col("hash"))


def staged(df: DataFrame, path: str, generation: str) -> None:
    """Rows of a generation, not active yet; writing a generation again replaces it alone."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    df.withColumn("is_active", F.lit(False)).withColumn("index_generation", F.lit(generation)).write.mode("overwrite").partitionBy("index_generation").parquet(path)


def report(df: DataFrame, path: str) -> None:
    """A small result as JSON lines and as a Markdown table; each file comes into place whole."""
    rows = [r.asDict(recursive=True) for r in df.collect()]
    head = df.columns
    table = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(str(r[c]) for c in head) + " |" for r in rows)]
    for end, text in ((".jsonl", "".join(json.dumps(r, default=str, sort_keys=True) + "\n" for r in rows)), (".md", "\n".join(table) + "\n")):
        fd, tmp = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
        with os.fdopen(fd, "w") as f:
            f.write(text)
        os.replace(tmp, path + end)
