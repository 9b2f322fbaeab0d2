"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table and the shards take turns
claiming the next free slot of their preference. The table has a fixed size, so it may be broadcast,
and placing a row is one hash and one lookup. Removing a shard moves its own rows and few others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.shared import others, spare, table

#: Slots: a prime, and over 100 times the shards used here, so that shares differ by a percent or so.
SLOTS = 65_537
SHARDS = tuple(f"shard-{i:04d}" for i in range(256))


def _prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The index of the shard that owns each slot. Raises ValueError for no shards, repeated names,
    more shards than slots, or a size that isn't prime (preferences would not reach all slots)."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots or not _prime(slots):
        raise ValueError("shards must be distinct, at least one, at most the slots, and the slots a prime number")
    start, skip = [], []
    for name in shards:
        d = hashlib.sha256(name.encode()).digest()
        start.append(int.from_bytes(d[:8], "big") % slots)
        skip.append(int.from_bytes(d[8:16], "big") % (slots - 1) + 1)
    owner, left = [-1] * slots, slots
    while True:
        for i in range(len(shards)):
            at = start[i]
            while owner[at] >= 0:
                at = (at + skip[i]) % slots
            owner[at] = i
            start[i] = (at + skip[i]) % slots
            left -= 1
            if not left:
                return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: its text's hash modulo the slots; a null key counts as the empty text."""
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))), F.lit(slots).cast("long"))


def place(df: DataFrame, key: str, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """df with `slot` and `shard`. Rows with equal keys share a shard; null keys have one of their
    own. Columns of df named slot or shard are replaced, all others stay, whatever their names; repeated
    rows are placed each. An empty table gives an empty one. The
    table of slots is broadcast: its size is fixed by the parameter and doesn't grow with df."""
    owners, names = lookup_table(shards, slots), list(shards)
    kept = others(df, "slot", "shard")
    at, owner = spare("at", df.columns), spare("owner", df.columns)
    rows = df.sparkSession.createDataFrame(pd.DataFrame({at: range(slots), owner: [names[i] for i in owners]}))
    cols = [F.col(f"`{c}`") for c in kept]
    placed = df.select(*cols, slot_of(F.col(f"`{key}`"), slots).alias("slot")).join(F.broadcast(rows), F.col("slot") == F.col(at), "left")
    return placed.select(*cols, "slot", F.col(owner).alias("shard"))


def write_shards(df: DataFrame, key: str, path: str, shards: Sequence[str] = SHARDS, files: int = 4) -> None:
    """Writes one folder per shard. Rows are dealt by shard and a salt of the key, so that one
    shard's rows never meet in a single task."""
    salt = F.pmod(F.xxhash64(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), F.lit(7)), F.lit(files))
    place(df, key, shards).repartition("shard", salt).write.partitionBy("shard").parquet(path)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, slot, shard of every document, with its size in characters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_text"))
    return place(docs, "doc_id").select("doc_id", "slot", "shard", "n_text")


QUERIES: dict[str, Callable] = {"op5_sharding": op5_sharding}
ORACLE: dict[str, str] = {}
