"""Structured Streaming: publish once, project metrics, dead letters, tails."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from millrace.sources.tables import exists, fresh

#: Keys that the projection remembers to drop what is delivered twice; messages of a file of a log.
REMEMBERED, BATCH = 4096, 100


def published_once(stream: DataFrame, key: str, time: str | None = None, late: str = "1 day") -> DataFrame:
    """A stream in which each key comes once; with a time column, keys are forgotten after `late`."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if time else stream.dropDuplicates([key])


def windowed(stream: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts and sums per window, given out once the watermark has passed it."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def projected(stream: DataFrame, group: str = "user_id") -> DataFrame:
    """Running counters per group from (group, event_id, event_type, value): events, errors, the last
    type and the sum. State is the counters and the ids last seen, bounded by REMEMBERED."""
    out = f"{group} long, events long, errors long, last_type string, total double"
    state = "events long, errors long, last_id long, last_type string, total double, seen array<long>"

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        events, errors, last_id, last_type, total, seen = held.get if held.exists else (0, 0, -1, "", 0.0, [])
        new = pd.concat(list(batches)).sort_values("event_id").drop_duplicates("event_id")
        new = new[~new["event_id"].isin(list(seen))]
        if len(new):
            events, errors, total = events + len(new), errors + int((new["event_type"] == "error").sum()), total + float(new["value"].sum())
            if new["event_id"].iloc[-1] > last_id:
                last_id, last_type = int(new["event_id"].iloc[-1]), new["event_type"].iloc[-1]
        seen = [*seen, *new["event_id"].tolist()]
        held.update((events, errors, last_id, last_type, total, seen[-REMEMBERED:]))
        yield pd.DataFrame([(key[0], events, errors, last_type, total)], columns=[group, "events", "errors", "last_type", "total"])

    return stream.groupBy(group).applyInPandasWithState(run, out, state, "update", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, name: str = "drained", mode: str = "append", checkpoint: str | None = None, path: str | None = None) -> DataFrame:
    """All that a stream gives out on what is there now, as a table in the shared folder. Appended rows come by Spark's
    own file sink, others in a folder for each batch, which a batch that runs again replaces: `batch` is its number.
    With a checkpoint and path of an earlier run it goes on behind it."""
    spark = stream.sparkSession
    path, checkpoint = path or fresh(spark, name), checkpoint or fresh(spark, f"{name}-checkpoint")
    out = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        out.format("parquet").option("path", path).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    out.foreachBatch(write).start().awaitTermination()
    found = spark.read.parquet(path)
    return found.where(F.col("batch") == found.agg(F.max("batch")).first()[0]).drop("batch") if mode == "complete" else found


def message_log(messages: DataFrame, path: str, order: str, most: int = BATCH) -> None:
    """Messages as a log that streams read in order: sorted files of `most` messages at most."""
    messages.repartitionByRange(order).sortWithinPartitions(order).write.option("maxRecordsPerFile", most).mode("append").parquet(path)


def consumed(spark: SparkSession, path: str, schema: StructType, files: int = 1) -> DataFrame:
    """A stream of a message log, `files` of it a micro-batch, so at most so many times the log's bound of messages.
    What was consumed is in the checkpoint of the query: a consumer that starts again goes on behind it."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def split_dead(stream: DataFrame, bad: Column, good_path: str, dead_path: str, checkpoint: str, key: str) -> StreamingQuery:
    """Writes good rows as they come and dead ones once a key, whatever the batch: those of a batch go past the keys
    that earlier batches have written. Batches have a folder each, so one that runs again replaces what it wrote."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.where(~bad).write.mode("overwrite").parquet(f"{good_path}/batch={number}")
        dead = batch.where(bad).dropDuplicates([key])
        if exists(spark, dead_path):
            earlier = spark.read.schema(stream.schema.add("batch", "long")).parquet(dead_path).where(F.col("batch") < number)
            dead = dead.join(earlier.select(key).distinct(), key, "left_anti")
        dead.write.mode("overwrite").parquet(f"{dead_path}/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
