"""Structured Streaming jobs over line snapshots. State is bounded by watermarks and timeouts."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def snapshots(spark: SparkSession, path: str, pattern: str | None = None, files_per_trigger: int | None = 4) -> DataFrame:
    """The files of a folder (or one file) as a stream, with the types that they have; without files_per_trigger all that are there make one batch."""
    kinds = spark.read.parquet(path if pattern is None else os.path.join(path, pattern)).schema
    reader = spark.readStream.schema(kinds)
    reader = reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).parquet(path)


def replay_slices(rows: DataFrame, time: str, path: str, slices: int, which: Sequence[int] | None = None) -> None:
    """Writes rows as files in time order, one for each of `slices` equal stretches from the first time to the last; a stream that takes one file a trigger replays them."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    span = rows.agg(F.min(at).alias("_low"), F.max(at).alias("_high"))  # one row
    number = F.least(F.floor((at - F.col("_low")) * slices / F.greatest(F.col("_high") - F.col("_low"), F.lit(1))), F.lit(slices - 1))
    marked = rows.join(F.broadcast(span)).withColumn("_slice", number).drop("_low", "_high")
    for i in range(slices) if which is None else which:  # one after another, as a stream takes older files first
        marked.where(F.col("_slice") == i).drop("_slice").repartition(1).write.mode("append").parquet(path)


def deduplicated(stream: DataFrame, keys: Sequence[str], time: str, late: str = "1 day") -> DataFrame:
    """The first snapshot of each logical line within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def lines_by_day(stream: DataFrame, time: str, keys: Sequence[str], late: str = "1 hour") -> DataFrame:
    out = stream.withWatermark(time, late).groupBy(F.window(time, "1 day"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("day"), *keys, "n")


def board_by_window(stream: DataFrame, time: str, keys: Sequence[str], late: str = "1 hour") -> DataFrame:
    """Lines in sliding windows of two hours, one each half hour."""
    out = stream.withWatermark(time, late).groupBy(F.window(time, "2 hours", "30 minutes"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


#: Keys are dealt into so many groups; the state of a group's keys is one table.
GROUPS = 256


def line_moves(stream: DataFrame, key: str, time: str, value: str, least: float, late: str = "1 hour", forget: str = "2 days") -> DataFrame:
    """A row for each batch in which a key's newest value lies `least` or more from its first one; a key's state goes after `forget`.

    A call takes a group of keys, whose state is a column each of keys, first and last times and values, and when a key is forgotten.
    """
    life = int(pd.Timedelta(forget).total_seconds() * 1000)

    def step(k: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        names, *held = state.get if state.exists else ([], [], [], [], [], [])
        known = dict(zip(names, zip(*held, strict=True), strict=True))
        out = []
        if not state.hasTimedOut:
            rows = pd.concat(list(frames)).sort_values("at", kind="stable")
            news = rows.drop_duplicates("key", keep="last")
            newest = dict(zip(news["key"], zip(news["at"].tolist(), news["value"].tolist(), strict=True), strict=True))
            olds = rows.drop_duplicates("key")
            for name, at, v in zip(olds["key"], olds["at"].tolist(), olds["value"].tolist(), strict=True):
                first_at, first, last_at, last, _ = known.get(name, (at, v, -1, 0.0, 0))
                if at < first_at:
                    first_at, first = at, v
                if newest[name][0] > last_at:
                    last_at, last = newest[name]
                known[name] = (first_at, first, last_at, last, max(now, last_at // 1000) + life)
                if abs(last - first) >= least:
                    out.append((name, first, last, last - first))
        known = {n: x for n, x in known.items() if x[-1] >= now}  # keys with new rows stay
        if known:
            state.update((list(known), *map(list, zip(*known.values(), strict=True))))
            state.setTimeoutTimestamp(min(x[-1] for x in known.values()))
        else:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["key", "first_value", "last_value", "move"])

    kind = stream.schema[key].dataType.simpleString()
    rows = stream.withWatermark(time, late).select(F.col(key).cast("string").alias("key"), time, F.unix_micros(F.col(time).cast("timestamp")).alias("at"), F.col(value).cast("double").alias("value"))
    rows = rows.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(GROUPS)))
    held = "key array<string>, first_at array<long>, first array<double>, last_at array<long>, last array<double>, until array<long>"
    got = rows.groupBy("group").applyInPandasWithState(step, "key string, first_value double, last_value double, move double", held, "update", GroupStateTimeout.EventTimeTimeout)
    return got.select(F.col("key").cast(kind).alias(key), "first_value", "last_value", "move")


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs the stream over what is there and returns its rows so far, from Parquet files beside the checkpoint; for tests and replays."""
    spark, out = stream.sparkSession, f"{checkpoint.rstrip('/')}-rows"
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{out}/none")  # so that a stream without batches has its schema, too

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{number}")  # a repeated batch replaces itself

    query = stream.writeStream.outputMode(mode).foreachBatch(write).queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(out)
