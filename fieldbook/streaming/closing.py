"""Closing lines: keyed state with event-time timers, over a stream of snapshots that comes in time order."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Lines are dealt into so many groups by their key and start; a group's open lines are one table of state.
GROUPS = 256
HELD = ["key", "open_at", "open", "last_at", "last", "n", "moves", "largest"]
STATE = "key array<string>, open_at array<long>, open array<double>, last_at array<long>, last array<double>, n array<long>, moves array<long>, largest array<double>, start long"


class CloseAtStart(StatefulProcessor):
    """Holds a group of lines of one start, each with its open and last snapshot and its moves; a timer at the start emits the closing rows and forgets the group.

    Value state: a column each of the lines' keys, open and last snapshots, numbers of snapshots and of moves of `least` or more, and
    largest moves (the first of equals). Snapshots at or after the start don't count; nor do those that come when the watermark has passed it.
    """

    def __init__(self, least: float) -> None:
        self.least = least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getValueState("lines", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        start = int(new["start"].iloc[0])
        new = new[new["at"] < start]
        if new.empty or start // 1000 <= timerValues.getCurrentWatermarkInMs():
            return
        state = self.lines.get() if self.lines.exists() else None
        held = None if state is None else pd.DataFrame({c: list(v) for c, v in zip(HELD, state, strict=False)})
        if held is None:
            self.handle.registerTimer(-(-start // 1000))
        merged = merge(held, new, self.least)
        self.lines.update((*[merged[c].tolist() for c in HELD[:-1]], [None if pd.isna(x) else x for x in merged["largest"]], start))
        return
        yield  # rows come from the timer alone

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.lines.exists():
            held = dict(zip(HELD, self.lines.get(), strict=False))
            yield pd.DataFrame({"key": list(held["key"]), "open_value": list(held["open"]), "close_value": list(held["last"]), "closed_at": list(held["last_at"]), "n": list(held["n"]), "moves": list(held["moves"]), "largest_move": pd.Series(list(held["largest"]), dtype="float64")})
            self.lines.clear()

    def close(self) -> None:
        pass


def merge(held: pd.DataFrame | None, new: pd.DataFrame, least: float) -> pd.DataFrame:
    """The lines' table after new snapshots (key, at, value), each line's in order of time and value."""
    rows = new[["key", "at", "value"]].sort_values(["key", "at", "value"], kind="stable", ignore_index=True)
    before = rows.groupby("key")["value"].shift()
    if held is not None:
        before = before.fillna(rows["key"].map(held.set_index("key")["last"]))
    move = rows["value"] - before
    move = move.where(move.abs() >= least)
    by = rows.groupby("key", sort=True)
    out = by.agg(open_at=("at", "first"), open=("value", "first"), last_at=("at", "last"), last=("value", "last"), n=("at", "size"))
    out["moves"] = move.notna().groupby(rows["key"]).sum()
    big = move.abs().dropna().groupby(rows["key"]).idxmax()
    out["largest"] = move.loc[big].set_axis(big.index).reindex(out.index)
    if held is None:
        return out.reset_index()
    old = held.set_index("key")
    old["largest"] = old["largest"].astype("float64")
    every = old.index.union(out.index)
    o, n = old.reindex(every), out.reindex(every)
    newer = n["largest"].notna() & ~(o["largest"].abs() >= n["largest"].abs())
    got = pd.DataFrame({"open_at": o["open_at"].fillna(n["open_at"]), "open": o["open"].fillna(n["open"]), "last_at": n["last_at"].fillna(o["last_at"]), "last": n["last"].fillna(o["last"]), "n": o["n"].fillna(0) + n["n"].fillna(0), "moves": o["moves"].fillna(0) + n["moves"].fillna(0), "largest": n["largest"].where(newer, o["largest"])}, index=every)
    return got.astype({"open_at": "int64", "last_at": "int64", "n": "int64", "moves": "int64"}).rename_axis("key").reset_index()


def closing_lines(stream: DataFrame, key: str, time: str, value: str, start: str, least: float, late: str = "1 hour") -> DataFrame:
    """A row for each line when the watermark passes its start: open, close, when it was last seen, snapshots, moves of `least` or more and the largest of them."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)  # timers need it
    rows = stream.withWatermark(time, late).select(F.col(key).cast("string").alias("key"), time, F.unix_micros(F.col(time).cast("timestamp")).alias("at"), F.col(value).cast("double").alias("value"), F.unix_micros(F.col(start).cast("timestamp")).alias("start"))
    rows = rows.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(GROUPS)))
    schema = "key string, open_value double, close_value double, closed_at long, n long, moves long, largest_move double"
    out = rows.groupBy("group", "start").transformWithStateInPandas(CloseAtStart(least), schema, "Append", "EventTime")
    return out.withColumn("closed_at", F.timestamp_micros("closed_at"))
