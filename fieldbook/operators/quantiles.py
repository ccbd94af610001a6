"""Exact quantiles of groups of any size, by histograms that narrow in rounds.

`percentile` holds all distinct values of a group in one task. Here a round counts values by bins between the least and
the largest value that a wanted rank can still have; counts combine before the shuffle. The bin that holds the rank,
with its actual least and largest value, is the next round's range. When a range holds `FEW` values or fewer, they
are sorted. Three rounds do for most data; each reads the values once.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fieldbook.session import saved, written

BINS, FEW, LARGEST = 1024, 20_000, sys.float_info.max


def quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float], name: str = "quantiles", bins: int = BINS, few: int = FEW) -> DataFrame:
    """keys and an array of the quantiles `qs` of each group, interpolated between neighbouring values as `percentile` does.

    Null and NaN values don't count; a group without any other value has no row. Null keys make a group.
    """
    v = F.col(value).cast("double")
    key = F.struct(*keys) if keys else F.struct(F.lit(1).alias("all"))
    rows = saved(df.where(v.isNotNull() & ~F.isnan(v)).select(key.alias("_k"), v.alias("_v")))
    groups = rows.groupBy("_k").agg(F.count("*").alias("n"), F.min("_v").alias("a"), F.max("_v").alias("b"))
    place = lambda q: F.lit(float(q)) * (F.col("n") - 1)
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(up).alias("up"), (F.ceil(place(q)) if up else F.floor(place(q))).cast("bigint").alias("rank")) for i, q in enumerate(qs) for up in (0, 1)]))
    open_, done = written(groups.select("_k", "n", "a", "b", wanted.alias("w")).select("_k", "n", "a", "b", "w.*")), None

    def inside(ranges: DataFrame) -> DataFrame:
        """Values within the ranges, which don't overlap within a group: one row of a group's ranges meets its values, so they don't multiply."""
        held = ranges.groupBy("_k").agg(F.collect_set(F.struct("a", "b")).alias("_r"))
        at = F.try_element_at(F.filter("_r", lambda r: F.col("_v").between(r["a"], r["b"])), F.lit(1))
        return rows.join(held, "_k").select("_k", "_v", at.alias("_at")).where("_at is not null").select("_k", "_v", "_at.a", "_at.b")

    sizes = {r["kind"] for r in open_.select(kind(few).alias("kind")).distinct().collect()}
    while "many" in sizes:
        large = open_.where(kind(few) == "many")
        low, high = F.greatest("a", F.lit(-LARGEST)) / 2, F.least("b", F.lit(LARGEST)) / 2  # halves, since the width of the whole range may overflow
        share = F.coalesce(F.try_divide(F.col("_v") / 2 - low, high - low), F.lit(0.0))
        place_in = F.when(F.col("_v") == F.col("a"), 0).when(F.col("_v") == F.col("b"), bins - 1).otherwise(F.least(F.floor(share * bins), F.lit(bins - 1)))
        cells = inside(large).groupBy("_k", "a", "b", place_in.alias("bin")).agg(F.count("*").alias("c"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        cells = cells.withColumn("below", F.sum("c").over(W.partitionBy("_k", "a", "b").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)))
        cells = cells.withColumn("below", F.coalesce("below", F.lit(0)))
        new = large.join(cells, ["_k", "a", "b"]).where((F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("c")))
        new = new.select("_k", F.col("c").alias("n"), F.col("low").alias("a"), F.col("high").alias("b"), "i", "up", (F.col("rank") - F.col("below")).alias("rank"))
        rest = open_.where(kind(few) != "many")
        done = rest if done is None else written(done.unionByName(rest))
        open_ = written(new)
        sizes = {r["kind"] for r in open_.select(kind(few).alias("kind")).distinct().collect()}
    every = open_ if done is None else done.unionByName(open_)
    found = every.where(kind(few) == "one").select("_k", "i", "up", F.col("a").alias("x"))
    some = every.where(kind(few) == "few")
    ranked = rows_in(rows, some).withColumn("rank", F.row_number().over(W.partitionBy("_k", "a", "b").orderBy("_v")) - 1)
    found = found.unionByName(some.join(ranked, ["_k", "a", "b", "rank"]).select("_k", "i", "up", F.col("_v").alias("x")))
    one = found.groupBy("_k", "i").agg(F.max(F.when(F.col("up") == 0, F.col("x"))).alias("x"), F.max(F.when(F.col("up") == 1, F.col("x"))).alias("y")).join(groups.select("_k", "n"), "_k")
    spot = F.element_at(F.array(*[F.lit(float(q)) for q in qs]), F.col("i") + 1) * (F.col("n") - 1)
    between = F.when(F.floor(spot) == F.ceil(spot), F.col("x")).otherwise((F.ceil(spot) - spot) * F.col("x") + (spot - F.floor(spot)) * F.col("y"))
    out = one.groupBy("_k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", between.alias("q")))), lambda s: s["q"]).alias(name))
    return out.select(*[F.col(f"_k.{k}").alias(k) for k in keys], name)


def kind(few: int) -> Column:
    """What is left of a wanted rank's range: one value, few values, or many."""
    return F.when(F.col("a") == F.col("b"), "one").when(F.col("n") <= few, "few").otherwise("many")


def rows_in(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Values within small ranges, once for each range; ranges of a group may overlap, as they come from several rounds."""
    held = ranges.groupBy("_k").agg(F.collect_set(F.struct("a", "b")).alias("_r"))
    at = F.explode(F.filter("_r", lambda r: F.col("_v").between(r["a"], r["b"])))
    return rows.join(held, "_k").select("_k", "_v", at.alias("_at")).select("_k", "_v", "_at.a", "_at.b")
