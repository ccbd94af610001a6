"""Reading and writing tables: facts, upserts, patches, retention, work lists, run slices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fieldbook.schema import schema


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.schema(schema(table)).parquet(f"{root}/{table}")


def player_games(facts: DataFrame, games: DataFrame, sport: str | None, game: str = "game_id", sport_col: str = "sport_code") -> DataFrame:
    """Facts with their game's columns; the sport filter reaches the scan of games."""
    dim = games if sport is None else games.where(F.col(sport_col) == sport)
    return facts.join(dim, game)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], version: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of both, the latest version of each key winning; with `columns`, an existing row changes in those only."""
    if columns is None:
        both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
        rest = [c for c in old.columns if c not in keys]
        return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, "_new")).alias("_r")).select(*keys, "_r.*").select(*old.columns)
    rest = [c for c in new.columns if c not in keys]
    latest = new.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_r")).select(*keys, F.col("_r").alias("_n"))
    joined = old.withColumn("_old", F.lit(True)).join(latest, list(keys), "full")
    value = lambda c: F.when(F.col("_n").isNotNull() & (F.col("_old").isNull() | F.lit(c in columns)), F.col("_n")[c]).otherwise(F.col(c)).alias(c)
    return joined.select(*[F.col(c) if c in keys else value(c) for c in old.columns])


def patch_features(stored: DataFrame, patch: DataFrame, key: str, date: str, as_of: Column, recent_days: int | None = 21, mode: str = "merge") -> DataFrame:
    """Stored feature maps with the patch's: merged (patch wins), or replaced; games older than recent_days stay. NaN becomes 0."""
    clean = F.transform_values("_p", lambda _, v: F.when(F.isnan(v), 0.0).otherwise(v))
    rows = stored.join(patch.select(key, F.col("features").alias("_p")), key, "left")
    apply = F.col("_p").isNotNull() if recent_days is None else F.col("_p").isNotNull() & (F.datediff(as_of, date) <= recent_days)
    own = F.coalesce(F.col("features"), F.create_map().cast("map<string,double>"))
    kept = F.map_filter(own, lambda k, _: ~F.map_contains_key(F.col("_p"), k))
    merged = clean if mode == "replace" else F.map_concat(kept, clean)
    return rows.withColumn("features", F.when(apply, merged).otherwise(F.col("features"))).drop("_p")


def prune(snapshots: DataFrame, picks: DataFrame, key: str, time: str, as_of: Column, days: int) -> DataFrame:
    """Snapshots of the last days, and older ones that a pick still refers to."""
    old = F.datediff(as_of, time) > days
    used = picks.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_used", F.lit(True))
    return snapshots.join(used, key, "left").where(~old | F.col("_used").isNotNull()).drop("_used")


def prune_counts(snapshots: DataFrame, picks: DataFrame, key: str, time: str, as_of: Column, days: int) -> DataFrame:
    """What `prune` would keep and drop."""
    old = F.datediff(as_of, time) > days
    used = picks.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_used", F.lit(True))
    what = F.when(~old, "recent").when(F.col("_used").isNotNull(), "referenced").otherwise("dropped")
    return snapshots.join(used, key, "left").groupBy(what.alias("what")).agg(F.count("*").alias("n"))


def unprocessed(games: DataFrame, box: DataFrame, key: str, when: Column) -> DataFrame:
    return games.where(when).join(box.select(key), key, "left_anti")


def write_slice(df: DataFrame, path: str, partitions: Sequence[str]) -> None:
    """Replaces the partitions that df has rows of, and no others. Large partitions are written by several tasks."""
    df.hint("rebalance", *partitions).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def write_observed(df: DataFrame, path: str, partitions: Sequence[str], metrics: Mapping[str, Column]) -> dict[str, object]:
    """`write_slice`, and aggregates of the rows that were taken while they were written, so that a monitor needs no second scan."""
    seen = Observation()
    write_slice(df.observe(seen, *[c.alias(n) for n, c in metrics.items()]), path, partitions)
    return dict(seen.get)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def dedup(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by a stated order, with all its columns."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def union_blocks(blocks: Sequence[DataFrame]) -> DataFrame:
    out = blocks[0]
    for b in blocks[1:]:
        out = out.unionByName(b, allowMissingColumns=True)
    return out


def merge_blocks(blocks: Sequence[DataFrame], key: str) -> DataFrame:
    """Feature blocks side by side by key, whichever block has it."""
    out = blocks[0]
    for b in blocks[1:]:
        out = out.join(b, key, "full")
    return out
