"""Registry, and the views in which the star-schema tables stand for the domain's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.session import in_pieces

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    in_pieces(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, dates and counts as they are."""
    return df.select(*[r6(c).alias(c) if t in ("double", "float") else F.col(c).cast("bigint").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


# --- the pick ledger: lineitem with its order ------------------------------------------------------

LEDGER = """
 select ((l_orderkey * 100000 + l_partkey) * 10000 + l_suppkey) * 10 + l_linenumber as pick_id, l_orderkey as game_id, l_suppkey as player_id, l_partkey as line_id,
  l_returnflag as sport, l_linestatus as stat_type, case when l_linenumber % 2 = 0 then 'over' else 'under' end as direction,
  (550 + 30 * cast(round(l_discount * 100) as bigint)) / cast(1000 as double) as model_prob,
  case when (l_orderkey * 31 + l_partkey * 17 + l_suppkey * 7 + l_linenumber * 13) % 100 < 55 + 3 * cast(round(l_discount * 100) as bigint) - case l_returnflag when 'A' then 2 when 'N' then 18 else 7 end then 1 else 0 end as win,
  cast(o_orderdate as date) as decided, cast(o_orderdate as date) + cast(l_linenumber % 3 as int) as settled,
  cast(3 + cast(l_quantity as bigint) % 20 as double) / 10 as payout, cast(45 + l_partkey % 20 as double) / 100 as market_prob, l_quantity as quantity
 from lineitem join orders on l_orderkey = o_orderkey
"""


def ledger(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    """Picks of all orders and lines, or of the given ones."""
    orders = table(spark, sf_dir, "orders") if orders is None else orders
    lines = table(spark, sf_dir, "lineitem") if lines is None else lines
    rows = lines.join(orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    k = F.round(F.col("l_discount") * 100).cast("bigint")
    mark = (F.col("l_orderkey") * 31 + F.col("l_partkey") * 17 + F.col("l_suppkey") * 7 + F.col("l_linenumber") * 13) % 100
    less = F.when(F.col("l_returnflag") == "A", 2).when(F.col("l_returnflag") == "N", 18).otherwise(7)
    day = F.col("o_orderdate").cast("date")
    return rows.select(
        (((F.col("l_orderkey") * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")).alias("pick_id"), F.col("l_orderkey").alias("game_id"), F.col("l_suppkey").alias("player_id"), F.col("l_partkey").alias("line_id"),
        F.col("l_returnflag").alias("sport"), F.col("l_linestatus").alias("stat_type"), F.when(F.col("l_linenumber") % 2 == 0, "over").otherwise("under").alias("direction"),
        ((550 + 30 * k) / F.lit(1000.0)).alias("model_prob"), F.when(mark < 55 + 3 * k - less, 1).otherwise(0).alias("win"),
        day.alias("decided"), F.date_add(day, F.col("l_linenumber") % 3).alias("settled"),
        ((3 + F.col("l_quantity").cast("bigint") % 20).cast("double") / 10).alias("payout"), ((45 + F.col("l_partkey") % 20).cast("double") / 100).alias("market_prob"), F.col("l_quantity").alias("quantity"),
    )


# --- player rows: a customer's orders; team rows: a supplier's part of an order --------------------

PLAYER = "select o_custkey as player_id, o_orderkey as player_game_id, cast(o_orderdate as date) as game_date, cast(year(o_orderdate) as varchar) as season, o_totalprice as points, o_orderstatus as status from orders"


def player_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("player_id"), F.col("o_orderkey").alias("player_game_id"), day.alias("game_date"), F.year(day).cast("string").alias("season"), F.col("o_totalprice").alias("points"), F.col("o_orderstatus").alias("status"))


DENSE = "select ((l_orderkey * 100000 + l_partkey) * 10000 + l_suppkey) * 10 + l_linenumber as player_game_id, l_orderkey as game_id, l_suppkey as team_id, l_partkey % 100 as opponent_id, l_partkey as player_id, cast(l_shipdate as date) as game_date, cast(year(l_shipdate) as varchar) as season, l_quantity as points, cast(round(l_discount * 100) as bigint) as assists, cast(round(l_tax * 100) as bigint) as turnovers, l_linenumber as minutes, l_returnflag as position from lineitem"


def dense_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("l_shipdate").cast("date")
    return table(spark, sf_dir, "lineitem").select(
        (((F.col("l_orderkey") * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")).alias("player_game_id"), F.col("l_orderkey").alias("game_id"), F.col("l_suppkey").alias("team_id"), (F.col("l_partkey") % 100).alias("opponent_id"), F.col("l_partkey").alias("player_id"),
        day.alias("game_date"), F.year(day).cast("string").alias("season"), F.col("l_quantity").alias("points"), F.round(F.col("l_discount") * 100).cast("bigint").alias("assists"), F.round(F.col("l_tax") * 100).cast("bigint").alias("turnovers"), F.col("l_linenumber").alias("minutes"), F.col("l_returnflag").alias("position"),
    )


TEAM = "select l_orderkey as game_id, l_suppkey as team_id, cast(min(o_orderdate) as date) as game_date, cast(year(min(o_orderdate)) as varchar) as season, sum(l_quantity) as points, cast(count(*) as bigint) as players from lineitem join orders on l_orderkey = o_orderkey group by 1, 2"


def team_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    out = rows.groupBy(F.col("l_orderkey").alias("game_id"), F.col("l_suppkey").alias("team_id")).agg(F.min(F.col("o_orderdate").cast("date")).alias("game_date"), F.sum("l_quantity").alias("points"), F.count("*").alias("players"))
    return out.withColumn("season", F.year("game_date").cast("string"))


# --- snapshots: views of events are lines, purchases are starts ------------------------------------

SNAPSHOTS = "select event_id as line_id, user_id as player_id, ts as snapshot_at, value as line_value, event_type from events"


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("line_id"), F.col("user_id").alias("player_id"), F.col("ts").alias("snapshot_at"), F.col("value").alias("line_value"), "event_type")
