"""Window operators over ordered entities.

Each looks at rows before the current one only, so that a row's features never hold its own outcome or a later
one. `order` must be a total order within the entity. Frames over one partitioning and order share one
sort; pass all columns of a kind at once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from pyspark.sql.window import WindowSpec


def entity(partition: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return W.partitionBy(*partition).orderBy(*order)


def before(w: WindowSpec, rows: int | None = None) -> WindowSpec:
    """The frame of the prior `rows` rows, or of all prior ones."""
    return w.rowsBetween(W.unboundedPreceding if rows is None else -rows, -1)


def prior_means(df: DataFrame, partition: Sequence[str], order: Sequence[str], stats: Sequence[str], sizes: Sequence[int] = (5, 10, 20), fill: float | None = 0.0) -> DataFrame:
    """last_{n}_avg_{stat}: mean of the prior n rows, for each stat and size."""
    w = entity(partition, order)
    out = {f"last_{n}_avg_{s}": F.avg(s).over(before(w, n)) for n in sizes for s in stats}
    return df.withColumns({k: v if fill is None else F.coalesce(v, F.lit(fill)) for k, v in out.items()})


def season_means(df: DataFrame, partition: Sequence[str], season: str, order: Sequence[str], stats: Sequence[str]) -> DataFrame:
    """season_avg_{stat}: mean of the prior rows of the season."""
    w = before(entity([*partition, season], order))
    return df.withColumns({f"season_avg_{s}": F.coalesce(F.avg(s).over(w), F.lit(0.0)) for s in stats})


def threshold_rates(df: DataFrame, partition: Sequence[str], order: Sequence[str], limits: Mapping[str, Sequence[float]], size: int = 10, count_missing_slot: bool = False) -> DataFrame:
    """last_{size}_rate_over_{limit}_{stat}: share of the prior rows above the limit.

    With count_missing_slot the row before the first one counts as a miss, as in stored tables of that form.
    """
    w = entity(partition, order)
    prior = before(w, size)
    out = {}
    for stat, values in limits.items():
        for limit in values:
            over = F.sum((F.col(stat) > limit).cast("double")).over(prior)
            n = F.count(F.lit(1)).over(prior)
            if count_missing_slot:
                n = F.least(F.row_number().over(w), F.lit(size))
            out[f"last_{size}_rate_over_{limit:g}_{stat}".replace(".", "_")] = F.coalesce(F.when(n > 0, over / n), F.lit(0.0))
    return df.withColumns(out)


def days_since(df: DataFrame, partition: Sequence[str], order: Sequence[str], date: str, name: str = "days_rest", first: int = -1) -> DataFrame:
    return df.withColumn(name, F.coalesce(F.datediff(F.col(date), F.lag(date).over(entity(partition, order))), F.lit(first)))


def prior_count(df: DataFrame, partition: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    return df.withColumn(name, (F.row_number().over(entity(partition, order)) - 1).cast("bigint"))


def runs(df: DataFrame, partition: Sequence[str], order: Sequence[str], value: str, name: str = "run") -> DataFrame:
    """The number of the run of equal values that a row is in, from 0."""
    w = entity(partition, order)
    change = F.when(~F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 1).otherwise(0)
    return df.withColumn("_change", change).withColumn(name, F.sum("_change").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("bigint")).drop("_change")


def series_context(df: DataFrame, partition: Sequence[str], order: Sequence[str], stats: Sequence[str]) -> DataFrame:
    """series_game_num and series_avg_{stat} of prior meetings; `partition` holds entity, season and opponent."""
    w = entity(partition, order)
    return df.withColumns({"series_game_num": (F.row_number().over(w) - 1).cast("bigint")} | {f"series_avg_{s}": F.coalesce(F.avg(s).over(before(w)), F.lit(0.0)) for s in stats})


def prior_ratio(df: DataFrame, partition: Sequence[str], order: Sequence[str], ratios: Mapping[str, tuple[str, str, float]], sizes: Sequence[int]) -> DataFrame:
    """{name}_{n} = scale * sum(numerator) / sum(denominator) over the prior n rows; 0 where the denominator isn't positive."""
    w, out = entity(partition, order), {}
    for n in sizes:
        for name, (top, below, scale) in ratios.items():
            den = F.sum(below).over(before(w, n))
            out[f"{name}_{n}"] = F.coalesce(F.when(den > 0, scale * F.sum(top).over(before(w, n)) / den), F.lit(0.0))
    return df.withColumns(out)


def career_vs(df: DataFrame, partition: Sequence[str], order: Sequence[str], stats: Sequence[str], least: int = 2) -> DataFrame:
    """vs_avg_{stat} over all prior meetings, 0 with fewer than `least`."""
    w = before(entity(partition, order))
    return df.withColumns({f"vs_avg_{s}": F.when(F.count(F.lit(1)).over(w) >= least, F.avg(s).over(w)).otherwise(0.0) for s in stats})


def prior_totals(df: DataFrame, partition: Sequence[str], order: Sequence[str], stats: Sequence[str], prefix: str = "career_") -> DataFrame:
    w = before(entity(partition, order))
    return df.withColumns({f"{prefix}{s}": F.coalesce(F.sum(s).over(w), F.lit(0.0)) for s in stats})


def games_in_days(df: DataFrame, partition: Sequence[str], order: Sequence[str], date: str, days: int = 7, name: str = "games_last_7_days") -> DataFrame:
    """Prior rows within the days before, and earlier rows of the same day."""
    day = F.unix_date(F.col(date).cast("date"))
    near = F.count(F.lit(1)).over(W.partitionBy(*partition).orderBy(day).rangeBetween(-days, -1))
    same = F.row_number().over(W.partitionBy(*partition, date).orderBy(*order)) - 1
    return df.withColumn(name, (near + same).cast("bigint"))


def conditional_last(df: DataFrame, partition: Sequence[str], order: Sequence[str], stat: str, when: Column, name: str, look_back: int = 30, take: int = 10) -> DataFrame:
    """Mean of the last `take` matching rows among the prior `look_back`; 0 if none matches."""
    w = before(entity(partition, order), look_back)
    held = F.collect_list(F.when(when, F.col(stat))).over(w)
    last = F.slice(held, F.greatest(F.size(held) - take + 1, F.lit(1)), F.lit(take))
    mean = F.aggregate(last, F.lit(0.0), lambda a, x: a + x) / F.size(last)
    return df.withColumn(name, F.when(F.size(held) > 0, mean).otherwise(0.0))


def prior_spread(df: DataFrame, partition: Sequence[str], order: Sequence[str], stat: str, name: str, size: int = 10) -> DataFrame:
    """Sample standard deviation of the prior rows, 0 with fewer than two."""
    return df.withColumn(name, F.coalesce(F.stddev_samp(stat).over(before(entity(partition, order), size)), F.lit(0.0)))


def form(df: DataFrame, partition: Sequence[str], order: Sequence[str], won: str, size: int = 5) -> DataFrame:
    """team_last_{size}_wins and team_won_last_game; one row for each team and game."""
    w = entity(partition, order)
    return df.withColumns({f"team_last_{size}_wins": F.coalesce(F.sum(won).over(before(w, size)), F.lit(0)).cast("bigint"), "team_won_last_game": F.coalesce(F.lag(won).over(w), F.lit(0)).cast("bigint")})


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The last row of each key by a total order: an aggregation, so rows combine before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each key; Spark drops rows beyond the n-th before the shuffle."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)


def recent_form(df: DataFrame, partition: Sequence[str], order: Sequence[Column], hit: Column, sizes: Sequence[int] = (5, 10)) -> DataFrame:
    """hits_{n}: "hits/decided" over the newest n rows of each entity; `hit` is null for pushes."""
    keep = top_per_key(df.withColumn("_hit", hit.cast("int")), partition, order, max(sizes), "_rank")
    cols = []
    for n in sizes:
        inside = F.col("_rank") <= n
        cols.append(F.concat_ws("/", F.count_if(inside & (F.col("_hit") == 1)).cast("string"), F.count_if(inside & F.col("_hit").isNotNull()).cast("string")).alias(f"hits_{n}"))
    return keep.groupBy(*partition).agg(*cols)


def bankroll(daily: DataFrame, partition: Sequence[str], day: str, profit: str) -> DataFrame:
    """balance, peak and drawdown by day, from one row for each day: so the window runs over days, not picks."""
    w = W.partitionBy(*partition).orderBy(day).rowsBetween(W.unboundedPreceding, 0)
    out = daily.withColumn("balance", F.sum(profit).over(w))
    out = out.withColumn("peak", F.greatest(F.max("balance").over(w), F.lit(0)))
    return out.withColumn("drawdown", F.col("peak") - F.col("balance"))


def losing_streak(df: DataFrame, partition: Sequence[str], order: Sequence[str], won: str) -> DataFrame:
    """losses since the last win of each entity: the last win's place is an aggregate, rows after it are counted."""
    place = F.struct(*order)
    last = df.groupBy(*partition).agg(F.max(F.when(F.col(won) == 1, place)).alias("_last"))
    rows = df.withColumn("_place", place).join(last, list(partition))
    return rows.groupBy(*partition).agg(F.count_if(F.col("_last").isNull() | (F.col("_place") > F.col("_last"))).alias("losing_streak"))


def upcoming(df: DataFrame, upcoming_rows: DataFrame, mark: str = "is_upcoming") -> DataFrame:
    """History and upcoming rows in one frame: the windows that made the training rows make the live vector."""
    return df.withColumn(mark, F.lit(False)).unionByName(upcoming_rows.withColumn(mark, F.lit(True)), allowMissingColumns=True)
