"""Reports over the settled ledger: track record, trend, scorecard, interval coverage, ideas.

Picks become counts by segment first; what needs an order of single picks (trend, drawdown) works on days and looks into
single days only, so no window runs over all picks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fieldbook.functions.counts import poisson_over, poisson_quantile
from fieldbook.functions.scalars import BREAKEVEN, side_adjusted, wilson
from fieldbook.operators.quantiles import quantiles
from fieldbook.operators.windows import top_per_key
from fieldbook.plans.ledger import COLD, HOT, with_cutoff
from fieldbook.session import saved

#: What a leg wins at the two-leg break-even, and in the scorecard's paper account; edges of the calibration bins; fewest picks of a sport, a bin, a market and a weak spot.
WIN_PAYS, PAPER_WIN = 1 / BREAKEVEN - 1, math.sqrt(3) - 1
BIN_EDGES = (0.50, 0.55, 0.60, 0.65, 0.70, 1.01)
LEAST_OF_SPORT, LEAST_OF_BIN, LEAST_OF_MARKET, LEAST_OF_SPOT, MARKETS = 5, 10, 8, 8, 8
#: Points of a trend, least picks of a trend and of a point, the trailing window's least size and its share of all.
POINTS, LEAST_TREND, LEAST_POINT, LEAST_WINDOW, WINDOW_SHARE = 14, 10, 5, 20, 8
#: A losing streak or a loss from the peak, in units, that make a cold stretch.
STREAK_ALERT, UNITS_ALERT = 6, 6.0
#: Quantiles of an interval and the share of outcomes that it should hold.
INTERVALS = ((0.25, 0.75, 0.50), (0.10, 0.90, 0.80))


def rank_trend(rows: DataFrame, keys: Sequence[str], day: str, order: str, win: str, points: int = POINTS) -> DataFrame:
    """keys, i, n, wins, rate of the trailing window at `points` ranks of the picks in order of day and `order`.

    The window holds a WINDOW_SHARE-th of the picks, LEAST_WINDOW at least. Days are cumulated; only the days that
    a window begins or ends in are ranked.
    """
    rows = saved(rows.where(F.col(day).isNotNull()).select(*keys, F.col(day).alias("_day"), order, F.col(win).cast("bigint").alias("_win")).withColumn("_all", F.lit(1)))
    on = ["_all", *keys]
    before = W.partitionBy(*on).orderBy("_day").rowsBetween(W.unboundedPreceding, -1)
    daily = rows.groupBy(*on, "_day").agg(F.count("*").alias("_n"), F.sum("_win").alias("_w"))
    daily = saved(daily.withColumns({"_n0": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_w0": F.coalesce(F.sum("_w").over(before), F.lit(0))}))
    total = daily.groupBy(*on).agg(F.sum("_n").alias("_total")).where(F.col("_total") >= LEAST_TREND)
    cuts = total.select(*on, "_total", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")).withColumn("_end", F.bround((F.col("i") + 1) * F.col("_total") / points).cast("bigint"))
    cuts = cuts.withColumn("_start", F.greatest(F.lit(0), F.col("_end") - F.greatest(F.lit(LEAST_WINDOW), F.floor(F.col("_total") / WINDOW_SHARE))))
    marks = cuts.select(*on, "i", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).alias("rank")) for s, c in ((-1, "_start"), (1, "_end"))])).alias("m")).select(*on, "i", "m.*")
    at = saved(marks.join(daily, on).where((F.col("rank") > F.col("_n0")) & (F.col("rank") <= F.col("_n0") + F.col("_n"))))
    nth = rows.join(at.select(*on, "_day").distinct(), [*on, "_day"], "left_semi").withColumn("_nth", F.row_number().over(W.partitionBy(*on, "_day").orderBy(order)))
    won = at.join(nth.select(*on, "_day", "_nth", "_win"), [*on, "_day"]).where(F.col("_nth") <= F.col("rank") - F.col("_n0"))
    won = won.groupBy(*on, "i", "side").agg((F.first("_w0") + F.sum("_win")).alias("_won")).groupBy(*on, "i").agg(F.sum(F.col("side") * F.col("_won")).alias("wins"))
    out = cuts.withColumn("n", F.col("_end") - F.col("_start")).where(F.col("n") >= LEAST_POINT).join(won, [*on, "i"], "left")
    return out.select(*keys, "i", "n", F.coalesce("wins", F.lit(0)).alias("wins")).withColumn("rate", F.col("wins") / F.col("n"))


def verdict(low: Column, high: Column) -> Column:
    return F.when(low >= BREAKEVEN, "edge").when(high < BREAKEVEN, "below breakeven").otherwise("not proven")


def summed(cells: DataFrame, keys: Sequence[str], section: str, part: Column, least: int = 1) -> DataFrame:
    """A report's rows of one section from counts n and wins."""
    got = (cells.groupBy(*keys) if keys else cells.groupBy()).agg(F.sum("n").alias("n"), F.sum("wins").alias("wins")).where(F.col("n") >= least)
    low, high = wilson(F.col("wins"), F.col("n"), 1.96)
    return got.withColumns({"_low": low, "_high": high}).select(F.lit(section).alias("section"), part.alias("part"), "n", "wins", (F.col("wins") / F.col("n")).alias("value"), F.col("_low").alias("low"), F.col("_high").alias("high"), verdict(F.col("_low"), F.col("_high")).alias("label"))


def plain(rows: DataFrame, section: str, part: Column, n: Column, wins: Column, value: Column) -> DataFrame:
    none = F.lit(None).cast("double")
    return rows.select(F.lit(section).alias("section"), part.cast("string").alias("part"), n.cast("bigint").alias("n"), wins.cast("bigint").alias("wins"), value.cast("double").alias("value"), none.alias("low"), none.alias("high"), F.lit(None).cast("string").alias("label"))


def performance_report(picks: DataFrame, recommended: DataFrame) -> DataFrame:
    """section, part, n, wins, value, low, high, label: the track record of settled picks and of those a walk-forward recommended.

    Sections: recommended, all, sport, market (hit rate, 95 % interval, verdict), roi (by sport, flat stakes at break-even odds),
    trend (trailing rate at 14 ranks), calibration (mean probability in `low`, actual rate in `value`, by bin), brier, clv
    (mean move of the market's price of our side to the close).
    """
    p, w = F.col("model_prob"), F.col("win")
    edge = sum((F.when(p >= e, 1).otherwise(0) for e in BIN_EDGES), F.lit(0))
    move = side_adjusted(F.col("market_prob_close"), F.col("direction")) - side_adjusted(F.col("market_prob"), F.col("direction"))
    cells = picks.groupBy(edge.alias("bin")).agg(F.count("*").alias("n"), F.sum(w).cast("bigint").alias("wins"), F.sum(p).alias("p"), F.sum((p - w) * (p - w)).alias("square"), F.count(move).alias("moves"), F.sum(move).alias("move"))
    cells, recommended = saved(cells), saved(recommended)
    own = saved(recommended.groupBy("sport", "stat_type", "direction").agg(F.count("*").alias("n"), F.sum(w).cast("bigint").alias("wins")))
    sports = own.groupBy("sport").agg(F.sum("n").alias("n"), F.sum("wins").alias("wins")).where(F.col("n") >= LEAST_OF_SPORT)
    market = summed(own, ["stat_type", "direction"], "market", F.concat_ws("|", "stat_type", "direction"), LEAST_OF_MARKET).orderBy(F.desc("n"), "part").limit(MARKETS)
    binned = cells.where((F.col("bin") >= 1) & (F.col("bin") < len(BIN_EDGES)) & (F.col("n") >= LEAST_OF_BIN))
    trend = rank_trend(recommended, [], "settled", "pick_id", "win")
    every = cells.groupBy().agg(F.sum("n").alias("n"), F.sum("wins").alias("wins"), F.sum("square").alias("square"), F.sum("moves").alias("moves"), F.sum("move").alias("move")).where("n > 0")
    none = F.lit(None).cast("string")
    parts = [
        summed(own, [], "recommended", none),
        summed(cells, [], "all", none),
        summed(own, ["sport"], "sport", F.col("sport"), LEAST_OF_SPORT),
        market,
        plain(sports, "roi", F.col("sport"), F.col("n"), F.col("wins"), (F.col("wins") * WIN_PAYS - (F.col("n") - F.col("wins"))) / F.col("n")),
        plain(trend, "trend", F.col("i"), F.col("n"), F.col("wins"), F.col("rate")),
        plain(binned, "calibration", F.col("bin"), F.col("n"), F.col("wins"), F.col("wins") / F.col("n")).join(binned.select(F.col("bin").cast("string").alias("part"), (F.col("p") / F.col("n")).alias("_p")), "part").withColumn("low", F.col("_p")).drop("_p").select("section", "part", "n", "wins", "value", "low", "high", "label"),
        plain(every, "brier", none, F.col("n"), F.col("wins"), F.col("square") / F.col("n")),
        plain(every.where("moves > 0"), "clv", none, F.col("moves"), F.lit(None), F.col("move") / F.col("moves")),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def drawdown(rows: DataFrame, day: str, order: str, win: str, pays: float = PAPER_WIN) -> DataFrame:
    """One row: units below the peak of a flat paper account, and the losses since the last win, over picks in order of day and `order`.

    Each day gives its profit and the highest point within it; only those are cumulated.
    """
    profit = F.when(F.col(win) == 1, F.lit(pays)).otherwise(-1.0)
    inside = rows.withColumn("_run", F.sum(profit).over(W.partitionBy(day).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))
    daily = inside.groupBy(day).agg(F.sum(profit).alias("_sum"), F.max("_run").alias("_top"))
    w = W.orderBy(day).rowsBetween(W.unboundedPreceding, -1)  # a row for each day
    daily = daily.withColumn("_before", F.coalesce(F.sum("_sum").over(w), F.lit(0.0)))
    money = daily.agg((F.greatest(F.lit(0.0), F.max(F.col("_before") + F.col("_top"))) - F.sum("_sum")).alias("drawdown"))
    place = F.struct(day, order)
    last = rows.agg(F.max(F.when(F.col(win) == 1, place)).alias("_last"))
    streak = rows.withColumn("_place", place).join(F.broadcast(last)).agg(F.count_if(F.col("_last").isNull() | (F.col("_place") > F.col("_last"))).alias("streak"))
    return money.join(F.broadcast(streak))


def scorecard(picks: DataFrame, cutoffs: DataFrame, day: str = "decided", days: int = 30, top: int = 5) -> DataFrame:
    """section, part, wins, losses, value, label of the last day with picks, its week and its `days` days.

    Recommended picks reach the cutoff of their stat. Sections: day, day_recommended, sport (recommended), week_recommended, top_day
    and top_week (each day's `top` likeliest recommended picks), weak_spot (the segment with the lowest rate below one half),
    cold (units below the peak in `value`, the streak in `losses`; labelled where it is a cold stretch).
    """
    last = picks.agg(F.max(day).alias("_last"))
    rows = with_cutoff(picks.join(F.broadcast(last)).withColumn("_age", F.datediff("_last", day)).where(F.col("_age") < days), cutoffs, direction=False)
    rows = saved(rows.select("pick_id", "sport", "stat_type", "direction", "model_prob", F.col("win").cast("bigint").alias("win"), F.col(day).alias("_day"), "_age", (F.col("model_prob") >= F.col("cutoff")).alias("_rec")))
    rec, none = rows.where("_rec"), F.lit(None).cast("string")

    def line(got: DataFrame, section: str, part: Column, *keys: str) -> DataFrame:
        sums = (got.groupBy(*keys) if keys else got.groupBy()).agg(F.sum("win").alias("wins"), F.sum(1 - F.col("win")).alias("losses")).where("wins is not null")
        return sums.select(F.lit(section).alias("section"), part.alias("part"), "wins", "losses", (F.col("wins") / (F.col("wins") + F.col("losses"))).alias("value"), none.alias("label"))

    best = saved(top_per_key(rec.where("_age < 7"), ["_day"], [F.desc("model_prob"), F.asc("pick_id")], top))
    segment = rows.groupBy("sport", "stat_type", "direction").agg(F.sum("win").alias("wins"), F.count("*").alias("n")).where((F.col("n") >= LEAST_OF_SPOT) & (F.col("wins") / F.col("n") < 0.5))
    weak = segment.withColumn("part", F.concat_ws("|", "sport", "stat_type", "direction")).orderBy(F.col("wins") / F.col("n"), "part").limit(1)
    week = line(rec.where("_age < 7"), "week_recommended", none)
    cold = drawdown(rec, "_day", "pick_id", "win").join(F.broadcast(week.agg(F.coalesce(F.max("value"), F.lit(1.0)).alias("_week")))).where("drawdown is not null")
    streak, deep = F.col("streak") >= STREAK_ALERT, (F.col("drawdown") >= UNITS_ALERT) & (F.col("_week") < BREAKEVEN)
    label = F.nullif(F.concat_ws(", ", F.when(streak, "losing streak"), F.when(deep, "below peak")), F.lit(""))
    parts = [
        line(rows.where("_age = 0"), "day", none),
        line(rec.where("_age = 0"), "day_recommended", none),
        line(rec.where("_age = 0"), "sport", F.col("sport"), "sport"),
        week,
        line(best.where("_age = 0"), "top_day", none),
        line(best, "top_week", none),
        weak.select(F.lit("weak_spot").alias("section"), "part", "wins", (F.col("n") - F.col("wins")).alias("losses"), (F.col("wins") / F.col("n")).alias("value"), none.alias("label")),
        cold.select(F.lit("cold").alias("section"), none.alias("part"), F.lit(None).cast("bigint").alias("wins"), F.col("streak").alias("losses"), F.col("drawdown").alias("value"), label.alias("label")),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def model_coverage(rows: DataFrame, key: str, actual: str, mean: str, least: int = 50, tolerance: float = 0.10) -> DataFrame:
    """interval, key (null: all), n, covered, off: how often the model's Poisson intervals hold the actual value, overall and by key.

    Rows are counted by key, mean and actual value first, so quantiles are taken for each mean once in a task.
    """
    cells = rows.where(F.col(mean).isNotNull() & F.col(actual).isNotNull()).groupBy(key, mean, actual).agg(F.count("*").alias("_n"))
    edges = {f"{side}_{i}": poisson_quantile(F.lit(q), F.col(mean)) for i, interval in enumerate(INTERVALS) for side, q in zip(("_low", "_high"), interval[:2], strict=True)}
    cells = cells.withColumns(edges)
    each = F.explode(F.array(*[F.struct(F.lit(f"{int(100 * a)}_{int(100 * b)}").alias("interval"), F.lit(want).alias("want"), F.col(actual).between(F.col(f"_low_{i}"), F.col(f"_high_{i}")).alias("in")) for i, (a, b, want) in enumerate(INTERVALS)])).alias("x")
    long = cells.select(F.col(key).alias(key), "_n", each).select(key, "_n", "x.*")
    out = long.groupingSets([[F.col("interval"), F.col("want")], [F.col("interval"), F.col("want"), F.col(key)]], F.col("interval"), F.col("want"), F.col(key)).agg(F.sum("_n").alias("n"), (F.sum(F.when(F.col("in"), F.col("_n")).otherwise(0)) / F.sum("_n")).alias("covered"))
    return out.where(F.col("n") >= least).select("interval", key, "n", "covered", (F.abs(F.col("covered") - F.col("want")) > tolerance).alias("off"))


#: The least volume-sorted slices of a synthetic-line backtest, and the fewest rows of a line or month.
TERTILES, LEAST_OF_SLICE = (0.33, 0.66), 30


def synthetic_backtest(rows: DataFrame, average: str, mean: str, actual: str, volume: str, date: str) -> DataFrame:
    """slice, part, n, accuracy, bias: the model's side against lines made of the season average, rounded to the half and one half at least.

    Slices: all, line, month (of LEAST_OF_SLICE rows or more) and volume tertile. Rows without an average and exact hits of the line don't
    count; even prices go under.
    """
    line = F.greatest(F.bround(F.col(average) * 2) / 2, F.lit(0.5))
    over = poisson_over(F.col("_line"), F.col(mean)) > 0.5
    rows = rows.where(F.col(average) > 0).withColumns({"_line": line, "_month": F.date_format(date, "yyyy-MM"), "_volume": F.coalesce(F.col(volume).cast("double"), F.lit(0.0)), "_bias": F.col(mean) - F.col(actual)})
    rows = saved(rows.where(F.col(actual) != F.col("_line")).select("_line", "_month", "_volume", "_bias", (over == (F.col(actual) > F.col("_line"))).cast("double").alias("_right")))
    cuts = F.broadcast(quantiles(rows, [], "_volume", TERTILES, "_q"))  # one row
    tertile = F.when(F.col("_volume") <= F.col("_q")[0], "low").when(F.col("_volume") <= F.col("_q")[1], "mid").otherwise("high")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("slice"), c.cast("string").alias("part"), F.lit(least).alias("least")) for n, c, least in (("all", F.lit(None), 1), ("line", F.col("_line"), LEAST_OF_SLICE), ("volume", tertile, 1), ("month", F.col("_month"), LEAST_OF_SLICE))])).alias("x")
    out = rows.join(cuts).select("_right", "_bias", each).groupBy("x.slice", "x.part", "x.least").agg(F.count("*").alias("n"), F.avg("_right").alias("accuracy"), F.avg("_bias").alias("bias"))
    return out.where("n >= least").drop("least")


#: Days, picks and rate of a recovering segment; days and picks of a hot or cold one.
RECOVERING, RECENT = (14, 10, 0.58), (21, 12)


def ideas(picks: DataFrame, cutoffs: DataFrame, last: Column, day: str = "decided") -> DataFrame:
    """kind, sport, stat_type, direction, n, rate: the hottest and the coldest segment, and suppressed stats that recover."""
    days, least = RECENT
    age = F.datediff(last, day)
    recent = saved(picks.where((age >= 0) & (age < max(days, RECOVERING[0]))).groupBy("sport", "stat_type", "direction", (age < RECOVERING[0]).alias("_new")).agg(F.count("*").alias("n"), F.sum("win").alias("w")))
    seg = recent.groupBy("sport", "stat_type", "direction").agg(F.sum("n").alias("n"), (F.sum("w") / F.sum("n")).alias("rate")).where(F.col("n") >= least)
    order = [F.asc("sport"), F.asc("stat_type"), F.asc("direction")]
    first = [seg.where(F.col("rate") >= HOT).orderBy(F.desc("rate"), *order).limit(1).withColumn("kind", F.lit("hot")), seg.where(F.col("rate") <= COLD).orderBy(F.asc("rate"), *order).limit(1).withColumn("kind", F.lit("cold"))]
    bad = cutoffs.where("level = 2 and status = 'suppressed'").select("sport", "stat_type")
    back = recent.where("_new").join(bad, ["sport", "stat_type"], "left_semi").groupBy("sport", "stat_type").agg(F.sum("n").alias("n"), (F.sum("w") / F.sum("n")).alias("rate"))
    back = back.where((F.col("n") >= RECOVERING[1]) & (F.col("rate") >= RECOVERING[2])).withColumns({"kind": F.lit("recovering"), "direction": F.lit(None).cast("string")})
    return first[0].unionByName(first[1]).unionByName(back).select("kind", "sport", "stat_type", "direction", "n", "rate")
