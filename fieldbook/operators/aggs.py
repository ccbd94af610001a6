"""Aggregations of ledgers, quotes and features. Counts combine before the shuffle; no operator ranks single rows globally."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fieldbook.functions.scalars import wilson
from fieldbook.operators.joins import small
from fieldbook.operators.quantiles import quantiles
from fieldbook.session import saved


def matched(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left rows with the other columns of the right row of their keys, null keys among them; null columns without one."""
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return left.join(right.withColumnsRenamed({k: f"_k_{k}" for k in keys}), on, "left").drop(*[f"_k_{k}" for k in keys])


def share_of_total(df: DataFrame, group: Sequence[str], column: str, name: str) -> DataFrame:
    total = F.sum(column).over(W.partitionBy(*group))
    return df.withColumn(name, F.coalesce(F.when(total > 0, F.col(column) / total), F.lit(0.0)))


def accuracy(df: DataFrame, sets: Sequence[Sequence[str]], win: str = "win", prob: str = "model_prob", least: int = 1) -> DataFrame:
    """n, wins, hit, mean_prob, brier by each grouping set; columns outside a set are null, `level` is the set's size."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    out = df.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(
        F.count("*").alias("n"), F.sum(win).cast("bigint").alias("wins"), F.avg(F.col(win).cast("double")).alias("hit"), F.avg(prob).alias("mean_prob"), F.avg(F.pow(F.col(prob) - F.col(win), F.lit(2))).alias("brier"), F.grouping_id().alias("_gid")
    )
    masks = {sum((0 if k in s else 1) << (len(keys) - 1 - i) for i, k in enumerate(keys)): len(s) for s in sets}
    level = F.try_element_at(F.create_map(*[F.lit(x) for kv in masks.items() for x in kv]), F.col("_gid").cast("int"))
    return out.withColumn("level", level).where(F.col("n") >= least).drop("_gid")


def ledger_summary(df: DataFrame, keys: Sequence[str], result: str, prob: str, edge: str) -> DataFrame:
    wins, losses = F.count_if(F.col(result) == "win"), F.count_if(F.col(result) == "loss")
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), wins.alias("wins"), losses.alias("losses"), F.count_if(F.col(result) == "push").alias("pushes"), F.count_if(F.col(result) == "void").alias("voids"),
        F.try_divide(100.0 * wins, F.nullif(wins + losses, F.lit(0))).alias("win_pct"), F.avg(prob).alias("mean_prob"), F.avg(edge).alias("mean_edge"),
    )


def binned(value: Column, edges: Sequence[float], right: bool = False) -> Column:
    """Number of the bin [a, b), or (a, b] if right; null outside. The last, or first, edge belongs to its bin."""
    out = None
    last = len(edges) - 2
    for i in range(len(edges) - 1):
        a, b = edges[i], edges[i + 1]
        test = ((value > a) | (F.lit(i == 0) & (value == a))) & (value <= b) if right else (value >= a) & ((value < b) | (F.lit(i == last) & (value == b)))
        out = F.when(test, i) if out is None else out.when(test, i)
    return out


def calibration(df: DataFrame, edges: Sequence[float], prob: str = "model_prob", win: str = "win", keys: Sequence[str] = (), right: bool = False) -> DataFrame:
    out = df.withColumn("bin", binned(F.col(prob), edges, right)).where("bin is not null").groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg(prob).alias("predicted"), F.avg(F.col(win).cast("double")).alias("actual"))
    return out.withColumn("gap", F.col("actual") - F.col("predicted"))


def weighted_gap(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return table.groupBy(*keys).agg((F.sum(F.abs("gap") * F.col("n")) / F.sum("n")).alias("weighted_gap"))


def brier(prob: Column, win: Column) -> Column:
    return F.avg(F.pow(prob - win, F.lit(2)))


def murphy(df: DataFrame, keys: Sequence[str], prob: str = "model_prob", win: str = "win", bins: int = 10) -> DataFrame:
    """reliability, resolution, uncertainty of each segment over equal bins of the probability."""
    cell = df.withColumn("_bin", F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1))).groupBy(*keys, "_bin").agg(F.count("*").alias("_n"), F.sum(prob).alias("_p"), F.sum(F.col(win).cast("double")).alias("_w"))
    total = cell.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sum("_w").alias("_all")) if keys else cell.agg(F.sum("_n").alias("n"), F.sum("_w").alias("_all"))
    rows = cell.join(total, list(keys)) if keys else cell.join(F.broadcast(total))
    rate, base = F.col("_w") / F.col("_n"), F.col("_all") / F.col("n")
    return rows.groupBy(*keys, "n").agg(
        (F.sum(F.col("_n") * F.pow(F.col("_p") / F.col("_n") - rate, F.lit(2))) / F.first("n")).alias("reliability"),
        (F.sum(F.col("_n") * F.pow(rate - base, F.lit(2))) / F.first("n")).alias("resolution"),
        F.first(base * (1 - base)).alias("uncertainty"),
    )


def auc(df: DataFrame, keys: Sequence[str], prob: str = "model_prob", win: str = "win", thin: int = 150, leak: float = 0.65) -> DataFrame:
    """n, auc (ties count half), se (Hanley-McNeil), flag of each segment.

    Rows are counted by segment and probability first, so the cumulative window runs over distinct probabilities.
    """
    cell = df.groupBy(*keys, prob).agg(F.sum(F.col(win).cast("double")).alias("_pos"), F.sum(1.0 - F.col(win)).alias("_neg"))
    w = W.partitionBy(*keys).orderBy(prob).rowsBetween(W.unboundedPreceding, -1)
    cell = cell.withColumn("_below", F.coalesce(F.sum("_neg").over(w), F.lit(0.0)))
    out = cell.groupBy(*keys).agg(F.sum("_pos").alias("p"), F.sum("_neg").alias("q"), F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2)).alias("u"))
    a = F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("u") / (F.col("p") * F.col("q")))
    out = out.withColumn("auc", a)
    q1, q2 = F.col("auc") / (2 - F.col("auc")), 2 * F.col("auc") * F.col("auc") / (1 + F.col("auc"))
    var = (F.col("auc") * (1 - F.col("auc")) + (F.col("p") - 1) * (q1 - F.col("auc") * F.col("auc")) + (F.col("q") - 1) * (q2 - F.col("auc") * F.col("auc"))) / (F.col("p") * F.col("q"))
    n = (F.col("p") + F.col("q")).cast("bigint")
    flag = F.when(n < thin, "thin").when(F.col("auc") > leak, "leak").otherwise("ok")
    return out.select(*keys, n.alias("n"), "auc", F.sqrt(F.greatest(var, F.lit(0.0))).alias("se"), flag.alias("flag"))


def consensus(quotes: DataFrame, keys: Sequence[str], prob: str) -> DataFrame:
    """Median over books; few rows for each key, so it is exact."""
    return quotes.groupBy(*keys).agg(F.round(F.median(prob), 4).alias("market_over_prob"), F.count("*").alias("books"))


def overdispersion(df: DataFrame, entity: str, stat: str, keys: Sequence[str] = (), least: int = 20) -> DataFrame:
    """Quartiles over entities of variance / mean within the entity."""
    own = df.groupBy(*keys, entity).agg(F.count("*").alias("n"), (F.var_samp(stat) / F.avg(stat)).alias("vmr")).where((F.col("n") >= least) & F.col("vmr").isNotNull())
    own = saved(own.select(*keys, "vmr"))
    out = matched(own.groupBy(*keys).agg(F.count("*").alias("entities")), quantiles(own, keys, "vmr", (0.25, 0.5, 0.75), "_q"), keys)
    return out.select(*keys, "entities", *[F.col("_q")[i].alias(n) for i, n in enumerate(("q25", "q50", "q75"))])


def residual_dispersion(df: DataFrame, keys: Sequence[str], actual: str, mean: str) -> DataFrame:
    return df.where(F.col(mean) > 0).groupBy(*keys).agg(F.count("*").alias("n"), (F.sum(F.pow(F.col(actual) - F.col(mean), F.lit(2))) / F.sum(mean)).alias("dispersion"))


def interval_anchors(df: DataFrame, keys: Sequence[str], mean: str, actual: str, bins: int = 8) -> DataFrame:
    """Empirical quartiles of the actual value in equal-count bins of the predicted mean; edges are quantiles, so no row is ranked globally."""
    df = saved(df.select(*keys, mean, actual))
    edges = quantiles(df, keys, mean, [i / bins for i in range(1, bins)], "_e")
    rows = saved(matched(df, edges, keys).withColumn("bin", F.size(F.filter("_e", lambda e: e < F.col(mean)))).drop("_e"))
    out = rows.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg(mean).alias("anchor"))
    return matched(out, quantiles(rows, [*keys, "bin"], actual, (0.25, 0.75), "_q"), [*keys, "bin"]).withColumns({"low": F.col("_q")[0], "high": F.col("_q")[1]}).drop("_q")


def nearest_anchor(df: DataFrame, anchors: DataFrame, keys: Sequence[str], row_id: str, mean: str) -> DataFrame:
    """low and high of the anchor whose mean is nearest; ties go to the lower anchor. Anchors are a few rows for each key: they come to the rows as one array, and a row picks its own."""
    sets = small(saved(anchors.groupBy(*keys).agg(F.collect_list(F.struct("anchor", "low", "high")).alias("_s"))))
    near = F.array_min(F.transform("_s", lambda x: F.struct(F.abs(F.col(mean) - x["anchor"]).alias("off"), x["anchor"].alias("anchor"), x["low"].alias("low"), x["high"].alias("high"))))
    own = df.select(row_id, *keys, mean).join(sets, list(keys)).select(row_id, near.alias("_a"))
    return own.groupBy(row_id).agg(F.min("_a").alias("_a")).select(row_id, "_a.anchor", "_a.low", "_a.high")


def coverage(df: DataFrame, keys: Sequence[str], actual: str, low: str, high: str, expected: float, least: int = 50, tolerance: float = 0.10) -> DataFrame:
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.col(actual).between(F.col(low), F.col(high)).cast("double")).alias("covered"))
    return out.where(F.col("n") >= least).withColumn("off", F.abs(F.col("covered") - expected) > tolerance)


def threshold_roi(df: DataFrame, thresholds: Sequence[float], edge: str, profit: str, win: str, keys: Sequence[str] = ()) -> DataFrame:
    """Bets, hit rate and mean profit from each edge threshold up; thresholds are exploded in the row, then combined."""
    rows = df.withColumn("threshold", F.explode(F.filter(F.array(*map(F.lit, thresholds)), lambda t: F.col(edge) >= t)))
    return rows.groupBy(*keys, "threshold").agg(F.count("*").alias("n"), F.avg(F.col(win).cast("double")).alias("hit"), F.avg(profit).alias("roi"))


def tier_roi(df: DataFrame, keys: Sequence[str], prob: str, payout: str, win: str, least: int = 30) -> DataFrame:
    """ROI of picks of positive expected value with a normal interval, and a verdict."""
    profit = F.when(F.col(win) == 1, F.col(payout) - 1).otherwise(-1.0)
    rows = df.where(F.col(prob) * F.col(payout) > 1).withColumn("_profit", profit)
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_profit").alias("roi"), F.avg(F.col(win).cast("double")).alias("hit"), F.avg(payout).alias("mean_payout"), F.var_pop("_profit").alias("_v"))
    half = 1.96 * F.sqrt(F.col("_v") / F.col("n"))
    out = out.withColumn("low", F.col("roi") - half).withColumn("high", F.col("roi") + half).drop("_v")
    return out.withColumn("verdict", F.when(F.col("n") < least, "thin").when(F.col("low") > 0, "profitable").when(F.col("high") < 0, "losing").otherwise("inconclusive"))


def coverage_drift(df: DataFrame, features: Sequence[str], date: str, split: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Share of present, non-zero values before and after the split date, and whether it collapsed."""
    long = df.select(*keys, (F.col(date) >= split).alias("_new"), F.explode(F.map_from_arrays(F.array(*map(F.lit, features)), F.array(*[F.col(f).cast("double") for f in features]))).alias("feature", "_v"))
    has = (F.col("_v").isNotNull() & (F.col("_v") != 0)).cast("double")
    out = long.groupBy(*keys, "feature").agg(F.avg(F.when(~F.col("_new"), has)).alias("base"), F.avg(F.when(F.col("_new"), has)).alias("recent"))
    return out.withColumn("collapsed", F.coalesce((F.col("base") >= 0.5) & (F.col("recent") < 0.4 * F.col("base")), F.lit(False)))


def feature_value(df: DataFrame, features: Sequence[str], actual: str, predicted: str) -> DataFrame:
    """Correlation of each feature with the actual value and with the residual, its coverage, and mean actuals of its outer thirds (by exact quantiles)."""
    long = df.select(F.col(actual).alias("_a"), (F.col(actual) - F.col(predicted)).alias("_r"), F.explode(F.map_from_arrays(F.array(*map(F.lit, features)), F.array(*[F.col(f).cast("double") for f in features]))).alias("feature", "_v"))
    long = saved(long)
    cut = quantiles(long, ["feature"], "_v", (1 / 3, 2 / 3), "_c")
    rows = long.join(F.broadcast(cut), "feature", "left")  # a row for each feature
    return rows.groupBy("feature").agg(F.corr("_v", "_a").alias("corr_actual"), F.corr("_v", "_r").alias("corr_residual"), F.avg((F.coalesce(F.col("_v"), F.lit(0.0)) != 0).cast("double")).alias("covered"), F.avg(F.when(F.col("_v") <= F.col("_c")[0], F.col("_a"))).alias("low_third"), F.avg(F.when(F.col("_v") > F.col("_c")[1], F.col("_a"))).alias("high_third"))


def history_against_lines(history: DataFrame, lines: DataFrame, player: str, value: str, over: float, line: str, least: int = 30) -> DataFrame:
    """Players of `least` games or more that have lines now: mean value, share of games above `over`, games, and the mean of the current lines."""
    past = history.groupBy(player).agg(F.avg(value).alias("mean"), F.avg((F.col(value) > over).cast("double")).alias("over_rate"), F.count("*").alias("games")).where(F.col("games") >= least)
    return past.join(lines.groupBy(player).agg(F.avg(line).alias("mean_line")), player)


def co_occurrence(df: DataFrame, group: Sequence[str], kind: str, hit: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Joint and independent rates and lift of two indicators in the same group, from a row for each group and kind."""
    wide = df.groupBy(*group).agg(*[F.max(F.when(F.col(kind) == k, F.col(hit))).alias(f"_{k}") for k in dict.fromkeys(k for p in pairs for k in p)])
    wide = wide.select(*[F.col(f"_{k}").alias(f"_{k}") for k in dict.fromkeys(k for p in pairs for k in p)])
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{a}").alias("x"), F.col(f"_{b}").alias("y")) for a, b in pairs])).alias("e")).select("e.*").where("x is not null and y is not null")
    out = long.groupBy("a", "b").agg(F.count("*").alias("n"), F.avg((F.col("x") * F.col("y")).cast("double")).alias("joint"), (F.avg(F.col("x").cast("double")) * F.avg(F.col("y").cast("double"))).alias("independent"))
    return out.withColumn("lift", F.col("joint") / F.col("independent")).withColumn("ev", 3 * F.col("joint") - 1)


def segment(df: DataFrame, keys: Sequence[str], win: str = "win", prob: str = "model_prob", breakeven: float = 0.577, least: int = 30) -> DataFrame:
    """n, wins, hit, 95 % Wilson interval, Brier score and verdict of each segment."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(win).cast("bigint").alias("wins"), brier(F.col(prob), F.col(win)).alias("brier"))
    low, high = wilson(F.col("wins"), F.col("n"), 1.96)
    verdict = F.when(F.col("n") < least, "thin").when(F.col("low") >= breakeven, "edge").when(F.col("high") < breakeven, "no edge").otherwise("unproven")
    return out.withColumn("hit", F.col("wins") / F.col("n")).withColumn("low", low).withColumn("high", high).withColumn("verdict", verdict)


def period_drift(df: DataFrame, keys: Sequence[str], recent: Column, win: str = "win", prob: str = "model_prob") -> DataFrame:
    rows = df.withColumn("_recent", recent)
    def part(x: Column, new: bool) -> Column:
        return F.avg(F.when(F.col("_recent") if new else ~F.col("_recent"), x))

    w, gap = F.col(win).cast("double"), F.col(win) - F.col(prob)
    return rows.groupBy(*keys).agg(part(w, False).alias("hit_before"), part(w, True).alias("hit_recent"), part(gap, False).alias("gap_before"), part(gap, True).alias("gap_recent")).withColumn("drift", F.col("hit_recent") - F.col("hit_before"))
