"""Pick-ledger jobs: settling, gates, cutoffs, walk-forward evaluation, calibration, closing lines, reports.

A ledger has sport, stat_type, direction, model_prob, win (0/1), decided and settled (dates).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fieldbook.functions.scalars import BREAKEVEN, american_decimal, blend, grade, half_kelly, pick_ev, platt, roi_two_legs, wilson
from fieldbook.operators import aggs
from fieldbook.operators.windows import top_per_key
from fieldbook.session import saved

#: Fixed values of the cutoff rules.
GRID = tuple(round(0.55 + 0.025 * i, 3) for i in range(13))
SWEEP = tuple(round(0.50 + 0.025 * i, 3) for i in range(13))
DEFAULT, SUPPRESS = 0.70, 0.99
LEAST_SPORT, LEAST_STAT, LEAST_SUPPRESS, STEP_UP = 30, 40, 15, 0.04
KEYS = ("sport", "stat_type", "direction")


# --- settling and gates ----------------------------------------------------------------------------


def settle(picks: DataFrame, games: DataFrame, lines: DataFrame, box: DataFrame, as_of: Column, stale_days: int = 2) -> DataFrame:
    """outcome of each open pick, by the first rule that fits.

    picks: pick_id, game_id, player_id, line_id, stat_type, direction; games: game_id, status, game_date; lines: line_id,
    line_value; box: game_id, player_id, did_play, stats (map), batters_faced (null unless a pitcher).
    """
    boxed = box.select("game_id").distinct().withColumn("_has_box", F.lit(True))
    rows = (
        picks.join(games.select("game_id", "status", "game_date"), "game_id", "left")
        .join(lines.select("line_id", "line_value"), "line_id", "left")
        .join(box.select("game_id", "player_id", F.lit(True).alias("_row"), "did_play", "stats", "batters_faced"), ["game_id", "player_id"], "left")
        .join(boxed, "game_id", "left")
    )
    stale = F.coalesce(F.datediff(as_of, "game_date") > stale_days, F.lit(False))
    actual = F.try_element_at("stats", "stat_type")
    outcome = (
        F.when(F.col("status").isNull(), "wait")
        .when(F.col("status") == "postponed", "void")
        .when((F.col("status") != "final") & stale, "void")
        .when(F.col("status") != "final", "wait")
        .when(F.col("line_value").isNull(), "void")
        .when(F.col("_row").isNull() & F.col("_has_box").isNotNull(), "void")
        .when(F.col("_row").isNull() & stale, "void")
        .when(F.col("_row").isNull(), "wait")
        .when(F.col("did_play") == F.lit(False), "void")
        .when(F.col("batters_faced") == 0, "void")
        .when(actual.isNull(), "missing")
        .otherwise(grade(actual, F.col("line_value"), F.col("direction")))
    )
    return rows.select("pick_id", outcome.alias("outcome"), actual.alias("actual_value"))


def valid(picks: DataFrame) -> DataFrame:
    """Settled picks that count: won or lost, with a probability, made before the start, on a real line, by one who played (unknown counts as played)."""
    return picks.where(F.col("leg_result").isin("win", "loss") & F.col("model_prob").isNotNull() & (F.col("picked_at") <= F.col("game_start")) & F.col("line_value").isNotNull() & F.coalesce(F.col("did_play"), F.lit(True)))


# --- cutoffs ---------------------------------------------------------------------------------------


def step(grid: Sequence[float]) -> Column:
    """The number of the highest step of the grid that the probability reaches; 0: none."""
    return sum((F.when(F.round("model_prob", 4) >= g, 1).otherwise(0) for g in grid), F.lit(0))


def cells(picks: DataFrame, *more: str) -> DataFrame:
    """n, wins and the last decision day of the picks by sport, stat, direction, more columns and grid step `g`."""
    return picks.groupBy(*KEYS, *more, step(GRID).alias("g")).agg(F.count("*").alias("n"), F.sum("win").alias("wins"), F.max("decided").alias("last"))


def levels(cells: DataFrame, *more: str) -> DataFrame:
    """Each cell once for each of the three levels: sport; sport and stat; sport, stat and direction."""
    none = F.lit(None).cast("string")
    level = [F.struct(F.lit(1).alias("level"), F.col("sport"), none.alias("stat_type"), none.alias("direction")), F.struct(F.lit(2).alias("level"), F.col("sport"), F.col("stat_type"), none.alias("direction"))]
    third = F.when(F.col("direction").isin("over", "under"), F.struct(F.lit(3).alias("level"), F.col("sport"), F.col("stat_type"), F.col("direction")))
    return cells.select(*more, "n", "wins", "g", F.explode(F.array_compact(F.array(*level, third))).alias("k")).select(*more, "n", "wins", "g", "k.*")


def grid_counts(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n and wins at or above each grid step, and of all (step 0), from counts by step: one aggregation, no window."""
    at = [F.struct(F.lit(i).alias("step"), F.sum(F.when(F.col("g") >= i, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(F.col("g") >= i, F.col("wins")).otherwise(0)).alias("wins")) for i in range(len(GRID) + 1)]
    return cells.groupBy(*keys).agg(F.array(*at).alias("_grid"))


def choose(grid: DataFrame, gaps: bool = False) -> DataFrame:
    """cutoff and status from the `_grid` of each key and its level; keys without an entry drop out, or have a null cutoff with `gaps`."""
    least = F.when(F.col("level") == 1, LEAST_SPORT).otherwise(LEAST_STAT)
    bound = F.transform("_grid", lambda c: F.struct(c["step"].alias("step"), c["n"].alias("n"), c["wins"].alias("wins"), wilson(c["wins"], c["n"])[0].alias("lb")))
    every = F.col("_grid")[0]
    good = F.when(every["n"] >= least, F.filter(bound, lambda c: (c["step"] > 0) & (c["n"] >= least) & (c["lb"] >= BREAKEVEN))).otherwise(F.filter(bound, lambda c: F.lit(False)))
    out = grid.withColumn("_good", good).withColumn("_all", every)
    best = F.array_max(F.transform("_good", lambda c: c["lb"]))
    first = F.try_element_at(F.filter("_good", lambda c: (F.col("level") == 1) | (c["lb"] >= best - STEP_UP)), F.lit(1))
    out = out.withColumn("_first", first)
    upper = wilson(F.col("_all")["wins"], F.col("_all")["n"])[1]
    value = F.try_element_at(F.array(*map(F.lit, GRID)), F.col("_first")["step"])
    sport = F.when(F.col("_all")["n"] >= LEAST_SPORT, SUPPRESS).otherwise(DEFAULT)
    other = F.when((F.col("_all")["n"] >= LEAST_SUPPRESS) & (upper < BREAKEVEN), SUPPRESS)
    cutoff = F.coalesce(value, F.when(F.col("level") == 1, sport).otherwise(other))
    status = F.when(value.isNotNull(), "tuned").when(cutoff == SUPPRESS, "suppressed").otherwise("unproven")
    n = F.coalesce(F.col("_first")["n"], F.col("_all")["n"])
    out = out.withColumns({"cutoff": cutoff, "status": status, "n": n}).drop("_grid", "_good", "_all", "_first")
    return out if gaps else out.where("cutoff is not null")


def cutoffs(picks: DataFrame) -> DataFrame:
    """level, sport, stat_type, direction, cutoff, status, n: the table that all picks give."""
    return choose(grid_counts(levels(cells(picks)), ["level", *KEYS]))


def with_cutoff(picks: DataFrame, table: DataFrame, *on: str, direction: bool = True) -> DataFrame:
    """Each pick's cutoff: of its direction (if asked), else its stat, else its sport, else the default.

    A sport's entries, a few for each stat, become one row with a map, so the picks are joined once.
    """
    name = F.concat_ws("\x1f", "stat_type", "direction")
    entry = F.when(F.col("stat_type").isNotNull() & (F.col("level") > 1), F.struct(name.alias("key"), F.col("cutoff").alias("value")))
    one = table.groupBy(*on, "sport").agg(F.max(F.when(F.col("level") == 1, F.col("cutoff"))).alias("_c1"), F.map_from_entries(F.collect_list(entry)).alias("_more"))
    out = picks.join(one, [*on, "sport"], "left")
    both = F.when(F.col("direction").isNotNull(), name)
    found = [F.try_element_at("_more", both)] if direction else []
    return out.withColumn("cutoff", F.coalesce(*found, F.try_element_at("_more", F.col("stat_type")), "_c1", F.lit(DEFAULT))).drop("_c1", "_more")


def dated_cutoffs(picks: DataFrame, least_train: int = LEAST_SPORT) -> DataFrame:
    """The cutoff tables that each decision day may know: from picks settled strictly before it.

    Picks become counts by (key, step, settle day), which are small and saved. A window over the days cumulates them; each
    decision day takes the last settle day before it, so no day fits on all history anew.
    """
    daily = saved(cells(picks, "settled"))
    settled = daily.where("settled is not null")
    by_day = grid_counts(levels(settled, "settled"), ["level", *KEYS, "settled"])
    w = W.partitionBy("level", *KEYS).orderBy("settled").rowsBetween(W.unboundedPreceding, 0)
    flat = by_day.select("level", *KEYS, "settled", *[x for i in range(len(GRID) + 1) for x in (F.sum(F.col("_grid")[i]["n"]).over(w).alias(f"n{i}"), F.sum(F.col("_grid")[i]["wins"]).over(w).alias(f"w{i}"))])
    grid = F.array(*[F.struct(F.lit(i).alias("step"), F.col(f"n{i}").alias("n"), F.col(f"w{i}").alias("wins")) for i in range(len(GRID) + 1)])
    tables = choose(flat.select("level", *KEYS, "settled", grid.alias("_grid")), gaps=True)  # a gap ends an earlier entry
    # a table holds from the day after it settled to the next settle day of its key; each such day is a row
    until = F.lead("settled").over(W.partitionBy("level", *KEYS).orderBy("settled"))
    total = settled.groupBy("settled").agg(F.sum("n").alias("n"))  # a row for each day
    total = total.withColumn("_total", F.sum("n").over(W.orderBy("settled").rowsBetween(W.unboundedPreceding, 0)))
    start = total.where(F.col("_total") >= least_train).agg(F.min("settled").alias("_start"))
    edges = start.join(F.broadcast(daily.agg(F.max("last").alias("_last"))))  # one row
    tables = tables.withColumn("_until", until).join(F.broadcast(edges)).withColumn("_until", F.least(F.coalesce("_until", "_last"), "_last"))
    held = F.explode(F.sequence(F.date_add("settled", 1), "_until"))
    tables = tables.where("cutoff is not null and _until > settled").select("level", *KEYS, "cutoff", "_start", held.alias("decided"))
    return tables.where(F.col("decided") > F.col("_start")).select("decided", "level", *KEYS, "cutoff")


def walk_forward(picks: DataFrame, least_train: int = LEAST_SPORT) -> DataFrame:
    """The picks that were recommended, each with the cutoff it faced on its decision day."""
    return with_cutoff(picks, dated_cutoffs(picks, least_train), "decided").where(F.col("model_prob") >= F.col("cutoff"))


def in_sample(picks: DataFrame) -> DataFrame:
    """The same with one table fitted on all outcomes: what hindsight would have recommended."""
    return with_cutoff(picks, cutoffs(picks)).where(F.col("model_prob") >= F.col("cutoff"))


def proven(recommended: DataFrame, keys: Sequence[str], least: int = 30) -> DataFrame:
    """Segments whose lower Wilson bound out of sample reaches break-even."""
    return aggs.segment(recommended, keys, least=least).where((F.col("n") >= least) & (F.col("low") >= BREAKEVEN)).select(*keys)


def gated_kelly(picks: DataFrame, segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Half-Kelly stakes in proven segments, zero elsewhere."""
    marked = picks.join(segments.withColumn("_ok", F.lit(True)), list(keys), "left")
    return marked.withColumn("stake", F.when(F.col("_ok").isNotNull(), half_kelly(F.col("model_prob"))).otherwise(0.0)).drop("_ok")


def daily_backtest(recommended: DataFrame, last: Column, days: int = 60) -> DataFrame:
    """Per sport: won, lost and ROI of the trailing window, and the last 7 days against the 7 before."""
    age = F.datediff(last, "decided")
    rows = recommended.where((age >= 0) & (age < days)).withColumn("_age", age).withColumn("_p", F.col("win").cast("double"))
    return rows.groupBy("sport").agg(
        F.count("*").alias("n"), F.sum("win").cast("bigint").alias("wins"), roi_two_legs(F.avg("_p")).alias("roi"), F.avg(F.when(F.col("_age") < 7, F.col("_p"))).alias("hit_7"), F.avg(F.when((F.col("_age") >= 7) & (F.col("_age") < 14), F.col("_p"))).alias("hit_prior_7")
    ).withColumn("trend", F.col("hit_7") - F.col("hit_prior_7"))


def cutoff_sweep(picks: DataFrame, table: DataFrame, least: int = 15) -> DataFrame:
    """Each sport and stat's live cutoff beside the sweep's best one by ROI at the lower Wilson bound (ties to the lower cutoff).

    Material: the best slice is proven (its bound reaches break-even), and nothing is live or the live cutoff is more than
    0.05 off with a hit rate more than 0.07 apart.
    """
    keys = list(KEYS[:2])
    counted = picks.groupBy(*keys, F.round("model_prob", 4).alias("model_prob")).agg(F.count("*").alias("n"), F.sum("win").alias("wins"))
    counted = with_cutoff(counted.withColumn("direction", F.lit(None).cast("string")), table, direction=False)
    above = lambda limit, c: F.coalesce(F.sum(F.when(F.col("model_prob") >= limit, F.col(c))), F.lit(0))
    points = F.array(*[F.struct(F.lit(g).alias("cutoff"), above(F.lit(g), "n").alias("n"), above(F.lit(g), "wins").alias("wins")) for g in SWEEP])
    live = [above(F.col("cutoff"), c).alias(f"live_{c}") for c in ("n", "wins")]
    grid = counted.groupBy(*keys).agg(F.max("cutoff").alias("live_cutoff"), *live, points.alias("_grid"))
    bound = F.transform(F.filter("_grid", lambda c: c["n"] >= least), lambda c: F.struct(wilson(c["wins"], c["n"])[0].alias("lb"), (-c["cutoff"]).alias("low"), c["n"].alias("n"), (c["wins"] / c["n"]).alias("hit")))
    out = grid.withColumn("_b", F.array_max(bound)).where("_b is not null")
    out = out.withColumns({"best_cutoff": -F.col("_b.low"), "n": F.col("_b.n"), "best_hit": F.col("_b.hit"), "best_roi": roi_two_legs(F.col("_b.lb")), "live_hit": F.when(F.col("live_n") > 0, F.col("live_wins") / F.col("live_n"))})
    far = (F.abs(F.col("best_cutoff") - F.col("live_cutoff")) > 0.05 + 1e-9) & (F.abs(F.col("live_hit") - F.col("best_hit")) > 0.07)
    material = (F.col("_b.lb") >= BREAKEVEN) & ((F.col("live_n") == 0) | F.coalesce(far, F.lit(False)))
    return out.select(*keys, "live_cutoff", "live_n", "live_hit", "best_cutoff", "n", "best_hit", "best_roi", material.alias("material"))


# --- calibration and blending ----------------------------------------------------------------------


def blend_weights(picks: DataFrame, keys: Sequence[str], least: int = 40, steps: int = 20) -> DataFrame:
    """The weight on the model with the least Brier score; that is quadratic in the weight, so three sums give all 21 points."""
    a, b = F.col("model_prob") - F.col("market_prob"), F.col("market_prob") - F.col("win")
    sums = picks.where("market_prob is not null").groupBy(*keys).agg(F.count("*").alias("n"), F.sum(a * a).alias("_aa"), F.sum(a * b).alias("_ab"), F.sum(b * b).alias("_bb"))
    points = F.array(*[F.lit(i / steps) for i in range(steps + 1)])
    score = F.transform(points, lambda w: F.struct(F.round((w * w * F.col("_aa") + 2 * w * F.col("_ab") + F.col("_bb")) / F.col("n"), 9).alias("brier"), w.alias("weight")))
    out = sums.withColumn("_best", F.array_min(score))
    return out.select(*keys, "n", F.when(F.col("n") >= least, F.col("_best.weight")).otherwise(1.0).alias("weight"), F.when(F.col("n") >= least, F.col("_best.brier")).alias("brier"))


#: Fixed value: the pull of a Platt fit to the identity, so slight that it only keeps separable cells finite.
RIDGE = 1e-6


def platt_fit(p: np.ndarray, wins: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept of the logistic map of logit(p), by Newton steps over grouped counts, with a slight pull to the identity."""
    q = np.clip(p, 1e-6, 1 - 1e-6)
    x = np.c_[np.log(q / (1 - q)), np.ones(len(q))]
    beta, prior = np.array([1.0, 0.0]), np.array([1.0, 0.0])
    for _ in range(rounds):
        mu = 1 / (1 + np.exp(-x @ beta))
        gradient = x.T @ (wins - n * mu) - RIDGE * (beta - prior)
        step = np.linalg.solve((x * (n * mu * (1 - mu))[:, None]).T @ x + RIDGE * np.eye(2), gradient)
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            break
    return float(beta[0]), float(beta[1])


def platt_cells(picks: DataFrame, keys: Sequence[str], least: int = 40) -> DataFrame:
    """slope, intercept, n, fitted of each cell. Picks are counted by probability first, so a cell is a few thousand rows at most."""
    cells = picks.withColumn("_p", F.round("model_prob", 4)).groupBy(*keys, "_p").agg(F.count("*").alias("_n"), F.sum("win").alias("_w"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_p")
        n, w = pdf["_n"].to_numpy(float), pdf["_w"].to_numpy(float)
        slope, intercept, ok = 1.0, 0.0, False
        if n.sum() >= least and 0 < w.sum() < n.sum():
            a, b = platt_fit(pdf["_p"].to_numpy(float), w, n)
            if np.isfinite(a) and a > 0:
                slope, intercept, ok = a, b, True
        return pd.DataFrame([[*[pdf[k].iloc[0] for k in keys], slope, intercept, int(n.sum()), ok]], columns=[*keys, "slope", "intercept", "n", "fitted"])

    kinds = ", ".join(f"`{k}` {picks.schema[k].dataType.simpleString()}" for k in keys)
    return cells.groupBy(*keys).applyInPandas(run, f"{kinds}, slope double, intercept double, n bigint, fitted boolean")


def platt_global(picks: DataFrame, least: int = 100) -> DataFrame:
    return platt_cells(picks.withColumn("scope", F.lit("all")), ["scope"], least)


def final_probability(picks: DataFrame, cells: DataFrame, weights: DataFrame, cell_keys: Sequence[str], weight_keys: Sequence[str]) -> DataFrame:
    """final_prob, edge and stake: calibrated by cell, blended with the market, rounded to 4 places. Both tables hold a row a segment."""
    rows = picks.join(cells.select(*cell_keys, "slope", "intercept", "fitted"), list(cell_keys), "left").join(weights.select(*weight_keys, F.col("weight").alias("_w")), list(weight_keys), "left")
    calibrated = platt(F.col("model_prob"), F.col("slope"), F.col("intercept"), F.coalesce("fitted", F.lit(False)))
    p = F.round(blend(calibrated, F.col("market_prob"), F.col("_w")), 4)
    return rows.withColumn("final_prob", p).withColumn("edge", F.round(F.col("final_prob") - F.coalesce("market_prob", F.lit(0.5)), 4)).withColumn("stake", half_kelly(F.col("final_prob"))).drop("slope", "intercept", "fitted", "_w")


def recommended_flag(p: Column, cutoff: Column, odds: Column) -> Column:
    """With odds: a positive expected value; at flat payouts: the cutoff."""
    return F.when(odds.isNotNull(), pick_ev(p, american_decimal(odds)) > 0).otherwise(p >= cutoff)


# --- suppression, availability ---------------------------------------------------------------------

#: The order of the reasons and their limits.
REASONS = ("low_edge", "out", "stale_game", "line_band", "too_sure", "availability", "duplicate")


def suppression(rows: DataFrame, logged: DataFrame, keys: Sequence[str], *, least_edge: float = 0.05, most_prob: float = 0.97) -> DataFrame:
    """reason of each row, the first that fits, null for those that stay.

    rows: edge, is_out, game_date, run_date, line_ok, model_prob, projected_minutes and the keys (player, stat, direction, line, day).
    """
    seen = logged.select(*keys).distinct().withColumn("_seen", F.lit(True))
    tests = (F.col("edge") < least_edge, F.col("is_out"), F.col("game_date") < F.col("run_date"), ~F.col("line_ok"), F.col("model_prob") > most_prob, F.col("projected_minutes") < 12, F.col("_seen"))
    reason = None
    for name, test in zip(REASONS, tests, strict=True):
        reason = F.when(test, name) if reason is None else reason.when(test, name)
    return rows.join(seen, list(keys), "left").withColumn("reason", reason).drop("_seen")


def injury_expansion(played: DataFrame, out: DataFrame, as_of: Column, *, team: str, player: str, day: str, minutes: str, days: int = 14, games: int = 3, floor: float = 5.0, lost: float = 15.0) -> DataFrame:
    """Healthy rotation players of teams whose absent players leave `lost` minutes or more; minutes_lost beside each."""
    age = F.datediff(as_of, day)
    roster = played.where((age > 0) & (age <= days) & (F.col(minutes) >= floor)).groupBy(team, player).agg(F.count("*").alias("_n"), F.avg(minutes).alias("mean_minutes")).where(F.col("_n") >= games)
    marked = roster.join(out.select(player).distinct().withColumn("_out", F.lit(True)), player, "left")
    gone = marked.groupBy(team).agg(F.sum(F.when(F.col("_out"), F.col("mean_minutes")).otherwise(0.0)).alias("minutes_lost"))
    return marked.where("_out is null").join(gone.where(F.col("minutes_lost") >= lost), team).select(team, player, "mean_minutes", "minutes_lost")


def combo_edges(means: DataFrame, combos: dict[str, Sequence[str]], keys: Sequence[str], stat: str, mean: str) -> DataFrame:
    """Means of combined stats where all their parts have one."""
    pairs = [(c, p, len(set(ps))) for c, ps in combos.items() for p in dict.fromkeys(ps)]
    part = F.explode(F.filter(F.array(*[F.struct(F.lit(c).alias("combo"), F.lit(p).alias("part"), F.lit(n).alias("need")) for c, p, n in pairs]), lambda x: x["part"] == F.col(stat)))
    rows = means.select(*keys, F.col(mean).alias("_m"), part.alias("x"))
    return rows.groupBy(*keys, F.col("x.combo").alias("combo")).agg(F.count("*").alias("_have"), F.first("x.need").alias("_need"), F.sum("_m").alias("combo_mean")).where("_have = _need").drop("_have", "_need")


# --- reports ---------------------------------------------------------------------------------------


def market_edge(rows: DataFrame, quotes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """edge = model probability less the side-adjusted market probability at the very line; less 0.5 without one."""
    market = quotes.groupBy(*keys).agg(F.avg("over_prob").alias("_m"))
    out = rows.join(market, list(keys), "left")
    side = F.when(F.col("direction") == "under", 1 - F.col("_m")).otherwise(F.col("_m"))
    return out.withColumn("edge", F.round(F.col("model_prob") - F.coalesce(side, F.lit(0.5)), 4)).drop("_m")


def forensics(picks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """By segment: picks, the largest burst of picks in one second, months, shares logged after the start and without a line."""
    second = picks.groupBy(*keys, F.date_trunc("second", "picked_at").alias("_s")).agg(F.count("*").alias("_n"), F.count_if(F.col("picked_at") > F.col("game_start")).alias("_late"), F.count_if(F.col("line_value").isNull()).alias("_bare"), F.min(F.date_format("picked_at", "yyyy-MM")).alias("_month"))
    return second.groupBy(*keys).agg(F.sum("_n").alias("n"), F.max("_n").alias("top_burst"), F.count_distinct("_month").alias("months"), (F.sum("_late") / F.sum("_n")).alias("late_share"), (F.sum("_bare") / F.sum("_n")).alias("bare_share"))


#: Rates of a hot and of a cold segment.
HOT, COLD = 0.66, 0.45


def hot_and_cold(picks: DataFrame, keys: Sequence[str], last: Column, days: int = 21, least: int = 12) -> DataFrame:
    """Segments of the last days with `least` picks or more: hit rate, and whether hot (>= 66 %) or cold (<= 45 %)."""
    age = F.datediff(last, "decided")
    out = picks.where((age >= 0) & (age < days)).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.col("win").cast("double")).alias("hit")).where(F.col("n") >= least)
    return out.withColumn("label", F.when(F.col("hit") >= HOT, "hot").when(F.col("hit") <= COLD, "cold").otherwise("even"))


def top_of_day(picks: DataFrame, day: str, n: int = 5) -> DataFrame:
    """n, wins of each day's most likely picks."""
    top = top_per_key(picks, [day], [F.desc("model_prob"), F.asc("pick_id")], n)
    return top.groupBy(day).agg(F.count("*").alias("n"), F.sum("win").cast("bigint").alias("wins"))
