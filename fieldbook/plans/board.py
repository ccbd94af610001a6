"""The board job: upcoming vectors, model prices, combined stats, calibration and blending as one plan, merged into the stored board."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.functions.counts import binary_over, poisson_over
from fieldbook.functions.scalars import blend, half_kelly, platt, side_adjusted
from fieldbook.operators import windows as win
from fieldbook.operators.joins import fresh_board, small
from fieldbook.plans.ledger import combo_edges
from fieldbook.session import written
from fieldbook.sources.store import upsert_partitions
from fieldbook.sources.tables import dedup

#: Fixed value: the least line that a stat is priced at; below it the model tells nothing.
LEAST_LINE = {"hits": 1.5}
#: What makes a row of the stored board.
KEYS = ("game_date", "game_id", "player_id", "stat_type", "line_value")


def interpolated(p: Column, xs: Column, ys: Column) -> Column:
    """The map through the points (xs, ys), xs rising: straight between them, flat outside; p itself without points."""
    n, i = F.size(xs), F.size(F.filter(xs, lambda x: x <= p))
    at = lambda v, k: F.try_element_at(v, k)
    step = F.coalesce(F.try_divide((p - at(xs, i)) * (at(ys, i + 1) - at(ys, i)), at(xs, i + 1) - at(xs, i)), F.lit(0.0))
    inside = F.when(i == 0, at(ys, F.lit(1))).when(i >= n, at(ys, n)).otherwise(at(ys, F.greatest(i, F.lit(1))) + step)
    return F.when(xs.isNull() | (n == 0), p).otherwise(inside)


def prices(rows: DataFrame, calibrators: DataFrame | None = None, least_line: Mapping[str, float] = LEAST_LINE) -> DataFrame:
    """p_over, direction, model_prob and edge of rows with stat_type, line_value, mean and is_binary.

    A binary model's mean is the probability of one or more. calibrators: stat_type, xs, ys (the points of a map of
    probabilities, one row a stat, so they are sent to every task); stats without one stay as they are. Even
    prices go under. Lines below the stat's least one drop out.
    """
    p = F.when(F.col("is_binary"), binary_over(F.col("line_value"), F.col("mean"))).otherwise(poisson_over(F.col("line_value"), F.col("mean")))
    for stat, least in least_line.items():
        rows = rows.where((F.col("stat_type") != stat) | (F.col("line_value") >= least))
    out = rows.withColumn("p_over", p)
    if calibrators is not None:
        out = out.join(F.broadcast(calibrators.select("stat_type", F.col("xs").alias("_xs"), F.col("ys").alias("_ys"))), "stat_type", "left")
        out = out.withColumn("p_over", interpolated(F.col("p_over"), F.col("_xs"), F.col("_ys"))).drop("_xs", "_ys")
    over = F.col("p_over") > 0.5
    return out.withColumns({"direction": F.when(over, "over").otherwise("under"), "model_prob": F.when(over, F.col("p_over")).otherwise(1 - F.col("p_over"))}).withColumn("edge", F.col("model_prob") - 0.5)


def finalized(edges: DataFrame, market: DataFrame, cells: DataFrame, weights: DataFrame, display: tuple[float, float] = (1.0, 0.0)) -> DataFrame:
    """model_prob calibrated by (sport, stat, direction), blended with the market's price of the side, rounded to 4 places; edge and half-Kelly ev.

    market: player_id, stat_type, line_value, over_prob; cells: the keys, slope, intercept, fitted; weights: sport, weight. display
    is the global map (slope, intercept) that sizes the stake.
    """
    rows = edges.join(market.select("player_id", "stat_type", "line_value", F.col("over_prob").alias("_m")), ["player_id", "stat_type", "line_value"], "left")
    rows = rows.join(cells.select("sport", "stat_type", "direction", "slope", "intercept", "fitted"), ["sport", "stat_type", "direction"], "left").join(weights.select("sport", F.col("weight").alias("_w")), "sport", "left")
    own = platt(F.col("model_prob"), F.col("slope"), F.col("intercept"), F.coalesce("fitted", F.lit(False)))
    p = F.round(blend(own, side_adjusted(F.col("_m"), F.col("direction")), F.coalesce("_w", F.lit(1.0))), 4)
    rows = rows.withColumn("model_prob", p).drop("_m", "_w", "slope", "intercept", "fitted")
    shown = platt(F.col("model_prob"), F.lit(display[0]), F.lit(display[1]), F.lit(True))
    return rows.withColumns({"edge": F.round(F.col("model_prob") - 0.5, 4), "ev": F.round(half_kelly(shown), 4)})


@dataclass(frozen=True)
class Models:
    """What prices a board: feature windows, the models' mean as a column of the features, which stats are binary, how stats combine, and the fitted tables."""

    mean: Column
    binary: Sequence[str]
    combos: Mapping[str, Sequence[str]]
    calibrators: DataFrame | None
    cells: DataFrame
    weights: DataFrame
    display: tuple[float, float] = (1.0, 0.0)
    sizes: Sequence[int] = (5,)
    least_line: Mapping[str, float] = field(default_factory=lambda: LEAST_LINE)


def vectors(history: DataFrame, ahead: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """Features of the coming games: history (player_id, stat_type, row_id, game_date, season, value) and the games ahead go through the same windows."""
    entity, order = ["player_id", "stat_type"], ["game_date", "row_id"]
    rows = win.upcoming(history, ahead)
    rows = win.prior_means(rows, entity, order, ["value"], sizes)
    return win.season_means(rows, entity, "season", order, ["value"]).where("is_upcoming")


def board(history: DataFrame, ahead: DataFrame, lines: DataFrame, market: DataFrame, models: Models, hours: int = 2) -> DataFrame:
    """All lines of the coming games with a price: KEYS, sport, direction, model_prob, edge, ev.

    Lines are those within `hours` of their stat's newest snapshot; their games are placeholders, so they meet the vectors by player
    and stat. A stat that a model prices itself goes before the same one summed from its parts.
    """
    own = vectors(history, ahead, models.sizes).withColumn("mean", models.mean).select("sport", "player_id", "game_id", "game_date", "stat_type", "mean", F.col("stat_type").isin(*models.binary).alias("is_binary"), F.lit(0).alias("_rank"))
    own = written(own)  # a row for each coming game and stat, priced as it is and summed into combined stats
    parts = combo_edges(own.where(~F.col("is_binary")), models.combos, ["sport", "player_id", "game_id", "game_date"], "stat_type", "mean")
    summed = parts.select("sport", "player_id", "game_id", "game_date", F.col("combo").alias("stat_type"), F.col("combo_mean").alias("mean"), F.lit(False).alias("is_binary"), F.lit(1).alias("_rank"))
    offered = fresh_board(lines.select("player_id", "stat_type", "line_value", "snapshot_at"), ["stat_type"], ["player_id", "line_value"], "snapshot_at", hours)
    rows = prices(own.unionByName(summed).join(offered, ["player_id", "stat_type"]), models.calibrators, models.least_line)
    rows = dedup(rows, list(KEYS), [F.asc("_rank"), F.desc("model_prob")])
    return finalized(rows, market, models.cells, models.weights, models.display).select(*KEYS, "sport", "direction", "model_prob", "edge", "ev")


def update_board(scored: DataFrame, path: str, run: Column) -> DataFrame:
    """Merges a run's rows into the stored board, partitioned by game date; `run` orders the runs. Gives the dates that were replaced."""
    return upsert_partitions(scored.where("game_id is not null").withColumn("updated_at", run), path, KEYS, "updated_at", ["game_date"])


# --- rows of the board as people see them ------------------------------------------------------------

#: A wind, in mph along the field, that gets a word; a form that does; an edge; a line's move.
WIND, FORM_GAMES, FORM_RATE, EDGE_SHOWN, MOVE_SHOWN = 5, 3, 0.6, 0.05, 0.05


def weather_note(wind_out: Column, dome: Column) -> Column:
    words = F.when(wind_out >= WIND, F.concat(F.lit("wind out +"), F.bround(wind_out).cast("bigint").cast("string"))).when(wind_out <= -WIND, F.concat(F.lit("wind in "), F.bround(wind_out).cast("bigint").cast("string"))).otherwise("calm")
    return F.when(F.coalesce(dome, F.lit(False)), "dome (neutral)").when(wind_out.isNotNull(), words)


def graded_form(picks: DataFrame, actuals: DataFrame, games: int = 10) -> DataFrame:
    """pick_id, l5, l10: how often the pick's side would have won over the player's last games ("hits/decided"; exact hits of the line don't count).

    actuals: player_id, stat_type, game_date, game_id, actual. Each player's last games become one array first, so a pick meets one row;
    games of players and stats without a pick are left behind before they are shuffled.
    """
    actuals = actuals.join(small(picks.select("player_id", "stat_type").distinct()), ["player_id", "stat_type"], "left_semi")
    ranked = win.top_per_key(actuals, ["player_id", "stat_type"], [F.desc("game_date"), F.desc("game_id")], games, "_r").where("actual is not null")
    last = ranked.groupBy("player_id", "stat_type").agg(F.array_sort(F.collect_list(F.struct("_r", "actual"))).alias("_last"))
    rows = picks.select("pick_id", "player_id", "stat_type", "direction", "line_value").join(last, ["player_id", "stat_type"], "left")
    hit = lambda a: F.when(a == F.col("line_value"), None).when(F.col("direction") == "over", a > F.col("line_value")).otherwise(a < F.col("line_value"))
    form = F.transform(F.coalesce(F.col("_last"), F.array().cast("array<struct<_r:int,actual:double>>")), lambda x: hit(x["actual"]))

    def counted(n: int) -> Column:
        some = F.filter(F.slice(form, 1, n), lambda h: h.isNotNull())
        return F.concat_ws("/", F.size(F.filter(some, lambda h: h)).cast("string"), F.size(some).cast("string"))

    return rows.select("pick_id", counted(5).alias("l5"), counted(10).alias("l10"))


def insight(l5: Column, direction: Column, edge: Column, moved: Column, prob: Column) -> Column:
    """At most three remarks: form, edge over the market, a line that moves our way; the model's confidence if there is none."""
    hits, games = (F.try_element_at(F.split(l5, "/"), F.lit(i)).cast("int") for i in (1, 2))
    ours = ((moved > 0) & (direction == "over")) | ((moved < 0) & (direction == "under"))
    bits = F.array_compact(F.array(
        F.when((games >= FORM_GAMES) & (hits / games >= FORM_RATE), F.concat(F.lit("hit "), F.upper(direction), F.lit(" "), l5, F.lit(" last 5"))),
        F.when(edge >= EDGE_SHOWN, F.concat(F.lit("+"), F.bround(edge * 100).cast("bigint").cast("string"), F.lit("% vs market"))),
        F.when((F.abs(moved) >= MOVE_SHOWN) & ours, F.lit("line moving your way")),
    ))
    return F.when(F.size(bits) > 0, F.concat_ws(" · ", bits)).otherwise(F.concat(F.lit("model "), F.bround(prob * 100).cast("bigint").cast("string"), F.lit("% confident")))


def board_rows(picks: DataFrame, players: DataFrame, teams: DataFrame, games: DataFrame, weather: DataFrame, actuals: DataFrame, day: Column, *, league: str | None = None, stats: Sequence[str] | None = None, direction: str | None = None, display: tuple[float, float] = (1.0, 0.0)) -> DataFrame:
    """A day's picks with team, match-up, projection, edge, weather, form and insight; filters reach the scan of the picks.

    picks: pick_id, player_id, game_id, stat_type, direction, line_value, model_prob, predicted_mean, edge, line_movement, picked_on, leg_result;
    players: player_id, player, team_id; teams: team_id, team; games: game_id, sport, game_date, home_team_id, away_team_id; weather: game_id,
    wind_out, is_dome. Void picks and those without projection or line are left out.
    """
    rows = picks.where((F.col("picked_on") == day) & (F.coalesce(F.col("leg_result"), F.lit("")) != "void") & F.col("predicted_mean").isNotNull() & F.col("line_value").isNotNull())
    rows = rows.where(F.col("stat_type").isin(*stats)) if stats else rows
    rows = rows.where(F.col("direction") == direction) if direction in ("over", "under") else rows
    rows = written(rows)  # a day's picks, which the form reads as well
    own = games.where(F.col("game_date") == day)
    own = own.where(F.col("sport") == league.lower()) if league else own
    name = lambda side: teams.select(F.col("team_id").alias(f"{side}_team_id"), F.col("team").alias(f"{side}_team"))
    rows = rows.join(own.drop("game_date"), "game_id").join(name("home"), "home_team_id", "left").join(name("away"), "away_team_id", "left")
    rows = rows.join(players, "player_id").join(teams, "team_id", "left").join(weather, "game_id", "left").join(graded_form(rows, actuals), "pick_id", "left")
    shown = platt(F.col("model_prob"), F.lit(display[0]), F.lit(display[1]), F.lit(True))
    unknown = F.lit("?")
    return rows.select(
        "pick_id", "sport", "player", F.coalesce("team", F.lit("")).alias("team"), F.concat_ws(" @ ", F.coalesce("away_team", unknown), F.coalesce("home_team", unknown)).alias("matchup"), "stat_type", "direction", "line_value", "predicted_mean",
        F.when(F.col("line_value") != 0, 100 * (F.col("predicted_mean") - F.col("line_value")) / F.col("line_value")).otherwise(0.0).alias("edge_pct"), weather_note(F.col("wind_out"), F.col("is_dome")).alias("weather"), "l5", "l10",
        insight(F.col("l5"), F.col("direction"), F.col("edge"), F.col("line_movement"), shown).alias("insight"),
    )
