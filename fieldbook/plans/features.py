"""Feature tables by sport: configurations of the window and join operators.

All windows of a table run over one partitioning by player; season frames sort within it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.functions.scalars import clip, ratio
from fieldbook.operators import windows as win
from fieldbook.operators.aggs import share_of_total
from fieldbook.operators.joins import absence_rows, attach_opponent, both_sides


@dataclass(frozen=True)
class Sport:
    """Windows, stats, threshold limits and combined stats of a sport's player features."""

    stats: Sequence[str]
    sizes: Sequence[int] = (5, 10, 20)
    limits: Mapping[str, Sequence[float]] = field(default_factory=dict)
    combos: Mapping[str, Sequence[str]] = field(default_factory=dict)


# The stats, windows, limits and combined stats of each sport.
BATTING = ("hits", "total_bases", "rbis", "runs", "home_runs", "strikeouts", "walks", "at_bats", "bat_order_spot")
PITCHING = ("strikeouts_pitcher", "outs_recorded", "earned_runs", "walks_allowed", "hits_allowed", "batters_faced")
BASKETBALL = ("points", "rebounds", "assists", "threes_made", "threes_attempted", "steals", "blocks", "turnovers", "fg_made", "fg_attempted", "ft_made", "ft_attempted", "off_rebounds", "def_rebounds", "personal_fouls", "minutes")
BASKETBALL_COMBOS = {"pts_rebs_asts": ("points", "rebounds", "assists"), "pts_rebs": ("points", "rebounds"), "pts_asts": ("points", "assists"), "rebs_asts": ("rebounds", "assists"), "blocks_steals": ("blocks", "steals")}
SKATER = ("goals", "assists", "points", "shots", "hits", "blocked_shots", "powerplay_goals", "powerplay_points", "penalty_minutes", "minutes")
GOALIE = ("saves", "goals_against", "shots_against")
FOOTBALL = ("passing_yards", "passing_tds", "completions", "pass_attempts", "interceptions", "rushing_yards", "rushing_tds", "carries", "receiving_yards", "receiving_tds", "receptions", "targets")
SOCCER = ("shots", "shots_on_target", "fouls", "fouls_drawn", "saves", "goals", "assists", "yellow_cards")
MLB_LIMITS = {"hits": (0.5, 1.5, 2.5), "total_bases": (1.5, 2.5, 3.5), "rbis": (0.5, 1.5), "home_runs": (0.5,), "strikeouts_pitcher": (4.5, 5.5, 6.5, 7.5)}
NBA_LIMITS = {
    "points": (9.5, 14.5, 19.5, 24.5, 29.5),
    "rebounds": (3.5, 5.5, 7.5, 9.5),
    "assists": (2.5, 4.5, 6.5, 8.5),
    "threes_made": (0.5, 1.5, 2.5, 3.5),
    "pts_rebs_asts": (19.5, 29.5, 39.5),
    "pts_rebs": (14.5, 19.5, 24.5),
    "pts_asts": (14.5, 19.5, 24.5),
    "rebs_asts": (7.5, 9.5, 11.5),
}
SHORTER_LIMITS = {"points": (9.5, 14.5, 19.5, 24.5), "rebounds": (3.5, 5.5, 7.5), "assists": (2.5, 4.5, 6.5), "threes_made": (0.5, 1.5, 2.5)}
NHL_LIMITS = {"points": (0.5, 1.5, 2.5), "goals": (0.5, 1.5), "assists": (0.5, 1.5, 2.5), "shots": (2.5, 3.5, 4.5), "hits": (1.5, 2.5, 3.5), "blocked_shots": (0.5, 1.5, 2.5), "saves": (19.5, 24.5, 29.5)}
SPORTS = {
    "mlb": Sport((*BATTING, *PITCHING), (5, 10, 20), MLB_LIMITS),
    "nba": Sport(BASKETBALL, (5, 10, 20), NBA_LIMITS, BASKETBALL_COMBOS),
    "wnba": Sport(BASKETBALL, (5, 10, 20), SHORTER_LIMITS, BASKETBALL_COMBOS),
    "cbb": Sport(BASKETBALL, (5, 10, 20), SHORTER_LIMITS, BASKETBALL_COMBOS),
    "nhl": Sport((*SKATER, *GOALIE), (5, 10, 20), NHL_LIMITS),
    "nfl": Sport(FOOTBALL, (3, 5, 8)),
    "cfb": Sport(FOOTBALL, (3, 5, 8)),
    "soccer": Sport(SOCCER, (3, 5)),
}


def player_features(rows: DataFrame, sport: Sport, *, player: str = "player_id", season: str = "season", date: str = "game_date", row_id: str = "player_game_id") -> DataFrame:
    """Rolling means, season means, threshold rates, rest and games played, from prior rows only."""
    order = [date, row_id]
    rows = rows.withColumns({c: sum((F.col(p) for p in parts[1:]), F.col(parts[0])) for c, parts in sport.combos.items()})
    stats = [*sport.stats, *sport.combos]
    out = win.prior_means(rows, [player], order, stats, sport.sizes)
    if sport.limits:
        out = win.threshold_rates(out, [player], order, sport.limits)
    out = win.days_since(out, [player], order, date)
    out = win.season_means(out, [player], season, order, stats)
    return win.prior_count(out, [player, season], order, "games_played_season")


def team_totals(rows: DataFrame, stats: Sequence[str], game: str = "game_id", team: str = "team_id", date: str = "game_date") -> DataFrame:
    return rows.groupBy(game, team).agg(F.min(date).alias(date), *[F.sum(s).alias(s) for s in stats])


def pace(team_games: DataFrame, points: str, sizes: Sequence[int] = (5, 10), game: str = "game_id", team: str = "team_id", date: str = "game_date") -> DataFrame:
    """Prior means of the game's total and of the own points; with several opponents the one with the smallest id counts."""
    rows = both_sides(team_games.select(game, team, date, points), game, team, [points])
    rows = rows.groupBy(game, team, date, points).agg(F.min_by(f"opp_{points}", f"opp_{team}").alias("_opp")).withColumn("game_total", F.col(points) + F.col("_opp")).drop("_opp")
    return win.prior_means(rows, [team], [date, game], ["game_total", points], sizes)


def allowed(rows: DataFrame, stats: Sequence[str], sizes: Sequence[int] = (5, 10), game: str = "game_id", opponent: str = "opponent_id", date: str = "game_date") -> DataFrame:
    """What each team allowed in its prior games."""
    totals = rows.groupBy(game, F.col(opponent).alias("defense_id")).agg(F.min(date).alias(date), *[F.sum(s).alias(s) for s in stats])
    return win.prior_means(totals, ["defense_id"], [date, game], stats, sizes)


def allowed_to_position(rows: DataFrame, stat: str, group: str, size: int = 10, least: int = 3, game: str = "game_id", opponent: str = "opponent_id", date: str = "game_date") -> DataFrame:
    """Mean that an opponent allowed to a position group in its prior games; 0 with fewer than `least` of them."""
    per = rows.groupBy(game, opponent, group).agg(F.min(date).alias(date), F.avg(stat).alias("_s"))
    w = win.before(win.entity([opponent, group], [date, game]), size)
    value = F.when(F.count(F.lit(1)).over(w) >= least, F.avg("_s").over(w)).otherwise(0.0)
    return per.select(game, opponent, group, value.alias(f"opp_allowed_{stat}"))


def rolled(rows: DataFrame, rates: Mapping[str, Column], sizes: Sequence[int]) -> DataFrame:
    """Each game's rates, and their prior means over the last games and the season, by player."""
    order = ["game_date", "player_game_id"]
    out = win.prior_means(rows.withColumns(dict(rates)), ["player_id"], order, list(rates), sizes)
    return win.season_means(out, ["player_id"], "season", order, list(rates))


def roles(rows: DataFrame, sizes: Sequence[int] = (5, 10, 20)) -> DataFrame:
    """Usage, spacing, foul drawing, points per shot, share of points in the paint, assists to points.

    Needs points, fg_attempted, fg3_attempted, fg3_made, ft_attempted, ft_made, assists, minutes.
    """
    c = F.col
    out = share_of_total(rows, ["game_id", "team_id"], "fg_attempted", "usage_rate")
    paint = F.greatest(c("points") - 3 * c("fg3_made") - c("ft_made"), F.lit(0.0))
    spacing = ratio(c("fg3_attempted"), c("minutes")) * ratio(c("fg3_made"), c("fg3_attempted"))
    return rolled(out, {"usage_rate": c("usage_rate"), "floor_spacing_score": spacing, "foul_drawing_rate": ratio(c("ft_attempted"), c("fg_attempted")), "pts_per_fga": ratio(c("points"), c("fg_attempted")), "paint_scoring_pct": ratio(paint, c("points")), "ast_to_pts_ratio": ratio(c("assists"), c("points"))}, sizes)


def spacing_context(rows: DataFrame, sizes: Sequence[int] = (5, 10)) -> DataFrame:
    """Prior mean spacing of the own and the opposing team; needs `spacing`, game_id, team_id, opponent_id, game_date."""
    team = rows.groupBy("game_id", "team_id").agg(F.min("game_date").alias("game_date"), F.avg("spacing").alias("spacing"))
    team = win.prior_means(team, ["team_id"], ["game_date", "game_id"], ["spacing"], sizes)
    names = [f"last_{n}_avg_spacing" for n in sizes]
    own = rows.join(team.select("game_id", "team_id", *[F.col(n).alias(f"team_{n}") for n in names]), ["game_id", "team_id"], "left")
    return attach_opponent(own, team, "game_id", "opponent_id", "team_id", names)


def close_games(games: DataFrame, margin: int = 5, size: int = 10) -> DataFrame:
    """Share of close games among each team's prior ones; 0.5 without any. games: game_id, game_date, home_team_id, away_team_id, home_score, away_score."""
    sides = games.select("game_id", "game_date", F.explode(F.array("home_team_id", "away_team_id")).alias("team_id"), (F.abs(F.col("home_score") - F.col("away_score")) <= margin).cast("double").alias("close"))
    return win.prior_means(sides, ["team_id"], ["game_date", "game_id"], ["close"], [size], fill=0.5)


def starters(rows: DataFrame, metric: str, game: str = "game_id", team: str = "team_id", row_id: str = "player_game_id", least: float = 0.0) -> DataFrame:
    """The row of each team and game with the highest metric; ties go to the smaller id."""
    rest = [c for c in rows.columns if c not in (game, team)]
    got = rows.where(F.col(metric) >= least).groupBy(game, team).agg(F.max_by(F.struct(*rest), F.struct(F.col(metric), -F.col(row_id))).alias("_r"))
    return got.select(game, team, "_r.*")


def pitcher_rates(rows: DataFrame, sizes: Sequence[int] = (5, 10)) -> DataFrame:
    """k_rate, and hits, walks and earned runs for 27 outs, over sums of prior games; strikeouts and outs for each of the window's slots, filled or not.

    Needs strikeouts, hits_allowed, walks_allowed, earned_runs, outs, batters_faced.
    """
    order = ["game_date", "player_game_id"]
    out = win.prior_ratio(rows, ["player_id"], order, {"k_rate": ("strikeouts", "batters_faced", 1.0), "h_per_9": ("hits_allowed", "outs", 27.0), "bb_per_9": ("walks_allowed", "outs", 27.0), "era": ("earned_runs", "outs", 27.0)}, sizes)
    w = win.entity(["player_id"], order)
    return out.withColumns({f"{name}_{n}": F.coalesce(F.sum(c).over(win.before(w, n)) / n, F.lit(0.0)) for n in sizes for name, c in (("avg_k", "strikeouts"), ("avg_outs", "outs"))})


def lineup_rates(team_games: DataFrame, sizes: Sequence[int] = (10, 20)) -> DataFrame:
    """Team strikeout and walk rates over prior games, and runs and total bases for each slot up to the current game.

    Needs strikeouts, walks, runs, total_bases, plate_appearances.
    """
    order = ["game_date", "game_id"]
    out = win.prior_ratio(team_games, ["team_id"], order, {"k_rate": ("strikeouts", "plate_appearances", 1.0), "walk_rate": ("walks", "plate_appearances", 1.0)}, sizes)
    w = win.entity(["team_id"], order)
    return out.withColumns({f"{name}_{n}": F.coalesce(F.sum(c).over(win.before(w, n)) / F.least(F.row_number().over(w), F.lit(n)), F.lit(0.0)) for n in sizes for name, c in (("avg_runs", "runs"), ("avg_tb", "total_bases"))})


def winner_form(team_games: DataFrame, sizes: Sequence[int] = (5, 10, 20)) -> DataFrame:
    """Scored, allowed, margin and win rate before each game, rest within 1..7; needs team_id, season, game_date, game_id, scored, allowed."""
    rows = team_games.withColumns({"margin": F.col("scored") - F.col("allowed"), "won": (F.col("scored") > F.col("allowed")).cast("double")})
    order = ["game_date", "game_id"]
    out = win.prior_means(rows, ["team_id"], order, ["scored", "allowed", "margin"], sizes)
    out = win.prior_means(out, ["team_id"], order, ["won"], sizes, fill=0.5)
    out = win.season_means(out, ["team_id"], "season", order, ["scored", "allowed", "margin"])
    out = win.days_since(out, ["team_id"], order, "game_date", "rest", first=7)
    return out.withColumn("rest", F.least(F.greatest("rest", F.lit(1)), F.lit(7)))


#: A starter's rates without any prior start.
STARTER_DEFAULTS = {"era": 4.5, "whip": 1.35, "k9": 8.0}


def starter_form(rows: DataFrame, sizes: Sequence[int] = (3, 5, 10), least: int = 2) -> DataFrame:
    """ERA, WHIP and strikeouts for nine innings over prior starts and the career; pitchers with fewer than `least` starts drop out."""
    w = win.entity(["player_id"], ["game_date", "player_game_id"])
    out = {}
    for label, size in [*((f"last_{n}", n) for n in sizes), ("career", None)]:
        frame = win.before(w, size)
        outs = F.sum("outs").over(frame)
        per = lambda c, k, outs=outs, frame=frame: F.when(outs > 0, k * F.sum(c).over(frame) / outs)
        out[f"{label}_era"] = F.coalesce(per("earned_runs", 27.0), F.lit(STARTER_DEFAULTS["era"]))
        out[f"{label}_whip"] = F.coalesce(per("baserunners", 3.0), F.lit(STARTER_DEFAULTS["whip"]))
        out[f"{label}_k9"] = F.coalesce(per("strikeouts", 27.0), F.lit(STARTER_DEFAULTS["k9"]))
    from pyspark.sql.window import Window as W

    total = F.count(F.lit(1)).over(W.partitionBy("player_id"))
    return rows.withColumns(out).withColumn("_n", total).where(F.col("_n") >= least).drop("_n")


def batting_advanced(rows: DataFrame, sizes: Sequence[int] = (5, 10, 20)) -> DataFrame:
    """Rates of rows with at-bats, within 0 and 1, and their prior means.

    Needs at_bats, plate_appearances, hits, walks, strikeouts, doubles, triples, home_runs, total_bases.
    """
    c = F.col
    extra = c("doubles") + 2 * c("triples") + 3 * c("home_runs")
    rates = {
        "batter_k_rate": (c("strikeouts"), c("at_bats")),
        "batter_bb_rate": (c("walks"), c("plate_appearances")),
        "batter_iso": (extra, c("at_bats")),
        "batter_slg": (c("total_bases"), c("at_bats")),
        "batter_hard_contact": (c("doubles") + c("triples") + c("home_runs"), c("at_bats")),
        "batter_hr_rate": (c("home_runs"), c("at_bats")),
    }
    babip = F.when(c("at_bats") - c("strikeouts") - c("home_runs") != 0, (c("hits") - c("home_runs")) / (c("at_bats") - c("strikeouts") - c("home_runs")))
    return rolled(rows.where(c("at_bats") > 0), {k: clip(ratio(a, b), 0.0, 1.0) for k, (a, b) in rates.items()} | {"batter_babip": clip(F.coalesce(babip, F.lit(0.0)), 0.0, 1.0)}, sizes)


def pitching_advanced(rows: DataFrame, sizes: Sequence[int] = (5, 10)) -> DataFrame:
    """Walks and home runs for nine innings (at most 20), outs a pitch, command, quality starts, and their prior means.

    Needs outs, pitches_thrown, walks_allowed, home_runs_allowed, strikeouts, earned_runs.
    """
    c = F.col
    quality = ((c("outs") >= 18) & (c("earned_runs") <= 3)).cast("double")
    rates = {"pitcher_bb9": clip(ratio(27.0 * c("walks_allowed"), c("outs")), 0.0, 20.0), "pitcher_hr9": clip(ratio(27.0 * c("home_runs_allowed"), c("outs")), 0.0, 20.0), "pitcher_pitch_eff": clip(ratio(c("outs"), c("pitches_thrown")), 0.0, 1.0), "pitcher_command": clip(ratio(c("strikeouts"), c("strikeouts") + c("walks_allowed")), 0.0, 1.0), "pitcher_qs_rate": quality}
    return rolled(rows.where(c("outs") > 0), rates, sizes)


def skater_advanced(rows: DataFrame, sizes: Sequence[int] = (5, 10, 20)) -> DataFrame:
    """Shooting, points, hits, blocks and penalties by time (at most 2), the team's share of the game's shots, the share of power-play points, and their prior means.

    Needs position, shots, goals, points, hits, blocked_shots, penalty_minutes, powerplay_points, minutes.
    """
    c = F.col
    skaters = rows.where(c("position") != "G")
    shots = skaters.groupBy("game_id", "team_id").agg(F.sum("shots").alias("team_shots"))
    own = skaters.join(shots, ["game_id", "team_id"])
    own = attach_opponent(own, shots, "game_id", "opponent_id", "team_id", ["team_shots"])
    own = share_of_total(own, ["game_id", "team_id"], "powerplay_points", "pp_toi_share")
    both = c("team_shots") + c("opp_team_shots")
    by = lambda a, b: clip(ratio(c(a), c(b)), 0.0, 2.0)
    rates = {"shooting_pct": by("goals", "shots"), "pts_per_toi": by("points", "minutes"), "goals_per_shot": by("goals", "shots"), "hit_rate": by("hits", "minutes"), "block_rate": by("blocked_shots", "minutes"), "penalty_rate": by("penalty_minutes", "minutes"), "corsi_team": F.coalesce(F.when(both > 0, c("team_shots") / both), F.lit(0.5)), "pp_toi_share": c("pp_toi_share")}
    return rolled(own, rates, sizes)


def goalie_advanced(rows: DataFrame, sizes: Sequence[int] = (5, 10, 20)) -> DataFrame:
    """Save share, goals against for 60 minutes (at most 10) and shots faced of goalies, and their prior means. Needs position, saves, shots_against, goals_against, minutes."""
    c = F.col
    rates = {"goalie_save_pct": clip(ratio(c("saves"), c("shots_against")), 0.0, 1.0), "goalie_gaa": clip(ratio(60.0 * c("goals_against"), c("minutes")), 0.0, 10.0), "goalie_workload": F.coalesce(c("shots_against").cast("double"), F.lit(0.0))}
    return rolled(rows.where(c("position") == "G"), rates, sizes)


def teammate_absence(played: DataFrame, stats: Sequence[str] = ("shots", "free_throws", "assists"), keep: Sequence[str] | None = None, **limits: float) -> DataFrame:
    """Absent teammates of each row: their number, the top one's recent means, what all leave free, and the share of the rotation's minutes; with the row's columns `keep` (all).

    Rows of those who didn't play themselves (fewer than the floor's minutes) get zeros, as do games without an absence.
    """
    kept = list(played.columns if keep is None else keep)
    games = absence_rows(played, player="player_id", team="team_id", game="game_id", day="game_date", minutes="minutes", stats=list(stats), keep=kept, **limits)
    names = [c for c in games.columns if c not in ("team_id", "game_id", "_rows", "top_absentee")]
    out = games.withColumn("_row", F.explode("_rows"))
    active = F.coalesce(F.col("_row.minutes") >= limits.get("floor", 5.0), F.lit(False)) & F.col("game_id").isNotNull()
    return out.select(*[F.col(c) if c in ("team_id", "game_id") else F.col("_row")[c].alias(c) for c in kept], *[F.when(active, F.coalesce(F.col(c), F.lit(0))).otherwise(0).alias(c) for c in names], F.when(active, F.col("top_absentee")).alias("top_absentee"))


def team_rest(rows: DataFrame, missing: int = 7, most: int = 14) -> DataFrame:
    """team_days_rest (at most `most`, `missing` before the first game) and back_to_back (one day) of each row's team."""
    games = rows.select("team_id", "game_id", "game_date").distinct()
    rest = win.days_since(games, ["team_id"], ["game_date", "game_id"], "game_date", "team_days_rest", missing).withColumn("team_days_rest", F.least("team_days_rest", F.lit(most)))
    return rows.join(rest.withColumn("back_to_back", (F.col("team_days_rest") == 1).cast("int")), ["team_id", "game_id", "game_date"], "left")


def season_key(season: Column) -> Column:
    """'2024-25' and '2024-2025' as 2024-25; a single year stays."""
    return F.when(season.rlike(r"^\d{4}-\d{2}(\d{2})?$"), F.concat(F.substring(season, 1, 5), F.substring(season, -2, 2))).otherwise(season)


#: Season types that count as play-offs, and the names of the two parts of a season.
PLAYOFFS, PARTS_OF_SEASON = ("playoffs", "play_in"), ("Playoffs", "Regular Season")


def play_type_season(season: Column) -> Column:
    """A year as the season that begins in it, 2024 as 2024-25; other forms by `season_key`."""
    start = F.substring(season, -2, 2)
    after = F.lpad(((start.cast("int") + 1) % 100).cast("string"), 2, "0")
    return F.when(season.rlike(r"^\d{4}$"), F.concat(F.lit("20"), start, F.lit("-"), after)).otherwise(season_key(season))


def season_part(season_type: Column) -> Column:
    return F.when(F.coalesce(season_type.isin(*PLAYOFFS), F.lit(False)), PARTS_OF_SEASON[0]).otherwise(PARTS_OF_SEASON[1])


def play_types(rows: DataFrame, teams: DataFrame, players: DataFrame) -> DataFrame:
    """Rows with the play types of their team and player in their season and its part; rows with neither drop out.

    rows: team_ext, player_ext, season, season_type; teams and players: the id, season, part and own columns. A season's lookup is
    small beside the rows, which are joined twice by equal keys.
    """
    keyed = rows.withColumns({"_season": play_type_season(F.col("season")), "_part": season_part(F.col("season_type"))})
    found = None
    for side, key in ((teams, "team_ext"), (players, "player_ext")):
        own = side.withColumnsRenamed({"season": "_season", "part": "_part"}).withColumn(f"_has_{key}", F.lit(True))
        keyed = keyed.join(own, [key, "_season", "_part"], "left")
        has = F.col(f"_has_{key}").isNotNull()
        found = has if found is None else found | has
    return keyed.where(found).drop("_season", "_part", "_has_team_ext", "_has_player_ext")
