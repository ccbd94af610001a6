"""Window operators (2.3) over player rows (a customer's orders), dense rows (a supplier's lines) and team rows."""

from pyspark.sql import functions as F

from fieldbook.operators import windows as w
from fieldbook.operators.blocks import prior_means_blocked
from fieldbook.operators.joins import attach_opponent, both_sides
from fieldbook.plans import features
from fieldbook.plans.state import FeatureState
from fieldbook.queries.base import DENSE, LEDGER, PLAYER, TEAM, dense_rows, ledger, player_rows, query, rounded, table, team_rows
from fieldbook.session import fresh_folder

C = F.col
ORDER = ["game_date", "player_game_id"]


def prior(f: str, n: object, part: str = "player_id", order: str = "game_date, player_game_id") -> str:
    return f"{f} over (partition by {part} order by {order} rows between {'unbounded' if n is None else n} preceding and 1 preceding)"


@query("c01_prior_means", f"select player_game_id, {', '.join(f'round(coalesce({prior('avg(points)', n)}, 0), 6) as last_{n}_avg_points' for n in (5, 10, 20))} from ({PLAYER})")
def c01(s, d):
    return rounded(w.prior_means(player_rows(s, d), ["player_id"], ORDER, ["points"]).select("player_game_id", *[f"last_{n}_avg_points" for n in (5, 10, 20)]))


@query("c01_dense_means", f"select player_game_id, {', '.join(f'round(coalesce({prior(f'avg({x})', n, 'team_id')}, 0), 6) as last_{n}_avg_{x}' for n in (3, 5, 8) for x in ('points', 'assists', 'turnovers'))} from ({DENSE})")
def c01_dense(s, d):
    stats = ["points", "assists", "turnovers"]
    return rounded(w.prior_means(dense_rows(s, d), ["team_id"], ORDER, stats, (3, 5, 8)).select("player_game_id", *[f"last_{n}_avg_{x}" for n in (3, 5, 8) for x in stats]))


@query("c01_means_of_hot_entity", f"with t as (select player_game_id, game_date, points, assists, case when player_game_id % 10 < 4 then 0 else team_id end as team_id from ({DENSE})) select player_game_id, {', '.join(f'round(coalesce({prior(f"avg({x})", n, "team_id")}, 0), 6) as last_{n}_avg_{x}' for n in (5, 20) for x in ('points', 'assists'))} from t")
def c01_hot(s, d):
    rows = dense_rows(s, d).withColumn("team_id", F.when(C("player_game_id") % 10 < 4, 0).otherwise(C("team_id")))
    out = prior_means_blocked(rows.select("player_game_id", "team_id", "game_date", "points", "assists"), ["team_id"], ORDER, ["points", "assists"], (5, 20))
    return rounded(out.select("player_game_id", *[f"last_{n}_avg_{x}" for n in (5, 20) for x in ("points", "assists")]))


@query("c02_season_means", f"select player_game_id, round(coalesce({prior('avg(points)', None, 'player_id, season')}, 0), 6) as season_avg_points from ({PLAYER})")
def c02(s, d):
    return rounded(w.season_means(player_rows(s, d), ["player_id"], "season", ORDER, ["points"]).select("player_game_id", "season_avg_points"))


@query("c03_threshold_rates", f"""select player_game_id, {', '.join(f"round(coalesce({prior(f'avg(case when points > {t} then 1.0::double else 0 end)', 10)}, 0), 6) as last_10_rate_over_{t}_points" for t in (150000, 300000))},
 round(coalesce(sum(case when points > 150000 then 1.0::double else 0 end) over p / least(row_number() over (partition by player_id order by game_date, player_game_id), 10), 0), 6) as stored_form
 from ({PLAYER}) window p as (partition by player_id order by game_date, player_game_id rows between 10 preceding and 1 preceding)""")
def c03(s, d):
    rows = w.threshold_rates(player_rows(s, d), ["player_id"], ORDER, {"points": (150000.0, 300000.0)})
    names = [c for c in rows.columns if c.startswith("last_10_rate")]
    stored = w.threshold_rates(player_rows(s, d), ["player_id"], ORDER, {"points": (150000.0,)}, count_missing_slot=True)
    name = [c for c in stored.columns if c.startswith("last_10_rate")][0]
    out = rows.select("player_game_id", *[C(a).alias(f"last_10_rate_over_{t}_points") for a, t in zip(names, (150000, 300000), strict=True)])
    return rounded(out.join(stored.select("player_game_id", C(name).alias("stored_form")), "player_game_id"))


@query("c04_days_rest", f"select player_game_id, cast(coalesce(datediff('day', lag(game_date) over (partition by player_id order by game_date, player_game_id), game_date), -1) as bigint) as days_rest from ({PLAYER})")
def c04(s, d):
    return rounded(w.days_since(player_rows(s, d), ["player_id"], ORDER, "game_date").select("player_game_id", "days_rest"))


@query("c05_games_played", f"select player_game_id, row_number() over (partition by player_id, season order by game_date, player_game_id) - 1 as games_played_season from ({PLAYER})")
def c05(s, d):
    return w.prior_count(player_rows(s, d), ["player_id", "season"], ORDER, "games_played_season").select("player_game_id", "games_played_season")


@query("c06_season_runs", f"with t as (select *, case when season <> lag(season) over (partition by player_id order by game_date, player_game_id) then 1 else 0 end as c from ({PLAYER})) select player_game_id, cast(sum(c) over (partition by player_id order by game_date, player_game_id rows between unbounded preceding and current row) as bigint) as run from t")
def c06(s, d):
    return w.runs(player_rows(s, d), ["player_id"], ORDER, "season").select("player_game_id", "run")


@query("c07_series_context", f"select player_game_id, row_number() over (partition by team_id, season, opponent_id order by game_date, player_game_id) - 1 as series_game_num, round(coalesce({prior('avg(points)', None, 'team_id, season, opponent_id')}, 0), 6) as series_avg_points from ({DENSE})")
def c07(s, d):
    return rounded(w.series_context(dense_rows(s, d), ["team_id", "season", "opponent_id"], ORDER, ["points"]).select("player_game_id", "series_game_num", "series_avg_points"))


def ratio_sql(a: str, b: str, n: int, k: int, part: str) -> str:
    den = prior(f"sum({b})", n, part)
    return f"round(coalesce(case when {den} > 0 then {k} * {prior(f'sum({a})', n, part)} / cast({den} as double) end, 0), 6)"


#: Box scores of players: counts that follow from the dense rows' columns.
BOX_COLUMNS = {
    "minutes": "cast(4 * minutes as double) + 0.3::double", "fg_attempted": "points", "fg3_attempted": "cast(assists as double)", "fg3_made": "floor(assists / 2.0::double)", "ft_attempted": "cast(turnovers as double)", "ft_made": "floor(turnovers / 2.0::double)",
    "at_bats": "cast(minutes % 6 as double)", "plate_appearances": "cast(minutes % 6 + turnovers % 3 as double)", "hits": "cast(assists % 5 as double)", "walks": "cast(turnovers % 3 as double)", "strikeouts": "cast(assists % 4 as double)", "doubles": "cast(assists % 3 as double)", "triples": "cast(turnovers % 2 as double)", "home_runs": "cast(minutes % 2 as double)", "total_bases": "cast(assists + minutes % 2 as double)", "runs": "cast(turnovers % 4 as double)",
    "outs": "cast(3 * minutes % 22 as double)", "pitches_thrown": "cast(points + 10 as double)", "walks_allowed": "cast(turnovers % 5 as double)", "home_runs_allowed": "cast(assists % 2 as double)", "hits_allowed": "cast(assists as double)", "earned_runs": "cast(turnovers % 6 as double)", "batters_faced": "cast(minutes % 7 * 4 as double)",
    "shots": "cast(assists as double)", "goals": "cast(assists % 3 as double)", "blocked_shots": "cast(turnovers as double)", "penalty_minutes": "cast(turnovers % 4 * 2 as double)", "powerplay_points": "cast(turnovers % 3 as double)", "saves": "cast(points - assists as double)", "shots_against": "points", "goals_against": "cast(assists as double)",
}
KEPT = "player_game_id, game_id, team_id, opponent_id, player_id, game_date, season, points, assists, case position when 'N' then 'G' else position end as position"
BOX = f"select {KEPT}, {', '.join(f'{v} as {k}' for k, v in BOX_COLUMNS.items())} from ({DENSE})"


def box_rows(s, d):
    """Box scores of players."""
    made = {k: F.expr(v.replace("::double", "D")) for k, v in BOX_COLUMNS.items()}
    rows = dense_rows(s, d)
    return rows.select("player_game_id", "game_id", "team_id", "opponent_id", "player_id", "game_date", "season", "points", "assists", F.when(C("position") == "N", "G").otherwise(C("position")).alias("position"), *[v.alias(k) for k, v in made.items()])


def rolled_sql(names, sizes, source):
    """Each rate, its prior means of each size and of the season, by player, from a table that has the rates."""
    cols = [f"round({n}, 6) as {n}" for n in names] + [f"round(coalesce({prior(f'avg({n})', k)}, 0), 6) as last_{k}_avg_{n}" for k in sizes for n in names] + [f"round(coalesce({prior(f'avg({n})', None, 'player_id, season')}, 0), 6) as season_avg_{n}" for n in names]
    return f"select player_game_id, {', '.join(cols)} from {source}"


def rolled_columns(names, sizes):
    return ["player_game_id", *names, *[f"last_{k}_avg_{n}" for k in sizes for n in names], *[f"season_avg_{n}" for n in names]]


def over_sql(a, b, most=None):
    out = f"coalesce(case when {b} > 0 then {a} / cast({b} as double) end, 0)"
    return out if most is None else f"least(greatest({out}, 0), {most})"


@query("c08_prior_ratios", f"select player_game_id, {', '.join(f'{ratio_sql(a, b, n, k, 'player_id')} as {name}_{n}' for n in (5, 10) for name, a, b, k in (('k_rate', 'strikeouts', 'batters_faced', 1), ('h_per_9', 'hits_allowed', 'outs', 27), ('bb_per_9', 'walks_allowed', 'outs', 27), ('era', 'earned_runs', 'outs', 27)))}, {', '.join(f'round(coalesce({prior(f'sum({c})', n)} / {n}, 0), 6) as {name}_{n}' for n in (5, 10) for name, c in (('avg_k', 'strikeouts'), ('avg_outs', 'outs')))} from ({BOX}) where batters_faced > 0")
def c08(s, d):
    out = features.pitcher_rates(box_rows(s, d).where("batters_faced > 0"))
    return rounded(out.select("player_game_id", *[f"{a}_{n}" for n in (5, 10) for a in ("k_rate", "h_per_9", "bb_per_9", "era", "avg_k", "avg_outs")]))


TEAM_BOX = f"select game_id, team_id, min(game_date) as game_date, {', '.join(f'sum({c}) as {c}' for c in ('strikeouts', 'walks', 'runs', 'total_bases', 'plate_appearances'))} from ({BOX}) group by 1, 2"


@query("c09_team_rates", f"select game_id, team_id, {', '.join(f'round({over_sql(prior(f'sum({a})', n, 'team_id', 'game_date, game_id'), prior('sum(plate_appearances)', n, 'team_id', 'game_date, game_id'))}, 6) as {name}_{n}' for n in (10, 20) for name, a in (('k_rate', 'strikeouts'), ('walk_rate', 'walks')))}, {', '.join(f'round(coalesce({prior(f'sum({a})', n, 'team_id', 'game_date, game_id')} / least(row_number() over (partition by team_id order by game_date, game_id), {n}), 0), 6) as {name}_{n}' for n in (10, 20) for name, a in (('avg_runs', 'runs'), ('avg_tb', 'total_bases')))} from ({TEAM_BOX})")
def c09(s, d):
    names = ["strikeouts", "walks", "runs", "total_bases", "plate_appearances"]
    out = features.lineup_rates(features.team_totals(box_rows(s, d), names))
    return rounded(out.select("game_id", "team_id", *[f"{a}_{n}" for n in (10, 20) for a in ("k_rate", "walk_rate", "avg_runs", "avg_tb")]))


@query("c10_opponent_allowed", f"with t as (select game_id, opponent_id as defense_id, min(game_date) as game_date, sum(points) as points from ({DENSE}) group by 1, 2) select game_id, defense_id, {', '.join(f'round(coalesce({prior('avg(points)', n, 'defense_id', 'game_date, game_id')}, 0), 6) as last_{n}_avg_points' for n in (5, 10))} from t")
def c10(s, d):
    return rounded(features.allowed(dense_rows(s, d), ["points"]).select("game_id", "defense_id", "last_5_avg_points", "last_10_avg_points"))


@query("c11_pace", f"with t as ({TEAM}), p as (select a.game_id, a.team_id, a.game_date, a.points, a.points + arg_min(b.points, b.team_id) as game_total from t a join t b on a.game_id = b.game_id and a.team_id <> b.team_id group by 1, 2, 3, 4) select game_id, team_id, {', '.join(f'round(coalesce({prior(f'avg({c})', n, 'team_id', 'game_date, game_id')}, 0), 6) as last_{n}_avg_{c}' for n in (5, 10) for c in ('game_total', 'points'))} from p")
def c11(s, d):
    out = features.pace(team_rows(s, d), "points")
    return rounded(out.select("game_id", "team_id", *[f"last_{n}_avg_{c}" for n in (5, 10) for c in ("game_total", "points")]))


ROLES = {"usage_rate": "case when sum(fg_attempted) over (partition by game_id, team_id) > 0 then fg_attempted / sum(fg_attempted) over (partition by game_id, team_id) else 0 end", "floor_spacing_score": f"{over_sql('fg3_attempted', 'minutes')} * {over_sql('fg3_made', 'fg3_attempted')}", "foul_drawing_rate": over_sql("ft_attempted", "fg_attempted"), "pts_per_fga": over_sql("points", "fg_attempted"), "paint_scoring_pct": over_sql("greatest(points - 3 * fg3_made - ft_made, 0)", "points"), "ast_to_pts_ratio": over_sql("assists", "points")}


@query("c12_role_share", f"with t as (select *, {', '.join(f'{v} as {k}' for k, v in ROLES.items())} from ({BOX})) {rolled_sql(ROLES, (5, 10, 20), 't')}")
def c12(s, d):
    return rounded(features.roles(box_rows(s, d)).select(*rolled_columns(ROLES, (5, 10, 20))))


@query("c13_spacing_context", f"""with t as (select *, assists / cast(10 as double) as spacing from ({DENSE})), m as (select game_id, team_id, min(game_date) as game_date, avg(spacing) as spacing from t group by 1, 2),
 v as (select game_id, team_id, coalesce({prior('avg(spacing)', 5, 'team_id', 'game_date, game_id')}, 0) as a from m)
 select player_game_id, round(x.a, 6) as team_last_5_avg_spacing, round(y.a, 6) as opp_last_5_avg_spacing from t left join v x on x.game_id = t.game_id and x.team_id = t.team_id left join v y on y.game_id = t.game_id and y.team_id = t.opponent_id""")
def c13(s, d):
    out = features.spacing_context(dense_rows(s, d).withColumn("spacing", C("assists") / F.lit(10.0)), (5,))
    return rounded(out.select("player_game_id", "team_last_5_avg_spacing", "opp_last_5_avg_spacing"))


@query("c14_close_game_rate", f"""with g as (select o_orderkey as game_id, cast(o_orderdate as date) as game_date, o_custkey % 50 as h, (o_custkey + 7) % 50 as a, case when cast(o_totalprice as bigint) % 20 <= 5 then 1.0::double else 0 end as close from orders),
 t as (select game_id, game_date, h as team_id, close from g union all select game_id, game_date, a, close from g)
 select game_id, team_id, round(coalesce({prior('avg(close)', 10, 'team_id', 'game_date, game_id')}, 0.5), 6) as last_10_avg_close from t""")
def c14(s, d):
    o = table(s, d, "orders")
    g = o.select(C("o_orderkey").alias("game_id"), C("o_orderdate").cast("date").alias("game_date"), (C("o_custkey") % 50).alias("home_team_id"), ((C("o_custkey") + 7) % 50).alias("away_team_id"), (F.round("o_totalprice", 0).cast("bigint") % 20).alias("home_score"), F.lit(0).alias("away_score"))
    g = g.withColumn("home_score", C("home_score"))
    return rounded(features.close_games(g).select("game_id", "team_id", "last_10_avg_close"))


@query("c15_games_last_7_days", f"select player_game_id, count(*) over (partition by player_id order by game_date range between interval 7 days preceding and interval 1 day preceding) + row_number() over (partition by player_id, game_date order by player_game_id) - 1 as games_last_7_days from ({PLAYER})")
def c15(s, d):
    return w.games_in_days(player_rows(s, d), ["player_id"], ["player_game_id"], "game_date").select("player_game_id", "games_last_7_days")


@query("c16_career_vs_opponent", f"select player_game_id, round(case when {prior('count(*)', None, 'team_id, opponent_id')} >= 2 then {prior('avg(points)', None, 'team_id, opponent_id')} else 0 end, 6) as vs_avg_points from ({DENSE})")
def c16(s, d):
    return rounded(w.career_vs(dense_rows(s, d), ["team_id", "opponent_id"], ORDER, ["points"]).select("player_game_id", "vs_avg_points"))


@query("c17_allowed_to_position", f"with t as (select game_id, opponent_id, position, min(game_date) as game_date, avg(points) as v from ({DENSE}) group by 1, 2, 3) select game_id, opponent_id, position, round(case when {prior('count(*)', 10, 'opponent_id, position', 'game_date, game_id')} >= 3 then {prior('avg(v)', 10, 'opponent_id, position', 'game_date, game_id')} else 0 end, 6) as opp_allowed_points from t")
def c17(s, d):
    return rounded(features.allowed_to_position(dense_rows(s, d), "points", "position"))


@query("c18_pair_totals", f"select player_game_id, coalesce({prior('sum(points)', None, 'team_id, opponent_id')}, 0) as career_points from ({DENSE})")
def c18(s, d):
    return w.prior_totals(dense_rows(s, d), ["team_id", "opponent_id"], ORDER, ["points"]).select("player_game_id", "career_points")


@query("c19_opponent_quality", f"with t as (select player_game_id, team_id, game_date, {ratio_sql('assists', 'points', 5, 1, 'opponent_id')[6:-4]} as q from ({DENSE})) select player_game_id, round(coalesce({prior('avg(q)', 10, 'team_id')}, 0), 6) as last_10_avg_q from t")
def c19(s, d):
    rows = w.prior_ratio(dense_rows(s, d), ["opponent_id"], ORDER, {"q": ("assists", "points", 1.0)}, (5,)).withColumnRenamed("q_5", "q")
    return rounded(w.prior_means(rows, ["team_id"], ORDER, ["q"], (10,)).select("player_game_id", "last_10_avg_q"))


@query("c20_home_split", f"with t as (select player_game_id, {prior('list(points) filter (minutes % 2 = 0)', 30, 'team_id')} as l from ({DENSE})) select player_game_id, round(coalesce(list_avg(l[-10:]), 0), 6) as home_last_10_points from t")
def c20(s, d):
    return rounded(w.conditional_last(dense_rows(s, d), ["team_id"], ORDER, "points", C("minutes") % 2 == 0, "home_last_10_points").select("player_game_id", "home_last_10_points"))


@query("c21_prior_spread", f"select player_game_id, round(coalesce({prior('stddev_samp(points)', 10)}, 0), 4) as points_stddev_last_10 from ({PLAYER})")
def c21(s, d):
    return w.prior_spread(player_rows(s, d), ["player_id"], ORDER, "points", "v").select("player_game_id", F.round("v", 4).alias("points_stddev_last_10"))


@query("c22_team_form", f"with t as (select *, case when points > 30 then 1 else 0 end as won from ({TEAM})) select game_id, team_id, cast(coalesce({prior('sum(won)', 5, 'team_id', 'game_date, game_id')}, 0) as bigint) as team_last_5_wins, cast(coalesce(lag(won) over (partition by team_id order by game_date, game_id), 0) as bigint) as team_won_last_game from t")
def c22(s, d):
    rows = team_rows(s, d).withColumn("won", F.when(C("points") > 30, 1).otherwise(0))
    return w.form(rows, ["team_id"], ["game_date", "game_id"], "won").select("game_id", "team_id", "team_last_5_wins", "team_won_last_game")


@query("c23_team_rest", f"with g as (select distinct team_id, game_id, game_date from ({DENSE})), r as (select *, least(coalesce(datediff('day', lag(game_date) over (partition by team_id order by game_date, game_id), game_date), 7), 14) as rest from g) select player_game_id, cast(rest as bigint) as team_days_rest, cast(case when rest = 1 then 1 else 0 end as bigint) as back_to_back from ({DENSE}) join r using (team_id, game_id, game_date)")
def c23(s, d):
    return rounded(features.team_rest(dense_rows(s, d)).select("player_game_id", "team_days_rest", "back_to_back"))


BATTING = {"batter_k_rate": over_sql("strikeouts", "at_bats", 1), "batter_bb_rate": over_sql("walks", "plate_appearances", 1), "batter_iso": over_sql("(doubles + 2 * triples + 3 * home_runs)", "at_bats", 1), "batter_slg": over_sql("total_bases", "at_bats", 1), "batter_hard_contact": over_sql("(doubles + triples + home_runs)", "at_bats", 1), "batter_hr_rate": over_sql("home_runs", "at_bats", 1), "batter_babip": "least(greatest(coalesce((hits - home_runs) / nullif(at_bats - strikeouts - home_runs, 0), 0), 0), 1)"}
PITCHING = {"pitcher_bb9": over_sql("27.0 * walks_allowed", "outs", 20), "pitcher_hr9": over_sql("27.0 * home_runs_allowed", "outs", 20), "pitcher_pitch_eff": over_sql("outs", "pitches_thrown", 1), "pitcher_command": over_sql("strikeouts", "(strikeouts + walks_allowed)", 1), "pitcher_qs_rate": "case when outs >= 18 and earned_runs <= 3 then 1.0::double else 0 end"}
SKATING = {"shooting_pct": over_sql("goals", "shots", 2), "pts_per_toi": over_sql("points", "minutes", 2), "goals_per_shot": over_sql("goals", "shots", 2), "hit_rate": over_sql("hits", "minutes", 2), "block_rate": over_sql("blocked_shots", "minutes", 2), "penalty_rate": over_sql("penalty_minutes", "minutes", 2), "corsi_team": "coalesce(case when ts + os > 0 then ts / (ts + os) end, 0.5)", "pp_toi_share": "case when sum(powerplay_points) over (partition by game_id, team_id) > 0 then powerplay_points / sum(powerplay_points) over (partition by game_id, team_id) else 0 end"}
GOALIES = {"goalie_save_pct": over_sql("saves", "shots_against", 1), "goalie_gaa": over_sql("60.0 * goals_against", "minutes", 10), "goalie_workload": "shots_against"}


@query("c24_advanced_rates", f"with t as (select *, {', '.join(f'{v} as {k}' for k, v in BATTING.items())} from ({BOX}) where at_bats > 0) {rolled_sql(BATTING, (5, 10, 20), 't')}")
def c24(s, d):
    return rounded(features.batting_advanced(box_rows(s, d)).select(*rolled_columns(BATTING, (5, 10, 20))))


@query("c24_pitching_rates", f"with t as (select *, {', '.join(f'{v} as {k}' for k, v in PITCHING.items())} from ({BOX}) where outs > 0) {rolled_sql(PITCHING, (5, 10), 't')}")
def c24_pitching(s, d):
    return rounded(features.pitching_advanced(box_rows(s, d)).select(*rolled_columns(PITCHING, (5, 10))))


@query("c25_share_by_role", f"with b as (select * from ({BOX}) where position <> 'G'), sh as (select game_id, team_id, sum(shots) as ts from b group by 1, 2), j as (select b.*, x.ts, y.ts as os from b join sh x using (game_id, team_id) left join sh y on y.game_id = b.game_id and y.team_id = b.opponent_id), t as (select *, {', '.join(f'{v} as {k}' for k, v in SKATING.items())} from j) {rolled_sql(SKATING, (5, 10, 20), 't')}")
def c25(s, d):
    return rounded(features.skater_advanced(box_rows(s, d)).select(*rolled_columns(SKATING, (5, 10, 20))))


@query("c25_goalie_rates", f"with t as (select *, {', '.join(f'{v} as {k}' for k, v in GOALIES.items())} from ({BOX}) where position = 'G') {rolled_sql(GOALIES, (5, 10, 20), 't')}")
def c25_goalies(s, d):
    return rounded(features.goalie_advanced(box_rows(s, d)).select(*rolled_columns(GOALIES, (5, 10, 20))))


@query("c26_starters", f"with t as (select *, row_number() over (partition by game_id, team_id order by points desc, player_game_id) as r from ({DENSE})) select game_id, team_id, player_game_id, points from t where r = 1")
def c26(s, d):
    return features.starters(dense_rows(s, d), "points").select("game_id", "team_id", "player_game_id", "points")


@query("c27_latest_per_key", "with t as (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as r from events) select user_id, event_type, event_id, value from t where r = 1")
def c27(s, d):
    return w.latest_per_key(table(s, d, "events").select("user_id", "event_type", "event_id", "ts", "value"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("c28_recent_form", f"with t as (select *, row_number() over (partition by player_id order by decided desc, pick_id) as r, case when quantity = 25 then null else win end as hit from ({LEDGER})) select player_id, cast(count(*) filter (hit = 1 and r <= 5) as varchar) || '/' || cast(count(*) filter (hit is not null and r <= 5) as varchar) as hits_5, cast(count(*) filter (hit = 1 and r <= 10) as varchar) || '/' || cast(count(*) filter (hit is not null and r <= 10) as varchar) as hits_10 from t group by 1")
def c28(s, d):
    return w.recent_form(ledger(s, d), ["player_id"], [F.desc("decided"), F.asc("pick_id")], F.when(C("quantity") != 25, C("win")))


PNL = f"select sport, decided, cast(sum(case when win = 1 then 1 else -1 end) as bigint) as pnl from ({LEDGER}) group by 1, 2"


@query("c29_bankroll", f"with t as ({PNL}), b as (select *, cast(sum(pnl) over w as bigint) as balance from t window w as (partition by sport order by decided)), p as (select *, greatest(max(balance) over (partition by sport order by decided), 0) as peak from b) select sport, decided, balance, peak, peak - balance as drawdown from p")
def c29(s, d):
    daily = ledger(s, d).groupBy("sport", "decided").agg(F.sum(F.when(C("win") == 1, 1).otherwise(-1)).alias("pnl"))
    return rounded(w.bankroll(daily, ["sport"], "decided", "pnl").select("sport", "decided", "balance", "peak", "drawdown"))


@query("c30_losing_streak", f"with t as (select *, max(case when win = 1 then (decided, pick_id) end) over (partition by player_id) as last from ({LEDGER})) select player_id, count(*) filter (last is null or (decided, pick_id) > last) as losing_streak from t group by 1")
def c30(s, d):
    return w.losing_streak(ledger(s, d), ["player_id"], ["decided", "pick_id"], "win")


@query("c32_winner_form", f"with t as (select *, cast(players * 20 as double) as allowed from ({TEAM})), u as (select *, points - allowed as margin, case when points > allowed then 1.0::double else 0 end as won from t) select game_id, team_id, round(coalesce({prior('avg(margin)', 10, 'team_id', 'game_date, game_id')}, 0), 6) as last_10_avg_margin, round(coalesce({prior('avg(won)', 5, 'team_id', 'game_date, game_id')}, 0.5), 6) as last_5_avg_won, round(coalesce({prior('avg(points)', None, 'team_id, season', 'game_date, game_id')}, 0), 6) as season_avg_scored, cast(least(greatest(coalesce(datediff('day', lag(game_date) over (partition by team_id order by game_date, game_id), game_date), 7), 1), 7) as bigint) as rest from u")
def c32(s, d):
    rows = team_rows(s, d).withColumns({"scored": C("points"), "allowed": (C("players") * 20).cast("double")})
    return rounded(features.winner_form(rows).select("game_id", "team_id", "last_10_avg_margin", "last_5_avg_won", "season_avg_scored", "rest"))


@query("c33_starter_form", f"""with t as (select player_game_id, team_id, game_date, turnovers as earned_runs, minutes as outs, assists as baserunners, points as strikeouts from ({DENSE})), n as (select *, count(*) over (partition by team_id) as c from t)
 select player_game_id, {', '.join(f"round(coalesce(case when {prior('sum(outs)', n, 'team_id')} > 0 then {k} * {prior(f'sum({a})', n, 'team_id')} / cast({prior('sum(outs)', n, 'team_id')} as double) end, {v}), 6) as {label}_{name}" for label, n in (('last_3', 3), ('career', None)) for name, a, k, v in (('era', 'earned_runs', 27, 4.5), ('whip', 'baserunners', 3, 1.35), ('k9', 'strikeouts', 27, 8)))} from n where c >= 2""")
def c33(s, d):
    rows = dense_rows(s, d).select("player_game_id", C("team_id").alias("player_id"), "game_date", C("turnovers").alias("earned_runs"), C("minutes").alias("outs"), C("assists").alias("baserunners"), C("points").alias("strikeouts"))
    out = features.starter_form(rows, (3,))
    return rounded(out.select("player_game_id", *[f"{a}_{b}" for a in ("last_3", "career") for b in ("era", "whip", "k9")]))


@query("c34_upcoming_vector", f"with u as (select player_id, null as player_game_id, max(game_date) + 1 as game_date, null as points from ({PLAYER}) group by 1), t as (select player_id, player_game_id, game_date, points from ({PLAYER}) union all select * from u), f as (select *, avg(points) over (partition by player_id order by game_date, player_game_id rows between 10 preceding and 1 preceding) as m from t) select player_id, game_date, round(coalesce(m, 0), 6) as last_10_avg_points from f where player_game_id is null")
def c34(s, d):
    rows = player_rows(s, d)
    ahead = rows.groupBy("player_id").agg(F.date_add(F.max("game_date"), 1).alias("game_date"))
    out = w.prior_means(w.upcoming(rows.select("player_id", "player_game_id", "game_date", "points"), ahead), ["player_id"], ORDER, ["points"], (10,))
    return rounded(out.where("is_upcoming").select("player_id", "game_date", "last_10_avg_points"))


@query("c35_latest_vector", f"with t as (select *, avg(points) over (partition by player_id order by game_date, player_game_id rows between 5 preceding and 1 preceding) as m, row_number() over (partition by player_id order by game_date desc, player_game_id desc) as r from ({PLAYER})) select player_id, round(coalesce(m, 0), 6) as last_5_avg_points from t where r = 1")
def c35(s, d):
    rows = w.prior_means(player_rows(s, d), ["player_id"], ORDER, ["points"], (5,)).select("player_id", *ORDER, "last_5_avg_points")
    return rounded(w.latest_per_key(rows, ["player_id"], ORDER).select("player_id", "last_5_avg_points"))


@query("c35_daily_state", f"select player_id, player_game_id, game_date, {', '.join(f'round(coalesce({prior('avg(points)', n)}, 0), 6) as last_{n}_avg_points' for n in (5, 20))}, round(coalesce({prior('avg(points)', None, 'player_id, season')}, 0), 6) as season_avg_points, row_number() over (partition by player_id, season order by game_date, player_game_id) - 1 as games_played_season from ({PLAYER})")
def c35_state(s, d):
    """All but the last days in one step, then a step for each of these; a step reads the stored state and its own rows."""
    rows = player_rows(s, d).drop("status")
    last = rows.select("game_date").distinct().orderBy(F.desc("game_date")).limit(4).collect()
    state = FeatureState(fresh_folder(s, "state"), "player_id", "season", ORDER, ["points"], (5, 20), buckets=8)
    days = sorted(r["game_date"] for r in last)
    out = state.advance(rows.where(C("game_date") < days[0]) if days else rows)
    for day in days:
        out = out.unionByName(state.advance(rows.where(C("game_date") == day)))
    return rounded(out.select("player_id", "player_game_id", "game_date", "last_5_avg_points", "last_20_avg_points", "season_avg_points", "games_played_season"))


@query("c_player_table", f"select player_game_id, {', '.join(f'round(coalesce({prior('avg(points)', n)}, 0), 6) as last_{n}_avg_points' for n in (5, 10))}, round(coalesce({prior('avg(points)', None, 'player_id, season')}, 0), 6) as season_avg_points, cast(coalesce(datediff('day', lag(game_date) over (partition by player_id order by game_date, player_game_id), game_date), -1) as bigint) as days_rest, row_number() over (partition by player_id, season order by game_date, player_game_id) - 1 as games_played_season from ({PLAYER})")
def player_table(s, d):
    out = features.player_features(player_rows(s, d), features.Sport(("points",), (5, 10)))
    return rounded(out.select("player_game_id", "last_5_avg_points", "last_10_avg_points", "season_avg_points", "days_rest", "games_played_season"))


def sport_sql(sport: features.Sport) -> str:
    """Each stat of the sport is a small number that the order gives; its features are written out."""
    stats = {x: f"cast((player_game_id * {2 * k + 3} + player_id * {k}) % 41 as double)" for k, x in enumerate(sport.stats)}
    named = stats | {c: " + ".join(stats[x] for x in parts) for c, parts in sport.combos.items()}
    out = [f"round(coalesce({prior(f'avg({x})', n)}, 0), 6) as last_{n}_avg_{x}" for n in sport.sizes for x in named] + [f"round(coalesce({prior(f'avg({x})', None, 'player_id, season')}, 0), 6) as season_avg_{x}" for x in named]
    out += [f"round(coalesce({prior(f'avg(cast({x} > {v} as int))', 10)}, 0), 6) as last_10_rate_over_{f'{v:g}'.replace('.', '_')}_{x}" for x, values in sport.limits.items() for v in values]
    rest = "cast(coalesce(datediff('day', lag(game_date) over (partition by player_id order by game_date, player_game_id), game_date), -1) as bigint) as days_rest, row_number() over (partition by player_id, season order by game_date, player_game_id) - 1 as games_played_season"
    return f"with t as (select player_id, player_game_id, game_date, season, {', '.join(f'{v} as {x}' for x, v in named.items())} from ({PLAYER})) select player_game_id, {', '.join(out)}, {rest} from t"


def sport_table(sport: features.Sport):
    def table(s, d):
        rows = player_rows(s, d).select("player_id", "player_game_id", "game_date", "season", *[((C("player_game_id") * (2 * k + 3) + C("player_id") * k) % 41).cast("double").alias(x) for k, x in enumerate(sport.stats)])
        return rounded(features.player_features(rows, sport).drop("player_id", "game_date", "season", *sport.stats, *sport.combos))

    return table


for _name in ("mlb", "nba", "wnba", "nhl", "nfl", "soccer"):  # cbb is as wnba, cfb as nfl
    query(f"c_table_{_name}", sport_sql(features.SPORTS[_name]))(sport_table(features.SPORTS[_name]))


@query("d01_attach_opponent", f"with t as ({TEAM}), f as (select game_id, team_id, coalesce({prior('avg(points)', 5, 'team_id', 'game_date, game_id')}, 0) as a from t) select player_game_id, round(f.a, 6) as opp_last_5_avg_points from ({DENSE}) r left join f on f.game_id = r.game_id and f.team_id = r.opponent_id")
def d01(s, d):
    f = w.prior_means(team_rows(s, d), ["team_id"], ["game_date", "game_id"], ["points"], (5,))
    return rounded(attach_opponent(dense_rows(s, d), f, "game_id", "opponent_id", "team_id", ["last_5_avg_points"]).select("player_game_id", "opp_last_5_avg_points"))
