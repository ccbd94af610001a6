"""Data-quality findings: rows of (level, name, detail, value)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fieldbook.functions.scalars import local_day


def finding(df: DataFrame, level: str | Column, name: str, detail: Column, value: Column) -> DataFrame:
    return df.select((F.lit(level) if isinstance(level, str) else level).alias("level"), F.lit(name).alias("name"), detail.cast("string").alias("detail"), value.cast("double").alias("value"))


def together(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def freshness(df: DataFrame, group: str, time: str, now: DataFrame, hours: float, name: str) -> DataFrame:
    """Groups whose newest row is more than `hours` older than `now`, a frame of one row (column now)."""
    last = df.groupBy(group).agg(F.max(F.col(time).cast("timestamp")).alias("_last")).join(F.broadcast(now))
    age = (F.unix_timestamp("now") - F.unix_timestamp("_last")) / 3600.0
    return finding(last.withColumn("_age", age).where(F.col("_age") > hours), "error", name, F.col(group), F.col("_age"))


def missing_box(games: DataFrame, box: DataFrame, game: str, group: str) -> DataFrame:
    gone = games.join(box.select(game).distinct(), game, "left_anti").groupBy(group).agg(F.count("*").alias("_n"))
    return finding(gone, "warn", "finals_without_box", F.col(group), F.col("_n"))


def board_volume(lines: DataFrame, day: Column, player: str, stat: str, game: str) -> DataFrame:
    """Distinct (player, stat) and distinct games by local day."""
    return lines.withColumn("day", day).groupBy("day").agg(F.count_distinct(player, stat).alias("board"), F.count_distinct(game).alias("games"))


#: A day is thin below this share of the week's mean lines for each game, collapsed below this share of its mean lines; both only above a mean of so many lines. Hours after which injuries are cold.
THIN, COLLAPSED, LEAST_BASELINE, COLD_HOURS = 0.30, 0.10, 50, 40.0


def thin_days(volume: DataFrame, days: int = 7) -> DataFrame:
    """Days with too few lines against the days before, from rows of (day, board, games): `feed broken` where nearly all are gone, `thin` where games have
    too few. A light day with the usual lines for each game is neither. The window runs over days.
    """
    w = W.orderBy(F.unix_date(F.col("day").cast("date"))).rangeBetween(-days, -1)
    each = F.when(F.col("games") > 0, F.col("board") / F.col("games"))
    rows = volume.withColumn("_each", each).withColumns({"_mean": F.avg("board").over(w), "_usual": F.coalesce(F.avg("_each").over(w), F.lit(0.0))})
    own = F.coalesce("_each", F.lit(0.0))
    broken = F.col("board") < COLLAPSED * F.col("_mean")
    rows = rows.where((F.col("_mean") >= LEAST_BASELINE) & (broken | (own < THIN * F.col("_usual"))))
    return finding(rows, "warn", "slate_thin", F.concat_ws(" ", F.col("day").cast("string"), F.when(broken, "feed broken").otherwise("thin")), own)


def cold_injuries(injuries: DataFrame, time: str, now: DataFrame) -> DataFrame:
    """A finding where the newest injury report is older than COLD_HOURS, or there is none (value null); now: one row."""
    last = injuries.agg(F.max(F.col(time).cast("timestamp")).alias("_last")).join(F.broadcast(now))
    age = (F.unix_timestamp("now") - F.unix_timestamp("_last")) / 3600.0
    return finding(last.withColumn("_age", age).where(F.col("_age").isNull() | (F.col("_age") > COLD_HOURS)), "warn", "injuries_stale", F.lit("injuries"), F.col("_age"))


def written_findings(spark: SparkSession, metrics: Mapping[str, object], now: DataFrame, hours: float) -> DataFrame:
    """Findings from the metrics of a write (rows, empty, newest): nothing written, rows without a value, old data."""
    one = spark.createDataFrame([(metrics["rows"], metrics["empty"], metrics["newest"])], "rows bigint, empty bigint, newest timestamp").join(F.broadcast(now))
    age = (F.unix_timestamp("now") - F.unix_timestamp("newest")) / 3600.0
    parts = [finding(one.where("rows = 0"), "error", "nothing_written", F.lit("rows"), F.lit(0)), finding(one.where("empty > 0"), "warn", "empty_values", F.lit("rows"), F.col("empty")), finding(one.where(age > hours), "warn", "old_rows", F.lit("newest"), age)]
    return together(parts)


def duplicates(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    rows = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
    return finding(rows, "error", name, F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), F.col("_n"))


#: The placeholder team's external id and the prefix of placeholder games; sports whose abbreviations may collide; teams of the full leagues.
PLACEHOLDER_TEAM, PLACEHOLDER_GAME = "PP_PLACEHOLDER", "pp_"
SHARED_ABBREVIATIONS = ("cbb", "cfb", "soccer")
EXPECTED_TEAMS = {"mlb": 30, "nba": 30, "nhl": 32, "wnba": 13}


def real_teams(teams: DataFrame) -> DataFrame:
    """Neither the placeholder nor an all-star team."""
    return teams.where((F.coalesce("external_id", F.lit("")) != PLACEHOLDER_TEAM) & ~F.lower(F.coalesce("name", F.lit(""))).contains("all-star"))


def teams_incomplete(teams: DataFrame, expected: Mapping[str, int] = EXPECTED_TEAMS) -> DataFrame:
    """Sports with fewer teams than their league has; the table of sports is a constant."""
    want = F.explode(F.create_map(*[F.lit(x) for kv in expected.items() for x in kv])).alias("sport_code", "_want")
    have = real_teams(teams).groupBy("sport_code").agg(F.count("*").alias("_have"))
    rows = teams.sparkSession.range(1).select(want).join(have, "sport_code", "left").withColumn("_have", F.coalesce("_have", F.lit(0))).where("_have < _want")
    return finding(rows, "warn", "teams_incomplete", F.col("sport_code"), F.col("_have"))


def duplicate_abbreviations(teams: DataFrame, exempt: Sequence[str] = SHARED_ABBREVIATIONS) -> DataFrame:
    rows = real_teams(teams).where(~F.col("sport_code").isin(*exempt)).groupBy("sport_code", "abbreviation").agg(F.count("*").alias("_n")).where("_n > 1")
    return finding(rows, "warn", "duplicate_abbrev", F.concat_ws("/", "sport_code", "abbreviation"), F.col("_n"))


def same_sides(games: DataFrame, game: str, home: str, away: str, external: str | None = None) -> DataFrame:
    """Games of a team against itself; placeholder games are expected to be such."""
    rows = games.where(F.col(home) == F.col(away))
    if external:
        rows = rows.where(~F.coalesce(F.col(external), F.lit("")).startswith(PLACEHOLDER_GAME))
    return finding(rows, "error", "home_is_away", F.col(game), F.lit(1))


def placeholder_picks(picks: DataFrame, box: DataFrame, teams: DataFrame) -> DataFrame:
    """How many settled picks hang on a placeholder team; no row where none does."""
    bad = teams.where(F.col("external_id") == PLACEHOLDER_TEAM).select("team_id")
    rows = picks.where(F.col("leg_result").isin("win", "loss", "push")).join(box.join(bad, "team_id", "left_semi").select("player_id", "game_id"), ["player_id", "game_id"])
    return finding(rows.agg(F.count("*").alias("_n")).where("_n > 0"), "warn", "placeholder_picks", F.lit("settled picks"), F.col("_n"))


def dnp_losses(picks: DataFrame, box: DataFrame, now: Column, days: int = 14) -> DataFrame:
    """How many picks settled in the last days were graded as losses of players who didn't play; no row where none was."""
    recent = picks.where((F.col("leg_result") == "loss") & (F.col("settled_at") >= now - F.expr(f"INTERVAL {days} DAYS")))
    rows = recent.join(box.where(F.col("did_play") == F.lit(False)).select("player_id", "game_id"), ["player_id", "game_id"])
    return finding(rows.agg(F.count("*").alias("_n")).where("_n > 0"), "warn", "dnp_leak", F.lit("losses"), F.col("_n"))


def many_teams(rows: DataFrame, player: str, team: str, most: int = 2) -> DataFrame:
    got = rows.groupBy(player).agg(F.count_distinct(team).alias("_n")).where(F.col("_n") > most)
    return finding(got, "warn", "many_teams", F.col(player), F.col("_n"))


def stale_mapping(rows: DataFrame, players: DataFrame, player: str, team: str, current: str, order: Sequence[str]) -> DataFrame:
    """Players whose stored team isn't the one of their latest row."""
    last = rows.groupBy(player).agg(F.max_by(team, F.struct(*order)).alias("_team"))
    bad = players.join(last, player).where(~F.col(current).eqNullSafe(F.col("_team")))
    return finding(bad, "warn", "stale_team", F.col(player), F.lit(1))


def incomplete_teams(rows: DataFrame, game: str, team: str, least: int) -> DataFrame:
    got = rows.groupBy(game, team).agg(F.count("*").alias("_n")).where(F.col("_n") < least)
    return finding(got, "warn", "few_players", F.concat_ws("|", F.col(game).cast("string"), F.col(team).cast("string")), F.col("_n"))


def combo_names(df: DataFrame, name: str) -> DataFrame:
    return finding(df.where(F.col(name).contains(" + ")), "warn", "combo_name", F.col(name), F.lit(1))


def orphans(rows: DataFrame, dim: DataFrame, key: str, name: str) -> DataFrame:
    """Keys of rows that the dimension lacks."""
    got = rows.join(dim.select(key), key, "left_anti").groupBy(key).agg(F.count("*").alias("_n"))
    return finding(got, "error", name, F.col(key), F.col("_n"))


def drift_findings(drift: DataFrame) -> DataFrame:
    return finding(drift.where("collapsed"), "error", "feature_collapsed", F.col("feature"), F.col("recent"))


def coverage_findings(table: DataFrame, key: str) -> DataFrame:
    return finding(table.where("off"), "warn", "interval_coverage", F.col(key), F.col("covered"))


def activity(lines: DataFrame, day: Column, time: str, now: Column) -> DataFrame:
    """Lines by local day and the hours since the day's last one."""
    return lines.withColumn("day", day).groupBy("day").agg(F.count("*").alias("n"), ((F.unix_timestamp(now) - F.unix_timestamp(F.max(time))) / 3600.0).alias("hours_ago"))


def usage(lines: DataFrame, picks: DataFrame, now: DataFrame, days: int = 10, settled_days: int = 7) -> DataFrame:
    """name, day, value: distinct lines by local day of the last `days`, their mean, hours since the last line and pick, picks of the local day, and picks settled
    in the last week. lines: player_id, stat_type, snapshot_at; picks: picked_at, leg_result; now: one row. A day without lines has no row; nothing at all gives nulls.
    """
    one = F.broadcast(now)
    recent = lines.join(one).where(F.col("snapshot_at") > F.col("now") - F.make_dt_interval(days=F.lit(days)))
    by_day = recent.groupBy(local_day(F.col("snapshot_at")).alias("day")).agg(F.count_distinct("player_id", "stat_type").cast("double").alias("value"))
    hours = lambda c: (F.unix_timestamp("now") - F.unix_timestamp(c)) / 3600.0
    none = F.lit(None).cast("date")
    row = lambda df, name, value: df.select(F.lit(name).alias("name"), none.alias("day"), value.cast("double").alias("value"))
    done = F.col("leg_result").isin("win", "loss", "push") & (F.col("picked_at") > F.col("now") - F.make_dt_interval(days=F.lit(settled_days)))
    counted = picks.join(one).agg(F.max("now").alias("now"), F.max("picked_at").alias("_last"), F.count_if(local_day(F.col("picked_at")) == local_day(F.col("now"))).alias("_today"), F.count_if(done).alias("_settled"))
    last = lines.agg(F.max("snapshot_at").alias("_last")).join(one)
    return together([by_day.select(F.lit("lines").alias("name"), "day", "value"), row(by_day.agg(F.avg("value").alias("_mean")), "mean_lines", F.col("_mean")), row(last, "line_hours", hours("_last")), row(counted, "pick_hours", hours("_last")), row(counted, "picks_today", F.col("_today")), row(counted, "settled", F.col("_settled"))])


def stuck(picks: DataFrame, result: str, day: str, as_of: Column, days: int = 2) -> DataFrame:
    """Open picks older than `days`."""
    return picks.where(F.col(result).isNull() & (F.datediff(as_of, day) > days)).agg(F.count("*").alias("stuck"))
