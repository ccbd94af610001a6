"""Join operators: opponents, as-of rows, fresh boards, staged matching, absences."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fieldbook.session import saved, written

#: Sides of so many rows at most are sent to every task; beyond it Spark shuffles both sides.
SMALL = 100_000
#: Recent means by player and day (six numbers a row) are sent to every task up to so many.
ON_DAYS = 500_000
#: A block of absences' games is so many times as long as the days that they look back.
BLOCK = 3
#: Names of one gram are dealt into blocks of about so many.
NAMES = 1_000


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """The frame with a broadcast hint if a count shows that it is small; for tables that are cheap to count."""
    return F.broadcast(df) if df.count() <= most else df


def attach_opponent(rows: DataFrame, features: DataFrame, game: str, opponent: str, team: str, columns: Sequence[str], prefix: str = "opp_") -> DataFrame:
    """Features of the opposing team's row of the game, as {prefix}{column}."""
    other = features.select(F.col(game).alias("_g"), F.col(team).alias("_t"), *[F.col(c).alias(prefix + c) for c in columns])
    return rows.join(other, (F.col(game) == F.col("_g")) & (F.col(opponent) == F.col("_t")), "left").drop("_g", "_t")


def both_sides(team_rows: DataFrame, game: str, team: str, columns: Sequence[str], prefix: str = "opp_") -> DataFrame:
    """Each team's row of a game beside each other team's row of it."""
    other = team_rows.select(F.col(game).alias("_g"), F.col(team).alias(prefix + team), *[F.col(c).alias(prefix + c) for c in columns])
    return team_rows.join(other, (F.col(game) == F.col("_g")) & (F.col(team) != F.col(prefix + team))).drop("_g")


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, columns: Sequence[str], inclusive: bool = True) -> DataFrame:
    """Each left row with the columns of the last right row of its keys at or before its time.

    Both sides go through one sort by (keys, time); there is no join that multiplies a hot key's rows.
    Right rows of one key and time must be unique, or the columns' order decides.
    """
    side = 0 if inclusive else 2
    payload = F.struct(F.col(right_time).alias("_at"), *columns)
    a = left.withColumn("_time", F.col(left_time)).withColumn("_side", F.lit(1)).withColumn("_row", F.lit(None).cast(right.select(payload.alias("x")).schema["x"].dataType))
    b = right.select(*keys, F.col(right_time).alias("_time"), F.lit(side).alias("_side"), payload.alias("_row"))
    w = W.partitionBy(*keys).orderBy("_time", "_side", F.col("_row")).rowsBetween(W.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_found", F.last("_row", ignorenulls=True).over(w))
    return both.where(F.col("_side") == 1).select(*left.columns, *[F.col("_found")[c].alias(c) for c in columns], F.col("_found")["_at"].alias(f"as_of_{right_time}"))


def movement(snapshots: DataFrame, keys: Sequence[str], time: str, value: str, now: str | Column, hours: int = 24) -> DataFrame:
    """line_open, line_now and movement of each key over the last hours: aggregates, so that rows combine before the shuffle."""
    at = F.to_timestamp(F.lit(now)) if isinstance(now, str) else now
    inside = snapshots.where((F.col(time) <= at) & (F.col(time) > at - F.expr(f"INTERVAL {hours} HOURS")))
    out = inside.groupBy(*keys).agg(F.min_by(value, time).alias("line_open"), F.max_by(value, time).alias("line_now"))
    return out.withColumn("movement", F.col("line_now") - F.col("line_open"))


def fresh_board(snapshots: DataFrame, group: Sequence[str], keys: Sequence[str], time: str, hours: int = 2) -> DataFrame:
    """The latest row of each key within `hours` of the newest snapshot of its group.

    Groups' newest times are written first: few groups go to every task by their size, instead of all snapshots to a task for each group.
    """
    newest = written(snapshots.groupBy(*group).agg(F.max(time).alias("_newest")))
    near = snapshots.join(newest, list(group)).where(F.col(time) >= F.col("_newest") - F.expr(f"INTERVAL {hours} HOURS")).drop("_newest")
    rest = [c for c in near.columns if c not in {*group, *keys}]
    return near.groupBy(*group, *keys).agg(F.max_by(F.struct(*rest), F.col(time)).alias("_row")).select(*group, *keys, "_row.*")


def main_line(quotes: DataFrame, keys: Sequence[str], line: str, prob: str, low: float = 0.2, high: float = 0.8) -> DataFrame:
    """The quote of each key whose probability is nearest to one half, kept within the band; ties go to the lower line."""
    best = quotes.groupBy(*keys).agg(F.min_by(F.struct(line, prob), F.struct(F.abs(F.col(prob) - 0.5), F.col(line))).alias("_q")).select(*keys, F.col("_q")[line].alias("main_line"), F.col("_q")[prob].alias("main_prob"))
    return best.where((F.col("main_prob") >= low) & (F.col("main_prob") <= high))


def home_away(games: DataFrame, features: DataFrame, game: str, team: str, home: str, away: str, columns: Sequence[str], defaults: Mapping[str, float]) -> DataFrame:
    """A row for each game with home_* and away_* features; teams without a row get the defaults."""
    out = games
    for side, key in (("home", home), ("away", away)):
        own = features.select(F.col(game).alias("_g"), F.col(team).alias("_t"), *[F.col(c).alias(f"{side}_{c}") for c in columns])
        out = out.join(own, (F.col(game) == F.col("_g")) & (F.col(key) == F.col("_t")), "left").drop("_g", "_t")
        out = out.withColumns({f"{side}_{c}": F.coalesce(F.col(f"{side}_{c}"), F.lit(defaults[c])) for c in columns if c in defaults})
    return out


def trigram_matches(left: DataFrame, right: DataFrame, key: str, least: float = 0.8) -> DataFrame:
    """Pairs of names (columns `key`, already normalized) whose trigram sets have a Jaccard similarity above `least`.

    Rare grams first: a pair that is similar enough shares a gram within each side's prefix, so only
    prefixes meet. A gram's names meet in blocks of NAMES by NAMES, and each pair is verified on the full sets where it meets first,
    so no task holds more than a block of names and the matches.
    """

    def grams(df: DataFrame, name: str) -> DataFrame:
        padded = F.concat(F.lit("  "), F.col(name), F.lit(" "))
        g = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))
        return df.select(F.col(key).alias(name)).distinct().withColumn("g", g)

    a, b = grams(left, "name"), grams(right, "match")
    count = a.select(F.explode("g").alias("gram")).unionByName(b.select(F.explode("g").alias("gram"))).groupBy("gram").agg(F.count("*").alias("n"))

    def prefix(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(name, F.explode("g").alias("gram")).join(count, "gram").groupBy(name).agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("s"))
        keep = F.size("s") - F.ceil(F.size("s") * least).cast("int") + 1
        rows = rows.select(name, F.col("s.gram").alias(f"{name}_grams"), keep.alias("_keep"))
        return saved(rows.select(name, f"{name}_grams", F.posexplode(F.slice(f"{name}_grams", F.lit(1), F.col("_keep"))).alias(f"{name}_at", "gram")))

    x, y = prefix(a, "name"), prefix(b, "match")
    blocks = [df.groupBy("gram").agg(F.ceil(F.count("*") / NAMES).cast("int").alias(c)) for df, c in ((x, "_i"), (y, "_j"))]
    blocks = saved(blocks[0].join(blocks[1], "gram"))  # a row for each gram

    def dealt(df: DataFrame, name: str, own: str, other: str) -> DataFrame:
        rows = df.join(blocks, "gram").withColumn(own, F.pmod(F.xxhash64(name), F.col(own)).cast("int"))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

    sizes = F.size("name_grams") + F.size("match_grams")
    similarity = lambda n: n / (sizes - n)
    most = F.least(F.size("name_grams") - F.col("name_at"), F.size("match_grams") - F.col("match_at"))  # no grams before the first common one are shared
    pairs = dealt(x, "name", "_i", "_j").join(dealt(y, "match", "_j", "_i"), ["gram", "_i", "_j"]).where(similarity(most) > least)
    common = F.array_intersect("name_grams", "match_grams")
    return pairs.where((F.element_at(common, 1) == F.col("gram")) & (similarity(F.size(common)) > least)).select("name", "match", similarity(F.size(common)).alias("similarity"))


def staged_match(rows: DataFrame, id_col: str, stages: Sequence[DataFrame]) -> DataFrame:
    """The first stage's match of each row: stages are frames (id_col, match), smaller numbers first; unmatched ids get null."""
    every = None
    for i, s in enumerate(stages):
        one = s.select(id_col, F.lit(i).alias("stage"), "match")
        every = one if every is None else every.unionByName(one)
    best = every.groupBy(id_col).agg(F.min(F.struct("stage", "match")).alias("_best")).select(id_col, "_best.stage", "_best.match")
    return rows.join(best, id_col, "left")


def nearest_game(rows: DataFrame, games: DataFrame, team: str, row_date: str, game_date: str, game: str, row_id: str) -> DataFrame:
    """The game of each row: its team's only one, else the only one of its date, else the only one a day off; else null."""
    own = games.select(F.col(team).alias("_team"), F.col(game_date).alias("_gd"), F.col(game).alias("_g"))
    teams = own.groupBy("_team").agg(F.count("_g").alias("_n0"), F.min("_g").alias("_g0"))
    # games by team and day, each day also under the day before and after it: a row meets one row, not its team's games
    days = own.groupBy("_team", "_gd").agg(F.count("*").alias("_n"), F.min("_g").alias("_g"))
    days = days.select("_team", "_n", "_g", F.explode(F.array(*[F.struct(F.date_add("_gd", i).alias("day"), F.lit(i).alias("off")) for i in (-1, 0, 1)])).alias("_at"))
    same = F.col("_at.off") == 0
    days = days.groupBy("_team", F.col("_at.day").alias("_day")).agg(F.sum(F.when(same, F.col("_n")).otherwise(0)).alias("_n1"), F.min(F.when(same, F.col("_g"))).alias("_g1"), F.sum("_n").alias("_n2"), F.min("_g").alias("_g2"))
    got = rows.withColumns({"_t": F.col(team), "_d": F.col(row_date)}).join(teams, F.col("_t") == F.col("_team"), "left").drop("_team")
    got = got.join(days, (F.col("_t") == F.col("_team")) & (F.col("_d") == F.col("_day")), "left")
    pick = F.when(F.col("_n0") == 1, F.col("_g0")).when(F.col("_n1") == 1, F.col("_g1")).when((F.col("_n1") == 0) & (F.col("_n2") == 1), F.col("_g2"))
    return got.select(*rows.columns, pick.alias("matched_game"))


def changed_rows(current: DataFrame, wanted: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Wanted rows that differ from the current ones, nulls compared as values."""
    old = current.select(key, *[F.col(c).alias(f"old_{c}") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"old_{c}"))
    return wanted.select(key, *columns).join(old, key).where(~same)


def absence_rows(played: DataFrame, *, player: str, team: str, game: str, day: str, minutes: str, stats: Sequence[str], keep: Sequence[str] = (), days: int = 30, least_minutes: float = 15.0, floor: float = 5.0, last: int = 10) -> DataFrame:
    """Each team and game with `_rows`, the players, minutes and columns `keep` of its played rows, and its absent players: see `absences`; without any `absent` is 0 and the rest null.

    Few rows are shuffled, and each of them once: games are written with their rows, a team's rows of a block of BLOCK x `days` days and of the `days`
    before it are one array, and a game meets its own block's array, where its rotation is built without more rows. Only absent
    players become rows, which meet the recent means where they are and are summed there. A player's recent row stands for the days up to the
    player's next one, no more than `days` of them, as nobody is in a rotation longer after a game: so it is found by player and day.
    """
    at = lambda c: F.unix_date(F.col(c).cast("date"))
    block = lambda d: F.floor(d / (BLOCK * days))
    needed = list(dict.fromkeys([player, day, minutes, *stats, *keep]))
    games = written(played.groupBy(team, game).agg(F.min(day).alias("_gd"), F.collect_list(F.struct(*needed)).alias("_of")))
    rows = games.select(team, game, F.explode("_of").alias("_row")).select(team, game, *[F.col("_row")[c].alias(c) for c in needed if c not in (team, game)]).where(F.col(minutes) >= floor)
    means = [*stats, minutes]
    frame = W.partitionBy(player).orderBy(day, game, team).rowsBetween(1 - last, 0)
    recent = rows.select(F.col(player).alias("_p"), F.col(day).cast("date").alias("_pd"), game, team, *[F.avg(c).over(frame).alias(f"_a_{c}") for c in means])
    recent = recent.groupBy("_p", "_pd").agg(F.max_by(F.struct(*[f"_a_{c}" for c in means]), F.struct(game, team)).alias("_r"))
    until = F.date_add("_pd", days)
    until = F.least(until, F.coalesce(F.lead("_pd").over(W.partitionBy("_p").orderBy("_pd")), until))
    recent = recent.withColumn("_until", until).select("_p", F.explode(F.sequence(F.date_add("_pd", 1), F.col("_until"))).alias("_on"), "_r.*")

    own_block, ahead = block(at(day)), block(at(day) + days)
    both = F.array(own_block, F.when(ahead > own_block, ahead))
    hist = rows.where(F.col(team).isNotNull()).select(team, F.explode(both).alias("_b"), F.col(player).alias("p"), at(day).alias("d"), F.col(minutes).cast("double").alias("m")).where("_b is not null")
    hist = hist.repartition(team, "_b").groupBy(team, "_b").agg(F.collect_list(F.struct("p", "d", "m")).alias("_hist"))
    own = F.transform("_of", lambda x: F.struct(*[x[c].alias(c) for c in dict.fromkeys([player, minutes, *keep]) if c not in (team, game)]))
    met = games.select(team, game, "_gd", block(at("_gd")).alias("_b"), own.alias("_rows")).join(hist, [team, "_b"], "left")
    met = met.withColumn("_here", F.transform(F.filter("_rows", lambda x: x[minutes] >= floor), lambda x: x[player]))
    gap = lambda x: F.col("_day") - x["d"]
    met = met.withColumn("_day", at("_gd")).withColumn("_past", F.filter("_hist", lambda x: (gap(x) >= 1) & (gap(x) <= days))).drop("_hist")
    each = F.transform(F.array_distinct(F.transform("_past", lambda x: x["p"])), lambda p: F.struct(p.alias("p"), F.transform(F.filter("_past", lambda x: x["p"].eqNullSafe(p)), lambda x: x["m"]).alias("m")))
    total = lambda c, of: F.aggregate(c, F.lit(0.0), lambda a, x: a + of(x))
    met = met.withColumn("_each", each).withColumn("_rotation", F.filter(F.transform("_each", lambda x: F.struct(x["p"].alias("p"), (total(x["m"], lambda m: m) / F.size(x["m"])).alias("mean"))), lambda x: x["mean"] >= least_minutes))
    met = met.withColumn("_gone", F.filter("_rotation", lambda x: ~F.coalesce(F.array_contains("_here", x["p"]), F.lit(False))))
    met = met.withColumn("_top", F.array_max(F.transform("_gone", lambda x: F.struct(F.round(x["mean"], 9), x["p"].alias("p"))))["p"])
    share = total("_gone", lambda x: x["mean"]) / total("_rotation", lambda x: x["mean"])
    of_game = F.struct("_rows", F.coalesce(F.array_size("_gone"), F.lit(0)).cast("bigint").alias("absent"), F.col("_top").alias("top_absentee"), F.when(F.array_size("_gone") > 0, share).alias("usage_bump"))
    # a game's own columns go with its first row, so that only one of them is held
    gone = met.select(team, "_b", game, F.col("_gd").cast("date").alias("_on"), "_top", of_game.alias("_game"), F.posexplode_outer(F.transform("_gone", lambda x: x["p"])).alias("_i", "_p"))
    gone = gone.select(team, "_b", game, "_on", "_p", F.col("_p").eqNullSafe(F.col("_top")).alias("_is_top"), F.when(F.coalesce("_i", F.lit(0)) == 0, F.col("_game")).alias("_game"), F.col("_i").isNotNull().alias("_any"))
    recent = small(written(recent), ON_DAYS)
    value = lambda c: F.when(F.col("_any"), F.coalesce(f"_a_{c}", F.lit(0.0)))
    out = gone.join(recent, ["_p", "_on"], "left").groupBy(team, "_b", game)
    # the top one's values by maximum: only one row of a game has them
    out = out.agg(F.first("_game", ignorenulls=True).alias("_game"), *[F.max(F.when(F.col("_is_top"), value(c))).alias(f"top_{c}") for c in means], *[F.sum(value(c)).alias(f"freed_{c}") for c in stats])
    return out.select(team, game, "_game._rows", "_game.absent", "_game.top_absentee", *[f"top_{c}" for c in means], *[f"freed_{c}" for c in stats], "_game.usage_bump")


def absences(played: DataFrame, **how) -> DataFrame:
    """For each team and game with absent players: their number, the top one and his recent means, what all leave free, and their share of the rotation's minutes.

    Rotation: players of the team with a mean of `least_minutes` or more over their games of the `days` before, of `floor` minutes
    or more each. Recent means (`top_*`, summed as `freed_*`) are of a player's last games before the day, for any team. Options as of `absence_rows`.
    """
    return absence_rows(played, **how).where("absent > 0").drop("_rows")
