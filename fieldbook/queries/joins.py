"""Join operators (2.4)."""

from pyspark.sql import functions as F

from fieldbook.functions.scalars import is_out, name_key
from fieldbook.operators import identity, joins as j
from fieldbook.operators.blocks import as_of_blocked
from fieldbook.plans import features, ledger as lg, market, models
from fieldbook.queries.base import DENSE, LEDGER, SNAPSHOTS, TEAM, dense_rows, ledger, query, rounded, snapshots, table, team_rows
from fieldbook.queries.windows import prior
from fieldbook.session import fresh_folder
from fieldbook.sources import store, tables

C = F.col


@query("d02_both_sides", f"with t as ({TEAM}) select a.game_id, a.team_id, b.team_id as opp_team_id, b.points as opp_points from t a join t b on a.game_id = b.game_id and a.team_id <> b.team_id")
def d02(s, d):
    return j.both_sides(team_rows(s, d).select("game_id", "team_id", "points"), "game_id", "team_id", ["points"]).select("game_id", "team_id", "opp_team_id", "opp_points")


@query("d03_as_of_line", f"with v as (select * from ({SNAPSHOTS}) where event_type = 'view'), p as (select * from ({SNAPSHOTS}) where event_type = 'purchase') select p.line_id, v.line_value as close_line, v.snapshot_at as as_of_snapshot_at from p asof left join v on p.player_id = v.player_id and p.snapshot_at >= v.snapshot_at")
def d03(s, d):
    rows = snapshots(s, d)
    views, starts = rows.where("event_type = 'view'").withColumnRenamed("line_value", "close_line"), rows.where("event_type = 'purchase'")
    return j.as_of(starts.select("line_id", "player_id", "snapshot_at"), views, ["player_id"], "snapshot_at", "snapshot_at", ["close_line"]).select("line_id", "close_line", "as_of_snapshot_at")


#: Snapshots in which one player holds the lines of four in ten.
HOT = f"select line_id, case when line_id % 10 < 4 then 0 else player_id end as player_id, snapshot_at, line_value, event_type from ({SNAPSHOTS})"


@query("d03_as_of_hot_player", f"with v as (select * from ({HOT}) where event_type = 'view'), p as (select * from ({HOT}) where event_type = 'purchase') select p.line_id, v.line_value as close_line, v.snapshot_at as as_of_snapshot_at from p asof left join v on p.player_id = v.player_id and p.snapshot_at >= v.snapshot_at")
def d03_hot(s, d):
    rows = snapshots(s, d).withColumn("player_id", F.when(C("line_id") % 10 < 4, 0).otherwise(C("player_id")))
    views, starts = rows.where("event_type = 'view'").withColumnRenamed("line_value", "close_line"), rows.where("event_type = 'purchase'")
    return as_of_blocked(starts.select("line_id", "player_id", "snapshot_at"), views, ["player_id"], "snapshot_at", "snapshot_at", ["close_line"]).select("line_id", "close_line", "as_of_snapshot_at")


@query("d04_line_movement", f"with t as (select *, max(snapshot_at) over () as now from ({SNAPSHOTS})) select player_id, min_by(line_value, snapshot_at) as line_open, max_by(line_value, snapshot_at) as line_now, round(max_by(line_value, snapshot_at) - min_by(line_value, snapshot_at), 6) as movement from t where snapshot_at > now - interval 24 hours group by 1")
def d04(s, d):
    rows = snapshots(s, d)
    now = rows.agg(F.max("snapshot_at").alias("now"))
    return rounded(j.movement(rows.join(F.broadcast(now)), ["player_id"], "snapshot_at", "line_value", C("now")))


@query("d05_fresh_board", f"with t as (select *, max(snapshot_at) over (partition by event_type) as newest from ({SNAPSHOTS})), r as (select *, row_number() over (partition by event_type, player_id order by snapshot_at desc) as n from t where snapshot_at >= newest - interval 48 hours) select event_type, player_id, line_id, line_value, snapshot_at from r where n = 1")
def d05(s, d):
    return j.fresh_board(snapshots(s, d), ["event_type"], ["player_id"], "snapshot_at", hours=48).select("event_type", "player_id", "line_id", "line_value", "snapshot_at")


@query("d06_player_identity", """
with a as (select s_suppkey as row_id, lower(replace(replace(s_name, '#', ' '), '  ', ' ')) as name from supplier), b as (select s_suppkey as match, case when s_suppkey % 3 = 0 then lower(replace(s_name, '#', ' ')) when s_suppkey % 3 = 1 then lower(replace(s_name, '#', ' ')) || ' x' end as name from supplier),
 g1 as (select distinct row_id, name, substr('  ' || name || ' ', i, 3) as g from (select row_id, name, unnest(range(1, length(name) + 2)) as i from a)), g2 as (select distinct match, name, substr('  ' || name || ' ', i, 3) as g from (select match, name, unnest(range(1, length(name) + 2)) as i from b where name is not null)),
 n1 as (select name, count(distinct g) as n from g1 group by 1), n2 as (select name, count(distinct g) as n from g2 group by 1),
 sim as (select g1.name as x, g2.name as y, count(distinct g1.g) as k from g1 join g2 using (g) group by 1, 2), near as (select x, y from sim join n1 on n1.name = x join n2 on n2.name = y where k / cast(n1.n + n2.n - k as double) > 0.8),
 m as (select row_id, 0 as stage, match from a join b using (name) union all select row_id, 1, match from a join near on near.x = a.name join b on b.name = near.y)
select row_id, cast(min(stage) as bigint) as stage, (min((stage, match)))[2] as match from a left join m using (row_id) group by 1""".replace("(min((stage, match)))[2]", "arg_min(match, (stage, match))"))
def d06(s, d):
    a = table(s, d, "supplier").select(C("s_suppkey").alias("row_id"), name_key(C("s_name")).alias("name"))
    b = table(s, d, "supplier").select(C("s_suppkey").alias("match_id"), F.when(C("s_suppkey") % 3 == 0, name_key(C("s_name"))).when(C("s_suppkey") % 3 == 1, F.concat(name_key(C("s_name")), F.lit(" x"))).alias("name")).where("name is not null")
    exact = a.join(b, "name").select("row_id", C("match_id").alias("match"))
    near = j.trigram_matches(a, b, "name")
    fuzzy = a.join(near.select("name", C("match").alias("other")), "name").join(b.select(C("name").alias("other"), "match_id"), "other").select("row_id", C("match_id").alias("match"))
    return rounded(j.staged_match(a.select("row_id"), "row_id", [exact, fuzzy]))


@query("d07_game_identity", """
with r as (select event_id as row_id, user_id % 40 as team, cast(ts as date) as d from events where event_type = 'view'), g as (select event_id as game, user_id % 40 as team, cast(ts as date) as gd from events where event_type = 'purchase'),
 c as (select row_id, count(game) as n0, min(game) as g0, count(*) filter (gd = d) as n1, min(game) filter (gd = d) as g1, count(*) filter (abs(datediff('day', gd, d)) <= 1) as n2, min(game) filter (abs(datediff('day', gd, d)) <= 1) as g2 from r left join g using (team) group by 1)
select row_id, case when n0 = 1 then g0 when n1 = 1 then g1 when n1 = 0 and n2 = 1 then g2 end as matched_game from c""")
def d07(s, d):
    e = table(s, d, "events")
    rows = e.where("event_type = 'view'").select(C("event_id").alias("row_id"), (C("user_id") % 40).alias("team"), C("ts").cast("date").alias("d"))
    games = e.where("event_type = 'purchase'").select(C("event_id").alias("game"), (C("user_id") % 40).alias("team"), C("ts").cast("date").alias("gd"))
    return j.nearest_game(rows, games, "team", "d", "gd", "game", "row_id").select("row_id", "matched_game")


@query("d08_placeholder_games", f"with p as (select pick_id, player_id, decided from ({LEDGER})), g as (select o_orderkey as game_id, o_custkey % 10 as player_id, cast(o_orderdate as date) as gd from orders where o_orderstatus = 'F'), r as (select pick_id, game_id, row_number() over (partition by pick_id order by gd, game_id) as n from p join g using (player_id) where abs(datediff('day', gd, decided)) <= 1) select pick_id, game_id from r where n = 1")
def d08(s, d):
    picks = ledger(s, d).select("pick_id", "player_id", "decided")
    games = table(s, d, "orders").where("o_orderstatus = 'F'").select(C("o_orderkey").alias("game_id"), (C("o_custkey") % 10).alias("player_id"), C("o_orderdate").cast("date").alias("gd"))
    # the first game of a player's day, also under the day before and after it: the join is by equality and meets one row
    first = games.groupBy("player_id", "gd").agg(F.min("game_id").alias("game_id"))
    near = F.explode(F.array(F.date_sub("gd", 1), C("gd"), F.date_add("gd", 1)))
    first = first.withColumn("decided", near).groupBy("player_id", "decided").agg(F.min_by("game_id", F.struct("gd", "game_id")).alias("game_id"))
    return picks.join(first, ["player_id", "decided"]).select("pick_id", "game_id")


@query("d09_repoint_children", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_suppkey % 2 = 1 then l_suppkey - 1 else l_suppkey end as real_id from lineitem")
def d09(s, d):
    mapping = table(s, d, "supplier").where("s_suppkey % 2 = 1").select(C("s_suppkey").alias("l_suppkey"), (C("s_suppkey") - 1).alias("to_id"))
    rows = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(mapping, "l_suppkey", "left")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.coalesce("to_id", "l_suppkey").alias("real_id"))


#: Records: customers under the ids and names of suppliers, which are the players; some only alike, some new.
RECORDS = "select c_custkey as row_id, 'x' || c_nationkey % 2 as sport, case c_custkey % 9 when 0 then 'pp_' || c_custkey % 100 when 8 then null else 'c' || c_custkey // 9 end as external_id, case c_custkey % 9 when 1 then 'supplier ' || lpad(cast(c_custkey % 100 as varchar), 9, '0') when 2 then 'supplier ' || lpad(cast(c_custkey % 100 as varchar), 9, '0') || ' x' when 3 then 'z ' || lpad(cast(c_custkey % 100 as varchar), 9, '0') when 8 then case when c_custkey % 2 = 0 then 'nobody ' || c_custkey % 4 end else 'customer ' || c_custkey // 9 end as name from customer"
PLAYERS = "select s_suppkey as player_id, 'x' || s_nationkey % 2 as sport, case when s_suppkey % 3 = 0 then 'pp_' else 's' end || s_suppkey as external_id, lower(replace(s_name, '#', ' ')) as name from supplier"
GRAMS = "select distinct name, substr('  ' || name || ' ', i, 3) as g from (select name, unnest(range(1, length(name) + 2)) as i from {})"


@query("d06_five_stages", f"""
with r as ({RECORDS}), p as ({PLAYERS}), s1 as (select row_id, min(player_id) as id from r join p on p.sport = r.sport and p.external_id = r.external_id group by 1), r2 as (select * from r anti join s1 using (row_id)),
 s2 as (select row_id, min(player_id) as id from r2 join p on p.sport = r2.sport and p.name = r2.name group by 1), r3 as (select * from r2 anti join s2 using (row_id)), n3 as (select distinct name from r3 where name is not null),
 g1 as ({GRAMS.format('n3')}), g2 as ({GRAMS.format('(select distinct name from p)')}), k1 as (select name, count(*) as n from g1 group by 1), k2 as (select name, count(*) as n from g2 group by 1), both_ as (select g1.name as x, g2.name as y, count(*) as k from g1 join g2 using (g) group by 1, 2),
 sim as (select x, y, k / cast(k1.n + k2.n - k as double) as s from both_ join k1 on k1.name = x join k2 on k2.name = y where k / cast(k1.n + k2.n - k as double) > 0.8),
 s3 as (select row_id, arg_min(player_id, (-s, player_id)) as id from r3 join sim on x = r3.name join p on p.sport = r3.sport and p.name = y group by 1), r4 as (select * from r3 anti join s3 using (row_id)),
 alone as (select sport, string_split(name, ' ')[-1] as last, min(player_id) as id from p where external_id not like 'pp%' group by 1, 2 having count(*) = 1), s4 as (select row_id, id from r4 join alone on alone.sport = r4.sport and last = string_split(name, ' ')[-1]), r5 as (select * from r4 anti join s4 using (row_id)),
 e5 as (select row_id, r5.sport || '|' || coalesce(external_id, 'name ' || name) as e from r5), n5 as (select e, (select max(player_id) from p) + row_number() over (order by substr(md5(e), 1, 3), e) as id from (select distinct e from e5 where e is not null))
select row_id, 'external' as stage, id as player_id from s1 union all select row_id, 'name', id from s2 union all select row_id, 'similar', id from s3 union all select row_id, 'last_name', id from s4 union all select row_id, case when id is not null then 'new' end, id from e5 left join n5 using (e)""")
def d06_stages(s, d):
    c, sup = table(s, d, "customer"), table(s, d, "supplier")
    k, padded = C("c_custkey") % 9, F.lpad((C("c_custkey") % 100).cast("string"), 9, "0")
    external = F.when(k == 0, F.concat(F.lit("pp_"), C("c_custkey") % 100)).when(k != 8, F.concat(F.lit("c"), F.floor(C("c_custkey") / 9)))
    name = F.when(k == 1, F.concat(F.lit("Supplier#"), padded)).when(k == 2, F.concat(F.lit("Supplier#"), padded, F.lit(" X"))).when(k == 3, F.concat(F.lit("Z. "), padded)).when(k == 8, F.when(C("c_custkey") % 2 == 0, F.concat(F.lit("Nobody "), C("c_custkey") % 4))).otherwise(F.concat(F.lit("Customer "), F.floor(C("c_custkey") / 9)))
    records = c.select(C("c_custkey").alias("row_id"), F.concat(F.lit("x"), C("c_nationkey") % 2).alias("sport"), external.alias("external_id"), name.alias("name"))
    players = sup.select(C("s_suppkey").alias("player_id"), F.concat(F.lit("x"), C("s_nationkey") % 2).alias("sport"), F.concat(F.when(C("s_suppkey") % 3 == 0, "pp_").otherwise("s"), C("s_suppkey")).alias("external_id"), C("s_name").alias("name"))
    return identity.resolve(records, players).select("row_id", "stage", "player_id")


#: Suppliers in fours: the first is real, the second a placeholder of its name, the third was moved to the second, the fourth to the third.
REAL = "case when {0} % 4 = 0 or {0} > (select max(s_suppkey) from supplier) then {0} else {0} - {0} % 4 end"


@query("d09_merged_placeholders", f"select 'lines' as child, (l_orderkey * 10 + l_linenumber) * 10000 + l_suppkey as row_id, {REAL.format('l_suppkey')} as player_id from lineitem union all select 'customers', c_custkey, {REAL.format('c_custkey')} from customer union all select 'parts', p_partkey, {REAL.format('p_partkey')} from part")
def d09_merged(s, d):
    sup = table(s, d, "supplier").select(C("s_suppkey").alias("player_id"), F.lit("x").alias("sport"), F.concat(F.when(C("s_suppkey") % 4 == 0, "s").otherwise("pp_"), C("s_suppkey")).alias("external_id"), F.concat(F.lit("n"), F.when(C("s_suppkey") % 4 > 1, -C("s_suppkey")).otherwise(F.floor(C("s_suppkey") / 4))).alias("name"))
    moved = sup.where("player_id % 4 > 1").select(C("player_id").alias("from_id"), (C("player_id") - 1).alias("to_id"))
    mapping = identity.closed(identity.placeholder_merges(sup).unionByName(moved))
    lines = table(s, d, "lineitem").select(((C("l_orderkey") * 10 + C("l_linenumber")) * 10000 + C("l_suppkey")).alias("row_id"), C("l_suppkey").alias("player_id"))
    children = {"lines": (lines, "player_id")} | {n: (table(s, d, t).select(C(k).alias("row_id"), C(k).alias("player_id")), "player_id") for n, t, k in (("customers", "customer", "c_custkey"), ("parts", "part", "p_partkey"))}
    out = [rows.select(F.lit(n).alias("child"), "row_id", "player_id") for n, rows in identity.repointed(children, mapping).items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("d10_changed_rows", "select c_custkey, c_nationkey as nation, n as old_nation from (select c_custkey, c_nationkey, case when c_custkey % 5 = 0 then null when c_custkey % 5 = 1 then c_nationkey + 1 else c_nationkey end as n from customer) where n is distinct from c_nationkey".replace("c_nationkey as nation, n as old_nation", "cast(c_nationkey as bigint) as nation, cast(n as bigint) as old_nation"))
def d10(s, d):
    c = table(s, d, "customer").select("c_custkey", C("c_nationkey").cast("bigint").alias("nation"))
    old = c.withColumn("nation", F.when(C("c_custkey") % 5 == 0, None).when(C("c_custkey") % 5 == 1, C("nation") + 1).otherwise(C("nation")))
    return j.changed_rows(old, c, "c_custkey", ["nation"]).select("c_custkey", "nation", "old_nation")


@query("d11_latest_injury", "with t as (select user_id, event_type, ts, max(ts) over () as now from events), r as (select user_id, event_type, row_number() over (partition by user_id order by ts desc) as n from t where ts > now - interval 30 hours) select user_id from r where n = 1 and event_type = 'error'")
def d11(s, d):
    from fieldbook.operators.windows import latest_per_key

    e = table(s, d, "events")
    now = e.agg(F.max("ts").alias("now"))
    recent = e.join(F.broadcast(now)).where(C("ts") > C("now") - F.expr("INTERVAL 30 HOURS")).select("user_id", "ts", F.when(C("event_type") == "error", "Out").otherwise("Active").alias("status"))
    return latest_per_key(recent, ["user_id"], ["ts"]).where(is_out(C("status"))).select("user_id")


QUOTES = f"select player_id, stat_type, cast(quantity as double) as line, round(avg(market_prob), 6) as over_prob from ({LEDGER}) group by 1, 2, 3"


def quotes(s, d):
    return ledger(s, d).groupBy("player_id", "stat_type", C("quantity").alias("line")).agg(F.round(F.avg("market_prob"), 6).alias("over_prob"))


@query("d12_main_line", f"with t as ({QUOTES}), r as (select *, row_number() over (partition by player_id, stat_type order by abs(over_prob - 0.5::double), line) as n from t) select player_id, stat_type, line as main_line, over_prob as main_prob from r where n = 1 and over_prob between 0.2 and 0.8")
def d12(s, d):
    return j.main_line(quotes(s, d), ["player_id", "stat_type"], "line", "over_prob")


@query("d13_home_away", f"with t as ({TEAM}), f as (select game_id, team_id, {prior('avg(points)', 5, 'team_id', 'game_date, game_id')} as a from t), e as (select game_id, min(team_id) as h, max(team_id) as w, arg_min(coalesce(a, 25), team_id) as hf, arg_max(coalesce(a, 25), team_id) as wf from f group by 1) select game_id, round(hf, 6) as home_form, round(wf, 6) as away_form from e where h <> w")
def d13(s, d):
    from fieldbook.operators.windows import prior_means

    f = prior_means(team_rows(s, d), ["team_id"], ["game_date", "game_id"], ["points"], (5,), fill=None).withColumnRenamed("last_5_avg_points", "form")
    games = team_rows(s, d).groupBy("game_id").agg(F.min("team_id").alias("h"), F.max("team_id").alias("a")).where("h <> a")
    return rounded(j.home_away(games, f, "game_id", "team_id", "h", "a", ["form"], {"form": 25.0}).select("game_id", "home_form", "away_form"))


@query("d14_absences", f"""
with p as (select team_id, game_id, opponent_id as player_id, min(game_date) as game_date, 4.0::double * sum(minutes) as minutes, sum(points) as shots, cast(sum(turnovers) as double) as free_throws, cast(sum(assists) as double) as assists from ({DENSE}) group by 1, 2, 3),
 a as (select * from p where minutes >= 5), g as (select team_id, game_id, min(game_date) as gd from p group by 1, 2), day as (select distinct team_id, gd from g), h as (select team_id, player_id, game_date, sum(minutes) as m, count(*) as n from a group by 1, 2, 3),
 rot as (select d.team_id, d.gd, h.player_id, sum(m) / sum(n) as mean from day d join h on h.team_id = d.team_id and h.game_date < d.gd and h.game_date >= d.gd - 30 group by 1, 2, 3 having sum(m) / sum(n) >= 15),
 tot as (select team_id, gd, sum(mean) as total from rot group by 1, 2), gone as (select g.game_id, rot.*, total from g join rot using (team_id, gd) join tot using (team_id, gd) left join a on a.team_id = rot.team_id and a.game_id = g.game_id and a.player_id = rot.player_id where a.player_id is null),
 r as (select player_id, game_date, game_id, team_id, avg(shots) over w as shots, avg(free_throws) over w as free_throws, avg(assists) over w as assists, avg(minutes) over w as minutes from a window w as (partition by player_id order by game_date, game_id, team_id rows between 9 preceding and current row)),
 r1 as (select player_id, game_date, unnest(arg_max({{'shots': shots, 'free_throws': free_throws, 'assists': assists, 'minutes': minutes}}, (game_id, team_id))) from r group by 1, 2),
 x as (select gone.*, coalesce(shots, 0) as shots, coalesce(free_throws, 0) as free_throws, coalesce(assists, 0) as assists, coalesce(minutes, 0) as minutes from gone asof left join r1 on r1.player_id = gone.player_id and gone.gd > r1.game_date),
 t as (select team_id, game_id, count(*) as absent, arg_max({{'top_absentee': player_id, 'top_shots': shots, 'top_free_throws': free_throws, 'top_assists': assists, 'top_minutes': minutes}}, (round(mean, 9), player_id)) as top, sum(shots) as freed_shots, sum(free_throws) as freed_free_throws, sum(assists) as freed_assists, sum(mean) / max(total) as usage_bump from x group by 1, 2)
select p.team_id, p.game_id, p.player_id, case when p.minutes >= 5 then coalesce(absent, 0) else 0 end as absent, case when p.minutes >= 5 then top.top_absentee end as top_absentee, {', '.join(f"round(case when p.minutes >= 5 then coalesce({c}, 0) else 0 end, 6) as {c.split('.')[-1]}" for c in ('top.top_shots', 'top.top_free_throws', 'top.top_assists', 'top.top_minutes', 'freed_shots', 'freed_free_throws', 'freed_assists', 'usage_bump'))} from p left join t using (team_id, game_id)""")
def d14(s, d):
    # dealt by game: a game's rows and their list come from one shuffle
    p = dense_rows(s, d).repartition("team_id", "game_id").groupBy("team_id", "game_id", C("opponent_id").alias("player_id")).agg(F.min("game_date").alias("game_date"), (4 * F.sum("minutes")).cast("double").alias("minutes"), F.sum("points").alias("shots"), F.sum("turnovers").cast("double").alias("free_throws"), F.sum("assists").cast("double").alias("assists"))
    out = features.teammate_absence(p, keep=["team_id", "game_id", "player_id"])
    return rounded(out.select("team_id", "game_id", "player_id", "absent", "top_absentee", "top_shots", "top_free_throws", "top_assists", "top_minutes", "freed_shots", "freed_free_throws", "freed_assists", "usage_bump"))


@query("d15_market_probability", f"with m as (select game_id, player_id, stat_type, avg(market_prob) as p from ({LEDGER}) where line_id % 3 = 0 group by 1, 2, 3) select pick_id, round(coalesce(p, 0.5), 6) as market from ({LEDGER}) left join m using (game_id, player_id, stat_type)")
def d15(s, d):
    keys = ["game_id", "player_id", "stat_type"]
    m = ledger(s, d).where("line_id % 3 = 0").groupBy(*keys).agg(F.avg("market_prob").alias("p"))
    return rounded(ledger(s, d).join(m, keys, "left").select("pick_id", F.coalesce("p", F.lit(0.5)).alias("market")))


@query("d16_season_lookup", "with t as (select o_orderkey, cast(year(o_orderdate) as varchar) || '-' || substr(cast(year(o_orderdate) + 1 as varchar), 3, 2) as k from orders), l as (select k, count(*) as n from t group by 1) select o_orderkey, k as season_key, n as season_orders from t join l using (k)")
def d16(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    t = o.select("o_orderkey", features.season_key(F.concat_ws("-", "y", F.when(C("o_orderkey") % 2 == 0, (C("y") + 1).cast("string")).otherwise(F.substring((C("y") + 1).cast("string"), 3, 2)))).alias("season_key"))
    return t.join(t.groupBy("season_key").agg(F.count("*").alias("season_orders")), "season_key")


#: Orders as player rows: the customer plays for a team of fifty; seasons as a year or as two, urgent orders in the play-offs. Play types by team and by player come from the lines.
PLAYED = "select o_orderkey, o_custkey % 50 as team_ext, o_custkey as player_ext, cast(year(o_orderdate) + 10 as varchar) || case when o_orderkey % 2 = 0 then '' else '-' || substr(cast(year(o_orderdate) + 11 as varchar), 3, 2) end as season, case o_orderpriority when '1-URGENT' then 'playoffs' when '2-HIGH' then 'play_in' else 'regular' end as season_type from orders"
TYPES = "select {} as id, year(l_shipdate) as y, case when l_returnflag = 'R' then 'Playoffs' else 'Regular Season' end as part, round(sum(l_discount), 6) as share from lineitem group by 1, 2, 3"


@query("d16_play_types", f"with r as ({PLAYED}), k as (select *, cast(substr(season, 1, 4) as bigint) - 10 as y, case when season_type in ('playoffs', 'play_in') then 'Playoffs' else 'Regular Season' end as part from r), t as ({TYPES.format('l_suppkey % 50')}), p as ({TYPES.format('l_partkey')}) select o_orderkey, t.share as team_share, p.share as player_share from k left join t on t.id = team_ext and t.y = k.y and t.part = k.part left join p on p.id = player_ext and p.y = k.y and p.part = k.part where t.share is not null or p.share is not null")
def d16_types(s, d):
    year = F.year("o_orderdate") + 10  # in this century, as the seasons' names ask
    season = F.when(C("o_orderkey") % 2 == 0, year.cast("string")).otherwise(F.concat_ws("-", year.cast("string"), F.substring((year + 1).cast("string"), 3, 2)))
    kind = F.when(C("o_orderpriority") == "1-URGENT", "playoffs").when(C("o_orderpriority") == "2-HIGH", "play_in").otherwise("regular")
    rows = table(s, d, "orders").select("o_orderkey", (C("o_custkey") % 50).alias("team_ext"), C("o_custkey").alias("player_ext"), season.alias("season"), kind.alias("season_type"))
    line, ship = table(s, d, "lineitem"), F.year("l_shipdate") + 10
    part = F.when(C("l_returnflag") == "R", "Playoffs").otherwise("Regular Season")
    types = lambda key, name, share: line.groupBy(key.alias(name), F.concat_ws("-", ship.cast("string"), F.substring((ship + 1).cast("string"), 3, 2)).alias("season"), part.alias("part")).agg(F.round(F.sum("l_discount"), 6).alias(share))
    out = features.play_types(rows, types(C("l_suppkey") % 50, "team_ext", "team_share"), types(C("l_partkey"), "player_ext", "player_share"))
    return out.select("o_orderkey", "team_share", "player_share")


@query("d17_weather", "select o_orderkey, coalesce(s_acctbal, 0) as wind from orders left join supplier on o_custkey = s_suppkey")
def d17(s, d):
    wx = table(s, d, "supplier").select(C("s_suppkey").alias("o_custkey"), "s_acctbal")
    return table(s, d, "orders").join(j.small(wx), "o_custkey", "left").select("o_orderkey", F.coalesce("s_acctbal", F.lit(0.0)).alias("wind"))


LEGS = f"select pick_id as leg_id, game_id, player_id as team_id, model_prob, direction from ({LEDGER})"


@query("d18_stacks", f"with t as ({LEGS}) select a.game_id, a.leg_id, b.leg_id as other_leg, round(least(0.99, a.model_prob * b.model_prob + 0.06), 6) as joint from t a join t b on a.game_id = b.game_id and a.team_id <> b.team_id and a.direction = 'over' and b.direction = 'under'")
def d18(s, d):
    legs = ledger(s, d).select(C("pick_id").alias("leg_id"), "game_id", C("player_id").alias("team_id"), "model_prob", "direction")
    return rounded(market.stacks(legs.where("direction = 'over'"), legs.where("direction = 'under'")))


@query("d19_predictions_and_actuals", f"select pick_id, quantity as actual, round(model_prob * 30, 6) as predicted from ({LEDGER}) join events on game_id = event_id where ts < timestamp '2024-01-20' and json_extract_string(props, '$.k') similar to '[0-9.]+'")
def d19(s, d):
    e = table(s, d, "events").where("ts < timestamp '2024-01-20'").select(C("event_id").alias("game_id"), "props")
    t = ledger(s, d).join(e, "game_id").where(F.get_json_object("props", "$.k").rlike("^[0-9.]+$"))
    return rounded(t.select("pick_id", C("quantity").alias("actual"), (C("model_prob") * 30).alias("predicted")))


#: Quotes on three stats and a combined one; box scores by order and supplier, whose stats are sums of the lines.
BOXES = "select l_orderkey as game_id, l_suppkey as player_id, 3 * count(*) + min(l_linenumber) + 6 as minutes, sum(l_quantity) as points, sum(case when l_returnflag <> 'N' then l_tax * 100 end) as rebounds, sum(l_discount * 100) as assists from lineitem group by 1, 2"


@query("d20_backtest_rows", f"""with b as ({BOXES}), o as (select game_id, player_id, ['points', 'rebounds', 'assists', 'pts_rebs', 'turnovers'][line_id % 5 + 1] as stat_type, quantity as line_value, case when line_id % 11 <> 0 then market_prob end as over_prob, 'b' || line_id % 3 as book from ({LEDGER}))
select cast(o_orderdate as date) as game_date, game_id, player_id, s_name as player_name, stat_type, line_value, over_prob, book, minutes, round(case stat_type when 'points' then points when 'rebounds' then rebounds when 'assists' then assists when 'pts_rebs' then points + rebounds end, 6) as actual from o join b using (game_id, player_id) join orders on o_orderkey = game_id join supplier on s_suppkey = player_id where o_orderstatus = 'F' and o_orderdate >= date '1997-01-01' and minutes >= 10 and over_prob is not null""")
def d20(s, d):
    line = table(s, d, "lineitem")
    box = line.groupBy(C("l_orderkey").alias("game_id"), C("l_suppkey").alias("player_id")).agg((3 * F.count("*") + F.min("l_linenumber") + 6).alias("minutes"), F.sum("l_quantity").alias("p"), F.sum(F.when(C("l_returnflag") != "N", C("l_tax") * 100)).alias("r"), F.sum(C("l_discount") * 100).alias("a"))
    box = box.select("game_id", "player_id", "minutes", F.create_map(F.lit("points"), C("p"), F.lit("rebounds"), C("r"), F.lit("assists"), C("a")).alias("stats"))
    stat = F.element_at(F.array(*map(F.lit, ("points", "rebounds", "assists", "pts_rebs", "turnovers"))), (C("line_id") % 5 + 1).cast("int"))
    odds = ledger(s, d).select("game_id", "player_id", stat.alias("stat_type"), C("quantity").alias("line_value"), F.when(C("line_id") % 11 != 0, C("market_prob")).alias("over_prob"), F.concat(F.lit("b"), C("line_id") % 3).alias("book"))
    games = table(s, d, "orders").select(C("o_orderkey").alias("game_id"), C("o_orderdate").cast("date").alias("game_date"), F.when(C("o_orderstatus") == "F", "final").otherwise("live").alias("status"))
    players = table(s, d, "supplier").select(C("s_suppkey").alias("player_id"), C("s_name").alias("player_name"))
    return rounded(models.backtest_rows(odds, games, box, players, F.lit("1997-01-01").cast("date")))


@query("d21_semi_and_anti", "select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey) and not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')")
def d21(s, d):
    line = table(s, d, "lineitem").select(C("l_orderkey").alias("o_orderkey"), "l_returnflag")
    o = table(s, d, "orders").select("o_orderkey")
    return o.join(line, "o_orderkey", "left_semi").join(line.where("l_returnflag = 'R'"), "o_orderkey", "left_anti")


@query("d22_confirm_starters", f"select pick_id, case when o_orderkey is null then 'void' when o_custkey % 10 <> player_id % 10 then 'void' else 'confirmed' end as status from ({LEDGER}) left join (select * from orders where o_orderstatus <> 'P') on o_orderkey = game_id where stat_type = 'F'")
def d22(s, d):
    o = table(s, d, "orders").where("o_orderstatus <> 'P'").select(C("o_orderkey").alias("game_id"), (C("o_custkey") % 10).alias("starter"))
    t = ledger(s, d).where("stat_type = 'F'").join(o, "game_id", "left")
    return t.select("pick_id", F.when(C("starter").isNull() | (C("starter") != C("player_id") % 10), "void").otherwise("confirmed").alias("status"))


# --- sources and sinks that are joins --------------------------------------------------------------


@query("a01_facts_and_games", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey, l_quantity from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus = 'F'")
def a01(s, d):
    facts = table(s, d, "lineitem").select(C("l_orderkey").alias("game_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    games = table(s, d, "orders").select(C("o_orderkey").alias("game_id"), "o_custkey", C("o_orderstatus").alias("sport_code"))
    return tables.player_games(facts, games, "F").select(C("game_id").alias("l_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "o_custkey", "l_quantity")


@query("a06_upsert", "with n as (select o_orderkey, o_totalprice + 1 as o_totalprice, o_orderstatus, 1 as v from orders where o_orderkey % 4 = 0), t as (select o_orderkey, o_totalprice, o_orderstatus, 0 as v from orders where o_orderkey % 8 <> 0 union all select * from n), r as (select *, row_number() over (partition by o_orderkey order by v desc) as k from t) select o_orderkey, o_totalprice, o_orderstatus from r where k = 1")
def a06(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    old = o.where("o_orderkey % 8 <> 0").withColumn("v", F.lit(0))
    new = o.where("o_orderkey % 4 = 0").withColumn("o_totalprice", C("o_totalprice") + 1).withColumn("v", F.lit(1))
    return tables.upsert(old, new, ["o_orderkey"], "v").drop("v")


#: Orders by month, with new prices in every fourth order of two months, and a new month.
MONTHS = "strftime(o_orderdate, '%Y-%m')"


@query("a06_upsert_partitions", f"with o as (select o_orderkey, {MONTHS} as month, o_totalprice, o_orderstatus from orders), n as (select max(month) as last from o) select o_orderkey, month, case when month in ('1996-03', last) and (month = last or o_orderkey % 4 = 0) then o_totalprice + 1 else o_totalprice end as o_totalprice, o_orderstatus from o, n")
def a06_partitions(s, d):
    path, keys = fresh_folder(s, "orders"), ["month", "o_orderkey"]
    o = table(s, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_totalprice", "o_orderstatus")
    last = F.broadcast(o.agg(F.max("month").alias("last")))
    store.upsert_partitions(o.join(last).where("month < last").drop("last").withColumn("v", F.lit(0)), path, keys, "v", ["month"])
    new = o.join(last).where("month = last or (month = '1996-03' and o_orderkey % 4 = 0)").drop("last").withColumns({"o_totalprice": C("o_totalprice") + 1, "v": F.lit(1)})
    store.upsert_partitions(new, path, keys, "v", ["month"])
    return s.read.schema(new.schema).parquet(path).select("o_orderkey", "month", "o_totalprice", "o_orderstatus")


@query("a06_upsert_columns", "with n as (select o_orderkey, o_totalprice + 1 as p, 'X' as st from orders where o_orderkey % 4 = 0), o as (select o_orderkey, o_totalprice as p, o_orderstatus as st from orders where o_orderkey % 8 <> 0) select coalesce(o.o_orderkey, n.o_orderkey) as o_orderkey, coalesce(n.p, o.p) as o_totalprice, coalesce(o.st, n.st) as o_orderstatus from o full join n on o.o_orderkey = n.o_orderkey")
def a06_columns(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus").withColumn("v", F.lit(0))
    new = o.where("o_orderkey % 4 = 0").withColumns({"o_totalprice": C("o_totalprice") + 1, "o_orderstatus": F.lit("X"), "v": F.lit(1)})
    return tables.upsert(o.where("o_orderkey % 8 <> 0"), new, ["o_orderkey"], "v", ["o_totalprice", "v"]).drop("v")


@query("a07_feature_patch", "with m as (select max(cast(o_orderdate as date)) as now from orders) select o_orderkey, case when o_orderkey % 3 = 0 and datediff('day', cast(o_orderdate as date), now) <= 400 then 1.0::double else o_totalprice end as a, case when o_orderkey % 3 = 0 and datediff('day', cast(o_orderdate as date), now) <= 400 then 0.0::double end as b from orders, m")
def a07(s, d):
    o = table(s, d, "orders").select("o_orderkey", C("o_orderdate").cast("date").alias("day"), F.create_map(F.lit("a"), C("o_totalprice")).alias("features"))
    patch = o.where("o_orderkey % 3 = 0").select("o_orderkey", F.create_map(F.lit("a"), F.lit(1.0), F.lit("b"), F.lit(float("nan"))).alias("features"))
    now = o.agg(F.max("day").alias("now"))
    got = tables.patch_features(o.join(F.broadcast(now)), patch, "o_orderkey", "day", C("now"), recent_days=400)
    return got.select("o_orderkey", F.try_element_at("features", F.lit("a")).alias("a"), F.try_element_at("features", F.lit("b")).alias("b"))


@query("a08_prune", f"with m as (select max(ts) as now from events), t as (select case when datediff('day', cast(ts as date), cast(now as date)) <= 10 then 'recent' when event_id in (select line_id from ({LEDGER})) then 'referenced' else 'dropped' end as what from events, m) select what, count(*) as n from t group by 1")
def a08(s, d):
    e = table(s, d, "events").select(C("event_id").alias("line_id"), "ts")
    now = e.agg(F.max("ts").alias("now"))
    return tables.prune_counts(e.join(F.broadcast(now)), ledger(s, d), "line_id", "ts", C("now"), 10)


@query("a08_prune_rows", f"with m as (select max(ts) as now from events) select event_id as line_id from events, m where datediff('day', cast(ts as date), cast(now as date)) <= 10 or event_id in (select line_id from ({LEDGER}))")
def a08_rows(s, d):
    e = table(s, d, "events").select(C("event_id").alias("line_id"), "ts")
    now = e.agg(F.max("ts").alias("now"))
    return tables.prune(e.join(F.broadcast(now)), ledger(s, d), "line_id", "ts", C("now"), 10).select("line_id")


@query("a09_unprocessed_games", "select o_orderkey from orders where o_orderstatus = 'F' and o_orderkey not in (select l_orderkey from lineitem)")
def a09(s, d):
    games = table(s, d, "orders").select(C("o_orderkey").alias("g"), "o_orderstatus")
    return tables.unprocessed(games, table(s, d, "lineitem").select(C("l_orderkey").alias("g")), "g", C("o_orderstatus") == "F").select(C("g").alias("o_orderkey"))


@query("i02_time_split", "with t as (select o_orderkey, cast(o_orderdate as date) as day from orders), m as (select max(day) as now, quantile_cont(datediff('day', date '1970-01-01', day), 0.8) as q from t) select o_orderkey, datediff('day', day, now) < 90 as last_days, datediff('day', date '1970-01-01', day) > q as by_quantile from t, m")
def i02(s, d):
    o = table(s, d, "orders").select("o_orderkey", C("o_orderdate").cast("date").alias("day"))
    a = models.split_last_days(o, "day", 90).withColumnRenamed("is_test", "last_days")
    return models.split_quantile(a, "day", 0.8).select("o_orderkey", "last_days", C("is_test").alias("by_quantile"))


@query("g02_valid_picks", f"select pick_id from ({LEDGER}) where pick_id % 11 <> 0 and pick_id % 13 <> 0 and pick_id % 7 <> 0 and coalesce(case when pick_id % 5 = 0 then null else pick_id % 17 <> 0 end, true)")
def g02(s, d):
    p = C("pick_id")
    rows = ledger(s, d).withColumns({"leg_result": F.when(p % 11 == 0, "push").when(C("win") == 1, "win").otherwise("loss"), "picked_at": F.when(p % 13 == 0, F.date_add("decided", 2)).otherwise(C("decided")), "game_start": F.date_add("decided", 1), "line_value": F.when(p % 7 != 0, C("quantity")), "did_play": F.when(p % 5 != 0, p % 17 != 0)})
    return lg.valid(rows).select("pick_id")
