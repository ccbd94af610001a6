"""Data quality (2.10)."""

from pyspark.sql import functions as F

from fieldbook.operators import aggs
from fieldbook.plans import quality as q
from fieldbook.queries.base import DENSE, LEDGER, dense_rows, ledger, query, rounded, table
from fieldbook.session import fresh_folder
from fieldbook.sources.tables import write_observed

C = F.col


#: Two days of the events are nearly gone; users stand for players and, by fifteens, for games.
THINNED = "select * from events where not (day(ts) = 10 and event_id % 12 <> 0) and not (day(ts) = 20 and event_id % 30 <> 0)"


@query("j01_monitor", f"""with e as ({THINNED}), n as (select max(ts) as now from e), f as (select event_type, (floor(epoch(now)) - floor(epoch(max(ts)))) / 3600 as age from e, n group by 1, now), v as (select cast(ts as date) as day, count(distinct (user_id, event_type)) as board, count(distinct user_id % 15) as games from e group by 1),
 t as (select *, board / games as each, avg(board) over w as m, avg(board / games) over w as u from v window w as (order by day range between interval 7 days preceding and interval 1 day preceding)), inj as (select (floor(epoch(now)) - floor(epoch(max(ts) filter (event_type = 'error' and day(ts) < 28)))) / 3600 as age from e, n group by now)
select 'error' as level, 'stale' as name, event_type as detail, round(age, 3) as value from f where age > 0.2 union all select 'warn', 'finals_without_box', o_orderpriority, count(*) from orders where o_orderstatus = 'F' and o_orderkey not in (select l_orderkey from lineitem) group by o_orderpriority
union all select 'warn', 'slate_thin', cast(day as varchar) || case when board < 0.1 * m then ' feed broken' else ' thin' end, round(each, 3) from t where m >= 50 and (board < 0.1 * m or each < 0.3 * u) union all select 'warn', 'injuries_stale', 'injuries', round(age, 3) from inj where age is null or age > 40""")
def j01(s, d):
    day = F.dayofmonth("ts")
    e = table(s, d, "events").where(~((day == 10) & (C("event_id") % 12 != 0)) & ~((day == 20) & (C("event_id") % 30 != 0)))
    now = e.agg(F.max("ts").cast("timestamp").alias("now"))
    stale = q.freshness(e, "event_type", "ts", now, 0.2, "stale")
    o = table(s, d, "orders").where("o_orderstatus = 'F'").select(C("o_orderkey").alias("g"), "o_orderpriority")
    box = q.missing_box(o, table(s, d, "lineitem").select(C("l_orderkey").alias("g")), "g", "o_orderpriority")
    thin = q.thin_days(q.board_volume(e.withColumn("game", C("user_id") % 15), C("ts").cast("date"), "user_id", "event_type", "game"))
    return q.together([stale, box, thin, q.cold_injuries(e.where((C("event_type") == "error") & (day < 28)), "ts", now)]).withColumn("value", F.round("value", 3))


@query("j01_write_metrics", "with t as (select cast(ts as timestamp) as ts, case when event_id % 50 <> 0 then value end as v from events where day(ts) < 29), n as (select max(ts) as now from events) select 'warn' as level, 'empty_values' as name, 'rows' as detail, cast(count(*) as double) as value from t where v is null having count(*) > 0 union all select 'warn', 'old_rows', 'newest', round((floor(epoch(max(now))) - floor(epoch(max(ts)))) / 3600, 3) from t, n having (floor(epoch(max(now))) - floor(epoch(max(ts)))) / 3600 > 18")
def j01_written(s, d):
    e = table(s, d, "events").withColumn("ts", C("ts").cast("timestamp"))
    now = e.agg(F.max("ts").alias("now"))
    rows = e.where(F.dayofmonth("ts") < 29).select("event_id", "event_type", "ts", F.when(C("event_id") % 50 != 0, C("value")).alias("value"))
    got = write_observed(rows, fresh_folder(s, "observed"), ["event_type"], {"rows": F.count(F.lit(1)), "empty": F.count_if(C("value").isNull()), "newest": F.max("ts")})
    return q.written_findings(s, got, now, 18.0).withColumn("value", F.round("value", 3))


@query("j02_audit", f"""with t as ({DENSE})
select 'error' as level, 'duplicate_name' as name, p_name as detail, cast(count(*) as double) as value from part group by p_name having count(*) > 1
union all select 'error', 'home_is_away', cast(l_orderkey as varchar), 1 from lineitem where l_partkey % 100 = l_suppkey union all select 'warn', 'many_teams', cast(opponent_id as varchar), count(distinct position) from t group by opponent_id having count(distinct position) > 2
union all select 'warn', 'few_players', cast(game_id as varchar) || '|' || cast(team_id as varchar), count(*) from t group by game_id, team_id having count(*) < 2 union all select 'error', 'no_order', cast(event_id as varchar), 1 from events where event_id not in (select o_orderkey from orders)""")
def j02(s, d):
    rows = dense_rows(s, d)
    parts = [
        q.duplicates(table(s, d, "part"), ["p_name"], "duplicate_name"), q.same_sides(table(s, d, "lineitem").withColumn("h", C("l_partkey") % 100), "l_orderkey", "h", "l_suppkey"), q.many_teams(rows, "opponent_id", "position"),
        q.incomplete_teams(rows, "game_id", "team_id", 2), q.orphans(table(s, d, "events").select("event_id"), table(s, d, "orders").select(C("o_orderkey").alias("event_id")), "event_id", "no_order"),
    ]
    return q.together(parts)


NATIONS = "select n_nationkey as team_id, case n_regionkey % 4 when 0 then 'mlb' when 1 then 'nba' when 2 then 'cbb' else 'wnba' end as sport_code, case when n_nationkey % 9 = 3 then 'PP_PLACEHOLDER' end as external_id, 'T' || n_nationkey % 4 as abbreviation, case when n_nationkey % 10 = 1 then 'West All-Star' else n_name end as name from nation"
BOXES = f"select game_id, player_id, min(line_id) % 25 as team_id, min(line_id) % 11 <> 0 as did_play from ({LEDGER}) where line_id % 5 <> 0 group by 1, 2"


@query("j02_team_audit", f"""with t as (select * from ({NATIONS}) where coalesce(external_id, '') <> 'PP_PLACEHOLDER' and name not ilike '%all-star%'), p as (select *, case when pick_id % 7 = 0 then 'void' when win = 1 then 'win' else 'loss' end as leg_result from ({LEDGER})), b as ({BOXES}), n as (select max(settled) as now from p),
 e as (select * from (values ('mlb', 30), ('nba', 30), ('nhl', 32), ('wnba', 13)) v(sport_code, want))
select 'warn' as level, 'teams_incomplete' as name, sport_code as detail, cast(count(t.team_id) as double) as value from e left join t using (sport_code) group by sport_code, want having count(t.team_id) < want
union all select 'warn', 'duplicate_abbrev', sport_code || '/' || abbreviation, count(*) from t where sport_code not in ('cbb', 'cfb', 'soccer') group by sport_code, abbreviation having count(*) > 1
union all select 'warn', 'placeholder_picks', 'settled picks', count(*) from p join b using (game_id, player_id) join ({NATIONS}) x using (team_id) where external_id = 'PP_PLACEHOLDER' and leg_result in ('win', 'loss', 'push') having count(*) > 0
union all select 'warn', 'dnp_leak', 'losses', count(*) from p join b using (game_id, player_id), n where leg_result = 'loss' and settled >= now - interval 14 days and not did_play having count(*) > 0
union all select 'error', 'home_is_away', cast(o_orderkey as varchar), 1 from orders where o_custkey % 20 = o_orderkey % 20 and o_orderkey % 3 <> 0""")
def j02_teams(s, d):
    n = C("n_nationkey")
    sport = F.element_at(F.array(*map(F.lit, ("mlb", "nba", "cbb", "wnba"))), (C("n_regionkey") % 4 + 1).cast("int"))
    teams = table(s, d, "nation").select(n.cast("bigint").alias("team_id"), sport.alias("sport_code"), F.when(n % 9 == 3, q.PLACEHOLDER_TEAM).alias("external_id"), F.concat(F.lit("T"), (n % 4).cast("string")).alias("abbreviation"), F.when(n % 10 == 1, "West All-Star").otherwise(C("n_name")).alias("name"))
    rows = ledger(s, d)
    picks = rows.select("game_id", "player_id", C("settled").cast("timestamp").alias("settled_at"), F.when(C("pick_id") % 7 == 0, "void").when(C("win") == 1, "win").otherwise("loss").alias("leg_result"))
    box = rows.where("line_id % 5 <> 0").groupBy("game_id", "player_id").agg(F.min("line_id").alias("l")).select("game_id", "player_id", (C("l") % 25).alias("team_id"), (C("l") % 11 != 0).alias("did_play"))
    now = picks.agg(F.max("settled_at").alias("now"))
    games = table(s, d, "orders").select(C("o_orderkey").alias("g"), (C("o_custkey") % 20).alias("h"), (C("o_orderkey") % 20).alias("a"), F.when(C("o_orderkey") % 3 == 0, F.concat(F.lit("pp_"), C("o_orderkey").cast("string"))).alias("x"))
    dnp = q.dnp_losses(picks.join(F.broadcast(now)), box, C("now"))
    return q.together([q.teams_incomplete(teams), q.duplicate_abbreviations(teams), q.placeholder_picks(picks, box, teams), dnp, q.same_sides(games, "g", "h", "a", "x")])


@query("j02_stale_mapping", f"with t as (select player_id, max_by(line_id % 7, (game_date, player_game_id)) as team from ({DENSE.replace('l_partkey as player_id', 'l_partkey as player_id, l_partkey as line_id')}) group by 1) select cast(player_id as varchar) as detail from t where team is distinct from case when player_id % 4 = 0 then null else player_id % 7 end")
def j02_stale(s, d):
    rows = dense_rows(s, d).withColumn("team", C("player_id") % 7)
    players = rows.select("player_id").distinct().withColumn("current", F.when(C("player_id") % 4 != 0, C("player_id") % 7))
    return q.stale_mapping(rows, players, "player_id", "team", "current", ["game_date", "player_game_id"]).select("detail")


@query("j02_combo_names", "select p_name || ' + ' || p_type as detail from part where p_partkey % 5 = 0")
def j02_combo(s, d):
    p = table(s, d, "part").withColumn("n", F.when(C("p_partkey") % 5 == 0, F.concat("p_name", F.lit(" + "), "p_type")).otherwise(C("p_name")))
    return q.combo_names(p, "n").select("detail")


@query("j03_drift_findings", f"select 'error' as level, 'feature_collapsed' as name, 'thin' as detail, round(avg(case when game_date >= date '2000-01-01' then cast(minutes = 7 as int) end), 6) as value from ({DENSE})")
def j03(s, d):
    rows = dense_rows(s, d).withColumn("thin", F.when((C("game_date") < "2000-01-01") | (C("minutes") == 7), C("points")).otherwise(0.0))
    return rounded(q.drift_findings(aggs.coverage_drift(rows, ["points", "thin"], "game_date", F.lit("2000-01-01").cast("date"))))


@query("j03_coverage_findings", f"select 'warn' as level, 'interval_coverage' as name, stat_type as detail, round(avg(cast(quantity between 10 and 45 as int)), 6) as value from ({LEDGER}) group by stat_type having abs(avg(cast(quantity between 10 and 45 as int)) - 0.5) > 0.1")
def j03_coverage(s, d):
    rows = ledger(s, d).withColumns({"low": F.lit(10.0), "high": F.lit(45.0)})
    return rounded(q.coverage_findings(aggs.coverage(rows, ["stat_type"], "quantity", "low", "high", 0.5), "stat_type"))


@query("j04_activity", "with n as (select max(ts) as now from events) select cast(ts as date) as day, count(*) as n, round((floor(epoch(max(now))) - floor(epoch(max(ts)))) / 3600, 6) as hours_ago from events, n group by 1")
def j04(s, d):
    e = table(s, d, "events").withColumn("ts", C("ts").cast("timestamp"))
    now = F.broadcast(e.agg(F.max("ts").alias("now")))
    return rounded(q.activity(e.join(now), C("ts").cast("date"), "ts", F.max("now")))


@query("j04_usage", f"""with n as (select max(ts) as now from events), l as (select cast(timezone('America/Los_Angeles', timezone('UTC', ts)) as date) as day, user_id, event_type from events, n where ts > now - interval 10 days), v as (select day, cast(count(distinct (user_id, event_type)) as double) as value from l group by 1),
 pn as (select timestamp '2001-07-31 20:00:00' as pnow), p as (select decided + to_hours(pick_id % 24) as picked_at, case when pick_id % 7 = 0 then 'void' when win = 1 then 'win' else 'loss' end as r from ({LEDGER}))
select 'lines' as name, day, value from v union all select 'mean_lines', null, round(avg(value), 6) from v union all select 'line_hours', null, round((floor(epoch(max(now))) - floor(epoch(max(ts)))) / 3600, 6) from events, n
union all select 'pick_hours', null, round((floor(epoch(now)) - floor(epoch((select max(picked_at) from p)))) / 3600, 6) from n union all select 'picks_today', null, count(*) from p, n where cast(timezone('America/Los_Angeles', timezone('UTC', picked_at)) as date) = cast(timezone('America/Los_Angeles', timezone('UTC', now)) as date)
union all select 'settled', null, count(*) from p, n where r in ('win', 'loss') and picked_at > now - interval 7 days""".replace("pn as (select timestamp '2001-07-31 20:00:00' as pnow), ", ""))
def j04_usage(s, d):
    e = table(s, d, "events").select(C("user_id").alias("player_id"), C("event_type").alias("stat_type"), C("ts").cast("timestamp").alias("snapshot_at"))
    now = e.agg(F.max("snapshot_at").alias("now"))
    picks = ledger(s, d).select((C("decided").cast("timestamp") + F.make_dt_interval(hours=(C("pick_id") % 24).cast("int"))).alias("picked_at"), F.when(C("pick_id") % 7 == 0, "void").when(C("win") == 1, "win").otherwise("loss").alias("leg_result"))
    return rounded(q.usage(e, picks, now))
