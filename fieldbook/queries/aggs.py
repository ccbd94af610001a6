"""Aggregations (2.5) and sorts, limits and set operations (2.6)."""

from pyspark.sql import functions as F

from fieldbook.operators import aggs as a
from fieldbook.operators.windows import top_per_key
from fieldbook.plans import ledger as lg
from fieldbook.plans import quality
from fieldbook.queries.base import DENSE, LEDGER, PLAYER, TEAM, dense_rows, ledger, player_rows, query, rounded, table, team_rows
from fieldbook.queries.scalars import wilson_sql
from fieldbook.sources import tables

C = F.col
EDGES = (0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85)


@query("e01_team_totals", TEAM)
def e01(s, d):
    return team_rows(s, d).select("game_id", "team_id", "game_date", "season", "points", "players")


@query("e02_share_of_total", f"select player_game_id, team_id, round(case when sum(points) over (partition by game_id, team_id) > 0 then points / sum(points) over (partition by game_id, team_id) else 0 end, 6) as usage from ({DENSE})")
def e02(s, d):
    return rounded(a.share_of_total(dense_rows(s, d), ["game_id", "team_id"], "points", "usage").select("player_game_id", "team_id", "usage"))


@query("e03_consensus", f"select player_id, stat_type, line_id, round(median(market_prob * 0.7 + model_prob * 0.3), 4) as market_over_prob, count(*) as books from ({LEDGER}) group by 1, 2, 3")
def e03(s, d):
    return a.consensus(ledger(s, d).withColumn("p", C("market_prob") * 0.7 + C("model_prob") * 0.3), ["player_id", "stat_type", "line_id"], "p")


RESULT = "case when pick_id % 11 = 0 then 'push' when pick_id % 13 = 0 then 'void' when win = 1 then 'win' else 'loss' end"


def with_result(df):
    return df.withColumn("result", F.when(C("pick_id") % 11 == 0, "push").when(C("pick_id") % 13 == 0, "void").when(C("win") == 1, "win").otherwise("loss"))


@query("e04_ledger_summary", f"with t as (select *, {RESULT} as r from ({LEDGER})) select sport, stat_type, direction, count(*) as n, count(*) filter (r = 'win') as wins, count(*) filter (r = 'loss') as losses, count(*) filter (r = 'push') as pushes, count(*) filter (r = 'void') as voids, round(100 * count(*) filter (r = 'win') / cast(nullif(count(*) filter (r in ('win', 'loss')), 0) as double), 6) as win_pct, round(avg(model_prob), 6) as mean_prob, round(avg(model_prob - market_prob), 6) as mean_edge from t group by 1, 2, 3")
def e04(s, d):
    return rounded(a.ledger_summary(with_result(ledger(s, d)).withColumn("edge", C("model_prob") - C("market_prob")), ["sport", "stat_type", "direction"], "result", "model_prob", "edge"))


@query("e05_accuracy_blocks", f"select sport, stat_type, direction, count(*) as n, cast(sum(win) as bigint) as wins, round(avg(win), 6) as hit, round(avg(model_prob), 6) as mean_prob, round(avg(pow(model_prob - win, 2)), 6) as brier, cast(case grouping(sport, stat_type, direction) when 7 then 0 when 3 then 1 else 3 end as bigint) as level from ({LEDGER}) group by grouping sets ((), (sport), (sport, stat_type, direction)) having count(*) >= 5")
def e05(s, d):
    return rounded(a.accuracy(ledger(s, d), [[], ["sport"], ["sport", "stat_type", "direction"]], least=5))


@query("e06_calibration_table", f"with t as (select *, case when model_prob < 0.60 then 0 when model_prob < 0.65 then 1 when model_prob < 0.70 then 2 when model_prob < 0.75 then 3 when model_prob < 0.80 then 4 when model_prob <= 0.85 then 5 end as bin from ({LEDGER})) select sport, cast(bin as bigint) as bin, count(*) as n, round(avg(model_prob), 6) as predicted, round(avg(win), 6) as actual, round(avg(win) - avg(model_prob), 6) as gap from t group by 1, 2")
def e06(s, d):
    return rounded(a.calibration(ledger(s, d).withColumn("model_prob", F.round("model_prob", 4)), EDGES, keys=["sport"]))


@query("e06_right_closed_bins", f"with t as (select *, case when model_prob <= 0.60 then 0 when model_prob <= 0.65 then 1 when model_prob <= 0.70 then 2 when model_prob <= 0.75 then 3 when model_prob <= 0.80 then 4 else 5 end as bin from ({LEDGER})), b as (select bin, count(*) as n, avg(win) - avg(model_prob) as gap from t group by 1) select round(sum(abs(gap) * n) / sum(n), 6) as weighted_gap from b")
def e06_right(s, d):
    return rounded(a.weighted_gap(a.calibration(ledger(s, d).withColumn("model_prob", F.round("model_prob", 4)), EDGES, right=True)))


@query("e07_brier", f"select sport, round(avg(pow(model_prob - win, 2)), 6) as brier, round(avg(pow(0.8 * model_prob + 0.1 - win, 2)), 6) as recalibrated from ({LEDGER}) group by 1")
def e07(s, d):
    return rounded(ledger(s, d).groupBy("sport").agg(a.brier(C("model_prob"), C("win")).alias("brier"), a.brier(0.8 * C("model_prob") + 0.1, C("win")).alias("recalibrated")))


@query("e08_murphy", f"with c as (select sport, least(floor(round(model_prob, 4) * 10), 9) as b, count(*) as n, sum(model_prob) as p, cast(sum(win) as double) as w from ({LEDGER}) group by 1, 2), t as (select sport, sum(n) as t, sum(w) as a from c group by 1) select sport, cast(t as bigint) as n, round(sum(n * pow(p / n - w / n, 2)) / t, 6) as reliability, round(sum(n * pow(w / n - a / t, 2)) / t, 6) as resolution, round((a / t) * (1 - a / t), 6) as uncertainty from c join t using (sport) group by sport, t, a")
def e08(s, d):
    return rounded(a.murphy(ledger(s, d).withColumn("model_prob", F.round("model_prob", 4)), ["sport"]))


@query("e09_auc", f"""with c as (select sport, model_prob, cast(sum(win) as double) as pos, cast(sum(1 - win) as double) as neg from ({LEDGER}) group by 1, 2), w as (select *, coalesce(sum(neg) over (partition by sport order by model_prob rows between unbounded preceding and 1 preceding), 0) as below from c),
 s as (select sport, sum(pos) as p, sum(neg) as q, sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) as auc from w group by 1)
select sport, cast(p + q as bigint) as n, round(auc, 6) as auc, round(sqrt((auc * (1 - auc) + (p - 1) * (auc / (2 - auc) - auc * auc) + (q - 1) * (2 * auc * auc / (1 + auc) - auc * auc)) / (p * q)), 6) as se, case when p + q < 150 then 'thin' when auc > 0.65 then 'leak' else 'ok' end as flag from s""")
def e09(s, d):
    return rounded(a.auc(ledger(s, d), ["sport"]))


@query("e10_overdispersion", f"with t as (select player_id, count(*) as n, var_samp(points) / avg(points) as v from ({PLAYER.replace('o_totalprice as points', 'cast(cast(o_totalprice as bigint) % 40 as double) as points').replace('cast(o_totalprice as bigint)', 'cast(floor(o_totalprice) as bigint)')}) group by 1 having count(*) >= 8) select count(*) as entities, round(quantile_cont(v, 0.25), 6) as q25, round(quantile_cont(v, 0.5), 6) as q50, round(quantile_cont(v, 0.75), 6) as q75 from t")
def e10(s, d):
    rows = player_rows(s, d).withColumn("points", (F.floor("points") % 40).cast("double"))
    return rounded(a.overdispersion(rows, "player_id", "points", least=8))


@query("e11_residual_dispersion", f"select stat_type, count(*) as n, round(sum(pow(quantity - 30 * model_prob, 2)) / sum(30 * model_prob), 6) as dispersion from ({LEDGER}) group by 1")
def e11(s, d):
    return rounded(a.residual_dispersion(ledger(s, d).withColumn("mean", 30 * C("model_prob")), ["stat_type"], "quantity", "mean"))


@query("e12_interval_anchors", f"""with t as (select stat_type, quantity, market_prob * 40 + model_prob as mean from ({LEDGER})), e as (select stat_type, quantile_cont(mean, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) as q from t group by 1), b as (select t.*, len(list_filter(q, lambda x: x < mean)) as bin from t join e using (stat_type))
select stat_type, cast(bin as bigint) as bin, count(*) as n, round(avg(mean), 6) as anchor, quantile_cont(quantity, 0.25) as low, quantile_cont(quantity, 0.75) as high from b group by 1, 2""")
def e12(s, d):
    return rounded(a.interval_anchors(ledger(s, d).withColumn("mean", C("market_prob") * 40 + C("model_prob")), ["stat_type"], "mean", "quantity"))


@query("e12_nearest_anchor", f"""with t as (select pick_id, stat_type, quantity, market_prob * 40 as mean from ({LEDGER})), a as (select stat_type, floor(mean) as anchor, min(quantity) as low, max(quantity) as high from t where cast(floor(mean) as bigint) % 4 = 0 group by 1, 2), r as (select pick_id, anchor, low, high, row_number() over (partition by pick_id order by round(abs(mean - anchor), 9), anchor) as n from t join a using (stat_type))
select pick_id, cast(anchor as double) as anchor, low, high from r where n = 1""")
def e12_nearest(s, d):
    t = ledger(s, d).withColumn("mean", F.round(C("market_prob") * 40, 9))
    anchors = t.where(F.floor("mean") % 4 == 0).groupBy("stat_type", F.floor("mean").cast("double").alias("anchor")).agg(F.min("quantity").alias("low"), F.max("quantity").alias("high"))
    return a.nearest_anchor(t, anchors, ["stat_type"], "pick_id", "mean")


@query("e14_edge_thresholds", f"with t as (select sport, win, model_prob - market_prob as edge, case when win = 1 then payout - 1 else -1 end as profit from ({LEDGER})), e as (select unnest([0.0, 0.05, 0.1, 0.2, 0.3])::double as threshold) select sport, threshold, count(*) as n, round(avg(win), 6) as hit, round(avg(profit), 6) as roi from t join e on round(edge, 6) >= threshold group by 1, 2")
def e14(s, d):
    t = ledger(s, d).withColumns({"edge": F.round(C("model_prob") - C("market_prob"), 6), "profit": F.when(C("win") == 1, C("payout") - 1).otherwise(-1.0)})
    return rounded(a.threshold_roi(t, [0.0, 0.05, 0.1, 0.2, 0.3], "edge", "profit", "win", ["sport"]))


@query("e15_tier_roi", f"""with t as (select sport, win, payout, case when win = 1 then payout - 1 else -1 end as profit from ({LEDGER}) where round(model_prob * payout, 6) > 1), g as (select sport, count(*) as n, avg(profit) as roi, avg(win) as hit, avg(payout) as mean_payout, 1.96 * sqrt(var_pop(profit) / count(*)) as half from t group by 1)
select sport, n, round(roi, 6) as roi, round(hit, 6) as hit, round(mean_payout, 6) as mean_payout, round(roi - half, 6) as low, round(roi + half, 6) as high, case when n < 30 then 'thin' when roi - half > 0 then 'profitable' when roi + half < 0 then 'losing' else 'inconclusive' end as verdict from g""")
def e15(s, d):
    return rounded(a.tier_roi(ledger(s, d).where(F.round(C("model_prob") * C("payout"), 6) > 1), ["sport"], "model_prob", "payout", "win"))


@query("e16_coverage_drift", f"""with t as (select game_date >= date '2000-01-01' as n, unnest([{{'f': 'assists', 'v': cast(assists as double)}}, {{'f': 'thin', 'v': case when game_date < date '2000-01-01' or minutes = 7 then points else 0 end}}]) as e from ({DENSE})), b as (select e.f as feature, avg(case when not n then cast(e.v <> 0 as int) end) as base, avg(case when n then cast(e.v <> 0 as int) end) as recent from t group by 1)
select feature, round(base, 6) as base, round(recent, 6) as recent, base >= 0.5 and recent < 0.4 * base as collapsed from b""")
def e16(s, d):
    rows = dense_rows(s, d).withColumn("thin", F.when((C("game_date") < "2000-01-01") | (C("minutes") == 7), C("points")).otherwise(0.0))
    return rounded(a.coverage_drift(rows, ["assists", "thin"], "game_date", F.lit("2000-01-01").cast("date")))


@query("e17_feature_value", f"""with t as (select quantity as a, quantity - 30 * model_prob as r, unnest([{{'f': 'payout', 'v': payout}}, {{'f': 'market', 'v': market_prob}}]) as e from ({LEDGER})), c as (select e.f as f, quantile_cont(e.v, [1/3.0::double, 2/3.0::double]) as q from t group by 1)
select f as feature, round(corr(e.v, a), 6) as corr_actual, round(corr(e.v, r), 6) as corr_residual, round(avg(cast(e.v <> 0 as int)), 6) as covered, round(avg(case when e.v <= q[1] then a end), 6) as low_third, round(avg(case when e.v > q[2] then a end), 6) as high_third from t join c on c.f = e.f group by 1""")
def e17(s, d):
    t = ledger(s, d).withColumns({"market": C("market_prob"), "predicted": 30 * C("model_prob")})
    return rounded(a.feature_value(t, ["payout", "market"], "quantity", "predicted"))


@query("e18_co_occurrence", f"""with g as (select game_id, max(case when sport = 'A' then win end) as x, max(case when sport = 'N' then win end) as y, max(case when sport = 'R' then win end) as z from ({LEDGER}) group by 1), p as (select 'A' as a, 'N' as b, x, y from g where x is not null and y is not null union all select 'N', 'R', y, z from g where y is not null and z is not null)
select a, b, count(*) as n, round(avg(x * y), 6) as joint, round(avg(x) * avg(y), 6) as independent, round(avg(x * y) / (avg(x) * avg(y)), 6) as lift, round(3 * avg(x * y) - 1, 6) as ev from p group by 1, 2""")
def e18(s, d):
    return rounded(a.co_occurrence(ledger(s, d), ["game_id"], "sport", "win", [("A", "N"), ("N", "R")]))


VOLUME = "select cast(ts as date) as day, count(distinct (user_id, event_type)) as board, count(distinct user_id) as games from events group by 1"


@query("e19_board_volume", VOLUME)
def e19(s, d):
    e = table(s, d, "events")
    return quality.board_volume(e, C("ts").cast("date"), "user_id", "event_type", "user_id")


@query("e20_leaderboard", f"select player_id, count(*) as n, round(avg(case when quantity > 25 then 1.0::double else 0 end), 6) as over_rate from ({LEDGER}) group by 1 having count(*) >= 30 order by over_rate desc, player_id limit 30")
def e20(s, d):
    t = ledger(s, d).groupBy("player_id").agg(F.count("*").alias("n"), F.avg((C("quantity") > 25).cast("double")).alias("over_rate")).where("n >= 30")
    return rounded(t).orderBy(F.desc("over_rate"), "player_id").limit(30)


@query("e20_history_and_lines", f"with h as (select player_id, avg(quantity) as mean, avg(cast(quantity > 25 as int)) as over_rate, count(*) as games from ({LEDGER}) where line_id % 3 <> 0 group by 1 having count(*) >= 30), l as (select player_id, avg(quantity) as mean_line from ({LEDGER}) where line_id % 3 = 0 and decided >= date '2000-01-01' group by 1) select player_id, round(mean, 6) as mean, round(over_rate, 6) as over_rate, games, round(mean_line, 6) as mean_line from h join l using (player_id)")
def e20_history(s, d):
    rows = ledger(s, d)
    lines = rows.where((C("line_id") % 3 == 0) & (C("decided") >= F.lit("2000-01-01").cast("date")))
    return rounded(a.history_against_lines(rows.where("line_id % 3 <> 0"), lines, "player_id", "quantity", 25.0, "quantity"))


@query("e21_row_counts", f"select sport, count(*) as n, min(decided) as first_day, max(decided) as last_day, round(stddev_samp(quantity), 6) as spread, count(*) filter (quantity < 10) as bin_0, count(*) filter (quantity >= 10 and quantity < 30) as bin_1_2, count(*) filter (quantity >= 30) as bin_3 from ({LEDGER}) group by 1")
def e21(s, d):
    b = F.width_bucket(C("quantity"), F.lit(0.0), F.lit(60.0), F.lit(6))
    return rounded(ledger(s, d).withColumn("b", b).groupBy("sport").agg(F.count("*").alias("n"), F.min("decided").alias("first_day"), F.max("decided").alias("last_day"), F.stddev_samp("quantity").alias("spread"), F.count_if(C("b") == 1).alias("bin_0"), F.count_if(C("b").isin(2, 3)).alias("bin_1_2"), F.count_if(C("b") >= 4).alias("bin_3")))


@query("e22_period_drift", f"with t as (select *, decided >= date '2001-01-01' as n from ({LEDGER})) select sport, round(avg(case when not n then win end), 6) as hit_before, round(avg(case when n then win end), 6) as hit_recent, round(avg(case when not n then win - model_prob end), 6) as gap_before, round(avg(case when n then win - model_prob end), 6) as gap_recent, round(avg(case when n then win end) - avg(case when not n then win end), 6) as drift from t group by 1")
def e22(s, d):
    return rounded(a.period_drift(ledger(s, d), ["sport"], C("decided") >= F.lit("2001-01-01").cast("date")))


@query("e23_hot_and_cold", f"with t as (select * from ({LEDGER}) where datediff('day', decided, date '2000-06-30') between 0 and 20) select sport, stat_type, count(*) as n, round(avg(win), 6) as hit, case when avg(win) >= 0.66 then 'hot' when avg(win) <= 0.45 then 'cold' else 'even' end as label from t group by 1, 2 having count(*) >= 12")
def e23(s, d):
    return rounded(lg.hot_and_cold(ledger(s, d), ["sport", "stat_type"], F.lit("2000-06-30").cast("date")))


@query("f01_top_of_day", f"with t as (select *, row_number() over (partition by decided order by model_prob desc, pick_id) as r from ({LEDGER})) select decided, count(*) as n, cast(sum(win) as bigint) as wins from t where r <= 5 group by 1")
def f01(s, d):
    return lg.top_of_day(ledger(s, d), "decided")


@query("f02_likely_players", f"with n as (select max(game_date) as now from ({DENSE})), t as (select team_id, opponent_id as player, sum(minutes) as m, max(game_date) as last from ({DENSE}), n where datediff('day', game_date, now) between 0 and 400 group by 1, 2), r as (select *, row_number() over (partition by team_id order by m desc, player) as k from t, n where datediff('day', last, now) <= 300 and player % 5 <> 0) select team_id, player, cast(m as bigint) as minutes from r where k <= 9")
def f02(s, d):
    rows = dense_rows(s, d).withColumnRenamed("opponent_id", "player")
    now = rows.agg(F.max("game_date").alias("now"))
    t = rows.join(F.broadcast(now)).where(F.datediff("now", "game_date").between(0, 400)).groupBy("team_id", "player").agg(F.sum("minutes").cast("bigint").alias("minutes"), F.min(F.datediff("now", "game_date")).alias("age"))
    hurt = rows.where("player % 5 = 0").select("player").distinct()
    good = t.where("age <= 300").join(hurt, "player", "left_anti")
    return top_per_key(good, ["team_id"], [F.desc("minutes"), F.asc("player")], 9).select("team_id", "player", "minutes")


@query("f03_board_limit", f"select pick_id, model_prob from ({LEDGER}) order by model_prob desc, pick_id limit 50")
def f03(s, d):
    return ledger(s, d).select("pick_id", "model_prob").orderBy(F.desc("model_prob"), "pick_id").limit(50)


@query("f04_diversified_slate", f"with t as (select pick_id as leg_id, decided, line_id as player_id, game_id, direction, model_prob from ({LEDGER})), p as (select *, row_number() over (partition by decided, player_id order by model_prob desc, leg_id) as a from t), q as (select *, row_number() over (partition by decided, game_id, direction order by model_prob desc, leg_id) as b from p where a = 1), r as (select *, row_number() over (partition by decided order by model_prob desc, leg_id) as rank from q where b = 1) select decided, leg_id, rank from r where rank <= 3")
def f04(s, d):
    from fieldbook.plans.market import diversified

    legs = ledger(s, d).select(C("pick_id").alias("leg_id"), "decided", C("line_id").alias("player_id"), "game_id", "direction", "model_prob")
    return rounded(diversified(legs, "decided", 3).select("decided", "leg_id", "rank"))


@query("f05_union_and_merge", "with a as (select o_orderkey, o_totalprice from orders where o_orderkey % 2 = 0), b as (select o_orderkey, o_custkey from orders where o_orderkey % 3 = 0) select coalesce(a.o_orderkey, b.o_orderkey) as o_orderkey, o_totalprice, o_custkey from a full join b on a.o_orderkey = b.o_orderkey")
def f05(s, d):
    o = table(s, d, "orders")
    return tables.merge_blocks([o.where("o_orderkey % 2 = 0").select("o_orderkey", "o_totalprice"), o.where("o_orderkey % 3 = 0").select("o_orderkey", "o_custkey")], "o_orderkey")


@query("f05_union_blocks", "select o_orderkey, o_totalprice, null::bigint as o_custkey from orders where o_orderkey % 2 = 0 union all select o_orderkey, null, o_custkey from orders where o_orderkey % 3 = 0")
def f05_union(s, d):
    o = table(s, d, "orders")
    return tables.union_blocks([o.where("o_orderkey % 2 = 0").select("o_orderkey", "o_totalprice"), o.where("o_orderkey % 3 = 0").select("o_orderkey", "o_custkey")])


@query("f06_dedup_by_priority", "with t as (select *, row_number() over (partition by o_custkey order by o_orderpriority, o_orderkey) as r from orders) select o_custkey, o_orderkey, o_orderpriority from t where r = 1")
def f06(s, d):
    return tables.dedup(table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), ["o_custkey"], [F.asc("o_orderpriority"), F.asc("o_orderkey")])


@query("f07_set_difference", "select c_custkey from customer except select o_custkey from orders where o_orderstatus = 'F'")
def f07(s, d):
    return table(s, d, "customer").select("c_custkey").join(table(s, d, "orders").where("o_orderstatus = 'F'").select(C("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("g07_segments", f"with t as (select sport, count(*) as n, cast(sum(win) as bigint) as wins, avg(pow(model_prob - win, 2)) as brier from ({LEDGER}) group by 1) select sport, n, wins, round(brier, 6) as brier, round(wins / cast(n as double), 6) as hit, round({wilson_sql('wins', 'n', '1.96', '-')}, 6) as low, round({wilson_sql('wins', 'n', '1.96', '+')}, 6) as high, case when n < 30 then 'thin' when {wilson_sql('wins', 'n', '1.96', '-')} >= 0.577 then 'edge' when {wilson_sql('wins', 'n', '1.96', '+')} < 0.577 then 'no edge' else 'unproven' end as verdict from t")
def g07(s, d):
    return rounded(a.segment(ledger(s, d), ["sport"]))
