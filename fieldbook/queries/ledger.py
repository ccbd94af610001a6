"""Ledger jobs (2.7)."""

from pyspark.sql import functions as F

from fieldbook.functions.scalars import clv_points
from fieldbook.operators import windows as w
from fieldbook.operators.joins import small
from fieldbook.plans import board
from fieldbook.plans import ledger as lg
from fieldbook.queries.base import DENSE, LEDGER, SNAPSHOTS, dense_rows, ledger, query, r6, rounded, snapshots, table
from fieldbook.queries.scalars import poisson_over_sql, wilson_sql
from fieldbook.session import fresh_folder, written

C = F.col


@query("g01_settle", f"""
with p as (select pick_id, game_id, player_id, line_id, stat_type, direction, quantity, pick_id % 9 as k from ({LEDGER})), g as (select o_orderkey as game_id, case o_orderstatus when 'F' then 'final' when 'P' then 'postponed' else 'live' end as status, cast(o_orderdate as date) as gd from orders where o_orderkey % 17 <> 0),
 b as (select game_id, player_id, min(quantity) as q, min(line_id) as l from ({LEDGER}) where line_id % 5 <> 0 group by 1, 2), h as (select distinct game_id from b),
 t as (select p.*, status, coalesce(datediff('day', gd, date '2001-08-02') > 2, false) as stale, case when p.line_id % 13 <> 0 then p.line_id % 50 end as line, b.game_id is not null as row_, h.game_id is not null as box, case when l % 4 = 0 then null else l % 11 <> 0 end as dnp, case when l % 6 = 0 then l % 12 end as bf, case when p.stat_type = 'F' then q end as actual
  from p left join g using (game_id) left join b on b.game_id = p.game_id and b.player_id = p.player_id left join h on h.game_id = p.game_id)
select pick_id, case when status is null then 'wait' when status = 'postponed' then 'void' when status <> 'final' and stale then 'void' when status <> 'final' then 'wait' when line is null then 'void' when not row_ and box then 'void' when not row_ and stale then 'void' when not row_ then 'wait' when dnp = false then 'void' when bf = 0 then 'void' when actual is null then 'missing' when actual = line then 'push' when (actual > line) = (direction = 'over') then 'win' else 'loss' end as outcome from t""")
def g01(s, d):
    all_ = ledger(s, d)
    picks = all_.select("pick_id", "game_id", "player_id", "line_id", "stat_type", "direction")
    o = table(s, d, "orders").where("o_orderkey % 17 <> 0")
    games = o.select(C("o_orderkey").alias("game_id"), F.when(C("o_orderstatus") == "F", "final").when(C("o_orderstatus") == "P", "postponed").otherwise("live").alias("status"), C("o_orderdate").cast("date").alias("game_date"))
    lines = all_.where("line_id % 13 <> 0").select("line_id", (C("line_id") % 50).cast("double").alias("line_value")).distinct()
    b = all_.where("line_id % 5 <> 0").groupBy("game_id", "player_id").agg(F.min("quantity").alias("q"), F.min("line_id").alias("l"))
    box = b.select("game_id", "player_id", F.when(C("l") % 4 != 0, C("l") % 11 != 0).alias("did_play"), F.create_map(F.lit("F"), C("q")).alias("stats"), F.when(C("l") % 6 == 0, C("l") % 12).alias("batters_faced"))
    return lg.settle(picks, games, lines, box, F.lit("2001-08-02").cast("date")).select("pick_id", "outcome")


def levels_sql(more: str = "") -> str:
    step = "cast(least(greatest(floor(round((round(model_prob, 4) - 0.55) / 0.025, 6)) + 1, 0), 13) as bigint)"
    return f"select {more} win, {step} as g, unnest([{{'level': 1, 'a': sport, 'b': null, 'c': null}}, {{'level': 2, 'a': sport, 'b': stat_type, 'c': null}}, {{'level': 3, 'a': sport, 'b': stat_type, 'c': direction}}], recursive := true) from ({LEDGER})"


def choose_sql(grid: str, keys: str) -> str:
    """cutoff by (keys, level, a, b, c) from rows (keys, level, a, b, c, step, n, wins)."""
    lb, ub = wilson_sql("wins", "n", "1.0", "-"), wilson_sql("wins", "n", "1.0", "+")
    return f"""
 q as (select *, case when n > 0 then {lb} else 0 end as lb, case when n > 0 then {ub} else 1 end as ub, case level when 1 then 30 else 40 end as least from {grid}),
 a_ as (select *, max(case when step = 0 then n end) over k as nall, max(case when step = 0 then ub end) over k as uball from q window k as (partition by {keys} level, a, b, c)),
 m as (select *, step > 0 and n >= least and nall >= least and lb >= 0.577 as good from a_), b_ as (select *, max(case when good then lb end) over (partition by {keys} level, a, b, c) as best from m),
 ch as (select {keys} level, a, b, c, min(case when good and (level = 1 or lb >= best - 0.04) then step end) as st, max(nall) as nall, max(uball) as uball from b_ group by all),
 cut as (select {keys} level, a, b, c, coalesce(round(0.55 + 0.025 * (st - 1), 3)::double, case when level = 1 then case when nall >= 30 then 0.99::double else 0.7 end when nall >= 15 and uball < 0.577 then 0.99 end) as cutoff, case when st is not null then 'tuned' when level = 1 and nall < 30 then 'unproven' else 'suppressed' end as status, nall from ch)"""


CELLS = f"lv as ({levels_sql()}), grid as (select level, a, b, c, s.step, count(*) filter (g >= s.step) as n, coalesce(sum(win) filter (g >= s.step), 0) as wins from lv, (select unnest(range(0, 14)) as step) s group by all)"


@query("g03_cutoffs", f"with {CELLS}, {choose_sql('grid', '')} select cast(level as bigint) as level, a as sport, b as stat_type, c as direction, cutoff, status from cut where cutoff is not null")
def g03(s, d):
    return rounded(lg.cutoffs(ledger(s, d)).select("level", "sport", "stat_type", "direction", "cutoff", "status"))


def lookup_sql(on: str = "") -> str:
    return f"""left join cut c3 on c3.level = 3 and c3.a = p.sport and c3.b = p.stat_type and c3.c = p.direction {on.replace('X', 'c3')} left join cut c2 on c2.level = 2 and c2.a = p.sport and c2.b = p.stat_type {on.replace('X', 'c2')} left join cut c1 on c1.level = 1 and c1.a = p.sport {on.replace('X', 'c1')}"""


@query("g04_cutoff_lookup", f"with {CELLS}, {choose_sql('grid', '')} select pick_id, coalesce(c3.cutoff, c2.cutoff, c1.cutoff, 0.7) as cutoff from ({LEDGER}) p {lookup_sql()}")
def g04(s, d):
    return lg.with_cutoff(ledger(s, d), lg.cutoffs(ledger(s, d))).select("pick_id", "cutoff")


DATED = f"""lv as ({levels_sql('settled,')}), daily as (select level, a, b, c, settled, s.step, count(*) filter (g >= s.step) as n, coalesce(sum(win) filter (g >= s.step), 0) as wins from lv, (select unnest(range(0, 14)) as step) s group by all),
 cum as (select level, a, b, c, step, settled, cast(sum(n) over k as bigint) as n, cast(sum(wins) over k as bigint) as wins from daily window k as (partition by level, a, b, c, step order by settled)),
 keys as (select distinct level, a, b, c, step from cum), days as (select distinct decided from ({LEDGER})), tot as (select settled, sum(count(*)) over (order by settled) as t from ({LEDGER}) group by settled), start_ as (select min(settled) as s0 from tot where t >= 30),
 want as (select decided, keys.* from days, keys, start_ where decided > s0),
 dgrid as (select w.decided, w.level, w.a, w.b, w.c, w.step, cum.n, cum.wins from want w asof join cum on w.level = cum.level and w.a = cum.a and coalesce(w.b, '') = coalesce(cum.b, '') and coalesce(w.c, '') = coalesce(cum.c, '') and w.step = cum.step and w.decided > cum.settled),
 {choose_sql('dgrid', 'decided,')}"""
WALK = f"select p.*, coalesce(c3.cutoff, c2.cutoff, c1.cutoff, 0.7) as cutoff from ({LEDGER}) p {lookup_sql('and X.decided = p.decided')}"


@query("g05_walk_forward", f"with {DATED}, w as ({WALK}) select pick_id, decided, model_prob, win, cutoff from w where model_prob >= cutoff".replace("model_prob, win, cutoff from w", "model_prob, cast(win as bigint) as win, cutoff from w"))
def g05(s, d):
    return rounded(lg.walk_forward(ledger(s, d)).select("pick_id", "decided", "model_prob", "win", "cutoff"))


@query("g06_in_sample", f"with {CELLS}, {choose_sql('grid', '')}, w as (select p.*, coalesce(c3.cutoff, c2.cutoff, c1.cutoff, 0.7) as cutoff from ({LEDGER}) p {lookup_sql()}) select sport, count(*) as n, round(avg(win), 6) as hit from w where model_prob >= cutoff group by 1")
def g06(s, d):
    return rounded(lg.in_sample(ledger(s, d)).groupBy("sport").agg(F.count("*").alias("n"), F.avg(C("win").cast("double")).alias("hit")))


@query("g08_daily_backtest", f"with {DATED}, w as ({WALK}), r as (select *, datediff('day', decided, date '2001-07-31') as age from w where model_prob >= cutoff), t as (select * from r where age between 0 and 399) select sport, count(*) as n, cast(sum(win) as bigint) as wins, round(3 * avg(win) * avg(win) - 1, 6) as roi, round(avg(case when age < 7 then win end), 6) as hit_7, round(avg(case when age between 7 and 13 then win end), 6) as hit_prior_7, round(avg(case when age < 7 then win end) - avg(case when age between 7 and 13 then win end), 6) as trend from t group by 1")
def g08(s, d):
    return rounded(lg.daily_backtest(lg.walk_forward(ledger(s, d)), F.lit("2001-07-31").cast("date"), 400))


SWEEP = f"""cnt as (select sport, stat_type, round(model_prob, 4) as p, count(*) as n, sum(win) as wins from ({LEDGER}) group by 1, 2, 3),
 lv2 as (select cnt.*, coalesce(c2.cutoff, c1.cutoff, 0.7) as live from cnt left join cut c2 on c2.level = 2 and c2.a = sport and c2.b = stat_type left join cut c1 on c1.level = 1 and c1.a = sport),
 lq as (select sport, stat_type, max(live) as live, coalesce(sum(n) filter (p >= live), 0) as live_n, coalesce(sum(wins) filter (p >= live), 0) as live_wins from lv2 group by 1, 2),
 sw as (select sport, stat_type, x, sum(n) as n, sum(wins) as wins from cnt, (select round(0.5 + 0.025 * i, 3)::double as x from (select unnest(range(0, 13)) as i)) where p >= x group by 1, 2, 3 having sum(n) >= 15),
 rk as (select *, {wilson_sql('wins', 'n', '1.0', '-')} as lb, row_number() over (partition by sport, stat_type order by {wilson_sql('wins', 'n', '1.0', '-')} desc, x) as k from sw)"""


@query("g09_cutoff_sweep", f"with {CELLS}, {choose_sql('grid', '')}, {SWEEP} select sport, stat_type, live as live_cutoff, cast(live_n as bigint) as live_n, round(case when live_n > 0 then live_wins / cast(live_n as double) end, 6) as live_hit, x as best_cutoff, cast(n as bigint) as n, round(wins / cast(n as double), 6) as best_hit, round(3 * lb * lb - 1, 6) as best_roi, lb >= 0.577 and (live_n = 0 or coalesce(abs(x - live) > 0.05 + 1e-9 and abs(live_wins / cast(live_n as double) - wins / cast(n as double)) > 0.07, false)) as material from rk join lq using (sport, stat_type) where k = 1")
def g09(s, d):
    rows = ledger(s, d)
    return rounded(lg.cutoff_sweep(rows, lg.cutoffs(rows)))


@query("g10_blend_weights", f"with t as (select sport, count(*) as n, sum((model_prob - market_prob) * (model_prob - market_prob)) as aa, sum((model_prob - market_prob) * (market_prob - win)) as ab, sum((market_prob - win) * (market_prob - win)) as bb from ({LEDGER}) group by 1), g as (select t.*, i / 20.0::double as w, round((i / 20.0::double * i / 20 * aa + 2 * i / 20.0::double * ab + bb) / n, 9) as brier from t, (select unnest(range(0, 21)) as i)), r as (select *, row_number() over (partition by sport order by brier, w) as k from g) select sport, n, w as weight, round(brier, 6) as brier from r where k = 1")
def g10(s, d):
    return rounded(lg.blend_weights(ledger(s, d), ["sport"]))


@query("g11_platt_global")
def g11(s, d):
    return rounded(lg.platt_global(ledger(s, d)))


@query("g12_platt_cells")
def g12(s, d):
    return rounded(lg.platt_cells(ledger(s, d), list(lg.KEYS)))


#: Points of a calibrator; the SQL maps p the same way.
CALIBRATOR = ((0.2, 0.31270413), (0.5, 0.5213), (0.8, 0.72910727))


def calibrated_sql(p: str) -> str:
    (a, x), (b, y), (c, z) = CALIBRATOR
    return f"case when {p} < {a} then {x} when {p} >= {c} then {z} when {p} < {b} then {x} + ({p} - {a}) * ({y} - {x}) / ({b} - {a}) else {y} + ({p} - {b}) * ({z} - {y}) / ({c} - {b}) end"


def calibrators(s, stat):
    xs, ys = (list(v) for v in zip(*CALIBRATOR, strict=True))
    return s.createDataFrame([(stat, xs, ys)], "stat_type string, xs array<double>, ys array<double>")


def price_sql(line: str, mean: str, binary: str) -> str:
    return f"case when not {binary} then {poisson_over_sql(line, mean)} when {line} < 1 then {mean} else {poisson_over_sql(line, f'(-ln(1 - {mean} + 1e-9))')} end"


@query("g13_score_board", f"""with m as (select player_id, stat_type, case when stat_type = 'F' then avg(quantity) / 5 else least(avg(quantity) / 51.3, 0.95) end as mean from ({LEDGER}) group by 1, 2),
 t as (select pick_id, l.stat_type, line_id % 8 + 0.5::double as line, mean from ({LEDGER}) l join m on m.player_id = l.player_id and m.stat_type = l.stat_type), k as (select distinct stat_type, line, mean from t where not (stat_type = 'F' and line < 1.5)),
 p as (select *, {price_sql('line', 'mean', "(stat_type = 'O')")} as raw from k), u as (select stat_type, line, mean, cast(case when stat_type = 'F' then {calibrated_sql('raw')} else raw end as double) as p from p)
select pick_id, round(p, 6) as p_over, case when p > 0.5 then 'over' else 'under' end as direction, round(greatest(p, 1 - p), 6) as model_prob, round(greatest(p, 1 - p) - 0.5, 6) as edge from t join u using (stat_type, line, mean)""")
def g13(s, d):
    rows = ledger(s, d)
    mean = F.avg("quantity")
    m = rows.groupBy("player_id", "stat_type").agg(F.when(C("stat_type") == "F", mean / 5).otherwise(F.least(mean / 51.3, F.lit(0.95))).alias("mean"))
    t = rows.select("pick_id", "player_id", "stat_type", (C("line_id") % 8 + 0.5).alias("line_value"), (C("stat_type") == "O").alias("is_binary")).join(m, ["player_id", "stat_type"])
    return rounded(board.prices(t, calibrators(s, "F"), {"F": 1.5}).select("pick_id", "p_over", "direction", "model_prob", "edge"))


@query("g14_combo_means", f"with m as (select player_id, sport, avg(quantity) as mean from ({LEDGER}) group by 1, 2), c as (select * from (values ('AN', 'A', 2), ('AN', 'N', 2), ('ANR', 'A', 3), ('ANR', 'N', 3), ('ANR', 'R', 3)) v(combo, part, need)) select player_id, combo, round(sum(mean), 6) as combo_mean from m join c on part = sport group by 1, 2, need having count(*) = need")
def g14(s, d):
    m = ledger(s, d).groupBy("player_id", "sport").agg(F.avg("quantity").alias("mean"))
    return rounded(lg.combo_edges(m, {"AN": ["A", "N"], "ANR": ["A", "N", "R"]}, ["player_id"], "sport", "mean"))


AVAILABILITY = f"""with a as (select player_game_id, team_id % 3 * 10 as minutes_out, {', '.join(f"avg(4.137::double * minutes) over (partition by team_id order by game_date, player_game_id rows between {n} preceding and 1 preceding) as a{n}" for n in (5, 10, 20))}, avg(4.137::double * minutes) over (partition by team_id, season order by game_date, player_game_id rows between unbounded preceding and 1 preceding) as s from ({DENSE})),
 b as (select *, case when minutes_out >= 15 and coalesce(a5, s, 0) >= 5 then 14.0::double else 0 end as bump, coalesce((coalesce(a5 * 0.5::double, 0) + coalesce(a10 * 0.3::double, 0) + coalesce(a20 * 0.2::double, 0)) / nullif(case when a5 is null then 0 else 0.5::double end + case when a10 is null then 0 else 0.3::double end + case when a20 is null then 0 else 0.2::double end, 0), s, 0) as base from a),
 c as (select *, round(greatest(base, bump), 1) as projected, coalesce(a5, base) < 8 and bump < 12 as bench, coalesce(a20 > 0 and a5 < 0.55 * a20 and a5 < 18, false) as collapse from b)"""


@query("g15_availability", f"{AVAILABILITY} select player_game_id, projected, bench or collapse as dnp_risk, projected < 12 or bench or collapse as suppressed, case when projected < 12 then 'minutes' when bench then 'bench' when collapse then 'collapse' end as reason from c")
def g15(s, d):
    from fieldbook.functions.scalars import availability, teammate_bump

    rows = dense_rows(s, d).withColumn("minutes", 4.137 * C("minutes"))
    t = w.prior_means(rows, ["team_id"], ["game_date", "player_game_id"], ["minutes"], (5, 10, 20), fill=None)
    t = t.withColumn("season_avg_minutes", F.avg("minutes").over(w.before(w.entity(["team_id", "season"], ["game_date", "player_game_id"]))))
    last5, last10, last20, season = (C(f"{n}_avg_minutes") for n in ("last_5", "last_10", "last_20", "season"))
    got = availability(last5, last10, last20, season, teammate_bump(last5, season, C("team_id") % 3 * 10))
    return t.select("player_game_id", got.alias("a")).select("player_game_id", "a.*")


@query("g16_injury_expansion", f"with n as (select max(game_date) as now from ({DENSE})), r as (select team_id, opponent_id as player, avg(minutes) as m from ({DENSE}), n where datediff('day', game_date, now) between 1 and 200 and minutes >= 2 group by 1, 2 having count(*) >= 2), l as (select team_id, sum(case when player % 4 = 0 then m else 0 end) as lost from r group by 1) select r.team_id, player, round(m, 6) as mean_minutes, round(lost, 6) as minutes_lost from r join l using (team_id) where lost >= 5 and player % 4 <> 0")
def g16(s, d):
    rows = dense_rows(s, d).withColumnRenamed("opponent_id", "player")
    now = rows.agg(F.max("game_date").alias("now"))
    out = rows.where("player % 4 = 0").select("player")
    return rounded(lg.injury_expansion(rows.join(F.broadcast(now)), out, C("now"), team="team_id", player="player", day="game_date", minutes="minutes", days=200, games=2, floor=2.0, lost=5.0))


@query("g17_suppression", f"with l as (select distinct player_id, stat_type, line_id from ({LEDGER}) where game_id % 2 = 0), t as (select p.*, model_prob - market_prob as edge, l.line_id is not null as seen from ({LEDGER}) p left join l on l.player_id = p.player_id and l.stat_type = p.stat_type and l.line_id = p.line_id), r as (select case when round(edge, 6) < 0.05 then 'low_edge' when player_id % 10 = 3 then 'out' when settled = decided and line_id % 7 = 0 then 'stale_game' when quantity > 45 then 'line_band' when model_prob > 0.84 then 'too_sure' when quantity < 4 then 'availability' when seen then 'duplicate' else 'kept' end as reason from t) select reason, count(*) as n from r group by 1")
def g17(s, d):
    rows = ledger(s, d)
    t = rows.withColumns({"edge": F.round(C("model_prob") - C("market_prob"), 6), "is_out": C("player_id") % 10 == 3, "game_date": C("decided"), "run_date": F.when((C("settled") == C("decided")) & (C("line_id") % 7 == 0), F.date_add("decided", 1)).otherwise(C("decided")), "line_ok": C("quantity") <= 45, "projected_minutes": F.when(C("quantity") < 4, 5.0).otherwise(20.0)})
    out = lg.suppression(t, rows.where("game_id % 2 = 0"), ["player_id", "stat_type", "line_id"], most_prob=0.84)
    return out.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("g18_final_probability")
def g18(s, d):
    rows = ledger(s, d)
    out = lg.final_probability(rows, lg.platt_cells(rows, list(lg.KEYS)), lg.blend_weights(rows, ["sport"]), lg.KEYS, ["sport"])
    return out.select("pick_id", "final_prob", "edge", "stake")


#: The board: suppliers' lines by return flag are the history of three stats, R being binary; the picks' lines are on offer, some of them on A + N.
OFFER = f"select player_id, case when line_id % 5 = 0 then 'AN' else sport end as stat_type, line_id % 8 + 0.5::double as line_value, decided, market_prob from ({LEDGER})"
BOARD = f"""h as (select team_id as player_id, position as stat_type, game_date, player_game_id, points from ({DENSE})), g as (select player_id, max(game_date) + cast(1 + player_id % 3 as int) as game_date from h group by 1),
 r as (select h.*, g.game_date as ahead, row_number() over (partition by player_id, stat_type order by h.game_date desc, player_game_id desc) as k from h join g using (player_id)),
 f as (select player_id, stat_type, ahead as game_date, avg(points) filter (k <= 5) as last5, coalesce(avg(points) filter (year(r.game_date) = year(ahead)), 0) as season from r group by 1, 2, 3),
 m as (select player_id, stat_type, game_date, case when stat_type = 'R' then least(last5 / 61.7, 0.95) else (0.6 * last5 + 0.4 * season) / 5 end as mean from f),
 m2 as (select * from m union all select player_id, 'AN', game_date, sum(mean) from m where stat_type in ('A', 'N') group by 1, 3 having count(*) = 2),
 o as ({OFFER}), fresh as (select distinct player_id, stat_type, line_value from (select *, max(decided) over (partition by stat_type) as newest from o) where decided >= newest - 30),
 raw as (select player_id, stat_type, line_value, game_date, {price_sql('line_value', 'mean', "(stat_type = 'R')")} as p from m2 join fresh using (player_id, stat_type) where not (stat_type = 'N' and line_value < 1.5)),
 cal as (select player_id, stat_type, line_value, game_date, cast(case when stat_type = 'A' then {calibrated_sql('p')} else p end as double) as p from raw), sided as (select *, case when p > 0.5 then 'over' else 'under' end as direction, case when p > 0.5 then p else 1 - p end as q from cal),
 mk as (select player_id, stat_type, line_value, avg(market_prob) as mp from o group by 1, 2, 3), one as (select min(game_date) as changed from g),
 fin as (select player_id, stat_type, line_value, game_date, direction, case stat_type || direction when 'Aover' then 1 / (1 + exp(-(0.9 * ln(q / (1 - q)) + 0.05))) when 'Nunder' then 1 / (1 + exp(-(0.8 * ln(q / (1 - q)) - 0.1))) else q end as q, mp + case when game_date = changed then 0.0413 else 0 end as mp from sided join mk using (player_id, stat_type, line_value), one),
 done as (select *, round(0.7 * q + 0.3 * case when direction = 'over' then mp else 1 - mp end, 4) as model_prob from fin)"""


@query("g19_score_universe", f"with {BOARD} select player_id as game_id, player_id, stat_type, line_value, game_date, direction, model_prob, round(model_prob - 0.5, 4) as edge, round(greatest(0, (3 / (1 + exp(-(0.95 * ln(model_prob / (1 - model_prob)) - 0.02))) - 1) / 4), 4) as ev from done")
def g19(s, d):
    rows = dense_rows(s, d)
    history = rows.select(C("team_id").alias("player_id"), C("position").alias("stat_type"), C("player_game_id").alias("row_id"), "game_date", "season", C("points").alias("value"))
    last = rows.groupBy(C("team_id").alias("player_id")).agg(F.max("game_date").alias("last"))
    games = written(last.select("player_id", C("player_id").alias("game_id"), F.date_add("last", (1 + C("player_id") % 3).cast("int")).alias("game_date"), F.lit("x").alias("sport")))
    ahead = written(history.select("player_id", "stat_type").distinct().join(games, "player_id").withColumn("season", F.year("game_date").cast("string")))
    o = ledger(s, d).select("player_id", F.when(C("line_id") % 5 == 0, "AN").otherwise(C("sport")).alias("stat_type"), (C("line_id") % 8 + 0.5).alias("line_value"), C("decided").cast("timestamp").alias("snapshot_at"), "market_prob")
    o = written(o)  # the stored lines, which both runs read
    market = written(o.groupBy("player_id", "stat_type", "line_value").agg(F.avg("market_prob").alias("over_prob")))
    last5, season = C("last_5_avg_value"), C("season_avg_value")
    models = board.Models(
        mean=F.when(C("stat_type") == "R", F.least(last5 / 61.7, F.lit(0.95))).otherwise((0.6 * last5 + 0.4 * season) / 5), binary=("R",), combos={"AN": ("A", "N")}, calibrators=calibrators(s, "A"),
        cells=s.createDataFrame([("x", "A", "over", 0.9, 0.05, True), ("x", "N", "under", 0.8, -0.1, True)], "sport string, stat_type string, direction string, slope double, intercept double, fitted boolean"),
        weights=s.createDataFrame([("x", 0.7)], "sport string, weight double"), display=(0.95, -0.02), least_line={"N": 1.5},
    )
    path = fresh_folder(s, "board")
    board.update_board(board.board(history, ahead, o, market, models, 30 * 24), path, F.lit(1))
    # the market moves for the games of one day: the second run scores these and replaces that day's files alone
    day = F.broadcast(games.agg(F.min("game_date").alias("game_date")))
    some = ahead.join(day, "game_date")
    moved = market.join(games.join(day, "game_date").select("player_id"), "player_id").withColumn("over_prob", C("over_prob") + 0.0413)
    scored = board.board(history.join(some.select("player_id").distinct(), "player_id"), some, o, moved, models, 30 * 24)
    board.update_board(scored, path, F.lit(2))
    return s.read.parquet(path).select("game_id", "player_id", "stat_type", "line_value", "game_date", "direction", "model_prob", "edge", "ev")


@query("g20_closing_line_value", f"with v as (select * from ({SNAPSHOTS}) where event_type = 'view'), p as (select * from ({SNAPSHOTS}) where event_type = 'purchase') select p.line_id, round(case when p.line_id % 2 = 0 then v.line_value - p.line_value else p.line_value - v.line_value end, 6) as clv, abs(v.line_value - p.line_value) >= 8 as steam from p asof join v on p.player_id = v.player_id and p.snapshot_at >= v.snapshot_at")
def g20(s, d):
    from fieldbook.operators.joins import as_of

    rows = snapshots(s, d)
    views = rows.where("event_type = 'view'").withColumnRenamed("line_value", "line_close")
    t = as_of(rows.where("event_type = 'purchase'").select("line_id", "player_id", "snapshot_at", "line_value"), views, ["player_id"], "snapshot_at", "snapshot_at", ["line_close"]).where("line_close is not null")
    side = F.when(C("line_id") % 2 == 0, "over").otherwise("under")
    return t.select("line_id", r6(clv_points(C("line_value"), C("line_close"), side)).alias("clv"), (F.abs(C("line_close") - C("line_value")) >= 8).alias("steam"))


@query("g21_recommended", f"select pick_id, case when line_id % 2 = 0 then model_prob * case when quantity > 25 then 1 + quantity * 4 / 100 else 1 + 100 / (quantity * 4 + 100) end - 1 > 0 else model_prob >= 0.7 end as recommended from ({LEDGER})")
def g21(s, d):
    odds = F.when(C("line_id") % 2 == 0, F.when(C("quantity") > 25, C("quantity") * 4).otherwise(-(C("quantity") * 4 + 100)))
    return ledger(s, d).select("pick_id", lg.recommended_flag(C("model_prob"), F.lit(0.7), odds).alias("recommended"))


@query("g22_proven_segments", f"with {DATED}, w as ({WALK}), r as (select sport, stat_type, count(*) as n, sum(win) as wins from w where model_prob >= cutoff group by 1, 2), ok as (select sport, stat_type from r where n >= 30 and {wilson_sql('wins', 'n', '1.96', '-')} >= 0.577) select pick_id, round(case when ok.sport is not null then greatest(0, (3 * model_prob - 1) / 4) else 0 end, 6) as stake from ({LEDGER}) p left join ok on ok.sport = p.sport and ok.stat_type = p.stat_type")
def g22(s, d):
    rows = ledger(s, d)
    seg = lg.proven(lg.walk_forward(rows), ["sport", "stat_type"])
    return rounded(lg.gated_kelly(rows, seg, ["sport", "stat_type"]).select("pick_id", "stake"))


@query("g25_blend_backfill", f"with m as (select player_id, stat_type, quantity, avg(market_prob) as m from ({LEDGER}) group by 1, 2, 3), t as (select pick_id, model_prob, round(0.6 * model_prob + 0.4 * case when direction = 'under' then 1 - m else m end, 4) as p from ({LEDGER}) join m using (player_id, stat_type, quantity)) select pick_id, p as new_prob from t where p <> model_prob")
def g25(s, d):
    from fieldbook.functions.scalars import blend, side_adjusted

    rows = ledger(s, d)
    m = rows.groupBy("player_id", "stat_type", "quantity").agg(F.avg("market_prob").alias("m"))
    t = rows.join(m, ["player_id", "stat_type", "quantity"]).withColumn("new_prob", F.round(blend(C("model_prob"), side_adjusted(C("m"), C("direction")), F.lit(0.6)), 4))
    return t.where("new_prob <> model_prob").select("pick_id", "new_prob")


@query("g26_forensics", f"with t as (select sport, settled as moment, count(*) as n, count(*) filter (settled > decided + 1) as late, count(*) filter (line_id % 7 = 0) as bare from ({LEDGER}) group by 1, 2) select sport, cast(sum(n) as bigint) as n, max(n) as top_burst, count(distinct strftime(moment, '%Y-%m')) as months, round(sum(late) / cast(sum(n) as double), 6) as late_share, round(sum(bare) / cast(sum(n) as double), 6) as bare_share from t group by 1")
def g26(s, d):
    rows = ledger(s, d).withColumns({"picked_at": C("settled").cast("timestamp"), "game_start": F.date_add("decided", 1).cast("timestamp"), "line_value": F.when(C("line_id") % 7 != 0, C("quantity"))})
    return rounded(lg.forensics(rows, ["sport"]))


@query("g27_stuck_picks", f"select count(*) as stuck from ({LEDGER}) where pick_id % 4 = 0 and datediff('day', decided, date '2001-08-02') > 2")
def g27(s, d):
    from fieldbook.plans.quality import stuck

    rows = ledger(s, d).withColumn("leg_result", F.when(C("pick_id") % 4 != 0, "win"))
    return stuck(rows, "leg_result", "decided", F.lit("2001-08-02").cast("date"))


#: A day's board: the picks of the last day but some; orders are the games, nations the teams, customers' orders the players' games.
SHOWN = f"""t as (select *, case when pick_id % 13 = 0 then 'void' end as leg_result, case when pick_id % 17 <> 0 then 8 + line_id % 31 * 1.1 end as predicted_mean, round(model_prob - market_prob - 0.2, 6) as edge, (line_id % 21 - 10) / 100.0 as moved from ({LEDGER})), day as (select cast(max(o_orderdate) as date) - 1 as d from orders),
 g as (select o_orderkey as game_id, case o_orderstatus when 'F' then 'mlb' when 'O' then 'nba' else 'nhl' end as sport, cast(o_orderdate as date) as game_date, o_custkey % 25 as home, o_custkey % 31 as away, case when o_orderkey % 3 <> 0 then (o_orderkey % 37 - 18) / 2.0 end as wind, o_orderkey % 10 = 0 as dome from orders),
 past as (select player_id, stat_type, quantity as actual, row_number() over (partition by player_id, stat_type order by decided desc, game_id desc, pick_id desc) as r from ({LEDGER}), day where decided < d and settled = decided),
 p as (select t.*, g.sport as league, home, away, wind, dome from t join g using (game_id), day where decided = d and game_date = d and coalesce(leg_result, '') <> 'void' and predicted_mean is not null and g.sport <> 'nhl'),
 f as (select pick_id, count(*) filter (r <= 5 and actual <> quantity and (actual > quantity) = (direction = 'over')) as h5, count(*) filter (r <= 5 and actual <> quantity) as d5, count(*) filter (r <= 10 and actual <> quantity and (actual > quantity) = (direction = 'over')) as h10, count(*) filter (r <= 10 and actual <> quantity) as d10 from p left join past using (player_id, stat_type) group by 1),
 b as (select p.*, h5, d5, h5 || '/' || d5 as l5, h10 || '/' || d10 as l10, 1 / (1 + exp(-(0.91 * ln(model_prob / (1 - model_prob)) - 0.013))) as shown from p join f using (pick_id)),
 i as (select *, list_filter([case when d5 >= 3 and h5 / cast(d5 as double) >= 0.6 then 'hit ' || upper(direction) || ' ' || l5 || ' last 5' end, case when edge >= 0.05 then '+' || cast(round_even(edge * 100, 0) as bigint) || '% vs market' end, case when abs(moved) >= 0.05 and ((moved > 0 and direction = 'over') or (moved < 0 and direction = 'under')) then 'line moving your way' end], lambda x: x is not null) as bits from b)"""


@query("g28_board_rows", f"with {SHOWN} select pick_id, league as sport, s_name as player, n.n_name as team, coalesce(a.n_name, '?') || ' @ ' || coalesce(h.n_name, '?') as matchup, stat_type, direction, quantity as line_value, round(predicted_mean, 6) as predicted_mean, round(100 * (predicted_mean - quantity) / quantity, 6) as edge_pct, case when dome then 'dome (neutral)' when wind >= 5 then 'wind out +' || cast(round_even(wind, 0) as bigint) when wind <= -5 then 'wind in ' || cast(round_even(wind, 0) as bigint) when wind is not null then 'calm' end as weather, l5, l10, case when len(bits) > 0 then array_to_string(bits, ' · ') else 'model ' || cast(round_even(shown * 100, 0) as bigint) || '% confident' end as insight from i join supplier on s_suppkey = player_id left join nation n on n.n_nationkey = s_nationkey left join nation h on h.n_nationkey = home left join nation a on a.n_nationkey = away")
def g28(s, d):
    o, sup = table(s, d, "orders"), table(s, d, "supplier")
    pick = C("pick_id")
    last = o.agg(F.date_sub(F.max(C("o_orderdate").cast("date")), 1).alias("d")).first()["d"]
    of_day = written(ledger(s, d, small(o.where(C("o_orderdate").cast("date") == F.lit(last)))))
    shown = small(of_day.select(C("player_id").alias("l_suppkey"), C("stat_type").alias("l_linestatus")).distinct())
    rows = ledger(s, d, lines=table(s, d, "lineitem").join(shown, ["l_suppkey", "l_linestatus"], "left_semi"))  # all that the day's form can read
    picks = of_day.withColumns({"leg_result": F.when(pick % 13 == 0, "void"), "predicted_mean": F.when(pick % 17 != 0, 8 + C("line_id") % 31 * 1.1), "edge": F.round(C("model_prob") - C("market_prob") - 0.2, 6), "line_movement": (C("line_id") % 21 - 10) / 100.0, "line_value": C("quantity"), "picked_on": C("decided")}).drop("sport")
    league = F.when(C("o_orderstatus") == "F", "mlb").when(C("o_orderstatus") == "O", "nba").otherwise("nhl")
    games = o.select(C("o_orderkey").alias("game_id"), league.alias("sport"), C("o_orderdate").cast("date").alias("game_date"), (C("o_custkey") % 25).alias("home_team_id"), (C("o_custkey") % 31).alias("away_team_id"))
    weather = o.select(C("o_orderkey").alias("game_id"), F.when(C("o_orderkey") % 3 != 0, (C("o_orderkey") % 37 - 18) / 2.0).alias("wind_out"), (C("o_orderkey") % 10 == 0).alias("is_dome"))
    teams = table(s, d, "nation").select(C("n_nationkey").alias("team_id"), C("n_name").alias("team"))
    players = sup.select(C("s_suppkey").alias("player_id"), C("s_name").alias("player"), C("s_nationkey").alias("team_id"))
    actuals = rows.where((C("decided") < F.lit(last)) & (C("settled") == C("decided"))).select("player_id", "stat_type", C("decided").alias("game_date"), F.struct("game_id", "pick_id").alias("game_id"), C("quantity").alias("actual"))
    boards = [board.board_rows(picks, players, teams, games, weather, actuals, F.lit(last), league=x, stats=("O", "F"), display=(0.91, -0.013)) for x in ("MLB", "nba")]
    return rounded(boards[0].unionByName(boards[1]))


@query("g29_active_players", f"with l as (select player_id, max_by(sport, (decided, pick_id)) as sport, max(decided) as last from ({LEDGER}) group by 1), m as (select sport, max(last) as newest from l group by 1) select player_id, l.sport, last from l join m using (sport) where datediff('day', last, newest) <= 150")
def g29(s, d):
    t = ledger(s, d).groupBy("player_id").agg(F.max_by("sport", F.struct("decided", "pick_id")).alias("sport"), F.max("decided").alias("last"))
    newest = t.groupBy("sport").agg(F.max("last").alias("newest"))
    return t.join(newest, "sport").where(F.datediff("newest", "last") <= 150).select("player_id", "sport", "last")


@query("g30_market_edge", f"with q as (select player_id, stat_type, quantity, avg(market_prob) as m from ({LEDGER}) where line_id % 3 = 0 group by 1, 2, 3) select pick_id, round(model_prob - coalesce(case when direction = 'under' then 1 - m else m end, 0.5), 4) as edge from ({LEDGER}) left join q using (player_id, stat_type, quantity)")
def g30(s, d):
    rows = ledger(s, d)
    quotes = rows.where("line_id % 3 = 0").select("player_id", "stat_type", "quantity", C("market_prob").alias("over_prob"))
    return lg.market_edge(rows, quotes, ["player_id", "stat_type", "quantity"]).select("pick_id", "edge")
