"""Reports over the settled ledger (2.3 C31, 2.5 E13 and E23, 2.7 G23 and G24, 2.9 I8)."""

from pyspark.sql import functions as F

from fieldbook.plans import ledger as lg
from fieldbook.plans import reports as rp
from fieldbook.queries.base import DENSE, LEDGER, dense_rows, ledger, query, rounded
from fieldbook.queries.ledger import CELLS, DATED, WALK, choose_sql
from fieldbook.queries.scalars import poisson_over_sql, wilson_sql

C = F.col


def trend_sql(rows: str, key: str) -> str:
    """CTEs ending in trend (key, i, n, wins, rate) from rows (key, settled, pick_id, win)."""
    return f"""tr as (select {key} as key, settled, pick_id, win, row_number() over (partition by {key} order by settled, pick_id) as r, count(*) over (partition by {key}) as total from {rows} where settled is not null),
 tc as (select distinct key, total, i, cast(round_even((i + 1) * total / 14, 0) as bigint) as e from tr, (select unnest(range(0, 14)) as i) where total >= 10), ts as (select *, greatest(0, e - greatest(20, total // 8)) as s from tc),
 trend as (select ts.key, i, e - s as n, cast(sum(win) as bigint) as wins, sum(win) / cast(e - s as double) as rate from ts join tr on tr.key = ts.key and r > s and r <= e where e - s >= 5 group by ts.key, i, e, s)"""


@query("c31_trailing_rate", f"with {trend_sql(f'({LEDGER})', 'sport')} select key as sport, i, n, wins, round(rate, 6) as rate from trend")
def c31(s, d):
    return rounded(rp.rank_trend(ledger(s, d), ["sport"], "settled", "pick_id", "win"))


#: Quantiles of each distinct mean, from its cumulated probabilities.
QUANTILES = """means as (select distinct mean from t), cdf as (select mean, k, (select sum(exp(-mean + i * ln(mean) - lgamma(i + 1))) from generate_series(0, k) g(i)) as p from means, (select unnest(range(0, 120)) as k)),
 qs as (select mean, min(k) filter (p >= 0.25 - 1e-12) as a, min(k) filter (p >= 0.75 - 1e-12) as b, min(k) filter (p >= 0.1 - 1e-12) as c, min(k) filter (p >= 0.9 - 1e-12) as e from cdf group by 1)"""
COVERAGE = f"with t as (select stat_type, quantity as actual, round(market_prob * 47, 6) as mean from ({LEDGER})), {QUANTILES}, x as (select stat_type, unnest([{{'i': '25_75', 'w': 0.5, 'h': actual between a and b}}, {{'i': '10_90', 'w': 0.8, 'h': actual between c and e}}], recursive := true) from t join qs using (mean))"


@query("e13_interval_coverage", f"{COVERAGE} select i as interval, stat_type, count(*) as n, round(avg(cast(h as int)), 6) as covered, abs(avg(cast(h as int)) - max(w)) > 0.1 as off from x group by grouping sets ((i), (i, stat_type)) having count(*) >= 50")
def e13(s, d):
    return rounded(rp.model_coverage(ledger(s, d).withColumn("mean", F.round(C("market_prob") * 47, 6)), "stat_type", "quantity", "mean"))


IDEAS = f"""{CELLS}, {choose_sql('grid', '')}, r as (select *, datediff('day', decided, date '2000-06-30') as age from ({LEDGER})), sg as (select sport, stat_type, direction, count(*) as n, avg(win) as rate from r where age between 0 and 20 group by 1, 2, 3 having count(*) >= 12),
 bk as (select sport, stat_type, count(*) as n, avg(win) as rate from r where age between 0 and 13 group by 1, 2 having count(*) >= 10 and avg(win) >= 0.58)"""


@query("e23_ideas", f"with {IDEAS} select * from (select 'hot' as kind, sport, stat_type, direction, n, round(rate, 6) as rate from sg where rate >= 0.66 order by sg.rate desc, sport, stat_type, direction limit 1) union all select * from (select 'cold', sport, stat_type, direction, n, round(rate, 6) from sg where rate <= 0.45 order by sg.rate, sport, stat_type, direction limit 1) union all select 'recovering', sport, stat_type, null, n, round(rate, 6) from bk where exists (select 1 from cut where level = 2 and status = 'suppressed' and a = sport and b = stat_type)")
def e23_ideas(s, d):
    rows = ledger(s, d)
    return rounded(rp.ideas(rows, lg.cutoffs(rows), F.lit("2000-06-30").cast("date")))


def summed_sql(section: str, part: str, rows: str, least: int = 1, tail: str = "") -> str:
    low, high = wilson_sql("w", "n", "1.96", "-"), wilson_sql("w", "n", "1.96", "+")
    group = "" if part == "null" else "group by 2"
    return f"select * from (select '{section}' as section, part, n, w as wins, w / cast(n as double) as value, {low} as low, {high} as high, case when {low} >= 0.577 then 'edge' when {high} < 0.577 then 'below breakeven' else 'not proven' end as label from (select 0, {part} as part, count(*) as n, cast(sum(win) as bigint) as w from {rows} {group} having count(*) >= {least}) {tail})"


PLAIN = "cast(null as double), cast(null as double), null"
BINS = "case when model_prob >= 0.7 then 5 when model_prob >= 0.65 then 4 when model_prob >= 0.6 then 3 when model_prob >= 0.55 then 2 when model_prob >= 0.5 then 1 end"
REPORT = f"""with {DATED}, wf as ({WALK}), rec as (select * from wf where model_prob >= cutoff), p as (select *, market_prob + (line_id % 11 - 5) / 100.0::double as closed from ({LEDGER})), {trend_sql('rec', '1')},
 bin as (select {BINS} as part, count(*) as n, cast(sum(win) as bigint) as w, avg(model_prob) as predicted from p group by 1 having count(*) >= 10),
 rows as ({summed_sql('recommended', 'null', 'rec')} union all {summed_sql('all', 'null', 'p')} union all {summed_sql('sport', 'sport', 'rec', 5)} union all {summed_sql('market', "stat_type || '|' || direction", 'rec', 8, 'order by n desc, part limit 8')}
 union all select 'roi', sport, count(*), cast(sum(win) as bigint), (sum(win) * (1 / 0.577::double - 1) - sum(1 - win)) / count(*), {PLAIN} from rec group by sport having count(*) >= 5
 union all select 'trend', cast(i as varchar), n, wins, rate, {PLAIN} from trend union all select 'calibration', cast(part as varchar), n, w, w / cast(n as double), predicted, null, null from bin
 union all select 'brier', null, count(*), cast(sum(win) as bigint), avg((model_prob - win) * (model_prob - win)), {PLAIN} from p union all select 'clv', null, count(*), null, avg(case when direction = 'over' then closed - market_prob else market_prob - closed end), {PLAIN} from p)"""


@query("g23_performance_report", f"{REPORT} select section, part, n, wins, round(value, 6) as value, round(low, 6) as low, round(high, 6) as high, label from rows")
def g23(s, d):
    rows = ledger(s, d)
    return rounded(rp.performance_report(rows.withColumn("market_prob_close", C("market_prob") + (C("line_id") % 11 - 5) / 100.0), lg.walk_forward(rows)))


CARD = f"""{CELLS}, {choose_sql('grid', '')}, n as (select max(decided) as last from ({LEDGER})), a as (select p.*, datediff('day', decided, last) as age, model_prob >= coalesce(c2.cutoff, c1.cutoff, 0.7) as rec from ({LEDGER}) p left join cut c2 on c2.level = 2 and c2.a = p.sport and c2.b = p.stat_type left join cut c1 on c1.level = 1 and c1.a = p.sport, n), r as (select * from a where age < 300),
 best as (select * from (select *, row_number() over (partition by decided order by model_prob desc, pick_id) as k from r where rec and age < 7) where k <= 5),
 run as (select *, sum(case when win = 1 then sqrt(3) - 1 else -1 end) over (order by decided, pick_id rows unbounded preceding) as money, max(case when win = 1 then (decided, pick_id) end) over () as lw from r where rec),
 dd as (select greatest(0, max(money)) - arg_max(money, (decided, pick_id)) as drawdown, count(*) filter (lw is null or (decided, pick_id) > lw) as streak from run having count(*) > 0), wk as (select coalesce(avg(win), 1) as wr from r where rec and age < 7)"""


def line_sql(section: str, rows: str, part: str = "null") -> str:
    return f"select '{section}' as section, {part} as part, cast(sum(win) as bigint) as wins, cast(sum(1 - win) as bigint) as losses, avg(win) as value, null as label from {rows} {'' if part == 'null' else f'group by {part}'} having count(*) > 0"


CARD_ROWS = " union all ".join(
    [line_sql("day", "r where age = 0"), line_sql("day_recommended", "r where rec and age = 0"), line_sql("sport", "r where rec and age = 0", "sport"), line_sql("week_recommended", "r where rec and age < 7"), line_sql("top_day", "best where age = 0"), line_sql("top_week", "best")]
    + ["select * from (select 'weak_spot', sport || '|' || stat_type || '|' || direction as part, cast(sum(win) as bigint), cast(sum(1 - win) as bigint), avg(win) as v, null from r group by sport, stat_type, direction having count(*) >= 8 and avg(win) < 0.5 order by v, part limit 1)", "select 'cold', null, null, streak, drawdown, nullif(concat_ws(', ', case when streak >= 6 then 'losing streak' end, case when drawdown >= 6 and wr < 0.577 then 'below peak' end), '') from dd, wk"]
)


@query("g24_scorecard", f"with {CARD} select section, part, wins, losses, round(value, 6) as value, label from ({CARD_ROWS})")
def g24(s, d):
    rows = ledger(s, d)
    return rounded(rp.scorecard(rows, lg.cutoffs(rows), days=300))


@query("i08_synthetic_lines", f"""with t as (select points / 3 as actual, assists * 0.83::double + 1.31::double as mean, greatest(round_even(turnovers * 2.31::double, 0) / 2, 0.5::double) as line, minutes as volume, game_date from ({DENSE}) where turnovers > 0), v as (select *, strftime(game_date, '%Y-%m') as month from t where actual <> line),
 k as (select distinct mean, line from v), q as (select mean, line, {poisson_over_sql('line', 'mean')} > 0.5 as up from k), c as (select quantile_cont(cast(volume as double), [0.33, 0.66]) as cuts from v),
 w as (select mean - actual as bias, cast(up = (actual > line) as int) as ok, unnest([{{'slice': 'all', 'part': null, 'least': 1}}, {{'slice': 'line', 'part': cast(line as varchar), 'least': 30}}, {{'slice': 'volume', 'part': case when volume <= cuts[1] then 'low' when volume <= cuts[2] then 'mid' else 'high' end, 'least': 1}}, {{'slice': 'month', 'part': month, 'least': 30}}], recursive := true) from v join q using (mean, line), c)
select slice, part, count(*) as n, round(avg(ok), 6) as accuracy, round(avg(bias), 6) as bias from w group by slice, part, least having count(*) >= least""")
def i08(s, d):
    t = dense_rows(s, d).select((C("points") / 3).alias("actual"), (C("assists") * 0.83 + 1.31).alias("mean"), (C("turnovers") * 1.155).alias("average"), "minutes", "game_date")
    return rounded(rp.synthetic_backtest(t, "average", "mean", "actual", "minutes", "game_date"))
