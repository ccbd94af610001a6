"""Scalar functions (2.2) over columns of the star-schema tables."""

from pyspark.sql import functions as F

from fieldbook.functions import counts
from fieldbook.functions import scalars as x
from fieldbook.queries.base import LEDGER, ledger, query, r6, rounded, table

C = F.col
#: Fixed values of the examples.
PARKS = (("nation_1", 1.12), ("nation_2", 1.05), ("7", 0.93))
BANDS = (("A", 5.0, 30.0), ("N", None, 40.0))
COMBOS = {"ring": "guard", "widget": "center"}
ID = "l_orderkey, l_partkey, l_suppkey, l_linenumber"
KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
ODDS = "case when l_linenumber % 2 = 0 then 100 + cast(l_quantity as bigint) * 5 else -(100 + cast(l_quantity as bigint) * 3) end"
UNDER = "-(105 + l_partkey % 50)"


def odds():  # noqa: ANN201
    q = C("l_quantity").cast("bigint")
    return F.when(C("l_linenumber") % 2 == 0, 100 + q * 5).otherwise(-(100 + q * 3)), -(105 + C("l_partkey") % 50)


@query("b01_json_stats", "select event_id, cast(json_extract_string(props, '$.k') as double) as k, cast(0 as double) as missing from events")
def b01(s, d):
    return table(s, d, "events").select("event_id", x.stat(C("props"), "k").alias("k"), x.stat(C("props"), "absent").alias("missing"))


@query("b02_stat_alias", "select event_id, cast(json_extract_string(props, '$.k') as double) as threes from events")
def b02(s, d):
    return table(s, d, "events").select("event_id", x.stat(C("props"), "threes", "fg3_made", "k").alias("threes"))


@query("b03_combo_stats", f"select {ID}, case when l_linenumber = 3 then null else l_quantity + l_linenumber end as strict_sum, l_quantity + case when l_linenumber = 3 then 0 else l_linenumber end as shown_sum from lineitem")
def b03(s, d):
    part = F.when(C("l_linenumber") != 3, C("l_linenumber").cast("double"))
    return table(s, d, "lineitem").select(*KEY, x.combo([C("l_quantity"), part]).alias("strict_sum"), x.combo([C("l_quantity"), part], strict=False).alias("shown_sum"))


@query("b04_efficiency", f"select {ID}, round(least(greatest(case when l_linenumber > 1 then (l_quantity / 10) / (l_linenumber - 1) else 0 end, 0), 2), 6) as rate from lineitem")
def b04(s, d):
    return table(s, d, "lineitem").select(*KEY, r6(x.clip(x.ratio(C("l_quantity") / 10, C("l_linenumber") - 1), 0.0, 2.0)).alias("rate"))


@query("b05_american_odds", f"with t as (select {ID}, {ODDS} as odds from lineitem) select {ID}, round(case when odds > 0 then 100 / cast(odds + 100 as double) else -odds / cast(-odds + 100 as double) end, 6) as implied, round(case when odds > 0 then 1 + odds / cast(100 as double) else 1 + 100 / cast(-odds as double) end, 6) as payout from t")
def b05(s, d):
    o, _ = odds()
    return table(s, d, "lineitem").select(*KEY, r6(x.american_implied(o)).alias("implied"), r6(x.american_decimal(o)).alias("payout"))


@query("b06_no_vig", f"with t as (select {ID}, {ODDS} as a, {UNDER} as b from lineitem), u as (select *, case when a > 0 then 100 / cast(a + 100 as double) else -a / cast(-a + 100 as double) end as p, -b / cast(-b + 100 as double) as q from t) select {ID}, round(p / (p + q), 6) as over_prob from u")
def b06(s, d):
    a, b = odds()
    return table(s, d, "lineitem").select(*KEY, r6(x.no_vig(a, b)).alias("over_prob"))


POISSON = "(select sum(exp(-mean + i * ln(mean) - lgamma(i + 1))) from generate_series(0, cast(floor(line) as bigint)) g(i))"


@query("b07_poisson_over", f"with t as (select distinct l_linenumber as line_no, l_linenumber - 0.5::double as line, l_quantity / 5 as mean from lineitem) select line_no, mean, round(1 - {POISSON}, 6) as p_over from t")
def b07(s, d):
    t = table(s, d, "lineitem").select(C("l_linenumber").alias("line_no"), (C("l_linenumber") - 0.5).alias("line"), (C("l_quantity") / 5).alias("mean")).distinct()
    return t.select("line_no", "mean", r6(counts.poisson_over(C("line"), C("mean"))).alias("p_over"))


@query("b08_negative_binomial_over", """
with t as (select distinct l_linenumber as line_no, l_linenumber - 0.5::double as line, l_quantity / 5 as mean, 1.5::double as phi from lineitem), u as (select *, mean / (phi - 1) as r from t)
select line_no, mean, round(1 - (select sum(exp(lgamma(i + r) - lgamma(r) - lgamma(i + 1) - r * ln(phi) + i * ln((phi - 1) / phi))) from generate_series(0, cast(floor(line) as bigint)) g(i)), 6) as p_over from u""")
def b08(s, d):
    t = table(s, d, "lineitem").select(C("l_linenumber").alias("line_no"), (C("l_linenumber") - 0.5).alias("line"), (C("l_quantity") / 5).alias("mean")).distinct()
    return t.select("line_no", "mean", r6(counts.count_over(C("line"), C("mean"), F.lit(1.5))).alias("p_over"))


@query("b09_binary_price", f"""
with t as (select distinct l_linenumber as line_no, l_linenumber - 0.5::double as line, (5 + l_quantity) / 60 as p from lineitem), u as (select *, -ln(1 - p + 1e-9) as mean from t)
select line_no, round(p, 6) as p, round(case when line < 1 then p else 1 - {POISSON} end, 6) as p_over from u""")
def b09(s, d):
    t = table(s, d, "lineitem").select(C("l_linenumber").alias("line_no"), (C("l_linenumber") - 0.5).alias("line"), ((5 + C("l_quantity")) / 60).alias("p")).distinct()
    return rounded(t.withColumn("p_over", counts.binary_over(C("line"), C("p"))).drop("line"))


def poisson_over_sql(line: str, mean: str) -> str:
    return f"(1 - list_sum(list_transform(range(0, cast(floor({line}) as bigint) + 1), lambda k: exp(-({mean}) + k * ln({mean}) - lgamma(k + 1)))))"


def implied_sql(pairs: str) -> str:
    """CTE imp (line, prob, mean) by 60 halvings; pairs: a table of distinct (line, prob)."""
    mid = "(lo + hi) / 2"
    up = f"{poisson_over_sql('line', mid)} < prob"
    return f"""halves as (select line, prob, 0.01::double as lo, 250.0::double as hi, 0 as i from {pairs} union all select line, prob, case when {up} then {mid} else lo end, case when {up} then hi else {mid} end, i + 1 from halves where i < 60),
 imp as (select line, prob, {mid} as mean from halves where i = 60)"""


@query("b10_implied_mean", f"with recursive t as (select distinct player_id % 8 + 0.5::double as line, model_prob as prob from ({LEDGER})), {implied_sql('t')} select line, prob as model_prob, round(mean, 6) as mean, round({poisson_over_sql('line', 'mean')}, 6) as round_trip from imp")
def b10(s, d):
    t = ledger(s, d).select((C("player_id") % 8 + 0.5).alias("line"), "model_prob").distinct()
    t = t.withColumn("mean", counts.implied_mean(C("line"), C("model_prob")))
    return t.select("line", "model_prob", r6("mean").alias("mean"), r6(counts.poisson_over(C("line"), C("mean"))).alias("round_trip"))


@query("b11_poisson_quantile", """
with m as (select distinct l_quantity / 5 as mean from lineitem), c as (select mean, k, (select sum(exp(-mean + i * ln(mean) - lgamma(i + 1))) from generate_series(0, k) g(i)) as p from m, (select unnest(range(0, 60)) as k))
select mean, cast(min(case when p >= 0.25 - 1e-12 then k end) as double) as q25, cast(min(case when p >= 0.9 - 1e-12 then k end) as double) as q90 from c group by mean""")
def b11(s, d):
    m = table(s, d, "lineitem").select((C("l_quantity") / 5).alias("mean")).distinct()
    return m.select("mean", counts.poisson_quantile(F.lit(0.25), C("mean")).alias("q25"), counts.poisson_quantile(F.lit(0.9), C("mean")).alias("q90"))


def wilson_sql(w: str, n: str, z: str, sign: str) -> str:
    return f"(({w} / cast({n} as double) + {z} * {z} / (2 * {n})) {sign} {z} * sqrt({w} / cast({n} as double) * (1 - {w} / cast({n} as double)) / {n} + {z} * {z} / (4 * cast({n} as double) * {n}))) / (1 + {z} * {z} / cast({n} as double))"


@query("b12_wilson", f"with t as (select player_id, sum(win) as w, count(*) as n from ({LEDGER}) group by 1) select player_id, round({wilson_sql('w', 'n', '1.0', '-')}, 6) as low, round({wilson_sql('w', 'n', '1.0', '+')}, 6) as high, round({wilson_sql('w', 'n', '1.96', '-')}, 6) as low95, round({wilson_sql('w', 'n', '1.96', '+')}, 6) as high95 from t")
def b12(s, d):
    t = ledger(s, d).groupBy("player_id").agg(F.sum("win").alias("w"), F.count("*").alias("n"))
    (a, b), (e, f) = x.wilson(C("w"), C("n")), x.wilson(C("w"), C("n"), 1.96)
    return t.select("player_id", r6(a).alias("low"), r6(b).alias("high"), r6(e).alias("low95"), r6(f).alias("high95"))


@query("b13_platt_map", f"select pick_id, round(case when sport = 'R' then model_prob else 1 / (1 + exp(-(0.8 * ln(model_prob / (1 - model_prob)) - 0.1))) end, 6) as p from ({LEDGER})")
def b13(s, d):
    on = F.when(C("sport") != "R", F.lit(0.8))
    return ledger(s, d).select("pick_id", r6(x.platt(C("model_prob"), on, F.lit(-0.1))).alias("p"))


@query("b14_blend", f"select pick_id, round(case when line_id % 7 = 0 then model_prob else 0.65 * model_prob + 0.35 * market_prob end, 6) as p from ({LEDGER})")
def b14(s, d):
    return ledger(s, d).select("pick_id", r6(x.blend(C("model_prob"), F.when(C("line_id") % 7 != 0, C("market_prob")), F.lit(0.65))).alias("p"))


@query("b15_grade", f"select pick_id, case when quantity = line_id % 50 then 'push' when (quantity > line_id % 50) = (direction = 'over') then 'win' else 'loss' end as result from ({LEDGER})")
def b15(s, d):
    return ledger(s, d).select("pick_id", x.grade(C("quantity"), C("line_id") % 50, C("direction")).alias("result"))


@query("b16_clv_points", f"select pick_id, case when line_id % 9 = 0 then null when direction = 'over' then quantity - line_id % 50 else line_id % 50 - quantity end as clv from ({LEDGER})")
def b16(s, d):
    closed = F.when(C("line_id") % 9 != 0, C("quantity"))
    return ledger(s, d).select("pick_id", x.clv_points((C("line_id") % 50).cast("double"), closed, C("direction")).alias("clv"))


@query("b17_ev_and_kelly", f"select pick_id, round(model_prob * payout - 1, 6) as ev, round(3 * model_prob * model_prob - 1, 6) as roi, round(greatest(0, (3 * model_prob - 1) / 4), 6) as stake from ({LEDGER})")
def b17(s, d):
    p = C("model_prob")
    return ledger(s, d).select("pick_id", r6(x.pick_ev(p, C("payout"))).alias("ev"), r6(x.roi_two_legs(p)).alias("roi"), r6(x.half_kelly(p)).alias("stake"))


@query("b18_wind_out", "select p_partkey, round(p_size * cos(radians((p_partkey % 360 + 180) % 360 - 45)), 6) as wind from part")
def b18(s, d):
    return table(s, d, "part").select("p_partkey", r6(x.wind_out(C("p_size"), (C("p_partkey") % 360).cast("double"), F.lit(45.0))).alias("wind"))


@query("b19_park_factor", "select n_nationkey, case when lower(n_name) like '%nation\\_1%' escape '\\' then 1.12::double when lower(n_name) like '%nation\\_2%' escape '\\' then 1.05::double when n_name like '%7%' then 0.93::double else 0.98::double end as factor from nation")
def b19(s, d):
    return table(s, d, "nation").select("n_nationkey", x.first_match(C("n_name"), PARKS, 0.98).alias("factor"))


@query("b20_platoon", "with t as (select p_partkey, case p_partkey % 4 when 0 then 'L' when 1 then 'R' when 2 then 'S' end as b, case p_size % 3 when 0 then 'L' when 1 then 'R' end as p from part) select p_partkey, case when b = 'S' then 0.5::double when b is null or p is null then 0 when b <> p then 1 else -1 end as platoon from t")
def b20(s, d):
    b = F.when(C("p_partkey") % 4 == 0, "L").when(C("p_partkey") % 4 == 1, "R").when(C("p_partkey") % 4 == 2, "S")
    p = F.when(C("p_size") % 3 == 0, "L").when(C("p_size") % 3 == 1, "R")
    return table(s, d, "part").select("p_partkey", x.platoon(b, p).alias("platoon"))


@query("b21_position_group", "select p_partkey, case split_part(p_name, ' ', 2) when 'ring' then 'guard' when 'widget' then 'center' else 'forward' end as position from part")
def b21(s, d):
    word = F.split_part(C("p_name"), F.lit(" "), F.lit(2))
    return table(s, d, "part").select("p_partkey", x.position_group(word, {k.upper(): v for k, v in COMBOS.items()}).alias("position"))


#: Status texts with their meaning, out or not.
STATUSES = (
    ("Out", True), ("Doubtful", True), ("15-Day-IL", True), ("60-Day-IL", True), ("7-Day IL", True), ("suspension", True), ("developmental list", True), ("paternity", True), ("Out - knee", True),
    ("Day-To-Day", False), ("Questionable", False), ("Probable (was out)", False), ("GTD", False), ("Available", False), ("", False), (None, False), ("Active", False),
)


@query("b22_injury_status", f"with t as (select o_orderkey, ([{', '.join('null' if x is None else repr(x) for x, _ in STATUSES)}])[o_orderkey % {len(STATUSES)} + 1] as st from orders) select o_orderkey, coalesce(st in ({', '.join(repr(x) for x, out in STATUSES if out)}), false) as is_out from t")
def b22(s, d):
    st = F.element_at(F.array(*[F.lit(x).cast("string") for x, _ in STATUSES]), (C("o_orderkey") % len(STATUSES) + 1).cast("int"))
    return table(s, d, "orders").select("o_orderkey", x.is_out(st).alias("is_out"))


@query("b23_line_band", f"select pick_id, case sport when 'A' then quantity between 5 and 30 when 'N' then quantity <= 40 else true end as inside from ({LEDGER})")
def b23(s, d):
    bands = s.createDataFrame(list(BANDS), "sport string, low double, high double")
    return ledger(s, d).join(F.broadcast(bands), "sport", "left").select("pick_id", x.inside_band(C("quantity"), C("low"), C("high")).alias("inside"))


@query("b24_name_key", "select s_suppkey, trim(regexp_replace(lower(replace(s_name, '#', ' É-')), '[^a-z0-9é]+', ' ', 'g')) as name from supplier".replace("lower(replace(s_name, '#', ' É-'))", "replace(lower(replace(s_name, '#', ' É-')), 'é', 'e')"))
def b24(s, d):
    return table(s, d, "supplier").select("s_suppkey", x.name_key(F.regexp_replace("s_name", "#", " É-")).alias("name"))


@query("b25_numeric_guard", "select p_partkey, cast(case when p_partkey % 3 = 0 then p_size end as double) as size, cast(json_extract_string(props, '$.k') is not null as boolean) as has_k from part join events on p_partkey = event_id")
def b25(s, d):
    text = F.when(C("p_partkey") % 3 == 0, C("p_size").cast("string")).when(C("p_partkey") % 3 == 1, F.concat(C("p_size").cast("string"), F.lit("x")))
    t = table(s, d, "part").join(table(s, d, "events"), C("p_partkey") == C("event_id"))
    return t.select("p_partkey", x.numeric_text(text).alias("size"), F.map_contains_key(F.from_json("props", "map<string,string>"), "k").alias("has_k"))


@query("b26_model_sport", "select p_partkey, case when p_type = 'ECONOMY' then 'mlb' when p_brand like 'Brand#1%' then 'wnba' when p_brand like 'Brand#2%' then 'nba' else 'nhl' end as sport from part")
def b26(s, d):
    p = table(s, d, "part").withColumn("m", F.when(C("p_type") == "ECONOMY", C("p_type")).otherwise(C("p_brand")))
    return p.select("p_partkey", x.model_sport(C("m"), {"ECONOMY": "mlb"}, [("Brand#1", "wnba"), ("Brand#2", "nba")], "nhl").alias("sport"))


@query("b27_recency_weight", "select o_orderkey, round(pow(0.5::double, datediff('day', cast(o_orderdate as date), (select max(cast(o_orderdate as date)) from orders)) / 365::double), 6) as weight from orders")
def b27(s, d):
    from fieldbook.plans.models import recency_weighted

    t = table(s, d, "orders").withColumn("day", C("o_orderdate").cast("date"))
    return recency_weighted(t, "day").select("o_orderkey", r6("weight").alias("weight"))


@query("b28_implied_totals", f"select {ID}, (l_quantity + 200 + l_linenumber) / 2 as home_total, (l_quantity + 200 - l_linenumber) / 2 as away_total from lineitem")
def b28(s, d):
    home, away = x.implied_totals(C("l_quantity") + 200, C("l_linenumber"))
    return table(s, d, "lineitem").select(*KEY, home.alias("home_total"), away.alias("away_total"))


@query("b29_possessions", f"select {ID}, round(l_quantity + 0.4 * l_linenumber + round(l_tax * 100) - round(l_discount * 100), 6) as possessions from lineitem")
def b29(s, d):
    return table(s, d, "lineitem").select(*KEY, r6(x.possessions(C("l_quantity"), C("l_linenumber"), F.round(C("l_tax") * 100), F.round(C("l_discount") * 100))).alias("possessions"))


@query("b30_local_day", "select event_id, cast(timezone('America/Los_Angeles', timezone('UTC', ts)) as date) as day from events")
def b30(s, d):
    return table(s, d, "events").select("event_id", x.local_day(C("ts")).alias("day"))
