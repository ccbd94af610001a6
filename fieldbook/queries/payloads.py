"""Payload sources and run-slice sinks (2.1): payloads are built from the tables, then flattened."""

import uuid

from pyspark.sql import functions as F

from fieldbook.session import shared_dir
from fieldbook.queries.base import query, r6, rounded, table
from fieldbook.sources import payloads as p
from fieldbook.sources import tables

C = F.col
STATS = {"quantity": "qty", "tax": "tx"}
LEAGUES = {"A": "mlb", "N": "nba"}


def field(**columns):
    return F.struct(*[v.alias(k) for k, v in columns.items()])


@query("a02_line_payload", "select cast(l_partkey as varchar) || '-' || cast(l_linenumber as varchar) || '-' || cast(l_suppkey as varchar) as line_id, case l_returnflag when 'A' then 'mlb' else 'nba' end as sport, case when l_linenumber % 3 = 0 then 'qty' else 'tx' end as stat, s_name as player, l_quantity as line from lineitem join supplier on s_suppkey = l_suppkey where l_returnflag in ('A', 'N') and l_linenumber % 3 <> 1 and l_linestatus = 'F' and l_partkey % 6 <> 0 and l_suppkey % 9 <> 0")
def a02(s, d):
    rows = table(s, d, "lineitem").join(table(s, d, "supplier"), C("s_suppkey") == C("l_suppkey"))
    text = lambda c: C(c).cast("string")
    line = field(
        id=F.concat_ws("-", text("l_partkey"), text("l_linenumber"), text("l_suppkey")),
        attributes=field(line_score=C("l_quantity"), stat_type=F.when(C("l_linenumber") % 3 == 0, "quantity").when(C("l_linenumber") % 3 == 1, "unknown").otherwise("tax"), is_promo=C("l_partkey") % 6 == 0, status=F.when(C("l_linestatus") == "F", "pre_game").otherwise("live"), start_time=text("l_shipdate")),
        relationships=field(player=field(id=text("l_suppkey")), league=field(id=C("l_returnflag"))),
    )
    name = F.when(C("l_suppkey") % 9 == 0, F.concat("s_name", F.lit(" + other"))).otherwise(C("s_name"))
    people = field(type=F.lit("new_player"), id=text("l_suppkey"), attributes=field(name=name, team=text("s_nationkey")))
    leagues = field(type=F.lit("league"), id=C("l_returnflag"), attributes=field(name=C("l_returnflag"), team=F.lit(None).cast("string")))
    raw = rows.groupBy(C("l_orderkey").alias("payload_id")).agg(F.to_json(F.struct(F.collect_list(line).alias("data"), F.array_union(F.collect_set(people), F.collect_set(leagues)).alias("included"))).alias("body"))
    return p.flatten_lines(p.parse(raw, "body", p.LINES), LEAGUES, STATS).select("line_id", "sport", "stat", "player", "line")


PRICES = "select l_orderkey as event_id, cast(l_suppkey as varchar) as book, l_returnflag as market, cast(l_partkey as varchar) as player, l_quantity as line, 100 + l_linenumber * 10 as a, -(105 + l_partkey % 50) as b from lineitem where l_linenumber % 4 <> 0"


@query("a03_odds_payload", f"with t as (select event_id, book, market, player, line, max(a) as a, max(b) as b from ({PRICES}) group by all) select cast(event_id as varchar) as event_id, book, market, player, line, cast(a as bigint) as over_price, cast(b as bigint) as under_price, round((100 / cast(a + 100 as double)) / (100 / cast(a + 100 as double) + -b / cast(-b + 100 as double)), 6) as over_prob from t")
def a03(s, d):
    rows = table(s, d, "lineitem")
    quote = lambda side, price: field(name=F.lit(side), description=C("l_partkey").cast("string"), point=C("l_quantity"), price=price)
    outcomes = F.array(quote("Over", 100 + C("l_linenumber") * 10), quote("Under", -(105 + C("l_partkey") % 50)))
    m = rows.where("l_linenumber % 4 <> 0").groupBy("l_orderkey", "l_suppkey", C("l_returnflag").alias("key")).agg(F.flatten(F.collect_list(outcomes)).alias("outcomes"))
    b = m.groupBy("l_orderkey", "l_suppkey").agg(F.collect_list(F.struct("key", "outcomes")).alias("markets"))
    raw = b.groupBy("l_orderkey").agg(F.to_json(F.struct(C("l_orderkey").cast("string").alias("event_id"), F.collect_list(F.struct(C("l_suppkey").cast("string").alias("key"), "markets")).alias("bookmakers"))).alias("body"))
    return rounded(p.flatten_odds(p.parse(raw.select("body"), "body", p.ODDS)))


@query("a04_book_lines", "with t as (select o_custkey, o_orderstatus, o_orderkey, o_totalprice, o_orderkey % 5 = 0 as inactive, o_orderkey % 7 = 0 as nopay from orders), g as (select * from t where not inactive and not nopay), r as (select *, row_number() over (partition by o_custkey, o_orderstatus order by cast(o_orderkey as varchar)) as k from g) select cast(o_custkey as varchar) as player, o_orderstatus as stat, o_totalprice as line, 1.8::double as over, 1.9::double as under from r where k = 1")
def a04(s, d):
    return p.flatten_book(book(s, d)).select("player", "stat", "line", "over", "under")


def book(s, d):
    pay = lambda side, x: field(outcome=F.lit(side), payout=F.lit(x))
    none = F.array().cast("array<struct<outcome:string,payout:double>>")
    return table(s, d, "orders").select(C("o_orderkey").cast("string").alias("line_id"), C("o_custkey").cast("string").alias("player"), F.lit("g").alias("game"), C("o_orderstatus").alias("stat"), C("o_totalprice").alias("line"), F.when(C("o_orderkey") % 5 == 0, "closed").otherwise("active").alias("status"), F.when(C("o_orderkey") % 7 == 0, none).otherwise(F.array(pay("over", 1.8), pay("under", 1.9))).alias("options"))


@query("a04_skip_reasons", "select case when o_orderkey % 5 = 0 then 'inactive' when o_orderkey % 7 = 0 then 'no payout' end as reason, count(*) as n from orders group by 1")
def a04_reasons(s, d):
    return p.skip_reason(book(s, d)).groupBy("reason").agg(F.count("*").alias("n"))


@query("a05_box_scores", "select o_orderkey, case when o_orderkey % 6 = 0 then 0 else (o_orderkey % 40) + (o_orderkey % 60) / cast(60 as double) end as minutes, case when o_orderkey % 6 = 0 then 0 else cast(o_custkey % 50 as double) end as points, cast(case when o_orderkey % 6 = 0 then 0 else o_orderkey % 9 end as bigint) as fg_made, cast(case when o_orderkey % 6 = 0 then 0 else o_orderkey % 9 + 3 end as bigint) as fg_attempted, cast(0 as bigint) as threes_made from orders".replace("end as minutes", "end as m").replace("select o_orderkey, case", "select o_orderkey, round(case").replace("end as m,", "end, 6) as minutes,"))
def a05(s, d):
    text = lambda c: c.cast("string")
    k = C("o_orderkey")
    stats = F.array(F.concat_ws(":", text(k % 40), F.lpad(text(k % 60), 2, "0")), text(C("o_custkey") % 50), F.concat_ws("-", text(k % 9), text(k % 9 + 3)), F.lit("--"))
    none = F.array().cast("array<string>")
    rows = table(s, d, "orders").select("o_orderkey", F.array(F.lit("min"), F.lit("PTS"), F.lit("FG"), F.lit("3PT")).alias("keys"), F.when(k % 6 == 0, none).otherwise(stats).alias("stats"))
    return rounded(p.box_scores(rows).select("o_orderkey", "minutes", "points", "fg_made", "fg_attempted", "threes_made"))


def scratch(s, what: str) -> str:
    return f"{shared_dir(s).rstrip('/')}/{what}-{uuid.uuid4().hex}"


@query("a10_partitioned_tables", "select o_orderkey, o_totalprice, o_orderstatus from orders")
def a10(s, d):
    path = scratch(s, "orders")
    tables.write_slice(table(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), path, ["o_orderstatus"])
    return s.read.parquet(path).select("o_orderkey", "o_totalprice", "o_orderstatus")


@query("a10_report", "select o_orderstatus, count(*) as n, round(avg(o_totalprice), 2) as mean_price from orders group by 1")
def a10_report(s, d):
    path = scratch(s, "report")
    tables.write_report(table(s, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean_price")), path)
    return s.read.schema("o_orderstatus string, n bigint, mean_price double").option("header", "true").csv(path)


@query("a11_run_slices", "select o_orderkey, o_orderstatus, case when o_orderstatus = 'F' then o_totalprice + 1 else o_totalprice end as price from orders where o_orderstatus <> 'F' or o_orderkey % 2 = 0")
def a11(s, d):
    path = scratch(s, "slices")
    o = table(s, d, "orders").select("o_orderkey", C("o_totalprice").alias("price"), "o_orderstatus")
    tables.write_slice(o, path, ["o_orderstatus"])
    tables.write_slice(o.where("o_orderstatus = 'F' and o_orderkey % 2 = 0").withColumn("price", C("price") + 1), path, ["o_orderstatus"])
    return s.read.parquet(path).select("o_orderkey", "o_orderstatus", r6("price").alias("price"))


DRIFT = "case event_id % 7 when 0 then props when 1 then replace(replace(props, ': ', ': \"'), '}', '\"}') when 2 then '{\"k\": \"x\"}' when 3 then 'k=' || event_id when 4 then '[1, 2]' when 6 then '{\"j\": 1}' end"


@query("b01_typed_payloads", f"with t as (select event_id, {DRIFT} as p from events) select event_id, case event_id % 7 when 2 then 'type k' when 3 then 'not json' when 4 then 'not an object' when 5 then 'null' when 6 then 'missing k' end as reason, case when event_id % 7 <= 1 then cast(json_extract_string(p, '$.k') as double) end as k from t")
def b01_typed(s, d):
    k = C("event_id") % 7
    quoted = F.regexp_replace(F.regexp_replace("props", ": ", ': "'), "\\}", '"}')
    raw = table(s, d, "events").select("event_id", F.when(k == 0, C("props")).when(k == 1, quoted).when(k == 2, F.lit('{"k": "x"}')).when(k == 3, F.concat(F.lit("k="), "event_id")).when(k == 4, F.lit("[1, 2]")).when(k == 6, F.lit('{"j": 1}')).alias("payload"))
    good, bad = p.typed_payloads(raw, "payload", {"k": "double"}, ["k"])
    return good.select("event_id", F.lit(None).cast("string").alias("reason"), "k").unionByName(bad.select("event_id", "reason", F.lit(None).cast("double").alias("k")))
