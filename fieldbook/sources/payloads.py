"""Payloads of line and odds feeds as rows. Arrays are exploded where they stand; look-ups are joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.functions.scalars import made_attempted, minutes, no_vig
from fieldbook.session import saved

LINES = "data array<struct<id:string,attributes:struct<line_score:double,stat_type:string,odds_type:string,is_promo:boolean,status:string,start_time:string>,relationships:struct<player:struct<id:string>,league:struct<id:string>>>>, included array<struct<type:string,id:string,attributes:struct<name:string,team:string>>>"
ODDS = "event_id string, bookmakers array<struct<key:string,markets:array<struct<key:string,outcomes:array<struct<name:string,description:string,point:double,price:int>>>>>>"
BOOK = "line_id string, player string, game string, stat string, line double, status string, options array<struct<outcome:string,payout:double>>"


def table(pairs: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def parse(raw: DataFrame, column: str, ddl: str) -> DataFrame:
    return raw.select("*", F.from_json(column, ddl).alias("_p")).select(*[c for c in raw.columns if c != column], "_p.*")


def typed_payloads(raw: DataFrame, column: str, fields: Mapping[str, str], required: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(good, bad) from one read of JSON texts whose fields may change their type: rows with the typed fields, and the others with a `reason`.

    Texts become VARIANT, so '12' and 12 are both a number. Reasons: `null`; `not json`; `not an object`; `missing <field>` for a required field
    that isn't there or is null; `type <field>` for one that can't be cast. The first in this order, then in the order of fields, counts.
    Each row is in one of the two.
    """
    v = F.try_parse_json(F.col(column))
    rows = raw.withColumn("_v", v)
    path = lambda f: f"$.{f}"
    rows = rows.withColumns({f"_raw_{f}": F.try_variant_get("_v", path(f), "string") for f in fields} | {f"_{f}": F.try_variant_get("_v", path(f), kind) for f, kind in fields.items()})
    reason = F.when(F.col(column).isNull(), "null").when(F.col("_v").isNull(), "not json").when(~F.coalesce(F.startswith(F.schema_of_variant("_v"), F.lit("OBJECT")), F.lit(False)), "not an object")
    for f in fields:
        gone = F.coalesce(F.is_variant_null(F.try_variant_get("_v", path(f), "variant")), F.lit(True)) | F.try_variant_get("_v", path(f), "variant").isNull()
        reason = reason.when(gone, f"missing {f}" if f in required else None) if f in required else reason
        reason = reason.when(~gone & F.col(f"_{f}").isNull(), f"type {f}")
    rows = saved(rows.select(*raw.columns, *[F.col(f"_{f}").alias(f"_{f}") for f in fields], reason.alias("reason")))
    good = rows.where("reason is null").select(*[c for c in raw.columns if c != column], *[F.col(f"_{f}").alias(f) for f in fields])
    return good, rows.where("reason is not null").select(*raw.columns, "reason")


def flatten_lines(payload: DataFrame, leagues: Mapping[str, str], stats: Mapping[str, str]) -> DataFrame:
    """Lines of known leagues and stats, one player each, neither promotions nor live; `payload` has a payload_id and the LINES columns."""
    data = payload.select("payload_id", F.explode("data").alias("d"))
    included = payload.select("payload_id", F.explode("included").alias("i")).select("payload_id", F.col("i.type").alias("type"), F.col("i.id").alias("id"), F.col("i.attributes.name").alias("name"), F.col("i.attributes.team").alias("team"))
    of = lambda kind, prefix: included.where(F.col("type") == kind).select("payload_id", F.col("id").alias(f"{prefix}_id"), F.col("name").alias(f"{prefix}_name"), F.col("team").alias(f"{prefix}_team"))
    rows = data.select("payload_id", F.col("d.id").alias("line_id"), F.col("d.relationships.player.id").alias("p_id"), F.col("d.relationships.league.id").alias("l_id"), "d.attributes.*")
    rows = rows.join(of("new_player", "p"), ["payload_id", "p_id"]).join(of("league", "l"), ["payload_id", "l_id"])
    rows = rows.withColumns({"sport": F.try_element_at(table(leagues), F.col("l_name")), "stat": F.try_element_at(table(stats), F.col("stat_type"))})
    good = F.col("sport").isNotNull() & F.col("stat").isNotNull() & ~F.col("p_name").contains(" + ") & ~F.coalesce("is_promo", F.lit(False)) & (F.coalesce("status", F.lit("pre_game")) == "pre_game") & F.col("line_score").isNotNull()
    return rows.where(good).select("line_id", "sport", "stat", F.col("p_name").alias("player"), F.col("p_team").alias("team"), F.col("line_score").alias("line"), F.to_timestamp("start_time").alias("start"))


def flatten_odds(payload: DataFrame) -> DataFrame:
    """book, market, player, line, over and under price and the no-vig probability; quotes without both sides are dropped."""
    books = payload.select("event_id", F.explode("bookmakers").alias("b")).select("event_id", F.col("b.key").alias("book"), F.explode("b.markets").alias("m"))
    rows = books.select("event_id", "book", F.col("m.key").alias("market"), F.explode("m.outcomes").alias("o")).select("event_id", "book", "market", F.col("o.description").alias("player"), F.col("o.point").alias("line"), F.lower("o.name").alias("side"), F.col("o.price").alias("price"))
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("price")))
    out = rows.groupBy("event_id", "book", "market", "player", "line").agg(side("over").alias("over_price"), side("under").alias("under_price")).where("over_price is not null and under_price is not null")
    return out.withColumn("over_prob", no_vig(F.col("over_price"), F.col("under_price")))


def option_payout(options: Column, side: str) -> Column:
    return F.try_element_at(F.filter(options, lambda o: o["outcome"] == side), F.lit(1))["payout"]


def skip_reason(rows: DataFrame) -> DataFrame:
    """BOOK rows with over, under and the reason why one is left out (null if none)."""
    rows = rows.withColumns({"over": option_payout(F.col("options"), "over"), "under": option_payout(F.col("options"), "under")})
    reason = F.when(F.col("status") != "active", "inactive").when(F.col("player").isNull(), "no player").when(F.col("line").isNull(), "no line").when(F.col("over").isNull() & F.col("under").isNull(), "no payout")
    return rows.withColumn("reason", reason)


def flatten_book(rows: DataFrame) -> DataFrame:
    """The first usable row of each player, game and stat."""
    good = skip_reason(rows).where("reason is null")
    got = good.groupBy("player", "game", "stat").agg(F.min_by(F.struct("line", "over", "under", "line_id"), "line_id").alias("_r"))
    return got.select("player", "game", "stat", "_r.*")


def box_scores(rows: DataFrame, keys: str = "keys", stats: str = "stats") -> DataFrame:
    """minutes, points, rebounds, assists and makes by the label array's places; an empty list (did not play) gives zeros."""
    cells = F.when(F.size(keys) == F.size(stats), F.map_from_arrays(F.transform(keys, lambda k: F.upper(k)), F.col(stats))).otherwise(F.create_map().cast("map<string,string>"))
    get = lambda k: F.coalesce(F.try_element_at(F.col("_m"), F.lit(k)), F.lit(""))
    number = lambda k: F.coalesce(get(k).try_cast("double"), F.lit(0.0))
    shots = lambda k, n: F.struct(made_attempted(get(k))["made"].alias(f"{n}_made"), made_attempted(get(k))["attempted"].alias(f"{n}_attempted"))
    out = rows.withColumn("_m", cells)
    out = out.withColumns({"minutes": minutes(get("MIN")), "points": number("PTS"), "rebounds": number("REB"), "assists": number("AST"), "_fg": shots("FG", "fg"), "_3": shots("3PT", "threes"), "_ft": shots("FT", "ft")})
    return out.select(*[c for c in rows.columns if c not in (keys, stats)], "minutes", "points", "rebounds", "assists", "_fg.*", "_3.*", "_ft.*")
