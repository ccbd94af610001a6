"""Who is who: records resolved to players in stages, new ids, and placeholders merged into real players."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fieldbook.functions.scalars import name_key
from fieldbook.operators.joins import trigram_matches
from fieldbook.session import saved, written

#: Fixed value: what external ids of placeholders begin with.
PLACEHOLDER = "pp_"
STAGES = ("external", "name", "similar", "last_name", "new")
#: Hex digits of a digest that deal new entities into buckets.
DIGITS = 3


def last_word(name: Column) -> Column:
    return F.element_at(F.split(name, " "), -1)


def new_ids(entities: DataFrame, key: str, base: DataFrame) -> DataFrame:
    """key and id: gapless from one above `base` (one row, `_base`), the same in each run over the same keys.

    Keys are dealt into buckets by their digest; a bucket's ids start where those before it end, so the buckets are
    sorted apart and only their sizes meet.
    """
    bucket = F.substring(F.md5(F.col(key).cast("binary")), 1, DIGITS)
    rows = saved(entities.select(key).distinct().withColumn("_bucket", bucket))
    sizes = rows.groupBy("_bucket").agg(F.count("*").alias("_n"))  # 16 ** DIGITS rows at most
    starts = sizes.select("_bucket", (F.sum("_n").over(W.orderBy("_bucket")) - F.col("_n")).alias("_start"))
    nth = F.row_number().over(W.partitionBy("_bucket").orderBy(key))
    return rows.withColumn("_nth", nth).join(F.broadcast(starts), "_bucket").join(F.broadcast(base)).select(key, (F.col("_base") + F.col("_start") + F.col("_nth")).cast("bigint").alias("id"))


def resolve(records: DataFrame, players: DataFrame, least: float = 0.8) -> DataFrame:
    """row_id, player_id and the stage that found it; each stage sees only what the ones before it left.

    records: row_id, sport, external_id, name; players: player_id, sport, external_id, name. The stages: the external id; the normalized
    name; the most similar name above `least`; a last name that only one player of the sport has (placeholders aside); a new
    player, one for each sport and external id (or name without an id). Ties go to the smaller player id. Once the new
    players are stored with their external ids, a rerun finds them by these. A record without id and name stays null.
    """
    key = name_key(F.col("name"))
    rest = saved(records.select("row_id", "sport", F.nullif("external_id", F.lit("")).alias("external_id"), F.nullif(key, F.lit("")).alias("name")))
    known = saved(players.select("player_id", "sport", "external_id", F.nullif(key, F.lit("")).alias("name")))
    found = None

    def take(matches: DataFrame, stage: str) -> None:
        nonlocal rest, found
        one = saved(matches.select("row_id", F.col("player_id").cast("bigint").alias("player_id"), F.lit(stage).alias("stage")))
        found = one if found is None else found.unionByName(one)
        rest = saved(rest.join(one, "row_id", "left_anti"))

    for stage, c in (("external", "external_id"), ("name", "name")):
        own = known.where(F.col(c).isNotNull()).groupBy("sport", c).agg(F.min("player_id").alias("player_id"))
        take(rest.where(F.col(c).isNotNull()).join(own, ["sport", c]), stage)

    asked = rest.where("name is not null")
    near = trigram_matches(asked, known.where("name is not null"), "name", least).withColumnRenamed("match", "other")
    own = known.where("name is not null").groupBy("sport", F.col("name").alias("other")).agg(F.min("player_id").alias("player_id"))
    # a match depends on sport and name alone, so names meet the players, and records their name's match
    best = asked.select("sport", "name").distinct().join(near, "name").join(own, ["sport", "other"]).groupBy("sport", "name").agg(F.min_by("player_id", F.struct(-F.col("similarity"), "player_id")).alias("player_id"))
    take(asked.join(best, ["sport", "name"]), "similar")

    real = known.where(F.col("name").isNotNull() & ~F.coalesce(F.startswith(F.col("external_id"), F.lit(PLACEHOLDER)), F.lit(False)))
    alone = real.groupBy("sport", last_word(F.col("name")).alias("_last")).agg(F.count("*").alias("_n"), F.min("player_id").alias("player_id")).where("_n = 1")
    take(rest.where("name is not null").withColumn("_last", last_word(F.col("name"))).join(alone, ["sport", "_last"]), "last_name")

    entity = F.concat_ws("|", F.coalesce("sport", F.lit("")), F.coalesce("external_id", F.concat(F.lit("name "), F.col("name"))))
    asked = rest.where("external_id is not null or name is not null").withColumn("_entity", entity)
    ids = new_ids(asked, "_entity", known.agg(F.coalesce(F.max("player_id"), F.lit(0)).alias("_base")))
    take(asked.join(ids, "_entity").withColumnRenamed("id", "player_id"), "new")
    none = rest.select("row_id", F.lit(None).cast("bigint").alias("player_id"), F.lit(None).cast("string").alias("stage"))
    return found.unionByName(none)


def placeholder_merges(players: DataFrame, keys: Sequence[str] = ("sport", "name")) -> DataFrame:
    """from_id, to_id: each placeholder with the smallest real player of its keys, where there is one."""
    mark = F.coalesce(F.startswith(F.col("external_id"), F.lit(PLACEHOLDER)), F.lit(False))
    real = players.where(~mark).groupBy(*keys).agg(F.min("player_id").alias("to_id"))
    return players.where(mark).join(real, list(keys)).select(F.col("player_id").alias("from_id"), "to_id").where("from_id <> to_id")


def closed(mapping: DataFrame) -> DataFrame:
    """from_id, to_id with chains followed to their end, by pointer jumping: each round doubles the steps.

    An id that is mapped twice goes to its smallest target; ids that map in a circle go to the smallest id of it.
    """
    rows = written(mapping.where("from_id is not null and to_id is not null and from_id <> to_id").groupBy("from_id").agg(F.min("to_id").alias("to_id")).withColumn("low", F.col("to_id")))
    most, steps = rows.count(), 1
    while True:
        on = rows.select(F.col("from_id").alias("to_id"), F.col("to_id").alias("_next"), F.col("low").alias("_low"))
        rows = written(rows.join(on, "to_id", "left").select("from_id", F.coalesce("_next", "to_id").alias("to_id"), F.least("low", F.coalesce("_low", "low")).alias("low"), F.col("_next").isNotNull().alias("_open")))
        steps *= 2
        still = rows.where("_open").limit(1).count()
        rows = rows.drop("_open")
        if not still:
            return rows.select("from_id", "to_id").where("from_id <> to_id")
        if steps > 2 * most:  # what is still open goes round
            inside = rows.select(F.col("from_id").alias("to_id"), F.lit(True).alias("_round"))
            return rows.join(inside, "to_id", "left").select("from_id", F.when(F.col("_round"), F.col("low")).otherwise(F.col("to_id")).alias("to_id")).where("from_id <> to_id")


def repointed(children: Mapping[str, tuple[DataFrame, str]], mapping: DataFrame) -> dict[str, DataFrame]:
    """The child tables with the ids of their column replaced by a closed mapping."""
    out = {}
    for name, (rows, column) in children.items():
        moved = rows.join(mapping.select(F.col("from_id").alias(column), "to_id"), column, "left")
        out[name] = moved.withColumn(column, F.coalesce("to_id", column)).select(*rows.columns)
    return out
