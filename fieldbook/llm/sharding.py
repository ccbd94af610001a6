"""Rendezvous hashing of stable record keys over weighted shards, in DataFrame functions only.

A record goes to the shard with the highest score, -weight / ln(u), u being the hash of the key and the shard in
(0, 1). Scores of other shards don't change when one is added, so a record moves only into the new one.

Slots number a shard's records from 0 without gaps. Equal records (id, size, checksum) become one row with their number, so
copies and rows without an id gather nowhere. These rows fall into bins of about `BIN` by a hash of all three; a bin's rows are
ordered in a window of their own, after the records of lower bins. No task has to hold a shard, and a record that
stands very often is written out in chunks by several tasks.

Null keys hash like any key. Null text has no bytes. Rows with equal keys share a shard and get a slot
each; equal rows are interchangeable. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fieldbook.llm.common import saved

BIN, CHUNK = 2_000, 10_000


def score(key: Column, shard: Column | int, weight: Column | float) -> Column:
    """-weight / ln(u); u lies in the middle of one of 2^52 steps, so that it is never 0 or 1."""
    u = (F.shiftright(F.xxhash64(key, F.lit("shard"), shard if isinstance(shard, Column) else F.lit(shard)), 12).cast("double") + 2.0**51 + 0.5) / 2.0**52
    return -(weight if isinstance(weight, Column) else F.lit(float(weight))) / F.log(u)


def shard_of(key: Column, weights: list[float]) -> Column:
    """The number of the best shard; ties go to the higher number."""
    scored = [F.struct(score(key, i, w).alias("score"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    return F.greatest(*scored)["shard"] if len(scored) > 1 else F.lit(0)


def rendezvous_shards(docs: DataFrame, weights: list[float], *, id_col: str = "doc_id", text_col: str = "text", extra: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (with one more shard of mean weight)."""
    key, text = F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(key.alias("doc_id"), (F.octet_length(text).cast("bigint") + extra).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    rows = saved(rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n")))
    bins = max(1, math.ceil(rows.count() / len(weights) / BIN))
    rows = rows.withColumns({"shard": shard_of(F.col("doc_id"), weights), "bin": F.pmod(F.xxhash64("doc_id", "size", "text_crc32", F.lit("bin")), F.lit(bins)).cast("int")})
    counts = rows.groupBy("shard", "bin").agg(F.sum("n").alias("_n"))
    starts = counts.select("shard", "bin", F.coalesce(F.sum("_n").over(W.partitionBy("shard").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    before = F.sum("n").over(W.partitionBy("shard", "bin").orderBy("doc_id", "size", "text_crc32").rowsBetween(W.unboundedPreceding, -1))
    placed = rows.join(starts, ["shard", "bin"]).withColumn("first", F.col("start") + F.coalesce(before, F.lit(0)))
    chunks = placed.withColumn("at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(CHUNK).cast("bigint")))).hint("rebalance")
    out = chunks.withColumn("nth", F.explode(F.sequence(F.col("at"), F.least(F.col("at") + CHUNK, F.col("n")) - 1)))
    grown = shard_of(F.col("doc_id"), [*weights, sum(weights) / len(weights)])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("nth")).cast("bigint").alias("slot"), grown.alias("grown_shard"))
