"""Prior rows of entities that hold too many rows for one task.

A window over an entity puts all its rows into one task. Here an entity is cut into blocks of time; windows run
inside the blocks, and each block gets what it needs of the rows before it: a summary of each block (its last row,
or its last n rows) goes to the blocks after it. Summaries are few, so only they meet by entity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fieldbook.operators.windows import prior_means

BLOCKS = 64


def seconds(df: DataFrame, time: str) -> Column:
    """A time, date or number as a double."""
    kind, c = dict(df.dtypes)[time], F.col(time)
    if kind == "date":
        return F.unix_date(c).cast("double")
    return c.cast("timestamp").cast("double") if kind.startswith("timestamp") else c.cast("double")


def with_block(df: DataFrame, time: str, blocks: int) -> DataFrame:
    """Rows with the number of their `_block`: equal widths from the first time to the last; 0 without a time."""
    at = seconds(df, time)
    span = df.agg(F.min(at).alias("_low"), F.max(at).alias("_high"))  # one row
    place = F.when(F.col("_high") > F.col("_low"), F.floor((at - F.col("_low")) / (F.col("_high") - F.col("_low")) * blocks))
    return df.join(F.broadcast(span)).withColumn("_block", F.when(place.isNull(), 0).otherwise(F.least(place, F.lit(blocks - 1))).cast("int")).drop("_low", "_high")


def as_of_blocked(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, columns: Sequence[str], inclusive: bool = True, blocks: int = BLOCKS) -> DataFrame:
    """`joins.as_of` for keys that may hold any share of the rows: same arguments, same rows.

    Both sides are dealt by (key, block) and sorted there; a row without an earlier right row in its block takes the
    last one of the blocks before it.
    """
    payload = F.struct(F.col(right_time).alias("_at"), *columns)
    kind = right.select(payload.alias("x")).schema["x"].dataType
    a = left.withColumns({"_time": F.col(left_time), "_side": F.lit(1), "_row": F.lit(None).cast(kind)})
    b = right.select(*keys, F.col(right_time).alias("_time"), F.lit(0 if inclusive else 2).alias("_side"), payload.alias("_row"))
    both = with_block(a.unionByName(b, allowMissingColumns=True), "_time", blocks)
    own = F.col("_side") != 1
    last = both.groupBy(*keys, "_block").agg(F.max_by(F.when(own, F.col("_row")), F.when(own, F.struct("_time", "_side", "_row"))).alias("_last"))
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)  # at most `blocks` rows
    carried = last.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_block").alias("_b"), F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    w = W.partitionBy(*keys, "_block").orderBy("_time", "_side", "_row").rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last("_row", ignorenulls=True).over(w)).where(F.col("_side") == 1)
    on = F.col("_block") == F.col("_b")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    got = F.coalesce("_found", "_carried")
    return found.join(carried, on, "left").select(*left.columns, *[got[c].alias(c) for c in columns], got["_at"].alias(f"as_of_{right_time}"))


def with_prior_rows(df: DataFrame, partition: Sequence[str], order: Sequence[str], columns: Sequence[str], n: int, blocks: int = BLOCKS) -> DataFrame:
    """Rows with `_block`, and copies (`_carried`) of the n rows before each block, so that windows of n prior rows can run inside blocks.

    order is total within an entity; its first column is the time that blocks are cut by. Of the copies only partition, order and `columns` are filled.
    """
    rows = with_block(df, order[0], blocks).withColumn("_carried", F.lit(False))
    down = W.partitionBy(*partition, "_block").orderBy(*[F.desc_nulls_last(c) for c in order])
    kept = list(dict.fromkeys([*order, *columns]))
    tail = rows.withColumn("_r", F.row_number().over(down)).where(F.col("_r") <= n)
    tail = tail.groupBy(*partition, "_block").agg(F.array_sort(F.collect_list(F.struct((-F.col("_r")).alias("_r"), *kept))).alias("_tail"))
    # each block has a row, so the last n blocks hold the last n rows
    before = F.flatten(F.collect_list("_tail").over(W.partitionBy(*partition).orderBy("_block").rowsBetween(-n, -1)))
    last = tail.withColumn("_before", before).where(F.size("_before") > 0).select(*partition, "_block", F.explode(F.slice("_before", -F.least(F.size("_before"), F.lit(n)), F.lit(n))).alias("_x"))
    copies = last.select(*partition, "_block", *[F.col(f"_x.{c}").alias(c) for c in kept], F.lit(True).alias("_carried"))
    return rows.unionByName(copies, allowMissingColumns=True)


def prior_means_blocked(df: DataFrame, partition: Sequence[str], order: Sequence[str], stats: Sequence[str], sizes: Sequence[int] = (5, 10, 20), fill: float | None = 0.0, blocks: int = BLOCKS) -> DataFrame:
    """`windows.prior_means` for entities that may hold any share of the rows: same arguments, same rows."""
    rows = with_prior_rows(df, partition, order, stats, max(sizes), blocks)
    return prior_means(rows, [*partition, "_block"], order, stats, sizes, fill).where(~F.col("_carried")).drop("_block", "_carried")
