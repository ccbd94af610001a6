"""Stored tables that are brought up to date in place: only the partitions that new rows touch are read and replaced."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldbook.session import saved
from fieldbook.sources.tables import upsert, write_slice

#: Touched partitions up to so many prune the scan by their values; beyond it the scan is pruned by a join with them.
MOST_TOUCHED = 10_000


def stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    """The stored rows, None where nothing is stored yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def in_partitions(old: DataFrame, touched: DataFrame, partitions: Sequence[str]) -> DataFrame:
    """Rows of the touched partitions. Their values become filters that Spark applies to the list of files before it reads any."""
    values = touched.limit(MOST_TOUCHED + 1).collect()
    if len(values) > MOST_TOUCHED:
        same = reduce(lambda a, b: a & b, [old[c].eqNullSafe(touched[c]) for c in partitions])
        return old.join(touched, same, "left_semi")
    for c in partitions:
        own = {r[c] for r in values}
        old = old.where(F.col(c).isin(*[v for v in own if v is not None]) | (F.col(c).isNull() if None in own else F.lit(False)))
    if len(partitions) > 1:  # of the combinations of the values only those that occur
        marks = F.broadcast(touched.withColumnsRenamed({c: f"_t_{c}" for c in partitions}))
        old = old.join(marks, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in partitions]), "left_semi")
    return old


def upsert_partitions(new: DataFrame, path: str, keys: Sequence[str], version: str, partitions: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Merges `new` into the table at `path`, the latest version of each key winning; gives the partitions that it replaced.

    The partition columns belong to the keys, so a row can't have an older version in another partition. Ties of
    version go to the new row; with `columns`, a stored row changes in those only. A run that is repeated, as
    after a failure between partitions, gives the same table. Empty `new` touches nothing.
    """
    if not set(partitions) <= set(keys):
        raise ValueError(f"{[c for c in partitions if c not in keys]} must be among the keys: else a key could be stored twice")
    new = saved(new)
    touched = saved(new.select(*partitions).distinct())
    old = stored(new.sparkSession, path, new.schema)
    held = new.where("false") if old is None else in_partitions(old, touched, partitions)
    write_slice(upsert(held.select(*new.columns), new, keys, version, columns), path, partitions)
    return touched
