"""Small helpers that the text operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fieldbook.session import saved, shared_dir

#: A word: a run of anything but ASCII white space. Java and DuckDB both read it.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of an Arrow batch: texts may be long, so batches are cut by bytes as well as by rows.
BATCH_BYTES = "4m"

__all__ = ["WORD", "arrow_map", "fresh_path", "met", "partitions", "saved", "shared_dir"]


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow for a function that yields dicts of columns (lists or numpy arrays).

    Sets the session's bound on a batch's bytes where it has none.
    """
    if df.sparkSession.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    kinds = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in f(batches):
            yield pa.RecordBatch.from_arrays([pa.array(columns[x.name], type=x.type) for x in arrow], schema=arrow)

    return df.mapInArrow(run, kinds)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def met(rows: DataFrame, table: DataFrame, key: Sequence[str]) -> DataFrame:
    """rows with the columns of `table`, which has a row for each key and its number of rows, `_n`; rows of other keys drop out.

    Keys with more rows than half a partition's share are hot. There are less than two for each
    partition, so their rows of the table may be broadcast, and no task gets all rows of a hot key.
    """
    most = rows.count() / (2 * partitions(rows.sparkSession))
    table = saved(table)
    hot, cold, key = F.broadcast(table.where(F.col("_n") > most).drop("_n")), table.where(F.col("_n") <= most).drop("_n"), list(key)
    return rows.join(hot, key).unionByName(rows.join(hot.select(*key), key, "left_anti").join(cold, key))
