"""Session settings that the library's results rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

#: Small shuffle pieces that adaptive execution merges: what a task reads, sorts and groups stays near `advisory`, however much data there is.
#: A task that scans holds its rows in memory until they are shuffled, so a scan is cut small as well.
PIECES = {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1024", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m", "spark.sql.files.maxPartitionBytes": "16m"}


def in_pieces(spark: SparkSession) -> None:
    """Sets PIECES where the session has no value of its own, so that tasks grow in number with the input and not in size; a session that shuffles into more partitions keeps its number."""
    for k, v in PIECES.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, max(v, spark.conf.get("spark.sql.shuffle.partitions"), key=int) if v.isdigit() else v)


def build(master: str, shuffle_partitions: int, **more: str) -> SparkSession:
    """A session for `master`. At scale leave shuffle_partitions at two or three times the cores and let adaptive execution merge them."""
    builder = SparkSession.builder.master(master).config(map=SETTINGS | {"spark.sql.shuffle.partitions": str(shuffle_partitions)} | more)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets a temporary one; a cluster must name it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = got.get() if got.isDefined() else None
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='fieldbook-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_folder(spark: SparkSession, what: str) -> str:
    """A folder of its own below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """The rows, computed once into the shared folder; what built them is not needed again. Spark deletes the files with the frame where spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The rows, written as Parquet into the shared folder and read again. For small tables of a loop: a checkpoint keeps the plan's estimated size, which joins would multiply round by round."""
    path = fresh_folder(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
