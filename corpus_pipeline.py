"""The corpus pipeline: documents through quality rules, near duplicates, secrets, mixing and packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. `run` writes each
stage's rows as Parquet into the shared folder and reads them again, so that a stage that loses executors
starts from its predecessor's files. Each row is judged for itself: doc_ids may be null or repeated. quality and secrets carry
the columns through their operators; near_duplicates and mix go by the rows' places in their files.
Null texts have no words, so quality drops them; empty tables go through all stages and give no pieces.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.llm import mixing, ngram_join, packing, quality_rules, secret_scan
from fieldbook.llm.common import fresh_path, saved

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Lists of so many ids at most go to every task; longer ones are joined by a shuffle.
SMALL = 2_000_000


def keyed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents with a key of their own, `_row`: the file's number and the row's place in it, which stay the same whenever the files are read.

    Documents that don't come straight from Parquet files are written with a key first.
    """
    try:
        rows = docs.select(*COLUMNS, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    except AnalysisException:
        path = fresh_path(spark, "rows")
        docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")).write.parquet(path)
        return spark.read.parquet(path)
    names = sorted(r["_file"] for r in rows.select("_file").distinct().collect())  # a row for each file
    files = spark.createDataFrame(list(enumerate(names)), "_number bigint, _file string")
    return rows.join(F.broadcast(files), "_file").select(*COLUMNS, (F.col("_number") * F.lit(1 << 40) + F.col("_at")).alias("_row"))


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents of `rows` whose _row is not in `gone`."""
    gone = saved(gone.select("_row"))
    return rows.join(F.broadcast(gone) if gone.count() <= SMALL else gone, "_row", "left_anti").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, each row judged for itself."""
    return quality_rules.quality_rules(docs, keep=COLUMNS).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; rows without an id come last."""
    rows = keyed(spark, docs)
    found = ngram_join.ngram_jaccard_join(rows, id_col="_row").select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group"))
    # groups of one row are settled; only the others need their documents' ids
    more = saved(found.where("_row <> _group").select("_row", "_group"))
    heads = more.select(F.col("_group").alias("_row"), "_group").distinct()
    members = saved(more.unionByName(heads).join(rows.select("_row", "doc_id"), "_row"))
    first = members.groupBy("_group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"].alias("_row"))
    return without(rows, members.join(first, "_row", "left_anti"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; found secrets are masked in their texts."""
    found = secret_scan.scan(docs, keep=("lang", "source", "n_chars"))
    found = found.withColumn("masked", F.when(~F.col("row.no_text"), secret_scan.masked(found)))
    length = F.when(F.col("row.n_chars").isNotNull(), F.length("masked").cast("bigint"))
    return found.select("doc_id", F.col("masked").alias("text"), "row.lang", "row.source", length.alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document that has words as often as the mix takes it."""
    rows = keyed(spark, docs)
    taken = mixing.mix_sources(rows, keep=("_row",)).where("size > 0").select("_row", (F.col("taken") / F.col("size")).cast("int").alias("times"))
    rows = rows.join(taken.where("times > 0"), "_row")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences."""
    return packing.best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mix", mix), ("pack", pack)]
#: SQL has no seeded hash of ours and no packing rule; the tests replay the stages in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
