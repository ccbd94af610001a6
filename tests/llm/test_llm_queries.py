"""The registered text queries against their SQL, and the pipeline against a replay in plain Python."""

import re
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))
import compare  # noqa: E402

import corpus_pipeline  # noqa: E402
from fieldbook.llm.queries import QUERIES  # noqa: E402
from fieldbook.llm.sql import ORACLE_SQL  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no tables")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    ours, theirs = compare.both(QUERIES[name](spark, FOLDER), compare.database(FOLDER), ORACLE_SQL[name])
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_query_covers_table(spark, name):
    rows = QUERIES[name](spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    if "doc_id" in rows.columns:
        assert rows.select("doc_id").distinct().count() == docs.count()
    else:
        assert rows.count() > 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    sql = compare.database(FOLDER)
    kept = {r[0] for r in sql.sql(f"select doc_id from ({ORACLE_SQL['op2_quality_rules']}) where kept").fetchall()}
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality"](spark, docs, FOLDER)
    assert good.columns == docs.columns and {r[0] for r in good.select("doc_id").collect()} == kept
    sql.sql("create table chosen as select * from documents where false")
    sql.execute("insert into chosen select * from documents where list_contains(?, doc_id)", [sorted(kept)])
    one = {r[0] for r in sql.sql(f"select doc_id from ({ORACLE_SQL['op1_ngram_jaccard_join'].replace('from documents', 'from chosen')}) where doc_id = component_id").fetchall()}
    single = stage["near_duplicates"](spark, good, FOLDER)
    assert {r[0] for r in single.select("doc_id").collect()} == one
    clean = stage["secrets"](spark, single, FOLDER)
    assert clean.columns == docs.columns and clean.count() == len(one)
    assert all(not re.search(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}", r[0]) for r in clean.select("text").collect())
    mixed = stage["mix"](spark, clean, FOLDER)
    times = Counter(r[0] for r in mixed.select("doc_id").collect())
    assert max(times.values()) <= 2 and set(times) <= one
    size = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r[0])) for r in rows.select("text").collect())
    assert size(mixed) == pytest.approx(1.5 * size(clean), rel=0.02)
    packed = stage["pack"](spark, mixed, FOLDER)
    assert Counter(r[0] for r in packed.where("piece = 0").select("doc_id").collect()) == times
    assert corpus_pipeline.run(spark, FOLDER).count() == packed.count()
