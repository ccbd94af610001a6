"""The text operators do their whole job, on rows that share an id or have none, and beyond former limits."""

import random
import sys
from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(seed: int, n: int = 80) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t) if t else None) for i, t, s in rows], SCHEMA)


def texts(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_stages_judge_rows_not_ids(spark):
    stage = dict(corpus_pipeline.STAGES)
    good, bad = [words(i) for i in range(8)], "too short"
    rows = [(1, good[0], "a"), (1, bad, "a"), (None, good[1], "a"), (None, bad, "a"), *[(10 + i, words(100 + i), "a") for i in range(200)]]
    left = texts(stage["quality"](spark, frame(spark, rows), ""))
    assert left[1, good[0]] == left[None, good[1]] == 1 and not any(t == bad for _, t in left) and len(left) == 202

    rows = [(5, good[0], "a"), (2, good[0], "a"), (5, good[1], "a"), (3, good[2], "a"), (3, good[2], "a"), (None, good[3], "a"), (None, good[3], "a"), (None, good[4], "a"), (9, good[4], "a"), (None, good[5], "a")]
    left = texts(stage["near_duplicates"](spark, frame(spark, rows), ""))
    assert left == Counter([(2, good[0]), (5, good[1]), (3, good[2]), (None, good[3]), (9, good[4]), (None, good[5])])


def test_mix_keeps_rows_without_id_and_own_times(spark):
    mix = dict(corpus_pipeline.STAGES)["mix"]
    # source a is taken twice over, b is cut: rows of the two that share an id have different numbers
    rows = [(i if i % 2 else None, words(i, 50 + i), "a") for i in range(20)] + [(i if i % 2 else None, words(1000 + i, 300 + i), "b") for i in range(60)]
    docs = frame(spark, rows)
    got = texts(mix(spark, docs, ""))
    plan = corpus_pipeline.mixing.mix_sources(docs).collect()
    want = Counter((r["doc_id"], r["size"]) for r in plan for _ in range(r["taken"] // r["size"]))
    assert Counter((i, len(t.split())) for i, t in got.elements()) == want
    assert any(i is None for i, _ in want) and len(set(Counter(want).values())) > 1


def test_mix_beyond_the_patterns_of_the_driver(spark, monkeypatch):
    rng = random.Random(3)
    one = [(i, words(i, rng.randrange(0, 60)), rng.choice([None, *"abcdefghijk"])) for i in range(300)]
    docs = frame(spark, one)
    several = spark.createDataFrame([(i, t, sorted({s or "z", rng.choice("lmno")}) if i % 3 else [s or "z"]) for i, t, s in one], "doc_id bigint, text string, source array<string>")
    total = lambda rows: sum(r["taken"] for r in rows)
    want, flow = corpus_pipeline.mixing.mix_sources(docs).collect(), corpus_pipeline.mixing.mix_sources(several).collect()
    monkeypatch.setattr(corpus_pipeline.mixing, "MOST_PATTERNS", 2)
    assert sorted(map(str, corpus_pipeline.mixing.mix_sources(docs).collect())) == sorted(map(str, want))
    got = corpus_pipeline.mixing.mix_sources(several).collect()
    strip = lambda rows: sorted(str((r["doc_id"], r["source"], r["size"], r["source_size"], round(r["target"], 6))) for r in rows)
    assert strip(got) == strip(flow) and abs(total(got) - total(flow)) <= 0.01 * total(flow)


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    odd = [(None, None, None), (None, "", "a"), (1, words(1), None), (1, words(1), None), (1, words(2), "a"), (None, words(3), "a"), (None, words(3), "a"), (2, words(4) + " password = hunter22secret", "b"), (3, "x " * 9000, "b"), (4, " ".join(words(i) for i in range(5, 40)), "b")]
    docs = frame(spark, odd).withColumn("extra", F.lit("e")).withColumn("size", F.lit("clash"))
    docs.write.parquet(f"{tmp_path}/odd/documents.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    ids = Counter(r["doc_id"] for r in got if r["piece"] == 0)
    assert set(ids) == {None, 1, 2, 4} and ids[1] >= 2  # both texts of id 1, copies once; junk, empty and null texts go
    assert max(r["offset"] + r["length"] for r in got) <= 2048
    spans = Counter()
    for r in got:
        spans[r["sequence_id"]] += r["length"]
    assert all(spans[r["sequence_id"]] >= r["offset"] + r["length"] for r in got)
    docs.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    empty = docs.where("false").select(*corpus_pipeline.COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0, name


def test_quality_of_more_hosts_than_go_to_every_task(spark, monkeypatch):
    rng = random.Random(2)
    docs = frame(spark, [(i if i % 9 else None, words(i, rng.choice([20, 80])), rng.choice([None, "a", "a", "a", f"h{i}"])) for i in range(300)])
    rules = corpus_pipeline.quality_rules
    got = [sorted(map(str, rules.quality_rules(docs, keep=keep).collect())) for keep in ((), ("text",))]
    monkeypatch.setattr(rules, "SMALL", 0)
    assert [sorted(map(str, rules.quality_rules(docs, keep=keep).collect())) for keep in ((), ("text",))] == got
    assert len(got[0]) == len(got[1]) == 300
