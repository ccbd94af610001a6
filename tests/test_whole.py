"""Queries do their whole job: no row of the input is left out and no step fails on some input."""

import inspect
import math
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import compare  # noqa: E402

from fieldbook.operators import joins as j  # noqa: E402
from fieldbook.plans import market as mk  # noqa: E402
from fieldbook.plans import models  # noqa: E402
from fieldbook.queries import ORACLE_SQL, QUERIES  # noqa: E402
from fieldbook.queries import market as mk_queries  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no tables")


def test_entry_is_the_walk_forward(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == e.queries()["g05_walk_forward"](spark, FOLDER).count() > 0


def test_nearest_game_tiers(spark):
    games = spark.createDataFrame([(1, "a", "2024-01-05"), (2, "b", "2024-01-05"), (3, "b", "2024-01-05"), (4, "b", "2024-01-07"), (5, "b", "2024-01-20"), (None, "c", "2024-01-01")], "game int, team string, gd string").selectExpr("game", "team", "cast(gd as date) gd")
    asked = [(1, "a", "2020-01-01"), (2, "b", "2024-01-05"), (3, "b", "2024-01-07"), (4, "b", "2024-01-08"), (5, "b", "2024-01-06"), (6, "b", "2024-01-21"), (7, "d", "2024-01-05"), (8, "b", None), (9, None, "2024-01-05")]
    rows = spark.createDataFrame(asked, "row_id int, team string, d string").selectExpr("row_id", "team", "cast(d as date) d")
    got = {r["row_id"]: r["matched_game"] for r in j.nearest_game(rows, games, "team", "d", "gd", "game", "row_id").collect()}
    assert got == {1: 1, 2: None, 3: 4, 4: 4, 5: None, 6: 5, 7: None, 8: None, 9: None}


def rho_of(a, b):
    """By the reference's rule, in plain Python: legs are (player, team, game, stat, side)."""
    if a[0] == b[0]:
        size = 0.0 if a[3] == b[3] else mk.pair_table().get("|".join(sorted((a[3], b[3]))), 0.20)
    else:
        size = 0.04 if a[1:3] == b[1:3] else 0.0
    return size if a[4] == b[4] else 0.0 - size


def test_copula_uses_each_pairs_rho_and_all_combinations(spark):
    legs = [(i, "s", i % 3, i % 2, i % 2, ["hits", "total_bases", "runs"][i // 3], ["over", "under"][i % 4 == 0], 0.55 + 0.01 * i, 0.1) for i in range(6)]
    rows = spark.createDataFrame(legs, "leg_id long, decided string, player_id int, team_id int, game_id int, stat_type string, direction string, model_prob double, edge double")
    combos = mk.parlays(rows, "decided").withColumn("combo_id", F.xxhash64("legs"))
    got = {r["combo_id"]: r["mc_joint"] for r in mk.copula_parlays(combos, "decided").collect()}
    plan = combos.collect()
    assert len(got) == len(plan) == 15 + 20 + 15
    for r in plan:
        own = [legs[i] for i in r["legs"]]
        p = np.array([x[7] for x in own])
        m = np.array([[1.0 if a is b else rho_of(a[2:7], b[2:7]) for b in own] for a in own])
        if (m == np.eye(len(own))).all():
            want = p.prod()
        else:  # draws, straightforwardly
            z = np.random.default_rng(42).standard_normal((40_000, len(own))) @ np.linalg.cholesky(m).T
            want = (z < [mk.normal_quantiles([x])[0] for x in p]).all(axis=1).mean()
        assert got[r["combo_id"]] == pytest.approx(want, abs=1e-4)


def test_candidates_are_the_best_of_each_player_stat_and_side(spark):
    rng = np.random.default_rng(3)
    rows = [(i, f"s{i % 3}", int(rng.integers(6)), 1, 1, "xy"[i % 2], ["over", "under"][i // 2 % 2], 0.6, float(rng.integers(0, 12)) / 100) for i in range(150)]
    frame = spark.createDataFrame(rows, "leg_id long, slate string, player_id int, team_id int, game_id int, stat_type string, direction string, model_prob double, edge double")
    for least in (0.06, 0.5):
        got = {(r["slate"], r["_i"]): r["leg_id"] for r in mk.candidates(frame, "slate", 5, least).collect()}
        want = {}
        for s in ("s0", "s1", "s2"):
            own, seen = [], set()
            for r in sorted((r for r in rows if r[1] == s), key=lambda r: (-r[8], r[0])):
                if (r[2], r[5], r[6]) not in seen:
                    seen.add((r[2], r[5], r[6]))
                    own.append(r)
            strong = [r for r in own if r[8] >= least]
            for i, r in enumerate((strong if len(strong) > 1 else own)[:5]):
                want[s, i + 1] = r[0]
        assert got == want


@pytest.mark.parametrize("name", ["h09_copula_joint", "h10_slate_plan"])
def test_every_slate_has_its_combinations(spark, name):
    n = mk.candidates(mk_queries.legs(spark, FOLDER), "decided").groupBy("decided").count().collect()
    top = {r["decided"]: r["count"] for r in n}
    want = sum(math.comb(t, k) if name == "h09_copula_joint" else t >= k for t in top.values() for k in (2, 3, 4))
    assert QUERIES[name](spark, FOLDER).count() == want


@pytest.mark.parametrize("name", ["k01_deduplicated", "k02_lines_by_day", "k02_sliding_board", "k03_line_moves"])
def test_streams_read_part_files_and_write_files(spark, tmp_path, name):
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    events.repartition(6).write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES[name](spark, str(tmp_path))
    assert got.inputFiles()
    if name in ORACLE_SQL:
        db = compare.duckdb.connect()
        db.sql("set timezone = 'UTC'")
        db.sql(f"create view events as select * from '{FOLDER}/events.parquet'")
        ours, theirs = compare.both(got, db, ORACLE_SQL[name])
    else:
        ours, theirs = (sorted(map(tuple, x.collect())) for x in (got, QUERIES[name](spark, FOLDER)))
    assert ours == theirs and ours


@pytest.mark.parametrize("name, fit, option, least", [("i04_winner_model", "fit_winner", "trees", 20), ("i04_margin_model", "fit_margin", "trees", 20), ("i06_line_calibration", "out_of_fold", "folds", 5)])
def test_models_are_fitted_in_full(spark, monkeypatch, name, fit, option, least):
    class Called(Exception):
        pass

    kind = inspect.signature(getattr(models, fit))

    def stop(*args, **options):
        bound = kind.bind(*args, **options)
        bound.apply_defaults()
        raise Called(bound.arguments[option])

    monkeypatch.setattr(models, fit, stop)
    with pytest.raises(Called) as got:
        QUERIES[name](spark, FOLDER)
    assert got.value.args[0] >= least


def test_arbitrage_prices_offers_of_all_days(spark):
    from fieldbook.queries.base import ledger

    got = QUERIES["h02_arbitrage"](spark, FOLDER).join(ledger(spark, FOLDER).select("pick_id", "decided"), "pick_id")
    assert got.where("decided < '1998-01-01'").count() > 0 and got.where("decided >= '1998-01-01'").count() > 0
