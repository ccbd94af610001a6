"""Cases whose results are known: statuses, availability, pair correlations, cutoff sweeps, stakes, audit findings."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldbook.functions import scalars as x
from fieldbook.plans import ledger as lg
from fieldbook.plans import market as mk

C = F.col


@pytest.mark.parametrize("status, out", [("Out", True), ("Doubtful", True), ("15-Day-IL", True), ("60-Day-IL", True), ("7-Day IL", True), ("suspension", True), ("developmental list", True), ("paternity", True), ("Day-To-Day", False), ("Questionable", False), ("Probable", False), ("GTD", False), ("Available", False), ("", False), (None, False)])
def test_is_out(spark, status, out):
    assert spark.createDataFrame([(status,)], "s string").select(x.is_out(C("s"))).first()[0] is out


def test_implied_totals(spark):
    home, away = x.implied_totals(F.lit(220.0), F.lit(6.0))
    assert spark.range(1).select(home, away).first()[:] == (113.0, 107.0)


@pytest.mark.parametrize(
    "last5, last10, last20, season, out, projected, risk, suppressed",
    [
        (30, 22, 18, None, 0, 25.2, False, False),  # recent games weigh more
        (34, 35, 33, None, 0, 34.1, False, False),
        (4, 5, 6, None, 0, 4.7, True, True),  # bench
        (9, 16, 24, None, 0, 14.1, True, True),  # collapse
        (10, 11, 11, None, 0, 10.5, False, True),
        (10, 11, 11, None, 28, 14.0, False, False),  # a teammate's minutes are free
        (10, None, None, 12, 28, 14.0, False, False),
        (2, None, None, 3, 28, 2.0, True, True),  # but not for one outside the rotation
        (0, 20, 20, None, 0, 10.0, True, True),  # an average of zero is known
        (None, None, None, 20, 0, 20.0, False, False),
        (None, None, None, None, 0, 0.0, True, True),
    ],
)
def test_availability(spark, last5, last10, last20, season, out, projected, risk, suppressed):
    row = spark.createDataFrame([tuple(None if v is None else float(v) for v in (last5, last10, last20, season, out))], "a double, b double, c double, s double, o double")
    got = row.select(x.availability(C("a"), C("b"), C("c"), C("s"), x.teammate_bump(C("a"), C("s"), C("o"))).alias("x")).first()["x"]
    assert (got["projected"], got["dnp_risk"], got["suppressed"]) == (projected, risk, suppressed)
    assert (got["reason"] is None) is not suppressed


@pytest.mark.parametrize("a, b, rho", [("hits", "total_bases", 0.72), ("rbis", "total_bases", 0.48), ("hits", "hits", 0.0), ("points", "pts_rebs_asts", 0.60), ("steals", "blocks_steals", 0.60), ("hits", "points", 0.20), ("assists", "points", 0.26)])
def test_pair_rho(spark, a, b, rho):
    leg = lambda stat, side, player=1, game=1, team=1: F.struct(F.lit(player).alias("player_id"), F.lit(game).alias("game_id"), F.lit(team).alias("team_id"), F.lit(stat).alias("stat_type"), F.lit(side).alias("direction"))
    ask = lambda one, two: spark.range(1).select(one.alias("a"), two.alias("b")).select(mk.pair_rho("a", "b")).first()[0]
    assert ask(leg(a, "over"), leg(b, "over", game=2)) == rho
    assert ask(leg(b, "over"), leg(a, "under")) == -rho
    assert ask(leg(a, "over"), leg(b, "over", player=2)) == 0.04
    assert ask(leg(a, "over"), leg(b, "over", player=2, team=2)) == ask(leg(a, "over"), leg(b, "over", player=2, game=2)) == 0.0


def picks(spark, rows):
    day = datetime.date(2024, 1, 1)
    return spark.createDataFrame([(s, t, "over", p, w, day) for s, t, p, w in rows], "sport string, stat_type string, direction string, model_prob double, win int, decided date")


def test_cutoff_sweep_flags_only_proven_slices(spark):
    rows = [("nba", "points", 0.85, int(i < 18)) for i in range(20)] + [("nba", "assists", 0.85, int(i < 8)) for i in range(20)]
    rows += [("nba", "steals", 0.85, int(i < 12)) for i in range(18)] + [("nba", "steals", 0.60, 0)] * 40
    rows += [("nba", "blocks", 0.85, 1)] * 10  # too few
    table = spark.createDataFrame([(1, "nba", None, None, 0.70), (2, "nba", "points", None, 0.99), (2, "nba", "assists", None, 0.99), (2, "nba", "steals", None, 0.99)], "level int, sport string, stat_type string, direction string, cutoff double")
    got = {r["stat_type"]: r for r in lg.cutoff_sweep(picks(spark, rows), table).collect()}
    assert {k: r["material"] for k, r in got.items()} == {"points": True, "assists": False, "steals": False}
    assert got["points"]["live_n"] == 0 and got["points"]["best_cutoff"] == 0.5


def growth(f, probs, rho):
    z = np.random.default_rng(42).standard_normal((20_000, len(probs))) @ mk.copula_root(rho).T
    return np.log(np.maximum(1 + (3.0 * (z < mk.normal_quantiles(probs)) - 1) @ f, 1e-6)).mean()


@pytest.mark.parametrize("n, rho, p", [(3, 0.0, 0.40), (3, 0.5, 0.36), (12, 0.3, 0.7), (1, 0.0, 0.2)])
def test_kelly_stakes_are_the_best_within_their_bounds(n, rho, p):
    probs = np.linspace(p, p + 0.05, n)
    m = np.full((n, n), rho) + (1 - rho) * np.eye(n)
    full = 2 * mk.kelly_stakes(probs, m)
    assert (full >= 0).all() and (full <= 0.1 + 1e-12).all() and full.sum() <= 1 + 1e-9
    best, rng = growth(full, probs, m), np.random.default_rng(0)
    for _ in range(60):
        other = mk.on_simplex(full + rng.normal(0, 0.01, n), 0.10, 1.0)
        assert growth(other, probs, m) <= best + 1e-6
    if p == 0.2:
        assert full.max() == 0


def test_kelly_stakes_of_correlated_legs_are_smaller():
    probs = np.full(4, 0.36)
    alone, together = (mk.kelly_stakes(probs, np.full((4, 4), r) + (1 - r) * np.eye(4)).sum() for r in (0.0, 0.6))
    assert together < alone


def test_degenerate_maps():
    from fieldbook.plans.models import degenerate

    flat, steep, pinned = [0.40, 0.42], [0.2, 0.9], [0.2, 0.99]
    assert degenerate([0.3, 0.9], flat, 1000, 500) and not degenerate([0.3, 0.9], steep, 1000, 0)
    assert degenerate([0.3, 0.9], steep, 300, 0)
    assert degenerate([0.3, 0.9], pinned, 1000, 100) and not degenerate([0.3, 0.9], pinned, 1000, 300)


def test_boost_notes(spark):
    sharp = spark.createDataFrame([("a", 5.5, 0.5), ("b", 0.5, 0.95)], "player string, line double, over_prob double")
    rows = [("a", 5.5, "over", 110, ""), ("a", 5.5, "up", 110, ""), ("a", 5.5, "over", 0, None), ("b", 0.5, "over", 110, ""), ("c", 1.5, "over", 110, ""), ("c", 1.5, "over", 110, "mine"), ("a", 5.5, "under", -110, "typed")]
    boosts = spark.createDataFrame(rows, "player string, line double, side string, odds int, typed_note string")
    got = {(r["player"], r["side"], r["odds"], r["typed_note"]): (r["note"], r["ev"]) for r in mk.boost_ev(boosts, sharp, ["player"], "line").collect()}
    assert got["a", "over", 110, ""] == (None, pytest.approx(0.5 * 2.1 - 1))
    assert [got[k][0] for k in (("a", "up", 110, ""), ("a", "over", 0, None), ("b", "over", 110, ""), ("c", "over", 110, ""), ("c", "over", 110, "mine"))] == ["no side", "no odds", "sharp anchor unreliable", "no sharp line", "mine"]
    assert got["a", "under", -110, "typed"] == ("typed", pytest.approx(0.5 * (1 + 100 / 110) - 1))
