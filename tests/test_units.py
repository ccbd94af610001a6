"""Operators on small frames: edge cases and properties."""

import datetime as dt
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldbook.functions import counts
from fieldbook.functions import scalars as x
from fieldbook.operators import aggs, joins, windows
from fieldbook.plans import features, ledger, market
from fieldbook.sources import tables

C = F.col


def one(df):
    return df.first()


def values(spark, ddl, rows, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, ddl).select(*cols).collect()]


def test_grades_and_clv(spark):
    rows = [(5.0, 4.5, "over"), (4.0, 4.5, "over"), (4.0, 4.5, "under"), (4.5, 4.5, "over"), (None, 4.5, "over"), (5.0, 4.5, None)]
    got = values(spark, "a double, l double, d string", rows, x.grade(C("a"), C("l"), C("d")), x.clv_points(C("l"), C("a"), C("d")))
    assert [g[0] for g in got] == ["win", "loss", "win", "push", None, None]
    assert got[0][1] == 0.5 and got[2][1] == 0.5 and got[4][1] is None


def test_stats_and_texts(spark):
    got = values(spark, "s string", [('{"hits": 3, "x": "7"}',), ('{"hits": "bad"}',), (None,), ("not json",)], x.stat(C("s"), "hits"), x.stat(C("s"), "y", "x"))
    assert got == [(3.0, 7.0), (0.0, 0.0), (0.0, 0.0), (0.0, 0.0)]
    got = values(spark, "s string", [("5-12",), ("--",), ("",), (None,)], x.made_attempted(C("s"))["made"], x.made_attempted(C("s"))["attempted"])
    assert got == [(5, 12), (0, 0), (0, 0), (0, 0)]
    assert [r[0] for r in values(spark, "s string", [("31:30",), ("12",), ("DNP",), (None,)], x.minutes(C("s")))] == [31.5, 12.0, 0.0, 0.0]
    assert values(spark, "s string", [("  José  O'Brien-Łuk Jr. ",)], x.name_key(C("s")))[0][0] == "jose o brien luk jr"
    assert values(spark, "a double, b double", [(1.0, None)], x.combo([C("a"), C("b")]), x.combo([C("a"), C("b")], strict=False)) == [(None, 1.0)]


def test_odds(spark):
    got = values(spark, "a int, b int", [(150, -170), (-110, -110), (0, -110), (None, 100)], x.american_implied(C("a")), x.american_decimal(C("a")), x.no_vig(C("a"), C("b")))
    assert got[0][:2] == (0.4, 2.5) and got[1][2] == 0.5 and got[2][0] is None and got[3][2] is None
    low, high = values(spark, "w int, n int", [(0, 0), (7, 10)], *x.wilson(C("w"), C("n")))
    assert low == (0.0, 1.0) and high[0] < 0.7 < high[1]
    home, away = values(spark, "t double, s double", [(220.0, 4.0)], *x.implied_totals(C("t"), C("s")))[0]
    assert (home, away) == (112.0, 108.0)


def test_wind_and_injuries(spark):
    got = [r[0] for r in values(spark, "f double", [(180.0,), (0.0,), (90.0,)], x.wind_out(F.lit(10.0), C("f"), F.lit(0.0)))]
    assert got == pytest.approx([10, -10, 0], abs=1e-9)
    got = [r[0] for r in values(spark, "s string", [("Out",), ("Probable - was out",), ("Doubtful",), (None,), ("10-Day-IL",)], x.is_out(C("s")))]
    assert got == [True, False, True, False, True]


def test_count_distributions(spark):
    rows = [(1.5, 2.0), (-1.0, 2.0), (0.5, 0.0), (None, 2.0), (4.5, 250.0)]
    got = [r[0] for r in values(spark, "l double, m double", rows, counts.poisson_over(C("l"), C("m")))]
    assert got[0] == pytest.approx(0.593994, abs=1e-6) and got[1] == 1.0 and got[2] == 0.0 and got[3] is None and got[4] == pytest.approx(1.0)
    nb = [r[0] for r in values(spark, "p double", [(1.0,), (1.5,), (3.0,)], counts.count_over(F.lit(7.5), F.lit(4.0), C("p")))]
    assert nb[0] < nb[1] < nb[2]
    lines = [r[0] for r in values(spark, "l double", [(k + 0.5,) for k in range(8)], counts.count_over(C("l"), F.lit(4.0), F.lit(2.0)))]
    assert lines == sorted(lines, reverse=True)


@pytest.mark.parametrize("mean", [3.0, 5.0, 8.0])
def test_implied_mean_round_trip(spark, mean):
    df = spark.createDataFrame([(4.5, mean)], "l double, m double").withColumn("p", counts.poisson_over(C("l"), C("m")))
    assert one(df.select(counts.implied_mean(C("l"), C("p"))))[0] == pytest.approx(mean, abs=1e-6)
    assert one(spark.createDataFrame([(4.5, 1.5)], "l double, p double").select(counts.implied_mean(C("l"), C("p"))))[0] is None


def history(spark, last):
    rows = [(1, i, dt.date(2024, 12, 28) + dt.timedelta(days=i), "2024" if i < 4 else "2025", float(i + 1)) for i in range(8)] + [(1, 8, dt.date(2025, 1, 5), "2025", last)]
    return spark.createDataFrame(rows, "player_id int, player_game_id int, game_date date, season string, points double")


def test_features_do_not_look_ahead(spark):
    sport = features.Sport(("points",), (5, 10), {"points": (3.5,)})
    a, b = ({r["player_game_id"]: r for r in features.player_features(history(spark, v), sport).drop("points").collect()} for v in (1.0, 999.0))
    assert a == b
    assert a[0]["last_5_avg_points"] == 0 and a[0]["days_rest"] == -1 and a[4]["games_played_season"] == 0
    assert a[8]["last_5_avg_points"] == 6.0 and a[8]["season_avg_points"] == 6.5


def test_other_windows_do_not_look_ahead(spark):
    def table(v):
        df = history(spark, v).withColumn("won", (C("points") > 4).cast("int"))
        o = (["player_id"], ["game_date", "player_game_id"])
        df = windows.prior_spread(windows.career_vs(windows.prior_totals(df, *o, ["points"]), *o, ["points"]), *o, "points", "spread")
        df = windows.games_in_days(windows.form(windows.conditional_last(df, *o, "points", C("points") > 2, "big"), *o, "won"), *o, "game_date")
        return {r["player_game_id"]: r for r in df.drop("points", "won").collect()}

    assert table(1.0) == table(999.0)


def test_upcoming_row_equals_training_row(spark):
    rows = history(spark, 5.0)
    ahead = rows.where("player_game_id = 8").select("player_id", "game_date")
    live = windows.prior_means(windows.upcoming(rows.where("player_game_id < 8"), ahead), ["player_id"], ["game_date", "player_game_id"], ["points"])
    train = windows.prior_means(rows, ["player_id"], ["game_date", "player_game_id"], ["points"]).where("player_game_id = 8")
    assert one(live.where("is_upcoming"))["last_10_avg_points"] == one(train)["last_10_avg_points"]


def test_latest_first_and_streak(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, t int, v string")
    assert {r["k"]: r["v"] for r in windows.latest_per_key(df, ["k"], ["t"]).collect()} == {1: "b", 2: "c"}
    assert {r["k"]: r["v"] for r in windows.first_per_key(df, ["k"], ["t"]).collect()} == {1: "a", 2: "c"}
    assert windows.latest_per_key(df.where("k = 9"), ["k"], ["t"]).count() == 0
    bets = spark.createDataFrame([(1, i, w) for i, w in enumerate([1, 0, 0])] + [(2, 0, 0), (3, 0, 1)], "k int, t int, win int")
    assert {r["k"]: r["losing_streak"] for r in windows.losing_streak(bets, ["k"], ["t"], "win").collect()} == {1: 2, 2: 1, 3: 0}


def test_as_of_takes_ties_and_misses(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 2, 10.0), (1, 5, 20.0)], "k int, s int, v double")
    got = {(r["k"], r["t"]): r["v"] for r in joins.as_of(left, right, ["k"], "t", "s", ["v"]).collect()}
    assert got == {(1, 5): 20.0, (1, 1): None, (2, 9): None}
    got = {(r["k"], r["t"]): r["v"] for r in joins.as_of(left, right, ["k"], "t", "s", ["v"], inclusive=False).collect()}
    assert got[(1, 5)] == 10.0


def test_trigram_matches_equal_brute_force(spark):
    rng = random.Random(3)
    names = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(3, 9))) for _ in range(60)})
    grams = {n: {f"  {n} "[i : i + 3] for i in range(len(n) + 1)} for n in names}
    want = {(a, b) for a in names[:30] for b in names[20:] if len(grams[a] & grams[b]) / len(grams[a] | grams[b]) > 0.5}
    left, right = (spark.createDataFrame([(n,) for n in p], "name string") for p in (names[:30], names[20:]))
    assert {(r["name"], r["match"]) for r in joins.trigram_matches(left, right, "name", 0.5).collect()} == want


def test_trigram_matches_in_blocks_give_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(joins, "NAMES", 3)
    gram = lambda s: {f"  {s} "[i : i + 3] for i in range(len(s) + 1)}
    names = [f"customer {i:05d}" for i in range(0, 2000, 37)] + ["", "x", "customer"]
    others = [f"customer {i:05d}{'x' * (i % 3)}" for i in range(0, 2000, 41)] + ["", "x"]
    left, right = (spark.createDataFrame([(n,) for n in x], "name string") for x in (names, others))
    want = sorted((a, b, s) for a in names for b in others if (s := len(gram(a) & gram(b)) / len(gram(a) | gram(b))) > 0.6)
    assert len(want) > 100
    assert sorted(map(tuple, joins.trigram_matches(left, right, "name", 0.6).collect())) == want


def test_auc_edge_cases(spark):
    cases = {"perfect": ([0.1, 0.2, 0.8, 0.9], [0, 0, 1, 1], 1.0), "reversed": ([0.9, 0.8, 0.2, 0.1], [0, 0, 1, 1], 0.0), "tied": ([0.5] * 4, [0, 1, 0, 1], 0.5), "one class": ([0.1, 0.9], [1, 1], None)}
    rows = [(k, p, y) for k, (ps, ys, _) in cases.items() for p, y in zip(ps, ys, strict=True)]
    got = {r["k"]: r["auc"] for r in aggs.auc(spark.createDataFrame(rows, "k string, model_prob double, win int"), ["k"]).collect()}
    assert got == {k: v[2] for k, v in cases.items()}


def synthetic(kind, n=4500, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        sport, stat, side, p = rng.choice("ABCDEF"), rng.choice("wxyz"), rng.choice(["over", "under"]), round(rng.uniform(0.55, 0.85), 3)
        day = rng.randint(0, 140)
        rate = 0.5 if kind == "noise" else 0.5 + (p - 0.55) * 1.3
        rows.append((i, sport, stat, side, p, int(rng.random() < rate), dt.date(2025, 1, 1) + dt.timedelta(days=day), dt.date(2025, 1, 1) + dt.timedelta(days=day + rng.randint(0, 2))))
    return rows


DDL = "pick_id int, sport string, stat_type string, direction string, model_prob double, win int, decided date, settled date"


def best(pairs, least, step_up):
    if len(pairs) < least:
        return None
    good = []
    for t in ledger.GRID:
        w = [w for p, w in pairs if p >= t]
        if len(w) >= least:
            r, n = sum(w) / len(w), len(w)
            lb = (r + 1 / (2 * n) - math.sqrt(r * (1 - r) / n + 1 / (4 * n * n))) / (1 + 1 / n)
            if lb >= x.BREAKEVEN:
                good.append((t, lb))
    if not good:
        return None
    top = max(b for _, b in good)
    return next(t for t, b in good if not step_up or b >= top - ledger.STEP_UP)


def table_of(rows):
    groups = defaultdict(list)
    for _, sport, stat, side, p, w, _, _ in rows:
        for k in ((sport,), (sport, stat), (sport, stat, side)):
            groups[k].append((p, w))
    out = {}
    for k, pairs in groups.items():
        c = best(pairs, 30 if len(k) == 1 else 40, len(k) > 1)
        if c is None:
            n, r = len(pairs), sum(w for _, w in pairs) / len(pairs)
            ub = (r + 1 / (2 * n) + math.sqrt(r * (1 - r) / n + 1 / (4 * n * n))) / (1 + 1 / n)
            c = (0.99 if n >= 30 else 0.70) if len(k) == 1 else 0.99 if n >= 15 and ub < x.BREAKEVEN else None
        if c is not None:
            out[k] = c
    return out


def replay(rows):
    out = {}
    for day in {r[6] for r in rows}:
        known = [r for r in rows if r[7] < day]
        table = table_of(known) if len(known) >= 30 else {}
        for r in rows:
            if r[6] == day:
                c = table.get(r[1:4]) or table.get(r[1:3]) or table.get(r[1:2]) or 0.70
                if r[4] >= c:
                    out[r[0]] = c
    return out


@pytest.mark.parametrize("kind", ["noise", "signal"])
def test_walk_forward_equals_replay(spark, kind):
    rows = synthetic(kind)
    got = {r["pick_id"]: r["cutoff"] for r in ledger.walk_forward(spark.createDataFrame(rows, DDL)).collect()}
    assert got == replay(rows)


def test_walk_forward_tells_noise_from_signal(spark):
    hit = {}
    for kind in ("noise", "signal"):
        df = spark.createDataFrame(synthetic(kind), DDL)
        hit[kind] = [one(t.agg(F.avg(C("win").cast("double"))))[0] for t in (ledger.walk_forward(df), ledger.in_sample(df))]
    assert abs(hit["noise"][0] - 0.5) < 0.06 and hit["noise"][1] > hit["noise"][0] - 0.01 and hit["signal"][0] > 0.6


def test_blend_and_platt(spark):
    rows = [("a", 0.9, 0.5, i % 2) for i in range(100)] + [("b", 0.9, 0.5, 1) for _ in range(10)]
    got = {r["sport"]: r["weight"] for r in ledger.blend_weights(spark.createDataFrame(rows, "sport string, model_prob double, market_prob double, win int"), ["sport"]).collect()}
    assert got == {"a": 0.0, "b": 1.0}
    rows = [("a", 0.85, int(i % 5 < 3)) for i in range(400)]
    r = one(ledger.platt_cells(spark.createDataFrame(rows, "sport string, model_prob double, win int"), ["sport"]))
    p = 1 / (1 + math.exp(-(r["slope"] * math.log(0.85 / 0.15) + r["intercept"])))
    assert r["fitted"] and r["slope"] < 1 and p == pytest.approx(0.6, abs=0.01)


def test_settle_order(spark):
    picks = spark.createDataFrame([(1, 1, 1, 1, "h", "over"), (2, 2, 1, 1, "h", "over"), (3, 9, 1, 1, "h", "over"), (4, 1, 2, 1, "h", "over"), (5, 1, 3, 1, "h", "over"), (6, 1, 1, 7, "h", "over"), (7, 1, 1, 1, "z", "over")], "pick_id int, game_id int, player_id int, line_id int, stat_type string, direction string")
    games = spark.createDataFrame([(1, "final", dt.date(2025, 1, 1)), (2, "postponed", dt.date(2025, 1, 1))], "game_id int, status string, game_date date")
    lines = spark.createDataFrame([(1, 1.5)], "line_id int, line_value double")
    box = spark.createDataFrame([(1, 1, None, {"h": 2.0}, None), (1, 3, False, {"h": 2.0}, None)], "game_id int, player_id int, did_play boolean, stats map<string,double>, batters_faced int")
    got = {r["pick_id"]: r["outcome"] for r in ledger.settle(picks, games, lines, box, F.lit("2025-01-02").cast("date")).collect()}
    assert got == {1: "win", 2: "void", 3: "wait", 4: "void", 5: "void", 6: "void", 7: "missing"}


def test_parlays_and_kelly(spark):
    legs = spark.createDataFrame([(1, i, i, 0, i, "s", "over", 0.6, 0.1) for i in range(5)], "slate int, leg_id int, player_id int, team_id int, game_id int, stat_type string, direction string, model_prob double, edge double")
    got = {r["size"]: r["n"] for r in market.parlays(legs, "slate").groupBy("size").agg(F.count("*").alias("n")).collect()}
    assert got == {2: 10, 3: 10, 4: 5}
    rho = np.array([[1, 0.5], [0.5, 1]])
    assert 0.36 < market.copula_joint([0.6, 0.6], rho.ravel()) < 0.6
    assert market.copula_joint([0.6, 0.6], np.eye(2).ravel()) == pytest.approx(0.36, abs=0.01)
    stakes = market.kelly_stakes(np.array([0.9, 0.3]), np.eye(2))
    assert stakes[0] == pytest.approx(0.05) and stakes[1] == 0


def test_upsert_patch_prune(spark):
    old = spark.createDataFrame([(1, 1.0, 0), (2, 2.0, 0)], "k int, v double, t int")
    new = spark.createDataFrame([(2, 5.0, 1), (3, 6.0, 1)], "k int, v double, t int")
    assert sorted(tuple(r) for r in tables.upsert(old, new, ["k"], "t").collect()) == [(1, 1.0, 0), (2, 5.0, 1), (3, 6.0, 1)]
    snap = spark.createDataFrame([(1, dt.date(2025, 1, 1)), (2, dt.date(2025, 1, 1)), (3, dt.date(2025, 2, 1))], "line_id int, at date")
    picks = spark.createDataFrame([(2,), (None,)], "line_id int")
    assert sorted(r[0] for r in tables.prune(snap, picks, "line_id", "at", F.lit("2025-02-02").cast("date"), 10).select("line_id").collect()) == [2, 3]
