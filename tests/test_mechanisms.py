"""The mechanisms behind jobs at scale against plain Python: stored tables, blocks, quantiles, identity, boosting, boards, reports."""

import datetime
import math
import os
import random
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldbook import session
from fieldbook.operators import aggs, blocks, identity, joins, quantiles, windows
from fieldbook.plans import boosting, features, ledger, market, models, quality, reports
from fieldbook.plans import board as bd
from fieldbook.plans.state import FeatureState
from fieldbook.queries import QUERIES, base
from fieldbook.queries import models as model_queries
from fieldbook.sources import payloads, store, tables

DAY = datetime.date(2024, 1, 1)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- stored tables ---------------------------------------------------------------------------------


def test_upsert_replaces_touched_partitions_only(spark, tmp_path):
    path = f"{tmp_path}/t"
    schema = "day date, k int, x string, v int"
    days = [DAY + datetime.timedelta(i) for i in range(3)]
    first = spark.createDataFrame([(d, k, "old", 1) for d in days for k in range(4)] + [(None, 9, "old", 1)], schema)
    store.upsert_partitions(first, path, ["day", "k"], "v", ["day"])
    listed = lambda: {f"{r}/{p}": os.path.getmtime(f"{r}/{p}") for r, _, names in os.walk(path) for p in names if p.endswith(".parquet")}
    files = listed()
    time.sleep(0.05)
    new = spark.createDataFrame([(days[1], 2, "new", 2), (days[1], 7, "new", 2), (days[1], 3, "older", 0), (None, 9, "new", 2)], schema)
    touched = store.upsert_partitions(new, path, ["day", "k"], "v", ["day"])
    assert {r[0] for r in touched.collect()} == {days[1], None}
    left, of = listed(), lambda d: {p for p in files if str(d) in p}
    assert all(left.get(p) == files[p] for d in (days[0], days[2]) for p in of(d)) and not any(p in left for p in of(days[1]))
    got = {(r["day"], r["k"]): r["x"] for r in spark.read.schema(schema).parquet(path).collect()}
    assert got[days[1], 2] == got[days[1], 7] == got[None, 9] == "new" and got[days[1], 3] == got[days[0], 2] == "old" and len(got) == 14
    plan = store.in_partitions(store.stored(spark, path, first.schema), new.select("day").distinct(), ["day"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "day#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    store.upsert_partitions(new, path, ["day", "k"], "v", ["day"])  # a repeated run changes nothing
    assert {(r["day"], r["k"]): r["x"] for r in spark.read.schema(schema).parquet(path).collect()} == got
    store.upsert_partitions(new.where("false"), path, ["day", "k"], "v", ["day"])
    assert spark.read.schema(schema).parquet(path).count() == 14
    with pytest.raises(ValueError):
        store.upsert_partitions(new, path, ["k"], "v", ["day"])


def test_many_touched_partitions_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "MOST_TOUCHED", 1)
    path = f"{tmp_path}/t"
    old = spark.createDataFrame([(a, b, a + b, 1) for a in range(3) for b in range(3)], "a int, b int, x int, v int")
    store.upsert_partitions(old, path, ["a", "b"], "v", ["a", "b"])
    store.upsert_partitions(spark.createDataFrame([(0, 1, 50, 2), (2, 2, 60, 2)], old.schema), path, ["a", "b"], "v", ["a", "b"])
    assert {(r["a"], r["b"]): r["x"] for r in spark.read.schema(old.schema).parquet(path).collect()} == {(a, b): {(0, 1): 50, (2, 2): 60}.get((a, b), a + b) for a in range(3) for b in range(3)}


def test_metrics_of_a_write_equal_a_scan(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 3, None if i % 4 == 0 else float(i)) for i in range(100)], "i int, p int, x double")
    got = tables.write_observed(df, f"{tmp_path}/o", ["p"], {"n": F.count(F.lit(1)), "empty": F.count_if(F.col("x").isNull()), "top": F.max("i")})
    back = spark.read.parquet(f"{tmp_path}/o")
    assert got == {"n": back.count(), "empty": back.where("x is null").count(), "top": 99}


def test_feature_state_equals_windows_over_all_days(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", "c", "d"]), str(2024 + (i > 60)), DAY + datetime.timedelta(i // 4), i, float(rng.randrange(30))) for i in range(120)]
    df = spark.createDataFrame(rows, "p string, season string, day date, id int, x double")
    state = FeatureState(f"{tmp_path}/s", "p", "season", ["day", "id"], ["x"], (3, 20), buckets=3)
    out = None
    for i in range(30):
        got = state.advance(df.where(F.col("day") == DAY + datetime.timedelta(i)))
        out = got if out is None else out.unionByName(got)
    full = windows.prior_count(windows.season_means(windows.prior_means(df, ["p"], ["day", "id"], ["x"], (3, 20)), ["p"], "season", ["day", "id"], ["x"]), ["p", "season"], ["day", "id"], "games")
    names = ["id", "last_3_avg_x", "last_20_avg_x", "season_avg_x"]
    a = [[round(v, 9) for v in r] for r in sorted(map(tuple, out.select(*names, "games_played_season").collect()))]
    b = [[round(v, 9) for v in r] for r in sorted(map(tuple, full.select(*names, "games").collect()))]
    assert a == b and len(a) == 120


# --- blocks and quantiles --------------------------------------------------------------------------


@pytest.mark.parametrize("n_blocks", [1, 3, 64])
@pytest.mark.parametrize("inclusive", [True, False])
def test_blocked_as_of_equals_as_of(spark, n_blocks, inclusive):
    rng = random.Random(n_blocks)
    left = [(i, rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([None, *range(40)])) for i in range(120)]
    right = [(k, t, 100 * j) for j, (k, t) in enumerate({(rng.choice(["hot"] * 6 + ["a", None]), rng.randrange(5, 35)) for _ in range(60)})]
    a, b = spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "k string, at int, v int")
    args = (a, b, ["k"], "t", "at", ["v"], inclusive)
    assert rows_of(blocks.as_of_blocked(*args, blocks=n_blocks)) == rows_of(joins.as_of(*args))
    assert blocks.as_of_blocked(a.where("false"), b, *args[2:]).count() == 0


@pytest.mark.parametrize("n_blocks", [1, 4, 50])
def test_blocked_means_equal_means(spark, n_blocks):
    rng = random.Random(7)
    df = spark.createDataFrame([(i, rng.choice([0] * 5 + [1, 2, None]), DAY + datetime.timedelta(rng.randrange(30)), rng.choice([None, 1.0, 2.0, 5.0])) for i in range(200)], "id int, k int, day date, x double")
    want = windows.prior_means(df, ["k"], ["day", "id"], ["x"], (2, 7))
    got = blocks.prior_means_blocked(df, ["k"], ["day", "id"], ["x"], (2, 7), blocks=n_blocks)
    assert got.columns == want.columns and rows_of(got) == rows_of(want)


@pytest.mark.parametrize("few", [5, 10_000])
def test_quantiles_equal_numpy(spark, few):
    rng = np.random.default_rng(few)
    groups = {"normal": rng.normal(size=400).tolist(), "ties": rng.integers(0, 3, 300).astype(float).tolist(), "one": [4.0], "spread": (2.0 ** rng.integers(-9, 9, 200)).tolist(), None: [1.0, 2.0], "same": [7.5] * 50, "signs": [-1e308, 1e308, 0.0, -5.0, 5.0]}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("normal", None), ("normal", float("nan")), ("empty", None)]
    qs = (0.0, 0.25, 0.5, 1 / 3, 0.9, 1.0)
    got = {r["k"]: r["q"] for r in quantiles.quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", qs, "q", bins=16, few=few).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        if k == "signs":
            assert got[k][2] == 0.0 and got[k][0] == -1e308 and got[k][-1] == 1e308
        else:
            assert got[k] == pytest.approx(np.quantile(vs, qs).tolist(), rel=1e-12)
    assert quantiles.quantiles(spark.createDataFrame(rows, "k string, v double").where("false"), ["k"], "v", qs).count() == 0


# --- identity --------------------------------------------------------------------------------------


def test_identity_takes_the_first_stage_that_fits_and_reruns_alike(spark):
    players = spark.createDataFrame(
        [(1, "nhl", "77", "Zach Benson"), (2, "nhl", "78", "Z. Adams"), (3, "nhl", "pp_9", "Old Placeholder"), (4, "nba", "80", "Zach Benson"), (5, "nhl", "81", "Ann Twin"), (6, "nhl", "82", "Bea Twin"), (7, "nhl", None, "José Núñez-Pérez")],
        "player_id int, sport string, external_id string, name string",
    )
    records = spark.createDataFrame(
        [(1, "nhl", "pp_9", "Whoever"), (2, "nhl", "x1", "zach  benson"), (3, "nhl", "x2", "Jose Nunez Perezz"), (4, "nhl", "x3", "Zoe Adams"), (5, "nhl", "x4", "Cid Twin"), (6, "nhl", "x4", "Cid Twin"), (7, "nhl", "", "No Id"), (8, "nba", "x5", "Zach Benson"), (9, "nhl", None, None), (10, "nhl", "x6", "Kim Placeholder")],
        "row_id int, sport string, external_id string, name string",
    )
    got = {r["row_id"]: (r["stage"], r["player_id"]) for r in identity.resolve(records, players).collect()}
    assert {i: got[i] for i in (1, 2, 3, 4, 8, 9)} == {1: ("external", 3), 2: ("name", 1), 3: ("similar", 7), 4: ("last_name", 2), 8: ("name", 4), 9: (None, None)}
    assert got[5] == got[6] and [got[i][0] for i in (5, 7, 10)] == ["new"] * 3  # two share a last name, a placeholder's doesn't count
    assert sorted({got[i][1] for i in (5, 7, 10)}) == [8, 9, 10]
    assert {r["row_id"]: (r["stage"], r["player_id"]) for r in identity.resolve(records.repartition(7), players).collect()} == got
    stored = players.unionByName(records.where("external_id like 'x%'").select(F.lit(0).alias("player_id"), "sport", "external_id", "name").where("external_id in ('x4', 'x6')").withColumn("player_id", F.when(F.col("external_id") == "x4", got[5][1]).otherwise(got[10][1]).cast("int")).distinct())
    again = {r["row_id"]: (r["stage"], r["player_id"]) for r in identity.resolve(records, stored).collect()}
    assert again[5] == ("external", got[5][1]) and again[10] == ("external", got[10][1])


def test_new_ids_have_no_gaps(spark):
    rows = spark.range(3000).select(F.concat(F.lit("e"), F.col("id") % 1000).alias("e"))
    got = [r["id"] for r in identity.new_ids(rows, "e", spark.createDataFrame([(41,)], "_base bigint")).collect()]
    assert sorted(got) == list(range(42, 1042))


def test_chains_and_circles_are_closed(spark):
    pairs = [(i, i + 1) for i in range(100, 150)] + [(1, 2), (2, 3), (3, 1), (4, 3), (9, 9), (7, 8), (7, 6), (None, 1)]
    got = {r["from_id"]: r["to_id"] for r in identity.closed(spark.createDataFrame(pairs, "from_id int, to_id int")).collect()}
    assert all(got[i] == 150 for i in range(100, 150)) and got[2] == got[3] == 1 and got[7] == 6 and 9 not in got and 1 not in got and got[4] in (1, 2, 3)
    children = {"a": (spark.createDataFrame([(1, 100), (2, 5)], "r int, player_id int"), "player_id"), "b": (spark.createDataFrame([(149, "x")], "p int, y string"), "p")}
    moved = identity.repointed(children, identity.closed(spark.createDataFrame(pairs, "from_id int, to_id int")))
    assert rows_of(moved["a"]) == [(1, 150), (2, 5)] and rows_of(moved["b"]) == [(150, "x")]


# --- boosting --------------------------------------------------------------------------------------


def plain_booster(x, y, trees, depth, edges, least, rate):
    """The same trees from plain arrays."""
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    top = max(len(e) for e in edges) + 1
    s = np.full(len(y), math.log(y.mean()))
    for _ in range(trees):
        g, h = y - np.exp(s), np.exp(s)
        at = np.zeros(len(y), object)
        at[:] = ""
        step = np.zeros(len(y))
        for level in range(depth + 1):
            for path in sorted({p for p in at if p is not None and len(p) == level}):
                inside = at == path
                best = (0.0, None)
                if level < depth:
                    for f in range(x.shape[1]):
                        for b in range(top - 1):
                            left = inside & (binned[:, f] <= b)
                            hl, hr = h[left].sum(), h[inside].sum() - h[left].sum()
                            if hl >= least and hr >= least:
                                gain = round(g[left].sum() ** 2 / hl + (g[inside].sum() - g[left].sum()) ** 2 / hr - g[inside].sum() ** 2 / h[inside].sum(), 9)
                                if gain > best[0]:
                                    best = (gain, (f, b))
                if best[1]:
                    f, b = best[1]
                    at[inside] = np.where(binned[inside, f] <= b, path + "0", path + "1")
                else:
                    step[inside] = np.clip(g[inside].sum() / h[inside].sum(), -0.7, 0.7)
                    at[inside] = None
        s = s + rate * step
    return np.exp(s)


def test_boosted_counts_equal_a_plain_booster_and_beat_the_linear_model(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(-2, 2, size=(500, 2))
    y = rng.poisson(np.exp(0.5 + np.sin(2 * x[:, 0]) + np.where(x[:, 1] > 0.3, 0.8, 0))).astype(float)
    df = spark.createDataFrame([(i, float(a), float(b), float(v)) for i, ((a, b), v) in enumerate(zip(x, y, strict=True))], "i int, a double, b double, label double")
    model = boosting.fit_boosted(df, ["a", "b"], trees=6, depth=2, bins=8)
    want = plain_booster(x, y, 6, 2, [np.array(e) for e in model.edges], 20.0, model.rate)
    got = np.array([r["predicted_mean"] for r in model.predict(df).orderBy("i").collect()])
    assert got == pytest.approx(want, rel=1e-9)
    linear = models.predict(models.fit_counts(df, ["a", "b"]), df, ["a", "b"])
    one = F.lit(1.0)
    assert boosting.deviance(df, "label", model.log_mean(), one) < boosting.deviance(linear, "label", F.log("predicted_mean"), one) - 0.2
    odd = spark.createDataFrame([(None, float("nan"))], "a double, b double")
    assert model.predict(odd).first()["predicted_mean"] > 0
    assert boosting.fit_boosted(df.where("false"), ["a", "b"], trees=1).base == 0.0


def test_platt_fit_is_plain_newton(spark):
    rng = np.random.default_rng(5)
    p = np.round(rng.uniform(0.5, 0.9, 3000), 2)
    win = (rng.uniform(size=3000) < 0.3 + 0.4 * p).astype(int)
    x, beta = np.c_[np.log(p / (1 - p)), np.ones(len(p))], np.array([1.0, 0.0])
    for _ in range(50):
        mu = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.solve((x * (mu * (1 - mu))[:, None]).T @ x, x.T @ (win - mu))
    df = spark.createDataFrame([("s", float(a), int(b)) for a, b in zip(p, win, strict=True)], "sport string, model_prob double, win int")
    cell = ledger.platt_cells(df, ["sport"]).first()
    assert (cell["slope"], cell["intercept"]) == pytest.approx(tuple(beta), abs=1e-6)
    weights = spark.createDataFrame([("s", 0.6)], "sport string, weight double")
    row = ledger.final_probability(df.withColumn("market_prob", F.lit(0.55)).limit(1), ledger.platt_cells(df, ["sport"]), weights, ["sport"], ["sport"]).first()
    own = 1 / (1 + math.exp(-(beta[0] * math.log(row["model_prob"] / (1 - row["model_prob"])) + beta[1])))
    assert row["final_prob"] == pytest.approx(0.6 * own + 0.4 * 0.55, abs=6e-5) and row["edge"] == pytest.approx(row["final_prob"] - 0.55, abs=1e-9)


# --- boards, prices, reports -----------------------------------------------------------------------


def test_calibrators_are_straight_between_their_points(spark):
    xs, ys = [0.2, 0.5, 0.8], [0.3, 0.55, 0.6]
    df = spark.createDataFrame([(p,) for p in (0.0, 0.2, 0.35, 0.5, 0.7, 0.8, 1.0)], "p double")
    arrays = [F.array(*map(F.lit, v)) for v in (xs, ys)]
    assert [r[0] for r in df.select(bd.interpolated(F.col("p"), *arrays)).collect()] == pytest.approx(np.interp([0.0, 0.2, 0.35, 0.5, 0.7, 0.8, 1.0], xs, ys).tolist())
    none = F.lit(None).cast("array<double>")
    assert [r[0] for r in df.select(bd.interpolated(F.col("p"), none, none)).collect()] == [0.0, 0.2, 0.35, 0.5, 0.7, 0.8, 1.0]


def test_prices_of_binary_and_count_models(spark):
    rows = spark.createDataFrame([("hr", 0.5, 0.3, True), ("hr", 1.5, 0.3, True), ("ks", 5.5, 6.2, False), ("hits", 0.5, 1.1, False)], "stat_type string, line_value double, mean double, is_binary boolean")
    got = {(r["stat_type"], r["line_value"]): (r["p_over"], r["direction"]) for r in bd.prices(rows).collect()}
    tail = lambda k, m: 1 - sum(math.exp(-m) * m**i / math.factorial(i) for i in range(k + 1))
    assert ("hits", 0.5) not in got  # tells nothing
    assert got["hr", 0.5] == (pytest.approx(0.3), "under") and got["hr", 1.5][0] == pytest.approx(tail(1, -math.log(0.7 + 1e-9)))
    assert got["ks", 5.5] == (pytest.approx(tail(5, 6.2)), "over")


@pytest.mark.parametrize(("over", "under", "prob", "start", "sides"), [(1.8, 1.8, 0.70, 60, ["over"]), (1.35, 1.35, 0.70, 60, []), (1.8, 1.8, 0.95, 60, []), (3.0, 1.2, 0.70, 60, []), (1.8, 1.8, 0.70, 29, []), (1.8, 1.8, 0.70, 30, [])])
def test_arbitrage_of_offers(spark, over, under, prob, start, sides):
    now = datetime.datetime(2024, 5, 1, 12)
    offer = spark.createDataFrame([("p", 0.5, over, under, now + datetime.timedelta(minutes=start))], "player string, line double, o double, u double, start timestamp")
    sharp = spark.createDataFrame([("p", 0.5, prob)], "player string, line double, over_prob double")
    got = market.arbitrage(offer, sharp, ["player"], "line", "o", "u", start=F.col("start"), now=F.lit(now)).select("side", "ev").collect()
    assert [r["side"] for r in got] == sides
    assert all(0.24 < r["ev"] < 0.28 for r in got)


def test_rank_trend_is_that_of_the_ranked_list(spark):
    rng = random.Random(4)
    for n in (9, 10, 57, 400):
        picks = [("s", DAY + datetime.timedelta(rng.randrange(12)), i, rng.randrange(2)) for i in range(n)]
        got = {r["i"]: (r["n"], r["wins"]) for r in reports.rank_trend(spark.createDataFrame([*picks, ("s", None, -1, 1)], "sport string, settled date, pick_id int, win int"), ["sport"], "settled", "pick_id", "win").collect()}
        ranked = sorted(picks, key=lambda p: (p[1], p[2]))
        want, size = {}, max(20, n // 8)
        for i in range(14 if n >= 10 else 0):
            end = round((i + 1) * n / 14)
            inside = ranked[max(0, end - size) : end]
            if len(inside) >= 5:
                want[i] = (len(inside), sum(p[3] for p in inside))
        assert got == want


def test_drawdown_and_streak(spark):
    rng = random.Random(9)
    picks = [(DAY + datetime.timedelta(rng.randrange(6)), i, rng.randrange(2)) for i in range(80)] + [(DAY + datetime.timedelta(9), 200 + i, 0) for i in range(7)]
    money = peak = 0.0
    for _, _, won in sorted(picks):
        money += math.sqrt(3) - 1 if won else -1
        peak = max(peak, money)
    streak = next(i for i, p in enumerate(sorted(picks)[::-1]) if p[2])
    got = reports.drawdown(spark.createDataFrame(picks, "day date, id int, win int"), "day", "id", "win").first()
    assert got["drawdown"] == pytest.approx(peak - money) and got["streak"] == streak == 7 + next(i for i, p in enumerate(sorted(picks[:80])[::-1]) if p[2])


def test_slates_are_thin_by_lines_for_each_game(spark):
    days = [(DAY + datetime.timedelta(i), 200, 10) for i in range(7)]
    level = lambda board, games: [(r["detail"].split(" ", 1)[1], round(r["value"], 3)) for r in quality.thin_days(spark.createDataFrame([*days, (DAY + datetime.timedelta(7), board, games)], "day date, board int, games int")).collect()]
    assert level(50, 10) == [("thin", 5.0)] and level(40, 2) == [] and level(19, 1) == [("feed broken", 19.0)] and level(60, 10) == []
    few = spark.createDataFrame([(DAY + datetime.timedelta(i), 40 if i < 7 else 1, 10) for i in range(8)], "day date, board int, games int")
    assert quality.thin_days(few).count() == 0  # no baseline


def test_payloads_are_split_by_reason(spark):
    texts = ['{"a": 1, "b": "x"}', '{"a": "2.5"}', '{"a": "two"}', '{"b": 1}', '{"a": null}', "[1]", "nope", None, "3", '{"a": {"c": 1}}']
    raw = spark.createDataFrame(list(enumerate(texts)), "i int, j string")
    good, bad = payloads.typed_payloads(raw, "j", {"a": "double", "b": "string"}, ["a"])
    assert rows_of(good) == [(0, 1.0, "x"), (1, 2.5, None)]
    assert {r["i"]: r["reason"] for r in bad.collect()} == {2: "type a", 3: "missing a", 4: "missing a", 5: "not an object", 6: "not json", 7: "null", 8: "not an object", 9: "type a"}


@pytest.mark.parametrize("name", ["mlb", "nba", "nhl", "nfl"])
def test_no_sport_looks_ahead(spark, name):
    sport = features.SPORTS[name]
    history = lambda last: spark.createDataFrame([(1, 100 + i, DAY + datetime.timedelta(i), "2024", *[float(i + 1 if i < 4 else last)] * len(sport.stats)) for i in range(5)], "player_id int, player_game_id int, game_date date, season string, " + ", ".join(f"`{s}` double" for s in sport.stats))
    of = lambda last: features.player_features(history(last), sport).where("player_game_id = 104").first().asDict()
    a, b = of(3.0), of(999.0)
    names = [c for c in a if c.startswith(("last_", "season_avg_"))]
    assert len(names) > 10 and all(a[c] == b[c] for c in names)
    combined = {c: len(parts) for c, parts in sport.combos.items()}
    assert all(a[f"season_avg_{c}"] == 2.5 * k for c, k in combined.items())


def test_insights(spark):
    row = lambda *v: spark.createDataFrame([v], "l5 string, d string, e double, m double, p double").select(bd.insight(*[F.col(c) for c in "l5 d e m p".split()])).first()[0]
    assert row("3/5", "over", 0.061, 0.05, 0.7) == "hit OVER 3/5 last 5 · +6% vs market · line moving your way"
    assert row("2/2", "under", 0.01, 0.5, 0.645) == "model 64% confident" and row("0/0", "under", None, -0.5, 0.7) == "line moving your way"
    notes = spark.createDataFrame([(6.4, False), (-5.0, None), (2.0, False), (None, None), (9.0, True)], "w double, d boolean").select(bd.weather_note(F.col("w"), F.col("d"))).collect()
    assert [n[0] for n in notes] == ["wind out +6", "wind in -5", "calm", None, "dome (neutral)"]


def test_null_keys_match(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2), ("y", 3)], "k string, v int")
    b = spark.createDataFrame([(None, 10), ("x", 20)], "k string, w int")
    assert rows_of(aggs.matched(a, b, ["k"])) == sorted([(None, 1, 10), ("x", 2, 20), ("y", 3, None)], key=str)


def test_slate_plan_is_greedy(spark):
    rng = random.Random(6)
    combos = []
    for slate in ("x", "y"):
        for size in (2, 3, 4):
            for _ in range(25):
                legs = sorted(rng.sample(range(9), size))
                combos.append((slate, size, legs, 0.3, round(rng.uniform(-0.1, 0.3), 4)))
    combos = list({(c[0], c[1], tuple(c[2])): c for c in combos}.values())
    got = {(r["slate"], r["size"]): (r["legs"], round(r["score"], 9)) for r in market.slate_plan(spark.createDataFrame(combos, "slate string, size int, legs array<int>, joint double, ev double"), "slate").collect()}
    want = {}
    for slate in ("x", "y"):
        used: set[int] = set()
        for size in (4, 3, 2):
            score, legs = max((c[4] - 0.04 * len(used & set(c[2])), [-x for x in c[2]]) for c in combos if c[0] == slate and c[1] == size)
            want[slate, size] = ([-x for x in legs], round(score, 9))
            used |= {-x for x in legs}
    assert got == want


def test_top_parlays_are_the_best_of_all(spark):
    rng = random.Random(2)
    stats = ["points", "rebounds", "pts_rebs", "hits"]
    legs = [(s, 100 * s + i, rng.randrange(4), rng.randrange(2), rng.randrange(2), rng.choice(stats), rng.choice(["over", "under"]), round(rng.uniform(0.5, 0.8), 3), round(rng.uniform(0, 0.2), 3)) for s in range(3) for i in range(10 if s else 2)]
    df = spark.createDataFrame(legs, "slate int, leg_id int, player_id int, team_id int, game_id int, stat_type string, direction string, model_prob double, edge double")
    every, best = market.parlays(df, "slate").collect(), market.top_parlays(df, "slate", 5).collect()
    for s in range(3):
        order = sorted((r for r in every if r["slate"] == s), key=lambda r: (-round(r["ev"], 9), r["legs"]))[:5]
        assert [r["legs"] for r in sorted((r for r in best if r["slate"] == s), key=lambda r: (-round(r["ev"], 9), r["legs"]))] == [r["legs"] for r in order]
    kept = {r["leg_id"]: r for r in market.candidates(df, "slate").collect()}
    for r in every:
        p = [kept[i]["model_prob"] for i in r["legs"]]
        assert p == r["probs"] and len(r["rho"]) == r["size"] ** 2
        total = math.prod(p)
        for i in range(len(p)):
            for j in range(i + 1, len(p)):
                rest = math.prod(x for k, x in enumerate(p) if k not in (i, j))
                total += r["rho"][i * len(p) + j] * math.sqrt(p[i] * (1 - p[i]) * p[j] * (1 - p[j])) * rest
        assert r["joint"] == pytest.approx(min(max(total, 0.01), 0.99))


def test_line_calibration_pools_adjacent_violators(spark):
    rng = np.random.default_rng(4)
    mean = np.round(rng.uniform(2, 12, 700), 1)
    actual = rng.poisson(mean * 0.8)
    df = spark.createDataFrame([(float(m), float(a)) for m, a in zip(mean, actual, strict=True)], "predicted_mean double, y double")
    model, rows = models.calibrate_lines(df, [3.5, 7.5], "y")
    assert model is not None
    cells = sorted((round(r["p"], 12), r["hits"], r["n"]) for r in rows.groupBy("p").agg(F.sum("label").alias("hits"), F.count("*").alias("n")).collect())
    pools: list[list[float]] = []
    for _, hits, n in cells:
        pools.append([hits, n, 1])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            hits, n, k = pools.pop()
            pools[-1] = [pools[-1][0] + hits, pools[-1][1] + n, pools[-1][2] + k]
    want = [h / n for h, n, k in pools for _ in range(k)]
    got = [r["c"] for r in model.transform(rows.select("p").distinct()).select("p", F.col("calibrated").alias("c")).orderBy("p").collect()]
    assert got == pytest.approx(want, abs=1e-9)


def test_absences_compute_the_rotation_once_and_count_unnamed_players(spark):
    day = lambda i: DAY + datetime.timedelta(i)
    rows = [("a", 1, "p", day(0), 20.0, 4.0), ("a", 1, "q", day(0), 30.0, 6.0), ("a", 1, None, day(0), 16.0, 1.0), ("b", 2, "p", day(29), 20.0, 8.0), ("a", 3, "q", day(30), 30.0, 2.0), ("a", 4, "p", day(61), 20.0, 0.0)]
    played = spark.createDataFrame(rows, "team string, game long, player string, day date, minutes double, points double")
    got = joins.absences(played, player="player", team="team", game="game", day="day", minutes="minutes", stats=["points"])
    assert {r["game"]: (r["absent"], r["top_absentee"], r["top_points"], r["freed_points"], round(r["usage_bump"], 6)) for r in got.collect()} == {3: (2, "p", 6.0, 6.0, round(36 / 66, 6))}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(array(") == 1


@pytest.mark.parametrize("on_days", [0, 10_000])
def test_absences_against_brute_force_and_absent_players_are_not_shuffled(spark, monkeypatch, on_days):
    monkeypatch.setattr(joins, "ON_DAYS", on_days)
    rng = np.random.default_rng(8)
    rows, game = [], 0
    for i in range(0, 100, 3):
        for team in "ab":
            for _ in range(rng.integers(1, 3)):
                game += 1
                own = [p for p in ["p", "q", "r", "s", None] if rng.random() < 0.5] or ["p"]
                rows += [(team, game, p, DAY + datetime.timedelta(int(i)), float(rng.integers(1, 40)), float(rng.integers(30))) for p in own]
    played = spark.createDataFrame(rows, "team string, game long, player string, day date, minutes double, points double")
    names = dict(player="player", team="team", game="game", day="day", minutes="minutes", stats=["points"])
    got = joins.absences(played, **names)
    want = {}
    for team, game, day in sorted({(r[0], r[1], r[3]) for r in rows}):
        here = {r[2] for r in rows if r[1] == game and r[4] >= 5} - {None}
        past = defaultdict(list)
        for r in rows:
            if r[0] == team and r[4] >= 5 and 1 <= (day - r[3]).days <= 30:
                past[r[2]].append(r[4])
        mean = {p: sum(m) / len(m) for p, m in past.items() if sum(m) / len(m) >= 15}
        gone = [p for p in mean if p not in here]
        recent = {}
        for p in gone:
            last = sorted((r for r in rows if r[2] == p and r[4] >= 5 and r[3] < day), key=lambda r: (r[3], r[1], r[0]))[-10:]
            recent[p] = sum(r[5] for r in last) / len(last) if p else 0.0  # rows without a name are no one's own
        if gone:
            top = max(gone, key=lambda p: (round(mean[p], 9), p or ""))
            want[game] = (len(gone), top, round(recent[top], 6), round(sum(recent.values()), 6), round(sum(mean[p] for p in gone) / sum(mean.values()), 6))
    assert {r["game"]: (r["absent"], r["top_absentee"], round(r["top_points"], 6), round(r["freed_points"], 6), round(r["usage_bump"], 6)) for r in got.collect()} == want and want
    if on_days:
        assert joins.absences(played, **names)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2


def test_tasks_read_pieces_however_many_rows_there_are(spark):
    own = {k: spark.conf.get(k, None) for k in session.PIECES}
    try:
        for k in session.PIECES:
            spark.conf.unset(k)
        session.in_pieces(spark)
        rows = spark.range(3_000_000).select((F.col("id") % 1_500_000).alias("k"), F.xxhash64("id").alias("x"), F.xxhash64("id", F.lit(1)).alias("y")).groupBy("k").agg(F.sum("x"), F.sum("y"))
        assert rows.rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "32m")
        session.in_pieces(spark)
        assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "32m"
    finally:
        for k, v in own.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_scans_are_cut_small_however_large_the_files_are(spark, tmp_path):
    more = {k: spark.conf.get(k, None) for k in (*session.PIECES, "spark.sql.files.minPartitionNum")}
    try:
        for k in session.PIECES:
            spark.conf.unset(k)
        spark.conf.set("spark.sql.files.minPartitionNum", "1")  # as if the files were large for the number of cores
        spark.range(0, 3_000_000, numPartitions=1).select("id", F.xxhash64("id").alias("x")).write.option("parquet.block.size", 1 << 22).parquet(f"{tmp_path}/big.parquet")
        rows = base.table(spark, str(tmp_path), "big").withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()
        assert sum(r["count"] for r in rows) == 3_000_000
        assert len(rows) > 1 and max(r["count"] for r in rows) < 2_000_000
    finally:
        for k, v in more.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["i04_winner_model", "i04_margin_model"])
def test_tree_models_compute_their_rows_once(spark, monkeypatch, name):
    computed = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def points(i):
        computed.add(1)
        return float(i * 7 % 50)

    rows = spark.range(300).select("id", points("id").alias("points"), (F.col("id") % 9).cast("double").alias("last_5_avg_points"), (F.col("id") % 11).cast("double").alias("last_10_avg_points"), F.lit(1.0).alias("season_avg_points"))
    cut = F.lit("2000-06-01").cast("date")
    monkeypatch.setattr(model_queries, "training", lambda *_: rows.withColumn("game_date", F.when(F.col("id") < 200, F.date_sub(cut, 1)).otherwise(cut)))
    assert QUERIES[name](spark, "").first()["n"] == 100
    assert computed.value == 300


@pytest.mark.parametrize("fit, trees, out", [(models.fit_winner, models.GBTClassifier, "prob"), (models.fit_margin, models.GBTRegressor, "predicted_margin")])
def test_trees_of_counted_cells_are_those_of_all_rows(spark, monkeypatch, fit, trees, out):
    rng = np.random.default_rng(5)
    x = rng.integers(0, [7, 4, 2], size=(2000, 3)).astype(float)
    y = (rng.random(2000) < 0.1 + x @ [0.08, 0.1, 0.05]).astype(float)
    names = ["a", "b", "c"]
    rows = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, label double").persist()
    more = {"predictionCol": "predicted_margin"} if out == "predicted_margin" else {}
    plain = trees(maxIter=20, maxDepth=3, seed=7, **more).fit(models.assembled(rows, names))
    want = {tuple(r)[:3]: r[out] for r in models.predict(plain, rows, names).select(*names, out).distinct().collect()}
    read, own = [], trees.fit
    monkeypatch.setattr(trees, "fit", lambda self, df, *more: read.append(df.count()) or own(self, df, *more))
    model = fit(rows, names)
    got = {tuple(r)[:3]: r[out] for r in models.predict(model, rows, names).select(*names, out).distinct().collect()}
    assert got == pytest.approx(want, abs=1e-9) and len({round(v, 6) for v in want.values()}) > 20
    assert read and read[0] <= 2 * 7 * 4 * 2  # cells, not rows
    odd = spark.createDataFrame([(None, 1.0, float("nan")), (-9.0, 99.0, float("inf"))], "a double, b double, c double")
    assert models.predict(model, odd, names).where(F.col(out).isNotNull()).count() == 2


def test_nearest_anchor_goes_to_the_rows_of_a_hot_key(spark):
    rows = spark.createDataFrame([(i, "a", float(i % 9)) for i in range(60)] + [(99, "b", 1.0), (100, "none", 1.0)], "id long, k string, mean double")
    anchors = spark.createDataFrame([("a", 0.0, 1, 2), ("a", 4.0, 3, 4), ("a", 8.0, 5, 6), ("b", 7.0, 7, 8)], "k string, anchor double, low int, high int")
    got = aggs.nearest_anchor(rows, anchors, ["k"], "id", "mean")
    want = {0: (0.0, 1, 2), 4: (4.0, 3, 4), 8: (8.0, 5, 6)}
    near = [0, 0, 0, 4, 4, 4, 4, 8, 8]  # ties go to the lower one
    assert {r["id"]: (r["anchor"], r["low"], r["high"]) for r in got.collect()} == {i: want[near[i % 9]] for i in range(60)} | {99: (7.0, 7, 8)}
    assert "strategy=broadcast" in got._jdf.queryExecution().optimizedPlan().toString()


def test_lines_of_a_group_merge_as_one_table():
    import pandas as pd

    from fieldbook.streaming import closing

    first = pd.DataFrame({"key": ["a", "b", "a"], "at": [5, 1, 2], "value": [9.0, 4.0, 1.0]})
    held = closing.merge(None, first, 8.0)
    got = closing.merge(held, pd.DataFrame({"key": ["a", "c", "a"], "at": [7, 7, 9], "value": [1.0, 3.0, 21.0]}), 8.0).set_index("key")
    assert got.loc["a"].tolist() == [2, 1.0, 9, 21.0, 4, 3, 20.0]  # moves 8, -8 and 20
    assert held.set_index("key").loc["a", "largest"] == 8.0
    assert got.loc["b"].tolist()[:6] == [1, 4.0, 1, 4.0, 1, 0] and got.loc["c"].tolist()[:6] == [7, 3.0, 7, 3.0, 1, 0]


def test_line_moves_forget_one_key_of_a_group_and_keep_the_others(spark, tmp_path, monkeypatch):
    from fieldbook.streaming import jobs

    monkeypatch.setattr(jobs, "GROUPS", 1)
    batches = [[(1, "2024-01-01 00:00", 1.0), (2, "2024-01-01 00:00", 1.0)], [(2, "2024-01-06 00:00", 2.0)], [(2, "2024-01-06 02:00", 7.0), (None, "2024-01-06 02:00", 1.0)], [(1, "2024-01-07 00:00", 9.0), (None, "2024-01-07 00:00", 8.0), (2, "2024-01-06 23:30", 7.0)]]
    for rows in batches:
        frame = spark.createDataFrame(rows, "user bigint, ts string, value double")
        frame.selectExpr("user", "cast(ts as timestamp) as ts", "value").coalesce(1).write.mode("append").parquet(f"{tmp_path}/lines")
    moves = jobs.line_moves(jobs.snapshots(spark, f"{tmp_path}/lines", files_per_trigger=1), "user", "ts", "value", 5.0)
    got = jobs.run_available(moves, "moves_of_a_group", f"file://{tmp_path}/state", "update")
    assert got.schema["user"].dataType.simpleString() == "bigint"
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(2, 1.0, 7.0, 6.0), (2, 1.0, 7.0, 6.0), (None, 1.0, 8.0, 7.0)], key=str)


def test_out_of_fold_computes_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def touch(x):
        seen.add(1)
        return float(x % 7)

    rows = spark.range(400).select(F.udf(touch, "double")("id").alias("x"), (F.col("id") % 5 + 1.0).alias("label"), F.date_add(F.lit(DAY), (F.col("id") % 40).cast("int")).alias("day"))
    out = models.out_of_fold(rows, ["x"], "day", folds=3)
    assert 0 < out.count() < 400 and seen.value == 400


def test_form_leaves_players_without_a_pick_behind(spark):
    from fieldbook.plans.board import graded_form

    picks = spark.createDataFrame([(1, 7, "hits", "over", 1.5), (2, 8, "hits", "under", 1.5)], "pick_id long, player_id long, stat_type string, direction string, line_value double")
    games = [(7, "hits", i, i, float(i)) for i in range(1, 5)] + [(9, "hits", i, i, 1.0) for i in range(50)] + [(7, "runs", 1, 1, 9.0)]
    out = graded_form(picks, spark.createDataFrame(games, "player_id long, stat_type string, game_date int, game_id int, actual double"))
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in out.collect()} == {(1, "3/4", "3/4"), (2, "0/0", "0/0")}


def test_board_rows_of_the_ledger_shuffle_no_other_players(spark):
    from fieldbook.queries.ledger import g28

    plan = g28(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") >= 2


def test_anchors_of_offers_are_computed_once(spark, tmp_path):
    spark.createDataFrame([(1, 5.5, 0.6), (1, 6.5, 0.4), (2, 3.5, 0.5)], "player_id long, line double, over_prob double").write.parquet(f"{tmp_path}/sharp")
    sharp = spark.read.parquet(f"{tmp_path}/sharp")
    offers = spark.createDataFrame([(1, 4.5, 2.0, 2.0), (2, 3.5, 2.0, 2.0)], "player_id long, line double, up double, down double")
    out = market.arbitrage(offers, sharp, ["player_id"], "line", "up", "down", low=-1.0, high=9.0)
    assert not [f for f in out.inputFiles() if "/sharp/" in f]  # what built the quotes is not in the plan, twice or once
    assert {r.player_id: r.main_line for r in out.collect()} == {1: 5.5, 2: 3.5}


def test_fresh_board_deals_no_snapshots_by_group(spark, tmp_path):
    spark.range(20_000).select((F.col("id") % 3).alias("stat"), (F.col("id") % 500).alias("player"), F.timestamp_seconds(F.col("id")).alias("at"), F.xxhash64("id").alias("line")).write.parquet(f"{tmp_path}/lines")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        out = joins.fresh_board(spark.read.parquet(f"{tmp_path}/lines"), ["stat"], ["player"], "at", hours=1)
        plan = out._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        newest = {k: max(i for i in range(20_000) if i % 3 == k) for k in range(3)}
        assert out.count() == len({(i % 3, i % 500) for i in range(20_000) if i >= newest[i % 3] - 3600})
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
