"""Modelling jobs (2.9). Fitted numbers depend on the solver, so those queries carry no SQL; evaluations do."""

from pyspark.sql import functions as F

from fieldbook.operators import windows as w
from fieldbook.plans import boosting
from fieldbook.plans import models as m
from fieldbook.queries.base import DENSE, LEDGER, dense_rows, ledger, query, rounded
from fieldbook.queries.windows import ORDER, prior
from fieldbook.session import written

C = F.col
FEATURES = ["last_5_avg_points", "last_10_avg_points", "season_avg_points"]
TRAIN = f"with t as (select player_game_id, game_date, minutes, points, coalesce({prior('avg(points)', 5, 'team_id')}, 0) as f5, row_number() over (partition by team_id order by game_date, player_game_id) as n from ({DENSE}))"


def training(s, d):
    rows = w.prior_means(dense_rows(s, d), ["team_id"], ORDER, ["points"], (5, 10))
    rows = w.season_means(rows, ["team_id"], "season", ORDER, ["points"])
    rows = w.prior_count(rows, ["team_id"], ORDER, "games")
    return m.training_set(rows, FEATURES, C("points"), C("minutes") >= 2, C("games") >= 5)


def labelled(s, d, label):
    """Training rows with another label, computed once: a fit reads them for its bins and its cells, and the evaluation again."""
    return written(training(s, d).select("game_date", *FEATURES, label.alias("label")))


@query("i01_training_set", f"{TRAIN} select player_game_id, round(f5, 6) as last_5_avg_points, points as label from t where minutes >= 2 and n > 5")
def i01(s, d):
    return rounded(training(s, d).select("player_game_id", "last_5_avg_points", "label"))


@query("i03_count_model")
def i03(s, d):
    train, test = m.split_at(training(s, d), "game_date", F.lit("2000-06-01").cast("date"))
    model = m.fit_counts(m.recency_weighted(train, "game_date"), FEATURES, "weight")
    out = m.predict(model, test, FEATURES)
    return rounded(m.evaluate_counts(out, "label", "predicted_mean", "season_avg_points"))


@query("i03_boosted_counts")
def i03_boosted(s, d):
    train, test = m.split_at(training(s, d), "game_date", F.lit("2000-06-01").cast("date"))
    train, valid = (x.drop("is_test") for x in (lambda t: (t.where("not is_test"), t.where("is_test")))(m.split_last_days(train, "game_date", 90)))
    model = boosting.fit_boosted(m.recency_weighted(train, "game_date"), FEATURES, weight="weight", trees=10, valid=valid)
    return rounded(m.evaluate_counts(model.predict(test), "label", "predicted_mean", "season_avg_points"))


@query("i04_winner_model")
def i04(s, d):
    rows = labelled(s, d, (C("points") > 25).cast("double"))
    train, test = m.split_at(rows, "game_date", F.lit("2000-06-01").cast("date"))
    out = m.predict(m.fit_winner(train, FEATURES), test, FEATURES)
    return rounded(m.evaluate_winner(written(out.select("prob", "label")), "prob", "label"))  # predicted once for both parts of the evaluation


@query("i04_margin_model")
def i04_margin(s, d):
    rows = labelled(s, d, C("points") - 25)
    train, test = m.split_at(rows, "game_date", F.lit("2000-06-01").cast("date"))
    out = m.predict(m.fit_margin(train, FEATURES), test, FEATURES).withColumn("zero", F.lit(0.0))
    return rounded(m.evaluate_counts(out, "label", "predicted_margin", "zero"))


@query("i05_evaluation", f"{TRAIN} select count(*) as n, round(avg(abs(points - f5)), 6) as mae, round(sqrt(avg((points - f5) * (points - f5))), 6) as rmse, round(avg(abs(points - 25)), 6) as baseline_mae, round(100 * (1 - avg(abs(points - f5)) / avg(abs(points - 25))), 6) as gain_pct from t where minutes >= 2 and n > 5")
def i05(s, d):
    return rounded(m.evaluate_counts(training(s, d).withColumn("base", F.lit(25.0)), "label", "last_5_avg_points", "base"))


@query("i05_winner_evaluation", f"""with t as (select model_prob as p, win from ({LEDGER})), c as (select p, cast(sum(win) as double) as pos, cast(sum(1 - win) as double) as neg from t group by 1), b as (select *, coalesce(sum(neg) over (order by p rows between unbounded preceding and 1 preceding), 0) as below from c), a as (select cast(sum(pos + neg) as bigint) as n, sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) as auc from b)
select n, round(auc, 6) as auc, round((select avg(-(win * ln(p) + (1 - win) * ln(1 - p))) from t), 6) as log_loss, round((select avg(cast((p >= 0.5) = (win = 1) as int)) from t), 6) as accuracy from a""")
def i05_winner(s, d):
    return rounded(m.evaluate_winner(ledger(s, d).withColumn("label", C("win").cast("double")), "model_prob", "label"))


@query("i06_line_calibration")
def i06(s, d):
    out = m.out_of_fold(training(s, d).select("game_date", "points", "label", *FEATURES), FEATURES, "game_date")
    model, rows = m.calibrate_lines(out, [10.5, 20.5, 30.5], "label")
    rows = m.calibrated(model, rows)
    hit = (C("points") > C("line")).cast("double")
    return rounded(rows.groupBy("line").agg(F.count("*").alias("n"), F.avg("p").alias("raw"), F.avg("calibrated").alias("calibrated"), F.avg(hit).alias("actual")))


@query("i07_model_comparison", f"select count(*) as n, round(avg(abs(quantity - 30 * model_prob)), 6) as mae_a, round(avg(abs(quantity - 40 * market_prob)), 6) as mae_b, round(100 * (avg(abs(quantity - 30 * model_prob)) - avg(abs(quantity - 40 * market_prob))) / avg(abs(quantity - 30 * model_prob)), 6) as gain_pct, 100 * (avg(abs(quantity - 30 * model_prob)) - avg(abs(quantity - 40 * market_prob))) / avg(abs(quantity - 30 * model_prob)) >= 0.5 as promote from ({LEDGER}) where sport <> 'R'")
def i07(s, d):
    t = ledger(s, d).withColumns({"a": 30 * C("model_prob"), "b": 40 * C("market_prob")})
    return rounded(m.compare(t, "quantity", "a", "b", C("sport") != "R"))


@query("i09_ensemble_weight", f"with t as (select i / 20.0::double as w, round(avg(abs(quantity - (i / 20.0::double * 30 * model_prob + (1 - i / 20.0::double) * 40 * market_prob))), 9) as mae from ({LEDGER}), (select unnest(range(0, 21)) as i) group by 1) select w as weight, round(mae, 6) as mae from t order by t.mae, w limit 1")
def i09(s, d):
    t = ledger(s, d).withColumns({"a": 30 * C("model_prob"), "b": 40 * C("market_prob")})
    return rounded(m.ensemble_weight(t, "quantity", "a", "b"))
