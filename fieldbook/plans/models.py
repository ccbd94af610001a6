"""Modelling jobs on Spark ML, and their evaluation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.functions.counts import poisson_over
from fieldbook.functions.scalars import recency_weight
from fieldbook.operators.aggs import auc
from fieldbook.plans.boosting import bin_edges
from fieldbook.plans.market import COMBOS
from fieldbook.session import written


def training_set(rows: DataFrame, features: Sequence[str], target: Column, appeared: Column, history: Column | None = None, market: str | None = None, binary_over: float | None = None) -> DataFrame:
    """Rows that appeared (and have history), missing features 0, market default 0.5, and the target (above a line if binary_over)."""
    out = rows.where(appeared if history is None else appeared & history)
    out = out.withColumns({f: F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)) for f in features})
    if market:
        out = out.withColumn(market, F.coalesce(market, F.lit(0.5)))
    y = target.cast("double") if binary_over is None else (target > binary_over).cast("double")
    return out.withColumn("label", y).where("label is not null")


#: Fixed value: minutes that a player must have played for a backtest row.
LEAST_MINUTES = 10


def backtest_rows(odds: DataFrame, games: DataFrame, box: DataFrame, players: DataFrame, since: Column, combos: Mapping[str, Sequence[str]] = COMBOS) -> DataFrame:
    """Quotes of finished games since a day with what the player did: quotes x games x box scores x players.

    odds: game_id, player_id, stat_type, line_value, over_prob, book; games: game_id, game_date, status; box: game_id, player_id, minutes,
    stats (map); players: player_id, player_name. actual is the stat of the quote's name, or the sum of a combined
    stat's parts (null if one is missing, or for a stat that the box doesn't have).
    """
    parts = F.try_element_at(F.create_map(*[x for name, of in combos.items() for x in (F.lit(name), F.array(*map(F.lit, of)))]), F.col("stat_type"))
    values = F.transform(F.coalesce(parts, F.array("stat_type")), lambda p: F.try_element_at(F.col("stats"), p))
    actual = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    done = games.where((F.col("status") == "final") & (F.col("game_date") >= since)).select("game_id", "game_date")
    played = box.where(F.col("minutes") >= LEAST_MINUTES).select("game_id", "player_id", "minutes", "stats")
    rows = odds.where("over_prob is not null").join(done, "game_id").join(played, ["game_id", "player_id"]).join(players.select("player_id", "player_name"), "player_id")
    return rows.select("game_date", "game_id", "player_id", "player_name", "stat_type", "line_value", "over_prob", "book", "minutes", actual.alias("actual"))


def split_at(rows: DataFrame, date: str, cut: Column) -> tuple[DataFrame, DataFrame]:
    return rows.where(F.col(date) < cut), rows.where(F.col(date) >= cut)


def split_last_days(rows: DataFrame, date: str, days: int) -> DataFrame:
    """Rows with `is_test`: the last days before and with the newest date; the date is one aggregated row."""
    newest = rows.agg(F.max(date).alias("_max"))
    return rows.join(F.broadcast(newest)).withColumn("is_test", F.datediff("_max", date) < days).drop("_max")


def split_quantile(rows: DataFrame, date: str, q: float) -> DataFrame:
    """Rows with `is_test`: days above the quantile of days."""
    day = F.unix_date(F.col(date).cast("date"))
    cut = rows.agg(F.percentile(day, q).alias("_cut"))
    return rows.join(F.broadcast(cut)).withColumn("is_test", day > F.col("_cut")).drop("_cut")


def recency_weighted(rows: DataFrame, date: str, half_life: float = 365.0) -> DataFrame:
    newest = rows.agg(F.max(date).alias("_max"))
    return rows.join(F.broadcast(newest)).withColumn("weight", recency_weight(F.col(date), F.col("_max"), half_life)).drop("_max")


def assembled(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep").transform(rows)


def fit_counts(train: DataFrame, features: Sequence[str], weight: str | None = None, ridge: float = 1e-3) -> Transformer:
    """A Poisson regression of the label."""
    model = GeneralizedLinearRegression(family="poisson", link="log", regParam=ridge, maxIter=25, labelCol="label", featuresCol="features", predictionCol="predicted_mean")
    return (model.setWeightCol(weight) if weight else model).fit(assembled(train, features))


#: Bins of a feature, as many as Spark's trees have by default, and the prefix of their columns.
BINS, BIN = 32, "_bin_"


def fit_binned(trees: Estimator, train: DataFrame, features: Sequence[str], keys: Sequence[str], label: Column) -> Transformer:
    """Trees that are fitted on cells: trees see bins alone, so training rows of the same bins and `keys` are one row with their number as its weight.

    Bins are quantiles of all rows. A tree's steps read the cells then, whose number is bound by the bins for few features (for many there are at most as many as rows).
    """
    edges = [[x for x in e if np.isfinite(x)] or [0.0] for e in bin_edges(train, features, BINS)]
    names = [BIN + f for f in features]
    bins = Bucketizer(splitsArray=[[-np.inf, *e, np.inf] for e in edges], inputCols=list(features), outputCols=names, handleInvalid="keep")
    # missing values have the last bin; these columns lose the bins' marks as categories, which have no order for trees
    cells = [F.coalesce(n, F.lit(len(e) + 1.0)).alias(n) for n, e in zip(names, edges, strict=True)]
    cells = written(bins.transform(train).groupBy(*cells, *keys).agg(label.alias("_label"), F.count("*").cast("double").alias("_n")))
    vectors = VectorAssembler(inputCols=names, outputCol=BIN, handleInvalid="keep")
    return PipelineModel([bins, vectors, trees.copy({trees.maxBins: BINS + 1, trees.labelCol: "_label", trees.featuresCol: BIN, trees.weightCol: "_n"}).fit(vectors.transform(cells))])


def fit_winner(train: DataFrame, features: Sequence[str], trees: int = 20, depth: int = 3, seed: int = 7) -> Transformer:
    return fit_binned(GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed), train, features, ["label"], F.first("label"))


def fit_margin(train: DataFrame, features: Sequence[str], trees: int = 20, depth: int = 3, seed: int = 7) -> Transformer:
    """A cell's mean stands for its labels, as the squared loss within a cell is the same for all trees."""
    return fit_binned(GBTRegressor(maxIter=trees, maxDepth=depth, seed=seed, predictionCol="predicted_margin"), train, features, [], F.avg("label"))


def predict(model: Transformer, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    out = model.transform(assembled(rows, features))
    if "probability" in out.columns:
        out = out.withColumn("prob", vector_to_array("probability")[1])
    return out.drop("features", "rawPrediction", "probability", BIN, *[BIN + f for f in features])


def evaluate_counts(rows: DataFrame, actual: str, predicted: str, baseline: str, keys: Sequence[str] = ()) -> DataFrame:
    """n, mae, rmse, baseline mae and the gain over it in percent."""
    e, b = F.col(actual) - F.col(predicted), F.abs(F.col(actual) - F.col(baseline))
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(b).alias("baseline_mae"))
    return out.withColumn("gain_pct", 100 * (1 - F.col("mae") / F.col("baseline_mae")))


def evaluate_winner(rows: DataFrame, prob: str, label: str) -> DataFrame:
    """n, auc, log loss, accuracy. Probabilities are counted to 6 places for the AUC."""
    p = F.greatest(F.least(F.col(prob), F.lit(1 - 1e-12)), F.lit(1e-12))
    loss = -(F.col(label) * F.log(p) + (1 - F.col(label)) * F.log(1 - p))
    one = rows.agg(F.avg(loss).alias("log_loss"), F.avg(((F.col(prob) >= 0.5).cast("double") == F.col(label)).cast("double")).alias("accuracy"))
    area = auc(rows.withColumn("_k", F.lit(1)).withColumn("_q", F.round(prob, 6)), ["_k"], "_q", label).select("n", "auc")
    return area.join(F.broadcast(one))


def out_of_fold(rows: DataFrame, features: Sequence[str], date: str, folds: int = 5) -> DataFrame:
    """Predictions of each later fold from a model on the folds before it; folds are quantiles of the day.

    The rows are written once: a fit reads them in each of its rounds, and would compute what built them each time.
    """
    rows = written(rows)
    day = F.unix_date(F.col(date).cast("date"))
    edges = rows.agg(F.percentile(day, F.array(*[F.lit(i / folds) for i in range(1, folds)])).alias("_e"))
    marked = rows.join(F.broadcast(edges)).withColumn("fold", F.size(F.filter("_e", lambda e: day > e))).drop("_e")
    out = None
    for k in range(1, folds):
        got = predict(fit_counts(marked.where(F.col("fold") < k), features), marked.where(F.col("fold") == k), features)
        out = got if out is None else out.unionByName(got)
    return out


#: Bounds of a calibrated probability, the fewest points of a map, where it is looked at, the least range, and when a high end counts as pinned by too few points.
LOWEST, HIGHEST, LEAST_POINTS, LEAST_RANGE = 0.01, 0.99, 400, 0.15
LOOKED_AT, PINNED, TAIL_FROM, LEAST_TAIL = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9), 0.97, 0.85, 300


def degenerate(edges: Sequence[float], values: Sequence[float], points: int, tail: int) -> bool:
    """Whether an isotonic map is no use: too few points, nearly flat, or pinned to the top by a sparse tail."""
    at = np.clip(np.interp(LOOKED_AT, edges, values), LOWEST, HIGHEST)
    return points < LEAST_POINTS or at[-1] - at[0] < LEAST_RANGE or (at.max() >= PINNED and tail < LEAST_TAIL)


def calibrate_lines(predicted: DataFrame, lines: Sequence[float], actual: str) -> tuple[Transformer | None, DataFrame]:
    """An isotonic map from P(X > line) to the hit rate over all lines pooled, None if it is degenerate; and the pooled rows."""
    rows = predicted.withColumn("line", F.explode(F.array(*map(F.lit, lines)))).withColumn("p", poisson_over(F.col("line"), F.col("predicted_mean"))).withColumn("label", (F.col(actual) > F.col("line")).cast("double"))
    rows = written(rows)  # counted, fitted and given back
    points, tail = rows.agg(F.count("*"), F.count_if(F.col("p") >= TAIL_FROM)).first()
    if points < LEAST_POINTS:
        return None, rows
    model = IsotonicRegression(labelCol="label", featuresCol="p", predictionCol="calibrated").fit(rows.select("p", "label"))
    return (None if degenerate(model.boundaries.toArray(), model.predictions.toArray(), points, tail) else model), rows  # the map's few steps


def calibrated(model: Transformer | None, rows: DataFrame) -> DataFrame:
    """Rows with `calibrated`, within the bounds; `p` itself without a map."""
    if model is None:
        return rows.withColumn("calibrated", F.col("p"))
    return model.transform(rows).withColumn("calibrated", F.greatest(F.least("calibrated", F.lit(HIGHEST)), F.lit(LOWEST)))


def compare(rows: DataFrame, actual: str, a: str, b: str, domain: Column, gate: float = 0.5) -> DataFrame:
    """MAE of two predictions on the same rows, and whether b improves it by `gate` percent or more."""
    out = rows.where(domain & F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.count("*").alias("n"), F.avg(F.abs(F.col(actual) - F.col(a))).alias("mae_a"), F.avg(F.abs(F.col(actual) - F.col(b))).alias("mae_b"))
    gain = 100 * (F.col("mae_a") - F.col("mae_b")) / F.col("mae_a")
    return out.withColumn("gain_pct", gain).withColumn("promote", F.coalesce(gain >= gate, F.lit(False)))


def ensemble_weight(rows: DataFrame, actual: str, a: str, b: str, steps: int = 20) -> DataFrame:
    """The weight on a (rest on b) with the least MAE; all weights in one aggregation. Ties go to the smaller weight."""
    points = [i / steps for i in range(steps + 1)]
    got = rows.agg(*[F.avg(F.abs(F.col(actual) - (w * F.col(a) + (1 - w) * F.col(b)))).alias(f"_m{i}") for i, w in enumerate(points)])
    best = F.array_min(F.array(*[F.struct(F.round(F.col(f"_m{i}"), 9).alias("mae"), F.lit(w).alias("weight")) for i, w in enumerate(points)]))
    return got.select(best.alias("_b")).select("_b.weight", "_b.mae")
