"""Gradient-boosted counts: trees on the Poisson deviance, grown from histograms that Spark aggregates.

Features become bins by quantiles. A tree grows level by level; one aggregation by (node, feature, bin) gives each level's
sums of residuals and of fitted means, from which the driver picks the splits: so many rows at most come to it as
nodes x features x bins. A leaf's step is in log space: sum of residuals over sum of fitted means (a Newton step).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.session import saved

#: The learning rate and how far a leaf may move a log mean in one step.
RATE, MOST_STEP = 0.1, 0.7
#: Scores are written out each so many trees, and a validation set is looked at.
BLOCK = 5


@dataclass(frozen=True)
class Node:
    """A split (feature number, last bin that goes left, gain) with two children, or a leaf's value."""

    feature: int = -1
    bin: int = 0
    left: Node | None = None
    right: Node | None = None
    value: float = 0.0


@dataclass(frozen=True)
class Booster:
    """log mean = base + rate * sum of trees; `edges` are the upper bounds of each feature's bins but the last."""

    features: Sequence[str]
    edges: Sequence[Sequence[float]]
    base: float
    trees: list[Node] = field(default_factory=list)
    rate: float = RATE

    def tree(self, node: Node, test) -> Column:
        """The tree's value as nested conditions; test(feature, bin) is the condition to go left."""
        if node.left is None:
            return F.lit(node.value)
        return F.when(test(node.feature, node.bin), self.tree(node.left, test)).otherwise(self.tree(node.right, test))

    def log_mean(self, trees: Sequence[Node] | None = None) -> Column:
        raw = lambda f, b: F.coalesce(F.nanvl(F.col(self.features[f]).cast("double"), F.lit(0.0)), F.lit(0.0)) <= self.edges[f][b]
        return sum((self.rate * self.tree(t, raw) for t in (self.trees if trees is None else trees)), F.lit(self.base))

    def predict(self, rows: DataFrame, name: str = "predicted_mean") -> DataFrame:
        return rows.withColumn(name, F.exp(self.log_mean()))


def bin_edges(rows: DataFrame, features: Sequence[str], bins: int, error: float = 1e-3) -> list[list[float]]:
    """Distinct quantiles of each feature, to a rank error of `error`; nulls and NaN count as 0."""
    clean = rows.select(*[F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f) for f in features])
    got = clean.approxQuantile(list(features), [i / bins for i in range(1, bins)], error)
    return [sorted(set(q)) for q in got]


def split(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, int, int]:
    """(gain, feature, bin) of the best split from sums by feature and bin; gain 0 without one. Ties go to the first feature and bin."""
    gl, hl = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
    gt, ht = g[0].sum(), h[0].sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = gl**2 / hl + (gt - gl) ** 2 / (ht - hl) - gt**2 / ht
    gain = np.where((hl >= least) & (ht - hl >= least), np.round(gain, 9), 0.0)
    if not gain.size:
        return 0.0, 0, 0
    at = int(gain.argmax())
    return float(gain.ravel()[at]), *divmod(at, gain.shape[1])


def leaf(g: float, h: float) -> Node:
    return Node(value=float(np.clip(g / h, -MOST_STEP, MOST_STEP)) if h > 0 else 0.0)


def grow(sums, depth: int, least: float) -> Node:
    """A tree; sums(open, found) gives the arrays g and h (features x bins) of each open node, named by its path of 0 (left) and 1."""
    found: dict[str, tuple[int, int]] = {}
    total: dict[str, tuple[float, float]] = {}
    open_ = [""]
    for _ in range(depth):
        following = []
        for path, (g, h) in sums(open_, found).items():
            total.setdefault(path, (float(g[0].sum()), float(h[0].sum())))
            gain, feature, b = split(g, h, least)
            if gain > 0:
                found[path] = feature, b
                gl, hl = float(g[feature, : b + 1].sum()), float(h[feature, : b + 1].sum())
                total[path + "0"], total[path + "1"] = (gl, hl), (total[path][0] - gl, total[path][1] - hl)
                following += [path + "0", path + "1"]
        open_ = following
        if not open_:
            break

    def made(path: str) -> Node:
        if path not in found:
            return leaf(*total[path])
        return Node(*found[path], made(path + "0"), made(path + "1"))

    return made("")


def deviance(rows: DataFrame, label: str, log_mean: Column, weight: Column) -> float:
    """Mean Poisson deviance of rows whose log mean is given."""
    y = F.col(label)
    part = F.when(y > 0, y * (F.log(y) - log_mean)).otherwise(0.0) - y + F.exp(log_mean)
    got = rows.agg(F.sum(2 * weight * part), F.sum(weight)).first()
    return got[0] / got[1] if got[1] else 0.0


def fit_boosted(train: DataFrame, features: Sequence[str], label: str = "label", weight: str | None = None, trees: int = 50, depth: int = 3, bins: int = 32, least: float = 20.0, valid: DataFrame | None = None, patience: int = 2, rate: float = RATE) -> Booster:
    """A booster of counts. `least` is the sum of fitted means that a leaf needs. With `valid`, growing stops when `patience` blocks
    of trees bring no lower deviance there, and the trees up to the best block are kept. Rows without a label don't count; no rows give a mean of 1.
    """
    train = train.where(F.col(label).isNotNull())
    edges = bin_edges(train, features, bins)
    n_bins = max((len(e) for e in edges), default=0) + 1
    value = lambda f: F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0))
    binned = F.array(*[F.coalesce(F.array_position(F.array(*[value(f) <= x for x in e]), True).cast("int") - 1, F.lit(-1)) if e else F.lit(0) for f, e in zip(features, edges, strict=True)])
    # array_position gives 0 where no edge is high enough: the last bin
    binned = F.transform(binned, lambda b: F.when(b < 0, n_bins - 1).otherwise(b))
    rows = saved(train.select(binned.alias("_b"), F.col(label).cast("double").alias("_y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w")))
    sums = rows.agg(F.sum(F.col("_w") * F.col("_y")), F.sum("_w")).first()
    model = Booster(features, edges, float(np.log(max(sums[0] / sums[1], 1e-9))) if sums[1] else 0.0, [], rate)
    rows = rows.withColumn("_s", F.lit(model.base))
    test = lambda f, b: F.col("_b")[f] <= b
    best, best_n, bad = np.inf, 0, 0
    for n in range(1, trees + 1):
        mean = F.exp("_s")
        scored = rows.withColumns({"_g": F.col("_w") * (F.col("_y") - mean), "_h": F.col("_w") * mean})

        def level(open_: list[str], found: dict[str, tuple[int, int]], scored=scored) -> dict:
            def place(path: str) -> Column:
                if path in found:
                    f, b = found[path]
                    return F.when(test(f, b), place(path + "0")).otherwise(place(path + "1"))
                return F.lit(path if path in open_ else None).cast("string")

            long = scored.select(place("").alias("_at"), "_g", "_h", F.posexplode("_b").alias("_f", "_bin")).where("_at is not null")
            out = {p: (np.zeros((len(features), n_bins)), np.zeros((len(features), n_bins))) for p in open_}
            for r in long.groupBy("_at", "_f", "_bin").agg(F.sum("_g").alias("g"), F.sum("_h").alias("h")).collect():
                g, h = out[r["_at"]]
                g[r["_f"], r["_bin"]], h[r["_f"], r["_bin"]] = r["g"], r["h"]
            return out

        tree = grow(level, depth, least)
        model.trees.append(tree)
        rows = rows.withColumn("_s", F.col("_s") + rate * model.tree(tree, test))
        if n % BLOCK == 0 or n == trees:
            rows = saved(rows)
            if valid is not None:
                score = deviance(valid.where(F.col(label).isNotNull()), label, model.log_mean(), F.lit(1.0))
                best, best_n, bad = (score, n, 0) if score < best - 1e-12 else (best, best_n, bad + 1)
                if bad >= patience:
                    break
    if valid is not None:
        del model.trees[best_n:]
    return model
