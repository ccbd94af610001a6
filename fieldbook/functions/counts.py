"""Count distributions.

Poisson and negative binomial tails as Spark expressions (each term follows from the one before), and, for
what has no closed recursion, small numpy helpers behind Arrow functions.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

MOST = 250.0


def poisson_over(line: Column, mean: Column) -> Column:
    """P(X > line) for a Poisson count; null where an input is null, 0 for a mean of 0 or less."""
    k = F.floor(line).cast("int")
    start = F.struct(F.exp(-mean).alias("term"), F.exp(-mean).alias("sum"))
    terms = F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
    below = F.aggregate(terms, start, lambda s, i: F.struct((s["term"] * mean / i).alias("term"), (s["sum"] + s["term"] * mean / i).alias("sum")), lambda s: s["sum"])
    return F.when(line.isNull() | mean.isNull(), None).when(mean <= 0, F.when(line < 0, 1.0).otherwise(0.0)).when(k < 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - below))


def count_over(line: Column, mean: Column, dispersion: Column) -> Column:
    """P(X > line) for a negative binomial count of variance dispersion * mean; Poisson where that is 1 or less, or null."""
    phi = F.when(dispersion > 1, dispersion)
    r = mean / (phi - 1)
    q = (phi - 1) / phi
    k = F.floor(line).cast("int")
    first = F.exp(-r * F.log(phi))
    terms = F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
    start = F.struct(first.alias("term"), first.alias("sum"))

    def step(s: Column, i: Column) -> Column:
        term = s["term"] * (i - 1 + r) / i * q
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    tail = F.when(k < 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.aggregate(terms, start, step, lambda s: s["sum"])))
    return F.when(phi.isNull() | (mean <= 0), poisson_over(line, mean)).otherwise(tail)


def binary_over(line: Column, p: Column) -> Column:
    """P(X > line) from the probability of at least one: p below 1, else Poisson with the mean that p implies."""
    return F.when(line < 1, p).otherwise(poisson_over(line, -F.log(1 - p + 1e-9)))


@F.pandas_udf(DoubleType())
def halved(line: pd.Series, prob: pd.Series) -> pd.Series:
    """60 halvings of [0.01, 250] for a whole batch at once; the tail is summed as in `poisson_over`."""
    k, p = np.floor(line.to_numpy(float)), prob.to_numpy(float)
    low, high = np.full(len(k), 0.01), np.full(len(k), MOST)
    top = int(min(np.nanmax(k, initial=0), 10 * MOST))  # beyond it nothing is left to add
    for _ in range(60):
        mid = (low + high) / 2
        term = np.exp(-mid)
        below = np.where(k >= 0, term, 0.0)
        for i in range(1, top + 1):
            term = term * mid / i
            below = below + np.where(i <= k, term, 0.0)
        up = np.maximum(0.0, 1 - below) < p
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    return pd.Series((low + high) / 2)


def implied_mean(line: Column, prob: Column) -> Column:
    """The Poisson mean in [0.01, 250] for which P(X > line) is prob; null for prob outside (0, 1). Apply it to distinct pairs."""
    good = (prob > 0) & (prob < 1) & line.isNotNull()
    return F.when(good, halved(F.when(good, line.cast("double")), F.when(good, prob.cast("double"))))


@F.pandas_udf(DoubleType())
def poisson_quantile(q: pd.Series, mean: pd.Series) -> pd.Series:
    """The least count k with P(X <= k) >= q; null where an input is null or the mean is negative."""
    x, m = q.to_numpy(float), mean.to_numpy(float)
    ok = (m >= 0) & (x >= 0) & (x < 1)
    out = np.full(len(x), np.nan)
    term, total, k = np.exp(-np.where(ok, m, 0.0)), np.zeros(len(x)), 0
    open_ = ok.copy()
    while open_.any():
        total = total + term
        hit = open_ & (total >= x - 1e-12)
        out[hit] = k
        open_ &= ~hit
        k += 1
        term = term * m / k
        if k > 10 * MOST:
            break
    return pd.Series(out).astype("Float64").mask(np.isnan(out))


def normal_quantiles(p: np.ndarray) -> np.ndarray:
    return np.array([NormalDist().inv_cdf(float(x)) for x in p])
