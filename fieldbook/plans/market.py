"""Prices against sharp lines, boosts, and parlays."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fieldbook.functions.counts import implied_mean, normal_quantiles, poisson_over
from fieldbook.functions.scalars import BREAKEVEN, american_decimal, clip, joint_legs
from fieldbook.operators.joins import main_line
from fieldbook.operators.windows import top_per_key
from fieldbook.session import saved, written

#: Measured correlations of two legs: of one player's pairs of stats, of a stat and a combined one that holds it, of other pairs of one player, of teammates in a game.
PAIR_RHO = {("hits", "total_bases"): 0.72, ("total_bases", "rbis"): 0.48, ("hits", "runs"): 0.38, ("points", "rebounds"): 0.34, ("rebounds", "assists"): 0.27, ("points", "assists"): 0.26}
COMBOS = {
    "pts_rebs_asts": ("points", "rebounds", "assists"),
    "pts_rebs": ("points", "rebounds"),
    "pts_asts": ("points", "assists"),
    "rebs_asts": ("rebounds", "assists"),
    "blocks_steals": ("blocks", "steals"),
    "hits_runs_rbis": ("hits", "runs", "rbis"),
}
RHO_COMBO, RHO_PLAYER, RHO_TEAM = 0.60, 0.20, 0.04
#: What a parlay of so many legs pays, the least edge of a leg, and the number of legs that a slate considers.
MULTIPLIERS, LEAST_EDGE, CANDIDATES = {2: 3.0, 3: 5.0, 4: 10.0}, 0.06, 16

#: Fixed value: minutes that must be left to a game's start for an offer to count.
BEFORE_START = 30


def with_mean(anchors: DataFrame, line: str, prob: str) -> DataFrame:
    """`mean` that the anchor implies; the inverse runs on distinct (line, prob) pairs only, which are few bytes but much work: adaptive execution would leave them to one task."""
    pairs = anchors.select(line, prob).distinct().repartition(4 * anchors.sparkSession.sparkContext.defaultParallelism)
    return anchors.join(pairs.withColumn("mean", implied_mean(F.col(line), F.col(prob))), [line, prob])


def soft_lines(board: DataFrame, sharp: DataFrame, keys: Sequence[str], line: str, least: float = BREAKEVEN) -> DataFrame:
    """Offered lines re-priced from the sharp main line: p_over, better side, its probability and the edge over break-even."""
    anchor = with_mean(written(main_line(sharp, keys, line, "over_prob")), "main_line", "main_prob")  # read twice
    rows = board.join(anchor, list(keys)).withColumn("p_over", poisson_over(F.col(line), F.col("mean")))
    side = F.when(F.col("p_over") >= 0.5, "over").otherwise("under")
    best = F.greatest(F.col("p_over"), 1 - F.col("p_over"))
    return rows.withColumns({"side": side, "prob": best}).withColumn("edge", F.col("prob") - least).where("edge > 0")


def arbitrage(board: DataFrame, sharp: DataFrame, keys: Sequence[str], line: str, over: str, under: str, low: float = 0.02, high: float = 0.40, start: Column | None = None, now: Column | None = None) -> DataFrame:
    """Better side (ties go over) of each offer by expected value, kept within (low, high); with `start` and `now` only offers of games that start later than BEFORE_START minutes from now."""
    if start is not None:
        board = board.where(start > now + F.make_dt_interval(mins=F.lit(BEFORE_START)))
    anchor = with_mean(written(main_line(sharp, keys, line, "over_prob")), "main_line", "main_prob")  # read twice
    rows = board.join(anchor, list(keys)).withColumn("p_over", poisson_over(F.col(line), F.col("mean")))
    a, b = F.col("p_over") * F.col(over) - 1, (1 - F.col("p_over")) * F.col(under) - 1
    rows = rows.withColumns({"side": F.when(F.coalesce(a, F.lit(-9.0)) >= F.coalesce(b, F.lit(-9.0)), "over").otherwise("under"), "ev": F.greatest(a, b)})
    return rows.where((F.col("ev") > low) & (F.col("ev") < high))


def boost_ev(boosts: DataFrame, sharp: DataFrame, keys: Sequence[str], line: str, low: float = 0.2, high: float = 0.8) -> DataFrame:
    """fair_prob and ev of each boost, or a note why it can't be priced; a note that a person typed (`typed_note`) stays.

    Run it again on a day's stored boosts to price them against the market of the moment.
    """
    anchor = written(main_line(sharp, keys, line, "over_prob", 0.0, 1.0))  # read three times
    inside = (F.col("main_prob") >= low) & (F.col("main_prob") <= high)
    priced = with_mean(anchor.where(inside), "main_line", "main_prob").select(*keys, "mean")
    rows = boosts.join(anchor, list(keys), "left").join(priced, list(keys), "left")
    over = poisson_over(F.col(line), F.col("mean"))
    p = F.when(F.col("side") == "over", over).when(F.col("side") == "under", 1 - over)
    why = F.when(F.col("odds").isNull() | (F.col("odds") == 0), "no odds").when(~F.coalesce(F.col("side").isin("over", "under"), F.lit(False)), "no side").when(F.col("main_prob").isNull(), "no sharp line").when(~inside, "sharp anchor unreliable").when(F.col("mean").isNull(), "no mean")
    typed = F.when(F.col("typed_note") != "", F.col("typed_note")) if "typed_note" in boosts.columns else F.lit(None).cast("string")
    rows = rows.withColumn("fair_prob", F.when(why.isNull(), p)).withColumn("ev", F.when(why.isNull(), p * american_decimal(F.col("odds")) - 1))
    return rows.withColumn("note", F.coalesce(typed, why))


def graded_roi(bets: DataFrame, keys: Sequence[str], actual: str, line: str, side: str, payout: str, push_as_under: bool = False) -> DataFrame:
    """n and mean profit of bets against actual values; a push pays 0, or as a win for under in the stored form."""
    over = F.col(actual) > F.col(line)
    push = F.col(actual) == F.col(line)
    won = F.when(F.col(side) == "over", over).otherwise(F.col(actual) <= F.col(line) if push_as_under else F.col(actual) < F.col(line))
    profit = F.when(won, F.col(payout) - 1).when(push & ~F.lit(push_as_under), 0.0).otherwise(-1.0)
    return bets.where(F.col(actual).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(won).alias("wins"), F.avg(profit).alias("roi"))


def pair_table() -> dict[str, float]:
    """Correlation of one player's two stats by their names in order, "a|b"; other pairs have RHO_PLAYER."""
    combos = {(c, part): RHO_COMBO for c, parts in COMBOS.items() for part in parts}
    return {"|".join(sorted(k)): v for k, v in (combos | PAIR_RHO).items()}


def pair_rho_of(a: Column, b: Column, stats: str = "stat_type") -> Column:
    """Correlation of two legs (structs); opposite sides turn the sign.

    One player: by the pair of stats, 0 for one and the same stat. Different players: teammates in one game, else 0.
    """
    x, y = a[stats], b[stats]
    table = F.create_map(*[F.lit(v) for kv in pair_table().items() for v in kv])
    own = F.when(x == y, 0.0).otherwise(F.coalesce(F.try_element_at(table, F.concat_ws("|", F.least(x, y), F.greatest(x, y))), F.lit(RHO_PLAYER)))
    team = (a["game_id"] == b["game_id"]) & (a["team_id"] == b["team_id"])
    size = F.when(a["player_id"] == b["player_id"], own).when(team, RHO_TEAM).otherwise(0.0)
    return F.when(a["direction"] == b["direction"], size).otherwise(0.0 - size)


def pair_rho(a: str, b: str, stats: str = "stat_type") -> Column:
    """The same of the structs in columns a and b."""
    return pair_rho_of(F.col(a), F.col(b), stats)


def candidates(legs: DataFrame, slate: str, top: int = CANDIDATES, least_edge: float = LEAST_EDGE) -> DataFrame:
    """Each slate's `top` legs by edge, numbered by `_i`: one for each player, stat and side, and only those of `least_edge` if there are two."""
    order = [F.desc("edge"), F.asc("leg_id")]
    best = legs.withColumn("_r", F.row_number().over(W.partitionBy(slate, "player_id", "stat_type", "direction").orderBy(*order))).where("_r = 1")
    strong = F.count_if(F.col("edge") >= least_edge).over(W.partitionBy(slate))
    ranked = best.withColumn("_strong", strong).where((F.col("_strong") < 2) | (F.col("edge") >= least_edge))
    return ranked.withColumn("_i", F.row_number().over(W.partitionBy(slate).orderBy(*order))).where(F.col("_i") <= top).drop("_r", "_strong")


def slates_of(legs: DataFrame, slate: str, top: int = CANDIDATES) -> DataFrame:
    """A row for each slate: its candidates in one array `_legs`, their number `_n` and the correlations of all pairs `_rho` (flat row-major)."""
    one = candidates(legs, slate, top).select(slate, F.struct("_i", "leg_id", "player_id", "team_id", "game_id", "stat_type", "direction", "model_prob").alias("leg"))
    pairs = F.flatten(F.transform("_legs", lambda a: F.transform("_legs", lambda b: pair_rho_of(a, b) + F.lit(0.0))))
    return one.groupBy(slate).agg(F.array_sort(F.collect_list("leg")).alias("_legs")).withColumn("_n", F.size("_legs")).withColumn("_rho", pairs)


def combined(slates: DataFrame, sizes: Sequence[int], top: int = CANDIDATES) -> DataFrame:
    """The slates' rows once for each combination of candidates: size, the legs' places `_at`, their ids `legs`, joint, ev.

    The combinations of places come from a constant table, so no leg is joined with another.
    """
    out = None
    for k in sizes:
        places = F.array(*[F.array(*map(F.lit, c)) for c in combinations(range(top), k)])
        rows = slates.withColumn("_at", F.explode(places)).where(F.col("_at")[k - 1] < F.col("_n"))
        rho = {(i, j): F.col("_rho")[F.col("_at")[i] * F.col("_n") + F.col("_at")[j]] for i in range(k) for j in range(i + 1, k)}
        joint = joint_legs([F.col("_legs")[F.col("_at")[i]]["model_prob"] for i in range(k)], rho)
        got = rows.withColumns({"size": F.lit(k), "legs": F.transform("_at", lambda i: F.col("_legs")[i]["leg_id"]), "joint": joint}).withColumn("ev", MULTIPLIERS[k] * F.col("joint") - 1)
        out = got if out is None else out.unionByName(got)
    return out


def spelled(combos: DataFrame, slate: str) -> DataFrame:
    """Combinations with the probs and the rho of their legs (flat row-major) instead of places."""
    each = lambda f: F.transform("_at", f)
    rho = F.flatten(each(lambda i: each(lambda j: F.when(i == j, 1.0).otherwise(F.col("_rho")[F.least(i, j) * F.col("_n") + F.greatest(i, j)]))))
    return combos.select(slate, "size", "legs", "joint", "ev", each(lambda i: F.col("_legs")[i]["model_prob"]).alias("probs"), rho.alias("rho"))


def parlays(legs: DataFrame, slate: str, sizes: Sequence[int] = (2, 3, 4), top: int = CANDIDATES) -> DataFrame:
    """All combinations of each slate's candidates: legs (ids), size, joint, ev, probs and rho (flat row-major); C(16,2) + C(16,3) + C(16,4) = 2,500 of a slate at most."""
    return spelled(combined(slates_of(legs, slate, top), sizes, top), slate)


def top_parlays(legs: DataFrame, slate: str, n: int = 10, sizes: Sequence[int] = (2, 3, 4), top: int = CANDIDATES) -> DataFrame:
    """The n combinations of each slate with the highest expected value, ties by their legs, as `parlays` has them; only those meet their slate's arrays again."""
    slates = saved(slates_of(legs, slate, top))
    best = top_per_key(combined(slates, sizes, top).select(slate, "size", "_at", "legs", "joint", "ev"), [slate], [F.desc(F.round("ev", 9)), F.asc("legs")], n)
    return spelled(best.join(slates, slate), slate)


def diversified(legs: DataFrame, slate: str, k: int) -> DataFrame:
    """The best leg of each player, of those the best of each game and direction, of those the top k of the slate."""
    order = [F.desc("model_prob"), F.asc("leg_id")]
    out = legs
    for keys in ([slate, "player_id"], [slate, "game_id", "direction"]):
        out = out.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
    return out.withColumn("rank", F.row_number().over(W.partitionBy(slate).orderBy(*order))).where(F.col("rank") <= k)


def slate_plan(combos: DataFrame, slate: str, penalty: float = 0.04, sizes: Sequence[int] = (4, 3, 2)) -> DataFrame:
    """One combination of each size, largest first; each leg used before costs `penalty` of the score."""
    used = combos.select(slate).distinct().withColumn("_used", F.array().cast(combos.schema["legs"].dataType))
    out = None
    for size in sizes:
        rows = combos.where(F.col("size") == size).join(used, slate).withColumn("score", F.col("ev") - penalty * F.size(F.array_intersect("legs", "_used")))
        best = rows.groupBy(slate).agg(F.max_by(F.struct("size", "legs", "joint", "ev", "score", "_used"), F.struct("score", F.transform("legs", lambda x: -x))).alias("_b")).select(slate, "_b.*")
        used = used.join(best.select(slate, F.col("legs").alias("_new")), slate, "left").select(slate, F.array_union("_used", F.coalesce("_new", "_used")).alias("_used"))
        got = best.select(slate, "size", "legs", "joint", "ev", "score")
        out = got if out is None else out.unionByName(got)
    return out


@lru_cache(8)
def normals(draws: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((draws, n))


def copula_root(rho: np.ndarray) -> np.ndarray:
    """The Cholesky factor of the correlations, of their nearest positive matrix if they aren't one."""
    values, vectors = np.linalg.eigh(rho)
    near = (vectors * np.maximum(values, 1e-6)) @ vectors.T
    scale = np.sqrt(np.diag(near))
    return np.linalg.cholesky(near / np.outer(scale, scale))


@lru_cache(4096)
def copula_rows(rho: tuple[float, ...]) -> tuple[tuple[float, ...], ...]:
    n = round(len(rho) ** 0.5)
    return tuple(tuple(r) for r in np.round(copula_root(np.array(rho).reshape(n, n)), 12).tolist())


@lru_cache(8192)
def leg_hits(row: tuple[float, ...], prob: float, draws: int, seed: int) -> np.ndarray:
    """In which draws a leg hits, as packed bits (5 KB for 40,000 draws); row: its line of the Cholesky factor."""
    limit = normal_quantiles(np.clip([prob], 1e-12, 1 - 1e-12))[0]
    return np.packbits(normals(draws, len(row), seed) @ np.array(row) < limit)


def copula_joint(probs: Sequence[float], rho: Sequence[float], draws: int = 40_000, seed: int = 42) -> float:
    """Joint probability of correlated legs (rho flat row-major) under a Gaussian copula.

    Few lines of Cholesky factors and few probabilities make up all combinations, so each leg's hits are kept.
    """
    hits = [leg_hits(r, float(p), draws, seed) for r, p in zip(copula_rows(tuple(map(float, rho))), probs, strict=True)]
    return int(np.bitwise_count(np.bitwise_and.reduce(hits)).sum()) / draws


def copula_parlays(combos: DataFrame, slate: str) -> DataFrame:
    """mc_joint of each combination; combos: slate, combo_id, probs (array), rho (flat row-major array).

    The product where no two legs are correlated, else from seeded draws; equal (probs, rho) are drawn once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [copula_joint(p, r) for p, r in zip(pdf["probs"], pdf["rho"], strict=True)]
            yield pdf.assign(drawn=got)

    n = int(combos.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    linked = F.exists("rho", lambda r: (r != 0) & (r != 1))
    drawn = combos.where(linked).select("probs", "rho").distinct().repartition(n, "probs", "rho").mapInPandas(run, "probs array<double>, rho array<double>, drawn double")
    product = F.aggregate("probs", F.lit(1.0), lambda a, p: a * p)
    return combos.join(drawn, ["probs", "rho"], "left").select(slate, "combo_id", clip(F.coalesce("drawn", product), 0.01, 0.99).alias("mc_joint"))


def on_simplex(f: np.ndarray, cap: float, most: float) -> np.ndarray:
    """The nearest stakes within 0 and `cap` that sum to `most` at most."""
    out = np.clip(f, 0, cap)
    if out.sum() <= most:
        return out
    low, high = 0.0, float(f.max())
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if np.clip(f - mid, 0, cap).sum() > most else (low, mid)
    return np.clip(f - high, 0, cap)


def kelly_stakes(probs: np.ndarray, rho: np.ndarray, *, pays: float = 3.0, cap: float = 0.10, most: float = 1.0, share: float = 0.5, draws: int = 20_000, seed: int = 42, rounds: int = 300) -> np.ndarray:
    """Stakes that maximize the mean log growth over correlated outcomes of the slate, times `share`.

    Outcomes are seeded draws of a Gaussian copula; equal ones count together. The growth is concave: projected
    gradient steps, each as long as the last one's curvature suggests and halved until the growth rises, reach its maximum.
    """
    wins = normals(draws, len(probs), seed) @ copula_root(rho).T < normal_quantiles(np.clip(probs, 1e-12, 1 - 1e-12))
    _, at, times = np.unique(np.packbits(wins, axis=1).view(np.void if len(probs) < 1 else f"V{-(-len(probs) // 8)}").ravel(), return_index=True, return_counts=True)
    gain, weight = pays * wins[at] - 1.0, times / draws
    value = lambda f: float(weight @ np.log(np.maximum(1 + gain @ f, 1e-6)))
    slope = lambda f: gain.T @ (weight / np.maximum(1 + gain @ f, 1e-6))
    half = share * np.clip((pays * probs - 1) / (pays - 1), 0, None)
    f = on_simplex(np.minimum(half, cap) * 0.9, cap, 0.9 * most)
    now, g, length = value(f), slope(f), 0.01
    for _ in range(rounds):
        if np.abs(on_simplex(f + g, cap, most) - f).max() < 1e-7:
            break
        move, scale = on_simplex(f + length * g, cap, most) - f, 1.0
        while scale > 1e-9 and (new := value(f + scale * move)) < now + 1e-4 * scale * (g @ move):
            scale /= 2
        if scale <= 1e-9:
            break
        moved = scale * move
        f, now, old = f + moved, new, g
        g = slope(f)
        bend = moved @ (old - g)
        length = min(max(moved @ moved / bend, 1e-6), 1e3) if bend > 0 else 1.0
    return f * share


def slate_kelly(legs: DataFrame, slate: str, columns: Sequence[str] = ("win",)) -> DataFrame:
    """leg_id, stake and `columns` of each slate's candidates, sized together. A slate holds CANDIDATES legs at most."""
    own = ["leg_id", "player_id", "team_id", "game_id", "stat_type", "direction", "model_prob", *columns]
    rows = candidates(legs, slate).select(slate, F.struct("_i", *own).alias("a"))
    pairs = rows.join(rows.withColumnRenamed("a", "b"), slate).withColumn("r", F.when(F.col("a._i") == F.col("b._i"), 1.0).otherwise(pair_rho("a", "b")))
    lines = pairs.groupBy(slate, "a").agg(F.array_sort(F.collect_list(F.struct("b._i", "r")))["r"].alias("r"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i", ignore_index=True)
        return pdf.assign(stake=kelly_stakes(pdf["model_prob"].to_numpy(float), np.array(pdf["r"].tolist(), float))).drop(columns=["_i", "r"])

    flat = lines.select(slate, "a._i", *[F.col(f"a.{c}").alias(c) for c in ("leg_id", "model_prob", *columns)], "r")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in flat.schema if f.name not in ("_i", "r"))
    return flat.groupBy(slate).applyInPandas(run, f"{fields}, stake double")


def compounded(staked: DataFrame, day: str, win: str, pays: float = 3.0) -> DataFrame:
    """Bankroll by day: the product of 1 + the day's return, 1e-6 at least; the window runs over days."""
    daily = staked.groupBy(day).agg(F.sum(F.col("stake") * (pays * F.col(win) - 1)).alias("day_return"))
    w = W.orderBy(day).rowsBetween(W.unboundedPreceding, 0)
    return daily.withColumn("bankroll", F.exp(F.sum(F.log(F.greatest(1 + F.col("day_return"), F.lit(1e-6)))).over(w)))


def stacks(legs: DataFrame, other: DataFrame, bonus: float = 0.06) -> DataFrame:
    """Same-game pairs of a leg and an opposing team's leg: joint = min(0.99, product + bonus)."""
    b = other.select("game_id", F.col("team_id").alias("other_team"), F.col("leg_id").alias("other_leg"), F.col("model_prob").alias("other_prob"))
    return legs.join(b, "game_id").where("team_id <> other_team").select("game_id", "leg_id", "other_leg", F.least(F.lit(0.99), F.col("model_prob") * F.col("other_prob") + bonus).alias("joint"))
