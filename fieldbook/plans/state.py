"""Feature state that advances by a day's rows: each entity's last games and season sums, stored, so no day reads the history.

The state of an entity is a ring of its last `size` rows (order and values) and its season's count and sums. New rows take
their features from the state as it was, and from earlier new rows; the state then moves on. Entities are dealt into
buckets by a hash; a day rewrites the buckets of the entities that played.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fieldbook.operators.windows import prior_means
from fieldbook.session import saved
from fieldbook.sources.store import in_partitions, stored
from fieldbook.sources.tables import write_slice

RING = 20


class FeatureState:
    """State at `path` for rows of (entity, season, order columns, stats). Order is total within an entity and never goes back from one step to the next."""

    def __init__(self, path: str, entity: str, season: str, order: Sequence[str], stats: Sequence[str], sizes: Sequence[int] = (5, 10, 20), buckets: int = 64):
        self.path, self.entity, self.season, self.order, self.stats, self.sizes, self.buckets = path, entity, season, list(order), list(stats), tuple(sizes), buckets
        self.size = max(sizes)

    def _empty(self, rows: DataFrame) -> DataFrame:
        return self._packed(rows.limit(0).withColumn("_bucket", F.lit(0)), None)

    def _packed(self, rows: DataFrame, old: DataFrame | None) -> DataFrame:
        """The state after rows (of this season and others) that hold the old ring's rows as well, marked by `_held`."""
        mark = F.col("_held") if old is not None else F.lit(False)
        item = F.struct(*self.order, *[F.col(s).cast("double").alias(s) for s in self.stats])
        down = F.row_number().over(W.partitionBy(self.entity).orderBy(*[F.desc(c) for c in self.order]))
        rows = rows.withColumns({"_r": down, "_season": F.last(self.season).over(W.partitionBy(self.entity).orderBy(*self.order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})
        now = ~mark & F.col(self.season).eqNullSafe(F.col("_season"))
        out = rows.groupBy(self.entity).agg(
            F.first("_bucket").alias("_bucket"), F.first("_season").alias("_season"), F.array_sort(F.collect_list(F.when(F.col("_r") <= self.size, item))).alias("_ring"), F.count_if(now).alias("_n"), *[F.coalesce(F.sum(F.when(now, F.col(s).cast("double"))), F.lit(0.0)).alias(f"_sum_{s}") for s in self.stats]
        )
        if old is None:
            return out
        before = old.select(self.entity, F.col("_season").alias("_was"), F.col("_n").alias("_n0"), *[F.col(f"_sum_{s}").alias(f"_old_{s}") for s in self.stats])
        same = F.col("_was").eqNullSafe(F.col("_season")) & F.col("_n0").isNotNull()
        out = out.join(before, self.entity, "left")
        add = lambda new, was: F.col(new) + F.when(same, F.col(was)).otherwise(0)
        return out.select(self.entity, "_bucket", "_season", "_ring", add("_n", "_n0").alias("_n"), *[add(f"_sum_{s}", f"_old_{s}").alias(f"_sum_{s}") for s in self.stats])

    def advance(self, new: DataFrame) -> DataFrame:
        """Features of the new rows (last_{n}_avg_*, season_avg_*, games_played_season), after which the stored state holds them.

        Rows without an entity get no features from others and leave no state. A step that failed before its end may be run again from the
        state that it found; one that ended may not, as its rows would count twice.
        """
        new = saved(new.withColumn("_bucket", F.pmod(F.xxhash64(self.entity), F.lit(self.buckets)).cast("int")))
        known = new.where(F.col(self.entity).isNotNull())
        schema = self._empty(known).schema
        state = stored(new.sparkSession, self.path, schema)
        old = (known.sparkSession.createDataFrame([], schema) if state is None else in_partitions(state, known.select("_bucket").distinct(), ["_bucket"]).select(*[f.name for f in schema]))
        old = saved(old)  # its files are about to be replaced
        mine = old.join(known.select(self.entity).distinct(), self.entity, "left_semi")
        ring = mine.select(self.entity, "_bucket", F.col("_season").alias(self.season), F.explode("_ring").alias("_x")).select(self.entity, "_bucket", self.season, "_x.*", F.lit(True).alias("_held"))
        both = saved(known.withColumn("_held", F.lit(False)).unionByName(ring, allowMissingColumns=True))
        out = prior_means(both, [self.entity], self.order, self.stats, self.sizes).where(~F.col("_held"))
        sums = mine.select(self.entity, F.col("_season").alias("_was"), F.col("_n").alias("_n0"), *[F.col(f"_sum_{s}").alias(f"_old_{s}") for s in self.stats])
        before = W.partitionBy(self.entity, self.season).orderBy(*self.order).rowsBetween(W.unboundedPreceding, -1)
        same = F.col("_was").eqNullSafe(F.col(self.season)) & F.col("_n0").isNotNull()
        out = out.join(sums, self.entity, "left").withColumn("_seen", F.when(same, F.col("_n0")).otherwise(0) + F.count(F.lit(1)).over(before))
        means = {f"season_avg_{s}": F.when(F.col("_seen") > 0, (F.when(same, F.col(f"_old_{s}")).otherwise(0.0) + F.coalesce(F.sum(F.col(s).cast("double")).over(before), F.lit(0.0))) / F.col("_seen")).otherwise(0.0) for s in self.stats}
        names = [f"last_{n}_avg_{s}" for n in self.sizes for s in self.stats]
        out = saved(out.withColumns(means).select(*[c for c in new.columns if c != "_bucket"], *names, *means, F.col("_seen").cast("bigint").alias("games_played_season")))
        moved = self._packed(both, mine)
        rest = old.join(moved.select(self.entity), self.entity, "left_anti")
        write_slice(rest.select(*moved.columns).unionByName(moved), self.path, ["_bucket"])
        return out
