"""Approximate nearest neighbours by vantage-point trees, one for each shard.

The largest inner product becomes the nearest distance by one more coordinate: with R the longest vector's
length, a vector x gets sqrt(R^2 - |x|^2) and a query gets 0; distances then order as inner products do.

Rows are dealt into shards by a hash; each shard's tree is built once and saved. A tree halves its points by their distance to a
vantage point. A search goes down the nearer half first; by the triangle inequality the other half can only help if its distance bound is below
the distance of the k-th best point so far. The bound is multiplied by `factor`: 1 keeps the search exact,
more prunes more. In a leaf all points are compared. A tree holds each distinct vector of its shard once, with its k + 1 smallest ids beside it
(all have one score, and one may be the query itself, so further copies can't be among the k best).

There are as many shards as there are shuffle partitions, but of `LEAST` vectors or more and `SHARD` at most. Queries are packed into blocks
of at most `BLOCK`; each block goes to all shards. A task gets a shard's tree once, then its blocks one by one. Each shard's k best of a query meet in a window by query.

Scores are computed anew from the original vectors in double precision. Vectors that are null, zero, or hold a null or
non-finite component take no part, nor do rows without an id; vectors of another length than the query's
are not its candidates. Rows that share an id each count as a candidate; a repeated query id
gives the rows of its smallest vector once. An empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fieldbook.llm.common import arrow_map, partitions, saved

LEAF, SHARD, LEAST, BLOCK = 512, 50_000, 2_000, 5_000


class Tree:
    """A vantage-point tree over the rows of x; nodes hold ranges of a permutation."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF) -> None:
        self.x, self.order = x, np.arange(len(x))
        self.square = np.einsum("ij,ij->i", x, x)
        self.nodes: list[tuple] = []
        self.root = self.build(0, len(x), leaf)

    def far(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((q * q).sum(1)[:, None] + self.square[rows] - 2 * q @ self.x[rows].T, 0))

    def build(self, lo: int, hi: int, leaf: int) -> int:
        if hi - lo <= leaf:
            self.nodes.append((lo, hi))
            return len(self.nodes) - 1
        rows = self.order[lo:hi]
        d = self.far(self.x[rows[:1]], rows)[0]
        vantage = int(rows[np.argmax(d)])  # a point at the edge halves better than one in the middle
        d = self.far(self.x[[vantage]], rows)[0]
        split = np.argsort(d, kind="stable")
        self.order[lo:hi], d = rows[split], d[split]
        mid = (hi - lo) // 2
        near, away = self.build(lo, lo + mid, leaf), self.build(lo + mid, hi, leaf)
        self.nodes.append((vantage, near, away, d[mid - 1], d[mid]))
        return len(self.nodes) - 1

    def search(self, q: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and distances of the k nearest found for each query, unordered; -1 where there are fewer."""
        best, dist = np.full((len(q), k), -1), np.full((len(q), k), np.inf)

        def visit(node: int, who: np.ndarray, bound: np.ndarray) -> None:
            open_ = bound * factor <= dist[who].max(1)
            who, bound = who[open_], bound[open_]
            if not len(who):
                return
            n = self.nodes[node]
            if len(n) == 2:
                rows = self.order[n[0] : n[1]]
                d = np.c_[dist[who], self.far(q[who], rows)]
                at = np.argpartition(d, k - 1, axis=1)[:, :k] if d.shape[1] > k else np.argsort(d, axis=1)
                ids = np.c_[best[who], np.broadcast_to(rows, (len(who), len(rows)))]
                best[who], dist[who] = np.take_along_axis(ids, at, 1), np.take_along_axis(d, at, 1)
                return
            vantage, near, away, inner, outer = n
            d = self.far(q[who], np.array([vantage]))[:, 0]
            to_near, to_away = np.maximum(bound, d - inner), np.maximum(bound, outer - d)
            first = d - inner <= outer - d
            visit(near, who[first], to_near[first])
            visit(away, who[~first], to_away[~first])
            visit(away, who[first], to_away[first])
            visit(near, who[~first], to_near[~first])

        if len(self.x):
            visit(self.root, np.arange(len(q)), np.zeros(len(q)))
        return best, dist


def packed_tree(ids: np.ndarray, x: np.ndarray, top: float, k: int) -> bytes:
    """The tree over a shard's distinct vectors, with the k + 1 smallest ids of each one."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    _, first, group = np.unique(x.view([("", x.dtype)] * x.shape[1]).ravel(), return_index=True, return_inverse=True)
    by = np.argsort(group, kind="stable")  # ids rise within a group
    start = np.r_[True, np.diff(group[by]) > 0]
    nth = np.arange(len(by)) - np.maximum.accumulate(np.where(start, np.arange(len(by)), 0))
    keep = by[nth <= k]
    edges = np.r_[0, np.cumsum(np.bincount(group[keep], minlength=len(first)))]
    x = x[first]
    lift = np.sqrt(np.maximum(top - np.einsum("ij,ij->i", x, x), 0))
    return pickle.dumps((Tree(np.c_[x, lift]), ids[keep], edges), protocol=5)


def found(tree: Tree, ids: np.ndarray, edges: np.ndarray, ask: np.ndarray, q: np.ndarray, k: int, factor: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and scores of the k best in the tree for each query, best first, ties to the smaller id."""
    # a few more vectors than k, so that rounding of distances or the query itself pushes nothing out
    near, _ = tree.search(np.c_[q, np.zeros(len(q))], k + 12, factor)
    x = tree.x[:, :-1]
    for i, at in enumerate(near):
        at = at[at >= 0]
        # sums of products in numpy's fixed pairwise order: equal vectors get equal scores
        score = np.repeat((x[at] * q[i]).sum(1), edges[at + 1] - edges[at])
        own = np.concatenate([ids[edges[a] : edges[a + 1]] for a in at]) if len(at) else ids[:0]
        other = own != ask[i]
        own, score = own[other], score[other]
        best = np.lexsort((own, -score))[:k]
        yield own[best], score[best]


def nearest(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, factor: float = 1.5) -> DataFrame:
    """query_id, rank, vec_id, score of the k candidates with the largest inner products that the search finds."""

    def clean(df: DataFrame) -> DataFrame:
        v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
        ok = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(vector_col, lambda x: x != 0)
        return df.where(ok).select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"), F.size(vector_col).alias("dim"))

    rows = clean(vectors)
    asked = clean(queries).groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    n, top = rows.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    shards, top = max(1, -(-n // SHARD), min(partitions(vectors.sparkSession), n // LEAST)), top or 0.0

    def build(table: pa.Table) -> pa.Table:
        x = np.asarray(table["v"].combine_chunks().flatten(), np.float64).reshape(len(table), -1)
        return pa.table({"dim": pa.array([x.shape[1]], pa.int32()), "shard": pa.array([table["shard"][0].as_py()], pa.int32()), "tree": pa.array([packed_tree(table["id"].to_numpy(), x, top, k)], pa.binary())})

    shard = F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int")
    trees = saved(rows.withColumn("shard", shard).groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, tree binary"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: dict[int, tuple[list, list]] = {}
        full = lambda dim: {"qdim": [dim], "ids": [np.concatenate(held[dim][0]).tobytes()], "q": [b"".join(held[dim][1])]}
        for b in batches:
            dims = b.column(2).to_numpy()
            for dim in np.unique(dims):
                own = pa.array(dims == dim)
                ids, v = b.column(0).filter(own).to_numpy(zero_copy_only=False), np.asarray(b.column(1).filter(own).flatten(), np.float64).reshape(-1, dim)
                for i in range(0, len(ids), BLOCK):
                    one = held.setdefault(int(dim), ([], []))
                    one[0].append(ids[i : i + BLOCK])
                    one[1].append(v[i : i + BLOCK].tobytes())
                    if sum(map(len, one[0])) >= BLOCK:
                        yield full(int(dim))
                        del held[int(dim)]
        for dim in held:
            yield full(dim)

    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    blocks = arrow_map(asked.select("id", "v", "dim"), pack, "qdim int, ids binary, q binary").select(F.col("qdim").alias("dim"), every.alias("shard"), F.lit(None).cast("binary").alias("tree"), "ids", "q")
    # a tree, which has no ids beside it, stands before its blocks
    none = F.lit(None).cast("binary")
    both = trees.select("dim", "shard", "tree", none.alias("ids"), none.alias("q")).unionByName(blocks)
    both = both.repartition("dim", "shard").sortWithinPartitions("dim", "shard", F.col("ids").isNotNull())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        name, tree = None, None
        for b in batches:
            for i in range(len(b)):
                mine = (b.column(0)[i].as_py(), b.column(1)[i].as_py())
                if (packed := b.column(2)[i]).is_valid:
                    name, tree = mine, pickle.loads(packed.as_buffer())
                    continue
                if name != mine:  # a shard without vectors of this length
                    continue
                ask, q = np.frombuffer(b.column(3)[i].as_buffer(), np.int64), np.frombuffer(b.column(4)[i].as_buffer(), np.float64).reshape(-1, mine[0])
                got = list(found(*tree, ask, q, k, factor))
                yield {"query_id": np.repeat(ask, [len(x) for x, _ in got]), "vec_id": np.concatenate([x for x, _ in got]), "score": np.concatenate([s for _, s in got])}

    both = arrow_map(both, search, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
