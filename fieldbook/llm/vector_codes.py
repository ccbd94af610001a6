"""Vector codes: parts of vectors are replaced by the nearest of a codebook's entries.

Each block of vectors has a metric tree for each part. A tree is built middle-out: about sqrt(n) anchors take
the points nearest to them, anchors are merged pairwise into balls up to the root, and each anchor is divided in
the same way. Balls cache the sum and number of their points. An assignment walks down with a list of entries
that may be the nearest of some point; a list that shrinks to one entry makes the whole ball that entry's, and
its cached sum goes to the entry without a look at its points. The trees are built once and saved; a round sends
at most one row for each part and entry from each task to the aggregation.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldbook.llm.common import arrow_map, met, saved

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors of a block, and points of a ball that isn't divided further.
BLOCK, LEAF = 4096, 64
#: Anchors inside anchors; what lies deeper stays one ball, whose points are compared one by one.
DEEPEST = 4
#: Sums of products below this are exact in double precision.
EXACT = 2.0**52


class Tree:
    """Balls over the rows of `points`, which are put in an order in which each ball is a slice [start, end)."""

    def __init__(self, points: np.ndarray):
        self.points, self.order = points, np.arange(len(points))
        self.balls: list[tuple[int, int, int, int]] = []  # start, end, left, right; -1: no child
        self.pivots: list[np.ndarray] = []
        self.radii: list[float] = []
        self.sums: list[np.ndarray] = []
        self.root = self._divide(np.arange(len(points)), 0)[0] if len(points) else -1
        self.points = points[self.order]

    def _ball(self, at: np.ndarray, start: int, left: int = -1, right: int = -1) -> int:
        rows = self.points[at]
        pivot = rows.mean(axis=0)
        self.balls.append((start, start + len(at), left, right))
        self.pivots.append(pivot)
        self.radii.append(float(np.sqrt(((rows - pivot) ** 2).sum(axis=1).max())))
        self.sums.append(rows.sum(axis=0))
        return len(self.balls) - 1

    def _divide(self, at: np.ndarray, start: int, depth: int = 0) -> tuple[int, np.ndarray]:
        """The ball of the points `at`, with the balls inside it; their order."""
        if len(at) > LEAF and depth < DEEPEST:
            groups = anchors(self.points[at].astype(np.float64), max(2, round(len(at) ** 0.5)))
            if len(groups) > 1:
                return self._merge([at[g] for g in groups], start, depth + 1)
        self.order[start : start + len(at)] = at
        return self._ball(at, start), at

    def _merge(self, groups: list[np.ndarray], start: int, depth: int) -> tuple[int, np.ndarray]:
        """Merges anchors pairwise, the closest balls first; then lays them out and divides them from the top down."""
        rows = [self.points[g] for g in groups]
        centers = np.array([r.mean(axis=0) for r in rows])
        radii = np.array([np.sqrt(((r - c) ** 2).sum(axis=1).max()) for r, c in zip(rows, centers, strict=True)])
        sizes, trees = np.array([len(g) for g in groups], float), list(range(len(groups)))
        apart = np.sqrt(((centers[:, None] - centers[None]) ** 2).sum(axis=2)) + radii[:, None] + radii[None]
        np.fill_diagonal(apart, np.inf)
        for _ in range(len(groups) - 1):
            i, j = sorted(divmod(int(apart.argmin()), len(groups)))
            trees[i] = (trees[i], trees[j])
            to = (centers[i] * sizes[i] + centers[j] * sizes[j]) / (sizes[i] + sizes[j])
            radii[i] = max(radii[i] + np.linalg.norm(to - centers[i]), radii[j] + np.linalg.norm(to - centers[j]))
            centers[i], sizes[i] = to, sizes[i] + sizes[j]
            apart[j, :] = apart[:, j] = np.inf
            alive = np.isfinite(apart[i])
            apart[i, alive] = apart[alive, i] = np.sqrt(((centers[alive] - to) ** 2).sum(axis=1)) + radii[alive] + radii[i]

        def laid(tree, start: int) -> tuple[int, np.ndarray]:
            if not isinstance(tree, tuple):
                return self._divide(groups[tree], start, depth)
            left, a = laid(tree[0], start)
            right, b = laid(tree[1], start + len(a))
            return self._ball(both := np.concatenate([a, b]), start, left, right), both

        return laid(trees[0], start)


def anchors(rows: np.ndarray, n: int) -> list[np.ndarray]:
    """Row numbers of n groups at most, each of the rows nearest to its anchor; rows equal to each other stay one group.

    A new anchor stands where the widest group ends. It looks only at rows farther from their anchor than half
    the distance of the two anchors: others can't be nearer to it.
    """
    first = int(((rows - rows.mean(axis=0)) ** 2).sum(axis=1).argmin())
    at, owner = [first], np.zeros(len(rows), dtype=np.int64)
    far = np.sqrt(((rows - rows[first]) ** 2).sum(axis=1))
    while len(at) < n:
        new = int(far.argmax())
        if far[new] == 0:
            break
        reach = np.sqrt(((rows[at] - rows[new]) ** 2).sum(axis=1)) / 2
        near = np.flatnonzero(far >= reach[owner] * (1 - 1e-9))
        d = np.sqrt(((rows[near] - rows[new]) ** 2).sum(axis=1))
        won = d < far[near]
        owner[near[won]], far[near[won]] = len(at), d[won]
        at.append(new)
    return [g for k in range(len(at)) if len(g := np.flatnonzero(owner == k))]


def squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows, as int64."""
    top = float(max(np.abs(points).max(initial=0), np.abs(entries).max(initial=0)))
    if 4 * points.shape[1] * top * top < EXACT:  # a product of matrices in double precision is exact
        p, e = points.astype(np.float64), entries.astype(np.float64)
        return ((p * p).sum(axis=1)[:, None] + (e * e).sum(axis=1) - 2 * (p @ e.T)).astype(np.int64)
    return np.stack([((points - e) ** 2).sum(axis=1) for e in entries], axis=1)


def owned(tree: dict, entries: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(ball, candidates) that cover all points once: whole balls with one candidate, and leaves with several."""
    e = entries.astype(np.float64)
    stack = [(tree["root"], np.arange(len(e)))] if tree["root"] >= 0 else []
    while stack:
        ball, listed = stack.pop()
        d = np.sqrt(((e[listed] - tree["pivots"][ball]) ** 2).sum(axis=1))
        # an entry farther than this is farther from each point of the ball than the nearest one; the margin covers rounding
        listed = listed[d <= d.min() * (1 + 1e-9) + 2 * tree["radii"][ball] * (1 + 1e-9) + 1e-6]
        _, _, left, right = tree["balls"][ball]
        if len(listed) == 1 or left < 0:
            yield ball, listed
        else:
            stack += [(left, listed), (right, listed)]


def built(points: np.ndarray) -> dict:
    t = Tree(points)
    return {"points": t.points.astype(np.int32), "order": t.order.astype(np.int32), "root": t.root, "balls": np.array(t.balls, np.int32).reshape(-1, 4), "pivots": np.array(t.pivots), "radii": np.array(t.radii), "sums": np.array(t.sums, np.int64)}


def sums_of(tree: dict, entries: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
    """Adds each point to its nearest entry's sum and count."""
    for ball, listed in owned(tree, entries):
        start, end = tree["balls"][ball][:2]
        if len(listed) == 1:
            sums[listed[0]] += tree["sums"][ball]
            counts[listed[0]] += end - start
        else:
            rows = tree["points"][start:end].astype(np.int64)
            won = listed[squares(rows, entries[listed]).argmin(axis=1)]
            np.add.at(sums, won, rows)
            counts += np.bincount(won, minlength=len(entries))


def codes_of(tree: dict, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each point, in the given order of points, and the squared distance."""
    code, error = np.zeros(len(tree["points"]), np.int64), np.zeros(len(tree["points"]), np.int64)
    for ball, listed in owned(tree, entries):
        start, end = tree["balls"][ball][:2]
        d = squares(tree["points"][start:end].astype(np.int64), entries[listed])
        best = d.argmin(axis=1)
        at = tree["order"][start:end]
        code[at], error[at] = listed[best], d[np.arange(len(d)), best]
    return code, error


def quantized(rows: DataFrame, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    """_id, _v (array of long), _label of the vectors that can be coded."""
    v = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * F.lit(float(SCALE))))
    whole = F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < 2.0**16))
    label = F.col(label_col).cast("string") if label_col else F.lit(None).cast("string")
    return rows.where(whole).select(F.col(id_col).alias("_id"), v.alias("_v"), label.alias("_label"))


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = PARTS, n_entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """id, code (two hex digits a part), error, label_error (of all rows with the label), codebooks_sha256.

    Components become floor(1024 * x). Each part's codebook starts as that part of the vectors with the smallest
    ids (ties: the smaller vector; null ids come last) and moves to its parts' means in each round, in integers.

    Dropped are null and empty vectors, those with a null, non-finite or huge component (2**16 or more: squared
    distances of longs would overflow), and those of another length than most kept ones (ties: the longer). A
    length that the parts don't divide is filled up with zeros. Repeated ids are coded as separate rows. No
    vectors give no rows. More than 256 entries give longer hex digits.
    """
    spark = vectors.sparkSession
    kept = quantized(vectors, id_col, vector_col, label_col)
    id_type = T._parse_datatype_string(dict(kept.dtypes)["_id"])
    schema = f"code string, error bigint, _label string, _id {id_type.simpleString()}"
    length = kept.groupBy(F.size("_v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if length is None:
        return spark.createDataFrame([], schema).select(F.col("_id").alias(id_col), "code", "error", F.col("error").alias("label_error"), F.col("code").alias("codebooks_sha256"))
    width, size = -(-length["n"] // parts), length["n"]
    kept = kept.where(F.size("_v") == size)

    def cut(v: np.ndarray) -> np.ndarray:
        """parts × rows × width"""
        full = np.zeros((len(v), parts * width), np.int64)
        full[:, :size] = v
        return full.reshape(len(v), parts, width).transpose(1, 0, 2)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        def block(t: pa.Table) -> dict:
            v = t["_v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            return {"ids": [t["_id"].to_pylist()], "labels": [t["_label"].to_pylist()], "trees": [pickle.dumps([built(p) for p in cut(v)], protocol=5)]}

        held, n = [], 0
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                held.append(piece := b.slice(i, BLOCK))
                n += piece.num_rows
                if n >= BLOCK:
                    yield block(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield block(pa.Table.from_batches(held))

    trees = saved(arrow_map(kept, blocks, f"ids array<{id_type.simpleString()}>, labels array<string>, trees binary"))
    first = kept.orderBy(F.col("_id").isNull(), "_id", "_v").limit(n_entries).collect()
    books = [b.copy() for b in cut(np.array([r["_v"] for r in first], np.int64))]

    def loaded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[dict]]]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                yield row, pickle.loads(row["trees"][0].as_py())

    for _ in range(rounds):

        def partial(batches: Iterator[pa.RecordBatch], books=books) -> Iterator[dict]:
            sums = [np.zeros_like(b) for b in books]
            counts = [np.zeros(len(b), np.int64) for b in books]
            for _, held in loaded(batches):
                for p, tree in enumerate(held):
                    sums_of(tree, books[p], sums[p], counts[p])
            for p, n in enumerate(counts):
                at = np.flatnonzero(n)
                yield {"part": np.full(len(at), p, np.int32), "entry": at.astype(np.int32), "n": n[at], "s": list(sums[p][at])}

        got = arrow_map(trees.select("trees"), partial, "part int, entry int, n bigint, s array<bigint>")
        for r in got.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("s")[i]) for i in range(width))).alias("s")).collect():  # at most parts × entries rows
            books[r["part"]][r["entry"]] = np.array(r["s"], np.int64) // r["n"]

    digits = max(2, len(f"{n_entries - 1:x}"))

    def final(batches: Iterator[pa.RecordBatch], books=books) -> Iterator[dict]:
        for row, held in loaded(batches):
            found = [codes_of(tree, books[p]) for p, tree in enumerate(held)]
            code = ["".join(f"{c:0{digits}x}" for c in cs) for cs in zip(*(c.tolist() for c, _ in found), strict=True)]
            yield {"code": code, "error": sum(e for _, e in found), "_label": row["labels"][0].as_py(), "_id": row["ids"][0].as_py()}

    out = saved(arrow_map(trees, final, schema).withColumn("_none", F.col("_label").isNull()).withColumn("_key", F.coalesce("_label", F.lit(""))))
    by_label = out.groupBy("_none", "_key").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n"))
    text = ",".join(str(x) for b in books for x in b.reshape(-1).tolist())
    digest = hashlib.sha256(text.encode()).hexdigest()
    return met(out, by_label, ["_none", "_key"]).select(F.col("_id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
