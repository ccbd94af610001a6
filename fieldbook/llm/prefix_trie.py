"""The prefix trie of conversations, by peeling turns off their ends.

A conversation is a row of prefix digests: the one at depth d stands for its first d turns, so equal digests are
the same node. Peeling goes down from the deepest level. The nodes of a level are the conversations that end there
merged with the survivors of the level above; each node's counts are complete as soon as it is found, is written
out, loses its last turn and goes on to the next level as a survivor, where it meets its siblings.

Levels are peeled in bands. Up to depth `SHALLOW`, where many conversations share few nodes, each level is an
aggregation of its own, combined before the shuffle. Above it, a band doubles in width: rows that share the band's
lowest prefix meet in a task that peels the band's levels one by one. A prefix with more than `MOST` rows in a
band goes level by level as well, so no task holds an unbounded group. Copies of a conversation are merged by
counts before they are peeled. Only digests and lengths travel, no texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldbook.llm.common import arrow_map, met, saved

#: Depths peeled by an aggregation each; rows of a group that a task may hold; width of the id ranges that are joined to strings first.
SHALLOW, MOST, RANGE = 8, 20_000, 4096
#: Every FORK-th conversation lends its first turns, LONGEST_HEAD at most, to those up to the next one.
FORK, LONGEST_HEAD = 100, 5
NOTHING = hashlib.sha256(b"").hexdigest()
COUNTS = ("conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
ROW = "depth int, h binary, path array<binary>, lens array<bigint>, conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order, an array of (digest of role and text, code points of the text)."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    turn = F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn").alias("turn"), digest.alias("h"), F.length(text).cast("bigint").alias("n"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("bigint").alias("conv_id"), turn.alias("t"))
    return rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["h"].alias("h"), t["n"].alias("n"))).alias("turns"))


def rebuilt(own: DataFrame) -> DataFrame:
    """Each conversation with its first turns replaced by those of the FORK-th one before it; none if that one is absent."""
    own = saved(own.withColumn("base", F.col("conv_id") - F.col("conv_id") % FORK))
    heads = own.where("base = conv_id").select("base", F.slice("turns", 1, LONGEST_HEAD).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (LONGEST_HEAD + 1)).cast("int")
    lent = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), h)
    return own.join(heads, "base", "left").select("conv_id", F.concat(lent, F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def paths(convs: DataFrame) -> DataFrame:
    """The conversations in the form ROW: path holds the digests of all prefixes, lens the code points of all turns."""

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            out = {"depth": [], "h": [], "path": [], "lens": []}
            for turns in b.column("turns").to_pylist():
                path, at = [], b""
                for t in turns:
                    at = hashlib.md5(at + t["h"]).digest()
                    path.append(at)
                for k, v in (("depth", len(path)), ("h", at), ("path", path), ("lens", [t["n"] for t in turns])):
                    out[k].append(v)
            yield out | {"conv_id": b.column("conv_id"), "n_convs": [1] * b.num_rows} | {k: [0] * b.num_rows for k in COUNTS[2:]}

    return arrow_map(convs, chained, ROW)


def level(rows: DataFrame, depth: int) -> DataFrame:
    """The nodes of one depth in the form ROW, from rows of that depth."""
    summed = [F.sum(c).alias(c) for c in COUNTS[1:]]
    nodes = rows.groupBy("h").agg(F.first("path").alias("path"), F.first("lens").alias("lens"), F.min("conv_id").alias("conv_id"), *summed)
    own = (F.col("n_convs") - 1) * F.element_at("lens", depth) if depth else F.lit(0)
    return nodes.select(F.lit(depth).alias("depth"), "h", "path", "lens", "conv_id", "n_convs", "n_children", F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")).alias("n_leaves"), (F.col("saved_tokens") + own).alias("saved_tokens"))


def stripped(nodes: DataFrame, depth: int) -> DataFrame:
    """The nodes of a depth without their last turn, each a child of the node that its path now ends in."""
    path = F.slice("path", 1, depth - 1)
    h = F.element_at("path", depth - 1) if depth > 1 else F.lit(b"")
    return nodes.where(F.col("depth") == depth).select(F.lit(depth - 1).alias("depth"), h.alias("h"), path.alias("path"), F.slice("lens", 1, depth - 1).alias("lens"), "conv_id", "n_convs", F.lit(1).cast("bigint").alias("n_children"), "n_leaves", "saved_tokens")


def peeled(rows: list[dict], low: int) -> Iterator[dict]:
    """The nodes above depth `low` of rows that share their first `low` turns, from the deepest level down."""
    ended: dict[int, list[dict]] = {}
    for r in rows:
        ended.setdefault(r["depth"], []).append(r)
    alive: dict[bytes, list] = {}
    for depth in range(max(ended), low, -1):
        for r in ended.get(depth, ()):  # newly ended ones meet the survivors
            at = alive.setdefault(r["h"], [r, r["conv_id"], 0, 0, 0, 0])
            at[1] = min(at[1], r["conv_id"])
            for i, c in enumerate(COUNTS[1:], 2):
                at[i] += r[c]
        below: dict[bytes, list] = {}
        for h, (r, conv_id, n, children, leaves, tokens) in alive.items():
            leaves, tokens = leaves if children else 1, tokens + (n - 1) * r["lens"][depth - 1]
            last = depth == low + 1  # only these go on to the next band
            yield {"depth": depth, "h": h, "path": r["path"][:depth] if last else r["path"][max(depth - 2, 0) : depth], "lens": r["lens"][:depth] if last else [], "conv_id": conv_id, "n_convs": n, "n_children": children, "n_leaves": leaves, "saved_tokens": tokens}
            if not last:
                at = below.setdefault(r["path"][depth - 2], [r, conv_id, 0, 0, 0, 0])
                at[1] = min(at[1], conv_id)
                for i, v in enumerate((n, 1, leaves, tokens), 2):
                    at[i] += v
        alive = below


def band(rows: DataFrame, low: int) -> DataFrame:
    """The nodes above depth `low`; those that aren't its lowest keep only the last two digests of their path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        each = (r for b in batches for r in b.to_pylist())
        out: list[dict] = []
        for _, group in groupby(each, lambda r: r["key"]):
            for node in peeled(list(group), low):
                out.append(node)
                if len(out) >= 4096:
                    yield {k: [r[k] for r in out] for k in out[0]}
                    out = []
        if out:
            yield {k: [r[k] for r in out] for k in out[0]}

    return arrow_map(rows.withColumn("key", F.element_at("path", low)).repartition("key").sortWithinPartitions("key"), run, ROW)


def edges(deepest: int) -> list[tuple[int, int]]:
    """(low, high] of each band, the deepest first; the root is (-1, 0]."""
    ends = [*range(-1, min(SHALLOW, deepest) + 1)]
    while ends[-1] < deepest:
        ends.append(min(2 * ends[-1], deepest))
    return list(zip(ends, ends[1:], strict=False))[::-1]


def trie(rows: DataFrame) -> list[DataFrame]:
    """All nodes in the form ROW, a frame for each band, from conversations in that form; a path ends with its parent's and its own digest."""
    counts = [F.sum("n_convs").alias("n_convs"), *(F.lit(0).cast("bigint").alias(c) for c in COUNTS[2:])]
    ended = saved(rows.groupBy("depth", "h").agg(F.first("path").alias("path"), F.first("lens").alias("lens"), F.min("conv_id").alias("conv_id"), *counts))
    deepest = ended.agg(F.max("depth")).first()[0]
    found, survivors = [], None
    for low, high in edges(deepest) if deepest is not None else ():
        here = ended.where((F.col("depth") > low) & (F.col("depth") <= high))
        here = here if survivors is None else here.unionByName(survivors)
        hot = None
        if high - low > 1 and here.count() > MOST:
            hot = saved(here.groupBy(F.element_at("path", low).alias("key")).count().where(F.col("count") > MOST).select("key"))
            hot = None if hot.isEmpty() else hot
        if high - low == 1:
            nodes = [saved(level(here, high))]
        elif hot is None:
            nodes = [saved(band(here, low))]
        else:
            keyed = here.withColumn("key", F.element_at("path", low))
            nodes, rest = [saved(band(keyed.join(hot, "key", "left_anti").drop("key"), low))], keyed.join(hot, "key", "left_semi").drop("key")
            above = None
            for depth in range(high, low, -1):
                at = rest.where(F.col("depth") == depth)
                nodes.append(saved(level(at if above is None else at.unionByName(above), depth)))
                above = stripped(nodes[-1], depth)
        found += nodes
        if low >= 0:
            out = [stripped(n, low + 1) for n in nodes]
            survivors = out[0] if len(out) == 1 else out[0].unionByName(out[-1])
    return found


def ends_digests(rows: DataFrame) -> DataFrame:
    """h and the SHA-256 of the ascending ids of the conversations that end there.

    Ids are joined to strings by ranges of RANGE ids; a node whose ids lie in several ranges is hashed by a task that
    takes the strings in order and holds one batch of them.
    """
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    chunks = saved(rows.groupBy("h", F.floor(F.col("conv_id") / RANGE).alias("range")).agg(ids.alias("ids")))
    number = chunks.groupBy("h").agg(F.count("*").alias("n"), F.max(F.struct("range", "ids"))["ids"].alias("ids"))
    one = number.where("n = 1").select("h", F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))
    several = chunks.join(number.where("n > 1").select("h"), "h", "left_semi").repartition("h").sortWithinPartitions("h", "range")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        at, state = None, None
        for b in batches:
            out: dict = {"h": [], "ends_sha256": []}
            for h, ids in zip(b.column("h").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if h == at:
                    state.update(b"," + ids.encode())
                    continue
                if state is not None:
                    out["h"].append(at)
                    out["ends_sha256"].append(state.hexdigest())
                at, state = h, hashlib.sha256(ids.encode())
            yield out
        if state is not None:
            yield {"h": [at], "ends_sha256": [state.hexdigest()]}

    return one.unionByName(arrow_map(several, hashed, "h binary, ends_sha256 string"))


def conversation_trie(conversations: DataFrame, fork: bool = True) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns go by number, null first; turns of one number (repeated rows among them, which all stay) by the digest of role and
    text. Null roles and texts are empty. Rows without conv_id belong to no conversation. With `fork`, each
    conversation's first turns are those of the hundredth before it (`rebuilt`). A conversation without turns ends in
    the root. No rows give no nodes, not even a root.
    """
    own = turns_of(conversations)
    rows = saved(paths(rebuilt(own) if fork else own))
    found = trie(rows)
    if not found:
        return rows.select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), *COUNTS[1:], F.lit(NOTHING).alias("ends_sha256"))
    above = F.when(F.col("depth") > 1, F.element_at("path", -2)).when(F.col("depth") == 1, F.lit(b""))
    nodes = found[0].select("depth", "h", above.alias("parent"), *COUNTS)
    for more in found[1:]:
        nodes = nodes.unionByName(more.select("depth", "h", above.alias("parent"), *COUNTS))
    nodes = saved(nodes.join(ends_digests(rows.select("h", "conv_id")), "h", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING))))
    parents = nodes.where("n_children > 0").select(F.col("h").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_n"))
    names = ("conv_id", "depth", "parent_conv_id", *COUNTS[1:], "ends_sha256")
    root = nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("bigint"))
    return met(nodes.where("depth > 0"), parents, ["parent"]).select(*names).unionByName(root.select(*names))
