"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct `words`-word shingles, hashed to 64 bits. Its parity sketch is a
very long bit string in which each shingle flips one bit; kept sparse, in parts, a part being the XOR
of the 64-bit hashes that fall into it. Flipped bits cancel exactly for shared shingles, so the Hamming
distance of two sketches is at most the size of the sets' symmetric difference d, and d <= (a + b)(100
- percent)/(100 + percent) for linked sets of sizes a and b.

Size bands: linked sets lie in one band or in two neighbouring ones. Band group g covers bands g
and g + 1, has the largest d of its pairs, D, and cuts sketches into p > D parts. A linked pair
differs in at most D parts, so it agrees in p - D or more (pigeonhole). Parts are dealt by their
content into buckets; one numpy pass over a bucket finds the sets that share a part:

* A part that few sets share gives each pair of them as a candidate.
* A part that more than `FEW` sets share, or that is empty, is weak. A set of which fewer parts are weak than
  its links must agree in is found by a part that is not weak. The others are the weak sets. Two of
  them that link share at least m weak parts, so each needs its rarest ones only, all but m - 1. In
  each such part its most typical set (with the most weak parts) is the centre, and the others
  are candidates with it: near copies of one text join here, with a pair for each, not for each two.
  Sets that share such a part and are in different components even then are compared in blocks by
  dense parity sketches of the whole sets, of a few bits for each shingle; pairs whose Hamming
  distance is no more than d are candidates, too.

Candidates whose dense sketches are near enough are verified on the sets themselves. Copies are one set throughout. Components come
from large-star/small-star rounds over the verified links.

Sets are told apart by 64 bits of their content; two different ones among n collide with a chance of
n^2 / 2^65. Null texts and texts without words have the empty set, which links with nothing. With fewer
than `words` words the whole sequence is one shingle. Rows whose id is null link with
nothing and have component_id null. Repeated rows each give a row. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from xxhash import xxh3_64_intdigest

from fieldbook.llm.common import arrow_map, met, partitions, saved

FEW, BLOCK, FLUSH, BITS = 8, 1024, 500_000, 8
#: A bucket is held whole by one task; there are so many buckets that it has about this many signatures at most.
BUCKET = 4_000_000
#: Lists of at most so many ids (16 bytes each, 8 MB) go to each task; larger ones are joined by a shuffle.
SMALL = 500_000
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles, letters A-Z lower-cased."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))
    n = max(1, len(h) - words + 1)
    out = np.full(n, len(found) if len(found) < words else words, np.uint64)
    for i in range(min(words, len(h))):
        out = mix(out * M2 + h[i : i + n])
    return np.unique(out)


def key_of(s: np.ndarray) -> int:
    """The set's name: 0 for the empty one."""
    return int(np.int64(np.uint64(xxh3_64_intdigest(s.tobytes()) | 1))) if len(s) else 0


@lru_cache(maxsize=4)
def bands(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower ends of the size bands, and for each band group D and the number of parts."""
    low, most, parts = [1], [], []
    while low[-1] < 1 << 40:
        low.append(low[-1] * 100 // percent + 1)
        a = low[-1] - 1
        most.append((a + a * 100 // percent) * (100 - percent) // (100 + percent))
        d = most[-1]
        parts.append(d + 1 + max(d // 4, min(d, 8)))
    return np.array(low), np.array(most), np.array(parts)


def most_apart(size: int, g: int, percent: int) -> int:
    """Largest symmetric difference of a set with a partner in band group g."""
    edge = int(bands(percent)[0][g + 1])
    partner = size * 100 // percent if size < edge else edge - 1
    return (size + partner) * (100 - percent) // (100 + percent)


def signatures(s: np.ndarray, percent: int) -> list[tuple[int, int, np.ndarray]]:
    """For each of the set's band groups: the group, the number of empty parts, the parts' signatures.

    Empty parts have a signature only for a set that may agree with another in nothing else.
    """
    low, most, parts = bands(percent)
    band = int(np.searchsorted(low, len(s), side="right")) - 1
    out = []
    for g in (band - 1, band):
        if g < 0 or most[g] == 0:  # then only equal sets link
            continue
        p = int(parts[g])
        part = ((s >> np.uint64(32)) * np.uint64(p)) >> np.uint64(32)  # rises with s
        start = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        value = np.bitwise_xor.reduceat(mix(s), start)
        empty = p - len(start)
        name = part[start]
        if empty >= p - most_apart(len(s), g, percent):
            rest = np.setdiff1d(np.arange(p, dtype=np.uint64), name)
            name, value = np.r_[name, rest], np.r_[value, np.zeros(len(rest), np.uint64)]
        out.append((g, empty, mix(value ^ mix(name + np.uint64((g + 1) << 32)))))
    return out


def sets(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """doc_id, n_shingles, key of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            found = [shingles(t.as_py(), words) for t in b.column(1)]
            yield {"doc_id": b.column(0), "n_shingles": [len(s) for s in found], "key": [key_of(s) for s in found]}

    return arrow_map(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id bigint, n_shingles bigint, key bigint")


def dealt(docs: DataFrame, text_col: str, words: int, percent: int, n: int) -> DataFrame:
    """Signatures in rows of one bucket each: 32 bits of each one, set by set, and how many each of the row's sets has."""

    def flush(held: list) -> Iterator[dict]:
        keys, sizes, groups, empty = (np.array(x, t) for x, t in zip(zip(*[h[:4] for h in held], strict=True), ("<i8", "<i4", "u1", "<i4"), strict=True))
        sig = np.concatenate([h[4] for h in held])
        who = np.repeat(np.arange(len(held), dtype=np.uint32), [len(h[4]) for h in held])
        bucket = (sig >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)
        order = np.argsort(bucket, kind="stable")
        at = np.searchsorted(bucket[order], np.arange(n + 1, dtype=np.uint64))
        out: dict[str, list] = {k: [] for k in ("bucket", "sig", "n", "key", "size", "grp", "empty")}
        for i in range(n):
            if at[i] < at[i + 1]:
                own = order[at[i] : at[i + 1]]
                mine, count = np.unique(who[own], return_counts=True)  # the order is stable, so own is sorted by set
                row = (i, (sig[own] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), count.astype("<u4").tobytes(), keys[mine].tobytes(), sizes[mine].tobytes(), groups[mine].tobytes(), empty[mine].tobytes())
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
        yield out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list = []
        total, seen = 0, set()
        for b in batches:
            for t in b.column(0):
                s = shingles(t.as_py(), words)
                if not len(s) or (key := key_of(s)) in seen:  # a copy in this task adds nothing
                    continue
                seen.add(key)
                for g, empty, sig in signatures(s, percent):
                    held.append((key, len(s), g, empty, sig))
                    total += len(sig)
                if total > FLUSH:
                    yield from flush(held)
                    held, total, seen = [], 0, set()
        if held:
            yield from flush(held)

    return arrow_map(docs.select(text_col), run, "bucket int, sig binary, n binary, key binary, size binary, grp binary, empty binary")


def shared(rows: DataFrame, percent: int) -> DataFrame:
    """What the buckets show: candidate pairs (kind 0: a, b), and each set's weak parts (kind 1: a in part b of group grp)."""
    low, most, parts = bands(percent)

    def bucket(name: int, rows: list) -> Iterator[dict]:
        key, size, grp, empty = (np.concatenate([np.frombuffer(r[i], t) for r in rows]) for i, t in ((2, "<i8"), (3, "<i4"), (4, "u1"), (5, "<i4")))
        size, grp = size.astype(np.int64), grp.astype(np.int32)
        sig = np.concatenate([np.frombuffer(r[0], "<u4") for r in rows])
        who = np.repeat(np.arange(len(key)), np.concatenate([np.frombuffer(r[1], "<u4") for r in rows]))
        order = np.lexsort((key[who], sig))
        sig, who = sig[order], who[order]
        new = np.r_[True, (sig[1:] != sig[:-1]) | (key[who][1:] != key[who][:-1])]  # copies are one
        sig, who = sig[new], who[new]
        start = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        n = np.diff(np.r_[start, len(sig)])
        for m in range(2, FEW + 1):
            at = start[n == m]
            for i in range(m):
                for j in range(i + 1, m):
                    x, y = who[at + i], who[at + j]
                    ok = (grp[x] == grp[y]) & linkable(size[x], size[y], grp[x], low, percent)
                    if ok.any():
                        a, b = key[x[ok]], key[y[ok]]
                        yield {"kind": np.zeros(len(a), np.int8), "a": np.minimum(a, b), "b": np.maximum(a, b), "grp": grp[x[ok]], "size": np.zeros(len(a), np.int64), "empty": np.zeros(len(a), np.int32)}
        hot = np.repeat(n > FEW, n)
        if hot.any():
            w = who[hot]
            part = (sig[hot].astype(np.int64) << 24) + name  # names the part with its group below
            yield {"kind": np.ones(len(w), np.int8), "a": key[w], "b": part, "grp": grp[w], "size": size[w], "empty": empty[w]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: dict[int, list] = {}
        for b in batches:
            for name, *rest in zip(*[c.to_pylist() for c in b.columns], strict=True):
                held.setdefault(name, []).append(rest)
        for name in list(held):
            yield from bucket(name, held.pop(name))

    return arrow_map(rows, run, "kind tinyint, a bigint, b bigint, grp int, size bigint, empty int")


def linkable(x: np.ndarray, y: np.ndarray, g: np.ndarray, low: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes x and y can link, the smaller one in band g (others meet in another group)."""
    a, b = np.minimum(x, y), np.maximum(x, y)
    return (a * 100 >= b * percent) & (a >= low[g]) & (a < low[g + 1])


def texts_of(keys: DataFrame, docs: DataFrame, rep: DataFrame, text_col: str, id_col: str, *more: str) -> DataFrame:
    """key, text and more columns of keys, from the rows that may have the key's set. rep: key, doc_id of one row that has it."""
    need = saved(keys.join(rep, "key").select("key", *more, F.col("doc_id").alias("_id")))
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return own.join(F.broadcast(need) if need.count() <= SMALL else need, F.col("doc_id") == F.col("_id")).select("key", "text", *more)


def verified(pairs: DataFrame, docs: DataFrame, rep: DataFrame, text_col: str, id_col: str, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of keys whose sets link."""
    own = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), docs, rep, text_col, id_col)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            found = [(k, s) for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) if key_of(s := shingles(t.as_py(), words)) == k]
            yield {"key": [k for k, _ in found], "s": [s.tobytes() for _, s in found]}

    full = arrow_map(own, hashed, "key bigint, s binary").dropDuplicates(["key"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(u) > len(v):
                    u, v = v, u
                both = int((v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u).sum())
                keep.append(100 * both >= percent * (len(u) + len(v) - both))
            keep = pa.array(keep, pa.bool_())
            yield {"a": b.column(0).filter(keep), "b": b.column(1).filter(keep)}

    two = pairs.join(full.withColumnsRenamed({"key": "a", "s": "sa"}), "a").join(full.withColumnsRenamed({"key": "b", "s": "sb"}), "b")
    return arrow_map(two.select("a", "b", "sa", "sb"), compare, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of each node of the links (a, b), by large-star and small-star rounds."""
    edges = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = saved(large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = now


def named(rows: DataFrame, comps: DataFrame, key: str) -> DataFrame:
    """The rows with `comp`, the component of their key: the key itself where it has no link."""
    return rows.join(comps.withColumnRenamed("node", key), key, "left").withColumn("comp", F.coalesce("component", key)).drop("component")


def weak_parts(found: DataFrame, percent: int) -> DataFrame:
    """part, grp, key, size, weight of the weak sets, in the parts that they need: all but the m - 1 that most of them share."""
    low, _, parts = bands(percent)
    at = lambda values, i: F.element_at(F.array(*[F.lit(int(v)) for v in values]), i + 1)
    rows = found.where("kind = 1").select(F.col("a").alias("key"), "grp", "size", "empty", F.struct("grp", "b").alias("part"))
    edge = at(low[:-1], F.col("grp") + 1)
    partner = F.when(F.col("size") < edge, F.floor(F.col("size") * 100 / percent)).otherwise(edge - 1)
    need = at(parts, F.col("grp")) - F.floor((F.col("size") + partner) * (100 - percent) / (100 + percent)) - F.col("empty")
    sets = rows.groupBy("key", "grp").agg(F.count("*").alias("weight"), F.max(need).alias("need")).where(F.col("weight") >= F.col("need"))
    own = saved(rows.join(sets, ["key", "grp"]).drop("empty"))
    common = own.groupBy("part").agg(F.count("*").alias("_n")).where("_n > 1")
    nth = F.row_number().over(W.partitionBy("key", "grp").orderBy(F.desc("n"), "part"))
    return saved(met(own, common.withColumn("n", F.col("_n")), ["part"]).withColumn("_r", nth).where(F.col("_r") >= F.col("need")).select("part", "grp", "key", "size", "weight"))


def stars(weak: DataFrame, percent: int) -> DataFrame:
    """Each weak set with the centre of each of its parts."""
    centre = weak.groupBy("part").agg(F.max_by(F.struct("key", "size"), F.struct("weight", "key")).alias("_c"), F.count("*").alias("_n")).select("part", "_n", F.col("_c.key").alias("_key"), F.col("_c.size").alias("_size"))
    near = F.least("size", "_size") * 100 >= F.greatest("size", "_size") * percent
    return met(weak, centre, ["part"]).where(near & (F.col("key") != F.col("_key"))).select(F.least("key", "_key").alias("a"), F.greatest("key", "_key").alias("b"), "grp").distinct()


def dense_sketch(s: np.ndarray, g: int, percent: int) -> bytes:
    """The parity of the shingles at each of the band group's bits."""
    width = 64 * -(-BITS * int(bands(percent)[0][g]) // 64)
    at = (mix(s ^ M2) % np.uint64(width)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=width) & 1).astype(np.uint8)).tobytes()


def sketches(asked: DataFrame, docs: DataFrame, rep: DataFrame, text_col: str, id_col: str, words: int, percent: int) -> DataFrame:
    """key, grp, n (the set's size), bits for each (key, grp) asked for."""
    grps = asked.groupBy("key").agg(F.collect_set("grp").alias("grps"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            rows = [(k, g, len(s), dense_sketch(s, g, percent)) for k, t, gs in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True) if key_of(s := shingles(t.as_py(), words)) == k for g in gs]
            yield {c: [r[i] for r in rows] for i, c in enumerate(("key", "grp", "n", "bits"))}

    texts = texts_of(grps, docs, rep, text_col, id_col, "grps")
    return arrow_map(texts, run, "key bigint, grp int, n bigint, bits binary").dropDuplicates(["key", "grp"])


def near_pairs(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, grp) whose dense sketches are near enough for a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            keep = []
            for m, n, x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), b.column(5), strict=True):
                apart = np.bitwise_count(np.frombuffer(x.as_buffer(), np.uint64) ^ np.frombuffer(y.as_buffer(), np.uint64)).sum()
                keep.append(bool(apart <= (m + n) * (100 - percent) // (100 + percent)))
            keep = pa.array(keep, pa.bool_())
            yield {"a": b.column(0).filter(keep), "b": b.column(1).filter(keep)}

    left, right = (bits.select(F.col("key").alias(c), "grp", F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}")) for c in "ab")
    two = pairs.join(left, ["a", "grp"]).join(right, ["b", "grp"])
    return arrow_map(two.select("a", "b", "na", "nb", "bitsa", "bitsb"), run, "a bigint, b bigint").distinct()


def weak_pairs(weak: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Pairs of weak sets of different components that share a part and whose dense sketches are near enough."""
    apart = weak.groupBy("part").agg(F.min("comp").alias("_x"), F.max("comp").alias("_y"), F.count("*").alias("_n")).where("_x <> _y").select("part", "_n", F.ceil(F.col("_n") / BLOCK).cast("int").alias("blocks"))
    rows = met(weak, apart, ["part"]).join(bits, ["key", "grp"]).withColumn("block", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    rows = rows.select("part", "key", "size", "comp", "bits", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("part", "key", "size", "comp", "bits", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def run(table: pa.Table) -> pa.Table:
        key, size, comp, block, i, j = (table[c].to_numpy() for c in ("key", "size", "comp", "block", "i", "j"))
        bits = np.frombuffer(b"".join(table["bits"].to_pylist()), np.uint64).reshape(len(key), -1)
        right = np.flatnonzero(block == j)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x in np.flatnonzero(block == i):
            y = right[comp[right] != comp[x]]
            y = y[key[y] > key[x]] if i[0] == j[0] else y
            y = y[np.bitwise_count(bits[y] ^ bits[x]).sum(axis=1) <= (size[y] + size[x]) * (100 - percent) // (100 + percent)]
            y = y[np.minimum(size[x], size[y]) * 100 >= np.maximum(size[x], size[y]) * percent]
            a.append(np.minimum(key[x], key[y]))
            b.append(np.maximum(key[x], key[y]))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return rows.groupBy("part", "i", "j").applyInArrow(run, "a bigint, b bigint").distinct()


def ngram_jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id among the documents that links reach) of each row."""
    spark = docs.sparkSession
    named_docs = docs.where(F.col(id_col).isNotNull())
    own = saved(sets(docs, id_col, text_col, words))
    rep = own.where("key <> 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    # a set's two groups have some 0.28 parts a shingle each
    n = max(partitions(spark), -(-int(0.6 * (own.agg(F.sum("n_shingles")).first()[0] or 0)) // BUCKET))
    found = saved(shared(dealt(named_docs, text_col, words, percent, n).repartitionById(n, F.col("bucket")), percent).distinct())
    weak = weak_parts(found, percent)
    pairs = saved(found.where("kind = 0").select("a", "b", "grp").unionByName(stars(weak, percent)).distinct())
    asked = pairs.select(F.explode(F.array("a", "b")).alias("key"), "grp").unionByName(weak.select("key", "grp")).distinct()
    bits = saved(sketches(asked, named_docs, rep, text_col, id_col, words, percent))
    links = saved(verified(saved(near_pairs(pairs, bits, percent)), named_docs, rep, text_col, id_col, words, percent))
    comps = components(links)
    rest = saved(weak_pairs(named(weak, comps, "key"), bits, percent))
    if not rest.isEmpty():
        comps = components(links.unionByName(verified(rest, named_docs, rep, text_col, id_col, words, percent)))

    out = named(own, comps, "key")
    name = out.where("key <> 0").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    out = out.join(name, "comp", "left")
    return out.select("doc_id", "n_shingles", F.when((F.col("key") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
