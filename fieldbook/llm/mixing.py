"""Mixing sources to target weights as a min-cost flow.

Sources overlap: one text stands in several of them, in as many rows as there are copies (or a document names several
sources itself). Texts whose rows are spread over the sources in the same way share a membership pattern. Words flow from
patterns to the quotas of their sources. To take a text once is cheapest; to repeat it costs more with each doubling
(convex costs), wherever its copies stand. So a text that three sources hold is taken for the one that needs it most
before any source repeats what it has taken. No row is taken more than `copies` times.

The flow has a node for each pattern of several sources and for each source, not for texts: it is solved on the driver over
that aggregate. Costs stand on the patterns' words alone, so the cheapest flow is reached level by level: each
level doubles what patterns and the sources' own texts may give, and the flow is augmented to its maximum (Dinic's algorithm),
which moves earlier words to other sources but never takes a pattern's words back. Of patterns whose rows have one source each it takes the `MOST_PATTERNS`
with the most words; in the rest each row serves its own source without regard to its copies elsewhere. Patterns with rows of several
sources all go through it, in one task. Any number of sources works: beyond `MOST_PATTERNS` of them targets are found by rounds of Spark aggregates.

From words to documents: a pattern's texts lie on a circle by a seeded hash, each as long as its words. Each of the pattern's
sources takes an arc, one after the other, so a text is taken as often as arcs pass its start. Then each
source's own texts fill what is left of its quota: whole rounds of all of them and a partial round, in bins of the hash of `BIN` texts
on average; inside the one bin that crosses the quota texts are taken largest first while they fit. A text's takes are dealt to its
rows evenly; the first ones by a hash of the id get one more. Sums of bins are cumulated by source, and rows of a hot
text are ranked by range partitions, so no task holds a source or all copies of a text.

Null text has size 0 and is never taken; a null source is a source of its own, and so is an empty array. Equal rows, and rows with
null ids, are taken by number: which of them is the same thing. Texts are told apart by 64 bits and their size. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fieldbook.llm.common import WORD, met, partitions, saved

MOST_PATTERNS, BIN, LEVELS = 100_000, 512, 48


def targets(sizes: list[int], weights: list[float], total: float, most: float = 2.0) -> list[float]:
    """Shares of the total by weight, none above `most` times its size; what is cut off goes to the others by weight."""
    out, open_ = [0.0] * len(sizes), [i for i in range(len(sizes))]
    left = total
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = float(left * weights[i] / w)
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def min_cost_flow(patterns: Sequence[tuple[int, Sequence[tuple[int, Sequence[int]]]]], quota: Sequence[int], own: Sequence[Sequence[int]], copies: int) -> list[list[dict[int, int]]]:
    """Words that each member of each pattern gives to each source, so that the quotas are filled as far as they can be at the least cost.

    patterns: (words, members); a member is (rows of each text, sources of these rows). own: for each source the
    words that its own texts give when each is taken 2^level times at most.
    """
    to, cap, edges = [], [], [[], []]

    def node() -> int:
        edges.append([])
        return len(edges) - 1

    def edge(a: int, b: int, room: int) -> int:
        for x, y, c in ((a, b, room), (b, a, 0)):
            edges[x].append(len(to))
            to.append(y)
            cap.append(c)
        return len(to) - 2

    start, end = 0, 1
    sources = [node() for _ in quota]
    ends = [edge(n, end, q) for n, q in zip(sources, quota, strict=True)]
    starts, arcs = [], []
    for words, members in patterns:
        p = node()
        starts.append(edge(start, p, 0))
        arcs.append([])
        for rows, at in members:
            room = copies * rows * words
            via = p
            if len(at) > 1:
                via = node()
                edge(p, via, room)
            arcs[-1].append({s: edge(via, sources[s], room) for s in at})

    def augment() -> None:
        while True:
            depth = [-1] * len(edges)
            depth[start], layer = 0, [start]
            while layer and depth[end] < 0:
                found = []
                for x in layer:
                    for e in edges[x]:
                        if cap[e] and depth[to[e]] < 0:
                            depth[to[e]] = depth[x] + 1
                            found.append(to[e])
                layer = found
            if depth[end] < 0:
                return
            following, path, x = [0] * len(edges), [], start
            while True:
                if x == end:
                    amount = min(cap[e] for e in path)
                    for e in path:
                        cap[e] -= amount
                        cap[e ^ 1] += amount
                    cut = next(i for i, e in enumerate(path) if not cap[e])
                    x = to[path[cut] ^ 1]
                    del path[cut:]
                elif following[x] < len(edges[x]):
                    e = edges[x][following[x]]
                    if cap[e] and depth[to[e]] == depth[x] + 1:
                        path.append(e)
                        x = to[e]
                    else:
                        following[x] += 1
                elif path:
                    x = to[path.pop() ^ 1]
                    following[x] += 1
                else:
                    break

    most = max((copies * sum(r for r, _ in members) for _, members in patterns), default=0)
    used, before = [0] * len(quota), 0
    for level in range(LEVELS):
        if not any(cap[e] for e in ends):
            break
        for s, curve in enumerate(own):
            more = min(curve[level] - used[s], cap[ends[s]])
            used[s] += more
            cap[ends[s]] -= more
        now = min(1 << level, most)
        if now > before:
            for (words, _), e in zip(patterns, starts, strict=True):
                cap[e] += words * (now - before)
            before = now
            augment()
    return [[{s: cap[e ^ 1] for s, e in member.items()} for member in members] for members in arcs]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, copies: int) -> DataFrame:
    """place, target and quota (in whole words) beside source and source_size: sources by code point, null (the empty key) last."""
    spark = sizes.sparkSession
    few = sizes.limit(MOST_PATTERNS + 1).collect()
    if len(few) <= MOST_PATTERNS:
        few.sort(key=lambda r: (r["source"] == "", r["source"].encode("utf-32-be", "surrogatepass")))
        goal = targets([r["source_size"] for r in few], [weights[i % len(weights)] for i in range(len(few))], share * sum(r["words"] for r in few), copies)
        return spark.createDataFrame([(r["source"], r["source_size"], i, g, round(g)) for i, (r, g) in enumerate(zip(few, goal, strict=True))], "source string, source_size bigint, place bigint, target double, quota bigint")
    # places by range, each range after the counts of those before it
    order = (F.col("source") == "", F.col("source"))
    ranges = saved(sizes.repartitionByRange(partitions(spark), *order).withColumn("part", F.spark_partition_id()))
    ahead, before = [], 0
    for part, n in sorted(map(tuple, ranges.groupBy("part").count().collect())):
        ahead.append((part, before))
        before += n
    place = F.col("ahead") + F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1
    sources = ranges.join(F.broadcast(spark.createDataFrame(ahead, "part int, ahead bigint")), "part").withColumn("place", place)
    sources = saved(sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))))
    # as in targets: rounds until no more sources are above their most
    most, left, w, closed = F.col("source_size") * copies, share * sources.agg(F.sum("words")).first()[0], sources.agg(F.sum("weight")).first()[0], 0
    total = left
    while w:
        over = F.lit(float(left)) * F.col("weight") / F.lit(float(w)) > most
        n, cut, rest = sources.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, most)), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
        if n == closed:
            break
        closed, left, w = n, total - cut, rest
    goal = F.when(over, most.cast("double")).otherwise(F.lit(float(left)) * F.col("weight") / F.lit(float(w))) if w else most.cast("double")
    return saved(sources.select("source", "source_size", "place", goal.alias("target")).withColumn("quota", F.bround("target").cast("bigint")))


def binned(texts: DataFrame, key: str, seed: int) -> DataFrame:
    """`hash`, `bin` and `ahead` (the words in the key's lower bins) of each text; texts have the key, its number of `bins`, text_key and size."""
    h = F.xxhash64(F.lit(seed), "text_key", "size")
    texts = texts.withColumn("hash", h).withColumn("bin", F.floor((F.shiftright("hash", 11).cast("double") / 2.0**53 + 0.5) * F.col("bins")).cast("bigint"))
    sums = texts.groupBy(key, "bin").agg(F.sum("size").alias("in_bin"))
    ahead = F.coalesce(F.sum("in_bin").over(W.partitionBy(key).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return texts.join(sums.withColumn("ahead", ahead), [key, "bin"])


def shared_takes(shared: DataFrame, kinds: list, routed: list[list[dict[int, int]]], seed: int) -> DataFrame:
    """text_key, size, sources, n and takes of the texts of the flow's patterns."""
    spark, plan, circles = shared.sparkSession, [], []
    for k, members in zip(kinds, routed, strict=True):
        circles.append((k["kind"], k["words"], max(1, k["n"] // BIN)))
        start = 0
        for at, gives in enumerate(members):
            given = sum(gives.values())
            plan.append((k["kind"], at, start, given))
            start += given
    circles = spark.createDataFrame(circles, "kind bigint, around bigint, bins bigint")
    laid = binned(shared.join(circles, "kind"), "kind", seed)
    within = F.sum("size").over(W.partitionBy("kind", "bin").orderBy("hash", "text_key", "size").rowsBetween(W.unboundedPreceding, -1))
    laid = laid.withColumn("pos", F.col("ahead") + F.coalesce(within, F.lit(0)))  # before the rows are exploded
    laid = laid.select("kind", "around", "text_key", "size", "pos", F.posexplode("pattern").alias("at", "m"))
    arcs = laid.join(spark.createDataFrame(plan, "kind bigint, at int, start bigint, given bigint"), ["kind", "at"])
    # how often pos, pos + around, … falls into [start, start + given); pos < around keeps the dividends positive
    passes = lambda to: F.expr(f"({to} - pos + 2 * around - 1) div around")
    return arcs.select("text_key", "size", F.col("m.sources").alias("sources"), F.col("m.n").alias("n"), (passes("start + given") - passes("start")).alias("takes"))


def own_takes(own: DataFrame, quotas: DataFrame, copies: int, seed: int) -> DataFrame:
    """text_key, size, sources, n and takes of each source's own texts, so that they add up to the source's `left` words."""
    caps = own.groupBy("source", (F.col("n") * copies).alias("cap")).agg(F.sum("size").alias("words"), F.count("*").alias("texts"))
    w = W.partitionBy("source")
    upto, after = w.orderBy("cap"), w.orderBy("cap").rowsBetween(1, W.unboundedFollowing)
    above = F.coalesce(F.sum("words").over(after), F.lit(0))
    caps = caps.select("source", "cap", above.alias("above"), F.coalesce(F.sum("texts").over(after), F.lit(0)).alias("texts_above"), (F.sum(F.col("words") * F.col("cap")).over(upto) + F.col("cap") * above).alias("filled"), F.sum("words").over(w).alias("words"), F.sum("texts").over(w).alias("texts"))
    # the last cap up to which all texts are taken, and whole rounds of the others beyond it
    reached = F.max(F.when(F.col("filled") <= F.col("left"), F.struct("cap", "filled", "above", "texts_above")))
    none = F.struct(F.lit(0).cast("bigint").alias("cap"), F.lit(0).cast("bigint").alias("filled"), F.first("words").alias("above"), F.first("texts").alias("texts_above"))
    plan = caps.join(quotas.select("source", "left"), "source").groupBy("source", "left").agg(F.coalesce(reached, none).alias("r"), F.sum("texts").alias("_n"))
    more = F.when(F.col("r.above") > 0, F.expr("(left - r.filled) div r.above")).otherwise(0)
    plan = plan.select("source", "_n", (F.col("r.cap") + more).alias("rounds"), F.when(F.col("r.above") > 0, F.col("left") - F.col("r.filled") - more * F.col("r.above")).otherwise(0).alias("rest"), F.greatest(F.lit(1), F.expr(f"r.texts_above div {BIN}")).alias("bins"))
    rows = saved(met(own, plan, ["source"]))
    over = (F.col("n") * copies > F.col("rounds")) & (F.col("rest") > 0)
    laid = saved(binned(rows.where(over), "source", seed))
    whole = F.col("ahead") + F.col("in_bin") <= F.col("rest")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "hash", "text_key"], ascending=[False, True, True], kind="stable")
        room, more = int(pdf["rest"].iloc[0] - pdf["ahead"].iloc[0]) if len(pdf) else 0, []
        for s in pdf["size"].tolist():
            more.append(int(s <= room))
            room -= s * more[-1]
        return pdf.assign(more=more)[["text_key", "size", "sources", "n", "rounds", "more"]]

    crossing = laid.where(~whole & (F.col("ahead") < F.col("rest")))
    fitted = crossing.groupBy("source").applyInPandas(fit, "text_key bigint, size bigint, sources array<string>, n bigint, rounds bigint, more bigint")
    done = laid.where(whole | (F.col("ahead") >= F.col("rest"))).select("text_key", "size", "sources", "n", "rounds", whole.cast("bigint").alias("more"))
    rest = rows.where(~over).select("text_key", "size", "sources", "n", "rounds", F.lit(0).cast("bigint").alias("more"))
    return fitted.unionByName(done).unionByName(rest).select("text_key", "size", "sources", "n", (F.least(F.col("n") * copies, "rounds") + F.col("more")).alias("takes"))


def dealt(rows: DataFrame, takes: DataFrame) -> DataFrame:
    """`times` of each row: its text's takes, dealt evenly to the text's n rows of these sources."""
    key = ["text_key", "size", "sources"]
    spark = rows.sparkSession
    rows = saved(met(rows, takes.withColumn("_n", F.col("n")), key))
    even, odd = F.expr("takes div n"), F.expr("takes % n")
    split = rows.where(odd > 0)
    order = ("id_hash", "row_key")
    split = saved(split.withColumn("id_hash", F.xxhash64("doc_id")).repartitionByRange(partitions(spark), *key, *order).withColumn("part", F.spark_partition_id()))
    ahead = split.groupBy(*key, "part").agg(F.count("*").alias("k"))
    ahead = ahead.withColumn("ahead", F.coalesce(F.sum("k").over(W.partitionBy(*key).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    nth = F.row_number().over(W.partitionBy("part", *key).orderBy(*order))
    split = split.join(ahead.drop("k"), ["part", *key]).withColumn("times", even + F.when(F.col("ahead") + nth <= odd, 1).otherwise(0))
    return split.select(*rows.columns, "times").unionByName(rows.where(odd == 0).withColumn("times", even))


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, copies: int = 2, seed: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and the columns to keep of each row.

    `source_col` holds a source or an array of sources; the weights go to the sources by code
    point, null last, over and over. A document's source_size and target are those of its first source.
    """
    spark = docs.sparkSession
    many = docs.schema[source_col].dataType.typeName() == "array"
    names = F.array_sort(F.array_distinct(source_col)) if many else F.array(F.col(source_col).cast("string"))
    names = F.when(F.coalesce(F.size(names), F.lit(0)) > 0, names).otherwise(F.array(F.lit(None).cast("string")))
    # a source's key: its name after "=", nothing for the null source
    sources = F.transform(names, lambda x: F.coalesce(F.concat(F.lit("="), x), F.lit("")))
    kept = [F.struct(*keep).alias("_kept")] if keep else []
    rows = saved(docs.select(F.col(id_col).alias("doc_id"), sources.alias("sources"), word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("text_key"), F.monotonically_increasing_id().alias("row_key"), *kept))
    per = rows.groupBy("sources").agg(F.sum("size").alias("size"))
    first = F.col("pos") == 0
    sizes = per.select("size", F.posexplode("sources").alias("pos", "source")).groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.when(first, F.col("size")).otherwise(0)).alias("words"))
    named = source_targets(sizes, weights, share, copies)
    texts = rows.where("size > 0").groupBy("text_key", "size", "sources").agg(F.count("*").alias("n")).groupBy("text_key", "size").agg(F.sort_array(F.collect_list(F.struct("sources", "n"))).alias("pattern"))
    texts = saved(texts.withColumn("kind", F.xxhash64("pattern")))
    spread = (F.size("pattern") > 1) | (F.size(F.col("pattern")[0]["sources"]) > 1)
    shared = texts.where(spread)
    ranked = shared.groupBy("kind").agg(F.first("pattern").alias("pattern"), F.sum("size").alias("words"), F.count("*").alias("n"))
    several = F.exists("pattern", lambda m: F.size(m["sources"]) > 1)
    kinds = ranked.where(~several).orderBy(F.desc("words"), "kind").limit(MOST_PATTERNS).collect() + (ranked.where(several).collect() if many else [])
    in_flow = spark.createDataFrame([(k["kind"],) for k in kinds], "kind bigint")
    alone = texts.where(~spread).unionByName(shared.join(in_flow, "kind", "left_anti"))
    own = alone.select("text_key", "size", F.explode("pattern").alias("m")).select("text_key", "size", "m.sources", "m.n", F.col("m.sources")[0].alias("source"))
    spent, pieces = None, []
    if kinds:
        inside = sorted({s for k in kinds for m in k["pattern"] for s in m["sources"]})
        asked = spark.createDataFrame([(s,) for s in inside], "source string")
        curve = F.array(*[F.sum(F.col("size") * F.least(F.lit(1 << i), F.col("n") * copies)) for i in range(LEVELS)])
        curves = {r["source"]: r["curve"] for r in own.groupBy("source").agg(curve.alias("curve")).join(asked, "source").collect()}
        quota = {r["source"]: r["quota"] for r in named.join(asked, "source").collect()}
        at = {s: i for i, s in enumerate(inside)}
        routed = min_cost_flow([(k["words"], [(m["n"], [at[s] for s in m["sources"]]) for m in k["pattern"]]) for k in kinds], [quota[s] for s in inside], [curves.get(s) or [0] * LEVELS for s in inside], copies)
        got = saved(shared_takes(shared, kinds, routed, seed))
        pieces.append(got)
        # what the flow's rows really take counts; rows of several sources count as the flow dealt them
        single = got.where(F.size("sources") == 1).groupBy(F.col("sources")[0].alias("source")).agg(F.sum(F.col("size") * F.col("takes")).alias("spent"))
        dealt_out = [0] * len(inside)
        for k, members in zip(kinds, routed, strict=True):
            for m, gives in zip(k["pattern"], members, strict=True):
                if len(m["sources"]) > 1:
                    for s, amount in gives.items():
                        dealt_out[s] += amount
        spent = single.unionByName(spark.createDataFrame([(s, dealt_out[i]) for s, i in at.items()], "source string, spent bigint")).groupBy("source").agg(F.sum("spent").alias("spent"))
    quotas = named.select("source", F.col("quota").alias("left")) if spent is None else named.join(spent, "source", "left").select("source", F.greatest(F.lit(0), F.col("quota") - F.coalesce("spent", F.lit(0))).alias("left"))
    pieces.append(own_takes(saved(own), quotas, copies, seed))
    takes = pieces[0] if len(pieces) == 1 else pieces[0].unionByName(pieces[1])
    out = dealt(rows.where("size > 0"), takes)
    columns = ["doc_id", "sources", "size", *(["_kept"] if keep else []), "times"]
    out = out.select(*columns).unionByName(rows.where("size = 0").withColumn("times", F.lit(0).cast("bigint")).select(*columns))
    facts = named.select("source", "source_size", "target")
    out = out.withColumn("source", F.col("sources")[0])
    out = out.join(F.broadcast(facts), "source") if named.count() <= MOST_PATTERNS else met(out, facts.join(out.groupBy("source").agg(F.count("*").alias("_n")), "source"), ["source"])
    name = F.when(F.col("source") != "", F.substr("source", F.lit(2)))
    return out.select("doc_id", name.alias("source"), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), *(["_kept.*"] if keep else []))
