"""Quality rules with host verdicts.

Each document has counts and base rules (too short; too much of it in repeated word triples) and two
soft rules (symbols, repeated lines). By host (`source`), documents and those that fail any rule are
counted, in two steps as sums combine before the shuffle. A beta prior, fitted to the hosts' rates
by moments, shrinks each host's rate: (failures + a) / (documents + a + b). The verdict of a host:

* "reject" if the rate less `z` posterior deviations is above `reject_above`: none of its documents stay;
* "strict" if the rate is above `strict_above`: documents that fail a soft rule go, too;
* "trust" otherwise: documents go by the base rules alone.

The hosts' verdicts are a narrow table that goes to the documents; rows of a hot host stay where they are.

Null text: no words, so the base rules fail it. A null host is a host of its own. Rows with equal
or null ids are judged each for itself. An empty table gives no rows. Texts of any length count whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from fieldbook.llm.common import arrow_map, met, saved
from fieldbook.llm.ngram_join import M1, M2, mix

#: So many hosts' verdicts (some 20 MB) go to every task; of more only the hot ones do, and other rows meet theirs by a shuffle.
SMALL = 500_000
SYMBOLS = "#*$%&|<>"
SPACE = "\t\n\x0b\x0c\r "


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words inside windows of `width` words that stand twice or more in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    window = np.zeros(n, np.uint64)
    for i in range(width):
        window = mix(window * M1 + h[i : i + n] + M2)
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = np.zeros(len(words), bool)
    for i in range(width):
        inside[i : i + n] |= twice
    return int(inside.sum())


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def measured(docs: DataFrame, id_col: str, text_col: str, host_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, host, the measures and the columns to keep of each row."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            rows = [(*measures(t), 1 + (t or "").count("\n")) for t in (x.as_py() for x in b.column(2))]
            yield {"doc_id": b.column(0), "host": b.column(1)} | {k: [r[i] for r in rows] for i, k in enumerate(names)} | {f"_k{i}": b.column(3 + i) for i in range(len(keep))}

    kinds = {c: docs.schema[c].dataType.simpleString() for c in (id_col, *keep)}
    columns = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)])
    return arrow_map(columns, run, f"doc_id {kinds[id_col]}, host string, " + ", ".join([f"{k} bigint" for k in names] + [f"_k{i} {kinds[c]}" for i, c in enumerate(keep)]))


def base_failed(min_words: int, repeat_percent: int) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def soft_failed(symbol_percent: int, line_percent: int) -> Column:
    return (100 * F.col("n_symbols") > symbol_percent * F.col("word_chars")) | (100 * F.col("n_dup_lines") > line_percent * F.col("n_lines"))


def hosts(marked: DataFrame, *, reject_above: float = 0.6, strict_above: float = 0.02, z: float = 2.0) -> DataFrame:
    """host, n, failures, rate, verdict, from rows with `host`, `base_failed` and `soft_failed`."""
    table = saved(marked.groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("base_failed") | F.col("soft_failed")).alias("failures")))
    raw = table.withColumn("r", F.col("failures") / F.col("n"))
    m, v, inside = raw.agg(F.sum("failures") / F.sum("n"), F.sum(F.col("n") * F.col("r") * F.col("r")) / F.sum("n"), F.count("*") / F.sum(1 / F.col("n"))).first() or (None,) * 3
    m = min(max(m or 0.0, 1e-6), 1 - 1e-6)
    # the rates' variance less what counting alone gives (about m (1 - m) / n at the hosts' harmonic mean n)
    spread = max((v or 0.0) - m * m - m * (1 - m) / max(inside or 1.0, 1.0), 1e-6)
    weight = min(max(m * (1 - m) / spread - 1, 2.0), 1e6)
    a, b = F.lit(m * weight), F.lit((1 - m) * weight)
    total = F.col("n") + a + b
    rate = (F.col("failures") + a) / total
    low = rate - z * F.sqrt(rate * (1 - rate) / (total + 1))
    verdict = F.when(low > reject_above, "reject").when(rate > strict_above, "strict").otherwise("trust")
    return table.select("host", "n", "failures", rate.alias("rate"), verdict.alias("verdict"))


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_words: int = 50, repeat_percent: int = 50, symbol_percent: int = 10, line_percent: int = 50, keep: tuple[str, ...] = (), **limits: float) -> DataFrame:
    """doc_id, host, the measures, base_failed, soft_failed, verdict (of the host), kept and, in the struct `row`, the columns to keep of each row.

    With columns to keep, which may hold the texts, rows are measured twice, once for the hosts; without, they are saved between.
    """

    def marks(*more: str) -> DataFrame:
        return measured(docs, id_col, text_col, host_col, more).withColumn("base_failed", base_failed(min_words, repeat_percent)).withColumn("soft_failed", soft_failed(symbol_percent, line_percent))

    marked = marks() if keep else saved(marks())
    name = F.coalesce(F.concat(F.lit("="), "host"), F.lit(""))  # no name: the null host
    verdicts = saved(hosts(marked, **limits).select(name.alias("_host"), "verdict", F.col("n").alias("_n")))
    out = (marks(*keep) if keep else marked).withColumn("_host", name)
    out = out.join(F.broadcast(verdicts), "_host") if verdicts.count() <= SMALL else met(out, verdicts, ["_host"])
    good = ~F.col("base_failed") & (F.col("verdict") != "reject") & ((F.col("verdict") == "trust") | ~F.col("soft_failed"))
    kept = [F.struct(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)]).alias("row")] if keep else []
    return out.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "base_failed", "soft_failed", "verdict", good.alias("kept"), *kept)
