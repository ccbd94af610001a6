"""Best-fit packing of tokenized documents by the sum-of-squares rule.

`pieces` tokenizes each text, adds the end id and cuts only what is longer than a sequence.
`sum_of_squares` places lengths one by one: of all ways to place a length (a new bin, or an open bin
with some residual gap), it takes the one after which the sum over gaps of (open bins with that
gap) squared is smallest. A length that leaves no gap closes its bin, which lowers the sum most, so
perfect fits come first; ties go to the smaller gap. `pack` deals the pieces by a hash of their row number into blocks of
about `block` pieces, which are packed independently: a block leaves a few bins part-full, so the
loss against one big block is a few sequences per `block` pieces, whatever the size of the input.

Null and empty texts become one piece that holds the end id only. Repeated rows are packed each for
itself. An empty table gives no pieces. Texts of any length are cut whole.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldbook.llm.bpe import merges
from fieldbook.llm.common import arrow_map, saved

CACHED = 450_000
#: ASCII and Latin-1 letters: lower-casing goes letter by letter, normal forms are as they stand.
PLAIN = re.compile(r"[\n -~À-ÖØ-öø-ÿ]*")
#: Fixed value: the vocabulary's pattern, for such text in lower case.
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes, with bounded caches of words and pre-tokens.

    The vocabulary drops white space, and merges stay inside a pre-token. Texts with other characters,
    or with special tokens in them, go to the library whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a core to each task
        from tokenizers import Tokenizer

        self.library, self.table = Tokenizer.from_file(path), merges(path)
        special = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def ask(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        known, cut = self.parts, [PARTS.findall(w.lower()) for w in words]
        new = list({p for ps in cut for p in ps if p not in known})
        if new:
            symbols, n = self.table.merge([p.encode() for p in new])
            flat, at = symbols.astype("<u4").tobytes(), np.r_[0, np.cumsum(n) * 4].tolist()
            known.update((p, flat[i:j]) for p, i, j in zip(new, at, at[1:], strict=False))
        self.words.update((w, b"".join([known[p] for p in ps])) for w, ps in zip(words, cut, strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        for known in (self.words, self.parts):
            if len(known) > CACHED:
                known.clear()
        odd = [not PLAIN.fullmatch(t) or self.special is not None and self.special.search(t) for t in texts]
        cut = [[] if o else t.replace("\n", " ").split(" ") for t, o in zip(texts, odd, strict=True)]
        get = self.words.get
        found = [list(map(get, ws)) for ws in cut]
        new = list({w for ws, fs in zip(cut, found, strict=True) if None in fs for w, f in zip(ws, fs, strict=True) if f is None})
        if new:
            self.learn(new)
            found = [[get(w) if f is None else f for w, f in zip(ws, fs, strict=True)] if None in fs else fs for ws, fs in zip(cut, found, strict=True)]
        return [self.ask(t) if o else b"".join(fs) for t, o, fs in zip(texts, odd, found, strict=True)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every text; `vocabulary` is the path of a tokenizers file on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        e, end, width = encoder(vocabulary), np.array([end_id], "<u4").tobytes(), capacity * 4
        for b in batches:
            ids, texts = b.column(0).to_pylist(), [x or "" for x in b.column(1).to_pylist()]
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            group: list[str] = []
            size = done = 0
            for i, t in enumerate(texts):
                group.append(t)
                size += len(t)
                if size > 1_000_000 or i == len(texts) - 1:
                    for tokens in e.encode(group):
                        tokens += end
                        for k, at in enumerate(range(0, len(tokens), width)):
                            part = tokens[at : at + width]
                            for name, v in zip(out, (ids[done], k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                                out[name].append(v)
                        done += 1
                    group, size = [], 0
            yield out

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, placed in the order given."""
    open_ = np.zeros(capacity + 1, np.int64)  # bins by residual gap; the gap 0 stays 0 here, as full bins don't count
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    n = 0
    for i, s in enumerate(lengths.tolist()):
        left = capacity - s
        if left == 0:
            where[i], n = n, n + 1
            continue
        # change of the sum when a bin of gap s..capacity takes it: -2 open[gap] + 1, +2 open[gap - s] + 1
        after = open_[: capacity - s + 1]
        change = 2 * (after - open_[s:]) + 2
        change[0] = 1 - 2 * open_[s]
        change[open_[s:] == 0] = 1 << 40
        k = int(change.argmin())
        if change[k] <= 2 * open_[left] + 1:
            b = bins[s + k].pop()
            open_[s + k] -= 1
            offset[i] = capacity - s - k
        else:
            b, k, n = n, left, n + 1
        where[i] = b
        if k:
            bins[k].append(b)
            open_[k] += 1
    return where, offset


def pack(parts: DataFrame, *, capacity: int = 2048, block: int = 25_000, seed: int = 0) -> DataFrame:
    """The pieces with sequence_id and offset. Give it saved parts: they are read twice, and their numbers have to stay the same."""
    n = max(1, -(-parts.count() // block))
    # by the row's number, as equal pieces would all share a block by content
    dealt = parts.withColumn("_block", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), F.lit(n)).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        where, offset = sum_of_squares(pdf["length"].to_numpy(), capacity)
        pdf["sequence_id"] = pdf["_block"].to_numpy().astype(np.int64) * (1 << 32) + where
        pdf["offset"] = offset
        return pdf.drop(columns="_block")

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema)
    return dealt.groupBy("_block").applyInPandas(run, f"{fields}, sequence_id bigint, offset bigint")


def best_fit_packing(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of all documents with the sequence and the place in it that each got."""
    return pack(saved(pieces(docs, vocabulary, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id)), capacity=capacity)
