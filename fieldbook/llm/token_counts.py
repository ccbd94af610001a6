"""Token counts by rank-synchronous merging.

The vocabulary's pattern cuts texts into pre-tokens. Those that this Python worker has not met yet are
held together as one ragged array and merged rank by rank (`bpe.Merges`); others come from a cache of
bounded size, so that memory does not follow the input. Special tokens inside a text count one, as
is the library's default.

Null and empty texts have no tokens. Repeated rows each give a row. An empty table gives none. Texts
of any length are counted whole: pieces are merged in slices of `SLICE` pre-tokens.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldbook.llm.bpe import merges
from fieldbook.llm.common import arrow_map

CACHED, SLICE = 800_000, 100_000
#: Fixed value: the pattern that splits text before the merges.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: The same for text of ASCII and Latin-1 letters, which the standard library splits faster.
PLAIN = re.compile(r"[\n -~À-ÖØ-öø-ÿ]*")
PLAIN_PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\s+(?!\S)|\s+")


class Counter:
    """Counts the tokens of texts; keeps what it learned about pre-tokens."""

    def __init__(self, path: str) -> None:
        self.table = merges(path)
        with open(path, encoding="utf-8") as f:
            special = [x["content"] for x in json.load(f)["added_tokens"] if x["special"]]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.tokens: dict[str, int] = {}

    def plain(self, texts: list[str]) -> list[int]:
        """Counts of texts without special tokens."""
        known = self.tokens
        if len(known) > CACHED:
            known.clear()
        cut = [(PLAIN_PATTERN if PLAIN.fullmatch(t) else PATTERN).findall(t) for t in texts]
        new: set[str] = set()
        for ts in cut:
            new.update(ts)
        missing = list(new.difference(known))
        for i in range(0, len(missing), SLICE):
            part = missing[i : i + SLICE]
            known.update(zip(part, self.table.count([t.encode() for t in part]).tolist(), strict=True))
        get = known.__getitem__
        return [sum(map(get, ts)) for ts in cut]

    def count(self, texts: list[str]) -> list[int]:
        if self.special is None or not any(self.special.search(t) for t in texts):
            return self.plain(texts)
        out = []
        for t in texts:
            parts = self.special.split(t)
            out.append(len(parts) - 1 + sum(self.plain(parts)))
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row; `vocabulary` is the path of a byte-level BPE file on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        c = counter(vocabulary)
        for b in batches:
            texts, size = [x or "" for x in b.column(1).to_pylist()], 0
            counts: list[int] = []
            group: list[str] = []
            for i, t in enumerate(texts):
                group.append(t)
                size += len(t)
                if size > 1_000_000 or i == len(texts) - 1:
                    counts += c.count(group)
                    group, size = [], 0
            yield {"doc_id": b.column(0), "n_bytes": [len(t.encode()) for t in texts], "n_tokens": counts, "over_limit": [n > limit for n in counts]}

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
