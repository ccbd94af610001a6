"""Byte-pair merging over ragged numpy arrays, all sequences of a batch at once."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

NEVER = np.iinfo(np.int64).max


def byte_characters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    out = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [out[b] for b in range(256)]


class Merges:
    """The merge table of a byte-level BPE file: pair of symbols -> rank and merged symbol, sorted by pair."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.width = max(vocab.values()) + 1
        key = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.key, self.rank = key[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        character, end = byte_characters(), model.get("end_of_word_suffix") or ""
        self.byte = np.array([vocab[c] for c in character], np.int64)
        self.last = np.array([vocab[c + end] for c in character], np.int64)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of each (non-empty) word when no pair of it can merge any more, in a row, and how many each has.

        Each round finds every word's lowest-ranked pair and merges all its places at once, left to
        right where places overlap. Since a merged symbol comes only from its own merge, this gives
        what merging one pair at a time gives. Words without a pair leave the arrays.
        """
        size = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbol = self.byte[raw]
        symbol[np.cumsum(size) - 1] = self.last[raw[np.cumsum(size) - 1]]
        word = np.repeat(np.arange(len(words)), size)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[start, len(symbol)])
            pair = symbol[:-1] * self.width + symbol[1:]
            at = np.minimum(np.searchsorted(self.key, pair), len(self.key) - 1)
            rank = np.full(len(symbol), NEVER)
            hit = (self.key[at] == pair) & (word[1:] == word[:-1])
            rank[:-1][hit] = self.rank[at[hit]]
            lowest = np.minimum.reduceat(rank, start)
            over = np.repeat(lowest == NEVER, size)
            done.append((word[over], symbol[over]))
            place = np.flatnonzero((rank == np.repeat(lowest, size)) & ~over)
            run = np.r_[True, np.diff(place) > 1]  # places next to each other overlap: take each second one
            first = place[np.maximum.accumulate(np.where(run[: len(place)], np.arange(len(place)), 0))]
            place = place[(place - first) % 2 == 0]
            symbol[place] = self.merged[at[place]]
            over[place + 1] = True
            symbol, word = symbol[~over], word[~over]
        word, symbol = (np.concatenate(x) for x in zip(*done, strict=True))
        return symbol[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def count(self, words: list[bytes]) -> np.ndarray:
        return self.merge(words)[1]


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges(path)
