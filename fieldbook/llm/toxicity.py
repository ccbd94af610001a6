"""Classifier chains for toxicity categories.

Categories are labelled columns, or derived from one: "severe" of "toxic" are the toxic rows that hold more of the words that
tell toxic rows than their median row does. They are predicted one after the other by linear models (logistic regression over hashed words and
word stems). Each model also sees the log-odds that the earlier categories got. In training those come out of
fold: a row's earlier probabilities are from models that did not see the row, so a later model
does not learn to trust them more than it may. The models are fitted on at most `sample` labelled rows, by
lowest hash of the id, a documented bound: what reaches the driver are the hashed features of so many rows.
Scoring covers all rows, in Arrow batches, with the weights of `dims` features for each category.

Null and empty texts have no features and get the intercepts. Null labels count as 0; labels of ids without
documents, or of null ids, are unused. If a category has no positive or no negative row its probability is
the constant rate. Repeated rows each give a row; repeated labels of an id count as one, by their
maximum. An empty table gives no rows. Texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from fieldbook.llm.common import arrow_map

DIMS, STEM = 1 << 17, 4
WORDS = re.compile(r"[^\W\d_]+")


def features(text: str | None, dims: int = DIMS) -> np.ndarray:
    """Sorted numbers of the features present: each word, and the stem of each longer word."""
    words = set(WORDS.findall((text or "").lower()))
    stems = {"<" + w[:STEM] for w in words if len(w) > STEM} | {"<" + w[: STEM + 1] for w in words if len(w) > STEM + 1}
    return np.unique(np.fromiter(map(xxh3_64_intdigest, (w.encode() for w in words | stems)), np.uint64, len(words) + len(stems)) % np.uint64(dims)).astype(np.int64)


@dataclass
class Linear:
    """Log-odds = intercept + the present features' weights + weights of the earlier categories' log-odds."""

    intercept: float
    weights: np.ndarray
    earlier: np.ndarray

    def logit(self, rows: list[np.ndarray], before: np.ndarray) -> np.ndarray:
        own = np.array([self.weights[r].sum() for r in rows])
        return self.intercept + own + before @ self.earlier


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def telling(flat: np.ndarray, y: np.ndarray, at: np.ndarray, rate: float, dims: int, least: float = 4.0) -> np.ndarray:
    """Numbers of the features that stand in positive rows far more, or less, often than chance has it (in deviations)."""
    n, pos = np.bincount(flat, minlength=dims), np.bincount(flat, y[at], dims)
    z = (pos - n * rate) / np.sqrt(np.maximum(n * rate * (1 - rate), 1e-9))
    return np.flatnonzero((n > 4) & (np.abs(z) > least))


def fit(rows: list[np.ndarray], before: np.ndarray, y: np.ndarray, dims: int = DIMS, rounds: int = 300, penalty: float = 1e-3) -> Linear:
    """Logistic regression with a ridge over the features that tell something, by gradient steps scaled by their past size."""
    rate = min(max(y.mean(), 1e-4), 1 - 1e-4) if len(y) else 1e-4
    intercept, k = float(np.log(rate / (1 - rate))), before.shape[1]
    if not len(y) or y.min() == y.max():
        return Linear(intercept, np.zeros(dims), np.zeros(k))
    flat, at = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    chosen = telling(flat, y, at, rate, dims)
    place = np.full(dims, -1)
    place[chosen] = np.arange(len(chosen))
    keep = place[flat] >= 0
    flat, at, d = place[flat[keep]], at[keep], len(chosen)
    w = np.zeros(d + k + 1)
    w[-1] = intercept
    memory, scale = np.zeros_like(w), np.full_like(w, 1e-8)
    for _ in range(rounds):
        z = w[-1] + np.bincount(at, w[flat], len(rows)) + before @ w[d : d + k]
        g = (sigmoid(z) - y) / len(y)
        grad = np.r_[np.bincount(flat, g[at], d), before.T @ g, g.sum()]
        grad[:-1] += penalty * w[:-1]
        scale = 0.9 * scale + 0.1 * grad * grad
        memory = 0.9 * memory + 0.1 * grad
        w -= 0.05 * memory / (np.sqrt(scale) + 1e-8)
    weights = np.zeros(dims)
    weights[chosen] = w[:d]
    return Linear(float(w[-1]), weights, w[d : d + k])


def severe(rows: list[np.ndarray], y: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """Which of the positive rows hold more of the features that stand in positive rows too often than their median row does."""
    if not len(y) or not y.any():
        return np.zeros(len(y), int)
    flat, at = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    known = np.zeros(dims, bool)
    known[telling(flat, y, at, min(max(y.mean(), 1e-4), 1 - 1e-4), dims)] = True
    known &= np.bincount(flat, y[at], dims) > y.mean() * np.bincount(flat, minlength=dims)
    held = np.bincount(at, known[flat], len(rows))
    return ((y > 0) & (held > np.median(held[y > 0]))).astype(int)


@dataclass
class Chain:
    """Models of the categories, in their order, and for each the probability from which a row counts as positive."""

    names: list[str]
    models: list[Linear]
    limits: list[float]

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        """Probabilities: a row for each text, a column for each category."""
        before = np.zeros((len(rows), 0))
        for m in self.models:
            before = np.c_[before, np.clip(m.logit(rows, before), -8, 8)]
        return sigmoid(before)


def best_limit(p: np.ndarray, y: np.ndarray) -> float:
    """The limit with the highest F1, in the middle of the gap that it stands in."""
    if not len(y) or y.min() == y.max():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    i = int(f1.argmax())
    return float(np.clip((p[order[i]] + (p[order[i + 1]] if i + 1 < len(p) else 0.0)) / 2, 0.05, 0.95))


def train(rows: list[np.ndarray], labels: np.ndarray, names: list[str], folds: int = 3, dims: int = DIMS, derived: dict[int, int] | None = None) -> Chain:
    """derived: the number of a category that is the severe rows of another one. A fold's model derives it from the rows that it is fitted on."""
    derived = derived or {}
    fold = np.random.default_rng(0).permutation(len(rows)) % folds
    before = np.zeros((len(rows), 0))
    models, limits = [], []
    for k in range(len(names)):
        y, out = labels[:, k].astype(float), np.zeros(len(rows))
        for f in range(folds):
            inside, outside = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if len(outside):
                own = [rows[i] for i in inside]
                m = fit(own, before[inside], severe(own, labels[inside, derived[k]], dims).astype(float) if k in derived else y[inside], dims)
                out[outside] = m.logit([rows[i] for i in outside], before[outside])
        out = np.clip(out, -8, 8)
        models.append(fit(rows, before, y, dims))
        limits.append(best_limit(sigmoid(out), y))
        before = np.c_[before, out]
    return Chain(list(names), models, limits)


def training_rows(docs: DataFrame, labels: DataFrame, names: list[str], id_col: str, text_col: str, label_id: str, sample: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and labels of at most `sample` labelled documents, those with the lowest hashes of their ids; no other texts are read into features."""
    one = labels.where(F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("_id")).agg(*[F.max(F.coalesce(F.col(c).cast("int"), F.lit(0))).alias(f"_l{i}") for i, c in enumerate(names)])
    few = one.orderBy(F.xxhash64("_id"), "_id").limit(sample)  # a bounded table, so it may be broadcast
    own = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")).join(F.broadcast(few), F.col("_doc") == F.col("_id"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            yield {"id": b.column(0), "x": [features(t.as_py()).astype("<u4").tobytes() for t in b.column(1)]} | {f"_l{i}": b.column(2 + i) for i in range(len(names))}

    out = arrow_map(own.select("_doc", "_text", *[f"_l{i}" for i in range(len(names))]), run, f"id {kind}, x binary" + "".join(f", _l{i} int" for i in range(len(names))))
    got = sorted(out.groupBy("id").agg(F.min(F.struct("x", *[f"_l{i}" for i in range(len(names))])).alias("r")).select("id", "r.*").collect(), key=lambda r: r["id"])
    return [np.frombuffer(r["x"], "<u4").astype(np.int64) for r in got], np.array([[r[f"_l{i}"] for i in range(len(names))] for r in got], int).reshape(len(got), len(names))


def toxicity_chain(docs: DataFrame, labels: DataFrame, names: tuple[str, ...] = ("quality", "severe", "toxic"), *, derived: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", sample: int = 4000) -> DataFrame:
    """doc_id, p_<category> for each, toxic (the last category's probability reaches its limit) of each row.

    `derived` names the categories that are the severe rows of another one.
    """
    derived = {"severe": "toxic"} if derived is None else derived
    given = [n for n in names if n not in derived]
    rows, y = training_rows(docs, labels, given, id_col, text_col, label_id, sample)
    table = np.column_stack([severe(rows, y[:, given.index(derived[n])]) if n in derived else y[:, given.index(n)] for n in names]) if len(rows) else np.zeros((0, len(names)), int)
    chain = train(rows, table, list(names), derived={names.index(n): names.index(of) for n, of in derived.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            p = chain.score([features(t.as_py()) for t in b.column(1)])
            yield {"doc_id": b.column(0), "toxic": p[:, -1] >= chain.limits[-1]} | {f"p_{n}": p[:, i] for i, n in enumerate(names)}

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, " + "".join(f"`p_{n}` double, " for n in names) + "toxic boolean")
