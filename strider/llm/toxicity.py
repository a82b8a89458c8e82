"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; other documents, whatever their label, are
unlabelled text, in which a share `prior` is toxic too. The risk of a classifier g is

    prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)])

with the logistic loss l; where the second term goes below zero, the step goes the other
way (Kiryo et al., "Positive-Unlabeled Learning with Non-Negative Risk Estimator", 2017).

Features are words and their 4, 5 and 6-byte beginnings, present or not, among letters
and bytes from 128 up, with A-Z in lower case. Of those that positives have, the ones
that positives have more often than unlabelled text by `ratio` (with half a document
added on both sides) are kept, the most telling first, at most `kept`. How telling a
feature is, is the number of positives that have it times the logarithm of that ratio; it
is counted and ordered by Spark over all features of the sample, rare or common, and only
the kept ones reach the driver. The classifier is linear and trained in numpy on the
driver from feature numbers of the sample.

Bounds, all parameters: at most `positives` confirmed toxic documents and `unlabelled`
others are learned from, all of them rows of `labels` in the training folds, those with
the lowest hash of their id (the label of an unlabelled one is not looked at). Every whole
text is scored. The prior is the toxic share of labelled training rows. Id, source, language
and labels are no inputs of a score.

Null text counts as empty. Rows with a null id or label are not learned from; repeated
labels of one id count once (the higher). One positive is enough to learn from; without
any every score is 0. If no feature tells positives from the rest, every score is the
prior. Ties among ids cannot be, ties among telling features go by their bytes. Repeated
rows give repeated results. Other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, text_column
from .quality import held_out

POSITIVES = 6_000
UNLABELLED = 12_000
KEPT = 2_000
RATIO = 2.5
STEPS = 400
_STEMS = (4, 5, 6)

_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(raw: bytes) -> set[bytes]:
    return set(raw.translate(_LETTERS).split())


def features_of(raw: bytes) -> set[bytes]:
    """Words, and beginnings marked by a star."""
    words = words_of(raw)
    return words.union(*({w[:n] + b"*" for w in words if len(w) >= n} for n in _STEMS))


@dataclass
class Model:
    index: dict[bytes, int]
    weights: np.ndarray
    #: None: nothing was learned, every score is 0
    bias: float | None

    def numbers(self, raw: bytes) -> list[int]:
        """Numbers of the kept features that a text has."""
        index, found = self.index, set()
        for w in words_of(raw):
            for f in (w, w[:4] + b"*", w[:5] + b"*", w[:6] + b"*"):
                k = index.get(f)
                if k is not None and (len(f) < 5 or f[-1:] != b"*" or len(w) >= len(f) - 1):
                    found.add(k)
        return sorted(found)

    def score(self, raw: bytes) -> float:
        if self.bias is None:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self.weights[self.numbers(raw)].sum() + self.bias, -40, 40))))


class Rows:
    """Rows of feature numbers, as one flat list."""

    def __init__(self, rows: list[list[int]], width: int):
        self.n, self.width = len(rows), width
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.col = np.fromiter((k for r in rows for k in r), np.int64, len(self.row))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n)

    def across(self, d: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, d[self.row], self.width)


def _sigmoid(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -40, 40)))


def risk(p: Rows, u: Rows, prior: float, w: np.ndarray, b: float) -> tuple[float, float]:
    """The two terms of the risk: of positives as positives, and of unlabelled text as negative without the share of positives (before it is cut at zero)."""
    loss = lambda g: np.logaddexp(0, -g).mean()
    gp, gu = p.times(w) + b, u.times(w) + b
    return prior * loss(gp), loss(-gu) - prior * loss(-gp)


def gradient(p: Rows, u: Rows, prior: float, w: np.ndarray, b: float) -> np.ndarray:
    """Of the risk by weights and bias; where its second term is below zero, the way back up of that term."""
    gp, gu = p.times(w) + b, u.times(w) + b
    rest = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
    back, away = -prior * _sigmoid(gp) / p.n, _sigmoid(gu) / u.n
    dp, du = (back - prior * _sigmoid(-gp) / p.n, away) if rest >= 0 else (-back, -away)
    return np.append(p.across(dp) + u.across(du), dp.sum() + du.sum())


def train(p: Rows, u: Rows, prior: float, steps: int = STEPS, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that lower the non-negative risk, by Adam over whole batches."""
    x = np.append(np.zeros(p.width), -1.0)
    m, v = np.zeros(len(x)), np.zeros(len(x))
    for t in range(1, steps + 1):
        grad = gradient(p, u, prior, x[:-1], x[-1]) + decay * np.append(x[:-1], 0)
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        x = x - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x[:-1], float(x[-1])


def fit(df: DataFrame, labels: DataFrame, label_col: str = "toxic", folds: int = 3, held: int = 1, id_col: str = "doc_id", text_col: str = "text", positives: int = POSITIVES, unlabelled: int = UNLABELLED, kept: int = KEPT, ratio: float = RATIO) -> Model:
    """A model from the positives among labelled rows whose fold is not `held`, and unlabelled text of the same folds."""
    own = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL")
    own = own.groupBy("doc_id").agg(F.max("y").alias("y")).where(held_out("doc_id", folds) != held)
    prior = own.agg(F.avg("y")).first()[0]
    nothing = Model({}, np.zeros(0), None)
    if not prior:
        return nothing
    order = F.xxhash64("doc_id"), "doc_id"
    p = own.where("y > 0").orderBy(*order).limit(positives).select("doc_id", F.lit(1).alias("p"))
    u = own.orderBy(*order).limit(unlabelled).select("doc_id", F.lit(0).alias("p"))
    # `marks` has at most positives + unlabelled rows of two numbers
    marks = save(p.unionByName(u), "toxic-ids")
    text = df.select(F.col(id_col).cast("long").alias("doc_id"), text_column(text_col).cast("binary").alias("raw"))
    rows = save(text.join(F.broadcast(marks), "doc_id").select("p", "raw"), "toxic-rows")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter(), Counter()
        for batch in batches:
            for p, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[p].update(features_of(raw))
        names = list(seen[0] | seen[1])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([seen[1][f] for f in names], pa.int64()), pa.array([seen[0][f] for f in names], pa.int64())], names=["f", "in_p", "in_u"])

    sizes = {r[0]: r[1] for r in rows.groupBy("p").count().collect()}
    n_p, n_u = sizes.get(1, 0), sizes.get(0, 0)
    if not n_p or not n_u:
        return nothing
    counted = rows.mapInArrow(count, "f binary, in_p long, in_u long").groupBy("f").agg(F.sum("in_p").alias("in_p"), F.sum("in_u").alias("in_u")).where("in_p > 0")
    times = (F.col("in_p") + 0.5) / (n_p + 1) / ((F.col("in_u") + 0.5) / (n_u + 1))
    telling = counted.where(times >= ratio).orderBy(F.desc(F.round(F.col("in_p") * F.log(times), 9)), "f").limit(kept).select("f")
    model = Model({bytes(r[0]): k for k, r in enumerate(telling.collect())}, np.zeros(0), float(np.log(prior / (1 - prior))) if prior < 1 else 40.0)
    if not model.index:
        return model

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.numbers(x) for x in batch.column(1).to_pylist()], pa.list_(pa.int32()))], names=["p", "k"])

    sample = rows.mapInArrow(numbers, "p int, k array<int>").collect()
    side = lambda p: Rows([r[1] for r in sample if r[0] == p], len(model.index))
    model.weights, model.bias = train(side(1), side(0), min(prior, 0.95))
    return model


def scores(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and `score` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(x) for x in batch.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_column(text_col).cast("binary").alias("raw")).mapInArrow(run, "doc_id long, score double")
