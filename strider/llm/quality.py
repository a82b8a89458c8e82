"""Quality classifier: random Fourier features, ridge by normal equations, isotonic calibration.

1. A document becomes statistics of its whole text: lengths, shares of byte classes,
   repetition of words and lines.
2. cos(Wx + b) with fixed random W and b approximates a Gaussian kernel over the
   standardised statistics.
3. Each partition of the training rows sums its part of Z'Z and Z'y; the driver adds
   the parts (their number and size are fixed) and solves the ridge system.
4. Pool-adjacent-violators on one fold of the training rows, which the ridge does not
   see, maps its output to a probability. Between block centres it is interpolated; a
   small logistic term keeps the order inside a block.

Labels come from at most `sample_rows` labelled documents (those with the lowest hash
of their id), a documented bound; every document is scored. Id, source, language and
labels are no inputs of a score.

Null text counts as empty. Rows with a null label or id are not learned from; repeated
labels of one id count once (the higher). Without any training row every score is 0.5.
Repeated rows give repeated results. Other columns are passed on by `with_scores`,
where a column named like the added one is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import save, text_column

SAMPLE_ROWS = 20_000
FEATURES = 256
RIDGE = 1e-3
SUM_TASKS = 8

_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t\r", "line": b"\n", "bar": b"|", "symbol": b"%&*#$@^~+=<>{}[]\\_`/", "bang": b"!?", "stop": b".,;:", "quote": b"'\"()-"}
_NAMES = ["log_bytes", "log_words", "word_length", "upper_of_letters", "digit", "space", "line", "bar", "symbol", "bang", "stop", "quote", "non_ascii", "stops_per_word", "bars_per_word", "symbols_per_word", "bangs_per_word", "distinct", "commonest", "repeated_next", "line_length", "repeated_lines", "entropy"]


def _class_table() -> np.ndarray:
    table = np.zeros((256, len(_CLASSES) + 1))
    for k, chars in enumerate(_CLASSES.values()):
        table[list(chars), k] = 1
    table[128:, -1] = 1
    return table


_TABLE = _class_table()


def statistics(raw: bytes) -> list[float]:
    """The statistics of one UTF-8 text, all finite; an empty text gives zeros."""
    if not raw:
        return [0.0] * len(_NAMES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    upper, lower, digit, space, line, bar, symbol, bang, stop, quote, high = (counts @ _TABLE).tolist()
    words = raw.split()
    k = max(1, len(words))
    commonest = max(Counter(words).values()) if words else 0
    lines = raw.split(b"\n")
    p = counts[counts > 0] / n
    return [
        np.log1p(n), np.log1p(len(words)), min(50.0, (n - space - line) / k), upper / max(1.0, upper + lower), digit / n, space / n, line / n, bar / n, symbol / n, bang / n, stop / n, quote / n, high / n,
        stop / k, bar / k, symbol / k, bang / k, np.log1p(len(set(words))) / np.log1p(k), commonest / k, sum(map(eq, words, words[1:])) / k, np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines), float(-(p * np.log(p)).sum()),
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    ridge: np.ndarray
    steps: tuple[np.ndarray, np.ndarray]

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.bias)) * np.cos(z @ self.weights + self.bias), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.ridge

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.steps[0]):
            return np.full(len(x), 0.5)
        raw = self.raw(x)
        order = 1 / (1 + np.exp(-np.clip(4 * (raw - 0.5), -30, 30)))
        return np.clip(0.98 * np.interp(raw, *self.steps) + 0.02 * order, 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; centres and means of the blocks, which increase. Ties in x are pooled first."""
    if not len(x):
        return np.zeros(0), np.zeros(0)
    xs, at = np.unique(x, return_inverse=True)
    n = np.bincount(at).astype(float)
    blocks: list[list[float]] = []
    for v, s, w in zip(xs, np.bincount(at, weights=y), n):
        blocks.append([v * w, s, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def held_out(id_col: str = "doc_id", folds: int = 5):
    """The remainder of the CRC-32 of the id as text."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_column(text_col).cast("binary").alias("raw"))


def _statistics_table(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return texts.mapInArrow(run, "doc_id long, x array<double>")


def fit(df: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 5, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> Model:
    """A model from labelled rows outside fold 0. Fold folds - 1 calibrates, the others fit."""
    own = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL")
    own = own.groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("fold", held_out("doc_id", folds)).where("fold <> 0")
    sample = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # `sample` has at most sample_rows rows of three numbers
    chosen = _texts(df, id_col, text_col).join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")
    rows = save(_statistics_table(chosen).join(F.broadcast(sample), "doc_id"), "quality-rows")
    d = len(_NAMES)
    moments = rows.agg(F.count(F.lit(1)), *(f(F.get("x", F.lit(k))) for k in range(d) for f in (F.avg, F.stddev_pop))).first()
    rng = np.random.default_rng(seed)
    weights, bias = rng.normal(0, 1 / np.sqrt(d), (d, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
    none = np.zeros(0)
    if not moments[0]:
        return Model(np.zeros(d), np.ones(d), weights, bias, np.zeros(FEATURES + 1), (none, none))
    mean, scale = np.array(moments[1::2], float), np.array(moments[2::2], float)
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), weights, bias, np.zeros(FEATURES + 1), (none, none))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, c, n = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1), 0
        for batch in batches:
            if batch.num_rows:
                z = model.features(np.array(batch.column(0).to_pylist()))
                g += z.T @ z
                c += z.T @ np.array(batch.column(1).to_pylist())
                n += len(z)
        yield pa.RecordBatch.from_arrays([pa.array([g.tobytes()], pa.binary()), pa.array([c.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["g", "c", "n"])

    fitted = rows.where(F.col("fold") < folds - 1).select("x", "y").coalesce(SUM_TASKS).mapInArrow(sums, "g binary, c binary, n long").collect()
    g = sum((np.frombuffer(r[0]).reshape(FEATURES + 1, -1) for r in fitted), np.zeros((FEATURES + 1, FEATURES + 1)))
    c = sum((np.frombuffer(r[1]) for r in fitted), np.zeros(FEATURES + 1))
    penalty = np.eye(FEATURES + 1) * max(RIDGE * sum(r[2] for r in fitted), 1e-6)
    penalty[-1, -1] = 1e-9
    model.ridge = np.linalg.solve(g + penalty, c)
    rest = rows.where(F.col("fold") == folds - 1).select("x", "y").collect() or rows.select("x", "y").collect()
    model.steps = isotonic(model.raw(np.array([r[0] for r in rest])), np.array([r[1] for r in rest]))
    return model


def scores(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and `score` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column(1).to_pylist()]).reshape(-1, len(_NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], names=["doc_id", "score"])

    return _texts(df, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def with_scores(df: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of `df` and the score, row by row without a join."""

    @F.pandas_udf(T.DoubleType())
    def score(raw: pd.Series) -> pd.Series:
        x = np.array([statistics(t) for t in raw]).reshape(-1, len(_NAMES))
        return pd.Series(model.score(x))

    return df.withColumn(score_col, score(text_column(text_col).cast("binary")))
