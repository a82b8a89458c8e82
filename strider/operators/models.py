"""Slots for models: callables over numpy batches, run inside Arrow workers; and the alignment that needs a decomposition."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Numbers that a model gets at once, if a row has no more.
AT_ONCE = 1 << 19


def _cut(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with about AT_ONCE numbers each."""
    rows = max(1, AT_ONCE * batch.num_rows // max(1, len(batch.column(batch.schema.get_field_index(column)).flatten())))
    return (batch.slice(k, rows) for k in range(0, max(1, batch.num_rows), rows))


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """Lists of one length as rows, without a Python object for each number."""
    sizes = np.unique(lists.value_lengths().to_numpy(zero_copy_only=False))
    if lists.null_count or len(sizes) != 1:
        return np.array(lists.to_pylist(), float)
    return np.array(lists.flatten().to_numpy(zero_copy_only=False), float).reshape(len(lists), int(sizes[0]))


def predict(df: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]], column: str, out: str) -> DataFrame:
    """Adds `out` by a model that `load` makes once for each partition; arrays of doubles in and out."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema if f.name != out)}, `{out}` array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in (some for b in batches for some in _cut(b, column)):
            x = _matrix(batch.column(batch.schema.get_field_index(column)))
            y = model(x) if len(x) else x
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(y), pa.list_(pa.float64()))], names=[*batch.schema.names, out])

    return df.drop(out).mapInArrow(run, schema)


def flip_ensemble(model: Callable[[np.ndarray], np.ndarray], flip: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    """Half of the model's answer and half of the flipped answer to the flipped input."""
    return lambda x: (model(x) + flip(model(flip(x)))) / 2


def align_3d(source: np.ndarray, target: np.ndarray, reference_compat: bool = False) -> np.ndarray:
    """Best rotation, scale and shift of n x 3 points onto others, for one pair or a batch of them at once; with reference_compat the transposed rotation. Points in one place stay."""
    a, b = source - source.mean(-2, keepdims=True), target - target.mean(-2, keepdims=True)
    still = (np.linalg.norm(a, axis=(-2, -1)) < 1e-8) | (np.linalg.norm(b, axis=(-2, -1)) < 1e-8)
    u, s, vt = np.linalg.svd(np.swapaxes(a, -2, -1) @ b)
    flip = np.ones(s.shape)
    flip[..., 2] = np.sign(np.linalg.det(u @ vt))
    r = (u * flip[..., None, :]) @ vt
    scale = (s * flip).sum(-1) / np.where(still, 1, (a * a).sum((-2, -1)))
    out = scale[..., None, None] * (a @ (np.swapaxes(r, -2, -1) if reference_compat else r)) + target.mean(-2, keepdims=True)
    return np.where(still[..., None, None], source, out)


def aligned_error(df: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Adds `error`, the mean distance in mm after the best alignment of two poses of 51 doubles; whole batches at once."""

    @F.pandas_udf(T.DoubleType())
    def error(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=float)
        x, y = (np.stack(s.to_list()).reshape(-1, 17, 3) for s in (a, b))
        return pd.Series(np.linalg.norm(align_3d(x, y) - y, axis=2).mean(1) * 1000)

    return df.withColumn("error", error(source, target))
