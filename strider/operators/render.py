"""Poses in the render frame: Z up, shoulders along X, a common height, feet on the ground."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEIGHT = 1.6


def _unit(v: np.ndarray) -> np.ndarray:
    return v / (np.linalg.norm(v, axis=-1, keepdims=True) + 1e-10)


def between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rotations from each of n vectors to one; none within 1e-4 of parallel, a half turn within 1e-4 of antiparallel."""
    a, b = _unit(a), _unit(np.broadcast_to(b, a.shape))
    v, c = np.cross(a, b), (a * b).sum(1)
    k = np.zeros((len(a), 3, 3))
    k[:, 0, 1], k[:, 0, 2], k[:, 1, 0], k[:, 1, 2], k[:, 2, 0], k[:, 2, 1] = -v[:, 2], v[:, 1], v[:, 2], -v[:, 0], -v[:, 1], v[:, 0]
    m = np.eye(3) + k + k @ k / np.where(c < -0.9999, 1, 1 + c)[:, None, None]
    side = np.cross(a, [1.0, 0, 0])
    short = np.linalg.norm(side, axis=1) < 1e-6
    side[short] = np.cross(a[short], [0, 1.0, 0])
    side = _unit(side)
    half = 2 * side[:, :, None] * side[:, None, :] - np.eye(3)
    m[c < -0.9999] = half[c < -0.9999]
    m[c > 0.9999] = np.eye(3)
    return m


def upright(p: np.ndarray, scale: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """n x 17 x 3 poses in the render frame, and the scales: given ones, or those that make each pose HEIGHT tall."""
    p = p - p[:, :1]
    p = np.einsum("nij,nkj->nki", between((p[:, 10] + p[:, 8]) / 2, np.array([0, 0, 1.0])), p)
    d = p[:, 14] - p[:, 11]
    turn = np.where(np.hypot(d[:, 0], d[:, 1]) > 1e-6, -np.arctan2(d[:, 1], d[:, 0]), 0.0)
    c, s = np.cos(turn)[:, None], np.sin(turn)[:, None]
    p = np.stack([c * p[:, :, 0] - s * p[:, :, 1], s * p[:, :, 0] + c * p[:, :, 1], p[:, :, 2]], 2)
    if scale is None:
        tall = np.ptp(p[:, :, 2], axis=1)
        scale = np.where(tall > 0.01, HEIGHT / np.maximum(tall, 0.01), 1.0)
    p = p * scale[:, None, None]
    p[:, :, 2] -= p[:, :, 2].min(1, keepdims=True)
    return p, scale


_KIND = T.StructType([T.StructField("pose", T.ArrayType(T.DoubleType())), T.StructField("scale", T.DoubleType())])


@F.pandas_udf(_KIND)
def _upright(pose: pd.Series) -> pd.DataFrame:
    if not len(pose):
        return pd.DataFrame({"pose": [], "scale": []})
    p, s = upright(np.stack(pose).reshape(-1, 17, 3))
    return pd.DataFrame({"pose": list(p.reshape(-1, 51)), "scale": s})


@F.pandas_udf(T.DoubleType())
def _hip_height(pose: pd.Series, scale: pd.Series) -> pd.Series:
    return pd.Series(upright(np.stack(pose).reshape(-1, 17, 3), scale.to_numpy())[0][:, 0, 2]) if len(pose) else pd.Series([], dtype=float)


def render_frame(poses: DataFrame, pose: str = "pose") -> DataFrame:
    """Replaces `pose` by the upright one and adds its scale."""
    r = poses.withColumn("__r", _upright(pose))
    return r.withColumns({pose: F.col("__r.pose"), "scale": F.col("__r.scale")}).drop("__r")


def select_frames(poses: DataFrame, pose: str = "pose") -> DataFrame:
    """clip, first, low, last: the lowest hip in the middle three fifths, and the highest before and from there on; first frames win ties."""
    scale = render_frame(poses.where("frame % 5 = 0"), pose).groupBy("clip").agg(F.min("scale").alias("s"))
    h = poses.join(scale, "clip").select("clip", "frame", _hip_height(pose, "s").alias("h"))
    n = h.groupBy("clip").agg((F.max("frame") + 1).alias("n"))
    h = h.join(n, "clip").withColumn("m", F.floor(F.col("n") / 5))
    pick = lambda d, order, name: d.withColumn("r", F.row_number().over(Window.partitionBy("clip").orderBy(order, "frame"))).where("r = 1").select("clip", F.col("frame").alias(name))
    low = pick(h.where("frame >= m AND frame < n - m"), F.col("h").asc(), "low")
    both = h.join(low, "clip")
    return low.join(pick(both.where("frame < low"), F.col("h").desc(), "first"), "clip", "left").join(pick(both.where("frame >= low"), F.col("h").desc(), "last"), "clip").select("clip", F.coalesce("first", F.lit(0).cast("long")).alias("first"), "low", "last")
