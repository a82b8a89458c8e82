"""Poses to joint angles and back.

The conversions are Arrow UDFs over whole batches in numpy: as native columns their
expressions multiply when they are put together (each rotation uses each vector many
times) and planning alone took minutes. The light parts are native columns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vec

#: Bones as (from, to) joints.
BONES = {"spine": (0, 7), "l_thigh": (4, 5), "l_shin": (5, 6), "r_thigh": (1, 2), "r_shin": (2, 3), "l_collar": (8, 11), "l_upper": (11, 12), "l_fore": (12, 13), "r_collar": (8, 14), "r_upper": (14, 15), "r_fore": (15, 16), "neck": (9, 10)}
#: Default bone lengths of forward kinematics.
DEFAULT = {"hip_spine": 0.12, "spine_thorax": 0.15, "thorax_neck": 0.08, "neck_head": 0.10, "hip_side": 0.10, "thigh": 0.40, "shin": 0.38, "shoulder_side": 0.18, "upper_arm": 0.28, "forearm": 0.25}
#: Left and right joints that a flip swaps.
LEFT, RIGHT = (4, 5, 6, 11, 12, 13), (1, 2, 3, 14, 15, 16)
#: Joints of the 16 bones of the drawn skeleton.
EDGES = ((0, 1), (1, 2), (2, 3), (0, 4), (4, 5), (5, 6), (0, 7), (7, 8), (8, 9), (9, 10), (8, 11), (11, 12), (12, 13), (8, 14), (14, 15), (15, 16))


_DOUBLES = T.ArrayType(T.DoubleType())


def _unit(v: np.ndarray) -> np.ndarray:
    """Length one; vectors shorter than 1e-8 become (0, 1, 0)."""
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.where(n < 1e-8, np.array([0.0, 1.0, 0.0]), v / np.where(n < 1e-8, 1.0, n))


def _turn(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pitch, roll, yaw of the rotation from a to b; antiparallel vectors give minus identity, kept as the surveyed rule has it."""
    a, b = np.broadcast_arrays(_unit(a), _unit(b))
    v, c = np.cross(a, b), (a * b).sum(1)
    x, y, z = v.T
    k = np.zeros((len(v), 3, 3))
    k[:, 0, 1], k[:, 0, 2], k[:, 1, 0], k[:, 1, 2], k[:, 2, 0], k[:, 2, 1] = -z, y, z, -x, -y, x
    s2 = (v * v).sum(1)
    m = np.eye(3) + k + k @ k * ((1 - c) / (s2 + 1e-8))[:, None, None]
    flat = np.sqrt(s2) < 1e-8
    m[flat] = np.eye(3) * np.where(c[flat] > 0, 1.0, -1.0)[:, None, None]
    sy = np.hypot(m[:, 0, 0], m[:, 1, 0])
    good = sy >= 1e-6
    pitch = np.where(good, np.arctan2(m[:, 2, 1], m[:, 2, 2]), np.arctan2(-m[:, 1, 2], m[:, 1, 1]))
    return np.stack([pitch, np.arctan2(-m[:, 2, 0], sy), np.where(good, np.arctan2(m[:, 1, 0], m[:, 0, 0]), 0.0)], 1)


def _bend(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.pi - np.arccos(np.clip((_unit(a) * _unit(b)).sum(1), -1, 1))[:, None]


def angles_of(p: np.ndarray) -> np.ndarray:
    """n x 17 x 3 to n x 22."""
    bone = {n: p[:, b] - p[:, a] for n, (a, b) in BONES.items()}
    up = np.array([[0.0, 1.0, 0.0]])
    legs = [f(s) for s in "lr" for f in (lambda s: _turn(-up, bone[f"{s}_thigh"]), lambda s: _bend(bone[f"{s}_thigh"], bone[f"{s}_shin"]))]
    arms = [f(s) for s in "lr" for f in (lambda s: _turn(bone[f"{s}_collar"], bone[f"{s}_upper"]), lambda s: _bend(bone[f"{s}_upper"], bone[f"{s}_fore"]))]
    return np.hstack([_turn(up, bone["spine"]), *legs, *arms, _turn(up, bone["neck"])])


def _matrix(e: np.ndarray) -> np.ndarray:
    """Rotations about x, y and z in the surveyed order, which is not that of _turn()."""
    (cx, cy, cz), (sx, sy, sz) = np.cos(e).T, np.sin(e).T
    rows = [[cy * cz, -cy * sz, sy], [cx * sz + sx * sy * cz, cx * cz - sx * sy * sz, -sx * cy], [sx * sz - cx * sy * cz, sx * cz + cx * sy * sz, cx * cy]]
    return np.array(rows).transpose(2, 0, 1)


def pose_of(a: np.ndarray, reference: np.ndarray | None = None) -> np.ndarray:
    """n x 22 to n x 17 x 3, with lengths and offsets of reference poses or the default ones."""
    n, p = len(a), np.zeros((len(a), 17, 3))
    size = lambda i, j, name: np.linalg.norm(reference[:, j] - reference[:, i], axis=1)[:, None] if reference is not None else DEFAULT[name]
    offset = lambda i, j, x: reference[:, j] - reference[:, i] if reference is not None else np.tile([x, 0.0, 0.0], (n, 1))
    move = lambda m, v: np.einsum("nij,nj->ni", m, np.broadcast_to(v, (n, 3)))
    up = np.array([0.0, 1.0, 0.0])
    along = move(_matrix(a[:, :3]), up)
    p[:, 7] = along * size(0, 7, "hip_spine")
    p[:, 8] = p[:, 7] + along * size(7, 8, "spine_thorax")
    p[:, 9] = p[:, 8] + up * size(8, 9, "thorax_neck")
    p[:, 10] = p[:, 9] + move(_matrix(a[:, 19:22]), up) * size(9, 10, "neck_head")
    still = np.zeros(n)
    for (hip, knee, ankle), x, at in (((4, 5, 6), -DEFAULT["hip_side"], 3), ((1, 2, 3), DEFAULT["hip_side"], 7)):
        m, b = _matrix(a[:, at : at + 3]), np.pi - a[:, at + 3]
        p[:, hip] = offset(0, hip, x)
        p[:, knee] = p[:, hip] + move(m, -up) * size(hip, knee, "thigh")
        p[:, ankle] = p[:, knee] + move(m, np.stack([still, -np.cos(b), np.sin(b)], 1)) * size(knee, ankle, "shin")
    for (sho, elbow, wrist), x, at, way in (((11, 12, 13), -DEFAULT["shoulder_side"], 11, -1), ((14, 15, 16), DEFAULT["shoulder_side"], 15, 1)):
        m, b, off = _matrix(a[:, at : at + 3]), np.pi - a[:, at + 3], offset(8, sho, x)
        p[:, sho] = p[:, 8] + off
        p[:, elbow] = p[:, sho] + move(m, _unit(off)) * size(sho, elbow, "upper_arm")
        p[:, wrist] = p[:, elbow] + move(m, np.stack([way * np.cos(b), -np.sin(b), still], 1)) * size(elbow, wrist, "forearm")
    return p


@F.pandas_udf(_DOUBLES)
def _to_angles(pose: pd.Series) -> pd.Series:
    return pd.Series(list(angles_of(np.stack(pose).reshape(-1, 17, 3)))) if len(pose) else pd.Series([], dtype=object)


@F.pandas_udf(_DOUBLES)
def _to_pose(angles: pd.Series) -> pd.Series:
    return pd.Series(list(pose_of(np.stack(angles)).reshape(-1, 51))) if len(angles) else pd.Series([], dtype=object)


@F.pandas_udf(_DOUBLES)
def _to_pose_like(angles: pd.Series, reference: pd.Series) -> pd.Series:
    return pd.Series(list(pose_of(np.stack(angles), np.stack(reference).reshape(-1, 17, 3)).reshape(-1, 51))) if len(angles) else pd.Series([], dtype=object)


def joint_angles(poses: DataFrame, pose: str = "pose") -> DataFrame:
    """Replaces `pose` by `angles`: spine 3, left hip 3, knee 1, right hip 3, knee 1, left shoulder 3, elbow 1, right shoulder 3, elbow 1, neck 3."""
    return poses.withColumn("angles", _to_angles(pose)).drop(pose)


def sin_cos(angles: Column) -> Column:
    return F.flatten(F.transform(angles, lambda a: F.array(F.sin(a), F.cos(a))))


def from_sin_cos(values: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), (F.size(values) / 2 - 1).cast("int")), lambda i: F.atan2(F.get(values, 2 * i), F.get(values, 2 * i + 1)))


def flip(pose: Column) -> Column:
    """Negates x and swaps left and right joints of a pose of 51 doubles."""
    swap = dict(zip(LEFT + RIGHT, RIGHT + LEFT))
    source = F.array(*(F.lit(3 * swap.get(j, j) + k) for j in range(17) for k in range(3)))
    return F.transform(source, lambda i: F.when(i % 3 == 0, -F.get(pose, i)).otherwise(F.get(pose, i)))


def root_centred(pose: Column) -> Column:
    return F.transform(pose, lambda v, i: v - F.get(pose, i % 3))


def bone_lengths(pose: str = "pose") -> Column:
    """Lengths of the 16 drawn bones."""
    return F.array(*(vec.norm(vec.sub(vec.at(pose, b), vec.at(pose, a))) for a, b in EDGES))


def forward(df: DataFrame, angles: str = "angles", reference: str | None = None) -> DataFrame:
    """Replaces `angles` by `pose`, with lengths and offsets of a reference pose or the default ones."""
    pose = _to_pose_like(angles, reference) if reference else _to_pose(angles)
    return df.withColumn("pose", pose).drop(angles)
