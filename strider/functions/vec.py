"""Column builders for small fixed-size vectors and rotations; no UDFs.

A vector is a tuple of Columns, a matrix a tuple of rows. Builders only compose
expressions, so callers stage intermediate vectors with `staged` where an expression
is used several times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vec = tuple[Column, ...]
Mat = tuple[Vec, ...]


def lit(*xs: float) -> Vec:
    return tuple(F.lit(float(x)) for x in xs)


def at(col: str, j: int) -> Vec:
    """Joint j of a pose kept as an array of 51 doubles."""
    return tuple(F.get(F.col(col), F.lit(3 * j + k)) for k in range(3))


def of(name: str, n: int = 3) -> Vec:
    """A staged vector."""
    return tuple(F.col(f"{name}_{k}") for k in range(n))


def staged(df: DataFrame, **vecs: Vec | Column) -> DataFrame:
    """Add vectors as columns name_0, name_1, ... and scalars as name."""
    cols = {}
    for name, v in vecs.items():
        cols |= {name: v} if isinstance(v, Column) else {f"{name}_{k}": c for k, c in enumerate(v)}
    return df.withColumns(cols)


def add(a: Vec, b: Vec) -> Vec:
    return tuple(x + y for x, y in zip(a, b))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(x - y for x, y in zip(a, b))


def scale(a: Vec, s: Column | float) -> Vec:
    return tuple(x * s for x in a)


def dot(a: Vec, b: Vec) -> Column:
    return sum((x * y for x, y in zip(a[1:], b[1:])), a[0] * b[0])


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def choose(when: Column, a: Vec, b: Vec) -> Vec:
    return tuple(F.when(when, x).otherwise(y) for x, y in zip(a, b))


def unit(a: Vec) -> Vec:
    """Length one; vectors shorter than 1e-8 become (0, 1, 0)."""
    n = norm(a)
    return choose(n < 1e-8, lit(0, 1, 0), tuple(x / F.nullif(n, F.lit(0.0)) for x in a))


def angle(u: Vec, v: Vec) -> Column:
    """Between unit vectors."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(u, v))))


def rotation(v: Vec, c: Column) -> Mat:
    """Of unit vectors with cross product v and dot product c. Parallel: identity; antiparallel: minus identity, kept as the surveyed rule has it."""
    s2 = dot(v, v)
    k = (1 - c) / (s2 + 1e-8)
    x, y, z = v
    full = (
        (1 - k * (y * y + z * z), k * x * y - z, k * x * z + y),
        (k * x * y + z, 1 - k * (x * x + z * z), k * y * z - x),
        (k * x * z - y, k * y * z + x, 1 - k * (x * x + y * y)),
    )
    flat = F.sqrt(s2) < 1e-8
    same = F.when(c > 0, 1.0).otherwise(-1.0)
    return tuple(tuple(F.when(flat, same if i == j else F.lit(0.0)).otherwise(full[i][j]) for j in range(3)) for i in range(3))


def euler(m: Mat) -> Vec:
    """Pitch, roll, yaw of a matrix, with the singular branch below 1e-6."""
    sy = F.sqrt(m[0][0] * m[0][0] + m[1][0] * m[1][0])
    good = sy >= 1e-6
    return (
        F.when(good, F.atan2(m[2][1], m[2][2])).otherwise(F.atan2(-m[1][2], m[1][1])),
        F.atan2(-m[2][0], sy),
        F.when(good, F.atan2(m[1][0], m[0][0])).otherwise(F.lit(0.0)),
    )


def from_euler(e: Vec) -> Mat:
    """A matrix of pitch, roll, yaw in the surveyed axis order, which is not that of euler()."""
    (cx, cy, cz), (sx, sy, sz) = tuple(map(F.cos, e)), tuple(map(F.sin, e))
    return (
        (cy * cz, -cy * sz, sy),
        (cx * sz + sx * sy * cz, cx * cz - sx * sy * sz, -sx * cy),
        (sx * sz - cx * sy * cz, sx * cz + cx * sy * sz, cx * cy),
    )


def apply(m: Mat, v: Vec) -> Vec:
    return tuple(dot(row, v) for row in m)


def quaternion(u: Vec, v: Vec) -> Vec:
    """w, x, y, z that turns unit vector u to unit vector v; within 1e-4 of parallel no turn, of antiparallel a half turn."""
    d = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(u, v)))
    c = cross(u, v)
    n = F.sqrt((1 + d) * (1 + d) + dot(c, c))
    side = cross(u, lit(1, 0, 0))
    side = choose(norm(side) < 1e-6, cross(u, lit(0, 1, 0)), side)
    half = (F.lit(0.0), *(x / F.nullif(norm(side), F.lit(0.0)) for x in side))
    turn = tuple(x / F.nullif(n, F.lit(0.0)) for x in (1 + d, *c))
    return choose(d > 0.9999, lit(1, 0, 0, 0), choose(d < -0.9999, half, turn))


def matrix_quaternion(m: Mat) -> Vec:
    """w, x, y, z of a rotation matrix: by the trace if it is positive, else by the largest diagonal term."""
    (a, b, c), (d, e, f), (g, h, i) = m
    root = lambda x: F.sqrt(F.greatest(x, F.lit(1e-12)))
    t = 0.5 / root(a + e + i + 1)
    by_trace = (0.25 / t, (h - f) * t, (c - g) * t, (d - b) * t)
    s, u, v = 2 * root(1 + a - e - i), 2 * root(1 + e - a - i), 2 * root(1 + i - a - e)
    by_x = ((h - f) / s, 0.25 * s, (b + d) / s, (c + g) / s)
    by_y = ((c - g) / u, (b + d) / u, 0.25 * u, (f + h) / u)
    by_z = ((d - b) / v, (c + g) / v, (f + h) / v, 0.25 * v)
    return choose(a + e + i > 0, by_trace, choose((a > e) & (a > i), by_x, choose(e > i, by_y, by_z)))
