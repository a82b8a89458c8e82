"""Queries: joint angles, forward kinematics, flips. Oracles work on one row per rotation instead of columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kinematics as kin
from . import views
from .catalog import query

R = lambda c: F.round(c, 4) + 0.0

_V = lambda i, j, k: f"(e[3 * {j} + {k + 1}] - e[3 * {i} + {k + 1}])"
IK = f"""+spec AS (SELECT * FROM (VALUES (0, -1, 1, 0, 7), (3, -1, -1, 4, 5), (7, -1, -1, 1, 2), (11, 8, 11, 11, 12), (15, 8, 14, 14, 15), (19, -1, 1, 9, 10)) t(pos, ai, aj, bi, bj)),
v0 AS (SELECT clip, frame, pos, {", ".join(f"CASE WHEN ai = -1 THEN {'aj' if k == 1 else '0'}::DOUBLE ELSE {_V('ai', 'aj', k)} END AS a{k}, {_V('bi', 'bj', k)} AS b{k}" for k in range(3))} FROM frames, spec),
v1 AS (SELECT *, sqrt(a0 * a0 + a1 * a1 + a2 * a2) AS na, sqrt(b0 * b0 + b1 * b1 + b2 * b2) AS nb FROM v0),
v2 AS (SELECT clip, frame, pos, {", ".join(f"CASE WHEN n{s} < 1e-8 THEN {1 if k == 1 else 0} ELSE {s}{k} / n{s} END AS {s}{k}" for s in "ab" for k in range(3))} FROM v1),
v3 AS (SELECT clip, frame, pos, a1 * b2 - a2 * b1 AS x, a2 * b0 - a0 * b2 AS y, a0 * b1 - a1 * b0 AS z, a0 * b0 + a1 * b1 + a2 * b2 AS c FROM v2),
v4 AS (SELECT *, sqrt(x * x + y * y + z * z) < 1e-8 AS flat, (1 - c) / (x * x + y * y + z * z + 1e-8) AS k, CASE WHEN c > 0 THEN 1.0 ELSE -1.0 END AS s FROM v3),
v5 AS (SELECT clip, frame, pos, CASE WHEN flat THEN s ELSE 1 - k * (y * y + z * z) END AS m00, CASE WHEN flat THEN 0 ELSE k * x * y + z END AS m10, CASE WHEN flat THEN 0 ELSE k * x * z - y END AS m20,
  CASE WHEN flat THEN s ELSE 1 - k * (x * x + z * z) END AS m11, CASE WHEN flat THEN 0 ELSE k * y * z - x END AS m12, CASE WHEN flat THEN 0 ELSE k * y * z + x END AS m21, CASE WHEN flat THEN s ELSE 1 - k * (x * x + y * y) END AS m22 FROM v4),
v6 AS (SELECT *, sqrt(m00 * m00 + m10 * m10) AS sy FROM v5),
bend AS (SELECT clip, frame, pos, {", ".join(f"{_V('i', 'j', k)} AS a{k}, {_V('j', 'l', k)} AS b{k}" for k in range(3))} FROM frames, (VALUES (6, 4, 5, 6), (10, 1, 2, 3), (14, 11, 12, 13), (18, 14, 15, 16)) t(pos, i, j, l)),
bend1 AS (SELECT clip, frame, pos, (a0 * b0 + a1 * b1 + a2 * b2) / (sqrt(a0 * a0 + a1 * a1 + a2 * a2) * sqrt(b0 * b0 + b1 * b1 + b2 * b2)) AS c FROM bend),
ik AS (SELECT clip, frame, pos AS k, CASE WHEN sy >= 1e-6 THEN atan2(m21, m22) ELSE atan2(-m12, m11) END AS angle FROM v6
  UNION ALL SELECT clip, frame, pos + 1, atan2(-m20, sy) FROM v6 UNION ALL SELECT clip, frame, pos + 2, CASE WHEN sy >= 1e-6 THEN atan2(m10, m00) ELSE 0 END FROM v6
  UNION ALL SELECT clip, frame, pos, pi() - acos(greatest(-1, least(1, c))) FROM bend1),
al AS (SELECT clip, frame, list(angle ORDER BY k) AS a FROM ik GROUP BY clip, frame)"""


def angles(spark, sf_dir):
    return kin.joint_angles(views.poses(spark, sf_dir))


def _long(df, col, name):
    return df.select("clip", "frame", F.posexplode(col).alias("k", name)).select("clip", "frame", F.col("k").cast("long").alias("k"), R(name).alias(name))


@query(views.sql(f"{IK} SELECT clip, frame, k::BIGINT AS k, round(angle, 4) + 0.0 AS angle FROM ik", "frames"))
def ik_angles(spark, sf_dir):
    return _long(angles(spark, sf_dir), "angles", "angle")


@query(views.sql(f"{IK} SELECT clip, frame, (2 * k + h)::BIGINT AS k, round(CASE h WHEN 0 THEN sin(angle) ELSE cos(angle) END, 4) + 0.0 AS v FROM ik, (VALUES (0), (1)) t(h)", "frames"))
def angles_sincos(spark, sf_dir):
    return _long(angles(spark, sf_dir).withColumn("v", kin.sin_cos(F.col("angles"))), "v", "v")


@query(views.sql(f"{IK} SELECT clip, frame, k::BIGINT AS k, round(atan2(sin(angle), cos(angle)), 4) + 0.0 AS angle FROM ik", "frames"))
def sincos_roundtrip(spark, sf_dir):
    return _long(angles(spark, sf_dir).withColumn("back", kin.from_sin_cos(kin.sin_cos(F.col("angles")))), "back", "angle")


def _m(k: int) -> str:
    p, r, y = f"a[{k + 1}]", f"a[{k + 2}]", f"a[{k + 3}]"
    return f"[[cos({r})*cos({y}), -cos({r})*sin({y}), sin({r})], [cos({p})*sin({y}) + sin({p})*sin({r})*cos({y}), cos({p})*cos({y}) - sin({p})*sin({r})*sin({y}), -sin({p})*cos({r})], [sin({p})*sin({y}) - cos({p})*sin({r})*cos({y}), sin({p})*cos({y}) + cos({p})*sin({r})*sin({y}), cos({p})*cos({r})]]"


def _dir(m: str, x: str, y: str, z: str, s: float, base: str) -> str:
    """base + s * m (x, y, z)."""
    return f"list_transform([1, 2, 3], lambda i: {base}[i] + {s} * ({m}[i][1] * ({x}) + {m}[i][2] * ({y}) + {m}[i][3] * ({z})))"


FK = f"""{IK},
f0 AS (SELECT clip, frame, a, {_m(0)} AS ms, {_m(3)} AS ml, {_m(7)} AS mr, {_m(11)} AS mls, {_m(15)} AS mrs, {_m(19)} AS mn, [0.0::DOUBLE, 0.0, 0.0] AS p0, [-0.1::DOUBLE, 0, 0] AS p4, [0.1::DOUBLE, 0, 0] AS p1 FROM al),
f1 AS (SELECT *, {_dir('ms', '0', '1', '0', 0.12, 'p0')} AS p7, {_dir('ml', '0', '-1', '0', 0.4, 'p4')} AS p5, {_dir('mr', '0', '-1', '0', 0.4, 'p1')} AS p2 FROM f0),
f2 AS (SELECT *, {_dir('ms', '0', '1', '0', 0.15, 'p7')} AS p8, {_dir('ml', '0', '-cos(pi() - a[7])', 'sin(pi() - a[7])', 0.38, 'p5')} AS p6, {_dir('mr', '0', '-cos(pi() - a[11])', 'sin(pi() - a[11])', 0.38, 'p2')} AS p3 FROM f1),
f3 AS (SELECT *, [p8[1], p8[2] + 0.08, p8[3]] AS p9, [p8[1] - 0.18, p8[2], p8[3]] AS p11, [p8[1] + 0.18, p8[2], p8[3]] AS p14 FROM f2),
f4 AS (SELECT *, {_dir('mn', '0', '1', '0', 0.1, 'p9')} AS p10, {_dir('mls', '-1', '0', '0', 0.28, 'p11')} AS p12, {_dir('mrs', '1', '0', '0', 0.28, 'p14')} AS p15 FROM f3),
f5 AS (SELECT *, {_dir('mls', '-cos(pi() - a[15])', '-sin(pi() - a[15])', '0', 0.25, 'p12')} AS p13, {_dir('mrs', 'cos(pi() - a[19])', '-sin(pi() - a[19])', '0', 0.25, 'p15')} AS p16 FROM f4),
fk AS (SELECT clip, frame, list_concat(p0, p1, p2, p3, p4, p5, p6, p7, p8, p9, p10, p11, p12, p13, p14, p15, p16) AS pose FROM f5)"""


@query(views.sql(f"{FK} SELECT clip, frame, k, round(pose[k + 1], 4) + 0.0 AS v FROM fk, range(51) t(k)", "frames"))
def fk_pose(spark, sf_dir):
    return _long(kin.forward(angles(spark, sf_dir)), "pose", "v")


@query()
def fk_reference_lengths(spark, sf_dir):
    """With a pose's own lengths, bones keep their lengths; tests compare them."""
    p = views.poses(spark, sf_dir).withColumn("ref", F.col("pose")).select("clip", "frame", "ref", "pose")
    return _long(kin.forward(kin.joint_angles(p), reference="ref"), "pose", "v")


_EDGES = ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(kin.EDGES))


@query(views.sql(f"SELECT clip, frame, k::BIGINT AS k, round(sqrt({_V('i', 'j', 0)} ** 2 + {_V('i', 'j', 1)} ** 2 + {_V('i', 'j', 2)} ** 2), 4) + 0.0 AS length FROM frames, (VALUES {_EDGES}) t(k, i, j)", "frames"))
def bone_lengths(spark, sf_dir):
    return _long(views.poses(spark, sf_dir).withColumn("n", kin.bone_lengths()), "n", "length")



@query(views.sql("+s AS (SELECT clip, frame, e, unnest([0, 4, 5, 6, 1, 2, 3, 7, 8, 9, 10, 14, 15, 16, 11, 12, 13]) AS src, unnest(range(17)) AS j FROM frames) SELECT clip, frame, 3 * j + c AS k, round(CASE WHEN c = 0 THEN -e[3 * src + 1] ELSE e[3 * src + c + 1] END, 4) + 0.0 AS v FROM s, range(3) t(c)", "frames"))
def flip_pose(spark, sf_dir):
    return _long(views.poses(spark, sf_dir).withColumn("p", kin.flip(F.col("pose"))), "p", "v")


@query(views.sql("SELECT clip, frame, k, round(e[k + 1] - e[k % 3 + 1], 4) + 0.0 AS v FROM frames, range(51) t(k)", "frames"))
def root_center(spark, sf_dir):
    return _long(views.poses(spark, sf_dir).withColumn("p", kin.root_centred(F.col("pose"))), "p", "v")


@query(views.sql("+g AS (SELECT clip, e AS root FROM frames WHERE frame = 0) SELECT clip, frame, k, round(e[k + 1] - root[k % 3 + 1], 4) + 0.0 AS v FROM frames JOIN g USING (clip), range(51) t(k)", "frames"))
def first_root_center(spark, sf_dir):
    p = views.poses(spark, sf_dir)
    root = p.where("frame = 0").select("clip", F.slice("pose", 1, 3).alias("root"))
    return _long(p.join(root, "clip").withColumn("p", F.transform("pose", lambda v, i: v - F.get("root", i % 3))), "p", "v")


@query(views.sql("+c AS (SELECT clip, frame, j, px - first(px) OVER w AS x, py - first(py) OVER w AS y, pz - first(pz) OVER w AS z FROM joints WINDOW w AS (PARTITION BY clip, frame ORDER BY j)), n AS (SELECT clip, avg(sqrt(x * x + y * y + z * z)) + 1e-6 AS size FROM c GROUP BY clip) SELECT clip, frame, j, round(x / size, 4) + 0.0 AS x, round(y / size, 4) + 0.0 AS y, round(z / size, 4) + 0.0 AS z FROM c JOIN n USING (clip)", "joints"))
def position_encoding(spark, sf_dir):
    """Root-centred positions over the mean length of a clip's points."""
    c = views.poses(spark, sf_dir).withColumn("p", kin.root_centred(F.col("pose"))).select("clip", "frame", F.explode(F.sequence(F.lit(0), F.lit(16))).alias("j"), "p")
    c = c.select("clip", "frame", F.col("j").cast("long").alias("j"), *(F.get("p", 3 * F.col("j") + k).alias(n) for k, n in enumerate("xyz")))
    size = c.groupBy("clip").agg((F.avg(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)) + 1e-6).alias("size"))
    return c.join(size, "clip").select("clip", "frame", "j", *(R(F.col(n) / F.col("size")).alias(n) for n in "xyz"))


@query(views.sql("SELECT clip, frame, round(sqrt((e[31] - (e[10] + e[19]) / 2) ** 2 + (e[32] - (e[11] + e[20]) / 2) ** 2 + (e[33] - (e[12] + e[21]) / 2) ** 2), 4) + 0.0 AS upright FROM frames", "frames"))
def uprightness(spark, sf_dir):
    from ..functions import vec

    ankles = vec.scale(vec.add(vec.at("pose", 3), vec.at("pose", 6)), 0.5)
    return views.poses(spark, sf_dir).select("clip", "frame", R(vec.norm(vec.sub(vec.at("pose", 10), ankles))).alias("upright"))
