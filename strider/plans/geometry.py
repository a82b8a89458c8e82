"""Queries: screen and box geometry, joint maps, alignment, render helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vec
from ..operators.kinematics import EDGES
from . import views
from .catalog import query

R = lambda c: F.round(c, 4) + 0.0
W, H = float(views.WIDTH), float(views.HEIGHT)
#: 25-joint ids for the 17 joints.
NTU = (0, 16, 17, 18, 12, 13, 14, 20, 2, 3, 3, 4, 5, 6, 8, 9, 10)
#: 17-joint places of the copied COCO joints.
H36M_FROM_COCO = {9: 0, 11: 5, 14: 6, 12: 7, 15: 8, 13: 9, 16: 10, 4: 11, 1: 12, 5: 13, 2: 14, 6: 15, 3: 16}


@query(views.sql("SELECT clip, frame, j, round(2 * x / 640 - 1, 4) + 0.0 AS u, round(2 * y / 640 - 480 / 640, 4) + 0.0 AS v FROM joints", "joints"))
def screen_norm(spark, sf_dir):
    return views.joints(spark, sf_dir).select("clip", "frame", "j", R(2 * F.col("x") / W - 1).alias("u"), R(2 * F.col("y") / W - H / W).alias("v"))


_BN = "SELECT clip, frame, j, round(2 * (x - x1) / greatest(x2 - x1, 1) - 1, 4) + 0.0 AS u, round(2 * (y - y1) / greatest(x2 - x1, 1) - greatest(y2 - y1, 1) / greatest(x2 - x1, 1), 4) + 0.0 AS v{} FROM joints JOIN boxes USING (clip, frame) WHERE x1 IS NOT NULL"


def _in_box(spark, sf_dir):
    j = views.joints(spark, sf_dir).join(views.boxes(spark, sf_dir).where("x1 IS NOT NULL"), ["clip", "frame"])
    w, h = F.greatest(F.col("x2") - F.col("x1"), F.lit(1.0)), F.greatest(F.col("y2") - F.col("y1"), F.lit(1.0))
    return j.select("clip", "frame", "j", R(2 * (F.col("x") - F.col("x1")) / w - 1).alias("u"), R(2 * (F.col("y") - F.col("y1")) / w - h / w).alias("v"), "conf")


@query(views.sql(_BN.format(""), "boxes"))
def box_norm(spark, sf_dir):
    return _in_box(spark, sf_dir).drop("conf")


@query(views.sql(_BN.format(", round(conf, 4) + 0.0 AS conf"), "boxes"))
def model_input(spark, sf_dir):
    return _in_box(spark, sf_dir).withColumn("conf", R("conf"))


def coco_points(df, x: str = "xs"):
    """17 expressions of one coordinate of the 17-joint pose from the array of COCO coordinates `x`, and whether it is y."""
    k = lambda j: F.get(F.col(x), F.lit(j))
    mean = lambda *js: sum((k(j) for j in js[1:]), k(js[0])) / len(js)

    def axis(y: bool):
        p = {h: k(c) for h, c in H36M_FROM_COCO.items()}
        sho = mean(5, 6)
        p[10] = k(1) + k(2) - k(0) if y else mean(1, 2, 3, 4)
        p[8] = sho + (k(0) - sho) / 3
        p[0] = mean(11, 12)
        p[7] = mean(5, 6, 11, 12)
        p[9] = p[9] - (p[9] - sho) / 4
        if y:
            p[8] = p[8] - (mean(1, 2) - k(0)) * 2 / 3
        else:
            p[7] = p[7] + 2 * (p[7] - (p[0] + p[8]) / 2)
        return F.array(*(p[j] for j in range(17)))

    return axis


_COCO = """+c AS (SELECT clip, frame, list(x ORDER BY j) AS x, list(y ORDER BY j) AS y, list(conf ORDER BY j) AS s FROM joints GROUP BY clip, frame),
h AS (SELECT *, (x[6] + x[7]) / 2 AS sx, (y[6] + y[7]) / 2 AS sy, (x[12] + x[13]) / 2 AS px, (y[12] + y[13]) / 2 AS py FROM c),
t AS (SELECT *, sx + (x[1] - sx) / 3 AS tx, sy + (y[1] - sy) / 3 AS ty, (x[6] + x[7] + x[12] + x[13]) / 4 AS mx, (y[6] + y[7] + y[12] + y[13]) / 4 AS my FROM h),
o AS (SELECT clip, frame, [px, x[13], x[15], x[17], x[12], x[14], x[16], mx + 2 * (mx - (px + tx) / 2), tx, x[1] - (x[1] - sx) / 4, (x[2] + x[3] + x[4] + x[5]) / 4, x[6], x[8], x[10], x[7], x[9], x[11]] AS u,
  [py, y[13], y[15], y[17], y[12], y[14], y[16], my, ty - ((y[2] + y[3]) / 2 - y[1]) * 2 / 3, y[1] - (y[1] - sy) / 4, y[2] + y[3] - y[1], y[6], y[8], y[10], y[7], y[9], y[11]] AS v,
  [(s[12] + s[13]) / 2, s[13], s[15], s[17], s[12], s[14], s[16], ((s[12] + s[13]) / 2 + (s[6] + s[7]) / 2) / 2, (s[6] + s[7]) / 2, s[1], (s[2] + s[3] + s[4] + s[5]) / 4, s[6], s[8], s[10], s[7], s[9], s[11]] AS w FROM t)"""


def _coco(spark, sf_dir):
    g = views.joints(spark, sf_dir).groupBy("clip", "frame").agg(F.array_sort(F.collect_list(F.struct("j", "x", "y", "conf"))).alias("p"))
    return g.select("clip", "frame", F.col("p.x").alias("xs"), F.col("p.y").alias("ys"), F.col("p.conf").alias("ss"))


@query(views.sql(f"{_COCO} SELECT clip, frame, j, round(u[j + 1], 3) + 0.0 AS x, round(v[j + 1], 3) + 0.0 AS y FROM o, range(17) r(j) WHERE list_sum(u) + list_sum(v) <> 0", "joints"))
def coco_to_h36m(spark, sf_dir):
    g = _coco(spark, sf_dir).select("clip", "frame", coco_points(None, "xs")(False).alias("u"), coco_points(None, "ys")(True).alias("v"))
    total = F.aggregate(F.concat("u", "v"), F.lit(0.0), lambda a, x: a + x)
    return g.where(total != 0).select("clip", "frame", F.posexplode(F.arrays_zip("u", "v")).alias("j", "p")).select("clip", "frame", F.col("j").cast("long").alias("j"), (F.round("p.u", 3) + 0.0).alias("x"), (F.round("p.v", 3) + 0.0).alias("y"))


@query(views.sql(f"{_COCO} SELECT clip, frame, j, round(w[j + 1], 4) + 0.0 AS score FROM o, range(17) r(j)", "joints"))
def h36m_scores(spark, sf_dir):
    s = lambda j: F.get("ss", F.lit(j))
    hip, sho = (s(11) + s(12)) / 2, (s(5) + s(6)) / 2
    made = {0: hip, 8: sho, 7: (hip + sho) / 2, 10: (s(1) + s(2) + s(3) + s(4)) / 4}
    arr = F.array(*(made[h] if h in made else s(H36M_FROM_COCO[h]) for h in range(17)))
    return _coco(spark, sf_dir).select("clip", "frame", F.posexplode(arr).alias("j", "score")).select("clip", "frame", F.col("j").cast("long").alias("j"), R("score").alias("score"))


@query(views.sql("SELECT clip, frame, j, round(e[[0, 16, 17, 18, 12, 13, 14, 20, 2, 3, 3, 4, 5, 6, 8, 9, 10][j + 1] + 1], 4) + 0.0 AS v FROM frames, range(17) t(j)", "frames"))
def ntu_map(spark, sf_dir):
    """The first 25 numbers stand for one coordinate of 25 joints."""
    m = F.array(*map(F.lit, NTU))
    return views.frames(spark, sf_dir).select("clip", "frame", F.posexplode(F.transform(m, lambda i: F.get("e", i))).alias("j", "v")).select("clip", "frame", F.col("j").cast("long").alias("j"), R("v").alias("v"))


def _pairs(spark, sf_dir):
    """Seen joints of each frame and of the clip's first frame."""
    j = views.joints(spark, sf_dir).where("conf >= 0.1").select("clip", "frame", "j", "x", "y")
    first = j.where("frame = 0").select("clip", "j", F.col("x").alias("tx"), F.col("y").alias("ty"))
    return j.join(first, ["clip", "j"])


def fit_2d(df, keys, cx, cy, ctx, cty):
    """Rotation, scale and means or anchors of the best turn from (x, y) to (tx, ty), by the closed form of two dimensions."""
    a, b, c, d = F.col("x") - cx, F.col("y") - cy, F.col("tx") - ctx, F.col("ty") - cty
    m = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(a * c).alias("xx"), F.sum(a * d).alias("xy"), F.sum(b * c).alias("yx"), F.sum(b * d).alias("yy"), F.sum(a * a + b * b).alias("var"))
    turn = F.atan2(F.col("xy") - F.col("yx"), F.col("xx") + F.col("yy"))
    sigma = F.sqrt(F.col("xx") ** 2 + F.col("xy") ** 2 + F.col("yx") ** 2 + F.col("yy") ** 2 + 2 * F.abs(F.col("xx") * F.col("yy") - F.col("xy") * F.col("yx")))
    return m.select(*keys, "n", turn.alias("turn"), F.when(F.col("var") > 1e-8, sigma / F.nullif(F.col("var"), F.lit(0.0))).otherwise(1.0).alias("scale"))


_PAIR = "+pr AS (SELECT a.clip, a.frame, a.j, a.x, a.y, b.x AS tx, b.y AS ty FROM joints a JOIN joints b ON a.clip = b.clip AND a.j = b.j AND b.frame = 0 WHERE a.conf >= 0.1 AND b.conf >= 0.1)"
_FIT = "SELECT clip, frame, n, round(atan2(xy - yx, xx + yy), 4) + 0.0 AS turn, round(CASE WHEN var > 1e-8 THEN sqrt(xx * xx + xy * xy + yx * yx + yy * yy + 2 * abs(xx * yy - xy * yx)) / var ELSE 1 END, 4) + 0.0 AS scale FROM (SELECT clip, frame, count(*) AS n, sum((x - cx) * (tx - dx)) AS xx, sum((x - cx) * (ty - dy)) AS xy, sum((y - cy) * (tx - dx)) AS yx, sum((y - cy) * (ty - dy)) AS yy, sum((x - cx) ** 2 + (y - cy) ** 2) AS var FROM ce GROUP BY clip, frame) WHERE n >= 3"


@query(views.sql(f"{_PAIR}, ce AS (SELECT *, avg(x) OVER w AS cx, avg(y) OVER w AS cy, avg(tx) OVER w AS dx, avg(ty) OVER w AS dy FROM pr WINDOW w AS (PARTITION BY clip, frame)) {_FIT}", "joints"))
def procrustes_2d(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    mean = p.groupBy("clip", "frame").agg(*(F.avg(c).alias(f"m{c}") for c in ("x", "y", "tx", "ty")))
    f = fit_2d(p.join(mean, ["clip", "frame"]), ["clip", "frame"], F.col("mx"), F.col("my"), F.col("mtx"), F.col("mty"))
    return f.where("n >= 3").withColumns({"turn": R("turn"), "scale": R("scale")})


@query(views.sql(f"{_PAIR}, ce AS (SELECT *, first(x) OVER w AS cx, first(y) OVER w AS cy, first(tx) OVER w AS dx, first(ty) OVER w AS dy FROM pr WINDOW w AS (PARTITION BY clip, frame ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) {_FIT}", "joints"))
def similarity_2d(spark, sf_dir):
    """Anchored at the first shared point instead of the mean."""
    p = _pairs(spark, sf_dir)
    first = p.groupBy("clip", "frame").agg(*(F.min_by(c, "j").alias(f"m{c}") for c in ("x", "y", "tx", "ty")))
    f = fit_2d(p.join(first, ["clip", "frame"]), ["clip", "frame"], F.col("mx"), F.col("my"), F.col("mtx"), F.col("mty"))
    return f.where("n >= 3").withColumns({"turn": R("turn"), "scale": R("scale")})


@query(views.sql("SELECT clip, frame, j, round(px * 0.8 * least(greatest(x2 - x1, 10), greatest(y2 - y1, 10)) + (x1 + x2) / 2, 3) + 0.0 AS u, round(py * 0.8 * least(greatest(x2 - x1, 10), greatest(y2 - y1, 10)) + (y1 + y2) / 2, 3) + 0.0 AS v FROM joints JOIN boxes USING (clip, frame)", "boxes"))
def project_box(spark, sf_dir):
    j = views.joints(spark, sf_dir).join(views.boxes(spark, sf_dir), ["clip", "frame"])
    s = 0.8 * F.least(F.greatest(F.col("x2") - F.col("x1"), F.lit(10.0)), F.greatest(F.col("y2") - F.col("y1"), F.lit(10.0)))
    ok = F.col("x1").isNotNull()
    return j.select("clip", "frame", "j", *((F.round(F.when(ok, F.col(p) * s + (F.col(a) + F.col(b)) / 2), 3) + 0.0).alias(n) for p, a, b, n in (("px", "x1", "x2", "u"), ("py", "y1", "y2", "v"))))


@query(views.sql("+k AS (SELECT clip, frame, greatest(0, floor(x1 - 0.2 * (x2 - x1))) AS l, greatest(0, floor(y1 - 0.2 * (y2 - y1))) AS t, least(640, floor(x2 + 0.2 * (x2 - x1))) AS r, least(480, floor(y2 + 0.2 * (y2 - y1))) AS b FROM boxes WHERE x1 IS NOT NULL) SELECT clip, frame, l::BIGINT AS l, t::BIGINT AS t, r::BIGINT AS r, b::BIGINT AS b FROM k WHERE r - l >= 10 AND b - t >= 10", "boxes"))
def crop_box(spark, sf_dir):
    w, h = 0.2 * (F.col("x2") - F.col("x1")), 0.2 * (F.col("y2") - F.col("y1"))
    zero = F.lit(0).cast("long")
    k = views.boxes(spark, sf_dir).where("x1 IS NOT NULL").select("clip", "frame", F.greatest(zero, F.floor(F.col("x1") - w)).alias("l"), F.greatest(zero, F.floor(F.col("y1") - h)).alias("t"), F.least(F.lit(640).cast("long"), F.floor(F.col("x2") + w)).alias("r"), F.least(F.lit(480).cast("long"), F.floor(F.col("y2") + h)).alias("b"))
    return k.where("r - l >= 10 AND b - t >= 10")


@query(views.sql("SELECT clip, frame, least(greatest(trunc(x1), 0), 639)::BIGINT AS x1, least(greatest(trunc(y1), 0), 479)::BIGINT AS y1, least(greatest(trunc(x2), 0), 639)::BIGINT AS x2, least(greatest(trunc(y2), 0), 479)::BIGINT AS y2 FROM boxes WHERE x1 IS NOT NULL", "boxes"))
def clamp_box(spark, sf_dir):
    cut = lambda c, most: F.least(F.greatest(F.col(c).cast("long"), F.lit(0).cast("long")), F.lit(most).cast("long")).alias(c)
    return views.boxes(spark, sf_dir).where("x1 IS NOT NULL").select("clip", "frame", cut("x1", 639), cut("y1", 479), cut("x2", 639), cut("y2", 479))


@query("SELECT DISTINCT user_id AS id, CASE WHEN w % 2 = 1 THEN w - 1 ELSE w END AS width, 480::BIGINT AS height FROM (SELECT user_id, floor(480 * ((100 + user_id) / 100.0::DOUBLE))::BIGINT AS w FROM events)")
def resize_plan(spark, sf_dir):
    """Height 480 and an even width of the same aspect; ids stand for aspects."""
    w = F.floor(480 * ((100 + F.col("user_id")) / F.lit(100.0)))
    return views.table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), (w - w % 2).alias("width"), F.lit(480).cast("long").alias("height")).distinct()


@query(views.sql("SELECT clip, frame, j, round(px - first(px) OVER w, 4) + 0.0 AS x, round(pz - first(pz) OVER w, 4) + 0.0 AS y, round(-(py - first(py) OVER w), 4) + 0.0 AS z FROM joints WINDOW w AS (PARTITION BY clip, frame ORDER BY j)", "joints"))
def axis_remap(spark, sf_dir):
    j = views.joints(spark, sf_dir).select("clip", "frame", "j", "px", "py", "pz")
    root = views.poses(spark, sf_dir).select("clip", "frame", *(F.get("pose", F.lit(k)).alias(f"r{k}") for k in range(3)))
    d = lambda c, k: F.col(c) - F.col(f"r{k}")
    return j.join(root, ["clip", "frame"]).select("clip", "frame", "j", R(d("px", 0)).alias("x"), R(d("pz", 2)).alias("y"), R(-d("py", 1)).alias("z"))


_E = ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(EDGES))


def _edges(spark, sf_dir):
    e = F.broadcast(spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(EDGES)], "edge long, a long, b long"))  # 16 rows
    j = views.joints(spark, sf_dir)
    side = lambda n: j.select("clip", "frame", *(F.col(c).alias(f"{n}_{c}") for c in ("j", "x", "y", "conf", "px", "py", "pz")))
    left = side("a").join(e, F.col("a_j") == F.col("a"))
    return left.join(side("b").withColumnRenamed("b_j", "b"), ["clip", "frame", "b"])


@query(views.sql(f"SELECT a.clip, a.frame, edge::BIGINT AS edge FROM (VALUES {_E}) t(edge, i, k) JOIN joints a ON a.j = i JOIN joints b ON b.j = k AND a.clip = b.clip AND a.frame = b.frame WHERE a.conf >= 0.15 AND b.conf >= 0.15 AND a.x BETWEEN -640 AND 1280 AND b.x BETWEEN -640 AND 1280 AND a.y BETWEEN -480 AND 960 AND b.y BETWEEN -480 AND 960", "joints"))
def drawable_bones(spark, sf_dir):
    ok = lambda n: (F.col(f"{n}_conf") >= 0.15) & F.col(f"{n}_x").between(-640, 1280) & F.col(f"{n}_y").between(-480, 960)
    return _edges(spark, sf_dir).where(ok("a") & ok("b")).select("clip", "frame", "edge")


@query(views.sql(f"""+b AS (SELECT a.clip, a.frame, edge::BIGINT AS edge, (a.px + c.px) / 2 AS mx, (a.py + c.py) / 2 AS my, (a.pz + c.pz) / 2 AS mz, c.px - a.px AS x, c.py - a.py AS y, c.pz - a.pz AS z FROM (VALUES {_E}) t(edge, i, k) JOIN joints a ON a.j = i JOIN joints c ON c.j = k AND a.clip = c.clip AND a.frame = c.frame),
l AS (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM b), u AS (SELECT *, greatest(-1, least(1, z / n)) AS d, -y / n AS qx, x / n AS qy FROM l)
SELECT clip, frame, edge, round(mx, 4) + 0.0 AS mx, round(my, 4) + 0.0 AS my, round(mz, 4) + 0.0 AS mz, round(n / 2, 4) + 0.0 AS half, round(CASE WHEN d > 0.9999 THEN 1 WHEN d < -0.9999 THEN 0 ELSE (1 + d) / sqrt((1 + d) ** 2 + qx * qx + qy * qy) END, 3) + 0.0 AS qw,
  round(CASE WHEN d > 0.9999 OR d < -0.9999 THEN 0 ELSE qx / sqrt((1 + d) ** 2 + qx * qx + qy * qy) END, 3) + 0.0 AS qx, round(CASE WHEN d > 0.9999 THEN 0 WHEN d < -0.9999 THEN 1 ELSE qy / sqrt((1 + d) ** 2 + qx * qx + qy * qy) END, 3) + 0.0 AS qy, 0.0::DOUBLE AS qz FROM u""", "joints"))
def capsules(spark, sf_dir):
    e = _edges(spark, sf_dir)
    e = e.withColumns({f"d{k}": F.col(f"b_p{c}") - F.col(f"a_p{c}") for k, c in enumerate("xyz")})
    e = e.withColumn("n", vec.norm(tuple(F.col(f"d{k}") for k in range(3))))
    e = e.withColumns({f"u{k}": F.col(f"d{k}") / (F.col("n") + 1e-10) for k in range(3)})
    q = vec.quaternion(vec.lit(0, 0, 1), tuple(F.col(f"u{k}") for k in range(3)))
    return e.select("clip", "frame", "edge", *(R((F.col(f"a_p{c}") + F.col(f"b_p{c}")) / 2).alias(f"m{c}") for c in "xyz"), R(F.col("n") / 2).alias("half"), *((F.round(c, 3) + 0.0).alias(f"q{n}") for n, c in zip("wxyz", q)))


@query(views.sql("SELECT clip, frame, j, greatest(0, least(639, round_even(x, 0)))::BIGINT AS u, greatest(0, least(479, round_even(y, 0)))::BIGINT AS v FROM joints WHERE conf >= 0.1 AND x > -640 AND x < 1280 AND y > -480 AND y < 960", "joints"))
def drawn_points(spark, sf_dir):
    """Joints near the picture, rounded (halves to even) and clamped into it."""
    near = F.col("x").isNotNull() & ~F.isnan("x") & ~F.isnan("y") & (F.col("x") > -640) & (F.col("x") < 1280) & (F.col("y") > -480) & (F.col("y") < 960)
    at = lambda c, most: F.greatest(F.lit(0.0), F.least(F.lit(float(most)), F.rint(c))).cast("long")
    return views.joints(spark, sf_dir).where((F.col("conf") >= 0.1) & near).select("clip", "frame", "j", at("x", 639).alias("u"), at("y", 479).alias("v"))
