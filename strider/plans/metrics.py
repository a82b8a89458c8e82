"""Queries: person metrics, intervals, position and angle errors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import windows
from ..operators.quantiles import quantiles
from ..operators.stored import stored
from . import views
from .catalog import query
from .kinematics import IK, angles

R = lambda c: F.round(c, 4) + 0.0
_FR = """+pf AS (SELECT clip, frame, (max(y) - min(y)) / 480 AS height, least(min(x) / 640, (640 - max(x)) / 640, min(y) / 480, (480 - max(y)) / 480) AS margin FROM joints WHERE conf >= 0.1 GROUP BY clip, frame HAVING count(*) >= 10)"""


#: How much the person is enlarged where the gates are to let some clips pass.
ZOOM = 2.5


def _frames(spark, sf_dir, zoom=1.0):
    j = views.joints(spark, sf_dir, zoom).where("conf >= 0.1")
    mn, mx = F.min, F.max
    f = j.groupBy("clip", "frame").agg(F.count(F.lit(1)).alias("n"), mn("x").alias("x1"), mn("y").alias("y1"), mx("x").alias("x2"), mx("y").alias("y2")).where("n >= 10")
    return f.select("clip", "frame", ((F.col("y2") - F.col("y1")) / 480).alias("height"), F.least(F.col("x1") / 640, (640 - F.col("x2")) / 640, F.col("y1") / 480, (480 - F.col("y2")) / 480).alias("margin"))


def _person(spark, sf_dir, least, zoom=1.0):
    all_clips = views.frames(spark, sf_dir).select("clip").distinct()
    p = _frames(spark, sf_dir, zoom).groupBy("clip").agg(F.avg("height").alias("height"), F.min("margin").alias("margin"), F.avg("margin").alias("mean_margin"), F.avg((F.col("margin") > least).cast("double")).alias("visible"))
    return all_clips.join(p, "clip", "left").na.fill(0.0)


_PERSON = _FR + ", pe AS (SELECT clip, coalesce(avg(height), 0) AS height, coalesce(min(margin), 0) AS margin, coalesce(avg(margin), 0) AS mean_margin, coalesce(avg(CASE WHEN margin > {} THEN 1.0::DOUBLE ELSE 0 END) FILTER (margin IS NOT NULL), 0) AS visible FROM (SELECT DISTINCT clip FROM frames) LEFT JOIN pf USING (clip) GROUP BY clip)"


@query(views.sql(_PERSON.format(0.05) + " SELECT clip, round(height, 4) + 0.0 AS height, round(margin, 4) + 0.0 AS margin, round(mean_margin, 4) + 0.0 AS mean_margin, round(visible, 4) + 0.0 AS visible FROM pe", "joints"))
def person_metrics(spark, sf_dir):
    return _person(spark, sf_dir, 0.05).select("clip", *(R(c).alias(c) for c in ("height", "margin", "mean_margin", "visible")))


#: Least height, margin and share of frames with a visible person, of samples and of intervals.
SAMPLE_GATE = "height >= 0.30 AND margin >= 0.05 AND visible >= 0.80"
INTERVAL_GATE = "disp >= 0.15 AND height >= 0.50 AND margin >= 0.03 AND visible >= 0.90"


@query(views.sql(_PERSON.format(0.05) + f" SELECT clip FROM pe WHERE {SAMPLE_GATE}", "joints", zoom=ZOOM))
def visibility(spark, sf_dir):
    return _person(spark, sf_dir, 0.05, ZOOM).where(SAMPLE_GATE).select("clip")


_STEP = "st AS (SELECT clip, frame, avg(sqrt((px - qx) ** 2 + (py - qy) ** 2 + (pz - qz) ** 2)) AS d FROM (SELECT *, lag(px) OVER w AS qx, lag(py) OVER w AS qy, lag(pz) OVER w AS qz FROM joints WINDOW w AS (PARTITION BY clip, j ORDER BY frame)) GROUP BY clip, frame)"


def _steps(spark, sf_dir):
    w = Window.partitionBy("clip", "j").orderBy("frame")
    j = views.joints(spark, sf_dir).select("clip", "frame", "j", *(F.col(c) - F.lag(c).over(w) for c in ("px", "py", "pz"))).toDF("clip", "frame", "j", "dx", "dy", "dz")
    return j.groupBy("clip", "frame").agg(F.avg(F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2)).alias("d"))


@query(views.sql(f"+{_STEP} SELECT clip, round(sum(d), 4) + 0.0 AS path FROM st GROUP BY clip", "joints"))
def path_length(spark, sf_dir):
    return _steps(spark, sf_dir).groupBy("clip").agg(R(F.sum("d")).alias("path"))


_H = 8
_IV = f"""+w AS (SELECT clip, start FROM (SELECT clip, count(*) AS n FROM frames GROUP BY clip), unnest(CASE WHEN n - {_H} >= 1 THEN range(0, n - {_H}, 2) END) t(start)), {_STEP},
pl AS (SELECT w.clip, start, sum(d) FILTER (frame > start) AS path FROM w JOIN st ON st.clip = w.clip AND frame >= start AND frame < start + {_H} GROUP BY w.clip, start),
vd AS (SELECT w.clip, start, CASE WHEN count(*) FILTER (ok) < 5 THEN 0 ELSE avg(d) FILTER (ok) / max(hh) END AS disp FROM w JOIN (SELECT a.clip, a.frame AS s, abs(a.x) + abs(a.y) > 1 AND abs(b.x) + abs(b.y) > 1 AS ok, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d, greatest(max(a.y) FILTER (abs(a.x) + abs(a.y) > 1) OVER f - min(a.y) FILTER (abs(a.x) + abs(a.y) > 1) OVER f, 1) AS hh FROM joints a JOIN joints b ON a.clip = b.clip AND a.j = b.j AND b.frame = a.frame + {_H - 1} WINDOW f AS (PARTITION BY a.clip, a.frame)) z ON z.clip = w.clip AND z.s = start GROUP BY w.clip, start),
iv AS (SELECT clip, start, path, disp FROM pl JOIN vd USING (clip, start))"""


def intervals(spark, sf_dir, zoom=1.0):
    """clip, start, path, disp. Frames meet their windows by exploding the windows, not by a range join."""
    n = views.frames(spark, sf_dir).groupBy("clip").agg(F.count(F.lit(1)).alias("n"))
    w = windows.candidates(n, _H, 2)
    inside = w.select("clip", "start", F.explode(F.sequence(F.col("start") + 1, F.col("start") + _H - 1)).alias("frame"))
    path = inside.join(_steps(spark, sf_dir), ["clip", "frame"]).groupBy("clip", "start").agg(F.sum("d").alias("path"))
    j = views.joints(spark, sf_dir, zoom).select("clip", "frame", "j", "x", "y", (F.abs("x") + F.abs("y") > 1).alias("ok"))
    a = w.join(j.withColumnRenamed("frame", "start"), ["clip", "start"])
    b = j.select("clip", (F.col("frame") - (_H - 1)).alias("start"), "j", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("ok").alias("ok2"))
    both = F.col("ok") & F.col("ok2")
    m = a.join(b, ["clip", "start", "j"]).groupBy("clip", "start").agg(F.count(F.when(both, 1)).alias("k"), F.avg(F.when(both, F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")))).alias("d"), F.greatest(F.max(F.when(F.col("ok"), F.col("y"))) - F.min(F.when(F.col("ok"), F.col("y"))), F.lit(1.0)).alias("tall"))
    disp = m.select("clip", "start", F.when(F.col("k") < 5, 0.0).otherwise(F.col("d") / F.col("tall")).alias("disp"))
    return path.join(disp, ["clip", "start"])


@query(views.sql(f"{_IV} SELECT clip, start, round(disp, 4) + 0.0 AS disp FROM iv", "joints"))
def visual_disp(spark, sf_dir):
    return intervals(spark, sf_dir).select("clip", "start", R("disp").alias("disp"))


_GATED = f"""{_IV}, fr AS (SELECT clip, frame, (max(y) FILTER (conf >= 0.1) - min(y) FILTER (conf >= 0.1)) / 480 AS height, least(min(x) FILTER (conf >= 0.1) / 640, (640 - max(x) FILTER (conf >= 0.1)) / 640, min(y) FILTER (conf >= 0.1) / 480, (480 - max(y) FILTER (conf >= 0.1)) / 480) AS margin,
  count(*) FILTER (conf >= 0.1) AS seen, count(*) FILTER (abs(x) + abs(y) > 1) AS valid FROM joints GROUP BY clip, frame),
ga AS (SELECT w.clip, start, min(valid) >= 10 AS whole, coalesce(avg(height) FILTER (seen >= 10), 0) AS height, coalesce(min(margin) FILTER (seen >= 10), 0) AS margin, coalesce(avg(CASE WHEN margin > 0.03 THEN 1.0::DOUBLE ELSE 0 END) FILTER (seen >= 10), 0) AS visible FROM w JOIN fr ON fr.clip = w.clip AND frame >= start AND frame < start + {_H} GROUP BY w.clip, start),
iw AS (SELECT * FROM iv JOIN ga USING (clip, start) WHERE whole AND clip % 7 IN (1, 3, 4, 6) AND {INTERVAL_GATE})"""


def gated(found, frames, span):
    """Those of the intervals (clip, start, path, disp) that pass the gate: in all their frames ten joints or more, the person large and inside the picture."""
    inside = found.select("clip", "start", F.explode(F.sequence(F.col("start"), F.col("start") + span - 1)).alias("frame")).join(frames, ["clip", "frame"])
    there = lambda c: F.when(F.col("seen") >= 10, c)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    per = inside.groupBy("clip", "start").agg((F.min("valid") >= 10).alias("whole"), zero(F.avg(there(F.col("height")))).alias("height"), zero(F.min(there(F.col("margin")))).alias("margin"), zero(F.avg(there((F.col("margin") > 0.03).cast("double")))).alias("visible"))
    return found.join(per.where("whole"), ["clip", "start"]).where(INTERVAL_GATE)


def _marked(spark, sf_dir, zoom):
    """clip, frame, height and margin of the detected joints, their number, and that of joints off the corner."""
    seen, s = F.col("conf") >= 0.1, lambda f, c: f(F.when(F.col("conf") >= 0.1, F.col(c)))
    margin = F.least(s(F.min, "x") / 640, (640 - s(F.max, "x")) / 640, s(F.min, "y") / 480, (480 - s(F.max, "y")) / 480)
    return views.joints(spark, sf_dir, zoom).groupBy("clip", "frame").agg(((s(F.max, "y") - s(F.min, "y")) / 480).alias("height"), margin.alias("margin"), F.count(F.when(seen, 1)).alias("seen"), F.count(F.when(F.abs("x") + F.abs("y") > 1, 1)).alias("valid"))


def _best(spark, sf_dir):
    """Intervals that pass, of clips whose class's name has a keyword."""
    named = views.frames(spark, sf_dir).select("clip").distinct().withColumn("name", F.concat(F.lit("Class"), (F.col("clip") % 7).cast("string")))
    wanted = named.where(F.exists(F.array(*map(F.lit, ("class1", "class3", "class4", "class6"))), lambda k: F.contains(F.lower("name"), k))).select("clip")
    return gated(intervals(spark, sf_dir, ZOOM).join(wanted, "clip", "left_semi"), _marked(spark, sf_dir, ZOOM), _H)


@query(views.sql(f"{_GATED} SELECT clip, start, round(height, 4) + 0.0 AS height, round(margin, 4) + 0.0 AS margin, round(visible, 4) + 0.0 AS visible FROM iw", "joints", zoom=ZOOM))
def interval_gate(spark, sf_dir):
    return _best(spark, sf_dir).select("clip", "start", *(R(c).alias(c) for c in ("height", "margin", "visible")))


@query(views.sql(f"{_GATED}, rk AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY round(disp, 6) DESC, start) AS r FROM iw) SELECT clip, start, round(path, 4) + 0.0 AS path, round(disp, 4) + 0.0 AS disp FROM rk WHERE r = 1 ORDER BY round(disp, 6) DESC, clip LIMIT 10", "joints", zoom=ZOOM))
def best_intervals(spark, sf_dir):
    """Of the intervals that pass the gate the best of each clip, then the ten best: a top-k report."""
    w = Window.partitionBy("clip").orderBy(F.round("disp", 6).desc(), "start")
    best = _best(spark, sf_dir).withColumn("r", F.row_number().over(w)).where("r = 1")
    return best.orderBy(F.round("disp", 6).desc(), "clip").limit(10).select("clip", "start", R("path").alias("path"), R("disp").alias("disp"))


_AN = f"{IK}, ra AS (SELECT t.clip, t.frame, t.k, t.angle, p.angle AS pred FROM ik t JOIN (SELECT clip, frame + 1 AS frame, k, angle FROM ik) p USING (clip, frame, k))"


def _angle_pairs(spark, sf_dir):
    """clip, frame, angles and pred: true and predicted angles of the frames that have a prediction."""
    true = angles(spark, sf_dir).select("clip", "frame", "angles")
    return true.join(views.predicted(true, "angles", "pred"), ["clip", "frame"])


def _rmse(df):
    sq = F.aggregate(F.zip_with("angles", "pred", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return df.groupBy("clip").agg(F.degrees(F.sqrt(F.sum(sq) / F.sum(F.size("angles")))).alias("rmse"))


@query(views.sql(f"{_AN} SELECT clip, round(degrees(sqrt(avg((pred - angle) ** 2))), 4) + 0.0 AS rmse FROM ra GROUP BY clip", "frames"))
def angle_rmse(spark, sf_dir):
    return _rmse(_angle_pairs(spark, sf_dir)).select("clip", R("rmse").alias("rmse"))


@query(views.sql(f"{_AN}, c AS (SELECT clip, degrees(sqrt(avg((pred - angle) ** 2))) AS rmse FROM ra GROUP BY clip) SELECT clip, round(rmse, 4) + 0.0 AS rmse FROM c ORDER BY round(rmse, 9), clip LIMIT 10", "frames"))
def lowest_rmse(spark, sf_dir):
    """The ten clips of the least angle error: a top-k report."""
    return _rmse(_angle_pairs(spark, sf_dir)).orderBy(F.round("rmse", 9), "clip").limit(10).select("clip", R("rmse").alias("rmse"))


@query(views.sql(f"{IK}, dm AS (SELECT clip, k, abs(angle - lag(angle) OVER (PARTITION BY clip, k ORDER BY frame)) AS d FROM ik) SELECT clip, round(sum(d), 3) + 0.0 AS motion FROM dm GROUP BY clip", "frames"))
def angular_motion(spark, sf_dir):
    a = angles(spark, sf_dir).withColumn("before", F.lag("angles").over(Window.partitionBy("clip").orderBy("frame"))).where("before IS NOT NULL")
    moved = F.aggregate(F.zip_with("angles", "before", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    return a.groupBy("clip").agg((F.round(F.sum(moved), 3) + 0.0).alias("motion"))


_ER = "+er AS (SELECT t.clip, t.frame, t.j, sqrt((t.px - p.px) ** 2 + (t.py - p.py) ** 2 + (t.pz - p.pz) ** 2) AS d FROM joints t JOIN (SELECT clip, frame + 1 AS frame, j, px, py, pz FROM joints) p USING (clip, frame, j))"


def _errors(spark, sf_dir):
    """clip, frame, j, d: the distance of each predicted joint; poses are joined as rows of a frame, joints come after."""
    true = views.poses(spark, sf_dir)
    both = true.join(views.predicted(true, "pose", "pred"), ["clip", "frame"])
    d = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda j: F.sqrt(sum((F.get("pose", j * 3 + k) - F.get("pred", j * 3 + k)) ** 2 for k in range(3))))
    return both.select("clip", "frame", F.posexplode(d).alias("j", "d")).withColumn("j", F.col("j").cast("long"))


@query(views.sql(f"{_ER} SELECT clip, round(avg(d) * 1000, 3) + 0.0 AS mpjpe FROM er WHERE j <> 10 GROUP BY clip", "joints"))
def mpjpe(spark, sf_dir):
    return _errors(spark, sf_dir).where("j <> 10").groupBy("clip").agg((F.round(F.avg("d") * 1000, 3) + 0.0).alias("mpjpe"))


@query(views.sql(f"{_ER} SELECT clip, round(avg(CASE WHEN d * 1000 < 150 THEN 100.0::DOUBLE ELSE 0 END), 3) + 0.0 AS pck FROM er GROUP BY clip", "joints"))
def pck(spark, sf_dir):
    return _errors(spark, sf_dir).groupBy("clip").agg((F.round(F.avg(F.when(F.col("d") * 1000 < 150, 100.0).otherwise(0.0)), 3) + 0.0).alias("pck"))


@query(views.sql(f"{_ER}, pc AS (SELECT clip, j, avg(d) AS d FROM er GROUP BY clip, j) SELECT j, round(avg(d) * 1000, 3) + 0.0 AS error FROM pc GROUP BY j", "joints"))
def per_joint_error(spark, sf_dir):
    return _errors(spark, sf_dir).groupBy("clip", "j").agg(F.avg("d").alias("d")).groupBy("j").agg((F.round(F.avg("d") * 1000, 3) + 0.0).alias("error"))


@query(views.sql(f"{_ER}, pc AS (SELECT clip, avg(d) * 1000 AS m FROM er GROUP BY clip) SELECT round(avg(m), 3) + 0.0 AS mean, round(quantile_cont(m, 0.5), 3) + 0.0 AS median, round(stddev_pop(m), 3) + 0.0 AS std, round(min(m), 3) + 0.0 AS least, round(max(m), 3) + 0.0 AS most, count(*) AS n FROM pc", "joints"))
def metric_summary(spark, sf_dir):
    m = stored(_errors(spark, sf_dir).groupBy("clip").agg((F.avg("d") * 1000).alias("m")))
    median = quantiles(m, [], "m", {"median": 0.5})  # one row
    r = lambda c: F.round(c, 3) + 0.0
    rest = m.agg(r(F.avg("m")).alias("mean"), r(F.stddev_pop("m")).alias("std"), r(F.min("m")).alias("least"), r(F.max("m")).alias("most"), F.count(F.lit(1)).alias("n"))
    return rest.join(F.broadcast(median.select(r(F.col("median")).alias("median"))), how="left").select("mean", "median", "std", "least", "most", "n")


@query(views.sql(f"{_ER} SELECT frame, round(avg(d), 4) + 0.0 AS d, round(sqrt(avg(d * d)) * 100, 4) + 0.0 AS rmse FROM er GROUP BY frame", "joints"))
def trajectory_error(spark, sf_dir):
    return _errors(spark, sf_dir).groupBy("frame").agg(R(F.avg("d")).alias("d"), R(F.sqrt(F.avg(F.col("d") * F.col("d"))) * 100).alias("rmse"))


_BS = _PERSON.format(0.05) + f", {_ER[1:]}, ls AS (SELECT clip, avg(d) AS loss FROM er GROUP BY clip), sa AS (SELECT clip FROM (SELECT DISTINCT clip FROM frames WHERE clip % 10 <> 9) ORDER BY md5('42-' || clip), clip LIMIT 500), sc AS (SELECT clip, loss, {SAMPLE_GATE} AS ok, 100 / (loss + 1) AS score FROM pe JOIN ls USING (clip) SEMI JOIN sa USING (clip))"


def _scored(spark, sf_dir):
    """A seeded sample of clips whose class is not excluded, with loss, gate and score: the sample is the operator's own."""
    clips = views.frames(spark, sf_dir).select("clip").distinct()
    excluded = clips.where("clip % 10 = 9")
    sample = clips.join(excluded, "clip", "left_anti").orderBy(F.md5(F.concat(F.lit("42-"), F.col("clip").cast("string")).cast("binary")), "clip").limit(500)
    loss = _errors(spark, sf_dir).groupBy("clip").agg(F.avg("d").alias("loss"))
    return _person(spark, sf_dir, 0.05, ZOOM).join(loss, "clip").join(sample, "clip", "left_semi").withColumns({"ok": F.expr(SAMPLE_GATE), "score": 100 / (F.col("loss") + 1)})


@query(views.sql(f"{_BS} SELECT clip, round(loss, 5) + 0.0 AS loss, round(score, 4) + 0.0 AS score FROM sc WHERE ok ORDER BY round(loss, 9), clip LIMIT 10", "joints", zoom=ZOOM))
def best_samples(spark, sf_dir):
    """The ten lowest losses among clips that pass the gate: a top-k report."""
    return _scored(spark, sf_dir).where("ok").orderBy(F.round("loss", 9), "clip").limit(10).select("clip", (F.round("loss", 5) + 0.0).alias("loss"), R("score").alias("score"))


@query(views.sql(f"{_BS} SELECT count(*) AS n, count(*) FILTER (ok) AS passed, round(min(loss), 5) + 0.0 AS least, round(avg(loss), 5) + 0.0 AS mean, round(max(CASE WHEN ok THEN score ELSE 0 END), 4) + 0.0 AS best FROM sc", "joints", zoom=ZOOM))
def sample_summary(spark, sf_dir):
    return _scored(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("ok"), 1)).alias("passed"), (F.round(F.min("loss"), 5) + 0.0).alias("least"), (F.round(F.avg("loss"), 5) + 0.0).alias("mean"), R(F.max(F.when(F.col("ok"), F.col("score")).otherwise(0.0))).alias("best"))


_SEEN = "+pb AS (SELECT clip, frame, k, cx - s * w / 2 AS x1, cy - s * h / 2 AS y1, cx + s * w / 2 AS x2, cy + s * h / 2 AS y2 FROM (SELECT clip, frame, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, x2 - x1 AS w, y2 - y1 AS h, k, 1 + 0.25 * ((clip + frame + 2 * k) % 3) AS s FROM boxes, range(4) t(k) WHERE x1 IS NOT NULL))"


def _detections(spark, sf_dir):
    """Four boxes in each frame, some of equal size."""
    b = views.boxes(spark, sf_dir).where("x1 IS NOT NULL").select("clip", "frame", ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("k"))
    s = 1 + 0.25 * ((F.col("clip") + F.col("frame") + 2 * F.col("k")) % 3)
    return b.select("clip", "frame", "k", *((F.col(c) + f * s * F.col(d) / 2).alias(n) for n, c, d, f in (("x1", "cx", "w", -1), ("y1", "cy", "h", -1), ("x2", "cx", "w", 1), ("y2", "cy", "h", 1))))


@query(views.sql(f"{_SEEN} SELECT clip, frame, k FROM (SELECT *, row_number() OVER (PARTITION BY clip, frame ORDER BY round((x2 - x1) * (y2 - y1), 6) DESC, k) AS r FROM pb) WHERE r = 1", "boxes"))
def largest_box(spark, sf_dir):
    """The largest box of each frame, the first of equals: a maximum by area and place, without a sort."""
    area = F.round((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")), 6)
    return _detections(spark, sf_dir).groupBy("clip", "frame").agg(F.max(F.struct(area.alias("area"), (-F.col("k")).alias("k"))).alias("best")).select("clip", "frame", (-F.col("best.k")).alias("k"))


@query(views.sql("+s AS (SELECT label, body, sum(conf) AS s FROM (SELECT clip // 3 AS label, clip % 3 AS body, conf FROM joints) GROUP BY label, body) SELECT label, body FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(s, 6) DESC, body) AS r FROM s) WHERE r = 1", "joints"))
def best_body(spark, sf_dir):
    s = views.joints(spark, sf_dir).groupBy(F.floor(F.col("clip") / 3).alias("label"), (F.col("clip") % 3).alias("body")).agg(F.round(F.sum("conf"), 6).alias("s"))
    return s.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("s"), "body"))).where("r = 1").select("label", "body")
