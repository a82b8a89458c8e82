"""Queries that compose operators: samples, export rows, pose evaluation, validation reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import kinematics as kin
from ..operators import quality as rules
from ..operators import windows
from ..operators.quantiles import quantiles
from ..operators.stored import stored
from ..sources import files
from . import quality, views
from .catalog import query
from .kinematics import IK

R = lambda c: F.round(c, 4) + 0.0


@query(views.sql("SELECT clip, n, n >= 10 AS at_least_10, n >= 16 AS at_least_16, n >= 20 AS at_least_20, n >= 30 AS at_least_30 FROM (SELECT clip, count(*) AS n FROM frames GROUP BY clip)", "frames"))
def length_gates(spark, sf_dir):
    n = views.frames(spark, sf_dir).groupBy("clip").agg(F.count(F.lit(1)).alias("n"))
    return n.select("clip", "n", *((F.col("n") >= k).alias(f"at_least_{k}") for k in (10, 16, 20, 30)))


_MIRROR = ", ".join(str(j) for j in (0, 4, 5, 6, 1, 2, 3, 7, 8, 9, 10, 14, 15, 16, 11, 12, 13))
_SAMPLES = f"""+fl AS (SELECT clip * 2 + f AS clip, frame, CASE WHEN f = 0 THEN e ELSE flatten(list_transform([{_MIRROR}], lambda s: [-e[3 * s + 1], e[3 * s + 2], e[3 * s + 3]])) END AS e FROM frames, range(2) t(f)), {IK[1:].replace("FROM frames", "FROM fl")},
nn AS (SELECT clip, count(*) AS n FROM frames GROUP BY clip),
ws AS (SELECT clip, n, start, f FROM nn, unnest(CASE WHEN n - 16 >= 4 THEN range(4, n - 15, 16) END) t(start), range(2) u(f))
SELECT ws.clip, start, f = 1 AS flipped, count(*) AS n_actions, round(sum(sin(angle) + (k + 1) * cos(angle)), 3) + 0.0 AS actions, round(sum(sin(angle) + (k + 1) * cos(angle)) FILTER (ik.frame = start), 3) + 0.0 AS state,
  any_value(2 * (start - 4) || ',' || 2 * (start - 3) || ',' || 2 * (start - 2) || ',' || 2 * (start - 1)) AS images,
  any_value('{text.TASK}c' || ws.clip % 12 || '{text.INSTRUCTION}' || CASE WHEN f = 1 THEN 'raise the right arm, then step Left' ELSE 'raise the left arm, then step Right' END || ' Progress: ' || printf('%.1f', start / 10.0::DOUBLE) || 's/' || printf('%.1f', n / 10.0::DOUBLE) || 's (' || printf('%.0f', start / n::DOUBLE * 100) || '%)' || '{text.FOCUS.format("1.6")}') AS instruction,
  any_value('c' || ws.clip % 12 || '/' || ws.clip) AS seq_name
FROM ws JOIN ik ON ik.clip = ws.clip * 2 + f AND ik.frame >= start AND ik.frame < start + 16 GROUP BY ws.clip, start, f"""


def training_samples(poses, lengths, captions, horizon=16, history=4, stride=16):
    """One row for each window of a clip, plain and flipped: clip, start, flipped, actions (sines and cosines of its angles, frame by frame), state (those of its first frame), images (video frames of the history) and instruction.

    poses: clip, frame, src (its video frame), pose; captions: clip, class, body. Windows meet their
    frames by exploding, flips are rows, and angles are computed once for each row.
    """
    w = windows.training(lengths, horizon, history, stride).withColumn("flipped", F.explode(F.array(F.lit(False), F.lit(True))))
    inside = w.select("*", F.explode(F.sequence(F.col("start"), F.col("start") + horizon - 1)).alias("frame")).join(poses.select("clip", "frame", "pose"), ["clip", "frame"])
    turned = inside.withColumn("pose", F.when(F.col("flipped"), kin.flip(F.col("pose"))).otherwise(F.col("pose")))
    encoded = kin.joint_angles(turned).withColumn("v", kin.sin_cos(F.col("angles")))
    made = encoded.groupBy("clip", "start", "flipped").agg(F.array_sort(F.collect_list(F.struct("frame", "v"))).alias("rows"))
    made = made.select("clip", "start", "flipped", F.transform("rows", lambda r: r["v"]).alias("actions"), F.get("rows", F.lit(0))["v"].alias("state"))
    at = lambda name, off: poses.select("clip", (F.col("frame") + off).alias("start"), F.col("src").alias(name))
    made = made.join(at("first", history), ["clip", "start"]).join(at("last", 1), ["clip", "start"]).join(lengths, "clip").join(captions, "clip")
    images = F.transform(F.sequence(F.lit(0), F.lit(history - 1)), lambda k: F.when(k == history - 1, F.col("last")).otherwise(F.floor(F.col("first") + k * ((F.col("last") - F.col("first")) / F.lit(float(history - 1))))))
    return made.select("clip", "start", "flipped", "actions", "state", images.alias("images"), text.instruction(F.col("class"), F.col("body"), F.col("start"), F.col("n"), horizon=horizon, flipped=F.col("flipped")).alias("instruction"), F.concat_ws("/", "class", "clip").alias("seq_name"))


@query(views.sql(_SAMPLES, "frames"))
def materialised_samples(spark, sf_dir):
    """Samples of windows of 16 frames with a history of four, described by sums over their numbers."""
    p = views.poses(spark, sf_dir).withColumn("src", 2 * F.col("frame"))
    n = p.groupBy("clip").agg(F.count(F.lit(1)).alias("n"))
    captions = n.select("clip", F.concat(F.lit("c"), F.col("clip") % 12).alias("class"), F.lit("raise the left arm, then step Right").alias("body"))
    s = training_samples(p, n, captions)
    # each angle's sine, and its cosine times its number from 1
    weigh = lambda v: F.aggregate(F.transform(v, lambda x, i: F.when(i % 2 == 0, x).otherwise(x * F.floor((i + 1) / 2))), F.lit(0.0), lambda a, x: a + x)
    total = F.aggregate(F.transform("actions", lambda v: weigh(v)), F.lit(0.0), lambda a, x: a + x)
    r3 = lambda c: F.round(c, 3) + 0.0
    return s.select("clip", "start", "flipped", (F.size("actions") * F.size("state") / 2).cast("long").alias("n_actions"), r3(total).alias("actions"), r3(weigh(F.col("state"))).alias("state"), F.array_join(F.transform("images", lambda k: k.cast("string")), ",").alias("images"), "instruction", "seq_name")


_COLUMNS = f"""+n AS (SELECT clip, count(*) AS n FROM frames GROUP BY clip), k AS (SELECT 'yt_' || clip || '_' || lpad((clip * 3)::VARCHAR, 6, '0') || '_' || lpad((clip * 3 + n)::VARCHAR, 6, '0') AS clip_id, clip, n FROM n)
SELECT clip_id, 'c' || clip % 12 AS action_class, 'yt_' || clip AS youtube_id, lpad((clip * 3)::VARCHAR, 6, '0') AS time_start, lpad((clip * 3 + n)::VARCHAR, 6, '0') AS time_end,
  CASE WHEN ('0x' || substr(md5(clip_id), 1, 8))::BIGINT / 4294967295.0::DOUBLE < 0.02 THEN 'val' ELSE 'train' END AS split, 'raise the left arm' AS instruction, 10.0::FLOAT AS fps, n::INTEGER AS num_pose_frames, 640 AS video_width, 480 AS video_height, clip % 11 = 0 AS has_hard_cuts, 1.0::FLOAT AS quality"""


def _export(spark, sf_dir):
    """The 13 plain columns of an export row beside the clip."""
    n = views.frames(spark, sf_dir).groupBy("clip").agg(F.count(F.lit(1)).alias("n"))
    six = lambda c: F.lpad(c.cast("string"), 6, "0")
    own = F.concat_ws("_", F.lit("yt"), F.col("clip").cast("string"), six(F.col("clip") * 3), six(F.col("clip") * 3 + F.col("n")))
    caption = F.lit("Video: v\nAction Class: c\nTimestamp: now\n\nDescription:\nraise the left arm\n")
    d = n.select("clip", "n", own.alias("clip_id"), caption.alias("caption"))
    part = text.clip_id_parts(F.col("clip_id"))
    return d.select(
        "clip", "clip_id", F.concat(F.lit("c"), (F.col("clip") % 12).cast("string")).alias("action_class"), part["id"].alias("youtube_id"), part["start"].alias("time_start"), part["end"].alias("time_end"),
        F.when(text.hash_share(F.col("clip_id")) < 0.02, "val").otherwise("train").alias("split"), text.caption_body(F.col("caption")).alias("instruction"), F.lit(10.0).cast("float").alias("fps"), F.col("n").cast("int").alias("num_pose_frames"),
        F.lit(640).alias("video_width"), F.lit(480).alias("video_height"), (F.col("clip") % 11 == 0).alias("has_hard_cuts"), F.lit(1.0).cast("float").alias("quality"),
    )


@query(views.sql(_COLUMNS + " FROM k", "frames"))
def export_columns(spark, sf_dir):
    """What an export row holds beside its blobs."""
    return _export(spark, sf_dir).drop("clip")


@query()
def export_row(spark, sf_dir):
    """The 20 columns of the export; seven are zipped blobs of a clip's numbers, frame after frame."""
    j = views.joints(spark, sf_dir)
    flat = lambda *c: F.flatten(F.transform("a", lambda r: F.array(*(r[k] for k in c))))
    points = j.groupBy("clip", "frame").agg(F.array_sort(F.collect_list(F.struct("j", "x", "y", "conf"))).alias("a")).select("clip", "frame", flat("x", "y").alias("xy"), flat("conf").alias("conf"))
    nan = lambda c: F.coalesce(F.col(c), F.lit(float("nan")))
    boxes = views.boxes(spark, sf_dir).select("clip", "frame", F.array(*map(nan, ("x1", "y1", "x2", "y2"))).alias("box"))
    p = views.poses(spark, sf_dir).withColumn("keep", F.col("pose"))
    a = kin.joint_angles(p).select("clip", "frame", "keep", kin.sin_cos(F.col("angles")).alias("v"))
    rows = a.join(points, ["clip", "frame"]).join(boxes, ["clip", "frame"])
    g = rows.groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("frame", "keep", "xy", "conf", "box", "v"))).alias("r"))
    each = lambda c: files.blob(F.flatten(F.transform("r", lambda r: r[c])))
    index = files.blob(F.transform("r", lambda r: r["frame"].cast("double")), "<i4")
    track = files.blob(F.transform("r", lambda r: F.lit(1.0)))
    blobs = g.select("clip", each("keep").alias("pose3d"), each("xy").alias("keypoints2d"), each("conf").alias("scores2d"), each("box").alias("bboxes"), each("v").alias("joint_angles"), index.alias("frame_indices"), track.alias("tracking_confidence"))
    return _export(spark, sf_dir).join(blobs, "clip").drop("clip")


_EVAL = """+n AS (SELECT clip, count(*) AS n, greatest(2, count(*) - 7) AS m FROM frames GROUP BY clip),
al AS (SELECT clip, i, CASE WHEN i = m - 1 THEN n - 1 ELSE floor(i * ((n - 1) / (m - 1)::DOUBLE))::BIGINT END AS src FROM n, unnest(range(m)) u(i)),
c AS (SELECT clip, frame, j, px - first(px) OVER w AS x, py - first(py) OVER w AS y, pz - first(pz) OVER w AS z FROM joints WINDOW w AS (PARTITION BY clip, frame ORDER BY j)),
er AS (SELECT t.clip, t.j, sqrt((t.x - p.x) ** 2 + (t.y - p.y) ** 2 + (t.z - p.z) ** 2) AS d FROM al JOIN c t ON t.clip = al.clip AND t.frame = al.i JOIN c p ON p.clip = al.clip AND p.frame = al.src AND p.j = t.j),
ev AS (SELECT clip, avg(d) FILTER (j <> 10) * 1000 AS mpjpe, avg(CASE WHEN d * 1000 < 150 THEN 100.0::DOUBLE ELSE 0 END) AS pck FROM er GROUP BY clip)"""


def _evaluated(spark, sf_dir):
    """clip, mpjpe, pck: a true sequence of some frames against a longer one, brought to its length and both centred on their roots."""
    p = views.poses(spark, sf_dir).select("clip", "frame", kin.root_centred(F.col("pose")).alias("pose"))
    n = p.groupBy("clip").agg(F.count(F.lit(1)).alias("n")).withColumn("m", F.greatest(F.lit(2).cast("long"), F.col("n") - 7))
    places = n.select("clip", "n", "m", F.explode(windows.upto(F.col("m"))).alias("frame"))
    src = F.when(F.col("frame") == F.col("m") - 1, F.col("n") - 1).otherwise(F.floor(F.col("frame") * ((F.col("n") - 1) / (F.col("m") - 1).cast("double"))))
    aligned = places.select("clip", "frame", src.alias("src")).join(p, ["clip", "frame"]).join(p.select("clip", F.col("frame").alias("src"), F.col("pose").alias("pred")), ["clip", "src"])
    d = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda j: F.sqrt(sum((F.get("pose", j * 3 + k) - F.get("pred", j * 3 + k)) ** 2 for k in range(3))))
    e = aligned.select("clip", F.posexplode(d).alias("j", "d"))
    return e.groupBy("clip").agg((F.avg(F.when(F.col("j") != 10, F.col("d"))) * 1000).alias("mpjpe"), F.avg(F.when(F.col("d") * 1000 < 150, 100.0).otherwise(0.0)).alias("pck"))


@query(views.sql(f"{_EVAL} SELECT clip, round(mpjpe, 3) + 0.0 AS mpjpe, round(pck, 3) + 0.0 AS pck FROM ev", "joints"))
def pose_evaluation(spark, sf_dir):
    return _evaluated(spark, sf_dir).select("clip", *((F.round(c, 3) + 0.0).alias(c) for c in ("mpjpe", "pck")))


@query(views.sql(f"{_EVAL} SELECT count(*) AS n, round(avg(mpjpe), 3) + 0.0 AS mean, round(quantile_cont(mpjpe, 0.5), 3) + 0.0 AS median, round(stddev_pop(mpjpe), 3) + 0.0 AS std, round(avg(pck), 3) + 0.0 AS pck FROM ev", "joints"))
def evaluation_summary(spark, sf_dir):
    r3 = lambda c: F.round(c, 3) + 0.0
    e = stored(_evaluated(spark, sf_dir))
    median = quantiles(e, [], "mpjpe", {"median": 0.5}).select(r3(F.col("median")).alias("median"))  # one row
    rest = e.agg(F.count(F.lit(1)).alias("n"), r3(F.avg("mpjpe")).alias("mean"), r3(F.stddev_pop("mpjpe")).alias("std"), r3(F.avg("pck")).alias("pck"))
    return rest.join(F.broadcast(median), how="left").select("n", "mean", "median", "std", "pck")


@query(views.sql(f"{quality.CLASSES}, s AS (SELECT clip, issues, status FROM classes ORDER BY md5('42-' || clip), clip LIMIT 16) SELECT clip, status, left(status || '_class_' || clip % 3 || '_' || lpad(clip::VARCHAR, 6, '0') || CASE WHEN len(issues) > 0 THEN '_' || array_to_string(issues[1:2], '_') ELSE '' END, 200) AS name, count(*) OVER (PARTITION BY status) AS of_status FROM s", "boxes"))
def validation_report(spark, sf_dir):
    """A seeded sample of 16 clips with their status, file name and how many share the status: the sample is the report's own."""
    c = quality._classes(spark, sf_dir).orderBy(F.md5(F.concat(F.lit("42-"), F.col("clip").cast("string")).cast("binary")), "clip").limit(16)
    return c.select("clip", "status", rules.status_name(F.concat(F.lit("class_"), (F.col("clip") % 3).cast("string")), F.lpad(F.col("clip").cast("string"), 6, "0")).alias("name"), F.count(F.lit(1)).over(Window.partitionBy("status")).alias("of_status"))
