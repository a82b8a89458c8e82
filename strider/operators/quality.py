"""Rules that keep or reject clips: body coverage, motion, tracking, and the classifier over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Joints of which three must be seen.
CORE = (0, 5, 6, 11, 12)
#: Issues that make a clip invalid by themselves.
CRITICAL = ("NO_KEYPOINTS", "NO_VALID_BODY", "NO_DETECTION", "TOO_SHORT_FOR_MOTION_CHECK", "NO_VALID_COMPARISONS")


def coverage(joints: DataFrame, clips: DataFrame | None = None, min_confidence: float = 0.3, min_ratio: float = 0.4) -> DataFrame:
    """clip, frames, ratio of frames with three core joints, issue (null if enough).

    A null confidence counts as one. Clips of `clips` (clip) without any frame have no keypoints.
    """
    seen = F.col("j").isin(*CORE) & (F.col("x") > 0) & (F.col("y") > 0) & (F.coalesce("conf", F.lit(1.0)) > min_confidence)
    per = joints.groupBy("clip", "frame").agg(F.count(F.when(seen, 1)).alias("core"))
    clip = per.groupBy("clip").agg(F.count(F.lit(1)).alias("frames"), F.avg((F.col("core") >= 3).cast("double")).alias("ratio"))
    if clips is not None:
        clip = clips.select("clip").distinct().join(clip, "clip", "left").withColumn("frames", F.coalesce("frames", F.lit(0)))
    text = F.concat(F.lit("INSUFFICIENT_COVERAGE_"), F.floor(F.col("ratio") * 100).cast("string"), F.lit("%"))
    return clip.withColumn("issue", F.when(F.col("frames") == 0, "NO_KEYPOINTS").when(F.col("ratio") < min_ratio, text))


def _moved(joints: DataFrame) -> DataFrame:
    """clip, frame and `m`, the joints seen in a frame and the next one, each with x, y and displacement; frames are rows with arrays until then."""
    seen = F.array_sort(F.collect_list(F.struct("j", "x", "y")))
    rows = joints.groupBy("clip", "frame").agg(seen.alias("a")).withColumn("b", F.lead("a").over(Window.partitionBy("clip").orderBy("frame")))
    both = F.filter(F.zip_with("a", "b", lambda p, q: F.struct(p["x"].alias("x"), p["y"].alias("y"), q["x"].alias("nx"), q["y"].alias("ny"))), lambda r: (r["x"] > 0) & (r["y"] > 0) & (r["nx"] > 0) & (r["ny"] > 0))
    moved = F.transform(both, lambda r: F.struct(r["x"].alias("x"), r["y"].alias("y"), F.hypot(r["nx"] - r["x"], r["ny"] - r["y"]).alias("d")))
    return rows.where("b IS NOT NULL").select("clip", "frame", moved.alias("m")).where(F.size("m") >= 3)


def motion(joints: DataFrame, clips: DataFrame | None = None, least_motion: float = 0.02, least_variation: float = 5.0) -> DataFrame:
    """clip, frames, compared pairs, mean motion, variation, issue; every frame has all joints."""
    moved = _moved(joints)
    total = F.aggregate("m", F.lit(0.0), lambda s, r: s + r["d"])
    clip = moved.groupBy("clip").agg(F.count(F.lit(1)).alias("compared"), F.avg(total / F.size("m") / 100).alias("motion"), F.min(F.size("m")).alias("shortest"))
    spread = moved.select("clip", F.posexplode("m").alias("r", "p")).groupBy("clip", "r").agg(F.stddev_pop("p.x").alias("sx"), F.stddev_pop("p.y").alias("sy"))
    variation = spread.join(clip.select("clip", "shortest"), "clip").where("r < shortest").groupBy("clip").agg(F.avg((F.col("sx") + F.col("sy")) / 2).alias("variation"))
    counts = joints.groupBy("clip").agg(F.countDistinct("frame").alias("frames"))
    if clips is not None:
        counts = clips.select("clip").distinct().join(counts, "clip", "left").withColumn("frames", F.coalesce("frames", F.lit(0)))
    out = counts.join(clip, "clip", "left").join(variation, "clip", "left")
    moves = (F.col("motion") > least_motion) | ((F.col("compared") > 1) & (F.col("variation") > least_variation))
    issue = F.when(F.col("frames") < 2, "TOO_SHORT_FOR_MOTION_CHECK").when(F.col("compared").isNull(), "NO_VALID_COMPARISONS").when(~moves, "NO_MOTION")
    return out.select("clip", "frames", F.coalesce("compared", F.lit(0)).alias("compared"), "motion", "variation", issue.alias("issue"))


def overlap(a: tuple, b: tuple):
    """Intersection over union of boxes given as four Columns each."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda q: (q[2] - q[0]) * (q[3] - q[1])
    return w * h / (area(a) + area(b) - w * h + 1e-6)


def box_pairs(boxes: DataFrame) -> DataFrame:
    """clip, frame, overlap and size ratio of a frame's box and the next; frames next to one without box have none."""
    w = Window.partitionBy("clip").orderBy("frame")
    names = ("x1", "y1", "x2", "y2")
    pairs = boxes.select("*", *(F.lead(c).over(w).alias(f"n{c}") for c in names)).where("x1 IS NOT NULL AND nx1 IS NOT NULL")
    a, b = tuple(map(F.col, names)), tuple(F.col(f"n{c}") for c in names)
    s, t = ((q[2] - q[0]) * (q[3] - q[1]) for q in (a, b))
    ratio = F.when((s > 0) & (t > 0), F.greatest(s / F.nullif(t, F.lit(0.0)), t / F.nullif(s, F.lit(0.0)))).otherwise(3.0)
    return pairs.select("clip", "frame", overlap(a, b).alias("overlap"), ratio.alias("ratio"))


def tracking(boxes: DataFrame, most_breaks: float = 0.1, most_jump: float = 2.0) -> DataFrame:
    """clip, pairs, breaks, issue."""
    broken = (F.col("overlap") < 0.1) & (F.col("ratio") > most_jump)
    found = box_pairs(boxes).groupBy("clip").agg(F.count(F.lit(1)).alias("pairs"), F.count(F.when(broken, 1)).alias("breaks"))
    out = boxes.select("clip").distinct().join(found, "clip", "left").select("clip", F.coalesce("pairs", F.lit(0)).alias("pairs"), F.coalesce("breaks", F.lit(0)).alias("breaks"))
    share = F.col("breaks") / F.nullif(F.col("pairs"), F.lit(0))
    text = F.concat(F.lit("TRACKING_BREAKS_"), F.floor(share * 100).cast("string"), F.lit("%"))
    return out.withColumn("issue", F.when(share > most_breaks, text))


def classify(joints: DataFrame, boxes: DataFrame, cuts: DataFrame | None = None, switches: DataFrame | None = None, clips: DataFrame | None = None, min_frames: int = 20) -> DataFrame:
    """clip, issues in order, status.

    `cuts` (clip, cut_frames) names clips with hard cuts and their frames, `switches` (clip, switch_frames)
    the frames in which the tracker changed the person: more than five and a twentieth of the boxes stand
    for the tracking check. `clips` (clip) are all clips, also such without frames.
    """
    cov = coverage(joints, clips).select("clip", "frames", F.col("issue").alias("cov"))
    out = cov.join(motion(joints, clips).select("clip", F.col("issue").alias("mot")), "clip").join(tracking(boxes).select("clip", F.col("issue").alias("trk")), "clip", "left")
    out = out.join(boxes.groupBy("clip").agg(F.count(F.lit(1)).alias("boxes")), "clip", "left")
    nothing = F.lit(None).cast("array<long>")
    out = out.join(cuts.select("clip", "cut_frames", F.lit("HARD_CUTS_DETECTED").alias("cut")), "clip", "left") if cuts is not None else out.withColumns({"cut": F.lit(None).cast("string"), "cut_frames": nothing})
    out = out.join(switches.select("clip", "switch_frames"), "clip", "left") if switches is not None else out.withColumn("switch_frames", nothing)
    scenes = F.concat(F.lit("SCENE_TRANSITIONS_AT_FRAMES_["), F.array_join(F.transform(F.slice("cut_frames", 1, 3), lambda k: k.cast("string")), ", "), F.lit("]"))
    many = F.size("switch_frames") > F.greatest(F.lit(5.0), F.coalesce("boxes", F.lit(0)) * 0.05)
    tracked = F.when(many, F.concat(F.lit("EXCESSIVE_TRACKING_SWITCHES_"), F.size("switch_frames").cast("string"), F.lit("_FRAMES"))).otherwise(F.col("trk"))
    short = F.when(F.col("frames") < min_frames, F.concat(F.lit("TOO_SHORT_"), F.col("frames").cast("string"), F.lit("_frames")))
    issues = F.array_compact(F.array("cut", F.when(F.size("cut_frames") > 0, scenes), tracked, short, "cov", "mot"))
    return out.select("clip", issues.alias("issues")).select("clip", "issues", status_of(F.col("issues")).alias("status"))


def legacy(joints: DataFrame) -> DataFrame:
    """clip, issues, status of the old validator: it passes a zero box for every frame, and asks for 25 frames."""
    zero = joints.select("clip", "frame", *(F.lit(0.0).alias(c) for c in ("x1", "y1", "x2", "y2"))).distinct()
    return classify(joints, zero, min_frames=25)


def status_name(action_class, clip_id):
    """A file name of status, class, clip and the first two issues, of 200 characters at most."""
    reasons = F.when(F.size("issues") > 0, F.concat(F.lit("_"), F.array_join(F.slice("issues", 1, 2), "_"))).otherwise("")
    return F.substring(F.concat(F.concat_ws("_", "status", action_class, clip_id), reasons), 1, 200)


def status_of(issues):
    """VALID, PARTIAL or INVALID of an array of issues."""
    length = lambda i: F.regexp_extract(i, "^TOO_SHORT_(\\d+)_", 1).try_cast("int")
    critical = F.exists(issues, lambda i: i.isin(*CRITICAL) | F.coalesce(length(i) < 15, F.lit(False)))
    partial = F.exists(issues, lambda i: i.contains("NO_MOTION") | i.contains("HARD_CUTS_DETECTED") | i.contains("EXCESSIVE_TRACKING_SWITCHES"))
    return F.when(F.size(issues) == 0, "VALID").when(critical, "INVALID").when(partial, "PARTIAL").otherwise("INVALID")
