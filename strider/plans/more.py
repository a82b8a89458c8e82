"""Queries: the remaining small operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vec
from ..operators import render
from . import views
from .catalog import query

R = lambda c: F.round(c, 4) + 0.0


@query("SELECT l.doc_id, d.lang, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def pose_caption_join(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", "lang").join(views.table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


@query("SELECT d.doc_id, CASE WHEN a.vec_id IS NOT NULL THEN 'class' WHEN b.page_id IS NOT NULL THEN 'flat' ELSE 'none' END AS place FROM documents d LEFT JOIN (SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0) a ON a.vec_id = d.doc_id LEFT JOIN pages b ON b.page_id = d.doc_id")
def video_fallback(spark, sf_dir):
    """The folder of the class first, then the flat one; what has neither is reported."""
    a = views.table(spark, sf_dir, "embeddings").where("vec_id % 2 = 0").select(F.col("vec_id").alias("doc_id"), F.lit("class").alias("a"))
    b = views.table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit("flat").alias("b"))
    d = views.table(spark, sf_dir, "documents").select("doc_id").join(a, "doc_id", "left").join(b, "doc_id", "left")
    return d.select("doc_id", F.coalesce("a", "b", F.lit("none")).alias("place"))


@query(views.sql("SELECT round(min(time), 4) + 0.0 AS least, round(max(time), 4) + 0.0 AS most, round(avg(time), 4) + 0.0 AS mean FROM results WHERE status = 'valid'", "results"))
def score_summary(spark, sf_dir):
    return views.results(spark, sf_dir).where("status = 'valid'").agg(R(F.min("time")).alias("least"), R(F.max("time")).alias("most"), R(F.avg("time")).alias("mean"))


@query("SELECT steps::BIGINT AS steps, solver FROM (VALUES (1), (2), (4), (8)) a(steps), (VALUES ('euler'), ('rk4')) b(solver)")
def config_grid(spark, sf_dir):
    """All settings: every row takes every solver by exploding a fixed list."""
    return spark.createDataFrame([(1,), (2,), (4,), (8,)], "steps long").select("steps", F.explode(F.array(F.lit("euler"), F.lit("rk4"))).alias("solver"))


@query("SELECT n, round((1 - 1.0 / n) ** n, 8) + 0.0 AS euler, round((1 - 1.0 / n + 1.0 / (2 * n * n) - 1.0 / (6 * n * n * n) + 1.0 / (24 * n * n * n * n)) ** n, 8) + 0.0 AS rk4 FROM range(1, 21) t(n)")
def integrators(spark, sf_dir):
    """dx/dt = -x from 1 over one unit of time, stepped by a fold; the oracle has the closed form."""
    dt = 1.0 / F.col("id")
    steps = F.sequence(F.lit(1).cast("long"), F.col("id"))

    def rk4(x, _):
        k1 = -x
        k2 = -(x + 0.5 * dt * k1)
        k3 = -(x + 0.5 * dt * k2)
        k4 = -(x + dt * k3)
        return x + dt / 6 * (k1 + 2 * k2 + 2 * k3 + k4)

    fold = lambda f: F.round(F.aggregate(steps, F.lit(1.0), f), 8) + 0.0
    return spark.range(1, 21).select(F.col("id").alias("n"), fold(lambda x, _: x - x * dt).alias("euler"), fold(rk4).alias("rk4"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE regexp_replace('module.' || event_type, '^module\\.', '') END AS key FROM events")
def state_prefix(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    key = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.concat(F.lit("module."), F.col("event_type")))
    return e.select("event_id", F.regexp_replace(key, r"^module\.", "").alias("key"))


@query("SELECT source, step FROM (SELECT source, doc_id AS step, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS r FROM documents) WHERE r <= 5")
def newest_checkpoints(spark, sf_dir):
    """The newest five of each run, by the step in the file's name."""
    name = F.format_string("checkpoint_step_%d.pth", F.col("doc_id"))
    step = F.regexp_extract(name, r"_(\d+)\.pth$", 1).cast("long")
    d = views.table(spark, sf_dir, "documents").select("source", step.alias("step"))
    return d.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("step")))).where("r <= 5").drop("r")


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'qwen_vl' WHEN 1 THEN 'cogvlm2' WHEN 2 THEN 'internvl2' WHEN 3 THEN 'video_llava' ELSE 'generic' END AS family FROM events")
def model_family(spark, sf_dir):
    names = F.array(*map(F.lit, ("Qwen2-VL-7B", "cogvlm2-video", "InternVL2-8B", "Video-LLaVA-7B", "other")))
    n = F.lower(F.get(names, (F.col("event_id") % 5).cast("int")))
    has = lambda s: F.contains(n, F.lit(s))
    family = F.when(has("qwen") & has("vl"), "qwen_vl").when(has("cogvlm"), "cogvlm2").when(has("internvl"), "internvl2").when(has("video-llava"), "video_llava").otherwise("generic")
    return views.table(spark, sf_dir, "events").select("event_id", family.alias("family"))


@query(views.sql("SELECT clip, frame, round(x1, 3) + 0.0 AS x1, round(y2, 3) + 0.0 AS y2 FROM boxes WHERE x1 IS NOT NULL", "boxes"))
def tracking_json(spark, sf_dir):
    """Boxes go into tracking JSON by person and come out again."""
    b = views.boxes(spark, sf_dir).where("x1 IS NOT NULL")
    track = F.struct(F.col("v.frame").alias("frame_idxs"), F.transform("v", lambda r: F.array(r["x1"], r["y1"], r["x2"], r["y2"])).alias("box"))
    g = b.groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("frame", "x1", "y1", "x2", "y2"))).alias("v"))
    js = g.select("clip", F.to_json(F.create_map(F.col("clip").cast("string"), track)).alias("j"))
    parsed = js.select("clip", F.from_json("j", "map<string, struct<frame_idxs: array<bigint>, box: array<array<double>>>>").alias("m"))
    one = parsed.select("clip", F.element_at("m", F.col("clip").cast("string")).alias("p"))
    rows = one.select("clip", F.explode(F.arrays_zip("p.frame_idxs", "p.box")).alias("z"))
    return rows.select("clip", F.col("z.frame_idxs").alias("frame"), (F.round(F.get("z.box", F.lit(0)), 3) + 0.0).alias("x1"), (F.round(F.get("z.box", F.lit(3)), 3) + 0.0).alias("y2"))


@query(views.sql("SELECT clip, frame, greatest(0, trunc(x1 - p))::BIGINT AS l, greatest(0, trunc(y1 - p * 0.3))::BIGINT AS t, least(640, trunc(x2 + p))::BIGINT AS r, least(480, trunc(y2 + p * 0.6))::BIGINT AS b FROM (SELECT *, 0.4 * greatest(x2 - x1, y2 - y1) AS p FROM boxes WHERE x1 IS NOT NULL)", "boxes"))
def figure_crop(spark, sf_dir):
    p = 0.4 * F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    whole = lambda c: c.cast("long")
    lo = lambda c: F.greatest(F.lit(0).cast("long"), whole(c))
    b = views.boxes(spark, sf_dir).where("x1 IS NOT NULL")
    return b.select("clip", "frame", lo(F.col("x1") - p).alias("l"), lo(F.col("y1") - p * 0.3).alias("t"), F.least(F.lit(640).cast("long"), whole(F.col("x2") + p)).alias("r"), F.least(F.lit(480).cast("long"), whole(F.col("y2") + p * 0.6)).alias("b"))


@query(views.sql("SELECT clip, round(1.1 * max(greatest(abs(px), abs(py), abs(pz))), 4) + 0.0 AS half FROM joints GROUP BY clip", "joints"))
def symmetric_range(spark, sf_dir):
    return views.joints(spark, sf_dir).groupBy("clip").agg(R(1.1 * F.max(F.greatest(F.abs("px"), F.abs("py"), F.abs("pz")))).alias("half"))


@query(views.sql("SELECT clip, round(avg(x), 3) + 0.0 AS cx, round(avg(y), 3) + 0.0 AS cy, round(480 * 0.85 / greatest(max(x) - min(x), max(y) - min(y), 1e-6), 4) + 0.0 AS scale FROM joints WHERE abs(x) + abs(y) > 1 GROUP BY clip", "joints"))
def common_centring(spark, sf_dir):
    j = views.joints(spark, sf_dir).where("abs(x) + abs(y) > 1")
    span = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1e-6))
    return j.groupBy("clip").agg((F.round(F.avg("x"), 3) + 0.0).alias("cx"), (F.round(F.avg("y"), 3) + 0.0).alias("cy"), R(480 * 0.85 / span).alias("scale"))


@query(views.sql("SELECT clip, frame, j, round(x * 320 / 640, 3) + 0.0 AS u, round(y * 240 / 480, 3) + 0.0 AS v, round(x - x1, 3) + 0.0 AS cx, round(y - y1, 3) + 0.0 AS cy FROM joints JOIN boxes USING (clip, frame) WHERE x1 IS NOT NULL", "boxes"))
def keypoint_rescale(spark, sf_dir):
    j = views.joints(spark, sf_dir).join(views.boxes(spark, sf_dir).where("x1 IS NOT NULL"), ["clip", "frame"])
    r = lambda c: F.round(c, 3) + 0.0
    return j.select("clip", "frame", "j", r(F.col("x") * 320 / 640).alias("u"), r(F.col("y") * 240 / 480).alias("v"), r(F.col("x") - F.col("x1")).alias("cx"), r(F.col("y") - F.col("y1")).alias("cy"))


_QUAT = """+an AS (SELECT clip, frame, 6 * e[1] AS p, 6 * e[2] AS r, 6 * e[3] AS y FROM frames),
m AS (SELECT clip, frame, cos(r)*cos(y) AS a, -cos(r)*sin(y) AS b, sin(r) AS c, cos(p)*sin(y) + sin(p)*sin(r)*cos(y) AS d, cos(p)*cos(y) - sin(p)*sin(r)*sin(y) AS e, -sin(p)*cos(r) AS f, sin(p)*sin(y) - cos(p)*sin(r)*cos(y) AS g, sin(p)*cos(y) + cos(p)*sin(r)*sin(y) AS h, cos(p)*cos(r) AS i FROM an),
q AS (SELECT clip, frame, CASE WHEN a + e + i > 0 THEN [sqrt(a + e + i + 1) / 2, (h - f) / 2 / sqrt(a + e + i + 1), (c - g) / 2 / sqrt(a + e + i + 1), (d - b) / 2 / sqrt(a + e + i + 1)]
  WHEN a > e AND a > i THEN [(h - f) / 2 / sqrt(1 + a - e - i), sqrt(1 + a - e - i) / 2, (b + d) / 2 / sqrt(1 + a - e - i), (c + g) / 2 / sqrt(1 + a - e - i)]
  WHEN e > i THEN [(c - g) / 2 / sqrt(1 + e - a - i), (b + d) / 2 / sqrt(1 + e - a - i), sqrt(1 + e - a - i) / 2, (f + h) / 2 / sqrt(1 + e - a - i)]
  ELSE [(d - b) / 2 / sqrt(1 + i - a - e), (c + g) / 2 / sqrt(1 + i - a - e), (f + h) / 2 / sqrt(1 + i - a - e), sqrt(1 + i - a - e) / 2] END AS q FROM m)
SELECT clip, frame, round(q[1], 4) + 0.0 AS w, round(q[2], 4) + 0.0 AS x, round(q[3], 4) + 0.0 AS y, round(q[4], 4) + 0.0 AS z FROM q"""


@query(views.sql(_QUAT, "frames"))
def matrix_quaternion(spark, sf_dir):
    f = views.frames(spark, sf_dir)
    f = f.select("clip", "frame", *((6 * F.get("e", F.lit(k))).alias(f"a{k}") for k in range(3)))
    m = f.select("clip", "frame", *(c.alias(f"m{i}{j}") for i, row in enumerate(vec.from_euler(tuple(F.col(f"a{k}") for k in range(3)))) for j, c in enumerate(row)))
    q = vec.matrix_quaternion(tuple(tuple(F.col(f"m{i}{j}") for j in range(3)) for i in range(3)))
    return m.select("clip", "frame", *(R(c).alias(n) for n, c in zip("wxyz", q)))


_ORTHO = """+h AS (SELECT clip, frame, j, px - first(px) OVER w AS x, -(py - first(py) OVER w) AS y FROM joints WINDOW w AS (PARTITION BY clip, frame ORDER BY j)),
b AS (SELECT a.clip, a.frame, a.j, a.x, a.y, f.x AS fx, f.y AS fy FROM h a JOIN h f ON a.clip = f.clip AND a.j = f.j AND f.frame = 0),
s AS (SELECT clip, frame, least(min(x), min(fx)) AS x0, greatest(max(x), max(fx)) AS x1, least(min(y), min(fy)) AS y0, greatest(max(y), max(fy)) AS y1 FROM b GROUP BY clip, frame),
k AS (SELECT *, 200 * 0.7 / CASE WHEN greatest(x1 - x0, y1 - y0) < 1e-6 THEN 1 ELSE greatest(x1 - x0, y1 - y0) END AS scale FROM s)"""


@query(views.sql(f"{_ORTHO} SELECT clip, frame, j, round((x - (x0 + x1) / 2) * scale + 100, 2) + 0.0 AS u, round(150 - (y - (y0 + y1) / 2) * scale, 2) + 0.0 AS v FROM b JOIN k USING (clip, frame)", "joints"))
def ortho_project(spark, sf_dir):
    """A pose and the clip's first one at one scale in a panel of 200 x 300 with margins of 15 %."""
    root = views.poses(spark, sf_dir).select("clip", "frame", F.get("pose", F.lit(0)).alias("rx"), F.get("pose", F.lit(1)).alias("ry"))
    h = views.joints(spark, sf_dir).join(root, ["clip", "frame"]).select("clip", "frame", "j", (F.col("px") - F.col("rx")).alias("x"), (F.col("ry") - F.col("py")).alias("y"))
    b = h.join(h.where("frame = 0").select("clip", "j", F.col("x").alias("fx"), F.col("y").alias("fy")), ["clip", "j"])
    lo, hi = (lambda a, c: F.least(F.min(a), F.min(c))), (lambda a, c: F.greatest(F.max(a), F.max(c)))
    s = b.groupBy("clip", "frame").agg(lo("x", "fx").alias("x0"), hi("x", "fx").alias("x1"), lo("y", "fy").alias("y0"), hi("y", "fy").alias("y1"))
    span = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    k = 200 * 0.7 / F.when(span < 1e-6, 1.0).otherwise(span)
    return b.join(s, ["clip", "frame"]).select("clip", "frame", "j", (F.round((F.col("x") - (F.col("x0") + F.col("x1")) / 2) * k + 100, 2) + 0.0).alias("u"), (F.round(150 - (F.col("y") - (F.col("y0") + F.col("y1")) / 2) * k, 2) + 0.0).alias("v"))


_TRAJECTORIES = """+tr AS (SELECT clip // 3 AS clip, row_number() OVER (PARTITION BY clip // 3 ORDER BY frame, clip) - 1 AS frame, e FROM frames),
u AS (SELECT clip, frame, sqrt((e[31] - (e[10] + e[19]) / 2) ** 2 + (e[32] - (e[11] + e[20]) / 2) ** 2 + (e[33] - (e[12] + e[21]) / 2) ** 2) AS up FROM tr),
m AS (SELECT clip, avg(abs(d)) AS motion FROM (SELECT clip, e[k + 1] - lag(e[k + 1]) OVER (PARTITION BY clip, k ORDER BY frame) AS d FROM tr, range(51) t(k)) GROUP BY clip),
fi AS (SELECT clip FROM (SELECT clip, row_number() OVER (PARTITION BY clip // 3 ORDER BY clip) AS r FROM (SELECT DISTINCT clip FROM tr)) WHERE r <= 30),
s AS (SELECT clip // 3 AS class, clip, min(up) * avg(up) * any_value(motion) AS score FROM u JOIN m USING (clip) SEMI JOIN fi USING (clip) GROUP BY clip HAVING count(*) >= 30)"""


@query(views.sql(f"{_TRAJECTORIES} SELECT class, clip FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY round(score, 9) DESC, clip) AS r FROM s) WHERE r = 1", "frames"))
def trajectory_pick(spark, sf_dir):
    """For each class, among its first 30 clips and those of 30 frames or more, the clip with the best product of least and mean uprightness and motion. A label's clips are one here."""
    order = Window.partitionBy("own").orderBy("frame", "clip")
    p = views.poses(spark, sf_dir).withColumn("own", F.floor(F.col("clip") / 3)).select(F.col("own").alias("clip"), F.row_number().over(order).alias("frame"), "pose")
    files = p.select("clip").distinct().withColumn("r", F.row_number().over(Window.partitionBy(F.floor(F.col("clip") / 3)).orderBy("clip"))).where("r <= 30").select("clip")
    p = p.join(files, "clip", "left_semi")
    ankles = vec.scale(vec.add(vec.at("pose", 3), vec.at("pose", 6)), 0.5)
    w = Window.partitionBy("clip").orderBy("frame")
    p = p.select("clip", "frame", vec.norm(vec.sub(vec.at("pose", 10), ankles)).alias("up"), F.aggregate(F.zip_with("pose", F.lag("pose").over(w), lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x).alias("d"))
    s = p.groupBy("clip").agg(F.count(F.lit(1)).alias("n"), (F.min("up") * F.avg("up") * F.avg("d") / 51).alias("score")).where("n >= 30").withColumn("class", F.floor(F.col("clip") / 3))
    best = Window.partitionBy("class").orderBy(F.round("score", 9).desc(), "clip")
    return s.withColumn("r", F.row_number().over(best)).where("r = 1").select("class", "clip")


@query("SELECT 'Video: ' || doc_id || chr(10) || 'Action Class: ' || source || chr(10) || chr(10) || 'Description:' || chr(10) || text AS content FROM documents WHERE text <> '' AND NOT starts_with(text, 'Error')")
def caption_file(spark, sf_dir):
    """Caption files of accepted captions, with the whole text."""
    d = views.table(spark, sf_dir, "documents").where((F.col("text") != "") & ~F.startswith("text", F.lit("Error")))
    return d.select(F.concat(F.lit("Video: "), F.col("doc_id").cast("string"), F.lit("\nAction Class: "), F.col("source"), F.lit("\n\nDescription:\n"), F.col("text")).alias("content"))


@query(views.sql("""SELECT '{"class":' || class || ',"n":' || count(*) || ',"valid":' || count(*) FILTER (status = 'valid') || '}' AS report FROM results GROUP BY class""", "results"))
def result_json(spark, sf_dir):
    g = views.results(spark, sf_dir).groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("status") == "valid", 1)).alias("valid"))
    return g.select(F.to_json(F.struct("class", "n", "valid")).alias("report"))


@query()
def render_frame(spark, sf_dir):
    return render.render_frame(views.poses(spark, sf_dir))


@query()
def frame_select(spark, sf_dir):
    return render.select_frames(views.poses(spark, sf_dir))
