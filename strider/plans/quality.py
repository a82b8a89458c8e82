"""Queries: clip quality rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import quality
from . import views
from .catalog import query

R = lambda c: F.round(c, 4) + 0.0

COVERAGE = """+cov AS (SELECT clip, count(*) AS frames, avg(CASE WHEN core >= 3 THEN 1.0::DOUBLE ELSE 0 END) AS ratio FROM (SELECT clip, frame, count(*) FILTER (j IN (0, 5, 6, 11, 12) AND x > 0 AND y > 0 AND CASE WHEN clip % 4 = 0 THEN 1.0 ELSE conf END > 0.3) AS core FROM joints GROUP BY clip, frame) GROUP BY clip)"""
MOTION = """moved AS (SELECT *, row_number() OVER (PARTITION BY clip, frame ORDER BY j) AS r, count(*) OVER (PARTITION BY clip, frame) AS n FROM
  (SELECT clip, frame, j, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM joints WINDOW w AS (PARTITION BY clip, j ORDER BY frame)) WHERE x > 0 AND y > 0 AND nx > 0 AND ny > 0),
pairs AS (SELECT clip, frame, avg(sqrt((nx - x) ** 2 + (ny - y) ** 2)) / 100 AS m, count(*) AS n FROM moved WHERE n >= 3 GROUP BY clip, frame),
per AS (SELECT clip, count(*) AS compared, avg(m) AS motion, min(n) AS shortest FROM pairs GROUP BY clip),
spread AS (SELECT clip, r, (stddev_pop(x) + stddev_pop(y)) / 2 AS s FROM moved WHERE n >= 3 GROUP BY clip, r),
vary AS (SELECT clip, avg(s) AS variation FROM spread JOIN per USING (clip) WHERE r <= shortest GROUP BY clip),
mot AS (SELECT clip, frames, coalesce(compared, 0) AS compared, motion, variation, CASE WHEN frames < 2 THEN 'TOO_SHORT_FOR_MOTION_CHECK' WHEN compared IS NULL THEN 'NO_VALID_COMPARISONS' WHEN NOT (motion > 0.02 OR (compared > 1 AND variation > 5)) THEN 'NO_MOTION' END AS issue
  FROM (SELECT clip, count(DISTINCT frame) AS frames FROM joints GROUP BY clip) LEFT JOIN per USING (clip) LEFT JOIN vary USING (clip))"""
TRACKING = """bp AS (SELECT clip, frame, (w * h) / (s + t - w * h + 1e-6) AS overlap, CASE WHEN s > 0 AND t > 0 THEN greatest(s / t, t / s) ELSE 3 END AS ratio FROM
  (SELECT clip, frame, greatest(0.0, least(x2, nx2) - greatest(x1, nx1)) AS w, greatest(0.0, least(y2, ny2) - greatest(y1, ny1)) AS h, (x2 - x1) * (y2 - y1) AS s, (nx2 - nx1) * (ny2 - ny1) AS t FROM
    (SELECT *, lead(x1) OVER o AS nx1, lead(y1) OVER o AS ny1, lead(x2) OVER o AS nx2, lead(y2) OVER o AS ny2 FROM boxes WINDOW o AS (PARTITION BY clip ORDER BY frame)) WHERE x1 IS NOT NULL AND nx1 IS NOT NULL)),
trk AS (SELECT clip, coalesce(pairs, 0) AS pairs, coalesce(breaks, 0) AS breaks, CASE WHEN breaks / pairs > 0.1 THEN 'TRACKING_BREAKS_' || floor(breaks / pairs * 100)::BIGINT || '%' END AS issue
  FROM (SELECT DISTINCT clip FROM boxes) LEFT JOIN (SELECT clip, count(*) AS pairs, count(*) FILTER (overlap < 0.1 AND ratio > 2) AS breaks FROM bp GROUP BY clip) USING (clip))"""
#: Clips of which a fifth more has no frame at all, and how the rules see those.
EVERY = "every AS (SELECT DISTINCT clip FROM frames UNION ALL SELECT DISTINCT clip + 1000 FROM frames WHERE clip % 5 = 2)"
_COV_ISSUE = "CASE WHEN frames IS NULL THEN 'NO_KEYPOINTS' WHEN ratio < 0.4 THEN 'INSUFFICIENT_COVERAGE_' || floor(ratio * 100)::BIGINT || '%' END"


def _classes_sql(min_frames: int, more: str) -> str:
    return f"""{COVERAGE}, {MOTION}, {TRACKING}, {EVERY},
cuts AS (SELECT clip, list(frame ORDER BY frame) FILTER (frame % 4 = 3 AND clip % 2 = 1) AS cut_frames FROM frames WHERE clip % 11 = 0 GROUP BY clip),
switches AS (SELECT clip, count(*) AS n FROM frames WHERE clip % 6 = 1 AND (frame % 2 = 0 OR clip % 4 = 1) GROUP BY clip),
held AS (SELECT clip, count(*) AS n FROM boxes GROUP BY clip),
lists AS (SELECT clip, coalesce(cov.frames, 0) AS n, list_filter([{more}
  CASE WHEN coalesce(cov.frames, 0) < {min_frames} THEN 'TOO_SHORT_' || coalesce(cov.frames, 0) || '_frames' END, {_COV_ISSUE.replace("frames", "cov.frames")}, CASE WHEN cov.frames IS NULL THEN 'TOO_SHORT_FOR_MOTION_CHECK' ELSE mot.issue END], lambda i: i IS NOT NULL) AS issues
  FROM every LEFT JOIN cov USING (clip) LEFT JOIN mot USING (clip) LEFT JOIN trk USING (clip) LEFT JOIN cuts USING (clip) LEFT JOIN switches USING (clip) LEFT JOIN held USING (clip)),
classes AS (SELECT clip, issues, CASE WHEN len(issues) = 0 THEN 'VALID'
  WHEN list_has_any(issues, ['NO_KEYPOINTS', 'NO_VALID_BODY', 'NO_DETECTION', 'TOO_SHORT_FOR_MOTION_CHECK', 'NO_VALID_COMPARISONS']) OR n < 15 THEN 'INVALID'
  WHEN len(list_filter(issues, lambda i: contains(i, 'NO_MOTION') OR contains(i, 'HARD_CUTS_DETECTED') OR contains(i, 'EXCESSIVE_TRACKING_SWITCHES'))) > 0 THEN 'PARTIAL' ELSE 'INVALID' END AS status FROM lists)"""


CLASSES = _classes_sql(20, """CASE WHEN cuts.clip IS NOT NULL THEN 'HARD_CUTS_DETECTED' END,
  CASE WHEN len(cut_frames) > 0 THEN 'SCENE_TRANSITIONS_AT_FRAMES_[' || array_to_string(cut_frames[1:3], ', ') || ']' END,
  CASE WHEN switches.n > greatest(5, 0.05 * coalesce(held.n, 0)) THEN 'EXCESSIVE_TRACKING_SWITCHES_' || switches.n || '_FRAMES' ELSE trk.issue END,""")
LEGACY = _classes_sql(25, "trk.issue,").replace("CASE WHEN clip % 4 = 0 THEN 1.0 ELSE conf END", "conf").replace("every AS (SELECT DISTINCT clip FROM frames UNION ALL SELECT DISTINCT clip + 1000 FROM frames WHERE clip % 5 = 2)", "every AS (SELECT DISTINCT clip FROM frames)")
_ZERO = "zero AS (SELECT clip, frame, 0.0::DOUBLE AS x1, 0.0::DOUBLE AS y1, 0.0::DOUBLE AS x2, 0.0::DOUBLE AS y2 FROM frames)"


def _every(f):
    return f.select("clip").distinct().unionByName(f.where("clip % 5 = 2").select((F.col("clip") + 1000).alias("clip")).distinct())


def _scoreless(j):
    """Every fourth clip comes without scores."""
    return j.withColumn("conf", F.when(F.col("clip") % 4 != 0, F.col("conf")))


def _classes(spark, sf_dir):
    """Clips with cuts, tracker switches, and none at all; what decides them is in FIXTURES.md."""
    j, f = views.joints(spark, sf_dir), views.frames(spark, sf_dir).select("clip", "frame")
    listed = lambda d, name, when: d.groupBy("clip").agg(F.array_sort(F.collect_list(F.when(when, F.col("frame")))).alias(name))
    cuts = listed(f.where("clip % 11 = 0"), "cut_frames", (F.col("frame") % 4 == 3) & (F.col("clip") % 2 == 1))
    switches = listed(f.where("clip % 6 = 1"), "switch_frames", (F.col("frame") % 2 == 0) | (F.col("clip") % 4 == 1))
    return quality.classify(_scoreless(j), views.boxes(spark, sf_dir), cuts, switches, _every(f))


@query(views.sql(f"{COVERAGE}, {EVERY} SELECT clip, coalesce(frames, 0) AS frames, round(ratio, 4) + 0.0 AS ratio, {_COV_ISSUE} AS issue FROM every LEFT JOIN cov USING (clip)", "joints"))
def body_coverage(spark, sf_dir):
    j = views.joints(spark, sf_dir)
    return quality.coverage(_scoreless(j), _every(views.frames(spark, sf_dir))).withColumn("ratio", R("ratio"))


@query(views.sql(f"+{MOTION} SELECT clip, frames, compared, round(motion, 4) + 0.0 AS motion, round(variation, 4) + 0.0 AS variation, issue FROM mot", "joints"))
def motion_check(spark, sf_dir):
    return quality.motion(views.joints(spark, sf_dir)).withColumns({"motion": R("motion"), "variation": R("variation")})


@query(views.sql(f"+{TRACKING} SELECT * FROM trk", "boxes"))
def tracking_check(spark, sf_dir):
    return quality.tracking(views.boxes(spark, sf_dir))


@query(views.sql(f"+{TRACKING} SELECT clip, frame, round(overlap, 4) + 0.0 AS overlap, round(ratio, 4) + 0.0 AS ratio FROM bp", "boxes"))
def iou_pairs(spark, sf_dir):
    return quality.box_pairs(views.boxes(spark, sf_dir)).withColumns({"overlap": R("overlap"), "ratio": R("ratio")})


@query(views.sql(f"{CLASSES} SELECT clip, array_to_string(issues, '|') AS issues, status FROM classes", "boxes"))
def classify_clips(spark, sf_dir):
    return _classes(spark, sf_dir).withColumn("issues", F.array_join("issues", "|"))


@query(views.sql(f"+{_ZERO}, {LEGACY[1:].replace('boxes', 'zero')} SELECT clip, array_to_string(issues, '|') AS issues, status FROM classes", "joints"))
def legacy_validator(spark, sf_dir):
    """The legacy validator passes empty boxes, which break every pair of frames."""
    return quality.legacy(views.joints(spark, sf_dir)).withColumn("issues", F.array_join("issues", "|"))


@query(views.sql(f"{CLASSES} SELECT status, count(*) AS clips, round(100.0 * count(*) / sum(count(*)) OVER (), 4) + 0.0 AS percent FROM classes GROUP BY status", "boxes"))
def status_counts(spark, sf_dir):
    c = _classes(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("clips"))
    total = c.agg(F.sum("clips").alias("total"))
    return c.join(F.broadcast(total)).select("status", "clips", R(100.0 * F.col("clips") / F.col("total")).alias("percent"))


@query(views.sql(f"{CLASSES}, u AS (SELECT unnest(issues) AS issue FROM classes) SELECT issue, count(*) AS clips, round(100.0 * count(*) / (SELECT count(*) FROM classes), 4) + 0.0 AS percent FROM u GROUP BY issue", "boxes"))
def issue_histogram(spark, sf_dir):
    c = _classes(spark, sf_dir)
    total = c.agg(F.count(F.lit(1)).alias("total"))
    n = c.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("clips"))
    return n.join(F.broadcast(total)).select("issue", "clips", R(100.0 * F.col("clips") / F.col("total")).alias("percent"))


@query(views.sql(f"{CLASSES} SELECT left(status || '_class_' || clip % 3 || '_' || lpad(clip::VARCHAR, 6, '0') || CASE WHEN len(issues) > 0 THEN '_' || array_to_string(issues[1:2], '_') ELSE '' END, 200) AS name FROM classes", "boxes"))
def status_filename(spark, sf_dir):
    class_ = F.concat(F.lit("class_"), (F.col("clip") % 3).cast("string"))
    return _classes(spark, sf_dir).select(quality.status_name(class_, F.lpad(F.col("clip").cast("string"), 6, "0")).alias("name"))


@query(views.sql(f"{CLASSES} SELECT clip, status FROM classes WHERE status = 'VALID'", "boxes"))
def keep_valid(spark, sf_dir):
    """Clips that stay: a filter before the write instead of deleting what was written."""
    return _classes(spark, sf_dir).where("status = 'VALID'").select("clip", "status")


@query(views.sql("SELECT clip, frame, x2 - x1 > 0 AND y2 - y1 > 0 AS usable FROM boxes WHERE x1 IS NOT NULL", "boxes"))
def box_validity(spark, sf_dir):
    return views.boxes(spark, sf_dir).where("x1 IS NOT NULL AND NOT isnan(x1)").select("clip", "frame", ((F.col("x2") - F.col("x1") > 0) & (F.col("y2") - F.col("y1") > 0)).alias("usable"))


@query(views.sql("SELECT clip, round(avg(CASE WHEN x1 IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 4) + 0.0 AS share FROM boxes GROUP BY clip HAVING avg(CASE WHEN x1 IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) >= 0.5", "boxes"))
def box_share(spark, sf_dir):
    return views.boxes(spark, sf_dir).groupBy("clip").agg(F.avg(F.col("x1").isNotNull().cast("double")).alias("share")).where("share >= 0.5").withColumn("share", R("share"))


_HIST = """WITH h AS (SELECT user_id AS clip, (user_id * 0 + date_diff('day', DATE '1970-01-01', ts::DATE))::BIGINT AS day, least(255, floor(value / 2))::BIGINT AS bin, count(*) AS n FROM events GROUP BY ALL)"""


@query(f"{_HIST} SELECT * FROM h")
def gray_histogram(spark, sf_dir):
    """256 bins for each clip and day; the values stand for gray levels."""
    e = views.table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("clip"), F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("long").alias("day"), F.least(F.lit(255).cast("long"), F.floor(F.col("value") / 2)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""{_HIST}, d AS (SELECT DISTINCT clip, day FROM h), o AS (SELECT clip, day, lag(day) OVER (PARTITION BY clip ORDER BY day) AS before FROM d),
b AS (SELECT clip, day, before, unnest(range(256)) AS bin FROM o WHERE before IS NOT NULL),
c AS (SELECT b.clip, b.day, corr(coalesce(x.n, 0), coalesce(y.n, 0)) AS r FROM b LEFT JOIN h x ON (b.clip, b.day, b.bin) = (x.clip, x.day, x.bin) LEFT JOIN h y ON (b.clip, b.before, b.bin) = (y.clip, y.day, y.bin) GROUP BY b.clip, b.day)
SELECT clip, day, round(r, 4) + 0.0 AS r, r < 0.4 AS cut FROM c"""
)
def hard_cuts(spark, sf_dir):
    """Correlation of each histogram with the one before, from sums over shared bins: absent bins add nothing to them."""
    h = gray_histogram(spark, sf_dir)
    days = h.select("clip", "day").distinct().withColumn("before", F.lag("day").over(Window.partitionBy("clip").orderBy("day"))).where("before IS NOT NULL")
    sums = h.groupBy("clip", "day").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
    both = days.join(h.withColumnRenamed("n", "x"), ["clip", "day"]).join(h.select("clip", F.col("day").alias("before"), "bin", F.col("n").alias("y")), ["clip", "before", "bin"], "left")
    prod = both.groupBy("clip", "day", "before").agg(F.sum(F.col("x") * F.coalesce("y", F.lit(0))).alias("p"))
    z = prod.join(sums, ["clip", "day"]).join(sums.select("clip", F.col("day").alias("before"), F.col("s").alias("s2"), F.col("q").alias("q2")), ["clip", "before"])
    r = (256 * F.col("p") - F.col("s") * F.col("s2")) / F.nullif(F.sqrt((256 * F.col("q") - F.col("s") * F.col("s")).cast("double")) * F.sqrt((256 * F.col("q2") - F.col("s2") * F.col("s2")).cast("double")), F.lit(0.0))
    return z.select("clip", "day", R(r).alias("r"), (r < 0.4).alias("cut"))
