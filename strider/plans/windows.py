"""Queries: windows, resampling and rolling baselines over the series view."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import windows
from ..operators.quantiles import quantiles
from ..operators.stored import stored
from . import views
from .catalog import query

R = lambda c: F.round(c, 4) + 0.0
L, HOP, EVEN = 24, 12, 30
_STRETCH = lambda i, n, t: f"CASE WHEN {i} = {t - 1} THEN {n} - 1 ELSE floor({i} * (({n} - 1) / {t - 1}.0::DOUBLE))::BIGINT END"


def _pos(target: int) -> str:
    return f"pos AS (SELECT clip, w, pos, start + CASE WHEN length = {target} THEN pos ELSE {_STRETCH('pos', 'length', target)} END AS src FROM wins, range({target}) t(pos))"


_FIXED = f"wins AS (SELECT clip, w, w * {EVEN} AS start, least({EVEN}, n - w * {EVEN}) AS length FROM (SELECT clip, n, unnest(range(ceil(n / {EVEN})::BIGINT)) AS w FROM lengths))"
_OVER = f"wins AS (SELECT clip, w, w * {HOP} AS start, least({L}, n - w * {HOP}) AS length FROM (SELECT clip, n, unnest(range(CASE WHEN n <= {L} THEN 1 ELSE full_ + (full_ * {HOP} < n)::BIGINT END)) AS w FROM (SELECT clip, n, CASE WHEN n <= {L} THEN 0 ELSE floor((n - {L}) / {HOP})::BIGINT + 1 END AS full_ FROM lengths)))"


@query(views.sql("SELECT clip, i, least(floor(i * (n / 40.0::DOUBLE))::BIGINT, n - 1) AS src FROM lengths, range(40) t(i)", "lengths"))
def resample_index(spark, sf_dir):
    return windows.resampled(views.lengths(spark, sf_dir), 40)


@query(views.sql(f"+{_FIXED}, {_pos(EVEN)} SELECT * FROM pos", "lengths"))
def fixed_clips(spark, sf_dir):
    return windows.positions(windows.fixed(views.lengths(spark, sf_dir), EVEN), EVEN)


@query(views.sql(f"+{_FIXED}, pos AS (SELECT clip, w, pos, start + CASE WHEN length = {EVEN} THEN pos ELSE least(floor(pos * (length / {EVEN}.0::DOUBLE))::BIGINT, length - 1) END AS src FROM wins, range({EVEN}) t(pos)) SELECT * FROM pos", "lengths"))
def resampled_clips(spark, sf_dir):
    return windows.positions(windows.fixed(views.lengths(spark, sf_dir), EVEN), EVEN, even=True)


@query(views.sql(f"+{_FIXED}, {_pos(EVEN)} SELECT clip, w, src, min(pos) AS pos FROM pos GROUP BY clip, w, src", "lengths"))
def unstretch_index(spark, sf_dir):
    return windows.first_occurrences(windows.positions(windows.fixed(views.lengths(spark, sf_dir), EVEN), EVEN))


@query(views.sql(f"+{_OVER}, {_pos(L)} SELECT * FROM pos", "lengths"))
def overlapping_clips(spark, sf_dir):
    return windows.positions(windows.overlapping(views.lengths(spark, sf_dir), L, HOP), L)


@query(views.sql(f"+{_OVER}, {_pos(L)}, m AS (SELECT pos.clip, src AS frame, avg(signal + w) AS v FROM pos JOIN series s ON pos.clip = s.clip AND src = frame GROUP BY pos.clip, src) SELECT clip, frame, round(coalesce(v, 0), 4) + 0.0 AS v FROM series LEFT JOIN m USING (clip, frame)", "lengths", "series"))
def overlap_average(spark, sf_dir):
    n = views.lengths(spark, sf_dir)
    s = views.series(spark, sf_dir)
    pos = windows.positions(windows.overlapping(n, L, HOP), L)
    pred = pos.join(s.withColumnRenamed("frame", "src"), ["clip", "src"]).select("clip", "src", (F.col("signal") + F.col("w")).alias("v"))
    return windows.overlap_average(pred, n).withColumn("v", R("v"))


@query(views.sql("SELECT clip, start FROM lengths, unnest(CASE WHEN n - 16 >= 4 THEN range(4, n - 15, 16) END) t(start)", "lengths"))
def train_windows(spark, sf_dir):
    return windows.training(views.lengths(spark, sf_dir))


@query(views.sql("SELECT clip, start FROM lengths, unnest(CASE WHEN n - 16 >= 1 THEN range(0, n - 16, 4) END) t(start)", "lengths"))
def candidate_intervals(spark, sf_dir):
    return windows.candidates(views.lengths(spark, sf_dir))


@query(views.sql("+a AS (SELECT clip, list(signal ORDER BY frame) AS v FROM series GROUP BY clip), p AS (SELECT clip, list_concat(v, list_transform(range(80), lambda i: v[-1]))[1:80] AS v FROM a) SELECT clip, len(v) AS n, round(list_sum(v), 3) + 0.0 AS total, v[80] AS last FROM p", "series"))
def padded_window(spark, sf_dir):
    a = views.series(spark, sf_dir).groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("frame", "signal"))).alias("v")).select("clip", windows.padded(F.col("v.signal"), 80).alias("v"))
    return a.select("clip", F.size("v").cast("long").alias("n"), (F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 3) + 0.0).alias("total"), F.element_at("v", -1).alias("last"))


@query(views.sql("+r AS (SELECT clip, n, list_reduce(list_transform(range(n), lambda x: [0.0::DOUBLE]), lambda s, x: list_append(s, s[-1] + 2.4::DOUBLE)) AS sums FROM lengths) SELECT clip, k - 1 AS k, floor(sums[k])::BIGINT AS frame FROM r, unnest(range(1, n + 1)) t(k) WHERE sums[k] < n", "lengths"))
def fps_sample(spark, sf_dir):
    return windows.sampled_frames(views.lengths(spark, sf_dir), 24.0, 10.0)


@query(views.sql(f"SELECT clip, k, CASE WHEN n <= 60 THEN k ELSE {_STRETCH('k', 'n', 60)} END AS frame FROM lengths, unnest(range(least(n, 60))) t(k)", "lengths"))
def uniform_pick(spark, sf_dir):
    return windows.uniform(views.lengths(spark, sf_dir), 60)


@query(views.sql("+w AS (SELECT clip, start FROM lengths, unnest(CASE WHEN n - 16 >= 4 THEN range(4, n - 15, 16) END) t(start)) SELECT clip, start, k, (start - 4) * 3 + " + _STRETCH("k", "10", 4) + " AS video_frame FROM w, range(4) t(k)", "lengths"))
def history_frames(spark, sf_dir):
    """Four pictures between the video frames (every third is a pose) of the first and the last of four history frames."""
    w = windows.training(views.lengths(spark, sf_dir)).select("*", F.explode(windows.upto(F.lit(4))).alias("k"))
    return w.select("clip", "start", "k", ((F.col("start") - 4) * 3 + windows.stretched(F.col("k"), F.lit(10).cast("long"), 4)).alias("video_frame"))


@query(views.sql("+g AS (SELECT clip, frame, CASE WHEN frame % 5 < 2 THEN signal END AS signal FROM series), m AS (SELECT *, last(CASE WHEN signal IS NOT NULL THEN frame END IGNORE NULLS) OVER b AS pf, last(signal IGNORE NULLS) OVER b AS pv, first(CASE WHEN signal IS NOT NULL THEN frame END IGNORE NULLS) OVER o AS nf, first(signal IGNORE NULLS) OVER o AS nv FROM g WINDOW b AS (PARTITION BY clip ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), o AS (PARTITION BY clip ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT clip, frame, CASE WHEN nf IS NULL OR frame - pf <= nf - frame THEN pv ELSE nv END AS signal FROM m", "series"))
def nearest_box_fill(spark, sf_dir):
    return windows.nearest_fill(views.series(spark, sf_dir).withColumn("signal", F.when(F.col("frame") % 5 < 2, F.col("signal"))), "signal")


_ROLL = "roll AS (SELECT clip, frame, signal, first(signal) OVER b AS static, first(signal) OVER b + coalesce(first(signal - before) OVER b, 0) * (frame % 3) AS linear FROM (SELECT *, lag(signal) OVER (PARTITION BY clip ORDER BY frame) AS before FROM series) WINDOW b AS (PARTITION BY clip, frame // 3 ORDER BY frame))"


@query(views.sql(f"+{_ROLL} SELECT clip, frame, static FROM roll", "series"))
def rolling_static(spark, sf_dir):
    return windows.rolling(views.series(spark, sf_dir), 3).select("clip", "frame", "static")


@query(views.sql(f"+{_ROLL} SELECT clip, frame, round(linear, 4) + 0.0 AS linear FROM roll", "series"))
def rolling_linear(spark, sf_dir):
    return windows.rolling(views.series(spark, sf_dir), 3).select("clip", "frame", R("linear").alias("linear"))


@query(views.sql("SELECT s.clip, s.frame, round(b.signal + 0.1 * (s.frame - b.frame), 4) + 0.0 AS model FROM series s JOIN series b ON s.clip = b.clip AND b.frame = s.frame - s.frame % 3", "series"))
def rolling_join(spark, sf_dir):
    return windows.boundaries(views.series(spark, sf_dir), 3).select("clip", "frame", R("model").alias("model"))


def _moved(spark, sf_dir):
    """The series with each frame's value before, by one window, and for each clip whether its motion is in the upper quarter."""
    s = views.series(spark, sf_dir).withColumn("before", F.lag("signal").over(Window.partitionBy("clip").orderBy("frame")))
    moved = stored(s.groupBy("clip").agg(F.sum(F.abs(F.col("signal") - F.col("before"))).alias("motion")))
    high = quantiles(moved, [], "motion", {"p75": 0.75})
    return s, moved.join(F.broadcast(high)).select("clip", (F.col("motion") >= F.col("p75")).alias("high"))


def _errors(spark, sf_dir):
    """All steps in one pass: a frame of each step's block takes the block's first value, its change, and the stub model's drift."""
    s, moved = _moved(spark, sf_dir)
    steps = s.join(moved, "clip").select("*", F.explode(F.array(*(F.lit(k).cast("long") for k in (1, 2, 3, 5)))).alias("step"))
    block = Window.partitionBy("step", "clip", F.floor(F.col("frame") / F.col("step"))).orderBy("frame")
    first = F.first(F.struct("signal", (F.col("signal") - F.col("before")).alias("speed"))).over(block)
    r = steps.select("clip", "frame", "step", "high", "signal", (F.col("frame") % F.col("step")).alias("k"), first.alias("at"))
    made = {"static": F.col("at.signal"), "linear": F.col("at.signal") + F.coalesce("at.speed", F.lit(0.0)) * F.col("k"), "model": F.col("at.signal") + 0.1 * F.col("k")}
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("method"), v.alias("p")) for m, v in made.items()))).alias("x")
    return r.select("clip", "frame", "step", "high", "signal", each).select("clip", "frame", "step", "x.method", "high", ((F.col("x.p") - F.col("signal")) * (F.col("x.p") - F.col("signal"))).alias("sq"))


_ERR = """+mo AS (SELECT clip, sum(abs(signal - before)) AS motion FROM (SELECT *, lag(signal) OVER (PARTITION BY clip ORDER BY frame) AS before FROM series) GROUP BY clip),
hi AS (SELECT clip, motion >= (SELECT quantile_cont(motion, 0.75) FROM mo) AS high FROM mo),
st AS (SELECT unnest([1, 2, 3, 5])::BIGINT AS step),
ro AS (SELECT step, clip, frame, signal, first(signal) OVER b AS static, first(signal) OVER b + coalesce(first(signal - before) OVER b, 0) * (frame % step) AS linear, first(signal) OVER b + 0.1 * (frame % step) AS model FROM (SELECT *, lag(signal) OVER (PARTITION BY clip ORDER BY frame) AS before FROM series), st WINDOW b AS (PARTITION BY step, clip, frame // step ORDER BY frame)),
er AS (SELECT clip, frame, step, method, high, (p - signal) ** 2 AS sq FROM (SELECT clip, frame, step, signal, unnest(['static', 'linear', 'model']) AS method, unnest([static, linear, model]) AS p FROM ro) JOIN hi USING (clip))"""


@query(views.sql(f"{_ERR} SELECT step, method, round(sqrt(avg(sq)), 3) + 0.0 AS rmse, round(sqrt(avg(sq) FILTER (high)), 3) + 0.0 AS rmse_high, round(sqrt(avg(sq) FILTER (frame % step <> 0)), 3) + 0.0 AS rmse_future FROM er GROUP BY step, method", "series"))
def rolling_rmse(spark, sf_dir):
    r3 = lambda c: F.round(F.sqrt(F.avg(c)), 3) + 0.0
    return _errors(spark, sf_dir).groupBy("step", "method").agg(r3(F.col("sq")).alias("rmse"), r3(F.when(F.col("high"), F.col("sq"))).alias("rmse_high"), r3(F.when(F.col("frame") % F.col("step") != 0, F.col("sq"))).alias("rmse_future"))


@query(views.sql(f"{_ERR}, c AS (SELECT clip, step, method, sqrt(avg(sq)) AS rmse FROM er GROUP BY clip, step, method) SELECT step, method, round(quantile_cont(rmse, 0.5), 3) + 0.0 AS median, round(quantile_cont(rmse, 0.25), 3) + 0.0 AS p25, round(quantile_cont(rmse, 0.75), 3) + 0.0 AS p75 FROM c GROUP BY step, method", "series"))
def rmse_distribution(spark, sf_dir):
    c = _errors(spark, sf_dir).groupBy("clip", "step", "method").agg(F.sqrt(F.avg("sq")).alias("rmse"))
    q = quantiles(c, ["step", "method"], "rmse", {"median": 0.5, "p25": 0.25, "p75": 0.75})
    return q.select("step", "method", *((F.round(n, 3) + 0.0).alias(n) for n in ("median", "p25", "p75")))


@query(views.sql(f"{_ERR} SELECT clip FROM hi WHERE high", "series"))
def high_motion(spark, sf_dir):
    return _moved(spark, sf_dir)[1].where("high").select("clip")


@query("SELECT DISTINCT unnest(range(0, 16, s))::BIGINT AS k FROM (SELECT unnest([1, 2, 3, 5, 8]) AS s)")
def needed_offsets(spark, sf_dir):
    return spark.createDataFrame([(1,), (2,), (3,), (5,), (8,)], "s long").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"), "s")).alias("k")).distinct()


@query("SELECT s, f FROM (SELECT unnest([2, 3, 5])::BIGINT AS s), range(16) t(f) WHERE f % s <> 0")
def future_frames(spark, sf_dir):
    """All frames without the boundaries, as a set difference."""
    s = spark.createDataFrame([(2,), (3,), (5,)], "s long")
    every = s.select("s", F.explode(windows.upto(F.lit(16))).alias("f"))
    return every.subtract(s.select("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"), "s")).alias("f")))


@query(views.sql("+q AS (SELECT clip, n, curr, least(16, n - curr) AS rem FROM lengths, unnest(range(0, n, 10)) t(curr)) SELECT clip, curr, k, least(curr + CASE WHEN k = 3 THEN rem - 1 ELSE floor(k * ((rem - 1) / 3.0::DOUBLE))::BIGINT END, n - 1) AS frame FROM q, range(4) t(k)", "lengths"))
def eval_images(spark, sf_dir):
    q = views.lengths(spark, sf_dir).select("clip", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(10).cast("long"))).alias("curr")).withColumn("rem", F.least(F.lit(16).cast("long"), F.col("n") - F.col("curr")))
    return q.select("*", F.explode(windows.upto(F.lit(4))).alias("k")).select("clip", "curr", "k", F.least(F.col("curr") + windows.stretched(F.col("k"), F.col("rem"), 4), F.col("n") - 1).alias("frame"))


@query(views.sql("+t AS (SELECT clip, n, greatest(2, n - 7) AS m FROM lengths) SELECT clip, i, CASE WHEN i = m - 1 THEN n - 1 ELSE floor(i * ((n - 1) / (m - 1)::DOUBLE))::BIGINT END AS src FROM t, unnest(range(m)) u(i)", "lengths"))
def length_alignment(spark, sf_dir):
    t = views.lengths(spark, sf_dir).withColumn("m", F.greatest(F.lit(2).cast("long"), F.col("n") - 7)).select("*", F.explode(windows.upto(F.col("m"))).alias("i"))
    return t.select("clip", "i", F.when(F.col("i") == F.col("m") - 1, F.col("n") - 1).otherwise(F.floor(F.col("i") * ((F.col("n") - 1) / (F.col("m") - 1).cast("double")))).alias("src"))


@query(views.sql("SELECT s.clip, s.frame, l.frame AS pose FROM series s LEFT JOIN (SELECT clip, 2 * frame AS video, min(frame) AS frame FROM series GROUP BY clip, 2 * frame) l ON s.clip = l.clip AND s.frame = l.video", "series"))
def frame_lookup(spark, sf_dir):
    """Video frame to pose frame; every second video frame has one."""
    s = views.series(spark, sf_dir).select("clip", "frame")
    pose = s.groupBy("clip", (2 * F.col("frame")).alias("video")).agg(F.min("frame").alias("pose"))
    return s.join(pose.withColumnRenamed("video", "frame"), ["clip", "frame"], "left")


@query(views.sql("SELECT id, (row_number() OVER (ORDER BY id) - 1) % 8 AS task FROM results", "results"))
def round_robin(spark, sf_dir):
    """Ids are dense, so rank and id agree and no single-partition window is needed; the rank stays for gaps within a range."""
    ids = views.results(spark, sf_dir).select("id")
    return windows.ranked(ids, "id").select("id", (F.col("rank") % 8).alias("task"))

