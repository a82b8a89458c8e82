"""Queries: processing reports, running statistics, schedules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.windows import before, ranked
from ..operators.quantiles import quantiles
from . import views
from .catalog import query

R = lambda c: F.round(c, 4) + 0.0
STATES = ("valid", "filtered", "failed", "error")
_PIVOT = ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in STATES)


@query(views.sql(f"SELECT class, {_PIVOT} FROM results GROUP BY class", "results"))
def class_status_matrix(spark, sf_dir):
    return views.results(spark, sf_dir).groupBy("class").pivot("status", list(STATES)).count().na.fill(0)


@query(views.sql("SELECT class, status, count(*) AS n FROM results GROUP BY ROLLUP (class, status)", "results"))
def status_rollup(spark, sf_dir):
    """An extra: both report levels in one pass."""
    return views.results(spark, sf_dir).rollup("class", "status").agg(F.count(F.lit(1)).alias("n"))


@query(views.sql("SELECT worker, count(*) AS processed, count(*) FILTER (status = 'error') AS errors, round(sum(time), 2) + 0.0 AS duration FROM results GROUP BY worker", "results"))
def worker_summary(spark, sf_dir):
    return views.results(spark, sf_dir).groupBy("worker").agg(F.count(F.lit(1)).alias("processed"), F.count(F.when(F.col("status") == "error", 1)).alias("errors"), (F.round(F.sum("time"), 2) + 0.0).alias("duration"))


@query(views.sql("SELECT worker, round(avg(time), 4) + 0.0 AS mean, round(quantile_cont(time, 0.5), 4) + 0.0 AS median, round(sum(time), 2) + 0.0 AS total, round(60 * count(*) / sum(time), 4) + 0.0 AS per_minute FROM results WHERE status = 'valid' GROUP BY worker", "results"))
def time_stats(spark, sf_dir):
    v = views.results(spark, sf_dir).where("status = 'valid'")
    median = quantiles(v, ["worker"], "time", {"median": 0.5}).select("worker", R("median").alias("median"))
    rest = v.groupBy("worker").agg(R(F.avg("time")).alias("mean"), (F.round(F.sum("time"), 2) + 0.0).alias("total"), R(60 * F.count(F.lit(1)) / F.sum("time")).alias("per_minute"))
    return rest.join(median, "worker").select("worker", "mean", "median", "total", "per_minute")


@query(views.sql("+r AS (SELECT id, status, row_number() OVER (ORDER BY id) AS rn FROM results), c AS (SELECT rn, count(*) FILTER (status = 'valid') OVER (ORDER BY rn) AS valid, count(*) FILTER (status = 'error') OVER (ORDER BY rn) AS error FROM r) SELECT rn, valid, error FROM c WHERE rn % 100 = 0", "results"))
def running_counts(spark, sf_dir):
    """Totals after every hundredth result: counts of blocks, then their sums over ranges of blocks."""
    r = ranked(views.results(spark, sf_dir).select("id", "status"), "id").withColumn("b", F.floor(F.col("rank") / 100))
    c = r.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("status") == "valid", 1)).alias("v"), F.count(F.when(F.col("status") == "error", 1)).alias("e"))
    c = before(c, "b", ["v", "e"]).where("n = 100")
    return c.select(((F.col("b") + 1) * 100).alias("rn"), (F.col("before_v") + F.col("v")).alias("valid"), (F.col("before_e") + F.col("e")).alias("error"))


def top_or_all(totals, key: str, most: int = 20, top: int = 10):
    """Rows by falling total: all if they are at most `most`, else the first `top`. No task sees more than `most` + 1 rows after the sort."""
    order = F.desc("total"), key
    first = totals.orderBy(*order).limit(most + 1)
    n = first.agg(F.count(F.lit(1)).alias("n"))
    ranked_ = first.withColumn("r", F.row_number().over(Window.orderBy(*order)))
    return ranked_.join(F.broadcast(n)).where((F.col("n") <= most) | (F.col("r") <= top)).select(*totals.columns)


@query(views.sql("+t AS (SELECT class, count(*) AS total FROM results GROUP BY class) SELECT class, total FROM t QUALIFY count(*) OVER () <= 20 OR row_number() OVER (ORDER BY total DESC, class) <= 10", "results"))
def top_classes(spark, sf_dir):
    """A top-k report over few classes: all of them."""
    return top_or_all(views.results(spark, sf_dir).groupBy("class").agg(F.count(F.lit(1)).alias("total")), "class")


@query(views.sql("+t AS (SELECT id % 37 AS class, count(*) AS total FROM results GROUP BY 1) SELECT class, total FROM t QUALIFY count(*) OVER () <= 20 OR row_number() OVER (ORDER BY total DESC, class) <= 10", "results"))
def top_many_classes(spark, sf_dir):
    """The same over many classes: the ten largest."""
    return top_or_all(views.results(spark, sf_dir).groupBy((F.col("id") % 37).alias("class")).agg(F.count(F.lit(1)).alias("total")), "class")


@query(views.sql("+m AS (SELECT class AS steps, avg(time) AS mean FROM results GROUP BY class) SELECT steps, round(mean, 4) + 0.0 AS mean, row_number() OVER (ORDER BY round(mean, 9), steps) AS place FROM m QUALIFY place <= 10", "results"))
def step_ranking(spark, sf_dir):
    """The ten best step counts: a top-k report, ranked after the limit."""
    m = views.results(spark, sf_dir).groupBy(F.col("class").alias("steps")).agg(F.avg("time").alias("m"))
    order = F.round("m", 9), "steps"
    return m.orderBy(*order).limit(10).select("steps", R("m").alias("mean"), F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))


@query(views.sql("SELECT class, round(count(*) / (sum(time) / 60), 4) + 0.0 AS rate, round((1000 - count(*)) / (count(*) / (sum(time) / 60)), 4) + 0.0 AS eta FROM results GROUP BY class", "results"))
def throughput_eta(spark, sf_dir):
    rate = F.count(F.lit(1)) / (F.sum("time") / 60)
    return views.results(spark, sf_dir).groupBy("class").agg(R(rate).alias("rate"), R((1000 - F.count(F.lit(1))) / rate).alias("eta"))


@query(views.sql("SELECT count(DISTINCT class) AS classes, count(DISTINCT worker) AS workers FROM results", "results"))
def distinct_classes(spark, sf_dir):
    return views.results(spark, sf_dir).agg(F.countDistinct("class").alias("classes"), F.countDistinct("worker").alias("workers"))


@query(views.sql("+m AS (SELECT class AS steps, avg(time) AS mean, stddev_pop(time) AS std, min(time) AS least, max(time) AS most FROM results GROUP BY class) SELECT steps, round(mean, 4) + 0.0 AS mean, round(std, 4) + 0.0 AS std, least, most, mean = min(mean) OVER () AS best FROM m", "results"))
def step_benchmark(spark, sf_dir):
    m = views.results(spark, sf_dir).groupBy(F.col("class").alias("steps")).agg(F.avg("time").alias("m"), F.stddev_pop("time").alias("s"), F.min("time").alias("least"), F.max("time").alias("most"))
    best = m.agg(F.min("m").alias("low"))
    return m.join(F.broadcast(best)).select("steps", R("m").alias("mean"), R("s").alias("std"), "least", "most", (F.col("m") == F.col("low")).alias("best"))


@query(views.sql("+s AS (SELECT worker AS sample, class // 4 AS steps, avg(time) AS loss FROM results GROUP BY ALL), p AS (SELECT a.steps, a.loss - b.loss AS d, b.loss AS base FROM s a JOIN s b ON a.sample = b.sample AND b.steps = b.sample % 3 AND a.steps <> b.steps) SELECT steps, round(avg(d), 4) + 0.0 AS diff, round(100 * avg(d) / avg(base), 4) + 0.0 AS percent, count(*) FILTER (d < 0) AS improved FROM p GROUP BY steps", "results"))
def paired_improvement(spark, sf_dir):
    s = views.results(spark, sf_dir).groupBy(F.col("worker").alias("sample"), F.floor(F.col("class") / 4).alias("steps")).agg(F.avg("time").alias("loss"))
    base = s.where(F.col("steps") == F.col("sample") % 3).select("sample", F.col("steps").alias("own"), F.col("loss").alias("base"))
    p = s.join(base, "sample").where("steps <> own").withColumn("d", F.col("loss") - F.col("base"))
    return p.groupBy("steps").agg(R(F.avg("d")).alias("diff"), R(100 * F.avg("d") / F.avg("base")).alias("percent"), F.count(F.when(F.col("d") < 0, 1)).alias("improved"))


@query(views.sql("+s AS (SELECT worker, class AS k, avg(time) AS v FROM results GROUP BY ALL) SELECT a.k AS a, b.k AS b, round(avg((a.v - b.v) ** 2), 3) + 0.0 AS mse FROM s a JOIN s b ON a.worker = b.worker AND a.k < b.k GROUP BY a.k, b.k", "results"))
def pairwise_mse(spark, sf_dir):
    """Pairs of the few configurations of each sample, joined on the sample."""
    s = views.results(spark, sf_dir).groupBy("worker", F.col("class").alias("k")).agg(F.avg("time").alias("v"))
    a, b = s.alias("a"), s.alias("b")
    p = a.join(b, (F.col("a.worker") == F.col("b.worker")) & (F.col("a.k") < F.col("b.k")))
    return p.groupBy(F.col("a.k").alias("a"), F.col("b.k").alias("b")).agg((F.round(F.avg((F.col("a.v") - F.col("b.v")) ** 2), 3) + 0.0).alias("mse"))


@query(views.sql("SELECT status, round(avg(time) * 1000, 3) + 0.0 AS mean_ms, round(100 * sum(time) / sum(sum(time)) OVER (), 4) + 0.0 AS share FROM results GROUP BY status", "results"))
def timer_stats(spark, sf_dir):
    t = views.results(spark, sf_dir).groupBy("status").agg(F.avg("time").alias("m"), F.sum("time").alias("s"))
    total = t.agg(F.sum("s").alias("total"))
    return t.join(F.broadcast(total)).select("status", (F.round(F.col("m") * 1000, 3) + 0.0).alias("mean_ms"), R(100 * F.col("s") / F.col("total")).alias("share"))


@query(views.sql("+p AS (SELECT worker, avg(time) AS m FROM results GROUP BY worker) SELECT round(avg(m), 4) + 0.0 AS mean_of_means FROM p", "results"))
def rank_mean(spark, sf_dir):
    return views.results(spark, sf_dir).groupBy("worker").agg(F.avg("time").alias("m")).agg(R(F.avg("m")).alias("mean_of_means"))


@query(views.sql("SELECT CASE status WHEN 'error' THEN 'worker_exception' WHEN 'failed' THEN 'load_error' ELSE 'result' END AS message, count(*) AS n FROM results GROUP BY ALL", "results"))
def message_types(spark, sf_dir):
    m = F.when(F.col("status") == "error", "worker_exception").when(F.col("status") == "failed", "load_error").otherwise("result")
    return views.results(spark, sf_dir).groupBy(m.alias("message")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s::BIGINT AS step, round(CASE WHEN s < 50 THEN 1 ELSE 0.1 + 0.4 * (1 + cos(pi() * (s - 50) / 150.0)) / 2 END, 6) + 0.0 AS factor FROM range(200) t(s)")
def lr_schedule(spark, sf_dir):
    s = F.col("id")
    return spark.range(200).select(s.alias("step"), (F.round(F.when(s < 50, 1.0).otherwise(0.1 + 0.4 * (1 + F.cos(F.pi() * (s - 50) / 150.0)) / 2), 6) + 0.0).alias("factor"))


@query("SELECT s AS step, (s * 16) % 1000 AS batch, ((s * 16) % 1000) * 8 AS sample FROM range(0, 2000, 37) t(s)")
def resume_position(spark, sf_dir):
    return spark.range(0, 2000, 37).select(F.col("id").alias("step"), ((F.col("id") * 16) % 1000).alias("batch"), (((F.col("id") * 16) % 1000) * 8).alias("sample"))


@query("SELECT t, i, round(sin(t * exp(-i * ln(10000.0) / 7)), 5) + 0.0 AS s, round(cos(t * exp(-i * ln(10000.0) / 7)), 5) + 0.0 AS c FROM range(20) a(t), range(8) b(i)")
def time_embedding(spark, sf_dir):
    t = spark.range(20).select(F.col("id").alias("t"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"))
    x = F.col("t") * F.exp(-F.col("i") * F.log(F.lit(10000.0)) / 7)
    return t.select("t", F.col("i").cast("long").alias("i"), (F.round(F.sin(x), 5) + 0.0).alias("s"), (F.round(F.cos(x), 5) + 0.0).alias("c"))


@query(views.sql("SELECT clip, frame, k, round(0.3 * e[k + 1] + 0.7 * e[k + 9], 4) + 0.0 AS x, round(e[k + 1] - e[k + 9], 4) + 0.0 AS target FROM frames, range(8) t(k)", "frames"))
def flow_interp(spark, sf_dir):
    z = F.zip_with(F.slice("e", 1, 8), F.slice("e", 9, 8), lambda a, n: F.struct((0.3 * a + 0.7 * n).alias("x"), (a - n).alias("t")))
    return views.frames(spark, sf_dir).select("clip", "frame", F.posexplode(z).alias("k", "v")).select("clip", "frame", F.col("k").cast("long").alias("k"), R("v.x").alias("x"), R("v.t").alias("target"))


@query("SELECT doc_id, floor(r / 64)::BIGINT AS shard, 'train-' || lpad(floor(r / 64)::BIGINT::VARCHAR, 5, '0') || '-of-' || lpad(ceil(n / 64)::BIGINT::VARCHAR, 5, '0') AS name FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS n FROM documents)")
def shard_plan(spark, sf_dir):
    d = ranked(views.table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    n = d.agg(F.ceil(F.count(F.lit(1)) / 64).alias("n"))
    s = F.floor(F.col("rank") / 64)
    return d.join(F.broadcast(n)).select("doc_id", s.alias("shard"), F.format_string("train-%05d-of-%05d", s, F.col("n")).alias("name"))


@query("SELECT b AS batch, count(*) AS n, min(doc_id) AS first FROM (SELECT doc_id, floor((row_number() OVER (ORDER BY doc_id) - 1) / 8)::BIGINT AS b FROM documents) GROUP BY b")
def collate_batches(spark, sf_dir):
    d = ranked(views.table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return d.groupBy(F.floor(F.col("rank") / 8).alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
