"""Motion views over the driver's tables, as DataFrames and as SQL for oracles.

A clip is a label and a remainder of the vector id; a frame is one embedding, whose
numbers are read as 17 joints. See FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Screen size of the derived views.
WIDTH, HEIGHT = 640, 480


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip, frame, e (64 doubles)."""
    w = Window.partitionBy("clip").orderBy("vec_id")
    t = table(spark, sf_dir, "embeddings").select((F.col("label") * 3 + F.col("vec_id") % 3).cast("long").alias("clip"), "vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return t.select("clip", (F.row_number().over(w) - 1).cast("long").alias("frame"), "e")


def joints(spark: SparkSession, sf_dir: str, zoom: float = 1.0) -> DataFrame:
    """clip, frame, j, px, py, pz, conf, x, y; undetected joints are at 0, 0. `zoom` enlarges the person on the screen."""
    f = frames(spark, sf_dir).select("clip", "frame", "e", F.explode(F.sequence(F.lit(0), F.lit(16))).alias("j"))
    p = [F.get("e", F.col("j") * 3 + k) for k in range(3)]
    conf = F.least(F.lit(1.0), 4 * F.abs(F.get("e", F.col("j") + 47)))
    f = f.select("clip", "frame", F.col("j").cast("long").alias("j"), *(c.alias(n) for c, n in zip(p, ("px", "py", "pz"))), conf.alias("conf"))
    amp = F.when(F.col("clip") % 5 == 0, 0.001).otherwise(zoom)
    seen = F.col("conf") >= 0.1
    return f.withColumns({"x": F.when(seen, 320 + amp * 320 * F.col("px")).otherwise(0.0), "y": F.when(seen, 240 + amp * 240 * F.col("py")).otherwise(0.0)})


def predicted(frames: DataFrame, column: str, out: str) -> DataFrame:
    """clip, frame and `out`: what the static model predicts for a frame, the value of the frame before; first frames have no prediction."""
    return frames.select("clip", (F.col("frame") + 1).alias("frame"), F.col(column).alias(out))


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip, frame, pose (51 doubles, x y z of 17 joints)."""
    return frames(spark, sf_dir).select("clip", "frame", F.slice("e", 1, 51).alias("pose"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip, frame, x1, y1, x2, y2: around detected joints, null in every 13th frame."""
    seen = F.col("conf") >= 0.1
    lost = (F.col("clip") * 7 + F.col("frame")) % 13 == 0
    b = joints(spark, sf_dir).groupBy("clip", "frame").agg(*(f(F.when(seen, F.col(c))).alias(n) for n, c, f in (("x1", "x", F.min), ("y1", "y", F.min), ("x2", "x", F.max), ("y2", "y", F.max))))
    return b.select("clip", "frame", *(F.when(~lost, F.col(c)).alias(c) for c in ("x1", "y1", "x2", "y2")))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip, frame, signal."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("clip"), (F.row_number().over(w) - 1).cast("long").alias("frame"), F.col("value").alias("signal"))


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip, n: frames of each series."""
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("clip")).agg(F.count(F.lit(1)).alias("n"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, class, worker, status, time."""
    kind = F.col("event_type")
    status = F.when(kind == "view", "valid").when(kind == "click", "filtered").when(kind == "purchase", "failed").otherwise("error")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 12).alias("class"), (F.col("user_id") % 8).alias("worker"), status.alias("status"), F.col("value").alias("time"))


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, caption: four shapes of caption file, by turn."""
    head = F.concat(F.lit("Video: v"), F.col("conv_id").cast("string"), F.lit("\nAction Class: walk\nTimestamp: now\n\n"))
    k = F.col("turn") % 4
    body = (
        F.when(k == 0, F.concat(head, F.lit("Description:\n"), F.col("text")))
        .when(k == 1, F.concat(head, F.lit("assistant\n"), F.col("text")))
        .when(k == 2, F.concat(head, F.lit("  DESCRIPTION: same line\nassistant\n"), F.col("text"), F.lit("\n\ndescription again\nlast ")))
        .otherwise(F.concat(head, F.lit("Description:\nassistant\n  "), F.col("text"), F.lit("\n")))
    )
    return table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), body.alias("caption"))


_SQL = {
    "frames": "frames AS (SELECT (label * 3 + vec_id % 3)::BIGINT AS clip, row_number() OVER (PARTITION BY label * 3 + vec_id % 3 ORDER BY vec_id) - 1 AS frame, embedding::DOUBLE[] AS e FROM embeddings)",
    "joints": "joints AS (SELECT clip, frame, j, px, py, pz, conf, CASE WHEN conf >= 0.1 THEN 320 + amp * 320 * px ELSE 0 END AS x, CASE WHEN conf >= 0.1 THEN 240 + amp * 240 * py ELSE 0 END AS y FROM (SELECT clip, frame, j, e[3 * j + 1] AS px, e[3 * j + 2] AS py, e[3 * j + 3] AS pz, least(1.0, 4 * abs(e[48 + j])) AS conf, CASE WHEN clip % 5 = 0 THEN 0.001 ELSE 1.0 END::DOUBLE AS amp FROM frames, range(17) t(j)))",
    "boxes": "boxes AS (SELECT clip, frame, CASE WHEN NOT lost THEN x1 END AS x1, CASE WHEN NOT lost THEN y1 END AS y1, CASE WHEN NOT lost THEN x2 END AS x2, CASE WHEN NOT lost THEN y2 END AS y2 FROM (SELECT clip, frame, (clip * 7 + frame) % 13 = 0 AS lost, min(x) FILTER (conf >= 0.1) AS x1, min(y) FILTER (conf >= 0.1) AS y1, max(x) FILTER (conf >= 0.1) AS x2, max(y) FILTER (conf >= 0.1) AS y2 FROM joints GROUP BY clip, frame))",
    "series": "series AS (SELECT user_id AS clip, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value AS signal FROM events)",
    "lengths": "lengths AS (SELECT user_id AS clip, count(*) AS n FROM events GROUP BY user_id)",
    "results": "results AS (SELECT event_id AS id, user_id % 12 AS class, user_id % 8 AS worker, CASE event_type WHEN 'view' THEN 'valid' WHEN 'click' THEN 'filtered' WHEN 'purchase' THEN 'failed' ELSE 'error' END AS status, value AS time FROM events)",
    "captions": "captions AS (SELECT concat_ws('-', conv_id, turn) AS id, CASE turn % 4 WHEN 0 THEN head || 'Description:' || chr(10) || text WHEN 1 THEN head || 'assistant' || chr(10) || text WHEN 2 THEN head || '  DESCRIPTION: same line' || chr(10) || 'assistant' || chr(10) || text || chr(10) || chr(10) || 'description again' || chr(10) || 'last ' ELSE head || 'Description:' || chr(10) || 'assistant' || chr(10) || '  ' || text || chr(10) END AS caption FROM (SELECT *, 'Video: v' || conv_id || chr(10) || 'Action Class: walk' || chr(10) || 'Timestamp: now' || chr(10) || chr(10) AS head FROM conversations))",
}
_NEEDS = {"joints": ["frames"], "boxes": ["frames", "joints"]}


def sql(body: str, *names: str, zoom: float = 1.0) -> str:
    """`body` after a WITH of the named views and what they need; `body` may start with more of them and a comma."""
    order = dict.fromkeys(x for n in names for x in [*_NEEDS.get(n, []), n])
    ctes = ",\n".join(_SQL[n] for n in order).replace("ELSE 1.0 END::DOUBLE AS amp", f"ELSE {zoom} END::DOUBLE AS amp")
    return f"WITH {ctes}" + (",\n" if body.lstrip().startswith("+") else "\n") + body.lstrip().removeprefix("+")
