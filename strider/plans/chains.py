"""Queries of longer chains: lifting over windows, skeleton texts, the shuffled sample index."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from ..operators import kinematics as kin
from ..operators import lifting, models, windows
from ..operators.ranks import indexed
from ..operators.stored import shared_folder
from ..sources import shards, skeletons
from . import views
from .catalog import query

TARGET, HOP = 8, 4
_SWAP = dict(zip([*kin.LEFT, *kin.RIGHT], [*kin.RIGHT, *kin.LEFT]))


def _stub():
    """An affine model over windows of poses: each joint has a scale of its own, and a quarter of the window's mean is added. In the flip ensemble, with the root at zero."""
    scale = np.repeat(0.5 + 0.01 * np.arange(17), 3)
    order = np.array([3 * _SWAP.get(j, j) + c for j in range(17) for c in range(3)])
    sign = np.tile([-1.0, 1.0, 1.0], 17)
    model = models.flip_ensemble(lambda x: x * scale + 0.25 * x.mean(1, keepdims=True) + 0.1, lambda x: x[..., order] * sign)

    def centred(x: np.ndarray) -> np.ndarray:
        y = model(x)
        return y - np.tile(y[..., :3], 17)

    return centred


_SCALE = ", ".join(f"({j}, {0.5 + 0.005 * (j + _SWAP.get(j, j))!r}::DOUBLE)" for j in range(17))


@query(
    views.sql(
        f"""+n AS (SELECT clip, count(*) AS n FROM frames GROUP BY clip), f AS (SELECT clip, n, CASE WHEN n <= {TARGET} THEN 0 ELSE floor((n - {TARGET}) / {HOP})::BIGINT + 1 END AS whole FROM n),
wins AS (SELECT clip, w, w * {HOP} AS start, least({TARGET}, n - w * {HOP}) AS length FROM (SELECT clip, n, unnest(range(CASE WHEN n <= {TARGET} THEN 1 ELSE whole + (whole * {HOP} < n)::BIGINT END)) AS w FROM f)),
pos AS (SELECT clip, w, pos, start + CASE WHEN length = {TARGET} THEN pos WHEN pos = {TARGET - 1} THEN length - 1 ELSE floor(pos * ((length - 1) / {TARGET - 1}.0::DOUBLE))::BIGINT END AS src FROM wins, range({TARGET}) t(pos)),
x AS (SELECT pos.clip, w, pos, src, k, k // 3 AS j, e[k + 1] AS x FROM pos JOIN frames ON pos.clip = frames.clip AND src = frame, range(51) u(k)),
y AS (SELECT clip, w, pos, src, k, s * x + 0.25 * avg(x) OVER (PARTITION BY clip, w, k) + CASE WHEN k % 3 = 0 THEN 0 ELSE 0.1 END AS y FROM x JOIN (VALUES {_SCALE}) v(j, s) USING (j)),
z AS (SELECT clip, src, k, y - first(y) OVER (PARTITION BY clip, w, pos, k % 3 ORDER BY k) AS z FROM y)
SELECT clip, src AS frame, k::INTEGER AS k, round(avg(z), 4) + 0.0 AS v FROM z GROUP BY clip, src, k""",
        "frames",
    )
)
def windowed_lift(spark, sf_dir):
    """Poses through a lifting model over overlapping windows, averaged by frame."""
    return lifting.lifted(views.poses(spark, sf_dir), _stub, TARGET, HOP).select("clip", "frame", "k", (F.round("v", 4) + 0.0).alias("v"))


def _texts(spark, sf_dir):
    """clip, value: skeleton texts of two bodies of six joints; every seventh frame is empty."""
    number = lambda c: c.cast("string")
    conf = lambda j: F.least(F.lit(1.0), 4 * F.abs(F.get("e", j + 47)))
    joint = lambda j: F.concat_ws(" ", *(number(F.get("e", j * 3 + k)) for k in range(3)), F.lit("0 0"), number(F.floor(conf(j) * 2 + 0.5)))
    body = lambda b: F.concat_ws("\n", F.lit("0 0 0"), F.lit("6"), F.transform(F.sequence(F.lit(6 * b), F.lit(6 * b + 5)), joint))
    frame = F.when(F.col("frame") % 7 == 3, "0").otherwise(F.concat_ws("\n", F.lit("2"), body(0), body(1)))
    f = views.frames(spark, sf_dir).select("clip", F.struct("frame", frame.alias("lines")).alias("r")).groupBy("clip").agg(F.array_sort(F.collect_list("r")).alias("r"))
    return f.select("clip", F.concat_ws("\n", F.size("r").cast("string"), F.col("r.lines")).alias("value"))


@query(
    views.sql(
        """+b AS (SELECT clip, frame, j // 6 AS body, j % 6 AS joint, px, py, pz, floor(conf * 2 + 0.5) AS state FROM joints WHERE j < 12 AND frame % 7 <> 3),
s AS (SELECT clip, frame, body FROM (SELECT clip, frame, body, sum(state) AS s FROM b GROUP BY clip, frame, body) QUALIFY row_number() OVER (PARTITION BY clip, frame ORDER BY s DESC, body) = 1),
p AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY frame) - 1 AS place FROM s)
SELECT clip, place AS frame, p.frame AS source_frame, body, joint, round(px, 6) + 0.0 AS x, round(py, 6) + 0.0 AS y, round(pz, 6) + 0.0 AS z FROM p JOIN b USING (clip, frame, body)""",
        "joints",
    )
)
def skeleton_bodies(spark, sf_dir):
    """The best body of each frame of skeleton texts."""
    best = skeletons.best_bodies(skeletons.skeleton_rows(_texts(spark, sf_dir)), ["clip"])
    return best.select("clip", "frame", "source_frame", "body", "joint", *((F.round(c, 6) + 0.0).alias(c) for c in ("x", "y", "z")))


@query(
    views.sql(
        """+w AS (SELECT clip, start FROM lengths, unnest(CASE WHEN n - 16 >= 4 THEN range(4, n - 15, 16) END) t(start)),
c AS (SELECT clip, row_number() OVER (ORDER BY 'class_' || clip % 12, lpad(clip::VARCHAR, 6, '0')) - 1 AS clip_idx FROM lengths)
SELECT row_number() OVER (ORDER BY md5('42-' || clip || '-' || start), clip, start) - 1 AS position, clip_idx, clip, start FROM w JOIN c USING (clip)""",
        "lengths",
    )
)
def shuffled_index(spark, sf_dir):
    """The dense index of training samples: clips numbered by class and id, samples in a seeded shuffle."""
    n = views.lengths(spark, sf_dir)
    name = F.concat(F.lit("class_"), (F.col("clip") % 12).cast("string"))
    clips = indexed(n.select("clip", name.alias("class"), F.lpad(F.col("clip").cast("string"), 6, "0").alias("id")), ["class", "id"], "clip_idx")
    key = F.md5(F.concat_ws("-", F.lit("42"), "clip", "start").cast("binary"))
    samples = indexed(windows.training(n).withColumn("key", key), ["key", "clip", "start"], "position")
    return samples.join(clips.select("clip", "clip_idx"), "clip").select("position", "clip_idx", "clip", "start")


@query(
    views.sql(
        """+p AS (SELECT clip, frame, 'class_' || clip % 12 AS class, row_number() OVER (ORDER BY 'class_' || clip % 12, clip, frame) - 1 AS place, count(*) OVER () AS n FROM frames)
SELECT 'train-' || lpad((place // 250)::VARCHAR, 5, '0') || '-of-' || lpad(((n + 249) // 250)::VARCHAR, 5, '0') || '.parquet' AS file, count(*) AS n, min(class) AS first_class, max(class) AS last_class, sum(clip)::BIGINT AS clips, sum(frame)::BIGINT AS frames
FROM p GROUP BY n, place // 250""",
        "frames",
    )
)
def named_shards(spark, sf_dir):
    """Frames written as named shards of 250 rows in order of class and clip, and what is read back from each file."""
    name = F.concat(F.lit("class_"), (F.col("clip") % 12).cast("string"))
    f = views.frames(spark, sf_dir).select(name.alias("class"), "clip", "frame")
    path = f"{shared_folder(spark)}/named-shards-{uuid.uuid4().hex}"
    shards.write_named(f, path, "train", ["class", "clip", "frame"], bytes_each=250, bytes_row=1)
    back = spark.read.schema(f.schema).parquet(path).groupBy(F.col("_metadata.file_name").alias("file"))
    return back.agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("first_class"), F.max("class").alias("last_class"), F.sum("clip").alias("clips"), F.sum("frame").alias("frames"))
