"""Composed operators, text rules and sinks against plain Python."""

import json
import os
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from strider.functions import text
from strider.operators import models, quality
from strider.plans import catalog, compose, views
from strider.sources import files


def test_wrapping_equals_the_library(spark):
    words = ["a", "word", "longer", "x" * 30, "y" * 66, "z"]
    rows = [" ".join(words[(k * j) % 6] for j in range(k)) for k in range(40)]
    got = spark.createDataFrame([(r,) for r in rows], "t string").select(text.wrapped(F.col("t")).alias("w")).collect()
    assert [r.w for r in got] == ["\n".join(textwrap.wrap(r, 70, initial_indent="    ", subsequent_indent="    ")) for r in rows]


def test_percent_rounds_halves_to_even(spark):
    df = spark.createDataFrame([(s, 200) for s in range(4, 200)], "s long, n long")
    got = [r.i for r in df.select(text.instruction(F.lit("c"), F.lit("b"), F.col("s"), F.col("n")).alias("i")).collect()]
    assert got == [f"Task: c. Instruction: b Progress: {s / 10:.1f}s/20.0s ({s / 200 * 100:.0f}%) Based on the current body position in these frames, predict the precise movements for the next 1.6 seconds." for s in range(4, 200)]
    none = spark.range(1).select(text.instruction(F.lit("running"), F.lit(None).cast("string"), F.lit(0), F.lit(10)).alias("i")).first().i
    assert none.startswith("A person performing running Progress: 0.0s/1.0s (0%)")


def test_segments_keep_the_format_rules(spark):
    good = json.dumps([{"frames": [3, 9], "description": '"quoted, \\"inside\\""', "confidence": 0.5}, {"frames": [1], "description": "b", "confidence": 0.2}, {"frames": [1, 2], "description": "c", "confidence": 1.2}])
    df = spark.createDataFrame([(1, good), (2, "[]"), (3, "no json"), (4, None)], "id long, js string")
    got = text.segments(df, "js").orderBy("id", "seg").collect()
    assert [(r.id, r.seg, r.first, r.last, r.valid) for r in got] == [(1, 1, 3, 9, True), (1, 2, 1, 1, False), (1, 3, 1, 2, False)]


def test_probe_meta(spark):
    rows = [('{"width":640,"height":480,"r_frame_rate":"30000/1001","nb_frames":"77"}', (640, 480, 30000 / 1001, 77)), ('{"width":1,"height":2,"r_frame_rate":"25/0","duration":"2.5"}', (1, 2, 30.0, 75)), ('{"width":1,"height":2,"r_frame_rate":"24","duration":"2"}', (1, 2, 24.0, 48)), ('{"width":1,"height":2}', (1, 2, 30.0, 0))]
    got = spark.createDataFrame([(r,) for r, _ in rows], "j string").select(text.probe_meta(F.col("j")).alias("m")).collect()
    assert [tuple(r.m) for r in got] == [w for _, w in rows]


def test_switches_and_scenes_of_the_classifier(spark):
    """Issues in order; more than five switches, and more than a twentieth of the boxes, stand for the tracking check."""
    joints = spark.createDataFrame([(c, f, j, 100.0 + 9 * f + j, 100.0 + j, None) for c in range(4) for f in range(30) for j in range(17)], "clip long, frame long, j long, x double, y double, conf double")
    boxes = spark.createDataFrame([(c, f, *((0.0,) * 4 if c == 3 else (0.0, 0.0, 9.0, 9.0))) for c in range(4) for f in range(30)], "clip long, frame long, x1 double, y1 double, x2 double, y2 double")
    cuts = spark.createDataFrame([(1, [4, 8, 15, 16]), (2, [])], "clip long, cut_frames array<long>")
    switches = spark.createDataFrame([(2, list(range(6))), (3, list(range(5)))], "clip long, switch_frames array<long>")
    clips = spark.createDataFrame([(c,) for c in range(5)], "clip long")
    got = {r.clip: (r.issues, r.status) for r in quality.classify(joints, boxes, cuts, switches, clips).collect()}
    assert got == {
        0: ([], "VALID"), 1: (["HARD_CUTS_DETECTED", "SCENE_TRANSITIONS_AT_FRAMES_[4, 8, 15]"], "PARTIAL"), 2: (["HARD_CUTS_DETECTED", "EXCESSIVE_TRACKING_SWITCHES_6_FRAMES"], "PARTIAL"),
        3: (["TRACKING_BREAKS_100%"], "INVALID"), 4: (["TOO_SHORT_0_frames", "NO_KEYPOINTS", "TOO_SHORT_FOR_MOTION_CHECK"], "INVALID"),
    }
    assert {r.clip: r.status for r in quality.legacy(joints).collect()} == {c: "INVALID" for c in range(4)}


@pytest.mark.parametrize("compat", [False, True])
def test_batches_are_aligned_like_single_poses(compat):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(2, 20, 17, 3))
    a[3] = 1.0
    one = np.stack([models.align_3d(x, y, compat) for x, y in zip(a, b)])
    assert np.allclose(models.align_3d(a, b, compat), one) and np.allclose(one[3], a[3])


def test_exported_blobs_come_back(spark, sf_dir, tmp_path):
    """Through the shard writer: the blobs hold as many numbers as the clip's frames and the column's shape ask for."""
    rows = catalog.QUERIES["export_row"](spark, sf_dir)
    files.write_shards(rows, f"{tmp_path}/shards", ["clip_id"], bytes_each=1 << 16)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert len(back.columns) == 20
    shapes = {"pose3d": 51, "keypoints2d": 34, "scores2d": 17, "bboxes": 4, "joint_angles": 44, "frame_indices": 1, "tracking_confidence": 1}
    got = back.select("clip_id", "num_pose_frames", *(files.unzipped(F.col(c)).alias(c) for c in shapes)).collect()
    assert len(got) == rows.count() and all(len(r[c]) == 4 * k * r.num_pose_frames for r in got for c, k in shapes.items())
    poses = {}
    for r in views.poses(spark, sf_dir).orderBy("clip", "frame").collect():
        poses.setdefault(f"yt_{r.clip}", []).extend(r.pose)
    for r in got:
        assert np.allclose(np.frombuffer(r.pose3d, "<f4"), poses[r.clip_id.rsplit("_", 2)[0]], atol=1e-6)
        assert np.frombuffer(r.frame_indices, "<i4").tolist() == list(range(r.num_pose_frames))


def test_samples_hold_windows_states_and_images(spark, sf_dir):
    poses = views.poses(spark, sf_dir).withColumn("src", 3 * F.col("frame"))
    n = poses.groupBy("clip").agg(F.count(F.lit(1)).alias("n"))
    captions = n.select("clip", F.lit("c").alias("class"), F.lit("left").alias("body"))
    got = compose.training_samples(poses, n, captions, horizon=4, history=3, stride=2).collect()
    want = {(r.clip, s) for r in n.collect() for s in range(3, r.n - 3, 2)}
    assert {(r.clip, r.start) for r in got} == want and len(got) == 2 * len(want)
    for r in got:
        assert len(r.actions) == 4 and all(len(v) == 44 for v in r.actions) and r.state == r.actions[0]
        assert r.images == [3 * (r.start - 3), 3 * (r.start - 2), 3 * (r.start - 1)]
        assert r.instruction.startswith("Task: c. Instruction: right" if r.flipped else "Task: c. Instruction: left")


def test_clip_and_report_sinks(spark, sf_dir, tmp_path):
    files.write_clips(catalog.QUERIES["export_columns"](spark, sf_dir), f"{tmp_path}/clips")
    assert all(d.startswith("action_class=") for d in os.listdir(f"{tmp_path}/clips") if not d.startswith((".", "_")))
    rows = spark.createDataFrame([("a", 1), ("b", None)], "name string, n long")
    files.write_report(rows, f"{tmp_path}/report", "Clips")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/report/json").collect()) == ['{"name":"a","n":1}', '{"name":"b"}']
    text_ = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/report/markdown").collect())
    assert text_ == "# Clips\n\n| name | n |\n|-|-|\n| a | 1 |\n| b |  |"
