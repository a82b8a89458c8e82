"""Quantiles, ranks, lifting over windows, skeleton texts and the rolling stream on odd rows."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strider.operators import lifting, quantiles, ranks, windows
from strider.sources import skeletons
from strider.streaming import rolling


@pytest.mark.parametrize("bins", [100, 4096])
def test_quantiles_equal_numpy(spark, bins):
    rng = np.random.default_rng(3)
    groups = {1: rng.normal(size=301), 2: np.repeat([2.0, 5.0], 50), 3: np.array([7.0]), None: 10.0 ** rng.integers(-300, 300, 64), 4: np.array([-1.7e308, 1.7e308, 0.0, -0.0]), 5: np.array([5e-324, 0.0, 1e-323])}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [(1, None), (1, float("nan")), (2, float("inf")), (6, None)]
    df = spark.createDataFrame(rows, "g long, v double").repartition(3)
    wanted = {"least": 0.0, "p25": 0.25, "median": 0.5, "p90": 0.9, "most": 1.0}
    got = {r["g"]: r for r in quantiles.quantiles(df, ["g"], "v", wanted, bins=bins).collect()}
    assert set(got) == set(groups)
    for k, x in groups.items():
        s = np.sort(x)
        for n, q in wanted.items():
            at = q * (len(s) - 1)
            lo, part = int(at), at - int(at)
            assert got[k][n] == pytest.approx(s[lo] * (1 - part) + s[min(lo + 1, len(s) - 1)] * part, rel=1e-12)
    one = quantiles.quantiles(df.where("g = 1"), [], "v", {"m": 0.5}, bins=bins).collect()
    assert [r["m"] for r in one] == [pytest.approx(np.median(groups[1]))]
    assert quantiles.quantiles(df.limit(0), [], "v", {"m": 0.5}).count() == 0


def test_index_is_dense_in_text_order(spark):
    words = [None, "", "b", "B", "é", *(f"w{random.Random(k).random()}" for k in range(500)), "b"]
    df = spark.createDataFrame([(k, w) for k, w in enumerate(words)], "id long, word string").repartition(4)
    got = ranks.indexed(df, ["word", "id"], pieces=7).collect()
    order = sorted(got, key=lambda r: (r["word"] is not None, (r["word"] or "").encode(), r["id"]))
    assert [r["index"] for r in order] == list(range(len(words)))
    assert ranks.indexed(df.limit(0), ["word"]).count() == 0


def test_lifting_averages_stretched_and_overlapping_windows(spark):
    rows = [(c, f, [float(10 * c + f), 1.0]) for c, n in ((1, 3), (2, 8), (3, 13), (4, 1)) for f in range(n)]
    df = spark.createDataFrame(rows, "clip long, frame long, pose array<double>")
    seen = []

    def load():
        def model(x):
            assert x.shape[1:] == (8, 2)
            return x + np.arange(8)[None, :, None]

        return model

    got = {(r["clip"], r["frame"], r["k"]): r["v"] for r in lifting.lifted(df, load, 8, 4, width=2).collect()}
    assert len(got) == 2 * len(rows)
    for c, n in ((1, 3), (2, 8), (3, 13), (4, 1)):
        places = {}
        starts = [0] if n <= 8 else [s for s in range(0, n, 4) if s + 8 <= n] + [s for s in [4 * ((n - 8) // 4 + 1)] if s < n]
        for s in starts:
            length = min(8, n - s)
            for i in range(8):
                src = s + (i if length == 8 else length - 1 if i == 7 else int(i * ((length - 1) / 7)))
                places.setdefault(src, []).append(i)
        for f in range(n):
            assert got[c, f, 0] == pytest.approx(10 * c + f + np.mean(places[f])), (c, f)
            seen.append(len(places[f]))
    assert max(seen) > 2


def test_windows_of_a_long_clip_are_cut_from_few_frames(spark):
    """No row that leads to the windows holds more than the frames of a span, however long the clip; windows apart from each other leave frames out."""
    df = spark.range(3000).selectExpr("7L as clip", "id as frame", "array(double(id), 1d) as pose").unionByName(spark.range(5).selectExpr("8L as clip", "id as frame", "array(double(id), 1d) as pose"))
    for hop in (4, 8, 11):
        got = {(r["clip"], r["w"]): (r["src"], r["x"]) for r in lifting.clip_windows(df, 8, hop).collect()}
        pos = windows.positions(windows.overlapping(df.groupBy("clip").agg(F.count(F.lit(1)).alias("n")), 8, hop), 8).orderBy("clip", "w", "pos").collect()
        want = {}
        for r in pos:
            want.setdefault((r["clip"], r["w"]), []).append(r["src"])
        assert {k: v[0] for k, v in got.items()} == want
        assert all(x[::2] == [float(s) for s in src] for src, x in got.values())
    wins = lifting.clip_windows(df, 8, 4)
    gathered = [line for line in wins._jdf.queryExecution().analyzed().toString().splitlines() if "collect_list" in line]
    assert len(gathered) == 1 and all("Aggregate [clip" in line and "span" in line.split("]")[0] for line in gathered)


TEXT = "3\n2\nbody\n2\n1 2 3 0 1\n4 5 6 0 1\nbody\n2\n7 8 9 0 2\n1 1 1 0 0\n0\n1\nbody\n1\n9 9 9 2"


def test_skeleton_rows_keep_their_file_and_the_first_best_body(spark):
    df = spark.createDataFrame([("a", TEXT, 1), ("b", None, 2), ("c", "", 3), ("d", TEXT[:40], 4), ("e", "x", 5), ("a2", TEXT, 6)], "path string, value string, frame_rate int")
    rows = skeletons.skeleton_rows(df)
    assert rows.columns[:2] == ["path", "frame_rate"] and rows.where("path = 'a' and error is null").count() == 5
    assert {r["path"] for r in rows.where("error is not null").collect()} == {"d", "e"}
    best = skeletons.best_bodies(rows, ["path"]).orderBy("path", "frame", "joint").collect()
    assert [tuple(r)[1:] for r in best if r["path"] == "a"] == [(0, 0, 0, 0, 1.0, 2.0, 3.0), (0, 0, 0, 1, 4.0, 5.0, 6.0), (1, 2, 0, 0, 9.0, 9.0, 9.0)]
    assert [tuple(r)[1:] for r in best if r["path"] == "a2"] == [tuple(r)[1:] for r in best if r["path"] == "a"]


SCHEMA = "clip long, frame long, signal double, at timestamp"


def streamed(spark, tmp_path, k, some, step, **more):
    """Add a file of rows and run over what is new."""
    source = tmp_path / "in"
    source.mkdir(exist_ok=True)
    table = pd.DataFrame(some, columns=["clip", "frame", "signal", "at"])
    table.assign(at=pd.to_datetime(table["at"] + 1_000_000, unit="s").astype("datetime64[us]")).to_parquet(source / f"{k}.parquet")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = rolling.run(rolling.rolling(stream, step, **more), str(tmp_path / "checkpoint"), str(tmp_path / "out"))
    assert query.awaitTermination(60)
    assert query.exception() is None
    return spark.read.parquet(str(tmp_path / "out"))


def test_rolling_stream_equals_the_batch_join_after_restarts(spark, tmp_path):
    rng = random.Random(2)
    rows = [(c, f, float(c) + rng.random(), f) for c in range(4) for f in range(20 + c) if (c, f) != (2, 6)]
    rng.shuffle(rows)  # frames come before their boundary, too; clip 2 lacks one
    size, seen = len(rows) // 3 + 1, []
    for k in range(3):
        out = streamed(spark, tmp_path, k, rows[k * size : (k + 1) * size], 3)
        seen.append(out.count())
    got = sorted((r["clip"], r["frame"], round(r["model"], 9)) for r in out.collect())
    batch = windows.boundaries(spark.createDataFrame([r[:3] for r in rows], "clip long, frame long, signal double"), 3)
    assert 0 < seen[0] < seen[1] < seen[2]
    assert got == sorted((r["clip"], r["frame"], round(r["model"], 9)) for r in batch.collect())
    assert not [1 for c, f, _ in got if c == 2 and 6 <= f < 9]


def test_an_idle_clip_is_dropped(spark, tmp_path):
    hour = {"idle_ms": 3_600_000, "late": "1 minute"}
    streamed(spark, tmp_path, 0, [(1, 0, 1.0, 0), (3, 0, 1.0, 9_000)], 4, **hour)
    streamed(spark, tmp_path, 1, [(2, 0, 5.0, 10_000)], 4, **hour)  # the watermark passes the hour of clip 1, not of clip 3
    out = streamed(spark, tmp_path, 2, [(1, 1, 2.0, 10_001), (3, 1, 2.0, 10_001)], 4, **hour)
    assert sorted((r["clip"], r["frame"]) for r in out.collect()) == [(1, 0), (2, 0), (3, 0), (3, 1)]


def test_new_queries_are_whole(spark, sf_dir):
    from strider.plans import catalog

    frames = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    assert catalog.QUERIES["windowed_lift"](spark, sf_dir).count() == 51 * frames
    index = catalog.QUERIES["shuffled_index"](spark, sf_dir)
    assert index.agg(F.max("position") + 1, F.count_distinct("position"), F.count(F.lit(1))).first() == (index.count(),) * 3
