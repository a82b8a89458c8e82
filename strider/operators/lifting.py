"""A model over overlapping windows of whole clips, and averages of what it says about each frame."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import models, windows


#: Neighbouring windows whose frames are gathered together.
SPAN = 32


def clip_windows(frames: DataFrame, target: int, hop: int | None = None, column: str = "pose") -> DataFrame:
    """clip, w, src (frames of each position), x (their values, one after another).

    frames: clip, frame (from 0, without gaps), `column` (an array). Clips may be of any length: only the frames of `SPAN`
    neighbouring windows are gathered at once, by one shuffle in which frames at the border of two spans go to both, and
    windows are cut from that array; a window shorter than `target` is stretched.
    """
    hop = hop or target // 2
    rows = frames.select("clip", "frame", F.col(column).alias("x")).join(frames.groupBy("clip").agg(F.count(F.lit(1)).alias("n")), "clip")
    # windows that hold a frame, and the spans that these are in
    first, last = F.greatest(F.ceil((F.col("frame") - (target - 1)) / hop), F.lit(0)), F.least(F.floor(F.col("frame") / hop), windows.overlaps(F.col("n"), target, hop) - 1)
    held = rows.withColumns({"first": first.cast("long"), "last": last.cast("long")}).where("first <= last")
    spans = held.select("clip", "n", "frame", "x", F.explode(F.sequence(F.floor(F.col("first") / SPAN), F.floor(F.col("last") / SPAN))).alias("span"))
    whole = spans.groupBy("clip", "span").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("frame", "x"))).alias("rows"))
    low, most = F.col("span") * SPAN, windows.overlaps(F.col("n"), target, hop) - 1
    # frames between windows that lie apart are not there, so places are counted inside each window
    inside = lambda w: F.filter("rows", lambda r: (r["frame"] >= w * hop) & (r["frame"] < w * hop + target))
    cut = whole.select("clip", F.explode(F.transform(F.sequence(low, F.least(low + SPAN - 1, most)), lambda w: F.struct(w.alias("w"), inside(w).alias("rows")))).alias("win"))
    cut = cut.select("clip", "win.w", F.size("win.rows").cast("long").alias("length"), F.col("win.rows.x").alias("x"))
    at = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(target - 1).cast("long")), lambda i: F.when(F.col("length") == target, i).otherwise(windows.stretched(i, F.col("length"), target)))
    placed = cut.select("clip", "w", "x", at.alias("at"))
    return placed.select("clip", "w", F.transform("at", lambda i: F.col("w") * hop + i).alias("src"), F.flatten(F.transform("at", lambda i: F.get("x", i.cast("int")))).alias("x"))


def over_windows(wins: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]], target: int, width: int) -> DataFrame:
    """clip, src, y: the model's answer for each place of each window. The model takes and gives (windows, target, width)."""

    def flat():
        model = load()
        return lambda x: model(x.reshape(len(x), target, width)).reshape(len(x), target * width)

    said = models.predict(wins, flat, "x", "y").select("clip", "src", "y")
    each = said.select("clip", F.posexplode("src").alias("i", "src"), "y")
    return each.select("clip", "src", F.slice("y", F.col("i") * width + 1, width).alias("y"))


def lifted(frames: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]], target: int, hop: int | None = None, width: int = 51, column: str = "pose") -> DataFrame:
    """clip, frame, k, v: number k of each frame, the mean over all windows and repeats that hold the frame."""
    said = over_windows(clip_windows(frames, target, hop, column), load, target, width)
    # numbers side by side: a row for each frame is moved, not one for each number
    sums = said.groupBy("clip", F.col("src").alias("frame")).agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.get("y", F.lit(k))).alias(f"s{k}") for k in range(width)))
    return sums.select("clip", "frame", F.posexplode(F.array(*(F.col(f"s{k}") / F.col("n") for k in range(width)))).alias("k", "v"))
