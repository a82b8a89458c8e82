"""Skeleton texts by a table function: the file's row stays beside its frames, and each frame gives its best body."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


@udtf(returnType="frame long, body long, joint long, x double, y double, z double, state long, error string")
class SkeletonRows:
    """Rows of one text: the number of frames; for each the number of bodies; for each body a line about it, the number
    of joints, and a line for each, x y z first and the tracking state last. A text that breaks off or holds something
    else gives what came before and one row with `error`."""

    def eval(self, text: str) -> Iterator[tuple]:
        lines = iter((text or "").split("\n"))
        count = lambda: int(next(lines).strip())
        if not (text or "").strip():
            return
        try:
            for frame in range(count()):
                for body in range(count()):
                    next(lines)
                    for joint in range(count()):
                        x, y, z, *rest = next(lines).split()
                        yield frame, body, joint, float(x), float(y), float(z), int(rest[-1]), None
        except (ValueError, IndexError, StopIteration) as e:
            yield None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:200]


def skeleton_rows(df: DataFrame, text_col: str = "value") -> DataFrame:
    """Every column of `df` but the text, beside each row of SkeletonRows."""
    keep = [c for c in df.columns if c != text_col]
    return df.lateralJoin(SkeletonRows(F.col(text_col).outer())).select(*keep, "frame", "body", "joint", "x", "y", "z", "state", "error")


def best_bodies(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, frame, source_frame, body, joint, x, y, z of the body with the highest sum of tracking states in each frame, the first of equals.

    Frames without bodies have no rows, and `frame` numbers those that are left from 0. Sums are made before anything
    moves; the numbering sees one row for each frame.
    """
    good = rows.where("error is null")
    sums = good.groupBy(*keys, "frame", "body").agg(F.sum("state").alias("s"))
    best = sums.groupBy(*keys, "frame").agg((-F.max(F.struct("s", (-F.col("body")).alias("b")))["b"]).alias("body"))
    numbered = best.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("frame")).cast("long") - 1)
    return good.join(numbered, [*keys, "frame", "body"]).select(*keys, F.col("place").alias("frame"), F.col("frame").alias("source_frame"), "body", "joint", "x", "y", "z")
