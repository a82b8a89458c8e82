"""Index windows over sequences: resampling, fixed, overlapping and training windows, rolling baselines.

Windows are rows from explode(sequence(...)) over (clip, n), so that frames meet their
windows by equi-joins; a range join would become a nested loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upto(n: Column) -> Column:
    """0 .. n - 1; none for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))


def stretched(i: Column, length: Column, target: int) -> Column:
    """floor(linspace(0, length - 1, target))[i]: multiples of the step, and the last value itself."""
    if target == 1:
        return F.lit(0).cast("long")
    return F.when(i == target - 1, length - 1).otherwise(F.floor(i * ((length - 1) / F.lit(float(target - 1))))).cast("long")


def resampled(lengths: DataFrame, target: int) -> DataFrame:
    """clip, i, src: evenly spread indices without the end."""
    rows = lengths.select("clip", "n", F.explode(upto(F.lit(target))).alias("i"))
    return rows.select("clip", "i", F.least(F.floor(F.col("i") * (F.col("n") / F.lit(float(target)))), F.col("n") - 1).cast("long").alias("src"))


def fixed(lengths: DataFrame, target: int) -> DataFrame:
    """clip, w, start, length of windows that follow one another."""
    rows = lengths.select("clip", "n", F.explode(upto(F.ceil(F.col("n") / target))).alias("w"))
    return rows.select("clip", "w", (F.col("w") * target).alias("start"), F.least(F.lit(target), F.col("n") - F.col("w") * target).cast("long").alias("length"))


def overlapping(lengths: DataFrame, target: int, hop: int | None = None, more: Sequence[str] = ()) -> DataFrame:
    """clip, w, start, length, `more`: full windows every `hop`, and a tail of what is left from the next start on."""
    hop = hop or target // 2
    rows = lengths.where("n > 0").select("clip", "n", *more, F.explode(upto(overlaps(F.col("n"), target, hop))).alias("w"))
    return rows.select("clip", "w", (F.col("w") * hop).alias("start"), F.least(F.lit(target), F.col("n") - F.col("w") * hop).cast("long").alias("length"), *more)


def overlaps(n: Column, target: int, hop: int) -> Column:
    """How many windows overlapping() cuts from n frames."""
    full = F.when(n <= target, 0).otherwise(F.floor((n - target) / hop) + 1)
    return F.when(n <= target, 1).otherwise(full + (full * hop < n).cast("long"))


def positions(wins: DataFrame, target: int, even: bool = False) -> DataFrame:
    """clip, w, pos, src; windows shorter than the target are stretched (or, if `even`, resampled without the end)."""
    rows = wins.select("*", F.explode(upto(F.lit(target))).alias("pos"))
    short = F.least(F.floor(F.col("pos") * (F.col("length") / F.lit(float(target)))), F.col("length") - 1) if even else stretched(F.col("pos"), F.col("length"), target)
    return rows.select("clip", "w", "pos", (F.col("start") + F.when(F.col("length") == target, F.col("pos")).otherwise(short)).cast("long").alias("src"))


def first_occurrences(pos: DataFrame) -> DataFrame:
    """clip, w, src and the first position that holds it."""
    return pos.groupBy("clip", "w", "src").agg(F.min("pos").alias("pos"))


def overlap_average(predictions: DataFrame, lengths: DataFrame, value: str = "v") -> DataFrame:
    """Mean over all windows and repeats of each source frame; frames without any are 0. predictions: clip, src, value."""
    mean = predictions.groupBy("clip", F.col("src").alias("frame")).agg(F.avg(value).alias("v"))
    spine = lengths.select("clip", F.explode(upto(F.col("n"))).alias("frame"))
    return spine.join(mean, ["clip", "frame"], "left").select("clip", "frame", F.coalesce("v", F.lit(0.0)).alias("v"))


def training(lengths: DataFrame, horizon: int = 16, history: int = 4, stride: int = 16) -> DataFrame:
    """clip, start: from `history` on, with `horizon` frames left."""
    start = F.when(F.col("n") - horizon >= history, F.sequence(F.lit(history).cast("long"), F.col("n") - horizon, F.lit(stride).cast("long")))
    return lengths.select("clip", F.explode(start).alias("start"))


def candidates(lengths: DataFrame, horizon: int = 16, stride: int = 4) -> DataFrame:
    """clip, start: the last possible start is not one of them."""
    start = F.when(F.col("n") - horizon >= 1, F.sequence(F.lit(0).cast("long"), F.col("n") - horizon - 1, F.lit(stride).cast("long")))
    return lengths.select("clip", F.explode(start).alias("start"))


def padded(values: Column, size: int) -> Column:
    """An array cut or filled up with its last value to `size`."""
    return F.slice(F.concat(values, F.array_repeat(F.element_at(values, -1), F.lit(size))), 1, size)


def sampled_frames(lengths: DataFrame, source: float, target: float) -> DataFrame:
    """clip, k, frame: every source / target frames by adding the interval again and again, as rounding then falls the same."""
    if target >= source:
        return lengths.select("clip", F.explode(upto(F.col("n"))).alias("k")).select("clip", "k", F.col("k").alias("frame"))
    interval = source / target
    most = F.ceil(F.col("n") / F.lit(interval)).cast("long") + 1
    zero = F.struct(F.lit(0.0).alias("at"), F.array().cast("array<double>").alias("all"))
    sums = F.aggregate(F.sequence(F.lit(1).cast("long"), most), zero, lambda s, _: F.struct((s["at"] + interval).alias("at"), F.array_append(s["all"], s["at"]).alias("all")))["all"]
    return lengths.where("n > 0").select("clip", "n", F.posexplode(sums).alias("k", "at")).where("at < n").select("clip", F.col("k").cast("long").alias("k"), F.floor("at").alias("frame"))


def uniform(lengths: DataFrame, count: int) -> DataFrame:
    """clip, k, frame: `count` frames spread from the first to the last; all frames where there are no more."""
    few = F.col("n") <= count
    rows = lengths.select("clip", "n", F.explode(upto(F.when(few, F.col("n")).otherwise(count))).alias("k"))
    return rows.select("clip", "k", F.when(few, F.col("k")).otherwise(stretched(F.col("k"), F.col("n"), count)).alias("frame"))


def nearest_fill(df: DataFrame, column: str) -> DataFrame:
    """Null values from the nearest frame that has one; the earlier of two."""
    back = Window.partitionBy("clip").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    on = Window.partitionBy("clip").orderBy("frame").rowsBetween(0, Window.unboundedFollowing)
    has = F.when(F.col(column).isNotNull(), F.col("frame"))
    marked = df.select("clip", "frame", column, *(f(c, ignorenulls=True).over(w).alias(n) for f, c, w, n in ((F.last, has, back, "pf"), (F.last, F.col(column), back, "pv"), (F.first, has, on, "nf"), (F.first, F.col(column), on, "nv"))))
    early = F.col("nf").isNull() | (F.col("frame") - F.col("pf") <= F.col("nf") - F.col("frame"))
    return marked.select("clip", "frame", F.when(early, F.col("pv")).otherwise(F.col("nv")).alias(column))


def rolling(df: DataFrame, step: int, value: str = "signal") -> DataFrame:
    """clip, frame, value, static and linear predictions from the last multiple of `step`."""
    order = Window.partitionBy("clip").orderBy("frame")
    with_before = df.select("clip", "frame", value, F.lag(value).over(order).alias("before"))
    block = Window.partitionBy("clip", F.floor(F.col("frame") / step)).orderBy("frame")
    first = lambda c: F.first(c).over(block)
    speed = F.coalesce(first(F.col(value) - F.col("before")), F.lit(0.0))
    return with_before.select("clip", "frame", value, first(F.col(value)).alias("static"), (first(F.col(value)) + speed * (F.col("frame") % step)).alias("linear"))


def boundaries(df: DataFrame, step: int, value: str = "signal", drift: float = 0.1) -> DataFrame:
    """clip, frame, value, model: the row takes the stub model's prediction made at its boundary, by an equi-join."""
    made = df.where(F.col("frame") % step == 0).select("clip", F.col("frame").alias("b"), F.col(value).alias("at_b"))
    keyed = df.withColumn("b", F.floor(F.col("frame") / step) * step)
    return keyed.join(made, ["clip", "b"]).select("clip", "frame", value, (F.col("at_b") + drift * (F.col("frame") - F.col("b"))).alias("model"))


def before(df: DataFrame, key: str, columns: list[str], span: int = 1 << 12) -> DataFrame:
    """Adds before_<column>: the column's sum over smaller keys, which are distinct numbers.

    Sums of key ranges are summed up first (the only step in one task, over one row for each
    range), then the keys inside each range.
    """
    own = df.withColumn("__range", F.floor(F.col(key) / span))
    every = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = own.groupBy("__range").agg(*(F.sum(c).alias(c) for c in columns))
    ranges = ranges.select("__range", *(F.coalesce(F.sum(c).over(every), F.lit(0)).alias(f"__{c}") for c in columns))
    inside = Window.partitionBy("__range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    added = own.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in columns}).join(ranges, "__range")
    return added.select(*df.columns, *((F.col(f"before_{c}") + F.col(f"__{c}")).alias(f"before_{c}") for c in columns))


def ranked(df: DataFrame, key: str, span: int = 1 << 16) -> DataFrame:
    """Adds `rank`, the 0-based global rank by a numeric key: ranks inside ranges of the key plus the counts before them."""
    marked = df.withColumn("__block", F.floor(F.col(key) / span))
    counts = before(marked.groupBy("__block").agg(F.count(F.lit(1)).alias("n")), "__block", ["n"]).select("__block", "before_n")
    inside = marked.withColumn("__r", F.row_number().over(Window.partitionBy("__block").orderBy(key)))
    return inside.join(counts, "__block").withColumn("rank", (F.col("before_n") + F.col("__r") - 1).cast("long")).drop("__block", "__r", "before_n")
