"""Exact quantiles by refined histograms: no task ever holds a group's values.

A sought rank lies in a range of values, at first from the group's minimum to its maximum.
Each round counts the values of a range in equal bins, with the least and greatest value
of each bin; the bin that holds the rank is the next range, and the rows below it are
counted off. A range of one value is the answer. Counts combine before their shuffle, so
what moves is at most `bins` rows for each task and range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import stored

BINS = 4096


def _meet(left: DataFrame, right: DataFrame, names: list[str], more: Column | None = None) -> DataFrame:
    """Rows of both that agree in `names`, nulls too; the columns of `left` and what else `right` has."""
    other = right.withColumnsRenamed({n: f"right_{n}" for n in names})
    same = reduce(lambda a, b: a & b, (F.col(n).eqNullSafe(F.col(f"right_{n}")) for n in names))
    return left.join(other, same if more is None else same & more).drop(*(f"right_{n}" for n in names))


def _scaled(v: Column, by_size: bool) -> Column:
    """Rising with v: halves, as a difference may leave the doubles, or the logarithm of a value's size with its sign."""
    return F.signum(v) * (F.ln(F.abs(v)) + 800) if by_size else v / 2


def _bin(v: Column, lo: Column, hi: Column, bins: int, by_size: bool) -> Column:
    """Equal bins of the values or, in turn, of their sizes, so that no spread of values takes many rounds. Ends have bins of their own, so that every round narrows a range."""
    x, a, b = (F.coalesce(_scaled(c, by_size), F.lit(0.0)) for c in (v, lo, hi))
    place = F.floor((x - a) / F.nullif(b - a, F.lit(0.0)) * (bins - 2)) + 1
    return F.when(v == lo, 0).when(v == hi, bins - 1).otherwise(F.coalesce(F.least(F.greatest(place, F.lit(1)), F.lit(bins - 2)), F.lit(1)))


def quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float], bins: int = BINS) -> DataFrame:
    """keys and one column for each quantile in `wanted`, interpolated between its two neighbours.

    Null, NaN and infinite values are left out; a group without others has no row, and so has an empty table. Null keys
    are a group. `df` is computed once and stored, narrow; each round is one pass over that.
    """
    own = [f"key{k}" for k in range(len(keys))] or ["key"]
    named = [F.col(k).alias(o) for k, o in zip(keys, own)] or [F.lit(0).alias("key")]
    data = stored(df.select(*named, F.col(value).cast("double").alias("v")).where("v - v = 0"))
    size = data.groupBy(*own).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = lambda q: F.lit(float(q)) * (F.col("n") - 1)
    sought = []
    for name, q in wanted.items():
        low, part = F.floor(at(q)), at(q) - F.floor(at(q))
        sought += [F.struct(F.lit(name).alias("name"), low.alias("k"), (1 - part).alias("weight")), F.struct(F.lit(name).alias("name"), F.ceil(at(q)).alias("k"), part.alias("weight"))]
    targets = stored(size.select(*own, "lo", "hi", F.explode(F.array(*sought)).alias("t")).select(*own, "lo", "hi", "t.name", "t.k", "t.weight"))
    state = stored(targets.select(*own, "k", "lo", "hi").distinct().withColumn("before", F.lit(0).cast("long")))
    small = F.broadcast if not keys else (lambda x: x)  # without keys there are two rows for each quantile at most
    by_size = False
    while not (wide := state.where("lo < hi")).isEmpty():
        inside = _meet(data, small(wide.select(*own, "lo", "hi").distinct()), own, F.col("v").between(F.col("lo"), F.col("hi")))
        counted = inside.groupBy(*own, "lo", "hi", _bin(F.col("v"), F.col("lo"), F.col("hi"), bins, by_size).alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        under = Window.partitionBy(*own, "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        counted = counted.withColumn("below", F.coalesce(F.sum("c").over(under), F.lit(0)))
        rank = F.col("k") - F.col("before")
        narrower = _meet(wide, counted, [*own, "lo", "hi"], (rank >= F.col("below")) & (rank < F.col("below") + F.col("c")))
        narrower = narrower.select(*own, "k", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("before") + F.col("below")).alias("before"))
        state = stored(narrower.unionByName(state.where("lo >= hi")))
        by_size = not by_size
    found = _meet(targets.select(*own, "name", "k", "weight"), small(state.select(*own, "k", "lo")), [*own, "k"]).select(*own, "name", (F.col("weight") * F.col("lo")).alias("x"))
    out = found.groupBy(*own).agg(*(F.sum(F.when(F.col("name") == n, F.col("x"))).alias(n) for n in wanted))
    return out.select(*(F.col(o).alias(k) for k, o in zip(keys, own)), *wanted)
