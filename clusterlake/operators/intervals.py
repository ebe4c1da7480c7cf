"""Joins of intervals: those that overlap, or lie within one another, without meeting all of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Each level's bins are this many times as wide as those of the level below, whose width is LEAST.
STEP, LEAST, LEVELS = 4, 64, 16


def _level(length: Column) -> Column:
    """The lowest level whose bins are no shorter than the interval, so that it lies in two of them at most."""
    return F.least(F.lit(LEVELS - 1), F.greatest(F.lit(0), F.ceil(F.log(F.greatest(length, F.lit(1)).cast("double") / LEAST) / F.log(F.lit(float(STEP)))))).cast("int")


def _width(level: Column) -> Column:
    return (F.lit(LEAST) * F.pow(F.lit(float(STEP)), level)).cast("long")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], start: str = "start", stop: str = "stop", least: int = 1) -> DataFrame:
    """Rows of left and right of one key whose intervals [start, stop) share at least so many positions: left's columns, and right's with _r behind those that aren't keys.

    Levels of bins grow by STEP; an interval is at home on the lowest level whose bins are no shorter than itself. A pair meets on the higher
    of both homes: the longer one in the two bins at most that it lies in, the shorter in the one or two that it reaches there. So a row meets
    only those near it, by its own length, and not all of its key. Levels that no interval of the other side has as home are left out.
    A pair that meets in two bins is kept in the first that both have. Intervals that are empty or null meet none.
    """
    def homes(df: DataFrame, name: str) -> DataFrame:
        some = df.where((F.col(start) < F.col(stop)) & F.col(start).isNotNull() & F.col(stop).isNotNull())
        for k in keys:
            some = some.where(F.col(k).isNotNull())
        return some.select(*(F.col(k) for k in keys), F.struct(*df.columns).alias(name), F.col(start).cast("long").alias(f"{name}_a"), F.col(stop).cast("long").alias(f"{name}_b")).withColumn(f"{name}_home", _level(F.col(f"{name}_b") - F.col(f"{name}_a")))

    def binned(df: DataFrame, name: str, levels: Column) -> DataFrame:
        at = df.withColumn("level", F.explode(levels))
        w = _width(F.col("level"))
        first, last = F.floor(F.col(f"{name}_a") / w), F.floor((F.col(f"{name}_b") - 1) / w)
        return at.withColumn(f"{name}_first", first).withColumn("bin", F.explode(F.sequence(first, last)))

    x, y = homes(left, "x"), homes(right, "y")
    used = lambda df, name: sorted(r[0] for r in df.select(f"{name}_home").distinct().collect())  # noqa: E731  # LEVELS at most
    above = lambda name, levels, strict: F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda v: v > F.col(f"{name}_home") if strict else v >= F.col(f"{name}_home"))
    own = lambda name: F.array(F.col(f"{name}_home"))
    on = [*keys, "level", "bin"]
    longer_x = binned(x, "x", own("x")).join(binned(y, "y", above("y", used(x, "x"), False)), on)
    longer_y = binned(x, "x", above("x", used(y, "y"), True)).join(binned(y, "y", own("y")), on)
    shared = F.least("x_b", "y_b") - F.greatest("x_a", "y_a")
    met = longer_x.unionByName(longer_y).where((F.col("bin") == F.greatest("x_first", "y_first")) & (shared >= least))
    return met.select(*(F.col(f"x.{c}").alias(c) for c in left.columns), *(F.col(f"y.{c}").alias(f"{c}_r") for c in right.columns if c not in keys))


def contained(inner: DataFrame, outer: DataFrame, keys: list[str], start: str = "start", stop: str = "stop") -> DataFrame:
    """Rows of inner and outer of one key where the interval of inner lies within that of outer; columns as those of overlapping()."""
    return overlapping(inner, outer, keys, start, stop).where((F.col(start) >= F.col(f"{start}_r")) & (F.col(stop) <= F.col(f"{stop}_r")))
