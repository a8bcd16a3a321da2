"""Continuous periods and gaps of interval sets (ranked starts against ranked ends).

Sort the starts and the ends of an entity independently. With n intervals, a gap lies behind
rank i exactly where start[i+1] > end[i]: then i intervals have begun and all i have ended. The
boundaries between gaps, paired, are the continuous periods; touching intervals are one period.

Ranks are computed without sorting one entity in one task: every entity's time range is divided
into slices of about ``slice_rows`` boundaries, rows are numbered inside a slice, and the counts of
the earlier slices are added. Only the slice counts, not the rows, meet in a per-entity window.

Defined results: a null entity or bound, a NaN or infinite bound and an interval whose end is not
after its start (after rounding) take no part; repeated rows change nothing; empty input gives
empty output; further input columns are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_ROWS = 50_000


def clean_intervals(df: DataFrame, entity: str, start: str, end: str, scale: int = 1000) -> DataFrame:
    """Distinct (e, s, t) with bounds in whole units of 1/scale; of equal starts only the last end.

    Dropping the shorter of two intervals that start together never changes the union, and it
    bounds an entity's rows by the number of distinct starts.
    """
    s, t = (F.col(c).cast("double") for c in (start, end))
    finite: Column = ~F.isnan(s) & ~F.isnan(t) & (F.abs(s) < 1e15) & (F.abs(t) < 1e15)
    rows = df.where(F.col(entity).isNotNull() & s.isNotNull() & t.isNotNull() & finite).select(
        F.col(entity).alias("e"),
        F.round(s * scale).cast("bigint").alias("s"),
        F.round(t * scale).cast("bigint").alias("t"),
    )
    return rows.where("t > s").groupBy("e", "s").agg(F.max("t").alias("t"))


def _points(bounds: DataFrame) -> DataFrame:
    """(e, s, t) -> (e, kind, at): starts are kind 0, ends kind 1."""
    return bounds.select("e", F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), F.col("s").alias("at")),
        F.struct(F.lit(1).alias("kind"), F.col("t").alias("at")))).alias("p")).select("e", "p.kind", "p.at")


def _sliced(points: DataFrame, keys: list[str], name: str, slice_rows: int) -> DataFrame:
    """The points with ``name``, their slice of equal width within the group, about ``slice_rows`` for a slice."""
    spread = points.groupBy(*keys).agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count("*").alias("n"))
    width = F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo") + 1) * F.lit(slice_rows) / F.col("n"))).cast("bigint")
    return points.join(spread.select(*keys, "lo", width.alias("w")), keys).select(
        *points.columns, F.floor((F.col("at") - F.col("lo")) / F.col("w")).alias(name))


def _ranked(points: DataFrame, slice_rows: int) -> DataFrame:
    """points(e, kind, at) -> (e, r, s, t): the r-th start and the r-th end of every entity.

    Slices are cut in slices again, so boundaries that crowd into a short time don't share one.
    """
    sliced = _sliced(_sliced(points, ["e"], "b", slice_rows), ["e", "b"], "c", slice_rows)
    counts = sliced.groupBy("e", "kind", "b", "c").agg(F.count("*").alias("held"))
    before = Window.partitionBy("e", "kind").orderBy("b", "c").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("e", "kind", "b", "c", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("off"))
    inside = Window.partitionBy("e", "kind", "b", "c").orderBy("at")
    numbered = sliced.withColumn("i", F.row_number().over(inside)).join(offsets, ["e", "kind", "b", "c"])
    return (
        numbered.groupBy("e", (F.col("i") + F.col("off")).alias("r"))
        .agg(F.max(F.when(F.col("kind") == 0, F.col("at"))).alias("s"),
             F.max(F.when(F.col("kind") == 1, F.col("at"))).alias("t"))
    )


def gaps(df: DataFrame, entity: str, start: str, end: str, scale: int = 1000,
         slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(e, gap_start, gap_end) between successive continuous periods."""
    ranked = _ranked(_points(clean_intervals(df, entity, start, end, scale)), slice_rows)
    ends = ranked.select("e", (F.col("r") + 1).alias("r"), F.col("t").alias("gap_start"))
    return (
        ranked.select("e", "r", F.col("s").alias("gap_end"))
        .join(ends, ["e", "r"])
        .where("gap_end > gap_start")
        .select("e", "gap_start", "gap_end")
    )


def periods(df: DataFrame, entity: str, start: str, end: str, scale: int = 1000,
            slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(e, period_start, period_end): the continuous periods, paired from the gap boundaries."""
    bounds = clean_intervals(df, entity, start, end, scale)
    found = gaps(df, entity, start, end, scale, slice_rows)
    hull = bounds.groupBy("e").agg(F.min("s").alias("lo"), F.max("t").alias("hi"))
    starts = hull.select("e", F.col("lo").alias("at"), F.lit(0).alias("kind")).unionByName(
        found.select("e", F.col("gap_end").alias("at"), F.lit(0).alias("kind")))
    ends = hull.select("e", F.col("hi").alias("at"), F.lit(1).alias("kind")).unionByName(
        found.select("e", F.col("gap_start").alias("at"), F.lit(1).alias("kind")))
    # Periods are disjoint, so their i-th start belongs to their i-th end.
    return _ranked(starts.unionByName(ends).select("e", "kind", "at"), slice_rows).select(
        "e", F.col("s").alias("period_start"), F.col("t").alias("period_end")
    )
