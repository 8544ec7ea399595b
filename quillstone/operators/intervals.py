"""Intervals: merging, overlap, containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged(df: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """key, start, end of the unions of overlapping or touching intervals of a key; one without a start goes to the last union."""
    order = Window.partitionBy(key).orderBy(F.col(start).asc_nulls_last(), F.col(end).asc_nulls_last())
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = (before.isNull() | (F.col(start) > before)).cast("int")
    islands = df.withColumn("_new", new).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def merge_array(ranges: Column) -> Column:
    """The same for an array of (start, end) structs in one row."""
    last = lambda a: F.element_at(a, -1)
    joined = lambda a, r: F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], r["end"]).alias("end"))))
    return F.aggregate(
        F.array_sort(ranges),
        F.slice(ranges, 1, 0),
        lambda a, r: F.when((F.size(a) > 0) & (r["start"] <= F.try_element_at(a, F.lit(-1))["end"]), joined(a, r)).otherwise(F.concat(a, F.array(r))),
    )


def overlapping(left: DataFrame, right: DataFrame, key: str, bucket: int = 1_440) -> DataFrame:
    """Pairs of a key whose half-open intervals overlap; left: start, end; right: r_start, r_end.

    Intervals meet in every stretch of length bucket that they touch, so a key's pairs are split over its time; a pair
    counts where its later start lies.
    """
    at = lambda x: F.floor(x / bucket)
    touched = lambda a, b: F.explode(F.sequence(at(F.col(a)), at(F.greatest(F.col(a), F.col(b) - 1))))
    pairs = left.withColumn("_at", touched("start", "end")).join(right.withColumn("_at", touched("r_start", "r_end")), [key, "_at"])
    return pairs.where("start < r_end AND end > r_start").where(F.col("_at") == at(F.greatest("start", "r_start"))).drop("_at")
