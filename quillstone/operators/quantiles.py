"""Exact medians that no task gathers the values for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Half the share of the rows in which the middle is looked for exactly; well beyond the error of the sketch.
AROUND = 0.001
ACCURACY = 10_000


def medians(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, median: the exact middle value, or the mean of the two; nulls do not count.

    A sketch brackets the middle, one pass counts what lies below, and only the values of the bracket, each with its
    count, are sorted: about AROUND * 2 of the rows at most. Groups are few enough for a row of each to be broadcast.
    """
    rows = df.select(group, value).where(F.col(value).isNotNull())
    cut = F.percentile_approx(value, [0.5 - AROUND, 0.5 + AROUND], ACCURACY)
    ends = rows.groupBy(group).agg(cut.alias("cut"), F.count(F.lit(1)).alias("n")).select(group, F.col("cut")[0].alias("lo"), F.col("cut")[1].alias("hi"), "n")
    near = rows.join(F.broadcast(ends), group)
    below = near.groupBy(group).agg(F.count_if(F.col(value) < F.col("lo")).alias("below"))
    inside = near.where(F.col(value).between(F.col("lo"), F.col("hi"))).groupBy(group, value, "n").agg(F.count(F.lit(1)).alias("c")).join(F.broadcast(below), group)
    upto = F.sum("c").over(Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) + F.col("below")
    placed = inside.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("c"))
    holds = lambda rank: (F.col("before") < rank) & (F.col("upto") >= rank)
    low, high = F.floor((F.col("n") + 1) / 2), F.ceil((F.col("n") + 1) / 2)
    return placed.groupBy(group).agg(((F.max(F.when(holds(low), F.col(value))) + F.max(F.when(holds(high), F.col(value)))) / 2).alias("median"))
