"""Brightness as histograms of 256 bins, and trimmed maxima. Bins are rows, so a histogram is one grouped count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.functions.scalar import clamp, round_away


def binned(rows: DataFrame, by: str, brightness: str) -> DataFrame:
    """(by, bin, n): how many values, 0 to 1, fall into each bin; values outside count in the first or last bin."""
    at = clamp(round_away(F.col(brightness) * 255, 0), 0.0, 255.0).cast("int")
    return rows.filter(F.col(brightness).isNotNull()).groupBy(by, at.alias("bin")).agg(F.count("*").alias("n"))


def cumulated(bins: DataFrame, by: str) -> DataFrame:
    """Bins with the count up to each (`upto`) and the total; a histogram has at most 256 rows."""
    own = Window.partitionBy(by)
    return bins.withColumn("upto", F.sum("n").over(own.orderBy("bin"))).withColumn("total", F.sum("n").over(own))


def percentiles(bins: DataFrame, by: str, shares: dict[str, float]) -> DataFrame:
    """(by, one column for each share): the first filled bin up to which that share of all values lies, not interpolated."""
    first = [(F.min(F.when((F.col("upto") >= min(1.0, max(0.0, p)) * F.col("total")) & (F.col("n") > 0), F.col("bin"))) / 255).alias(c) for c, p in shares.items()]
    return cumulated(bins, by).groupBy(by).agg(*first)


def share_from(bins: DataFrame, by: str, low: float, high: float) -> DataFrame:
    """(by, below, above): shares of values at or below `low`, and at or above `high`."""
    return bins.groupBy(by).agg(
        (F.sum(F.when(F.col("bin") <= F.floor(F.lit(low * 255)), F.col("n")).otherwise(0)) / F.sum("n")).alias("below"),
        (F.sum(F.when(F.col("bin") >= F.ceil(F.lit(high * 255)), F.col("n")).otherwise(0)) / F.sum("n")).alias("above"),
    )


def top_mean(values: Column, share: float) -> Column:
    """The mean of the largest share of an array's values, at least one; 0 of an empty array."""
    size = F.size(values)
    take = F.greatest(F.lit(1), F.least(size, round_away(size * share, 0).cast("int")))
    top = F.slice(F.sort_array(values, asc=False), F.lit(1), take)
    return F.when(size > 0, F.aggregate(top, F.lit(0.0), lambda s, x: s + x) / take).otherwise(0.0)
