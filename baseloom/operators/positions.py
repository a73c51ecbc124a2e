"""Modules by read position: quality, base content, N content."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bins import bin_high, bin_low
from ..functions.scalars import phred

PERCENTS = (10, 25, 50, 75, 90)
DEPTH = 100


def _binned(df: DataFrame) -> DataFrame:
    """df with low and high of each position's bin; the longest position is the file's."""
    longest = F.max("pos").over(Window.partitionBy("file"))
    return df.withColumn("longest", longest).withColumn("low", bin_low(F.col("pos"), F.col("longest"))).withColumn("high", bin_high(F.col("low"), F.col("longest"))).drop("longest")


def position_quality(cube: DataFrame) -> DataFrame:
    """(file, pos, depth, mean, p10..p90) from a quality cube; exact percentiles with truncated targets."""
    offset = phred(F.min("ascii").over(Window.partitionBy("file")))["offset"]
    at = Window.partitionBy("file", "pos")
    c = cube.withColumn("offset", offset).withColumn("depth", F.sum("n").over(at))
    own = F.col("ascii") >= F.col("offset")
    c = c.withColumn("reached", F.sum(F.when(own, F.col("n")).otherwise(0)).over(at.orderBy("ascii").rowsBetween(Window.unboundedPreceding, 0)))
    value = F.col("ascii") - F.col("offset")
    hit = lambda p: F.min(F.when(own & (F.col("reached") >= F.floor(F.col("depth") * p / 100)), value))
    mean = F.sum(F.when(own, F.col("n") * value)) / F.sum(F.when(own, F.col("n")))
    return c.groupBy("file", "pos").agg(F.first("depth").alias("depth"), mean.alias("mean"), *(F.coalesce(hit(p), F.lit(0)).alias(f"p{p}") for p in PERCENTS))


def per_base_quality(cube: DataFrame) -> DataFrame:
    """(file, low, high, mean, lowest, lower_quartile, median, upper_quartile, highest); lowest and highest are the 10th and 90th percentiles."""
    names = dict(zip(PERCENTS, ("lowest", "lower_quartile", "median", "upper_quartile", "highest"), strict=True))
    deep = lambda p: F.coalesce(F.avg(F.when(F.col("depth") > DEPTH, F.col(f"p{p}"))), F.lit(0.0))
    return _binned(position_quality(cube)).groupBy("file", "low", "high").agg(F.avg("mean").alias("mean"), *(deep(p).alias(n) for p, n in names.items()))


def _base_counts(cube: DataFrame) -> DataFrame:
    counted = [F.sum(F.when(F.col("base") == b, F.col("n")).otherwise(0)).alias(b.lower()) for b in "ACGTN"]
    return cube.groupBy("file", "pos").agg(*counted, F.sum("n").alias("depth"))


def position_content(cube: DataFrame) -> DataFrame:
    """(file, pos, a, c, g, t, n, not_n) counts."""
    return _base_counts(cube).withColumn("not_n", F.col("depth") - F.col("n")).drop("depth")


def per_base_content(cube: DataFrame) -> DataFrame:
    """(file, low, high, t, c, a, g) percentages without N; null where a bin holds none of the four."""
    binned = _binned(_base_counts(cube)).groupBy("file", "low", "high").agg(*(F.sum(b).alias(f"s{b}") for b in "tcag"))
    total = F.col("st") + F.col("sc") + F.col("sa") + F.col("sg")
    return binned.select("file", "low", "high", *(F.try_divide(100.0 * F.col(f"s{b}"), total).alias(b) for b in "tcag"))


def per_base_n(cube: DataFrame) -> DataFrame:
    """(file, low, high, n_percent)."""
    binned = _binned(_base_counts(cube)).groupBy("file", "low", "high").agg(F.sum("n").alias("s"), F.sum("depth").alias("d"))
    return binned.select("file", "low", "high", F.try_divide(100.0 * F.col("s"), F.col("d")).alias("n_percent"))
