"""The small cubes from which the modules by position derive: reads are exploded once, then only counts remain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _exploded(reads: DataFrame, column: str) -> DataFrame:
    return reads.select("file", F.posexplode(F.split(column, "")).alias("p", "c")).where("c <> ''").select("file", (F.col("p") + 1).cast("long").alias("pos"), "c")


def base_cube(reads: DataFrame) -> DataFrame:
    """(file, pos, base, n); pos is 1-based."""
    return _exploded(reads, "seq").groupBy("file", "pos", F.col("c").alias("base")).agg(F.count("*").alias("n"))


def quality_cube(reads: DataFrame) -> DataFrame:
    """(file, pos, ascii, n)."""
    return _exploded(reads, "qual").groupBy("file", "pos", F.ascii("c").cast("long").alias("ascii")).agg(F.count("*").alias("n"))
