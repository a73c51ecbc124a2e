"""Basic statistics and the quality histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import phred

THRESHOLDS = (20, 30, 40, 50)


def quality_histogram(reads: DataFrame) -> DataFrame:
    """(file, ascii, n) for the codes that occur."""
    chars = reads.select("file", F.explode(F.split("qual", "")).alias("c")).where("c <> ''")
    return chars.groupBy("file", F.ascii("c").cast("long").alias("ascii")).agg(F.count("*").alias("n"))


def dense_histogram(histogram: DataFrame) -> DataFrame:
    """All 150 codes, 0 where none occurs."""
    spine = histogram.select("file").distinct().select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(149).cast("long"))).alias("ascii"))
    return spine.join(histogram, ["file", "ascii"], "left").select("file", "ascii", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def basic_stats(reads: DataFrame) -> DataFrame:
    """One row a file. Lengths and total_bases count A, C, G, T and N only; gc_percentage is a fraction."""
    count = lambda b: F.length("seq") - F.length(F.replace("seq", F.lit(b), F.lit("")))
    per_read = reads.select("file", *(count(b).cast("long").alias(b) for b in "TCGAN"))
    own = sum((F.col(b) for b in "CGAN"), F.col("T"))
    bases = per_read.groupBy("file").agg(F.count("*").alias("total_reads"), F.sum(own).alias("total_bases"), *(F.sum(b).alias(f"{b.lower()}_count") for b in "TCGAN"), F.min(own).alias("min_length"), F.max(own).alias("max_length"))
    h = quality_histogram(reads)
    lowest = h.groupBy("file").agg(F.least(F.lit(126), F.min("ascii")).cast("long").alias("lowest_char"), F.greatest(F.lit(0), F.max("ascii")).cast("long").alias("highest_char")).withColumn("phred", phred(F.col("lowest_char")))
    over = h.join(lowest, "file").groupBy("file").agg(
        F.first("lowest_char").alias("lowest_char"), F.first("highest_char").alias("highest_char"), F.first("phred").alias("phred"),
        *(F.sum(F.when(F.col("ascii") >= F.col("phred.offset") + q, F.col("n")).otherwise(0)).alias(f"q{q}_bases") for q in THRESHOLDS),
    )
    return bases.join(over, "file", "left").withColumn("gc_percentage", (F.col("g_count") + F.col("c_count")) / F.col("total_bases"))
