"""Incremental counts over a stream of read batches: partial cubes are appended, and merged when read.

The modules by position need counts only, which add up over batches; what depends on read order takes read_idx from the
source and is computed over all reads at the end. Each micro-batch writes under its own number, so a batch that is
run again after a failure replaces its own part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cubes import base_cube, quality_cube

CUBES = {"bases": (base_cube, ["file", "pos", "base"]), "qualities": (quality_cube, ["file", "pos", "ascii"])}


def start(reads: DataFrame, folder: str, checkpoint: str, **trigger):
    """A query that keeps the cubes of a streaming reads table in folder; trigger as of writeStream.trigger()."""

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        for name, (cube, _) in CUBES.items():
            cube(df).write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        df.unpersist()

    return reads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def cube(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The merged cube so far."""
    keys = CUBES[name][1]
    return spark.read.parquet(f"{folder}/{name}").groupBy(*keys).agg(F.sum("n").alias("n"))
