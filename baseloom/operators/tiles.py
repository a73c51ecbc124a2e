"""Per-tile quality: the first reads and then every N-th; deviations from the mean over tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bins import bin_high, bin_low
from ..functions.scalars import phred, tile_field, tile_of

FIRST, EVERY, MOST = 10_000, 10, 1001
BLOCK = 4096  # reads to a block, when empty ones are counted


def sampled_tiles(reads: DataFrame, first: int = FIRST, every: int = EVERY) -> DataFrame:
    """(file, read_idx, tile, qual) of sampled reads with a quality; the head format is that of a file's first such read.

    A sampled read with too few fields ends the module for its file; earlier reads count. Ordinals count reads with a
    quality; they are the read's number less the empty ones before it: those of the blocks before, by running sums, and those
    of its own block. Only files with empty reads have blocks in that table, from the first such on.
    """
    full = reads.where("length(qual) > 0").withColumn("b", F.floor(F.col("read_idx") / BLOCK))
    blocks = reads.groupBy("file", F.floor(F.col("read_idx") / BLOCK).alias("b")).agg(F.collect_list(F.when(F.length("qual") == 0, F.col("read_idx"))).alias("gaps"))
    before = F.sum(F.size("gaps")).over(Window.partitionBy("file").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)) - F.size("gaps")
    blocks = blocks.withColumn("before", before).where("before > 0 or size(gaps) > 0")
    gone = F.coalesce(F.col("before") + F.size(F.filter("gaps", lambda i: i < F.col("read_idx"))), F.lit(0))
    numbered = full.join(blocks, ["file", "b"], "left").withColumn("j", F.col("read_idx") - gone)
    kept = numbered.where((F.col("j") <= first) | (F.col("j") % every == 0))
    head = kept.groupBy("file").agg(F.min_by(F.struct("head"), "read_idx")["head"].alias("head1")).select("file", tile_field(F.col("head1")).alias("field"))
    shaped = kept.join(F.broadcast(head), "file").where("field is not null").withColumn("short", F.size(F.split("head", ":")) <= F.col("field"))
    stop = shaped.where("short").groupBy("file").agg(F.min("read_idx").alias("stop"))
    going = shaped.join(F.broadcast(stop), "file", "left").where("stop is null or read_idx < stop")
    return going.select("file", "read_idx", tile_of(F.col("head"), F.col("field")).alias("tile"), "qual")


def tile_quality(reads: DataFrame, first: int = FIRST, every: int = EVERY) -> DataFrame:
    """(file, tile, low, high, mean, deviation); nothing for a file of more than MOST tiles."""
    lowest = reads.where("length(qual) > 0").select("file", F.explode(F.array_distinct(F.split("qual", ""))).alias("c")).where("c <> ''").groupBy("file").agg(phred(F.min(F.ascii("c")))["offset"].alias("offset"))
    chars = sampled_tiles(reads, first, every).select("file", "tile", F.posexplode(F.split("qual", "")).alias("p", "c")).where("c <> ''")
    cube = chars.groupBy("file", "tile", (F.col("p") + 1).cast("long").alias("pos"), F.ascii("c").cast("long").alias("ascii")).agg(F.count("*").alias("n")).join(F.broadcast(lowest), "file")
    own = F.when(F.col("ascii") >= F.col("offset"), F.col("n"))
    at = cube.groupBy("file", "tile", "pos").agg((F.sum(own * (F.col("ascii") - F.col("offset"))) / F.sum(own)).alias("m"))
    at = at.withColumn("longest", F.max("pos").over(Window.partitionBy("file"))).withColumn("low", bin_low(F.col("pos"), F.col("longest"))).withColumn("high", bin_high(F.col("low"), F.col("longest")))
    means = at.groupBy("file", "tile", "low", "high").agg(F.avg("m").alias("mean"))
    # a row a tile with its bins (at most some 75); the grid of all tiles and bins is laid out from these rows
    per_tile = means.groupBy("file", "tile").agg(F.collect_list(F.struct("low", "high", "mean")).alias("r"))
    w = Window.partitionBy("file")
    bins = F.array_distinct(F.flatten(F.collect_list(F.transform("r", lambda x: F.struct(x["low"].alias("low"), x["high"].alias("high")))).over(w)))
    wide = per_tile.withColumn("bins", bins).withColumn("k", F.count("*").over(w)).where(F.col("k") <= MOST)
    grid = wide.select("file", "tile", "r", F.explode("bins").alias("b"))
    own = F.get(F.filter("r", lambda x: x["low"] == F.col("b.low")), F.lit(0))["mean"]
    dense = grid.select("file", "tile", F.col("b.low").alias("low"), F.col("b.high").alias("high"), F.coalesce(own, F.lit(0.0)).alias("mean"))
    return dense.withColumn("deviation", F.col("mean") - F.avg("mean").over(Window.partitionBy("file", "low")))
