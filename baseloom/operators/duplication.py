"""Overrepresented sequences and duplication levels, over the first K distinct sequence keys in read order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TRACKED = 100_000
PERCENT = 0.1
BLOCK = 1 << 16  # reads to a block, when the first keys are looked for
LABELS = ("1", "2", "3", "4", "5", "6", "7", "8", "9", ">10", ">50", ">100", ">500", ">1k", ">5k", ">10k")


def sequence_keys(reads: DataFrame) -> DataFrame:
    """(file, key, n, first_idx): reads over 75 bases are known by their first 50."""
    key = F.when(F.length("seq") > 75, F.substring("seq", 1, 50)).otherwise(F.col("seq"))
    return reads.groupBy("file", key.alias("key")).agg(F.count("*").alias("n"), F.min("read_idx").alias("first_idx"))


def tracked_keys(keys: DataFrame, limit: int | None = TRACKED) -> DataFrame:
    """keys with rank, the first `limit` of each file by first occurrence; None keeps all, without ranks. The limit belongs to the feature.

    Keys are counted by blocks of reads; only those up to the block in which the limit is reached are ranked, so a task ranks
    `limit` and BLOCK keys at most, however many a file has.
    """
    if limit is None:
        return keys.withColumn("rank", F.lit(None).cast("int"))
    block = F.floor(F.col("first_idx") / BLOCK)
    sums = keys.groupBy("file", block.alias("b")).agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy("file").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = sums.withColumn("before", before).where(F.col("before") < limit).groupBy("file").agg(F.max("b").alias("last"))  # a row a file
    few = keys.join(F.broadcast(last), "file").where(block <= F.col("last")).drop("last")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("file").orderBy("first_idx"))).where(F.col("rank") <= limit)


def tracking(reads: DataFrame, tracked: DataFrame, limit: int | None = TRACKED) -> DataFrame:
    """(file, total, unique_seq_count, count_at_unique_limit): reads seen when tracking stopped, all if it never did."""
    total = reads.groupBy("file").agg(F.count("*").alias("total"))
    at = F.max(F.when(F.col("rank") == limit, F.col("first_idx"))) if limit is not None else F.lit(None).cast("long")
    seen = tracked.groupBy("file").agg(F.count("*").alias("unique_seq_count"), at.alias("at"))
    return total.join(seen, "file", "left").select("file", "total", F.coalesce("unique_seq_count", F.lit(0)).alias("unique_seq_count"), F.coalesce("at", "total").alias("count_at_unique_limit"))


def overrepresented(tracked: DataFrame, totals: DataFrame) -> DataFrame:
    """(file, seq, n, percentage) of the keys over PERCENT; ties in order of sequence."""
    share = F.col("n") / F.col("total") * 100
    return tracked.join(F.broadcast(totals.select("file", "total")), "file").select("file", F.col("key").alias("seq"), "n", share.alias("percentage")).where(F.col("percentage") > PERCENT).orderBy("file", F.desc("n"), "seq")


def _slot():
    n = F.col("level")
    slot = F.lit(15)
    for top, k in ((10_000, 14), (5000, 13), (1000, 12), (500, 11), (100, 10), (50, 9)):
        slot = F.when(n <= top, k).otherwise(slot)
    return F.when(n < 10, n - 1).otherwise(slot).cast("int")


def corrected():
    """Keys of a level that the whole file is expected to have, from those found before tracking stopped.

    The chance to miss a key is a product of d factors, each 1 - at / total at most, and counts as 0 below a limit; so only as many
    factors are multiplied as can keep it over that limit.
    """
    at, total, d, n = (F.col(c) for c in ("count_at_unique_limit", "total", "level", "keys"))
    least = 1 - n / (n + 0.01)
    enough = F.when(at < total, F.ceil(F.log(least) / F.log1p(-at / total)) + 2).otherwise(1).cast("long")
    factors = F.sequence(F.lit(0).cast("long"), F.greatest(F.least(d, enough), F.lit(1).cast("long")) - 1)
    missed = F.aggregate(factors, F.lit(1.0), lambda a, j: a * F.greatest(total - at - j, F.lit(0)) / (total - j))
    missed = F.when(missed < least, 0.0).otherwise(missed)
    return F.when((at == total) | (total - n < n), n.cast("double")).otherwise(n / (1 - missed))


def duplication_levels(tracked: DataFrame, totals: DataFrame) -> DataFrame:
    """(file, slot, label, dedup_percent, total_percent, percent_different): 16 rows a file."""
    levels = tracked.groupBy("file", F.col("n").alias("level")).agg(F.count("*").alias("keys")).join(F.broadcast(totals), "file")
    each = levels.withColumn("c", corrected()).groupBy("file", _slot().alias("slot")).agg(F.sum("c").alias("d"), F.sum(F.col("c") * F.col("level")).alias("r"))
    whole = each.groupBy("file").agg(F.sum("d").alias("dd"), F.sum("r").alias("rr"))
    spine = whole.select("file", "dd", "rr", F.posexplode(F.array(*map(F.lit, LABELS))).alias("slot", "label"))
    out = spine.join(each, ["file", "slot"], "left")
    part = lambda x, of: F.coalesce(F.col(x), F.lit(0.0)) / F.col(of) * 100
    return out.select("file", F.col("slot").cast("long").alias("slot"), "label", part("d", "dd").alias("dedup_percent"), part("r", "rr").alias("total_percent"), F.when(F.col("rr") == 0, 100.0).otherwise(F.col("dd") / F.col("rr") * 100).alias("percent_different"))
