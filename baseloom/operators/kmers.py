"""Positional k-mer enrichment over every N-th read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bins import bin_high, bin_low

K, EVERY, LONGEST = 7, 50, 500
P_VALUE, RATIO, TOP, PLOTTED = 0.01, 5.0, 20, 6


def _sampled(reads: DataFrame, every: int) -> DataFrame:
    seq = F.substring("seq", 1, LONGEST)
    windows = F.transform(F.sequence(F.lit(1), F.length(seq) - K + 1), lambda i: F.struct(i.cast("long").alias("pos"), F.substring(seq, i, F.lit(K)).alias("kmer")))
    kept = reads.where((F.col("read_idx") % every == 0) & (F.length("seq") >= K))
    return kept.select("file", "read_idx", F.greatest(F.length(seq) - K + 1, F.lit(0)).cast("long").alias("width"), F.explode(windows).alias("w")).select("file", "read_idx", "width", "w.pos", "w.kmer").where(~F.col("kmer").contains("N"))


def kmer_counts(reads: DataFrame, every: int = EVERY) -> DataFrame:
    """(file, kmer, pos, n, reach): reach is how many positions the k-mer's counts cover."""
    s = _sampled(reads, every)
    at = s.groupBy("file", "kmer", "pos").agg(F.count("*").alias("n"), F.min(F.struct("read_idx", "width"))["width"].alias("first_width"), F.min("read_idx").alias("first"))
    w = Window.partitionBy("file", "kmer")
    first = F.min(F.struct("first", "first_width")).over(w)["first_width"]
    return at.select("file", "kmer", "pos", "n", F.greatest(first, F.max("pos").over(w)).alias("reach"))


def kmer_groups(counts: DataFrame, widest: DataFrame) -> DataFrame:
    """(file, kmer, low, high, count, hits, group_total, share, predicted, obs_exp) for each k-mer and bin with positions in reach.

    widest: (file, longest), the largest number of windows of a sampled read.
    """
    per_pos = counts.groupBy("file", "pos").agg(F.sum("n").alias("total"))
    per_file = per_pos.groupBy("file").agg(F.sum("total").alias("all"))
    kmers = counts.groupBy("file", "kmer", "reach").agg(F.sum("n").alias("count")).join(F.broadcast(per_file), "file").withColumn("share", F.col("count") / F.col("all"))
    binned = lambda df: df.join(F.broadcast(widest), "file").withColumn("low", bin_low(F.col("pos"), F.col("longest"))).withColumn("high", bin_high(F.col("low"), F.col("longest")))
    hits = binned(counts).groupBy("file", "kmer", "low").agg(F.sum("n").alias("hits"))
    # a bin's total stops at the k-mer's reach; reaches are few (at most the longest window count)
    reaches = counts.select("file", "reach").distinct()
    totals = binned(per_pos).join(reaches, "file").where("pos <= reach").groupBy("file", "reach", "low", "high").agg(F.sum("total").alias("group_total"))
    out = kmers.join(totals, ["file", "reach"]).join(hits, ["file", "kmer", "low"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)).cast("long"))
    predicted = F.col("share") * F.col("group_total")
    return out.select("file", "kmer", "low", "high", "count", "hits", "group_total", "share", predicted.alias("predicted"), (F.col("hits") / predicted).alias("obs_exp"))


def windows_of(reads: DataFrame, every: int = EVERY) -> DataFrame:
    kept = reads.where((F.col("read_idx") % every == 0) & (F.length("seq") >= K))
    return kept.groupBy("file").agg((F.max(F.least(F.length("seq"), F.lit(LONGEST))) - K + 1).cast("long").alias("longest"))


def tail(hits: int, total: int, share: float) -> float:
    """1 minus the binomial distribution function, as doubles subtract: tails under about 1e-16 are 0.

    Terms are summed away from `hits`, upwards beyond the mean and downwards below it, until they no longer count.
    """
    from math import exp, lgamma, log, log1p

    if hits >= total:
        return 0.0
    if share >= 1:
        return 1.0
    up, odds = hits >= total * share, share / (1 - share)
    k = hits + 1 if up else hits
    term = exp(lgamma(total + 1) - lgamma(k + 1) - lgamma(total - k + 1) + k * log(share) + (total - k) * log1p(-share))
    sum_ = 0.0
    while 0 <= k <= total and term > sum_ * 1e-17:
        sum_ += term
        term *= (total - k) / (k + 1) * odds if up else k / (total - k + 1) / odds
        k += 1 if up else -1
    below = 1.0 - sum_ if up else sum_
    return max(0.0, 1.0 - below)


def enriched_kmers(groups: DataFrame) -> DataFrame:
    """(file, rank, kmer, count, lowest_pvalue, max_obs_exp, max_low): the TOP by largest ratio, then sequence, both descending."""
    import pandas as pd

    def tails(hits, total, share):
        return pd.Series([tail(int(h), int(t), s) * 4.0**K for h, t, s in zip(hits, total, share, strict=True)])

    p_value = F.pandas_udf(tails, "double")
    likely = groups.where((F.col("obs_exp") > RATIO) & (F.col("hits") > F.col("predicted"))).withColumn("p", p_value("hits", "group_total", "share")).where(F.col("p") < P_VALUE)
    lowest = likely.groupBy("file", "kmer").agg(F.min("p").alias("lowest_pvalue"))
    best = groups.groupBy("file", "kmer", "count").agg(F.max("obs_exp").alias("max_obs_exp"), F.max_by("low", F.struct("obs_exp", -F.col("low"))).alias("max_low"))
    ranked = lowest.join(best, ["file", "kmer"]).withColumn("rank", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("max_obs_exp"), F.desc("kmer"))).cast("long"))
    return ranked.where(F.col("rank") <= TOP).select("file", "rank", "kmer", "count", "lowest_pvalue", "max_obs_exp", "max_low")


def plotted_curves(groups: DataFrame, enriched: DataFrame) -> DataFrame:
    """(file, rank, kmer, low, obs_exp) of the PLOTTED first enriched k-mers."""
    few = enriched.where(F.col("rank") <= PLOTTED).select("file", "rank", "kmer")
    return groups.join(F.broadcast(few), ["file", "kmer"]).select("file", "rank", "kmer", "low", "high", "obs_exp")
