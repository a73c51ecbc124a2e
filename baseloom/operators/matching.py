"""Adapters, contaminants and SNP patterns: reads against small reference tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bins import bin_high, bin_low

PATTERN = 21
BLOCK = 11  # (PATTERN + 1) / 2: of a read's 11-mers from its start, end to end, each 21-mer holds one that begins in its first 11 bases


def adapter_positions(reads: DataFrame, adapters: list[tuple[str, str]]) -> DataFrame:
    """(file, ord, adapter, pos, reads): reads whose first occurrence begins at or before the 0-based pos; dense up to longest read - longest adapter."""
    size = max(len(s) for _, s in adapters)
    firsts = F.array(*(F.struct(F.lit(i).alias("ord"), (F.instr("seq", s) - 1).alias("pos")) for i, (_, s) in enumerate(adapters)))
    hits = reads.select("file", F.explode(firsts).alias("h")).where("h.pos >= 0").groupBy("file", "h.ord", "h.pos").agg(F.count("*").alias("n"))
    ends = reads.groupBy("file").agg(F.max(F.length("seq")).alias("longest")).where(F.col("longest") >= size)
    table = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(n).alias("adapter")) for i, (n, _) in enumerate(adapters)))
    spine = ends.select("file", F.explode(table).alias("a"), F.col("longest")).select("file", "a.ord", "a.adapter", F.explode(F.sequence(F.lit(0), F.col("longest") - size)).alias("pos"))
    w = Window.partitionBy("file", "ord").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return spine.join(hits, ["file", "ord", "pos"], "left").withColumn("reads", F.coalesce(F.sum("n").over(w), F.lit(0)).cast("long")).drop("n")


def adapter_content(reads: DataFrame, adapters: list[tuple[str, str]]) -> DataFrame:
    """(file, adapter, low, high, percent): mean over a bin of the percentage of reads with the adapter so far."""
    totals = reads.groupBy("file").agg(F.count("*").alias("total"))
    at = adapter_positions(reads, adapters).withColumn("p1", (F.col("pos") + 1).cast("long")).withColumn("longest", F.max("p1").over(Window.partitionBy("file")))
    at = at.withColumn("low", bin_low(F.col("p1"), F.col("longest"))).withColumn("high", bin_high(F.col("low"), F.col("longest"))).join(F.broadcast(totals), "file")
    return at.groupBy("file", "adapter", "low", "high").agg((F.sum(F.col("reads") * 100.0 / F.col("total")) / (F.col("high") - F.col("low") + 1)).alias("percent"))


def best_match(query: str, forward: str, reverse: str, search_reverse: bool = False) -> tuple[str, int, int] | None:
    """(direction, length, percent_id) of a query's best ungapped match with one contaminant.

    Queries of 8 to 19 bases match as exact substrings only. Otherwise a run along a diagonal, with one mismatch at
    most, counts from 21 bases on; the longest wins, then the higher identity, then the first found.
    """
    q = query.upper()
    if 8 <= len(q) < 20:
        for name, text in (("forward", forward), ("reverse", reverse)):
            if q in text:
                return name, len(q), 100
    best = None
    for name, text in (("forward", forward), *((("reverse", reverse),) if search_reverse else ())):
        for offset in range(20 - len(text), len(q) - 20):
            found = _diagonal(text, q, offset)
            if found and (best is None or found[0] > best[1]):
                best = (name, *found)
    return best


def _diagonal(text: str, query: str, offset: int) -> tuple[int, int] | None:
    """(length, percent_id) of the best run where text[i] faces query[i + offset]."""
    lo, hi = max(0, -offset), min(len(text), len(query) - offset)
    best, start, end, wrong = None, lo, 0, 0
    runs = []
    for i in range(lo, hi):
        if text[i] == query[i + offset]:
            end = i
            continue
        wrong += 1
        if wrong > 1:  # a second mismatch closes the run; the one before it stays inside
            runs.append((1 + end - start, wrong - 1))
            start, end, wrong = i + 1, i + 1, 0
    runs.append((1 + end - start, wrong))
    for length, misses in runs:
        if length > 20:
            found = (length, (length - misses) * 100 // length)
            if best is None or found > best:
                best = found
    return best


HIT = T.StructType([T.StructField("name", T.StringType()), T.StructField("direction", T.StringType()), T.StructField("length", T.LongType()), T.StructField("percent_id", T.LongType())])


def contaminant_hits(found: DataFrame, contaminants: list[tuple[str, str, str]], search_reverse: bool = False) -> DataFrame:
    """found (with seq, at most 1000 rows a file) with the best contaminant hit, null if none; the first listed wins ties."""
    import pandas as pd

    def best(seqs):
        rows = []
        for seq in seqs:
            top = None
            for name, forward, reverse in contaminants:
                hit = best_match(seq, forward, reverse, search_reverse)
                if hit and (top is None or hit[1:] > top[2:]):
                    top = (name, *hit)
            rows.append(top or (None, None, None, None))
        return pd.DataFrame(rows, columns=["name", "direction", "length", "percent_id"]).astype({"length": "Int64", "percent_id": "Int64"})

    hit = F.pandas_udf(best, HIT)("seq")
    return found.withColumn("_hit", hit).select(*found.columns, F.when(F.col("_hit.name").isNotNull(), F.col("_hit")).alias("contaminant_hit"))


def candidates(reads: DataFrame, patterns: DataFrame) -> DataFrame:
    """(file, read_idx, kmer): the reads' 21-mers around blocks that occur in patterns at the place they have in the 21-mer; each occurrence of a pattern once."""
    n = F.length("seq")
    blocks = reads.select("file", "read_idx", "seq", F.explode(F.when(n >= PATTERN, F.sequence(F.lit(1), n - BLOCK + 1, F.lit(BLOCK)))).alias("pos"))
    first = F.greatest(F.col("pos") - BLOCK + 1, F.lit(1))  # the 21-mers of a block begin here to pos; around holds them all
    blocks = blocks.select("file", "read_idx", F.substring("seq", F.col("pos"), F.lit(BLOCK)).alias("block"), F.substring("seq", first, F.col("pos") - first + PATTERN).alias("around"))
    known = patterns.select(F.explode(F.array(*(F.substring("kmer", i + 1, BLOCK) for i in range(BLOCK)))).alias("block")).distinct()
    near = blocks.join(known, "block", "left_semi")
    near = near.select("file", "read_idx", "around", F.explode(F.sequence(F.lit(1), F.length("around") - PATTERN + 1)).alias("pos"))
    return near.select("file", "read_idx", F.substring("around", F.col("pos"), F.lit(PATTERN)).alias("kmer"))


def vaf_counts(reads: DataFrame, patterns: DataFrame, per_read: bool = True) -> DataFrame:
    """(file, snp_idx, allele, n): reads that hold a pattern of the allele, or all occurrences.

    patterns is a fixed reference table of 21-mers; it is broadcast only while it is below the session's threshold.
    """
    found = candidates(reads, patterns).join(patterns, "kmer").select("file", "read_idx", "snp_idx", "allele")
    if per_read:
        found = found.distinct()
    return found.groupBy("file", "snp_idx", "allele").agg(F.count("*").alias("n"))


def vaf_matrix(reads: DataFrame, patterns: DataFrame, universe: DataFrame, per_read: bool = True) -> DataFrame:
    """(file, snp_idx, ref, alt, vaf): counts are null for an untracked index without hits; vaf is alt / (ref + alt)."""
    counts = vaf_counts(reads, patterns, per_read).groupBy("file", "snp_idx").agg(*(F.sum(F.when(F.col("allele") == a, F.col("n"))).alias(c) for a, c in ((0, "r"), (1, "a"))))
    files = reads.select("file").distinct()
    full = files.crossJoin(universe).join(counts, ["file", "snp_idx"], "left")  # universe: a row for each index
    fill = lambda c: F.coalesce(F.col(c), F.when(F.col("tracked"), F.lit(0).cast("long")))
    full = full.select("file", "snp_idx", fill("r").alias("ref"), fill("a").alias("alt"))
    both = F.col("ref") + F.col("alt")
    return full.withColumn("vaf", F.when(both > 0, 1 - F.col("ref") / both))
