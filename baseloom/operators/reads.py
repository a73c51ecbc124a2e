"""Modules by read: mean quality, GC content against its fitted curve, lengths."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bins import length_interval
from ..functions.scalars import ascii_sum


def per_seq_quality(reads: DataFrame) -> DataFrame:
    """(file, score, n): reads by floor of the mean quality code, less the offset; scores between the ends are filled with 0."""
    from ..functions.scalars import phred

    whole = reads.where("length(qual) > 0").select("file", F.floor(ascii_sum(F.col("qual")) / F.length("qual")).alias("code"), F.array_min(F.transform(F.array_distinct(F.split("qual", "")), lambda c: F.when(c != "", F.ascii(c)))).alias("low"))
    counts = whole.groupBy("file", "code").agg(F.count("*").alias("n"), F.min("low").alias("low"))
    ends = counts.groupBy("file").agg(F.min("code").alias("lo"), F.max("code").alias("hi"), phred(F.min("low"))["offset"].alias("offset"))
    spine = ends.select("file", "offset", F.explode(F.sequence("lo", "hi")).alias("code"))
    return spine.join(counts.select("file", "code", "n"), ["file", "code"], "left").select("file", (F.col("code") - F.col("offset")).alias("score"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def most_frequent_score(scores: DataFrame) -> DataFrame:
    """(file, most_frequent_score): the first largest count among as many leading slots as there are distinct scores."""
    w = Window.partitionBy("file")
    slots = scores.withColumn("slot", F.col("score") - F.min("score").over(w)).withColumn("d", F.count_if(F.col("n") > 0).over(w))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("score").alias("score")))
    return slots.where("slot < d").groupBy("file").agg(best["score"].alias("most_frequent_score"))


def gc_model(lengths: DataFrame) -> DataFrame:
    """(len, gc_count, pct, increment) for each len of lengths: what a read adds to which percentages."""
    ks = lengths.select("len").distinct().select("len", F.explode(F.sequence(F.lit(0).cast("long"), "len")).alias("gc_count"))
    edge = lambda x: F.round(F.least(F.greatest(x, F.lit(0.0)), F.col("len").cast("double")) * 100 / F.col("len")).cast("int")
    claims = ks.select("len", "gc_count", F.explode(F.sequence(edge(F.col("gc_count") - 0.5), edge(F.col("gc_count") + 0.5))).alias("pct"))
    return claims.withColumn("increment", 1.0 / F.count("*").over(Window.partitionBy("len", "pct")))


def gc_observed(reads: DataFrame) -> DataFrame:
    """(file, pct, y) for pct 0 to 100; reads over 100 bases count up to full hundreds, over 1000 to full thousands."""
    length = F.length("seq")
    cut = F.when(length > 1000, F.floor(length / 1000) * 1000).when(length > 100, F.floor(length / 100) * 100).otherwise(length)
    seq = F.expr("substring(seq, 1, cut)")
    cutted = reads.where("length(seq) > 0").withColumn("cut", cut.cast("int")).select("file", F.col("cut").cast("long").alias("len"), (F.col("cut") - F.length(F.translate(seq, "GC", ""))).cast("long").alias("gc_count"))
    counts = cutted.groupBy("file", "len", "gc_count").agg(F.count("*").alias("n"))
    y = counts.join(gc_model(counts), ["len", "gc_count"]).groupBy("file", "pct").agg(F.sum(F.col("n") * F.col("increment")).alias("y"))
    spine = counts.select("file").distinct().select("file", F.explode(F.sequence(F.lit(0), F.lit(100))).alias("pct"))
    return spine.join(y, ["file", "pct"], "left").select("file", F.col("pct").cast("long").alias("pct"), F.coalesce("y", F.lit(0.0)).alias("y"))


def gc_theoretical(observed: DataFrame) -> DataFrame:
    """(file, pct, y, theoretical, deviation_percent): a normal curve about the mode of the observed distribution."""
    ys = observed.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("pct", "y"))), lambda s: s["y"]).alias("ys"))  # 101 values
    first = ys.withColumn("m", F.array_position(F.transform("ys", lambda v: F.round(v, 9)), F.round(F.array_max("ys"), 9)).cast("int") - 1)
    low_enough = F.get("ys", F.col("m")) - F.get("ys", F.col("m")) / 10
    below = F.filter(F.sequence(F.lit(0), F.lit(100)), lambda i: F.get("ys", i) <= low_enough)
    up, down = F.array_min(F.filter(below, lambda i: i > F.col("m"))), F.array_max(F.filter(below, lambda i: i < F.col("m")))
    centre = F.coalesce((up + down) / 2, F.col("m").cast("double"))
    c = first.withColumn("centre", centre).withColumn("total", F.aggregate("ys", F.lit(0.0), lambda a, v: a + v))
    squares = F.aggregate(F.transform("ys", lambda v, i: F.pow(i - F.col("centre"), F.lit(2)) * v), F.lit(0.0), lambda a, v: a + v)
    c = c.withColumn("sd", F.sqrt(F.try_divide(squares, F.col("total") - 1)))
    density = lambda i: F.try_divide(F.exp(-F.try_divide(F.pow(i - F.col("centre"), F.lit(2)), 2 * F.col("sd") * F.col("sd"))), F.sqrt(F.lit(2 * pi)) * F.col("sd")) * F.col("total")
    c = c.withColumn("theo", F.transform("ys", lambda v, i: density(i)))
    c = c.withColumn("deviation_percent", F.aggregate(F.zip_with("ys", "theo", lambda a, b: F.abs(b - a)), F.lit(0.0), lambda a, v: a + v) / F.col("total") * 100)
    rows = c.select("file", F.posexplode(F.arrays_zip("ys", "theo")).alias("pct", "z"), "deviation_percent")
    return rows.select("file", F.col("pct").cast("long").alias("pct"), F.col("z.ys").alias("y"), F.col("z.theo").alias("theoretical"), "deviation_percent")


def length_distribution(reads: DataFrame) -> DataFrame:
    """(file, low, label, n): lengths in equal bins, one category beyond either end."""
    counts = reads.groupBy("file", F.length("seq").cast("long").alias("len")).agg(F.count("*").alias("n"))
    ends = counts.groupBy("file").agg(F.greatest(F.min("len") - 1, F.lit(0)).alias("lo"), (F.max("len") + 1).alias("hi")).withColumn("iv", length_interval(F.col("lo"), F.col("hi")))
    ends = ends.withColumn("start", F.round(F.col("lo") / F.col("iv")).cast("long") * F.col("iv"))
    bins = ends.where("start <= hi").select("file", "iv", "hi", F.explode(F.sequence("start", "hi", "iv")).alias("low"))
    binned = counts.join(ends, "file").where("len >= start").withColumn("low", F.col("start") + F.floor((F.col("len") - F.col("start")) / F.col("iv")) * F.col("iv")).groupBy("file", "low").agg(F.sum("n").cast("double").alias("n"))
    top = F.least(F.col("low") + F.col("iv") - 1, F.col("hi"))
    label = F.when(F.col("iv") == 1, F.col("low").cast("string")).otherwise(F.concat_ws("-", F.col("low").cast("string"), top.cast("string")))
    return bins.withColumn("label", label).join(binned, ["file", "low"], "left").select("file", "low", "label", F.coalesce("n", F.lit(0.0)).alias("n"))
