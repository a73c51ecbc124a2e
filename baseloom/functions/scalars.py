"""Scalar functions over sequences, qualities, names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ascii_sum(text: Column) -> Column:
    """Sum of the codes of the characters, which are ASCII."""
    return F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda a, c: a + F.ascii(c))


def phred(lowest: Column) -> Column:
    """struct(name, offset) from the lowest quality character's code."""
    made = lambda name, offset: F.struct(F.lit(name).alias("name"), F.lit(offset).cast("long").alias("offset"))
    bad = F.raise_error(F.concat(F.lit("no known encoding has quality character code "), lowest.cast("string")))
    return (
        F.when(lowest < 33, bad.cast("struct<name:string,offset:bigint>"))
        .when(lowest < 64, made("Sanger / Illumina 1.9", 33))
        .when(lowest == 65, made("Illumina 1.3", 64))
        .when(lowest <= 126, made("Illumina 1.5", 64))
        .otherwise(bad.cast("struct<name:string,offset:bigint>"))
    )


def phred_to_probability(q: Column) -> Column:
    return F.pow(F.lit(10.0), -q / 10)


def old_illumina_to_probability(q: Column) -> Column:
    """10 to the power (q/q + 1) / -10, which is constant but for q = 0, where it is not a number."""
    return F.when(q == 0, F.lit(float("nan"))).otherwise(F.pow(F.lit(10.0), F.lit(2.0 / -10)))


def probability_to_phred(p: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), (-10 * F.log10(p)).cast("long"))


def probability_to_old_illumina(p: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), (-10 * F.log10(p / (1 - p))).cast("long"))


def reverse_complement(seq: Column) -> Column:
    up = F.upper(seq)
    bad = F.raise_error(F.concat(F.lit("not a sequence of A, C, G and T: "), seq)).cast("string")
    return F.when(up.rlike("[^ACGT]"), bad).otherwise(F.reverse(F.translate(up, "ACGT", "TGCA")))


def tile_field(head: Column) -> Column:
    """Which ':' field holds the tile, from a head's number of fields: 4 of 7 or more, 2 of 5 or more, else null."""
    n = F.size(F.split(head, ":"))
    return F.when(n >= 7, 4).when(n >= 5, 2)


def tile_of(head: Column, field: Column) -> Column:
    return F.get(F.split(head, ":"), field).cast("long")


def is_fastq(path: Column) -> Column:
    return path.rlike("^.*(.fq|.fastq)$")


def is_fastq_gz(path: Column) -> Column:
    return path.rlike("^.*(.fq.gz|.fastq.gz)$")


REMOTE = r"(oss|s3)://([^/]+)(/.*)$"


def is_remote(path: Column) -> Column:
    return path.rlike(r"(oss|s3)://.*$")


def remote_parts(path: Column) -> Column:
    """struct(scheme, bucket, key), the key with its slash; an error for other paths."""
    part = lambda i: F.regexp_extract(path, REMOTE, i)
    bad = F.raise_error(F.concat(F.lit("not a remote path: "), path)).cast("struct<scheme:string,bucket:string,key:string>")
    return F.when(path.rlike(REMOTE), F.struct(part(1).alias("scheme"), part(2).alias("bucket"), part(3).alias("key"))).otherwise(bad)


def stem(path: Column) -> Column:
    """The base name without its last two suffixes."""
    return F.regexp_replace(F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", ""), r"(?<=.)\.[^.]*$", "")


def guessed_reads(path: Column, length: Column) -> Column:
    """Reads in a file by its size: a fitted line for gzip, the size itself for others, 0 if missing."""
    return F.when(length.isNull(), 0).when(path.endswith(".gz"), F.floor(F.lit(1968523.0) + F.lit(0.01164386) * length)).otherwise(length).cast("long")


def hit_text(name: Column, percent_id: Column, length: Column) -> Column:
    return F.coalesce(F.concat(name, F.lit(" ("), percent_id.cast("string"), F.lit("% over "), length.cast("string"), F.lit("bp)")), F.lit("No Hit"))


def not_finite_to_null(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)
