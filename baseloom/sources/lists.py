"""Reference lists: adapters, contaminants, SNP patterns."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATA = Path(__file__).resolve().parent.parent / "data"


def _parse(lines) -> list[tuple[str, str]]:
    import re

    rows = (x.strip() for x in lines)
    return [(a.strip(), b.strip()) for a, b in (re.split("\t+", x)[:2] for x in rows if x and not x.startswith("#") and "\t" in x)]


def default_adapters() -> list[tuple[str, str]]:
    return _parse((DATA / "adapters.txt").read_text().splitlines())


def default_contaminants() -> list[tuple[str, str, str]]:
    """(name, forward, reverse complement), in the order of the list."""
    return [(n, s.upper(), reverse_complement(s)) for n, s in _parse((DATA / "contaminants.txt").read_text().splitlines())]


def reverse_complement(seq: str) -> str:
    seq = seq.upper()
    if set(seq) - set("ACGT"):
        raise ValueError(f"not a sequence of A, C, G and T: {seq}")
    return seq[::-1].translate(str.maketrans("ACGT", "TGCA"))


def read_list(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(name, sequence) rows of an adapter or contaminant file: tab-separated; '#' lines and blank ones are skipped."""
    lines = spark.read.text(path, wholetext=True).select("value").collect()  # a reference list, one small file
    return _parse(x for r in lines for x in r.value.splitlines())


def read_patterns(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(patterns, universe) of a JSON file {count, data: {kmer: [index, allele]}, indexes}: indexes are those tracked."""
    schema = "count int, data map<string, array<int>>, indexes array<int>"
    j = spark.read.schema(schema).option("multiLine", True).json(path)
    patterns = j.select(F.explode("data").alias("kmer", "v")).select("kmer", F.get("v", F.lit(0)).alias("snp_idx"), F.get("v", F.lit(1)).alias("allele"))
    universe = j.where("count > 0").select(F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("snp_idx"), "indexes").select("snp_idx", F.array_contains("indexes", F.col("snp_idx")).alias("tracked"))
    return patterns, universe


def build_patterns(spark: SparkSession, path: str) -> DataFrame:
    """One row (count, data, indexes) from lines of tab-separated index|allele|kmer fields; write it with .write.json().

    A k-mer given twice keeps its largest (index, allele).
    """
    f = F.split(F.trim("field"), "[|]")
    fields = spark.read.text(path).select(F.explode(F.split("value", "\t")).alias("field")).where(F.size(f) >= 3)
    rows = fields.select(f[0].cast("int").alias("i"), f[1].cast("int").alias("a"), f[2].alias("kmer")).groupBy("kmer").agg(F.max(F.struct("i", "a")).alias("v"))
    data = F.map_from_entries(F.collect_list(F.struct("kmer", F.array("v.i", "v.a"))))
    return rows.agg((F.max("v.i") - F.min("v.i") + 1).alias("count"), data.alias("data"), F.sort_array(F.collect_set("v.i")).alias("indexes"))
