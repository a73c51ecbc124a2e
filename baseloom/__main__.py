"""python -m baseloom metrics FILE... | merge -o OUT FILE..."""

from __future__ import annotations

import argparse
import os
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="baseloom")
    sub = p.add_subparsers(dest="command", required=True)
    m = sub.add_parser("metrics", help="quality report of FASTQ files")
    m.add_argument("files", nargs="+")
    m.add_argument("-w", "--which", choices=["checksum", "fastqc", "checkmate", "all"], default="all")
    m.add_argument("-n", "--nthreads", type=int, default=1, help="local cores")
    m.add_argument("-o", "--output", default="", help="an existing folder")
    m.add_argument("-m", "--algorithm", choices=["md5sum", "blake2b"], default="md5sum")
    m.add_argument("-p", "--pattern-file")
    m.add_argument("-A", "--adapter-file")
    m.add_argument("-C", "--contaminant-file")
    m.add_argument("--overrepresented-musc", type=int, default=100_000, help="distinct sequences tracked; 0: all")
    m.add_argument("--kmer-isi", type=int, default=50, help="keep one of so many reads")
    m.add_argument("--tile-csb", type=int, default=10_000, help="reads kept from the start")
    m.add_argument("--tile-isi", type=int, default=10, help="then one of so many")
    c = sub.add_parser("merge", help="append files to a new one")
    c.add_argument("files", nargs="+")
    c.add_argument("-o", "--output", required=True)
    return p


def metrics(a: argparse.Namespace) -> list[str]:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .plans.report import Config, report
    from .session import ship
    from .sources import fastq, files, lists

    missing = [x for x in a.files if not os.path.isfile(x)]
    if missing:
        sys.exit("not found: " + ", ".join(missing))
    spark = SparkSession.builder.master(f"local[{max(1, a.nthreads)}]").config("spark.sql.shuffle.partitions", max(1, a.nthreads)).getOrCreate()
    ship(spark)
    fastq.register(spark)
    meta = files.checksum(spark, ",".join(a.files) if len(a.files) == 1 else [os.path.abspath(x) for x in a.files], a.algorithm).withColumn("file", F.regexp_replace("path", "^file:/*", "/"))
    reads = spark.read.format("fastq").load(",".join(os.path.abspath(x) for x in a.files)).persist()
    config = Config(a.which, a.overrepresented_musc, a.kmer_isi, a.tile_csb, a.tile_isi)
    if a.adapter_file:
        config.adapters = lists.read_list(spark, a.adapter_file)
    if a.contaminant_file:
        config.contaminants = [(n, s.upper(), lists.reverse_complement(s)) for n, s in lists.read_list(spark, a.contaminant_file)]
    if a.pattern_file:
        config.patterns, config.universe = lists.read_patterns(spark, a.pattern_file)
    return files.write_reports(report(reads, config, meta), a.output)


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    if a.command == "merge":
        from .sources.files import merge

        merge(a.files, a.output)
    else:
        print("\n".join(metrics(a)))


if __name__ == "__main__":
    main()
