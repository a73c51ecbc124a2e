"""Whole files: checksums, sizes, byte concatenation and the JSON sink."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import guessed_reads, stem


def checksum(spark: SparkSession, path: str, algorithm: str = "md5sum") -> DataFrame:
    """(path, md5sum, filesize) of the raw bytes; algorithm blake2b gives a 512-bit digest in the same column, others MD5.

    Files on paths that every executor sees are read in parts, whatever their size; those of other stores go through Spark
    whole, up to its 2 GB.
    """
    files = spark.read.format("binaryFile").load(path)
    local = F.col("path").startswith("file:")
    out = "path string, md5sum string, filesize long"
    streamed = files.where(local).select("path", "length").mapInArrow(_digests(algorithm, False), out)
    return streamed.union(files.where(~local).select("path", "length", "content").mapInArrow(_digests(algorithm, True), out))


def _digests(algorithm: str, whole: bool):
    def digests(batches):
        import hashlib
        from urllib.parse import unquote, urlparse

        import pyarrow as pa

        for b in batches:
            sums = []
            for i, path in enumerate(b.column(0).to_pylist()):
                h = hashlib.blake2b() if algorithm == "blake2b" else hashlib.md5()
                if whole:
                    h.update(b.column(2)[i].as_py())
                else:
                    with open(unquote(urlparse(path).path), "rb") as f:
                        while part := f.read(1 << 20):
                            h.update(part)
                sums.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sums, pa.string()), b.column(1)], ["path", "md5sum", "filesize"])

    return digests


def exact_read_counts(reads: DataFrame) -> DataFrame:
    """(file, n): reads in each file, counted."""
    return reads.groupBy("file").agg(F.count("*").alias("n"))


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """(path, filesize, guess): reads in each file as guessed by its size."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("filesize"), guessed_reads(F.col("path"), F.col("length")).alias("guess"))


def merge(inputs: list[str], output: str) -> int:
    """Bytes of all inputs, appended in order to a new file; gzip members may follow each other. Checks come first."""
    if os.path.exists(output):
        raise FileExistsError(output)
    missing = [x for x in inputs if not os.path.isfile(x)]
    if missing:
        raise FileNotFoundError(", ".join(missing))
    n = 0
    with open(output, "xb") as out:
        for path in inputs:
            with open(path, "rb") as f:
                while part := f.read(1 << 16):
                    n += out.write(part)
    return n


def report_names(reports: DataFrame) -> DataFrame:
    """reports with name, the report's file name: the input's base name without two suffixes."""
    return reports.withColumn("name", F.concat(stem(F.col("file")), F.lit(".json")))


def write_reports(reports: DataFrame, folder: str = "") -> list[str]:
    """One <stem>.json for each row (file, json) in an existing local folder; existing files are replaced."""
    if folder and not os.path.isdir(folder):
        raise NotADirectoryError(folder)
    done = []
    for r in report_names(reports).toLocalIterator():  # one small document an input file
        path = os.path.join(folder, r.name)
        with open(path, "w") as f:
            f.write(r.json)
        done.append(path)
    return done
