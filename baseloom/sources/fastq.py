"""A FASTQ source: spark.read.format("fastq").load(path), after register(spark).

A partition is one file: read_idx, the 1-based ordinal in the file, decides sampling and tracking, so records are numbered where
they are read. Plain files, gzip (any number of members) and lz4 frames are told apart by their first bytes. A broken record
or a byte outside ASCII is an error. Option "columns" (a comma-separated list) leaves the other columns null.

Paths are local or mounted ones that every executor sees; for files in other stores use read_fastq(), which reads whole
files through Spark.
"""

from __future__ import annotations

import glob
import gzip
import io
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, read_idx bigint, head string, seq string, qual string"
BATCH = 8192


def opened(f):
    """A binary stream of the decompressed content."""
    f = f if hasattr(f, "peek") else io.BufferedReader(f)
    start = f.peek(4)[:4]
    if start[:2] == b"\x1f\x8b":
        return gzip.open(f)
    if start == b"\x04\x22\x4d\x18":
        try:
            import lz4.frame
        except ImportError as e:
            raise RuntimeError("lz4 files need the lz4 package") from e
        return lz4.frame.open(f)
    return f


def records(stream, name: str) -> Iterator[tuple[str, str, str]]:
    """(head, seq, qual) of each record; head without its '@'."""
    lines = (x.rstrip(b"\r\n") for x in stream)
    for head in lines:
        if not head:
            if any(x for x in lines):
                raise ValueError(f"{name}: an empty line between records")
            return
        seq, plus, qual = next(lines, None), next(lines, None), next(lines, None)
        if qual is None or head[:1] != b"@" or plus[:1] != b"+" or len(seq) != len(qual):
            raise ValueError(f"{name}: not a record: {head[:80]!r}")
        yield head[1:].decode("ascii"), seq.decode("ascii"), qual.decode("ascii")


def batches(found: Iterator, name: str, columns: set[str] | None = None):
    """Arrow batches of records, numbered from 1."""
    import pyarrow as pa

    types = [("file", pa.string()), ("read_idx", pa.int64()), ("head", pa.string()), ("seq", pa.string()), ("qual", pa.string())]

    def made(rows, first):
        cols = {"file": [name] * len(rows), "read_idx": range(first, first + len(rows)), **{c: [r[i] for r in rows] for i, c in enumerate(("head", "seq", "qual"))}}
        return pa.RecordBatch.from_arrays([pa.array([None] * len(rows) if columns and n not in columns | {"file", "read_idx"} else cols[n], t) for n, t in types], schema=pa.schema(types))

    rows, first = [], 1
    for r in found:
        rows.append(r)
        if len(rows) == BATCH:
            yield made(rows, first)
            first, rows = first + len(rows), []
    if rows:
        yield made(rows, first)


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FastqReader(self.options)


class FastqReader(DataSourceReader):
    def __init__(self, options):
        paths = options["path"].split(",")
        self.files = sorted(y for x in paths for y in ([z for z in glob.glob(os.path.join(x, "*")) if os.path.isfile(z)] if os.path.isdir(x) else glob.glob(x) or [x]))
        self.columns = set(options["columns"].replace(" ", "").split(",")) if options.get("columns") else None

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in self.files]

    def read(self, partition: InputPartition):
        with open(partition.value, "rb") as f:
            yield from batches(records(opened(f), partition.value), partition.value, self.columns)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastqSource)


def _from_bytes(columns):
    def read(parts):
        for b in parts:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield from batches(records(opened(io.BytesIO(content)), path), path, columns)

    return read


def read_fastq(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Reads through Spark's file systems; a file must fit in a task's memory in its compressed form."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_from_bytes(set(columns) if columns else None), SCHEMA)


def concatenated(frames: list[DataFrame]) -> DataFrame:
    """The reads of several files as those of one, in the order given, numbered on."""
    out = None
    for i, df in enumerate(frames):
        part = df.withColumn("part", F.lit(i))
        out = part if out is None else out.unionByName(part)
    from pyspark.sql import Window

    sizes = out.groupBy("part").agg(F.max("read_idx").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row an input
    return out.join(F.broadcast(before), "part").withColumn("read_idx", F.col("read_idx") + F.col("before")).drop("part", "before")
