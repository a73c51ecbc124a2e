"""Contiguous balanced shards from global byte-size prefix sums, in built-in functions only.

Rows (without texts) are range-partitioned and sorted by doc_id and written; the totals of the partitions, one row
each, give every partition's offset; running sums within a partition add to it. A row goes to the shard in which the
middle of its bytes lies, so shards are contiguous in doc_id order and near equal in bytes: no shard's edge
is more than half a row from its target.

Defined cases. Null text: size 1, crc32 of nothing (0). Null doc_id: sorted first. Rows with the same doc_id: sorted by
crc32 and size, equal rows next to each other. A row longer than a shard's target stays whole; shards may then be
empty. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SHARDS = 16
ORDER = ("doc_id", "text_crc32", "size")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row of docs."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1).cast("long")).alias("size"), F.crc32(text).alias("text_crc32"))
    # which partition a row is in must not change between the jobs that follow, so it is written with the row
    rows = stored(rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).withColumn("part", F.spark_partition_id()), "shard-rows")
    totals = rows.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
    offsets = totals.select("part", F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"), F.sum("part_bytes").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_bytes"))
    inside = Window.partitionBy("part").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.select("*", F.coalesce(F.sum("size").over(inside), F.lit(0)).alias("bytes_in"), F.coalesce(F.count(F.lit(1)).over(inside), F.lit(0)).alias("rows_in"))
    placed = placed.join(F.broadcast(offsets), "part")  # a row for each shuffle partition
    middle = 2 * (F.col("bytes_before") + F.col("bytes_in")) + F.col("size")
    at = F.least(F.lit(shards - 1).cast("decimal(38,0)"), F.floor(middle.cast("decimal(28,0)") * shards / (2 * F.col("all_bytes")).cast("decimal(28,0)")))
    placed = placed.select("doc_id", "size", "text_crc32", at.cast("int").alias("shard"), (F.col("rows_before") + F.col("rows_in")).alias("at"))
    starts = placed.groupBy("shard").agg(F.min("at").alias("start"))  # a row for each shard
    return placed.join(F.broadcast(starts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("at") - F.col("start")).alias("slot"))


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The same rows in DuckDB's SQL: checksums byte by byte with a table made by the polynomial's rule, one running sum for the bytes before.
OP5_SQL = f"""with steps as (select list(c order by i) as tab from (select i, list_reduce(range(9), lambda c, k: case when k = 0 then c when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) as c from range(256) r(i))),
t as (select doc_id, hex(encode(coalesce(text, ''))) as hex from documents),
b as (select doc_id, length(hex) // 2 + 1 as size, list_transform(regexp_extract_all(hex, '..'), lambda x: cast(cast('0x' || x as int) as bigint)) as bytes from t),
c as (select doc_id, size, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) as crc from b, steps),
p as (select *, sum(size) over (order by doc_id nulls first, crc, size rows unbounded preceding) - size as before, sum(size) over () as total, row_number() over (order by doc_id nulls first, crc, size) as pos from c),
s as (select *, least({SHARDS - 1}, (2 * before + size) * {SHARDS} // (2 * total)) as shard from p)
select doc_id, cast(size as bigint) as size, cast(crc as bigint) as text_crc32, 'bytes' as law, cast(shard as int) as shard, cast(pos - min(pos) over (partition by shard) as bigint) as slot, cast(null as int) as grown_shard from s"""
