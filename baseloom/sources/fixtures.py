"""Reads derived from the orders table: the same text runs in Spark SQL and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

READS_CTE = r"""
fx_k as (select o_orderkey as k, case when o_orderkey % 10 = 3 then o_orderkey % 50 else o_orderkey end as s from orders),
fx_b as (select k, s, translate(concat(md5(concat('a',s)),md5(concat('b',s)),md5(concat('c',s)),md5(concat('d',s))),'0123456789abcdef','ACGTACGTACGTACGT') as b,
 translate(concat(md5(concat('q',k)),md5(concat('r',k)),md5(concat('t',k)),md5(concat('u',k))),'0123456789abcdef','IIIIIIHHHGGFF?5#') as q from fx_k),
fx_c as (select k, case
  when k % 100 = 5 then concat('CAAGCAGAAGACGGCATACGAGATCGGTCTCGGCATTCCTGCTGAACCGCTCTTCCGATCT', substr(b,1,40))
  when k % 50 = 7 then concat(substr(b,1,30 + k % 40),'AGATCGGAAGAG',substr(b,1,128))
  when k % 100 = 49 then concat(substr(b,1,2),'CGCATTT',substr(b,10,119))
  when k % 13 = 0 then concat(substr(b,1,k % 90),'N',substr(b,2 + k % 90,128))
  else b end as b, q from fx_b),
reads as (select k + 1 as read_idx, concat('A00:1:FCX:1:', 1101 + k % 12, ':', k, ':', k * 7, ' 1:N:0:ACGT') as head,
 substr(b,1,100) as seq, substr(q,1,100) as qual from fx_c)
"""

VAR_CTE = READS_CTE + r""",
reads_var as (select read_idx, head, substr(seq,1,36 + (read_idx*7) % 65) as seq, substr(qual,1,36 + (read_idx*7) % 65) as qual from reads)
"""

PATTERNS_CTE = READS_CTE + r""",
patterns as (select substr(seq,11,21) as kmer, cast(((read_idx-1) % 50 - 3)/10 as int) as snp_idx, 0 as allele from reads where read_idx in (4,64,24,34,44)
union all select substr(seq,45,21), cast(((read_idx-1) % 50 - 3)/10 as int), 0 from reads where read_idx in (4,64,24,34,44)
union all select substr(seq,40,21), cast(((read_idx-1) % 50 - 1)/10 as int), 1 from reads where read_idx in (12,22,32,42)
union all select substr(seq,5,21), 0, 1 from reads where read_idx = 6
union all select 'AAAAAAAAAAAAAAAAAAAAA', 5, 0)
"""
#: (index, tracked): an untracked index has null counts instead of 0.
UNIVERSE = tuple((i, i < 6) for i in range(7))


READS = "'fixture' as file, read_idx, head, seq, qual"
_made: dict[tuple, DataFrame] = {}


def _kept(spark: SparkSession, sf_dir: str, table: str) -> DataFrame | None:
    made = _made.get((spark.sparkContext.applicationId, sf_dir, table))
    return made if made is not None and made.storageLevel.useMemory else None


def _sql(spark: SparkSession, orders: DataFrame, cte: str, table: str, columns: str) -> DataFrame:
    orders.createOrReplaceTempView("orders")
    return spark.sql(f"with {cte} select {columns} from {table}")


def _run(spark: SparkSession, sf_dir: str, cte: str, table: str, columns: str) -> DataFrame:
    """The table, made once a session and persisted: all modules read the same reads."""
    if _kept(spark, sf_dir, table) is None:
        made = _sql(spark, spark.read.parquet(f"{sf_dir}/orders.parquet"), cte, table, columns).persist()
        _made[spark.sparkContext.applicationId, sf_dir, table] = made
    return _kept(spark, sf_dir, table)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, READS_CTE, "reads", READS)


def reads_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads for one pass over a few columns: the persisted ones if there are any, else only what is asked for is made, and nothing persisted.

    The keys are dealt out first, as a small orders table is one row group, which one task would read.
    """
    if (kept := _kept(spark, sf_dir, "reads")) is not None:
        return kept
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    keys.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey").createOrReplaceTempView("spread_orders")  # a new orders view would drop what is kept of the old one
    return spark.sql(f"with orders as (select * from spread_orders), {READS_CTE} select {READS} from reads")


def reads_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths from 36 to 100."""
    return _run(spark, sf_dir, VAR_CTE, "reads_var", READS)


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of 16 rows, read when asked for, so that joins know its size."""
    rows = _sql(spark, spark.read.parquet(f"{sf_dir}/orders.parquet"), PATTERNS_CTE, "patterns", "kmer, snp_idx, allele").toArrow()
    return spark.createDataFrame(rows)


def universe(spark: SparkSession) -> DataFrame:
    import pyarrow as pa

    return spark.createDataFrame(pa.table({"snp_idx": pa.array([i for i, _ in UNIVERSE], pa.int32()), "tracked": [t for _, t in UNIVERSE]}))
