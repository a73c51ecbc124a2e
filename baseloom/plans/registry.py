"""The queries that the driver runs, and their SQL (written independently; only the text of the fixtures is shared)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import basic, cubes, duplication, kmers, matching, positions, tiles
from ..operators import reads as by_read
from ..sources import fixtures, lists

TRACK = 1000  # of the limited variants: small enough to be reached at every scale


def _q(df: DataFrame) -> DataFrame:
    """df without file, doubles rounded."""
    return df.select(*(F.round(c, 6).alias(c) if t in ("double", "float") else F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes if c != "file"))


def q_basic_stats(spark, d):
    x = basic.basic_stats(fixtures.reads(spark, d))
    return _q(x.select("*", F.col("phred.name").alias("encoding"), F.col("phred.offset").alias("offset")).drop("phred"))


def q_histogram(spark, d):
    return _q(basic.dense_histogram(basic.quality_histogram(fixtures.reads(spark, d))))


def q_per_base_quality(spark, d):
    return _q(positions.per_base_quality(cubes.quality_cube(fixtures.reads(spark, d))))


def q_per_base_content(spark, d):
    return _q(positions.per_base_content(cubes.base_cube(fixtures.reads(spark, d))))


def q_position_content(spark, d):
    return _q(positions.position_content(cubes.base_cube(fixtures.reads(spark, d))))


def q_per_base_n(spark, d):
    return _q(positions.per_base_n(cubes.base_cube(fixtures.reads(spark, d))))


def q_per_seq_quality(spark, d):
    return _q(by_read.per_seq_quality(fixtures.reads(spark, d)))


def q_most_frequent_score(spark, d):
    return _q(by_read.most_frequent_score(by_read.per_seq_quality(fixtures.reads(spark, d))))


def q_gc_observed(spark, d):
    return _q(by_read.gc_observed(fixtures.reads(spark, d)))


def q_gc_observed_var(spark, d):
    return _q(by_read.gc_observed(fixtures.reads_var(spark, d)))


def q_gc_theoretical(spark, d):
    return _q(by_read.gc_theoretical(by_read.gc_observed(fixtures.reads(spark, d))))


def q_lengths(spark, d):
    return _q(by_read.length_distribution(fixtures.reads(spark, d)))


def q_lengths_var(spark, d):
    return _q(by_read.length_distribution(fixtures.reads_var(spark, d)))


def _tracked(spark, d, limit):
    reads = fixtures.reads(spark, d)
    tracked = duplication.tracked_keys(duplication.sequence_keys(reads), limit)
    return tracked, duplication.tracking(reads, tracked, limit)


def q_overrepresented(spark, d):
    return _q(duplication.overrepresented(*_tracked(spark, d, duplication.TRACKED)))


def q_overrepresented_limited(spark, d):
    return _q(duplication.overrepresented(*_tracked(spark, d, TRACK)))


def q_unique_limit(spark, d):
    return _q(_tracked(spark, d, TRACK)[1])


def q_duplication(spark, d):
    return _q(duplication.duplication_levels(*_tracked(spark, d, duplication.TRACKED)))


def q_duplication_limited(spark, d):
    return _q(duplication.duplication_levels(*_tracked(spark, d, TRACK)))


def q_adapters(spark, d):
    return _q(matching.adapter_content(fixtures.reads(spark, d), lists.default_adapters()))


def q_contaminants(spark, d):
    found = duplication.overrepresented(*_tracked(spark, d, duplication.TRACKED))
    hits = matching.contaminant_hits(found, lists.default_contaminants())
    h = F.col("contaminant_hit")
    return _q(hits.select("seq", "n", "percentage", h["name"].alias("hit_name"), h["direction"].alias("direction"), h["length"].alias("hit_length"), h["percent_id"].alias("percent_id"), S.hit_text(h["name"], h["percent_id"], h["length"]).alias("hit_text")))


def q_tiles(spark, d):
    return _q(tiles.tile_quality(fixtures.reads(spark, d)))


def _vaf(spark, d, per_read):
    patterns = fixtures.patterns(spark, d)
    return _q(matching.vaf_matrix(fixtures.reads_once(spark, d), patterns, fixtures.universe(spark), per_read))


def q_vaf(spark, d):
    return _vaf(spark, d, True)


def q_vaf_all(spark, d):
    return _vaf(spark, d, False)


def q_kmer_counts(spark, d):
    return _q(kmers.kmer_counts(fixtures.reads(spark, d)).drop("reach"))


def _groups(spark, d):
    reads = fixtures.reads(spark, d)
    return kmers.kmer_groups(kmers.kmer_counts(reads), kmers.windows_of(reads))


def q_kmer_obs_exp(spark, d):
    return _q(_groups(spark, d).where("hits > 0").drop("share", "predicted"))


def q_kmer_enriched(spark, d):
    return _q(kmers.enriched_kmers(_groups(spark, d)))


def q_phred(spark, d):
    q = spark.range(0, 61).select(F.col("id").alias("q"))
    p = S.phred_to_probability(F.col("q"))
    part = (F.col("q") + 1) / 64.0
    return _q(q.select("q", p.alias("p"), S.not_finite_to_null(S.old_illumina_to_probability(F.col("q"))).alias("p_old"), S.probability_to_phred(part).alias("back"), S.probability_to_old_illumina(part).alias("back_old")))


def q_strings(spark, d):
    plain = ~F.col("seq").contains("N")  # a read with N has no reverse complement
    return fixtures.reads(spark, d).select("read_idx", F.when(plain, S.reverse_complement(F.col("seq"))).alias("revcomp"), S.tile_of(F.col("head"), S.tile_field(F.col("head"))).alias("tile"))


PATHS = ("a.fq", "dir/b.fastq", "c.fq.gz", "d.x.fastq.gz", "xfq", "e.txt", "oss://bucket/k/x.fq.gz", "s3://b2/y.fastq", "http://h/z.fq")


def q_paths(spark, d):
    p = spark.createDataFrame([(x,) for x in PATHS], "path string")
    c = F.col("path")
    parts = F.when(S.is_remote(c), S.remote_parts(c))
    return p.select("path", S.is_fastq(c).alias("fastq"), S.is_fastq_gz(c).alias("fastq_gz"), S.is_remote(c).alias("remote"), parts["scheme"].alias("scheme"), parts["bucket"].alias("bucket"), parts["key"].alias("key"), S.stem(c).alias("stem"), S.guessed_reads(c, F.lit(1_000_000)).alias("guess"))


QUERIES = {
    "basic_stats": q_basic_stats, "quality_histogram": q_histogram, "per_base_quality": q_per_base_quality, "per_base_content": q_per_base_content,
    "position_content": q_position_content, "per_base_n": q_per_base_n, "per_seq_quality": q_per_seq_quality, "most_frequent_score": q_most_frequent_score,
    "gc_observed": q_gc_observed, "gc_observed_var": q_gc_observed_var, "gc_theoretical": q_gc_theoretical, "length_distribution": q_lengths,
    "length_distribution_var": q_lengths_var, "overrepresented": q_overrepresented, "overrepresented_limited": q_overrepresented_limited,
    "unique_limit": q_unique_limit, "duplication_levels": q_duplication, "duplication_levels_limited": q_duplication_limited, "adapter_content": q_adapters,
    "contaminant_hits": q_contaminants, "tile_quality": q_tiles, "vaf_matrix": q_vaf, "vaf_all_occurrences": q_vaf_all, "kmer_counts": q_kmer_counts,
    "kmer_obs_exp": q_kmer_obs_exp, "kmer_enriched": q_kmer_enriched, "phred_functions": q_phred, "sequence_functions": q_strings, "path_functions": q_paths,
}

from .oracles import ORACLES  # noqa: E402, F401
