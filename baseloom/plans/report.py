"""The quality report: all modules of a file as one nested JSON document."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bins import bin_label
from ..functions.scalars import not_finite_to_null
from ..operators import basic, cubes, duplication, kmers, matching, positions, tiles
from ..operators import reads as by_read
from ..sources import lists

MODULES = ("checksum", "fastqc", "checkmate", "all")
UNLIMITED_COMPAT = 61  # what a limit of 0 meant to the original: 2 xor 63


@dataclass
class Config:
    """Options; defaults as the command line's. tracked=0 is no limit, or 61 with compat."""

    which: str = "all"
    tracked: int = duplication.TRACKED
    kmer_every: int = kmers.EVERY
    tile_first: int = tiles.FIRST
    tile_every: int = tiles.EVERY
    adapters: list = field(default_factory=lists.default_adapters)
    contaminants: list = field(default_factory=lists.default_contaminants)
    patterns: DataFrame | None = None
    universe: DataFrame | None = None
    search_reverse: bool = False
    compat: bool = False

    def limit(self) -> int | None:
        return self.tracked or (UNLIMITED_COMPAT if self.compat else None)


def _field(name: str):
    return lambda x: x[name]


def _list(df: DataFrame, name: str, order: list[str], **columns: Column) -> DataFrame:
    """(file, name): a struct of arrays, one element a row of df in order."""
    rows = F.array_sort(F.collect_list(F.struct(*order, *(c.alias(f"_{k}") for k, c in columns.items()))))
    return df.groupBy("file").agg(rows.alias("r")).select("file", F.struct(*(F.transform("r", _field(f"_{k}")).alias(k) for k in columns)).alias(name))


def _safe(c: str) -> Column:
    return not_finite_to_null(F.col(c))


def fastqc(reads: DataFrame, config: Config) -> DataFrame:
    """(file, fastqc) with the modules in the report's order."""
    name = bin_label(F.col("low"), F.col("high"))
    bases, quals = cubes.base_cube(reads), cubes.quality_cube(reads)
    h = _list(basic.dense_histogram(basic.quality_histogram(reads)), "h", ["ascii"], n=F.col("n"))
    b = basic.basic_stats(reads).join(h, "file")
    fields = "total_reads total_bases q20_bases q30_bases q40_bases q50_bases t_count c_count g_count a_count n_count".split()
    basics = b.select("file", F.struct(
        F.col("file").alias("file_name"), F.lit("Conventional base calls").alias("file_type"), "phred", *fields, _safe("gc_percentage").alias("gc_percentage"),
        "min_length", "max_length", F.chr("lowest_char").alias("lowest_char"), F.chr("highest_char").alias("highest_char"),
        F.struct(F.col("h.n").alias("actual_counts"), F.aggregate("h.n", F.lit(0).cast("long"), lambda a, x: a + x).alias("total_counts")).alias("quality_count"),
    ).alias("basic_stats"))
    quality = _list(positions.per_base_quality(quals), "per_base_seq_quality", ["low"], base_pos=F.col("low"), xlabels=name, **{c: _safe(c) for c in ("mean", "median", "lower_quartile", "upper_quartile", "lowest", "highest")})
    scores = by_read.per_seq_quality(reads)
    per_seq = _list(scores, "s", ["score"], x_category_quality=F.col("score"), y_category_count=F.col("n")).join(by_read.most_frequent_score(scores), "file").select("file", F.struct("s.*", "most_frequent_score").alias("per_seq_quality_score"))
    counts = _list(positions.position_content(bases), "c", ["pos"], g_counts=F.col("g"), c_counts=F.col("c"), a_counts=F.col("a"), t_counts=F.col("t"), n_counts=F.col("n"), not_n_counts=F.col("not_n"))
    shares = _list(positions.per_base_content(bases), "p", ["low"], x_category=name, percentages=F.array(*(_safe(x) for x in "tcag")))
    content = counts.join(shares, "file").select("file", F.struct("p.x_category", "c.g_counts", "c.c_counts", "c.a_counts", "c.t_counts", "p.percentages").alias("per_base_seq_content"))
    n_shares = _list(positions.per_base_n(bases), "p", ["low"], x_categories=name, percentages=_safe("n_percent"))
    n_content = counts.join(n_shares, "file").select("file", F.struct("p.x_categories", "c.n_counts", "c.not_n_counts", "p.percentages").alias("per_base_n_content"))
    theory = by_read.gc_theoretical(by_read.gc_observed(reads))
    gc = _list(theory, "g", ["pct"], x_category=F.col("pct"), y_gc_distribution=F.col("y"), y_theo_distribution=_safe("theoretical"), d=_safe("deviation_percent")).select("file", F.struct("g.x_category", "g.y_gc_distribution", "g.y_theo_distribution", F.get("g.d", F.lit(0)).alias("deviation_percent")).alias("per_seq_gc_content"))
    lengths = _list(by_read.length_distribution(reads), "seq_len_distribution", ["low"], x_categories=F.col("label"), graph_counts=F.col("n"))
    limit = config.limit()
    tracked = duplication.tracked_keys(duplication.sequence_keys(reads), limit)
    totals = duplication.tracking(reads, tracked, limit)
    hits = matching.contaminant_hits(duplication.overrepresented(tracked, totals), config.contaminants, config.search_reverse)
    hits = hits.groupBy("file").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "seq", F.col("n").alias("count"), "percentage", "contaminant_hit"))).alias("r"))
    over = totals.join(hits, "file", "left").select("file", F.struct(F.col("total").alias("count"), F.lit(duplication.PERCENT).alias("observation_cut_off"), "unique_seq_count", "count_at_unique_limit", F.coalesce(F.transform("r", lambda x: x.dropFields("o")), F.array()).alias("overrepresented_seqs")).alias("overrepresented_seqs"))
    dup = _list(duplication.duplication_levels(tracked, totals), "d", ["slot"], dedup_percentages=F.col("dedup_percent"), total_percentages=F.col("total_percent"), labels=F.col("label"), p=F.col("percent_different")).select("file", F.struct("d.dedup_percentages", "d.total_percentages", F.get("d.p", F.lit(0)).alias("percent_diff_seq"), "d.labels").alias("seq_duplication_level"))
    order = F.array_position(F.array(*(F.lit(n) for n, _ in config.adapters)), F.col("adapter"))
    curves = _list(matching.adapter_content(reads, config.adapters).withColumn("o", order), "c", ["o", "low"], l=name, a=F.col("adapter"), e=_safe("percent")).select("file", F.struct(F.array_distinct("c.a").alias("labels"), F.array_distinct("c.l").alias("x_labels"), F.transform(F.array_distinct("c.a"), lambda a: F.transform(F.filter(F.arrays_zip(F.col("c.a").alias("a"), F.col("c.e").alias("e")), lambda x: x["a"] == a), lambda x: x["e"])).alias("enrichments")).alias("adapter_content"))
    groups = kmers.kmer_groups(kmers.kmer_counts(reads, config.kmer_every), kmers.windows_of(reads, config.kmer_every))
    top = kmers.enriched_kmers(groups)
    found = _list(top, "k", ["rank"], enriched_kmers=F.struct(F.col("kmer").alias("sequence"), "count", "lowest_pvalue"))
    lines = kmers.plotted_curves(groups, top).groupBy("file", "rank", "kmer").agg(F.array_sort(F.collect_list(F.struct("low", name.alias("l"), "obs_exp"))).alias("r"))
    lines = _list(lines, "c", ["rank"], enrichments=F.transform("r", lambda x: x["obs_exp"]), x_labels=F.col("kmer"), x=F.transform("r", lambda x: x["l"])).select("file", F.col("c.enrichments").alias("enrichments"), F.get("c.x", F.lit(0)).alias("x_categories"), F.col("c.x_labels").alias("x_labels"))
    kmer = found.join(lines, "file", "left").select("file", F.struct("k.enriched_kmers", "enrichments", "x_categories", "x_labels").alias("kmer_content"))
    per_tile = tiles.tile_quality(reads, config.tile_first, config.tile_every).groupBy("file", "tile").agg(F.array_sort(F.collect_list(F.struct("low", name.alias("l"), "deviation"))).alias("r"))
    tile = _list(per_tile, "t", ["tile"], tiles=F.col("tile"), means=F.transform("r", lambda x: x["deviation"]), x=F.transform("r", lambda x: x["l"])).select("file", F.struct(F.get("t.x", F.lit(0)).alias("x_labels"), "t.tiles", "t.means").alias("per_tile_quality_score"))
    out = basics
    parts = (quality, per_seq, content, gc, n_content, lengths, over, dup, curves, kmer, tile)
    for part in parts:
        out = out.join(part, "file", "left")
    return out.select("file", F.struct("basic_stats", *(p.columns[1] for p in parts)).alias("fastqc"))


def vaf(reads: DataFrame, config: Config) -> DataFrame:
    """(file, vaf_matrix)."""
    m = matching.vaf_matrix(reads, config.patterns, config.universe)
    return _list(m, "vaf_matrix", ["snp_idx"], indexes=F.col("snp_idx"), reference=F.col("ref"), alternative=F.col("alt"), vaf=F.col("vaf").cast("float"))


def report(reads: DataFrame, config: Config | None = None, meta: DataFrame | None = None) -> DataFrame:
    """(file, json): filemeta, fastqc and vaf_matrix, each null if not asked for. meta: (file, md5sum, filesize)."""
    config = config or Config()
    if config.which not in MODULES:
        raise ValueError(f"which is one of {', '.join(MODULES)}")
    out = reads.select("file").distinct() if meta is None else meta.select("file")
    null = lambda n: F.lit(None).cast("string").alias(n)
    cols = [null("filemeta"), null("fastqc"), null("vaf_matrix")]
    if meta is not None and config.which in ("all", "checksum"):
        out = out.join(meta.select("file", F.struct("md5sum", "filesize").alias("filemeta")), "file", "left")
        cols[0] = F.col("filemeta")
    if config.which in ("all", "fastqc"):
        out = out.join(fastqc(reads, config), "file", "left")
        cols[1] = F.col("fastqc")
    if config.which in ("all", "checkmate") and config.patterns is not None:
        out = out.join(vaf(reads, config), "file", "left")
        cols[2] = F.col("vaf_matrix")
    body = F.col("filemeta") if config.which == "checksum" else F.struct(*cols)
    return out.select("file", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))
