"""Queries against their SQL on the smallest tables; file sources and sinks; quirks."""

import gzip
import hashlib
import json
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from baseloom.functions import bins
from baseloom.functions import scalars as S
from baseloom.operators import basic, cubes, duplication, kmers, matching, positions, tiles
from baseloom.operators import reads as by_read
from baseloom.plans import registry
from baseloom.plans.report import Config, report
from baseloom.sources import fastq, files, fixtures, lists

SF = "/root/testdata/sf0.001"
READ = ("some_name", "GTCGCACTGATCTGGGTTAGGCGCGGAGCCGAGGGTTGCACCATTTTTCATTATTGAATGCCAAGATA", "I" * 68)


def frame(spark, rows):
    return spark.createDataFrame([("f", i, *r) for i, r in enumerate(rows, 1)], fastq.SCHEMA)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{SF}/orders.parquet'")
    want = con.sql(registry.ORACLES[name])
    cols = sorted(want.columns)
    got = registry.QUERIES[name](spark, SF)
    assert sorted(got.columns) == cols
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got.select(*cols).collect()), key=key) == sorted(con.sql(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({registry.ORACLES[name]})").fetchall(), key=key)


def test_partitioning_does_not_matter(spark):
    reads = fixtures.reads(spark, SF)
    for module in (lambda r: duplication.overrepresented(t := duplication.tracked_keys(duplication.sequence_keys(r), 500), duplication.tracking(r, t, 500)), lambda r: kmers.kmer_counts(r), lambda r: tiles.tile_quality(r, 100, 7)):
        one, many = (sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in module(reads.repartition(n)).collect()) for n in (1, 7))
        assert one == many


def test_worked_example(spark):
    r = basic.basic_stats(frame(spark, [READ, READ])).first()
    assert (r.total_bases, r.total_reads, r.max_length) == (136, 2, 68)


def test_phred(spark):
    assert spark.range(1).select(S.probability_to_old_illumina(F.lit(0.01))).first()[0] == 19
    for code, offset in ((65, 64), (64, 64), (63, 33), (66, 64)):
        assert spark.range(1).select(S.phred(F.lit(code))["offset"]).first()[0] == offset


@pytest.mark.parametrize(("longest", "width"), [(150, 5), (139, 2), (144, 5), (300, 5), (500, 10), (1000, 20)])
def test_intervals(spark, longest, width):
    assert spark.range(1).select(bins.linear_interval(F.lit(longest))).first()[0] == width


def test_contaminant_matching():
    forward = "GATCGGAAGAGCTCGTATGCCGTCTTCTGCTTG"
    assert matching.best_match(forward[3:15], forward, lists.reverse_complement(forward)) == ("forward", 12, 100)
    assert matching.best_match("A" * 5 + forward, forward, "") == ("forward", 33, 100)
    assert matching.best_match(forward[:20], forward, "") is None  # exactly 20 bases never hit
    broken = forward[:12] + ("A" if forward[12] != "A" else "C") + forward[13:]
    assert matching.best_match(broken, forward, "") == ("forward", 33, 96)


def test_binomial_tail():
    from math import comb

    want = sum(comb(50, k) * 0.1**k * 0.9 ** (50 - k) for k in range(11, 51))
    assert kmers.tail(10, 50, 0.1) == pytest.approx(want, abs=1e-12)
    assert kmers.tail(200, 500, 0.001) == 0.0 and kmers.tail(7, 7, 0.5) == 0.0 and kmers.tail(3, 7, 1.0) == 1.0
    low = sum(comb(50, k) * 0.5**50 for k in range(4, 51))
    assert kmers.tail(3, 50, 0.5) == pytest.approx(low, abs=1e-12)
    assert 0 < kmers.tail(1_002_000, 10**9, 0.001) < 0.05  # two standard deviations over the mean, in short time


def test_short_and_empty_reads(spark):
    reads = frame(spark, [("a:1:2:3:4:5:6", "", ""), ("a:1:2:3:4:5:6", "ACGTN", "IIIII"), ("a:1:2:3:4:5:6", "ACGTNACGTACGTACG", "IIIIIIIIIIIIIIII")])
    assert by_read.length_distribution(reads).count() > 0
    assert positions.per_base_content(cubes.base_cube(reads)).count() == 16
    assert kmers.kmer_counts(reads, 1).count() > 0
    assert by_read.gc_observed(reads).agg(F.sum("y")).first()[0] > 0
    assert tiles.tile_quality(reads).select("tile").distinct().collect() == [(4,)]
    empty = reads.where("false")
    for module in (basic.basic_stats, lambda r: positions.per_base_quality(cubes.quality_cube(r)), by_read.per_seq_quality, by_read.length_distribution, kmers.kmer_counts, tiles.tile_quality):
        assert module(empty).count() == 0


def test_short_head_stops_the_tiles(spark):
    head = "a:1:2:3:4:5:6"
    reads = frame(spark, [(head, "AC", "II"), ("a:b", "AC", "##"), (head, "AC", "##")])
    assert [(r.read_idx, r.tile) for r in tiles.sampled_tiles(reads).collect()] == [(1, 4)]
    assert {r.mean for r in tiles.tile_quality(reads).collect()} == {40.0}


def test_ordinals_over_many_empty_reads(spark):
    """Every third read is empty, over several blocks: ordinals count the others."""
    n = 3 * tiles.BLOCK
    reads = spark.range(1, n + 1).selectExpr("'f' file", "id read_idx", "'a:1:2:3:4:5:6' head", "if(id % 3 = 0, '', 'AC') seq", "if(id % 3 = 0, '', 'II') qual")
    full = [i for i in range(1, n + 1) if i % 3]
    want = [i for j, i in enumerate(full, 1) if j <= 10 or j % 7 == 0]
    assert sorted(r.read_idx for r in tiles.sampled_tiles(reads.repartition(5), 10, 7).collect()) == want


def test_tracking_ranks_the_first_blocks_only(spark):
    keys = spark.range(400_000).selectExpr("'f' file", "cast(id as string) key", "1L n", "id * 3 + 1 first_idx")
    got = duplication.tracked_keys(keys.repartition(4), 70_000).agg(F.count("*"), F.max("rank"), F.max("first_idx")).first()
    assert tuple(got) == (70_000, 70_000, 69_999 * 3 + 1)
    assert duplication.tracked_keys(keys, None).count() == 400_000


def test_expected_keys_of_hot_levels(spark):
    """The correction of levels up to a hundred million copies, against the whole product where that is short."""
    rows = [(100_000, 10**9, 100_000_000, 1), (100_000, 10**9, 5000, 3), (100_000, 200_000, 7, 40_000), (5, 5, 3, 2), (300, 1000, 900, 2)]
    got = [r[0] for r in spark.createDataFrame(rows, "count_at_unique_limit long, total long, level long, keys long").select(duplication.corrected()).collect()]
    for value, (at, total, d, n) in zip(got, rows, strict=True):
        missed, j = 1.0, 0
        while j < d and missed >= 1 - n / (n + 0.01):
            missed *= max(total - at - j, 0) / (total - j)
            j += 1
        missed = 0.0 if missed < 1 - n / (n + 0.01) else missed
        assert value == pytest.approx(n if at == total or total - n < n else n / (1 - missed), rel=1e-9)


def test_files(spark, tmp_path):
    text = "".join(f"@{h}\n{s}\n+\n{q}\n" for h, s, q in [READ] * 3).encode()
    (tmp_path / "a.fastq").write_bytes(text)
    (tmp_path / "b.x.fq.gz").write_bytes(gzip.compress(text) + gzip.compress(text))
    fastq.register(spark)
    got = spark.read.format("fastq").load(f"{tmp_path}/*")
    assert got.groupBy("file").count().orderBy("file").toPandas()["count"].tolist() == [3, 6]
    assert fastq.read_fastq(spark, str(tmp_path)).count() == 9
    assert fastq.concatenated([got.where("file like '%a.fastq'")] * 2).agg(F.max("read_idx")).first()[0] == 6
    assert files.checksum(spark, f"{tmp_path}/a.fastq").first().md5sum == hashlib.md5(text).hexdigest()
    assert files.checksum(spark, f"{tmp_path}/a.fastq", "blake2b").first().md5sum == hashlib.blake2b(text).hexdigest()
    assert files.merge([f"{tmp_path}/a.fastq"] * 2, f"{tmp_path}/c") == 2 * len(text)
    with pytest.raises(FileExistsError):
        files.merge([f"{tmp_path}/a.fastq"], f"{tmp_path}/c")
    (tmp_path / "bad.fastq").write_text("@h\nAC\n+\nI\n")
    with pytest.raises(Exception, match="not a record"):
        spark.read.format("fastq").load(f"{tmp_path}/bad.fastq").count()


def test_large_file_is_read_in_parts(spark, tmp_path):
    """A sparse file of over 2 GB."""
    with open(tmp_path / "big", "wb") as f:
        f.truncate((1 << 31) + 10)
    h = hashlib.md5()
    for _ in range(1 << 7):
        h.update(bytes(1 << 24))
    h.update(bytes(10))
    r = files.checksum(spark, f"{tmp_path}/big").first()
    assert (r.md5sum, r.filesize) == (h.hexdigest(), (1 << 31) + 10)


def test_counts_and_lists(spark, tmp_path):
    text = "".join(f"@{h}\n{s}\n+\n{q}\n" for h, s, q in [READ] * 3)
    (tmp_path / "a.fastq").write_text(text)
    assert [(r.guess, r.filesize) for r in files.read_counts(spark, f"{tmp_path}/a.fastq").collect()] == [(len(text), len(text))]
    assert [r.n for r in files.exact_read_counts(fastq.read_fastq(spark, f"{tmp_path}/a.fastq")).collect()] == [3]
    (tmp_path / "l.txt").write_text("# a comment\n\nName one\t\tACGT\nno tab\nTwo\tGG\n")
    assert lists.read_list(spark, f"{tmp_path}/l.txt") == [("Name one", "ACGT"), ("Two", "GG")]


def test_exponential_widths(spark):
    width = lambda p, n: spark.range(1).select(bins.exponential_width(F.lit(p), F.lit(n))).first()[0]
    assert [width(p, n) for p, n in ((5, 60), (10, 60), (9, 100), (10, 100), (50, 150), (50, 250), (100, 400), (500, 1500), (1000, 2500))] == [1, 1, 1, 5, 5, 10, 50, 100, 500]


def test_command_line(spark, tmp_path, monkeypatch):
    """A report on a real file, through the command line's own entry."""
    import runpy
    import sys

    reads = [("A00:1:F:1:1101:%d:1" % i, READ[1], READ[2]) for i in range(120)]
    (tmp_path / "x.y.fastq").write_text("".join(f"@{h}\n{s}\n+\n{q}\n" for h, s, q in reads))
    monkeypatch.setattr(sys, "argv", ["baseloom", "merge", "-o", str(tmp_path / "m.fastq"), str(tmp_path / "x.y.fastq"), str(tmp_path / "x.y.fastq")])
    runpy.run_module("baseloom", run_name="__main__")
    assert (tmp_path / "m.fastq").read_text().count("@A00") == 240
    monkeypatch.setattr(sys, "argv", ["baseloom", "metrics", "-o", str(tmp_path), "-m", "blake2b", "--kmer-isi", "10", str(tmp_path / "x.y.fastq")])
    runpy.run_module("baseloom", run_name="__main__")
    body = json.loads((tmp_path / "x.json").read_text())
    assert body["filemeta"]["md5sum"] == hashlib.blake2b((tmp_path / "x.y.fastq").read_bytes()).hexdigest()
    assert body["fastqc"]["basic_stats"]["total_reads"] == 120 and body["fastqc"]["overrepresented_seqs"]["overrepresented_seqs"][0]["count"] == 120


def test_patterns(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("0|0|" + "A" * 21 + "\t0|1|" + "C" * 21 + "\n2|0|" + "G" * 21 + "\n")
    lists.build_patterns(spark, f"{tmp_path}/p.tsv").write.json(f"{tmp_path}/p.json")
    patterns, universe = lists.read_patterns(spark, f"{tmp_path}/p.json")
    assert (patterns.count(), sorted(map(tuple, universe.collect()))) == (3, [(0, True), (1, False), (2, True)])


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_vaf_counts_equal_plain_search(spark, threshold):
    """whole counts where patterns overlap, repeat, begin and end reads, by broadcast and by shuffle."""
    draw = random.Random(7)
    texts = ["".join(draw.choices("AC", (30, 1), k=draw.randint(0, 75))) for _ in range(300)] + ["A" * n for n in range(15, 80)]
    texts += ["".join(draw.choices("ACGT", k=100)) for _ in range(50)] + ["n" * 20 + "N" * 30, None, ""]
    given = [("A" * 21, 0, 0), ("A" * 10 + "C" + "A" * 10, 0, 1), ("C" + "A" * 20, 1, 0), ("A" * 20 + "C", 1, 0), ("A" * 21, 2, 1), ("A" * 20, 3, 0), ("N" * 21, 3, 1)]
    given += [(t[i : i + 21], 4 + j % 3, j % 2) for j, (t, i) in enumerate(zip(texts[365:415], range(0, 80), strict=False))] + [(texts[370][79:], 9, 0), (texts[371][:21], 9, 1)]
    reads, patterns = frame(spark, [("h", t, None) for t in texts]), spark.createDataFrame(given, "kmer string, snp_idx int, allele int")
    hits = [(r, s, a) for r, t in enumerate(texts) for i in range(len(t or "") - 20) for k, s, a in given if t[i : i + 21] == k]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        for per_read in (False, True):
            want = Counter((s, a) for _, s, a in (set(hits) if per_read else hits))
            assert {(r.snp_idx, r.allele): r.n for r in matching.vaf_counts(reads, patterns, per_read).collect()} == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_vaf_counts_make_few_rows(spark):
    """a read without a pattern makes a row for each of its blocks, not for each 21-mer."""
    draw = random.Random(8)
    reads = frame(spark, [("h", "".join(draw.choices("CGT", k=100)), None) for _ in range(500)])
    patterns = spark.createDataFrame([("A" * 21, 0, 0), ("AC" * 10 + "A", 0, 1)], "kmer string, snp_idx int, allele int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = matching.vaf_counts(reads, patterns)
        assert df.collect() == []
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    made, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Generate":
            made += node.metrics().get("numOutputRows").get().value()
    assert made < 500 * 12


def test_vaf_makes_what_it_reads(spark):
    """the query makes the reads' columns that it needs, over all tasks, and keeps none; lists of a few rows are broadcast."""
    d = SF.replace("/testdata", "/./testdata")  # a path whose reads are not kept
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        plan = registry.q_vaf(spark, d)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("BroadcastHashJoin") >= 2 and "InMemoryTableScan" not in plan and "concat(q" not in plan
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    spread, kept = fixtures.reads_once(spark, d), fixtures.reads(spark, d)
    try:
        assert spread.rdd.getNumPartitions() == 7 and spread.exceptAll(kept).count() == 0 and spread.count() == kept.count()
        assert fixtures.reads_once(spark, d) is kept  # a query that finds them uses them
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        kept.unpersist()


def test_report(spark, tmp_path):
    out = report(fixtures.reads(spark, SF), Config(which="fastqc"))
    written = files.write_reports(out.withColumn("file", F.lit("x/y.a.fastq")), str(tmp_path))
    body = json.loads(open(written[0]).read())
    assert written[0].endswith("/y.json") and body["filemeta"] is None
    assert list(body["fastqc"]) == "basic_stats per_base_seq_quality per_seq_quality_score per_base_seq_content per_seq_gc_content per_base_n_content seq_len_distribution overrepresented_seqs seq_duplication_level adapter_content kmer_content per_tile_quality_score".split()
    assert body["fastqc"]["basic_stats"]["total_reads"] == 1500
    assert len(body["fastqc"]["per_tile_quality_score"]["tiles"]) == 12 and len(body["fastqc"]["adapter_content"]["enrichments"]) == 5


def test_streaming(spark, tmp_path):
    from baseloom.streaming import incremental

    reads = fixtures.reads(spark, SF)
    reads.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    incremental.start(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    got = incremental.cube(spark, f"{tmp_path}/out", "bases").exceptAll(cubes.base_cube(reads).select("file", "pos", "base", "n"))
    assert got.count() == 0


def test_limits():
    assert (Config(tracked=0).limit(), Config(tracked=0, compat=True).limit(), Config().limit()) == (None, 61, 100_000)
