"""Line deduplication: keep bitmaps from a range-partitioned stream of line hashes.

Lines become (128-bit key hash, doc_id, position) rows. They are range-partitioned by (hash, doc_id), so that a
line which a third of all documents hold is dealt over many partitions, and sorted by hash, then doc_id from the
largest, then position. One pass over each partition streams the sorted rows: the first document of a run is the one
that keeps its lines, the lines of the others are dropped as soon as a third document is seen. Only the first and
the last run of a partition can go on in a neighbour: of these, the undecided lines (of two documents at most) and
one summary row are returned, and a join on the summaries decides them. The result is a compressed bitmap for each
document, no text.

Defined cases. Null or empty text: one empty line, kept. Null doc_id: the row takes no part in counting and keeps all
lines. Rows with the same doc_id count as one document; each row gets its own bitmap (rows are told apart by doc_id
and a hash of the text). Empty table: no rows. Other columns are ignored or, by
`deduped`, returned, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_bytes, tidy

LINES = "h1 long, h2 long, doc_id long, fp long, pos int"
DECIDED = "kind int, h1 long, h2 long, doc_id long, fp long, pos int, n_docs long"
DROP, OPEN, SUMMARY = 0, 1, 2


def _line_rows(min_chars: int):
    def rows(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        digest = xxhash.xxh3_128_digest
        for b in batches:
            ids, fps = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            for lo in range(0, len(ids), 512):
                keys, at, pos = [], [], []
                for i, text in enumerate(text_bytes(b.column(2).slice(lo, 512)), lo):
                    for j, line in enumerate(text.split(b"\n")):
                        key = line.strip().lower()  # of bytes: exactly the white space and letters asked for
                        n = len(key)
                        if n >= min_chars and (n >= 4 * min_chars or len(key.decode()) >= min_chars):
                            keys.append(digest(key))
                            at.append(i)
                            pos.append(j)
                if keys:
                    h = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
                    cols = [h[:, 0], h[:, 1], ids[at], fps[at], np.array(pos, "i4")]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], ["h1", "h2", "doc_id", "fp", "pos"])

    return rows


class _Run:
    """The lines of one key in one partition, arriving by doc_id from the largest."""

    def __init__(self, key, first: bool):
        self.key, self.first, self.keeper, self.last, self.n = key, first, None, None, 0
        self.kept, self.held = [], []  # the keeper's rows; rows of a second document until a third is seen

    def add(self, doc, fp, pos, need: int) -> list:
        """Rows that are certainly dropped."""
        import numpy as np

        if self.keeper is None:
            self.keeper = self.last = doc[0]
            self.n = 1
        self.n += int(doc[0] != self.last) + int(np.count_nonzero(doc[1:] != doc[:-1]))
        self.last = doc[-1]
        own = doc == self.keeper
        if own.any():
            self.kept.append((doc[own], fp[own], pos[own]))
        if not own.all():
            self.held.append((doc[~own], fp[~own], pos[~own]))
        if self.n < need:
            return []
        out, self.held = self.held, []
        return out


def _decide(need: int):
    def decide(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        names = ["kind", "h1", "h2", "doc_id", "fp", "pos", "n_docs"]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

        def made(kind, rows, key=(None, None), n=None):
            doc, fp, pos = (np.concatenate(x) for x in zip(*rows, strict=True))
            fill = [[kind] * len(doc), [key[0]] * len(doc), [key[1]] * len(doc), doc, fp, pos, [n] * len(doc)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(fill, types, strict=True)], names)

        def closed(run, edge):
            if edge or run.first:
                yield made(OPEN, run.kept + run.held, run.key)
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip([SUMMARY, *run.key, run.keeper, None, None, run.n], types, strict=True)], names)

        run, first = None, True
        for b in batches:
            h1, h2, doc, fp, pos = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            if not len(h1):
                continue
            new = np.empty(len(h1), bool)
            new[0] = True
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            starts = np.append(np.flatnonzero(new), len(h1))
            drops = []
            lo = 0  # of runs; the first may go on from the batch before, the last into the next
            key = (int(h1[0]), int(h2[0]))
            if run is None or run.key != key:
                if run is not None:
                    yield from closed(run, False)
                run, first = _Run(key, first), False
            drops += run.add(doc[: starts[1]], fp[: starts[1]], pos[: starts[1]], need)
            if len(starts) > 2:
                yield from closed(run, False)
                lo, hi = starts[1], starts[-2]
                if hi > lo:  # runs wholly inside this batch
                    inner = np.flatnonzero(new[lo:hi]) + lo
                    of = np.cumsum(new[lo:hi]) - 1
                    other = np.zeros(hi - lo, np.int64)
                    other[1:] = (doc[lo + 1 : hi] != doc[lo : hi - 1]) & ~new[lo + 1 : hi]
                    n = 1 + np.bincount(of, weights=other, minlength=len(inner))
                    gone = (n[of] >= need) & (doc[lo:hi] != doc[inner][of])
                    if gone.any():
                        drops.append((doc[lo:hi][gone], fp[lo:hi][gone], pos[lo:hi][gone]))
                run = _Run((int(h1[hi]), int(h2[hi])), False)
                drops += run.add(doc[hi:], fp[hi:], pos[hi:], need)
            if drops:
                yield made(DROP, drops)
        if run is not None:
            yield from closed(run, True)

    return decide


def _bitmaps(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for b in batches:
        keep = []
        for n, gone in zip(b.column("n_lines").to_pylist(), b.column("gone").to_pylist(), strict=True):
            bits = np.ones(n, np.uint8)
            if gone:
                bits[gone] = 0
            keep.append(zlib.compress(np.packbits(bits).tobytes(), 1))
        cols = [b.column("doc_id"), b.column("fp"), b.column("n_lines"), b.column("n_dropped"), pa.array(keep, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "fp", "n_lines", "n_dropped", "keep"])


def line_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, fp, n_lines, n_dropped, keep) for each row of docs: keep is a zlib-compressed bit array, a bit a line."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("fp"), F.col("text").alias("text"))
    lines = docs.where("doc_id is not null and text is not null").mapInArrow(tidy(_line_rows(min_chars)), LINES)
    lines = stored(lines, "line-rows")  # the range partitioner reads them twice
    ordered = lines.repartitionByRange("h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", F.desc("doc_id"), "pos")
    decided = stored(ordered.mapInArrow(tidy(_decide(min_docs)), DECIDED), "line-dedup")
    whole = decided.where(F.col("kind") == SUMMARY).groupBy("h1", "h2").agg(F.sum("n_docs").alias("n"), F.max("doc_id").alias("keeper"))
    late = decided.where(F.col("kind") == OPEN).select("h1", "h2", "doc_id", "fp", "pos").join(whole, ["h1", "h2"]).where((F.col("n") >= min_docs) & (F.col("doc_id") != F.col("keeper")))
    gone = decided.where(F.col("kind") == DROP).select("doc_id", "fp", "pos").union(late.select("doc_id", "fp", "pos"))
    gone = gone.groupBy("doc_id", "fp").agg(F.collect_set("pos").alias("gone"))
    text = F.coalesce("text", F.lit(""))
    counts = docs.select("doc_id", "fp", (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"))
    g = gone.select(F.col("doc_id").alias("g_id"), F.col("fp").alias("g_fp"), "gone")
    full = counts.join(g, (F.col("doc_id") == F.col("g_id")) & (F.col("fp") == F.col("g_fp")), "left")
    full = full.select("doc_id", "fp", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    full = full.withColumn("n_dropped", F.when(F.col("n_dropped") < 0, 0).otherwise(F.col("n_dropped")).cast("long"))
    return full.mapInArrow(_bitmaps, "doc_id long, fp long, n_lines long, n_dropped long, keep binary")


def kept_lines(text: bytes, keep: bytes | None) -> bytes:
    """The text that a bitmap leaves; all of it without one."""
    import numpy as np

    if keep is None:
        return text
    lines = text.split(b"\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return b"\n".join([x for x, bit in zip(lines, bits.tolist(), strict=True) if bit])


def _apply(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        out = [kept_lines(t, k) for t, k in zip(text_bytes(b.column("text_in")), b.column("keep").to_pylist(), strict=True)]
        cols = {n: b.column(n) for n in b.schema.names if n not in ("text_in", "keep")}
        cols["kept_text"] = pa.array(out, pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


def with_kept_text(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs' columns but text, whatever their names, each as `_d_` and its name; and kept_text, n_lines and n_dropped."""
    from pyspark.sql import types as T

    only = bitmaps.where("n_dropped > 0").dropDuplicates(["doc_id", "fp"]).select(*(F.col(c).alias(f"_b_{c}") for c in ("doc_id", "fp", "n_dropped", "keep")))
    rest = [c for c in docs.columns if c != "text"]
    left = docs.select(*(F.col(f"`{c}`").alias(f"_d_{c}") for c in rest), F.col("text").alias("text_in"), F.xxhash64("text").alias("_fp"))
    # rows without an id join nothing, and are dealt by their texts
    key = F.coalesce(F.col("_d_doc_id").cast("long"), F.col("_fp"))
    both = left.join(only, (key == F.col("_b_doc_id")) & (F.col("_fp") == F.col("_b_fp")) & F.col("_d_doc_id").isNotNull(), "left")
    plain = F.coalesce("text_in", F.lit(""))
    n_lines = (F.length(plain) - F.length(F.replace(plain, F.lit("\n"), F.lit(""))) + 1).cast("long")
    both = both.select(*(F.col(f"`_d_{c}`") for c in rest), "text_in", F.col("_b_keep").alias("keep"), F.coalesce("_b_n_dropped", F.lit(0)).cast("long").alias("n_dropped"), n_lines.alias("n_lines"))
    schema = T.StructType([f for f in both.schema.fields if f.name not in ("text_in", "keep")] + [T.StructField("kept_text", T.StringType())])
    return both.mapInArrow(tidy(_apply), schema)


def deduped(docs: DataFrame) -> DataFrame:
    """docs without their repeated lines, in docs' columns; an n_chars column follows the text."""
    done = with_kept_text(docs, line_bitmaps(docs))
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return done.select(*(new[c].alias(c) if c in new else F.col(f"`_d_{c}`").alias(c) for c in docs.columns))


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = with_kept_text(docs, line_bitmaps(docs))
    return done.select(F.col("_d_doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP2_SQL = r"""
with lines as (
  select doc_id, u.line as line, u.pos as pos,
    translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {'line': x, 'pos': i})) as u from documents)),
k as (select k, max(doc_id) as keeper from lines where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
m as (select l.*, coalesce(l.doc_id <> k.keeper, false) as gone from lines l left join k using (k))
select doc_id, cast(count(*) as bigint) as n_lines, cast(count_if(gone) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from m group by doc_id
"""
