"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

Words are runs outside white space with A-Z lower-cased; shingles have five words (a shorter text is one shingle). A
test item with n distinct shingles leaks into a document that holds at least 0.8 n of them, wherever they stand. So an item of under
five words is found in a document of just these words, not inside longer ones.

Items are partitioned by size (classes of powers of two), each with an index of its own. An item's MinHash sketch holds the smallest hashes of
its shingles, as many as its class's largest item could miss and one more; a document that holds 0.8 of the item therefore holds one of the sketch,
so the search is complete. A document asks the classes whose least item it is long enough to hold. Found pairs are verified by
counting equal shingles as strings.

The items are a stated query set: they go to the executors in blocks of a bounded number of shingles, one at a time: a block is broadcast, held
against every document by one scan, its findings are written and it is freed. Documents are read whole and never shuffled.

Defined cases. Null or empty item or document: no shingles, never a match. Null ids: a document without doc_id is
reported with a null id; items likewise. Repeated rows: reported once for each document row; items with the same id
and text count once. Empty tables: no rows. Other columns are ignored or, by `clean`, returned, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, text_bytes, tidy

WORDS, SHARE = 5, 0.8
BLOCK_SHINGLES = 500_000
FOUND = "doc_id long, fp long, item_id long, n_shingles long, n_found long"


def shingles(text: bytes, n: int = WORDS) -> list[bytes]:
    words = text.lower().split()
    return [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []


def _sketches(items: list[tuple], share: float, n_words: int) -> list[tuple]:
    """For each size class (the least number of shingles a document needs, sorted sketch hashes, their items' numbers)."""
    import numpy as np
    import xxhash

    classes: dict[int, tuple[list, list]] = {}
    for k, (_, text) in enumerate(items):
        own = sorted({xxhash.xxh3_64_intdigest(s) for s in shingles(text, n_words)})
        size = len(own).bit_length()
        upper = (1 << size) - 1  # the largest size in the class
        take = upper - ceil(share * upper - 1e-9) + 1
        hashes, owners = classes.setdefault(size, ([], []))
        hashes += own[:take]
        owners += [k] * min(take, len(own))
    out = []
    for size, (hashes, owners) in sorted(classes.items()):
        order = np.argsort(np.array(hashes, np.uint64), kind="stable")
        out.append((ceil(share * (1 << size - 1) - 1e-9), np.array(hashes, np.uint64)[order], np.array(owners, np.int64)[order]))
    return out


def _scan(shared, share: float, n_words: int):
    def scan(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        items, classes = shared.value
        parts = [set(shingles(t, n_words)) for _, t in items]
        mask = np.uint64((1 << 22) - 1)
        seen = np.zeros(1 << 22, bool)
        for _, hashes, _ in classes:
            seen[(hashes & mask).astype(np.int64)] = True
        xxh, join = xxhash.xxh3_64_intdigest, b" ".join
        for b in batches:
            out = []
            ids, fps = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo in range(0, b.num_rows, 64):
                for i, text in enumerate(text_bytes(b.column(2).slice(lo, 64)), lo):
                    words = text.lower().split()
                    if not words:
                        continue
                    own = shingles(text, n_words) if len(words) < n_words else [join(t) for t in zip(*(words[k:] for k in range(n_words)), strict=False)]
                    h = np.fromiter(map(xxh, own), np.uint64, len(own))
                    h = h[seen[(h & mask).astype(np.int64)]]
                    if not len(h):
                        continue
                    maybe: set[int] = set()
                    for least, hashes, owners in classes:
                        if least > len(own):
                            break
                        at, end = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
                        for k in np.flatnonzero(end > at).tolist():
                            maybe.update(owners[at[k] : end[k]].tolist())
                    if maybe:
                        own = set(own)
                        for k in sorted(maybe):
                            n, got = len(parts[k]), len(parts[k] & own)
                            if got >= share * n - 1e-9:
                                out.append((ids[i], fps[i], items[k][0], n, got))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], [c.split()[0] for c in FOUND.split(", ")])

    return scan


def _blocks(items: Iterator[tuple], limit: int) -> Iterator[list[tuple]]:
    block, n = [], 0
    for item in items:
        m = len(item[1].split())
        if block and n + m > limit:
            yield block
            block, n = [], 0
        block.append(item)
        n += m
    if block:
        yield block


def _found(docs: DataFrame, items: DataFrame, share: float, n_words: int, block: int) -> DataFrame:
    """leaks() with fp, the xxhash64 of the document's text."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("fp"), F.col("text").alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).where("text is not null").distinct()
    rows = ((r.item_id, r.text.encode()) for r in items.orderBy("item_id", "text").toLocalIterator() if r.text.encode().split())
    path = new_path(spark, "leaks")
    spark.createDataFrame([], FOUND).write.parquet(path)
    for part in _blocks(rows, block):
        shared = spark.sparkContext.broadcast((part, _sketches(part, share, n_words)))
        docs.mapInArrow(tidy(_scan(shared, share, n_words)), FOUND).write.mode("append").parquet(path)
        shared.destroy()
    return spark.read.schema(FOUND).parquet(path)


def leaks(docs: DataFrame, items: DataFrame, share: float = SHARE, n_words: int = WORDS, block: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found): each item of which a document holds at least the share."""
    return _found(docs, items, share, n_words, block).drop("fp")


def clean(docs: DataFrame, items: DataFrame, share: float = SHARE, n_words: int = WORDS, block: int = BLOCK_SHINGLES) -> DataFrame:
    """The rows of docs that hold no item, all columns; rows are told apart by doc_id (null equals null) and text."""
    found = _found(docs, items, share, n_words, block).select(F.col("doc_id").alias("f_id"), F.col("fp").alias("f_fp")).distinct()
    named = docs.select(*(F.col(f"`{c}`").alias(f"_d_{c}") for c in docs.columns))
    same = F.col("_d_doc_id").cast("long").eqNullSafe(F.col("f_id")) & (F.xxhash64("_d_text") == F.col("f_fp"))
    return named.join(found, same, "left_anti").select(*(F.col(f"`_d_{c}`").alias(c) for c in docs.columns))


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP4_SQL = r"""
with d as (select doc_id as id, true as doc, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
  union all select item_id, false, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') from benchmark),
s as (select distinct id, doc, unnest(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) as g from d where len(w) > 0),
n as (select id, count(*) as n from s where not doc group by id),
m as (select a.id as doc_id, b.id as item_id, count(*) as k from s a join s b on a.g = b.g where a.doc and not b.doc group by all)
select m.doc_id, m.item_id, cast(n.n as bigint) as n_shingles, cast(m.k as bigint) as n_found from m join n on n.id = m.item_id where m.k >= 0.8 * n.n - 1e-9
"""
