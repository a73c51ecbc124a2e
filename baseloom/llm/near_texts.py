"""Near copies by shingle similarity: operator 6 with wide fingerprints, each group checked on the whole shingle sets.

Words are runs outside white space with A-Z lower-cased; shingles have five words (a shorter text is one shingle). Two texts
are linked where the Jaccard similarity of their shingle sets (64-bit hashes) is 0.8 at least. Texts of equal sets are one
class from the start.

Candidates come from SimHash fingerprints of LANES x 64 bits over the set, compared exactly by tiles (`simhash.forest`). Classes are sorted
by set size, and only tiles whose sizes can be 0.8 of each other are compared. Of two sets at similarity s, about
arccos(2s / (1 + s)) / pi of the bits differ; radii() allows a quarter more and four standard deviations, in the first lane and in all.
So a link at 0.8 is missed with a probability below 1e-4 (small sets; less else), which is SimHash's only loss. Comparing is
quadratic in the number of classes of like size, as the method is.

The classes that candidates connect are clusters; these are superset of the true groups. Every member is compared with its
cluster's pivot, by a join that is salted for large clusters; that resolves all clusters but those with members which are not like the
pivot. Their members are cut into blocks by group, and pairs of blocks of different groups are compared, until the groups
link. So many copies of one text cost one comparison each, no task holds a whole cluster, and no link between candidates of one cluster is lost.

Memory: two blocks of BLOCK_BYTES (or two sets, 8 bytes a word, where they are larger).

Defined cases. Null or empty text: the empty set, equal to any other such. Null doc_id: a row like any other; it gives a
component its id only if nobody else does (null). Repeated rows and doc_ids: one result row for each. Empty table: no rows. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, pi, sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import stored, text_bytes, tidy
from .components import components

WORDS, SIMILAR, LANES, TILE = 5, 0.8, 4, 1 << 15
MEMBERS_A_SALT, BLOCK, BLOCK_BYTES = 1000, 256, 1 << 22


def radii(similar: float, lanes: int) -> tuple[int, int]:
    p = 1.25 * acos(2 * similar / (1 + similar)) / pi
    return tuple(ceil(bits * p + 4 * sqrt(bits * p * (1 - p))) for bits in (64, 64 * lanes))


def shingle_hashes(text: bytes, n: int = WORDS):
    """The sorted distinct hashes of a text's shingles."""
    import numpy as np
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    xxh, join = xxhash.xxh3_64_intdigest, b" ".join
    if len(words) < n:
        return np.array([xxh(join(words))], np.uint64)
    return np.unique(np.fromiter(map(xxh, map(join, zip(*(words[k:] for k in range(n)), strict=False))), np.uint64, len(words) - n + 1))


def mixed(h, lanes: int):
    """rows x lanes of values as good as independent for each lane."""
    import numpy as np

    z = h[:, None] + np.arange(1, lanes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _sketches(n: int, lanes: int):
    def sketches(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                classes, sizes, fps = [], [], []
                for text in text_bytes(part.column(2)):
                    h = shingle_hashes(text, n)
                    classes.append(xxhash.xxh3_64_intdigest(h.tobytes()))
                    sizes.append(len(h))
                    fps.append(simhash.majority(mixed(h, lanes)).tobytes())
                cols = [part.column(0), part.column(1), pa.array(np.array(classes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(fps, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "fp", "class", "size", "fps"])

    return sketches


def _sets(n: int):
    def sets(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                hashes = [shingle_hashes(t, n).tobytes() for t in text_bytes(part.column(0))]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(hashes, pa.binary())], ["cluster", "class", "salts", "hashes"])

    return sets


def linked(x, y, similar: float) -> bool:
    """Whether two sorted arrays without repeats have a Jaccard similarity of `similar` at least."""
    import numpy as np

    n, m = len(x), len(y)
    if min(n, m) < similar * max(n, m) - 1e-9:
        return False
    both = np.concatenate((x, y))
    both.sort()
    k = int(np.count_nonzero(both[1:] == both[:-1]))
    return k >= similar * (n + m - k) - 1e-9


def _by_pivot(similar: float):
    def by_pivot(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            label = []
            for cluster, own, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                label.append(cluster if linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), similar) else own)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(label, pa.int64())], ["cluster", "class", "label"])

    return by_pivot


def _blocks(rows: int, size: int):
    """Rows sorted by (cluster, label): (cluster, label, hashes) to blocks of one cluster each; `pure` is a block's only label."""

    def blocks(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        number, held, cluster, n = TaskContext.get().partitionId() << 32, [], None, 0

        def block():
            labels = [x for x, _ in held]
            one = [[number], [cluster], [labels[0] if labels[0] == labels[-1] else None], [labels], [[h for _, h in held]]]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(one, types, strict=True)], ["tile", "cluster", "pure", "labels", "sets"])

        for b in batches:
            for c, label, hashes in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (c != cluster or len(held) >= rows or n + len(hashes) > size):
                    yield block()
                    held, n, number = [], 0, number + 1
                cluster = c
                held.append((label, hashes))
                n += len(hashes)
        if held:
            yield block()

    return blocks


def across(one: list[tuple], other: list[tuple] | None, similar: float) -> list[tuple]:
    """Links (label, label) between (label, sorted hashes) members of two blocks, or of one; what is linked is not compared again."""
    root: dict[int, int] = {}

    def of(k):
        while k in root:
            k = root[k]
        return k

    out = []
    for i, (a, x) in enumerate(one):
        for b, y in one[:i] if other is None else other:
            if (p := of(a)) != (q := of(b)) and linked(x, y, similar):
                root[max(p, q)] = min(p, q)
                out.append((a, b))
    return out


def _across(similar: float):
    def links(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            out = []
            for k in range(b.num_rows):
                la, sa, lb, sb = (c[k].as_py() for c in b.columns)
                one, other = ([(x, np.frombuffer(h, np.uint64)) for x, h in zip(labels, sets, strict=True)] if labels is not None else None for labels, sets in ((la, sa), (lb, sb)))
                out += across(one, other, similar)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return links


def size_pairs(tiles: DataFrame, similar: float) -> DataFrame:
    """(a, b): numbers of the tile pairs with sizes that can be similar, each once: b in the bin of its least size, a in all it reaches."""
    step = sqrt(1 / similar)
    bin_of = lambda c: F.floor(F.log(F.greatest(c.cast("double"), F.lit(1.0))) / F.log(F.lit(step))).cast("int")
    reach = F.sequence(bin_of(F.col("low")), bin_of(F.col("high") / similar + 1))
    salts = F.explode(F.array(*map(F.lit, range(simhash.SALTS))))
    asked = tiles.select(F.col("tile").alias("a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"), F.explode(reach).alias("bin")).select("*", salts.alias("salt"))
    other = tiles.select(F.col("tile").alias("b"), F.col("low").alias("low_b"), bin_of(F.col("low")).alias("bin"), F.pmod(F.xxhash64("tile"), F.lit(simhash.SALTS)).cast("int").alias("salt"))
    after = (F.col("low_b") > F.col("low_a")) | ((F.col("low_b") == F.col("low_a")) & (F.col("b") >= F.col("a")))
    return asked.join(other.hint("merge"), ["bin", "salt"]).where(after & (F.col("low_b") * similar <= F.col("high_a") + 1e-6)).select("a", "b")


def groups(docs: DataFrame, similar: float = SIMILAR, n_words: int = WORDS, tile: int = TILE, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): rows has (doc_id, fp, class) for each row of docs, fp the xxhash64 of its text; groups (class, label) for the classes in groups of two or more."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("fp"), F.col("text").alias("text"))
    own = stored(texts.mapInArrow(tidy(_sketches(n_words, LANES)), "doc_id long, fp long, class long, size int, fps binary"), "near-sketches")
    classes = stored(own.groupBy("class").agg(F.min(F.struct("doc_id", "fp")).alias("first"), F.first("size").alias("size"), F.first("fps").alias("fps")), "near-classes")
    ordered = classes.select("size", "class", "fps").repartitionByRange("size", "class").sortWithinPartitions("size", "class")
    tiles = stored(ordered.mapInArrow(simhash.cut_tiles(tile, LANES, False), simhash.TILES), "near-tiles")
    found = components(simhash.compared(tiles, size_pairs(tiles, similar), radii(similar, LANES), LANES, similar))
    counts = found.groupBy("root").agg(F.ceil(F.count("*") / MEMBERS_A_SALT).cast("int").alias("salts"))
    members = classes.select("class", F.col("first.doc_id").alias("m_id"), F.col("first.fp").alias("m_fp")).join(found.select(F.col("node").alias("class"), F.col("root").alias("cluster")), "class")
    members = stored(members.join(counts.withColumnRenamed("root", "cluster"), "cluster"), "near-members")
    # one text of each class that has candidates; one plan at every size: texts are dealt, never sorted, and meet a hash table of narrow rows
    wanted = texts.join(members.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("fp") == F.col("m_fp"))).select("text", "cluster", "class", "salts")
    sets = stored(wanted.mapInArrow(tidy(_sets(n_words)), "cluster long, class long, salts int, hashes binary"), "near-sets")
    salt = F.pmod(F.xxhash64("class"), F.col("salts")).cast("int")
    pivots = sets.where("class = cluster").dropDuplicates(["class"]).select(F.col("cluster").alias("p_cluster"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("p_salt"), F.col("hashes").alias("pivot"))
    met = sets.withColumn("salt", salt).join(pivots.hint("merge"), (F.col("cluster") == F.col("p_cluster")) & (F.col("salt") == F.col("p_salt"))).select("cluster", "class", "hashes", "pivot")
    labels = stored(met.mapInArrow(tidy(_by_pivot(similar)), "cluster long, class long, label long").distinct(), "near-labels")
    # clusters with members unlike the pivot, where these may be like others
    open_ = labels.groupBy("cluster").agg(F.count_if(F.col("label") != F.col("cluster")).alias("off"), F.count("*").alias("n")).where("off > 0 and n > 2").select("cluster")
    rest = labels.join(open_, "cluster", "left_semi").select(F.col("class").alias("l_class"), "label").join(sets, F.col("l_class") == F.col("class"))
    rest = rest.select("cluster", "label", "hashes").repartitionByRange("cluster", "label", F.xxhash64("hashes")).sortWithinPartitions("cluster", "label")
    cut = stored(rest.mapInArrow(_blocks(block, BLOCK_BYTES), "tile long, cluster long, pure long, labels array<long>, sets array<binary>"), "near-blocks")
    salts = F.explode(F.array(*map(F.lit, range(simhash.SALTS))))
    asked = cut.select(F.col("tile").alias("a"), "cluster", F.col("pure").alias("pure_a"), salts.alias("salt"))
    other = cut.select(F.col("tile").alias("b"), "cluster", F.col("pure").alias("pure_b"), F.pmod(F.xxhash64("tile"), F.lit(simhash.SALTS)).cast("int").alias("salt"))
    pairs = asked.join(other.hint("merge"), ["cluster", "salt"]).where("a <= b and not coalesce(pure_a = pure_b, false)").select("a", F.when(F.col("a") != F.col("b"), F.col("b")).alias("b"))
    content = lambda k: cut.select(F.col("tile").alias(k), F.col("labels").alias(f"labels_{k}"), F.col("sets").alias(f"sets_{k}"))
    more = pairs.join(content("a").hint("merge"), "a").join(content("b").hint("merge"), "b", "left").select("labels_a", "sets_a", "labels_b", "sets_b").mapInArrow(tidy(_across(similar)), "a long, b long")
    joined = components(more).select(F.col("node").alias("label"), "root")
    return own.select("doc_id", "fp", "class"), labels.join(joined, "label", "left").select("class", F.coalesce("root", "label").alias("label"))


def near_texts(docs: DataFrame, similar: float = SIMILAR, n_words: int = WORDS, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """(doc_id, component_id) for each row: component_id is the smallest doc_id reachable over links."""
    rows, labels = groups(docs, similar, n_words, tile, block)
    classes = rows.groupBy("class").agg(F.min("doc_id").alias("first_id")).join(labels, "class", "left").select("class", "first_id", F.coalesce("label", "class").alias("label"))
    least = classes.groupBy("label").agg(F.min("first_id").alias("component_id"))
    return rows.join(classes.select("class", "label"), "class").join(least, "label").select("doc_id", "component_id")


def first_rows(docs: DataFrame, similar: float = SIMILAR, n_words: int = WORDS) -> DataFrame:
    """One row of each group of near copies, all columns: that of the smallest doc_id (null last), then of the smallest text hash; of equal such rows any one."""
    rows, labels = groups(docs, similar, n_words)
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")
    classes = rows.groupBy("class").agg(F.min(key).alias("first")).join(labels, "class", "left")
    keep = classes.groupBy(F.coalesce("label", "class").alias("label")).agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("k_id"), F.col("first.fp").alias("k_fp"))
    same = rows.groupBy("doc_id", "fp").agg(F.count("*").alias("n"))
    keep = keep.join(same, F.col("k_id").eqNullSafe(F.col("doc_id")) & (F.col("k_fp") == F.col("fp"))).select("k_id", "k_fp", "n")
    keep = stored(keep, "near-kept")

    def of(part: DataFrame) -> DataFrame:
        named = docs.select(*(F.col(f"`{c}`").alias(f"_d_{c}") for c in docs.columns))
        at = F.col("_d_doc_id").cast("long").eqNullSafe(F.col("k_id")) & (F.xxhash64("_d_text") == F.col("k_fp"))
        return named.join(part.hint("shuffle_hash"), at, "left_semi")

    out = of(keep.where("n = 1"))
    if not keep.where("n > 1").isEmpty():
        out = out.union(of(keep.where("n > 1")).withColumn("_k_fp", F.xxhash64("_d_text")).dropDuplicates(["_d_doc_id", "_k_fp"]).drop("_k_fp"))
    return out.select(*(F.col(f"`_d_{c}`").alias(c) for c in docs.columns))
