"""SimHash near-duplicates by exact tiled comparison.

Each distinct fingerprint is kept once. Fingerprints are laid into cells by the population counts of their four
16-bit quarters and cut into tiles of bounded size. If two fingerprints differ in at most r bits, the population counts
of their quarters differ by at most r in total, so only tile pairs of such cells are compared (each pair once), with
numpy exclusive-or and bit counts, and no link is lost. Pairs of tiles are found by numbers alone, salted, as the middle
cells hold many tiles; the fingerprints are fetched for the pairs that remain. A tile pair returns a spanning forest of
its links, never all pairs: rows that are known to be of one component are not compared again. Components are then found on that table.

The comparison is quadratic within near cells, as the method is. `near_texts` uses the same tiles for wide fingerprints.

Defined cases. Null or empty text: fingerprint zero, linked like any other. Null doc_id: the row is returned with its
fingerprint and the component of that fingerprint, but gives no component its id (null if nobody else does). Repeated
rows and doc_ids: one result row for each. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_bytes, tidy
from .components import components

RADIUS, TILE = 2, 4096
SALTS, CELL_TILES = 16, 64
TILES = "tile long, low int, high int, ids binary, fps binary, sizes binary"


def fingerprint(text: bytes) -> int:
    """One text's fingerprint, as the contract words it; the plain form for tests."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def majority(h):
    """Bits set in over half the rows of h (rows x lanes of 64 bits), as one value a lane."""
    import numpy as np

    ones = np.zeros(64 * h.shape[1], np.int64)
    for at in range(0, len(h), 4096):
        part = np.ascontiguousarray(h[at : at + 4096])
        ones += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)


def _fingerprints(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa
    import xxhash

    xxh, join = xxhash.xxh64_intdigest, b" ".join
    for b in batches:
        out = []
        for lo in range(0, b.num_rows, 64):
            for text in text_bytes(b.column(1).slice(lo, 64)):
                words = text.lower().split()
                if not words:
                    out.append(0)
                    continue
                if len(words) < 3:
                    h = np.array([xxh(join(words), 42)], np.uint64)
                else:
                    h = np.fromiter((xxh(join(t), 42) for t in zip(words, words[1:], words[2:], strict=False)), np.uint64, len(words) - 2)
                out.append(int(majority(h[:, None])[0]))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(out, np.uint64).view(np.int64))], ["doc_id", "fp"])


def cut_tiles(size: int, lanes: int, by_cell: bool):
    """Rows sorted by (at, id): (at, id, fps or null) to tiles of at most `size` rows, with the least and largest `at`; by_cell: of one `at` each."""

    def tiles(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        parts, n = [], 0

        def tile():
            at, ids, fps = (np.concatenate(x) for x in zip(*parts, strict=True))
            one = lambda x, t: pa.array([x], t)
            cols = [one(number, pa.int64()), one(int(at[0]), pa.int32()), one(int(at[-1]), pa.int32()), one(ids.tobytes(), pa.binary()), one(fps.tobytes() if lanes > 1 else None, pa.binary()), one(None if by_cell else at.astype("<i4").tobytes(), pa.binary())]
            return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in TILES.split(", ")])

        for b in batches:
            if not b.num_rows:
                continue
            at, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            fps = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint64).reshape(-1, lanes) if lanes > 1 else ids
            cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)] if by_cell else [0, len(at)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                while lo < hi:
                    if n >= size or (n and by_cell and parts[-1][0][0] != at[lo]):
                        yield tile()
                        parts, n, number = [], 0, number + 1
                    take = min(hi - lo, size - n)
                    parts.append((at[lo : lo + take], ids[lo : lo + take], fps[lo : lo + take]))
                    n, lo = n + take, lo + take
        if n:
            yield tile()

    return tiles


def forest(x, y, radii: tuple, sizes=None, similar: float = 0.0):
    """(i, j): a spanning forest of the links between rows of x and rows of y (None: x itself), both rows x lanes.

    A link differs in radii[0] bits of the first lane at most, and in radii[-1] of all lanes. sizes: increasing sizes of the rows of
    x and of y; a link's lesser one is `similar` times the other at least. Rows of one label are linked already.
    """
    import numpy as np

    same, m = y is None, len(x)
    y = x if same else y
    label = np.arange(m if same else m + len(y))
    of_y = label if same else label[m:]
    y0, out = np.ascontiguousarray(y[:, 0]), []
    todo = np.arange(m)
    while len(todo):
        own = label[todo]
        count = np.bincount(own, minlength=1)
        hot = int(count.argmax())
        cols = np.arange(len(y))
        if count[hot] > 16:  # many rows of one component: only rows of others are of interest
            mine, cols = own == hot, np.flatnonzero(of_y != hot)
            rows = todo[mine][: max(16, 1_000_000 // max(1, len(cols)))]
        else:
            rows = todo[: max(16, 1_000_000 // max(1, len(cols)))]
        todo = todo[np.isin(todo, rows, assume_unique=True, invert=True)] if count[hot] > 16 else todo[len(rows) :]
        if sizes is not None:
            sx, sy = sizes[0][rows], sizes[1][cols]
            cols = cols[np.searchsorted(sy, sx[0] * similar - 1e-9, "left") : np.searchsorted(sy, sx[-1] / similar + 1e-9, "right")]
        if not len(cols):
            continue
        near = np.flatnonzero(np.bitwise_count(x[rows, 0][:, None] ^ y0[cols]) <= radii[0])
        i, j = near // len(cols), cols[near % len(cols)]
        if sizes is not None:
            sx, sy = sizes[0][rows[i]], sizes[1][j]
            fit = np.minimum(sx, sy) >= similar * np.maximum(sx, sy) - 1e-9
            i, j = i[fit], j[fit]
        if x.shape[1] > 1:
            total = np.zeros(len(i), np.int32)
            for k in range(x.shape[1]):
                total += np.bitwise_count(x[rows[i], k] ^ y[j, k])
            i, j = i[total <= radii[-1]], j[total <= radii[-1]]
        apart = label[rows[i]] != of_y[j]
        i, j = i[apart], j[apart]
        cuts = np.append(np.flatnonzero(np.diff(i, prepend=-1)), len(i)).tolist()
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            r = int(rows[i[lo]])
            others, first = np.unique(of_y[j[lo:hi]], return_index=True)
            for other, k in zip(others.tolist(), first.tolist(), strict=True):
                if other != label[r]:
                    out.append((r, int(j[lo + k])))
                    label[label == other] = label[r]
    return out


def _links(radii: tuple, lanes: int, similar: float):
    def links(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            us, vs = [], []
            for k in range(b.num_rows):
                (a, x, sx), (c, y, sy) = (tuple(b.column(f"{n}_{side}")[k].as_py() for n in ("ids", "fps", "sizes")) for side in "ab")
                ids = [np.frombuffer(i, np.uint64) if i is not None else None for i in (a, c)]
                rows = [np.frombuffer(f, np.uint64).reshape(-1, lanes) if f is not None else i if i is None else i[:, None] for i, f in zip(ids, (x, y), strict=True)]
                sizes = [np.frombuffer(s if s is not None else sx, "<i4") for s in (sx, sy)] if sx is not None else None
                found = forest(*rows, radii, sizes, similar)
                other = ids[1] if ids[1] is not None else ids[0]
                us += [int(ids[0][i]) for i, _ in found]
                vs += [int(other[j]) for _, j in found]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.uint64).view(np.int64)) for c in (us, vs)], ["a", "b"])

    return links


def compared(tiles: DataFrame, pairs: DataFrame, radii: tuple, lanes: int = 1, similar: float = 0.0) -> DataFrame:
    """(a, b): links of the tile pairs (a, b); a pair of one tile with itself has its content fetched once."""
    own = tiles.select(F.col("tile").alias("a"), *(F.col(c).alias(f"{c}_a") for c in ("ids", "fps", "sizes")))
    other = tiles.select(F.col("tile").alias("b"), *(F.col(c).alias(f"{c}_b") for c in ("ids", "fps", "sizes")))
    keyed = pairs.select("a", F.when(F.col("a") != F.col("b"), F.col("b")).alias("b"))
    return keyed.join(own.hint("merge"), "a").join(other.hint("merge"), "b", "left").select(*(f"{c}_{s}" for s in "ab" for c in ("ids", "fps", "sizes"))).mapInArrow(tidy(_links(radii, lanes, similar)), "a long, b long")


def _quarter(k: int):
    return F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF)))


def _near(radius: int) -> list[int]:
    """Differences of cell numbers (base 32, a digit a quarter, never wrapped) within the radius, a half of them and 0."""
    from itertools import product

    found = [d for d in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius and d >= (0, 0, 0, 0)]
    return [sum(x * 32**k for k, x in enumerate(reversed(d))) for d in found]


def cell_pairs(tiles: DataFrame, radius: int) -> DataFrame:
    """(a, b): numbers of the tile pairs of near cells, each once. A cell of many tiles has a salt for each CELL_TILES of them.

    The exploded side is joined by shuffle: its size is not seen through explode, and Spark would broadcast it.
    """
    cells = tiles.groupBy(F.col("low").alias("cell")).agg(F.ceil(F.count("*") / CELL_TILES).cast("int").alias("salts"))
    cells = F.broadcast(cells)  # 17 ** 4 rows at most
    steps = F.explode(F.array(*map(F.lit, _near(radius))))
    asked = tiles.select(F.col("tile").alias("a"), "low", steps.alias("step")).select("a", "step", (F.col("low") + F.col("step")).alias("cell")).join(cells, "cell")
    asked = asked.select("a", "step", "cell", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    other = tiles.select(F.col("tile").alias("b"), F.col("low").alias("cell")).join(cells, "cell").select("b", "cell", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    return asked.join(other.hint("merge"), ["cell", "salt"]).where("step <> 0 or a <= b").select("a", "b")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(doc_id, fp long, component_id) for each row: component_id is the smallest doc_id reachable over links."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(tidy(_fingerprints), "doc_id long, fp long")
    rows = stored(rows, "fingerprints")
    own = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    own = stored(own.withColumn("cell", (((_quarter(3) * 32 + _quarter(2)) * 32 + _quarter(1)) * 32 + _quarter(0)).cast("int")), "distinct-fingerprints")
    ordered = own.select("cell", "fp", F.lit(None).cast("binary").alias("fps")).repartitionByRange("cell", "fp").sortWithinPartitions("cell", "fp")
    tiles = stored(ordered.mapInArrow(cut_tiles(tile, 1, True), TILES), "tiles")
    comp = components(compared(tiles, cell_pairs(tiles, radius), (radius,)))
    # components over fingerprints; then the smallest doc_id of each
    classes = own.join(comp.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = classes.join(least, "root").select(F.col("fp").alias("n_fp"), "component_id")
    return rows.join(named, F.col("fp") == F.col("n_fp")).select("doc_id", "fp", "component_id")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
