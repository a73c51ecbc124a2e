"""Order-preserving packing by dynamic programming.

The documents of a partition, in input order, are one stream of tokens. Cuts may fall at the ends of documents (free), at the ends of
sentences (a small penalty for what the cut truncates) and, inside sentences longer than FORCED tokens, every FORCED tokens (a
larger penalty). Cut points are chosen so that padding plus penalties, and OPEN for each sequence, is least, over all
windows of at most `window` tokens: f(j) = OPEN + penalty(j) + min over i of f(i) + padding(p(j) - p(i)). Padding goes up to the window,
but a length that is a power of two has none. The minimum over a sliding window is a monotone queue's first entry, so
these transitions are constant; the few points at distances of powers of two are tried besides.

A partition is streamed. Cuts are final, and returned, once the best paths to all points that a later point can still follow
(those of the last window) share them; so the plan is the best of the whole partition, and memory holds the tokens since
the last shared cut, some windows in practice, and one text.

Ids come from the library word by word, as this tokenizer drops white space and no token spans words. A word of Latin
letters and a tail of signs is encoded in two parts, which the tokenizer would part too; Latin letters are those below
U+0250 but U+0130, whose lower case is two characters, so neither composition nor case runs over the border. Every other word is
encoded whole. A worker's table of parts is bounded.

No shuffle: order is kept within the input's partitions, each of which pads its last sequence.

Defined cases. Null or empty text: the closing token alone. Null doc_id: kept, with a null id. Repeated rows: packed
each. A text longer than a sequence is cut into pieces; no id is lost or doubled. Empty table: no rows. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .token_cache import encode_words, tokenizer

WINDOW, CLOSING = 4096, 2
SENTENCE, INSIDE, OPEN, FORCED = 4.0, 64.0, 16.0, 256
SETTLE = 1 << 18  # tokens between two looks for shared cuts
PARTS_KEPT = 400_000  # about 0.1 GB for each worker process
BATCH_CHARS = 1_000_000
STOPS = (".", "!", "?", "\n")
#: What the tokenizer drops at a word's ends: str.strip() would also take U+001C to U+001F, which have ids.
BLANK = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and not "\x1c" <= c <= "\x1f")
LATIN = r"^(?P<stem>[A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]+)(?P<tail>[.,;:!?#*$%&]*)\n?$"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordIds:
    """Token ids of texts by way of the ids of their words' parts."""

    def __init__(self, path: str, kept: int = PARTS_KEPT):
        import numpy as np

        self.tok, self.kept = tokenizer(path), kept
        self.at: dict[str, int] = {}
        self.flat, self.ends, self.n, self.used = np.zeros(1 << 16, "<u4"), np.zeros(1 << 14, np.int64), 0, 0

    def learn(self, parts: list[str]):
        """Numbers of the parts in the table."""
        import numpy as np

        if len(self.at) > self.kept:
            self.at, self.n, self.used = {}, 0, 0
        get = self.at.get
        numbers = np.fromiter((get(x, -1) for x in parts), np.int64, len(parts))
        miss = np.flatnonzero(numbers < 0)
        if len(miss):
            new = list(dict.fromkeys(parts[i] for i in miss.tolist()))
            ids, ends = encode_words(self.tok, [" " + x for x in new])
            self.flat, self.ends = _grown(self.flat, self.used + len(ids)), _grown(self.ends, self.n + len(new) + 1)
            self.flat[self.used : self.used + len(ids)] = ids
            self.ends[self.n + 1 : self.n + 1 + len(new)] = ends + self.used
            self.ends[self.n] = self.used
            self.at.update(zip(new, range(self.n, self.n + len(new)), strict=True))
            self.n, self.used = self.n + len(new), self.used + len(ids)
            numbers[miss] = [self.at[parts[i]] for i in miss.tolist()]
        return numbers

    def encode(self, texts: list[str]):
        """(ids, ends) for each text: ends are the positions in ids after which a sentence or line has ended."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        lists = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", "\n "), " ")
        coded = lists.flatten().dictionary_encode()
        words, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        stops = np.zeros(len(words), bool)
        for s in STOPS:
            stops |= pc.ends_with(words, s).to_numpy(zero_copy_only=False)
        found = pc.extract_regex(words, LATIN)
        whole = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
        split = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        found = found.drop_null()
        stems, tails = pc.ascii_lower(found.field("stem")).dictionary_encode(), found.field("tail").dictionary_encode()
        s, t, cores = (x.to_numpy(zero_copy_only=False).tolist() for x in (stems.dictionary, tails.dictionary, words.take(pa.array(whole))))
        cores = [w.strip(BLANK) for w in cores]
        numbers = self.learn([*s, *t, *cores, ""])
        first, second = np.full(len(words), numbers[-1]), np.full(len(words), numbers[-1])
        first[whole] = numbers[len(s) + len(t) : -1]
        first[split] = numbers[stems.indices.to_numpy()]
        second[split] = numbers[len(s) + tails.indices.to_numpy()]
        # the words' ids one after another, then those of every word in its place
        two = np.stack((first, second), axis=1).ravel()
        lengths = self.ends[two + 1] - self.ends[two]
        own = self.flat[_ranges(self.ends[two], lengths)]
        lengths = lengths.reshape(-1, 2).sum(1)
        starts = np.cumsum(lengths) - lengths
        n = lengths[codes]
        ids = own[_ranges(starts[codes], n)]
        after = np.concatenate(([0], np.cumsum(n)))
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        edges, marks = after[bounds], after[np.flatnonzero(stops[codes]) + 1]
        cuts = np.searchsorted(marks, edges[:-1], "left"), np.searchsorted(marks, edges[1:], "right")
        return [(ids[lo:hi], marks[p:q] - lo) for lo, hi, p, q in zip(edges.tolist(), edges[1:].tolist(), *(c.tolist() for c in cuts), strict=False)]


def _grown(x, n: int):
    import numpy as np

    if n <= len(x):
        return x
    out = np.zeros(max(n, 2 * len(x)), x.dtype)
    out[: len(x)] = x
    return out


def _ranges(starts, lengths):
    """starts[0], starts[0] + 1, ... for lengths[0] numbers, then the next range."""
    import numpy as np

    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


_tables: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """This process's table for a tokenizer: the tasks that a worker runs in turn share the parts they have learnt."""
    if path not in _tables:
        _tables[path] = WordIds(path)
    return _tables[path]


class Planner:
    """Best cuts of a stream of points, found point by point."""

    def __init__(self, window: int, start: int = 0):
        self.window = window
        self.powers = [1 << k for k in range(window.bit_length()) if 1 << k < window]
        self.points, self.cost, self.back, self.base = [start], [0.0], [0], 0  # base: the number of the first point kept
        self.queue: deque = deque([(float(start), 0)])  # (cost + point, number), increasing

    def extend(self, points: list[int], penalties: list[float]) -> None:
        """Points increase, by the window at most."""
        import numpy as np

        window, base, queue, cost, back = self.window, self.base, self.queue, self.cost, self.back
        first = len(self.points)
        self.points += points
        tail = max(0, first - window)
        known = np.array(self.points[tail:], np.int64)
        own = known[first - tail :]
        at = np.array([np.searchsorted(known, own - k) for k in self.powers], np.int64).reshape(len(self.powers), len(own))
        hit = known[at] == own - np.array(self.powers, np.int64).reshape(-1, 1)
        of, which = np.nonzero(hit.T)  # by point
        near, ends = (at.T[of, which] + tail).tolist(), np.searchsorted(of, np.arange(1, len(own) + 1)).tolist()
        lo, where = 0, self.points
        for j, (p, penalty, hi) in enumerate(zip(points, penalties, ends, strict=True), first):
            low = p - window
            while where[queue[0][1] - base] < low:
                queue.popleft()
            c, i = queue[0]
            c += window - p
            for k in near[lo:hi]:
                if cost[k] < c:
                    c, i = cost[k], k + base
            lo = hi
            c += penalty + OPEN
            cost.append(c)
            back.append(i)
            c += p
            while queue and queue[-1][0] >= c:
                queue.pop()
            queue.append((c, j + base))

    def path(self, number: int) -> list[int]:
        """Points from the first one kept to that of this number."""
        out = [number]
        while out[-1] > self.base:
            out.append(self.back[out[-1] - self.base])
        return [self.points[k - self.base] for k in reversed(out)]

    def settled(self) -> list[int]:
        """The points that every best path shares, the first one kept included; what comes before the last is forgotten."""
        from bisect import bisect_left

        live = bisect_left(self.points, self.points[-1] - self.window)
        heap = [-k for k in range(self.base + live, self.base + len(self.points))]
        heapify(heap)
        while heap[0] != heap[-1] or len(set(heap)) > 1:
            top = -heappop(heap)
            while heap and -heap[0] == top:
                heappop(heap)
            if not heap:
                heap = [-top]
                break
            heappush(heap, -self.back[top - self.base])
        shared = -heap[0]
        out, gone = self.path(shared), shared - self.base
        self.points, self.cost, self.back, self.base = self.points[gone:], self.cost[gone:], self.back[gone:], shared
        return out

    def finished(self) -> list[int]:
        return self.path(self.base + len(self.points) - 1)


class Packer:
    def __init__(self, window: int, first_id: int, settle: int = SETTLE):
        self.planner, self.next_id, self.settle = Planner(window), first_id, settle
        self.docs: deque = deque()  # (doc_id, ids, the position of its first id)
        self.end, self.next_look = 0, settle

    def add(self, docs: list[tuple]) -> list:
        """docs: (doc_id, ids, ends); pieces that are final."""
        import numpy as np

        points, penalties = [], []
        for doc_id, ids, ends in docs:
            n = len(ids)
            at = np.concatenate(([0], np.unique(ends[(ends > 0) & (ends < n)]), [n]))
            cost = np.full(len(at), SENTENCE)
            cost[-1] = 0.0
            gaps = np.flatnonzero(np.diff(at) > FORCED)
            if len(gaps):
                extra = np.concatenate([np.arange(at[g] + FORCED, at[g + 1], FORCED) for g in gaps.tolist()])
                at, cost = np.concatenate((at, extra)), np.concatenate((cost, np.full(len(extra), INSIDE)))
                order = np.argsort(at, kind="stable")
                at, cost = at[order], cost[order]
            points.append(at[1:] + self.end)
            penalties.append(cost[1:])
            self.docs.append((doc_id, ids, self.end))
            self.end += n
        if points:
            self.planner.extend(np.concatenate(points).tolist(), np.concatenate(penalties).tolist())
        if self.end < self.next_look:
            return []
        self.next_look = self.end + self.settle
        return self._pieces(self.planner.settled())

    def flush(self) -> list:
        return self._pieces(self.planner.finished())

    def _pieces(self, cuts: list[int]) -> list:
        out = []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            at = lo
            while at < hi:
                doc_id, ids, start = self.docs[0]
                p = at - start
                q = min(len(ids), hi - start)
                out.append((doc_id, p, q - p, zlib.crc32(ids[p:q].tobytes()), len(ids), self.next_id, at - lo))
                at = start + q
                if q == len(ids):
                    self.docs.popleft()
            self.next_id += 1
        return out


def batched(texts: list[str], limit: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about `limit` characters, one text at least."""
    lo, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= limit:
            yield lo, i + 1
            lo, n = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _pack(path: str, window: int, closing: int):
    def pack(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        schema = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])
        words, packer, last = word_ids(path), Packer(window, TaskContext.get().partitionId() << 32), np.array([closing], "<u4")

        def rows(pieces):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pieces, strict=True)], schema=schema)

        for b in batches:
            keys, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            for lo, hi in batched(texts):
                coded = words.encode(texts[lo:hi])
                if out := packer.add([(k, np.append(ids, last), ends) for k, (ids, ends) in zip(keys[lo:hi], coded, strict=True)]):
                    yield rows(out)
        if out := packer.flush():
            yield rows(out)

    return pack


def packed(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, closing: int = CLOSING) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(tidy(_pack(tokenizer_path, window, closing)), PIECES)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
