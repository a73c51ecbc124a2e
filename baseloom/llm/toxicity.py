"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and applied in numpy.

A word's input is a hashed embedding of its lower-cased form beside the mean of hashed embeddings of its character
trigrams. Two gated recurrent layers read a window of WINDOW words from either end; attention over their states gives
one vector, and that a logit. A text is covered by overlapping windows (every STRIDE words, the last one ends with the text),
all of them scored; the largest logit is mapped to a score by a logistic curve.

Training takes a bounded sample: at most SAMPLE labelled documents (half of each class where there are as many), those
with the smallest hashes of their ids among the rows that may be learned from, and all windows of their whole texts. One in CALIBRATE of them trains
nothing: on these the logistic curve is fitted. A label is a document's, not a window's, so training goes in two rounds: first all windows
have their document's label; then, of a toxic document, only the window with the largest logit and those above most clean windows
(the CLEAN quantile) go on with label 1, the others are left out. The seed is fixed, so the model is the same for the same rows.

Defined cases. Null or empty text: one window without words. Null doc_id: scored, held_out null. Repeated rows: scored
each. Labels of one kind only or none: the score is constant, the share of toxic labels (0 without labels). Empty table: no rows.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes, tidy

WINDOW, STRIDE = 64, 48
SAMPLE, CALIBRATE, CLEAN = 4000, 8, 0.98
WORD_BUCKETS, CHAR_BUCKETS, WORD_DIM, CHAR_DIM, HIDDEN, ATTEND = 1 << 13, 1 << 11, 12, 8, 8, 8
EPOCHS, STEPS, BATCH, RATE = (2, 2), (90, 90), 128, 0.01  # of either round: passes over the windows, but so many steps at least
WORDS_KEPT = 200_000


def _sigmoid(x):
    import numpy as np

    return np.tanh(x * 0.5) * 0.5 + 0.5


def word_parts(words: list[bytes]):
    """Buckets of words; buckets of all their character trigrams, one word after another; how many each word has."""
    import numpy as np

    raw = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint64)
    n = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(n + 2)
    grams = raw[:-2] << np.uint64(16) | raw[1:-1] << np.uint64(8) | raw[2:]
    grams = (grams * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % CHAR_BUCKETS
    starts = np.ones(len(raw), bool)
    starts[ends - 1] = starts[ends - 2] = False  # a trigram does not run into the next word
    empty = n == 0
    starts[ends[empty] - 2] = True  # a word without characters has one
    if empty.any():
        grams = np.append(grams, (0, 0))
    return np.fromiter(map(crc32, words), np.int64, len(words)) % WORD_BUCKETS, grams[np.flatnonzero(starts)], np.maximum(n, 1)


class Net:
    """Parameters, forward pass and gradients. Gate inputs are direction x time x row x unit."""

    def __init__(self, seed: int = 7):
        import numpy as np

        r, d, h = np.random.default_rng(seed), WORD_DIM + CHAR_DIM, HIDDEN
        draw = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        self.p = {
            "word": draw(WORD_BUCKETS, WORD_DIM, scale=0.3), "char": draw(CHAR_BUCKETS, CHAR_DIM, scale=0.3),
            "W": draw(2, d, 3 * h, scale=d**-0.5), "b": np.zeros((2, 1, 3 * h), np.float32), "U": draw(2, h, 3 * h, scale=h**-0.5),
            "A": draw(2 * h, ATTEND, scale=(2 * h) ** -0.5), "v": draw(ATTEND, scale=ATTEND**-0.5), "w": draw(2 * h, scale=(2 * h) ** -0.5), "c": np.zeros(1, np.float32),
        }

    def embed(self, parts):
        import numpy as np

        own, flat, n = parts
        chars = np.add.reduceat(self.p["char"][flat], np.cumsum(n) - n, axis=0) / n[:, None]
        return np.concatenate((self.p["word"][own], chars), axis=1).astype(np.float32)

    def project(self, x):
        """Gate inputs of word vectors, both directions: 2 x rows x 3h."""
        import numpy as np

        return np.matmul(x[None], self.p["W"]) + self.p["b"]

    def run(self, gates, mask, keep: bool = False):
        """gates: 2 x time x rows x 3h, direction 1 already reversed in time; mask: 2 x time x rows x 1."""
        import numpy as np

        _, t_max, rows, _ = gates.shape
        h, u = HIDDEN, self.p["U"]
        state = np.zeros((2, rows, h), np.float32)
        states = np.empty((t_max, 2, rows, h), np.float32)
        tape = []
        for t in range(t_max):
            g, rec = gates[:, t], np.matmul(state, u)
            zr = _sigmoid(g[:, :, : 2 * h] + rec[:, :, : 2 * h])
            z, r = zr[:, :, :h], zr[:, :, h:]
            n = np.tanh(g[:, :, 2 * h :] + r * rec[:, :, 2 * h :])
            step = (1 - z) * mask[:, t]  # a masked step leaves the state
            if keep:
                tape.append((state, z, r, n, rec[:, :, 2 * h :]))
            state = state + step * (n - state)
            states[t] = state
        both = np.concatenate((states[:, 0], states[::-1, 1]), axis=2)  # time x rows x 2h, in text order
        live = mask[0, :, :, 0]
        a = np.tanh(both @ self.p["A"])
        e = a @ self.p["v"] + (live - 1) * 1e4
        e = np.exp(e - e.max(0))
        e /= e.sum(0)
        pooled = np.einsum("tr,trk->rk", e, both)
        logit = pooled @ self.p["w"] + self.p["c"][0]
        return logit, (both, a, e, pooled, tape)

    def gradients(self, gates, mask, target):
        """Mean cross-entropy's gradients for the recurrent part, and for the gate inputs."""
        import numpy as np

        logit, (both, a, e, pooled, tape) = self.run(gates, mask, keep=True)
        _, t_max, rows, _ = gates.shape
        h, p, g = HIDDEN, self.p, {}
        d = ((_sigmoid(logit) - target) / rows).astype(np.float32)
        g["w"], g["c"] = pooled.T @ d, d.sum(keepdims=True)
        dp = d[:, None] * p["w"]
        de = np.einsum("rk,trk->tr", dp, both)
        ds = e * (de - (e * de).sum(0))
        g["v"] = np.einsum("tr,trk->k", ds, a)
        da = ds[:, :, None] * p["v"] * (1 - a * a)
        g["A"] = np.einsum("trk,trm->km", both, da)
        dboth = e[:, :, None] * dp + da @ p["A"].T
        dstates = np.stack((dboth[:, :, :h], dboth[::-1, :, h:]), axis=1)
        g["U"], dgates, carry = np.zeros_like(p["U"]), np.zeros_like(gates), np.zeros((2, rows, h), np.float32)
        for t in range(t_max - 1, -1, -1):
            state, z, r, n, rec_n = tape[t]
            dh = dstates[t] + carry
            m = mask[:, t]
            dn = dh * (1 - z) * m * (1 - n * n)
            dz = dh * (state - n) * m * z * (1 - z)
            dr = dn * rec_n * r * (1 - r)
            drec = np.concatenate((dz, dr, dn * r), axis=2)
            dgates[:, t] = np.concatenate((dz, dr, dn), axis=2)
            g["U"] += np.matmul(state.transpose(0, 2, 1), drec)
            carry = dh * (1 - (1 - z) * m) + np.matmul(drec, p["U"].transpose(0, 2, 1))
        return logit, g, dgates


def laid_out(index, mask, table):
    """Gate inputs and masks in run()'s order, from rows x time indices into a projected table (2 x words x 3h)."""
    import numpy as np

    at = np.ascontiguousarray(index.T)
    gates = np.empty((2, *at.shape, table.shape[2]), np.float32)
    np.take(table[0], at, axis=0, out=gates[0], mode="clip")
    np.take(table[1], at[::-1], axis=0, out=gates[1], mode="clip")
    return gates, np.stack((mask.T, mask.T[::-1]))[..., None].astype(np.float32)


def _summed(at, rows, n: int):
    """Sums of rows by their number in at, which holds every number below n."""
    import numpy as np

    order = np.argsort(at, kind="stable")
    return np.add.reduceat(rows[order], np.searchsorted(at[order], np.arange(n)), axis=0)


def windows(n: int) -> list[tuple[int, int]]:
    """Overlapping windows over n words: every STRIDE words, the last ends with the text."""
    if n <= WINDOW:
        return [(0, n)]
    starts = list(range(0, n - WINDOW, STRIDE)) + [n - WINDOW]
    return [(s, s + WINDOW) for s in starts]


def train(documents: list[tuple[list[list[bytes]], int]], seed: int = 7, epochs: tuple[int, int] = EPOCHS) -> Net:
    """documents: (windows of words, label)."""
    import numpy as np

    net, r = Net(seed), np.random.default_rng(seed)
    flat = [(words, y, k) for k, (parts, y) in enumerate(documents) for words in parts]
    vocabulary: dict[bytes, int] = {b"": 0}
    index = np.zeros((len(flat), WINDOW), np.int32)
    length = np.zeros(len(flat), np.int32)
    for i, (words, _, _) in enumerate(flat):
        for j, w in enumerate(words[:WINDOW]):
            index[i, j] = vocabulary.setdefault(w, len(vocabulary))
        length[i] = len(words)
    target, of = np.array([y for _, y, _ in flat], np.float32), np.array([k for _, _, k in flat])
    known = list(vocabulary)
    state = _Adam(net)
    done, rows = 0, np.arange(len(flat))
    for n, least in zip(epochs, STEPS, strict=True):
        for _ in range(max(n, -(-least * BATCH // len(rows)))):
            order = r.permutation(rows)
            for lo in range(0, len(order), BATCH):
                done += min(BATCH, len(order) - lo)
                rate = RATE * max(0.2, 1 - 0.8 * done / max(sum(epochs) * len(flat), sum(STEPS) * BATCH))
                _step(net, state, index, length, target, known, order[lo : lo + BATCH], rate)
        rows = _telling(_all_logits(net, index, length, known), target, of)
    return net


def _telling(z, target, of):
    """The windows of clean documents; of toxic ones the largest, and those above most clean ones."""
    import numpy as np

    bad = target > 0
    least = np.quantile(z[~bad], CLEAN) if (~bad).any() else -np.inf
    top = np.full(of.max() + 1, -np.inf)
    np.maximum.at(top, of, z)
    return np.flatnonzero(~bad | (z > least) | (z >= top[of]))


def _mask(length, rows):
    import numpy as np

    return (np.arange(WINDOW) < length[rows, None]).astype(np.float32)


def _all_logits(net: Net, index, length, known):
    import numpy as np

    table = np.concatenate([net.project(net.embed(word_parts(known[lo : lo + 20_000]))) for lo in range(0, len(known), 20_000)], axis=1)
    out = []
    for lo in range(0, len(index), 1024):
        rows = np.arange(lo, min(lo + 1024, len(index)))
        out.append(net.run(*laid_out(index[rows], _mask(length, rows), table))[0])
    return np.concatenate(out)


class _Adam:
    def __init__(self, net: Net):
        import numpy as np

        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
        self.squares = {k: np.full(len(net.p[k]), 1e-6, np.float32) for k in ("word", "char")}
        self.steps = 0


def _step(net: Net, state: _Adam, index, length, target, known, rows, rate: float) -> None:
    import numpy as np

    used, local = np.unique(index[rows], return_inverse=True)
    parts = word_parts([known[k] for k in used])
    x = net.embed(parts)
    local = local.reshape(len(rows), WINDOW)
    gates, m = laid_out(local, _mask(length, rows), net.project(x))
    _, g, dgates = net.gradients(gates, m, target[rows])
    at = local.T
    dtable = np.stack([_summed(k.ravel(), d.reshape(-1, d.shape[-1]), len(used)) for k, d in ((at, dgates[0]), (at[::-1], dgates[1]))])
    g["b"] = dtable.sum(1)[:, None]
    g["W"] = np.stack([x.T @ dtable[k] for k in (0, 1)])
    dx = dtable[0] @ net.p["W"][0].T + dtable[1] @ net.p["W"][1].T
    state.steps += 1
    for k, dk in g.items():
        a, b = state.moments[k]
        a += 0.1 * (dk - a)
        b += 0.001 * (dk * dk - b)
        net.p[k] -= rate * (a / (1 - 0.9**state.steps)) / (np.sqrt(b / (1 - 0.999**state.steps)) + 1e-8)
    _embedding_step(net, state.squares, parts, dx)


def _embedding_step(net: Net, squares, parts, dx):
    import numpy as np

    own, flat, n = parts
    at = {"word": own, "char": flat}
    d = {"word": dx[:, :WORD_DIM], "char": np.repeat(dx[:, WORD_DIM:] / n[:, None], n, axis=0)}
    for k in at:
        rows, inverse = np.unique(at[k], return_inverse=True)
        total = _summed(inverse, d[k], len(rows))
        squares[k][rows] += (total * total).mean(1)
        net.p[k][rows] -= 0.05 * total / np.sqrt(squares[k][rows])[:, None]


class Scorer:
    """Largest logits of texts; projected word inputs are kept for a bounded number of words."""

    def __init__(self, net: Net, kept: int = WORDS_KEPT, rows: int = 1024):
        import numpy as np

        self.net, self.kept, self.rows = net, kept, rows
        self.at: dict[bytes, int] = {}
        self.table = np.zeros((2, 1, 3 * HIDDEN), np.float32)  # row 0: no word
        self.used = 1

    def learn(self, words: set[bytes]) -> None:
        import numpy as np

        if len(self.at) + len(words) > self.kept:
            self.at, self.used = {}, 1
        new = list(words.difference(self.at))
        if not new:
            return
        if self.used + len(new) > self.table.shape[1]:
            bigger = np.zeros((2, max(2 * self.table.shape[1], self.used + len(new)), 3 * HIDDEN), np.float32)
            bigger[:, : self.used] = self.table[:, : self.used]
            self.table = bigger
        for lo in range(0, len(new), 20_000):
            part = new[lo : lo + 20_000]
            self.table[:, self.used : self.used + len(part)] = self.net.project(self.net.embed(word_parts(part)))
            self.at.update(zip(part, range(self.used, self.used + len(part)), strict=True))
            self.used += len(part)

    def logits(self, texts: list[bytes]):
        """For each text, the largest logit of its windows."""
        import numpy as np

        split = [t.lower().split() for t in texts]
        known: set[bytes] = set()
        for words in split:
            known.update(words)
        self.learn(known)
        get = self.at.__getitem__
        of, starts, ends, base, flat = [], [], [], 0, []
        for i, words in enumerate(split):
            flat.append(np.fromiter(map(get, words), np.int64, len(words)))
            for s, e in windows(len(words)):
                of.append(i)
                starts.append(base + s)
                ends.append(base + e)
            base += len(words)
        flat = np.concatenate([*flat, np.zeros(WINDOW, np.int64)])
        of, starts, ends = np.array(of), np.array(starts), np.array(ends)
        out = np.full(len(texts), -np.inf, np.float32)
        for lo in range(0, len(of), self.rows):
            at = starts[lo : lo + self.rows, None] + np.arange(WINDOW)
            mask = (at < ends[lo : lo + self.rows, None]).astype(np.float32)
            gates, m = laid_out(np.where(mask > 0, flat[at], 0), mask, self.table)
            np.maximum.at(out, of[lo : lo + self.rows], self.net.run(gates, m)[0])
        return out


def _score(shared):
    def score(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        scorer = Scorer(shared.value)
        for b in batches:
            for lo in range(0, b.num_rows, 128):
                part = b.slice(lo, 128)
                z = scorer.logits(text_bytes(part.column(1))).astype(np.float64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(z)], ["doc_id", "logit"])

    return score


def calibrated(z, y) -> tuple[float, float]:
    """(slope, shift) of the logistic curve through largest logits, both classes weighing the same, by Newton's method."""
    import numpy as np

    z, y = np.array(z, float), np.array(y, float)
    middle, spread = z.mean(), z.std() + 1e-6
    x = np.stack(((z - middle) / spread, np.ones(len(z))), axis=1)
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    b = np.zeros(2)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (weight * (p - y)) + 0.001 * b * (1, 0)
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag((0.001, 1e-9))
        b -= np.linalg.solve(hess, grad)
    return float(b[0] / spread), float(b[1] - b[0] * middle / spread)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """(net, slope, shift), or the constant share of toxic labels; labels: those that may be learned from."""
    spark = docs.sparkSession
    own = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    key = F.xxhash64("doc_id")
    chosen = own.where("toxic = 1").orderBy(key, "doc_id").limit(sample // 2).collect() + own.where("toxic = 0").orderBy(key, "doc_id").limit(sample // 2).collect()
    if len({r.toxic for r in chosen}) < 2:
        return float(sum(r.toxic for r in chosen) / max(1, len(chosen)))
    few = F.broadcast(spark.createDataFrame([(r.doc_id, r.toxic) for r in chosen], "l_id long, toxic int"))  # at most `sample` rows
    texts = docs.select("doc_id", "text").join(few, F.col("doc_id") == F.col("l_id")).select("l_id", "toxic", F.col("text").cast("binary").alias("text"))
    rows = sorted((r.l_id, r.toxic, bytes(r.text or b"")) for r in texts.collect())  # the sample's texts
    rank = {y: {k: n for n, k in enumerate(sorted({i for i, t, _ in rows if t == y}))} for y in (0, 1)}
    later = [rank[y][i] % CALIBRATE == CALIBRATE - 1 for i, y, _ in rows]  # of each class alike
    split = [(text.lower().split(), y) for (_, y, text), z in zip(rows, later, strict=True) if not z]
    net = train([([words[s:e] for s, e in windows(len(words))], y) for words, y in split])
    held = [(text, y) for (_, y, text), z in zip(rows, later, strict=True) if z]
    if len({y for _, y in held}) < 2:
        held = [(text, y) for _, y, text in rows]
    scorer = Scorer(net)
    z = [x for lo in range(0, len(held), 128) for x in scorer.logits([t for t, _ in held[lo : lo + 128]]).tolist()]
    return (net, *calibrated(z, [y for _, y in held]))


def scores(docs: DataFrame, model) -> DataFrame:
    """(doc_id, score) for each row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    if isinstance(model, float):
        return docs.select("doc_id", F.lit(model).alias("score"))
    net, slope, shift = model
    z = docs.mapInArrow(tidy(_score(docs.sparkSession.sparkContext.broadcast(net))), "doc_id long, logit double")
    return z.select("doc_id", (1 / (1 + F.exp(-(F.col("logit") * slope + shift)))).alias("score"))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    fold = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 5
    out = scores(docs, fit(docs, labels.where(fold("doc_id") != 0)))
    return out.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
