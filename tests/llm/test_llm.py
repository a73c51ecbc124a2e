"""Each operator against brute force or SQL, over nulls, empty and long texts, repeated rows, ties and clashing columns."""

import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from baseloom.llm import components, decontaminate, licenses, line_dedup, near_texts, packing, quality_llr, sharding, simhash, token_cache, toxicity, url_lm
from baseloom.llm.common import new_path

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
LINE, OTHER = "One line that stands in many documents", "  oNE LINE that stands in many documents\t"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
LONG = " ".join(WORDS[(i * i) % 10] + str(i % 97) for i in range(12_000))
ROWS = [
    (0, "\n".join([LINE, "first own line of the text"])), (1, f"{OTHER}\nsecond\n{LINE}"), (2, f"third\n{LINE}\n\n"), (2, f"third\n{LINE}\n\n"), (3, ""), (4, None), (None, f"{LINE}\nx"), (None, None),
    (5, LONG), (6, LONG + " one more"), (7, "two words"), (8, "übergrößen straße ÉTÉ naïve\u00a0space"), (9, " lead  and   runs \t\n\n tabs "), (10, "<|endoftext|> inside | bars|too 'll can't 123 4"), (11, LINE),
]
CLASH = "fp pos keep h1 size part shard n_lines n_dropped text_in kept_text gone cell class label cluster k_id k_fp n n_words score kept c"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    for c in CLASH.split():
        df = df.withColumn(c, F.lit("clash"))
    return df.persist()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def words(text):
    return (text or "").encode().lower().split()


def test_line_dedup(spark, docs, nothing):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(con.sql(line_dedup.OP2_SQL).fetchall())
    got = line_dedup.op2_line_dedup(spark, SF).select("doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert sorted(map(tuple, got.collect())) == want
    holders = {i for i, t in ROWS if i is not None and t and LINE.lower() in t.lower()}
    done = line_dedup.deduped(docs)
    assert done.columns == docs.columns and {r.kept_text for r in done.collect()} == {"clash"}
    kept = lambda i, t: (t or "") if i is None or i == max(holders) else "\n".join(x for x in (t or "").split("\n") if x.strip().lower() != LINE.lower())
    key = lambda x: (str(x[0]), x[1])
    assert sorted(((r.doc_id, r.text) for r in done.collect()), key=key) == sorted(((i, kept(i, t)) for i, t in ROWS), key=key)
    assert line_dedup.line_bitmaps(nothing).count() == 0 and line_dedup.deduped(nothing).count() == 0


@pytest.mark.parametrize("batch", [1, 2, 5, 100])
def test_runs_over_batches_and_partitions(batch):
    """The streamed decision against counting, however rows are cut into batches and partitions."""
    import pyarrow as pa

    r = np.random.default_rng(batch)
    rows = sorted({(int(h), 0, -int(d), int(p)) for h, d, p in zip(r.integers(0, 6, 120), r.integers(0, 8, 120), r.integers(0, 3, 120), strict=True)})
    by_key = {}
    for h, _, d, _ in rows:
        by_key.setdefault(h, set()).add(-d)
    want = {(-d, p, h) for h, _, d, p in rows if len(by_key[h]) >= 3 and -d != max(by_key[h])}
    cuts = sorted(rows, key=lambda x: (x[0], -x[2]))
    edges = [0, *sorted({next(i for i, y in enumerate(cuts) if y[0] == x[0] and y[2] == x[2]) for x in cuts[:: max(1, len(cuts) // 4)]} - {0}), len(cuts)]
    drops, held, sums = set(), [], {}
    for lo, hi in zip(edges, edges[1:], strict=False):
        part = sorted(cuts[lo:hi], key=lambda x: (x[0], x[2], x[3]))
        made = [pa.RecordBatch.from_arrays([pa.array([x[0] for x in b]), pa.array([0] * len(b)), pa.array([-x[2] for x in b]), pa.array([x[0] for x in b]), pa.array([x[3] for x in b], pa.int32())], ["h1", "h2", "doc_id", "fp", "pos"]) for b in (part[i : i + batch] for i in range(0, len(part), batch))]
        for out in line_dedup._decide(3)(iter(made)):
            for x in out.to_pylist():
                if x["kind"] == line_dedup.DROP:
                    drops.add((x["doc_id"], x["pos"], x["fp"]))
                elif x["kind"] == line_dedup.OPEN:
                    held.append((x["h1"], x["doc_id"], x["pos"], x["fp"]))
                else:
                    n, top = sums.get(x["h1"], (0, -1))
                    sums[x["h1"]] = (n + x["n_docs"], max(top, x["doc_id"]))
    drops |= {(d, p, f) for h, d, p, f in held if sums[h][0] >= 3 and d != sums[h][1]}
    assert drops == want


def test_decontaminate(spark, docs, nothing):
    items = spark.createDataFrame([(1, LINE), (2, None), (3, ""), (4, "two WORDS"), (4, "two WORDS"), (5, "no such words anywhere in here at all"), (None, "first own line of the text")], "item_id long, text string")
    want = Counter()
    for i, t in ROWS:
        own = set(decontaminate.shingles((t or "").encode()))
        for k, x in {(k, x) for k, x in ((1, LINE), (4, "two WORDS"), (None, "first own line of the text"))}:
            part = set(decontaminate.shingles(x.encode()))
            if len(part & own) >= 0.8 * len(part):
                want[(i, k, len(part), len(part & own))] += 1
    for block in (1, 500_000):
        assert Counter(map(tuple, decontaminate.leaks(docs, items, block=block).collect())) == want
    assert decontaminate.leaks(nothing, items).count() == 0 and decontaminate.leaks(docs, items.where("false")).count() == 0
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert sorted(map(tuple, decontaminate.op4_decontaminate(spark, SF).collect())) == sorted(con.sql(decontaminate.OP4_SQL).fetchall())


def test_sketch_is_complete():
    """Whatever fifth of an item is missing, a hash of its sketch is left."""
    text = " ".join(f"w{i}" for i in range(44)).encode()
    ((least, hashes, _),) = decontaminate._sketches([(1, text)], 0.8, 5)
    assert least == 26  # 0.8 of 32, the least size of the class
    import xxhash

    own = sorted(xxhash.xxh3_64_intdigest(s) for s in decontaminate.shingles(text))
    left = own[len(own) - 32 :]  # 0.8 of 40, the smallest hashes missing
    assert set(left) & set(hashes.tolist())


def test_balance_of_shards(spark):
    """Shards of many small rows are within a row of their target."""
    df = spark.createDataFrame([(i, "x" * (i % 37)) for i in range(5000)], "doc_id long, text string").repartition(5)
    sizes = Counter()
    for r in sharding.shard(df).collect():
        sizes[r.shard] += r["size"]
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 2 * 37


def test_sharding(docs, nothing):
    rows = sharding.shard(docs, 4).collect()
    # the law: in order of id, each row in the shard in which the middle of its bytes lies
    order = sorted((-1 if i is None else i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in ROWS)
    total, before, want = sum(x[2] for x in order), 0, Counter()
    for i, c, n in order:
        want[(i, c, min(3, (2 * before + n) * 4 // (2 * total)))] += 1
        before += n
    assert Counter((-1 if r.doc_id is None else r.doc_id, r.text_crc32, r.shard) for r in rows) == want and len({r.shard for r in rows}) > 1
    assert len(rows) == len(ROWS) and sum(r["size"] for r in rows) == sum(len((t or "").encode()) + 1 for _, t in ROWS)
    assert Counter((r.doc_id, r.text_crc32) for r in rows) == Counter((i, zlib.crc32((t or "").encode())) for i, t in ROWS)
    for k in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    assert sharding.shard(nothing).count() == 0


def test_shards_by_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    assert sorted(map(tuple, sharding.op5_sharding(spark, SF).collect())) == sorted(con.sql(sharding.OP5_SQL).fetchall())
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [list(r) for r in ROWS])
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    got = sharding.shard(docs).select("doc_id", "size", "text_crc32", "shard", "slot").collect()
    assert sorted(map(tuple, got), key=key) == sorted(con.sql(f"select doc_id, size, text_crc32, shard, slot from ({sharding.OP5_SQL})").fetchall(), key=key)


def test_simhash(docs, nothing):
    got = simhash.near_duplicates(docs, tile=2).collect()
    fps = Counter((i, simhash.fingerprint((t or "").encode())) for i, t in ROWS)
    assert Counter((r.doc_id, r.fp % 2**64) for r in got) == fps
    ids = sorted({f for _, f in fps})
    root = {f: f for f in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if (a ^ b).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    least = {}
    for i, f in fps:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    assert all(r.component_id == least.get(root[r.fp % 2**64]) for r in got)
    assert simhash.near_duplicates(nothing).count() == 0


def _similar_groups(rows):
    """The smallest doc_id reachable for each row, by comparing all pairs of sets of five-word shingles."""
    sets = [frozenset(decontaminate.shingles((t or "").encode())) for _, t in rows]
    root = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or len(x & y) >= 0.8 * len(x | y):
                root = [root[j] if r == root[i] else r for r in root]
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return Counter((i, least.get(r)) for (i, _), r in zip(rows, root, strict=True))


def test_near_texts(spark, docs, nothing):
    assert Counter(map(tuple, near_texts.near_texts(docs).collect())) == _similar_groups(ROWS)
    assert near_texts.near_texts(nothing).count() == 0
    r, rows = np.random.default_rng(7), []
    for k in range(12):
        base = [f"w{x}" for x in r.integers(0, 500, 200)]
        for c in range(10):
            own = list(base)
            for at in r.choice(200, c, replace=False):  # each changed word takes up to five shingles
                own[at] = f"new{r.integers(0, 10**6)}"
            rows.append((100 * k + c, " ".join(own)))
    want = _similar_groups(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, near_texts.near_texts(df).collect())) == want
    assert Counter(map(tuple, near_texts.near_texts(df, tile=16, block=3).collect())) == want  # many tiles and blocks
    assert 12 < len({c for _, c in want}) < len(rows)


def test_forest_joins_a_large_group_without_all_pairs():
    """Components of the returned edges are those of all pairs, for rows in one hot group, small groups and none."""
    r = np.random.default_rng(3)
    hot = r.integers(0, 2**63, 1, dtype=np.uint64) ^ (np.uint64(1) << r.integers(0, 12, 900, dtype=np.uint64))
    rows = np.unique(np.concatenate((hot, r.integers(0, 2**63, 300, dtype=np.uint64), hot[:3] ^ np.uint64(7 << 40))))
    r.shuffle(rows)
    for cut in (None, 500):
        x, y = (rows[:cut, None], None if cut is None else rows[cut:, None])
        found = simhash.forest(x, y, (2,))
        other = x if y is None else y
        near = np.bitwise_count(x ^ other.T) <= 2

        def parts(pairs, m=len(x), n=len(other), one=y is None):
            root = list(range(m if one else m + n))

            def of(k):
                while root[k] != k:
                    k = root[k]
                return k

            for i, j in pairs:
                a, b = of(i), of(j if one else m + j)
                root[max(a, b)] = min(a, b)
            return [of(k) for k in range(len(root))]

        assert parts(found) == parts(zip(*(k.tolist() for k in np.nonzero(near)), strict=True))
        assert len(found) < len(rows)


def test_chains_within_a_cluster(spark):
    """Neighbours in a chain are similar, its ends are not: members unlike the pivot are found by blocks."""
    base = [f"w{i}" for i in range(300)]
    rows = []
    for k in range(40):
        own = list(base)
        for at in range(k):
            own[7 * at + 3] = f"x{at}"
        rows.append((k, " ".join(own)))
    want = _similar_groups(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, near_texts.near_texts(df, block=4).collect())) == want


def test_pipeline_drops_near_copies(spark):
    """Two changed words of 300 (Jaccard about 0.93) are beyond two bits of the SimHash, but a near copy all the same."""
    import corpus_pipeline

    rows = []
    for k in range(8):
        base = [f"w{k}x{i}" for i in range(300)]
        rows += [(10 * k, " ".join(base)), (10 * k + 1, " ".join([*base[:100], "other", *base[101:200], "words", *base[201:]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len({x.component_id for x in simhash.near_duplicates(df).collect()}) > 8
    assert sorted(x.doc_id for x in corpus_pipeline.dedup_documents(spark, df, SF).collect()) == [10 * k for k in range(8)]


def test_components(spark):
    chain = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 100), (7, 7), (None, 3)] + [(200, i) for i in range(201, 230)]
    got = dict(map(tuple, components.components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100, **{i: 200 for i in range(200, 230)}}


def test_token_counts(spark, docs, nothing):
    path, cache = P.path("byte_bpe_50k.json"), new_path(spark, "test-cache")
    tok = token_cache.tokenizer(path)
    want = Counter((i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in ROWS)
    assert Counter(map(tuple, token_cache.count_tokens(docs, path, cache).collect())) == want
    stored = spark.read.parquet(cache).count()
    assert Counter(map(tuple, token_cache.count_tokens(docs, path, cache).collect())) == want
    assert spark.read.parquet(cache).count() == stored == len({t or "" for _, t in ROWS})  # nothing encoded again
    assert token_cache.count_tokens(nothing, path, cache).count() == 0


def test_packing(docs, nothing):
    path = P.path("word_bpe_49k.json")
    tok = token_cache.tokenizer(path)
    pieces = packing.packed(docs, path, window=256).collect()
    by_seq = {}
    for p in pieces:
        by_seq.setdefault(p.sequence_id, []).append(p)
    for s in by_seq.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 256
    for i, t in {x for x in ROWS if x[0] is not None and x[0] != 2}:
        ids, at = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for p in sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    assert packing.packed(nothing, path).count() == 0


def test_word_ids_of_control_characters():
    """Separators U+001C to U+001F have ids; other white space, at ends or alone, has none."""
    path = P.path("word_bpe_49k.json")
    tok, table = token_cache.tokenizer(path), packing.WordIds(path)
    spaces = [c for c in map(chr, range(0x3001)) if c.isspace()]
    texts = [t for c in spaces for t in (c, f"foo{c}", f"{c}foo", f"a {c} b", f"end.{c} next", f"{c}{c}\n{c}x!{c}", f"Foo\x1c{c}", f"{c}\x1fbar.", f"a{c}|b{c}")]
    for t, (ids, _) in zip(texts, table.encode(texts), strict=True):
        assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_ids_are_the_library_s():
    """Every letter, mark, sign and digit of several planes, beside signs and control characters, against the library."""
    path = P.path("word_bpe_49k.json")
    tok, table = token_cache.tokenizer(path), packing.WordIds(path)
    found = [*range(0x20, 0x2100), *range(0x2C00, 0x3100), *range(0xA640, 0xA800), *range(0xAB30, 0xAC10), *range(0xF900, 0xFB50), *range(0x10400, 0x10450), *range(0x1D400, 0x1D420)]
    texts = [" ".join(x.format(c=chr(c)) for x in ("{c}", "{c}.", "a{c}", "a{c}!", "{c}a,", "b{c}#\x1c", "e{c}\u0301.", "'{c}'s")) + "\n" for c in found]
    texts += ["\u0130. x", "<|endoftext|> a<|startoftext|>.", "don't I'LL it's. 3rd", "A\u0130B. \u01c5! \ufb01,", "caf\u00e9, cafe\u0301, \u212b.", "a\u00a0b.\u2003c!", "", "\n", " \n. \n"]
    for lo in range(0, len(texts), 500):
        part = texts[lo : lo + 500]
        for t, (ids, ends), e in zip(part, table.encode(part), tok.encode_batch(part, add_special_tokens=False), strict=True):
            assert ids.tolist() == e.ids, repr(t)
            assert all(0 <= x <= len(ids) for x in ends)
    small = packing.WordIds(path, kept=3)  # a table that is cleared at every call
    for t in texts[-9:]:
        assert small.encode([t, "one two. three"])[0][0].tolist() == tok.encode(t, add_special_tokens=False).ids


def _cost(length, window):
    return 0 if length & (length - 1) == 0 else window - length


def test_plan_is_best():
    """The streamed plan, settled at any time, against all plans."""
    r = np.random.default_rng(1)
    for k in range(60):
        points = np.cumsum([0, *r.integers(1, 9, 25)]).tolist()
        penalty = r.integers(0, 9, len(points)).astype(float).tolist()
        best = [0.0] + [float("inf")] * 25
        for j in range(1, 26):
            best[j] = min(best[i] + _cost(points[j] - points[i], 12) + penalty[j] + packing.OPEN for i in range(j) if points[j] - points[i] <= 12)
        planner, cuts, lo = packing.Planner(12), [0], 1
        while lo < 26:
            hi = min(26, lo + int(r.integers(1, 7)))
            planner.extend(points[lo:hi], penalty[lo:hi])
            if k % 2:
                cuts += planner.settled()[1:]
            lo = hi
        cuts += planner.finished()[1:]
        assert cuts[0] == 0 and cuts[-1] == points[-1]
        at = {p: n for n, p in enumerate(points)}
        assert sum(_cost(b - a, 12) + penalty[at[b]] + packing.OPEN for a, b in zip(cuts, cuts[1:], strict=False)) == best[-1]


def test_packer_settles_and_wastes_little():
    """Many documents through a packer that settles often: the same pieces as at once, nothing lost, little padding."""
    r = np.random.default_rng(2)
    docs = []
    for k in range(800):
        n = int(r.integers(1, 900)) if k % 100 else 9000
        docs.append((None if k == 5 else k % 790, r.integers(0, 49_000, n).astype("<u4"), np.unique(r.integers(1, n + 1, n // 15 + 1))))
    results = []
    for settle, step in ((10**9, 800), (1, 7), (20_000, 100)):
        packer, out = packing.Packer(4096, 0, settle), []
        for lo in range(0, 800, step):
            out += packer.add(docs[lo : lo + step])
        results.append(out + packer.flush())
    assert results[0] == results[1] == results[2]
    lengths = Counter()
    for p in results[0]:
        lengths[p[5]] += p[2]
    assert sum(lengths.values()) == sum(len(ids) for _, ids, _ in docs) and max(lengths.values()) <= 4096
    assert sum(_cost(n, 4096) for k, n in lengths.items() if k < max(lengths)) < 0.02 * sum(lengths.values())


def test_quality(spark, docs, nothing):
    many = spark.createDataFrame([(i, " ".join(WORDS[(i * k + k) % 10] + ("###" if i % 4 == 0 else "") for k in range(60 + i))) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(30)] + [(None, 1), (3, 1), (99, None)], "doc_id long, quality int")
    model = quality_llr.fit(many, labels)
    got = {r.doc_id: r for r in quality_llr.judged(many, model).collect()}
    assert all((r.score >= model.threshold) == (i % 4 > 0) for i, r in got.items())
    rows = quality_llr.judged(docs, model).collect()
    assert len(rows) == len(ROWS)
    both = {(r.doc_id, r.n_words, r.word_chars): r for r in rows}
    for i, t in ROWS:
        w = [x.decode() for x in (t or "").encode().split()]
        r = both[(i, len(w), sum(map(len, w)))]
        c, covered = Counter(zip(w, w[1:], w[2:], strict=False)), set()
        for k, x in enumerate(zip(w, w[1:], w[2:], strict=False)):
            if c[x] > 1:
                covered |= {k, k + 1, k + 2}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
    assert quality_llr.fit(many, labels.where("false")).threshold is None
    assert quality_llr.judged(nothing, model).count() == 0
    kept = quality_llr.kept_rows(docs, model)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in rows if r.kept)


def test_likelihood_ratio(spark):
    """Scores against the plain formula over hashed words and pairs; the target counts every trusted row, however small the sample."""
    texts = [(0, "a b a c"), (1, "a a b"), (2, None), (None, "c c"), (3, "b c d e"), (3, "b d")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (3, 1), (1, 0), (9, 1), (0, 1)], "doc_id long, quality int")
    model = quality_llr.fit(docs, labels, sample=1)
    feats = {}
    hashed = lambda *w: docs.sparkSession.range(1).select(F.pmod(F.xxhash64(*(F.lit(x) for x in w)), F.lit(quality_llr.BUCKETS))).first()[0]
    code = {w: docs.sparkSession.range(1).select(F.xxhash64(F.lit(w))).first()[0] for w in "abcde"}
    for k, (_, t) in enumerate(texts):
        w = (t or "").split()
        feats[k] = [code[x] % quality_llr.BUCKETS for x in w] + [hashed(code[x], code[y]) for x, y in zip(w, w[1:], strict=False)]
    raw, good = Counter(), Counter()
    for k, (i, _) in enumerate(texts):
        raw.update(feats[k])
        if i in (0, 3):
            good.update(feats[k])
    n, m = (sum(c.values()) + quality_llr.SMOOTH * quality_llr.BUCKETS for c in (raw, good))
    d = lambda f: np.log((good[f] + quality_llr.SMOOTH) / m) - np.log((raw[f] + quality_llr.SMOOTH) / n)
    want = sorted((str(i), round(float(np.mean([d(f) for f in feats[k]])) if feats[k] else 0.0, 6)) for k, (i, _) in enumerate(texts))
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in quality_llr.judged(docs, model).collect()) == want


def _plain_cut(seen):
    seen = sorted(seen)
    bad, fine = sum(q != 1 for _, q in seen), sum(q == 1 for _, q in seen)
    cuts = [((s + t) / 2, s) for (s, _), (t, _) in zip(seen, seen[1:], strict=False) if t > s]
    return min([(1.0, seen[0][0])] + [(quality_llr.COST * sum(q == 1 and x <= s for x, q in seen) / fine + sum(q != 1 and x > s for x, q in seen) / bad, cut) for cut, s in cuts])[1]


def test_threshold_from_all_labels(spark):
    """The labelled rows beyond the 20,000 of smallest hashes move the threshold."""
    ids = [r.id for r in spark.range(20_400).orderBy(F.xxhash64("id"), "id").collect()]
    level = {i: 3 if n >= 20_000 or n < 200 else (0, 1, 2, 4, 5, 6, 7, 8)[n % 8] for n, i in enumerate(ids)}
    quality = {i: int(n >= 20_000 or level[i] > 3) for n, i in enumerate(ids)}
    docs = spark.createDataFrame([(i, " ".join(["good"] * k + ["bad"] * (8 - k))) for i, k in level.items()], "doc_id long, text string")
    model = quality_llr.fit(docs, spark.createDataFrame(list(quality.items()), "doc_id long, quality int"))
    score = {r.doc_id: r.score for r in quality_llr.judged(docs, model).collect()}
    at = {k: score[i] for i, k in level.items()}
    assert at[2] < model.threshold < at[3] < at[4]


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_cut_over_partitions(spark, coalesce):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    r = np.random.default_rng(5)
    spark.conf.set(key, coalesce)
    try:
        for n, spread in ((300, 40), (300, 10**6), (2, 9), (40, 3)):
            s = [float(x) / 7 for x in r.integers(-spread, spread, n)]
            q = [int(r.random() < 0.5 + x / (3 * max(map(abs, s)) + 1)) for x in s]
            q[:2] = [1, 0]
            scores = spark.createDataFrame([*enumerate(s), (None, -99.0), (n + 5, -99.0)], "doc_id long, score double")
            labels = spark.createDataFrame([*enumerate(q), (n + 9, 1), (None, 0)], "doc_id long, quality int")
            assert quality_llr.best_cut(scores, labels) == _plain_cut(zip(s, q, strict=True))
            assert quality_llr.best_cut(scores, labels.where("quality = 1")) is None
    finally:
        spark.conf.unset(key)


def test_urls(spark):
    urls = ["https://a.example.net/en/x", "http://EXAMPLE.com/de/y?q#z", "http://net", "ftp://b.net/", "nothing", None, "", "x://q.org/fr/1", "http://example.net/de/"]
    spam = ["casino-fun", "cheap-casino", "free-casino", "casino-jackpots", "lucky-casino", "casino-bingo", "best-casino", "casino-club", "casinos-lucky-jackpot", "free-lucky-bingo"]  # the last two hold no seed
    plain = ["thornton", "thentionth", "nothentio", "ontheno", "tionthen", "hothentto", "notitheon", "enthotion", "thinotten", "ottenthin", "thenthen", "notthein"]
    urls += [f"http://{h}.example.com/en/{i}" for h in (*spam, *plain) for i in ("1", "22")]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rows = {r.page_id: r for r in url_lm.filtered(pages).collect()}
    got = {i: (r.host, r.path, r.rule, r.verdict) for i, r in rows.items()}
    assert [got[i][:3] for i in range(9)] == [("a.example.net", "/en/x", "example.net/en/"), ("example.com", "/de/y", "example.com/de/"), ("net", "", None), ("b.net", "/", "net/"), ("", "", None), ("", "", None), ("", "", None), ("q.org", "/fr/1", "org/fr/"), ("example.net", "/de/", "net/")]
    assert [got[i][3] for i in (0, 1, 3, 4, 5, 7, 8)] == ["allow", "block", "block", "allow", "allow", "allow", "block"]
    assert [rows[9 + 2 * k].seeded for k in range(10)] == [True] * 8 + [False] * 2
    assert {got[i][3] for i in range(25, 29)} == {"block"}, "unlisted look-alikes are judged by spelling"
    assert {got[i][3] for i in range(29, 53)} == {"allow"}
    none = url_lm.filtered(pages, seeds=("nowhere",)).where("rule is null").select("verdict").distinct().collect()
    assert [r.verdict for r in none] == ["allow"]
    assert url_lm.filtered(pages.where("false")).count() == 0


def _ratio(gram, counts):
    """The interpolated probability of a gram's last character, by recursion over (gram, count) pairs."""
    sums = Counter()
    for g, n in counts.items():
        sums[g[len(g) - len(gram) :]] += n
    here = {g: n for g, n in sums.items() if g[:-1] == gram[:-1]}
    p = 1 / url_lm.SYMBOLS if len(gram) == 1 else _ratio(gram[1:], counts)
    n, t = sum(here.values()), sum(x > 0 for x in here.values())
    return (here.get(gram, 0) + t * p) / (n + t) if n + t else p


def test_scores_leave_the_host_out(spark):
    rows = [("abab/0", 0, 3, 0), ("abba", 1, 1, 2), ("b.c/a", 2, 0, 4), ("abc", 1, 2, 0)]
    strings = spark.createDataFrame(rows, "s string, fold int, good long, bad long")
    got = {r.s: r.score for r in url_lm.scored(strings, order=2, folds=3).collect()}
    grams = lambda s: [("^^" + s)[i : i + 3] for i in range(len(s))]
    for s, fold, _, _ in rows:
        one, two = Counter(), Counter()
        for t, f, good, bad in rows:
            for g in grams(t):
                one[g] += good * (f != fold)
                two[g] += bad * (f != fold)
        assert got[s] == pytest.approx(np.mean([np.log(_ratio(g, one)) - np.log(_ratio(g, two)) for g in grams(s)]))


def test_licenses(spark):
    files = [("r/LICENSE", "x\nReleased under the MIT License.\n"), ("r/a.py", "code"), ("r/b/c/d.py", None), ("r/b/COPYING.txt", "this WORK is licensed under the gnu general public license, version 3"), ("r/b/e.py", "Licensed under CC BY-NC 4.0."), ("s/f.py", ""), (None, "Mit der Zeit"), ("r/a.py", "code"), ("top.py", "the license")]
    df = spark.createDataFrame([(i, p, t, "clash") for i, (p, t) in enumerate(files)], "id long, path string, text string, own string")
    got = {r.id: (r.license, r.origin) for r in licenses.scan(df, "id").collect()}
    assert got == {0: ("mit", "own"), 1: ("mit", "inherited"), 2: ("gpl-3.0", "inherited"), 3: ("gpl-3.0", "own"), 4: ("cc-by-nc-4.0", "own"), 5: (None, None), 6: (None, None), 7: ("mit", "inherited"), 8: (None, None)}
    assert licenses.scan(df.where("false"), "id").count() == 0


def test_licence_passages(spark):
    """Passages in longer lines, over line ends and in bodies, and what a directory inherits from them."""
    gpl = "it under the terms of the GNU General Public License as published by"
    texts = [
        ("a/x.py", "// Copyright 2019 The Authors. Licensed under the Apache License, Version 2.0\ncode", "apache-2.0"), ("b/x.py", "# SPDX-License-Identifier: MIT\ncode", "mit"),
        ("c/COPYING", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\nmore", "gpl-3.0"), ("c/d/x.py", "code", "gpl-3.0"), ("e/x.py", "GNU GENERAL PUBLIC LICENSE", "gpl"),
        ("f/x.py", f" * {gpl}\n * the Free Software Foundation; either version 2 of\n * the License, or later", "gpl-2.0"), ("g/x.py", f"{gpl} somebody", "gpl"),
        ("h/x.py", "x\n# Licensed under the\n#   MIT License. See there", "mit"), ("i/LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files", "mit"),
        ("j/x.py", "no license is given for the permission of gnu", None), ("k/x.py", "SPDX-License-Identifier: Other", None),
    ]
    df = spark.createDataFrame([(i, p, t) for i, (p, t, _) in enumerate(texts)], "id long, path string, text string")
    assert {r.id: r.license for r in licenses.scan(df, "id").collect()} == {i: x for i, (_, _, x) in enumerate(texts)}


def _cosine(a, b, idf, other):
    """Of two lists of terms; a term without a weight weighs other."""
    weigh = lambda t: {w: n * idf.get(w, other) for w, n in Counter(t).items()}
    x, y = weigh(a), weigh(b)
    return sum(v * y.get(w, 0.0) for w, v in x.items()) / (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5


def _plain_scan(files):
    """{key: (own, score, license, origin)} of (key, path, text): every line against every template, every window of a passage's length
    in which a key term lies where the passage has it against that passage, every ancestor directory in turn."""
    idf = lambda ts: {w: math.log(1 + len(ts) / sum(w in t for t in ts)) for t in ts for w in t}
    lines, parts = ([(n, licenses.terms(t)) for n, t in x] for x in (licenses.TEMPLATES, licenses.PASSAGES))
    by_line, by_part = idf([t for _, t in lines]), idf([t for _, t in parts])
    own, given = {}, {}
    for key, path, text in files:
        best = (0.0, 0, "")
        for line in (text or "").split("\n"):
            words = licenses.terms(line)
            if set(words) & {w for w in by_line if w not in licenses.COMMON}:
                best = max(best, *((round(_cosine(words, t, by_line, math.log(1 + len(lines))), 9), 0, n) for n, t in lines))
        words = licenses.terms(text or "")
        for name, t in parts:
            mark = next(k for k in licenses.KEYS if k in t)
            for i in range(len(words) - len(t) + 1):
                block = words[i : i + len(t)]
                if any(x == y == mark for x, y in zip(block, t, strict=True)):
                    best = max(best, (round(_cosine(block, t, by_part, math.log(1 + len(parts))), 9), len(t), name))
        own[key] = (best[2], best[0]) if best[0] >= licenses.SIMILAR else (None, None)
        if path is not None and own[key][0] and re.search(licenses.LICENCE_FILES, path):
            given.setdefault(path.rpartition("/")[0], []).append((-best[0], best[2]))
    out = {}
    for key, path, _ in files:
        name, score = own[key]
        dirs = [] if path is None else path.split("/")[:-1]
        found = next((min(given[d])[1] for n in range(len(dirs), -1, -1) for d in ["/".join(dirs[:n])] if path is not None and d in given), None)
        out[key] = (name, score, name or found, "own" if name else "inherited" if found else None)
    return out


def test_license_scan_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files"
    extra = [mit, f"{'word ' * 3000}{mit}", "// SPDX-License-Identifier:\n// MPL-2.0", "the GNU General\n * Public License", "Licensed under the Apache License, Version 2.0 and more", "license " * 40, None, ""]
    texts = [r.text for r in docs] + extra
    names = ["LICENSE", "a.py", "b/c.py", "b/NOTICE.md", "b/d/e/f.py"]
    files = [(i, None if i % 17 == 0 else f"r{i // 7 % 9}/{names[i % 5]}", t) for i, t in enumerate(texts)]
    files += [(len(files) + i, p, "x") for i, p in enumerate(["top.py", "r1/b/d/x.py", "r2/z/y.py"])]
    got = {r.id: (r.own, r.score and round(r.score, 6), r.license, r.origin) for r in licenses.scan(spark.createDataFrame(files, "id int, path string, text string"), "id").collect()}
    want = {k: (o, s and round(s, 6), x, g) for k, (o, s, x, g) in _plain_scan(files).items()}
    assert got == want and {g for *_, g in want.values()} == {"own", "inherited", None}


def test_gradients():
    net, r = toxicity.Net(3), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    gates, mask = r.standard_normal((2, 5, 3, 3 * toxicity.HIDDEN)), np.ones((2, 5, 3, 1))
    mask[0, 3:, 1], mask[1, :2, 1] = 0, 0
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        z = net.run(gates, mask)[0].astype(np.float64)
        return float(np.mean(np.log1p(np.exp(-np.where(y > 0, z, -z)))))

    _, g, dgates = net.gradients(gates, mask, y)
    for name, at in (("U", (0, 2, 5)), ("U", (1, 1, 20)), ("A", (3, 2)), ("v", (1,)), ("w", (4,))):
        keep = net.p[name][at]
        net.p[name][at] = keep + 1e-2
        up = loss()
        net.p[name][at] = keep - 1e-2
        down = loss()
        net.p[name][at] = keep
        assert g[name][at] == pytest.approx((up - down) / 2e-2, rel=0.05, abs=2e-5)


def test_toxicity(spark, docs, nothing):
    r = np.random.default_rng(0)
    rows = [(i, " ".join([*r.choice(WORDS, 80), *(["vile"] * 3 if i % 2 else []), *r.choice(WORDS, 40)])) for i in range(300)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (500, None)], "doc_id long, toxic int")
    model = toxicity.fit(texts, labels)
    got = {x.doc_id: x.score for x in toxicity.scores(texts, model).collect()}
    assert np.mean([(got[i] >= 0.5) == (i % 2 == 1) for i in range(200, 300)]) > 0.95
    assert all(0 <= x.score <= 1 for x in toxicity.scores(docs, model).collect())
    assert toxicity.scores(nothing, model).count() == 0
    assert toxicity.fit(texts, labels.where("toxic = 0")) == 0.0
    # the score is the largest logit over all windows, each read alone
    scorer, text = toxicity.Scorer(model[0], rows=3), " ".join(r.choice(WORDS, 400)).encode()
    own = text.split()
    alone = [float(scorer.logits([b" ".join(own[s:e])])[0]) for s, e in toxicity.windows(400)]
    assert float(scorer.logits([b"other words", text, b""])[1]) == pytest.approx(max(alone), abs=1e-4) and len(alone) > 4
    assert [toxicity.windows(n) for n in (0, 64, 65, 130)] == [[(0, 0)], [(0, 64)], [(0, 64), (1, 65)], [(0, 64), (48, 112), (66, 130)]]


def test_forward_pass():
    """The batched network against one word after another in plain arithmetic."""
    net, h = toxicity.Net(5), toxicity.HIDDEN
    words = [b"alpha", b"be", b"c", b"alpha", b"delta"]
    x = net.embed(toxicity.word_parts(words)).astype(np.float64)
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    sig = lambda z: 1 / (1 + np.exp(-z))
    both = []
    for way, order in ((0, range(5)), (1, range(4, -1, -1))):
        state, states = np.zeros(h), {}
        for t in order:
            g, rec = x[t] @ p["W"][way] + p["b"][way, 0], state @ p["U"][way]
            z, q = sig(g[:h] + rec[:h]), sig(g[h : 2 * h] + rec[h : 2 * h])
            state = z * state + (1 - z) * np.tanh(g[2 * h :] + q * rec[2 * h :])
            states[t] = state
        both.append([states[t] for t in range(5)])
    both = np.concatenate(both, axis=1)
    e = np.exp(np.tanh(both @ p["A"]) @ p["v"])
    want = (e / e.sum()) @ both @ p["w"] + p["c"][0]
    assert float(toxicity.Scorer(net).logits([b" ".join(words)])[0]) == pytest.approx(want, abs=1e-4)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = lambda df: {r.doc_id: r.text or "" for r in df.collect()}
    kept = dict(corpus_pipeline.STAGES)
    a = kept["quality_rules"](spark, docs, SF)
    assert a.columns == docs.columns and 0 < a.count() < docs.count()
    b = kept["line_dedup"](spark, a, SF)
    con = duckdb.connect()
    con.register("documents", a.toPandas())
    assert {i: sha256(t.encode()).hexdigest() for i, t in text(b).items()} == {r[0]: r[3] for r in con.sql(line_dedup.OP2_SQL).fetchall()}
    b = spark.createDataFrame(b.collect(), docs.schema)
    c = kept["simhash_dedup"](spark, b, SF)
    assert {r.doc_id for r in c.collect()} == {g for _, g in _similar_groups([(r.doc_id, r.text) for r in b.collect()])}
    d = kept["decontamination"](spark, c, SF)
    items = [set(decontaminate.shingles(r.text.encode())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaky = lambda t: any(len(x & own) >= 0.8 * len(x) for own in [set(decontaminate.shingles(t.encode()))] for x in items)
    assert set(text(d)) == {i for i, t in text(c).items() if not leaky(t)}
    path = P.path("word_bpe_49k.json")
    tok, pieces = token_cache.tokenizer(path), {}
    for r in kept["packing"](spark, d, SF).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(text(d))
    for i, t in text(d).items():
        ids, at = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.ids_crc32, r.doc_tokens) == (at, zlib.crc32(ids[at : at + r.length].tobytes()), len(ids))
            at += r.length
        assert at == len(ids)


def test_pipeline_quality_by_all_labels(spark, tmp_path):
    """The first stage's cut is that of all labelled rows, also beyond the 20,000 of smallest hashes."""
    import corpus_pipeline

    ids = [r.id for r in spark.range(-41, 20_400).where("id >= 0 or id % 2 = 0").orderBy(F.xxhash64("id"), "id").collect()]
    level = {i: 3 if n >= 20_000 or n < 200 else (0, 1, 2, 4, 5, 6, 7, 8)[n % 8] for n, i in enumerate(ids) if i >= 0}
    short = [(i, " ".join(["good"] * k + ["bad"] * (8 - k))) for i, k in level.items()]
    long = [(-1 - k, " ".join(w for x in range(40) for w in ("good" if x < k else "bad", f"w{x}"))) for k in range(41)]  # no three-word window comes twice
    docs = spark.createDataFrame(short + long, "doc_id long, text string")
    quality = {i: int(n >= 20_000 or level.get(i, 8) > 3) for n, i in enumerate(ids)}
    spark.createDataFrame(list(quality.items()), "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    model = quality_llr.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    score = {r.doc_id: r.score for r in quality_llr.judged(docs, model).collect()}
    cuts = []
    for few in (ids, ids[:20_000]):
        by = Counter((score[i], quality[i]) for i in few)
        steps = sorted({s for s, _ in by})
        cost = lambda t: quality_llr.COST * sum(n for (s, q), n in by.items() if q and s < t) / sum(n for (_, q), n in by.items() if q) + sum(n for (s, q), n in by.items() if not q and s >= t) / sum(n for (_, q), n in by.items() if not q)  # noqa: B023, E731
        cuts.append(min([steps[0], *((s + t) / 2 for s, t in zip(steps, steps[1:], strict=False))], key=cost))
    want, sampled = ({k for k, _ in long if score[k] >= t} for t in cuts)
    assert want != sampled
    assert {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, str(tmp_path)).collect()} == want


def test_pipeline_rows(spark, docs, nothing):
    """Null and repeated ids, clashing columns and empty tables, stage by stage."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SF).count() == 0, name
        if name != "packing":
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and all(r[k] == "clash" for r in out.collect() for k in CLASH.split() if k not in ("n_chars",)), name
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(5, "A " * 9 + "own words of the first text"), (5, f"before {item} after"), (None, item), (None, "another text of its own without anything"), (3, "words that nobody else has written here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, stages["decontamination"](spark, df, SF).collect())) == Counter([rows[0], *rows[3:]])
    a, b = (" ".join(f"{k}{i}" for i in range(40)) for k in "ab")
    rows = [(5, a), (5, b), (3, b), (None, a), (None, None), (9, ""), (4, "c"), (4, "c"), (None, "d"), (None, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, stages["simhash_dedup"](spark, df, SF).collect())) == Counter([(5, a), (3, b), (9, ""), (4, "c"), (None, "d")])
    assert stages["packing"](spark, df, SF).count() == len(rows)


def test_folder_must_be_shared():
    from types import SimpleNamespace

    from baseloom.llm import common

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        sc = SimpleNamespace(getConf=lambda: {}, getCheckpointDir=lambda: None, master=master)
        with pytest.raises(RuntimeError, match="checkpoint"):
            common.shared_dir(SimpleNamespace(sparkContext=sc))
