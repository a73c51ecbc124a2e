"""Token counts through a digest cache.

A text's key is the SHA-256 of its normalised content (null becomes empty; nothing else, as every other change could
change the count) with the digest of the tokenizer's file. Keys join the stored counts; the texts of the keys that are not
stored, one for each, are encoded and their counts appended to the cache as Parquet; then all rows join the cache.
A hot text is one key: it is encoded once. Digests that more than one row in HOT has, of which there are fewer than HOT, are broadcast with their counts;
their rows are dealt by their ids where the others join the cache, so no task gets a hot text's rows.

Within a worker, counts of words are kept too: where every white-space run is a single character, a word with the space
before it is always a pre-token of its own, so a text's count is the sum of its words' counts by the library. Other
texts go to the library whole. The memory for words is bounded.

Defined cases. Null or empty text: 0 bytes, 0 tokens. Repeated rows and null doc_ids: one result row each. Empty table:
no rows. A cache that holds a key twice (two writers) is read once. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, stored, tidy

LIMIT = 512
HOT = 4096
CACHE = "digest binary, n_tokens long"
WORDS_KEPT = 1_000_000
_RUN = re.compile(r"\s\s")


def tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


#: Stands between the words of one call: a pre-token of its own, and one token, in both tokenizers.
MARK = " |"


def encode_words(tok, words: list[str]):
    """(ids, ends) of words as if each were encoded alone: word i has ids[ends[i - 1] : ends[i]]. Far fewer calls.

    A word starts with its white space. Words that hold the mark, or have white space at other ends, do go alone.
    """
    import numpy as np

    marks = tok.encode(MARK, add_special_tokens=False).ids
    ids, ends, base, groups, plain = [], [], 0, [], False
    for w in words:
        alone = "|" in w or w[1:].strip() != w[1:] or len(w) < 2 or len(marks) != 1
        if alone or not plain or len(groups[-1]) >= 256:
            groups.append([w])
        else:
            groups[-1].append(w)
        plain = not alone
    for group, e in zip(groups, tok.encode_batch_fast([MARK.join(g) for g in groups], add_special_tokens=False), strict=True):
        part = np.array(e.ids, "<u4")
        if len(group) > 1:
            at = np.append(np.flatnonzero(part == marks[0]), len(part))
            ends.append(base + at - np.arange(len(at)))
            part = part[part != marks[0]]
        else:
            ends.append(np.array([base + len(part)]))
        ids.append(part)
        base += len(part)
    return (np.concatenate(ids), np.concatenate(ends)) if ids else (np.zeros(0, "<u4"), np.zeros(0, np.int64))


class WordCounts:
    """Token counts of texts, by way of counts of words where that is exact."""

    def __init__(self, path: str, kept: int = WORDS_KEPT):
        self.tok, self.kept, self.words = tokenizer(path), kept, {}

    def encode(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def counts(self, texts: list[str]) -> list[int]:
        out, split = [0] * len(texts), {}
        slow = [i for i, t in enumerate(texts) if _RUN.search(t)]
        for i in set(range(len(texts))).difference(slow):
            split[i] = texts[i].replace("\n", " \n").split(" ")  # a word after a line's end starts with that
        for i, n in zip(slow, self.encode([texts[i] for i in slow]), strict=True):
            out[i] = n
        firsts = list(split)
        for i, n in zip(firsts, self.encode([split[i][0] for i in firsts]), strict=True):
            out[i] = n
        if len(self.words) > self.kept:
            self.words.clear()
        new: set[str] = set()
        for words in split.values():
            new.update(words[1:])
        miss = list(new.difference(self.words))
        ends = encode_words(self.tok, [w if w[:1] == "\n" else " " + w for w in miss])[1]
        if miss:
            self.words[miss[0]] = int(ends[0])
            self.words.update(zip(miss[1:], (ends[1:] - ends[:-1]).tolist(), strict=True))
        get = self.words.__getitem__
        for i, words in split.items():
            out[i] += sum(map(get, words[1:]))
        return out


def _encode(path: str):
    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counter = WordCounts(path)
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counter.counts(part.column(1).to_pylist()), pa.int64())], ["digest", "n_tokens"])

    return encode


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for each row of docs; counts of texts that the cache lacks are appended to it.

    tokenizer_path is the same on driver and executors; cache_path lies in storage that all of them share.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as f:
        version = hashlib.sha256(f.read()).hexdigest()
    text = F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.sha2(text, 256), F.lit(version)), 256))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), digest.alias("digest"), text.alias("text"))
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache_path)  # so that a new cache can be read

    def cache() -> DataFrame:
        return spark.read.schema(CACHE).parquet(cache_path).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    misses = rows.select("digest", "text").join(cache().select("digest"), "digest", "left_anti").dropDuplicates(["digest"])
    misses.mapInArrow(tidy(_encode(tokenizer_path)), CACHE).write.mode("append").parquet(cache_path)
    keyed = stored(rows.drop("text"), "digests")
    many = keyed.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > keyed.count() / HOT).select("digest")
    hot = F.broadcast(cache().join(F.broadcast(many), "digest").select(F.col("digest").alias("h_digest"), F.col("n_tokens").alias("h_tokens")))  # fewer than HOT rows
    left = keyed.join(hot, F.col("digest") == F.col("h_digest"), "left")
    own = F.when(F.col("h_digest").isNull(), F.col("digest")).otherwise(F.encode(F.xxhash64("doc_id").cast("string"), "UTF-8"))  # no digest: those have 32 bytes
    counts = cache().select(F.col("digest").alias("c_digest"), "n_tokens")
    out = left.withColumn("own", own).join(counts, F.col("own") == F.col("c_digest"), "left")
    return out.select("doc_id", "n_bytes", F.coalesce("h_tokens", "n_tokens").alias("n_tokens"))


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), new_path(spark, "token-cache"))
    return out.withColumn("over_limit", F.col("n_tokens") > LIMIT)
