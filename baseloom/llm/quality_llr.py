"""Quality rules: a log-likelihood ratio of hashed n-grams, trusted target against raw corpus; built-in functions only.

Features are words and word pairs, hashed into BUCKETS. The raw multinomial counts every document of the corpus; the
target multinomial counts every trusted one (label 1). Both are smoothed. A document's score is the mean over its features of
log(p_target / p_raw). The threshold is fitted on all labelled rows: the score which best separates label 1
from label 0, where a trusted document lost counts COST times a bad one kept; it is then applied to every document.
Scores (without texts) are range-partitioned and sorted, so running counts over all of them need no single task.

Base rules besides: n_words under 50, or over half of the words in 3-word windows that occur twice or more.

Defined cases. Null or empty text: no words, all counts 0, score 0, fails the base rules. Null doc_id: judged, never a labelled row. Repeated
rows: judged each; a doc_id labelled twice has its lowest label. No labels, or labels of one kind only: no threshold,
the base rules decide alone. Empty table: no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, stored

BUCKETS, SMOOTH, COST = 1 << 14, 0.5, 4.0
MIN_WORDS = 50


def _split(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")


def features(text: Column) -> Column:
    """array<int> of the buckets of a text's words and word pairs."""
    hashed = F.transform(_split(text), lambda w: F.xxhash64(w))

    def both(h):
        pairs = F.zip_with(h, F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))
        return F.transform(F.filter(F.concat(h, pairs), lambda x: x.isNotNull()), lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int"))

    return let(hashed, both)


def _repeats(words: Column) -> Column:
    """How many words stand in 3-word windows found twice or more."""

    def of(h):
        n = F.size(h) - 2
        windows = F.transform(F.slice(h, 1, F.greatest(n, F.lit(0))), lambda x, i: F.xxhash64(x, h[i + 1], h[i + 2]))

        def counted(w):
            order = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
            again = let(order, lambda s: F.filter(F.transform(s, lambda e, k: F.when((k > 0) & (F.try_element_at(s, k)["x"] == e["x"]) | (F.get(s, k + 1)["x"] == e["x"]), e["i"])), lambda i: i.isNotNull()))
            starts = F.sort_array(again)
            cover = let(starts, lambda s: F.aggregate(s, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"]))
            return F.when(F.size(w) == F.size(F.array_distinct(w)), 0).otherwise(cover)

        return let(windows, counted)

    return F.when(F.size(words) < 3, 0).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), of))


def base_counts(text: Column) -> Column:
    """struct(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = F.coalesce(text, F.lit(""))
    full = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^ \\t-\\r]"))
    again = let(full, lambda x: F.size(x) - F.size(F.array_distinct(x)))

    def counted(w):
        joined = F.array_join(w, "")
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(joined).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(joined, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            again.cast("long").alias("n_dup_lines"),
            _repeats(w).cast("long").alias("n_repeat_words"),
        )

    return let(_split(text), counted)


def fails(counts: Column) -> Column:
    return (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])


@dataclass
class Model:
    """BUCKETS weights (fixed size) and a threshold, or none."""

    weights: list[float]
    threshold: float | None

    def score(self, text: Column) -> Column:
        weights = F.split(F.lit(",".join(f"{w:.9g}" for w in self.weights)), ",").cast("array<double>")  # folded to a literal
        return let(features(text), lambda f: F.when(F.size(f) > 0, F.aggregate(f, F.lit(0.0), lambda a, x: a + F.get(weights, x)) / F.size(f)).otherwise(0.0))


def _qualities(labels: DataFrame) -> DataFrame:
    own = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"))
    return own.select(F.col("doc_id").cast("long").alias("l_id"), "q")


def weigh(docs: DataFrame, labels: DataFrame) -> Model:
    """The weights, from all rows of docs; no threshold yet."""
    from math import log

    # rows without an id join nothing, and are dealt by their texts
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    keyed = rows.select("doc_id", "text", F.coalesce("doc_id", F.xxhash64("text")).alias("key"))
    trusted = _qualities(labels).where("q = 1").select("l_id")
    # one plan at every size: texts are dealt by their ids, never sorted, and the ids of a partition are its hash table
    known = keyed.join(trusted.hint("shuffle_hash"), (F.col("key") == F.col("l_id")) & F.col("doc_id").isNotNull(), "left")
    counts = known.select("l_id", F.explode(features(F.col("text"))).alias("k")).groupBy("k").agg(F.count("*").alias("raw"), F.count("l_id").alias("good"))
    raw, good = [SMOOTH] * BUCKETS, [SMOOTH] * BUCKETS
    for r in counts.collect():  # a row a bucket
        raw[r.k] += r.raw
        good[r.k] += r.good
    a, b = sum(raw), sum(good)
    return Model([log(y / b) - log(x / a) for x, y in zip(raw, good, strict=True)], None)


def best_cut(scores: DataFrame, labels: DataFrame, sample: int | None = None) -> float | None:
    """The threshold for (doc_id, score) rows with text: the cheapest cut between two neighbouring scores of labelled ids, or below all."""
    own = _qualities(labels)
    if sample is not None:
        own = own.orderBy(F.xxhash64("l_id"), "l_id").limit(sample)
    # an id may stand on many rows: one score for each
    ids = scores.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("score").alias("s"))
    seen = ids.join(own.hint("shuffle_hash"), F.col("doc_id") == F.col("l_id"))
    levels = seen.groupBy("s").agg(F.count_if(F.col("q") == 1).alias("fine"), F.count_if(F.col("q") != 1).alias("bad"))
    # which partition a score is in must not change between the jobs that follow, so it is written with the score
    levels = stored(levels.repartitionByRange("s").sortWithinPartitions("s").withColumn("part", F.spark_partition_id()), "quality-levels")
    totals = levels.groupBy("part").agg(F.sum("fine").alias("part_fine"), F.sum("bad").alias("part_bad"), F.min("s").alias("low"))
    by_part = Window.orderBy("part")  # over one row a partition
    before, all_ = by_part.rowsBetween(Window.unboundedPreceding, -1), by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "part", F.lead("low").over(by_part).alias("next_low"), F.min("low").over(all_).alias("least"),
        *(F.coalesce(F.sum(f"part_{c}").over(before), F.lit(0)).alias(f"{c}_before") for c in ("fine", "bad")), *(F.sum(f"part_{c}").over(all_).alias(f"all_{c}") for c in ("fine", "bad")),
    )
    inside = Window.partitionBy("part").orderBy("s")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = levels.select("part", "s", F.lead("s").over(inside).alias("t"), F.sum("fine").over(upto).alias("fine_in"), F.sum("bad").over(upto).alias("bad_in"))
    placed = placed.join(F.broadcast(offsets), "part")  # a row for each shuffle partition
    lost, kept = F.col("fine_before") + F.col("fine_in"), F.col("all_bad") - F.col("bad_before") - F.col("bad_in")
    cost = F.lit(COST) * lost / F.col("all_fine") + kept / F.col("all_bad")
    t = F.coalesce("t", "next_low")
    cuts = placed.where((F.col("all_fine") > 0) & (F.col("all_bad") > 0)).select("least", F.when(t.isNotNull(), F.struct(cost.alias("cost"), ((F.col("s") + t) / 2).alias("cut"))).alias("at"))
    r = cuts.agg(F.min("least").alias("least"), F.min("at").alias("at")).first()
    if r.least is None:
        return None
    return min((1.0, r.least), tuple(r.at) if r.at else (1.0, r.least))[1]


def fit(docs: DataFrame, labels: DataFrame, sample: int | None = None) -> Model:
    """Weights from all rows, the threshold from all labelled rows; with `sample`, from at most so many, those with the smallest hashes of their ids."""
    model = weigh(docs, labels)
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    model.threshold = best_cut(rows.where("octet_length(text) > 0").select("doc_id", model.score(F.col("text")).alias("score")), labels, sample)
    return model


def likely(text: Column, model: Model) -> Column:
    """Whether the method keeps a text."""
    return model.score(text) >= model.threshold if model.threshold is not None else F.lit(True)


def kept_rows(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that are kept, all columns."""
    text = F.col("text")
    return docs.where(~fails(base_counts(text)) & likely(text, model))


def _counted(docs: DataFrame, model: Model) -> DataFrame:
    """What does not depend on the threshold; `some` tells whether there is text at all."""
    rows = docs.select("doc_id", base_counts(F.col("text")).alias("c"), model.score(F.col("text")).alias("score"), (F.octet_length("text") > 0).alias("some"))
    return rows.select("doc_id", "c.*", "score", "some").withColumn("base_failed", fails({c: F.col(c) for c in ("n_words", "n_repeat_words")}))


def _decided(rows: DataFrame, model: Model) -> DataFrame:
    fine = F.col("score") >= model.threshold if model.threshold is not None else F.lit(True)
    return rows.drop("some").withColumn("kept", ~F.col("base_failed") & fine)


def judged(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept) for each row of docs."""
    return _decided(_counted(docs, model), model)


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = weigh(docs, labels)
    rows = stored(_counted(docs, model), "quality-rows")  # no texts; the same scores give the threshold and the verdicts
    model.threshold = best_cut(rows.where("some").select("doc_id", "score"), labels)
    return _decided(rows, model)
