"""URL filters: rules by host and path, and a character language-model ratio; built-in functions only.

Two variable-order Markov models over characters, of accepted and of rejected URLs, with Witten-Bell smoothing: a context
that a model has not seen falls back to the next shorter one. A URL's score is the mean over its characters of the
difference of log-likelihoods (accepted minus rejected), so long URLs are not favoured.

Labels for training: a URL whose host or path holds one of the seed terms between separators is rejected, others are accepted. A URL is
never scored by models that have seen its host: hosts (digits collapsed) are dealt over FOLDS folds, and each fold is scored by the
counts of all others. So a seed term in a URL, or its own listing as accepted, does not decide its verdict; spelling does. The threshold is calibrated on
these held-out scores, as the point at which both classes' scores are equally many standard deviations away. The models are trained twice: accepted URLs that
the first ones reject train neither class the second time. Rules come before the models. Counts cover every URL.
Characters are A-Z lower-cased, digits one symbol, all others but letters, '-', '.' and '/' one symbol; equal strings are counted once with
their multiplicity, so a hot host costs as much as a rare one. Rows meet their string's verdict by a salted join; the join of a
frequent gram is left to adaptive splitting.

Defined cases. Null url, or one without '://': host and path empty, no rule, allowed. Empty host: no rule fits. Repeated
rows and null page_ids: judged each. No rejected URL in the table: everything without a rule is allowed. Empty table:
no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
SEEDS = ("casino", "poker", "bet", "porn", "adult", "sex", "xxx", "ads", "adserver", "track", "tracker", "viagra", "pills", "loan", "warez")
ORDER, FOLDS, SALTS = 4, 8, 8
SYMBOLS = 26 + 1 + 1 + 3  # letters, digit, other, the three kept


def parts(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)


def rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as a string, and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def normal(host: Column, path: Column) -> Column:
    low = ascii_lower(F.concat(host, path))
    return F.regexp_replace(F.regexp_replace(low, "[0-9]+", "0"), "[^a-z0./-]+", "_")


def _grams(strings: DataFrame, order: int) -> DataFrame:
    """(s, fold, good, bad, gram) for each character: it with the order characters before it; '^' pads the start."""
    padded = F.concat(F.lit("^" * order), F.col("s"))
    return strings.where("s <> ''").select("s", "fold", "good", "bad", F.explode(F.transform(F.sequence(F.lit(1), F.length("s")), lambda i: F.substring(padded, i, F.lit(order + 1)))).alias("gram"))


def ratios(strings: DataFrame, order: int = ORDER, folds: int = FOLDS) -> DataFrame:
    """(gram, k, d) for each gram and fold: log-likelihood difference of the gram's last character after the ones before it, by interpolation, without fold k's counts."""
    own = stored(_grams(strings, order).groupBy("gram", "fold").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "url-grams")
    # a gram has a row for every fold, with no counts where only that fold has it
    dealt = own.select("gram", "good", "bad", "fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("k"))
    others = lambda c: F.sum(F.when(F.col("fold").eqNullSafe(F.col("k")), 0).otherwise(F.col(c))).alias(c)
    levels = [stored(dealt.groupBy("gram", "k").agg(others("good"), others("bad")), "url-levels")]
    for _ in range(order):
        levels.append(levels[-1].select(F.expr("substring(gram, 2)").alias("gram"), "k", "good", "bad").groupBy("gram", "k").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")))
    lower = None
    for level in reversed(levels):
        context = F.expr("substring(gram, 1, length(gram) - 1)")
        stats = level.groupBy(context.alias("c_context"), F.col("k").alias("c_k")).agg(*(f for c in ("good", "bad") for f in (F.sum(c).alias(f"n_{c}"), F.count_if(F.col(c) > 0).alias(f"t_{c}"))))
        level = level.withColumn("context", context).join(stats, (F.col("context") == F.col("c_context")) & (F.col("k") == F.col("c_k")))
        if lower is None:
            level = level.withColumns({f"p_{c}": F.lit(1.0 / SYMBOLS) for c in ("good", "bad")})
        else:
            below = lower.select(F.col("gram").alias("l_gram"), F.col("k").alias("l_k"), F.col("q_good").alias("p_good"), F.col("q_bad").alias("p_bad"))
            level = level.join(below, (F.expr("substring(gram, 2)") == F.col("l_gram")) & (F.col("k") == F.col("l_k")))
        q = {f"q_{c}": F.when(F.col(f"n_{c}") + F.col(f"t_{c}") > 0, (F.col(c) + F.col(f"t_{c}") * F.col(f"p_{c}")) / (F.col(f"n_{c}") + F.col(f"t_{c}"))).otherwise(F.col(f"p_{c}")) for c in ("good", "bad")}
        lower = level.withColumns(q).select("gram", "k", "q_good", "q_bad")
    return lower.select("gram", "k", (F.log("q_good") - F.log("q_bad")).alias("d"))


def scored(strings: DataFrame, order: int = ORDER, folds: int = FOLDS) -> DataFrame:
    """(s, good, bad, score) for each distinct non-empty string; good and bad are how often it is labelled so."""
    d = ratios(strings, order, folds).select(F.col("gram").alias("d_gram"), "k", "d")
    return _grams(strings, order).join(d, (F.col("gram") == F.col("d_gram")) & (F.col("fold") == F.col("k"))).groupBy("s").agg(F.avg("d").alias("score"), F.first("good").alias("good"), F.first("bad").alias("bad"))


def threshold(scores: DataFrame) -> DataFrame:
    """One row: cut, null if a class is missing."""
    def moments(k):
        n = F.sum(k)
        mean = F.try_divide(F.sum(F.col(k) * F.col("score")), n)
        return [n.alias(f"n_{k}"), mean.alias(f"m_{k}"), F.sqrt(F.greatest(F.try_divide(F.sum(F.col(k) * F.col("score") * F.col("score")), n) - mean * mean, F.lit(0.0))).alias(f"s_{k}")]

    x = scores.agg(*moments("good"), *moments("bad"))
    # a class of equal strings has no spread of its own; a twentieth of the distance keeps the cut between the means
    least = 0.05 * F.abs(F.col("m_good") - F.col("m_bad")) + 1e-9
    good, bad = F.col("s_good") + least, F.col("s_bad") + least
    cut = F.try_divide(F.col("m_good") * bad + F.col("m_bad") * good, good + bad)
    return x.select(F.when((F.col("n_good") > 0) & (F.col("n_bad") > 0), cut).alias("cut"))


def filtered(pages: DataFrame, rules=RULES, seeds=SEEDS, order: int = ORDER, folds: int = FOLDS) -> DataFrame:
    """(page_id, host, path, rule, verdict, score, seeded) for each row of pages; seeded: the URL was trained on as rejected."""
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", name.alias("rule"), verdict.alias("by_rule"), normal(F.col("host"), F.col("path")).alias("s"))
    seeded = F.col("s").rlike(f"(^|[^a-z])({'|'.join(seeds)})([^a-z]|$)")
    fold = F.pmod(F.xxhash64(F.substring_index("s", "/", 1)), F.lit(folds)).cast("int")  # a host has no slash
    strings = rows.groupBy("s").agg(F.count("*").alias("n")).select("s", fold.alias("fold"), F.when(seeded, 0).otherwise(F.col("n")).alias("good"), F.when(seeded, F.col("n")).otherwise(0).alias("bad"))
    strings = stored(strings, "url-strings")
    first = stored(scored(strings, order, folds), "url-scores")
    doubtful = first.crossJoin(F.broadcast(threshold(first))).where("bad = 0 and score < cut").select("s", F.lit(True).alias("doubt"))  # one row is joined to all
    relabelled = strings.join(doubtful, "s", "left").select("s", "fold", F.when(F.col("doubt"), 0).otherwise(F.col("good")).alias("good"), "bad")
    scores = stored(scored(stored(relabelled, "url-strings"), order, folds), "url-scores")
    cut = F.broadcast(threshold(scores))  # one row
    method = scores.crossJoin(cut).select(F.col("s").alias("m_s"), "score", (F.col("bad") > 0).alias("seeded"), F.when(F.col("score") < F.col("cut"), "block").otherwise("allow").alias("by_method"))
    method = method.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("m_salt"))
    salt = F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(SALTS)).cast("int")
    out = rows.withColumn("salt", salt).join(method, (F.col("s") == F.col("m_s")) & (F.col("salt") == F.col("m_salt")), "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", "by_method", F.lit("allow")).alias("verdict"), "score", "seeded")


def op1_url_filters(spark, sf_dir: str) -> DataFrame:
    return filtered(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).drop("score", "seeded")
