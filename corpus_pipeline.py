"""The corpus pipeline: quality rules, line dedup, near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet in the shared folder and
read again as the next stage's docs. All stages but the last keep the columns of documents.

Stages decide on rows, which are told apart by doc_id (null equals null) and text, so rows that share an id, or have none, are
judged by their own texts. Defined cases, for every stage: null texts are empty ones; columns besides doc_id and text are
returned as they are, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from baseloom.llm import decontaminate, line_dedup, near_texts, packing, quality_llr
from baseloom.llm.common import stored
from baseloom.session import ship


def quality_rules(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that fail the base rules or the likelihood ratio go: empty texts with them. Equal rows stay or go together."""
    model = quality_llr.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_llr.kept_rows(docs, model)


def dedup_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, n_chars follows; a document may end up empty. Rows of one id are one document; rows without an id keep all lines."""
    ship(spark)
    return line_dedup.deduped(docs)


def dedup_documents(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (SimHash candidates, five-word shingles, Jaccard 0.8) one row stays: that of the smallest doc_id, null
    last, then of the smallest hash of its text; of equal rows any one. Empty texts are copies of each other."""
    ship(spark)
    return near_texts.first_rows(docs)


def decontaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item go; others with the same id stay."""
    ship(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences of 4096 tokens at most; an empty text is its closing token, a null id stays null."""
    import public_tokenizers

    ship(spark)
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", dedup_documents),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: Hashes and tokens are not to be had in SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
