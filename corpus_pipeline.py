"""From raw documents to packed training sequences, one operator per stage.

Every stage but the last returns the columns of ``documents``; each result is
written as Parquet into the shared checkpoint folder and read again, so a lost
executor never costs more than the stage at work.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointstrata.llm import best_two_fit, crf_pii, near_copies, pu_toxicity, qgram_leaks
from pointstrata.llm.common import fold, store, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the operating point."""
    model = pu_toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), ~fold(3, 1))
    return pu_toxicity.score(docs.select(*COLUMNS), model, "_toxic").where(F.col("_toxic") < pu_toxicity.OPERATE).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard similarity of 0.8 or more."""
    return near_copies.keep_one(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return qgram_leaks.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return crf_pii.redact(docs.select(*COLUMNS), crf_pii.train(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents with their place in sequences of 2048 tokens."""
    return best_two_fit.best_two_fit(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("pii", pii),
    ("best_fit_packing", packing),
]
#: Tokenizers and trained models cannot be stated in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = store(docs)
    return docs
