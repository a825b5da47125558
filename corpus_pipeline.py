"""The corpus pipeline: toxicity, exact dedup, MinHash near-dedup, benchmark decontamination, byte-level BPE.

Every stage works on all that its predecessor kept. All but the last return the columns of documents; the last returns a row
a document: doc_id, n_tokens, ids_sha256, decoded_sha256. Nulls, empty texts and repeated rows are treated as the operators
state; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webloom.llm import bpe, decontaminate, exact_dedup, near_dedup, toxicity
from webloom.llm.common import materialize, table
from webloom.llm.queries import vocabulary


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity classifier rejects."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each equal text."""
    return exact_dedup.dedup(docs)


def distinct_enough(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8."""
    return near_dedup.dedup(docs, words=5, percent=80)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold benchmark passages."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to."""
    return bpe.digests(docs, vocabulary("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("toxicity", clean),
    ("exact_dedup", unique),
    ("minhash_dedup", distinct_enough),
    ("decontamination", uncontaminated),
    ("byte_bpe", encoded),
]

#: The trained classifier, MinHash components and BPE merges have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
