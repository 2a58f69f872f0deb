"""A training corpus from raw documents: quality, near copies, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last
return the columns of documents, and further ones as they are, whatever their names.

Defined cases, in every stage: an empty table gives no rows; very long texts are taken whole; nulls in lang, source
and n_chars are of no account; what a null, empty or repeated text comes to is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobloom.llm import decontamination, jaccard, packing, quality, suffix_dedup
from jobloom.llm.common import stored, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose quality score is 0.3 or more. Null and empty texts are scored as texts without words; repeated
    rows go or stay together."""
    return quality.keep_good(spark, docs, table(spark, sf_dir, "labels"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near and exact copies: the one with the smallest doc_id; a null one counts as the
    largest, and of rows equal in doc_id and text one stays. Texts without words, null ones included, are copies of
    nothing: all stay."""
    return jaccard.keep_first(spark, docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with what is left of their texts after repeated passages of over 50 words, and repeated 400-byte
    windows, are removed; n_chars follows the text. A text of which nothing is left stays as an empty text; repeated
    rows lose all that is long enough; null stays null."""
    return suffix_dedup.replace_texts(spark, docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which less than a twentieth of the words lies in benchmark windows; null and empty texts stay."""
    return decontamination.decontaminate(spark, docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens; null and empty texts are their end token."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", pack),
]

#: A trained classifier and a tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(spark, docs, f"pipeline-{k}")
    return docs
