"""Training-corpus pipeline: good documents, exact dedup, near dedup, decontamination, SentencePiece ids.

Each stage works on all that the one before kept, which is written as Parquet in between. All but the last return documents' own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from twinsift.llm import common, decontaminate, exact_dedup, ngram_join, quality, sentencepiece_codec


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that the quality classifier keeps."""
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: the first of equal texts."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: one document of each component of five-word shingle sets of similarity 0.8 and more."""
    return ngram_join.keep_one(docs, 5, 80, 100)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents without benchmark items."""
    return decontaminate.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: doc_id, ids, round_trip."""
    import public_tokenizers

    return sentencepiece_codec.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality classifier", good), ("exact dedup", exact), ("n-gram jaccard join", near), ("benchmark decontamination", clean), ("sentencepiece", encoded)]
#: The classifier, decontamination and the lattice can't be expressed in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.materialize(docs, "stage")
    return docs
