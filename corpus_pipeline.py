"""From raw documents to training text: five stages, each one of the training-data operators.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its result is written
as Parquet in the shared folder and read again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import common, decontaminate, near_dedup, quality, queries, sentencepiece_bpe, toxicity


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the co-trained classifier rejects."""
    return quality.reject(docs, common.table(spark, sf_dir, "labels"))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the classifier chain finds toxic."""
    return toxicity.reject(docs, common.table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of copies and near-duplicates."""
    return near_dedup.keep_one(docs)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold any window of a benchmark item."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def in_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add the ids of a seeded, lossless segmentation."""
    return sentencepiece_bpe.encode(docs, queries.public_tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", good_quality),
    ("toxicity", not_toxic),
    ("near-dedup", one_of_each),
    ("decontamination", not_in_benchmark),
    ("SentencePiece", in_pieces),
]

#: The classifiers, Order MinHash and merge-dropout are not expressible in SQL; the tests hold near-dedup, decontamination and
#: merge-dropout against plain versions, and the classifiers against held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of ``sf_dir`` after all stages."""
    docs = common.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = common.materialise(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
