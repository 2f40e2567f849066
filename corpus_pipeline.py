"""Corpus pipeline: quality filter, near-duplicate removal, mixing, sampled tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as
Parquet in the shared folder and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_spark.llm.common import read, stored
from evidence_spark.llm.op3_mixing import poisson_mix
from evidence_spark.llm.op4_quality import score_quality
from evidence_spark.llm.op5_pieces import encode_decode
from evidence_spark.llm.op6_jaccard import one_per_component

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the rule ensemble, trained on ``labels``, predicts to be of quality 0."""
    scored = score_quality(docs, read(spark, sf_dir, "labels"), keep=COLUMNS)
    return scored.where(F.col("predicted") == 1).select(*COLUMNS)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: five-word shingles, similarity of 0.8 or more."""
    return one_per_component(docs, width=5, percent=80).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replicate documents to the sources' target weights and shuffle them globally."""
    return poisson_mix(docs).select(*COLUMNS)


def sampled_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample a segmentation of every text and check that decoding it gives the text back."""
    return encode_decode(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", jaccard_join),
    ("mixing sources to target weights", mixing),
    ("SentencePiece encoding and decoding", sampled_pieces),
]

#: The classifier is trained, which SQL cannot express; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: one row per document of the mixture, with its pieces."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
