"""A corpus from documents: language, near copies, benchmark passages, personal data, pieces.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents, the last one the encoded documents;
run() writes every stage to the shared folder and reads it again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cardloom.llm import decontaminate, langid, neardup, pieces, pii
from cardloom.llm.common import materialise, read


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which one language has at least half of the text; texts without letters go."""
    return langid.keep_known(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, of a Jaccard similarity of 0.8 or more (op10's contract has 0.85)."""
    return neardup.keep_first(docs, similarity=80)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of test items are cut out; documents that are mostly such passages go."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets."""
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of each text, checked by decoding: docs plus piece_ids, n_pieces, pieces_sha256, lossless."""
    return pieces.encode_digest_column(docs)


STAGES = [("language", language), ("near_copies", near_copies), ("benchmark_passages", benchmark_passages), ("personal_data", personal_data), ("encode", encode)]

#: Language mixtures and sampled pieces can't be written in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
