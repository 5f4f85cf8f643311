"""Training-data pipeline over ``documents``: five stages, each a table in and a table out.

Edge cases, in every stage: a null text counts as empty; repeated rows are judged alike, and near
duplicates keep one of them; of equal candidates the smallest id stays; an empty table gives an empty
result; all but the last stage return the columns of ``documents`` as they are, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, line_dedup, passage_quality, sentencepieces, simhash
from tidemark.llm.workspace import written

#: The learned models and counts of a stage cannot be said in SQL.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score 0.7 or more)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = passage_quality.fit_quality(docs, labels, max_rows=3000, held_out=(4, 2))
    return passage_quality.drop_poor(docs, model, cut=0.7)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more stay at their first occurrence only."""
    kept = line_dedup.dedup_lines(docs, min_docs=10, min_key_chars=1, keep="first")
    if "n_chars" not in docs.columns:
        return kept
    length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return kept.withColumn("n_chars", length)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, that of the smallest id."""
    return simhash.drop_near_duplicates(docs, shingle=3, radius=3)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), shingle=5, threshold=0.8)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text that is left, with digests of ids and decoded text."""
    return sentencepieces.encode_documents(
        docs, public_tokenizers.path("piece_bpe_32k.model"), outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256")
    )


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("sentencepiece", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
