"""Corpus pipeline: stages that each call one corpus operator on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from surfaudit.llm.bpe import encode_texts
from surfaudit.llm.common import materialize, table
from surfaudit.llm.decontaminate import drop_contaminated
from surfaudit.llm.language import keep_identified
from surfaudit.llm.near_copies import drop_near_copies
from surfaudit.llm.substring import drop_repeated_spans


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin; the others go."""
    return keep_identified(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard similarity 0.8 or more."""
    return drop_near_copies(docs)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the spans that an earlier place has; texts without such spans stay as they are."""
    return drop_repeated_spans(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and the byte at which each token starts."""
    return encode_texts(docs).withColumn("n_tokens", F.size("ids").cast("bigint"))


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_copies),
    ("substring_dedup", repeated_spans),
    ("benchmark_decontamination", contamination),
    ("byte_bpe", tokens),
]
# Neither compression nor the fingerprints' XXH64 nor rank merges can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what a stage returns is written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
