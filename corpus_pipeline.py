"""From raw documents to token ids: toxicity, line dedup, near dedup, decontamination, BPE.

Each stage reads all that the one before wrote and returns a DataFrame, which run() writes to the shared folder as Parquet. All but the last keep the columns of documents.
SQL can't express the first stage (a trained network), so ORACLE_SQL is None and tests compare with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataflow.llm import bpe, decontaminate, line_dedup, near_dedup, toxicity
from strataflow.llm._shared import stored


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network judges toxic go."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line matches go, and documents without a line left."""
    return line_dedup.without_duplicate_lines(docs)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dedup.without_near_duplicates(docs)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark go."""
    return decontaminate.without_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With tokens and n_tokens."""
    return bpe.encoded(docs)


STAGES = [("toxicity", _toxicity), ("line_dedup", _line_dedup), ("near_dedup", _near_dedup), ("decontamination", _decontamination), ("bpe", _bpe)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over the whole of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
