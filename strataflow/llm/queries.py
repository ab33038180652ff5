"""The operators as queries over whole tables, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataflow.llm import bpe, decontaminate, fingerprints, html_extract, licenses, line_dedup, near_dedup, substring_dedup, token_blocks, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.duplicate_lines(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")).select("doc_id", "score", "toxic")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trips(table(spark, sf_dir, "documents"))


def op4_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.token_blocks(table(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passages(table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_equals(table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_bpe": op3_bpe,
    "op4_token_blocks": op4_token_blocks,
    "op5_near_dedup": op5_near_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_html_extraction": op7_html_extraction,
    "op8_decontamination": op8_decontamination,
    "op9_fingerprints": op9_fingerprints,
    "op10_licenses": op10_licenses,
}
SQL: dict[str, str] = {
    "op1_line_dedup": line_dedup.SQL,
    "op9_fingerprints": fingerprints.SQL,
}
