"""parse(), ingest_file() and ingest_directory(): files to documents, and documents to chunk records.

Keyword arguments beat the environment's values (STRATAFLOW_CHUNK_TOKENS and so on), which beat the defaults. Formats other than text go through the caller's extractors,
by extension; a file that can't be read is reported, and the others go on.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.operators import layout, structure
from strataflow.sources import extract, files

Extractors = dict[str, Callable[[], extract.Extractor]]
Chunker = Callable[[dict], list[dict]]


@dataclass(frozen=True)
class Config:
    """A value given beats the environment's, which beats the default."""

    chunk_tokens: int = structure.CHUNK_TOKENS
    overlap: int = structure.OVERLAP
    min_tokens: int = structure.MIN_TOKENS
    dpi: int = 300
    scanned_dpi: int = 200
    window: int = 16
    languages: tuple[str, ...] = ("en",)
    skip_underscored: bool = False

    @staticmethod
    def of(**given) -> Config:
        numbers = [f.name for f in fields(Config) if isinstance(f.default, int) and not isinstance(f.default, bool)]
        env = {k: int(v) for k in numbers if (v := os.environ.get(f"STRATAFLOW_{k.upper()}"))}
        return Config(**env | {k: v for k, v in given.items() if v is not None})


def cache_dir() -> str:
    """Where OCR results are kept: $STRATAFLOW_CACHE, else under $XDG_CACHE_HOME, else under the home folder."""
    base = os.environ.get("XDG_CACHE_HOME") or str(Path.home() / ".cache")
    return os.environ.get("STRATAFLOW_CACHE") or str(Path(base) / "strataflow" / "ocr")


def on_disk(df: DataFrame) -> DataFrame:
    """Kept on the executors' disks, so that files are extracted once; what a lost executor held is extracted again."""
    return df.persist(StorageLevel.DISK_ONLY)


def found(spark: SparkSession, path: str, config: Config) -> DataFrame:
    return files.files(spark, path, config.skip_underscored) if os.path.isdir(path) else files.named(spark, [path])


def parse(spark: SparkSession, path: str, extractors: Extractors | None = None, config: Config | None = None, keep: Callable[[DataFrame], DataFrame] = on_disk) -> tuple[DataFrame, DataFrame]:
    """(files with their errors, documents with their elements) of a file or folder."""
    all_ = found(spark, path, config or Config.of())
    texts = files.texts(all_).select("source", "filename", F.lit("txt").alias("doc_type"), structure.elements_of(F.col("text")).alias("elements"))
    if not extractors:
        return all_.withColumn("error", F.coalesce("error", F.when(F.col("ext") != ".txt", F.lit("no extractor for this format is installed")))), texts
    pages = keep(extract.pages(all_.where("ext <> '.txt'"), extractors))
    failed = pages.where("error is not null").select(F.col("source").alias("f_source"), F.col("error").alias("f_error")).dropDuplicates(["f_source"])
    seen = all_.join(failed, F.col("source") == F.col("f_source"), "left").withColumn("error", F.coalesce("error", "f_error")).drop("f_source", "f_error")
    names = pages.select("source", F.col("doc_type").alias("kind")).distinct()
    docs = layout.documents(keep(extract.items(pages))).join(names, "source").select("source", "filename", F.col("kind").alias("doc_type"), "elements")
    return seen, texts.unionByName(docs)


def chunks(docs: DataFrame, config: Config, chunker: Chunker | None = None) -> DataFrame:
    """Chunk records, by the built-in packing or by the caller's chunker, which runs on the executors like it."""
    if chunker is None:
        out = structure.chunks(docs, config.chunk_tokens, config.overlap, config.min_tokens, list(config.languages))
    else:
        out = structure.custom(docs, chunker, list(config.languages))
    return out.withColumns({"source_file": F.col("source"), "ocr_used": F.lit(False), "garble_suspected": F.lit(False)})


def ingest(spark: SparkSession, path: str, config: Config | None = None, extractors: Extractors | None = None, chunker: Chunker | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, chunks) of a file or folder."""
    config = config or Config.of()
    seen, docs = parse(spark, path, extractors, config)
    return seen, chunks(docs, config, chunker)


def ingest_file(spark: SparkSession, path: str, extractors: Extractors | None = None, chunker: Chunker | None = None, **options) -> DataFrame:
    """Chunk records of one file."""
    if not os.path.isfile(path):
        raise FileNotFoundError(path)
    return ingest(spark, path, Config.of(**options), extractors, chunker)[1]


def ingest_directory(spark: SparkSession, path: str, extractors: Extractors | None = None, chunker: Chunker | None = None, **options) -> DataFrame:
    """Chunk records of a folder's files; .collect() is its list."""
    if not os.path.isdir(path):
        raise NotADirectoryError(path)
    return ingest(spark, path, Config.of(**options), extractors, chunker)[1]
