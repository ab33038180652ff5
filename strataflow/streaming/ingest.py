"""Ingestion as a stream: each micro-batch of text files becomes chunk records. No state: a document stands by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from strataflow.operators import structure


def text_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """(source, filename, text) of text files as they come in."""
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.txt").option("maxFilesPerTrigger", files_per_batch).load(folder)
    path = F.regexp_replace("path", "^file:/*", "/")
    return found.select(path.alias("source"), F.element_at(F.split(path, "/"), -1).alias("filename"), F.decode("content", "UTF-8").alias("text"))


def chunk_batch(texts: DataFrame, **options) -> DataFrame:
    docs = texts.select("source", "filename", F.lit("txt").alias("doc_type"), structure.elements_of(F.col("text")).alias("elements"))
    return structure.chunks(docs, **options)


def to_parquet(texts: DataFrame, out: str, checkpoint: str, **options) -> DataStreamWriter:
    """A writer that puts each batch's chunks in a folder of its own, so that a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        chunk_batch(batch, **options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
