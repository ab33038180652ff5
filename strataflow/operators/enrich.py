"""Facts of pages onto chunks, and statistics of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def facts_by_source(pages: DataFrame) -> DataFrame:
    """pages(source, page, ocr_used, ocr_engine, garble_suspect) to one row a source: arrays of pages and a map of engines."""
    num = F.col("page")
    return pages.groupBy("source").agg(
        F.array_sort(F.array_distinct(F.collect_list(F.when(F.col("ocr_used"), num)))).alias("ocr_pages"),
        F.array_sort(F.array_distinct(F.collect_list(F.when(F.col("garble_suspect"), num)))).alias("suspect_pages"),
        F.map_from_entries(F.collect_list(F.when(F.col("ocr_engine").isNotNull(), F.struct("page", "ocr_engine")))).alias("engines"),
        F.sum(F.coalesce(F.col("n_fig"), F.lit(0))).alias("figure_count_raw") if "n_fig" in pages.columns else F.lit(0).alias("figure_count_raw"),
    )


def engines_of(pages: Column, engines: Column) -> Column:
    """The pages' engines, each once and sorted, joined by a plus; null without any."""
    return F.nullif(F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(pages, lambda p: F.try_element_at(engines, p)), lambda e: e.isNotNull()))), "+"), F.lit(""))


def with_page_facts(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """chunks(source, pages, ...) with ocr_used, garble_suspected and ocr_engine. A chunk without pages has none of them."""
    out = chunks.join(facts_by_source(pages).withColumnRenamed("source", "f_source"), F.col("source") == F.col("f_source"), "left")
    none = F.array().cast("array<int>")
    touches = lambda c: F.coalesce(F.arrays_overlap(F.col("pages"), F.coalesce(F.col(c), none)), F.lit(False))
    return out.select(*[F.col(c) for c in chunks.columns], touches("ocr_pages").alias("ocr_used"), touches("suspect_pages").alias("garble_suspected"), engines_of(F.col("pages"), F.col("engines")).alias("ocr_engine"))


def type_counts(elements: DataFrame) -> DataFrame:
    """(source, n, counts): elements in all and by type."""
    by = elements.groupBy("source", "type").count()
    return by.groupBy("source").agg(F.sum("count").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "count")))).alias("counts"))


def run_stats(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: files seen, parsed and failed, chunks, errors in order. files(source, ext, error); a file without chunks stays in."""
    per = chunks.groupBy("source").count().withColumnRenamed("source", "c_source")
    both = files.join(per, F.col("source") == F.col("c_source"), "left")
    return both.agg(
        F.count("*").alias("files_seen"), F.count_if(F.col("error").isNull()).alias("files_parsed"), F.count_if(F.col("error").isNotNull()).alias("files_failed"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("chunks"), F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.concat_ws(": ", "source", "error")))).alias("errors"),
    )


def chunks_by_type(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_type").agg(F.count("*").alias("n_chunks"))
