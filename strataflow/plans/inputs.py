"""Inputs that are derived from the tables by expressions which Spark SQL and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TELUGU = "".join(chr(0x0C15 + i) for i in range(20)) + "".join(chr(0x0C2A + i) for i in range(6))
DEVANAGARI = "".join(chr(0x0915 + i) for i in range(20)) + "".join(chr(0x092A + i) for i in range(6))
LATIN = "abcdefghijklmnopqrstuvwxyz"
_INDIC = f"translate(lower(text), '{LATIN}', '{TELUGU}')"
_E, _Q, _A = TELUGU[4], TELUGU[16], TELUGU[0]
#: Kinds of damage: name, expression over text.
VARIANTS = {
    "clean": "text",
    "latin1": "translate(text, 'aeioutnsrh', 'àèìòùþñšřħ')",
    "glyph": "translate(text, 'aeiouAEIOU', 'xkzvqXKZVQ')",
    "spiked": "replace(translate(text, 'aeou', 'xkvq'), 't', ';')",
    "mixed": f"replace({_INDIC}, '{_A}', '{_A}λ')",
    "sparse": f"replace({_INDIC}, '{_Q}', '{_Q}λ')",
    "decomposed": f"replace(replace(text, 'a', 'a{chr(0x301)}'), 'o', 'o{chr(0x308)}')",
    "pua": f"translate(text, 'etaoin', '{''.join(chr(0xE001 + i) for i in range(6))}')",
    "fffd": f"translate(text, 'q', '{chr(0xFFFD)}')",
    "spliced": f"replace({_INDIC}, '{_E}', '{_E}|')",
}
SELECT_VARIANTS = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS variant, {e} AS text FROM documents" for k, e in VARIANTS.items())
#: Items of layout: a line each, 20 to a page; documents of odd id have two columns.
_PAGE = "CAST(floor(i / 20) AS INT) + 1"
_ROW = "CASE WHEN doc_id % 2 = 1 AND i % 20 BETWEEN 10 AND 18 THEN i % 20 - 9 ELSE i % 20 END"
ITEM = {
    "source": "concat('doc://', CAST(doc_id AS STRING))",
    "page": _PAGE,
    "idx": "CAST(i AS INT)",
    "kind": "'text'",
    "x0": "CAST(CASE WHEN doc_id % 2 = 1 AND i % 20 BETWEEN 10 AND 18 THEN 350 + i % 3 ELSE 50 + i % 2 END AS DOUBLE)",
    "y0": f"CAST(38 * ({_ROW}) + i % 3 AS DOUBLE)",
    "x1": "CAST(CASE WHEN doc_id % 2 = 1 AND i % 20 BETWEEN 10 AND 18 THEN 560 ELSE 290 END AS DOUBLE)",
    "y1": f"CAST(38 * ({_ROW}) + i % 3 + 12 AS DOUBLE)",
    "text": f"CASE i % 20 WHEN 0 THEN concat('Report page ', CAST({_PAGE} AS STRING)) WHEN 19 THEN concat('Part ', CAST({_PAGE} AS STRING), '  of 9') ELSE line END",
    "size": "CAST(CASE WHEN i % 10 = 1 THEN 18 WHEN i % 10 = 4 THEN 14 WHEN i % 10 = 7 THEN 10.5 ELSE 11 END AS DOUBLE)",
    "bold": "i % 7 = 2",
    "font": "CASE WHEN i % 20 = 3 AND doc_id % 4 = 0 THEN 'ABCDEF+SHREE-TEL-0900' WHEN i % 5 = 0 THEN 'Serif' ELSE 'Sans' END",
    "width": "CAST(612 AS DOUBLE)",
    "height": "CAST(792 AS DOUBLE)",
}
_FIELDS = ", ".join(f"{e} AS {k}" for k, e in ITEM.items())
SQL_ITEMS = f"SELECT doc_id, {_FIELDS} FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) ls"
#: Tables: one to an order, a row to a line item, some cells blank.
CELLS = ["CAST(l_linenumber AS STRING)", "CASE WHEN l_partkey % 4 = 0 THEN '' ELSE CAST(l_partkey AS STRING) END", "CASE WHEN l_suppkey % 3 = 0 THEN ' ' ELSE concat(l_returnflag, '|', l_linestatus) END", "CASE WHEN l_partkey % 97 = 0 THEN repeat('long cell ', 25) ELSE CAST(CAST(l_quantity AS INT) AS STRING) END"]
HEADERS = ["line", "part", "", "quantity"]
SQL_TABLES = f"SELECT l_orderkey, ['line', 'part', '', 'quantity'] AS headers, list([{', '.join(CELLS)}] ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS tbl_rows FROM lineitem GROUP BY l_orderkey"
#: Facts of pages for the planning of OCR.
FACTS = {
    "garbled": "page_id % 5 <> 0",
    "font_pack": "CASE page_id % 4 WHEN 0 THEN 'tel' WHEN 1 THEN 'hin' END",
    "declared": "CASE WHEN page_id % 3 = 0 THEN 'tam' END",
    "lang_list": "CASE page_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'te' WHEN 2 THEN 'hi,ta' WHEN 3 THEN 'en' WHEN 4 THEN 'mr,hi,en' ELSE 'ta,kn' END",
    "osd": "CASE page_id % 7 WHEN 0 THEN 'Devanagari' WHEN 1 THEN 'Telugu' WHEN 2 THEN 'Tamil' WHEN 3 THEN 'Latin' WHEN 4 THEN 'Unheard' END",
    "installed_list": "CASE page_id % 3 WHEN 0 THEN 'eng,tel,hin,tam,mar' WHEN 1 THEN 'eng,tel,tam' ELSE 'hin,kan' END",
}
SELECT_FACTS = "SELECT page_id, " + ", ".join(f"{e} AS {k}" for k, e in FACTS.items()) + " FROM pages"
SQL_PATHS = "SELECT doc_id, concat(CASE doc_id % 7 WHEN 0 THEN '/in/_private/' WHEN 1 THEN '/in/b/' WHEN 2 THEN '/in/.cache/' WHEN 3 THEN '/in/b.d/' ELSE '/in/a/' END, CASE doc_id % 5 WHEN 0 THEN '_' ELSE '' END, CASE WHEN doc_id % 13 = 0 THEN '' ELSE CAST(doc_id AS STRING) END, CASE doc_id % 6 WHEN 0 THEN '.PDF' WHEN 1 THEN '.txt' WHEN 2 THEN '.docx' WHEN 3 THEN '.Jpeg' WHEN 4 THEN '' ELSE '.tar.tiff' END) AS path FROM documents"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, variant, text): the documents and nine kinds of damage to them. One scan: the kinds are exploded."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.expr(_INDIC).alias("indic"))  # translated once for three kinds
    kinds = F.array(*[F.struct(F.lit(k).alias("variant"), F.expr(e.replace(_INDIC, "indic")).alias("text")) for k, e in VARIANTS.items()])
    return docs.select("doc_id", F.explode(kinds).alias("v")).select("doc_id", "v.variant", "v.text")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return lines.select("doc_id", *[F.expr(e).alias(k) for k, e in ITEM.items()])


def order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.array(*map(F.expr, CELLS)).alias("cells"))
    by = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "cells")))
    return rows.groupBy("l_orderkey").agg(F.transform(by, lambda r: r["cells"]).alias("tbl_rows")).withColumn("headers", F.array(*map(F.lit, HEADERS)))


def structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) with a heading before every fifth line and a blank line before every third."""
    lines = F.split("text", "\n")
    marked = F.transform(lines, lambda l, i: F.concat(F.when(i % 5 == 0, F.concat(F.lit("=== Section "), F.floor(i / 5).cast("string"), F.lit(" ===\n"))).otherwise(""), F.when(i % 3 == 0, "\n").otherwise(""), l))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(marked, "\n").alias("text"))


SQL_STRUCTURED = "SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: concat(CASE WHEN (i - 1) % 5 = 0 THEN concat('=== Section ', CAST((i - 1) // 5 AS VARCHAR), ' ===', chr(10)) ELSE '' END, CASE WHEN (i - 1) % 3 = 0 THEN chr(10) ELSE '' END, l)), chr(10)) AS text FROM documents"


def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "pages").select("page_id", *[F.expr(e).alias(k) for k, e in FACTS.items()])
    parts = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    return facts.withColumn("langs", parts("lang_list")).withColumn("installed", parts("installed_list"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id", SQL_PATHS.split("SELECT doc_id, ", 1)[1].rsplit(" FROM ", 1)[0])


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as pages: (source, page, ocr_used, ocr_engine, garble_suspect, n_fig)."""
    return table(spark, sf_dir, "conversations").selectExpr(*[f"{e} AS {k}" for k, e in TURN.items()])


TURN = {
    "source": "concat('conv://', CAST(conv_id AS STRING))",
    "page": "CAST(turn AS INT) + 1",
    "ocr_used": "length(text) % 3 = 0",
    "ocr_engine": "CASE WHEN length(text) % 3 = 0 THEN CASE WHEN role = 'user' THEN 'stub-a' ELSE 'stub-b' END END",
    "garble_suspect": "length(text) % 5 = 0",
    "n_fig": "CAST(length(text) % 4 AS INT)",
}
SQL_TURNS = "SELECT " + ", ".join(f"{e} AS {k}" for k, e in TURN.items()) + " FROM conversations"
