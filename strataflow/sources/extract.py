"""The seam for extractors: files to pages, a row each, and pages to items.

An extractor is the caller's; none is part of this package. Its worker is made once per Python worker, and a file that it can't read becomes a row with an error.
All that one page holds is in its row, so joining spans, choosing tables and dropping the text beneath them need no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.functions import tables
from strataflow.functions import text as X
from strataflow.operators import layout, structure

BOLD = 1 << 4
LEAST_FIGURE, LEAST_TEXT = 40, 20


class Extractor(Protocol):
    """pages() gives a dictionary for each page: width, height; blocks (x0, y0, x1, y1, lines: a list of spans of text, size, flags, font); tables (strategy: 0 is the
    strict detector; x0, y0, x1, y1, headers, rows); figures (x0, y0, x1, y1, image); image, the page's own picture. All may be left out."""

    def pages(self, content: bytes) -> Iterable[dict]: ...


class PictureExtractor:
    """A picture file is one page without items, which only OCR can read."""

    def pages(self, content: bytes) -> Iterable[dict]:
        yield {"image": content}


_BOX = [(k, pa.float64()) for k in ("x0", "y0", "x1", "y1")]
_SPAN = pa.struct([("text", pa.string()), ("size", pa.float64()), ("flags", pa.int32()), ("font", pa.string())])
_ARROW = pa.schema(
    [
        ("source", pa.string()), ("filename", pa.string()), ("doc_type", pa.string()), ("page", pa.int32()), ("width", pa.float64()), ("height", pa.float64()),
        ("blocks", pa.list_(pa.struct([*_BOX, ("lines", pa.list_(pa.list_(_SPAN)))]))),
        ("tables", pa.list_(pa.struct([("strategy", pa.int32()), *_BOX, ("headers", pa.list_(pa.string())), ("rows", pa.list_(pa.list_(pa.string())))]))),
        ("figures", pa.list_(pa.struct([*_BOX, ("image", pa.binary())]))),
        ("image", pa.binary()), ("error", pa.string()),
    ]
)
_CORNERS = "x0:double,y0:double,x1:double,y1:double"
PAGES = (
    f"source string, filename string, doc_type string, page int, width double, height double, blocks array<struct<{_CORNERS},lines:array<array<struct<text:string,size:double,flags:int,font:string>>>>>,"
    f" tables array<struct<strategy:int,{_CORNERS},headers:array<string>,rows:array<array<string>>>>, figures array<struct<{_CORNERS},image:binary>>, image binary, error string"
)


def pages(found: DataFrame, extractors: dict[str, Callable[[], Extractor]]) -> DataFrame:
    """files (source, filename, ext, content) to PAGES, numbered from 1. Formats without an extractor, and files that can't be read, give one row with an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, Extractor] = {}
        for b in batches:
            for f in b.to_pylist():
                who = {"source": f["source"], "filename": f["filename"], "doc_type": f["doc_type"]}
                try:
                    if f["ext"] not in extractors:
                        raise ValueError("no extractor for this format is installed")
                    if f["ext"] not in made:
                        made[f["ext"]] = extractors[f["ext"]]()
                    rows = [who | {"page": k} | p for k, p in enumerate(made[f["ext"]].pages(f["content"]), 1)]
                    out = pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                except Exception as e:  # noqa: BLE001 - one file's failure is that file's alone
                    out = pa.RecordBatch.from_pylist([who | {"error": f"{type(e).__name__}: {e}"}], schema=_ARROW)
                yield out

    kind = F.when(F.col("ext") == ".pdf", "pdf").when(F.col("ext") == ".txt", "txt").otherwise("image")
    return found.where("error is null").select("source", "filename", "ext", "content", kind.alias("doc_type")).mapInArrow(run, PAGES)


def _block_text(block: Column) -> Column:
    """Spans run together, lines each on one."""
    return F.array_join(F.transform(block["lines"], lambda l: F.array_join(F.transform(l, lambda s: F.coalesce(s["text"], F.lit(""))), "")), "\n")


def _spans(block: Column) -> Column:
    return F.flatten(block["lines"])


def _side(s: Column) -> dict[str, Column]:
    return {k: s[k] for k in ("x0", "y0", "x1", "y1")}


def real_tables(found: Column) -> Column:
    """Candidates of all strategies, the strict one's first, without those that overlap a kept one, and without those that are no table."""
    none = F.array().cast("array<struct<strategy:int,x0:double,y0:double,x1:double,y1:double,headers:array<string>,rows:array<array<string>>>>")
    numbered = F.transform(F.coalesce(found, none), lambda t, i: F.struct(t["strategy"].alias("strategy"), i.alias("i"), *[t[k].alias(k) for k in ("x0", "y0", "x1", "y1")], tables.normalized(t["headers"], t["rows"]).alias("tbl")))
    in_order = F.array_sort(numbered, lambda a, b: F.when(a["strategy"] != b["strategy"], a["strategy"] - b["strategy"]).otherwise(a["i"] - b["i"]))
    return layout.distinct_boxes(F.filter(in_order, lambda t: tables.is_real(t["tbl"]["headers"], t["tbl"]["rows"])))


def with_items(found: DataFrame) -> DataFrame:
    """PAGES with kept_tables and kept_blocks: text that no table covers by 30 %."""
    blocks = F.coalesce(F.col("blocks"), F.array().cast(found.schema["blocks"].dataType))
    out = found.where("error is null").withColumn("kept_tables", real_tables(F.col("tables")))
    return out.withColumn("kept_blocks", F.filter(blocks, lambda b: ~F.exists("kept_tables", lambda t: layout.overlap(_side(b), _side(t)) >= 0.3)))


def items(found: DataFrame, figure_texts: DataFrame | None = None) -> DataFrame:
    """PAGES to layout's items. Figures have the text of figure_texts(source, page, figure, text), which OCR gives where it is switched on, and stay only if that reads as words."""
    null = lambda t: F.lit(None).cast(t)
    tbl = lambda t: F.struct(t["headers"].alias("headers"), t["rows"].alias("rows"))
    corners = lambda s: [s[k].alias(k) for k in ("x0", "y0", "x1", "y1")]
    item = lambda kind, s, text, size, bold, fonts, t: F.struct(F.lit(kind).alias("kind"), *corners(s), text.alias("text"), size.alias("size"), bold.alias("bold"), fonts.alias("fonts"), t.alias("tbl"))
    size = lambda b: F.coalesce(F.array_max(F.transform(_spans(b), lambda s: s["size"])), F.lit(0.0))
    text = F.transform("kept_blocks", lambda b: item("text", b, _block_text(b), size(b), F.exists(_spans(b), lambda s: s["flags"].bitwiseAND(F.lit(BOLD)) != 0), F.array_distinct(F.transform(_spans(b), lambda s: s["font"])), null(structure.TABLE)))
    table = F.transform("kept_tables", lambda t: item("table", t, F.lit(""), F.lit(0.0), F.lit(False), F.array().cast("array<string>"), tbl(t["tbl"])))
    rows = with_items(found).select("source", "page", "width", "height", F.posexplode(F.concat(text, table)).alias("idx", "i")).select("source", "page", "idx", "width", "height", "i.*")
    if figure_texts is None:
        return rows
    kept = figure_texts.where(X.plausible(F.col("text")))
    boxes = found.select("source", "page", "width", "height", F.posexplode("figures").alias("figure", "f"))
    new = boxes.join(kept, ["source", "page", "figure"]).select("source", "page", (F.col("figure") + 1_000_000).alias("idx"), "width", "height", F.lit("figure").alias("kind"), "f.x0", "f.y0", "f.x1", "f.y1", X.figure(F.col("text")).alias("text"), F.lit(0.0).alias("size"), F.lit(False).alias("bold"), F.array().cast("array<string>").alias("fonts"), null(structure.TABLE).alias("tbl"))
    return rows.unionByName(new)


def facts(found: DataFrame) -> DataFrame:
    """(source, page, raw_length, fonts, text, n_fig, scanned, judged) of each page: the text that detection judges is the prose, then the tables' cells."""
    has = lambda s: X.strip(s) != ""
    prose = F.filter(F.transform("kept_blocks", _block_text), has)
    cells = F.flatten(F.transform("kept_tables", lambda t: F.concat(t["tbl"]["headers"], F.flatten(t["tbl"]["rows"]))))
    big = F.filter(F.coalesce("figures", F.array().cast(found.schema["figures"].dataType)), lambda f: (f["x1"] - f["x0"] >= LEAST_FIGURE) & (f["y1"] - f["y0"] >= LEAST_FIGURE))
    raw = F.aggregate(F.transform("kept_blocks", _block_text), F.lit(0), lambda n, t: n + F.length(t))
    text = X.strip(F.array_join(F.concat(prose, F.filter(cells, lambda c: c.isNotNull() & has(c))), " "))
    fonts = F.array_sort(F.array_distinct(F.flatten(F.transform("kept_blocks", lambda b: F.transform(_spans(b), lambda s: s["font"])))))
    out = with_items(found).select("source", "page", raw.alias("raw_length"), fonts.alias("fonts"), text.alias("text"), F.size(big).alias("n_fig"), F.size("kept_tables").alias("n_tables"))
    return out.withColumn("scanned", (F.col("raw_length") < LEAST_TEXT) & (F.col("n_tables") == 0)).withColumn("judged", F.length("text") >= LEAST_TEXT)


def figures(found: DataFrame, enabled: bool, engine_there: bool) -> DataFrame | None:
    """(source, page, figure, image) for OCR of figures; None where the feature is off or no engine is there."""
    if not (enabled and engine_there):
        return None
    return found.select("source", "page", F.posexplode("figures").alias("figure", "f")).select("source", "page", "figure", "f.image").where("image is not null")


def paragraphs(texts: DataFrame) -> DataFrame:
    """OCR texts (source, page, ocr_text) as items, one for each paragraph between blank lines."""
    part = F.posexplode(F.filter(F.split("ocr_text", r"\n[\s]*\n"), lambda p: X.strip(p) != ""))
    null = lambda t, k: F.lit(None).cast(t).alias(k)
    return texts.select("source", "page", part.alias("idx", "t")).select("source", "page", (F.col("idx") + 2_000_000).alias("idx"), null("double", "width"), null("double", "height"), F.lit("text").alias("kind"), F.lit(0.0).alias("x0"), F.col("idx").cast("double").alias("y0"), F.lit(0.0).alias("x1"), F.col("idx").cast("double").alias("y1"), X.strip(F.col("t")).alias("text"), F.lit(0.0).alias("size"), F.lit(False).alias("bold"), F.array().cast("array<string>").alias("fonts"), F.lit(None).cast(structure.TABLE).alias("tbl"))
