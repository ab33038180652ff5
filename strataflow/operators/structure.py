"""From text to elements to chunks. A document is one row with its elements as an array, so that nothing is shuffled."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.functions import languages, tables
from strataflow.functions import text as X

CHUNK_TOKENS, OVERLAP, MIN_TOKENS = 400, 60, 48
TABLE = "struct<headers:array<string>,rows:array<array<string>>>"
ELEMENT = f"struct<type:string,text:string,level:int,page:int,tbl:{TABLE}>"


def elements_of(text: Column) -> Column:
    """Text to array<ELEMENT>: `=== X ===` is a heading of level 1, blank lines part paragraphs. Null text has none.

    Lines are stripped, so one that begins with a blank can't be of the text: it marks a heading.
    """
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), X.LINE_END), X.strip)
    heading = lambda l: l.startswith("===") & l.endswith("===") & (F.length(l) > 6)
    name = lambda l: F.concat(F.lit("\n\n "), X.strip(F.regexp_replace(l, r"^[= ]+|[= ]+$", "")), F.lit("\n"))
    parts = F.filter(F.split(F.array_join(F.transform(lines, lambda l: F.when(heading(l), name(l)).otherwise(l)), "\n"), r"\n{2,}"), lambda p: p.rlike("^ ") | (X.strip(p) != ""))
    return F.transform(
        parts,
        lambda p: F.struct(
            F.when(p.startswith(" "), "heading").otherwise("paragraph").alias("type"),
            X.collapse(p).alias("text"),
            F.when(p.startswith(" "), 1).otherwise(0).cast("int").alias("level"),
            F.lit(None).cast("int").alias("page"),
            F.lit(None).cast(TABLE).alias("tbl"),
        ),
    )


def documents(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(source, filename, doc_type, elements) of a table of texts."""
    return df.select(F.concat(F.lit("doc://"), F.col(key).cast("string")).alias("source"), F.concat(F.col(key).cast("string"), F.lit(".txt")).alias("filename"), F.lit("txt").alias("doc_type"), elements_of(F.col(text)).alias("elements"))


def title(elements: Column, filename: Column) -> Column:
    """The first title, else the first heading of level 1 anywhere, else the file's name."""
    first = lambda test: F.get(F.filter(F.transform(F.filter(elements, test), lambda e: X.strip(e["text"])), lambda t: t != ""), F.lit(0))
    return F.coalesce(first(lambda e: e["type"] == "title"), first(lambda e: (e["type"] == "heading") & (e["level"] == 1)), filename, F.lit(""))


def crumbs_at(elements: Column, upto: Column) -> Column:
    """Headings open at a place: those that no later heading of the same or a higher level closes."""
    before = F.filter(F.slice(elements, F.lit(1), upto), lambda e: e["type"].isin("heading", "title"))
    levels = F.transform(before, lambda e, i: F.struct(i.alias("i"), F.when(F.coalesce(e["level"], F.lit(0)) == 0, 1).otherwise(e["level"]).alias("level"), X.strip(e["text"]).alias("text")))
    return F.transform(F.filter(levels, lambda h: ~F.exists(levels, lambda o: (o["i"] > h["i"]) & (o["level"] <= h["level"]))), lambda h: h["text"])


def segments(elements: DataFrame) -> DataFrame:
    """elements(source, seq, type, ...) with `segment`: headings and tables begin a new one."""
    at = Window.partitionBy("source").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return elements.withColumn("segment", F.sum(F.col("type").isin("heading", "title", "table").cast("int")).over(at))


_SENTENCE, _FIRST_BLANK = re.compile(r"(?<=[.!?])\s+"), "\n\n"


def count(text: str) -> int:
    return max(1, len(text) // 4) if text else 0


def tail(body: str, budget: int) -> list[str]:
    kept: list[str] = []
    total = 0
    for s in reversed([s for s in _SENTENCE.split(body) if s.strip()]):
        total += count(s)
        if kept and total > budget:
            break
        kept.insert(0, s.strip())
    return kept


def packed(elements: list[dict[str, Any]], name: str, budget: int, overlap: int) -> Iterator[dict[str, Any]]:
    """Prose chunks and table slots of one document: (ordinal left to count, path, body, pages, table)."""
    heads = [e for e in elements if e["type"] == "title"] + [e for e in elements if e["type"] == "heading" and e["level"] == 1]
    top = next((t for e in heads if (t := (e["text"] or "").strip())), name)
    stack: list[tuple[int, str]] = []
    held: list[str] = []
    size, pages = 0, []

    def path() -> list[str]:
        full = [p for p in [top, *[t for _, t in stack]] if p]
        return [p for i, p in enumerate(full) if not i or full[i - 1] != p]

    def emit() -> list[dict[str, Any]]:
        body = "\n".join(held).strip()
        return [{"path": path(), "body": body, "pages": sorted(set(pages)), "table": None}] if body else []

    for e in elements:
        if e["type"] in ("heading", "title"):
            yield from emit()
            held, size, pages = [], 0, []
            level = e["level"] or 1
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, (e["text"] or "").strip()))
            continue
        if e["type"] == "table" and e["tbl"] is not None:
            yield from emit()
            held, size, pages = [], 0, []
            yield {"path": path(), "body": None, "pages": [e["page"]] if e["page"] is not None else [], "table": e["tbl"]}
            continue
        text = (e["text"] or "").strip()
        if not text:
            continue
        if e["type"] == "figure":
            text = f"[Figure] {text}"
        n = count(text)
        if held and size + n > budget:
            yield from emit()
            carried = tail("\n".join(held).strip(), overlap) if overlap > 0 else []
            held, size, pages = carried, count(" ".join(carried)), pages[-1:] if carried else []
        if e["page"] is not None and e["page"] not in pages:
            pages = [*pages, e["page"]]
        held = [*held, text]
        size += n
    yield from emit()


def joined(pieces: Iterator[dict[str, Any]], least: int, budget: int) -> list[dict[str, Any]]:
    """Pieces with their texts; prose of under `least` tokens joins the one before, of the same section, up to one and a half budgets. `slots` counts what each holds."""
    out: list[dict[str, Any]] = []
    for p in pieces:
        crumb = X.BREADCRUMB.join(p["path"])
        text = None if p["table"] is not None else f"{crumb}\n\n{p['body']}" if crumb else p["body"]
        last = out[-1] if out else None
        if last and text is not None and last["text"] is not None and last["path"] == p["path"] and count(text) < least and count(last["text"]) + count(text) <= int(budget * 1.5):
            last["text"] += "\n" + text.split(_FIRST_BLANK, 1)[-1]
            last["pages"] = sorted({*last["pages"], *p["pages"]})
            last["slots"] += 1
        else:
            out.append({"path": p["path"], "text": text, "pages": p["pages"], "tbl": p["table"], "slots": 1})
    return out


PIECES = f"source string, filename string, doc_type string, pieces array<struct<path:array<string>,text:string,pages:array<int>,tbl:{TABLE},slots:int>>"


def pieces(docs: DataFrame, budget: int, overlap: int, least: int) -> DataFrame:
    """The packing and merging, which are folds over each document's elements: Arrow batches, a row a document, without a shuffle."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(PIECES)
    schema = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                rows = b.slice(i, 256).to_pylist()
                out = [{k: r[k] for k in ("source", "filename", "doc_type")} | {"pieces": joined(packed(r["elements"] or [], r["filename"] or "", budget, overlap), least, budget)} for r in rows]
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return docs.select("source", "filename", "doc_type", "elements").mapInArrow(run, kind)


def table_parts(tbl: Column, budget: int) -> Column:
    """array<struct(part, tbl)>: one without a part if it fits; else row groups from 1, each with the header."""

    def parts(each: Column) -> Column:
        groups = F.greatest(F.lit(1), F.ceil(F.size(tbl["rows"]) / each).cast("int"))
        part = lambda k: F.struct(F.when(groups > 1, k).cast("int").alias("part"), F.struct(tbl["headers"].alias("headers"), F.slice(tbl["rows"], (k - 1) * each + 1, each).alias("rows")).alias("tbl"))
        return F.transform(F.sequence(F.lit(1), groups), part)

    return X.let(tables.rows_per_group(tbl["headers"], tbl["rows"], budget), parts)


def table_text(path: Column, tbl: Column, part: Column) -> Column:
    n, m = F.size(tbl["rows"]), tables.n_cols(tbl["headers"], tbl["rows"])
    label = F.concat(F.lit("Table ("), n.cast("string"), F.lit("×"), m.cast("string"), F.lit(")"), F.coalesce(F.concat(F.lit(" — part "), part.cast("string")), F.lit("")))
    return X.chunk_text(path, F.concat(label, F.lit("\n"), tables.markdown(tbl["headers"], tbl["rows"])))


def chunks(docs: DataFrame, budget: int = CHUNK_TOKENS, overlap: int = OVERLAP, least: int = MIN_TOKENS, declared: list[str] | None = None) -> DataFrame:
    """docs(source, filename, doc_type, elements) to chunk records, without a shuffle; see joined() for `least`."""
    if budget < 1 or overlap < 0 or least < 0:
        raise ValueError("budgets of tokens can't be negative, and a chunk's must be 1 or more")
    none = F.array(F.struct(F.lit(None).cast("int").alias("part"), F.lit(None).cast(TABLE).alias("tbl")))
    split = F.transform("pieces", lambda p: F.struct(p["path"].alias("path"), p["text"].alias("text"), p["pages"].alias("pages"), p["slots"].alias("slots"), F.when(p["tbl"].isNull(), none).otherwise(table_parts(p["tbl"], budget)).alias("parts")))
    out = pieces(docs, budget, overlap, least).withColumn("pieces", split)
    out = out.withColumn("taken", F.transform("pieces", lambda p: p["slots"] + F.size(p["parts"]) - 1)).select("source", "filename", "doc_type", "taken", F.posexplode("pieces").alias("slot", "piece"))
    out = out.withColumn("before", F.aggregate(F.slice("taken", F.lit(1), F.col("slot")), F.lit(0), lambda a, n: a + n))
    out = out.select("source", "filename", "doc_type", "piece.path", F.col("piece.text").alias("body"), "piece.pages", "before", F.posexplode("piece.parts").alias("k", "p"))
    ordinal, is_table, tbl = (F.col("before") + F.col("k")).cast("int"), F.col("p.tbl").isNotNull(), F.col("p.tbl")
    path_id = F.array_join("path", X.PATH)
    shape = F.when(is_table, F.array(F.size(tbl["rows"]), tables.n_cols(tbl["headers"], tbl["rows"])))
    out = out.select(
        X.stable_id(F.col("source"), F.when(is_table, F.concat(path_id, F.lit("::table#"), ordinal.cast("string"))).otherwise(path_id), ordinal).alias("chunk_id"),
        F.when(is_table, table_text(F.col("path"), tbl, F.col("p.part"))).otherwise(F.col("body")).alias("text"),
        "source", "doc_type", F.when(is_table, "table").otherwise("structure").alias("strategy"), ordinal.alias("ordinal"),
        F.col("path").alias("section_path"), F.coalesce(F.element_at(F.when(F.size("path") > 0, F.col("path")), -1), F.lit("")).alias("heading"), F.array_min("pages").alias("page"), "pages", "filename",
        F.when(is_table, True).alias("is_table"), shape.alias("table_shape"), F.when(is_table, F.size(tbl["rows"]) < 2).alias("low_rows"),
    )
    return languages.tagged(out, "text", "language", declared or list(languages.BY_ISO))


def custom(docs: DataFrame, chunker: Callable[[dict], list[dict]], declared: list[str] | None = None, strategy: str = "custom") -> DataFrame:
    """docs(source, filename, doc_type, elements) to chunk records by the caller's chunker: it gets a document as a dictionary and gives its chunks in order, each with a
    text and, if it likes, section_path, pages, is_table, table_shape and low_rows. It is shipped to the workers, a document at a time."""
    kinds = [("source", pa.string()), ("filename", pa.string()), ("doc_type", pa.string()), ("ordinal", pa.int32()), ("text", pa.string()), ("section_path", pa.list_(pa.string())), ("pages", pa.list_(pa.int32())), ("is_table", pa.bool_()), ("table_shape", pa.list_(pa.int32())), ("low_rows", pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"section_path": [], "pages": []} | c | {k: d[k] for k in ("source", "filename", "doc_type")} | {"ordinal": i} for d in b.to_pylist() for i, c in enumerate(chunker(d))]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))

    schema = "source string, filename string, doc_type string, ordinal int, text string, section_path array<string>, pages array<int>, is_table boolean, table_shape array<int>, low_rows boolean"
    out = docs.select("source", "filename", "doc_type", "elements").mapInArrow(run, schema)
    out = out.select(
        X.stable_id(F.col("source"), F.array_join("section_path", X.PATH), F.col("ordinal")).alias("chunk_id"), "text", "source", "doc_type", F.lit(strategy).alias("strategy"), "ordinal", "section_path",
        F.coalesce(F.try_element_at("section_path", F.lit(-1)), F.lit("")).alias("heading"), F.array_min("pages").alias("page"), "pages", "filename", "is_table", "table_shape", "low_rows",
    )
    return languages.tagged(out, "text", "language", declared or list(languages.BY_ISO))


def merged(records: DataFrame, least: int = MIN_TOKENS, budget: int = CHUNK_TOKENS) -> DataFrame:
    """The merging of joined(), over a table of chunk records.

    A fold over each source's chunks, which are few and already lie together; ids and ordinals stay, so numbers may be missing.
    """
    columns = records.columns

    def fold(pdf):
        import numpy as np

        rows = pdf.sort_values("ordinal", kind="stable").to_dict("records")
        out: list[dict] = []
        for r in rows:
            p = out[-1] if out else None
            table = lambda x: x["is_table"] is True or x["is_table"] is np.True_
            if p and not table(p) and not table(r) and list(p["section_path"]) == list(r["section_path"]) and count(r["text"]) < least and count(p["text"]) + count(r["text"]) <= int(budget * 1.5):
                p["text"] += "\n" + r["text"].split(_FIRST_BLANK, 1)[-1]
                p["pages"] = sorted({*p["pages"], *r["pages"]})
                p["page"] = p["pages"][0] if p["pages"] else p["page"]
            else:
                out.append(r)
        return pdf.iloc[:0] if not out else type(pdf)(out, columns=columns)

    return records.groupBy("source").applyInPandas(fold, records.schema)


JSON_FIELDS = ["section_path", "heading", "page", "pages", "ordinal", "filename", "is_table", "table_shape", "low_rows", "source", "source_file", "doc_type", "strategy", "ocr_used", "garble_suspected", "ocr_engine", "backend", "language"]


def records(chunked: DataFrame) -> DataFrame:
    """(chunk_id, text, metadata): absent columns and null fields aren't in the JSON."""
    fields = [F.col(c) for c in JSON_FIELDS if c in chunked.columns]
    return chunked.select("chunk_id", "text", F.struct(*fields).alias("metadata"))
