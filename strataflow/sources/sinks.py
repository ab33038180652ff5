"""Chunk records and documents as JSON."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.operators.structure import records


def json_lines(chunks: DataFrame) -> DataFrame:
    """A column of JSON, a record each: {chunk_id, text, metadata}."""
    r = records(chunks)
    return r.select(F.to_json(F.struct("chunk_id", "text", "metadata")).alias("value"))


def write_jsonl(chunks: DataFrame, path: str) -> None:
    """A folder of JSON-lines files, written by the executors."""
    json_lines(chunks).write.mode("overwrite").text(path)


def write_one(chunks: DataFrame, path: str, order: Iterable[str] = ("source", "ordinal")) -> int:
    """One JSON-lines file on the driver's machine, in order; rows stream through, and their number is returned."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        return write_to(chunks, f, order)


def write_to(chunks: DataFrame, f: TextIO, order: Iterable[str] = ("source", "ordinal")) -> int:
    r, n = chunks.orderBy(*order), 0
    for row in json_lines(r).toLocalIterator():
        f.write(row["value"] + "\n")
        n += 1
    return n


def document_json(docs: DataFrame) -> Iterator[dict]:
    """Documents as dictionaries; `table` only where there is one."""
    for row in docs.toLocalIterator():
        d = row.asDict(recursive=True)
        elements = [{"type": e["type"], "text": e["text"], "level": e["level"], "page": e["page"]} | ({"table": e["tbl"]} if e["tbl"] else {}) for e in d["elements"]]
        yield {"source": d["source"], "doc_type": d["doc_type"], "metadata": {"filename": d["filename"]}, "elements": elements}


def dump_documents(docs: DataFrame, path: str) -> int:
    """One JSON file: an object if there is one document, else a list. Documents stream through; their number is returned."""
    with open(path, "w", encoding="utf-8") as f:
        return dump_to(docs, f)


def dump_to(docs: DataFrame, f: TextIO) -> int:
    held: dict | None = None
    n = 0
    for n, d in enumerate(document_json(docs), 1):
        if held is not None:
            f.write(("[\n" if n == 2 else ",\n") + json.dumps(held, ensure_ascii=False, indent=2))
        held = d
    f.write("[]" if held is None else json.dumps(held, ensure_ascii=False, indent=2) if n == 1 else ",\n" + json.dumps(held, ensure_ascii=False, indent=2) + "\n]")
    return n
