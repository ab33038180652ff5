"""Files of a folder as rows. Names that begin with a dot or an underscore count, which Spark's own file sources leave out."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMATS = {".pdf": "pdf", ".txt": "txt"} | dict.fromkeys((".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp"), "image")
FILES = "pos long, source string, filename string, ext string, content binary, error string"


def extension(path: Column) -> Column:
    """Lower case, with its dot; '' for names without, or that are all dot and suffix."""
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(?<=[^/])(\.[^./]*)$", 1))


def doc_type(path: Column) -> Column:
    """pdf, image or txt; null for what isn't supported."""
    ext = extension(path)
    return F.when(ext == ".pdf", "pdf").when(ext == ".txt", "txt").when(ext.isin(*[e for e, t in FORMATS.items() if t == "image"]), "image")


def supported(path: Column) -> Column:
    return doc_type(path).isNotNull()


def underscored(relative: Column) -> Column:
    """A part of the path under the root begins with an underscore."""
    return F.exists(F.split(relative, "/"), lambda p: p.startswith("_"))


def in_order(path: Column) -> Column:
    """Paths sort part by part."""
    return F.split(path, "/")


def canonical(source: str) -> str:
    """Absolute and without links, if it exists; else as it is."""
    return str(Path(source).resolve()) if source and os.path.exists(source) else source


def listed(root: str, skip_underscored: bool = False) -> list[str]:
    """Supported files under a folder, sorted part by part."""
    top = Path(root)
    if not top.is_dir():
        raise NotADirectoryError(root)
    found = [p for p in top.rglob("*") if p.is_file() and p.suffix.lower() in FORMATS]
    return [str(p) for p in sorted(found) if not (skip_underscored and any(x.startswith("_") for x in p.relative_to(top).parts))]


class _Part(InputPartition):
    def __init__(self, rows: list[tuple[int, str]]):
        self.rows = rows


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[_Part]:
        if (paths := self.options.get("paths")) is not None:
            found = paths.split("\n") if paths else []
        else:
            found = listed(self.options["path"], self.options.get("skipunderscored", "false").lower() == "true")
        rows = list(enumerate(found))
        most = int(self.options.get("filesperpartition", 64))
        return [_Part(rows[i : i + most]) for i in range(0, len(rows), most)] or [_Part([])]

    def read(self, part: _Part) -> Iterator[tuple]:
        for pos, path in part.rows:
            name = os.path.basename(path)
            ext = Path(path).suffix.lower()
            if ext not in FORMATS:
                yield pos, canonical(path), name, ext, None, f"unsupported file type: {ext or name}"
                continue
            try:
                content = Path(path).read_bytes()
            except OSError as e:
                yield pos, canonical(path), name, ext, None, f"{type(e).__name__}: {e.strerror}"
            else:
                yield pos, canonical(path), name, ext, content, None


class FolderSource(DataSource):
    """format("strata_files"): options path, or paths (one a line, kept in order); skipUnderscored; filesPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "strata_files"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def files(spark: SparkSession, root: str, skip_underscored: bool = False) -> DataFrame:
    """Files under a folder; each that can't be read has an error and no content."""
    if not os.path.isdir(root):
        raise NotADirectoryError(root)
    spark.dataSource.register(FolderSource)
    return spark.read.format("strata_files").option("skipUnderscored", str(skip_underscored).lower()).load(root)


def named(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files of a list, a row each, numbered in its order."""
    spark.dataSource.register(FolderSource)
    return spark.read.format("strata_files").option("paths", "\n".join(paths)).load()


def texts(found: DataFrame) -> DataFrame:
    """(source, filename, text) of text files: UTF-8, what isn't valid replaced."""
    return found.where("ext = '.txt' and error is null").select("source", "filename", F.decode("content", "UTF-8").alias("text"))
