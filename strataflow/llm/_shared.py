"""Helpers that the training-data operators share: scratch tables, Arrow slices, word codes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; on one machine, where it is unset, a temporary folder."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="strataflow-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return f"file://{_LOCAL[0]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: lineage ends there, and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about `limit` bytes of `column`, one row at least."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(b.column(column)), 0)).astype(np.int64)
        part = np.cumsum(size) // limit
        cuts = np.flatnonzero(np.diff(part)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
            if j > i:
                yield b.slice(i, j - i)


def array_of(x: pa.Array | pa.ChunkedArray) -> pa.Array:
    return x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(start of each text's words, code of each word, distinct words): split at ASCII white space, lower case; a null has no word."""
    split = array_of(pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), "")))
    flat = split.flatten()
    offsets = np.asarray(split.offsets).astype(np.int64)
    full = np.asarray(pc.binary_length(flat)) > 0
    if not full.all():  # leading and trailing blanks give empty words
        keep = np.concatenate([[0], np.cumsum(full)])
        flat, offsets = flat.filter(pa.array(full)), keep[offsets]
    coded = array_of(flat).dictionary_encode()
    lower = array_of(pc.utf8_lower(coded.dictionary)).dictionary_encode()
    return offsets - offsets[0], np.asarray(lower.indices).astype(np.int64)[np.asarray(coded.indices)], lower.dictionary


def hashes(values: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hashes of strings without nulls: eight bytes at a time, for all of them at once."""
    values = values.cast(pa.large_string())
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + n + 1]
    data = values.buffers()[2]
    raw = np.zeros(offsets[-1] + 8, np.uint8)
    if data is not None:
        raw[: offsets[-1]] = np.frombuffer(data, np.uint8)[: offsets[-1]]
    eight = np.lib.stride_tricks.as_strided(raw.view(np.uint64) if len(raw) % 8 == 0 else np.frombuffer(raw.tobytes() + bytes(-len(raw) % 8), np.uint64), (offsets[-1] + 1,), (1,))
    start, size = offsets[:-1], np.diff(offsets)
    out = mix(size.astype(np.uint64), seed + 11)
    at, k = np.arange(n), 0
    while len(at):
        left = size[at] - 8 * k
        at, left = at[left > 0], left[left > 0]
        v = eight[start[at] + 8 * k]
        part = left < 8
        v[part] &= (np.uint64(1) << (8 * left[part]).astype(np.uint64)) - np.uint64(1)
        out[at] = mix(out[at] ^ (v * np.uint64(0x9FB21C651E98DF25)), k + 1)
        k += 1
    return out


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def emptied(column: str, columns: list[str]) -> str:
    """A name near `column` that is in none of `columns`, whatever their case."""
    taken = {c.lower() for c in columns}
    while column.lower() in taken:
        column = f"_{column}"
    return column
