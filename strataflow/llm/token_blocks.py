"""Token ids as binary: patched frame-of-reference blocks.

Each document's ids are cut into blocks of BLOCK. A block stores its least id and the differences to it, packed at the
width that holds the PERCENTILE of them; the low bits of wider ones are packed with the others, and the rest goes to the block's list of exceptions
(places and high bits). block_starts indexes the payload, so that any block can be read by itself.

Block, little-endian: least id (4 bytes), ids - 1 (1), width (1), exceptions (1); packed differences, lowest bit first; exceptions' places (1 each), then
their high bits (4 each).

Nulls: a null text has a null payload and index, an empty one an empty payload. Repeated rows are encoded alike; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm import bpe
from strataflow.llm._shared import slices

BLOCK, PERCENTILE = 128, 90
HEAD = 7


def pack(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(payload bytes of all lists, start of each block in it, blocks before each list)."""
    n = np.diff(offsets)
    blocks = -(-n // BLOCK)
    before = np.concatenate([[0], np.cumsum(blocks)])
    owner = np.repeat(np.arange(len(n)), blocks)
    first = offsets[owner] + (np.arange(before[-1]) - before[owner]) * BLOCK
    count = np.minimum(BLOCK, offsets[owner + 1] - first)
    if not len(count):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), before
    at = np.arange(BLOCK)[None]
    there = at < count[:, None]
    values = ids[np.where(there, first[:, None] + at, first[:, None])].astype(np.int64)
    least = values.min(axis=1)
    values -= least[:, None]
    values[~there] = 1 << 40
    ranked = np.sort(values, axis=1)
    wide = ranked[np.arange(len(count)), np.maximum(0, -(-count * PERCENTILE // 100) - 1)]
    width = np.frexp(wide.astype(float))[1].astype(np.int64)
    values[~there] = 0
    odd = (values >> width[:, None]) > 0
    odds = odd.sum(axis=1)
    packed = -(-count * width // 8)
    size = HEAD + packed + 5 * odds
    start = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(start[-1], np.uint8)
    start = start[:-1]
    out[start[:, None] + np.arange(4)] = least.astype("<u4").view(np.uint8).reshape(-1, 4)
    out[start + 4], out[start + 5], out[start + 6] = count - 1, width, odds
    for w in np.unique(width):
        if w:
            of = np.flatnonzero(width == w)
            low = (values[of] & ((1 << int(w)) - 1)).astype("<u4").view(np.uint8).reshape(len(of), BLOCK, 4)
            bits = np.unpackbits(low, axis=2, bitorder="little", count=int(w)).reshape(len(of), -1)
            raw = np.packbits(bits, axis=1, bitorder="little")
            mask = np.arange(raw.shape[1])[None] < packed[of][:, None]
            out[(start[of, None] + HEAD + np.arange(raw.shape[1])[None])[mask]] = raw[mask]
    b, place = np.nonzero(odd)
    nth = np.arange(len(b)) - np.repeat(np.cumsum(odds) - odds, odds)
    tail = start[b] + HEAD + packed[b]
    out[tail + nth] = place
    high = (values[b, place] >> width[b]).astype("<u4").view(np.uint8).reshape(-1, 4)
    out[(tail + odds[b] + 4 * nth)[:, None] + np.arange(4)] = high
    return out, start, before


def unpack_block(payload: bytes, start: int = 0) -> np.ndarray:
    raw = np.frombuffer(payload, np.uint8)[start:]
    least, count, width, odds = int(raw[:4].view("<u4")[0]), int(raw[4]) + 1, int(raw[5]), int(raw[6])
    packed = -(-count * width // 8)
    out = np.zeros(count, np.int64)
    if width:
        bits = np.unpackbits(raw[HEAD : HEAD + packed], bitorder="little", count=count * width).reshape(count, width)
        out = bits.astype(np.int64) @ (1 << np.arange(width, dtype=np.int64))
    place = raw[HEAD + packed : HEAD + packed + odds]
    high = np.frombuffer(raw[HEAD + packed + odds : HEAD + packed + 5 * odds].tobytes(), "<u4").astype(np.int64)
    out[place] |= high << width
    return (out + least).astype(np.int32)


def unpack(payload: bytes, starts: list[int]) -> list[int]:
    """All ids of a document."""
    return np.concatenate([unpack_block(payload, s) for s in starts]).tolist() if starts else []


def writing(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(shared)
        for b in slices(batches, "text", bpe.SLICE):
            ids, offsets, _ = enc.encode(b.column("text"))
            out, start, before = pack(ids, offsets)
            null = np.asarray(b.column("text").is_null())
            own = np.append(start, len(out))[before]
            within = start - np.repeat(own[:-1], np.diff(before))
            payload = pa.Array.from_buffers(pa.binary(), b.num_rows, [pa.array(~null).buffers()[1], pa.py_buffer(own.astype(np.int32)), pa.py_buffer(out)])
            yield pa.record_batch(
                {
                    "doc_id": b.column("doc_id"),
                    "n_tokens": pa.array(np.diff(offsets), mask=null),
                    "block_starts": pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.array(within.astype(np.int32)), mask=pa.array(null)),
                    "payload": payload,
                }
            )

    return run


def token_blocks(docs: DataFrame, path: str = bpe.VOCABULARY) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_tokens, block_starts, payload)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(writing(bpe.vocabulary(docs.sparkSession, path)), "doc_id long, n_tokens long, block_starts array<int>, payload binary")


def reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = zip(b.column("payload").to_pylist(), b.column("block_starts").to_pylist())
        yield pa.record_batch({"doc_id": b.column("doc_id"), "tokens": pa.array([None if p is None else unpack(p, s) for p, s in rows], pa.list_(pa.int32()))})


def tokens_of(blocks: DataFrame) -> DataFrame:
    """(doc_id, tokens) again."""
    return blocks.select("doc_id", "payload", "block_starts").mapInArrow(reading, "doc_id long, tokens array<int>")
