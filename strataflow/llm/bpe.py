"""BPE encoding and decoding with a public byte-level vocabulary (a file of base64 tokens and ranks).

A text is cut into words by the vocabulary's pattern. A word that isn't a token starts as single bytes: an array holds the
part boundaries and another, beside it, the rank of each adjacent pair. The least rank is found by a scan, its boundary is deleted and
the two neighbouring ranks are looked up again, until no pair has a rank. That is quadratic, so words of over SHORT bytes
use a heap over linked parts, with the same result. Words repeat, so the distinct ones of a batch are encoded once, all of them at once in numpy, a
row of ranks for each; a text's ids are then taken from its words'. Decoding takes the tokens' bytes in the same way.

Nulls: a null text has null ids; an empty one has none. Repeated rows are encoded alike, and all other columns are kept,
but for columns of the output's names, which are replaced.
"""

from __future__ import annotations

import base64
import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataflow.llm._shared import slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHORT, BLOCK, SLICE = 256, 1 << 18, 2 << 20
NONE = 1 << 62


def load(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word, by the contiguous rank array."""
    bounds = list(range(len(word) + 1))
    pairs = [ranks.get(word[i : i + 2], NONE) for i in range(len(word) - 1)]
    while pairs:
        least = min(pairs)
        if least == NONE:
            break
        i = pairs.index(least)
        del bounds[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(word[bounds[i] : bounds[i + 2]], NONE)
        if i:
            pairs[i - 1] = ranks.get(word[bounds[i - 1] : bounds[i + 1]], NONE)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As merge(), by a heap of (rank, place): n log n."""
    n = len(word)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2], NONE)) != NONE]
    heapq.heapify(heap)
    alive = bytearray(b"\1") * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        alive[j], end[i], after[i] = 0, stop, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(word[i : end[after[i]]], NONE)) != NONE:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if (k := before[i]) >= 0 and (r := ranks.get(word[k:stop], NONE)) != NONE:
            heapq.heappush(heap, (r, k, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = after[i]
    return out


#: White space, and what may be taken for it, among ASCII characters.
BLANK, NEAR_BLANK = np.zeros(256, bool), np.zeros(256, bool)
BLANK[[*range(9, 14), 32]] = NEAR_BLANK[[*range(9, 14), *range(28, 33)]] = True


def parts(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(parts, offsets of each text's, bytes of all): texts cut wherever ASCII white space follows another character. The pattern ends a word there always, and
    looks no further back or ahead than the part, so that each part can be encoded by itself."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    begin = np.zeros(len(raw) + 1, bool)
    begin[1:-1] = BLANK[raw[1:]] & ~NEAR_BLANK[raw[:-1]]
    high = np.flatnonzero(begin[1:-1] & (raw[:-1] >= 0x80)) if len(raw) else begin[:0]  # the last byte of a wider character, which may be white space too
    if len(high):
        x, y, z = raw[high].astype(np.int64), raw[np.maximum(high - 1, 0)], raw[np.maximum(high - 2, 0)]
        wide = (y == 0xC2) & ((x == 0x85) | (x == 0xA0)) | (z == 0xE1) & (y == 0x9A) & (x == 0x80) | (z == 0xE3) & (y == 0x80) & (x == 0x80)
        wide |= (z == 0xE2) & ((y == 0x80) & ((x <= 0x8A) | (x == 0xA8) | (x == 0xA9) | (x == 0xAF)) | (y == 0x81) & (x == 0x9F))
        begin[high[wide] + 1] = False
    begin[offsets[:-1]] = True
    start = np.flatnonzero(begin[:-1])
    ends = np.append(start, len(raw)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(raw)), np.searchsorted(start, offsets), raw


def repeated(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1 and so on, count[0] of them, then those from start[1]."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + count, count)


def taken(ids: np.ndarray, size: np.ndarray, code: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids of each sequence) of sequences code[offsets[i] : offsets[i + 1]], given those of each code."""
    count = size[code]
    ends = np.concatenate([[0], np.cumsum(count)])[offsets]
    return ids[repeated((np.cumsum(size) - size)[code], count)], np.diff(ends)


class Pairs:
    """The rank of each pair of adjacent tokens that together are one: a table of open addresses, looked up in numpy."""

    def __init__(self, ranks: dict[bytes, int]):
        found = [(a, b, r) for token, r in ranks.items() for k in range(1, len(token)) if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None]
        a, b, rank = np.array(found, np.int64).reshape(-1, 3).T
        self.bits = max(4, int(4 * len(a)).bit_length())
        self.table = np.full(1 << self.bits, -1, np.int64)
        entry = self.key(a, b) << 20 | rank
        slot = self.slot(entry >> 20)
        while len(entry):
            first = np.zeros(len(entry), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            first &= self.table[slot] < 0
            self.table[slot[first]] = entry[first]
            entry, slot = entry[~first], (slot[~first] + 1) & len(self.table) - 1

    @staticmethod
    def key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a << 20 | b

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, LAST where there is none; a negative id has no pair."""
        out = np.full(len(a), LAST, np.int32)
        left = np.flatnonzero((a >= 0) & (b >= 0))
        key = self.key(a[left].astype(np.int64), b[left].astype(np.int64))
        slot = self.slot(key)
        while len(left):
            entry = self.table[slot]
            hit = entry >> 20 == key
            out[left[hit]] = entry[hit] & (1 << 20) - 1
            go = ~hit & (entry >= 0)
            left, key, slot = left[go], key[go], (slot[go] + 1) & len(self.table) - 1
        return out


LAST = np.iinfo(np.int32).max
LETTER, DIGIT, SPACE, OTHER, ASK = range(1, 6)
KIND = np.full(256, ASK, np.uint8)
KIND[33:127] = OTHER
KIND[[*range(65, 91), *range(97, 123)]], KIND[48:58], KIND[[*range(9, 14), 32]], KIND[39] = LETTER, DIGIT, SPACE, ASK


def cut_words(raw: np.ndarray, offsets: np.ndarray, find) -> np.ndarray:
    """Where the pattern's words begin in parts() of texts. Kinds of characters settle it, but for parts with an apostrophe or with
    characters other than ASCII and Latin letters up to U+017F: the pattern itself cuts those."""
    kind = KIND[raw]
    lead = np.flatnonzero((raw >= 0xC3) & (raw <= 0xC5))
    lead = lead[~((raw[lead] == 0xC3) & ((raw[lead + 1] == 0x97) | (raw[lead + 1] == 0xB7)))]
    kind[lead] = kind[lead + 1] = LETTER
    space = kind == SPACE
    begin = np.zeros(len(raw) + 1, bool)
    change = kind[1:] != kind[:-1]
    change[offsets[1:-1] - 1] = False
    inner = change & ~space[:-1]
    after = change & space[:-1]  # the last blank goes with what follows it, or stands alone if it isn't a space
    begin[1:-1] = inner | after & (raw[:-1] != 32)
    begin[:-2] |= after
    begin[offsets[:-1]] = True
    odd = np.flatnonzero(np.logical_or.reduceat(kind == ASK, offsets[:-1]))
    for k in odd.tolist():
        i, j = int(offsets[k]), int(offsets[k + 1])
        text = raw[i:j].tobytes()
        begin[i + 1 : j] = False
        if text.isascii():
            sizes = map(len, find(text.decode()))
        else:
            sizes = (len(w.encode()) for w in find(text.decode()))
        for n in sizes:
            begin[i] = True
            i += n
    return np.flatnonzero(begin[:-1])


class Encoder:
    """Texts to ids, and back. A batch's distinct parts are encoded once, and all texts' ids taken from theirs."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.tokens = {rank: token for token, rank in ranks.items()}
        known = [self.tokens.get(i, b"") for i in range(max(self.tokens, default=-1) + 1)]
        self.sizes = np.fromiter(map(len, known), np.int64, len(known))
        self.starts, self.bytes = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(known), np.uint8)
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.pairs = Pairs(ranks)

    def merged(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, ids of each): merge() over all words of up to SHORT bytes at once. Each row of `ranks` is a word's array of ranks and each row
        of `ids` its parts; a round finds the least rank of every row, deletes that boundary and looks up the two neighbours. Rows without a rank leave."""
        order = np.argsort(size, kind="stable")
        rows, counts, ids_of = [], [], []
        i = 0
        while i < len(order):
            j = min(len(order), i + 1 + BLOCK // max(1, int(size[order[i]])))
            at = order[i:j]
            i = j
            wide = int(size[at[-1]])
            column = np.arange(wide)
            there = column < size[at][:, None]
            ids = np.where(there, self.single[raw[np.where(there, start[at][:, None] + column, 0)]], -1).astype(np.int32)
            ranks = self.pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(at), wide - 1)
            while len(at):
                if ranks.shape[1]:
                    least = ranks.argmin(axis=1)
                    rank = np.take_along_axis(ranks, least[:, None], 1)[:, 0]
                    on = rank < LAST
                else:
                    on = np.zeros(len(at), bool)
                if not on.all():
                    done = ids[~on]
                    rows.append(at[~on])
                    counts.append((done >= 0).sum(axis=1))
                    ids_of.append(done[done >= 0])
                    at, ids, ranks = at[on], ids[on], ranks[on]
                    if not len(at):
                        break
                    least, rank = least[on], rank[on]
                near = np.arange(ids.shape[1] - 1) <= least[:, None]
                ids = np.where(near, ids[:, :-1], ids[:, 1:])
                ranks = np.where(near[:, :-1], ranks[:, :-1], ranks[:, 1:])
                row = np.arange(len(at))
                ids[row, least] = rank
                r = np.flatnonzero(least > 0)
                ranks[r, least[r] - 1] = self.pairs(ids[r, least[r] - 1], rank[r])
                r = np.flatnonzero(least < ranks.shape[1])
                ranks[r, least[r]] = self.pairs(rank[r], ids[r, least[r] + 1])
        if not rows:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        row, count, flat = np.concatenate(rows), np.concatenate(counts), np.concatenate(ids_of)
        out = np.empty(len(row), np.int64)
        out[row] = count
        begin = np.empty(len(row), np.int64)
        begin[row] = np.cumsum(count) - count
        return flat[repeated(begin, out)], out

    def words(self, cut: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of distinct words, ids of each)."""
        names = cut.to_pylist()
        own = np.fromiter((self.ranks.get(w, -1) for w in names), np.int64, len(names))
        offsets = np.frombuffer(cut.buffers()[1], np.int64)[cut.offset : cut.offset + len(names) + 1]
        size = np.diff(offsets)
        short = np.flatnonzero((own < 0) & (size <= SHORT))
        flat, count = self.merged(np.frombuffer(cut.buffers()[2] or b"", np.uint8), offsets[:-1][short], size[short])
        long = {k: merge_long(names[k], self.ranks) for k in np.flatnonzero((own < 0) & (size > SHORT)).tolist()}
        counts = np.ones(len(names), np.int64)
        counts[short] = count
        for k, ids in long.items():
            counts[k] = len(ids)
        begin = np.cumsum(counts) - counts
        out = np.empty(counts.sum(), np.int32)
        out[begin[own >= 0]] = own[own >= 0]
        out[repeated(begin[short], count)] = flat
        for k, ids in long.items():
            out[begin[k] : begin[k] + len(ids)] = ids
        return out, counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(all ids, offsets of each text's, the texts' bytes)."""
        cut, offsets, raw = parts(texts)
        if not len(cut):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64), raw
        coded = cut.dictionary_encode()
        distinct = coded.dictionary
        at = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
        spelled = np.frombuffer(distinct.buffers()[2], np.uint8)[: at[-1]]
        start = cut_words(spelled, at, self.find)
        spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.append(start, len(spelled)).astype(np.int64)), pa.py_buffer(spelled)])
        word = spans.dictionary_encode()
        ids, size = self.words(word.dictionary)
        ids, size = taken(ids, size, np.asarray(word.indices), np.searchsorted(start, at))
        ids, size = taken(ids, size, np.asarray(coded.indices), offsets)
        return ids, np.concatenate([[0], np.cumsum(size)]), raw

    def spelled(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids, offsets of each id's)."""
        size = self.sizes[ids]
        return self.bytes[repeated(self.starts[ids], size)], np.concatenate([[0], np.cumsum(size)])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def vocabulary(spark: SparkSession, path: str) -> tuple[str, Broadcast]:
    """The ranks, read on the driver and sent to each executor once (some 50,000 tokens, whatever the texts)."""
    return uuid.uuid4().hex, spark.sparkContext.broadcast(load(path))


def encoder(shared: tuple[str, Broadcast]) -> Encoder:
    """One per worker and vocabulary."""
    key, ranks = shared
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(ranks.value)
    return _ENCODERS[key]


def same(raw: np.ndarray, spelled: np.ndarray, offsets: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Whether each text's bytes, raw[offsets[i] : offsets[i + 1]], are spelled[own[i] : own[i + 1]]."""
    size = np.diff(offsets)
    out = size == np.diff(own)
    at = np.flatnonzero(out & (size > 0))
    differ = raw[repeated(offsets[:-1][at], size[at])] != spelled[repeated(own[:-1][at], size[at])]
    if len(at):
        out[at] = ~np.logical_or.reduceat(differ, np.cumsum(size[at]) - size[at])
    return out


def encoding(shared, check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared)
        for b in slices(batches, "text", SLICE):
            ids, offsets, raw = enc.encode(b.column("text"))
            null = np.asarray(b.column("text").is_null())
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids), mask=pa.array(null))
            columns = {n: b.column(n) for n in b.schema.names} | {"tokens": lists, "n_tokens": pa.array(np.diff(offsets), mask=null)}
            if check:
                columns = {"doc_id": columns["doc_id"]} | {k: columns[k] for k in ("n_tokens", "tokens")}
                spelled, at = enc.spelled(ids)
                size = np.asarray(pc.fill_null(pc.binary_length(b.column("text")), 0)).astype(np.int64)
                columns["exact"] = pa.array(same(raw, spelled, np.concatenate([[0], np.cumsum(size)]), at[offsets]), pa.bool_(), mask=null)
            yield pa.record_batch(columns)

    return run


TOKENS = [T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())]


def encoded(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """docs with tokens and n_tokens."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("tokens", "n_tokens")])
    schema = T.StructType([*docs.schema.fields, *TOKENS])
    return docs.mapInArrow(encoding(vocabulary(docs.sparkSession, path), False), schema)


def round_trips(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, tokens, exact): exact says whether the ids decode to the text itself."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(encoding(vocabulary(docs.sparkSession, path), True), "doc_id long, n_tokens long, tokens array<int>, exact boolean")


def decoding(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared)
        for b in batches:
            lists = b.column("tokens")
            null, ids = np.asarray(lists.is_null()), np.asarray(lists.flatten())
            spelled, at = enc.spelled(ids)
            cut = at[np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))])].tolist()
            raw = spelled.tobytes()
            yield pa.record_batch({"doc_id": b.column("doc_id"), "text": pa.array([None if n else raw[i:j].decode("utf-8", "replace") for n, i, j in zip(null.tolist(), cut, cut[1:])], pa.string())})

    return run


def decoded(tokens: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of tokens(doc_id, tokens)."""
    return tokens.select("doc_id", "tokens").mapInArrow(decoding(vocabulary(tokens.sparkSession, path)), "doc_id long, text string")
