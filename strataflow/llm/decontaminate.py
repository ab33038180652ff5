"""Benchmark decontamination: a distributed positional inverted index of the training texts.

Words are lower case, with outer punctuation off; bare punctuation isn't a word. The index is a table of shards. A shard covers about SHARD bytes of texts
and stores, for each term of the benchmark, the sorted positions of its tokens, and where each document begins. It is
written once and then searched shard by shard, so that no posting is shuffled.

Exact phrase: PHRASE words in a row of an item (all of it, if it has MIN_WORDS to PHRASE) stand in a row in the document. The phrase's lists, rarest term first,
are moved by the term's offset and intersected. Items of fewer words can't be told from chance and match nothing.
Proximity: at least SHARE of the item's distinct terms, of which there must be MIN_TERMS, stand within SPREAD times its length in words. Such a window holds one of its
(terms - needed + 1) rarest terms, so only their postings are candidates.

Nulls: rows whose doc_id, item_id or text is null match nothing and stay. Rows that share a doc_id are matched each, and reported
together; items that share an id are matched each. Without documents or items there are no matches. Other columns are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm._shared import array_of, emptied, slices, stored, words
from strataflow.llm.toxicity import OUTER

PHRASE, MIN_WORDS = 8, 5
SHARE, MIN_TERMS, SPREAD = 0.8, 8, 1.25
SHARD = 16 << 20
#: Bytes of benchmark texts that are sent to the workers at once; a larger benchmark is searched in so many parts.
PART = 16 << 20

INDEX = "doc_ids array<long>, starts array<int>, terms array<string>, cuts array<int>, positions array<int>"


def bare_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """As words(), without outer punctuation."""
    offsets, codes, vocab = words(texts)
    bare = array_of(pc.utf8_trim(vocab, OUTER)).dictionary_encode()
    code = np.asarray(bare.indices).astype(np.int64)[codes]
    names = bare.dictionary.to_pylist()
    full = np.array([n != "" for n in names], bool)[code] if len(code) else np.zeros(0, bool)
    return np.concatenate([[0], np.cumsum(full)])[offsets], code[full], names


def indexing(known: frozenset[str]):
    """Texts to shards with the postings of the known terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SHARD):
            offsets, codes, names = bare_words(b.column("text"))
            wanted = np.array([n in known for n in names], bool)
            terms = [n for n, w in zip(names, wanted) if w]
            term = np.where(wanted, np.cumsum(wanted) - 1, -1)[codes] if len(codes) else codes
            at = np.flatnonzero(term >= 0)
            order = np.argsort(term[at], kind="stable")
            cuts = np.concatenate([[0], np.cumsum(np.bincount(term[at], minlength=len(terms)))]).astype(np.int32)
            one = lambda x, t: pa.array([x], pa.list_(t))
            yield pa.record_batch({"doc_ids": one(b.column("doc_id").to_numpy(zero_copy_only=False), pa.int64()), "starts": one(offsets.astype(np.int32), pa.int32()), "terms": one(terms, pa.string()), "cuts": one(cuts, pa.int32()), "positions": one(at[order].astype(np.int32), pa.int32())})

    return run


class Item:
    def __init__(self, key: int, text: list[str]):
        self.key, self.words = key, text
        self.terms = sorted(set(text))
        self.need = math.ceil(SHARE * len(self.terms)) if len(self.terms) >= MIN_TERMS else 0
        self.width = math.ceil(SPREAD * len(text))
        n = min(PHRASE, len(text))
        self.phrases = list(dict.fromkeys(tuple(text[i : i + n]) for i in range(len(text) - n + 1))) if len(text) >= MIN_WORDS else []


class Shard:
    """Postings of one shard: sorted positions by term."""

    def __init__(self, doc_ids, starts, terms, cuts, positions):
        self.doc_ids, self.starts, self.cuts, self.positions = doc_ids, starts, cuts, positions
        self.number = {t: k for k, t in enumerate(terms)}
        self.term_at = np.full(int(starts[-1]) if len(starts) else 0, -1, np.int32)
        self.term_at[positions] = np.repeat(np.arange(len(terms)), np.diff(cuts))

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.cuts[term] : self.cuts[term + 1]]

    def documents(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, side="right") - 1

    def phrase(self, phrase: tuple[str, ...]) -> np.ndarray:
        """Documents that hold the phrase."""
        terms = [self.number.get(w, -1) for w in phrase]
        if -1 in terms:
            return np.zeros(0, np.int64)
        order = sorted(range(len(terms)), key=lambda k: self.cuts[terms[k] + 1] - self.cuts[terms[k]])
        begin = self.postings(terms[order[0]]).astype(np.int64) - order[0]
        for k in order[1:]:
            if not len(begin):
                break
            other = self.postings(terms[k]).astype(np.int64) - k
            if len(other):
                found = np.minimum(np.searchsorted(other, begin), len(other) - 1)
                begin = begin[other[found] == begin]
            else:
                begin = begin[:0]
        if not len(begin):
            return begin
        doc = self.documents(np.maximum(begin, 0))
        return np.unique(doc[(begin >= self.starts[doc]) & (begin + len(phrase) <= self.starts[doc + 1])])

    def near(self, item: Item) -> np.ndarray:
        """Documents with a window of item.width tokens that holds item.need of its terms."""
        terms = [k for k in (self.number.get(t, -1) for t in item.terms) if k >= 0]
        spare = len(item.terms) - item.need + 1 - (len(item.terms) - len(terms))  # absent terms are the rarest
        if not item.need or spare <= 0:
            return np.zeros(0, np.int64)
        size = [int(self.cuts[k + 1] - self.cuts[k]) for k in terms]
        rare = [terms[k] for k in np.argsort(size, kind="stable")[:spare]]
        at = np.unique(np.concatenate([self.postings(k) for k in rare])).astype(np.int64)
        own = np.full(len(self.number) + 1, -1, np.int64)
        own[terms] = np.arange(len(terms))
        found: list[np.ndarray] = []
        reach = np.arange(-item.width + 1, item.width)
        for i in range(0, len(at), 4096):
            p = at[i : i + 4096]
            doc = self.documents(p)
            spot = p[:, None] + reach
            inside = (spot >= self.starts[doc][:, None]) & (spot < self.starts[doc + 1][:, None])
            term = np.where(inside, own[self.term_at[np.clip(spot, 0, len(self.term_at) - 1)]], -1)
            likely = (term >= 0).sum(axis=1) >= item.need
            for row, d in zip(term[likely], doc[likely]):
                if len(np.unique(row[row >= 0])) >= item.need and most_distinct(row, item.width, len(terms)) >= item.need:
                    found.append(d)
        return np.unique(np.array(found, np.int64))


def most_distinct(row: np.ndarray, width: int, terms: int) -> int:
    """The most distinct numbers >= 0 in any `width` neighbours."""
    seen, now, best = np.zeros(terms, np.int64), 0, 0
    for k, t in enumerate(row.tolist()):
        if t >= 0:
            now += seen[t] == 0
            seen[t] += 1
        if k >= width and (old := int(row[k - width])) >= 0:
            seen[old] -= 1
            now -= seen[old] == 0
        best = max(best, now)
    return int(best)


def searching(items: list[tuple[int, list[str]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = [Item(k, t) for k, t in items]
        for b in batches:
            for k in range(b.num_rows):
                shard = Shard(*(np.asarray(b.column(c)[k].values) if c != "terms" else b.column(c)[k].as_py() for c in ("doc_ids", "starts", "terms", "cuts", "positions")))
                out: list[tuple] = []
                for item in tests:
                    exact: dict[int, int] = {}
                    for p in item.phrases:
                        for d in shard.phrase(p).tolist():
                            exact[d] = exact.get(d, 0) + 1
                    near = set(shard.near(item).tolist())
                    out += [(int(shard.doc_ids[d]), item.key, exact.get(d, 0), d in near) for d in sorted(exact.keys() | near)]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], names=["doc_id", "item_id", "phrases", "near"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, phrases, near): how many of the item's phrases the document holds, and if its terms stand near."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    tests = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    parts = max(1, math.ceil((tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / PART))
    found = []
    for part in range(parts):
        rows = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()  # of about PART bytes
        offsets, codes, names = bare_words(pa.array([r["text"] for r in rows], pa.large_string()))
        items = [(r["item_id"], [names[c] for c in codes[i:j]]) for r, i, j in zip(rows, offsets, offsets[1:])]
        index = stored(docs.mapInArrow(indexing(frozenset(w for _, t in items for w in t)), INDEX), "index")
        found.append(index.mapInArrow(searching(items), "doc_id long, item_id long, phrases long, near boolean"))
    return reduce(DataFrame.union, found).groupBy("doc_id", "item_id").agg(F.max("phrases").alias("phrases"), F.max("near").alias("near"))


def without_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a phrase of the benchmark, or most of an item's terms close together."""
    key = emptied("doc_key", docs.columns)
    gone = contamination(docs, benchmark).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(key), "left_anti")
