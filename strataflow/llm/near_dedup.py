"""MinHash near-dedup with HyperMinHash sketches.

A document's set is its runs of three words (lower case, split at white space; all its words if there are fewer).

1. Of each shingle's hash, 7 bits choose one of 128 registers. A register keeps the least remainder, compressed to its
   leading-zero count (6 bits) and the 10 bits after the leading one.
2. Documents with equal shingles are collapsed to the one of least doc_id by a 128-bit hash.
3. Registers, with the empty ones filled by optimal densification, form 32 bands of 4. In a band, all documents of a
   bucket are paired with its least doc_id, so a bucket of copies costs in proportion to its size.
4. Sketches estimate each pair's Jaccard similarity, corrected for expected register collisions; pairs that are more than
   0.13 (three standard deviations) below the threshold go.
5. Texts verify the others: first the likeliest pair of each document, then all pairs that would join two different groups.
6. Buckets whose documents are in several groups by then are gone through again, the next HEADS documents (and four times as many in each round) with all
   others that are in other groups, until each pair of each bucket is compared or within one group.
7. Groups are the connected components; the least doc_id of each stays.

Nulls: rows whose doc_id or text is null, and texts without words, take no part and stay. Rows that share a doc_id are one
document, with all their texts; where they repeat doc_id and words, one of them stays. Other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataflow.llm._shared import emptied, hashes, mix, slices, stored, words
from strataflow.llm.graph import components

THRESHOLD, MARGIN = 0.6, 0.13
SHINGLE, REGISTERS, BAND, HEADS = 3, 128, 4, 16
MANTISSA, EMPTY = 10, 0xFFFF
#: Expected collisions of registers of unrelated sets of like size, as a multiple of 2 ** -MANTISSA per register (Yu and Weber, HyperMinHash).
COLLISIONS = 0.169919487159739


def _donors() -> np.ndarray:
    """For each register, all registers in a fixed random order: where an empty one is filled from."""
    rng = np.random.default_rng(20)
    return np.stack([rng.permutation(REGISTERS) for _ in range(REGISTERS)], axis=1)


DONORS = _donors()


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, offsets of each text's)."""
    offsets, codes, vocab = words(texts)
    h = hashes(vocab)[codes] if len(codes) else np.zeros(0, np.uint64)
    n = np.diff(offsets)
    count = np.where(n == 0, 0, np.maximum(1, n - SHINGLE + 1))
    out = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(offsets[:-1], count) + np.arange(out[-1]) - np.repeat(out[:-1], count)
    end = np.repeat(offsets[1:], count)
    total = np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        there = at + k < end
        total = mix(total + np.where(there, h[np.minimum(at + k, max(len(h) - 1, 0))] if len(h) else np.uint64(0), np.uint64(k + 1)))
    return total, out


def registers(hashed: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, REGISTERS) of uint16: leading-zero count << MANTISSA | mantissa of each register's least hash."""
    rows = len(offsets) - 1
    least = np.full(rows * REGISTERS, np.uint64(1 << 51))
    np.minimum.at(least, np.repeat(np.arange(rows), np.diff(offsets)) * REGISTERS + (hashed >> np.uint64(57)).astype(np.int64), hashed >> np.uint64(6) & np.uint64((1 << 51) - 1))
    empty = least == np.uint64(1 << 51)
    zeros = 51 - np.frexp(np.where(empty, 0, least).astype(np.float64))[1].astype(np.int64)
    tail = (least << np.minimum(zeros + 1, 63).astype(np.uint64)) & np.uint64((1 << 51) - 1)
    out = (zeros << MANTISSA) | (tail >> np.uint64(51 - MANTISSA)).astype(np.int64)
    return np.where(empty, EMPTY, out).astype(np.uint16).reshape(rows, REGISTERS)


def bands(regs: np.ndarray) -> np.ndarray:
    """(texts, REGISTERS / BAND) of hashes of the densified registers."""
    full = regs.copy()
    short = np.flatnonzero((regs == EMPTY).any(axis=1) & (regs != EMPTY).any(axis=1))
    if len(short):
        sub, raw = full[short], regs[short]
        for donor in DONORS:
            hole = sub == EMPTY
            if not hole.any():
                break
            sub = np.where(hole, raw[:, donor], sub)
        full[short] = sub
    out = np.zeros((len(regs), REGISTERS // BAND), np.uint64) + np.arange(REGISTERS // BAND, dtype=np.uint64)
    for k in range(BAND):
        out = mix(out + full[:, k::BAND].astype(np.uint64), k)
    return out


def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        h, offsets = shingles(b.column("text"))
        n = np.diff(offsets)
        ok = np.flatnonzero(n)
        if not len(ok):
            continue
        regs = registers(h, offsets)[ok]
        width = REGISTERS // BAND
        yield pa.record_batch(
            {
                "doc_id": b.column("doc_id").take(pa.array(ok)).cast(pa.int64()),
                "k1": pa.array(np.add.reduceat(mix(h, 1), offsets[ok]).view(np.int64)),
                "k2": pa.array(np.add.reduceat(mix(h, 2), offsets[ok]).view(np.int64)),
                "n": pa.array(n[ok].astype(np.int64)),
                "regs": pa.array([r.tobytes() for r in regs], pa.binary()),
                "bands": pa.ListArray.from_arrays(pa.array(np.arange(0, len(ok) * width + 1, width, dtype=np.int32)), pa.array(bands(regs).ravel().view(np.int64))),
            }
        )


SKETCH = "doc_id long, k1 long, k2 long, n long, regs binary, bands array<long>"


def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Jaccard similarities of pairs of sketches, corrected for collisions."""
    for b in batches:
        if not b.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("x", "y"))
        nx, ny = (b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("nx", "ny"))
        filled = np.maximum(((x != EMPTY) | (y != EMPTY)).sum(axis=1), 1)
        same = ((x == y) & (x != EMPTY)).sum(axis=1)
        by_chance = COLLISIONS * filled / (1 << MANTISSA) * 4 * nx * ny / (nx + ny) ** 2
        yield pa.record_batch({"a": b.column("a"), "b": b.column("b"), "est": pa.array(np.maximum(same - by_chance, 0) / filled)})


def verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                (x, ox), (y, oy) = shingles(part.column("x")), shingles(part.column("y"))
                keep = []
                for k in range(part.num_rows):
                    p, q = np.unique(x[ox[k] : ox[k + 1]]), np.unique(y[oy[k] : oy[k + 1]])
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    keep.append(both >= threshold * (len(p) + len(q) - both))
                yield part.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


def shared_buckets(sketches: DataFrame) -> DataFrame:
    """(band, doc_id, head) of the buckets of two documents and more; the head is the least doc_id."""
    buckets = sketches.select("doc_id", F.explode("bands").alias("band"))
    several = buckets.groupBy("band").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("last")).where("head < last").drop("last")
    return buckets.join(several, "band").distinct()


def estimated(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """(a, b, est) of pairs(a, b)."""
    side = lambda k, r, n: sketches.select(F.col("doc_id").alias(k), F.col("regs").alias(r), F.col("n").alias(n))
    both = pairs.join(side("a", "x", "nx"), "a").join(side("b", "y", "ny"), "b").select("a", "b", "x", "y", "nx", "ny")
    return both.mapInArrow(estimate, "a long, b long, est double").groupBy("a", "b").agg(F.max("est").alias("est"))


def duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """((doc_id, duplicate_of) of the documents that go, sketches)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    sketches = stored(docs.mapInArrow(sketch, SKETCH), "sketches")
    heads = stored(sketches.groupBy("k1", "k2").agg(F.min("doc_id").alias("head")), "heads")
    copies = sketches.select("doc_id", "k1", "k2").join(heads, ["k1", "k2"]).where("doc_id <> head").select(F.col("head").alias("a"), F.col("doc_id").alias("b"))
    lone = sketches.join(heads, (sketches["k1"] == heads["k1"]) & (sketches["k2"] == heads["k2"]) & (F.col("doc_id") == F.col("head"))).select("doc_id", sketches["k1"], sketches["k2"], "n", "regs", "bands").dropDuplicates(["doc_id", "k1", "k2"])
    buckets = stored(shared_buckets(lone), "buckets")
    some = buckets.select("doc_id").distinct()
    lone = stored(lone.drop("bands").join(some.hint("merge"), "doc_id", "left_semi"), "near-sketches")
    # ids grow with the corpus: never broadcast
    texts = stored(docs.join(some.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]), "near-texts")

    def verified(these: DataFrame) -> DataFrame:
        both = these.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y")), "b")
        return stored(both.select("a", "b", "x", "y").mapInArrow(verify(threshold), "a long, b long").distinct(), "near-verified")

    of = lambda roots, k, r: roots.select(F.col("node").alias(k), F.col("root").alias(r))

    def joined(pairs: DataFrame, known: DataFrame | None) -> DataFrame:
        """known(a, b) and those of pairs(a, b) that are near: of each b the likeliest first, then those that would join two groups."""
        pairs = stored(estimated(pairs, lone).where(F.col("est") >= threshold - MARGIN), "near-pairs")
        likeliest = pairs.withColumn("nth", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("est"), "a"))).where("nth = 1").select("a", "b")
        first = verified(likeliest)
        edges = first if known is None else known.union(first)
        roots = components(edges)
        rest = pairs.join(likeliest, ["a", "b"], "left_anti").join(of(roots, "a", "ra"), "a", "left").join(of(roots, "b", "rb"), "b", "left").where("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b")
        return edges.union(verified(rest))

    edges = joined(buckets.where("head <> doc_id").select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct(), None)
    left, most = buckets.where("doc_id <> head").select("band", "doc_id"), HEADS
    while True:
        roots = components(edges)
        left = left.join(of(roots, "doc_id", "root"), "doc_id", "left").select("band", "doc_id", F.coalesce("root", "doc_id").alias("root"))
        mixed = left.groupBy("band").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 < r2").select("band")
        left = stored(left.join(mixed.hint("merge"), "band", "left_semi"), "near-left")
        if left.isEmpty():
            break
        nth = F.row_number().over(Window.partitionBy("band").orderBy("doc_id"))
        first = stored(left.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth"), "near-heads")
        pairs = first.select("band", F.col("doc_id").alias("a"), F.col("root").alias("ra")).join(left, "band").where("a < doc_id and ra <> root").select("a", F.col("doc_id").alias("b")).distinct()
        edges = joined(pairs, edges)
        left, most = left.join(first.select("band", "doc_id"), ["band", "doc_id"], "left_anti").select("band", "doc_id"), 4 * most
    final = components(edges.union(copies))
    return final.select(F.col("node").alias("doc_id"), F.col("root").alias("duplicate_of")), sketches


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents of docs(doc_id, text) that are near copies of another one, which stays: (doc_id, duplicate_of)."""
    return duplicates(docs, threshold)[0]


def without_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each group of near copies."""
    gone, sketches = duplicates(docs, threshold)
    columns = docs.columns
    key = emptied("doc_key", columns)
    kept = docs.join(gone.select(F.col("doc_id").alias(key)), F.col("doc_id").cast("long") == F.col(key), "left_anti")
    again = sketches.groupBy("doc_id", "k1", "k2").count().where("count > 1").select(F.col("doc_id").alias(key)).distinct()
    if again.isEmpty():
        return kept
    match = F.col("doc_id").cast("long") == F.col(key)
    nth = emptied("nth", columns)
    normal = F.array_join(F.filter(F.split(F.lower(F.col("text").cast("string")), r"(?U)\s+"), lambda w: w != ""), " ")
    one = kept.join(again, match, "left_semi").withColumn(nth, F.row_number().over(Window.partitionBy("doc_id", normal).orderBy(F.xxhash64("text")))).where((F.col(nth) == 1) | (normal == "") | normal.isNull())
    return kept.join(again, match, "left_anti").unionByName(one.drop(nth))
