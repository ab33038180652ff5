"""Line dedup: an exact set-similarity join of lines.

A line's set is its distinct words (lower case, split at ASCII white space). A line goes if an earlier line
(by doc_id, then line number) has a set of Jaccard similarity >= threshold, whether or not that line stays itself.

1. Word frequencies over all lines, summed by hash bucket (a table of fixed size), order the words by rarity; the hash
   breaks ties, so the order is total and the join exact, however coarse the buckets.
2. Lines of one set are aggregated by a 128-bit hash to the first of them, in tasks before the shuffle; only that one can be the line that matches an earlier set's, as
   the others follow a copy. So a line of thousands of copies, or of a third of all rows, has one row from here on.
3. Each set gives its rarest |s| - ceil(t|s|) + 1 words as prefix postings, with its first line, its size and a 64-bit
   parity bitmap. Two sets of the wanted similarity share a prefix word.
4. Postings meet by word, sorted by line. The length, positional and bitmap filters (all of them free of false negatives)
   leave candidates. Of each set and word, the first CANDIDATES go on; a set that these don't settle gets all of its candidates in a
   second pass, so that groups of thousands of like lines stay linear and none is missed.
5. The candidates' words are compared exactly.

Nulls: rows whose doc_id or text is null take no part and stay as they are. Lines without words stay. Rows that share
doc_id and line number are never earlier than one another, so repeated rows don't remove their own lines. Other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm._shared import array_of, emptied, hashes, mix, slices, stored, words

THRESHOLD = Fraction(9, 10)
BUCKETS = 1 << 20
CANDIDATES = 16


def split_lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(lines, row of each, number of each from 0)."""
    parts = array_of(pc.split_pattern(texts.cast(pa.large_string()), "\n"))
    flat, offsets = parts.flatten(), np.asarray(parts.offsets).astype(np.int64)
    count = np.diff(offsets)
    return flat, np.repeat(np.arange(len(count)), count), np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], count)


def distinct_words(offsets: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """line << 32 | word, sorted, each once."""
    key = np.sort(np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(offsets)) << np.uint64(32) | codes.astype(np.uint64))
    return key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for b in slices(batches, "text"):
        _, codes, vocab = words(b.column("text"))
        at = (hashes(vocab) % np.uint64(BUCKETS)).astype(np.int64)
        np.add.at(total, at, np.bincount(codes, minlength=len(vocab)))
    some = np.flatnonzero(total)
    for i in range(0, len(some), 1 << 16):
        yield pa.record_batch({"bucket": pa.array(some[i : i + (1 << 16)].astype(np.int32)), "n": pa.array(total[some[i : i + (1 << 16)]])})


def word_order(docs: DataFrame) -> np.ndarray:
    """Occurrences of words by hash bucket, over all lines of docs(text): BUCKETS numbers at most, whatever the size of docs."""
    found = docs.select("text").mapInArrow(word_counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def line_rows(counts: np.ndarray, t: Fraction):
    """Batches of (doc_id, text) -> one row per line with words: its set's hashes and, once per set and slice, the set's size, bitmap and prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            lines, row, number = split_lines(b.column("text"))
            offsets, codes, vocab = words(lines)
            if not len(codes):
                continue
            h = hashes(vocab)
            order = np.lexsort((h, counts[(h % np.uint64(BUCKETS)).astype(np.int64)]))
            rank = np.empty(len(h), np.uint64)
            rank[order] = np.arange(len(h), dtype=np.uint64)
            key = distinct_words(offsets, rank[codes])
            line, word = (key >> np.uint64(32)).astype(np.int64), h[order[(key & np.uint64(0xFFFFFFFF)).astype(np.int64)]]
            start = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
            at, n = line[start], np.diff(np.append(start, len(line)))
            h1, h2 = np.add.reduceat(mix(word, 1), start), np.add.reduceat(mix(word, 2), start)
            bits = np.bitwise_xor.reduceat(np.uint64(1) << (mix(word, 3) >> np.uint64(58)), start)
            prefix = n - -(-t.numerator * n // t.denominator) + 1
            first = np.zeros(len(at), bool)
            first[np.unique(h1, return_index=True)[1]] = True
            taken = np.where(first, prefix, 0)
            pick = np.repeat(start, taken) + np.arange(taken.sum()) - np.repeat(np.cumsum(taken) - taken, taken)
            i64 = lambda x: pa.array(x.view(np.int64))
            yield pa.record_batch(
                {
                    "doc_id": b.column("doc_id").take(pa.array(row[at])).cast(pa.int64()),
                    "line_no": pa.array(number[at].astype(np.int32)),
                    "h1": i64(h1),
                    "h2": i64(h2),
                    "n": pa.array(n.astype(np.int32)),
                    "bits": i64(bits),
                    "prefix": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(taken)]).astype(np.int32)), i64(word[pick])),
                }
            )

    return run


LINE_ROWS = "doc_id long, line_no int, h1 long, h2 long, n int, bits long, prefix array<long>"
#: Postings are five numbers: word, doc_id, line_no << 32 | place in the prefix, size of the set, bitmap.
POSTING = ["word", "doc_id", "at", "n", "bits"]
CANDIDATE_ROWS = "x_doc long, x_line int, y_doc long, y_line int, more boolean"


def candidates(t: Fraction, most: int | None):
    """Postings sorted by (word, doc_id, line_no) -> for each, the earlier ones that pass the filters (the first `most`)."""

    def pairs(c: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        c |= {"line_no": (c["at"] >> 32).astype(np.int32), "place": c["at"] & 0xFFFFFFFF, "wanted": c.get("wanted", np.ones(len(c["word"]), bool))}
        w = c["word"]
        fresh = np.concatenate([[True], w[1:] != w[:-1]])
        start = np.maximum.accumulate(np.where(fresh, np.arange(len(w)), 0))
        before = np.where(c["wanted"], np.arange(len(w)) - start, 0)
        cut = np.cumsum(before) // 2_000_000
        edges = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), len(w)]
        for i, j in zip(edges[:-1], edges[1:]):
            k = before[i:j]
            x = np.repeat(np.arange(i, j), k)
            y = np.arange(len(x)) - np.repeat(np.cumsum(k) - k, k) + start[x]
            nx, ny = c["n"][x], c["n"][y]
            need = -(-t.numerator * (nx + ny) // (t.numerator + t.denominator))
            ok = np.minimum(nx, ny) * t.denominator >= np.maximum(nx, ny) * t.numerator
            ok &= 1 + np.minimum(nx - c["place"][x] - 1, ny - c["place"][y] - 1) + np.minimum(c["place"][x], c["place"][y]) >= need
            ok &= np.bitwise_count((c["bits"][x] ^ c["bits"][y]).view(np.uint64)) <= nx + ny - 2 * need
            ok &= (c["doc_id"][x] != c["doc_id"][y]) | (c["line_no"][x] != c["line_no"][y])
            x, y = x[ok], y[ok]
            if not len(x):
                continue
            nth = np.arange(len(x)) - np.maximum.accumulate(np.where(np.concatenate([[True], x[1:] != x[:-1]]), np.arange(len(x)), 0))
            if most:
                over = np.unique(x[nth >= most])
                x, y = x[nth < most], y[nth < most]
            else:
                over = x[:0]
            yield pa.record_batch({"x_doc": c["doc_id"][x], "x_line": c["line_no"][x], "y_doc": c["doc_id"][y], "y_line": c["line_no"][y], "more": np.isin(x, over)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for b in batches:
            c = {n: b.column(n).to_numpy(zero_copy_only=False) for n in b.schema.names}
            if held is not None:
                c = {k: np.concatenate([held[k], v]) for k, v in c.items()}
            if not len(c["word"]):
                continue
            last = int(np.searchsorted(-(c["word"] != c["word"][-1]).astype(np.int8), 0))  # the last word may go on in the next batch
            held = {k: v[last:] for k, v in c.items()}
            if last:
                yield from pairs({k: v[:last] for k, v in c.items()})
        if held is not None:
            yield from pairs(held)

    return run


def compare(t: Fraction):
    """Keeps the candidates whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                part = b.slice(i, 2000)
                both = pa.chunked_array([part.column("x_text"), part.column("y_text")]).combine_chunks()
                offsets, codes, _ = words(both)
                key = distinct_words(offsets, codes)
                start = np.searchsorted(key, np.arange(len(both) + 1, dtype=np.uint64) << np.uint64(32))
                word, cut, keep = key & np.uint64(0xFFFFFFFF), start.tolist(), []
                n = part.num_rows
                for k in range(n):
                    p, q = word[cut[k] : cut[k + 1]], word[cut[n + k] : cut[n + k + 1]]
                    common = len(np.intersect1d(p, q, assume_unique=True))
                    keep.append(common * t.denominator >= (len(p) + len(q) - common) * t.numerator)
                ok = np.array(keep, bool)
                yield part.select(["x_doc", "x_line"]).filter(pa.array(ok))

    return run


def texts_of(docs: DataFrame, need: DataFrame) -> DataFrame:
    """(d, l, line) of the lines in need(d, l)."""
    wanted = need.distinct().groupBy("d").agg(F.collect_set("l").alias("ls"))
    both = docs.join(wanted.hint("merge"), F.col("doc_id") == F.col("d"))  # these grow with the corpus: never broadcast
    lines = F.split("text", "\n")
    return both.select("d", F.explode(F.transform("ls", lambda i: F.struct(i.alias("l"), F.get(lines, i).alias("line")))).alias("s")).select("d", "s.l", "s.line").where("line is not null")


def settled(lines: DataFrame, sides: DataFrame, t: Fraction) -> DataFrame:
    """(x_doc, x_line): of sides(x_doc, x_line, y_doc, y_line), the lines x that match y."""
    x = lines.select(F.col("d").alias("x_doc"), F.col("l").alias("x_line"), F.col("line").alias("x_text"))
    y = lines.select(F.col("d").alias("y_doc"), F.col("l").alias("y_line"), F.col("line").alias("y_text"))
    both = sides.join(x, ["x_doc", "x_line"]).join(y, ["y_doc", "y_line"])
    return both.select("x_doc", "x_line", "x_text", "y_text").mapInArrow(compare(t), "x_doc long, x_line int").distinct()


def near_lines(docs: DataFrame, postings: DataFrame, t: Fraction) -> DataFrame:
    """(doc_id, line_no) of the sets' first lines that an earlier line of another set matches."""
    pair, x = ["x_doc", "x_line", "y_doc", "y_line"], ["x_doc", "x_line"]

    def paired(wanted: DataFrame, most: int | None) -> DataFrame:
        return stored(wanted.repartition("word").sortWithinPartitions("word", "doc_id", "at").mapInArrow(candidates(t, most), CANDIDATE_ROWS).groupBy(*pair).agg(F.max("more").alias("more")), "line-pairs")

    def compared(found: DataFrame) -> tuple[DataFrame, DataFrame]:
        need = found.select(F.col("x_doc").alias("d"), F.col("x_line").alias("l")).union(found.select("y_doc", "y_line"))
        lines = stored(texts_of(docs, need), "line-texts")
        first = found.groupBy(*x).agg(F.min(F.struct("y_doc", "y_line")).alias("y")).select(*x, "y.y_doc", "y.y_line")
        near = stored(settled(lines, first, t), "line-matches")
        rest = found.select(*pair).join(near, x, "left_anti").join(first, pair, "left_anti")
        return near, stored(settled(lines, rest, t), "line-matches")

    found = paired(postings, CANDIDATES)
    near = compared(found)
    left = stored(found.where("more").select(*x).distinct().join(near[0].union(near[1]), x, "left_anti"), "lines-left")
    if not left.isEmpty():
        marked = postings.join(left.withColumn("wanted", F.lit(True)), (F.col("doc_id") == F.col("x_doc")) & (F.shiftright("at", 32) == F.col("x_line")), "left").select(*POSTING, F.coalesce("wanted", F.lit(False)).alias("wanted"))
        near += compared(paired(marked, None))
    out = near[0]
    for more in near[1:]:
        out = out.union(more)
    return out.select(F.col("x_doc").alias("doc_id"), F.col("x_line").alias("line_no"))


def duplicate_lines(docs: DataFrame, threshold: Fraction = THRESHOLD) -> DataFrame:
    """Lines of docs(doc_id, text) that an earlier line matches: (doc_id, line_no from 0)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    rows = stored(docs.mapInArrow(line_rows(word_order(docs), threshold), LINE_ROWS), "lines")
    sets = stored(rows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.max(F.struct("prefix", "n", "bits")).alias("s"), F.count("*").alias("lines")).select("h1", "h2", "first.doc_id", "first.line_no", "s.*", "lines"), "line-sets")
    at = F.shiftleft(F.col("line_no").cast("long"), 32).bitwiseOR(F.col("place").cast("long"))
    postings = sets.select("doc_id", "line_no", "n", "bits", F.posexplode("prefix").alias("place", "word")).select("word", "doc_id", at.alias("at"), F.col("n").cast("long").alias("n"), "bits")
    near = near_lines(docs, postings, threshold)
    key = ["doc_id", "line_no"]
    # the first line of a set goes if an earlier set matches it; the others follow a copy
    first = near.select(*key).distinct()
    again = sets.where("lines > 1").select("h1", "h2", F.col("doc_id").alias("first_doc"), F.col("line_no").alias("first_line"))
    more = rows.select("h1", "h2", *key).join(again, ["h1", "h2"]).where(F.struct(*key) > F.struct("first_doc", "first_line")).select(*key).distinct()
    return first.union(more)


def without_duplicate_lines(docs: DataFrame, threshold: Fraction = THRESHOLD) -> DataFrame:
    """docs without the lines that an earlier line matches; n_chars, where there is one, follows. A document of which no line is left goes."""
    columns = docs.columns
    key, gone_at = emptied("doc_key", columns), emptied("gone_at", columns)
    gone = duplicate_lines(docs, threshold).groupBy(F.col("doc_id").alias(key)).agg(F.collect_set("line_no").alias(gone_at))
    kept = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(gone_at, i))
    text = F.when(F.col(gone_at).isNull() | F.col("text").isNull(), F.col("text")).when(F.size(kept) > 0, F.array_join(kept, "\n"))
    out = docs.join(gone, F.col("doc_id").cast("long") == F.col(key), "left").withColumn(gone_at, F.struct(text.alias("text"), (F.col(gone_at).isNull() | F.col("text").isNull()).alias("same")))
    out = out.where(F.col(f"{gone_at}.same") | F.col(f"{gone_at}.text").isNotNull())
    chars = F.when(F.col(f"{gone_at}.same"), F.col("n_chars")).otherwise(F.length(f"{gone_at}.text")).cast(docs.schema["n_chars"].dataType).alias("n_chars") if "n_chars" in columns else None
    return out.select(*[F.col(f"{gone_at}.text").alias("text") if c == "text" else chars if c == "n_chars" else F.col(f"`{c}`") for c in columns])


SQL = """
WITH lines AS (
  SELECT doc_id, i - 1 AS line_no, list_distinct(list_filter(regexp_split_to_array(lower(l), '\\s+'), lambda w: w <> '')) AS words
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE doc_id IS NOT NULL)
), sets AS (
  SELECT row_number() OVER () AS s, list_sort(words) AS words, len(words) AS n, min((doc_id, line_no)) AS first FROM lines WHERE len(words) > 0 GROUP BY list_sort(words), len(words)
), tokens AS (SELECT s, n, unnest(words) AS w FROM sets),
ranked AS (SELECT s, n, w, row_number() OVER (PARTITION BY s ORDER BY df, w) AS place FROM tokens JOIN (SELECT w, count(*) AS df FROM tokens GROUP BY w) USING (w)),
prefixes AS (SELECT s, n, w FROM ranked WHERE place <= n - ceil(n * 9 / 10.0) + 1),
pairs AS (SELECT DISTINCT a.s AS a, b.s AS b FROM prefixes a JOIN prefixes b USING (w) WHERE a.s <> b.s AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n),
near AS (
  SELECT DISTINCT a FROM pairs JOIN sets x ON x.s = a JOIN sets y ON y.s = b
  WHERE y.first < x.first AND 10 * len(list_intersect(x.words, y.words)) >= 9 * (x.n + y.n - len(list_intersect(x.words, y.words)))
)
SELECT DISTINCT l.doc_id, CAST(l.line_no AS INTEGER) AS line_no
FROM lines l JOIN sets ON list_sort(l.words) = sets.words
WHERE (l.doc_id, l.line_no) > sets.first OR s IN (SELECT a FROM near)
"""
