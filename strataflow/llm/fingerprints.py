"""Document fingerprints: a homomorphic hash of the multiset of a document's paragraphs (LtHash).

A paragraph (a line that isn't empty) hashes to a vector of 256 lanes of 16 bits: SHA-256 of its bytes, in hexadecimal, expanded by SHA-256 of that
text, a colon and 0 to 15. A document's fingerprint is the sum of its paragraphs' vectors modulo 2 ** 16, lane by lane. So the order of paragraphs doesn't matter, their
number does, and paragraphs are added to or taken from a fingerprint without reading the others.

Nulls: a null text has a null fingerprint and matches none; an empty one has the empty multiset's, all zeros. Rows that share a doc_id are
fingerprinted each. Null ids are kept, but are never what another document is the same as. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm._shared import slices, stored
from strataflow.llm.line_dedup import split_lines

LANES, EXPAND = 256, [f":{i}".encode() for i in range(16)]


def vector(paragraph: str) -> bytes:
    """The lanes of a paragraph, each big-endian."""
    seed = sha256(paragraph.encode()).hexdigest().encode()
    return b"".join([sha256(seed + x).digest() for x in EXPAND])


def vectors(paragraphs: list[str]) -> np.ndarray:
    return np.frombuffer(b"".join(map(vector, paragraphs)), ">u2").astype(np.uint16).reshape(-1, LANES)


def fingerprint(paragraphs: list[str]) -> str:
    return to_text(vectors([p for p in paragraphs if p]).sum(axis=0, dtype=np.uint16))


def to_text(lanes: np.ndarray) -> str:
    return lanes.astype(">u2").tobytes().hex()


def of_text(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u2").astype(np.uint16)


def changed(text: str, added: list[str] = (), removed: list[str] = ()) -> str:
    """The fingerprint after paragraphs were added and removed."""
    lanes = of_text(text)
    for p in added:
        lanes = lanes + vectors([p])[0] if p else lanes
    for p in removed:
        lanes = lanes - vectors([p])[0] if p else lanes
    return to_text(lanes)


def hashing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        lines, row, _ = split_lines(pc.fill_null(b.column("text"), ""))
        full = np.asarray(pc.binary_length(lines)) > 0
        coded, row = lines.filter(pa.array(full)).dictionary_encode(), row[full]
        total = np.zeros((b.num_rows, LANES), np.uint16)
        codes = np.asarray(coded.indices)
        own, text = vectors(coded.dictionary.to_pylist()), np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else row
        for i in range(0, len(text), 2048):  # some documents' paragraphs at a time
            start = text[i : i + 2048]
            end = text[i + 2048] if i + 2048 < len(text) else len(row)
            total[row[start]] = np.add.reduceat(own[codes[start[0] : end]], start - start[0], axis=0, dtype=np.uint16)
        null = np.asarray(b.column("text").is_null())
        yield pa.record_batch(
            {
                "doc_id": b.column("doc_id"),
                "n_paragraphs": pa.array(np.bincount(row, minlength=b.num_rows), mask=null),
                "fingerprint": pa.array([None if n else to_text(t) for n, t in zip(null, total)], pa.string()),
            }
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_paragraphs, fingerprint)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(hashing, "doc_id long, n_paragraphs long, fingerprint string")


def with_equals(docs: DataFrame) -> DataFrame:
    """fingerprints() and same_as: the least doc_id whose paragraphs are the same multiset (its own, if there is no lesser one)."""
    own = stored(fingerprints(docs), "fingerprints")
    digest = F.sha2("fingerprint", 256)
    groups = own.where("doc_id is not null and fingerprint is not null").groupBy(digest.alias("digest"), "n_paragraphs").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    shared = groups.select("digest", F.col("n_paragraphs").alias("n"), "least")
    keyed = own.select("doc_id", "n_paragraphs", digest.alias("d"))
    later = keyed.join(shared, (F.col("d") == F.col("digest")) & (F.col("n_paragraphs") == F.col("n"))).select("doc_id", "d", "least").where("doc_id <> least").distinct().select(F.col("doc_id").alias("later"), F.col("d").alias("of"), "least")
    return own.join(later, (F.col("doc_id") == F.col("later")) & (digest == F.col("of")), "left").select("doc_id", "n_paragraphs", "fingerprint", F.when(F.col("fingerprint").isNotNull(), F.coalesce("least", "doc_id")).alias("same_as"))


def updated(own: DataFrame, changes: DataFrame) -> DataFrame:
    """own(doc_id, n_paragraphs, fingerprint) after changes(doc_id, paragraph, sign): sign 1 adds the paragraph, -1 takes it away."""
    valid = changes.where("doc_id is not null and coalesce(paragraph, '') <> '' and sign in (1, -1)")
    sides = valid.groupBy(F.col("doc_id").alias("changed")).agg(*[F.collect_list(F.when(F.col("sign") == s, F.col("paragraph"))).alias(k) for s, k in ((1, "added"), (-1, "removed"))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(r["doc_id"], r["n_paragraphs"], r["fingerprint"], r["added"] or [], r["removed"] or []) for r in b.to_pylist()]
            yield pa.record_batch(
                {
                    "doc_id": b.column("doc_id"),
                    "n_paragraphs": pa.array([None if n is None else n + len(a) - len(r) for _, n, _, a, r in rows], pa.int64()),
                    "fingerprint": pa.array([None if f is None else changed(f, a, r) for _, _, f, a, r in rows], pa.string()),
                }
            )

    both = own.join(sides, F.col("doc_id") == F.col("changed"), "left").select("doc_id", "n_paragraphs", "fingerprint", "added", "removed")
    return both.mapInArrow(apply, "doc_id long, n_paragraphs long, fingerprint string")


SQL = """
WITH p AS (
  SELECT r, doc_id, sha256(l) AS seed FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents) d, unnest(string_split(d.text, chr(10))) AS u(l) WHERE l <> ''
), e AS (
  SELECT r, i, sha256(seed || ':' || CAST(i AS VARCHAR)) AS h FROM p, range(16) AS x(i)
), lanes AS (
  SELECT r, i * 16 + k AS lane, sum(CAST('0x' || substr(h, CAST(k * 4 + 1 AS BIGINT), 4) AS INTEGER)) % 65536 AS v FROM e, range(16) AS y(k) GROUP BY ALL
), f AS (SELECT r, string_agg(printf('%04x', CAST(v AS INTEGER)), '' ORDER BY lane) AS fp FROM lanes GROUP BY r),
n AS (SELECT r, count(*) AS n FROM p GROUP BY r),
d AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(n, 0) END AS n_paragraphs, CASE WHEN text IS NULL THEN NULL ELSE coalesce(fp, repeat('0', 1024)) END AS fingerprint
  FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents) LEFT JOIN f USING (r) LEFT JOIN n USING (r)
)
SELECT doc_id, n_paragraphs, fingerprint, CASE WHEN fingerprint IS NULL THEN NULL ELSE coalesce(min(doc_id) OVER (PARTITION BY n_paragraphs, fingerprint), doc_id) END AS same_as FROM d
"""
