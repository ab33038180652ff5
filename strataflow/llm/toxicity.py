"""Toxicity: a bidirectional gated recurrent network with attention pooling, over character and word inputs, in numpy.

Each word (lower case, outer punctuation off; longer ones in pieces of WORD characters) is read by a character GRU in both directions, whose
states an attention pools into a vector. That and a hashed word embedding are the input of a second bidirectional GRU over
windows of WINDOW words, one every STRIDE, so that windows overlap and each word of a text is in one at least. A second attention
pools its states into the window's score. A document's score is its highest window's.

Labels are of documents, so training is multiple-instance learning: of a toxic document only the window that scores highest, of all of its windows, counts as
toxic. Before there are scores, a first epoch takes all windows of the toxic documents of at most FIRST windows (of all toxic ones, if there is none such), as
their label says most of each window. From the fourth on, toxic documents count only if their window stands out (above the share CLEAN of clean windows, or, if
that is under half of them, the better half), as labels may be wrong. Clean windows are drawn anew for each epoch, NEGATIVES for each toxic one, a quarter of them those of CANDIDATES
drawn that score highest. Words of fewer than SEEN of the documents have no embedding, so that rare ones can't stand for their document's label.

Fitting uses at most SAMPLE labelled documents of each class, chosen by hash, and runs as one task on an executor, which is run again if that is lost. From HELD documents
on, a quarter takes no part in fitting and sets the threshold (the best F0.5 of their highest windows, so that clean documents weigh more); with fewer, all of them set it. All texts are scored whole.

Null or wordless texts: no score, not toxic. Rows that repeat are scored alike, and null ids are kept. If labels are
missing, null or of one class, there is no model, no scores, and nothing is toxic. An id of which any label is toxic counts as toxic; of an id with several texts
the one of least hash is fitted. Other columns pass through; where docs has a column of an output's name, the output's gets underscores in front.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataflow.llm._shared import array_of, emptied, hashes, slices, words

SAMPLE, HELD, FIRST, NEGATIVES, CANDIDATES, CLEAN = 1200, 200, 8, 2, 20_000, 0.98
WINDOW, STRIDE, WORD = 48, 32, 24
H, CHARS, CHAR_DIM, BUCKETS, WORD_DIM, SEEN = 8, 256, 8, 1 << 16, 8, 4
EPOCHS, BATCH, RATE = 10, 128, 0.01
OUTER = ".,;:!?\"'()[]{}|#*$%&<>/\\-_=+~^`@"


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def summed(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """(size, D): the sums of the rows at each place."""
    order = np.argsort(at, kind="stable")
    place = at[order]
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    out = np.zeros((size, rows.shape[1]), np.float32)
    out[place[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


class Gru:
    """One direction over (T, B, 3H) projected inputs: update, reset and candidate gates."""

    @staticmethod
    def forward(x, u, mask, keep=False):
        h = np.zeros(x.shape[1:2] + (u.shape[0],), np.float32)
        n, states, cache = u.shape[0], [], []
        if not keep:
            states, whole = np.empty(x.shape[:2] + (n,), np.float32), mask.reshape(len(x), -1).all(axis=1)
            for t in range(len(x)):
                hu = h @ u
                zr = x[t, :, : 2 * n] + hu[:, : 2 * n]
                zr *= 0.5
                np.tanh(zr, out=zr)
                zr *= 0.5
                zr += 0.5
                c = zr[:, n:] * hu[:, 2 * n :]
                c += x[t, :, 2 * n :]
                np.tanh(c, out=c)
                c -= h
                c *= zr[:, :n]
                if not whole[t]:
                    c *= mask[t]
                h = np.add(h, c, out=states[t])
            return states, cache
        for t in range(len(x)):
            hu = h @ u
            zr = sigmoid(x[t, :, : 2 * n] + hu[:, : 2 * n])
            z, r = zr[:, :n] * mask[t], zr[:, n:]
            c = np.tanh(x[t, :, 2 * n :] + r * hu[:, 2 * n :])
            if keep:
                cache.append((h, hu, zr, c))
            h = h + z * (c - h)
            states.append(h)
        return np.stack(states), cache

    @staticmethod
    def backward(d, x, u, mask, cache):
        n, du, dx, dh = u.shape[0], np.zeros_like(u), np.empty_like(x), np.zeros_like(d[0])
        for t in range(len(x) - 1, -1, -1):
            h, hu, zr, c = cache[t]
            z, r = zr[:, :n] * mask[t], zr[:, n:]
            dh = dh + d[t]
            dc = dh * z * (1 - c * c)
            dz = dh * (c - h) * mask[t] * zr[:, :n] * (1 - zr[:, :n])
            dr = dc * hu[:, 2 * n :] * r * (1 - r)
            dx[t] = np.concatenate([dz, dr, dc], axis=1)
            dhu = np.concatenate([dz, dr, dc * r], axis=1)
            du += h.T @ dhu
            dh = dh * (1 - z) + dhu @ u.T
        return dx, du


class Pooled:
    """Both directions and attention pooling: (V, D) inputs, (B, T) indices into them and lengths -> (B, 2H)."""

    def __init__(self, p: dict[str, np.ndarray], name: str):
        self.p, self.name = p, name

    def __call__(self, feats, index, length, keep=False):
        p, s = self.p, self.name
        steps = index.shape[1]
        mask = (np.arange(steps)[:, None] < length[None]).astype(np.float32)[:, :, None]
        self.mask, self.index, self.feats = mask, index, feats
        self.xf = (feats @ p[s + "wf"] + p[s + "bf"])[index.T]
        self.xb = (feats @ p[s + "wb"] + p[s + "bb"])[index.T[::-1]]
        f, self.cf = Gru.forward(self.xf, p[s + "uf"], mask, keep)
        b, self.cb = Gru.forward(self.xb, p[s + "ub"], mask[::-1], keep)
        h = np.concatenate([f, b[::-1]], axis=2)
        e = np.where(mask[:, :, 0] > 0, h @ p[s + "v"], -1e9)
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        out = np.einsum("tb,tbh->bh", a, h)
        if keep:
            self.h, self.a, self.out = h, a, out
        return out

    def backward(self, d, g):
        """Adds to g; returns the gradient of the inputs."""
        p, s, h, a = self.p, self.name, self.h, self.a
        da = np.einsum("bh,tbh->tb", d, h) - np.sum(d * self.out, axis=1)
        de = a * da
        g[s + "v"] += np.einsum("tb,tbh->h", de, h)
        dh = a[:, :, None] * d[None] + de[:, :, None] * p[s + "v"]
        n = p[s + "uf"].shape[0]
        dxf, duf = Gru.backward(dh[:, :, :n], self.xf, p[s + "uf"], self.mask, self.cf)
        dxb, dub = Gru.backward(dh[::-1, :, n:], self.xb, p[s + "ub"], self.mask[::-1], self.cb)
        g[s + "uf"] += duf
        g[s + "ub"] += dub
        out = np.zeros_like(self.feats)
        for k, dx, index in (("f", dxf, self.index.T), ("b", dxb, self.index.T[::-1])):
            per = summed(index.ravel(), dx.reshape(-1, dx.shape[2]), len(self.feats))
            g[s + "w" + k] += self.feats.T @ per
            g[s + "b" + k] += per.sum(axis=0)
            out += per @ p[s + "w" + k].T
        return out


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        w = lambda *shape, scale=None: (rng.standard_normal(shape) * (scale or shape[0] ** -0.5)).astype(np.float32)
        self.p = {"chars": w(CHARS, CHAR_DIM, scale=0.5), "words": w(BUCKETS, WORD_DIM, scale=0.1), "o": w(2 * H), "ob": np.zeros(1, np.float32)}
        for s, d in (("c", CHAR_DIM), ("w", 2 * H + WORD_DIM)):
            for k in "fb":
                self.p |= {s + "w" + k: w(d, 3 * H), s + "u" + k: w(H, 3 * H), s + "b" + k: np.zeros(3 * H, np.float32)}
            self.p[s + "v"] = w(2 * H, scale=0.3)
        self.known = np.ones((BUCKETS, 1), np.float32)
        self.threshold = 0.5

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("char", "word", "context")}

    def features(self, chars, length, bucket, drop=None, keep=False):
        """(V, 2H + WORD_DIM): characters and word of each distinct word."""
        self.char = Pooled(self.p, "c")
        pooled = self.char(self.p["chars"], chars, length, keep)
        emb = self.p["words"][bucket] * self.known[bucket]
        return np.concatenate([pooled, emb if drop is None else emb * drop], axis=1)

    def vocabulary(self, vocab, step=2048):
        """features() of all distinct words, those of like length together, so that short words take few steps."""
        chars, length, bucket = vocab
        order, out = np.argsort(length, kind="stable"), np.empty((len(length), 2 * H + WORD_DIM), np.float32)
        for i in range(0, len(order), step):
            o = order[i : i + step]
            out[o] = self.features(chars[o, : length[o].max()], length[o], bucket[o])
        return out

    def logits(self, feats, index, length, keep=False):
        self.word = Pooled(self.p, "w")
        self.context = self.word(feats, index, length, keep)
        return self.context @ self.p["o"] + self.p["ob"]

    def score(self, feats, codes, start, length, step=1024) -> np.ndarray:
        """Logits of all windows."""
        cut = range(0, len(start), step)
        return np.concatenate([self.logits(feats, gather(codes, start[i : i + step], length[i : i + step]), length[i : i + step]) for i in cut] or [np.zeros(0, np.float32)])

    def gradient(self, vocab, index, length, y, rng):
        """Loss gradient of a batch of windows over distinct words vocab = (chars, length, bucket)."""
        used, local = np.unique(index, return_inverse=True)
        chars, n, bucket = (v[used] for v in vocab)
        drop = (rng.random((len(used), 1)) < 0.5).astype(np.float32)
        feats = self.features(chars[:, : max(1, n.max())], n, bucket, drop, keep=True)
        z = self.logits(feats, local.reshape(index.shape), length, keep=True)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        dz = ((sigmoid(z) - y) / len(y)).astype(np.float32)
        g["o"] += self.context.T @ dz
        g["ob"] += dz.sum()
        d = self.word.backward(dz[:, None] * self.p["o"][None], g)
        g["words"] += summed(bucket, d[:, 2 * H :] * drop * self.known[bucket], BUCKETS)
        g["chars"] += self.char.backward(d[:, : 2 * H], g)
        return g


def pieces(texts: pa.Array):
    """((chars, length, bucket) of distinct words, their codes in text order, offsets of each text): long words are cut, none is left out."""
    offsets, codes, vocab = words(texts)
    bare = array_of(pc.utf8_trim(vocab, OUTER)).dictionary_encode()
    names, size = bare.dictionary, np.asarray(pc.utf8_length(bare.dictionary)).astype(np.int64)
    count, start = np.maximum(1, -(-size // WORD)), np.arange(len(size))
    extra: list[str] = []
    for k in np.flatnonzero(count > 1).tolist():
        w = names[k].as_py()
        start[k] = len(size) + len(extra)
        extra += [w[i : i + WORD] for i in range(0, len(w), WORD)]
    names = array_of(pa.chunked_array([pc.utf8_slice_codeunits(names, 0, WORD).cast(pa.large_string()), pa.array(extra, pa.large_string())]))
    code = np.asarray(bare.indices).astype(np.int64)[codes]
    per = count[code]
    flat = np.repeat(start[code], per) + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    length = np.asarray(pc.utf8_length(names)).astype(np.int64)
    points = np.frombuffer("".join(pc.utf8_rpad(names, WORD, "\0").to_pylist()).encode("utf-32-le", "replace"), np.uint32).reshape(-1, WORD)
    chars = np.where(points < CHARS, points, 1 + points % (CHARS - 1)).astype(np.uint8)
    bucket = (hashes(names) % np.uint64(BUCKETS)).astype(np.int64)
    return (chars, np.maximum(length, 1), bucket), flat, np.concatenate([[0], np.cumsum(per)])[offsets]


def windows(offsets: np.ndarray):
    """(text, start, length) of all windows: one every STRIDE words until the text is covered."""
    n = np.diff(offsets)
    count = np.where(n == 0, 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)))
    text = np.repeat(np.arange(len(n)), count)
    start = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    return text, offsets[text] + start, np.minimum(WINDOW, n[text] - start)


def gather(codes: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    at = np.arange(WINDOW)[None]
    return codes[np.where(at < length[:, None], start[:, None] + at, start[:, None])]


def train(texts: list[str], y: np.ndarray, seed: int = 7) -> Network | None:
    """A network and its threshold from labelled texts; None without both classes."""
    vocab, codes, offsets = pieces(pa.array(texts, pa.large_string()))
    full = np.diff(offsets) > 0
    if not (y[full] == 1).any() or not (y[full] == 0).any():
        return None
    rng, net = np.random.default_rng(seed), Network(seed)
    text, start, length = windows(offsets)
    index = gather(codes, start, length)
    both = np.unique(np.repeat(np.arange(len(texts)), np.diff(offsets)) * BUCKETS + vocab[2][codes])
    net.known = (np.bincount(both % BUCKETS, minlength=BUCKETS) >= SEEN).astype(np.float32)[:, None]
    used, index = np.unique(index, return_inverse=True)
    vocab, index = tuple(x[used] for x in vocab), index.reshape(-1, WINDOW)
    held = np.zeros(len(texts), bool)
    if len(texts) >= HELD:
        held[rng.permutation(len(texts))[: len(texts) // 4]] = True
    toxic, clean = np.flatnonzero((y[text] == 1) & ~held[text]), np.flatnonzero((y[text] == 0) & ~held[text])
    m, v, step = {k: np.zeros_like(x) for k, x in net.p.items()}, {k: np.zeros_like(x) for k, x in net.p.items()}, 0

    def scores(rows):
        used, local = np.unique(index[rows], return_inverse=True)
        return net.score(net.vocabulary(tuple(x[used] for x in vocab)), local.ravel(), np.arange(len(rows)) * WINDOW, length[rows])

    count = np.bincount(text, minlength=len(texts))
    few = toxic[count[text[toxic]] <= FIRST]
    epochs = max(EPOCHS, min(40, 60 * BATCH // max(1, 2 * len(np.unique(text[toxic])))))
    for epoch in range(epochs):
        if epoch:  # of each toxic text the window that scores highest
            best = np.lexsort((-scores(toxic), text[toxic]))
            positive = toxic[best[np.unique(text[toxic][best], return_index=True)[1]]]
        else:
            positive = few if len(few) else toxic
        drawn = rng.permutation(clean)
        negative = drawn[: max(NEGATIVES * len(positive), 8 * BATCH)]
        if epoch >= 2:
            drawn = drawn[:CANDIDATES]
            s = scores(drawn)
            if epoch >= 3:  # toxic texts of which no window stands out from clean ones may be labelled wrongly
                own = scores(positive)
                stands_out = own > np.quantile(s, CLEAN)
                positive = positive[stands_out if stands_out.sum() >= len(own) // 2 else own >= np.median(own)]
            hard = drawn[np.argsort(-s)[: len(negative) // 4]]
            negative = np.concatenate([negative[: len(negative) - len(hard)], hard])
        rows = rng.permutation(np.concatenate([positive, negative]))
        for i in range(0, len(rows), BATCH):
            b = rows[i : i + BATCH]
            g = net.gradient(vocab, index[b], length[b], y[text[b]].astype(np.float32), rng)
            step += 1
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            for k, x in g.items():
                x = x * min(1.0, 1.0 / max(norm, 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x * x
                net.p[k] -= RATE * (0.5 if epoch > epochs * 2 // 3 else 1) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
    s = scores(np.arange(len(text)))
    top = np.full(len(texts), -np.inf, np.float32)
    np.maximum.at(top, text, s)
    use = full & (held if held.any() and len(np.unique(y[held & full])) == 2 else True)
    order = np.argsort(-top[use], kind="stable")
    ranked, hit = top[use][order], y[use][order] == 1
    f = 1.25 * np.cumsum(hit) / (np.arange(1, len(hit) + 1) + 0.25 * hit.sum())
    ends = np.append(ranked[1:] < ranked[:-1], True)
    k = int(np.argmax(np.where(ends, f, -1)))
    below = ranked[k + 1] if k + 1 < len(ranked) else ranked[k] - 2
    net.threshold = float((ranked[k] + below) / 2)
    net.held_f = float(f[k])
    return net


def fit(docs: DataFrame, labels: DataFrame) -> Network | None:
    """Trained on a bounded sample of labels(doc_id, toxic) and their documents."""
    labels = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("y")).where("label_id is not null and y in (0, 1)").groupBy("label_id").agg(F.max("y").alias("y"))
    sample = [r for k in (0, 1) for r in labels.where(F.col("y") == k).orderBy(F.xxhash64("label_id"), "label_id").limit(SAMPLE).collect()]
    if len({r["y"] for r in sample}) < 2:
        return None
    few = docs.sparkSession.createDataFrame(sample, "label_id long, y int")  # 2 * SAMPLE rows at most, however large the tables
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(few), F.col("doc_id") == F.col("label_id"))
    one = rows.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", "y", "t.text")
    made = one.coalesce(1).mapInArrow(training, "network binary").collect()
    return pickle.loads(made[0]["network"]) if made else None


def training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sampled documents to a trained network, if they have both classes."""
    rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["doc_id"])
    net = train([r["text"] for r in rows], np.array([r["y"] for r in rows])) if rows else None
    if net is not None:
        yield pa.record_batch({"network": pa.array([pickle.dumps(net)], pa.binary())})


def scorer(net: Network | None, score: str, toxic: str):
    """Appends the document's score and verdict to each batch, without changing its columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 2 << 20):
            top = np.full(b.num_rows, -np.inf, np.float32)
            if net is not None:
                vocab, codes, offsets = pieces(array_of(b.column("text")))
                if len(codes):
                    text, start, length = windows(offsets)
                    s = net.score(net.vocabulary(vocab), codes, start, length)
                    np.maximum.at(top, text, s)
            prob = pa.array(np.round(sigmoid(top.astype(float) - (net.threshold if net else 0)), 6), mask=np.isneginf(top))
            yield pa.RecordBatch.from_arrays([*b.columns, prob, pa.array((top > (net.threshold if net else np.inf)))], names=[*b.schema.names, score, toxic])

    return run


def scored(docs: DataFrame, labels: DataFrame, score: str = "score", toxic: str = "toxic") -> DataFrame:
    """docs with the columns score (0.5 is the threshold) and toxic, under names that docs doesn't have."""
    score, toxic = emptied(score, docs.columns), emptied(toxic, docs.columns)
    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType()), T.StructField(toxic, T.BooleanType())])
    return docs.mapInArrow(scorer(fit(docs, labels), score, toxic), schema)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those judged toxic."""
    score = emptied("score", docs.columns)
    toxic = emptied("toxic", docs.columns)
    return scored(docs, labels, score, toxic).where(~F.col(toxic)).select(*[F.col(f"`{c}`") for c in docs.columns])
