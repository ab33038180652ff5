"""HTML extraction: a linear-chain conditional random field over a page's leaf blocks, decoded by Viterbi.

A leaf block is the text between two block-level tags. Its features are its ancestors' tags, classes and ids, its parent, its share of link text, its length,
punctuation and marks, and its place. Labels are boilerplate (0) and content (1). The CRF is trained here, on LABELLED: pages that were
written for it, in layouts of several kinds, whose blocks are labelled by the attribute data-y. The labels are taken off before features are made.

Nulls: a null page has a null text and no blocks; an empty one an empty text. Broken markup is read as far as it goes: unclosed tags end with their
parent, unknown ones are inline. Repeated rows are read alike, null ids are kept; other columns don't matter.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm._shared import slices

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*)>", re.S | re.I)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
LABEL = re.compile(r"\bdata-y\s*=\s*\"?([01])")
BLOCK = frozenset("html head title body nav ul ol li div article section main aside header footer h1 h2 h3 h4 h5 h6 p pre blockquote table thead tbody tr td th dl dt dd form fieldset figure figcaption address hr option select button menu details summary".split())
VOID = frozenset("meta link br hr img input area base col embed source track wbr".split())
CLOSES = {"li": {"li"}, "p": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
SCOPE = frozenset("ul ol table dl div article section main aside nav body".split())
WORD = re.compile(r"[a-z]+")
STEPS, RATE, DECAY = 250, 0.1, 1e-3
SPACE = re.compile(r"\s+")


class Leaf:
    __slots__ = ("text", "link", "path", "names", "label")

    def __init__(self, text, link, path, names, label):
        self.text, self.link, self.path, self.names, self.label = text, link, path, names, label


def leaves(page: str) -> list[Leaf]:
    """A page's blocks with text, in order."""
    out: list[Leaf] = []
    stack: list[tuple[str, tuple[str, ...], int | None]] = []
    parts: list[str] = []
    link, in_link, last = 0, 0, 0

    def text(piece: str) -> None:
        nonlocal link
        if piece:
            parts.append(piece)
            if in_link:
                link += len(piece.strip())

    def flush() -> None:
        nonlocal link
        if parts:
            whole = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if whole:
                label = next((y for _, _, y in reversed(stack) if y is not None), None)
                out.append(Leaf(whole, min(1.0, link / len(whole)), tuple(t for t, _, _ in stack), frozenset(n for _, ns, _ in stack for n in ns), label))
            parts.clear()
        link = 0

    for m in TAG.finditer(page):
        text(page[last : m.start()])
        last = m.end()
        tag = (m.group(3) or "").lower()
        if not tag:
            continue
        if m.group(2):
            if tag == "a":
                in_link = max(0, in_link - 1)
            elif tag in BLOCK:
                flush()
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                    if tag not in SCOPE and stack[k][0] in SCOPE:
                        break
        elif tag == "a":
            in_link += 1
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCK:
            flush()
            in_link = 0
            ends = CLOSES.get(tag, set()) | ({"p"} if tag not in ("html", "head", "body") else set())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends:
                    del stack[k:]
                    break
                if stack[k][0] in SCOPE:
                    break
            if tag not in VOID:
                attributes = m.group(4)
                names = tuple(w for a, b, c in NAMES.findall(attributes) for w in WORD.findall((a or b or c).lower())) if attributes else ()
                y = LABEL.search(attributes) if attributes else None
                stack.append((tag, names, int(y.group(1)) if y else None))
    text(page[last:])
    flush()
    return out


def features(blocks: list[Leaf]) -> list[list[str]]:
    out = []
    for k, b in enumerate(blocks):
        n, t = b.text.count(" ") + 1, b.text
        f = ["1", f"parent={b.path[-1] if b.path else ''}", f"words={min(n.bit_length(), 8)}", f"link={round(b.link * 4)}", f"end={t[-1] if t[-1] in '.!?:,' else ''}", f"stops={min(3, t.count('. ') + t.count(', '))}"]
        f += [f"in={x}" for x in set(b.path)] + [f"name={x}" for x in b.names]
        f += [x for x, there in (("first", k == 0), ("last", k == len(blocks) - 1), ("mark", "©" in t or "|" in t or "·" in t or "»" in t), ("upper", t.isupper()), ("digits", any(c.isdigit() for c in t))) if there]
        out.append(f)
    return out


def labelled(seed: int = 3, pages: int = 90) -> list[str]:
    """Training pages in eight layouts, with data-y labels; their words are invented."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("ka", "lo", "mi", "ter", "sa", "nu", "pol", "ri", "dan", "ve", "os")) for _ in range(rng.randint(1, 4)))
    say = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))

    def prose(a=1, b=4, most=30):
        s = " ".join(f"{say(2, most).capitalize()}{rng.choice(['.', '.', '!', '?'])}" for _ in range(rng.randint(a, b)))
        return s if rng.random() < 0.9 else s.replace(" ", " &amp; ", 1)

    links = lambda n: "".join(f'<li><a href="/{word()}">{say(1, 2)}</a></li>' for _ in range(n))
    body = lambda: "".join(rng.choice((f"<p>{prose()}</p>", f"<p>{prose()}<br>", f"<p><b>{prose(1, 1, 8)}<br><p>{prose()}</p>", f"<p>{prose(1, 1, 3)}</p>", f"<blockquote>{prose()}</blockquote>", f"<h2>{say(2, 6)}</h2><p>{prose()}</p>", f"<ul><li>{prose(1, 2)}</li><li>{say(3, 12)}</li></ul>", f"<p>{prose(1, 1)} <a href='#'>{say(1, 3)}</a> {prose(1, 1)}</p>", f"<p>{' | '.join(word() for _ in range(rng.randint(5, 30)))} |</p>", f"<pre>{say(4, 20)}</pre>")) for _ in range(rng.randint(1, 9)))
    title = lambda: say(2, 10)
    out = []
    for k in range(pages):
        head = f"<!DOCTYPE html><html><head><title data-y=0>{title()}</title><style>p{{}}</style><script>var x='<p>';</script></head><body>"
        nav = rng.choice((f"<nav data-y=0><ul>{links(rng.randint(3, 8))}</ul></nav>", f'<div class="menu" data-y=0>{"".join(f"<a href=/>{say(1, 2)}</a> | " for _ in range(5))}</div>', f"<header data-y=0><h2>{say(1, 3)}</h2><ul>{links(4)}</ul></header>"))
        ad = rng.choice(("", f'<div class="ad" data-y=0>{prose(1, 3)}</div>', f'<aside class="sponsored" data-y=0><p>{prose(1, 3)}</p></aside>', f'<div class="cookie banner" data-y=0>{prose(1, 2)}<button>{say(1, 2)}</button></div>'))
        foot = rng.choice((f"<footer data-y=0>&copy; {word()}.example.com &middot; {prose(1, 1)}</footer>", f'<div id="footer" data-y=0><p>&copy; {say(2, 4)}</p><p>{say(2, 6)}</p></div>', f"<footer data-y=0><ul>{links(4)}</ul>{say(2, 8)}</footer>"))
        side = rng.choice(("", f'<aside class="related sidebar" data-y=0><h3>{say(1, 3)}</h3><ul>{links(5)}</ul></aside>', f'<div class="share social" data-y=0>{say(1, 4)}</div>', f'<div class="comments" data-y=0><p>{prose(1, 2)}</p><form><label>{say(1, 2)}</label></form></div>'))
        main = f"<h1>{title()}</h1>{body()}"
        kind = k % 8
        core = {0: f"<article data-y=1>{main}</article>", 1: f"<main data-y=1><article>{main}</article></main>", 2: f'<div class="content" data-y=1>{main}</div>', 3: f'<div id="post" class="entry" data-y=1><div class="text">{main}</div></div>', 4: f"<section data-y=1>{main}</section>", 5: f"<table><tr><td data-y=0><ul>{links(4)}</ul></td><td data-y=1>{main}</td></tr></table>", 6: f"<article data-y=1><header><h1>{title()}</h1></header>{body()}</article>", 7: f"<div data-y=1>{main}</div>"}[kind]
        page = f"{head}{nav}<!-- {word()} -->{ad}{core}{side}{foot}</body></html>"
        out.append(page if rng.random() < 0.85 else page.removesuffix("</body></html>"))
    return out


class Crf:
    """Weights of features by label, and of label pairs."""

    def __init__(self, number: dict[str, int], weights: np.ndarray, pairs: np.ndarray):
        self.number, self.weights, self.pairs = number, weights, pairs
        self.table = {f: weights[k].tolist() for f, k in number.items()}

    @staticmethod
    def train(pages: list[str], steps: int = STEPS) -> Crf:
        rows = [leaves(p) for p in pages]
        rows = [r for r in rows if r and all(b.label is not None for b in r)]
        feats, y = [features(r) for r in rows], [[b.label for b in r] for r in rows]
        number: dict[str, int] = {}
        for f in feats:
            for x in f:
                for n in x:
                    number.setdefault(n, len(number))
        most, n = max(map(len, y)), len(y)
        x = np.zeros((n, most, len(number)), np.float32)
        for i, f in enumerate(feats):
            for t, names in enumerate(f):
                x[i, t, [number[k] for k in names]] = 1
        size = np.array([len(r) for r in y])
        mask = np.arange(most)[None] < size[:, None]
        gold = np.zeros((n, most, 2))
        for i, r in enumerate(y):
            gold[i, np.arange(len(r)), r] = 1
        gold_pairs = np.einsum("ita,itb->ab", gold[:, :-1], gold[:, 1:])
        gold_w = np.einsum("itf,itl->fl", x, gold)
        w, pairs = np.zeros((len(number), 2)), np.zeros((2, 2))
        cache = [np.zeros_like(w), np.zeros_like(pairs)]
        for _ in range(steps):
            u = x @ w
            alpha, beta = np.zeros((n, most, 2)), np.zeros((n, most, 2))
            alpha[:, 0] = u[:, 0]
            for t in range(1, most):
                alpha[:, t] = u[:, t] + np.logaddexp.reduce(alpha[:, t - 1, :, None] + pairs, axis=1)
            for t in range(most - 2, -1, -1):
                step = np.logaddexp.reduce(pairs + (u[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
                beta[:, t] = np.where(mask[:, t + 1, None], step, 0)
            z = np.logaddexp.reduce(alpha[np.arange(n), size - 1], axis=1)
            p = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
            both = np.exp(alpha[:, :-1, :, None] + pairs + (u[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
            for value, grad, c in ((w, gold_w - np.einsum("itf,itl->fl", x, p) - DECAY * n * w, cache[0]), (pairs, gold_pairs - both.sum(axis=(0, 1)) - DECAY * n * pairs, cache[1])):
                c += grad * grad
                value += RATE * grad / (np.sqrt(c) + 1e-6)
        return Crf(number, w, pairs)

    def decode(self, blocks: list[Leaf]) -> list[int]:
        """Viterbi: the likeliest labels."""
        (aa, ab), (ba, bb) = self.pairs.tolist()
        back, score = [], None
        for f in features(blocks):
            u0 = u1 = 0.0
            for name in f:
                if (w := self.table.get(name)) is not None:
                    u0 += w[0]
                    u1 += w[1]
            if score is None:
                score = (u0, u1)
                continue
            from0 = int(score[1] + ba > score[0] + aa)
            from1 = int(score[1] + bb > score[0] + ab)
            back.append((from0, from1))
            score = (u0 + (score[1] + ba if from0 else score[0] + aa), u1 + (score[1] + bb if from1 else score[0] + ab))
        if score is None:
            return []
        out = [int(score[1] > score[0])]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]


def extracting(crf: Crf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            texts, counts, kept = [], [], []
            for page in b.column("html").to_pylist():
                if page is None:
                    texts.append(None), counts.append(0), kept.append(0)
                    continue
                blocks = leaves(page)
                content = [x.text for x, y in zip(blocks, crf.decode(blocks)) if y]
                texts.append("\n".join(content)), counts.append(len(blocks)), kept.append(len(content))
            yield pa.record_batch({"page_id": b.column("page_id"), "text": pa.array(texts, pa.string()), "n_blocks": pa.array(counts, pa.int32()), "n_content": pa.array(kept, pa.int32())})

    return run


def extract(pages: DataFrame, crf: Crf | None = None) -> DataFrame:
    """pages(page_id, html) -> (page_id, text, n_blocks, n_content): the text of the content blocks, a line each."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    return pages.mapInArrow(extracting(crf or Crf.train(labelled())), "page_id long, text string, n_blocks int, n_content int")
