"""Signals of damaged text.

damage() counts characters and words by class in one Arrow pass over a text's code points; the signals are Catalyst expressions over that. Words are corrupt or
spliced as by the regular expressions CORRUPT and SPLICED, which the pass follows by the same classes.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataflow.functions.languages import BLOCKS, REGISTRY
from strataflow.functions.text import let

#: Parts of names of fonts that map glyphs of a script to Latin code points, and the script's OCR pack, in order of precedence.
FONTS = [(part, pack) for pack, parts in (
    ("tel", "shree-tel,shreetel,anu,hemalatha"), ("hin", "shree-dev,shree-deo,kruti dev,krutidev"), ("tam", "shree-tam"), ("kan", "shree-kan"), ("mal", "shree-mal"),
    ("guj", "shree-guj"), ("ben", "shree-ben"), ("pan", "shree-pun"), ("ori", "shree-ori"), ("asm", "ramdhenu"),
) for part in parts.split(",")]
#: Code points of scripts, in hexadecimal.
SCRIPTS = {
    "latin": "41-24F 250-2AF 1E00-1EFF", "greek": "370-3FF 1F00-1FFF", "cyrl": "400-52F", "armn": "530-58F", "hebr": "590-5FF", "arab": "600-77F", "deva": "900-97F 1CD0-1CFF",
    "beng": "980-9FF", "guru": "A00-A7F", "gujr": "A80-AFF", "orya": "B00-B7F", "taml": "B80-BFF", "telu": "C00-C7F", "knda": "C80-CFF", "mlym": "D00-D7F", "sinh": "D80-DFF",
    "thai": "E00-E7F", "geor": "10A0-10FF", "cjk": "3040-30FF 3400-9FFF", "hang": "AC00-D7AF", "notation": "1D400-1D7FF",
}
INDIC = "deva beng guru gujr orya taml telu knda mlym sinh".split()
MARKS = "300-36F 1AB0-1AFF 1DC0-1DFF 20D0-20FF"
ATTACHED, NEVER = "-‐‑–—'’‘.,:/&_@·।॥", "|\\£¥¤~^*=+<>`"


def chars(ranges: str) -> str:
    """The inside of a regular expression's class."""
    return "".join("-".join(f"\\x{{{x}}}" for x in r.split("-")) for r in ranges.split())


def escaped(characters: str) -> str:
    return "".join(f"\\x{{{ord(c):X}}}" for c in characters)


FOREIGN = f"[\\p{{L}}&&[^{chars(SCRIPTS['latin'])}{chars(SCRIPTS['notation'])}]]"
_OWN = "".join(chars(SCRIPTS[s]) for s in INDIC)
INDIC_LETTER, INDIC_CHAR = f"[\\p{{L}}&&[{_OWN}]]", f"[[\\p{{L}}\\p{{M}}]&&[{_OWN}]]"
_KNOWN = "".join(chars(r) for r in SCRIPTS.values())
_CLASSES = [chars(r) for s, r in SCRIPTS.items() if s not in ("latin", "notation")]
#: Of the foreign letters, the first one's script isn't that of all.
MIXED = f"^(?:(?!{FOREIGN}).)*+(?:" + "|".join([f"[{c}].*[{FOREIGN}&&[^{c}]]" for c in _CLASSES] + [f"[^{_KNOWN}].*[{FOREIGN}&&[{_KNOWN}]]"]) + ")"
MARKED = f"(?:^|{INDIC_LETTER})\\P{{L}}*?[\\p{{Mn}}&&[{chars(MARKS)}]]"
CORRUPT = f"(?s)\\x{{FFFD}}|\\p{{Co}}|{MARKED}|{MIXED}"
_NEVER = f"[{escaped(NEVER)}]"
SPLICED = f"(?<={INDIC_CHAR}){_NEVER}|{_NEVER}(?={INDIC_CHAR})|(?<={INDIC_CHAR})[[\\p{{P}}\\p{{S}}]&&[^{escaped(ATTACHED + NEVER)}]](?={INDIC_CHAR})"
HIGH, STEP = 0x300, 1 << 18
LETTER, ACCENTED, ASCII, VOWEL, UPPER, DIGIT, ALNUM, SPACE, PRIVATE, FFFD, COLON, HIGHER, MARK, OWN, APART, BREAK, FOREIGN_LETTER, UNSTABLE = (1 << k for k in range(18))
BLOCK_OF_PACK = {x.pack: x.block for x in REGISTRY if x.block}


def _inside(ranges: str) -> Iterator[slice]:
    for r in ranges.split():
        low, _, high = r.partition("-")
        yield slice(int(low, 16), int(high or low, 16) + 1)


@functools.cache
def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of each code point's class, bits of each class, script of each foreign letter, block of each letter: from 2 on, 1 if it is in none, 0 for others)."""
    points = range(0x110000)
    kinds = np.array([unicodedata.category(chr(c)) for c in points])
    first = kinds.astype("U1")
    out, script, block = np.zeros(len(kinds), np.int32), np.zeros(len(kinds), np.uint8), np.zeros(len(kinds), np.uint8)
    out[first == "L"] |= LETTER | ALNUM
    out[first == "N"] |= ALNUM
    out[kinds == "Nd"] |= DIGIT
    out[kinds == "Co"] |= PRIVATE
    out[0xC0:0x250][(out[0xC0:0x250] & LETTER) > 0] |= ACCENTED
    for low, high in (("A", "Z"), ("a", "z")):
        out[ord(low) : ord(high) + 1] |= ASCII
    out[ord("A") : ord("Z") + 1] |= UPPER
    out[[ord(c) for c in "aeiouAEIOU"]] |= VOWEL
    out[[*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] |= SPACE
    out[0xFFFD] |= FFFD
    out[[58, 59]] |= COLON
    out[HIGH:] |= HIGHER
    for at in _inside(MARKS):
        out[at][kinds[at] == "Mn"] |= MARK
    for name in INDIC:
        for at in _inside(SCRIPTS[name]):
            out[at][(first[at] == "L") | (first[at] == "M")] |= OWN
    out[(first == "P") | (first == "S")] |= BREAK
    out[[ord(c) for c in ATTACHED + NEVER]] &= ~BREAK
    out[[ord(c) for c in NEVER]] |= APART
    script[first == "L"] = len(SCRIPTS) + 1
    for k, (name, ranges) in enumerate(SCRIPTS.items(), 1):
        for at in _inside(ranges):
            script[at][first[at] == "L"] = 0 if name in ("latin", "notation") else k
    out[script > 0] |= FOREIGN_LETTER
    block[first == "L"] = 1
    for k, low in enumerate(BLOCKS, 2):
        block[low : low + 0x80][first[low : low + 0x80] == "L"] = k
    for c in (*points[:0xD800], *points[0xE000:]):  # form C may change these, or what stands before them
        parts = unicodedata.decomposition(chr(c)).split()
        if unicodedata.combining(chr(c)) or not unicodedata.is_normalized("NFC", chr(c)):
            out[c] |= UNSTABLE
        if len(parts) == 2 and parts[0][0] != "<":
            out[int(parts[1], 16)] |= UNSTABLE
    out[0x1161:0x1176] |= UNSTABLE
    out[0x11A8:0x11C3] |= UNSTABLE
    bits, number = np.unique(out, return_inverse=True)
    return number.astype(np.uint8), bits, script, block


def _joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of the texts, with a line feed after each; where each text begins, and the end)."""
    ends = pc.binary_join_element_wise(texts.cast(pa.large_string()), *(pa.scalar(x, pa.large_string()) for x in ("", "\n")))
    offsets = np.frombuffer(ends.buffers()[1], np.int64)[ends.offset : ends.offset + len(ends) + 1]
    points = np.frombuffer(bytes(ends.buffers()[2])[offsets[0] : offsets[-1]].decode().encode("utf-32-le"), np.uint32)
    return points, np.append(0, np.cumsum(np.asarray(pc.utf8_length(texts)).astype(np.int64) + 1))


def _tally(classes: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """How often each of n classes stands in each text."""
    of = np.repeat(np.arange(len(offsets) - 1) * n, np.diff(offsets))
    return np.bincount(of + classes, minlength=n * (len(offsets) - 1)).reshape(-1, n)


def _words(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(class of each code point, their bits, starts of words, offsets of each text's words, the bits in each word, words of two letters)."""
    number, bits, _, _ = _classes()
    kind = number[points]
    full = ((bits & SPACE) == 0)[kind]
    begin = full.copy()
    begin[1:] &= ~full[:-1]
    start, each = np.flatnonzero(begin), bits[kind]
    inside = np.bitwise_or.reduceat(each, start) if len(start) else np.zeros(0, np.int32)
    n = np.append(0, np.cumsum(each & LETTER, dtype=np.int32))[np.append(start, len(kind))]
    return kind, each, start, np.searchsorted(start, offsets), inside, np.diff(n) >= 2


def _between(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(flags, dtype=np.int32))[offsets])


def _raw(points: np.ndarray, offsets: np.ndarray, words: tuple[np.ndarray, ...]) -> dict[str, np.ndarray]:
    kind, each, start, of, inside, several = words
    bits = _classes()[1]
    tally = _tally(kind, offsets, len(bits)) @ (bits[:, None] & np.array([LETTER, ACCENTED, ASCII, VOWEL, UPPER, DIGIT, ALNUM]) > 0)
    at = np.flatnonzero((each & COLON) > 0)
    at = at[(at > 0) & (at < len(each) - 1)]
    at = at[(each[at - 1] & each[at + 1] & ASCII) > 0]
    spiked = np.zeros(len(start), bool)
    spiked[np.searchsorted(start, at, "right") - 1] = True
    latin = (inside & ASCII) > 0
    return dict(zip("letters accented ascii vowels upper digits alnum".split(), tally.T)) | {"n": _between(latin, of), "spiked": _between(latin & spiked, of), "bare": _between(latin & ((inside & VOWEL) == 0) & several, of)}


def _composed(points: np.ndarray, offsets: np.ndarray, words: tuple[np.ndarray, ...]) -> dict[str, np.ndarray]:
    """Counts of texts in form C. Words are corrupt and spliced as by CORRUPT and SPLICED."""
    kind, each, start, of, inside, several = words
    bits = _classes()[1]
    tally = _tally(kind, offsets, len(bits)) @ (bits[:, None] & np.array([LETTER, PRIVATE, FFFD]) > 0)
    corrupt, spliced = (inside & (FFFD | PRIVATE)) > 0, np.zeros(len(start), bool)
    word = lambda at: np.searchsorted(start, at, "right") - 1
    if len(marks := np.flatnonzero((each & MARK) > 0)):
        letters = np.flatnonzero((each & LETTER) > 0)
        before = np.append(-1, letters)[np.searchsorted(letters, marks)]
        of_mark = word(marks)
        corrupt[of_mark[(before < start[of_mark]) | ((each[before] & OWN) > 0)]] = True
    if len(foreign := np.flatnonzero((each & FOREIGN_LETTER) > 0)):
        script = _classes()[2][points[foreign]]
        differs = np.flatnonzero(script[1:] != script[:-1])
        one, other = word(foreign[differs]), word(foreign[differs + 1])
        corrupt[one[one == other]] = True
    at = np.flatnonzero((each & (APART | BREAK)) > 0)
    at = at[(at > 0) & (at < len(each) - 1)]
    before, after = (each[at - 1] & OWN) > 0, (each[at + 1] & OWN) > 0
    spliced[word(at[np.where((each[at] & APART) > 0, before | after, before & after)])] = True
    return dict(zip(("nfc_letters", "pua", "fffd"), tally.T)) | {"words": _between(several, of), "corrupt": _between(several & corrupt, of), "spliced": _between(several & spliced, of)}


def _suspects(points: np.ndarray, words: tuple[np.ndarray, ...]) -> list[list[str]]:
    _, each, start, of, inside, several = words
    at, space = start[bad := np.flatnonzero(several & ((inside & HIGHER) > 0))], np.flatnonzero((each & SPACE) > 0)
    out = [points[i:j].tobytes().decode("utf-32-le") for i, j in zip(at.tolist(), space[np.searchsorted(space, at)].tolist())]
    cut = np.searchsorted(bad, of).tolist()
    return [out[i:j] for i, j in zip(cut, cut[1:])]


def _damage(texts: pa.Array, lists: bool = False) -> dict[str, list | np.ndarray]:
    points, offsets = _joined(texts)
    words = _words(points, offsets)
    own = _raw(points, offsets, words)
    done = _composed(points, offsets, words) | ({"suspects": _suspects(points, words)} if lists else {})
    unstable = np.flatnonzero(np.add.reduceat((words[1] & UNSTABLE) > 0, offsets[:-1]))
    if len(unstable):
        points, offsets = _joined(pa.array([unicodedata.normalize("NFC", t) for t in texts.take(pa.array(unstable)).to_pylist()], pa.large_string()))
        words = _words(points, offsets)
        for k, v in (_composed(points, offsets, words) | ({"suspects": _suspects(points, words)} if lists else {})).items():
            for i, x in zip(unstable.tolist(), v) if k == "suspects" else ():
                done[k][i] = x
            if k != "suspects":
                done[k][unstable] = v
    return own | done


def _letters(texts: pa.Array) -> dict[str, np.ndarray]:
    points, offsets = _joined(texts)
    tally = _tally(_classes()[3][points], offsets, len(BLOCKS) + 2)
    return {"letters": tally[:, 1:].sum(1)} | {f"b{b:x}": tally[:, k] for k, b in enumerate(BLOCKS, 2)}


def _by_steps(texts: pa.Array, kind: T.StructType, of: Callable[[pa.Array], dict]) -> pa.Array:
    """Texts are taken together up to about STEP bytes, which stay in the processor's caches."""
    part = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)) // STEP
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)] if len(texts) else []

    def one(texts: pa.Array) -> pa.Array:
        found = of(pc.fill_null(texts, ""))
        columns = [pa.array(found[f.name], pa.list_(pa.string())) if f.name == "suspects" else pa.array(np.asarray(found[f.name]).astype(np.int32)) for f in kind.fields]
        return pa.StructArray.from_arrays(columns, names=[f.name for f in kind.fields], mask=texts.is_null())

    return pa.concat_arrays([one(texts[i:j]) for i, j in zip(cuts, cuts[1:])] or [one(pa.array([""], pa.string()))[:0]])


_COUNTS = "letters accented ascii vowels upper digits alnum n spiked bare words nfc_letters pua fffd".split()
MEASURED = T.StructType([*[T.StructField(k, T.IntegerType()) for k in _COUNTS], T.StructField("suspects", T.ArrayType(T.StringType()))])
DAMAGE = T.StructType([T.StructField(k, T.IntegerType()) for k in (*_COUNTS, "corrupt", "spliced")])
LETTERS = T.StructType([T.StructField(k, T.IntegerType()) for k in ("letters", *(f"b{b:x}" for b in BLOCKS))])


@F.arrow_udf(MEASURED)
def measured(texts: pa.Array) -> pa.Array:
    """Counts of a text's characters and words; of its form C the words of two letters, letters, private-use and replacement characters, and those words that hold a character from U+0300 on."""
    return _by_steps(texts, MEASURED, lambda t: _damage(t, True))


@F.arrow_udf(DAMAGE)
def damage(texts: pa.Array) -> pa.Array:
    """As measured(), with the number of corrupt and of spliced words instead of words."""
    return _by_steps(texts, DAMAGE, _damage)


@F.arrow_udf(LETTERS)
def script_letters(texts: pa.Array) -> pa.Array:
    """A text's letters, and those of each block."""
    return _by_steps(texts, LETTERS, _letters)


def font_pack(fonts: Column) -> Column:
    """Pack of the first font (by name) that is known to map glyphs, by the first part that its name holds."""

    def one(font: Column) -> Column:
        name = F.lower(F.trim(F.regexp_replace(font, r"^[^+]*\+", "")))
        out = F.lit(None).cast("string")
        for part, pack in reversed(FONTS):
            out = F.when(name.contains(part), pack).otherwise(out)
        return out

    return F.get(F.filter(F.transform(F.array_sort(fonts), one), lambda x: x.isNotNull()), F.lit(0))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def latin1_ratio(m: Column) -> Column:
    return ratio(m["accented"], m["letters"])


def latin1(m: Column) -> Column:
    """Accented letters are 40 % of all."""
    return latin1_ratio(m) >= 0.4


def ascii_glyphs(m: Column) -> Column:
    """ASCII letters that don't make Latin words: few vowels, and semicolons within words or many words without a vowel."""
    prose = (ratio(m["bare"], m["n"]) >= 0.4) & (ratio(m["digits"], m["alnum"]) < 0.1) & (ratio(m["upper"], m["ascii"]) < 0.3)
    return F.coalesce((ratio(m["ascii"], m["letters"]) >= 0.85) & (m["n"] >= 8) & (ratio(m["vowels"], m["ascii"]) < 0.35) & ((ratio(m["spiked"], m["n"]) >= 0.15) | prose), F.lit(False))


def counts(m: Column) -> Column:
    """Struct of counts: corrupt and spliced words, words of two letters, letters, private-use and replacement characters."""
    return F.struct(*[m[k].alias(k) for k in ("corrupt", "spliced", "words")], m["nfc_letters"].alias("letters"), m["pua"].alias("pua"), m["fffd"].alias("fffd"))


def _floor(c: Column, fffd: int, pua: int, pua_share: float, bad: int, bad_share: float) -> Column:
    share = c["pua"] / F.greatest(F.lit(1), c["pua"] + c["letters"])
    return (c["fffd"] >= fffd) | ((c["pua"] >= pua) & (share >= pua_share)) | ((c["words"] >= 8) & (c["corrupt"] >= bad) & (ratio(c["corrupt"], c["words"]) >= bad_share))


def broken_cmap(c: Column) -> Column:
    return _floor(c, 4, 20, 0.3, 4, 0.15)


def symbol_glyphs(c: Column, least: int = 4, share: float = 0.08) -> Column:
    return (c["words"] >= 8) & (c["spliced"] >= least) & (ratio(c["spliced"], c["words"]) >= share)


def suspect_floor(c: Column) -> Column:
    return _floor(c, 2, 8, 0.1, 2, 0.05) | symbol_glyphs(c, 2, 0.03)


def signals(df: DataFrame, column: str = "text", fonts: str | None = None) -> DataFrame:
    """df with all signals of a page's text, `garbled` (any of five) and `suspect` (garbled, or under the lower floor)."""
    out = df.withColumn("_m", damage(F.col(column))).withColumn("_c", counts(F.col("_m")))
    m, c = F.col("_m"), F.col("_c")
    out = out.withColumns({
        "legacy_font": font_pack(F.col(fonts)).isNotNull() if fonts else F.lit(False), "latin1": latin1(m), "ascii_glyphs": ascii_glyphs(m),
        "broken_cmap": broken_cmap(c), "symbol_glyphs": symbol_glyphs(c), "floor": suspect_floor(c),
    })
    garbled = F.col("legacy_font") | F.col("latin1") | F.col("ascii_glyphs") | F.col("broken_cmap") | F.col("symbol_glyphs")
    return out.withColumn("garbled", garbled).withColumn("suspect", garbled | F.col("floor")).drop("_m", "_c", "floor")


def script_ratio(m: Column, pack: str) -> Column:
    """Letters of the pack's block, as a share of all letters, of script_letters(); 0 for packs without a block."""
    block = BLOCK_OF_PACK.get(pack)
    return ratio(m[f"b{block:x}"], m["letters"]) if block else F.lit(0.0)


def best_script(text: Column, packs: Column) -> Column:
    """struct(ratio, pack) of the pack with the highest ratio; the first of equals."""

    def best(m: Column) -> Column:
        def scored(pack: Column) -> Column:
            out = F.lit(0.0)
            for p in BLOCK_OF_PACK:
                out = F.when(pack == p, script_ratio(m, p)).otherwise(out)
            return out

        rows = F.transform(packs, lambda p, i: F.struct(scored(p).alias("ratio"), (-i).alias("k"), p.alias("pack")))
        return let(F.array_max(rows), lambda b: F.struct(F.coalesce(b["ratio"], F.lit(0.0)).alias("ratio"), b["pack"].alias("pack")))

    return let(script_letters(text), best)
