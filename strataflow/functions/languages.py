"""The registry of languages, and what is looked up in it."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Language(NamedTuple):
    iso: str
    name: str
    pack: str
    block: int | None
    osd: str

    @property
    def characters(self) -> str | None:
        """A regular expression's class of the block, for Java and RE2 alike."""
        return None if self.block is None else f"[\\x{{{self.block:04X}}}-\\x{{{self.block + 0x7F:04X}}}]"


#: In the order that settles ties.
REGISTRY = [Language(*row) for row in zip(
    "en te hi mr ta kn ml bn gu pa or as".split(),
    "English Telugu Hindi Marathi Tamil Kannada Malayalam Bengali Gujarati Punjabi Odia Assamese".split(),
    "eng tel hin mar tam kan mal ben guj pan ori asm".split(),
    (None, 0xC00, 0x900, 0x900, 0xB80, 0xC80, 0xD00, 0x980, 0xA80, 0xA00, 0xB00, 0x980),
    "Latin Telugu Devanagari Devanagari Tamil Kannada Malayalam Bengali Gujarati Gurmukhi Oriya Bengali".split(),
)]
BY_ISO = {x.iso: x for x in REGISTRY}
ALIASES = {a: x.iso for x in REGISTRY for a in (x.iso, x.name.lower(), x.pack)} | {"oriya": "or", "odiya": "or", "bangla": "bn", "panjabi": "pa", "asomiya": "as"}
PACKS = {x.iso: x.pack for x in REGISTRY if x.iso != "en"}
BLOCK_OF_PACK = {x.pack: x.characters for x in REGISTRY if x.characters}


def literal_map(of: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in of.items() for x in pair])


def normalize(name: Column) -> Column:
    """ISO code of a code, name or pack; null if there is none."""
    return F.try_element_at(literal_map(ALIASES), F.lower(F.trim(name)))


def normalize_list(names: Column) -> Column:
    """Distinct ISO codes of a list, parted by commas or slashes, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(names, "[,/]"), normalize), lambda x: x.isNotNull()))


def pack_of(iso: Column) -> Column:
    """The OCR pack; null for English and for what isn't known, but for packs themselves."""
    name = F.lower(F.trim(iso))
    return F.coalesce(F.try_element_at(literal_map(PACKS), name), F.when(name.isin(*BLOCK_OF_PACK), name))


def display_name(iso: Column) -> Column:
    return F.try_element_at(literal_map({x.iso: x.name for x in REGISTRY}), iso)


BLOCKS = sorted({x.block for x in REGISTRY if x.block is not None})
COUNTS = T.StructType([T.StructField(k, T.IntegerType()) for k in ("latin", *(f"b{b:x}" for b in BLOCKS))])


@F.arrow_udf(COUNTS)
def counts(texts: pa.Array) -> pa.Array:
    """ASCII letters and characters of each block, all from one pass over the UTF-8 bytes: a block from U+0900 to U+0DFF is a lead byte and half of the next one's range."""
    texts = texts.cast(pa.large_string())
    n, null = len(texts), np.asarray(texts.is_null())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]

    def per_text(at: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(at, offsets)).astype(np.int32)

    latin = np.flatnonzero(((raw | 32) >= 97) & ((raw | 32) <= 122))
    lead = np.flatnonzero(raw[:-1] == 0xE0) if len(raw) else latin
    block = 0x800 + ((raw[lead + 1].astype(np.int64) - 0xA0) >> 1) * 0x80 if len(lead) else lead
    columns = [per_text(latin), *[per_text(lead[block == b]) for b in BLOCKS]]
    return pa.StructArray.from_arrays([pa.array(c) for c in columns], names=["latin", *[f"b{b:x}" for b in BLOCKS]], mask=pa.array(null))


def _most(c: Column, latin: bool, pool: list[str]) -> Column:
    rows = [(c["latin"], 0, "en")] if latin else []
    rows += [(c[f"b{BY_ISO[i].block:x}"], k, i) for k, i in enumerate(pool, 1) if BY_ISO[i].block is not None]
    found = F.array(*[F.when(n > 0, F.struct(n.alias("n"), F.lit(-k).alias("k"), F.lit(i).alias("iso"))) for n, k, i in rows])
    return F.array_max(found)["iso"]


def of_counts(c: Column, pool: list[str] | None = None) -> Column:
    """The language, English aside, whose block has most characters; null without any."""
    return _most(c, False, pool or list(BY_ISO))


def dominant(c: Column, pool: list[str] | None = None) -> Column:
    """As of_counts(), but against ASCII letters, which count as English and win ties."""
    return _most(c, True, pool or list(BY_ISO))


def tag(c: Column, declared: list[str]) -> Column:
    """The dominant language; where there are no letters, English if it is declared, else the first declared."""
    return F.coalesce(dominant(c, declared), F.lit("en" if "en" in declared or not declared else declared[0]))


def tagged(df: DataFrame, text: str, to: str, declared: list[str]) -> DataFrame:
    """df with the language of a text, whose characters are counted once."""
    return df.withColumn("_counts", counts(F.col(text))).withColumn(to, tag(F.col("_counts"), declared)).drop("_counts")


def of_osd(osd: Column, candidates: Column) -> Column:
    """ISO code of a script's name: the first candidate that is written in it, else the first of the registry."""
    name = F.lower(F.trim(osd))
    osd_of = literal_map({x.iso: x.osd.lower() for x in REGISTRY})
    owner: dict[str, str] = {}
    for x in REGISTRY:
        owner.setdefault(x.osd.lower(), x.iso)
    return F.coalesce(F.get(F.filter(F.transform(candidates, normalize), lambda c: F.try_element_at(osd_of, c) == name), F.lit(0)), F.try_element_at(literal_map(owner), name))


def pinned(declared: Column) -> Column:
    """As pinned_pack(), of an array of ISO codes."""
    foreign = F.array_distinct(F.filter(declared, lambda i: i != "en"))
    return F.when(F.size(foreign) == 1, F.try_element_at(literal_map(PACKS), F.get(foreign, F.lit(0))))


def pinned_pack(declared: list[str]) -> str | None:
    """The pack that is used without detection: only where exactly one language beside English is declared."""
    foreign = [i for i in dict.fromkeys(declared) if i != "en"]
    return PACKS.get(foreign[0]) if len(foreign) == 1 else None
