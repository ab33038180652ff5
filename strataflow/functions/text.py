"""Scalar text functions, Column to Column: tokens, ids, white space, sentences, headings and gates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space and the four separators U+001C to U+001F.
SPACES = r"(?U)[\s\x1c-\x1f]+"
#: All ends of lines, not only the line feed.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
SENTENCE_END = r"(?U)(?<=[.!?])[\s\x1c-\x1f]+"
BULLETED = r"(?s)^(?:[•\-*·‣◦–]|\d$|\d[.)]|\p{L}[.)].)"
BREADCRUMB, PATH, UNIT = " › ", " / ", "\u001f"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once, however often it is named."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def tokens(text: Column) -> Column:
    """Four characters to a token, rounded down, one at least; nothing has none."""
    n = F.coalesce(F.length(text), F.lit(0))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4).cast("int"))).cast("int")


def chars_of(n: Column) -> Column:
    """Characters that so many tokens stand for."""
    return F.floor(n * 4).cast("int")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def stable_id(source: Column, path: Column, ordinal: Column) -> Column:
    return F.concat(F.lit("c_"), F.substring(F.sha1(F.concat_ws(UNIT, source, path, ordinal.cast("string"))), 1, 16))


def margin_form(text: Column) -> Column:
    """A header or footer with its numbers as #, so that it is the same on all pages."""
    return F.substring(collapse(F.regexp_replace(F.lower(text), r"(?U)\d+", "#")), 1, 80)


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, SENTENCE_END), lambda s: strip(s) != "")


def tail_sentences(text: Column, budget: int) -> Column:
    """The last sentences within the budget; one at least, however long."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("n"), F.lit(False).alias("over"))

    def step(state: Column, s: Column) -> Column:
        over = state["over"] | ((state["n"] + tokens(s) > budget) & (F.size(state["kept"]) > 0))
        return F.struct(
            F.when(over, state["kept"]).otherwise(F.concat(F.array(strip(s)), state["kept"])).alias("kept"),
            F.when(over, state["n"]).otherwise(state["n"] + tokens(s)).alias("n"),
            over.alias("over"),
        )

    return F.aggregate(F.reverse(sentences(text)), start, step, lambda s: s["kept"])


def is_list_item(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+", "").rlike(BULLETED)


def count_of(text: Column, kind: str) -> Column:
    """Characters of a class: by what is left without its runs, as regexp_count() would build an array of every one."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{kind}+", ""))


def letters(text: Column) -> Column:
    return count_of(text, r"\p{L}")


def plausible(text: Column) -> Column:
    """Recognised text that reads as words: 12 characters, three words of three letters, mostly letters and blanks."""
    s = strip(F.coalesce(text, F.lit("")))
    words = F.size(F.filter(F.split(s, SPACES), lambda w: letters(w) >= 3))
    share = count_of(s, r"(?U)[\p{L}\s\x1c-\x1f]") / F.greatest(F.lit(1), F.length(s))
    return (F.length(s) >= 12) & (words >= 3) & (share >= 0.55)


def without_markup(text: Column) -> Column:
    """Line-break tags to line ends; tags of bold, italics, maths and the like off."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?i)<br\s*/?>", "\n"), r"(?i)</?(?:b|i|u|em|strong|sub|sup|math|mark|small|del|span)\b[^>]*>", ""))


def file_part(text: Column) -> Column:
    """Safe as the name of a file."""
    return F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_")


def chunk_text(path: Column, body: Column) -> Column:
    """The breadcrumb, a blank line and the body; the body alone without a breadcrumb."""
    crumb = F.array_join(F.filter(path, lambda p: p != ""), BREADCRUMB)
    return F.when(crumb == "", body).otherwise(F.concat(crumb, F.lit("\n\n"), body))


def section_path(title: Column, crumbs: Column) -> Column:
    """Title and headings without blanks and without neighbours that are the same."""
    full = F.filter(F.concat(F.array(title), crumbs), lambda p: p.isNotNull() & (p != ""))
    numbered = F.transform(full, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    return F.transform(F.filter(numbered, lambda s: (s["i"] == 0) | (F.get(full, s["i"] - 1) != s["p"])), lambda s: s["p"])


def figure(text: Column) -> Column:
    return F.concat(F.lit("[Figure] "), text)
