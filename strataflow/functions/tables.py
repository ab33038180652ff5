"""Tables as struct<headers: array<string>, rows: array<array<string>>>: cleaning, tests, Markdown, row groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataflow.functions.text import collapse, let, strip, tokens


def clean_cell(cell: Column) -> Column:
    """One line, safe in Markdown."""
    return collapse(F.replace(F.regexp_replace(F.coalesce(cell, F.lit("")), r"[\r\n]", " "), F.lit("|"), F.lit("\\|")))


def n_cols(headers: Column, rows: Column) -> Column:
    return F.when(F.size(headers) > 0, F.size(headers)).otherwise(F.coalesce(F.size(F.get(rows, F.lit(0))), F.lit(0)))


def same_row(a: Column, b: Column) -> Column:
    """Equal but for case and white space."""
    form = lambda r: F.transform(r, lambda c: F.lower(collapse(c)))
    return form(a) == form(b)


def normalized(headers: Column, rows: Column) -> Column:
    """struct(headers, rows): nulls as blanks, blank rows off, the header not repeated as a row; null if no row is left."""
    filled = F.transform(F.coalesce(rows, F.array().cast("array<array<string>>")), lambda r: F.transform(r, lambda c: F.coalesce(c, F.lit(""))))
    full = F.filter(filled, lambda r: F.exists(r, lambda c: strip(c) != ""))
    names = F.transform(F.coalesce(headers, F.array().cast("array<string>")), lambda c: F.coalesce(c, F.lit("")))
    top = F.when(F.size(names) > 0, names).otherwise(F.get(full, F.lit(0)))
    rest = F.slice(full, 2, F.greatest(F.size(full), F.lit(1)))
    body = F.when((F.size(names) == 0) | same_row(names, F.get(full, F.lit(0))), rest).otherwise(full)
    return F.when(F.size(body) > 0, F.struct(top.alias("headers"), body.alias("rows")))


def is_real(headers: Column, rows: Column) -> Column:
    """Not prose that looks like a table: two columns, short cells, few blanks; none in a table of one row."""
    cells = F.flatten(rows)
    n = F.size(cells)
    blanks = F.size(F.filter(cells, lambda c: strip(c) == ""))
    total = F.aggregate(cells, F.lit(0), lambda a, c: a + F.length(c))
    longest = F.array_max(F.transform(cells, lambda c: F.length(c)))
    return F.coalesce((n_cols(headers, rows) >= 2) & (F.size(rows) >= 1) & (n > 0) & (longest <= 200) & (total / n <= 80) & (blanks / n <= 0.6) & ((F.size(rows) >= 2) | (blanks == 0)), F.lit(False))


def markdown(headers: Column, rows: Column, max_rows: Column | None = None) -> Column:
    """A Markdown table; rows beyond max_rows become one of ellipses."""
    return let(n_cols(headers, rows), lambda cols: _markdown(headers, rows, cols, max_rows))


def _markdown(headers: Column, rows: Column, cols: Column, max_rows: Column | None) -> Column:
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    padded = lambda r: F.slice(F.concat(F.transform(r, clean_cell), F.array_repeat(F.lit(""), F.greatest(F.lit(0), cols - F.size(r)))), F.lit(1), cols)
    numbered = F.transform(F.sequence(F.lit(1), F.greatest(cols, F.lit(1))), lambda i: F.concat(F.lit("col_"), i.cast("string")))
    names = F.when(F.size(headers) > 0, F.transform(headers, lambda h, i: F.coalesce(F.nullif(clean_cell(h), F.lit("")), F.concat(F.lit("col_"), (i + 1).cast("string"))))).otherwise(numbered)
    body = rows if max_rows is None else F.slice(rows, F.lit(1), max_rows)
    lines = F.concat(F.array(line(F.slice(names, F.lit(1), cols)), line(F.array_repeat(F.lit("---"), cols))), F.transform(body, lambda r: line(padded(r))))
    if max_rows is not None:
        lines = F.concat(lines, F.when(F.size(rows) > max_rows, F.array(line(F.array_repeat(F.lit("…"), cols)))).otherwise(F.array().cast("array<string>")))
    return F.when(cols == 0, "").otherwise(F.array_join(lines, "\n"))


def rows_per_group(headers: Column, rows: Column, budget: int) -> Column:
    """Rows that fit the budget beside a repeated header; all of them if the table fits, or has one row."""
    sizes = F.struct(tokens(markdown(headers, rows)).alias("full"), F.greatest(F.lit(1), tokens(markdown(headers, rows, F.lit(0)))).alias("head"), F.greatest(F.lit(1), F.size(rows)).alias("n"))

    def split(s: Column) -> Column:
        each = F.greatest(F.lit(1), F.floor((s["full"] - s["head"]) / s["n"]))
        return F.when((s["full"] <= budget) | (s["n"] <= 1), s["n"]).otherwise(F.greatest(F.lit(1), F.floor((F.lit(budget) - s["head"]) / each))).cast("int")

    return let(sizes, split)
