"""Layout of pages: items(source, page, idx, kind, x0, y0, x1, y1, text, size, bold, width, height) to ordered, classified elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.functions import text as X

PAGE = ["source", "page"]


def overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Share of a's area that b covers."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    area = (a["x1"] - a["x0"]) * (a["y1"] - a["y0"])
    return F.when((w > 0) & (h > 0) & (area > 0), w * h / area).otherwise(F.lit(0.0))


def box(prefix: str = "") -> dict[str, Column]:
    return {k: F.col(f"{prefix}{k}") for k in ("x0", "y0", "x1", "y1")}


def outside_tables(items: DataFrame, boxes: DataFrame, least: float = 0.3) -> DataFrame:
    """Text that no table of its page covers by 30 %; boxes(source, page, x0, y0, x1, y1)."""
    b = boxes.select(F.col("source").alias("b_source"), F.col("page").alias("b_page"), *[F.col(k).alias(f"b_{k}") for k in ("x0", "y0", "x1", "y1")])
    return items.join(b, (F.col("source") == F.col("b_source")) & (F.col("page") == F.col("b_page")) & (overlap(box(), box("b_")) >= least), "left_anti")


def distinct_boxes(boxes: Column) -> Column:
    """Boxes in order, without those that overlap a kept one by half, either way: greedy, over the few boxes of a page."""
    side = lambda s: {k: s[k] for k in ("x0", "y0", "x1", "y1")}
    clash = lambda kept, b: F.exists(kept, lambda k: (overlap(side(k), side(b)) >= 0.5) | (overlap(side(b), side(k)) >= 0.5))
    return F.aggregate(boxes, F.slice(boxes, 1, 0), lambda kept, b: F.when(clash(kept, b), kept).otherwise(F.concat(kept, F.array(b))))


def columns(items: DataFrame) -> DataFrame:
    """(source, page, two_columns): six texts, three on either side of the middle, and a gutter of 6 % between."""
    mid = F.col("width") / 2
    left, right = F.when(F.col("x0") < mid, F.col("x0")), F.when(F.col("x0") >= mid, F.col("x0"))
    found = items.where("kind = 'text'").groupBy(*PAGE).agg(F.count("*").alias("n"), F.count(left).alias("l"), F.count(right).alias("r"), (F.min(right) - F.max(left)).alias("gutter"), F.first("width").alias("width"))
    two = (F.col("width") > 0) & (F.col("n") >= 6) & (F.col("l") >= 3) & (F.col("r") >= 3) & (F.col("gutter") > F.col("width") * 0.06)
    return found.select(*PAGE, F.coalesce(two, F.lit(False)).alias("two_columns"))


def ordered(items: DataFrame) -> DataFrame:
    """items with `col` and `seq`, the reading order of the page from 0. One window by page finds the columns too, so there is one shuffle."""
    page = Window.partitionBy(*PAGE)
    mid, text = F.col("width") / 2, F.col("kind") == "text"
    left, right = F.when(text & (F.col("x0") < mid), F.col("x0")), F.when(text & (F.col("x0") >= mid), F.col("x0"))
    two = (F.count(F.when(text, 1)).over(page) >= 6) & (F.count(left).over(page) >= 3) & (F.count(right).over(page) >= 3) & (F.min(right).over(page) - F.max(left).over(page) > F.col("width") * 0.06)
    out = items.withColumn("col", F.when(F.coalesce(two, F.lit(False)) & (F.col("x0") >= mid), 1).otherwise(0))
    return out.withColumn("seq", F.row_number().over(page.orderBy("col", F.bround(F.col("y0") / 4), "x0", "idx")) - 1)


def font_sizes(items: DataFrame) -> DataFrame:
    """(source, body, heading_sizes): the size of most characters (the first met, among equals), and the four largest from 1.15 times that on."""
    sized = items.where("kind = 'text' and size > 0").groupBy("source", F.bround("size").alias("s")).agg(F.sum(F.length("text")).alias("n"), F.min(F.struct("page", "idx")).alias("at"))
    by = sized.groupBy("source").agg(F.max_by("s", F.struct("n", -F.col("at.page"), -F.col("at.idx"))).alias("body"), F.collect_set("s").alias("all"))
    return by.select("source", "body", F.slice(F.sort_array(F.filter("all", lambda s: s >= F.col("body") * 1.15), asc=False), 1, 4).alias("heading_sizes"))


def in_margin(frac: float = 0.1) -> Column:
    return F.coalesce((F.col("height") > 0) & ((F.col("y1") <= F.col("height") * frac) | (F.col("y0") >= F.col("height") * (1 - frac))), F.lit(False))


def running_margins(items: DataFrame, least: int = 3, share: float = 0.4) -> DataFrame:
    """(source, norm) of headers and footers that stand on 40 % of the pages, three at least."""
    pages = items.groupBy("source").agg(F.countDistinct("page").alias("pages"))
    seen = items.where((F.col("kind") == "text") & in_margin()).select("source", "page", X.margin_form(F.col("text")).alias("norm")).where(F.length("norm") >= 3)
    counted = seen.groupBy("source", "norm").agg(F.countDistinct("page").alias("n"))
    return counted.join(pages, "source").where((F.col("pages") >= least) & (F.col("n") >= F.greatest(F.lit(least), F.floor(F.col("pages") * share)))).select("source", "norm")


def without_margins(items: DataFrame) -> DataFrame:
    found = running_margins(items).withColumnRenamed("source", "b_source")
    hit = (F.col("source") == F.col("b_source")) & (X.margin_form(F.col("text")) == F.col("norm")) & in_margin() & (F.col("kind") == "text")
    return items.join(found, hit, "left_anti")


def classified(items: DataFrame) -> DataFrame:
    """items with (type, level): by size, else by bold type, else list item, else paragraph. Blank ones go."""
    text = X.collapse(F.col("text"))
    out = items.join(font_sizes(items), "source", "left").withColumn("text", F.when(F.col("kind") == "text", text).otherwise(F.col("text")))
    level = F.get(F.filter(F.transform("heading_sizes", lambda h, i: F.when(F.col("size") >= h - 0.5, i + 1)), lambda x: x.isNotNull()), F.lit(0))
    by_size = F.when((F.length("text") <= 160) & level.isNotNull(), level)
    by_bold = F.when(level.isNull() & F.col("bold") & F.length("text").between(1, 80) & (F.col("size") >= F.col("body") - 0.5) & ~F.col("text").rlike("[.,;:]$"), F.least(F.lit(6), F.size("heading_sizes") + 1))
    head = F.coalesce(by_size, by_bold).cast("int")
    kind = F.when(F.col("kind") != "text", F.col("kind")).when(head.isNotNull(), "heading").when(X.is_list_item(F.col("text")), "list_item").otherwise("paragraph")
    return out.where((F.col("kind") != "text") | (F.col("text") != "")).withColumn("type", kind).withColumn("level", F.when(F.col("type") == "heading", head).otherwise(0).cast("int")).drop("body", "heading_sizes")


def documents(items: DataFrame, doc_type: str = "pdf") -> DataFrame:
    """items to (source, filename, doc_type, elements): margins off, in reading order, classified. Shuffles by source for margins and font sizes, by page for the order, and by source for the array."""
    done = ordered(classified(without_margins(items)))
    tbl = F.col("tbl") if "tbl" in items.columns else F.lit(None).cast("struct<headers:array<string>,rows:array<array<string>>>")
    element = F.struct(F.col("type"), F.col("text"), F.col("level"), F.col("page"), tbl.alias("tbl"))
    all_ = F.array_sort(F.collect_list(F.struct(F.col("page").alias("p"), F.col("seq").alias("s"), element.alias("e"))), lambda a, b: F.when(a["p"] != b["p"], F.when(a["p"] < b["p"], -1).otherwise(1)).otherwise(a["s"] - b["s"]))
    return done.groupBy("source").agg(F.transform(all_, lambda x: x["e"]).alias("elements")).select("source", F.element_at(F.split("source", "/"), -1).alias("filename"), F.lit(doc_type).alias("doc_type"), "elements")


def page_facts(items: DataFrame) -> DataFrame:
    """(source, page, raw_length, fonts, text, n_fig, scanned, judged): what decides on a page's detection and OCR."""
    has = F.col("kind") == "text"
    ordered_text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(has & (X.strip(F.col("text")) != ""), F.struct("idx", "text")))), lambda s: s["text"]), " ")
    n_fig = F.count(F.when((F.col("kind") == "figure") & (F.col("x1") - F.col("x0") >= 40) & (F.col("y1") - F.col("y0") >= 40), 1))
    facts = items.groupBy(*PAGE).agg(F.coalesce(F.sum(F.when(has, F.length("text"))), F.lit(0)).alias("raw_length"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(has, F.col("fonts")))))).alias("fonts"), X.strip(ordered_text).alias("text"), n_fig.alias("n_fig"), F.count(F.when(F.col("kind") == "table", 1)).alias("n_tables"))
    return facts.withColumn("scanned", (F.col("raw_length") < 20) & (F.col("n_tables") == 0)).withColumn("judged", F.length("text") >= 20)
