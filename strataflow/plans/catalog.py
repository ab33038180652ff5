"""The queries of the ingestion engine and their DuckDB SQL, by name. All run over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.functions import garble, languages, tables
from strataflow.functions import text as X
from strataflow.operators import enrich, layout, ocr, structure
from strataflow.plans import inputs
from strataflow.plans import oracle as O
from strataflow.sources import files

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "documents")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest_chunks(spark, sf_dir)


@query()
def ingest_chunks(spark, sf_dir):
    """Documents to chunk records, with overlap and merging."""
    return structure.chunks(structure.documents(inputs.structured(spark, sf_dir)))


@query(O.PACK)
def pack_chunks(spark, sf_dir):
    out = structure.chunks(structure.documents(inputs.structured(spark, sf_dir)), overlap=0, least=0)
    return out.select("chunk_id", "text", "source", "ordinal", "heading", F.array_join("section_path", "/").alias("path"), "language")


@query("SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS n_tokens FROM documents")
def token_count(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.tokens(F.col("text")).cast("long").alias("n_tokens"))


@query("SELECT doc_id, concat('c_', substr(sha1(concat_ws(chr(31), 'doc://' || doc_id, lang || ' / ' || source, n_chars % 7)), 1, 16)) AS chunk_id FROM documents")
def stable_id(spark, sf_dir):
    path = F.array_join(F.array("lang", "source"), X.PATH)
    return docs(spark, sf_dir).select("doc_id", X.stable_id(F.concat(F.lit("doc://"), F.col("doc_id").cast("string")), path, F.col("n_chars") % 7).alias("chunk_id"))


@query(r"SELECT doc_id, trim(regexp_replace(replace(text, 'e', '  '), '[\s\x{A0}\x{85}\p{Z}\x{0B}\x{1C}-\x{1F}]+', ' ', 'g')) AS norm FROM documents")
def whitespace_norm(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.collapse(F.replace("text", F.lit("e"), F.lit("  "))).alias("norm"))


@query(r"SELECT doc_id, i - 1 AS line_no, substr(trim(regexp_replace(regexp_replace(lower(line), '\p{Nd}+', '#', 'g'), '[\s\x{A0}\x{85}\p{Z}\x{0B}\x{1C}-\x{1F}]+', ' ', 'g')), 1, 80) AS norm FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)")
def boiler_norm(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).select("doc_id", F.col("line_no").cast("long").alias("line_no"), X.margin_form(F.col("line")).alias("norm"))


@query(O.LANGUAGE)
def language_dominant(spark, sf_dir):
    c = F.col("c")
    v = inputs.variants(spark, sf_dir).withColumn("c", languages.counts(F.col("text")))
    return v.select("doc_id", "variant", languages.dominant(c).alias("dominant"), languages.of_counts(c).alias("foreign_language"), languages.tag(c, ["hi", "ta"]).alias("tag"))


@query(O.ALIAS)
def language_alias(spark, sf_dir):
    names = F.concat_ws(",", F.upper("lang"), F.when(F.col("doc_id") % 3 == 0, " Bangla ").when(F.col("doc_id") % 3 == 1, "tel/Odia"), F.col("lang"))
    return docs(spark, sf_dir).select("doc_id", F.array_join(languages.normalize_list(names), "+").alias("codes"), languages.normalize(F.col("lang")).alias("code"))


@query(O.OSD)
def osd_language(spark, sf_dir):
    f = inputs.page_facts(spark, sf_dir).withColumn("iso", languages.of_osd(F.col("osd"), F.col("langs")))
    return f.select("page_id", "iso", languages.pack_of(F.col("iso")).alias("pack"), languages.display_name(F.col("iso")).alias("name"))


@query(O.SENTENCES)
def sentence_split(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence")).select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence")


@query(O.TAIL)
def tail_overlap(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(X.tail_sentences(F.col("text"), 60), "~").alias("tail"))


@query(O.ELEMENTS)
def text_parse_elements(spark, sf_dir):
    e = structure.elements_of(F.col("text"))
    return inputs.structured(spark, sf_dir).select("doc_id", F.posexplode(e).alias("seq", "e")).select("doc_id", F.col("seq").cast("long").alias("seq"), "e.type", "e.text", F.col("e.level").cast("long").alias("level"))


@query(O.LATIN1)
def latin1_signal(spark, sf_dir):
    m = F.col("m")
    return inputs.variants(spark, sf_dir).withColumn("m", garble.damage(F.col("text"))).select("doc_id", "variant", garble.latin1_ratio(m).alias("ratio"), garble.latin1(m).alias("latin1"))


@query(O.GLYPHS)
def ascii_glyph_signal(spark, sf_dir):
    return inputs.variants(spark, sf_dir).withColumn("m", garble.damage(F.col("text"))).select("doc_id", "variant", garble.ascii_glyphs(F.col("m")).alias("ascii_glyphs"))


@query(O.CMAP)
def cmap_signal(spark, sf_dir):
    c = inputs.variants(spark, sf_dir).withColumn("m", garble.damage(F.col("text"))).withColumn("c", garble.counts(F.col("m")))
    return c.select("doc_id", "variant", *[F.col(f"c.{k}").cast("long").alias(k) for k in ("corrupt", "words", "letters", "pua", "fffd")], garble.broken_cmap(F.col("c")).alias("broken_cmap"))


@query(O.SPLICE)
def splice_signal(spark, sf_dir):
    c = inputs.variants(spark, sf_dir).withColumn("m", garble.damage(F.col("text"))).withColumn("c", garble.counts(F.col("m")))
    return c.select("doc_id", "variant", F.col("c.spliced").cast("long").alias("spliced"), garble.symbol_glyphs(F.col("c")).alias("symbol_glyphs"), garble.suspect_floor(F.col("c")).alias("suspect"))


@query(O.FONTS)
def legacy_font(spark, sf_dir):
    part = inputs.table(spark, sf_dir, "part")
    name = F.concat(F.lit("ABCDEF+"), F.when(F.col("p_size") % 4 == 0, "Shree-Dev-").when(F.col("p_size") % 4 == 1, "KrutiDev ").when(F.col("p_size") % 4 == 2, "Man").otherwise("Ramdhenu"), F.col("p_brand"))
    return part.select("p_partkey", garble.font_pack(F.array(F.col("p_type"), name)).alias("pack"))


@query(O.GARBLE)
def garble_summary(spark, sf_dir):
    s = garble.signals(inputs.variants(spark, sf_dir))
    return s.groupBy("variant").agg(F.count("*").alias("n"), *[F.count_if(k).alias(k) for k in ("latin1", "ascii_glyphs", "broken_cmap", "symbol_glyphs", "garbled", "suspect")])


@query(O.SCRIPT)
def script_ratio(spark, sf_dir):
    best = garble.best_script(F.col("text"), F.array(F.lit("hin"), F.lit("tel"), F.lit("mar"), F.lit("xyz")))
    return inputs.variants(spark, sf_dir).select("doc_id", "variant", best.alias("b")).select("doc_id", "variant", F.col("b.ratio").alias("ratio"), F.col("b.pack").alias("pack"), (F.col("b.ratio") >= ocr.LEAST_RATIO).alias("accepted"))


@query(O.OCR_TEXT)
def ocr_text_gate(spark, sf_dir):
    t = X.without_markup(F.concat(F.lit("<b>"), F.col("text"), F.lit("</b><br>x")))
    return docs(spark, sf_dir).select("doc_id", X.plausible(t).alias("plausible"), X.plausible(F.regexp_replace("text", "[a-m]", "1")).alias("damaged"), X.figure(t).alias("shown"))


@query(f"SELECT source, page, sum(length(text)) AS raw_length, array_to_string(list_sort(list(DISTINCT font)), ',') AS fonts, count(*) AS n FROM ({inputs.SQL_ITEMS}) GROUP BY source, page")
def page_items(spark, sf_dir):
    i = inputs.items(spark, sf_dir)
    return i.groupBy("source", "page").agg(F.sum(F.length("text")).alias("raw_length"), F.array_join(F.array_sort(F.collect_set("font")), ",").alias("fonts"), F.count("*").alias("n"))


@query(O.PAGES)
def page_decision(spark, sf_dir):
    f = layout.page_facts(inputs.items(spark, sf_dir).withColumn("fonts", F.array("font")))
    return f.select("source", "page", "raw_length", "scanned", "judged", F.md5("text").alias("text_md5"), garble.font_pack(F.col("fonts")).alias("pack"))


@query(O.COLUMNS)
def column_detect(spark, sf_dir):
    return layout.columns(inputs.items(spark, sf_dir))


@query(O.ORDER)
def reading_order(spark, sf_dir):
    return layout.ordered(inputs.items(spark, sf_dir)).select("source", "page", "idx", F.col("col").cast("long").alias("col"), F.col("seq").cast("long").alias("seq"))


@query(O.SIZES)
def font_histogram(spark, sf_dir):
    f = layout.font_sizes(inputs.items(spark, sf_dir))
    return f.select("source", F.col("body").cast("double").alias("body"), F.array_join(F.transform("heading_sizes", lambda s: s.cast("int").cast("string")), ",").alias("heading_sizes"))


@query(O.MARGINS)
def boilerplate(spark, sf_dir):
    return layout.running_margins(inputs.items(spark, sf_dir))


@query(O.WITHOUT_MARGINS)
def boilerplate_removed(spark, sf_dir):
    return layout.without_margins(inputs.items(spark, sf_dir)).select("source", "page", "idx")


@query(O.CLASSES)
def classify_elements(spark, sf_dir):
    return layout.classified(inputs.items(spark, sf_dir)).select("source", "idx", "type", F.col("level").cast("long").alias("level"), "text")


@query()
def layout_chunks(spark, sf_dir):
    """Items of pages to chunks: margins off, reading order, classes, packing."""
    return structure.chunks(layout.documents(inputs.items(spark, sf_dir)))


def boxes(items: DataFrame) -> DataFrame:
    return items.where("idx % 20 = 5 and doc_id % 3 = 0").select("source", "page", F.lit(40.0).alias("x0"), F.lit(100.0).alias("y0"), F.lit(300.0).alias("x1"), (F.lit(200.0) + F.col("size") * 5).alias("y1"))


@query(O.OUTSIDE)
def table_anti_overlap(spark, sf_dir):
    i = inputs.items(spark, sf_dir)
    return layout.outside_tables(i, boxes(i)).select("source", "page", "idx")


@query(O.BOXES)
def table_dedup(spark, sf_dir):
    b = lambda k, x, y, w, h: F.struct(F.lit(k).alias("k"), *[e.cast("double").alias(n) for n, e in (("x0", x), ("y0", y), ("x1", x + w), ("y1", y + h))])
    size, key = F.col("p_size"), F.col("p_partkey")
    all_ = F.array(b(1, F.lit(0), F.lit(0), F.lit(40), F.lit(40)), b(2, size, F.lit(0), F.lit(30), F.lit(40)), b(3, F.lit(0), key % 50, F.lit(50), F.lit(30)))
    return inputs.table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(layout.distinct_boxes(all_), lambda s: s["k"].cast("string")), ",").alias("kept"))


@query(O.REAL)
def real_table(spark, sf_dir):
    t = inputs.order_tables(spark, sf_dir).withColumn("t", tables.normalized(F.col("headers"), F.col("tbl_rows")))
    return t.select("l_orderkey", F.size("t.rows").cast("long").alias("n_rows"), tables.is_real(F.col("t.headers"), F.col("t.rows")).alias("is_real"))


@query(O.MARKDOWN)
def table_markdown(spark, sf_dir):
    t = inputs.order_tables(spark, sf_dir)
    return t.select("l_orderkey", tables.markdown(F.col("headers"), F.col("tbl_rows")).alias("markdown"), tables.markdown(F.col("headers"), F.col("tbl_rows"), F.lit(1)).alias("card"))


@query(O.GROUPS)
def table_chunks(spark, sf_dir):
    t = inputs.order_tables(spark, sf_dir)
    tbl = F.struct("headers", F.col("tbl_rows").alias("rows"))
    parts = t.select("l_orderkey", F.posexplode(structure.table_parts(tbl, 30)).alias("k", "p"))
    return parts.select("l_orderkey", F.col("k").cast("long").alias("k"), F.col("p.part").cast("long").alias("part"), F.size("p.tbl.rows").cast("long").alias("n_rows"), (F.size("p.tbl.rows") < 2).alias("low_rows"), structure.table_text(F.array(F.lit("Orders")), F.col("p.tbl"), F.col("p.part")).alias("text"))


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = inputs.table(spark, sf_dir, "conversations")
    e = F.struct(F.when(F.length("text") % 2 == 0, "heading").otherwise("paragraph").alias("type"), F.concat(F.col("role"), (F.length("text") % 3).cast("string")).alias("text"), (F.length("text") % 5 % 3 + 1).alias("level"))
    return c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.length("text"), e.alias("e")))), lambda x: x["e"]).alias("elements"))


@query(O.CRUMBS)
def breadcrumb(spark, sf_dir):
    h = headings(spark, sf_dir)
    at = h.select("conv_id", "elements", F.explode(F.sequence(F.lit(1), F.size("elements"))).alias("seq"))
    path = X.section_path(structure.title(F.col("elements"), F.lit("file")), structure.crumbs_at(F.col("elements"), F.col("seq")))
    return at.select("conv_id", F.col("seq").cast("long").alias("seq"), F.array_join(path, X.BREADCRUMB).alias("path"))


@query("SELECT conv_id, turn AS seq, sum(CASE WHEN length(text) % 4 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM conversations")
def segments_ordinal(spark, sf_dir):
    e = inputs.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("source"), F.col("turn").alias("seq"), F.when(F.length("text") % 4 == 0, "heading").otherwise("paragraph").alias("type"))
    return structure.segments(e).select(F.col("source").alias("conv_id"), "seq", "segment")


@query()
def merge_small(spark, sf_dir):
    c = inputs.table(spark, sf_dir, "conversations")
    rows = c.select(
        X.stable_id(F.col("conv_id").cast("string"), F.lit(""), F.col("turn")).alias("chunk_id"), F.concat(F.lit("talk\n\n"), F.col("text")).alias("text"), F.col("conv_id").cast("string").alias("source"), F.lit("txt").alias("doc_type"), F.lit("structure").alias("strategy"),
        F.col("turn").cast("int").alias("ordinal"), F.array(F.lit("talk")).alias("section_path"), F.lit("talk").alias("heading"), (F.col("turn") + 1).cast("int").alias("page"), F.array((F.col("turn") + 1).cast("int")).alias("pages"), F.lit("talk").alias("filename"),
        F.lit(None).cast("boolean").alias("is_table"), F.lit(None).cast("array<int>").alias("table_shape"), F.lit(None).cast("boolean").alias("low_rows"),
    )
    return structure.merged(rows, least=48, budget=60)


@query(O.CHUNK_TEXT)
def chunk_text_render(spark, sf_dir):
    path = F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("lang", F.lit(""), "source"))
    return docs(spark, sf_dir).select("doc_id", X.chunk_text(path, F.col("text")).alias("text"))


@query(O.ENRICH)
def enrich_pages(spark, sf_dir):
    pages = inputs.turns(spark, sf_dir)
    chunks = pages.groupBy("source", F.floor((F.col("page") - 1) / 2).alias("chunk")).agg(F.array_sort(F.collect_set("page")).alias("pages"))
    return enrich.with_page_facts(chunks, pages).select("source", "chunk", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"), "ocr_used", "garble_suspected", "ocr_engine")


@query(f"SELECT source, array_to_string(list_sort(list(DISTINCT page) FILTER (ocr_used)), ',') AS ocr_pages, array_to_string(list_sort(list(DISTINCT page) FILTER (garble_suspect)), ',') AS suspect_pages, sum(n_fig)::BIGINT AS figure_count_raw FROM ({inputs.SQL_TURNS}) GROUP BY source")
def document_pages(spark, sf_dir):
    f = enrich.facts_by_source(inputs.turns(spark, sf_dir))
    joined = lambda c: F.nullif(F.array_join(F.transform(c, lambda p: p.cast("string")), ","), F.lit("")).alias(c)
    return f.select("source", joined("ocr_pages"), joined("suspect_pages"), "figure_count_raw")


@query(O.SUMMARY)
def doc_summary(spark, sf_dir):
    e = inputs.structured(spark, sf_dir).select(F.col("doc_id").alias("source"), F.explode(structure.elements_of(F.col("text"))).alias("e")).select("source", "e.type")
    s = enrich.type_counts(e)
    return s.select(F.col("source").alias("doc_id"), "n", F.try_element_at("counts", F.lit("heading")).alias("headings"), F.try_element_at("counts", F.lit("paragraph")).alias("paragraphs"))


@query(O.STATS)
def ingest_stats(spark, sf_dir):
    p = inputs.paths(spark, sf_dir)
    found = p.select(F.col("path").alias("source"), F.when(~files.supported(F.col("path")), "unsupported").alias("error"))
    chunks = p.where(files.supported(F.col("path"))).select(F.col("path").alias("source"), F.explode(F.sequence(F.lit(1), (F.col("doc_id") % 3 + 1).cast("int"))))
    return enrich.run_stats(found, chunks.where("col > 1")).select("files_seen", "files_parsed", "files_failed", "chunks", F.md5(F.array_join("errors", ",")).alias("errors"))


@query(O.PATHS)
def path_filter(spark, sf_dir):
    path = F.col("path")
    out = inputs.paths(spark, sf_dir).where(files.supported(path) & ~files.underscored(F.replace(path, F.lit("/in/"), F.lit(""))))
    return out.select("doc_id", "path", files.doc_type(path).alias("doc_type"), F.array_join(files.in_order(path), "!").alias("sort_key"))


@query(O.RECOVER)
def ocr_plan_recover(spark, sf_dir):
    p = ocr.recover_plan(inputs.page_facts(spark, sf_dir))
    return p.select("page_id", "script", F.array_join("verify", ",").alias("verify"), ocr.bilingual(F.col("script"), F.col("installed")).alias("request"))


@query(O.SCANNED)
def ocr_plan_scanned(spark, sf_dir):
    p = ocr.scanned_plan(inputs.page_facts(spark, sf_dir))
    return p.select("page_id", F.array_join("attempts", ",").alias("attempts"), F.array_join("verify", ",").alias("verify"))


@query(O.CACHE)
def ocr_cache_split(spark, sf_dir):
    pages = inputs.table(spark, sf_dir, "pages")
    want = pages.select("page_id", F.sha1(F.concat_ws("\x1f", F.col("html"), F.lit("stub:1"), F.lit("tel+eng"))).alias("digest"))
    cache = want.where("page_id % 3 = 0").select("digest", F.when(F.col("page_id") % 2 == 0, "text").otherwise("").alias("text"), F.lit("stub").alias("engine"))
    hit, miss = ocr.cache_split(want, cache)
    out = hit.select("page_id", "digest", F.col("cached").alias("cached")).unionByName(miss.select("page_id", "digest", F.lit(None).cast("string").alias("cached")))
    return out.withColumn("path", ocr.cache_path(F.col("digest"), F.lit("stub:1"), F.lit("tel+eng"))).select("page_id", "cached", "path")


@query(O.RANK)
def ocr_engine_rank(spark, sf_dir):
    grid = inputs.page_facts(spark, sf_dir).select("page_id", F.when(F.col("page_id") % 2 == 0, "tel+eng").otherwise("hin+kan").alias("script"), F.posexplode(F.array(F.array(F.lit("tel")), F.array(F.lit("eng"), F.lit("tel"), F.lit("hin")), F.array(F.lit("kan")))).alias("pos", "packs"))
    from pyspark.sql import Window

    parts = F.split("script", r"\+")
    g = grid.withColumn("covers", F.size(F.array_intersect(parts, "packs"))).withColumn("whole", ocr.covered(F.col("script"), F.col("packs")).cast("int"))
    at = Window.partitionBy("page_id")
    g = g.withColumn("most", F.max("covers").over(at)).where("covers > 0 or most = 0")
    return g.select("page_id", F.col("pos").cast("long").alias("pos"), F.row_number().over(at.orderBy(F.desc("whole"), F.desc("covers"), "pos")).cast("long").alias("rank"))


@query(O.EXECUTE)
def ocr_execute(spark, sf_dir):
    """Results of all attempts, as a stub engine gives them: judged, and the first accepted of each page."""
    plans = ocr.scanned_plan(inputs.page_facts(spark, sf_dir)).select("page_id", "verify", F.posexplode("attempts").alias("attempt", "script"))
    text = F.when(F.col("page_id") % 4 == 0, "").when(F.col("script").contains("tel"), inputs.TELUGU).when(F.col("script").contains("hin"), inputs.DEVANAGARI + "abcdefghij").otherwise("plain words only")
    done = ocr.judged(plans.withColumn("ocr_text", text).withColumn("ocr_engine", F.lit("stub")))
    return ocr.settled(done).select("page_id", "ocr_text", "detected", F.round("confidence", 6).alias("confidence"))


@query("SELECT page_id, CASE WHEN f = ['te'] THEN 'tel' WHEN f = ['hi'] THEN 'hin' END AS pack FROM (SELECT page_id, list_distinct(list_filter(string_split(langs, ','), lambda x: x NOT IN ('', 'en'))) AS f FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'en,te' WHEN 1 THEN 'hi,en,hi' WHEN 2 THEN 'te,hi' ELSE 'en' END AS langs FROM pages))")
def pin_script(spark, sf_dir):
    """The one pack of pages' declared languages, where exactly one beside English is declared."""
    declared = F.expr("split(CASE page_id % 4 WHEN 0 THEN 'en,te' WHEN 1 THEN 'hi,en,hi' WHEN 2 THEN 'te,hi' ELSE 'en' END, ',')")
    return inputs.table(spark, sf_dir, "pages").select("page_id", languages.pinned(declared).alias("pack"))


@query(O.JSONL)
def jsonl_projection(spark, sf_dir):
    d = docs(spark, sf_dir).select(F.concat(F.lit("c_"), F.col("doc_id")).alias("chunk_id"), F.col("text"), F.col("source"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("int")).alias("page"), F.col("lang").alias("language"))
    r = structure.records(d)
    return r.select("chunk_id", "text", F.to_json("metadata").alias("metadata"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
