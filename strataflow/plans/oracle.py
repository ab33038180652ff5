"""DuckDB SQL of the queries, written apart from the Spark expressions."""

from __future__ import annotations

from strataflow.functions.garble import ATTACHED, FONTS, INDIC, MARKS, NEVER, SCRIPTS, chars, escaped
from strataflow.functions.languages import ALIASES, PACKS, REGISTRY
from strataflow.plans.inputs import DEVANAGARI, SELECT_FACTS, SELECT_VARIANTS, SQL_ITEMS, SQL_PATHS, SQL_STRUCTURED, SQL_TABLES, SQL_TURNS, TELUGU

V = f"v AS ({SELECT_VARIANTS})"
WS = r"[\s\x{A0}\x{85}\p{Z}\x{0B}\x{1C}-\x{1F}]"
COUNT = lambda p, t="text": f"length(regexp_replace({t}, '[^{p}]+', '', 'g'))"
MAP = lambda d: "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in d.items()) + "}"
WORDS = lambda t: f"list_filter(regexp_split_to_array({t}, '{WS}+'), lambda w: length(regexp_replace(w, '[^\\p{{L}}]', '', 'g')) >= 2)"
BLOCKS = [(x.iso, f"\\x{{{x.block:X}}}-\\x{{{x.block + 0x7F:X}}}") for x in REGISTRY if x.block]


def _best(rows: list[tuple[str, str]]) -> str:
    """The first code with the most characters."""
    top = "greatest(" + ", ".join(n for _, n in rows) + ")"
    return f"CASE WHEN {top} = 0 THEN NULL " + " ".join(f"WHEN {n} = {top} THEN '{iso}'" for iso, n in rows) + " END"


_CNT = ", ".join(f"{COUNT(b)} AS n_{iso}" for iso, b in BLOCKS) + f", {COUNT('A-Za-z')} AS n_en"
_ROWS = [("en", "n_en"), *[(i, f"n_{i}") for i, _ in BLOCKS]]
LANGUAGE = f"WITH {V}, c AS (SELECT doc_id, variant, {_CNT} FROM v) SELECT doc_id, variant, {_best(_ROWS)} AS dominant, {_best(_ROWS[1:])} AS foreign_language, coalesce({_best([r for r in _ROWS if r[0] in ('en', 'hi', 'ta')])}, 'hi') AS tag FROM c"
_ALIAS = MAP(ALIASES)
ALIAS = f"""
SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '+') AS codes, {_ALIAS}[lower(trim(lang))] AS code
FROM (SELECT doc_id, lang, list_filter(list_transform(regexp_split_to_array(names, '[,/]'), lambda x: {_ALIAS}[lower(trim(x))]), lambda x: x IS NOT NULL) AS l
  FROM (SELECT doc_id, lang, concat_ws(',', upper(lang), CASE doc_id % 3 WHEN 0 THEN ' Bangla ' WHEN 1 THEN 'tel/Odia' END, lang) AS names FROM documents))
"""
F_ = f"f AS (SELECT *, list_filter(string_split(lang_list, ','), lambda x: x <> '') AS langs, string_split(installed_list, ',') AS installed FROM ({SELECT_FACTS}))"
_PACKS = MAP(PACKS)
_OWNERS: dict[str, str] = {}
for _x in REGISTRY:
    _OWNERS.setdefault(_x.osd.lower(), _x.iso)
_OSD_OF = lambda c: MAP({x.iso: x.osd.lower() for x in REGISTRY}) + f"[{c}]"
_ISO = lambda cands: f"coalesce(list_filter({cands}, lambda x: {_OSD_OF('x')} = lower(osd))[1], {MAP(_OWNERS)}[lower(osd)])"
OSD = f"WITH {F_}, g AS (SELECT page_id, {_ISO('langs')} AS iso FROM f) SELECT page_id, iso, {_PACKS}[iso] AS pack, {MAP({x.iso: x.name for x in REGISTRY})}[iso] AS name FROM g"

_SPLIT = f"list_filter(string_split(regexp_replace(text, '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '{WS}', '', 'g') <> '')"
SENTENCES = f"SELECT doc_id, i - 1 AS pos, s AS sentence FROM (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, {_SPLIT} AS l FROM documents))"
_STRIP = lambda t: f"regexp_replace(regexp_replace({t}, '^{WS}+', ''), '{WS}+$', '')"
TAIL = f"""
WITH s AS (SELECT doc_id, pos, sentence, greatest(1, length(sentence) // 4) AS n FROM ({SENTENCES})),
r AS (SELECT *, sum(n) OVER w AS total, row_number() OVER w AS k FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY pos DESC ROWS UNBOUNDED PRECEDING))
SELECT d.doc_id, coalesce(t.tail, '') AS tail FROM documents d LEFT JOIN (SELECT doc_id, string_agg({_STRIP('sentence')}, '~' ORDER BY pos) AS tail FROM r WHERE total <= 60 OR k = 1 GROUP BY doc_id) t USING (doc_id)
"""
_E = f"""
st AS ({SQL_STRUCTURED}),
ln AS (SELECT doc_id, i, {_STRIP('line')} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM st)),
hd AS (SELECT *, starts_with(line, '===') AND ends_with(line, '===') AND length(line) > 6 AS head FROM ln),
gr AS (SELECT *, sum(CASE WHEN head OR line = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM hd),
el AS (
  SELECT doc_id, i, 'heading' AS type, trim(trim(line, '= ')) AS text, 1 AS level FROM gr WHERE head
  UNION ALL SELECT doc_id, min(i), 'paragraph', trim(regexp_replace(string_agg(line, ' ' ORDER BY i), '{WS}+', ' ', 'g')), 0 FROM gr WHERE NOT head AND line <> '' GROUP BY doc_id, g
), e AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS seq, type, text, level FROM el)
"""
ELEMENTS = f"WITH {_E} SELECT doc_id, seq, type, text, CAST(level AS BIGINT) AS level FROM e"
PACK = f"""
WITH RECURSIVE {_E},
t AS (SELECT *, greatest(1, length(text) // 4) AS n, max(CASE WHEN type = 'heading' THEN seq END) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS h FROM e WHERE text <> ''),
p AS (SELECT doc_id, h, n, text, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS k FROM t WHERE type = 'paragraph'),
w AS (
  SELECT doc_id, k, h, n, n AS held, 0 AS c FROM p WHERE k = 1
  UNION ALL SELECT p.doc_id, p.k, p.h, p.n, CASE WHEN p.h IS DISTINCT FROM w.h OR w.held + p.n > 400 THEN p.n ELSE w.held + p.n END, CASE WHEN p.h IS DISTINCT FROM w.h OR w.held + p.n > 400 THEN w.c + 1 ELSE w.c END
  FROM w JOIN p ON p.doc_id = w.doc_id AND p.k = w.k + 1
), title AS (SELECT doc_id, arg_min(text, seq) AS title FROM e WHERE type = 'heading' AND text <> '' GROUP BY doc_id),
ch AS (SELECT w.doc_id, w.c, any_value(w.h) AS h, string_agg(p.text, chr(10) ORDER BY w.k) AS body FROM w JOIN p ON p.doc_id = w.doc_id AND p.k = w.k GROUP BY w.doc_id, w.c),
f AS (SELECT ch.doc_id, ch.c, ch.body, coalesce(title, ch.doc_id || '.txt') AS title, e.text AS head FROM ch LEFT JOIN title USING (doc_id) LEFT JOIN e ON e.doc_id = ch.doc_id AND e.seq = ch.h),
q AS (SELECT *, CASE WHEN head IS NULL OR head = title THEN [title] ELSE [title, head] END AS path FROM f),
x AS (SELECT *, array_to_string(path, ' › ') || chr(10) || chr(10) || body AS full_text FROM q)
SELECT concat('c_', substr(sha1(concat_ws(chr(31), 'doc://' || doc_id, array_to_string(path, ' / '), c)), 1, 16)) AS chunk_id, full_text AS text, 'doc://' || doc_id AS source, c AS ordinal, path[-1] AS heading, array_to_string(path, '/') AS path,
  CASE WHEN regexp_matches(full_text, '[A-Za-z]') THEN 'en' ELSE 'en' END AS language FROM x
"""
_L = COUNT(r"\p{L}")
_ACC = COUNT(r"\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}")
LATIN1 = f"WITH {V} SELECT doc_id, variant, CASE WHEN {_L} = 0 THEN 0.0::DOUBLE ELSE {_ACC} / {_L} END AS ratio, CASE WHEN {_L} = 0 THEN false ELSE {_ACC} / {_L} >= 0.4 END AS latin1 FROM v"
_G = f"""gw AS (SELECT doc_id, variant, w, count(*) AS k FROM (SELECT doc_id, variant, unnest(regexp_split_to_array(text, '{WS}+')) AS w FROM v) WHERE regexp_matches(w, '[A-Za-z]') GROUP BY ALL),
gd AS (SELECT w, regexp_matches(w, '[A-Za-z][;:][A-Za-z]') AS sp, length(regexp_replace(w, '[^\\p{{L}}]+', '', 'g')) >= 2 AND NOT regexp_matches(w, '[aeiouAEIOU]') AS ba FROM (SELECT DISTINCT w FROM gw)),
gs AS (SELECT doc_id, variant, sum(k) AS n, coalesce(sum(k) FILTER (sp), 0) AS spiked, coalesce(sum(k) FILTER (ba), 0) AS bare FROM gw JOIN gd USING (w) GROUP BY ALL),
g AS (SELECT doc_id, variant, text, {_L} AS l, {COUNT('A-Za-z')} AS a, {COUNT('aeiouAEIOU')} AS vowels, {COUNT('A-Z')} AS uppers, {COUNT(r'\p{Nd}')} AS digits, {COUNT(r'\p{L}\p{N}')} AS alnum, coalesce(n, 0) AS n, coalesce(spiked, 0) AS spiked, coalesce(bare, 0) AS bare FROM v LEFT JOIN gs USING (doc_id, variant))"""
_GOK = "coalesce(l > 0 AND a / l >= 0.85 AND n >= 8 AND vowels / a < 0.35 AND (spiked / n >= 0.15 OR (bare / n >= 0.4 AND (alnum = 0 OR digits / alnum < 0.1) AND uppers / a < 0.3)), false)"
GLYPHS = f"WITH {V}, {_G} SELECT doc_id, variant, {_GOK} AS ascii_glyphs FROM g"
_SKIP = chars(SCRIPTS["latin"]) + chars(SCRIPTS["notation"])
_OTHER = "".join(chars(r) for r in SCRIPTS.values())
_SETS = [f"[{chars(r)}]" for s, r in SCRIPTS.items() if s not in ("latin", "notation")] + [f"[^{_OTHER}]"]
_IND = "".join(chars(SCRIPTS[s]) for s in INDIC)
_NL = f"regexp_replace(regexp_replace(w, '[^\\p{{L}}]', '', 'g'), '[{_SKIP}]', '', 'g')"
_MIXED = " + ".join(f"regexp_matches({_NL}, '{c}')::INT" for c in _SETS)
_BAD = f"(contains(w, chr(65533)) OR regexp_matches(w, '\\p{{Co}}') OR regexp_matches(w, '(^|[{_IND}])\\P{{L}}*[{chars(MARKS)}]') OR ({_MIXED}) >= 2)"
_SPL = f"(regexp_matches(w, '[{_IND}][{escaped(NEVER)}]|[{escaped(NEVER)}][{_IND}]') OR regexp_matches(regexp_replace(w, '[{escaped(ATTACHED)}]', 'a', 'g'), '[{_IND}][\\p{{P}}\\p{{S}}][{_IND}]'))"
_C0 = f"""n AS (SELECT doc_id, variant, nfc_normalize(text) AS text FROM v),
ct AS (SELECT doc_id, variant, {_L} AS letters, {COUNT(r'\p{Co}')} AS pua, {COUNT(r'\x{FFFD}')} AS fffd FROM n),
wc AS (SELECT doc_id, variant, w, count(*) AS k FROM (SELECT doc_id, variant, unnest(regexp_split_to_array(text, '{WS}+')) AS w FROM n) GROUP BY ALL),
dw AS (SELECT w, regexp_matches(w, '[^\\x00-\\x{{2FF}}]') AS high FROM (SELECT DISTINCT w FROM wc) WHERE length(regexp_replace(w, '[^\\p{{L}}]+', '', 'g')) >= 2),
fl AS (SELECT w, CASE WHEN high THEN {_BAD} ELSE false END AS bad, CASE WHEN high THEN {_SPL} ELSE false END AS spl FROM dw),
wd AS (SELECT doc_id, variant, sum(k) AS words, coalesce(sum(k) FILTER (bad), 0) AS corrupt, coalesce(sum(k) FILTER (spl), 0) AS spliced FROM wc JOIN fl USING (w) GROUP BY ALL),
c AS (SELECT doc_id, variant, coalesce(words, 0)::BIGINT AS words, coalesce(corrupt, 0)::BIGINT AS corrupt, coalesce(spliced, 0)::BIGINT AS spliced, letters, pua, fffd FROM ct LEFT JOIN wd USING (doc_id, variant))"""
_FLOOR = lambda a, b, c, d, e: f"(fffd >= {a} OR (pua >= {b} AND pua / greatest(1, pua + letters) >= {c}) OR (words >= 8 AND corrupt >= {d} AND corrupt / words >= {e}))"
_SYM = lambda a, b: f"(words >= 8 AND spliced >= {a} AND spliced / words >= {b})"
CMAP = f"WITH {V}, {_C0} SELECT doc_id, variant, corrupt, words, letters, pua, fffd, {_FLOOR(4, 20, 0.3, 4, 0.15)} AS broken_cmap FROM c"
SPLICE = f"WITH {V}, {_C0} SELECT doc_id, variant, spliced, {_SYM(4, 0.08)} AS symbol_glyphs, {_FLOOR(2, 8, 0.1, 2, 0.05)} OR {_SYM(2, 0.03)} AS suspect FROM c"
GARBLE = f"""
WITH {V}, {_G}, {_C0}, s AS (
  SELECT variant, l > 0 AND {_ACC} / l >= 0.4 AS latin1, {_GOK} AS ascii_glyphs, {_FLOOR(4, 20, 0.3, 4, 0.15)} AS broken_cmap, {_SYM(4, 0.08)} AS symbol_glyphs, {_FLOOR(2, 8, 0.1, 2, 0.05)} OR {_SYM(2, 0.03)} AS low
  FROM g JOIN c USING (doc_id, variant)
)
SELECT variant, count(*) AS n, count_if(latin1)::BIGINT AS latin1, count_if(ascii_glyphs)::BIGINT AS ascii_glyphs, count_if(broken_cmap)::BIGINT AS broken_cmap, count_if(symbol_glyphs)::BIGINT AS symbol_glyphs,
  count_if(latin1 OR ascii_glyphs OR broken_cmap OR symbol_glyphs)::BIGINT AS garbled, count_if(latin1 OR ascii_glyphs OR broken_cmap OR symbol_glyphs OR low)::BIGINT AS suspect FROM s GROUP BY variant
"""
FONTS_NAME = "'ABCDEF+' || CASE p_size % 4 WHEN 0 THEN 'Shree-Dev-' WHEN 1 THEN 'KrutiDev ' WHEN 2 THEN 'Man' ELSE 'Ramdhenu' END || p_brand"
_FONT_OF = lambda e: "CASE " + " ".join(f"WHEN contains(lower(regexp_replace({e}, '^[^+]*[+]', '')), '{p}') THEN '{k}'" for p, k in FONTS) + " END"
FONTS_OUT = f"WITH n AS (SELECT p_partkey, least(p_type, {FONTS_NAME}) AS a, greatest(p_type, {FONTS_NAME}) AS b FROM part) SELECT p_partkey, coalesce({_FONT_OF('a')}, {_FONT_OF('b')}) AS pack FROM n"
_R = lambda b: f"CASE WHEN {_L} = 0 THEN 0.0::DOUBLE ELSE {COUNT(b)} / {_L} END"
SCRIPT = f"WITH {V}, r AS (SELECT doc_id, variant, {_R(r'\x{900}-\x{97F}')} AS d, {_R(r'\x{C00}-\x{C7F}')} AS t FROM v) SELECT doc_id, variant, greatest(d, t) AS ratio, CASE WHEN t > d THEN 'tel' ELSE 'hin' END AS pack, greatest(d, t) >= 0.3 AS accepted FROM r"
_PLAUS = lambda t: f"(length({t}) >= 12 AND len(list_filter(regexp_split_to_array({t}, '{WS}+'), lambda w: length(regexp_replace(w, '[^\\p{{L}}]', '', 'g')) >= 3)) >= 3 AND length(regexp_replace({t}, '[^\\p{{L}}\\s\\x{{A0}}\\x{{85}}\\p{{Z}}\\x{{0B}}\\x{{1C}}-\\x{{1F}}]', '', 'g')) / length({t}) >= 0.55)"
OCR_TEXT = f"WITH t AS (SELECT doc_id, trim(text || chr(10) || 'x', ' ') AS shown, {_STRIP("text || chr(10) || 'x'")} AS a, {_STRIP("regexp_replace(text, '[a-m]', '1', 'g')")} AS b FROM documents) SELECT doc_id, {_PLAUS('a')} AS plausible, {_PLAUS('b')} AS damaged, '[Figure] ' || shown AS shown FROM t"
IT = f"it AS ({SQL_ITEMS})"
PAGES = f"""
WITH {IT}, p AS (SELECT source, page, idx, font, text FROM it),
f AS (SELECT source, page, sum(length(text))::BIGINT AS raw_length, trim(string_agg(text, ' ' ORDER BY idx) FILTER (trim(text) <> '')) AS text, bool_or(contains(font, 'SHREE')) AS tel FROM p GROUP BY source, page)
SELECT source, page, raw_length, raw_length < 20 AS scanned, length(coalesce(text, '')) >= 20 AS judged, md5(coalesce(text, '')) AS text_md5, CASE WHEN tel THEN 'tel' END AS pack FROM f
"""
_TWO = "count(*) >= 6 AND count(*) FILTER (x0 < 306) >= 3 AND count(*) FILTER (x0 >= 306) >= 3 AND min(x0) FILTER (x0 >= 306) - max(x0) FILTER (x0 < 306) > 36.72"
COLUMNS = f"WITH {IT} SELECT source, page, coalesce({_TWO}, false) AS two_columns FROM it GROUP BY source, page"
_ORD = f"{IT}, two AS (SELECT source, page, coalesce({_TWO}, false) AS two FROM it GROUP BY source, page), od AS (SELECT it.*, CASE WHEN two AND x0 >= 306 THEN 1 ELSE 0 END AS col FROM it JOIN two USING (source, page))"
ORDER = f"WITH {_ORD} SELECT source, page, idx, col::BIGINT AS col, row_number() OVER (PARTITION BY source, page ORDER BY col, round_even(y0 / 4, 0), x0, idx) - 1 AS seq FROM od"
_SZ = "hs AS (SELECT source, round_even(size, 0) AS s, sum(length(text)) AS n, min(idx) AS first FROM it WHERE size > 0 GROUP BY ALL), bd AS (SELECT source, s AS body FROM hs QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, first) = 1), hz AS (SELECT source, body, coalesce(list(s ORDER BY s DESC) FILTER (s >= body * 1.15), [])[1:4] AS sizes FROM hs JOIN bd USING (source) GROUP BY source, body)"
SIZES = f"WITH {IT}, {_SZ} SELECT source, body, array_to_string(list_transform(sizes, lambda s: CAST(s AS INT)), ',') AS heading_sizes FROM hz"
_NORM = f"substr(trim(regexp_replace(regexp_replace(lower(text), '\\p{{Nd}}+', '#', 'g'), '{WS}+', ' ', 'g')), 1, 80)"
_MARGIN = "(y1 <= 79.2 OR y0 >= 792 * 0.9)"
_BP = f"bp AS (SELECT source, norm FROM (SELECT source, {_NORM} AS norm, page FROM it WHERE {_MARGIN}) JOIN (SELECT source, count(DISTINCT page) AS pages FROM it GROUP BY source) USING (source) WHERE length(norm) >= 3 GROUP BY source, norm, pages HAVING pages >= 3 AND count(DISTINCT page) >= greatest(3, floor(pages * 0.4)))"
MARGINS = f"WITH {IT}, {_BP} SELECT source, norm FROM bp"
WITHOUT_MARGINS = f"WITH {IT}, {_BP} SELECT source, page, idx FROM it WHERE NOT ({_MARGIN} AND (source, {_NORM}) IN (SELECT source, norm FROM bp))"
CLASSES = f"""
WITH {IT}, {_SZ}, c AS (SELECT source, idx, size, bold, body, sizes, trim(regexp_replace(text, '{WS}+', ' ', 'g')) AS text FROM it JOIN hz USING (source)),
l AS (SELECT *, list_filter(list_transform(sizes, lambda h, i: CASE WHEN size >= h - 0.5 THEN i END), lambda x: x IS NOT NULL)[1] AS lv FROM c WHERE text <> ''),
k AS (SELECT *, CASE WHEN lv IS NOT NULL AND length(text) <= 160 THEN lv WHEN lv IS NULL AND bold AND length(text) <= 80 AND size >= body - 0.5 AND right(text, 1) NOT IN ('.', ',', ';', ':') THEN least(6, len(sizes) + 1) END AS head FROM l)
SELECT source, idx, CASE WHEN head IS NOT NULL THEN 'heading' WHEN left(text, 1) IN ('•', '-', '*', '·', '‣', '◦', '–') OR regexp_matches(text, '^[0-9]([.)]|$)') OR (regexp_matches(text, '^\\p{{L}}[.)]') AND length(text) > 2) THEN 'list_item' ELSE 'paragraph' END AS type, coalesce(head, 0)::BIGINT AS level, text FROM k
"""
OUTSIDE = f"WITH {IT}, b AS (SELECT source, page, 200.0 + size * 5 AS y FROM it WHERE idx % 20 = 5 AND doc_id % 3 = 0) SELECT source, page, idx FROM it WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.source = it.source AND b.page = it.page AND greatest(0, least(it.x1, 300) - greatest(it.x0, 40)) * greatest(0, least(it.y1, y) - greatest(it.y0, 100)) >= 0.3 * (it.x1 - it.x0) * (it.y1 - it.y0))"
_IN = lambda a, b: f"(greatest(0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * greatest(0, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0)) >= 0.5 * least(({a}.x1 - {a}.x0) * ({a}.y1 - {a}.y0), ({b}.x1 - {b}.x0) * ({b}.y1 - {b}.y0)))"
BOXES = f"""
WITH b AS (SELECT p_partkey, {{'x0': 0, 'y0': 0, 'x1': 40, 'y1': 40}} AS p, {{'x0': p_size, 'y0': 0, 'x1': p_size + 30, 'y1': 40}} AS q, {{'x0': 0, 'y0': p_partkey % 50, 'x1': 50, 'y1': p_partkey % 50 + 30}} AS r FROM part),
k AS (SELECT p_partkey, NOT {_IN('q', 'p')} AS two, NOT {_IN('r', 'p')} AS free, {_IN('r', 'q')} AS meets FROM b)
SELECT p_partkey, '1' || CASE WHEN two THEN ',2' ELSE '' END || CASE WHEN free AND NOT (two AND meets) THEN ',3' ELSE '' END AS kept FROM k
"""
TB = f"tb AS ({SQL_TABLES})"
REAL = f"""
WITH {TB}, n AS (SELECT l_orderkey, list_filter(tbl_rows, lambda r: len(list_filter(r, lambda c: trim(c) <> '')) > 0) AS b FROM tb), f AS (SELECT l_orderkey, b, flatten(b) AS cells FROM n),
z AS (SELECT l_orderkey, len(b) AS n_rows, list_max(list_transform(cells, lambda c: length(c))) AS longest, list_avg(list_transform(cells, lambda c: length(c))) AS mean, len(list_filter(cells, lambda c: trim(c) = '')) AS blanks, len(cells) AS n FROM f)
SELECT l_orderkey, n_rows, n_rows >= 1 AND longest <= 200 AND mean <= 80 AND blanks / n <= 0.6 AND (n_rows > 1 OR blanks = 0) AS is_real FROM z
"""
_MDROW = "'| ' || array_to_string(list_transform(r, lambda c: trim(regexp_replace(replace(c, '|', chr(92) || '|'), '\\s+', ' ', 'g'))), ' | ') || ' |'"
_HEAD = "'| line | part | col_3 | quantity |' || chr(10) || '| --- | --- | --- | --- |'"
_MD = lambda rows: f"{_HEAD} || chr(10) || array_to_string(list_transform({rows}, lambda r: {_MDROW}), chr(10))"
MARKDOWN = f"WITH {TB} SELECT l_orderkey, {_MD('tbl_rows')} AS markdown, {_MD('tbl_rows[1:1]')} || CASE WHEN len(tbl_rows) > 1 THEN chr(10) || '| … | … | … | … |' ELSE '' END AS card FROM tb"
GROUPS = f"""
WITH {TB}, m AS (SELECT l_orderkey, tbl_rows, len(tbl_rows) AS n, greatest(1, length({_MD('tbl_rows')}) // 4) AS t, greatest(1, length({_HEAD} || chr(10) || '| … | … | … | … |') // 4) AS h FROM tb),
g AS (SELECT *, CASE WHEN t <= 30 OR n <= 1 THEN n ELSE greatest(1, CAST(floor((30 - h) / greatest(1, floor((t - h) / n))) AS BIGINT)) END AS each FROM m),
p AS (SELECT *, unnest(range((n + each - 1) // each)) AS k FROM g),
s AS (SELECT *, tbl_rows[CAST(k * each + 1 AS BIGINT):CAST((k + 1) * each AS BIGINT)] AS part_rows FROM p)
SELECT l_orderkey, k::BIGINT AS k, CASE WHEN n > each THEN k + 1 END::BIGINT AS part, len(part_rows) AS n_rows, len(part_rows) < 2 AS low_rows,
  'Orders' || chr(10) || chr(10) || 'Table (' || len(part_rows) || '×4)' || CASE WHEN n > each THEN ' — part ' || CAST(k + 1 AS BIGINT) ELSE '' END || chr(10) || {_MD('part_rows')} AS text FROM s
"""
CRUMBS = """
WITH e AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(text)) AS seq, length(text) % 2 = 0 AS head, role || length(text) % 3 AS text, length(text) % 5 % 3 + 1 AS level FROM conversations),
title AS (SELECT conv_id, arg_min(text, seq) AS title FROM e WHERE head AND level = 1 GROUP BY conv_id),
open AS (SELECT a.conv_id, a.seq, h.seq AS spot, h.text FROM e a JOIN e h ON h.conv_id = a.conv_id AND h.seq <= a.seq AND h.head WHERE NOT EXISTS (SELECT 1 FROM e o WHERE o.conv_id = a.conv_id AND o.head AND o.seq > h.seq AND o.seq <= a.seq AND o.level <= h.level)),
path AS (SELECT conv_id, seq, 0 AS spot, coalesce(title, 'file') AS text FROM e LEFT JOIN title USING (conv_id) UNION ALL SELECT * FROM open),
kept AS (SELECT *, lag(text) OVER (PARTITION BY conv_id, seq ORDER BY spot) AS prior FROM path)
SELECT conv_id, seq, string_agg(text, ' › ' ORDER BY spot) AS path FROM kept WHERE prior IS DISTINCT FROM text GROUP BY conv_id, seq
"""
CHUNK_TEXT = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang || ' › ' || source || chr(10) || chr(10) END || text AS text FROM documents"
ENRICH = f"""
WITH t AS ({SQL_TURNS}), c AS (SELECT *, (page - 1) // 2 AS chunk FROM t)
SELECT source, chunk::BIGINT AS chunk, array_to_string(list_sort(list(DISTINCT page)), ',') AS pages, bool_or(ocr_used) AS ocr_used, bool_or(garble_suspect) AS garble_suspected, string_agg(DISTINCT ocr_engine, '+' ORDER BY ocr_engine) AS ocr_engine FROM c GROUP BY source, chunk
"""
SUMMARY = f"WITH {_E} SELECT doc_id, count(*) AS n, nullif(count_if(type = 'heading'), 0)::BIGINT AS headings, nullif(count_if(type = 'paragraph'), 0)::BIGINT AS paragraphs FROM e GROUP BY doc_id"
_EXT = "lower(regexp_extract(path, '[^/](\\.[^./]*)$', 1))"
_OK = f"{_EXT} IN ('.pdf', '.txt', '.png', '.jpg', '.jpeg', '.tif', '.tiff', '.bmp', '.webp')"
STATS = f"""
WITH p AS ({SQL_PATHS}), s AS (SELECT doc_id, path, {_OK} AS ok FROM p),
c AS (SELECT path, sum(CASE WHEN ok THEN doc_id % 3 ELSE 0 END) AS n FROM s GROUP BY path)
SELECT count(*) AS files_seen, count_if(ok)::BIGINT AS files_parsed, count_if(NOT ok)::BIGINT AS files_failed, coalesce(sum(n), 0)::BIGINT AS chunks, md5(coalesce(string_agg(CASE WHEN NOT ok THEN path || ': unsupported' END, ',' ORDER BY path || ': unsupported'), '')) AS errors FROM s JOIN c USING (path)
"""
PATHS = f"""
WITH p AS ({SQL_PATHS})
SELECT doc_id, path, CASE {_EXT} WHEN '.pdf' THEN 'pdf' WHEN '.txt' THEN 'txt' ELSE 'image' END AS doc_type, replace(path, '/', '!') AS sort_key FROM p
WHERE {_OK} AND NOT regexp_matches(path, '/_')
"""
_POOL = "CASE WHEN len(langs) > 0 THEN langs ELSE [" + ", ".join(f"'{x.iso}'" for x in REGISTRY) + "] END"
_PK = lambda l: f"list_filter(list_transform({l}, lambda x: {_PACKS}[x]), lambda x: x IS NOT NULL)"
_PLAN = f"""{F_}, g AS (SELECT *, {_PK('langs')} AS packs, list_filter({_POOL}, lambda x: list_contains(installed, {_PACKS}[x])) AS resolve FROM f),
o AS (SELECT *, list_filter(packs, lambda p: list_contains(installed, p)) AS cand, {_PACKS}[{_ISO('resolve')}] AS seen, {_PACKS}[{_ISO('langs')}] AS seen_langs FROM g)"""
_COVER = lambda s: f"len(list_filter(string_split({s}, '+'), lambda p: NOT list_contains(installed, p))) = 0"
RECOVER = f"""
WITH {_PLAN}, s AS (SELECT *, CASE WHEN font_pack IS NOT NULL AND (len(cand) = 0 OR list_contains(cand, font_pack)) THEN font_pack WHEN declared IS NOT NULL AND (len(cand) = 0 OR list_contains(cand, declared)) THEN declared
  WHEN len(resolve) > 0 AND seen IS NOT NULL THEN seen WHEN len(cand) > 0 THEN array_to_string(cand, '+') ELSE coalesce(font_pack, declared) END AS script FROM o),
k AS (SELECT *, garbled AND script IS NOT NULL AND {_COVER('script')} AS go FROM s)
SELECT page_id, CASE WHEN go THEN script END AS script, CASE WHEN go THEN array_to_string(CASE WHEN len(cand) > 0 THEN cand WHEN len(resolve) > 0 THEN {_PK('resolve')} ELSE [script] END, ',') END AS verify,
  CASE WHEN go THEN script || CASE WHEN list_contains(installed, 'eng') THEN '+eng' ELSE '' END END AS request FROM k
"""
_SC = f"""{_PLAN}, s AS (SELECT *, [CASE WHEN declared IS NOT NULL AND (len(packs) = 0 OR list_contains(packs, declared)) THEN declared END, CASE WHEN len(packs) > 0 THEN seen_langs WHEN len(resolve) > 0 THEN seen END, CASE WHEN len(packs) > 0 THEN array_to_string(packs, '+') END] AS tried FROM o),
u AS (SELECT *, list_filter(tried, lambda x: x IS NOT NULL AND {_COVER('x')}) AS able FROM s), a AS (SELECT *, list_filter(able, lambda x, i: list_position(able, x) = i) AS attempts FROM u),
pl AS (SELECT page_id, attempts, CASE WHEN len(packs) > 0 THEN packs WHEN len(resolve) > 0 THEN {_PK('resolve')} ELSE attempts END AS verify FROM a)"""
SCANNED = f"WITH {_SC} SELECT page_id, CASE WHEN len(attempts) > 0 THEN array_to_string(attempts, ',') END AS attempts, CASE WHEN len(attempts) > 0 THEN array_to_string(verify, ',') END AS verify FROM pl"
EXECUTE = f"""
WITH {_SC}, r AS (SELECT page_id, verify, unnest(attempts) AS script, generate_subscripts(attempts, 1) AS k FROM pl),
x AS (SELECT *, CASE WHEN page_id % 4 = 0 THEN '' WHEN contains(script, 'tel') THEN '{TELUGU}' WHEN contains(script, 'hin') THEN '{DEVANAGARI}abcdefghij' ELSE 'plain words only' END AS ocr_text FROM r),
b AS (SELECT *, list_filter(verify, lambda p: (ocr_text = '{TELUGU}' AND p = 'tel') OR (starts_with(ocr_text, '{DEVANAGARI[:3]}') AND p IN ('hin', 'mar')))[1] AS detected FROM x)
SELECT page_id, ocr_text, detected, CASE WHEN detected = 'tel' THEN 1.0::DOUBLE ELSE round(26 / 36, 6) END AS confidence FROM b WHERE detected IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY k) = 1
"""
CACHE = """
WITH q AS (SELECT page_id, sha1(concat_ws(chr(31), html, 'stub:1', 'tel+eng')) AS d FROM pages), c AS (SELECT DISTINCT d FROM q WHERE page_id % 6 = 0)
SELECT page_id, CASE WHEN c.d IS NOT NULL THEN 'text' END AS cached, 'stub_1/tel_eng/' || substr(q.d, 1, 2) || '/' || q.d AS path FROM q LEFT JOIN c ON q.d = c.d
"""
RANK = f"""
WITH {F_}, g AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'tel+eng' ELSE 'hin+kan' END AS script, unnest([0, 1, 2]) AS pos FROM f),
h AS (SELECT *, CASE pos WHEN 0 THEN ['tel'] WHEN 1 THEN ['eng', 'tel', 'hin'] ELSE ['kan'] END AS packs FROM g), k AS (SELECT *, len(list_intersect(string_split(script, '+'), packs)) AS covers FROM h)
SELECT page_id, pos::BIGINT AS pos, row_number() OVER (PARTITION BY page_id ORDER BY covers DESC, pos) AS rank FROM k WHERE covers > 0
"""
JSONL = """
SELECT 'c_' || doc_id AS chunk_id, text, '{' || CASE WHEN doc_id % 2 = 0 THEN '"page":' || doc_id || ',' ELSE '' END || '"source":"' || source || '","language":"' || lang || '"}' AS metadata FROM documents
"""
FONTS = FONTS_OUT
