"""The seams with stubs in place of extractors, engines and chunkers."""

import json

import pytest
from pyspark.sql import functions as F

from strataflow import api, cli
from strataflow.functions import garble
from strataflow.operators import ocr
from strataflow.sources import extract, files


def span(text, size=10.0, flags=0, font="Sans"):
    return {"text": text, "size": size, "flags": flags, "font": font}


def block(x0, y0, *lines):
    return {"x0": x0, "y0": y0, "x1": x0 + 200.0, "y1": y0 + 20.0, "lines": [list(l) for l in lines]}


def grid(strategy, y0, rows):
    return {"strategy": strategy, "x0": 50.0, "y0": y0, "x1": 250.0, "y1": y0 + 100, "headers": ["name", "count"], "rows": rows}


class Stub:
    """A page a line of the file; `!` makes it fail."""

    def pages(self, content):
        if b"!" in content:
            raise OSError("broken file")
        for k, line in enumerate(content.decode().split("\n")):
            if not line:
                yield {"width": 600.0, "height": 800.0, "image": b"scan", "figures": [{"x0": 0.0, "y0": 0.0, "x1": 50.0, "y1": 50.0, "image": b"fig"}, {"x0": 0.0, "y0": 0.0, "x1": 5.0, "y1": 5.0}]}
                continue
            yield {
                "width": 600.0, "height": 800.0,
                "blocks": [block(50.0, 100.0, [span("Head ", 18.0, 16), span("line", 18.0)]), block(50.0, 150.0, [span(line)], [span("second line of it.")]), block(60.0, 320.0, [span("beneath the table")])],
                "tables": [grid(1, 300.0, [["loose", "1"], ["b", "2"]]), grid(0, 305.0, [["a", "1"], ["b", "2"]]), grid(0, 600.0, [["only", ""]])],
            }


class Reader(ocr.BaseEngine):
    name = "stub"

    def scripts(self):
        return {"eng"}

    def one(self, image, script):
        return {b"scan": "First paragraph.\n\nSecond one."}.get(image, "")


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.pdf").write_text("Some text of page one\n\nmore on page three")
    (tmp_path / "bad.pdf").write_text("!")
    (tmp_path / "c.txt").write_text("=== T ===\nplain text of a file")
    (tmp_path / "d.png").write_bytes(b"scan")
    return tmp_path


EXTRACTORS = {".pdf": Stub, ".png": extract.PictureExtractor}


def pages(spark, folder):
    return extract.pages(files.files(spark, str(folder)).where("ext <> '.txt'"), EXTRACTORS)


def test_pages_and_errors(spark, folder):
    rows = {(r["filename"], r["page"]): r for r in pages(spark, folder).collect()}
    assert rows.keys() == {("a.pdf", 1), ("a.pdf", 2), ("a.pdf", 3), ("bad.pdf", None), ("d.png", 1)}
    assert rows["bad.pdf", None]["error"] == "OSError: broken file" and rows["d.png", 1]["image"] == b"scan"


def test_items_of_spans_and_tables(spark, folder):
    found = extract.items(pages(spark, folder).where("filename = 'a.pdf' and page = 1")).collect()
    text = [(r["text"], r["size"], r["bold"], r["fonts"]) for r in found if r["kind"] == "text"]
    assert text == [("Head line", 18.0, True, ["Sans"]), ("Some text of page one\nsecond line of it.", 10.0, False, ["Sans"])]
    assert [(r["tbl"]["headers"], r["tbl"]["rows"]) for r in found if r["kind"] == "table"] == [(["name", "count"], [["a", "1"], ["b", "2"]])]  # the strict one


def test_facts_have_cells_of_tables(spark, folder):
    rows = {(r["page"]): r for r in extract.facts(pages(spark, folder).where("filename = 'a.pdf'")).collect()}
    assert rows[1]["text"] == "Head line Some text of page one\nsecond line of it. name count a 1 b 2" and not rows[1]["scanned"] and rows[1]["judged"]
    assert rows[2]["scanned"] and rows[2]["n_fig"] == 1 and not rows[2]["judged"]


def test_figures_need_the_feature_and_words(spark, folder):
    p = pages(spark, folder).where("filename = 'a.pdf'")
    assert extract.figures(p, False, True) is None and extract.figures(p, True, False) is None
    assert [(r["page"], r["figure"]) for r in extract.figures(p, True, True).collect()] == [(2, 0)]
    texts = spark.createDataFrame([(r["source"], 2, k, t) for r in p.limit(1).collect() for k, t in ((0, "A chart of many things here"), (1, "x1"))], "source string, page int, figure int, text string")
    assert [r["text"] for r in extract.items(p, texts).where("kind = 'figure'").collect()] == ["[Figure] A chart of many things here"]


def test_english_after_the_attempts(spark, folder):
    scanned = spark.createDataFrame([(1, "scan"), (2, "scan"), (3, "other")], "page_id long, digest string")
    done = spark.createDataFrame([(2,)], "page_id long")
    out = ocr.english(scanned, done, Reader, lambda d: d.encode(), lambda df: df)
    assert [tuple(r) for r in out.collect()] == [(1, "First paragraph.\n\nSecond one.", "stub")]
    got = extract.paragraphs(out.select(F.lit("s").alias("source"), F.col("page_id").cast("int").alias("page"), "ocr_text")).collect()
    assert [(r["text"], r["kind"]) for r in got] == [("First paragraph.", "text"), ("Second one.", "text")]
    old = extract.items(pages(spark, folder).where("filename = 'a.pdf' and page = 1"))
    assert old.unionByName(extract.paragraphs(out.select(F.lit("s").alias("source"), F.col("page_id").cast("int").alias("page"), "ocr_text"))).count() == old.count() + 2


def test_recovered_pages_give_way(spark, folder):
    old = extract.items(pages(spark, folder).where("filename = 'a.pdf'"))
    new = ocr.spliced(old, old.where("page = 1").select("source", "page").distinct().withColumn("ocr_text", F.lit("recovered")))
    assert [(r["page"], r["text"]) for r in new.where("page = 1").collect()] == [(1, "recovered")] and new.where("page = 3").count() == old.where("page = 3").count()


def test_cache_is_appended_once(spark, tmp_path):
    at = str(tmp_path / "cache")
    assert ocr.cached(spark, at).count() == 0
    rows = spark.createDataFrame([("aa1", "text", "e"), ("aa1", "text", "e"), ("bb2", "", "e"), ("cc3", None, None)], "digest string, ocr_text string, ocr_engine string")
    ocr.cache_append(rows, at)
    ocr.cache_append(rows.union(spark.createDataFrame([("dd4", "more", "f")], rows.schema)), at)
    assert sorted(tuple(r) for r in ocr.cached(spark, at).collect()) == [("aa1", "text", "e"), ("dd4", "more", "f")]
    hit, miss = ocr.cache_split(spark.createDataFrame([("aa1",), ("bb2",)], "digest string"), ocr.cached(spark, at))
    assert [r["cached_engine"] for r in hit.collect()] == ["e"] and [r["digest"] for r in miss.collect()] == ["bb2"]


def test_script_detection_never_raises(spark):
    def detect(image):
        if image == b"bad":
            raise ValueError
        return "Telugu"

    rows = spark.createDataFrame([("ok", ["te"]), ("bad", ["te"]), ("ok", [])], "digest string, langs array<string>")
    assert [r["osd"] for r in ocr.with_osd(rows, detect, str.encode).collect()] == ["Telugu", None, None]


def test_engine_modes():
    a, b = Reader(), Reader()
    assert ocr.select_engine("none", {}) is None
    assert ocr.select_engine("auto", {"tesseract": lambda: a}) is a
    both = ocr.select_engine("auto", {"tesseract": lambda: a, "surya": lambda: b}, gpu=True)
    assert both.engines == [b, a] and both.attributed([b"scan", b"?"], "eng") == [("First paragraph.\n\nSecond one.", "stub"), ("", None)]


def test_api(spark, folder, monkeypatch):
    seen, docs = api.parse(spark, str(folder), EXTRACTORS)
    assert {r["filename"]: r["error"] for r in seen.collect()} == {"a.pdf": None, "bad.pdf": "OSError: broken file", "c.txt": None, "d.png": None}
    types = {r["filename"]: [e["type"] for e in r["elements"]] for r in docs.collect()}
    assert types["a.pdf"].count("table") == 2 and "heading" in types["a.pdf"] and types["c.txt"] == ["heading", "paragraph"]
    rows = api.ingest_directory(spark, str(folder), EXTRACTORS, min_tokens=0).collect()
    assert {"a.pdf", "c.txt"} == {r["filename"] for r in rows} and any(r["is_table"] for r in rows)
    monkeypatch.setenv("STRATAFLOW_CHUNK_TOKENS", "77")
    monkeypatch.setenv("XDG_CACHE_HOME", "/tmp/x")
    assert api.Config.of().chunk_tokens == 77 and api.Config.of(chunk_tokens=5).chunk_tokens == 5 and api.Config.of().dpi == 300
    assert api.cache_dir() == "/tmp/x/strataflow/ocr"
    with pytest.raises(FileNotFoundError):
        api.ingest_file(spark, str(folder / "none.txt"))
    with pytest.raises(NotADirectoryError):
        api.ingest_directory(spark, str(folder / "c.txt"))


def test_a_chunker_of_the_callers(spark, folder):
    rows = api.ingest_file(spark, str(folder / "c.txt"), chunker=lambda d: [{"text": e["text"].upper(), "section_path": ["x"]} for e in d["elements"]]).collect()
    assert [(r["ordinal"], r["text"], r["strategy"], r["heading"], r["language"]) for r in rows] == [(0, "T", "custom", "x", "en"), (1, "PLAIN TEXT OF A FILE", "custom", "x", "en")]


def test_json_of_documents(spark, folder, tmp_path, capsys):
    out = tmp_path / "docs.json"
    assert cli.main(["ingest", str(folder / "c.txt"), "-o", str(tmp_path / "o.jsonl"), "--json", str(out)]) == 0
    assert json.loads(out.read_text())["elements"][0]["type"] == "heading"
    assert cli.main(["info"]) == 0 and "GPU" in capsys.readouterr().out


def test_measured_counts(spark):
    text = "Ab é́x ; a;b кириллица  � 12٣ é"
    m = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(garble.measured("t").alias("m")).collect()
    assert m[0]["m"].asDict() == {"letters": 16, "accented": 1, "ascii": 6, "vowels": 3, "upper": 1, "digits": 3, "alnum": 19, "n": 4, "spiked": 1, "bare": 1, "words": 4, "nfc_letters": 16, "pua": 1, "fffd": 1, "suspects": ["é́x", "кириллица"]}
    assert m[1]["m"]["letters"] == 0 and m[1]["m"]["suspects"] == [] and m[2]["m"] is None
