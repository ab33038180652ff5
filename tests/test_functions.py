import json
import random

import pytest
from pyspark.sql import functions as F

from strataflow import cli
from strataflow.functions import garble, languages, tables
from strataflow.functions import text as X
from strataflow.operators import ocr, structure
from strataflow.sources import files, sinks
from strataflow.streaming import ingest


def test_stable_id(spark):
    assert spark.range(1).select(X.stable_id(F.lit("a"), F.lit("b"), F.lit(0))).first()[0] == "c_d47af2d60923be50"


def test_tokens_of_nothing(spark):
    rows = spark.createDataFrame([(None,), ("",), ("abc",), ("abcdefgh",)], "t string").select(X.tokens(F.col("t"))).collect()
    assert [r[0] for r in rows] == [0, 0, 1, 2]


def test_list_items(spark):
    said = {"7": True, "10. x": False, "1.5 V": True, "a) b": True, "a)": False, "- x": True, "word": False, "": False}
    rows = spark.createDataFrame([(k,) for k in said], "t string").select("t", X.is_list_item(F.col("t"))).collect()
    assert dict(map(tuple, rows)) == said


def test_corrupt_and_spliced_words(spark):
    tel = "కఖగ"
    said = {"plain": (False, False), tel: (False, False), tel + "αβ": (True, False), "áb": (False, False), tel + "́": (True, False), "́ab": (True, False), "x�y": (True, False), f"క|ఖ": (False, True), "క(ఖ": (False, True), "(కఖ)": (False, False), "క-ఖ": (False, False), "కఖ|": (False, True)}
    rows = spark.createDataFrame([(k,) for k in said], "t string").select("t", F.col("t").rlike(garble.CORRUPT), F.col("t").rlike(garble.SPLICED)).collect()
    assert {r[0]: (r[1], r[2]) for r in rows} == said


def test_damage_is_by_the_regular_expressions(spark):
    """The counts of one pass over all texts of a batch are those of each text alone, and its words those that Java's regular expressions find."""
    r = random.Random(3)
    some = "ab é а я α β ט క ఖ ా ् क ा ৰ ਕ 中 ア 한 ა ะ ꙮ ʰ 𝐀 Ａ ́ ̈ ⃗ ⃝ \u0c56 \ufffd \ue000 | ^ - ( · ॥ + , 1 ٣ ; : \u00a0 \u2028".split(" ") + ["\x1c", "\x85"]
    texts = ["".join(r.choice(some) + (" " if r.random() < 0.15 else "") for _ in range(r.randint(0, 60))) for _ in range(400)] + ["ab;", "ab", None, "", "\u1112\u1161\u11ab x", "క" * 300 + "λ"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(1)
    m = F.col("m")
    hits = lambda p: F.size(F.filter(m["suspects"], lambda w: w.rlike(p)))
    got = d.select("t", garble.damage("t").alias("d"), garble.measured("t").alias("m")).select("t", "d", hits(garble.CORRUPT).alias("corrupt"), hits(garble.SPLICED).alias("spliced")).collect()
    assert len(got) == len(texts) and sum(x["corrupt"] for x in got if x["t"]) > 200 and sum(x["spliced"] for x in got if x["t"]) > 100
    for x in got:
        assert x["t"] is None and x["d"] is None or (x["d"]["corrupt"], x["d"]["spliced"]) == (x["corrupt"], x["spliced"]), x["t"]
    assert next(x["d"]["spiked"] for x in got if x["t"] == "ab;") == 0
    kinds = d.select("t", garble.script_letters("t").alias("s"), *[X.count_of(F.col("t"), rf"[\p{{L}}&&{languages.BY_ISO[i].characters}]").alias(i) for i in ("te", "hi", "bn")], X.letters(F.col("t")).alias("all")).where("t is not null").collect()
    assert all((x["s"]["bc00"], x["s"]["b900"], x["s"]["b980"], x["s"]["letters"]) == (x["te"], x["hi"], x["bn"], x["all"]) for x in kinds)


def test_language_ties_and_fallback(spark):
    rows = [("ab", "en"), ("కఖ", "te"), ("aక", "en"), ("अआ", "hi"), ("12", "ta"), (None, "ta")]
    out = spark.createDataFrame([r[:1] for r in rows], "t string").select(languages.tag(languages.counts(F.col("t")), ["ta", "hi", "te", "mr"])).collect()
    assert [r[0] for r in out] == [r[1] for r in rows]
    assert languages.pinned_pack(["en", "te"]) == "tel" and languages.pinned_pack(["te", "hi"]) is None


def test_markdown_and_rows(spark):
    t = spark.createDataFrame([(["a", ""], [["1|2", None], ["x"]])], "h array<string>, r array<array<string>>")
    assert t.select(tables.markdown(F.col("h"), F.col("r"))).first()[0] == "| a | col_2 |\n| --- | --- |\n| 1\\|2 |  |\n| x |  |"
    assert t.select(tables.markdown(F.col("h"), F.col("r"), F.lit(0))).first()[0].endswith("| … | … |")


def docs(spark, text):
    return spark.createDataFrame([("s", "f.txt", "txt", text)], "source string, filename string, doc_type string, text string").withColumn("elements", structure.elements_of(F.col("text")))


def test_elements(spark):
    got = docs(spark, "one\n two \n\n=== Head ===\nbody\r\n=======\nlast").select(F.explode("elements").alias("e")).select("e.type", "e.text").collect()
    assert [tuple(r) for r in got] == [("paragraph", "one two"), ("heading", "Head"), ("paragraph", "body"), ("heading", ""), ("paragraph", "last")]


def test_oversized_paragraph_and_overlap(spark):
    text = "\n\n".join([f"Sentence {k} " + "word " * 150 + "end. Short tail." for k in range(4)])
    out = sorted(structure.chunks(docs(spark, text), least=0).collect(), key=lambda r: r["ordinal"])
    assert [r["ordinal"] for r in out] == list(range(len(out))) and "Short tail." in out[1]["text"].split("\n\n", 1)[1][:20]
    assert structure.chunks(docs(spark, "=== only ===\n=== heads ===")).count() == 0
    assert structure.chunks(docs(spark, None)).count() == 0
    with pytest.raises(ValueError):
        structure.chunks(docs(spark, "x"), budget=0)


def test_table_parts_keep_ordinals(spark):
    rows = [[str(i), "x" * 20] for i in range(30)]
    e = [("paragraph", "before", 0, 1, None), ("table", None, 0, 1, {"headers": ["a", "b"], "rows": rows}), ("paragraph", "after", 0, 2, None)]
    d = spark.createDataFrame([("s", "f", "pdf", e)], f"source string, filename string, doc_type string, elements array<{structure.ELEMENT}>")
    out = sorted(structure.chunks(d, budget=100, least=0).collect(), key=lambda r: r["ordinal"])
    assert [r["ordinal"] for r in out] == list(range(len(out))) and out[1]["is_table"] and out[-1]["pages"] == [2]
    assert sum(r["table_shape"][0] for r in out if r["is_table"]) == 30 and all("part" in r["text"] for r in out if r["is_table"])


def test_merging_leaves_gaps(spark):
    out = structure.chunks(docs(spark, "\n\n".join(["a" * 1600, "b" * 40, "c" * 1600])), overlap=0).collect()
    assert len(out) == 2 and "b" * 40 in min(out, key=lambda r: r["ordinal"])["text"] and {r["ordinal"] for r in out} == {0, 2}


def test_files_sinks_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in {"a.txt": "=== T ===\nhello world", "_b.txt": "under", ".c.txt": "dot", "d.docx": "no"}.items():
        (tmp_path / "in" / name).write_text(text)
    found, chunks = cli.ingest(spark, str(tmp_path / "in"))
    assert sorted(r["filename"] for r in found.collect()) == [".c.txt", "_b.txt", "a.txt"]
    assert files.files(spark, str(tmp_path / "in"), True).count() == 2
    named = files.named(spark, [str(tmp_path / "in/d.docx"), str(tmp_path / "in/none.txt")]).orderBy("pos").collect()
    assert "unsupported" in named[0]["error"] and named[1]["error"]
    with pytest.raises(NotADirectoryError):
        files.files(spark, str(tmp_path / "nowhere"))
    assert sinks.write_one(chunks, str(tmp_path / "out/x.jsonl")) == 3
    first = json.loads((tmp_path / "out/x.jsonl").read_text().split("\n")[2])
    assert set(first) == {"chunk_id", "text", "metadata"} and "is_table" not in first["metadata"]
    q = ingest.to_parquet(ingest.text_stream(spark, str(tmp_path / "in")), str(tmp_path / "chunks"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "chunks")).count() >= 1
    assert cli.main(["ingest", str(tmp_path / "nowhere")]) == 2


class Stub(ocr.BaseEngine):
    def __init__(self, name, known, says):
        self.name, self.known, self.says = name, known, says

    def scripts(self):
        return self.known

    def one(self, image, script):
        return self.says.get(script, "")


def test_engines_fall_back(spark):
    a, b = Stub("a", {"tel"}, {}), Stub("b", {"tel", "eng"}, {"tel": "కఖ", "tel+eng": "కఖ"})
    f = ocr.Fallback([a, b])
    assert f.attributed([b"x"], "tel") == [("కఖ", "b")] and [e.name for e in f.ranked("tel+eng")] == ["b", "a"]
    assert ocr.select_engine("easyocr", {"tesseract": lambda: b}) is b
    with pytest.raises(ValueError):
        ocr.select_engine("magic", {})


def test_execute_rounds(spark, tmp_path):
    plans = spark.createDataFrame([(1, "d1", ["hin", "tel"], ["tel"]), (2, "d2", ["hin"], ["hin"])], "page_id long, digest string, attempts array<string>, verify array<string>")
    kept = []

    def keep(df):
        kept.append(str(tmp_path / f"r{len(kept)}"))
        df.write.parquet(kept[-1])
        return spark.read.parquet(kept[-1])

    says = {"tel": "కఖగఘ", "hin": "latin only"}

    def make():
        class E(ocr.BaseEngine):
            name = "stub"

            def one(self, image, script):
                return says[script]

        return E()

    out = ocr.execute(plans, make, lambda d: b"", keep).collect()
    assert [(r["page_id"], r["detected"], r["ocr_engine"]) for r in out] == [(1, "tel", "stub")] and len(kept) == 2
