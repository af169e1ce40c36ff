"""Small fixtures: chunks, headings, pages, rows, geometry, sheets."""

import io
import re
import zipfile

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkquire.functions.pytext import strip
from sparkquire.operators import chunking as C
from sparkquire.operators import geometry, graph, manifest, records, scalars
from sparkquire.sources.corpus import assembled

PAGE_TEXT = "\n<!-- Page 1 -->\n\n# Test Title\n\n## Introduction\n\nText here.\n\n<!-- Page 2 -->\n## Methods\n\n| a | b | c |\n| --- | --- | --- |\n| 1 | 2 | 3 |\n| 4 | 5 | 6 |\n\n### Data\u00a0Collection\nmore"


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column).first()[0]


def cut_basic(text, size, overlap, least):
    out, s, c = [], 0, int(size * 0.8)
    while True:
        if s + size >= len(text):
            return out + ([(s, len(text) - s)] if len(text) - s >= least else [])
        ends = [k for k, ch in enumerate(text[s + c : s + size]) if ch in C.TERMINATORS]
        long = c + ends[-1] + 1 if ends else size
        if long >= least:
            out.append((s, long))
        s += long - overlap


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="ab .!。\n\U0001f600", max_size=300), st.integers(10, 60))
def test_basic_cutter(spark, text, size):
    got = one(spark, C.basic(F.col("text"), size, size // 5, 5), text)
    assert [(x["start"], x["len"]) for x in got] == cut_basic(text, size, size // 5, 5)


def test_overlap_is_checked():
    with pytest.raises(ValueError):
        C.basic(F.lit("x"), 100, 81, 1)


def test_paragraphs_and_sections(spark):
    text = "\n\n".join(["x" * 60, "y" * 60])
    got = one(spark, C.paragraphs(F.col("text"), 100, 20, 10), text)
    assert got == ["x" * 60, "x" * 20 + "\n\n" + "y" * 60]
    got = one(spark, C.headings(F.col("text")), "intro\n# One\na\nALL CAPS LINE\nb\n1. Numbered heading\nc \U0001f600\n## Two\nd")
    assert [x["heading"] for x in got] == ["", "# One", "ALL CAPS LINE", "1. Numbered heading", "## Two"]
    assert "".join(x["text"] for x in got).startswith("intro\n# One")
    long = "# Head\n" + "word " * 500
    got = one(spark, C.semantic(F.col("text"), 200, 40, 20), long)
    assert len(got) > 5 and {x["heading"] for x in got} == {"# Head"}


def test_pages(spark):
    text = "lost <!-- Page 1 -->" + "a" * 30 + "<!-- Page 2 -->" + "b" * 30 + "<!-- Page 3 -->" + "c" * 30
    got = one(spark, C.page_aware(F.col("text"), 500, 50, 10), text)
    assert [(x["page"], x["text"][0]) for x in got] == [(1, "a"), (2, "b"), (3, "c")]


def test_manifest(spark):
    pages = spark.createDataFrame([("d", 1, PAGE_TEXT)], "doc_id string, pg long, t string")
    s = manifest.sections(pages).orderBy("start_line").collect()
    assert [(x.title, x.page, x.level) for x in s] == [("Test Title", 1, 1), ("Introduction", 1, 2), ("Methods", 2, 2), ("Data\u00a0Collection", 2, 3)]
    t = manifest.tables(pages).first()
    assert (t.id, t.row_count, t.col_count) == ("tab_1", 3, 4 - 1)
    assert manifest.titles(pages).first().title == "Test Title"


def test_long_table(spark):
    md = "| a | b |\n| - | - |\n" + "| 1 | 2 |\n" * 5000
    pages = spark.createDataFrame([("d", 1, md)], "doc_id string, pg long, t string")
    assert manifest.tables(pages).first().row_count == 5001


def test_scalars(spark):
    kinds = [("patient dose drug", "a.pdf", "medical"), ("class method import", "a.pdf", "technical"), ("hereby whereas party", "x", "legal"), ("anything", "notes.txt", "simple"), ("", "", "general")]
    for text, name, kind in kinds:
        assert one(spark, scalars.doc_type(F.col("text"), F.lit(name)), text) == kind
    assert re.fullmatch(r"doc_study_report_pdf_[0-9a-f]{6}", one(spark, scalars.doc_id(F.col("text"), F.lit("u")), "Study_Report.pdf"))
    assert one(spark, strip(F.col("text")), "\u2003a b\u00a0") == "a b"


def test_rows(spark):
    row = F.parse_json(F.col("text"))
    assert one(spark, records.errors(row), '{"Name":"a","Size":true,"Kind":"SMALL"}') == []
    assert one(spark, records.errors(row), '{"Size":"high","Kind":"IV","Dose":1}') == ["Unknown column: 'Dose'", "Missing required column: 'Name'", "Column 'Size' must be a number", "Invalid value for enum column 'Kind': 'IV'"]
    rows = spark.createDataFrame([("t", 0, "A"), ("t", 1, "B")], "table_id string, idx long, name string")
    done = records.deleted(records.replaced(rows, "t", 0, name="C"), "t", 0)
    assert [tuple(r) for r in done.collect()] == [("t", 0, "B")]
    more = spark.createDataFrame([("t", 5, "D"), ("t", 2, "C")], "table_id string, at long, name string")
    assert [r.name for r in records.appended(rows, more).orderBy("idx").collect()] == ["A", "B", "C", "D"]


def test_sheet_and_clusters(spark):
    with zipfile.ZipFile(io.BytesIO(records.xlsx([{"a": 1, "b": "<x>"}], ["a", "b"], "T"))) as z:
        assert "&lt;x&gt;" in z.read("xl/worksheets/sheet1.xml").decode()
    rects = spark.createDataFrame([([(0.0, 0.0, 100.0, 100.0), (10.0, 120.0, 60.0, 140.0), (0.0, 400.0, 20.0, 420.0)],)], f"r array<{geometry.RECT}>")
    got = rects.select(geometry.clusters(F.col("r"))).first()[0]
    assert [tuple(x) for x in got] == [(0.0, 0.0, 100.0, 140.0)]


def test_sheet(spark):
    from xml.etree import ElementTree

    kinds = {"Item": "text", "n": "number", "link": "url", "Confidence": "enum"}
    rows = [{"Item": "<a & b>", "n": 2.5, "link": "https://example.org/?a=1&b=2", "Confidence": "High"}, {"Item": None, "n": 1, "Confidence": "low"}]
    with zipfile.ZipFile(io.BytesIO(records.xlsx(iter(rows), list(kinds), "T", "doc", True, kinds))) as z:
        parts = {n: ElementTree.fromstring(z.read(n)) for n in z.namelist()}
    sheet = parts["xl/worksheets/sheet1.xml"]
    cells = {c.get("r"): c for c in sheet.iter() if c.tag.endswith("}c")}
    assert "".join(cells["A2"].itertext()) == "Source: doc" and "".join(cells["A4"].itertext()) == "Item"
    assert "".join(cells["A5"].itertext()) == "<a & b>" and "".join(cells["B5"].itertext()) == "2.5" and cells["B5"].get("t") is None
    assert [cells[c].get("s") for c in ("A1", "A4", "A5", "D5", "D6")] == ["1", "2", "3", "4", "5"]
    assert "".join(cells["A6"].itertext()) == "" and "".join(cells["C6"].itertext()) == ""
    assert [c.get("width") for c in sheet.iter() if c.tag.endswith("}col")] == ["9", "5", "30", "12"]
    assert [c.get("sqref") for c in sheet.iter() if c.tag.endswith("}conditionalFormatting")] == ["B5:B6"]
    assert parts["xl/worksheets/_rels/sheet1.xml.rels"][0].get("Target") == "https://example.org/?a=1&b=2"


def test_workbook(spark):
    rows = spark.createDataFrame([("t", k, f"n{k}", k, "SMALL") for k in range(5)] + [("u", 0, "x", 1, None)], "table_id string, idx long, name string, size int, kind string")
    with zipfile.ZipFile(io.BytesIO(records.workbook(rows, "t"))) as z:
        assert z.read("xl/worksheets/sheet1.xml").decode().count("<row ") == 7
    with pytest.raises(ValueError):
        records.workbook(rows, "t", most=4)


def test_visual_content(spark, tmp_path):
    texts = ["é" * 60, "ünïcode wörds " * 30, "a" * 99 + "é", "a\tB\r" * 60, "", None, "a" * 99, "a" * 200, "aZ" * 100, "\U0001f600x" * 400, "a" * 1000 + "é" * 90]
    rows = [(k, t) for k, t in enumerate(texts)] + [(8, "aZ" * 100)]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def want(t):
        b = (t or "").encode()[:1000]
        return len(b) >= 100 and sum((x - sum(b) / len(b)) ** 2 for x in b) / len(b) > 100

    got = geometry.visual_content(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == sorted((k, want(t)) for k, t in rows)
    assert {r.visual for r in got} == {True, False}


def python_entities(text):
    runs = re.findall(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b", text)
    out = {}
    for e in re.findall(r'"([^"]+)"', text) + [r for r in runs if r not in graph.STOP]:
        out.setdefault(e.lower(), e)
    return list(out.values())


ENTITY_TEXTS = ["Cióníos met Ana Ñandú and Élan Vital in Paris", 'É "ciudad Ávila" The Old\u00a0Town New\u2003Road\u0085Down\x1cHill _Under Über9Side', "A\u0301na Bo\u0301b Carl\u0301 Dan\u200dEve Five\u2167 Six\u00bd Sev\u4e2d Oct\U0001d400 \U0001d400Nov Dec\U0001f600 End", "Line\nBreak\tTab The Best This"]


def test_entities(spark, tmp_path):
    for text in ENTITY_TEXTS:
        d = graph.first_entities(spark.createDataFrame([(1, text)], "doc_id long, text string"), 1000)
        assert [r.entity for r in d.orderBy("place").collect()] == python_entities(text)
    spark.createDataFrame(list(enumerate(ENTITY_TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.place, r.entity) for r in graph.extract_entities(spark, str(tmp_path)).collect())
    assert got == [(k, p + 1, e) for k, t in enumerate(ENTITY_TEXTS) for p, e in enumerate(python_entities(f'"Drug {k}" and The Best Of {t}')[:5])]


def test_graph_covers_whole_texts(spark, tmp_path):
    filler = "some words that go on without any name. " * 100
    late = "Zoë saw Anna Bell and Karl Ito. "
    texts = [filler + late + "Late \"one é\" here.", "Ana Ben Cid, Dora, Eva, Finn, Gil, Hal. " + filler * 2 + late, None, "", "Eve Fox " + "x" * 3187 + " Cut Name, Karl Ito", "so Anna Bell, ANNA, anna, Karl Ito, Karl Ito"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {}
    for t in texts:
        ends = [s for s, n in cut_basic(t, 3200, 0, 0)] if t is not None else []
        seen = [{} for _ in ends]
        for m in list(re.finditer(r'"([^"]+)"', t or "")) + list(re.finditer(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b", t or "")):
            e = m[1] if m.re.groups else m[0]
            seen[max(k for k, s in enumerate(ends) if s <= m.start())].setdefault(e.lower(), e)
        for c in seen:
            for a in c.values():
                for b in c.values():
                    if a < b:
                        want[a, b] = want.get((a, b), 0) + 1
    assert {(r.source, r.target): r.weight for r in graph.cooccurrences(docs).collect()} == want
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    edges = {(r.source, r.target): r.weight for r in graph.kg_build(spark, str(tmp_path)).collect()}
    assert edges["Anna Bell", "Karl Ito"] == 3 and want["Cut Name", "Eve Fox"] == 1 and ("Cut Name", "Karl Ito") not in want


def test_full_text_of_every_document(spark):
    d = "/root/testdata/sf0.001"
    got = {r.doc_id: tuple(r) for r in manifest.fetch_full_text(spark, d).collect()}
    assert set(got) == {r.doc_id for r in manifest.page_rows(spark, d).select("doc_id").distinct().collect()} and len(got) > 2
    whole = {r.doc_id: len(r.md) // 4 for r in assembled(manifest.page_rows(spark, d)).collect()}
    assert {k: r[3] for k, r in got.items()} == whole and all(r[2] for r in got.values())
    two = manifest.fetch_full_text(spark, d, ["doc_src1", "doc_src2"]).collect()
    assert sorted(map(tuple, two)) == sorted(got[k] for k in ("doc_src1", "doc_src2"))
