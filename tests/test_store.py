"""Tables, drafts, jobs, files, graphs and extension points: the rules of each command, and round trips through files."""

import base64
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkquire.operators import chunking, files, graph, tools
from sparkquire.operators.tablestore import Store, create_params
from sparkquire.plans import extensions

COLUMNS = [{"name": "Drug", "type": "text"}, {"name": "Dose", "type": "number"}, {"name": "Route", "type": "enum", "required": False, "enum_values": ["IV", "IM"]}]


@pytest.fixture
def desk(spark):
    return tools.Desk(Store.empty(spark), files.Jobs.empty(spark))


def rows_of(store, t):
    return [json.loads(r[0]) for r in store.own(t).orderBy("idx").select(F.to_json("row")).collect()]


def test_rows_are_judged_one_by_one(spark):
    store, t = Store.empty(spark).create("comparison", "Drugs", COLUMNS)
    store, r = store.add(t, [{"Drug": "Remimazolam", "Dose": 0.2}, {"Drug": "Propofol", "Dose": "high"}, {"Drug": "Ketamine", "Dose": 2, "Route": "PO"}, {"Drug": "Propofol", "Dose": 2.0, "Route": "IV"}])
    assert (r["success"], r["added"], r["total_rows"]) == (True, 2, 2) and [b.row_index for b in r["errors"].orderBy("row_index").collect()] == [1, 2]
    again, r = store.add(t, [{"Dose": "x"}])
    assert not r["success"] and again is store and [len(b.errors) for b in r["errors"].collect()] == [2]
    with pytest.raises(ValueError, match="Table not found: nope"):
        store.add("nope", [])
    for bad in (-1, 2):
        with pytest.raises(ValueError, match=f"Invalid row index: {bad}"):
            store.update_row(t, bad, {})
    same, r = store.update_row(t, 0, {"Drug": "A"})
    assert not r["success"] and same is store
    store, r = store.update_row(t, 0, {"Drug": "A", "Dose": 1})
    store, r = store.update_cell(t, 1, "Dose", "much")
    assert (r["old_value"], r["new_value"]) == (2, "much") or r["old_value"] == 2.0
    with pytest.raises(ValueError, match="Unknown column: 'Colour'"):
        store.update_cell(t, 0, "Colour", "x")
    assert rows_of(store, t) == [{"Drug": "A", "Dose": 1}, {"Drug": "Propofol", "Dose": "much", "Route": "IV"}]
    assert store.preview(t, 1) == "### Drugs\\n\\n| Drug | Dose | Route |\\n| --- | --- | --- |\\n| A | 1 | - |\\n\\n*(Showing 1 of 2 rows)*".replace("\\n", "\n")
    store, r = store.delete_row(t, 0)
    assert r["total_rows"] == 1 and [x.idx for x in store.own(t).collect()] == [0] and store.status(t)["last_rows"][0]["Drug"] == "Propofol"
    assert store.render(t, "markdown")["row_count"] == 1 and store.render(t)["content"][:2] == b"PK" and store.tokens(t)["content"] > 0
    with pytest.raises(NotImplementedError):
        store.render(t, "html")
    empty, e = store.create("summary", "None", COLUMNS)
    with pytest.raises(ValueError, match="empty table"):
        empty.render(e)
    store, gone = store.delete_table(t)
    assert gone and not store.delete_table(t)[1] and store.listed().count() == 0 and store.rows.count() == 0
    assert create_params(COLUMNS)[2] == {"name": "Route", "type": "enum", "required": False}


def test_drafts_become_tables(spark, tmp_path):
    store, d = Store.empty(spark).create_draft("Plan", notes="n")
    for field, message in ((None, "no columns"), ({"proposed_columns": COLUMNS}, "no intent")):
        store = store.update_draft(d, **field)[0] if field else store
        with pytest.raises(ValueError, match=message):
            store.commit_draft(d)
    store, _ = store.update_draft(d, intent="citation", source_doc_ids=["a", "b"], unknown=1)
    store, n = store.add_to_draft(d, [{"Drug": "A", "Dose": 1}, {"Drug": "B"}])
    store, n = store.add_to_draft(d, [{"Drug": "C", "Dose": 3}])
    assert n == 3 and store.draft_tokens(d) > 40
    store, t, r = store.commit_draft(d)
    assert r["added"] == 2 and store.table(t).source_description == "Sources: a, b" and [x["Drug"] for x in rows_of(store, t)] == ["A", "C"]
    store, t2, _ = store.commit_draft(d)
    assert t2 != t and store.draft(d).table_id == t2 and store.listed().count() == 2 and store.listed_drafts().first().pending_rows == 3
    store.save(str(tmp_path))
    back = Store.load(spark, str(tmp_path))
    assert rows_of(back, t) == rows_of(store, t) and back.table(t).columns == store.table(t).columns and back.draft(d).notes == "n" and back.draft_rows.count() == 3
    assert back.preview(t) == store.preview(t) == store.previews(10).where(F.col("table_id") == t).first().preview
    store, gone = store.delete_draft(d)
    assert gone and store.draft_rows.count() == 0
    with pytest.raises(ValueError, match="Draft not found"):
        store.draft(d)


def test_jobs(spark, tmp_path):
    now = datetime(2024, 1, 2)
    jobs = files.Jobs.empty(spark).create("a", ["x.pdf"], now).create("b", ["x.pdf", "y.pdf"], now + timedelta(hours=1))
    with pytest.raises(ValueError, match="already exists"):
        jobs.create("a", [])
    assert [j.job_type for j in jobs.recent().collect()] == ["ingest_batch", "ingest_single"] and jobs.recent(1).count() == 1
    jobs = jobs.start("a", now).progress("a", 1, 4)
    assert jobs.get("a").percentage == 25.0 and jobs.progress("a", 1, 0).get("a").percentage == 25.0
    jobs = jobs.complete("a", ["doc_x"], now)
    assert jobs.get("a").percentage == 100.0 and not jobs.cancel("a")[1] and not jobs.cancel("none")[1]
    jobs, done = jobs.cancel("b")
    assert done and jobs.active().count() == 0
    assert jobs.cleanup(24, now + timedelta(hours=24.5))[1] == 1
    jobs.save(str(tmp_path / "jobs"))
    assert files.Jobs.load(spark, str(tmp_path / "jobs")).jobs.count() == 2 and jobs.delete("a")[1] and not jobs.delete("zz")[1] and jobs.fail("b", "why").get("b").error == "why"


def test_documents_and_images(spark, tmp_path):
    pages = spark.createDataFrame([("doc_a", 1, "one"), ("doc_a", 2, "two"), ("doc_b", 1, "")], "doc_id string, pg int, t string")
    md = str(tmp_path / "md")
    files.save_markdown(pages, md)
    files.save_markdown(pages.where("doc_id = 'doc_a'").withColumn("t", F.upper("t")), md)
    assert files.load_markdown(spark, md, "doc_a").first().md == "ONE\nTWO" and files.load_markdown(spark, md, "doc_b").count() == 1 and files.load_markdown(spark, md, "doc_c").count() == 0
    images = spark.createDataFrame([("doc_a", "f", "gif", b"g"), ("doc_a", "f", "JPG", b"j"), ("doc_a", "f", "bmp", b"b"), ("doc_a", "only", "bmp", b"b")], "doc_id string, image_id string, ext string, content binary")
    files.save_images(images, str(tmp_path / "im"))
    assert bytes(files.load_image(spark, str(tmp_path / "im"), "doc_a", "f").first().content) == b"j" and files.load_image(spark, str(tmp_path / "im"), "doc_a", "only").count() == 0
    files.save_manifests(spark.createDataFrame([("doc_a", '{"doc_id": "doc_a"}')], "doc_id string, manifest string"), str(tmp_path / "mf"))
    assert spark.read.json(str(tmp_path / "mf")).first().asDict() == {"doc_id": "doc_a", "manifest_path": str(tmp_path / "mf")}
    figures = spark.createDataFrame([("doc_a", "fig_1_1", 1, "", "p1", "png", 1, 1), ("doc_a", "fig_1_2", 1, "", "p2", "png", 1, 1), ("doc_a", "fig_1_3", 1, "", "p3", "png", 1, 1)], "doc_id string, id string, page int, caption string, path string, ext string, width int, height int")
    asked = spark.createDataFrame([("doc_a", f"fig_1_{k}") for k in range(1, 5)] + [("doc_z", "fig_1_1")], "doc_id string, asset_id string")
    got = {(r.doc_id, r.asset_id): r for r in files.fetched_figures(asked, figures, figures, spark.createDataFrame([("p1", b"x"), ("p3", b"y" * 2000)], "path string, content binary"), largest=0.001).collect()}
    assert [got["doc_a", f"fig_1_{k}"].error for k in range(1, 5)] == [None, "Image not found: p2", "Image not found: p3", "Figure not found: fig_1_4"] and got["doc_z", "fig_1_1"].error == "Manifest not found"
    assert base64.b64decode(got["doc_a", "fig_1_1"].image_base64) == b"x"
    assert [r.kb for r in files.size_kb(spark.createDataFrame([("a", 2048), ("b", None)], "path string, length long")).collect()] == [2.0, 0.0]


def test_graph_files(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    path = str(tmp_path / "graph.xml")
    body = "\n".join(r.value for r in files.as_graphml(graph.nodes(spark, sf), graph.edges(spark, sf)).collect())
    (tmp_path / "graph.xml").write_text(f"<graphml><graph>{body}<edge source='a' target='b'/></graph></graphml>")
    found, links = files.graphml(spark, path)
    assert {tuple(r)[:3] for r in found.collect()} == {tuple(r)[:3] for r in graph.nodes(spark, sf).collect()}
    assert links.where("source = 'a'").first().weight == "1.0" and links.count() == graph.edges(spark, sf).count() + 1
    parts = files.exported(spark, path, types=["nation"], limit=7)
    assert parts["nodes"].count() == 7 and [r.type for r in parts["types"].collect()] == ["nation"]
    with pytest.raises(ValueError, match="Unknown format"):
        files.exported(spark, path, "dot")
    with pytest.raises(FileNotFoundError):
        files.exported(spark, path + "x")
    desk = tools.Desk(Store.empty(spark), files.Jobs.empty(spark))
    assert desk.knowledge_graph_summary(spark, path + "x").startswith("Error: ") and "## Entity Types" in desk.knowledge_graph_summary(spark, path)
    n, e = graph.nodes(spark, sf), graph.edges(spark, sf)
    assert desk.consult_knowledge_graph("x") .startswith("Knowledge graph is not available") and desk.consult_knowledge_graph("zzzz", "hybrid", n, e) == "No results found."
    assert desk.consult_knowledge_graph("x", "odd", n, e).startswith("Query failed") and "→" in desk.compare("based", n, e)


def test_decoders(spark):
    class Toy:
        """A decoder of JSON that stands in for a page format."""

        def spans(self, content):
            return json.loads(content)["spans"]

        def tables(self, content):
            return json.loads(content)["tables"]

        def images(self, content):
            return [(p, how, "png", b"i" * n) for p, how, n in json.loads(content)["images"]]

        def metadata(self, content):
            return json.loads(content)["about"]

    spans = [(1, 0, 0, 0, 0, 20.0, 0, "Title"), (1, 0, 0, 1, 0, 10.0, 16, "bold"), (1, 0, 0, 1, 1, 10.0, 0, " rest"), (1, 0, 0, 2, 0, 10.0, 0, "  "), (1, 1, 1, 0, 0, 9.0, 0, "picture"), (2, 0, 0, 0, 0, 13.0, 0, "Sub")]
    body = json.dumps({"spans": spans, "tables": [(1, [["a", None], ["1", " 2 "]]), (2, [])], "images": [(1, "embedded", 5), (1, "vector", 6), (1, "grid", 7), (1, "embedded", 3000)], "about": {"author": "x"}}).encode()
    found = spark.createDataFrame([("f.pdf", body), ("bad.pdf", b"not json")], "path string, content binary")
    assert [r.t for r in extensions.extracted_pages(found, Toy()).orderBy("pg").collect()] == ["\n<!-- Page 1 -->\n# Title\n**bold** rest", "\n<!-- Page 2 -->\n### Sub"]
    assert [(r.id, r.markdown) for r in extensions.extracted_tables(found, Toy()).collect()] == [("tab_1", "| a |  |\n| --- | --- |\n| 1 | 2 |")]
    assert sorted(r.id for r in extensions.extracted_images(found, Toy(), largest=0.001).collect()) == ["fig_1_1", "fig_1_800", "fig_1_900"]
    assert {r.path: r.metadata for r in extensions.extracted_metadata(found, Toy()).collect()} == {"f.pdf": {"author": "x"}, "bad.pdf": None}


def test_extension_points(spark):
    assert extensions.chunker("nothing") is extensions.CHUNKERS["semantic"]
    extensions.register_chunker(spark, "by_line", lambda t: t.split("\n"))
    assert [tuple(r) for r in spark.sql("SELECT * FROM by_line('a\nb')").collect()] == [(0, "a"), (1, "b")]
    q = spark.createDataFrame([("x",), ("y",)], "question string")
    assert [r.answer for r in extensions.answers(q, lambda qs: ["" if k == "x" else "yes" for k in qs]).collect()] == ["No results found.", "yes"]

    def broken(qs):
        raise RuntimeError("down")

    assert {r.answer for r in extensions.answers(q, broken).collect()} == {"Query failed: down"}
    v = extensions.embedded(spark.createDataFrame([("a b",), (None,)], "text string"), extensions.offline_embedding).collect()
    assert [len(r.embedding) for r in v] == [768, 768] and abs(sum(x * x for x in v[0].embedding) - 1) < 1e-9


def test_chunks_of_own_sizes_and_places(spark):
    text = "<!-- Page 1 -->\n" + "One sentence here. " * 200
    docs = spark.createDataFrame([("d", text, "a.pdf")], "doc_id string, text string, filename string")
    for strategy in ("basic", "semantic", "auto", "no such"):
        got = chunking.located(chunking.smart(docs, strategy=strategy, custom=(200, 20, 10)), docs).orderBy("index").collect()
        assert got and all(r.start_char is None or text[r.start_char : r.end_char] == r.chunk for r in got)
        assert strategy != "basic" or max(len(r.chunk) for r in got) <= 200


def test_long_texts_are_cut_in_linear_time(spark):
    import time

    took = []
    for n in (40_000, 40_000, 160_000):
        df = spark.createDataFrame([("Some words of a sentence. " * (n // 26),)], "text string").select(F.size(chunking.basic(F.col("text"), 1000, 200, 100)))
        begin = time.time()
        assert df.first()[0] > n / 1000
        took.append(time.time() - begin)
    assert took[2] < 16 * took[1] + 2


def test_commands_answer_in_words(spark, desk):
    assert desk.list_tables().startswith("No tables") and desk.list_drafts().startswith("No drafts") and desk.delete_table("x").startswith("❌")
    made = desk.create_table("comparison", "T", COLUMNS)
    t = made.split("`")[1]
    assert made.startswith("✅") and "2 rows" in desk.add_rows(t, [{"Drug": "A", "Dose": 1}, {"Drug": "B", "Dose": 2}, {"Drug": "C"}]) and desk.add_rows(t, [{}]).startswith("❌ Failed") and desk.add_rows("x", []).startswith("❌ Error: Table not found")
    assert desk.update_row(t, 0, {"Drug": "Z", "Dose": 9}).startswith("✅") and desk.update_row(t, 9, {}).startswith("❌ Error: Invalid") and desk.update_cell(t, 0, "Dose", "7").startswith("✅ Cell") and desk.update_cell(t, 0, "?", "7").startswith("❌ Error: Unknown column")
    assert desk.delete_row(t, 1).endswith("1") and desk.render_table(t, "markdown").startswith("### T") and desk.render_table(t, "html").startswith("❌") and desk.render_table(t).startswith("✅")
    assert json.loads(desk.table_status(t))["row_count"] == 1 and desk.table_status("x") == "Table not found: x" and desk.table_content(t).startswith("### T") and f"`{t}`" in desk.list_tables()
    d = desk.create_table_draft("D", intent="summary").split("`")[1]
    assert desk.update_table_draft(d, proposed_columns=COLUMNS[:1], source_doc_ids=["no"]).startswith("✅") and desk.add_rows_to_draft(d, [{"Drug": "A"}, {"Nope": 1}]).endswith("2") and "1 rows had" in desk.commit_draft_to_table(d)
    assert json.loads(desk.draft_content(d))["source_doc_ids"] == [] and desk.draft_content("x") == "Draft not found: x" and "Has table" in desk.list_drafts() and desk.commit_draft_to_table("x").startswith("❌")
    assert "~" in desk.estimate_tokens(t, d, "some text") and "❌ Table error" in desk.estimate_tokens("x") and desk.estimate_tokens().endswith("estimate.")
    asked = spark.createDataFrame([("a.pdf", True), ("b.txt", True), ("c.pdf", False)], "filename string, there boolean")
    assert "1/3" in desk.ingest_documents(asked, F.col("there")) and "~30" in desk.ingest_documents(asked, F.col("there"), "j1") and "PENDING" in desk.get_job_status("j1")
    assert desk.cancel_job("j1").startswith("🚫") and desk.cancel_job("j1").startswith("❌") and desk.get_job_status("zz") == "Job not found: zz"
