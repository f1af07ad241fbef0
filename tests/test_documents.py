import io
import zipfile

import pytest
from pyspark.sql import functions as F

from paperloom import sql
from paperloom.operators import hierarchy as H
from paperloom.operators import jobs as J
from paperloom.operators import learning as N
from paperloom.operators import sheets as S
from paperloom.operators import survey as V
from paperloom.operators.vectors import cosine_topk
from paperloom.sources import files, ooxml
from paperloom.streaming import jobs as Z

CELL = "sheet string, row int, col int, text string, kind string, formula string"


def sheet(spark, rows, name="s"):
    """Cells from rows of values; a text that begins with = is a formula."""
    out = []
    for r, row in enumerate(rows, 1):
        for c, v in enumerate(row, 1):
            if v is not None:
                formula = v if isinstance(v, str) and v.startswith("=") else None
                out.append((name, r, c, None if formula else str(v), "n" if formula or isinstance(v, (int, float)) else "s", formula))
    return spark.createDataFrame(out, CELL)


def bounds(df):
    return [tuple(r[c] for c in ("min_row", "max_row", "min_col", "max_col", "kind")) for r in df.orderBy("region_no").collect()]


def test_regions(spark):
    x = sheet(spark, [["A", "B", None, None], [1, 2, None, None], [None, None, "C", "D"], [None, None, 3, 4]])
    assert bounds(S.regions(x, ["sheet"])) == [(1, 2, 1, 2, "table"), (3, 4, 3, 4, "table")]
    stacked = sheet(spark, [["K", "V", "W"], ["a", 1, 2], ["b", 3, 4], ["P", "Q", None], [5, 6, None], [7, 8, None]])
    assert [b[:2] for b in bounds(S.regions(stacked, ["sheet"]))] == [(1, 3), (4, 6)]
    params = sheet(spark, [["Division Head", "All"], ["Region", "All"]])
    assert bounds(S.regions(params, ["sheet"]))[0][4] == "text"
    touching = sheet(spark, [["A", "B", "C", "D"], [1, 2, 3, 4], [5, 6, 7, 8]])
    declared = spark.createDataFrame([("s", 0, 1, 3, 1, 2), ("s", 0, 1, 3, 3, 4), ("s", 1, 1, 2, 2, 3)], "sheet string, priority int, min_row int, max_row int, min_col int, max_col int")
    assert bounds(S.regions(touching, ["sheet"], declared)) == [(1, 3, 1, 2, "table"), (1, 3, 3, 4, "table")]
    assert S.regions(x.limit(0), ["sheet"]).count() == 0


def test_row_roles(spark):
    rows = [["Status", "Department", "Count", "Cost"]]
    for k, name in enumerate(("Open", "Closed")):
        top = len(rows) + 1
        rows += [[name, f"D{i}", i, 100.0 * i] for i in (1, 2, 3)]
        rows.append([f"{name} Total", None, f"=SUM(C{top}:C{top + 2})", f"=SUM(D{top}:D{top + 2})"])
    rows += [["Grand Total", None, 12, 1200.0]]
    x = sheet(spark, rows)
    head = S.header_rows(x, ["sheet"])
    assert head.first()["header_row"] == 1
    roles = {r["row"]: r["row_role"] for r in S.row_roles(x, ["sheet"], head).collect()}
    assert [roles[k] for k in range(2, 11)] == ["data"] * 3 + ["subtotal"] + ["data"] * 3 + ["subtotal", "grand_total"]


def test_coverage_and_crossing(spark):
    x = sheet(spark, [["A", "B"], [1, 2], [None, None], ["C", "D"], [3, 4]])
    r = S.regions(x, ["sheet"])
    refs = spark.createDataFrame([("s", 1, 2, 1, 1), ("s", 1, 2, 1, 1), ("s", 2, 2, 1, 2)], "sheet string, min_row int, max_row int, min_col int, max_col int")
    assert {t["region_no"]: (t["n_cells"], t["n_covered"]) for t in S.coverage(r, x, refs, ["sheet"]).collect()} == {1: (4, 3), 2: (4, 0)}
    spans = spark.createDataFrame([("s", 1, 1, 5, 1, 1), ("s", 2, 1, 2, 1, 1)], "sheet string, range_id int, min_row int, max_row int, min_col int, max_col int")
    assert [tuple(t) for t in S.crossing_ranges(spans, r, ["sheet"]).collect()] == [("s", 1, 2)]
    assert S.region_markdown(x.where("row <= 2"), ["sheet"]).first()["markdown"] == "| A | B |\n| --- | --- |\n| 1 | 2 |"
    vals = S.reference_values(spark.createDataFrame([("s", 9, 1, 2, 1, 2)], "sheet string, ref_id int, min_row int, max_row int, min_col int, max_col int"), x, ["sheet"]).first()
    assert vals["cell_values"] == ["A", "B", "1", "2"]
    holes = spark.createDataFrame([("s", 2, 2), ("s", 9, 9)], "sheet string, row int, col int")
    around = spark.createDataFrame([("s", 2, 1), ("s", 2, 3), ("s", 9, 8)], "sheet string, row int, col int")
    assert [tuple(t) for t in S.bridging_cells(holes, around, ["sheet"]).collect()] == [("s", 2, 2)]


EVENT = "doc string, seq long, kind string, ordinal string, label string, text string, page long"


def events(spark, rows):
    return spark.createDataFrame([("d", i, k, o, None, t, 1) for i, (k, o, t) in enumerate(rows, 1)], EVENT)


def test_tree(spark):
    e = events(spark, [("judul", None, "T"), ("pembukaan", None, "M"), ("bab", "I", None), ("pasal", "1", None), ("ayat", "1", "x"), ("huruf", "a", "y"), ("teks", None, "z"), ("ayat", "2", "w"), ("pasal", "2", None), ("bab", "II", None)])
    assert [r["parent_seq"] for r in H.parents(e).orderBy("seq").collect()] == [None, 1, 1, 3, 4, 5, 6, 4, 3, 1]
    assert [(r["kind"], r["ordinal"]) for r in H.open_path(e).orderBy("depth").collect()] == [("judul", None), ("bab", "II")]
    text = H.render(e, with_pages=False).first()["text"]
    assert "## BAB I" in text and "#### Pasal 1" in text and "- (1) x" in text and "  - a. y" in text


def test_ordinals(spark):
    e = events(spark, [("pasal", o, None) for o in ("1", "2", "L2", "4", "4A", "5", "7", "6", "20")])
    got = [(r["seq"], r["severity"], r["proposed"]) for r in H.ordinal_audit(e).orderBy("seq").collect()]
    assert got == [(3, "perbaiki", "3"), (7, "eskalasi", None), (8, "eskalasi", None), (9, "eskalasi", None)]
    resets = events(spark, [("pasal", "1", None), ("ayat", "1", None), ("ayat", "2", None), ("pasal", "2", None), ("ayat", "1", None)])
    assert H.ordinal_audit(resets).count() == 0 and H.ordinal_audit(resets.limit(0)).count() == 0
    assert "PERBAIKI" in H.violation_report(H.ordinal_audit(e)).first()["report"]


def test_amounts(spark):
    e = events(spark, [
        ("pasal", "2", "Anggaran"), ("huruf", "a", "belanja Rp 300,00"), ("pasal", "3", "rincian Pasal 2 huruf a"), ("huruf", "a", "x Rp 100,00"), ("huruf", "b", "y Rp 150,00"),
    ])
    assert [tuple(r) for r in H.amount_audit(e).collect()] == [("d", 3, 250.0, 300.0)]
    assert H.count_amount_checks(e).first()["n_checks"] == 1


def test_components_and_splits(spark):
    x = spark.createDataFrame([(i, f"a{i // 2}", f"b{(i + 1) // 2}" if i < 20 else None) for i in range(30)] + [(99, None, None)], "id long, k1 string, k2 string")
    root = {r["id"]: r["root"] for r in N.components(x, "id", ["k1", "k2"]).collect()}
    assert all(root[i] == 0 for i in range(20)) and root[21] == 20 and root[99] == 99
    with pytest.raises(ValueError):
        N.tail_split(spark.createDataFrame([(1,)], "root long"))
    parts = N.tail_split(spark.createDataFrame([(i,) for i in range(23)], "root long")).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in parts} == {"train": 15, "validation": 4, "test": 4}
    import hashlib

    fixed = spark.createDataFrame([(f"r{i}",) for i in range(40)], "root string")
    assert all(s == N.SPLITS[int(hashlib.sha256(r.encode()).hexdigest(), 16) % 5] for r, s in fixed.select("root", N.fixed_split(F.col("root"))).collect())
    pins = spark.createDataFrame([(0, "train"), (1, "test"), (25, "train")], "id long, split string")
    assert N.pinned_conflicts(N.components(x, "id", ["k1", "k2"]), pins, "id").first()["pins"] == ["test", "train"]


def test_scores():
    assert N.score_text("a\n| x | 1 |", "a\n| x | 1 |")[:3] == (1.0, 1.0, 1.0) and N.score_text("a 5", "")[2] == 0.0 and N.score_text("nilai 5", "nilai 6")[3] == 2


def test_latest(spark):
    log = spark.createDataFrame([(1, "d", 1, True), (2, "d", 1, False), (3, "e", 1, True)], "id long, doc string, page int, ready boolean")
    assert [r["id"] for r in N.latest_ready(log, ["doc", "page"], "id", F.col("ready")).collect()] == [3]


def test_jobs(spark):
    assert J.indices_of("1,5,10-12,x,") == [(1, 1), (5, 5), (10, 12)]
    f = spark.createDataFrame([("a", f"f{i}.pdf") for i in range(8)] + [("b", "g.docx")], "folder string, name string")
    assert [r["name"] for r in J.select_batch(f, "folder", "name", indices="2-3,9").collect()] == ["f1.pdf", "f2.pdf", "g.docx"]
    assert [r["name"] for r in J.select_batch(f, "folder", "name", pattern="f?.pdf", per_folder=2, limit=5).collect()] == ["f0.pdf", "f1.pdf"]
    s = J.seeded_sample(f, "name", 3, 1, f.where("name = 'f0.pdf'"))
    assert [r["name"] for r in s.collect()] == [r["name"] for r in s.collect()] and s.count() == 3
    logs = spark.createDataFrame([("j", 1, "Memproses Halaman 3 / 10 dari 'x'"), ("j", 2, "lain"), ("j", 3, "Sub-Agent SQL mulai"), ("k", 1, "[Slide 2/8]")], "job string, n int, line string")
    assert {r["job"]: (r["current_page"], r["total_pages"], r["stage"]) for r in J.latest_progress(logs, "job", "n", "line").collect()} == {"j": (3, 10, "tabular"), "k": (2, 8, "page")}
    up = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "a", "y")], "n int, path string, c string")
    assert {r["n"] for r in J.dedupe_uploads(up, "path", F.col("c"), "n").collect()} == {1, 3}


def test_survey(spark):
    p = spark.createDataFrame([("d", i, "table", [0.1, 0.5 + (0.005 * i if i < 5 else 0.2)]) for i in range(1, 9)] + [("d", 9, "text", None)], "doc string, p int, m string, s array<double>")
    spans = [r["span"] for r in V.spans(p, "doc", "p", "m", "s").orderBy("p").collect()]
    assert spans == [1, 1, 1, 1, 2, 2, 2, 2, 3]
    b = spark.createDataFrame([("s", i, i in (12, 21)) for i in range(1, 31)], "g string, p int, st boolean")
    assert [(r["first_page"], r["last_page"]) for r in V.plan_batches(b, "g", "p", "st").orderBy("batch").collect()] == [(1, 11), (12, 20), (21, 30)]


def test_nearest(spark):
    rows = [(i, [float(i % 3), 1.0]) for i in range(20)] + [(50, None), (51, [0.0, 0.0]), (52, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = cosine_topk(df.where("vec_id = 0 OR vec_id > 40"), df, "vec_id", "embedding", 3).where("query_id = 0").orderBy("rank").collect()
    assert [r["vec_id"] for r in out] == [0, 3, 6]
    assert cosine_topk(df.limit(0), df, "vec_id", "embedding", 3).count() == 0


def xlsx():
    buffer = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="Data" sheetId="1" r:id="rId1"/><sheet name="Tersembunyi" sheetId="2" state="hidden" r:id="rId2"/></sheets></workbook>')
        rel = "http://schemas.openxmlformats.org/package/2006/relationships"
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{rel}"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Nama</t></si><si><r><t>Sal</t></r><r><t>do</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2" t="inlineStr"><is><t>x</t></is></c><c r="B2"><f>SUM(B3:B4)</f><v>12.5</v></c><c r="C2" s="1"><v>45236</v></c><c r="D2" t="b"><v>1</v></c></row></sheetData><mergeCells><mergeCell ref="A1:A1"/></mergeCells></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1"><v>7</v></c></row></sheetData></worksheet>')
    return buffer.getvalue()


def pptx():
    buffer = io.BytesIO()
    ns = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    rel = "http://schemas.openxmlformats.org/package/2006/relationships"
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("ppt/presentation.xml", f'<p:presentation {ns}><p:sldIdLst><p:sldId id="1" r:id="rId1"/></p:sldIdLst></p:presentation>')
        z.writestr("ppt/_rels/presentation.xml.rels", f'<Relationships xmlns="{rel}"><Relationship Id="rId1" Target="slides/slide1.xml"/></Relationships>')
        cell = lambda t: f"<a:tc><a:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></a:txBody></a:tc>"
        z.writestr("ppt/slides/slide1.xml", f'<p:sld {ns}><p:cSld><p:spTree><p:sp><p:nvSpPr><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>Rapat</a:t></a:r></a:p></p:txBody></p:sp><p:sp><p:txBody><a:p><a:r><a:t>Poin satu</a:t></a:r></a:p></p:txBody></p:sp><a:tbl><a:tr>{cell("A")}{cell("B")}</a:tr><a:tr>{cell("1")}{cell("2")}</a:tr></a:tbl></p:spTree></p:cSld></p:sld>')
    return buffer.getvalue()


def test_sources(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.xlsx").write_bytes(xlsx())
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    (tmp_path / "p.pptx").write_bytes(pptx())
    (tmp_path / "note.txt").write_text("x")
    (tmp_path / ".git").mkdir()
    cells = {(r["sheet"], r["coordinate"]): r for r in ooxml.read_workbooks(spark, tmp_path.as_uri()).collect()}
    assert cells["Data", "A1"]["text"] == "Nama" and cells["Data", "B1"]["text"] == "Saldo" and cells["Data", "B2"]["formula"] == "=SUM(B3:B4)" and cells["Data", "C2"]["text"] == "2023-11-06T00:00:00"
    assert cells["Data", "D2"]["kind"] == "b" and not cells["Tersembunyi", "A1"]["visible"] and len(cells) == 7
    slide = ooxml.read_presentations(spark, tmp_path.as_uri()).first()
    assert slide["title"] == "Rapat" and "- Poin satu" in slide["markdown"] and "| A | B |\n| --- | --- |\n| 1 | 2 |" in slide["markdown"]
    found = files.document_files(spark, tmp_path.as_uri()).select("name").collect()
    assert {r["name"] for r in found} == {"a.xlsx", "bad.xlsx", "p.pptx"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "it's", None, "i")], "n int, s string, d double, _src string")
    assert df.transform(lambda x: files.sql_statements(x, "t")).first()[0] == "INSERT INTO \"t\" (\"n\", \"s\", \"d\", \"_src\") VALUES (1, 'it''s', NULL, 'i');"
    assert files.create_statement(df, "t") == 'CREATE TABLE "t" ("n" INTEGER, "s" TEXT, "d" REAL, "_src" TEXT);'
    with zipfile.ZipFile(io.BytesIO(files.zip_tables({"t": df, "T": df}))) as z:
        assert z.namelist() == ["t.csv", "T_2.csv"] and "_src" not in z.read("t.csv").decode()
    files.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["n", "s", "d"]
    files.write_json_lines(df, str(tmp_path / "j"))
    files.write_json_lines(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1
    files.manifest(spark, (tmp_path / "m.json").as_uri(), {"a": 1})
    assert (tmp_path / "m.json").read_text() == '{\n "a": 1\n}'
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "doc.md").write_text("# T")
    (tmp_path / "x" / "doc.json").write_text("{}")
    (tmp_path / "y").mkdir()
    (tmp_path / "y" / "doc.md").write_text("# U")
    found = {(r["folder"].rpartition("/")[2], r["doc"], r["text"], r["meta"]) for r in files.read_extractions(spark, tmp_path.as_uri()).collect()}
    assert found == {("x", "doc", "# T", "{}"), ("y", "doc", "# U", None)}


def test_sql_surface(spark):
    sql.register(spark)
    row = spark.sql("SELECT parse_number('(Rp 1.234,5)'), parse_date_iso('1/2/24'), clean_cell(' **a  b** '), sanitize_ident('2 Nd')").first()
    assert tuple(row) == (-1234.5, "2024-02-01", "a b", "col_2_nd")
    assert spark.sql("SELECT headers FROM markdown_tables('| A | B |\n|---|---|\n| 1 | 2 |')").first()[0] == ["A", "B"]
    assert sql.run_select(spark, "SELECT id FROM range(500)")["rows"].__len__() == 100
    for bad in ("DROP TABLE x", "WITH a AS (SELECT 1) SELECT 1", "SELECT 1; SELECT 2", "", "SELECT nope FROM nowhere"):
        assert sql.run_select(spark, bad)["error"]
    assert sql.run_select(spark, "SELECT 'drop table' AS x")["rows"] == [("drop table",)]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [("a", 1, "running"), ("a", 2, "queued"), ("b", 3, "paused"), ("a", 4, "completed")]
    spark.createDataFrame(rows, "job string, seq long, status string").coalesce(1).write.mode("overwrite").json(str(tmp_path / "in"))
    s = spark.readStream.schema("job string, seq long, status string").json(str(tmp_path / "in"))
    q = Z.job_states(s).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("states").collect()} == {("a", "completed", 3, 1), ("b", "queued", 1, 1)}
    ev = events(spark, [("bab", "I", None), ("pasal", "3", None), ("ayat", "2", None)]).select("doc", "seq", "kind", "ordinal")
    ev.coalesce(1).write.mode("overwrite").json(str(tmp_path / "e"))
    e = spark.readStream.schema("doc string, seq long, kind string, ordinal string").json(str(tmp_path / "e"))
    q = Z.clause_cursor(e).writeStream.outputMode("update").format("memory").queryName("cursor").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("cursor").first()["open_path"] == "bab I > pasal 3 > ayat 2"
    q = Z.append_pages(e, str(tmp_path / "out"), str(tmp_path / "cc"), "1 second")
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    seen = Z.complete_pages(spark.createDataFrame([("d", "p1\n---\nhalf"), ("e", "none")], "k string, t string"), "k", "t")
    assert [r["visible"] for r in seen.orderBy("k").collect()] == ["p1", ""]
