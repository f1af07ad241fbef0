"""Operators that no query runs by itself."""

from datetime import datetime

from pyspark.sql import functions as F

from paperloom.functions import cells as C
from paperloom.functions import pagetext as P
from paperloom.operators import jobs as J
from paperloom.operators import learning as N
from paperloom.operators import quality as Q
from paperloom.operators import sheets as S
from paperloom.operators import survey as V
from paperloom.sources import files


def test_times_and_families(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 20, 0, 0),), (None,)], "t timestamp")
    assert [r[0] for r in df.select(C.display_time("t")).collect()] == ["02 Jan 2024, 03:00:00", None]
    fam = spark.createDataFrame([("", "s"), ("x", "s"), ("1", "n"), ("true", "b"), ("2", "n"), ("d", "d"), (None, None)], "t string, k string")
    got = [r[0] for r in fam.select(C.value_family(F.col("t"), F.col("k"))).collect()]
    assert got == ["empty", "text", "number", "bool", "number", "date", "empty"]
    assert spark.createDataFrame([(got,), (["empty"],)], "a array<string>").select(C.dominant_family(F.col("a"))).collect()[0][0] == "number"
    cat = spark.createDataFrame([("Mar-24", "s"), ("Jan 2024", "s"), ("x", "s"), ("5", "n"), (None, None)], "t string, k string")
    assert [r[0] for r in cat.select(C.category_family(F.col("t"), F.col("k"))).collect()] == ["date", "date", "text", "number", "text"]
    num = spark.createDataFrame([(50000000.0,), (1.5,), (None,)], "x double")
    assert [r[0] for r in num.select(C.stable_text("x", "n")).collect()] == ["50000000", "1.5", None]


def test_page_texts(spark):
    df = spark.createDataFrame([("# B\n## Satu\na\n## Dua\nb",)], "t string")
    assert [tuple(x) for x in df.select(P.split_sheets(F.col("t"))).first()[0]] == [("Satu", "a"), ("Dua", "b")]
    q = spark.createDataFrame([("baris\n dua ",), ("> **[Diagram/Visual]:** x",), ("",)], "t string")
    assert [r[0] for r in q.select(P.visual_description(F.col("t"))).collect()] == ["> **[Diagram/Visual]:** baris\n> dua", "> **[Diagram/Visual]:** x", ""]
    w = spark.createDataFrame([("dengan itu", "Dengan ini"), ("itu", "lain"), ("", "x")], "c string, h string")
    assert [r[0] for r in w.select(P.catchword_missing(F.col("c"), F.col("h"))).collect()] == [False, True, False]
    old, new = spark.createDataFrame([("d", 1, "a"), ("d", 2, "b")], "k string, n int, c string"), spark.createDataFrame([("d", 2, "B"), ("d", 3, "C")], "k string, n int, c string")
    assert {tuple(r) for r in P.upsert_pages(old, new, "k", "n").collect()} == {("d", 1, "a"), ("d", 2, "B"), ("d", 3, "C")}
    assert P.missing_pages(old.where("n = 2"), "k", "n", F.lit(4)).first()["missing"] == [1, 3, 4]


def test_reflow_and_density(spark):
    df = spark.createDataFrame([
        (["text"], ["journal"], "abcdefghij", "abcdefghij"), (["text"], ["journal"], "abcdefghij", "abc"), (["table"], ["journal"], "a", "a"), ([], ["journal"], "a", "a"), (["text"], ["slides"], "a", "a"), (["text"], ["journal"], "", ""),
    ], "k array<string>, s array<string>, a string, b string")
    got = [r[0] for r in df.select(Q.reflow_status(F.col("k"), F.col("s"), F.col("a"), F.col("b"), ("journal",), ("chat",), ("table",))).collect()]
    assert got == ["applied", "content_guard", "non_text_region", "missing_regions", "ineligible_spec", "empty_output"]
    m = Q.column_density(spark.createDataFrame([(1, [0.0, 1.0, 0.0, 1.0])], "k int, v array<double>"), "k", "v").withColumn("c", V.density_class(F.col("density"))).first()
    assert (m["density"], m["c"]) == (500.0, "filled")


def test_visual_plan(spark):
    sheets = spark.createDataFrame([("a", "dashboard", True), ("b", "plain", True), ("c", "detail", True), ("d", "plain", False)], "sheet string, role string, visible boolean")
    region = spark.createDataFrame([("a", 1, 2, 1, 2, "table"), ("a", 5, 9, 3, 4, "text"), ("b", 1, 2, 1, 2, "mixed"), ("b", 4, 5, 1, 2, "table"), ("c", 1, 2, 1, 2, "mixed"), ("d", 1, 2, 1, 2, "mixed")], "sheet string, min_row int, max_row int, min_col int, max_col int, kind string")
    plan = S.visual_plan(sheets, region, ["sheet"])
    assert {tuple(r) for r in plan.collect()} == {("a", 1, 9, 1, 4), ("b", 1, 2, 1, 2)}
    pictures = S.drawing_regions(spark.createDataFrame([("b", "Image 1", 2, None, 2, 3)], "sheet string, title string, min_row int, max_row int, min_col int, max_col int"), ["sheet"])
    assert {r["sheet"] for r in S.needs_visual_tables(plan, pictures, ["sheet"]).collect()} == {"b"}
    book = spark.createDataFrame([("x", 2, "Dua", "b", "T"), ("x", 1, "Satu", "a", "T")], "k string, tab_no int, sheet string, markdown string, t string")
    assert S.workbook_markdown(book, "k", "t").first()["text"] == "# T\n\n## Satu\n\na\n\n## Dua\n\nb\n"
    refs = spark.createDataFrame([("s", 1, "s", 2, 2), ("s", 1, "other", 2, 2), ("s", 1, "s", 9, 9)], "sheet string, region_no int, source_sheet string, source_row int, source_col int")
    area = spark.createDataFrame([("s", 1, 1, 3, 1, 3)], "sheet string, region_no int, min_row int, max_row int, min_col int, max_col int")
    assert S.external_references(refs, area, ["sheet"]).count() == 2


def test_listings_and_logs(spark, tmp_path):
    mem = spark.createDataFrame([("a", True, 1)], "k string, act boolean, t int")
    disk = spark.createDataFrame([("a", False, 9), ("b", False, 3), ("c", False, 5)], mem.schema)
    assert [r["k"] for r in J.merge_listings(mem, disk, "k", "act", "t").collect()] == ["a", "c", "b"]
    assert J.run_summary(disk, F.col("t") > 3).first().asDict() == {"total": 3, "n_success": 2, "n_error": 1, "status": "partial"}
    log = spark.createDataFrame([(1, "a"), (2, "b")], "id int, version string")
    assert [r["previous_version"] for r in N.previous_release(log).orderBy("id").collect()] == [None, "a"]
    assert N.upsert(log, spark.createDataFrame([(2, "c")], log.schema), "id").orderBy("id").collect()[1]["version"] == "c"
    pair = spark.createDataFrame([((0.5, 0.5, 0.5), (0.6, 0.5, 0.55)), ((0.5, 0.5, 0.5), (0.9, 0.4, 0.65))], "b struct<text_score:double,table_score:double,score:double>, c struct<text_score:double,table_score:double,score:double>")
    assert [r[0] for r in pair.select(N.is_improvement(F.col("b"), F.col("c"))).collect()] == [True, False]
    (tmp_path / "a.pdf").write_bytes(b"x")
    now = files.document_files(spark, tmp_path.as_uri())
    assert files.unchanged(now, now).count() == 1 and files.unchanged(now, now.withColumn("bytes", F.col("bytes") + 1)).count() == 0
