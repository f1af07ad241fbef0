"""Queries over made-up workbooks, one per supplier, whose layout follows from the supplier's key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import cells as C
from paperloom.operators import sheets as S
from paperloom.session import load

K = ["book"]


def _books(spark: SparkSession, d: str) -> DataFrame:
    """book, m: the supplier's key and how many rows its first table has."""
    return load(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("book"), (3 + F.col("s_suppkey") % 4).cast("int").alias("m"), F.col("s_name").alias("name"))


def _cell(row: Column, col: int, text: Column, kind: str, formula: Column | None = None) -> Column:
    nothing = F.lit(None).cast("string")
    return F.struct(row.cast("int").alias("row"), F.lit(col).alias("col"), text.cast("string").alias("text"), F.lit(kind).alias("kind"), (nothing if formula is None else formula).alias("formula"))


def _layout(spark: SparkSession, d: str) -> DataFrame:
    """A table of m rows under a header, right below it a second one with other columns, beside them a parameter block, further down a few cells.

    book, row, col, text, kind, formula.
    """
    m, one = F.col("m"), F.lit(1)
    fixed = [
        *[_cell(one, c, F.lit(t), "s") for c, t in ((1, "Nama"), (2, "Jumlah"), (3, "Nilai"))], *[_cell(m + 2, c, F.lit(t), "s") for c, t in ((1, "Wilayah"), (2, "Total"))],
        *[_cell(m + r, 1, F.lit(10 * r), "n") for r in (3, 4)], *[_cell(m + r, 2, F.lit(10 * r + 1), "n", F.format_string("=SUM(B2:B%d)", m + 1)) for r in (3, 4)],
        _cell(one, 6, F.lit("Periode:"), "s"), _cell(one, 7, F.lit("2024"), "s"), _cell(F.lit(2), 6, F.lit("Cabang:"), "s"), _cell(F.lit(2), 7, F.lit("(Semua)"), "s"),
        *[_cell(F.lit(20 + k), 1 + k, F.lit(k), "n") for k in range(3)],
    ]
    rows = F.flatten(F.transform(F.sequence(F.lit(2), m + 1), lambda r: F.array(_cell(r, 1, F.concat(F.lit("Baris "), r.cast("string")), "s"), _cell(r, 2, r * 2, "n"), _cell(r, 3, r * 3, "n"))))
    return _books(spark, d).select("book", F.explode(F.concat(F.array(*fixed), rows)).alias("c")).select("book", "c.*")


def _declared(spark: SparkSession, d: str) -> DataFrame:
    """A table area over the cells further down, and a name that overlaps it."""
    areas = F.array(*[F.struct(F.lit(p).alias("priority"), *[F.lit(v).alias(n) for v, n in zip(b, ("min_row", "max_row", "min_col", "max_col"))]) for p, b in ((0, (20, 24, 1, 4)), (1, (22, 30, 1, 2)))])
    return _books(spark, d).select("book", F.explode(areas).alias("a")).select("book", "a.*")


def _regions(spark: SparkSession, d: str) -> DataFrame:
    return S.regions(_layout(spark, d), K, _declared(spark, d))


def layouts(spark: SparkSession, d: str) -> DataFrame:
    """The regions of every workbook: declared ones, tables parted at a header between them, parameter blocks."""
    return _regions(spark, d)


def crossing(spark: SparkSession, d: str) -> DataFrame:
    """Chart ranges that touch more than one region."""
    m = F.col("m")
    spots = F.array(*[F.struct(F.lit(i).alias("range_id"), a.cast("int").alias("min_row"), z.cast("int").alias("max_row"), F.lit(1).alias("min_col"), F.lit(c).alias("max_col")) for i, a, z, c in ((1, m, m + 3, 2), (2, F.lit(2), m, 3), (3, F.lit(1), F.lit(24), 7))])
    ranges = _books(spark, d).select("book", F.explode(spots).alias("r")).select("book", "r.*")
    return S.crossing_ranges(ranges, _regions(spark, d), K)


def _references(spark: SparkSession, d: str) -> DataFrame:
    """The formulas of the second table as references to the region they point at."""
    x = _layout(spark, d).where(F.col("formula").isNotNull())
    refs = x.select("book", "row", "col", F.explode(C.formula_references("formula", F.col("book").cast("string"), F.array(F.col("book").cast("string")))).alias("r")).select("book", "row", "col", "r.*")
    r = _regions(spark, d).select("book", "region_no", *[F.col(c).alias(f"_{c}") for c in ("min_row", "max_row", "min_col", "max_col")])
    hit = F.col("min_row").between(F.col("_min_row"), F.col("_max_row")) & F.col("min_col").between(F.col("_min_col"), F.col("_max_col"))
    return refs.join(r, "book").where(hit).select("book", "region_no", F.col("book").alias("source_sheet"), F.col("row").alias("source_row"), F.col("col").alias("source_col"), "min_row", "max_row", "min_col", "max_col")


def external(spark: SparkSession, d: str) -> DataFrame:
    """References from outside the region they point at; one in three is moved inside."""
    x = _references(spark, d).withColumn("source_row", F.when(F.col("book") % 3 == 0, F.lit(2)).otherwise(F.col("source_row")))
    return S.external_references(x, _regions(spark, d), K).select("book", "region_no", "source_row", "source_col")


def formulas(spark: SparkSession, d: str) -> DataFrame:
    """What formulas name, texts in quotes, unknown sheets and functions left out."""
    b = _books(spark, d)
    text = F.format_string("=SUM($B$2:B%d)+'Data ''24'!C%d*LOG10(7)&\"A1\"&Lain!A1+d%d:a1", F.col("m") + 1, F.col("m"), F.col("m"))
    refs = C.formula_references(text, F.lit("Ringkas"), F.array(F.lit("Ringkas"), F.lit("Data '24")))
    return b.select("book", F.posexplode(refs).alias("k", "r")).select("book", "k", "r.*")


def fed_dashboards(spark: SparkSession, d: str) -> DataFrame:
    """Sheets that a dashboard reads: suppliers depend on the next one, every fifth is a dashboard."""
    b = _books(spark, d)
    depends = b.select(F.lit(1).alias("wb"), F.col("book").alias("sheet"), (F.col("book") + 1).alias("depends_on")).unionByName(b.select(F.lit(1).alias("wb"), F.col("book").alias("sheet"), (F.col("book") + 2).alias("depends_on")))
    boards = b.where(F.col("book") % 5 == 0).select(F.lit(1).alias("wb"), F.col("book").alias("sheet"))
    return S.feeds_dashboards(depends, boards, ["wb"]).select("sheet")


def reference_values(spark: SparkSession, d: str) -> DataFrame:
    """The cells of one range of each workbook, from left to right and top to bottom."""
    refs = _books(spark, d).select("book", F.lit(1).alias("ref_id"), F.lit(1).alias("min_row"), F.lit(3).alias("max_row"), F.lit(2).alias("min_col"), F.lit(3).alias("max_col"))
    return S.reference_values(refs, _layout(spark, d), K).select("book", "ref_id", F.array_join("cell_values", ";", "").alias("cell_values"))


def artefacts(spark: SparkSession, d: str) -> DataFrame:
    """What each workbook holds: cells, formulas, tables and other regions."""
    return S.native_artefacts(_layout(spark, d), _regions(spark, d), K)


def bridges(spark: SparkSession, d: str) -> DataFrame:
    """Empty cells with a style that hold a table together."""
    m = F.col("m")
    spots = F.array(*[F.struct(r.cast("int").alias("row"), F.lit(c).alias("col")) for r, c in ((m + 2, 3), (F.lit(21), 1), (F.lit(21), 3), (m + 3, 3), (F.lit(1), 5), (F.lit(0), 1), (F.lit(1), 4))])
    styled = _books(spark, d).select("book", F.explode(spots).alias("s")).select("book", "s.*")
    filled = _layout(spark, d).where("NOT (row = 21 AND col = 2)").unionByName(_books(spark, d).select("book", _cell(m + 2, 4, F.lit("x"), "s").alias("c")).select("book", "c.*"))
    return S.bridging_cells(styled, filled, K)


def drawings(spark: SparkSession, d: str) -> DataFrame:
    """Pictures as regions; every other one lacks its end anchor, every third has it before the start."""
    b, k = _books(spark, d), F.col("book")
    end = lambda start: F.when(k % 2 == 0, F.lit(None).cast("int")).when(k % 3 == 0, F.lit(start - 1)).otherwise(F.lit(start + 5))
    x = b.select("book", F.col("name").alias("title"), F.lit(4).alias("min_row"), end(4).alias("max_row"), F.lit(2).alias("min_col"), end(2).alias("max_col"))
    return S.drawing_regions(x, K)


def _planned(spark: SparkSession, d: str) -> DataFrame:
    b = _books(spark, d)
    role = F.element_at(F.array(*map(F.lit, ("dashboard", "detail", "plain", "summary"))), (F.col("book") % 4 + 1).cast("int"))
    sheets = b.select("book", role.alias("role"), (F.col("book") % 7 != 0).alias("visible"))
    mixed = S.drawing_regions(b.select("book", F.lit("x").alias("title"), F.lit(40).alias("min_row"), (40 + F.col("m")).alias("max_row"), F.lit(2).alias("min_col"), F.lit(9).alias("max_col")), K)
    columns = ["book", "min_row", "max_row", "min_col", "max_col", "kind"]
    return S.visual_plan(sheets, _regions(spark, d).select(columns).unionByName(mixed.select(columns)), K)


def visual_plan(spark: SparkSession, d: str) -> DataFrame:
    """What of each workbook must be looked at as a picture."""
    return _planned(spark, d)


def visual_tables(spark: SparkSession, d: str) -> DataFrame:
    """Planned rectangles that a pasted picture touches; every third workbook has one."""
    pictures = _books(spark, d).where("book % 3 = 0").select("book", F.lit(39).alias("min_row"), F.lit(41).alias("max_row"), F.lit(1).alias("min_col"), F.lit(2).alias("max_col"))
    return S.needs_visual_tables(_planned(spark, d), pictures, K)


def _markdowns(spark: SparkSession, d: str) -> DataFrame:
    x = _layout(spark, d).where("row <= 3 AND col <= 3").withColumn("text", F.when((F.col("row") == 2) & (F.col("col") == 1), "a|b\nc").otherwise(F.col("text")))
    return S.region_markdown(x, K)


def region_markdown(spark: SparkSession, d: str) -> DataFrame:
    """The top of each workbook's first table as a pipe table."""
    return _markdowns(spark, d)


def workbook_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Workbooks of three sheets as one text, in the order of their tabs."""
    x = _markdowns(spark, d).select(F.floor(F.col("book") / 3).alias("wb"), (9 - F.col("book") % 3).alias("tab_no"), F.concat(F.lit("Lembar "), F.col("book").cast("string")).alias("sheet"), "markdown", F.lit("Buku").alias("title"))
    return S.workbook_markdown(x, "wb", "title")


def value_families(spark: SparkSession, d: str) -> DataFrame:
    """The family most cells of a column have."""
    x = _layout(spark, d).withColumn("f", C.value_family(F.col("text"), F.col("kind")))
    g = x.groupBy("book", "col").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "f"))), lambda s: s["f"]).alias("fs"))
    return g.select("book", "col", C.dominant_family(F.col("fs")).alias("family"))


def header_rows(spark: SparkSession, d: str) -> DataFrame:
    """Which rows of a sheet open a table although no blank row stands before them."""
    r = _regions(spark, d).where("source = 'cells' AND min_col = 1 AND min_row > 1")
    return r.select("book", F.col("min_row").alias("row"), "kind")


QUERIES = {
    "books_layouts": layouts, "books_crossing": crossing, "books_external": external, "books_formulas": formulas, "books_fed": fed_dashboards, "books_values": reference_values, "books_artefacts": artefacts,
    "books_bridges": bridges, "books_drawings": drawings, "books_plan": visual_plan, "books_pictures": visual_tables, "books_markdown": region_markdown, "books_text": workbook_markdown,
    "books_families": value_families, "books_header_breaks": header_rows,
}

_B = "b AS (SELECT s_suppkey AS book, CAST(3 + s_suppkey % 4 AS INTEGER) AS m, s_name AS name FROM supplier)"
_R = f"""WITH {_B}, r AS (
    SELECT book, 1 AS region_no, 1 AS min_row, m + 1 AS max_row, 1 AS min_col, 3 AS max_col, 3 * (m + 1) AS n_cells, 'table' AS kind, 'cells' AS source FROM b
    UNION ALL SELECT book, 2, 1, 2, 6, 7, 4, 'text', 'cells' FROM b UNION ALL SELECT book, 3, m + 2, m + 4, 1, 2, 6, 'table', 'cells' FROM b UNION ALL SELECT book, 4, 20, 24, 1, 4, 3, 'table', 'table' FROM b)
"""
_P = f"""{_R}, p AS (SELECT book, 1 AS min_row, 40 + m AS max_row, 1 AS min_col, 9 AS max_col FROM b WHERE book % 4 = 0 AND book % 7 <> 0 UNION ALL SELECT book, 40, 40 + m, 2, 9 FROM b WHERE book % 4 IN (2, 3) AND book % 7 <> 0)"""
_T = r"'| Nama | Jumlah | Nilai |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| a\|b c | 4 | 6 |' || chr(10) || '| Baris 3 | 6 | 9 |'"
ORACLE = {
    "books_layouts": _R + "SELECT * FROM r",
    "books_crossing": _R + "SELECT book, range_id, n_regions FROM b, (VALUES (1, 2), (3, 4)) v(range_id, n_regions)",
    "books_external": f"WITH {_B} SELECT book, 1 AS region_no, m + k AS source_row, 2 AS source_col FROM b, (VALUES (3), (4)) v(k) WHERE book % 3 <> 0",
    "books_formulas": f"""WITH {_B} SELECT book, k, sheet, CASE k WHEN 0 THEN 2 WHEN 1 THEN m ELSE 1 END AS min_row, CASE k WHEN 0 THEN m + 1 ELSE m END AS max_row, CASE k WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 1 END AS min_col, CASE k WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 4 END AS max_col
        FROM b, (VALUES (0, 'Ringkas'), (1, 'Data ''24'), (2, 'Ringkas')) v(k, sheet)""",
    "books_fed": "SELECT DISTINCT s_suppkey + k AS sheet FROM supplier, (VALUES (1), (2)) v(k) WHERE s_suppkey % 5 = 0",
    "books_values": "SELECT s_suppkey AS book, 1 AS ref_id, 'Jumlah;Nilai;4;6;6;9' AS cell_values FROM supplier",
    "books_artefacts": f"WITH {_B} SELECT book, 3 * (m + 1) + 13 AS n_cells, 2 AS n_formulas, 3 AS n_tables, 1 AS n_other FROM b",
    "books_bridges": f"WITH {_B} SELECT book, m + 2 AS row, 3 AS col FROM b UNION ALL SELECT book, 0, 0 FROM b WHERE false",
    "books_drawings": "SELECT s_suppkey AS book, s_name AS title, 4 AS min_row, CASE WHEN s_suppkey % 2 = 0 OR s_suppkey % 3 = 0 THEN 4 ELSE 9 END AS max_row, 2 AS min_col, CASE WHEN s_suppkey % 2 = 0 OR s_suppkey % 3 = 0 THEN 2 ELSE 7 END AS max_col, 'mixed' AS kind FROM supplier",
    "books_plan": _P + "SELECT * FROM p",
    "books_pictures": _P + "SELECT * FROM p WHERE book % 3 = 0",
    "books_markdown": f"SELECT s_suppkey AS book, {_T} AS markdown FROM supplier",
    "books_text": f"SELECT s_suppkey // 3 AS wb, '# Buku' || chr(10) || chr(10) || string_agg('## Lembar ' || s_suppkey || chr(10) || chr(10) || {_T}, chr(10) || chr(10) ORDER BY s_suppkey % 3 DESC) || chr(10) AS text FROM supplier GROUP BY 1",
    "books_families": "SELECT s_suppkey AS book, col, family FROM supplier, (VALUES (1, 'text'), (2, 'number'), (3, 'number'), (6, 'text'), (7, 'text')) v(col, family)",
    "books_header_breaks": f"WITH {_B} SELECT book, m + 2 AS row, 'table' AS kind FROM b",
}
