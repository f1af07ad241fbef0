"""Queries over tables in texts, stored records, files read and written, and streams of files."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.pagetext import page_batches
from paperloom.operators import ledger as G
from paperloom.operators import storage as S
from paperloom.operators import tables as T
from paperloom.plans.streams import finish, table_stream
from paperloom.session import cut, drop_folder, load, shared_folder
from paperloom.sources import files as W
from paperloom.sources import ooxml as X
from paperloom.sources import pdf as D
from paperloom.streaming import jobs as J


def _in_folder(spark: SparkSession, use: Callable[[str], DataFrame]) -> DataFrame:
    """What a query makes of a folder of its own in the shared folder, which is deleted after."""
    folder = f"{shared_folder(spark)}/paperloom-{uuid.uuid4().hex}"
    try:
        return cut(use(folder))
    finally:
        drop_folder(spark, folder)


# ---- tables ----


def html_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables written as HTML, one per supplier."""
    text = F.concat(F.lit("<p>x</p><table><tr><th colspan=2>Nama</th><th>Saldo</th></tr><tr><td>"), "s_name", F.lit("</td><td></td><td>a|b<br>"), F.col("s_suppkey").cast("string"), F.lit("</td></tr></table>akhir"))
    t = T.markdown_tables(load(spark, d, "supplier").select("s_suppkey", text.alias("text")), ["s_suppkey"], "text")
    return t.select("s_suppkey", "table_no", F.array_join("headers", ";").alias("headers"), F.array_join(F.element_at("rows", 1), ";").alias("first_row"), F.size("rows").alias("n_rows"))


def tagged_tables(spark: SparkSession, d: str) -> DataFrame:
    """Texts in which each table is preceded by the name it is stored under; every other second table keeps its old one."""
    k = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit("awal\n\n| a | b |\n|---|---|\n| 1 | "), k, F.lit(" |\n\nlalu\n\n<!-- sqlite_table: lama -->\n| c | d |\n|---|---|\n| 2 | "), k, F.lit(" |\n"))
    x = load(spark, d, "supplier").select("s_suppkey", text.alias("text"), F.array(F.lit("satu"), F.when(F.col("s_suppkey") % 2 == 0, "dua")).alias("names"))
    return T.tagged(x, "s_suppkey", "text", "names")


_LAYOUTS = (("Tanggal Transaksi", "Uraian", "Debet", "Saldo Akhir"), ("Pihak", "Nama", "Jabatan", "Tanda Tangan"), ("Produk", "Qty", "Harga"), ("Value Date", "Posting Date", "Description", "Kredit"))


def routed_tables(spark: SparkSession, d: str) -> DataFrame:
    """Where tables of four layouts are stored, and which canonical column each header takes."""
    layouts = F.array(*[F.array(*map(F.lit, h)) for h in _LAYOUTS])
    x = load(spark, d, "part").select("p_partkey", F.element_at(layouts, (F.col("p_partkey") % 4 + 1).cast("int")).alias("h"))
    m = T.canonical_columns(F.col("h"), T.TRANSACTION_ALIASES)
    pairs = F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))), ",")
    return x.select("p_partkey", F.coalesce(T.route(F.col("h"), F.lit(None).cast("string"), F.lit(False)), F.lit("none")).alias("stored_in"), pairs.alias("mapped"), T.valid_transaction(m).alias("is_ledger"))


def full_headers(spark: SparkSession, d: str) -> DataFrame:
    """The whole header record of statements, one per supplier: number, period, party, amount and fingerprint."""
    k = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit("# Rekening Koran\n\nNo Rekening: 12-"), k, F.lit("\nPeriode: 01/01/2024 - 31/01/2024\nNasabah: "), "s_name", F.lit("\nSaldo Akhir: Rp 1."), F.lpad(k, 3, "0"), F.lit(",50\n"))
    x = load(spark, d, "supplier").select("s_suppkey", T.header_info(text, F.lit("a.pdf")).alias("h"))
    return x.select("s_suppkey", "h.*")


def canonical_differences(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a text writes them against the stored rows, by canonical values; every tenth has another amount."""
    o = load(spark, d, "orders")
    local = F.concat(F.lit("Rp "), F.translate(F.format_number(F.col("o_totalprice") + F.when(F.col("o_orderkey") % 10 == 0, 1.0).otherwise(0.0), 2), ",.", ".,"))
    shape = lambda key, n, day: (key.cast("string").alias("k"), G.canonical_value(n, "number").alias("n"), G.canonical_value(day, "date").alias("d"))
    text = o.select(*shape(F.concat(F.lit("**"), F.col("o_orderkey").cast("string"), F.lit("**")), local, F.date_format("o_orderdate", "dd/MM/yyyy")))
    text = text.withColumn("k", G.canonical_value(F.col("k"), "text"))
    stored = o.select(*shape(F.col("o_orderkey"), F.format_string("%.2f", "o_totalprice"), F.date_format("o_orderdate", "yyyy-MM-dd")))
    return G.value_differences(text, stored, ["k", "n", "d"]).select("k", "d", "n_text", "n_stored")


# ---- storage ----


def signatory_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Signatories under the hash of what they say, each once."""
    s = load(spark, d, "document_signatories")
    x = s.select("signatory_id", S.row_hash([(F.col(c), "text") for c in ("header_id", "role_party", "name", "position", "date")]).alias("row_hash"))
    return S.insert_new(x.where("signatory_id % 2 = 0"), x.where("signatory_id % 2 = 1"), "row_hash").groupBy("row_hash").agg(F.count(F.lit(1)).alias("n"))


def ingested(spark: SparkSession, d: str) -> DataFrame:
    """Tables of pages stored under one schema, by header or by place, and every third page stored again with a changed row."""
    k = F.col("s_suppkey").cast("string")
    row = lambda amount: F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("| Saldo | Nama |\n|---|---|\n| Rp "), amount, F.lit(",50 | **"), "s_name", F.lit("** |"))).otherwise(F.concat(F.lit("| x | y |\n|---|---|\n| "), "s_name", F.lit(" | "), amount, F.lit(",50 |")))
    pages = load(spark, d, "supplier").select(F.lit("a.pdf").alias("doc"), F.col("s_suppkey").alias("page"), row(k).alias("text"), row(F.concat(F.lit("9"), k)).alias("again"))
    stored = lambda x, c: S.ingest(T.markdown_tables(x, ["doc", "page"], c), [], {"nama": "TEXT", "saldo": "REAL"}, "doc", "page")
    return S.replace_pages(stored(pages, "text"), pages.where("page % 3 = 0").select(F.col("doc").alias("_source_doc"), F.col("page").cast("int").alias("_page_number")), stored(pages.where("page % 3 = 0"), "again"))


def statements(spark: SparkSession, d: str) -> DataFrame:
    """A table as SQL: how it is made and what fills it."""
    n = load(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    made = spark.createDataFrame([(W.create_statement(n, "nation"),)], "statement string")
    quoted = n.withColumn("n_name", F.concat("n_name", F.lit("'s")))
    return made.unionByName(W.sql_statements(quoted, "nation"))


def samples(spark: SparkSession, d: str) -> DataFrame:
    """The last orders as samples."""
    return S.last_rows(load(spark, d, "orders"), "o_orderkey", 5).select("o_orderkey", "o_custkey")


def versions(spark: SparkSession, d: str) -> DataFrame:
    """Two tables committed together, then one of them again: what readers see."""

    def use(folder: str) -> DataFrame:
        S.commit_version(spark, folder, {"nation": load(spark, d, "nation"), "supplier": load(spark, d, "supplier")})
        S.commit_version(spark, folder, {"nation": S.read_version(spark, folder, "nation").where("n_regionkey = 1")}, ["n_regionkey"])
        seen = [S.read_version(spark, folder, t).select(F.lit(t).alias("table_name"), F.col(k).cast("long").alias("key")) for t, k in (("nation", "n_nationkey"), ("supplier", "s_suppkey"))]
        return seen[0].unionByName(seen[1])

    return _in_folder(spark, use)


# ---- files ----


def csv_files(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers written as CSV without internal columns and read again."""

    def use(folder: str) -> DataFrame:
        W.write_csv(load(spark, d, "supplier").withColumn("_source", F.lit("x")), folder)
        return spark.read.option("header", "true").csv(folder)

    return _in_folder(spark, use)


def zipped_files(spark: SparkSession, d: str) -> DataFrame:
    """Small tables as CSV files of one archive, opened again."""
    data = W.zip_tables({"Nation": load(spark, d, "nation"), "nation": load(spark, d, "region").select(F.col("r_regionkey").alias("n_nationkey"), F.col("r_name").alias("n_name"), F.lit(-1).alias("n_regionkey"))})
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        parts = [pd.read_csv(z.open(n), encoding="utf-8-sig").assign(file=n) for n in z.namelist()]
    return spark.createDataFrame(pd.concat(parts)[["file", "n_nationkey", "n_name"]])


def _nation_files(spark: SparkSession, d: str, folder: str) -> DataFrame:
    """A text file per region and its listing."""
    load(spark, d, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_name").alias("value")).repartition("region").write.mode("append").partitionBy("region").text(folder)
    return W.document_files(spark, folder, (".txt",)).withColumn("region", F.regexp_extract("folder", "region=([0-9]+)$", 1).cast("int"))


def listed_files(spark: SparkSession, d: str) -> DataFrame:
    """Files under a folder with their sizes; other types and ignored folders are left out."""

    def use(folder: str) -> DataFrame:
        W.write_file(spark, f"{folder}/.git/x.txt", b"x")
        W.write_file(spark, f"{folder}/note.md", b"x")
        return _nation_files(spark, d, folder).select("region", "ext", "bytes")

    return _in_folder(spark, use)


def unchanged_files(spark: SparkSession, d: str) -> DataFrame:
    """Files that need no new work: those of region 2 have changed since."""

    def use(folder: str) -> DataFrame:
        now = cut(_nation_files(spark, d, folder))
        seen = now.withColumn("bytes", F.when(F.col("region") == 2, F.col("bytes") + 1).otherwise(F.col("bytes")))
        return W.unchanged(now, seen).select("region")

    return _in_folder(spark, use)


def extractions(spark: SparkSession, d: str) -> DataFrame:
    """Extracted documents of the same names in several folders, with the JSON beside them."""

    def use(folder: str) -> DataFrame:
        for r in load(spark, d, "nation").collect():
            place = f"{folder}/r{r['n_regionkey']}/dok{r['n_nationkey'] // 5}"
            W.write_file(spark, place + ".md", f"# {r['n_name']}".encode())
            if r["n_nationkey"] % 2 == 0:
                W.write_file(spark, place + ".json", b'{"n": %d}' % r["n_nationkey"])
        return W.read_extractions(spark, folder).select(F.element_at(F.split("folder", "/"), -1).alias("folder"), "doc", "text", "meta")

    return _in_folder(spark, use)


def manifests(spark: SparkSession, d: str) -> DataFrame:
    """A manifest of row counts, written whole and read again."""

    def use(folder: str) -> DataFrame:
        W.manifest(spark, f"{folder}/m.json", {"tables": [{"name": t, "n_rows": load(spark, d, t).count()} for t in ("nation", "region", "supplier")]})
        return spark.read.option("multiLine", "true").json(f"{folder}/m.json").select(F.explode("tables").alias("t")).select("t.name", "t.n_rows")

    return _in_folder(spark, use)


def cleaned_files(spark: SparkSession, d: str) -> DataFrame:
    """What is left of written outputs after those of one document are deleted."""

    def use(folder: str) -> DataFrame:
        for r in load(spark, d, "region").collect():
            for ending in (".txt", ".json", "-2.txt"):
                W.write_file(spark, f"{folder}/dok{r['r_regionkey']}{ending}", b"x")
        gone = W.clean_outputs(spark, folder, "dok1")
        left = W.document_files(spark, folder, (".txt", ".json"))
        return left.select("name", F.lit(gone).alias("n_deleted"))

    return _in_folder(spark, use)


def batched_pages(spark: SparkSession, d: str) -> DataFrame:
    """Chunk items in batches of three, each with the end of what came before."""
    x = load(spark, d, "chunk_items").select("preview_id", "chunk_id", "content").distinct()
    return page_batches(x, "preview_id", "chunk_id", "content", 3, 50)


_SHEET = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_SLIDE = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_RELATIONS = "http://schemas.openxmlformats.org/package/2006/relationships"


def _archive(parts: dict[str, str]) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return buffer.getvalue()


def workbook_files(spark: SparkSession, d: str) -> DataFrame:
    """Workbooks, one per region with its nations on a sheet, read as cells."""

    def use(folder: str) -> DataFrame:
        nations = load(spark, d, "nation").orderBy("n_nationkey").collect()
        for region in sorted({r["n_regionkey"] for r in nations}):
            rows = "".join(f'<row r="{k}"><c r="A{k}" t="inlineStr"><is><t>{r["n_name"]}</t></is></c><c r="B{k}"><f>A{k}*2</f><v>{r["n_nationkey"]}</v></c></row>' for k, r in enumerate((r for r in nations if r["n_regionkey"] == region), 1))
            W.write_file(spark, f"{folder}/r{region}.xlsx", _archive({
                "xl/workbook.xml": f'<workbook {_SHEET}><sheets><sheet name="Wilayah {region}" sheetId="1" r:id="rId1"/></sheets></workbook>',
                "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_RELATIONS}"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
                "xl/worksheets/sheet1.xml": f"<worksheet {_SHEET}><sheetData>{rows}</sheetData></worksheet>",
            }))
        return X.read_workbooks(spark, folder).select("sheet", "row", "col", "text", "kind", "formula")

    return _in_folder(spark, use)


def slide_files(spark: SparkSession, d: str) -> DataFrame:
    """Presentations read as slides, their tables stored and held against the nations they were made from."""

    def use(folder: str) -> DataFrame:
        nations = load(spark, d, "nation").orderBy("n_nationkey").collect()
        cell = lambda t: f"<a:tc><a:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></a:txBody></a:tc>"
        for region in sorted({r["n_regionkey"] for r in nations}):
            rows = "".join(f"<a:tr>{cell(a)}{cell(b)}</a:tr>" for a, b in [("Nama", "Nomor"), *((r["n_name"], r["n_nationkey"]) for r in nations if r["n_regionkey"] == region)])
            W.write_file(spark, f"{folder}/r{region}.pptx", _archive({
                "ppt/presentation.xml": f'<p:presentation {_SLIDE}><p:sldIdLst><p:sldId id="1" r:id="rId1"/></p:sldIdLst></p:presentation>',
                "ppt/_rels/presentation.xml.rels": f'<Relationships xmlns="{_RELATIONS}"><Relationship Id="rId1" Target="slides/slide1.xml"/></Relationships>',
                "ppt/slides/slide1.xml": f'<p:sld {_SLIDE}><p:cSld><p:spTree><p:sp><p:nvSpPr><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>Wilayah {region}</a:t></a:r></a:p></p:txBody></p:sp><a:tbl>{rows}</a:tbl></p:spTree></p:cSld></p:sld>',
            }))
        slides = X.read_presentations(spark, folder)
        stored = T.markdown_tables(slides.select("title", "markdown"), ["title"], "markdown").select("title", F.explode("rows").alias("r")).select("title", F.col("r")[0].alias("name"), F.col("r")[1].alias("number"))
        right = load(spark, d, "nation").select(F.concat(F.lit("Wilayah "), F.col("n_regionkey").cast("string")).alias("title"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("number"))
        wrong = G.value_differences(stored, right, ["title", "name", "number"]).groupBy("title").agg(F.count(F.lit(1)).alias("n_wrong"))
        counts = G.count_differences(stored, right, "title")
        return counts.join(wrong, "title", "left").select("title", "n_text", "n_stored", "agrees", F.coalesce("n_wrong", F.lit(0)).alias("n_wrong"))

    return _in_folder(spark, use)


def pdf_files(spark: SparkSession, d: str) -> DataFrame:
    """PDF files, one per region with a page per nation, read page by page."""

    def use(folder: str) -> DataFrame:
        nations = load(spark, d, "nation").orderBy("n_nationkey").collect()
        for region in sorted({r["n_regionkey"] for r in nations}):
            names = [r["n_name"] for r in nations if r["n_regionkey"] == region]
            objects, kids = ["<< /Type /Catalog /Pages 2 0 R >>", "", "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"], []
            for name in names:
                body = f"BT /F1 12 Tf 14 TL 72 720 Td (Negara \\({region}\\)) Tj T* ({name}) Tj ET"
                objects += [f"<< /Length {len(body)} >>\nstream\n{body}\nendstream", f"<< /Type /Page /Contents {len(objects) + 1} 0 R /Resources << /Font << /F1 3 0 R >> >> >>"]
                kids.append(f"{len(objects)} 0 R")
            objects[1] = f"<< /Type /Pages /Kids [{' '.join(kids)}] >>"
            text = "%PDF-1.4\n" + "".join(f"{k} 0 obj\n{o}\nendobj\n" for k, o in enumerate(objects, 1)) + "trailer << /Root 1 0 R >>\n%%EOF"
            W.write_file(spark, f"{folder}/r{region}.pdf", text.encode("cp1252"))
        pages = D.read_pdf_text(spark, folder)
        counted = pages.join(D.page_counts(pages), "path")
        return counted.select(F.regexp_extract("path", r"r(\d+)\.pdf$", 1).cast("int").alias("region"), "page_number", "n_pages", "text")

    return _in_folder(spark, use)


# ---- streams of files ----


def streamed_progress(spark: SparkSession, d: str) -> DataFrame:
    """Progress of previews, told by lines of log files that are read as a stream."""

    def use(folder: str) -> DataFrame:
        i, p = load(spark, d, "chunk_items").select("preview_id", "chunk_id").distinct(), load(spark, d, "chunking_previews").select("preview_id", "total_chunks")
        line = F.concat_ws("|", F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("chunk_id")), "yyyy-MM-dd HH:mm:ss"), F.col("preview_id").cast("string"), F.concat(F.lit("Memproses Halaman "), F.col("chunk_id").cast("string"), F.lit(" / "), F.col("total_chunks").cast("string")))
        i.join(p, "preview_id").select(line.alias("value")).write.text(folder)
        parts = F.split("value", r"\|")
        lines = J.read_log(spark, folder).select(parts[1].cast("long").alias("preview_id"), parts[0].cast("timestamp").alias("at"), parts[2].alias("line"))
        x = finish(J.progress_stream(lines, "preview_id", "at", "line"), "update")
        return x.groupBy("preview_id").agg(F.max_by(F.struct("current_page", "total_pages", "percent"), "batch").alias("s")).select("preview_id", "s.*")

    return _in_folder(spark, use)


def visible_pages(spark: SparkSession, d: str) -> DataFrame:
    """What readers may see of documents that are still being written."""
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("halaman "), k, F.lit("\n\n---\n\nlagi\n---"), F.when(F.col("p_partkey") % 2 == 0, F.lit("-\nbelum")).otherwise(F.lit("  \nbelum")))
    return J.complete_pages(load(spark, d, "part").select("p_partkey", text.alias("text")), "p_partkey", "text")


def appended_pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents appended as they come; the stream is stopped and started again, and no page is written twice."""

    def use(folder: str) -> DataFrame:
        for _ in range(2):
            pages = table_stream(spark, d, "documents").select("doc_id", "n_chars")
            q = J.append_pages(pages, f"{folder}/pages", f"{folder}/state", "0 seconds")
            q.processAllAvailable()
            q.stop()
        return spark.read.parquet(f"{folder}/pages").select("doc_id", "n_chars")

    return _in_folder(spark, use)


QUERIES = {
    "tables_html": html_tables, "tables_tagged": tagged_tables, "tables_routed": routed_tables, "tables_headers": full_headers, "ledger_canonical": canonical_differences, "store_signatories": signatory_hashes,
    "store_statements": statements, "store_ingested": ingested, "files_cleaned": cleaned_files, "pages_batched": batched_pages, "store_samples": samples, "store_versions": versions, "files_csv": csv_files, "files_zip": zipped_files, "files_listed": listed_files, "files_unchanged": unchanged_files,
    "files_extractions": extractions, "files_manifest": manifests, "files_workbooks": workbook_files, "files_slides": slide_files, "files_pdf": pdf_files, "streams_progress": streamed_progress, "streams_visible": visible_pages, "streams_appended": appended_pages,
}

_N = "chr(10)"
ORACLE = {
    "tables_html": "SELECT s_suppkey, 1 AS table_no, 'Nama;;Saldo' AS headers, s_name || ';;a&#124;b ' || s_suppkey AS first_row, 1 AS n_rows FROM supplier",
    "tables_tagged": f"""SELECT s_suppkey, array_to_string(['awal', '', '<!-- sqlite_table: satu -->', '| a | b |', '| --- | --- |', '| 1 | ' || s_suppkey || ' |', '', 'lalu', '', CASE WHEN s_suppkey % 2 = 0 THEN '<!-- sqlite_table: dua -->' ELSE '<!-- sqlite_table: lama -->' END,
        '| c | d |', '| --- | --- |', '| 2 | ' || s_suppkey || ' |', ''], {_N}) AS text FROM supplier""",
    "tables_routed": """SELECT p_partkey, stored_in, mapped, stored_in = 'transaction_details' AS is_ledger FROM part JOIN (VALUES (0, 'transaction_details', 'balance:3,debit:2,description:1,txn_date:0'), (1, 'document_signatories', ''),
        (2, 'none', ''), (3, 'transaction_details', 'credit:3,description:2,txn_date:0')) v(k, stored_in, mapped) ON k = p_partkey % 4""",
    "tables_headers": """WITH h AS (SELECT s_suppkey, 'bank_statement' AS doc_type, 'Rekening Koran' AS doc_title, '12-' || s_suppkey AS doc_number, '01/01/2024 - 31/01/2024' AS doc_date, s_name AS parties, 1000 + s_suppkey % 1000 + 0.5 AS total_amount FROM supplier)
        SELECT *, substring(sha256(doc_type || '|' || doc_number || '|' || doc_date || '|' || parties || '|a.pdf'), 1, 16) AS fingerprint_hash FROM h""",
    "ledger_canonical": "SELECT CAST(o_orderkey AS VARCHAR) AS k, strftime(o_orderdate, '%Y-%m-%d') AS d, n_text, 1 - n_text AS n_stored FROM orders, (VALUES (0), (1)) v(n_text) WHERE o_orderkey % 10 = 0",
    "store_signatories": """WITH h AS (SELECT signatory_id, substring(sha256(coalesce(CAST(header_id AS VARCHAR), '') || '|' || coalesce(role_party, '') || '|' || coalesce(name, '') || '|' || coalesce(position, '') || '|' || coalesce("date", '')), 1, 24) AS row_hash FROM document_signatories)
        SELECT row_hash, greatest(count(*) FILTER (signatory_id % 2 = 0), 1) AS n FROM h GROUP BY row_hash""",
    "store_statements": """SELECT 'CREATE TABLE "nation" ("n_nationkey" INTEGER, "n_name" TEXT, "n_regionkey" INTEGER);' AS statement
        UNION ALL SELECT 'INSERT INTO "nation" ("n_nationkey", "n_name", "n_regionkey") VALUES (' || n_nationkey || ', ''' || n_name || '''''s'', ' || n_regionkey || ');' FROM nation""",
    "store_ingested": "SELECT s_name AS nama, CAST(CASE WHEN s_suppkey % 3 = 0 THEN '9' ELSE '' END || s_suppkey AS DOUBLE) + 0.5 AS saldo, 'a.pdf' AS _source_doc, s_suppkey AS _page_number FROM supplier",
    "files_cleaned": "SELECT 'dok' || r_regionkey || e AS name, 2 AS n_deleted FROM region, (VALUES ('.txt'), ('.json'), ('-2.txt')) v(e) WHERE r_regionkey <> 1 OR e = '-2.txt'",
    "pages_batched": """WITH x AS (SELECT DISTINCT preview_id, chunk_id, content FROM chunk_items), g AS (SELECT preview_id, (chunk_id - 1) // 3 AS batch, min(chunk_id) AS first_page, max(chunk_id) AS last_page, arg_max(right(content, 50), chunk_id) AS e FROM x GROUP BY ALL)
        SELECT preview_id, batch, first_page, last_page, lag(e) OVER (PARTITION BY preview_id ORDER BY batch) AS context FROM g""",
    "store_samples": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 5",
    "store_versions": "SELECT 'nation' AS table_name, n_nationkey AS key FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'supplier', s_suppkey FROM supplier",
    "files_csv": "SELECT CAST(COLUMNS(*) AS VARCHAR) FROM supplier",
    "files_zip": "SELECT 'Nation.csv' AS file, n_nationkey, n_name FROM nation UNION ALL SELECT 'nation_2.csv', r_regionkey, r_name FROM region",
    "files_listed": "SELECT n_regionkey AS region, '.txt' AS ext, CAST(sum(octet_length(encode(n_name)) + 1) AS BIGINT) AS bytes FROM nation GROUP BY 1",
    "files_unchanged": "SELECT DISTINCT n_regionkey AS region FROM nation WHERE n_regionkey <> 2",
    "files_extractions": "SELECT 'r' || n_regionkey AS folder, 'dok' || n_nationkey // 5 AS doc, '# ' || n_name AS text, CASE WHEN n_nationkey % 2 = 0 THEN '{\"n\": ' || n_nationkey || '}' END AS meta FROM nation",
    "files_manifest": "SELECT 'nation' AS name, count(*) AS n_rows FROM nation UNION ALL SELECT 'region', count(*) FROM region UNION ALL SELECT 'supplier', count(*) FROM supplier",
    "files_workbooks": """WITH n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation)
        SELECT 'Wilayah ' || n_regionkey AS sheet, k AS row, 1 AS col, n_name AS text, 's' AS kind, NULL AS formula FROM n UNION ALL SELECT 'Wilayah ' || n_regionkey, k, 2, CAST(n_nationkey AS VARCHAR), 'n', '=A' || k || '*2' FROM n""",
    "files_slides": "SELECT 'Wilayah ' || n_regionkey AS title, count(*) AS n_text, count(*) AS n_stored, true AS agrees, 0 AS n_wrong FROM nation GROUP BY 1",
    "files_pdf": """SELECT n_regionkey AS region, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS page_number, count(*) OVER (PARTITION BY n_regionkey) AS n_pages, 'Negara (' || n_regionkey || ')' || chr(10) || n_name AS text FROM nation""",
    "streams_progress": """WITH x AS (SELECT preview_id, max(chunk_id) AS current_page, max(total_chunks) AS total_pages FROM (SELECT DISTINCT preview_id, chunk_id FROM chunk_items) JOIN chunking_previews USING (preview_id) GROUP BY 1)
        SELECT *, CASE WHEN total_pages > 0 AND current_page > 0 THEN least(98.0, greatest(1.0, round_even(current_page / total_pages * 100.0, 1))) ELSE 5.0 END AS percent FROM x""",
    "streams_visible": f"SELECT p_partkey, 'halaman ' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE {_N} || {_N} || '---' || {_N} || {_N} || 'lagi' END AS visible FROM part",
    "streams_appended": "SELECT doc_id, n_chars FROM documents",
}
