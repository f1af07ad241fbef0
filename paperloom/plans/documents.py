"""Queries over sheets, clause trees, learning logs, jobs, surveys and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import hierarchy as H
from paperloom.operators import jobs as J
from paperloom.operators import learning as N
from paperloom.operators import sheets as S
from paperloom.operators import survey as V
from paperloom.operators.vectors import cosine_topk
from paperloom.session import load


# ---- sheets ----


def _sheet_cells(spark: SparkSession, d: str) -> DataFrame:
    """One sheet per nation: a header row, one row per customer, a total row with a formula."""
    c = load(spark, d, "customer").select(F.col("c_nationkey").cast("int").alias("sheet"), "c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    row = F.row_number().over(V.Window.partitionBy("sheet").orderBy("c_custkey")) + 1
    x = c.withColumn("row", row)
    cell = lambda k, t, kind, f=None: F.struct(F.lit(k).alias("col"), t.alias("text"), F.lit(kind).alias("kind"), (F.lit(None).cast("string") if f is None else f).alias("formula"))
    body = x.select("sheet", "row", F.explode(F.array(cell(1, F.col("c_name"), "s"), cell(2, F.col("c_mktsegment"), "s"), cell(3, F.col("c_custkey").cast("string"), "n"), cell(4, F.format_string("%.2f", "c_acctbal"), "n"))).alias("c"))
    last = x.groupBy("sheet").agg(F.max("row").alias("m"), F.sum(F.round(F.col("c_acctbal") * 100).cast("long")).alias("t"))
    formula = F.concat(F.lit("=SUM(D2:D"), F.col("m").cast("string"), F.lit(")"))
    total = last.select("sheet", (F.col("m") + 1).alias("row"), F.explode(F.array(cell(1, F.lit("Grand Total"), "s"), cell(4, F.format_string("%.2f", F.col("t") / 100), "n", formula))).alias("c"))
    head = last.select("sheet", F.lit(1).alias("row"), F.explode(F.array(*[cell(k + 1, F.lit(n), "s") for k, n in enumerate(("Nama", "Segmen", "Nomor", "Saldo"))])).alias("c"))
    return body.unionByName(total).unionByName(head).select("sheet", "row", "c.*")


def sheet_regions(spark: SparkSession, d: str) -> DataFrame:
    """The rectangles of each sheet."""
    return S.regions(_sheet_cells(spark, d), ["sheet"]).select("sheet", "region_no", "min_row", "max_row", "min_col", "max_col", "n_cells", "kind")


def sheet_headers(spark: SparkSession, d: str) -> DataFrame:
    """The header row of each sheet."""
    return S.header_rows(_sheet_cells(spark, d), ["sheet"])


def sheet_row_roles(spark: SparkSession, d: str) -> DataFrame:
    """Rows per role, and the balance that data rows alone add up to."""
    c = _sheet_cells(spark, d)
    roles = S.row_roles(c, ["sheet"], S.header_rows(c, ["sheet"]))
    value = c.where("col = 4").select("sheet", "row", F.round(F.col("text").try_cast("double") * 100).cast("long").alias("v"))
    return roles.join(value, ["sheet", "row"]).groupBy("sheet", "row_role").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("v").alias("cents"))


def sheet_types(spark: SparkSession, d: str) -> DataFrame:
    """Native column types below the header."""
    return S.native_types(_sheet_cells(spark, d).where("row > 1"), ["sheet"])


def sheet_native(spark: SparkSession, d: str) -> DataFrame:
    """Sheets as tables: customers per segment."""
    t = S.native_table(_sheet_cells(spark, d).where("row > 1"), ["sheet"], {1: "nama", 2: "segmen", 3: "nomor", 4: "saldo"})
    return t.groupBy("segmen").agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.col("nomor").try_cast("long")).alias("last_number"))


def sheet_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Which part of each sheet its total formulas refer to."""
    c = _sheet_cells(spark, d)
    refs = c.where(F.col("formula").isNotNull()).select("sheet", F.lit(2).alias("min_row"), (F.col("row") - 1).alias("max_row"), F.lit(4).alias("min_col"), F.lit(4).alias("max_col"))
    r = S.regions(c, ["sheet"])
    return S.coverage(r, c, refs, ["sheet"]).select("sheet", "region_no", "n_cells", "n_covered")


def sheet_roles(spark: SparkSession, d: str) -> DataFrame:
    """The role of each sheet from its counts."""
    c = _sheet_cells(spark, d)
    x = c.groupBy("sheet").agg(F.count(F.lit(1)).alias("n_cells"), F.count("formula").alias("n_formulas"), F.max("row").alias("t_rows"), F.max("col").alias("t_cols"))
    y = x.select("sheet", (F.col("sheet") == 0).alias("has_charts"), F.lit(True).alias("visible"), "n_formulas", "n_cells", F.lit(0).alias("n_dependencies"), F.lit(False).alias("feeds_dashboard"), "t_rows", "t_cols", F.col("n_cells").alias("t_cells"))
    return S.sheet_roles(y).select("sheet", "role", F.round("role_confidence", 4).alias("role_confidence"))


def sheet_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Regions cut into tiles of 50 by 20."""
    r = S.regions(_sheet_cells(spark, d), ["sheet"]).select("sheet", "region_no", "min_row", "max_row", "min_col", "max_col")
    return S.tiles(r).select("sheet", "region_no", "min_row", "max_row", "min_col", "max_col")


def _monthly(spark: SparkSession, d: str) -> DataFrame:
    x = load(spark, d, "lineitem").groupBy("l_returnflag", F.date_format("l_shipdate", "yyyy-MM").alias("m")).agg(F.sum("l_quantity").cast("long").alias("value"))
    pos = F.row_number().over(V.Window.partitionBy("l_returnflag").orderBy("m"))
    label = F.concat(F.element_at(F.array(*[F.lit(n) for n in "Jan Feb Mar Apr Mei Jun Jul Agu Sep Okt Nov Des".split()]), F.substring("m", 6, 2).cast("int")), F.lit("-"), F.substring("m", 1, 4))
    return x.select(F.col("l_returnflag").alias("series"), pos.alias("pos"), label.alias("category"), F.lit("s").alias("kind"), "value", "m")


def chart_story(spark: SparkSession, d: str) -> DataFrame:
    """First, last, highest and lowest month of each series."""
    return S.chart_points(_monthly(spark, d), ["series"])


def chart_checks(spark: SparkSession, d: str) -> DataFrame:
    """Whether the series are fit for a chart."""
    return S.chart_warnings(_monthly(spark, d), ["series"])


def chart_table(spark: SparkSession, d: str) -> DataFrame:
    """The series side by side."""
    return S.chart_grid(_monthly(spark, d), ["A", "N", "R"])


# ---- clauses ----


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Regions as chapters, nations as articles, customers as paragraphs; customers in debt left out of the numbering's text."""
    r, n, c = load(spark, d, "region"), load(spark, d, "nation"), load(spark, d, "customer")
    a = r.select(F.col("r_regionkey").cast("long").alias("r"), F.lit(-1).cast("long").alias("n"), F.lit(-1).cast("long").alias("c"), F.lit("bab").alias("kind"), F.lit(None).cast("string").alias("ordinal"))
    b = n.select(F.col("n_regionkey").cast("long").alias("r"), F.col("n_nationkey").cast("long").alias("n"), F.lit(-1).cast("long").alias("c"), F.lit("pasal").alias("kind"), (F.col("n_nationkey") + 1).cast("string").alias("ordinal"))
    number = F.row_number().over(V.Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    e = c.withColumn("k", number).where("c_acctbal >= 0 OR k = 1").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_regionkey").cast("long").alias("r"), F.col("n_nationkey").cast("long").alias("n"), F.col("c_custkey").alias("c"), F.lit("ayat").alias("kind"), F.col("k").cast("string").alias("ordinal")
    )
    seq = F.row_number().over(V.Window.partitionBy("doc").orderBy("r", "n", "c")).cast("long")
    x = a.unionByName(b).unionByName(e).withColumn("doc", F.concat(F.lit("doc"), F.col("r").cast("string")))
    return x.select("doc", seq.alias("seq"), "kind", "ordinal", F.lit(None).cast("string").alias("label"), F.concat(F.lit("isi "), F.col("c").cast("string")).alias("text"), F.lit(1).cast("long").alias("page"))


def clause_parents(spark: SparkSession, d: str) -> DataFrame:
    """The parent of every clause."""
    return H.parents(_events(spark, d)).select("doc", "seq", "kind", "parent_seq")


def clause_audit(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs whose number does not follow."""
    return H.ordinal_audit(_events(spark, d).where("kind = 'ayat' OR kind = 'pasal'").withColumn("ordinal", F.when(F.col("kind") == "pasal", F.lit(None).cast("string")).otherwise(F.col("ordinal")))).where("kind = 'ayat'").groupBy("doc", "message").agg(F.count(F.lit(1)).alias("n"))


def clause_open(spark: SparkSession, d: str) -> DataFrame:
    """What is still open at the end of each document."""
    return H.open_path(_events(spark, d)).select("doc", "kind", "ordinal", "depth")


# ---- learning ----


def latest_headers(spark: SparkSession, d: str) -> DataFrame:
    """The last delivery of each header, if it has an amount."""
    x = load(spark, d, "document_headers").select("header_id", F.try_to_timestamp("updated_at").alias("at"), "total_amount", "doc_number")
    return N.latest_ready(x, ["header_id"], "at", F.col("total_amount").isNotNull()).select("header_id", "doc_number")


def text_classes(spark: SparkSession, d: str) -> DataFrame:
    """Documents that share a text, directly or by others, under the smallest id."""
    x = load(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("text_hash"))
    return N.components(x, "doc_id", ["text_hash"])


def split_by_hash(spark: SparkSession, d: str) -> DataFrame:
    """Training, validation and test shares of documents whose copies stay together."""
    x = text_classes(spark, d)
    return x.groupBy(N.fixed_split(F.col("root")).alias("split")).agg(F.count(F.lit(1)).alias("n_documents"), F.countDistinct("root").alias("n_groups"))


def split_tail(spark: SparkSession, d: str) -> DataFrame:
    """The split by sorted groups of documents that share a text."""
    return N.tail_split(text_classes(spark, d)).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("first"), F.max("root").alias("last"))


def ocr_scores(spark: SparkSession, d: str) -> DataFrame:
    """Raw scanned text held against its right repair."""
    g = load(spark, d, "ocr_gold").select("region_id", "clean_text").distinct()
    r = load(spark, d, "ocr_regions").where(F.col("text").isNotNull()).select("region_id", "text", "label").distinct()
    scored = N.with_scores(g.join(r, "region_id"), "clean_text", "text")
    return scored.select("region_id", F.round("text_score", 4).alias("text_score"), F.round("score", 4).alias("score"), "wrong_numbers")


# ---- jobs ----


def folders(spark: SparkSession, d: str) -> DataFrame:
    """Source files by style: how many, which types, the first five."""
    x = load(spark, d, "documents").where(F.col("source_file").isNotNull()).select(F.coalesce("spec", F.lit("none")).alias("folder"), F.col("source_file").alias("name")).distinct()
    y = J.folder_summary(x, "folder", "name")
    return y.select("folder", "total_documents", F.col("extension_counts")[".pdf"].alias("n_pdf"), F.array_join("sample_files", ",").alias("samples"))


def selected(spark: SparkSession, d: str) -> DataFrame:
    """The first three files of each style that match a pattern."""
    x = load(spark, d, "documents").where(F.col("source_file").isNotNull()).select(F.coalesce("spec", F.lit("none")).alias("folder"), F.col("source_file").alias("name")).distinct()
    return J.select_batch(x, "folder", "name", pattern="berkas_*5.pdf", per_folder=3)


def sampled(spark: SparkSession, d: str) -> DataFrame:
    """Forty unlabelled documents in a seeded order."""
    x = load(spark, d, "documents").select("doc_id")
    return J.seeded_sample(x, "doc_id", 40, 42, load(spark, d, "subject_labels").select("doc_id").where(F.col("doc_id").isNotNull()))


def batches(spark: SparkSession, d: str) -> DataFrame:
    """Events as jobs of a user's batch, rolled up."""
    kinds = {"click": "completed", "view": "completed", "purchase": "running", "error": "failed"}
    status = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("event_type")), F.lit("canceled"))
    x = load(spark, d, "events").select("user_id", status.alias("status"))
    return J.batch_rollup(x, "user_id", "status")


def progress_log(spark: SparkSession, d: str) -> DataFrame:
    """Progress read from log lines made from chunk items."""
    i, p = load(spark, d, "chunk_items").select("preview_id", "chunk_id").distinct(), load(spark, d, "chunking_previews").select("preview_id", "total_chunks")
    x = i.join(p, "preview_id").select("preview_id", "chunk_id", F.concat(F.lit("Memproses Halaman "), F.col("chunk_id").cast("string"), F.lit(" / "), F.col("total_chunks").cast("string"), F.lit(" dari 'x.pdf'")).alias("line"))
    return J.latest_progress(x, "preview_id", "chunk_id", "line")


def orphans_on_disk(spark: SparkSession, d: str) -> DataFrame:
    """Source files of the ledger that no signatory names."""
    a = load(spark, d, "transaction_details").where(F.col("_source_doc").isNotNull()).select("_source_doc").distinct()
    return J.unreferenced(a, load(spark, d, "document_signatories").where(F.col("_source_doc").isNotNull()), "_source_doc")


def queue(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers queued by balance, those of nation 3 first."""
    x = load(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.round("s_acctbal").cast("long").alias("pos"))
    return J.queue_order(J.prioritise(x, "pos", F.col("s_nationkey") == 3), "pos", "s_suppkey").select("s_suppkey", "ahead")


def upload_names(spark: SparkSession, d: str) -> DataFrame:
    """Documents of one source file under names of their own."""
    x = load(spark, d, "documents").where(F.col("source_file").isNotNull())
    return J.unique_stems(x.select("doc_id", "source_file"), "source_file", "doc_id").select("doc_id", "unique_name")


# ---- surveys and vectors ----


def event_islands(spark: SparkSession, d: str) -> DataFrame:
    """Runs of a user's events no more than a day apart."""
    x = load(spark, d, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    return V.clusters(x, "user_id", "t", 86400).select("user_id", F.col("n").cast("long").alias("n"), F.col("first").alias("first_t"), F.col("last").alias("last_t"))


def grid_carried(spark: SparkSession, d: str) -> DataFrame:
    """The last reading order found on the pages before, per scanned document."""
    x = load(spark, d, "ocr_regions").select("source_doc", "region_id", "reading_order", "label").distinct()
    y = V.inherit(x, "source_doc", "region_id", "reading_order", F.col("label") == "header")
    return y.select("region_id", "reading_order")


def nearest_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 20, against all."""
    e = load(spark, d, "embeddings").select("vec_id", "embedding")
    return cosine_topk(e.where(F.col("vec_id") % 20 == 0), e, "vec_id", "embedding", 5).select("query_id", "rank", "vec_id")


QUERIES = {
    "sheets_regions": sheet_regions, "sheets_headers": sheet_headers, "sheets_row_roles": sheet_row_roles, "sheets_types": sheet_types, "sheets_native": sheet_native,
    "sheets_coverage": sheet_coverage, "sheets_roles": sheet_roles, "sheets_tiles": sheet_tiles, "charts_story": chart_story, "charts_checks": chart_checks, "charts_table": chart_table,
    "clauses_parents": clause_parents, "clauses_audit": clause_audit, "clauses_open": clause_open,
    "learning_latest": latest_headers, "learning_classes": text_classes, "learning_split": split_by_hash, "learning_tail": split_tail, "learning_scores": ocr_scores,
    "jobs_folders": folders, "jobs_selected": selected, "jobs_sampled": sampled, "jobs_batches": batches, "jobs_progress": progress_log, "jobs_unreferenced": orphans_on_disk,
    "jobs_queue": queue, "jobs_names": upload_names, "survey_islands": event_islands, "survey_inherited": grid_carried,
    "vectors_nearest": nearest_vectors,
}

_SHEET = """s AS (SELECT CAST(c_nationkey AS INTEGER) AS sheet, count(*) AS n, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS t FROM customer GROUP BY 1)"""
_MONTHLY = """q AS (SELECT l_returnflag AS series, strftime(l_shipdate, '%Y-%m') AS m, CAST(sum(l_quantity) AS BIGINT) AS value FROM lineitem GROUP BY 1, 2),
    p AS (SELECT *, CAST(row_number() OVER (PARTITION BY series ORDER BY m) AS INTEGER) AS pos, ['Jan', 'Feb', 'Mar', 'Apr', 'Mei', 'Jun', 'Jul', 'Agu', 'Sep', 'Okt', 'Nov', 'Des'][CAST(m[6:7] AS INTEGER)] || '-' || m[1:4] AS category FROM q)"""
_EVENTS = """k AS (SELECT c_custkey, c_nationkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer),
    e AS (SELECT r_regionkey AS r, -1 AS n, -1 AS c, 'bab' AS kind, NULL AS ordinal FROM region UNION ALL SELECT n_regionkey, n_nationkey, -1, 'pasal', CAST(n_nationkey + 1 AS VARCHAR) FROM nation
        UNION ALL SELECT n_regionkey, n_nationkey, c_custkey, 'ayat', CAST(k AS VARCHAR) FROM k JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal >= 0 OR k = 1),
    v AS (SELECT 'doc' || r AS doc, row_number() OVER (PARTITION BY r ORDER BY r, n, c) AS seq, kind, ordinal FROM e)"""

ORACLE = {
    "sheets_regions": f"WITH {_SHEET} SELECT sheet, 1 AS region_no, 1 AS min_row, CAST(n + 2 AS INTEGER) AS max_row, 1 AS min_col, 4 AS max_col, CAST(4 * n + 6 AS INTEGER) AS n_cells, 'table' AS kind FROM s",
    "sheets_headers": f"WITH {_SHEET} SELECT sheet, 1 AS header_row FROM s",
    "sheets_row_roles": f"WITH {_SHEET} SELECT sheet, 'data' AS row_role, n AS n_rows, t AS cents FROM s UNION ALL SELECT sheet, 'grand_total', 1, t FROM s",
    "sheets_types": f"WITH {_SHEET} SELECT sheet, unnest([1, 2, 3, 4]) AS col, unnest(['TEXT', 'TEXT', 'INTEGER', 'REAL']) AS col_type FROM s",
    "sheets_native": "SELECT c_mktsegment AS segmen, count(*) AS n_rows, max(c_custkey) AS last_number FROM customer GROUP BY 1 UNION ALL SELECT NULL, count(DISTINCT c_nationkey), NULL FROM customer",
    "sheets_coverage": f"WITH {_SHEET} SELECT sheet, 1 AS region_no, 4 * n + 6 AS n_cells, n AS n_covered FROM s",
    "sheets_roles": f"""WITH {_SHEET} SELECT sheet, CASE WHEN sheet = 0 THEN 'dashboard' WHEN n + 2 >= 12 AND 4 * n + 6 >= 0.55 * 4 * (n + 2) THEN 'detail' ELSE 'plain' END AS role,
        CAST(CASE WHEN sheet = 0 THEN 0.98 WHEN n + 2 >= 12 AND 4 * n + 6 >= 0.55 * 4 * (n + 2) THEN 0.9 ELSE 0.65 END AS DOUBLE) AS role_confidence FROM s""",
    "sheets_tiles": f"""WITH {_SHEET}, k AS (SELECT sheet, n + 2 AS hi, unnest(generate_series(0, (n + 1) // 50)) AS k FROM s)
        SELECT sheet, 1 AS region_no, CAST(1 + 50 * k AS INTEGER) AS min_row, CAST(least(50 + 50 * k, hi) AS INTEGER) AS max_row, 1 AS min_col, 4 AS max_col FROM k""",
    "charts_story": f"""WITH {_MONTHLY} SELECT series, true AS by_date, arg_min(value, pos) AS first_value, arg_max(value, pos) AS last_value, arg_min(category, (-value, pos)) AS max_category, max(value) AS max_value,
        arg_min(category, (value, pos)) AS min_category, min(value) AS min_value, arg_max(value, pos) - arg_min(value, pos) AS change FROM p GROUP BY series""",
    "charts_checks": f"WITH {_MONTHLY} SELECT series, false AS uneven, false AS mixed, false AS gaps FROM p GROUP BY series",
    "charts_table": f"""WITH {_MONTHLY} SELECT pos, coalesce(any_value(category) FILTER (series = 'A'), any_value(category)) AS category, max(value) FILTER (series = 'A') AS "A", max(value) FILTER (series = 'N') AS "N", max(value) FILTER (series = 'R') AS "R"
        FROM p WHERE pos <= 200 GROUP BY pos""",
    "clauses_parents": f"""WITH {_EVENTS} SELECT doc, seq, kind, CASE kind WHEN 'pasal' THEN max(seq) FILTER (kind = 'bab') OVER w WHEN 'ayat' THEN max(seq) FILTER (kind = 'pasal') OVER w END AS parent_seq FROM v
        WINDOW w AS (PARTITION BY doc ORDER BY seq)""",
    "clauses_audit": f"""WITH {_EVENTS}, g AS (SELECT *, sum((kind = 'pasal')::INT) OVER (PARTITION BY doc ORDER BY seq) AS art FROM v WHERE kind <> 'bab'),
        a AS (SELECT doc, CAST(ordinal AS INTEGER) AS o, lag(CAST(ordinal AS INTEGER)) OVER (PARTITION BY doc, art ORDER BY seq) AS b FROM g WHERE kind = 'ayat')
        SELECT doc, CASE WHEN b IS NULL THEN 'does not begin at 1' WHEN o = b + 2 THEN 'one is missing' ELSE 'jumps' END AS message, count(*) AS n FROM a WHERE (b IS NULL AND o <> 1) OR o > b + 1 GROUP BY 1, 2""",
    "clauses_open": f"""WITH {_EVENTS}, l AS (SELECT doc, kind, arg_max(ordinal, seq) AS ordinal, max(seq) AS seq FROM v GROUP BY doc, kind)
        SELECT doc, l.kind, arg_max AS ordinal, depth FROM (SELECT doc, kind, ordinal AS arg_max, seq, CASE kind WHEN 'bab' THEN 1 WHEN 'pasal' THEN 2 ELSE 3 END AS depth, max(seq) FILTER (kind = 'pasal') OVER (PARTITION BY doc) AS ps FROM l) l WHERE kind <> 'ayat' OR seq > ps""",
    "learning_latest": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY header_id ORDER BY CAST(updated_at AS TIMESTAMPTZ) DESC, total_amount DESC NULLS LAST, doc_number DESC) AS k FROM document_headers)
        SELECT header_id, doc_number FROM r WHERE k = 1 AND total_amount IS NOT NULL""",
    "learning_classes": "SELECT doc_id, CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS root FROM documents",
    "learning_split": """WITH c AS (SELECT doc_id, CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS root FROM documents), h AS (SELECT root, sha256(CAST(root AS VARCHAR)) AS h FROM c),
        m AS (SELECT root, (CAST('0x' || h[1:8] AS BIGINT) + CAST('0x' || h[9:16] AS BIGINT) + CAST('0x' || h[17:24] AS BIGINT) + CAST('0x' || h[25:32] AS BIGINT) + CAST('0x' || h[33:40] AS BIGINT) + CAST('0x' || h[41:48] AS BIGINT)
            + CAST('0x' || h[49:56] AS BIGINT) + CAST('0x' || h[57:64] AS BIGINT)) % 5 AS k FROM h)
        SELECT ['train', 'train', 'train', 'validation', 'test'][CAST(k + 1 AS INTEGER)] AS split, count(*) AS n_documents, count(DISTINCT root) AS n_groups FROM m GROUP BY 1""",
    "learning_tail": """WITH g AS (SELECT DISTINCT CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS k FROM documents),
        r AS (SELECT k, row_number() OVER (ORDER BY k DESC) AS i, greatest(1, count(*) OVER () // 5) AS n FROM g)
        SELECT CASE WHEN i <= n THEN 'test' WHEN i <= 2 * n THEN 'validation' ELSE 'train' END AS split, count(*) AS n, min(k) AS first, max(k) AS last FROM r GROUP BY 1""",
    "jobs_folders": """WITH f AS (SELECT DISTINCT coalesce(spec, 'none') AS folder, source_file AS name FROM documents WHERE source_file IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY name) AS k FROM f)
        SELECT folder, count(*) AS total_documents, count(*) FILTER (lower(name) LIKE '%.pdf') AS n_pdf, string_agg(name, ',' ORDER BY name) FILTER (k <= 5) AS samples FROM r GROUP BY folder""",
    "jobs_selected": """WITH f AS (SELECT DISTINCT coalesce(spec, 'none') AS folder, source_file AS name FROM documents WHERE source_file LIKE 'berkas_%5.pdf'), r AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY name) AS k FROM f)
        SELECT folder, name FROM r WHERE k <= 3""",
    "jobs_sampled": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM subject_labels WHERE doc_id IS NOT NULL) ORDER BY sha256('42|' || doc_id), doc_id LIMIT 40",
    "jobs_batches": """WITH s AS (SELECT user_id, CASE event_type WHEN 'click' THEN 'completed' WHEN 'view' THEN 'completed' WHEN 'purchase' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'canceled' END AS s FROM events)
        SELECT user_id, count(*) AS n_jobs, count(*) FILTER (s = 'completed') AS n_done, count(*) FILTER (s IN ('failed', 'canceled')) AS n_failed, count(*) FILTER (s = 'running') AS n_active,
            CASE WHEN bool_or(s = 'running') THEN 'Diproses' WHEN bool_or(s IN ('failed', 'canceled')) THEN 'Perlu diperiksa' ELSE 'Selesai' END AS state FROM s GROUP BY user_id""",
    "jobs_progress": """SELECT preview_id, max(chunk_id) AS current_page, any_value(total_chunks) AS total_pages, 'page' AS stage FROM (SELECT DISTINCT preview_id, chunk_id FROM chunk_items) JOIN chunking_previews USING (preview_id) GROUP BY preview_id""",
    "jobs_unreferenced": "SELECT DISTINCT _source_doc FROM transaction_details WHERE _source_doc IS NOT NULL AND _source_doc NOT IN (SELECT _source_doc FROM document_signatories WHERE _source_doc IS NOT NULL)",
    "jobs_queue": """WITH p AS (SELECT s_suppkey, s_nationkey, CAST(round(s_acctbal) AS BIGINT) AS pos FROM supplier), m AS (SELECT min(pos) - 1 AS m FROM p)
        SELECT s_suppkey, row_number() OVER (ORDER BY CASE WHEN s_nationkey = 3 THEN m ELSE pos END, s_suppkey) - 1 AS ahead FROM p, m""",
    "jobs_names": """WITH r AS (SELECT doc_id, source_file, row_number() OVER (PARTITION BY lower(source_file) ORDER BY doc_id) AS k FROM documents WHERE source_file IS NOT NULL)
        SELECT doc_id, CASE WHEN k = 1 THEN source_file ELSE source_file || ' (' || k || ')' END AS unique_name FROM r""",
    "survey_islands": """WITH e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > 86400 THEN 1 ELSE 0 END AS n FROM e),
        i AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY t RANGE UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM i GROUP BY user_id, k""",
    "survey_inherited": """WITH x AS (SELECT DISTINCT source_doc, region_id, reading_order, label FROM ocr_regions), i AS (SELECT *, sum(CASE WHEN label = 'header' THEN 1 ELSE 0 END) OVER (PARTITION BY source_doc ORDER BY region_id) AS k FROM x)
        SELECT region_id, last_value(reading_order IGNORE NULLS) OVER (PARTITION BY source_doc, k ORDER BY region_id) AS reading_order FROM i""",
    "vectors_nearest": """WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 20 = 0),
        s AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(CAST(v AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 9) DESC, vec_id) AS rank FROM q, embeddings)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id FROM s WHERE rank <= 5""",
}
