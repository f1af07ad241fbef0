"""Queries over page texts, clause amounts, scores, listings, layouts of scanned pages and the SQL surface."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom import sql as Q
from paperloom.functions import cells as C
from paperloom.functions import labels as L
from paperloom.functions import pagetext as P
from paperloom.operators import geometry as R
from paperloom.operators import hierarchy as H
from paperloom.operators import jobs as J
from paperloom.operators import learning as N
from paperloom.operators import quality as Y
from paperloom.operators import survey as V
from paperloom.session import load


# ---- cells and labels ----


def slugs(spark: SparkSession, d: str) -> DataFrame:
    """Document titles as short file names."""
    x = load(spark, d, "document_headers").where(F.col("doc_title").isNotNull())
    return x.select(C.slug("doc_title", "dok", 20).alias("slug")).groupBy("slug").agg(F.count(F.lit(1)).alias("n"))


def stable_values(spark: SparkSession, d: str) -> DataFrame:
    """Order totals and dates as text that does not change with the engine."""
    return load(spark, d, "orders").select("o_orderkey", C.stable_text("o_totalprice", "n").alias("total"), C.stable_text("o_orderdate", "d").alias("day"), C.stable_text("o_custkey", "s").alias("customer"))


def shown_times(spark: SparkSession, d: str) -> DataFrame:
    """Event times as shown to people."""
    return load(spark, d, "events").select("event_id", C.display_time(F.col("ts").cast("timestamp")).alias("shown"))


def grounded(spark: SparkSession, d: str) -> DataFrame:
    """A model's tagged answers, one per page, read back as regions with boxes in pixels."""
    r = load(spark, d, "ocr_regions").where(F.col("bbox_model").isNotNull() & F.col("source_doc").isNotNull()).select("region_id", "source_doc", "page_number", "label", "bbox_model").distinct()
    one = F.concat(
        F.lit("<|ref|>"), F.col("label"), F.lit("<|/ref|><|det|>[["), F.array_join(F.transform("bbox_model", lambda v: v.cast("string")), ", "), F.lit("]]<|/det|>\nisi "), F.col("region_id").cast("string"), F.lit("\n")
    )
    pages = r.groupBy("source_doc", "page_number").agg(F.array_join(F.array_sort(F.collect_list(one)), "").alias("raw"))
    x = pages.select(F.explode(L.grounded_regions(F.col("raw"), F.lit(1200), F.lit(1600))).alias("g"))
    return x.select("g.label", "g.text", *[F.col("g.bbox_pixels")[k].alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))])


# ---- page texts ----


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_partkey").cast("string").alias("t"), "p_name")


def sheet_sections(spark: SparkSession, d: str) -> DataFrame:
    """The sheets of workbooks written as Markdown, one workbook per region."""
    x = load(spark, d, "nation").groupBy(F.col("n_regionkey").alias("wb")).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("## "), "n_name", F.lit("  \n\nIsi "), F.col("n_nationkey").cast("string"), F.lit("\n")))), "\n").alias("t"))
    y = x.select("wb", F.explode(P.split_sheets(F.concat(F.lit("# Buku\n\nawal\n\n"), F.col("t")))).alias("s"))
    return y.select("wb", "s.sheet", "s.content")


def without_images(spark: SparkSession, d: str) -> DataFrame:
    """Page texts without embedded pictures."""
    t = F.concat(F.lit('awal\n\n<div align="c"><img src="x.png"></div>\n\n\n\n![a](b.png)\n\n<IMG SRC=1>akhir '), F.col("t"))
    return _parts(spark, d).select("k", P.strip_images(t).alias("text"))


def without_thoughts(spark: SparkSession, d: str) -> DataFrame:
    """A model's answers without its train of thought, page markers and the fence around the whole."""
    title = F.concat(F.lit("# Judul "), F.col("t"), F.lit("\nisi"))
    raw = (
        F.when(F.col("k") % 4 == 0, F.concat(F.lit("<think>a\nb</think>\n"), title)).when(F.col("k") % 4 == 1, F.concat(F.lit("Mari kita lihat.\nlalu\n"), title))
        .when(F.col("k") % 4 == 2, F.concat(F.lit("<!-- PAGE: 3 -->\n"), title)).otherwise(F.concat(F.lit("```markdown\n"), title, F.lit("\n```")))
    )
    return _parts(spark, d).select("k", P.unfence(P.strip_markers(raw)).alias("text"))


def united_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of two runs, the later run's first, stitched into one text per preview."""
    x = load(spark, d, "chunk_items").select("preview_id", "chunk_id").distinct()
    page = lambda word: F.concat(F.lit(word), F.col("chunk_id").cast("string"), F.lit("."))
    old, new = x.withColumn("content", page("Isi lama ")), x.where("chunk_id % 3 = 0").withColumn("content", page("Isi baru "))
    return P.stitch(P.upsert_pages(old, new, "preview_id", "chunk_id"), "preview_id", "chunk_id", "content", markers=False)


def flowing_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages joined under their titles: a page goes on in the paragraph before unless that ended."""
    x = load(spark, d, "supplier").select((F.col("s_suppkey") % 10).alias("doc"), "s_suppkey", F.concat(F.lit("isi "), F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 3 == 0, ".").otherwise("")).alias("content"), F.lit("Judul").alias("title"))
    return P.stitch(x, "doc", "s_suppkey", "content", "title", markers=False)


def folded_words(spark: SparkSession, d: str) -> DataFrame:
    """The words of scanned regions, one blank between."""
    x = load(spark, d, "ocr_regions").where(F.col("text").isNotNull()).select("region_id", "text").distinct()
    return x.select("region_id", P.normalized_words(F.col("text")).alias("words"))


def catchwords(spark: SparkSession, d: str) -> DataFrame:
    """Whether the next page begins with what the catchword announces."""
    x = load(spark, d, "part").select("p_partkey", "p_name", "p_type", (F.col("p_partkey") % 3).alias("k"))
    head = F.when(F.col("k") == 0, F.concat(F.lit("Lalu "), F.upper(F.element_at(F.split("p_name", " "), -1)))).when(F.col("k") == 1, F.lit("1 2 3")).otherwise(F.concat("p_name", F.lit(" dan")))
    return x.select("p_partkey", P.catchword_missing(F.concat("p_name", F.lit(" —")), head).alias("missing"))


def judged(spark: SparkSession, d: str) -> DataFrame:
    """Whether a revision passes the guards: leaks, emptiness, lost diagrams, bloat, truncation."""
    draft = F.concat(F.repeat(F.lit("kata "), F.col("p_size") * 8), F.lit("akhir."))
    forms = (("good", F.concat(draft, F.lit(" Baik."))), ("double", F.concat(draft, F.lit(" "), draft)), ("third", F.concat(F.repeat(F.lit("kata "), F.floor(F.col("p_size") * 2.5).cast("int")), F.lit("akhir."))), ("leak", F.concat(F.lit("Mari kita lihat.\n"), draft)), ("empty", F.lit("  ")))
    # A part makes some kilobytes of text, so even a small file is spread; a stated number is not coalesced.
    parts = load(spark, d, "part").select("p_partkey", "p_size").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    x = parts.select("p_partkey", draft.alias("draft"), F.explode(F.array(*[F.struct(F.lit(n).alias("form"), t.alias("raw")) for n, t in forms])).alias("f"))
    return x.select("p_partkey", "f.form", (P.accepted_revision(F.col("draft"), F.col("f.raw")) == F.col("draft")).alias("draft_kept"))


def described(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions of pictures as quoted blocks; those that are already are left alone."""
    t = F.when(F.col("k") % 2 == 0, F.concat(F.lit("\n Baris satu \n\n  baris dua "), F.col("t"))).otherwise(F.concat(F.lit("> **[Diagram/Visual]:** sudah "), F.col("t")))
    return _parts(spark, d).select("k", P.visual_description(t).alias("text"))


def diagram_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The diagram code inside page texts."""
    t = F.concat(F.lit("a\n```mermaid\ngraph TD\nA"), F.col("t"), F.lit("-->B\n```\nb\n```Mermaid x"), F.col("t"), F.lit("```"))
    return _parts(spark, d).select("k", F.posexplode(P.mermaid_blocks(t)).alias("place", "code"))


def reflowed(spark: SparkSession, d: str) -> DataFrame:
    """Scanned pages reflowed from their regions, and why some keep their first text."""
    r = load(spark, d, "ocr_regions").where(F.col("source_doc").isNotNull()).select("source_doc", "page_number", "region_no", "region_id", "label", "text").distinct()
    kind = F.when(F.col("label") == "paragraph_title", "section").otherwise("text")
    return Y.reflow_regions(r.withColumn("kind", kind), ["source_doc", "page_number"], ["region_no", "region_id"], "kind", "text", F.array(F.when(F.col("page_number") % 5 == 0, "chat_transcript").otherwise("plain")))


# ---- clauses ----


def _amount_events(spark: SparkSession, d: str) -> DataFrame:
    """Per customer an article whose two lettered amounts refer to the letter of another; every third does not add up."""
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("doc"), (F.abs(F.round("c_acctbal")).cast("long") + 100).alias("v"), F.when(F.col("c_custkey") % 3 == 0, 10).otherwise(0).alias("off"))
    money = lambda x: F.concat(F.lit("Rp "), F.translate(F.format_number(x, 2), ",.", ".,"))
    text = F.lit("Jumlah sebagaimana dimaksud dalam Pasal 2 huruf a terdiri atas:")
    rows = ((1, "pasal", "1", text), (2, "huruf", "a", money(F.col("v") - 50 - F.col("off"))), (3, "huruf", "b", money(F.lit(50).cast("long"))), (4, "pasal", "2", F.lit(None).cast("string")), (5, "huruf", "a", money(F.col("v"))), (6, "huruf", "d", F.lit("lain")))
    events = F.array(*[F.struct(F.lit(s).cast("long").alias("seq"), F.lit(k).alias("kind"), F.lit(o).alias("ordinal"), t.alias("text")) for s, k, o, t in rows])
    return c.select("doc", F.explode(events).alias("e")).select("doc", "e.*", F.lit(None).cast("string").alias("label"), F.lit(1).cast("long").alias("page"))


def amount_audit(spark: SparkSession, d: str) -> DataFrame:
    """Clauses whose lettered amounts do not add up to the amount they refer to."""
    return H.amount_audit(_amount_events(spark, d))


def amount_checks(spark: SparkSession, d: str) -> DataFrame:
    """How many clauses of each document name a total that can be checked."""
    return H.count_amount_checks(_amount_events(spark, d))


def clause_text(spark: SparkSession, d: str) -> DataFrame:
    """Documents rendered from their clauses."""
    return H.render(_amount_events(spark, d))


def clause_report(spark: SparkSession, d: str) -> DataFrame:
    """The findings of the number audit as text."""
    return H.violation_report(H.ordinal_audit(_amount_events(spark, d)))


# ---- learning ----


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    table = F.concat(F.lit("Nomor "), F.col("c_custkey").cast("string"), F.lit("\n| a | b |\n|---|---|\n| 1 | "), F.col("c_custkey").cast("string"), F.lit(" |"))
    said = F.when(F.col("c_custkey") % 3 == 0, table).when(F.col("c_custkey") % 3 == 1, F.lit(" ")).otherwise(F.lit("????"))
    return load(spark, d, "customer").select("c_custkey", "c_nationkey", table.alias("right"), said.alias("said"))


def scored_pages(spark: SparkSession, d: str) -> DataFrame:
    """Predictions that are right, empty or have nothing in common with the reference."""
    return N.with_scores(_pairs(spark, d), "right", "said").select("c_custkey", "text_score", "table_score", "score", "wrong_numbers")


def evaluated(spark: SparkSession, d: str) -> DataFrame:
    """Mean scores per nation, and whether a candidate that is always right improves on them."""
    e = N.evaluation(N.with_scores(_pairs(spark, d), "right", "said"), ["c_nationkey"])
    best = F.struct(F.lit(1.0).alias("text_score"), F.lit(1.0).alias("table_score"), F.lit(1.0).alias("score"))
    return e.select("c_nationkey", "n_pages", *[F.round(c, 6).alias(c) for c in ("text_score", "table_score", "score")], N.is_improvement(F.struct("text_score", "table_score", "score"), best).alias("improves"))


def releases(spark: SparkSession, d: str) -> DataFrame:
    """A release log in which entries were replaced, each with what a rollback returns to."""
    s = load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("v"), F.col("s_suppkey").cast("string")).alias("version"))
    again = s.where("id % 4 = 0").withColumn("version", F.concat("version", F.lit("b")))
    return N.previous_release(N.upsert(s, again, "id"))


# ---- jobs ----


def merged_listing(spark: SparkSession, d: str) -> DataFrame:
    """Documents known in memory and on disk, memory first for the same key."""
    s = load(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 5 == 0).alias("active"), "s_acctbal")
    return J.merge_listings(s.where("s_suppkey % 2 = 0").withColumn("side", F.lit("memory")), s.where("s_suppkey % 3 = 0").withColumn("side", F.lit("disk")), "s_suppkey", "active", "s_acctbal")


def run_summaries(spark: SparkSession, d: str) -> DataFrame:
    """How the runs went: one in which some fail, one in which none does, one in which all do, one without any."""
    o, parts = load(spark, d, "orders"), None
    for name, where in (("some", "true"), ("none", "o_orderkey % 2 = 0"), ("all", "o_orderkey % 2 = 1"), ("empty", "false")):
        part = J.run_summary(o.where(where), F.col("o_orderkey") % 2 == 0).withColumn("run", F.lit(name))
        parts = part if parts is None else parts.unionByName(part)
    return parts


_STATUS = {"click": "running", "view": "completed", "purchase": "queued", "error": "failed"}


def active_counts(spark: SparkSession, d: str) -> DataFrame:
    """Jobs of each user by state, a column per state."""
    status = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in _STATUS.items() for x in kv]), F.col("event_type")), F.lit("paused"))
    return J.status_counts(load(spark, d, "events").select("user_id", status.alias("status")), "user_id", "status")


def deduped_uploads(spark: SparkSession, d: str) -> DataFrame:
    """Uploads of which the same path and content came before are left out."""
    x = load(spark, d, "documents").where(F.col("source_file").isNotNull() & F.col("text").isNotNull()).select(F.col("source").alias("path"), "text", "doc_id")
    return J.dedupe_uploads(x.where(F.col("path").isNotNull()), "path", F.col("text"), "doc_id").select("path", "doc_id")


# ---- scanned pages ----


def densities(spark: SparkSession, d: str) -> DataFrame:
    """Columns of ink by how full they are."""
    values = F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda i: (i <= F.col("s_suppkey") % 25).cast("int"))
    x = Y.column_density(load(spark, d, "supplier").select("s_suppkey", values.alias("v")), "s_suppkey", "v")
    return x.select("s_suppkey", F.round("density", 6).alias("density"), V.density_class(F.col("density")).alias("class"))


def _scans(spark: SparkSession, d: str) -> DataFrame:
    """Forty pages per nation: tables whose columns drift, with plain pages between."""
    n = load(spark, d, "nation").select(F.col("n_nationkey").alias("doc"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("page"))
    mode = F.when(F.col("page") % 20 == 19, "text").otherwise("table")
    return n.select("doc", "page", mode.alias("mode"), F.array(0.1 + 0.02 * (F.col("page") % 5), F.lit(0.8)).alias("lines"), (F.col("page") % (F.col("doc") % 5 + 3) == 0).alias("starts"))


def page_spans(spark: SparkSession, d: str) -> DataFrame:
    """Runs of pages with one layout, compared with the first page of the run."""
    return V.spans(_scans(spark, d), "doc", "page", "mode", "lines")


def page_batches(spark: SparkSession, d: str) -> DataFrame:
    """Runs of about ten pages that begin, where one is near, on a page that starts a row."""
    return V.plan_batches(_scans(spark, d), "doc", "page", "starts")


def ink(spark: SparkSession, d: str) -> DataFrame:
    """How much of made-up pictures is dark, and how it lies."""
    dark = (F.col("s_suppkey") % 20).cast("int")  # rows of a picture of 20 by 10 that are dark in their left half
    picture = F.unhex(F.concat(F.repeat(F.lit("00" * 5 + "FF" * 5), dark), F.repeat(F.lit("FF" * 10), 20 - dark)))
    x = Y.ink_signals(load(spark, d, "supplier").select("s_suppkey", picture.alias("p"), F.lit(10).alias("w")), "s_suppkey", "p", "w")
    return x.select("s_suppkey", *[F.round(c, 6).alias(c) for c in ("ink_ratio", "row_energy", "column_energy")])


def _pictures(spark: SparkSession, d: str) -> DataFrame:
    """Pages of 200 by 502 points with a ruled table; the second column's line moves with the key, every fifth page has no lines down."""
    k = F.col("s_suppkey")
    dark, blank = F.lit("00" * 200), F.lit("FF" * 200)
    at = (70 + 10 * (k % 3)).cast("int")
    header = F.when(k % 5 == 0, blank).otherwise(F.concat(F.lit("FF" * 20 + "0000"), F.repeat(F.lit("FF"), at - 22), F.lit("0000"), F.repeat(F.lit("FF"), 178 - at), F.lit("0000"), F.lit("FF" * 18)))
    parts = ((blank, 30), (dark, 2), (header, 28), (dark, 2), (header, 28), (dark, 2), (blank, 308), (dark, 2), (blank, 100))
    return load(spark, d, "supplier").select("s_suppkey", F.unhex(F.concat(*[F.repeat(c, n) for c, n in parts])).alias("picture"), F.lit(200).alias("width"))


def grids(spark: SparkSession, d: str) -> DataFrame:
    """Where the ruled tables of made-up pages have their columns, header and body."""
    x = R.survey_pages(_pictures(spark, d), ["s_suppkey"], "picture", "width")
    return x.select("s_suppkey", "mode", F.array_join(F.transform("separators", lambda v: F.format_string("%.3f", v)), ",").alias("separators"), "header_top", "header_bottom", "body_top", "body_bottom")


def row_starts(spark: SparkSession, d: str) -> DataFrame:
    """The numbers that begin rows: in the first column of the body, neither in the header nor at the foot."""
    g = R.survey_pages(_pictures(spark, d), ["s_suppkey"], "picture", "width").withColumn("width", F.lit(200))
    spots = ((30.0, 120.0, "1."), (30.0, 200.0, "lanjut"), (40.0, 300.0, "2a"), (120.0, 150.0, "3"), (30.0, 50.0, "4"), (30.0, 450.0, "SK 5"))
    words = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(t).alias("text")) for x, y, t in spots])
    w = load(spark, d, "supplier").select("s_suppkey", F.explode(words).alias("w")).select("s_suppkey", "w.*")
    return R.row_starts(w, g, ["s_suppkey"], "width").select("s_suppkey", F.array_join("tokens", " ").alias("tokens"))


# ---- the SQL surface ----


def guarded(spark: SparkSession, d: str) -> DataFrame:
    """Which statements the read-only surface takes: one per nation, in five forms."""
    forms = ("SELECT {k} AS n", "select {k}; drop table x", "DELETE FROM t WHERE n = {k}", "-- ask\nSELECT 'drop {k}; x'", "WITH a AS (SELECT {k}) SELECT * FROM a")
    keys = [r["n_nationkey"] for r in load(spark, d, "nation").select("n_nationkey").collect()]
    return spark.createDataFrame([(int(k), Q.allowed(forms[k % 5].format(k=k))) for k in keys], "n_nationkey long, taken boolean")


def asked(spark: SparkSession, d: str) -> DataFrame:
    """A page of rows of a statement of a user's own, with the registered functions."""
    Q.register(spark)
    load(spark, d, "supplier").createOrReplaceTempView("paperloom_suppliers")
    out = Q.run_select(spark, "SELECT s_suppkey AS id, parse_number(concat('Rp ', s_nationkey, '.000,50')) AS n, clean_cell(concat(' **', s_name, '** ')) AS name, sanitize_ident(concat('No. ', s_suppkey)) AS ident, parse_date_iso('3/4/2024') AS day FROM paperloom_suppliers WHERE s_suppkey > :least ORDER BY s_suppkey", 60, least=5)
    return spark.createDataFrame(out["rows"], "id long, n double, name string, ident string, day string")


def catalogued(spark: SparkSession, d: str) -> DataFrame:
    """The columns of tables made known to the surface."""
    for t in ("nation", "supplier"):
        load(spark, d, t).createOrReplaceTempView(f"paperloom_{t}")
    x = Q.catalog_of(spark, ["paperloom_nation", "paperloom_supplier"])
    return x.select(F.regexp_replace("table_name", "paperloom_", "").alias("table_name"), "column_name")


QUERIES = {
    "cells_slugs": slugs, "cells_stable": stable_values, "cells_times": shown_times, "labels_grounded": grounded, "pages_sheets": sheet_sections, "pages_images": without_images, "pages_thoughts": without_thoughts,
    "pages_united": united_pages, "pages_flowing": flowing_pages, "pages_words": folded_words, "pages_catchwords": catchwords, "pages_judged": judged, "pages_described": described, "pages_diagrams": diagram_blocks, "pages_reflowed": reflowed,
    "clauses_amount_audit": amount_audit, "clauses_amount_checks": amount_checks, "clauses_text": clause_text, "clauses_report": clause_report, "learning_scored": scored_pages, "learning_evaluated": evaluated,
    "learning_releases": releases, "jobs_merged": merged_listing, "jobs_summaries": run_summaries, "jobs_active": active_counts, "jobs_uploads": deduped_uploads, "survey_densities": densities, "survey_spans": page_spans,
    "survey_batches": page_batches, "survey_ink": ink, "survey_grids": grids, "survey_row_starts": row_starts, "sql_guarded": guarded, "sql_asked": asked, "sql_catalog": catalogued,
}

_N = "chr(10)"
_RP = "'Rp ' || replace(replace(replace(format('{:,}', CAST(%s AS BIGINT)), ',', '.'), ' ', ''), 'x', '') || ',00'"
_AMOUNT = "c AS (SELECT c_custkey AS doc, CAST(abs(round(c_acctbal)) AS BIGINT) + 100 AS v, CASE WHEN c_custkey % 3 = 0 THEN 10 ELSE 0 END AS off FROM customer)"
_PAGE_TEXT = r"regexp_replace(regexp_replace(text, '([\pL\pN])[-‐‑¬\x{ad}][ \t]*\n[ \t]*(\p{Ll})', '\1\2', 'g'), '[\s\pZ\x{1c}-\x{1f}\x{85}]+', ' ', 'g')"
_SCORED = """p AS (SELECT c_custkey, c_nationkey, CASE c_custkey % 3 WHEN 0 THEN 1.0 ELSE 0.0 END AS text_score, CASE c_custkey % 3 WHEN 0 THEN 1.0 ELSE 0.0 END AS table_score, CASE c_custkey % 3 WHEN 0 THEN 1.0 ELSE 0.0 END AS score,
    CASE c_custkey % 3 WHEN 0 THEN 0 ELSE 3 END AS wrong_numbers FROM customer)"""
ORACLE = {
    "cells_slugs": r"SELECT coalesce(nullif(substring(lower(trim(regexp_replace(regexp_replace(strip_accents(doc_title), '[^\x00-\x7f]', '', 'g'), '[^a-zA-Z0-9]+', '_', 'g'), '_')), 1, 20), ''), 'dok') AS slug, count(*) AS n FROM document_headers WHERE doc_title IS NOT NULL GROUP BY 1",
    "cells_stable": "SELECT o_orderkey, CASE WHEN o_totalprice = floor(o_totalprice) THEN CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) ELSE CAST(o_totalprice AS VARCHAR) END AS total, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS day, CAST(o_custkey AS VARCHAR) AS customer FROM orders",
    "cells_times": "SELECT event_id, strftime(ts + INTERVAL 7 HOUR, '%d %b %Y, %H:%M:%S') AS shown FROM events",
    "labels_grounded": """
        WITH b AS (SELECT DISTINCT region_id, label, source_doc, page_number, bbox_model FROM ocr_regions WHERE bbox_model IS NOT NULL AND source_doc IS NOT NULL),
        r AS (SELECT region_id, coalesce(nullif(trim(label), ''), 'unknown') AS label, bbox_model AS m FROM b WHERE label IS NOT NULL),
        s AS (SELECT label, 'isi ' || region_id AS text, least(greatest(CAST(round_even(m[1] / 1024.0 * 1200, 0) AS INTEGER), 0), 1200) AS x1, least(greatest(CAST(round_even(m[2] / 1024.0 * 1600, 0) AS INTEGER), 0), 1600) AS y1,
            least(greatest(CAST(round_even(m[3] / 1024.0 * 1200, 0) AS INTEGER), 0), 1200) AS x2, least(greatest(CAST(round_even(m[4] / 1024.0 * 1600, 0) AS INTEGER), 0), 1600) AS y2 FROM r)
        SELECT * FROM s WHERE x2 > x1 AND y2 > y1""",
    "pages_sheets": "SELECT n_regionkey AS wb, n_name AS sheet, 'Isi ' || n_nationkey AS content FROM nation",
    "pages_images": f"SELECT p_partkey AS k, 'awal' || {_N} || {_N} || 'akhir ' || p_partkey AS text FROM part",
    "pages_thoughts": f"SELECT p_partkey AS k, '# Judul ' || p_partkey || {_N} || 'isi' AS text FROM part",
    "pages_united": f"""WITH x AS (SELECT DISTINCT preview_id, chunk_id FROM chunk_items)
        SELECT preview_id, string_agg(CASE WHEN chunk_id % 3 = 0 THEN 'Isi baru ' ELSE 'Isi lama ' END || chunk_id || '.', {_N} || {_N} ORDER BY chunk_id) || {_N} AS text FROM x GROUP BY preview_id""",
    "pages_flowing": f"""WITH x AS (SELECT s_suppkey % 10 AS doc, s_suppkey AS k, lag(s_suppkey) OVER (PARTITION BY s_suppkey % 10 ORDER BY s_suppkey) AS before FROM supplier),
        y AS (SELECT doc, k, CASE WHEN before IS NULL THEN '# Judul' || {_N} || {_N} WHEN before % 3 = 0 THEN {_N} || {_N} ELSE ' ' END || 'isi ' || k || CASE WHEN k % 3 = 0 THEN '.' ELSE '' END AS t FROM x)
        SELECT doc, string_agg(t, '' ORDER BY k) || {_N} AS text FROM y GROUP BY doc""",
    "pages_words": r"SELECT DISTINCT region_id, array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}]+'), ' ') AS words FROM ocr_regions WHERE text IS NOT NULL",
    "pages_catchwords": "SELECT p_partkey, p_partkey % 3 = 1 AS missing FROM part",
    "pages_judged": """WITH x AS (SELECT p_partkey, form, p_size * 40 + 6 AS a, floor(p_size * 2.5) * 5 + 6 AS third FROM part, (VALUES ('good'), ('double'), ('third'), ('leak'), ('empty')) v(form))
        SELECT p_partkey, form, CASE form WHEN 'good' THEN false WHEN 'double' THEN a > 500 AND 2 * a + 1 > 1.8 * a WHEN 'third' THEN a > 800 AND third < 0.45 * a ELSE true END AS draft_kept FROM x""",
    "pages_described": f"SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN '> **[Diagram/Visual]:** Baris satu' || {_N} || '> baris dua ' || p_partkey ELSE '> **[Diagram/Visual]:** sudah ' || p_partkey END AS text FROM part",
    "pages_diagrams": f"SELECT p_partkey AS k, place, CASE place WHEN 0 THEN 'graph TD' || {_N} || 'A' || p_partkey || '-->B' ELSE 'x' || p_partkey END AS code FROM part, (VALUES (0), (1)) v(place)",
    "pages_reflowed": rf"""
        WITH r AS (SELECT DISTINCT source_doc, page_number, region_no, region_id, label, text FROM ocr_regions WHERE source_doc IS NOT NULL),
        b AS (SELECT *, trim({_PAGE_TEXT}) AS t FROM r),
        g AS (SELECT source_doc, page_number, string_agg(CASE WHEN label = 'paragraph_title' THEN '## ' ELSE '' END || t, {_N} || {_N} ORDER BY region_no, region_id) FILTER (t <> '') AS text FROM b GROUP BY ALL)
        SELECT source_doc, page_number, CASE WHEN page_number % 5 = 0 THEN 'ineligible_spec' WHEN text IS NULL OR NOT regexp_matches(text, '[\pL\pN]') THEN 'empty_output' ELSE 'applied' END AS status, CASE WHEN status = 'applied' THEN text END AS text FROM g""",
    "clauses_amount_audit": f"WITH {_AMOUNT} SELECT doc, 1 AS seq, CAST(v - off AS DOUBLE) AS total, CAST(v AS DOUBLE) AS declared FROM c WHERE off > 0",
    "clauses_amount_checks": f"WITH {_AMOUNT} SELECT doc, 1 AS n_checks FROM c",
    "clauses_text": f"""WITH {_AMOUNT} SELECT doc, '#### Pasal 1  <!-- hal.1 -->' || {_N} || {_N} || 'Jumlah sebagaimana dimaksud dalam Pasal 2 huruf a terdiri atas:' || {_N} || '- a. ' || {_RP % '(v - 50 - off)'} || {_N} || '- b. Rp 50,00' || {_N} || {_N}
        || '#### Pasal 2  <!-- hal.1 -->' || {_N} || '- a. ' || {_RP % 'v'} || {_N} || '- d. lain' || {_N} AS text FROM c""",
    "clauses_report": f"SELECT c_custkey AS doc, 'Auditor: 1 temuan' || {_N} || '  ESKALASI hal.1    huruf     jumps' AS report FROM customer",
    "learning_scored": f"WITH {_SCORED} SELECT c_custkey, text_score, table_score, score, wrong_numbers FROM p",
    "learning_evaluated": f"""WITH {_SCORED}, e AS (SELECT c_nationkey, count(*) AS n_pages, avg(text_score) AS text_score, avg(table_score) AS table_score, avg(score) AS score FROM p GROUP BY 1)
        SELECT c_nationkey, n_pages, round(text_score, 6) AS text_score, round(table_score, 6) AS table_score, round(score, 6) AS score, score < 1 AS improves FROM e""",
    "learning_releases": "WITH r AS (SELECT s_suppkey AS id, 'v' || s_suppkey || CASE WHEN s_suppkey % 4 = 0 THEN 'b' ELSE '' END AS version FROM supplier) SELECT id, version, lag(version) OVER (ORDER BY id) AS previous_version FROM r",
    "jobs_merged": "SELECT s_suppkey, s_suppkey % 5 = 0 AS active, s_acctbal, CASE WHEN s_suppkey % 2 = 0 THEN 'memory' ELSE 'disk' END AS side FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0",
    "jobs_summaries": """WITH x AS (SELECT run, count(o_orderkey) AS total, count(*) FILTER (o_orderkey % 2 = 0) AS n_success FROM (VALUES ('some'), ('none'), ('all'), ('empty')) v(run)
            LEFT JOIN orders ON run = 'some' OR (run = 'none' AND o_orderkey % 2 = 0) OR (run = 'all' AND o_orderkey % 2 = 1) GROUP BY run)
        SELECT run, total, n_success, total - n_success AS n_error, CASE WHEN total = n_success THEN 'success' WHEN n_success > 0 THEN 'partial' ELSE 'error' END AS status FROM x""",
    "jobs_active": """SELECT user_id, count(*) FILTER (event_type = 'purchase') AS queued, count(*) FILTER (event_type = 'click') AS running, count(*) FILTER (event_type NOT IN ('click', 'view', 'purchase', 'error') OR event_type IS NULL) AS paused,
        count(*) FILTER (event_type = 'view') AS completed, count(*) FILTER (event_type = 'error') AS failed, 0 AS canceled FROM events GROUP BY user_id""",
    "jobs_uploads": "SELECT source AS path, min(doc_id) AS doc_id FROM documents WHERE source_file IS NOT NULL AND text IS NOT NULL AND source IS NOT NULL GROUP BY source, text",
    "survey_densities": "SELECT s_suppkey, CAST(s_suppkey % 25 AS DOUBLE) AS density, CASE WHEN s_suppkey % 25 >= 13 THEN 'filled' WHEN s_suppkey % 25 <= 9 THEN 'empty' ELSE 'unsure' END AS class FROM supplier",
    # Columns move by 0.02 a page and come back every fifth; a page of text where a new run begins anyway changes nothing.
    "survey_spans": """WITH p AS (SELECT n_nationkey AS doc, CAST(page AS INTEGER) AS page FROM nation, range(40) t(page))
        SELECT doc, page, CAST(3 * (page // 5) + [1, 1, 2, 2, 3][page % 5 + 1] AS INTEGER) AS span FROM p""",
    "survey_batches": """WITH RECURSIVE b AS (SELECT n_nationkey AS doc, n_nationkey % 5 + 3 AS every, 0 AS batch, 0 AS s, -1 AS e FROM nation
        UNION ALL SELECT doc, every, batch + 1, e + 1, least(CASE WHEN e + 11 > 39 THEN e + 11 ELSE coalesce(
            (SELECT arg_min(q, abs(q - (e + 11)) * 100 + q) FROM range(40) t(q) WHERE q % every = 0 AND abs(q - (e + 11)) <= 2 AND q > e + 1), e + 11) END - 1, 39) FROM b WHERE e < 39)
        SELECT doc, CAST(batch AS INTEGER) AS batch, CAST(s AS INTEGER) AS first_page, CAST(e AS INTEGER) AS last_page FROM b WHERE batch > 0""",
    "survey_ink": """WITH x AS (SELECT s_suppkey, s_suppkey % 20 AS k FROM supplier)
        SELECT s_suppkey, round(k * 5 / 200.0, 6) AS ink_ratio, CASE WHEN k = 0 THEN 0.0 ELSE round(1.0 / k, 6) END AS row_energy, CASE WHEN k = 0 THEN 0.0 ELSE 0.2 END AS column_energy FROM x""",
    "survey_grids": """SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'text' ELSE 'table' END AS mode, CASE WHEN mode = 'table' THEN format('{:.3f},{:.3f},{:.3f}', 20 / 200.0, (70 + 10 * (s_suppkey % 3)) / 200.0, 180 / 200.0) END AS separators,
        CASE WHEN mode = 'table' THEN 30 END AS header_top, CASE WHEN mode = 'table' THEN 90 END AS header_bottom, CASE WHEN mode = 'table' THEN 110 END AS body_top, CASE WHEN mode = 'table' THEN 380 END AS body_bottom FROM supplier""",
    "survey_row_starts": "SELECT s_suppkey, '1. 2a' AS tokens FROM supplier WHERE s_suppkey % 5 <> 0",
    "sql_guarded": "SELECT n_nationkey, n_nationkey % 5 IN (0, 3) AS taken FROM nation",
    "sql_asked": "SELECT s_suppkey AS id, s_nationkey * 1000 + 0.5 AS n, s_name AS name, 'no_' || s_suppkey AS ident, '2024-04-03' AS day FROM supplier WHERE s_suppkey > 5 ORDER BY s_suppkey LIMIT 60",
    "sql_catalog": "SELECT table_name, column_name FROM information_schema.columns WHERE table_name IN ('nation', 'supplier')",
}
