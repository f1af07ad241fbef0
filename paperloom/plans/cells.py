"""Queries over cells, labels and page texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import cells as C
from paperloom.functions import labels as L
from paperloom.functions import ordinals as O
from paperloom.functions import pagetext as P
from paperloom.session import load


def _cents(c) -> F.Column:
    return F.sum(F.round(c * 100).cast("long"))


def number_locales(spark: SparkSession, d: str) -> DataFrame:
    """Prices written in four ways and read back."""
    v = F.col("l_extendedprice")
    us = F.format_number(v, 2)
    local = F.translate(us, ",.", ".,")
    shapes = F.array(*[F.struct(F.lit(n).alias("shape"), t.alias("t")) for n, t in (("us", us), ("id", F.concat(F.lit("Rp "), local)), ("bracket", F.concat(F.lit("("), us, F.lit(")"))), ("minus", F.concat(F.lit("**-"), local, F.lit("**"))))])
    x = load(spark, d, "lineitem").select(F.explode(shapes).alias("s")).select("s.shape", C.parse_number("s.t").alias("n"))
    return x.groupBy("shape").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("n").isNull()).alias("n_null"), _cents(F.col("n")).alias("total_cents"))


def number_dirty(spark: SparkSession, d: str) -> DataFrame:
    """What the number reader makes of reference numbers."""
    x = load(spark, d, "transaction_details").select("detail_id", C.parse_number("ref_no").alias("value"))
    return x.where(F.col("value").isNotNull())


def date_dirty(spark: SparkSession, d: str) -> DataFrame:
    """How far three written forms of dates reach in each date column."""
    t, s, h = load(spark, d, "transaction_details"), load(spark, d, "document_signatories"), load(spark, d, "document_headers")
    x = (
        t.select(F.lit("txn_date").alias("field"), F.col("txn_date").alias("v")).unionByName(t.select(F.lit("value_date").alias("field"), F.col("value_date").alias("v")))
        .unionByName(s.select(F.lit("date").alias("field"), F.col("date").alias("v"))).unionByName(h.select(F.lit("doc_date").alias("field"), F.col("doc_date").alias("v")))
    )
    p = C.parse_date("v")
    return x.groupBy("field").agg(F.count("v").alias("n_values"), F.count(p).alias("n_dates"), F.min(p).alias("first_date"), F.max(p).alias("last_date"), F.countDistinct(p).alias("n_days"))


def identifiers(spark: SparkSession, d: str) -> DataFrame:
    """Part names and document titles as identifiers, with how many names each stands for."""
    names = load(spark, d, "part").select(F.col("p_name").alias("n")).unionByName(load(spark, d, "document_headers").select(F.col("doc_title").alias("n"))).where(F.col("n").isNotNull())
    return names.groupBy(C.sanitize_identifier("n").alias("identifier")).agg(F.count(F.lit(1)).alias("n_rows"))


def clean_roles(spark: SparkSession, d: str) -> DataFrame:
    """Roles and descriptions after cleaning."""
    s = load(spark, d, "document_signatories").select(F.col("role_party").alias("v")).unionByName(load(spark, d, "transaction_details").select(F.col("description").alias("v")))
    return s.where(F.col("v").isNotNull()).groupBy(C.clean_cell("v").alias("cleaned")).agg(F.count(F.lit(1)).alias("n_rows"))


def rupiah(spark: SparkSession, d: str) -> DataFrame:
    """Rupiah amounts in sentences, positive and in brackets."""
    v = F.translate(F.format_number("l_extendedprice", 2), ",.", ".,")
    text = F.when(F.col("l_linestatus") == "O", F.concat(F.lit("sebesar Rp. ("), v, F.lit(") per unit"))).otherwise(F.concat(F.lit("sebesar Rp "), v, F.lit(" per unit")))
    return load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linestatus", F.round(C.parse_rupiah(text) * 100).cast("long").alias("cents"))


def periods(spark: SparkSession, d: str) -> DataFrame:
    """The period each document speaks of first."""
    x = load(spark, d, "documents").select(C.extract_period("text").alias("period"))
    return x.where(F.col("period").isNotNull()).groupBy("period").agg(F.count(F.lit(1)).alias("n_documents"))


def native_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Estimated tokens of the distinct chunk items."""
    x = load(spark, d, "chunk_items").select("preview_id", "chunk_id", "content").distinct()
    return x.groupBy("preview_id").agg(F.sum(C.native_tokens("content")).cast("long").alias("tokens"), F.count(F.lit(1)).alias("n_items"))


def column_letters(spark: SparkSession, d: str) -> DataFrame:
    """Part keys as sheet columns and back."""
    k = (F.col("p_partkey") % 16384 + 1).cast("int")
    x = load(spark, d, "part").select(k.alias("idx"), C.column_letter(k).alias("letters"))
    return x.distinct().withColumn("back", C.column_index("letters"))


def ranges(spark: SparkSession, d: str) -> DataFrame:
    """Rectangles in A1 notation made from suppliers, parsed and held against one sheet area."""
    k = F.col("s_suppkey").cast("int")
    ref = F.concat(F.lit("$"), C.column_letter(k % 50 + 1), F.lit("$"), (k % 90 + 1).cast("string"), F.lit(":"), C.column_letter(k % 50 + 4), (k % 90 + 10).cast("string"))
    area = F.struct(F.lit(20).alias("min_row"), F.lit(60).alias("max_row"), F.lit(5).alias("min_col"), F.lit(30).alias("max_col"))
    x = load(spark, d, "supplier").select("s_suppkey", C.range_bounds(ref).alias("b"))
    return x.select("s_suppkey", "b.min_row", "b.max_row", "b.min_col", "b.max_col", C.bounds_overlap(F.col("b"), area).alias("overlaps"), C.range_contains(area, F.col("b")).alias("inside"))


def region_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Scanned regions by the kind of their label and of their content."""
    r = load(spark, d, "ocr_regions")
    return r.groupBy(L.layout_kind(F.col("label")).alias("layout_kind"), L.region_kind(F.col("label"), F.col("text")).alias("content_kind")).agg(F.count(F.lit(1)).alias("n_regions"))


def box_scaling(spark: SparkSession, d: str) -> DataFrame:
    """Model boxes as pixels of a 1200 by 1600 page."""
    r = load(spark, d, "ocr_regions").select("region_id", L.scaled_box(F.col("bbox_model"), F.lit(1200), F.lit(1600)).alias("b")).where(F.col("b").isNotNull()).distinct()
    return r.select("region_id", *[F.col("b")[k].alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))])


def specs(spark: SparkSession, d: str) -> DataFrame:
    """Document styles asked for by spec and source together."""
    asked = F.concat_ws(" + ", F.coalesce("spec", F.lit("")), F.coalesce(F.replace("source", F.lit("_"), F.lit(" ")), F.lit("")))
    return load(spark, d, "documents").groupBy(F.array_join(L.normalize_specs(asked), ",").alias("specs")).agg(F.count(F.lit(1)).alias("n_documents"))


def diagram_types(spark: SparkSession, d: str) -> DataFrame:
    """Names of diagrams made from part names, by type, and which may become code."""
    words = ("Pin layout", "memory", "Work-Flow", "Arsitektur block", "sequence diagram", "skema", "timing", "mindmap", "swimlane", "x", "", "Register pin")
    name = F.concat(F.element_at(F.array(*map(F.lit, words)), (F.col("p_partkey") % 12 + 1).cast("int")), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), "p_name")).otherwise(""))
    a = L.diagram_advice(name)
    return load(spark, d, "part").select("p_partkey", a["diagram_type"].alias("diagram_type"), a["recommended_format"].alias("advised"), a["is_mermaid_compatible"].alias("as_code"))


def preview_progress(spark: SparkSession, d: str) -> DataFrame:
    """How far each chunk item is through its preview."""
    i, p = load(spark, d, "chunk_items").select("preview_id", "chunk_id").distinct(), load(spark, d, "chunking_previews").select("preview_id", "total_chunks")
    x = i.join(p, "preview_id")
    return x.select("preview_id", "chunk_id", L.progress(F.lit("running"), F.col("chunk_id"), F.col("total_chunks")).alias("percent"))


def roman_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Order keys below 4000 as roman numbers and back."""
    n = (F.col("o_orderkey") % 3999 + 1).cast("int")
    x = load(spark, d, "orders").select(n.alias("n")).distinct()
    return x.select("n", O.roman_to_int(O.int_to_roman(F.col("n"))).alias("back"), F.length(O.int_to_roman(F.col("n"))).alias("n_digits"))


def page_split(spark: SparkSession, d: str) -> DataFrame:
    """The pages inside document texts."""
    x = load(spark, d, "documents").select("doc_id", F.posexplode(P.split_pages(F.col("text"))).alias("k", "p"))
    return x.select("doc_id", (F.col("k") + 1).alias("place"), "p.page_number", F.length("p.content").alias("n_chars"))


def page_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of scanned text that hold no page number."""
    x = load(spark, d, "ocr_regions").where(F.col("text").isNotNull()).select("region_id", "text").distinct()
    return x.select("region_id", F.size(F.split("text", "\n")).alias("n_lines"), P.drop_page_lines(F.col("text")).alias("kept"))


def titles(spark: SparkSession, d: str) -> DataFrame:
    """The title of each document that has one."""
    return load(spark, d, "documents").select("doc_id", P.title_of(F.col("text")).alias("title")).where(F.col("title").isNotNull())


def collapsed_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Scanned regions written twice, with the repeat collapsed."""
    x = load(spark, d, "ocr_regions").where(F.col("text").isNotNull() & (F.trim("text") != "")).select("region_id", "text").distinct()
    twice = F.concat("text", F.lit("\n\n"), "text", F.lit("\n\nend\n\n"), "text")
    return x.select("region_id", P.collapse_blocks(twice).alias("text"))


def page_traits(spark: SparkSession, d: str) -> DataFrame:
    """Documents by difficulty, with their visuals and tables."""
    t = F.col("text")
    x = load(spark, d, "documents").where(t.isNotNull())
    return x.groupBy(P.difficulty(t).alias("difficulty"), P.may_skip_review(t).alias("plain")).agg(
        F.count(F.lit(1)).alias("n_documents"), F.sum(P.count_visuals(t)).cast("long").alias("n_visuals"), F.sum(P.count_tables(t)).cast("long").alias("n_tables")
    )


def find_containing(spark: SparkSession, d: str) -> DataFrame:
    """Documents that speak of audits."""
    x = load(spark, d, "documents").where(P.contains_text(F.col("text"), "Audit"))
    return x.groupBy("lang").agg(F.count(F.lit(1)).alias("n_documents"))


def pages_missing(spark: SparkSession, d: str) -> DataFrame:
    """Page numbers up to the last one of which each scanned document has no region."""
    x = load(spark, d, "ocr_regions").where(F.col("source_doc").isNotNull())
    y = P.missing_pages(x, "source_doc", "page_number", F.col("page_number"))
    return y.select("source_doc", "n_saved", F.size("missing").alias("n_missing"))


def stitched(spark: SparkSession, d: str) -> DataFrame:
    """Chunk items joined in order as pages of their preview."""
    x = load(spark, d, "chunk_items").select("preview_id", "chunk_id", "content").distinct()
    s = P.stitch(x, "preview_id", "chunk_id", "content")
    return s.select("preview_id", "text", F.regexp_count("text", F.lit("<!-- PAGE: ")).alias("n_pages"))


def carried_tails(spark: SparkSession, d: str) -> DataFrame:
    """The end of the chunk before, as context of each chunk."""
    x = load(spark, d, "chunk_items").select("preview_id", "chunk_id", "content").distinct()
    y = x.withColumn("tail", P.carried_tail("content", "preview_id", "chunk_id")).where(F.col("tail").isNotNull())
    return y.select("preview_id", "chunk_id", "tail")


QUERIES = {
    "cells_number_locales": number_locales, "cells_number_dirty": number_dirty, "cells_date_dirty": date_dirty, "cells_identifiers": identifiers,
    "cells_clean": clean_roles, "cells_rupiah": rupiah, "cells_periods": periods, "cells_native_tokens": native_tokens, "cells_column_letters": column_letters,
    "cells_ranges": ranges, "labels_region_kinds": region_kinds, "labels_boxes": box_scaling, "labels_specs": specs, "labels_diagrams": diagram_types,
    "labels_progress": preview_progress, "ordinals_roman": roman_numbers, "pages_split": page_split, "pages_lines": page_lines, "pages_titles": titles,
    "pages_collapse": collapsed_blocks, "pages_traits": page_traits, "pages_containing": find_containing, "pages_missing": pages_missing,
    "pages_stitched": stitched, "pages_carried": carried_tails,
}

_WS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_CLEAN = lambda c: f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '{_WS}+', ' ', 'g'), '^ +| +$', '', 'g'), '^[*_]+|[*_]+$', '', 'g'), '^ +| +$', '', 'g'), '', '')"
_MON = C.PERIOD_MONTHS
_ALIASES = ", ".join(f"('{a}', '{s}')" for s, names in L.SPEC_ALIASES.items() for a in names)
_MARK = r"(?i)<!--\s*(?:PAGE|SLIDE)\s*:?\s*(\d+)\s*-->"
_TRIM = lambda c: f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"

ORACLE = {
    "cells_number_locales": """
        SELECT shape, count(*) AS n_rows, 0 AS n_null, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * sgn) AS BIGINT) AS total_cents
        FROM lineitem, (VALUES ('us', 1), ('id', 1), ('bracket', -1), ('minus', -1)) s(shape, sgn) GROUP BY shape""",
    "cells_number_dirty": """
        WITH d AS (SELECT detail_id, trim(ref_no) AS r, regexp_replace(ref_no, '[^0-9.,]', '', 'g') AS g FROM transaction_details WHERE ref_no IS NOT NULL),
        p AS (SELECT detail_id, r, CASE WHEN NOT regexp_matches(g, '[.,]') THEN g
            WHEN regexp_matches(g, '[.]') AND regexp_matches(g, ',') THEN NULL
            WHEN regexp_matches(g, '[0-9].*[.,][^.,]{3}$') THEN regexp_replace(g, '[.,]', '', 'g')
            ELSE regexp_replace(g, '^(.*)[.,]([^.,]*)$', '\\1.\\2') END AS n FROM d)
        SELECT detail_id, CASE WHEN r LIKE '-%' THEN -CAST(n AS DOUBLE) ELSE CAST(n AS DOUBLE) END AS value FROM p WHERE regexp_full_match(n, '[0-9]+([.][0-9]+)?')""",
    "cells_date_dirty": f"""
        WITH v AS (SELECT 'txn_date' AS field, txn_date AS v FROM transaction_details UNION ALL SELECT 'value_date', value_date FROM transaction_details
            UNION ALL SELECT 'date', "date" FROM document_signatories UNION ALL SELECT 'doc_date', doc_date FROM document_headers),
        c AS (SELECT field, v, {_CLEAN('v')} AS x FROM v),
        p AS (SELECT field, v, CASE
            WHEN regexp_full_match(x, '(19|20)\\d{{2}}(0[1-9]|1[0-2])(0[1-9]|[12]\\d|3[01])') THEN x[1:4] || '-' || x[5:6] || '-' || x[7:8]
            WHEN regexp_full_match(x, '(19|20)\\d{{2}}-(0[1-9]|1[0-2])-(0[1-9]|[12]\\d|3[01])') THEN x
            WHEN regexp_full_match(x, '(0?[1-9]|[12]\\d|3[01])[./-](0?[1-9]|1[0-2])[./-]((19|20)?\\d{{2}})') THEN
                right('20' || regexp_extract(x, '(\\d+)$', 1), 4) || '-' || lpad(regexp_extract(x, '^\\d+[./-](\\d+)', 1), 2, '0') || '-' || lpad(regexp_extract(x, '^(\\d+)', 1), 2, '0')
            END AS p FROM c)
        SELECT field, count(v) AS n_values, count(p) AS n_dates, min(p) AS first_date, max(p) AS last_date, count(DISTINCT p) AS n_days FROM p GROUP BY field""".replace("\\\\", "\\"),
    "cells_identifiers": """
        WITH n AS (SELECT p_name AS n FROM part UNION ALL SELECT doc_title FROM document_headers),
        i AS (SELECT regexp_replace(trim(regexp_replace(regexp_replace(lower(trim(n)), '[^a-z0-9_]', '_', 'g'), '_+', '_', 'g'), '_'), '^$', '') AS i FROM n WHERE n IS NOT NULL)
        SELECT CASE WHEN i = '' OR regexp_matches(i, '^[0-9]') THEN 'col_' || i ELSE i END AS identifier, count(*) AS n_rows FROM i GROUP BY 1""",
    "cells_clean": f"""
        WITH v AS (SELECT role_party AS v FROM document_signatories UNION ALL SELECT description FROM transaction_details)
        SELECT {_CLEAN('v')} AS cleaned, count(*) AS n_rows FROM v WHERE v IS NOT NULL GROUP BY 1""",
    "cells_rupiah": """
        SELECT l_orderkey, l_partkey, l_linestatus, CAST(round(l_extendedprice * 100) AS BIGINT) * CASE WHEN l_linestatus = 'O' THEN -1 ELSE 1 END AS cents FROM lineitem""",
    "cells_periods": f"""
        WITH p AS (SELECT coalesce(nullif(regexp_extract(text, '(?i)\\b((?:{_MON})\\s+20\\d{{2}})\\b', 1), ''), nullif(regexp_extract(text, '(?i)\\b(\\d{{1,2}}\\s+(?:{_MON})\\s+20\\d{{2}})\\b', 1), ''),
            nullif(regexp_extract(text, '\\b((?:0?[1-9]|1[0-2])[/\\-]20\\d{{2}})\\b', 1), ''), nullif(regexp_extract(text, '\\b(20\\d{{2}}[/\\-](?:0?[1-9]|1[0-2]))\\b', 1), '')) AS period FROM documents)
        SELECT period, count(*) AS n_documents FROM p WHERE period IS NOT NULL GROUP BY period""".replace("\\\\", "\\"),
    "cells_native_tokens": """
        WITH x AS (SELECT DISTINCT preview_id, chunk_id, content FROM chunk_items)
        SELECT preview_id, CAST(sum(ceil(octet_length(encode(content)) / 3.0)) AS BIGINT) AS tokens, count(*) AS n_items FROM x GROUP BY preview_id""",
    "cells_column_letters": """
        WITH x AS (SELECT DISTINCT CAST(p_partkey % 16384 + 1 AS INTEGER) AS idx FROM part)
        SELECT idx, CASE WHEN idx > 702 THEN chr(CAST(65 + (idx - 703) // 676 AS INTEGER)) ELSE '' END || CASE WHEN idx > 26 THEN chr(CAST(65 + ((idx - 27) // 26) % 26 AS INTEGER)) ELSE '' END || chr(CAST(65 + (idx - 1) % 26 AS INTEGER)) AS letters, idx AS back FROM x""",
    "cells_ranges": """
        WITH b AS (SELECT s_suppkey, CAST(s_suppkey % 90 + 1 AS INTEGER) AS min_row, CAST(s_suppkey % 90 + 10 AS INTEGER) AS max_row, CAST(s_suppkey % 50 + 1 AS INTEGER) AS min_col, CAST(s_suppkey % 50 + 4 AS INTEGER) AS max_col FROM supplier)
        SELECT *, max_row >= 20 AND min_row <= 60 AND max_col >= 5 AND min_col <= 30 AS overlaps, min_row >= 20 AND max_row <= 60 AND min_col >= 5 AND max_col <= 30 AS inside FROM b""",
    "labels_region_kinds": """
        SELECT CASE label WHEN 'paragraph_title' THEN 'section' WHEN 'title' THEN 'title' WHEN 'doc_title' THEN 'title' ELSE label END AS layout_kind,
            CASE WHEN length(coalesce(text, '')) - length(replace(coalesce(text, ''), '|', '')) >= 4 OR contains(lower(coalesce(text, '')), '<table') OR contains(lower(coalesce(text, '')), '</table>') THEN 'table'
                WHEN contains(lower(label), 'text') OR contains(lower(label), 'title') THEN 'text' ELSE 'unknown' END AS content_kind, count(*) AS n_regions
        FROM ocr_regions GROUP BY ALL""",
    "labels_boxes": """
        WITH b AS (SELECT DISTINCT region_id, least(greatest(CAST(round_even(bbox_model[1] / 1024.0 * 1200, 0) AS INTEGER), 0), 1200) AS x1, least(greatest(CAST(round_even(bbox_model[2] / 1024.0 * 1600, 0) AS INTEGER), 0), 1600) AS y1,
            least(greatest(CAST(round_even(bbox_model[3] / 1024.0 * 1200, 0) AS INTEGER), 0), 1200) AS x2, least(greatest(CAST(round_even(bbox_model[4] / 1024.0 * 1600, 0) AS INTEGER), 0), 1600) AS y2 FROM ocr_regions)
        SELECT * FROM b WHERE x2 > x1 AND y2 > y1""",
    "labels_specs": f"""
        WITH a(alias, spec) AS (VALUES {_ALIASES}),
        q AS (SELECT doc_id, lower(trim(coalesce(spec, '') || ' + ' || coalesce(replace(source, '_', ' '), ''))) AS t FROM documents),
        tok AS (SELECT doc_id, trim(regexp_replace(t, '[^a-z0-9_]+', '_', 'g'), '_') AS k, 0 AS n FROM q
            UNION ALL SELECT doc_id, trim(regexp_replace(w, '[^a-z0-9_]+', '_', 'g'), '_'), n FROM (SELECT doc_id, unnest(s) AS w, generate_subscripts(s, 1) AS n FROM (SELECT doc_id, regexp_split_to_array(t, '[,;|+/\\s]+') AS s FROM q))),
        hit AS (SELECT doc_id, a.spec, min(n) AS n FROM tok JOIN a ON a.alias = k GROUP BY ALL),
        g AS (SELECT doc_id, string_agg(spec, ',' ORDER BY n) AS s FROM hit GROUP BY doc_id)
        SELECT coalesce(s, 'plain') AS specs, count(*) AS n_documents FROM q LEFT JOIN g USING (doc_id) GROUP BY 1""".replace("\\\\", "\\"),
    "labels_diagrams": """
        WITH n AS (SELECT p_partkey, ['Pin layout', 'memory', 'Work-Flow', 'Arsitektur block', 'sequence diagram', 'skema', 'timing', 'mindmap', 'swimlane', 'x', '', 'Register pin'][CAST(p_partkey % 12 + 1 AS INTEGER)] || CASE WHEN p_partkey % 2 = 0 THEN ' ' || p_name ELSE '' END AS n FROM part),
        p AS (SELECT p_partkey, replace(replace(lower(trim(n)), '-', '_'), ' ', '_') AS y FROM n),
        t AS (SELECT p_partkey, CASE WHEN regexp_matches(y, 'flowchart|workflow|swimlane|decision_tree|alur_proses') THEN 'flowchart' ELSE y END AS x FROM p),
        d AS (SELECT p_partkey, CASE WHEN x = '' THEN 'generic_diagram' WHEN x IN ('flowchart', 'sequence_diagram', 'mindmap') THEN x WHEN contains(x, 'pin') THEN 'pin_diagram' WHEN regexp_matches(x, 'memory|register|map') THEN 'memory_map' WHEN contains(x, 'flow') THEN 'flowchart'
            WHEN regexp_matches(x, 'block|arch') THEN 'block_architecture' WHEN contains(x, 'seq') THEN 'sequence_diagram' WHEN regexp_matches(x, 'circuit|skema') THEN 'circuit_diagram' WHEN regexp_matches(x, 'time|timing') THEN 'timing_diagram' ELSE 'generic_diagram' END AS diagram_type FROM t)
        SELECT p_partkey, diagram_type, CASE WHEN diagram_type = 'flowchart' THEN 'mermaid_code' ELSE 'text_description' END AS advised, diagram_type = 'flowchart' AS as_code FROM d""",
    "labels_progress": """
        SELECT preview_id, chunk_id, CASE WHEN total_chunks > 0 AND chunk_id > 0 THEN least(98.0, greatest(1.0, round_even(chunk_id / total_chunks * 100.0, 1))) ELSE 5.0 END AS percent
        FROM (SELECT DISTINCT preview_id, chunk_id FROM chunk_items) JOIN chunking_previews USING (preview_id)""",
    "ordinals_roman": """
        WITH x AS (SELECT DISTINCT CAST(o_orderkey % 3999 + 1 AS INTEGER) AS n FROM orders),
        len(dg, k) AS (VALUES (0, 0), (1, 1), (2, 2), (3, 3), (4, 2), (5, 1), (6, 2), (7, 3), (8, 4), (9, 2))
        SELECT n, n AS back, CAST(n // 1000 + a.k + b.k + c.k AS INTEGER) AS n_digits FROM x JOIN len a ON a.dg = n // 100 % 10 JOIN len b ON b.dg = n // 10 % 10 JOIN len c ON c.dg = n % 10""",
    "pages_split": f"""
        WITH p AS (SELECT doc_id, text, regexp_split_to_array(text, '{_MARK.replace('(', '(', 1)}') AS parts, regexp_extract_all(text, '{_MARK}', 1) AS nums FROM documents WHERE text IS NOT NULL AND {_TRIM('text')} <> ''),
        u AS (SELECT doc_id, unnest(nums) AS num, unnest(parts[2:len(nums) + 1]) AS c, generate_subscripts(nums, 1) AS place FROM p WHERE len(nums) > 0)
        SELECT doc_id, CAST(place AS INTEGER) AS place, CAST(num AS INTEGER) AS page_number, CAST(length({_TRIM('c')}) AS INTEGER) AS n_chars FROM u
        UNION ALL SELECT doc_id, 1, 1, CAST(length({_TRIM('text')}) AS INTEGER) FROM p WHERE len(nums) = 0""",
    "pages_lines": r"""
        WITH x AS (SELECT DISTINCT region_id, text FROM ocr_regions WHERE text IS NOT NULL),
        l AS (SELECT region_id, string_split(text, chr(10)) AS l FROM x)
        SELECT region_id, CAST(len(l) AS INTEGER) AS n_lines, coalesce(array_to_string(list_filter(l, lambda s: NOT regexp_full_match(trim(s), '(?i)(halaman|page|-)?\s*\d+\s*(dari|of|/)?\s*\d*\s*(-)?')), chr(10)), '') AS kept FROM l""",
    "pages_titles": r"""
        WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(trim(regexp_replace(text, '(?i)<!--\s*(?:PAGE|SLIDE)\s*:?\s*(\d+)\s*-->', '', 'g')), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL),
        t AS (SELECT doc_id, coalesce(
            list_filter(list_transform(list_filter(l, lambda x: starts_with(x, '# ')), lambda x: trim(x[3:])), lambda x: x <> '' AND lower(x) NOT IN ('document', 'dokumen', 'page 1', 'halaman 1', 'slide 1', 'overview', 'ringkasan', 'pendahuluan', 'untitled', 'table of contents', 'daftar isi'))[1],
            list_filter(list_transform(list_filter(l, lambda x: starts_with(x, '## ')), lambda x: trim(x[4:])), lambda x: x <> '' AND lower(x) NOT IN ('document', 'dokumen', 'page 1', 'halaman 1', 'slide 1', 'overview', 'ringkasan', 'pendahuluan', 'untitled', 'table of contents', 'daftar isi'))[1],
            list_filter(list_transform(l[1:5], lambda x: trim(regexp_extract(x, '^\*\*(.+?)\*\*$', 1))), lambda x: length(x) > 3)[1]) AS title FROM l)
        SELECT doc_id, title FROM t WHERE title IS NOT NULL""",
    "pages_collapse": r"""
        WITH x AS (SELECT DISTINCT region_id, text FROM ocr_regions WHERE text IS NOT NULL AND trim(text) <> '')
        SELECT region_id, regexp_replace(text, '^' || ws || '+', '') || chr(10) || chr(10) || 'end' || chr(10) || chr(10) || regexp_replace(text, ws || '+$', '') AS text FROM x, (SELECT '[' || chr(160) || chr(8201) || chr(12288) || '\s]' AS ws)""",
    "pages_traits": r"""
        WITH x AS (SELECT text, regexp_matches(text, '\[Diagram/Visual\]|\[Gambar/Visual\]|\[Topologi\]|\[Diagram/Topologi\]|```mermaid') OR regexp_matches(text, '(?i)\b(?:FIGURE|Bagan|Skema)\s+\d+') AS dia,
            contains(text, '|---') AS tab, length(text) - length(replace(text, '|', '')) AS pipes FROM documents WHERE text IS NOT NULL),
        y AS (SELECT *, CASE WHEN dia THEN 'complex' WHEN tab OR pipes > 8 OR length(text) > 2000 THEN 'standard' ELSE 'simple' END AS difficulty FROM x)
        SELECT difficulty, difficulty = 'simple' AND length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 20 AND NOT contains(text, '[tidak terbaca]') AS plain, count(*) AS n_documents,
            CAST(sum(len(regexp_extract_all(text, '\[Diagram/Visual\]|\[Gambar/Visual\]|\[Topologi\]|\[Diagram/Topologi\]|```mermaid'))) AS BIGINT) AS n_visuals,
            CAST(sum(len(list_filter(string_split(text, chr(10)), lambda s: regexp_full_match(s, '\s*\|?[\s:|-]*-{3,}[\s:|-]*\|?\s*')))) AS BIGINT) AS n_tables FROM y GROUP BY ALL""",
    "pages_containing": "SELECT lang, count(*) AS n_documents FROM documents WHERE contains(lower(text), 'audit') GROUP BY lang",
    "pages_missing": """
        WITH x AS (SELECT source_doc, count(DISTINCT page_number) AS n, max(page_number) AS hi FROM ocr_regions WHERE source_doc IS NOT NULL GROUP BY source_doc)
        SELECT source_doc, CAST(n AS INTEGER) AS n_saved, CAST(hi - n AS INTEGER) AS n_missing FROM x""",
    "pages_stitched": rf"""
        WITH x AS (SELECT DISTINCT preview_id, chunk_id, content FROM chunk_items),
        c AS (SELECT preview_id, row_number() OVER (PARTITION BY preview_id ORDER BY chunk_id) AS i, {_TRIM(r"array_to_string(list_filter(string_split(content, chr(10)), lambda s: NOT regexp_full_match(trim(s), '(?i)(halaman|page|-)?\s*\d+\s*(dari|of|/)?\s*\d*\s*(-)?')), chr(10))")} AS t FROM x),
        k AS (SELECT preview_id, count(*) AS n, string_agg('<!-- PAGE: ' || i || ' -->' || chr(10) || chr(10) || t, chr(10) || chr(10) ORDER BY i) || chr(10) AS text FROM c WHERE t <> '' GROUP BY preview_id)
        SELECT preview_id, text, CAST(n AS INTEGER) AS n_pages FROM k""",
    "pages_carried": """
        WITH x AS (SELECT DISTINCT preview_id, chunk_id, content FROM chunk_items), y AS (SELECT preview_id, chunk_id, lag(right(content, 400)) OVER (PARTITION BY preview_id ORDER BY chunk_id) AS tail FROM x)
        SELECT * FROM y WHERE tail IS NOT NULL""",
}
