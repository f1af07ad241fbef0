"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.copies import collapse_copies, copy_links
from paperloom.llm.leakage import leaks
from paperloom.llm.leakage import report as leak_report
from paperloom.llm.mixture import Mixture
from paperloom.llm.pieces import DEFAULT_OVERLAP, DEFAULT_SIZE, split_files, split_items
from paperloom.llm.scans import decoded, repaired
from paperloom.llm.subjects import assigned, subjects_of, train
from paperloom.operators.skew import salted_join
from paperloom.session import cut, drop_folder, load, shared_folder


FILE_PIECE, FILE_OVERLAP, FILE_RANGE = 2000, 100, 1 << 20
COPY_KEYS = ["header_id", "txn_date", "value_date", "debit", "credit", "balance"]


def _scans(spark: SparkSession, d: str) -> DataFrame:
    return decoded(load(spark, d, "ocr_regions"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines that are page furniture, end in a cut word, or hold a misread word."""
    return _scans(spark, d).where("kind != 'body'").select("region_id", "line_no", "kind").distinct()


def p1_text(spark: SparkSession, d: str) -> DataFrame:
    """The repaired paragraphs of each region."""
    return repaired(_scans(spark, d))


def p1_gold(spark: SparkSession, d: str) -> DataFrame:
    """Repaired regions of which the right repair is known: how many, their words, and whether at least 99 in 100 words come out right in their place."""
    words = lambda c: F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")
    gold = load(spark, d, "ocr_gold").select("region_id", words("clean_text").alias("gold")).distinct()
    both = gold.join(repaired(_scans(spark, d)).select("region_id", words("clean_text").alias("mine")), "region_id", "left")
    same = F.size(F.filter(F.zip_with("gold", F.coalesce("mine", F.array()), lambda a, b: a == b), lambda x: x))
    return both.agg(F.count(F.lit(1)).alias("n_regions"), F.sum(F.size("gold")).alias("n_words"), (F.sum(same) >= 0.99 * F.sum(F.size("gold"))).alias("accurate"))


def _sized_items(spark: SparkSession, d: str) -> DataFrame:
    """Chunk items with the limits of their preview; an item without a preview gets the defaults."""
    items = load(spark, d, "chunk_items").select("preview_id", "chunk_id", "content")
    counts = items.where(F.col("preview_id").isNotNull()).groupBy("preview_id").agg(F.count(F.lit(1)).alias("n_rows"))
    previews = load(spark, d, "chunking_previews").select("preview_id", "chunk_size", "chunk_overlap")
    limits = cut(counts.join(previews, "preview_id", "left"))
    return salted_join(items, limits, ["preview_id"], F.col("chunk_id"), how="left")


def _pieces(spark: SparkSession, d: str, with_text: bool) -> DataFrame:
    return split_items(_sized_items(spark, d), ["preview_id", "chunk_id"], "content", "chunk_size", "chunk_overlap", with_text)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Items that had to be cut."""
    return _pieces(spark, d, False).where("n_pieces > 1").select("preview_id", "chunk_id").distinct()


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of all items that had to be cut."""
    return _pieces(spark, d, True).where("n_pieces > 1")


def p3_files(spark: SparkSession, d: str) -> DataFrame:
    """The documents of each source written as text files, cut by byte ranges: characters covered, and whether pieces keep the limits and join up."""
    folder = f"{shared_folder(spark)}/paperloom-files-{uuid.uuid4().hex}"
    key = F.coalesce(F.lower(F.trim("source")), F.lit("none"))
    load(spark, d, "documents").select(key.alias("source"), F.coalesce("text", F.lit("")).alias("text")).write.partitionBy("source").text(folder)
    try:
        pieces = split_files(spark, folder, FILE_PIECE, FILE_OVERLAP, "*.txt", FILE_RANGE)
        source, length = F.regexp_extract("path", "source=([^/]*)", 1), F.col("end_char") - F.col("start_char")
        fresh = length - F.when(F.col("piece_no") > 1, FILE_OVERLAP).otherwise(0)
        held = (length == F.length("piece")) & (length <= FILE_PIECE) & (F.col("piece_no") <= F.col("n_pieces"))
        return cut(pieces.groupBy(source.alias("source")).agg(F.sum(fresh).alias("n_chars"), F.min(held.cast("int")).alias("kept")))
    finally:
        drop_folder(spark, folder)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Copies of bookings, each with the smallest id of its set."""
    return copy_links(load(spark, d, "transaction_details"), "detail_id", COPY_KEYS, "description", "ref_no")


def p5_bookings(spark: SparkSession, d: str) -> DataFrame:
    """One row per booking with its number of copies."""
    details = load(spark, d, "transaction_details")
    links = copy_links(details, "detail_id", COPY_KEYS, "description", "ref_no")
    return collapse_copies(details.select("detail_id", *COPY_KEYS, "description", "ref_no"), links, "detail_id").select(
        "detail_id", "header_id", "description", "ref_no", "n_copies"
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the test items of which they hold at least twelve consecutive words."""
    return leaks(load(spark, d, "documents"), load(spark, d, "eval_items")).select("doc_id", "item_id")


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """Which test items leaked, into how many documents."""
    return p6_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the test items that they hold, word by word or reworded."""
    return leak_report(load(spark, d, "documents"), load(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that cannot reach their share within their repeats."""
    mix = Mixture(load(spark, d, "documents"), load(spark, d, "mix_targets"))
    return mix.report().where("falls_short").select("source")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """The shares the mix really reaches."""
    return Mixture(load(spark, d, "documents"), load(spark, d, "mix_targets")).report()


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mix: which tokens of which documents stand in which slot of which shard."""
    return Mixture(load(spark, d, "documents"), load(spark, d, "mix_targets")).contents()


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    docs, names = load(spark, d, "documents"), subjects_of(load(spark, d, "subject_areas"))
    return assigned(docs, train(docs, load(spark, d, "subject_labels"), names), names)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Subjects that a document treats in three or more sentences."""
    return _subjects(spark, d).select("doc_id", "subject").distinct()


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents and treating sentences per subject."""
    return _subjects(spark, d).groupBy("subject").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_sentences").alias("n_sentences"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """The subject that most sentences of each test passage treat; the passages take no part in fitting."""
    docs, names = load(spark, d, "documents"), subjects_of(load(spark, d, "subject_areas"))
    items = load(spark, d, "eval_items").select(F.col("item_id").alias("doc_id"), "text")
    found = assigned(items, train(docs, load(spark, d, "subject_labels"), names), names, min_sentences=1)
    return found.groupBy(F.col("doc_id").alias("item_id")).agg(F.max_by("subject", F.struct("n_sentences", "subject")).alias("subject"))


QUERIES = {
    "p1_found": p1_found, "p1_text": p1_text, "p1_gold": p1_gold,
    "p3_found": p3_found, "p3_pieces": p3_pieces, "p3_files": p3_files, "p5_found": p5_found, "p5_bookings": p5_bookings, "p6_found": p6_found, "p6_items": p6_items, "p6_report": p6_report, "p7_found": p7_found, "p7_report": p7_report, "p7_mix": p7_mix,
    "p8_found": p8_found, "p8_composition": p8_composition, "p8_items": p8_items,
}

_LEAK_SQL = r"""
    WITH every AS (SELECT doc_id AS id, text, 'd' AS side FROM documents UNION ALL SELECT item_id, text, 'i' FROM eval_items),
    worded AS (SELECT id, side, regexp_extract_all(regexp_replace(regexp_replace(lower(text), '<!--(?:.|\n)*?-->', ' ', 'g'), '([\pL\pN])[-\x{ad}\x{2010}\x{2011}\x{ac}][ \t]*\r?\n\s*([\pL\pN])', '\1\2', 'g'), '[\pL\pN]+') AS w FROM every WHERE text IS NOT NULL),
    grams AS (SELECT id, side, unnest(list_transform(generate_series(1, len(w) - 11), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM worded WHERE len(w) >= 12),
    found AS (SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM grams d JOIN grams i ON d.g = i.g AND d.side = 'd' AND i.side = 'i')
"""
# The words of a description in order of the alphabet: what does not change with the order of segments.
_COPY_SQL = r"""
    WITH canon AS (
        SELECT detail_id, header_id, txn_date, value_date, debit, credit, balance, description, ref_no,
            list_sort(regexp_extract_all(lower(regexp_replace(description, '[^\pL\pN\s\pZ/|:;,·–-]', '', 'g')), '\pL+|\pN+')) AS words,
            lower(regexp_replace(ref_no, '[^\pL\pN]', '', 'g')) AS ref
        FROM transaction_details
    ), sets AS (
        SELECT *, min(detail_id) OVER w AS first_id, count(*) OVER w AS n_copies FROM canon
        WINDOW w AS (PARTITION BY header_id, txn_date, value_date, debit, credit, balance, words, ref)
    )
"""
_SPACE = r"\s\pZ\x{0b}\x{1c}-\x{1f}\x{85}"
_LAST_BOUNDARY = ", ".join(
    f"length(regexp_extract(w, '(?s)^(.*{kind})', 1))"
    for kind in (rf"\n[ \t\r]*\n[{_SPACE}]*)([^{_SPACE}]", "\\n)(.", rf"[.!?…。][)\]\x22''”’]*[{_SPACE}]+)([^{_SPACE}]", rf"[,;:][{_SPACE}]+)([^{_SPACE}]", rf"[{_SPACE}])([^{_SPACE}]")
)
# Piece after piece of every item: the last boundary of the strongest kind in the second half of what fits, then of any, then before what belongs to no earlier character.
_PIECE_SQL = rf"""
    WITH RECURSIVE sized AS (
        SELECT DISTINCT i.preview_id, i.chunk_id, i.content AS c, greatest(coalesce(p.chunk_size, {DEFAULT_SIZE}), 1) AS size, least(greatest(coalesce(p.chunk_overlap, {DEFAULT_OVERLAP}), 0), size - 1) AS lap
        FROM chunk_items i LEFT JOIN chunking_previews p USING (preview_id) WHERE length(i.content) > greatest(coalesce(p.chunk_size, {DEFAULT_SIZE}), 1)
    ), walk AS (
        SELECT *, CAST(0 AS BIGINT) AS no, CAST(NULL AS BIGINT) AS s, CAST(lap AS BIGINT) AS e FROM sized
        UNION ALL
        SELECT preview_id, chunk_id, c, size, lap, no + 1, s2, CASE WHEN length(c) - s2 <= size THEN length(c) ELSE s2 + coalesce(
            list_filter(ends, lambda x: x >= greatest(lap + 1, size // 2))[1], list_filter(ends, lambda x: x >= lap + 1)[1], CASE WHEN hard >= lap + 1 THEN hard END, size) END
        FROM (SELECT *, [{_LAST_BOUNDARY}] AS ends, length(regexp_extract(w, '(?s)^(.*)[^\p{{Mn}}\x{{200d}}\x{{fe0e}}\x{{fe0f}}\x{{20e3}}\x{{1f3fb}}-\x{{1f3ff}}]', 1)) AS hard
            FROM (SELECT *, e - lap AS s2, substring(c, e - lap + 1, size + 1) AS w FROM walk WHERE no = 0 OR e < length(c)))
    )
    SELECT preview_id, chunk_id, no AS piece_no, max(no) OVER (PARTITION BY preview_id, chunk_id) AS n_pieces, s AS start_char, e AS end_char, substring(c, s + 1, e - s) AS piece FROM walk WHERE no > 0
"""
ORACLE = {
    "p1_gold": "SELECT count(*) AS n_regions, CAST(sum(len(string_split(trim(regexp_replace(clean_text, '\\s+', ' ', 'g')), ' '))) AS BIGINT) AS n_words, true AS accurate FROM (SELECT DISTINCT region_id, clean_text FROM ocr_gold)",
    "p8_items": "SELECT item_id, lower(trim(subject)) AS subject FROM eval_items",
    "p3_pieces": _PIECE_SQL,
    "p3_files": "SELECT coalesce(lower(trim(source)), 'none') AS source, sum(length(coalesce(text, '')) + 1) AS n_chars, 1 AS kept FROM documents GROUP BY 1",
    "p5_found": _COPY_SQL + "SELECT first_id, detail_id AS copy_id FROM sets WHERE detail_id > first_id",
    "p5_bookings": _COPY_SQL + "SELECT detail_id, header_id, description, ref_no, n_copies FROM sets WHERE detail_id = first_id",
    "p6_found": _LEAK_SQL + "SELECT doc_id, item_id FROM found",
    "p6_items": _LEAK_SQL + "SELECT item_id, count(*) AS n_documents FROM found GROUP BY item_id",
    "p3_found": f"""
        SELECT DISTINCT i.preview_id, i.chunk_id FROM chunk_items i LEFT JOIN chunking_previews p USING (preview_id)
        WHERE length(i.content) > coalesce(p.chunk_size, {DEFAULT_SIZE})""",
    "p7_found": """
        WITH sized AS (SELECT lower(trim(source)) AS source, sum(n_chars) AS n FROM documents GROUP BY 1)
        SELECT t.source FROM mix_targets t LEFT JOIN sized s ON s.source = lower(trim(t.source))
        WHERE coalesce(s.n, 0) * t.max_repeats < t.target_share * (SELECT sum(n) FROM sized)""",
}
