"""Queries of the general training-data problems: orphans and timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.instants import normalised
from paperloom.operators.orphans import existence_deltas, fold_deltas, instant, orphan_report, orphan_rows, orphans_of, reference_deltas
from paperloom.session import load


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    refs = {
        "transaction_details": (load(spark, d, "transaction_details"), "detail_id"),
        "document_signatories": (load(spark, d, "document_signatories"), "signatory_id"),
    }
    return orphan_rows(refs, load(spark, d, "document_headers"), load(spark, d, "header_deletions"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose header is missing, deleted or stored only after them."""
    return _orphans(spark, d).select("tab", "ingest_month", "rec_id")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan rows and distinct missing headers per table, month and reason."""
    return orphan_report(_orphans(spark, d))


def p2_state(spark: SparkSession, d: str) -> DataFrame:
    """Orphan keys after two batches of changes folded one into the other: what happened before a moment, and after it."""
    moment = F.lit("2024-07-01T00:00:00Z").cast("timestamp")
    details, signatories = load(spark, d, "transaction_details"), load(spark, d, "document_signatories")
    rows = details.select("header_id", "_ingested_at").unionByName(signatories.select("header_id", "_ingested_at")).select(F.col("header_id").alias("key"), instant(F.col("_ingested_at")).alias("at"))
    headers, deletions = load(spark, d, "document_headers"), load(spark, d, "header_deletions")
    early = lambda c: F.coalesce(c < moment, F.lit(False))
    made, undone = early(instant(F.col("created_at"))), F.when(early(F.col("restored_at")), F.col("restored_at"))
    first = fold_deltas(
        reference_deltas(rows.where(early(F.col("at")))),
        existence_deltas(headers.where(made), deletions.where(early(F.col("deleted_at"))).withColumn("restored_at", undone)),
    )
    changed = deletions.where(~early(F.col("deleted_at")) | ~early(F.coalesce("restored_at", F.col("deleted_at"))))
    later = existence_deltas(headers.where(~made), changed)
    return orphans_of(fold_deltas(first, reference_deltas(rows.where(~early(F.col("at")))), later))


def _normal_dates(spark: SparkSession, d: str) -> DataFrame:
    details = normalised(load(spark, d, "transaction_details"), "transaction_details", "detail_id", ["txn_date", "value_date"], "zona")
    headers = normalised(load(spark, d, "document_headers"), "document_headers", "header_id", ["doc_date"])
    return details.unionByName(headers)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Values that denote a date or an instant and are not already written YYYY-MM-DD."""
    cases = _normal_dates(spark, d).where(F.col("norm_value").isNotNull() & (F.col("norm_value") != F.col("raw")))
    once = cases.where(F.col("tab") == "transaction_details").select("tab", "rec_id", "field", "norm_value")
    again = cases.where(F.col("tab") != "transaction_details").select("tab", "rec_id", "field", "norm_value").distinct()
    return once.unionByName(again)


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """How many values of each field are dates, instants or neither, and how many were already normal."""
    n = F.col("norm_value")
    kind = F.when(n.isNull(), "neither").when(F.length(n) == 10, "date").otherwise("instant")
    return _normal_dates(spark, d).groupBy("tab", "field", kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("n_values"), F.count_if(F.coalesce(n == F.col("raw"), F.lit(False))).alias("n_already")
    )


QUERIES = {"p2_found": p2_found, "p2_report": p2_report, "p2_state": p2_state, "p4_found": p4_found, "p4_report": p4_report}

_ORPHAN_SQL = """
    WITH refs AS (
        SELECT 'transaction_details' AS tab, detail_id AS rec_id, header_id, CAST(_ingested_at AS TIMESTAMPTZ) AS at FROM transaction_details
        UNION ALL
        SELECT 'document_signatories', signatory_id, header_id, CAST(_ingested_at AS TIMESTAMPTZ) FROM document_signatories
    ), born AS (
        SELECT header_id, min(CAST(created_at AS TIMESTAMPTZ)) AS created FROM document_headers GROUP BY header_id
    ), dead AS (
        SELECT header_id FROM header_deletions GROUP BY header_id
        HAVING arg_max(restored_at IS NULL, deleted_at)
    ), found AS (
        SELECT r.tab, strftime(r.at AT TIME ZONE 'UTC', '%Y-%m') AS ingest_month, r.rec_id, r.header_id,
            CASE WHEN b.header_id IS NULL THEN 'missing' WHEN d.header_id IS NOT NULL THEN 'deleted' WHEN b.created > r.at THEN 'later' END AS reason
        FROM refs r LEFT JOIN born b ON r.header_id = b.header_id LEFT JOIN dead d ON r.header_id = d.header_id
        WHERE r.header_id IS NOT NULL
    )
"""
_MONTH_NAMES = (
    ("januari|january", "Jan"), ("februari|pebruari|february", "Feb"), ("maret|march|mar", "Mar"), ("april", "Apr"), ("mei|may", "May"), ("juni|june", "Jun"), ("juli|july", "Jul"),
    ("agustus|august|agt|ags|agu", "Aug"), ("september|sept", "Sep"), ("oktober|october|okt", "Oct"), ("nopember|november|nop", "Nov"), ("desember|december|des", "Dec"),
)


def _english(column: str) -> str:
    for names, short in _MONTH_NAMES:
        column = f"regexp_replace({column}, '(?i)\\b({names})\\b', '{short}')"
    return column


_DATE_SQL = rf"""
    WITH raw AS (
        SELECT 'transaction_details' AS tab, detail_id AS rec_id, 'txn_date' AS field, txn_date AS v, zona FROM transaction_details
        UNION ALL SELECT 'transaction_details', detail_id, 'value_date', value_date, zona FROM transaction_details
        UNION ALL SELECT 'document_headers', header_id, 'doc_date', doc_date, NULL FROM document_headers
    ), named AS (
        SELECT DISTINCT tab, rec_id, field, v, regexp_replace(v, '^\s+|\s+$', '', 'g') AS x, coalesce(
            CASE upper(trim(zona)) WHEN 'WIB' THEN 'Asia/Jakarta' WHEN 'WITA' THEN 'Asia/Makassar' WHEN 'WIT' THEN 'Asia/Jayapura' WHEN 'UTC' THEN 'UTC' END, CASE WHEN contains(zona, '/') THEN trim(zona) END, 'Asia/Jakarta') AS zone
        FROM raw WHERE v IS NOT NULL
    ), plain AS (
        SELECT *, {_english(r"regexp_replace(regexp_replace(x, '(?i)^(?:senin|selasa|rabu|kamis|jumat|sabtu|minggu|mon|tue|wed|thu|fri|sat|sun)[a-z]*,? +([0-9])', '\1'), '(?i),? *pukul', '')")} AS y FROM named
    ), parts AS (
        SELECT *, upper(regexp_extract(y, '[0-9M] ?(WIB|WITA|WIT|UTC|CET|CEST|EST|EDT|Z)$', 1)) AS abbr, regexp_extract(y, '[0-9]{{2}} ?(?:GMT)?([+-][0-9]{{1,2}}):?(?:[0-9]{{2}})?$', 1) AS off,
            regexp_replace(regexp_replace(y, '([0-9M]) ?(WIB|WITA|WIT|UTC|CET|CEST|EST|EDT|Z)$', '\1'), '([:.][0-9]{{2}}(?:[.][0-9]+)?) ?(?:GMT)?[+-][0-9]{{1,2}}:?(?:[0-9]{{2}})?$', '\1') AS z FROM plain
    ), bare AS (
        SELECT *, regexp_full_match(x, '[0-9]+') AS digits, regexp_replace(z, '([:][0-9]{{2}})[.][0-9]+$', '\1') AS t FROM parts
    ), told AS (
        SELECT *, CASE WHEN digits THEN NULL ELSE coalesce(
                CASE WHEN regexp_full_match(t, '[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}') THEN try_strptime(t[1:6] || '20' || t[7:8], '%d-%m-%Y') WHEN regexp_full_match(t, '[0-9]+ [A-Z][a-z]+ [0-9]{{2}}') THEN try_strptime(regexp_replace(t, '([0-9]{{2}})$', '20\1'), '%d %b %Y') END,
                try_strptime(t, ['%Y-%m-%d', '%Y/%m/%d', '%Y.%m.%d', '%d/%m/%Y', '%d.%m.%Y', '%d-%m-%Y', '%d %b %Y', '%d-%b-%Y', '%b %d, %Y']), try_strptime(t, '%m/%d/%Y')) END AS day,
            CASE WHEN digits THEN CASE WHEN length(x) = 14 THEN try_strptime(x, '%Y%m%d%H%M%S') END ELSE coalesce(
                try_strptime(replace(t, 'T', ' '), ['%Y-%m-%d %H:%M:%S', '%d.%m.%Y %H.%M.%S', '%d/%m/%Y %H:%M', '%d %b %Y %H.%M', '%b %d, %Y %H:%M:%S', '%d %b %Y %I:%M %p', '%d-%b-%Y %I:%M %p', '%d %b %Y %H:%M:%S']),
                try_strptime(t, '%Y%m%dT%H%M%S'), try_strptime(regexp_replace(t, '^([0-9]{{2}}-[A-Z][a-z]{{2}})-([0-9]{{2}}) ', '\1-20\2 '), '%d-%b-%Y %H:%M:%S'), try_strptime(t, '%m/%d/%Y %H:%M')) END AS wall FROM bare
    ), placed AS (
        SELECT *, CASE WHEN abbr <> '' THEN wall - to_minutes(CASE abbr WHEN 'WIB' THEN 420 WHEN 'WITA' THEN 480 WHEN 'WIT' THEN 540 WHEN 'CET' THEN 60 WHEN 'CEST' THEN 120 WHEN 'EST' THEN -300 WHEN 'EDT' THEN -240 ELSE 0 END)
            WHEN off <> '' THEN wall - to_hours(CAST(off AS INTEGER)) WHEN wall IS NOT NULL THEN timezone('UTC', timezone(zone, wall)) END AS utc FROM told
    ), first AS (
        SELECT *, CASE WHEN digits AND length(x) = 10 THEN epoch_ms(CAST(x AS BIGINT) * 1000) WHEN digits AND length(x) = 13 THEN epoch_ms(CAST(x AS BIGINT) // 1000 * 1000)
            WHEN abbr = '' AND off = '' AND wall IS NOT NULL AND timezone(zone, timezone('UTC', utc - INTERVAL 1 HOUR)) = wall THEN utc - INTERVAL 1 HOUR ELSE utc END AS instant,
            CASE WHEN digits AND length(x) = 8 THEN try_strptime(x, '%Y%m%d') WHEN digits AND length(x) = 5 THEN DATE '1899-12-30' + CAST(x AS INTEGER) ELSE day END AS d FROM placed
    ), normal AS (SELECT tab, rec_id, field, v, coalesce(strftime(instant, '%Y-%m-%dT%H:%M:%SZ'), strftime(CAST(d AS DATE), '%Y-%m-%d')) AS norm_value FROM first)
"""

ORACLE = {
    "p4_found": _DATE_SQL + "SELECT DISTINCT tab, rec_id, field, norm_value FROM normal WHERE norm_value IS NOT NULL AND norm_value <> v",
    "p4_report": _DATE_SQL + """SELECT r.tab, r.field, CASE WHEN n.norm_value IS NULL THEN 'neither' WHEN length(n.norm_value) = 10 THEN 'date' ELSE 'instant' END AS kind, count(*) AS n_values, count(*) FILTER (n.norm_value = r.v) AS n_already
        FROM raw r JOIN normal n ON r.tab = n.tab AND r.rec_id = n.rec_id AND r.field = n.field AND r.v = n.v GROUP BY ALL""",
    "p2_found": _ORPHAN_SQL + "SELECT tab, ingest_month, rec_id FROM found WHERE reason IS NOT NULL",
    "p2_state": _ORPHAN_SQL + """, per_key AS (SELECT header_id, count(*) AS n_rows FROM refs WHERE header_id IS NOT NULL GROUP BY header_id)
        SELECT p.header_id AS key, p.n_rows, CASE WHEN b.header_id IS NULL THEN 'missing' ELSE 'deleted' END AS reason
        FROM per_key p LEFT JOIN born b USING (header_id) LEFT JOIN dead d USING (header_id) WHERE b.header_id IS NULL OR d.header_id IS NOT NULL""",
    "p2_report": _ORPHAN_SQL + "SELECT tab, ingest_month, reason, count(*) AS n_rows, count(DISTINCT header_id) AS n_keys FROM found WHERE reason IS NOT NULL GROUP BY ALL",
}
