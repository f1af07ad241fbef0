"""Queries over parsed tables, ledgers and keyed storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.cells import clean_cell
from paperloom.operators import ledger as G
from paperloom.operators import storage as S
from paperloom.operators import tables as T
from paperloom.session import load

DETAIL_KEYS = ["header_id", "txn_date", "description", "debit", "credit", "balance"]


def _ledger_pages(spark: SparkSession, d: str) -> DataFrame:
    """One page of Markdown per customer with the customer's orders as a pipe table; some rows lack the leading pipe."""
    o = load(spark, d, "orders")
    local = F.concat(F.lit("Rp "), F.translate(F.format_number("o_totalprice", 2), ",.", ".,"))
    body = F.concat_ws(" | ", F.date_format("o_orderdate", "dd/MM/yyyy"), F.concat(F.lit("Pesanan "), F.col("o_orderkey").cast("string")), local, F.col("o_orderpriority"))
    line = F.when(F.col("o_orderkey") % 7 == 0, body).otherwise(F.concat(F.lit("| "), body, F.lit(" |")))
    g = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("l")))).alias("x"))
    head = F.lit("# Buku Besar\n\nPeriode: 2024\n\n| Tanggal | Uraian | Debit | Status |\n|---|---|---|---|\n")
    return g.select("o_custkey", F.concat(head, F.array_join(F.col("x.l"), "\n\n")).alias("text"))


def markdown_ledgers(spark: SparkSession, d: str) -> DataFrame:
    """Pipe tables built from orders, repaired, parsed and typed again."""
    t = T.markdown_tables(_ledger_pages(spark, d), ["o_custkey"], "text")
    rows = t.select("o_custkey", F.explode("rows").alias("r")).select("o_custkey", *[F.col("r")[k].alias(n) for k, n in enumerate(("d", "u", "a", "s"))])
    x = S.typed(rows, {"d": "DATE", "a": "REAL", "u": "TEXT"})
    return x.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.round(F.col("a") * 100).cast("long")).alias("total_cents"), F.min("d").alias("first_date"), F.max("u").alias("last_text"))


def document_tables(spark: SparkSession, d: str) -> DataFrame:
    """The pipe tables that the corpus and the chunk items hold."""
    c = load(spark, d, "chunk_items").select("preview_id", "chunk_id", "content").distinct()
    t = T.markdown_tables(c, ["preview_id", "chunk_id"], "content")
    return t.select("preview_id", "chunk_id", "table_no", F.size("headers").alias("n_columns"), F.size("rows").alias("n_rows"), "line_start", "line_end")


def _text_cells(spark: SparkSession, d: str) -> DataFrame:
    """customer, part and supplier as tables of text cells, rows in the order of their keys."""
    parts = []
    for name, key, cols in (("customer", "c_custkey", ("c_custkey", "c_name", "c_acctbal", "c_mktsegment")), ("part", "p_partkey", ("p_partkey", "p_name", "p_size", "p_retailprice")), ("supplier", "s_suppkey", ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"))):
        t = load(spark, d, name)
        text = lambda c, t=t: F.format_string("%.2f", F.col(c)) if dict(t.dtypes)[c] == "double" else F.col(c).cast("string")
        cells = F.explode(F.array(*[F.struct(F.lit(k).alias("col"), F.lit(c).alias("header"), text(c).alias("cell")) for k, c in enumerate(cols)]))
        parts.append(t.select(F.lit(name).alias("tab"), (F.col(key) - 1).cast("int").alias("row"), cells.alias("c")).select("tab", "row", "c.col", "c.header", "c.cell"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def inferred_types(spark: SparkSession, d: str) -> DataFrame:
    """Column types judged by the first rows of three tables."""
    return T.column_types(_text_cells(spark, d), ["tab"]).select("tab", "col", "header", "col_type")


def classified_tables(spark: SparkSession, d: str) -> DataFrame:
    """The class of three tables, over all their cells."""
    return T.classify_tables(_text_cells(spark, d), ["tab"]).select("tab", "table_type", "numeric_density", "date_density", "keyword_ratio")


def matched_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables of the data matched with each other by their column names."""
    names = ["document_headers", "transaction_details", "document_signatories", "customer", "supplier", "orders", "lineitem", "events", "ocr_regions", "documents"]
    catalog = spark.createDataFrame([(k, n, load(spark, d, n).columns) for k, n in enumerate(names)], "cat_no int, cat_name string, cat_names array<string>")
    asked = [("a", ["header_id", "txn_date", "description", "debit", "credit", "saldo"]), ("b", ["c_custkey", "c_name", "c_phone"]), ("c", ["ts", "user_id", "event_type", "value", "props", "event_id"]), ("d", ["x", "y"])]
    incoming = spark.createDataFrame(asked, "in_id string, in_names array<string>")
    return T.table_match(incoming, catalog).select("in_id", "cat_name", F.round("score", 6).alias("score"))


def header_records(spark: SparkSession, d: str) -> DataFrame:
    """What a document's text says of its type, title and amounts."""
    x = load(spark, d, "documents").select("doc_id", T.header_info(F.col("text"), F.col("source_file")).alias("h")).where(F.col("h").isNotNull())
    return x.select("doc_id", "h.doc_type", "h.doc_title", "h.parties")


def numeric_sums(spark: SparkSession, d: str) -> DataFrame:
    """Sum and mean of every amount in the ledger in one pass."""
    x = load(spark, d, "transaction_details").select(*[F.round(F.col(c) * 100).cast("long").alias(c) for c in ("debit", "credit", "balance")])
    return G.numeric_sanity(x, ["debit", "credit", "balance"]).select("col", "n", F.col("total").cast("decimal(30,0)").cast("string").alias("total_cents"), F.round("mean", 3).alias("mean_cents"))


def running(spark: SparkSession, d: str) -> DataFrame:
    """Each row with the balance that the amounts of its document add up to."""
    x = load(spark, d, "transaction_details").where(F.col("header_id").isNotNull())
    return G.running_balance(x, "header_id", "detail_id", F.col("debit"), F.col("credit")).select("detail_id", "running_cents")


def continuity(spark: SparkSession, d: str) -> DataFrame:
    """How often stored balances break, over all rows of each document."""
    x = load(spark, d, "transaction_details").where(F.col("header_id").isNotNull())
    return G.continuity(x, "header_id", "detail_id", first_rows=None)


def verified(spark: SparkSession, d: str) -> DataFrame:
    """The verdict on each document's ledger with the reference's sample of first rows."""
    x = load(spark, d, "transaction_details").where(F.col("header_id").isNotNull())
    return G.verify_ledger(x, "header_id", "detail_id").select("header_id", "row_count", "n_breaks", "confidence", "status")


def count_diffs(spark: SparkSession, d: str) -> DataFrame:
    """Rows per document in the ledger and among the signatories."""
    key = F.col("_source_doc").alias("doc")
    return G.count_differences(load(spark, d, "transaction_details").select(key), load(spark, d, "document_signatories").select(key), "doc")


def _tampered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    cols = ["header_id", "description", "ref_no", "debit"]
    a = load(spark, d, "transaction_details").select(*cols)
    b = a.withColumn("debit", F.when(F.col("debit") > 9_000_000, F.col("debit") + 1).otherwise(F.col("debit"))).where(~F.coalesce(F.col("ref_no").startswith("FT-2023-0"), F.lit(False)))
    return a, b


def value_diffs(spark: SparkSession, d: str) -> DataFrame:
    """The multiset difference between the ledger and a copy with changed and missing rows."""
    a, b = _tampered(spark, d)
    return G.value_differences(a, b, ["header_id", "description", "ref_no", "debit"])


def audited(spark: SparkSession, d: str) -> DataFrame:
    """Each document's ledger against the copy: passed, or something is wrong."""
    a, b = _tampered(spark, d)
    t, s = a.groupBy("header_id").agg(F.count(F.lit(1)).alias("n_text")), b.groupBy("header_id").agg(F.count(F.lit(1)).alias("n_stored"))
    w = G.value_differences(a, b, ["header_id", "description", "ref_no", "debit"]).groupBy("header_id").agg(F.count(F.lit(1)).alias("n_wrong"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    x = t.where(F.col("header_id").isNotNull()).join(s, "header_id", "left").join(w, "header_id", "left")
    status = G.audit_status(F.lit(1), F.when(z("n_stored") > 0, 1).otherwise(0), z("n_text"), z("n_stored"), (z("n_text") != z("n_stored")).cast("int"), z("n_wrong"))
    return x.select("header_id", status.alias("status"))


def hash_inserts(spark: SparkSession, d: str) -> DataFrame:
    """Ledger rows entered once by the hash of their cells and page, whichever delivery came first."""
    x = load(spark, d, "transaction_details")
    parts = [(F.col("_source_doc"), "text"), (F.col("_page_number"), "text"), (F.col("header_id"), "text"), (F.col("txn_date"), "text"), (F.col("description"), "text"), (F.col("ref_no"), "text"), (F.col("debit"), "number"), (F.col("credit"), "number"), (F.col("balance"), "number")]
    h = x.select(S.row_hash(parts).alias("row_hash"), "_page_number")
    first, later = h.where("_page_number = 1"), h.where("_page_number IS NULL OR _page_number != 1")
    done = S.insert_new(first.dropDuplicates(["row_hash"]), later, "row_hash")
    return done.groupBy("_page_number").agg(F.count(F.lit(1)).alias("n_rows"), F.min("row_hash").alias("least_hash"))


def upserted_headers(spark: SparkSession, d: str) -> DataFrame:
    """Headers brought up to date by changed copies of themselves: nulls never overwrite, type and number never change once set."""
    cols = ["doc_type", "doc_number", "doc_title", "doc_date", "parties", "currency"]
    h = load(spark, d, "document_headers").select("fingerprint_hash", "updated_at", *cols)
    one = h.groupBy("fingerprint_hash").agg(*[F.min(c).alias(c) for c in cols])
    new = one.withColumn("doc_title", F.when(F.col("currency").isNotNull(), F.upper("doc_title"))).withColumn("doc_type", F.lit("memo"))
    return S.upsert_coalesce(one, new, "fingerprint_hash", keep=("doc_type", "doc_number"))


def merged_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Ledger rows merged on their keys, gaps filled from the copies."""
    x = load(spark, d, "transaction_details").select("detail_id", *DETAIL_KEYS, "ref_no", "value_date", "zona")
    return S.merge_duplicates(x, DETAIL_KEYS, "detail_id").select("detail_id", "header_id", "ref_no", "value_date", "zona")


def merge_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many rows merging removes."""
    x = load(spark, d, "transaction_details").select("detail_id", *DETAIL_KEYS)
    return S.merge_report(x, S.merge_duplicates(x, DETAIL_KEYS, "detail_id"))


def reparented(spark: SparkSession, d: str) -> DataFrame:
    """Ledger rows under the first header with the same number."""
    h = load(spark, d, "document_headers").select("header_id", "doc_number")
    x = S.reparent(load(spark, d, "transaction_details").select("detail_id", "header_id"), h, "header_id", "doc_number")
    return x


def replaced_pages(spark: SparkSession, d: str) -> DataFrame:
    """The ledger after page 2 of every document came again with doubled debits."""
    x = load(spark, d, "transaction_details").select("detail_id", "_source_doc", "_page_number", "debit")
    again = x.where("_page_number = 2").withColumn("debit", F.col("debit") * 2)
    y = S.replace_pages(x, again.select("_source_doc", "_page_number"), again)
    return y.groupBy("_page_number").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.round(F.col("debit") * 100).cast("long")).alias("debit_cents"))


def pruned_pages(spark: SparkSession, d: str) -> DataFrame:
    """The ledger cut after the last page of which there is a signature."""
    x = load(spark, d, "transaction_details").select("detail_id", "_source_doc", "_page_number")
    limits = load(spark, d, "document_signatories").where(F.col("_source_doc").isNotNull()).groupBy("_source_doc").agg(F.max("_page_number").alias("last_page"))
    return S.prune_pages(x, limits).groupBy("_source_doc").agg(F.count(F.lit(1)).alias("n_rows"))


def evolved(spark: SparkSession, d: str) -> DataFrame:
    """Ledger and signatories under the columns of both."""
    a = load(spark, d, "transaction_details").select(F.col("detail_id").alias("rec_id"), "header_id", "debit")
    b = load(spark, d, "document_signatories").select(F.col("signatory_id").alias("rec_id"), "header_id", "role_party")
    x = S.evolve(a, b)
    return x.groupBy("header_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count("debit").alias("n_debit"), F.count("role_party").alias("n_roles"))


def summary(spark: SparkSession, d: str) -> DataFrame:
    """Rows and columns of the stored tables."""
    order = {"transaction_details": "detail_id", "document_signatories": "signatory_id", "document_headers": "header_id"}
    return S.table_summary({t: load(spark, d, t) for t in order}, order).select("table_name", "n_columns", "n_rows")


def header_detail(spark: SparkSession, d: str) -> DataFrame:
    """Ledger totals under the headers that exist."""
    h = load(spark, d, "document_headers").select("header_id", "doc_type", F.upper("currency").alias("currency")).distinct()
    t = load(spark, d, "transaction_details").select("header_id", "debit", "credit").groupBy("header_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round(F.coalesce("debit", F.lit(0.0)) * 100).cast("long")).alias("d"), F.sum(F.round(F.coalesce("credit", F.lit(0.0)) * 100).cast("long")).alias("c")
    )
    x = h.join(t, "header_id")
    return x.groupBy("doc_type", "currency").agg(F.sum("n").alias("n_rows"), F.sum("d").alias("debit_cents"), F.sum("c").alias("credit_cents"))


def cleaned_text(spark: SparkSession, d: str) -> DataFrame:
    """How many descriptions cleaning changes."""
    x = load(spark, d, "transaction_details").where(F.col("description").isNotNull())
    return x.agg(F.count_if(clean_cell("description") != F.col("description")).alias("n_changed"))


QUERIES = {
    "tables_markdown_ledgers": markdown_ledgers, "tables_in_chunks": document_tables, "tables_types": inferred_types, "tables_classes": classified_tables,
    "tables_matched": matched_tables, "tables_header_records": header_records, "ledger_sums": numeric_sums, "ledger_running": running,
    "ledger_continuity": continuity, "ledger_verified": verified, "ledger_counts": count_diffs, "ledger_values": value_diffs, "ledger_audit": audited,
    "ledger_header_detail": header_detail, "store_hash_inserts": hash_inserts, "store_upsert": upserted_headers, "store_merge": merged_duplicates, "store_merge_counts": merge_counts,
    "store_reparent": reparented, "store_replace_pages": replaced_pages, "store_prune_pages": pruned_pages, "store_evolve": evolved, "store_summary": summary,
}

_COPY = """a AS (SELECT header_id, description, ref_no, debit FROM transaction_details),
    b AS (SELECT header_id, description, ref_no, CASE WHEN debit > 9000000 THEN debit + 1 ELSE debit END AS debit FROM a WHERE NOT coalesce(starts_with(ref_no, 'FT-2023-0'), false)),
    diff AS (SELECT header_id, description, ref_no, debit, CAST(sum(x) AS BIGINT) AS n_text, CAST(sum(y) AS BIGINT) AS n_stored FROM (SELECT *, 1 AS x, 0 AS y FROM a UNION ALL SELECT *, 0, 1 FROM b) GROUP BY ALL HAVING sum(x) <> sum(y))"""
_BREAKS = """o AS (SELECT header_id, balance, debit, credit, row_number() OVER w AS n, lag(coalesce(balance, 0)) OVER w AS before FROM transaction_details WHERE header_id IS NOT NULL
        WINDOW w AS (PARTITION BY header_id ORDER BY detail_id)),
    c AS (SELECT header_id, n, abs(before + coalesce(credit, 0) - coalesce(debit, 0) - coalesce(balance, 0)) > 1.0 AS bad FROM o WHERE n > 1)"""
_TYPES = """
    WITH c AS (SELECT 'customer' AS tab, c_custkey - 1 AS r, unnest([0, 1, 2, 3]) AS col, unnest(['c_custkey', 'c_name', 'c_acctbal', 'c_mktsegment']) AS header, unnest([CAST(c_custkey AS VARCHAR), c_name, printf('%.2f', c_acctbal), c_mktsegment]) AS cell FROM customer
        UNION ALL SELECT 'part', p_partkey - 1, unnest([0, 1, 2, 3]), unnest(['p_partkey', 'p_name', 'p_size', 'p_retailprice']), unnest([CAST(p_partkey AS VARCHAR), p_name, CAST(p_size AS VARCHAR), printf('%.2f', p_retailprice)]) FROM part
        UNION ALL SELECT 'supplier', s_suppkey - 1, unnest([0, 1, 2, 3]), unnest(['s_suppkey', 's_name', 's_nationkey', 's_acctbal']), unnest([CAST(s_suppkey AS VARCHAR), s_name, CAST(s_nationkey AS VARCHAR), printf('%.2f', s_acctbal)]) FROM supplier),
    n AS (SELECT *, regexp_replace(trim(cell), '[^0-9.,]', '', 'g') AS g FROM c),
    v AS (SELECT *, g <> '' AND regexp_full_match(CASE WHEN regexp_matches(g, '[0-9].*[.,][^.,]{3}$') THEN regexp_replace(g, '[.,]', '', 'g') ELSE regexp_replace(g, '^(.*)[.,]([^.,]*)$', '\\1.\\2') END, '[0-9]+([.][0-9]+)?') AS num,
        contains(g, '.') AND NOT regexp_matches(g, '[.]0*$') AND NOT regexp_matches(g, '[0-9].*[.,][^.,]{3}$') AS frac FROM n)"""

ORACLE = {
    # Runs of lines with bars whose second line is a rule; lines are counted in the text as it stands.
    "tables_in_chunks": r"""
        WITH c AS (SELECT DISTINCT preview_id, chunk_id, content FROM chunk_items),
        l AS (SELECT preview_id, chunk_id, unnest(string_split(content, chr(10))) AS t, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM c),
        r AS (SELECT *, trim(t) AS x, i - row_number() OVER (PARTITION BY preview_id, chunk_id ORDER BY i) AS run FROM l WHERE regexp_full_match(trim(t), '\|.*\|.*')),
        p AS (SELECT *, row_number() OVER w AS k, lead(x) OVER w AS following, count(*) OVER (PARTITION BY preview_id, chunk_id, run) AS n FROM r WINDOW w AS (PARTITION BY preview_id, chunk_id, run ORDER BY i))
        SELECT preview_id, chunk_id, CAST(row_number() OVER (PARTITION BY preview_id, chunk_id ORDER BY i) AS INTEGER) AS table_no, CAST(len(string_split(trim(x, '|'), '|')) AS INTEGER) AS n_columns, CAST(n - 2 AS INTEGER) AS n_rows, CAST(i AS INTEGER) AS line_start, CAST(i + n - 1 AS INTEGER) AS line_end
        FROM p WHERE k = 1 AND n > 2 AND regexp_full_match(following, '\|(\s*:?-+:?\s*\|)+')""",
    "tables_matched": """
        WITH names(cat_no, cat_name) AS (VALUES (0, 'document_headers'), (1, 'transaction_details'), (2, 'document_signatories'), (3, 'customer'), (4, 'supplier'), (5, 'orders'), (6, 'lineitem'), (7, 'events'), (8, 'ocr_regions'), (9, 'documents')),
        c AS (SELECT cat_no, cat_name, column_name AS w, count(*) OVER (PARTITION BY cat_no) AS nb FROM names JOIN information_schema.columns ON table_name = cat_name WHERE NOT starts_with(column_name, '_')),
        asked(in_id, ws) AS (VALUES ('a', ['header_id', 'txn_date', 'description', 'debit', 'credit', 'saldo']), ('b', ['c_custkey', 'c_name', 'c_phone']), ('c', ['ts', 'user_id', 'event_type', 'value', 'props', 'event_id']), ('d', ['x', 'y'])),
        i AS (SELECT in_id, len(ws) AS na, unnest(ws) AS w FROM asked),
        s AS (SELECT in_id, cat_no, cat_name, count(*) / greatest(max(na), max(nb)) AS base, count(*) FILTER (w IN ('date', 'tanggal', 'description', 'keterangan', 'debit', 'kredit', 'credit', 'balance', 'saldo', 'amount', 'nominal')) AS f FROM i JOIN c USING (w) GROUP BY ALL),
        t AS (SELECT *, CASE WHEN f >= 2 THEN greatest(base, 0.75) ELSE base END AS score FROM s)
        SELECT in_id, arg_max(cat_name, score * 1000 - cat_no) AS cat_name, round(max(score), 6) AS score FROM t WHERE score >= 0.5 GROUP BY in_id""",
    "tables_markdown_ledgers": """
        SELECT o_custkey, count(*) AS n_rows, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total_cents, strftime(min(o_orderdate), '%Y-%m-%d') AS first_date, max('Pesanan ' || o_orderkey) AS last_text
        FROM orders GROUP BY o_custkey""",
    "tables_types": _TYPES + """
        SELECT tab, CAST(col AS INTEGER) AS col, header, CASE WHEN sum(num::INT) / count(*) >= 0.7 THEN CASE WHEN bool_or(num AND frac) THEN 'REAL' ELSE 'NUMERIC' END
            WHEN regexp_matches(header, 'amount|saldo|balance|debit|kredit|credit|nominal|fee|harga|price') THEN 'REAL' ELSE 'TEXT' END AS col_type
        FROM v WHERE r < 50 AND trim(cell) <> '' GROUP BY tab, col, header""",
    "tables_classes": _TYPES + """
        , s AS (SELECT tab, sum(num::INT) / count(*) AS nd, avg(length(trim(cell))) AS len, max(r) + 1 AS n FROM v WHERE trim(cell) <> '' GROUP BY tab),
        k AS (SELECT tab, avg(CASE WHEN regexp_matches(replace(header, '_', ' '), 'price|rate|unit|ph|tax|date') THEN 1.0 ELSE 0.0 END) AS kw FROM v WHERE r = 0 GROUP BY tab)
        SELECT tab, CASE WHEN kw >= 0.4 AND nd >= 0.3 AND n >= 3 THEN 'transactional_log' WHEN nd >= 0.4 AND n >= 3 AND len <= 45 THEN 'transactional_log' WHEN len > 70 OR nd < 0.15 THEN 'narrative_matrix' ELSE 'generic_table' END AS table_type,
            round_even(nd, 3) AS numeric_density, CAST(0 AS DOUBLE) AS date_density, round_even(kw, 3) AS keyword_ratio FROM s JOIN k USING (tab)""",
    "tables_header_records": r"""
        WITH x AS (SELECT doc_id, text, lower(text) AS low FROM documents WHERE text IS NOT NULL AND regexp_replace(text, '\s', '', 'g') <> '')
        SELECT doc_id, CASE WHEN regexp_matches(low, 'account statement|rekening koran|bank statement|giro|tabungan|statement of account') THEN 'bank_statement'
            WHEN regexp_matches(low, 'berita acara|bast|serah terima|upgrade daya|perjanjian') THEN 'berita_acara' WHEN regexp_matches(low, 'invoice|faktur|tagihan|kwitansi|receipt') THEN 'invoice' ELSE 'general_document' END AS doc_type,
            trim(regexp_replace(trim(regexp_replace(coalesce(nullif(regexp_extract(text, '(?m)^#\s+(.+)$', 1), ''), nullif(regexp_extract(text, '\*\*([^*\n]+)\*\*', 1), '')), '\s+', ' ', 'g')), '^[*_]+|[*_]+$', '', 'g')) AS doc_title,
            trim(regexp_replace(coalesce(nullif(regexp_extract(text, '(?i)(?:CUSTOMER|NASABAH|PIHAK)\s*[:.]\s*([^\n\r]+)', 1), ''), nullif(regexp_extract(text, '\*\*(PT\s+[^*]+)\*\*', 1), '')), '\s+', ' ', 'g')) AS parties FROM x""",
    "ledger_sums": """
        WITH x AS (SELECT CAST(round(debit * 100) AS BIGINT) AS debit, CAST(round(credit * 100) AS BIGINT) AS credit, CAST(round(balance * 100) AS BIGINT) AS balance FROM transaction_details),
        u AS (SELECT 'debit' AS col, debit AS v FROM x UNION ALL SELECT 'credit', credit FROM x UNION ALL SELECT 'balance', balance FROM x)
        SELECT col, count(v) AS n, CAST(CAST(sum(v) AS BIGINT) AS VARCHAR) AS total_cents, round(avg(v), 3) AS mean_cents FROM u GROUP BY col""",
    "ledger_running": """
        SELECT detail_id, CAST(sum(CAST(round(coalesce(credit, 0) * 100) AS BIGINT) - CAST(round(coalesce(debit, 0) * 100) AS BIGINT)) OVER (PARTITION BY header_id ORDER BY detail_id) AS BIGINT) AS running_cents
        FROM transaction_details WHERE header_id IS NOT NULL""",
    "ledger_continuity": f"WITH {_BREAKS} SELECT header_id, count(*) AS n_checked, count(*) FILTER (bad) AS n_breaks FROM c GROUP BY header_id",
    "ledger_verified": f"""
        WITH {_BREAKS}, k AS (SELECT header_id, count(*) FILTER (bad) AS n_breaks FROM c WHERE n <= 20 GROUP BY header_id),
        t AS (SELECT header_id, count(*) AS row_count FROM transaction_details WHERE header_id IS NOT NULL GROUP BY header_id)
        SELECT header_id, row_count, coalesce(n_breaks, 0) AS n_breaks, CAST(CASE WHEN coalesce(n_breaks, 0) = 0 THEN 1.0 ELSE 0.56 END AS DOUBLE) AS confidence, CASE WHEN coalesce(n_breaks, 0) = 0 THEN 'verified' ELSE 'needs_revision' END AS status
        FROM t LEFT JOIN k USING (header_id)""",
    "ledger_counts": """
        WITH a AS (SELECT _source_doc AS doc, count(*) AS n FROM transaction_details GROUP BY 1), b AS (SELECT _source_doc AS doc, count(*) AS n FROM document_signatories GROUP BY 1)
        SELECT coalesce(a.doc, b.doc) AS doc, coalesce(a.n, 0) AS n_text, coalesce(b.n, 0) AS n_stored, coalesce(a.n, 0) = coalesce(b.n, 0) AS agrees FROM a FULL JOIN b ON a.doc = b.doc""",
    "ledger_values": f"WITH {_COPY} SELECT * FROM diff",
    "ledger_audit": f"""
        WITH {_COPY}, t AS (SELECT header_id, count(*) AS n FROM a WHERE header_id IS NOT NULL GROUP BY 1), s AS (SELECT header_id, count(*) AS n FROM b GROUP BY 1), w AS (SELECT header_id, count(*) AS n FROM diff GROUP BY 1)
        SELECT header_id, CASE WHEN w.n IS NULL AND t.n = s.n THEN 'PASSED' ELSE 'WARNING' END AS status FROM t LEFT JOIN s USING (header_id) LEFT JOIN w USING (header_id)""",
    "ledger_header_detail": """
        WITH h AS (SELECT DISTINCT header_id, doc_type, upper(currency) AS currency FROM document_headers)
        SELECT doc_type, currency, count(*) AS n_rows, CAST(sum(CAST(round(coalesce(debit, 0) * 100) AS BIGINT)) AS BIGINT) AS debit_cents, CAST(sum(CAST(round(coalesce(credit, 0) * 100) AS BIGINT)) AS BIGINT) AS credit_cents
        FROM h JOIN transaction_details USING (header_id) GROUP BY doc_type, currency""",
    "store_hash_inserts": """
        WITH h AS (SELECT _page_number, left(sha256(coalesce(_source_doc, '') || '|' || coalesce(CAST(_page_number AS VARCHAR), '') || '|' || coalesce(CAST(header_id AS VARCHAR), '') || '|' || coalesce(txn_date, '') || '|' || coalesce(description, '') || '|' || coalesce(ref_no, '')
            || '|' || CASE WHEN debit IS NULL THEN '0' ELSE printf('%.2f', debit) END || '|' || CASE WHEN credit IS NULL THEN '0' ELSE printf('%.2f', credit) END || '|' || CASE WHEN balance IS NULL THEN '0' ELSE printf('%.2f', balance) END), 24) AS h FROM transaction_details)
        SELECT _page_number, count(DISTINCT h) AS n_rows, min(h) AS least_hash FROM h GROUP BY _page_number""",
    "store_upsert": """
        SELECT fingerprint_hash, min(doc_type) AS doc_type, min(doc_number) AS doc_number, CASE WHEN min(currency) IS NOT NULL THEN upper(min(doc_title)) ELSE min(doc_title) END AS doc_title, min(doc_date) AS doc_date, min(parties) AS parties, min(currency) AS currency
        FROM document_headers GROUP BY fingerprint_hash""".replace("min(doc_type) AS doc_type", "coalesce(min(doc_type), 'memo') AS doc_type"),
    "store_merge": """
        WITH k AS (SELECT *, header_id IS NOT NULL AND txn_date IS NOT NULL AND description IS NOT NULL AND debit IS NOT NULL AND credit IS NOT NULL AND balance IS NOT NULL AS whole FROM transaction_details)
        SELECT min(detail_id) AS detail_id, header_id, arg_min(ref_no, detail_id) FILTER (ref_no IS NOT NULL) AS ref_no, arg_min(value_date, detail_id) FILTER (value_date IS NOT NULL) AS value_date, arg_min(zona, detail_id) FILTER (zona IS NOT NULL) AS zona
        FROM k WHERE whole GROUP BY header_id, txn_date, description, debit, credit, balance
        UNION ALL SELECT detail_id, header_id, ref_no, value_date, zona FROM k WHERE NOT whole""",
    "store_merge_counts": """
        WITH k AS (SELECT *, header_id IS NOT NULL AND txn_date IS NOT NULL AND description IS NOT NULL AND debit IS NOT NULL AND credit IS NOT NULL AND balance IS NOT NULL AS whole FROM transaction_details),
        g AS (SELECT count(*) AS n FROM (SELECT DISTINCT header_id, txn_date, description, debit, credit, balance FROM k WHERE whole))
        SELECT count(*) AS initial_rows, count(*) FILTER (NOT whole) + any_value(g.n) AS final_rows, count(*) FILTER (whole) - any_value(g.n) AS removed_rows FROM k, g""",
    "store_reparent": """
        WITH m AS (SELECT DISTINCT h.header_id, k.t FROM document_headers h JOIN (SELECT doc_number, min(header_id) AS t FROM document_headers WHERE doc_number IS NOT NULL GROUP BY 1) k USING (doc_number) WHERE h.header_id <> k.t)
        SELECT detail_id, coalesce(m.t, d.header_id) AS header_id FROM transaction_details d LEFT JOIN m ON m.header_id = d.header_id""",
    "store_replace_pages": """
        SELECT _page_number, count(*) AS n_rows, CAST(sum(CAST(round(debit * CASE WHEN _page_number = 2 THEN 2 ELSE 1 END * 100) AS BIGINT)) AS BIGINT) AS debit_cents FROM transaction_details GROUP BY _page_number""",
    "store_prune_pages": """
        WITH l AS (SELECT _source_doc, max(_page_number) AS hi FROM document_signatories WHERE _source_doc IS NOT NULL GROUP BY 1)
        SELECT d._source_doc, count(*) AS n_rows FROM transaction_details d LEFT JOIN l ON l._source_doc = d._source_doc WHERE hi IS NULL OR _page_number IS NULL OR _page_number <= hi GROUP BY 1""",
    "store_evolve": """
        SELECT header_id, count(*) AS n_rows, count(debit) AS n_debit, count(role_party) AS n_roles FROM (SELECT header_id, debit, NULL AS role_party FROM transaction_details UNION ALL SELECT header_id, NULL, role_party FROM document_signatories) GROUP BY header_id""",
    "store_summary": """
        SELECT 'transaction_details' AS table_name, 16 AS n_columns, count(*) AS n_rows FROM transaction_details UNION ALL SELECT 'document_signatories', 12, count(*) FROM document_signatories UNION ALL SELECT 'document_headers', 12, count(*) FROM document_headers""",
}
