"""Tables inside Markdown: repair, parsing, column mapping, typing, classification, matching.

Repair and parsing are line state machines, so they run as Arrow batches of whole documents; all
that follows is column expressions over exploded cells.
"""

from __future__ import annotations

import html.parser
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions.cells import clean_cell, parse_date, parse_number, sanitize_identifier, strip

# Names under which columns of ledgers and signature tables occur, in the order they are tried.
TRANSACTION_ALIASES = {
    "txn_date": ("posting date", "posting_date", "post date", "tanggal posting", "tanggal", "date", "tgl", "tgl transaksi", "transaction date"),
    "value_date": ("value date", "value_date", "valuta date", "tgl valuta", "valuta"),
    "description": ("transaction description", "description", "deskripsi", "keterangan", "uraian", "transaksi", "uraian transaksi", "narasi", "rincian", "item", "nama item"),
    "ref_no": ("reference/cheque no", "reference cheque no", "reference", "ref no", "ref", "cheque no", "no ref", "no referensi", "no cek", "nomor transaksi", "id transaksi", "doc ref"),
    "detail_info": ("detail", "details", "keterangan tambahan", "info", "informasi", "penerima/pengirim", "tujuan"),
    "debit": ("debit amount", "debit", "debet", "mutasi debet", "mutasi debit", "keluar", "pengeluaran", "dr"),
    "credit": ("credit amount", "credit", "kredit", "mutasi kredit", "masuk", "penerimaan", "cr"),
    "balance": ("balance", "saldo", "sisa saldo", "saldo akhir", "total balance"),
}
SIGNATORY_ALIASES = {
    "role_party": ("pihak / peran", "pihak peran", "pihak", "peran", "role", "party", "pihak pertama", "pihak kedua", "instansi", "perusahaan", "organisasi"),
    "name": ("nama", "nama penandatangan", "nama terang", "name", "signatory", "pejabat"),
    "position": ("jabatan", "position", "title", "job title", "kedudukan", "role position"),
    "date": ("tanggal", "tgl", "date", "signed date", "tanggal ttd"),
    "signature_status": ("tanda tangan / paraf", "tanda tangan", "ttd", "paraf", "signature", "status ttd"),
    "notes": ("keterangan", "notes", "catatan", "remark", "remarks"),
}
# Header words of transactional tables; names of finance and date columns.
HEADER_KEYWORDS = (
    "date", "tanggal", "posting date", "value date", "description", "deskripsi", "keterangan", "transaksi", "transaction", "reference", "ref no", "cheque",
    "debit", "debit amount", "credit", "credit amount", "kredit", "balance", "saldo", "amount", "nominal", "total", "subtotal", "price", "harga", "qty",
    "quantity", "unit", "rate", "tax", "pajak", "fee", "biaya", "mutasi", "tds", "dhl", "ph", "suhu", "temperature", "elevasi", "elevation", "skor",
    "score", "nilai", "value", "persentase", "percentage", "korelasi", "correlation", "volume",
)
FINANCE_NAMES = ("date", "tanggal", "description", "keterangan", "debit", "kredit", "credit", "balance", "saldo", "amount", "nominal")
FINANCE_HEADERS = ("debit", "credit", "kredit", "balance", "saldo", "amount", "nominal", "mutasi")
DATE_HEADERS = ("date", "tanggal", "posting_date", "value_date", "tgl")
REAL_HINTS = ("amount", "saldo", "balance", "debit", "kredit", "credit", "nominal", "fee", "harga", "price")
DATE_HINTS = ("date", "tanggal", "posting")


class _HtmlTable(html.parser.HTMLParser):
    """Collects the cells of one HTML table; a cell that spans columns is followed by empty ones."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self.cell: list[str] | None = None
        self.span = 1

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            self._close()
            self.cell = []
            value = dict(attrs).get("colspan") or "1"
            self.span = int(value) if value.isdigit() and 0 < int(value) <= 1000 else 1
        elif tag == "br" and self.cell is not None:
            self.cell.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr", "table"):
            self._close()

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)

    def _close(self) -> None:
        if self.cell is None:
            return
        if not self.rows:
            self.rows.append([])
        text = " ".join("".join(self.cell).split()).replace("|", "&#124;")
        self.rows[-1].extend([text, *[""] * (self.span - 1)])
        self.cell = None


def html_tables_to_pipes(text: str) -> str:
    """HTML tables outside code fences as pipe tables; the first row becomes the header."""
    fenced = re.split(r"(```[\s\S]*?```)", text)

    def table(m: re.Match) -> str:
        reader = _HtmlTable()
        reader.feed(m.group())
        reader._close()
        rows = [r for r in reader.rows if r]
        if not rows:
            return m.group()
        width = max(map(len, rows))
        rows = [r + [""] * (width - len(r)) for r in rows]
        lines = ["| " + " | ".join(r) + " |" for r in rows]
        return "\n\n" + "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]) + "\n\n"

    return "".join(p if k % 2 else re.sub(r"<table\b[\s\S]*?</table\s*>", table, p, flags=re.I) for k, p in enumerate(fenced))


_SEPARATOR = re.compile(r"\|(\s*:?-+:?\s*\|)+")


def _cells(line: str) -> list[str]:
    inner = line.strip()
    inner = inner[1:] if inner.startswith("|") else inner
    inner = inner[:-1] if inner.endswith("|") else inner
    return [c.strip() for c in inner.split("|")]


def _is_row(line: str) -> bool:
    s = line.strip()
    return s.startswith("|") and s.count("|") >= 2


def repair_tables(text: str) -> str:
    """Pipe tables made well-formed: headerless runs get headers, gaps inside are closed, rows fit the header."""
    text = html_tables_to_pipes(text)
    lines = text.split("\n")
    out: list[str] = []
    k, fenced = 0, False
    while k < len(lines):
        line = lines[k]
        if line.strip().startswith("```"):
            fenced = not fenced
        if fenced or not _is_row(line):
            out.append(line)
            k += 1
            continue
        has_header = k + 1 < len(lines) and bool(_SEPARATOR.fullmatch(lines[k + 1].strip()))
        if not has_header and not _SEPARATOR.fullmatch(line.strip()):
            run = [line]
            while k + len(run) < len(lines) and _is_row(lines[k + len(run)]) and not _SEPARATOR.fullmatch(lines[k + len(run)].strip()):
                run.append(lines[k + len(run)])
            width = len(_cells(run[0]))
            follows = k + len(run) < len(lines) and _SEPARATOR.fullmatch(lines[k + len(run)].strip())
            if len(run) >= 2 and not follows and width >= 2 and all(len(_cells(r)) == width for r in run):
                out.append("| " + " | ".join(f"Kolom {i + 1}" for i in range(width)) + " |")
                out.append("|" + " --- |" * width)
                out.extend(run)
                k += len(run)
                continue
            out.extend(run[:-1] if follows else run)
            k += len(run) - (1 if follows else 0)
            if not follows:
                continue
            line = lines[k]
        elif not has_header:
            out.append(line)
            k += 1
            continue
        width = len(_cells(line))
        out.append("| " + " | ".join(_cells(line)) + " |")
        out.append("|" + " --- |" * width)
        k += 2
        while k < len(lines):
            row = lines[k]
            if not row.strip():
                ahead = k
                while ahead < len(lines) and not lines[ahead].strip():
                    ahead += 1
                new_table = ahead + 1 < len(lines) and bool(_SEPARATOR.fullmatch(lines[ahead + 1].strip()))
                goes_on = ahead < len(lines) and (_is_row(lines[ahead]) or lines[ahead].count("|") >= max(2, width - 1))
                if goes_on and not new_table:
                    k = ahead
                    continue
                break
            if _SEPARATOR.fullmatch(row.strip()):
                k += 1
                continue
            if not _is_row(row):
                if row.count("|") >= max(1, width - 1):
                    row = "| " + row.strip()
                else:
                    break
            opens_new = k + 1 < len(lines) and _SEPARATOR.fullmatch(lines[k + 1].strip()) and len(_cells(lines[k + 1])) == len(_cells(row)) != width
            if opens_new:
                break
            cells = _cells(row)
            if len(cells) > width:
                last = next((c for c in reversed(cells[width - 1 :]) if c), "")
                cells = [*cells[: width - 1], last]
            out.append("| " + " | ".join(cells + [""] * (width - len(cells))) + " |")
            k += 1
    return "\n".join(out)


_HINT = re.compile(r"<!--\s*sqlite_table:\s*([A-Za-z0-9_]+)\s*-->", re.I)


def parse_tables(text: str | None) -> list[dict]:
    """The pipe tables of a text: table_no, headers, rows, context, hint, line_start, line_end. None for no table."""
    if not text:
        return []
    lines = repair_tables(text).split("\n")
    out, k = [], 0
    while k + 1 < len(lines):
        if not (_is_row(lines[k]) and _SEPARATOR.fullmatch(lines[k + 1].strip())):
            k += 1
            continue
        headers, rows, start = _cells(lines[k]), [], k
        k += 2
        while k < len(lines) and _is_row(lines[k]) and not _SEPARATOR.fullmatch(lines[k].strip()):
            cells = _cells(lines[k])
            rows.append((cells + [""] * len(headers))[: len(headers)])
            k += 1
        if rows:
            before = [x.strip() for x in lines[max(0, start - 3) : start] if x.strip()]
            hint = next((m.group(1) for x in reversed(before) if (m := _HINT.search(x))), None)
            out.append({"table_no": len(out) + 1, "headers": headers, "rows": rows, "context": "\n".join(before), "hint": hint, "line_start": start + 1, "line_end": k})
    return out


def tag_tables(text: str, names: list[str | None]) -> str:
    """The text with a comment that names the stored table before each of its tables; old comments are replaced."""
    lines = repair_tables(text).split("\n")
    for table, name in reversed(list(zip(parse_tables(text), names))):
        at = table["line_start"] - 1
        if not name:
            continue
        tag = f"<!-- sqlite_table: {name} -->"
        if at > 0 and _HINT.fullmatch(lines[at - 1].strip()):
            lines[at - 1] = tag
        else:
            lines.insert(at, tag)
    return "\n".join(lines)


def tagged(docs: DataFrame, key: str, text: str, names: str) -> DataFrame:
    """key, text: each text with its tables tagged by an array of names in their order; a null name, or none, leaves a table as it is. Null texts stay null."""

    @F.pandas_udf("string")
    def tag(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([tag_tables(x, [] if y is None else list(y)) if isinstance(x, str) else None for x, y in zip(t, n)])

    return docs.select(key, tag(text, names).alias(text))


TABLE_SCHEMA = "table_no int, headers array<string>, rows array<array<string>>, context string, hint string, line_start int, line_end int"


def markdown_tables(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per table of each document's text, with the keys. Null and empty texts have no tables."""
    names = [f.split()[0] for f in TABLE_SCHEMA.replace("array<array<string>>", "x").replace("array<string>", "x").split(", ")]
    fields = [docs.schema[k] for k in keys] + T.StructType.fromDDL(TABLE_SCHEMA).fields

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{**{k: r[k] for k in keys}, **t} for r in pdf.to_dict("records") for t in parse_tables(r["_text"] if isinstance(r["_text"], str) else None)]
            yield pd.DataFrame(rows, columns=[*keys, *names])

    return docs.select(*keys, F.col(text).alias("_text")).mapInPandas(run, T.StructType(fields))


# ---- mapping columns ----


def canonical_columns(headers: Column, aliases: dict[str, tuple[str, ...]]) -> Column:
    """Map of canonical name to 0-based column: headers from left to right, each takes the first free name it fits.

    A header fits a name if one of its aliases equals it, equals its identifier, or is a part of it.
    """
    low = F.transform(headers, lambda h: F.struct(F.lower(clean_cell(h)).alias("t"), sanitize_identifier(h).alias("i")))

    def fits(h: Column, words: tuple[str, ...]) -> Column:
        hit = F.lit(False)
        for w in words:
            hit = hit | h["t"].contains(w) | (h["i"] == w)
        return hit

    names = list(aliases)
    start = F.array(*[F.lit(-1) for _ in names])
    seq = F.zip_with(low, F.sequence(F.lit(0), F.greatest(F.size(headers) - 1, F.lit(0))), lambda h, k: F.struct(h["t"].alias("t"), h["i"].alias("i"), k.alias("k")))

    def step(acc: Column, h: Column) -> Column:
        chosen = F.lit(None).cast("int")
        for j, n in reversed(list(enumerate(names))):
            chosen = F.when((acc[j] < 0) & fits(h, aliases[n]), j).otherwise(chosen)
        return F.transform(acc, lambda v, j: F.when(j == F.coalesce(chosen, F.lit(-1)), h["k"]).otherwise(v))

    taken = F.aggregate(F.filter(seq, lambda h: h["t"].isNotNull() & (h["t"] != "")), start, step)
    return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), taken), lambda _, v: v >= 0)


def valid_transaction(mapping: Column) -> Column:
    """Whether mapped columns make a ledger: a date or a text, and an amount."""
    has = lambda *n: F.arrays_overlap(F.map_keys(mapping), F.array(*map(F.lit, n)))
    return has("txn_date", "description") & has("debit", "credit", "balance")


def valid_signatory(mapping: Column) -> Column:
    has = lambda *n: F.arrays_overlap(F.map_keys(mapping), F.array(*map(F.lit, n)))
    return has("name", "role_party") & has("position", "signature_status")


def route(headers: Column, hint: Column, forced: Column) -> Column:
    """Where a table is stored: transaction_details, document_signatories, generic, or nowhere (null)."""
    signs = F.exists(headers, lambda h: F.lower(h).rlike("pihak|tanda tangan|jabatan"))
    return (
        F.when((hint == "transaction_details") | valid_transaction(canonical_columns(headers, TRANSACTION_ALIASES)), "transaction_details")
        .when((hint == "document_signatories") | valid_signatory(canonical_columns(headers, SIGNATORY_ALIASES)) | signs, "document_signatories")
        .when(forced, "generic")
    )


# ---- typing and classes ----


def cells_of(tables: DataFrame, keys: list[str]) -> DataFrame:
    """keys, col, header, row, cell: every cell of tables with headers and rows."""
    rows = tables.select(*keys, "headers", F.posexplode("rows").alias("row", "r"))
    return rows.select(*keys, "row", "headers", F.posexplode("r").alias("col", "cell")).select(*keys, "row", "col", F.get("headers", F.col("col")).alias("header"), "cell")


def column_types(cells: DataFrame, keys: list[str], sample_rows: int = 50) -> DataFrame:
    """keys, col, header, col_type, samples of every column, judged by its first rows.

    Seven in ten numbers make REAL (if any has a fraction) or NUMERIC, seven in ten dates DATE; else
    the name decides, else TEXT. A date that also reads as a number counts as a number.
    """
    c = cells.where(F.col("row") < sample_rows).withColumn("t", clean_cell("cell"))
    c = c.withColumn("num", parse_number("t")).withColumn("full", F.coalesce(F.col("t") != "", F.lit(False)))
    c = c.withColumn("dat", F.col("num").isNull() & parse_date("t").isNotNull())
    flag = lambda x: F.sum((F.col("full") & x).cast("int"))
    g = c.groupBy(*keys, "col").agg(
        F.first("header", True).alias("header"), F.sum(F.col("full").cast("int")).alias("n"), flag(F.col("num").isNotNull()).alias("n_num"),
        flag(F.col("dat")).alias("n_date"), F.bool_or(F.col("full") & (F.col("num") != F.floor("num"))).alias("fraction"),
        F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("full"), F.struct("row", "t")))), 1, 3), lambda s: s["t"]).alias("samples"),
    )
    name = F.lower(F.coalesce("header", F.lit("")))
    hint = lambda words: name.rlike("|".join(words))
    col_type = (
        F.when((F.col("n") > 0) & (F.col("n_num") / F.col("n") >= 0.7), F.when(F.col("fraction"), "REAL").otherwise("NUMERIC"))
        .when((F.col("n") > 0) & (F.col("n_date") / F.col("n") >= 0.7), "DATE")
        .when(hint(REAL_HINTS), "REAL").when(hint(DATE_HINTS), "DATE").otherwise("TEXT")
    )
    return g.select(*keys, "col", "header", col_type.alias("col_type"), "samples")


def unique_names(names: Column) -> Column:
    """Identifiers of an array of headers; one met before gets _1, _2 and so on."""
    ids = F.transform(names, sanitize_identifier)
    return F.transform(ids, lambda x, k: F.when(F.size(F.filter(F.slice(ids, F.lit(1), k), lambda y: y == x)) == 0, x).otherwise(
        F.concat(x, F.lit("_"), F.size(F.filter(F.slice(ids, F.lit(1), k), lambda y: y == x)).cast("string"))))


def classify_tables(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, table_type, confidence, numeric_density, date_density, keyword_ratio of every table."""
    c = cells.withColumn("t", clean_cell("cell")).withColumn("full", F.coalesce(F.col("t") != "", F.lit(False)))
    c = c.withColumn("num", F.col("full") & parse_number("t").isNotNull()).withColumn("dat", F.col("full") & ~F.col("num") & parse_date("t").isNotNull())
    ident = sanitize_identifier("header")
    words = F.replace(ident, F.lit("_"), F.lit(" "))
    keyword = F.lit(False)
    for w in HEADER_KEYWORDS:
        keyword = keyword | words.contains(w)
    head = c.where("row = 0").groupBy(*keys).agg(
        F.avg(keyword.cast("double")).alias("kw"), F.bool_or(ident.isin(*FINANCE_HEADERS)).alias("fin"), F.bool_or(ident.isin(*DATE_HEADERS)).alias("dte")
    )
    body = c.groupBy(*keys).agg(
        F.sum(F.col("full").cast("int")).alias("n"), F.sum(F.col("num").cast("int")).alias("n_num"), F.sum(F.col("dat").cast("int")).alias("n_dat"),
        F.coalesce(F.avg(F.when(F.col("full"), F.length("t"))), F.lit(0.0)).alias("len"), (F.max("row") + 1).alias("rows"),
    )
    x = body.join(head, keys)
    share = lambda k: F.when(F.col("n") > 0, F.col(k) / F.col("n")).otherwise(0.0)
    x = x.withColumn("nd", share("n_num")).withColumn("dd", share("n_dat"))
    kind = (
        F.when(F.col("fin") & F.col("dte"), F.when(F.col("rows") >= 5, "financial_statement").otherwise("transactional_log"))
        .when((F.col("kw") >= 0.4) & (F.col("nd") + F.col("dd") >= 0.3) & (F.col("rows") >= 3), "transactional_log")
        .when((F.col("nd") >= 0.4) & (F.col("rows") >= 3) & (F.col("len") <= 45), "transactional_log")
        .when((F.col("len") > 70) | ((F.col("nd") < 0.15) & ~F.col("fin")), "narrative_matrix")
        .otherwise("generic_table")
    )
    conf = F.least(F.lit(0.98), F.greatest(F.lit(0.65), 0.5 * F.col("kw") + 0.5 * (F.col("nd") + F.col("dd"))))
    return x.select(*keys, kind.alias("table_type"), F.bround(conf, 2).alias("confidence"), F.bround("nd", 3).alias("numeric_density"), F.bround("dd", 3).alias("date_density"), F.bround("kw", 3).alias("keyword_ratio"))


def table_match(incoming: DataFrame, catalog: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Each incoming table (in_id, in_names) with the stored table (cat_no, cat_name, cat_names) whose columns fit best.

    Fit is shared names over the longer list, at least three quarters if two finance names are shared.
    Candidates meet on a shared column name, so tables without one are never paired. Of equals
    the earlier in the catalogue wins; a table without a candidate is left out.
    """
    a = incoming.select("in_id", F.array_distinct("in_names").alias("in_names"))
    b = catalog.select("cat_no", "cat_name", F.array_distinct(F.filter("cat_names", lambda x: ~x.startswith("_"))).alias("cat_names"))
    shared = (
        a.select("in_id", F.size("in_names").alias("na"), F.explode("in_names").alias("w"))
        .join(b.select("cat_no", "cat_name", F.size("cat_names").alias("nb"), F.explode("cat_names").alias("w")), "w")
        .groupBy("in_id", "cat_no", "cat_name").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.count(F.lit(1)).alias("k"), F.count_if(F.col("w").isin(*FINANCE_NAMES)).alias("f"))
    )
    base = F.col("k") / F.greatest("na", "nb")
    score = F.when(F.col("f") >= 2, F.greatest(base, F.lit(0.75))).otherwise(base)
    best = shared.withColumn("score", score).where(F.col("score") >= threshold).groupBy("in_id").agg(F.max(F.struct("score", (-F.col("cat_no")).alias("m"), "cat_name")).alias("b"))
    return best.select("in_id", F.col("b.cat_name").alias("cat_name"), F.col("b.score").alias("score"))


# ---- header of a document ----


def header_info(text: Column, source: Column) -> Column:
    """struct(doc_type, doc_title, doc_number, doc_date, parties, total_amount, fingerprint_hash) read from a document's text."""
    low = F.lower(text)
    kinds = (
        ("bank_statement", ("account statement", "rekening koran", "bank statement", "giro", "tabungan", "statement of account")),
        ("berita_acara", ("berita acara", "bast", "serah terima", "upgrade daya", "perjanjian")),
        ("invoice", ("invoice", "faktur", "tagihan", "kwitansi", "receipt")),
    )
    doc_type = None
    for kind, words in kinds:
        hit = low.rlike("|".join(words))
        doc_type = F.when(hit, kind) if doc_type is None else doc_type.when(hit, kind)
    doc_type = doc_type.otherwise("general_document")
    grab = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    named = lambda x: F.when(~F.lower(x).isin("koran", "giro", "tabungan", "statement"), x)
    title = clean_cell(F.coalesce(grab(r"(?m)^#\s+(.+)$"), grab(r"\*\*([^*\n]+)\*\*")))
    number = clean_cell(F.coalesce(
        named(grab(r"(?i)(?:ACCOUNT(?:\s*NO|\s*NUMBER)?|NO\.?\s*REK(?:ENING)?|NOMOR\s*REKENING)\s*[:=]\s*([0-9A-Za-z\-_/]+)")),
        grab(r"(?i)(?:ACCOUNT(?:\s*NO|\s*NUMBER)?|REKENING|NO\.?\s*REK(?:ENING)?)\s*[:.]?\s*([0-9][0-9A-Za-z\-_/]+)"),
        named(grab(r"(?i)(?:NOMOR|NO)\s*[:.]\s*([0-9A-Za-z\-_/]+)")),
        grab(r"(?i)(?:NOMOR AGENDA|ID PELANGGAN)\s*[:.]\s*([0-9]+)"),
    ))
    period = clean_cell(grab(r"(?i)(?:PERIOD|PERIODE)\s*[:.]\s*([0-9./-]+(?:\s+(?:TO|-)\s+[0-9./-]+)?)"))
    dated = clean_cell(grab(r"(?i)(?:TANGGAL|DATE)\s*[:.]\s*([^\n\r]+)"))
    doc_date = F.coalesce(period, parse_date(dated), dated)
    parties = clean_cell(F.coalesce(grab(r"(?i)(?:CUSTOMER|NASABAH|PIHAK)\s*[:.]\s*([^\n\r]+)"), grab(r"\*\*(PT\s+[^*]+)\*\*")))
    total = parse_number(grab(r"(?i)(?:BALANCE AT PERIOD START|TOTAL|SALDO AKHIR|TOTAL AMOUNT|NILAI)\s*[:=]?\s*Rp?\.?\s*([0-9,.]+)"))
    empty = F.lit("")
    parts = F.concat_ws("|", doc_type, F.coalesce(number, empty), F.coalesce(doc_date, empty), F.coalesce(parties, empty), F.coalesce(source, empty))
    bare = F.coalesce(source, empty).eqNullSafe("") & number.isNull() & doc_date.isNull() & parties.isNull() & title.isNull()
    print_ = F.when(bare, F.concat(doc_type, F.lit("|"), F.sha2(text, 256))).otherwise(parts)
    return F.when(text.isNotNull() & (strip(text) != ""), F.struct(
        doc_type.alias("doc_type"), title.alias("doc_title"), number.alias("doc_number"), doc_date.alias("doc_date"), parties.alias("parties"),
        total.alias("total_amount"), F.substring(F.sha2(print_, 256), 1, 16).alias("fingerprint_hash"),
    ))
