"""Cleaning and reading single cells, as column expressions that stay in the JVM.

Every function takes a column (or a name) and gives null for null unless it says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for an empty number.
NULL_TOKENS = ("-", "--", "N/A", "NA", "null", "None")
# Months as they appear in period labels, and filter values of report headers.
PERIOD_MONTHS = (
    "jan(?:uari|uary)?|feb(?:ruari|ruary)?|mar(?:et|ch)?|apr(?:il)?|mei|may|jun(?:i|e)?|jul(?:i|y)?|"
    "agu(?:stus)?|aug(?:ust)?|sep(?:tember)?|okt(?:ober)?|oct(?:ober)?|nov(?:ember)?|des(?:ember)?|dec(?:ember)?"
)
CATEGORY_MONTHS = "jan|feb|mar|apr|may|mei|jun|jul|aug|agu|sep|oct|okt|nov|dec|des"
FILTER_TOKENS = ("all", "(all)", "semua", "(semua)", "(multiple items)", "(beberapa item)", "(blank)", "(kosong)")

_SPACE = r"[\s\x1c-\x1f\x85   -     　]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(c, f"^{_SPACE}+|{_SPACE}+$", "")


def clean_cell(c: Column | str) -> Column:
    """Runs of white space become one blank; emphasis marks at the ends are taken off."""
    flat = F.trim(F.regexp_replace(_col(c), f"{_SPACE}+", " "))  # only blanks are left to trim
    return F.trim(F.regexp_replace(flat, r"^[*_]+|[*_]+$", ""))


def sanitize_identifier(c: Column | str) -> Column:
    """A name of lower-case letters, digits and single underscores; ``col_`` leads where a letter would not."""
    x = F.regexp_replace(F.lower(strip(_col(c))), r"[^a-zA-Z0-9_]", "_")
    x = F.regexp_replace(F.regexp_replace(x, r"_+", "_"), r"^_+|_+$", "")
    return F.regexp_replace(x, r"^(?=[0-9]|$)", "col_")


def parse_number(c: Column | str) -> Column:
    """A double from text with either decimal convention, currency signs and bracketed negatives; null if there is none.

    The later of two kinds of separator is the decimal one; one kind alone parts thousands if exactly
    three digits follow the last. Everything but digits and separators is dropped first. What is
    named several times below is computed once, as a common subexpression of the generated code.
    """
    x = clean_cell(c)
    digits = F.regexp_replace(x, r"[^0-9.,]", "")
    dotted = F.translate(digits, ",", ".")
    after = F.length(F.substring_index(dotted, ".", -1))
    whole = F.replace(dotted, F.lit("."), F.lit(""))
    parted = F.contains(dotted, F.lit("."))
    both = digits.contains(".") & digits.contains(",")
    # Digits before the last separator: all but those after it.
    thousands = ~both & (after == 3) & (F.length(whole) > 3)
    at = F.length(whole) - after
    plain = F.when(~parted, whole).when(thousands, whole).otherwise(F.concat(F.substring(whole, F.lit(1), at), F.lit("."), F.substring(whole, at + 1, after)))
    # With one kind of separator all but the last must be none; with both, those of the other kind part thousands.
    last_kind = F.when(F.length(F.substring_index(digits, ".", -1)) < F.length(F.substring_index(digits, ",", -1)), ".").otherwise(",")
    decimals = F.length(digits) - F.length(F.replace(digits, last_kind, F.lit("")))
    single = F.when(both, decimals == 1).otherwise(~parted | thousands | (F.length(dotted) - F.length(whole) == 1))
    good = single & (whole != "") & (~parted | thousands | ((after > 0) & (at > 0)))
    negative = (x.startswith("(") & x.endswith(")")) | x.startswith("-")
    return F.when(good & ~x.isin(*NULL_TOKENS) & (x != ""), plain.try_cast("double") * F.when(negative, -1.0).otherwise(1.0))


def parse_date(c: Column | str) -> Column:
    """``YYYY-MM-DD`` from packed, ISO or day-first dates; shape is checked, the calendar is not."""
    packed = r"^((?:19|20)\d{2})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])$"
    iso = r"^((?:19|20)\d{2})-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$"
    day = r"^(0?[1-9]|[12]\d|3[01])[./-](0?[1-9]|1[0-2])[./-]((?:19|20)?\d{2})$"

    def read(x: Column) -> Column:
        part = lambda k: F.regexp_extract(x, day, k)
        year = F.right(F.concat(F.lit("20"), part(3)), F.lit(4))
        return (
            F.when(x.rlike(packed), F.regexp_replace(x, packed, "$1-$2-$3"))
            .when(x.rlike(iso), x)
            .when(x.rlike(day), F.concat_ws("-", year, F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0")))
        )

    return let(clean_cell(c), read)


def parse_rupiah(c: Column | str) -> Column:
    """The first rupiah amount with two decimals in a text; a bracket in it makes it negative."""
    pattern = r"(Rp\.?\s*\(?\s*([\d.]+),(\d{2})\)?)"
    x = _col(c)
    hit = F.regexp_extract(x, pattern, 1)
    whole = F.replace(F.regexp_extract(x, pattern, 2), F.lit("."), F.lit("")).try_cast("double")
    value = whole + F.regexp_extract(x, pattern, 3).try_cast("double") / 100
    return F.when(hit.contains("("), -value).otherwise(value)


def slug(c: Column | str, fallback: str = "sheet", length: int = 48) -> Column:
    """A short lower-case ASCII name; accents of Latin letters are taken off."""
    accents = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
    plain = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
    ascii_only = F.regexp_replace(F.translate(_col(c), accents, plain), r"[^\x00-\x7f]", "")
    x = F.lower(F.regexp_replace(F.regexp_replace(ascii_only, r"[^a-zA-Z0-9]+", "_"), r"^_+|_+$", ""))
    return F.coalesce(F.nullif(F.substring(x, 1, length), F.lit("")), F.lit(fallback))


def extract_period(c: Column | str) -> Column:
    """The first month-and-year mention; the order of the four patterns counts before the place in the text."""
    x = _col(c)
    patterns = (
        rf"(?i)\b((?:{PERIOD_MONTHS})\s+20\d{{2}})\b",
        rf"(?i)\b(\d{{1,2}}\s+(?:{PERIOD_MONTHS})\s+20\d{{2}})\b",
        r"\b((?:0?[1-9]|1[0-2])[/\-]20\d{2})\b",
        r"\b(20\d{2}[/\-](?:0?[1-9]|1[0-2]))\b",
    )
    return F.coalesce(*[F.nullif(F.regexp_extract(x, p, 1), F.lit("")) for p in patterns])


def value_family(text: Column, kind: Column) -> Column:
    """empty, bool, date, number or text of a cell given its text and its stored kind (b, d, n, s)."""
    return (
        F.when(text.isNull() | (strip(text) == ""), "empty").when(kind == "b", "bool").when(kind == "d", "date").when(kind == "n", "number").otherwise("text")
    )


def dominant_family(families: Column) -> Column:
    """The most frequent family of an array, empties left out; of equals the one met first."""
    kept = F.filter(families, lambda x: x != "empty")
    scored = F.transform(F.array_distinct(kept), lambda f: F.struct(F.size(F.filter(kept, lambda x: x == f)).alias("n"), (-F.array_position(kept, f)).alias("p"), f.alias("f")))
    return F.array_max(scored)["f"]


def category_family(text: Column, kind: Column) -> Column:
    """date, number or text of a chart category; labels such as Mar-24 are dates."""
    monthly = strip(F.coalesce(text, F.lit(""))).rlike(rf"(?i)^(?:{CATEGORY_MONTHS})[a-z]*[- /]\d{{2,4}}$")
    return F.when((kind == "d") | monthly, "date").when(kind == "n", "number").otherwise("text")


def stable_text(c: Column | str, kind: str) -> Column:
    """A stored value as text that does not change with the engine: ISO dates, plain numbers, true and false."""
    x = _col(c)
    if kind == "d":
        return F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss")
    if kind == "n":
        whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
        return F.when(x.isNotNull(), F.when(whole, F.format_string("%d", x.cast("long"))).otherwise(x.cast("string")))
    return x.cast("string")


def native_tokens(c: Column | str) -> Column:
    """A rough token count: UTF-8 bytes over three, rounded up."""
    return F.ceil(F.octet_length(_col(c)) / 3)


def display_time(c: Column | str, zone: str = "Asia/Jakarta") -> Column:
    """A timestamp as shown to people in a zone."""
    return F.date_format(F.from_utc_timestamp(F.to_utc_timestamp(_col(c), F.current_timezone()), zone), "dd MMM yyyy, HH:mm:ss")


# ---- A1 notation ----


def column_index(letters: Column | str) -> Column:
    """A -> 1, Z -> 26, AA -> 27."""
    chars = F.split(F.upper(_col(letters)), "(?!$)")
    return F.aggregate(chars, F.lit(0), lambda acc, x: acc * 26 + F.ascii(x) - 64)


def column_letter(index: Column | str) -> Column:
    """1 -> A, 27 -> AA; three letters reach beyond any sheet."""
    n = _col(index).cast("int")
    one = lambda k: F.char(F.lit(65) + k)
    low, mid = F.pmod(n - 1, F.lit(26)), F.floor((n - 1) / 26)
    second, high = F.pmod(mid - 1, F.lit(26)), F.floor((mid - 1) / 26)
    return F.when(n < 1, F.lit(None).cast("string")).otherwise(
        F.concat(F.when(high > 0, one(high - 1)).otherwise(""), F.when(mid > 0, one(second)).otherwise(""), one(low))
    )


def range_bounds(reference: Column | str) -> Column:
    """``$A$1:C7`` as struct(min_row, max_row, min_col, max_col); null for anything that is no such rectangle."""
    x = F.upper(F.replace(_col(reference), F.lit("$"), F.lit("")))
    p = r"^([A-Z]{1,3})(\d+)(?::([A-Z]{1,3})(\d+))?$"
    g = lambda k: F.regexp_extract(x, p, k)
    c1, r1 = column_index(g(1)), g(2).try_cast("int")
    c2 = F.when(g(3) == "", c1).otherwise(column_index(g(3)))
    r2 = F.when(g(4) == "", r1).otherwise(g(4).try_cast("int"))
    ok = x.rlike(p) & (r1 >= 1) & (c1 >= 1) & (r2 >= r1) & (c2 >= c1)
    return F.when(ok, F.struct(r1.alias("min_row"), r2.alias("max_row"), c1.alias("min_col"), c2.alias("max_col")))


def bounds_overlap(a: Column, b: Column) -> Column:
    """Whether two closed rectangles share a cell."""
    return (a["max_row"] >= b["min_row"]) & (b["max_row"] >= a["min_row"]) & (a["max_col"] >= b["min_col"]) & (b["max_col"] >= a["min_col"])


def in_bounds(row: Column, col: Column, b: Column) -> Column:
    """Whether a cell lies in a closed rectangle."""
    return row.between(b["min_row"], b["max_row"]) & col.between(b["min_col"], b["max_col"])


def range_contains(outer: Column, inner: Column) -> Column:
    """Whether one closed rectangle lies in another."""
    return (outer["min_row"] <= inner["min_row"]) & (outer["max_row"] >= inner["max_row"]) & (outer["min_col"] <= inner["min_col"]) & (outer["max_col"] >= inner["max_col"])


MAX_ROWS, MAX_COLUMNS = 1_048_576, 16_384


def formula_references(formula: Column | str, source_sheet: Column, sheets: Column) -> Column:
    """Array of (sheet, min_row, max_row, min_col, max_col) that a formula names; texts in quotes are no references.

    References to sheets that are not in ``sheets`` and those beyond a sheet's size are left out.
    """
    blanked = F.regexp_replace(_col(formula), r'"(?:[^"]|"")*"', '""')
    one = r"(?<![A-Za-z0-9_.!'])((?:(?:'(?:[^']|'')+'|[A-Za-z_][A-Za-z0-9_.]*)!)?\$?[A-Za-z]{1,3}\$?\d+(?::\$?[A-Za-z]{1,3}\$?\d+)?)(?![A-Za-z0-9_(])"
    hits = F.regexp_extract_all(blanked, F.lit(one), F.lit(1))

    def read(h: Column) -> Column:
        named = h.contains("!")
        raw = F.regexp_extract(h, r"^(.*)!", 1)
        sheet = F.when(~named, source_sheet).when(raw.startswith("'"), F.replace(F.regexp_extract(raw, r"^'(.*)'$", 1), F.lit("''"), F.lit("'"))).otherwise(raw)
        ref = F.replace(F.regexp_extract(h, r"([^!]*)$", 1), F.lit("$"), F.lit(""))
        p = r"^([A-Za-z]+)(\d+)(?::([A-Za-z]+)(\d+))?$"
        c1, r1 = column_index(F.regexp_extract(ref, p, 1)), F.regexp_extract(ref, p, 2).try_cast("int")
        c2 = F.when(F.regexp_extract(ref, p, 3) == "", c1).otherwise(column_index(F.regexp_extract(ref, p, 3)))
        r2 = F.when(F.regexp_extract(ref, p, 4) == "", r1).otherwise(F.regexp_extract(ref, p, 4).try_cast("int"))
        return F.struct(
            F.trim(sheet).alias("sheet"), F.least(r1, r2).alias("min_row"), F.greatest(r1, r2).alias("max_row"),
            F.least(c1, c2).alias("min_col"), F.greatest(c1, c2).alias("max_col"),
        )

    return F.filter(
        F.transform(hits, read),
        lambda s: F.array_contains(sheets, s["sheet"]) & (s["min_row"] >= 1) & (s["max_row"] <= MAX_ROWS) & (s["max_col"] <= MAX_COLUMNS),
    )
