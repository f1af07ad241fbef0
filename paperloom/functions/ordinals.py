"""Numbers of legal clauses: roman, spelled out, letters, arabic with a suffix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Levels from the outermost in, and how each is numbered.
LEVELS = ("judul", "pembukaan", "buku", "bab", "bagian", "paragraf", "pasal", "ayat", "huruf", "angka", "huruf2", "angka2")
STYLES = {
    "buku": "roman", "bab": "roman", "bagian": "word", "paragraf": "arabic", "pasal": "arabic", "ayat": "arabic", "huruf": "letter",
    "angka": "arabic", "huruf2": "letter", "angka2": "arabic", "pembukaan": "free", "judul": "free",
}
RESETS = ("ayat", "huruf", "angka", "huruf2", "angka2", "paragraf", "bagian")
BLOCKED_IN_PREAMBLE = ("buku", "bab", "bagian", "paragraf", "pasal")
NUMBER_WORDS = ("kesatu", "kedua", "ketiga", "keempat", "kelima", "keenam", "ketujuh", "kedelapan", "kesembilan", "kesepuluh")
ROMAN = (("M", 1000), ("CM", 900), ("D", 500), ("CD", 400), ("C", 100), ("XC", 90), ("L", 50), ("XL", 40), ("X", 10), ("IX", 9), ("V", 5), ("IV", 4), ("I", 1))


def level_index(kind: Column) -> Column:
    """0 for the outermost level; unknown kinds come after all."""
    known = F.create_map(*[F.lit(x) for i, k in enumerate(LEVELS) for x in (k, i)])
    return F.coalesce(F.try_element_at(known, kind), F.lit(len(LEVELS)))


def roman_to_int(c: Column) -> Column:
    """The value of roman digits, read from the right; null if there are other characters."""
    value = F.create_map(*[F.lit(x) for k, v in ROMAN if len(k) == 1 for x in (k, v)])
    digits = F.reverse(F.transform(F.split(F.upper(c), "(?!$)"), lambda d: F.try_element_at(value, d)))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("top"))
    folded = F.aggregate(
        digits, start,
        lambda acc, d: F.struct((acc["total"] + F.when(d < acc["top"], -d).otherwise(d)).alias("total"), F.greatest(acc["top"], d).alias("top")),
        lambda acc: acc["total"],
    )
    return F.when(F.upper(c).rlike("^[IVXLCDM]+$"), folded)


def int_to_roman(c: Column) -> Column:
    """Roman digits of a positive number below 4000."""
    parts, rest = [], c
    for letters, value in ROMAN:
        parts.append(F.repeat(F.lit(letters), F.floor(rest / value).cast("int")))
        rest = rest % value
    return F.when((c > 0) & (c < 4000), F.concat(*parts))


def to_number(ordinal: Column, kind: Column) -> Column:
    """The place of an ordinal in its level as a double; a suffix letter counts hundredths. Null if unreadable."""
    raw = F.trim(F.regexp_replace(F.trim(ordinal), r"^[.()\[\]]+|[.()\[\]]+$", ""))
    style = F.try_element_at(F.create_map(*[F.lit(x) for kv in STYLES.items() for x in kv]), kind)
    words = F.create_map(*[F.lit(x) for i, w in enumerate(NUMBER_WORDS) for x in (w, i + 1)])
    arabic = r"^(\d+)\s*([A-Za-z])?$"
    base, suffix = F.regexp_extract(raw, arabic, 1).try_cast("double"), F.regexp_extract(raw, arabic, 2)
    with_suffix = F.when(suffix == "", base).otherwise(base + (F.ascii(F.upper(suffix)) - 64) / 100.0)
    return (
        F.when(style == "roman", roman_to_int(raw).cast("double"))
        .when(style == "word", F.try_element_at(words, F.lower(raw)).cast("double"))
        .when((style == "letter") & raw.rlike("^[A-Za-z]$"), (F.ascii(F.lower(raw)) - 96).cast("double"))
        .when((style == "arabic") & raw.rlike(arabic), with_suffix)
    )


def from_number(value: Column, kind: Column) -> Column:
    """The ordinal of a whole number in the style of its level."""
    style = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in STYLES.items() for x in kv]), kind), F.lit("free"))
    words = F.array(*[F.lit(w.capitalize()) for w in NUMBER_WORDS])
    n = value.cast("int")
    return (
        F.when(style == "roman", int_to_roman(n))
        .when((style == "word") & n.between(1, len(NUMBER_WORDS)), F.try_element_at(words, n))
        .when(style == "letter", F.char(F.lit(96) + n))
        .otherwise(n.cast("string"))
    )


def follows(previous: Column, current: Column) -> Column:
    """Whether a number may come after another: the next whole one, or the next suffix of the same."""
    base = lambda x: F.floor(x)
    suffix = lambda x: F.round((x - F.floor(x)) * 100).cast("int")
    same = (base(current) == base(previous)) & (suffix(current) == suffix(previous) + 1)
    return same | ((base(current) == base(previous) + 1) & (suffix(current) == 0))
