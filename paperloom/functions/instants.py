"""Mixed timestamp texts to one unambiguous form.

All known layouts are one regex alternation with named groups. One replace call per value puts
every component at a fixed place of a delimited string, so the pattern runs once per value in
the JVM. Calendar ranges are checked on integers, days are counted by civil-calendar
arithmetic, and only a wall time without an offset consults a zone.

Results: ``YYYY-MM-DD`` for a date (never shifted), ``YYYY-MM-DDTHH:MM:SSZ`` for an instant with
fractions cut off, null for nulls, empty text, text that is no date, and impossible dates.
A wall time that occurs twice is the first; one skipped by a clock change counts on with the
offset from before the change. Numeric day and month are day first unless only month first
gives a date. Two-digit years are 20YY.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.cells import let

# Month and weekday names (Indonesian and English) and zone abbreviations in minutes.
MONTHS = {
    "januari": 1, "january": 1, "jan": 1, "februari": 2, "february": 2, "pebruari": 2, "feb": 2, "peb": 2,
    "maret": 3, "march": 3, "mar": 3, "april": 4, "apr": 4, "mei": 5, "may": 5, "juni": 6, "june": 6, "jun": 6,
    "juli": 7, "july": 7, "jul": 7, "agustus": 8, "august": 8, "agu": 8, "agt": 8, "ags": 8, "aug": 8,
    "september": 9, "sept": 9, "sep": 9, "oktober": 10, "october": 10, "okt": 10, "oct": 10,
    "november": 11, "nopember": 11, "nov": 11, "nop": 11, "desember": 12, "december": 12, "des": 12, "dec": 12,
}
WEEKDAYS = (
    "senin selasa rabu kamis jumat jum'at sabtu minggu ahad sen sel rab kam jum sab min "
    "monday tuesday wednesday thursday friday saturday sunday mon tue tues wed thu thur thurs fri sat sun"
).split()
OFFSETS = {
    "wib": 420, "wita": 480, "wit": 540, "utc": 0, "gmt": 0, "z": 0, "cet": 60, "cest": 120, "wet": 0, "west": 60, "eet": 120,
    "eest": 180, "bst": 60, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480,
    "pdt": -420, "sgt": 480, "myt": 480, "jst": 540,
}
DEFAULT_ZONE = "Asia/Jakarta"
#: Day counts of spreadsheets that are read as dates: 1950 to 2099.
SERIAL_RANGE = (18264, 73050)

_SEP = "\u0001"
_NAMES = ("y", "m", "d", "mon", "dm", "md", "yy", "h", "mi", "s", "ap", "zone", "oh", "om", "num")


def _longest_first(words) -> str:
    return "|".join(sorted(words, key=len, reverse=True))


@lru_cache(maxsize=1)
def layout_pattern() -> tuple[str, str]:
    """The alternation and the replacement that lines its groups up.

    Weekday and clock stand once around the alternatives of dates. The named groups of an
    alternative carry its number; the replacement joins the groups of one component, of which
    at most one took part in the match.
    """
    month, day_name = _longest_first(MONTHS), _longest_first(WEEKDAYS)
    offset = r"(?:(?:UTC|GMT)?(?<oh{k}>[+-]\d{{1,2}})(?::?(?<om{k}>\d{{2}}))?|(?<zone{k}>" + _longest_first(OFFSETS) + "))"
    clock = (
        r"(?<h{k}>\d{{1,2}})[:.](?<mi{k}>\d{{2}})(?:[:.](?<s{k}>\d{{2}})(?:[.,]\d+)?)?(?:\s*(?<ap{k}>[AP])\.?M\.?)?(?:\s*" + offset + ")?"
    )
    tail = r"(?:(?:\s*,?\s*(?:pukul|jam|at)\s+|\s*T\s*|\s*,\s*|\s+)" + clock + ")?"
    lead = f"(?:(?:{day_name})\\.?,?\\s+)?"
    dates = [
        r"(?<y{k}>\d{{4}})(?:-(?<m{k}>\d{{1,2}})-|/(?<m{k}s>\d{{1,2}})/|\.(?<m{k}p>\d{{1,2}})\.)(?<d{k}>\d{{1,2}})",
        r"(?<dm{k}>\d{{1,2}})(?:-(?<md{k}>\d{{1,2}})-|/(?<md{k}s>\d{{1,2}})/|\.(?<md{k}p>\d{{1,2}})\.)(?:(?<y{k}>\d{{4}})|(?<yy{k}>\d{{2}}))",
        r"(?<d{k}>\d{{1,2}})(?:st|nd|rd|th)?[\s./-]+(?<mon{k}>" + month + r")\.?[\s./,-]+(?:(?<y{k}>\d{{4}})|(?<yy{k}>\d{{2}}))",
        r"(?<mon{k}>" + month + r")\.?\s+(?<d{k}>\d{{1,2}})(?:st|nd|rd|th)?\s*,?\s+(?<y{k}>\d{{4}})",
    ]
    known = [d.format(k=k) for k, d in enumerate(dates)]
    times = [tail.format(k="t")]
    compact = (r"(?<y{k}>\d{{4}})(?<m{k}>\d{{2}})(?<d{k}>\d{{2}})T(?<h{k}>\d{{2}})(?<mi{k}>\d{{2}})(?<s{k}>\d{{2}})?(?:[.,]\d+)?(?:" + offset + ")?").format(k="c")
    number = r"(?<numn>\d{5,16}(?:\.\d+)?)"
    pattern = r"(?i)^[\s ​﻿]*(?:" + lead + "(?:" + "|".join(known) + ")" + times[0] + "|" + compact + "|" + number + r")[\s ​﻿]*$"
    whole = pattern
    slots = []
    for name in _NAMES:
        slots.append("".join(f"${{{name}{k}{v}}}" for k in (*range(len(dates)), "t", "c", "n") for v in ("", "s", "p") if f"(?<{name}{k}{v}>" in whole))
    return pattern, _SEP.join(slots)


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, by integer arithmetic."""
    yy = F.when(m <= 2, y - 1).otherwise(y)
    era = F.floor(yy / 400)
    yoe = yy - era * 400
    doy = F.floor((F.pmod(m + 9, F.lit(12)) * 153 + 2) / 5) + d - 1
    return (era * 146097 + yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy - 719468).cast("long")


def civil(days: Column) -> Column:
    """struct(y, m, d) of days since 1970-01-01; every intermediate value is computed once."""

    def of_day(era: Column, doe: Column) -> Column:
        yoe = F.floor((doe - F.floor(doe / 1460) + F.floor(doe / 36524) - F.floor(doe / 146096)) / 365)
        return let(yoe, lambda q: let(doe - (q * 365 + F.floor(q / 4) - F.floor(q / 100)), lambda doy: let(F.floor((doy * 5 + 2) / 153), lambda mp: fields(era, q, doy, mp))))

    def fields(era: Column, yoe: Column, doy: Column, mp: Column) -> Column:
        return F.struct(
            (yoe + era * 400 + F.when(mp >= 10, 1).otherwise(0)).cast("int").alias("y"), F.when(mp < 10, mp + 3).otherwise(mp - 9).cast("int").alias("m"),
            (doy - F.floor((mp * 153 + 2) / 5) + 1).cast("int").alias("d"),
        )

    return let(days + 719468, lambda z: let(F.floor(z / 146097), lambda era: let(z - era * 146097, lambda doe: of_day(era, doe))))


def civil_from_days(days: Column) -> tuple[Column, Column, Column]:
    """Year, month, day of days since 1970-01-01."""
    c = civil(days)
    return c["y"], c["m"], c["d"]


def _month_days(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def _real(y: Column, m: Column, d: Column) -> Column:
    return (y >= 1) & m.between(1, 12) & (d >= 1) & (d <= _month_days(y, m))


def _date_text(days: Column) -> Column:
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return let(civil(days), lambda c: F.concat(F.lpad(c["y"].cast("string"), 4, "0"), F.lit("-"), two(c["m"]), F.lit("-"), two(c["d"])))


@lru_cache(maxsize=4)
def _regions(_key: int, spark: SparkSession) -> tuple[str, ...]:
    zones = spark._jvm.java.time.ZoneId.getAvailableZoneIds()
    return tuple(sorted(str(z) for z in zones if "/" in str(z)))


def zone_of(spark: SparkSession, zona: Column | None) -> Column:
    """A zone text (abbreviation, offset or region name) as a zone the engine knows; else the default zone."""
    if zona is None:
        return F.lit(DEFAULT_ZONE)
    text = F.trim(zona)
    fixed = F.create_map(*[F.lit(x) for k, v in OFFSETS.items() for x in (k, f"{'-' if v < 0 else '+'}{abs(v) // 60:02d}:{abs(v) % 60:02d}")])
    regions = _regions(id(spark), spark)
    return F.coalesce(
        F.try_element_at(fixed, F.lower(text)),
        F.when(text.isin(*regions), text),
        F.when(text.rlike(r"^[+-](0\d|1[0-4]):[0-5]\d$"), text),
        F.lit(DEFAULT_ZONE),
    )


def _components(p: Column) -> Column:
    part = {n: F.nullif(p[i], F.lit("")) for i, n in enumerate(_NAMES)}
    num = {n: part[n].try_cast("int") for n in ("y", "m", "d", "dm", "md", "yy", "h", "mi", "s", "oh", "om")}
    months = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    zones = F.create_map(*[F.lit(x) for kv in OFFSETS.items() for x in kv])
    year = F.coalesce(num["y"], num["yy"] + 2000)
    hour12 = num["h"] % 12 + F.when(F.lower(part["ap"]) == "p", 12).otherwise(0)
    signed = F.when(part["oh"].startswith("-"), -1).otherwise(1)
    return F.struct(
        year.alias("y"), num["m"].alias("m"), F.try_element_at(months, F.lower(part["mon"])).alias("mon"), num["d"].alias("d"),
        num["dm"].alias("dm"), num["md"].alias("md"), _real(year, num["md"], num["dm"]).alias("day_first"),
        F.when(part["ap"].isNull(), num["h"]).when(num["h"].between(1, 12), hour12).otherwise(99).alias("h"),
        num["mi"].alias("mi"), F.coalesce(num["s"], F.lit(0)).alias("s"),
        F.coalesce(F.try_element_at(zones, F.lower(part["zone"])), num["oh"] * 60 + signed * F.coalesce(num["om"], F.lit(0))).alias("off"),
        part["num"].alias("n"),
    )


def _bare_numbers(c: Column) -> Column:
    """yyyymmdd and yyyymmddhhmmss, a spreadsheet's day count, seconds to microseconds of an epoch."""
    n = c["n"]
    whole = F.substring_index(n, ".", 1)
    size, plain = F.length(whole), ~n.contains(".")
    sub = lambda a, k: F.substring(n, a, k).try_cast("int")
    ymd = _real(sub(1, 4), sub(5, 2), sub(7, 2)) & sub(1, 4).between(1900, 2099)
    dmy = (size == 8) & _real(sub(5, 4), sub(3, 2), sub(1, 2)) & sub(5, 4).between(1900, 2099)
    packed = plain & size.isin(8, 14)
    long = plain & (size == 14)
    epoch = F.when(size.isin(9, 10), whole.try_cast("long")).when((size == 13) & plain, F.floor(n.try_cast("long") / 1000))
    epoch = epoch.when((size == 16) & plain, F.floor(n.try_cast("long") / 1000000))
    return F.struct(
        F.when(packed & ymd, sub(1, 4)).when(packed & dmy, sub(5, 4)).otherwise(c["y"]).alias("y"),
        F.coalesce(F.when(packed & ymd, sub(5, 2)).when(packed & dmy, sub(3, 2)).otherwise(c["m"]), c["mon"], F.when(c["day_first"], c["md"]).otherwise(c["dm"])).alias("m"),
        F.coalesce(F.when(packed & ymd, sub(7, 2)).when(packed & dmy, sub(1, 2)).otherwise(c["d"]), F.when(c["day_first"], c["dm"]).otherwise(c["md"])).alias("d"),
        F.when(long, sub(9, 2)).otherwise(c["h"]).alias("h"), F.when(long, sub(11, 2)).otherwise(c["mi"]).alias("mi"), F.when(long, sub(13, 2)).otherwise(c["s"]).alias("s"),
        c["off"].alias("off"),
        F.when((size == 5) & whole.try_cast("long").between(*SERIAL_RANGE), whole.try_cast("long") - 25569).alias("serial"),
        F.when((size == 5) & ~plain, F.round(F.pmod(n.try_cast("double"), F.lit(1.0)) * 86400).cast("long")).alias("clock"),
        epoch.cast("long").alias("epoch"),
    )


def _assemble(c: Column, zone: Column) -> Column:
    good = _real(c["y"], c["m"], c["d"])
    timed = c["h"].isNotNull()
    in_range = c["h"].between(0, 23) & c["mi"].between(0, 59) & c["s"].between(0, 59)
    day = days_from_civil(c["y"], c["m"], c["d"])
    wall = F.coalesce(
        F.when(good & timed & in_range, day * 86400 + c["h"] * 3600 + c["mi"] * 60 + c["s"]), c["serial"] * 86400 + c["clock"]
    )
    only_day = F.coalesce(F.when(good & ~timed, day), F.when(c["clock"].isNull(), c["serial"]))

    def in_utc(w: Column) -> Column:
        zoned = F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(w), zone))
        return F.coalesce(c["epoch"], w - c["off"] * 60, F.when(w.isNotNull(), zoned))

    def stamp(sec: Column) -> Column:
        tod = F.pmod(sec, F.lit(86400))
        two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
        clock = F.concat(F.lit("T"), two(tod / 3600), F.lit(":"), two(tod % 3600 / 60), F.lit(":"), two(tod % 60), F.lit("Z"))
        whole_day = let(F.coalesce(F.floor(sec / 86400), only_day), _date_text)
        return F.when(sec.isNotNull(), F.concat(whole_day, clock)).otherwise(whole_day)

    return let(let(wall, in_utc), stamp)


def with_norm(df: DataFrame, value: str, zona: str | None, out: str = "norm_value") -> DataFrame:
    """Add ``out``, the normalised text of column ``value``; ``zona`` names the column with the row's zone.

    A value already written YYYY-MM-DD skips the pattern; most values of a clean column do.
    """
    pattern, replacement = layout_pattern()
    raw = F.col(value).cast("string")
    zone = zone_of(df.sparkSession, F.col(zona) if zona else None)
    iso = lambda a, k: F.substring(raw, a, k).try_cast("int")
    is_iso = raw.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    # A text that does not fit is left as it is by the replacement, so it holds no separator.
    parts = let(F.regexp_replace(raw, pattern, replacement), lambda x: F.when(x.contains(_SEP) & ~raw.contains(_SEP), F.split(x, _SEP, -1)))
    free = let(let(let(parts, _components), _bare_numbers), lambda c: _assemble(c, zone))
    return df.withColumn(
        out, F.when(is_iso, F.when(_real(iso(1, 4), iso(6, 2), iso(9, 2)), raw)).otherwise(free)
    )


def normalised(df: DataFrame, tab: str, rec_id: str, fields: list[str], zona: str | None = None) -> DataFrame:
    """tab, rec_id, field, raw, norm_value of every non-null value of the named fields, read in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("raw")) for f in fields]))
    long = df.select(F.lit(tab).alias("tab"), F.col(rec_id).cast("long").alias("rec_id"), *([F.col(zona).alias("zona")] if zona else []), pairs.alias("f"))
    long = long.select("*", "f.field", "f.raw").drop("f").where(F.col("raw").isNotNull())
    return with_norm(long, "raw", "zona" if zona else None).select("tab", "rec_id", "field", "raw", "norm_value")
