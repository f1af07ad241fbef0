"""Orphans and timestamps: brute force, hot keys, nulls, empty tables, clashing columns."""

import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from paperloom.functions.instants import civil_from_days, days_from_civil, with_norm
from paperloom.operators.orphans import existence_deltas, fold_deltas, instant, orphan_report, orphan_rows, orphans_of, reference_deltas
from paperloom.operators.skew import prefix_sum, salted_join

HEADER = "header_id long, created_at string, key string, n_rows int"
DELETION = "header_id long, deleted_at timestamp, restored_at timestamp, reason string"
ROW = "detail_id long, header_id long, _ingested_at string, reason string, tab string"


def orphan_case(spark, rows, headers, deletions, per_task=500_000):
    out = orphan_rows({"t": (spark.createDataFrame(rows, ROW), "detail_id")}, spark.createDataFrame(headers, HEADER), spark.createDataFrame(deletions, DELETION), per_task)
    return sorted((r["rec_id"], r["reason"], r["ingest_month"]) for r in out.collect())


def test_orphans(spark):
    t = lambda d: datetime(2024, 1, d)
    headers = [(1, "2024-01-05T00:00:00+07:00", None, 1), (1, "2024-01-05T00:00:00+07:00", None, 1), (2, "2024-01-01T00:00:00Z", None, 1), (3, "2024-01-01T00:00:00Z", None, 1), (5, None, None, 1), (None, "2024-01-01T00:00:00Z", None, 1)]
    deletions = [(2, t(2), t(3), None), (2, t(4), None, None), (3, t(2), None, None), (3, t(4), t(5), None), (9, t(1), t(2), None), (None, t(1), None, None)]
    rows = [
        (10, 1, "2024-01-04T16:59:59Z", None, None), (11, 1, "2024-01-04T17:00:00Z", None, None), (12, 2, "2024-02-01T00:00:00+07:00", None, None), (13, 3, "2024-02-01T00:00:00Z", None, None),
        (14, 4, "2024-01-01T00:00:00Z", None, None), (15, None, "2024-01-01T00:00:00Z", None, None), (16, 9, None, None, None), (17, 1, None, None, None), (18, 5, "2020-01-01T00:00:00Z", None, None), (14, 4, "2024-01-01T00:00:00Z", None, None),
    ]
    want = [(10, "later", "2024-01"), (12, "deleted", "2024-01"), (14, "missing", "2024-01"), (14, "missing", "2024-01"), (16, "missing", None)]
    assert orphan_case(spark, rows, headers, deletions) == sorted(want, key=lambda x: (x[0], x[1], x[2] or ""))
    assert orphan_case(spark, rows, headers, deletions, per_task=1) == sorted(want, key=lambda x: (x[0], x[1], x[2] or ""))
    assert orphan_case(spark, [], headers, deletions) == []
    assert [r[0] for r in orphan_case(spark, rows, [], [])] == [10, 11, 12, 13, 14, 14, 16, 17, 18]
    report = orphan_report(orphan_rows({"t": (spark.createDataFrame(rows, ROW), "detail_id")}, spark.createDataFrame(headers, HEADER), spark.createDataFrame(deletions, DELETION)))
    assert report.agg(F.sum("n_rows")).first()[0] == 5


def batch(spark, refs, headers, deletions):
    rows = spark.createDataFrame(refs, "key long, t string").select("key", instant(F.col("t")).alias("at"))
    return reference_deltas(rows), existence_deltas(spark.createDataFrame([(h, "2024-01-01T00:00:00Z", None, 1) for h in headers], HEADER), spark.createDataFrame(deletions, DELETION))


def test_batches_fold_like_one(spark):
    t = lambda d: datetime(2024, 1, d)
    refs = lambda *ks: [(k, "2024-01-02T00:00:00Z") for k in ks]
    one = ([*refs(1, 2, 3, None)], [1, 2], [(2, t(2), None, None)])
    # Header 1 is delivered again and deleted, header 2 restored, header 3 delivered at last, 4 only referenced.
    two = ([*refs(1, 4)], [1, 3], [(1, t(3), None, None), (2, t(2), t(4), None)])
    first = fold_deltas(*batch(spark, *one))
    assert {(r["key"], r["existence"], r["transition"]) for r in first.collect()} == {(1, 1, 1), (2, 0, 0), (3, 0, 0)}
    second = fold_deltas(first, *batch(spark, *two))
    assert {(r["key"], r["existence"], r["transition"]) for r in second.collect()} == {(1, 0, -1), (2, 1, 1), (3, 1, 1), (4, 0, 0)}
    assert {tuple(r) for r in orphans_of(second).collect()} == {(1, 2, "deleted"), (4, 1, "missing")}
    again = fold_deltas(second, *batch(spark, [], [1, 2, 3], two[2]))  # nothing new
    assert again.where("transition != 0").count() == 0


def test_any_batches_fold_like_one(spark):
    rng = random.Random(12)
    refs = [(rng.randint(1, 20), "2024-01-02T00:00:00Z") for _ in range(60)]
    headers = [rng.randint(1, 20) for _ in range(20)]
    deletions = [(rng.randint(1, 20), datetime(2024, 1, rng.randint(1, 9)), rng.choice([None, datetime(2024, 2, 1)]), None) for _ in range(30)]
    whole = fold_deltas(*batch(spark, refs, headers, deletions))
    state = None
    for k in range(4):
        part = batch(spark, refs[k::4], headers[k::4], deletions[k::4])
        state = fold_deltas(*([state] if state is not None else []), *part)
    columns = [c for c in whole.columns if c != "transition"]
    assert sorted(map(str, state.select(columns).collect())) == sorted(map(str, whole.select(columns).collect()))


def test_salted_join_is_a_join(spark):
    rng = random.Random(1)
    rows = [(i, 0 if rng.random() < 0.5 else rng.randint(1, 30)) for i in range(2000)] + [(5000, None)]
    df = spark.createDataFrame(rows, "id long, k int")
    side = df.where("k IS NOT NULL AND k % 2 = 0").groupBy("k").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("x", F.col("k") * 10)
    want = sorted((i, k * 10) for i, k in rows if k is not None and k % 2 == 0)
    for per_task in (7, 10**6):
        assert sorted((r["id"], r["x"]) for r in salted_join(df, side, ["k"], F.col("id"), per_task=per_task).collect()) == want
    left = salted_join(df, side, ["k"], F.col("id"), per_task=7, how="left")
    assert left.count() == len(rows) and left.where("x IS NULL").count() == len(rows) - len(want)


def test_prefix_sum(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else None, i % 5) for i in range(500)], "id long, g string, v int")
    got = prefix_sum(df, "g", F.pmod(F.xxhash64("id"), F.lit(1 << 62)), "v", "before", 16).orderBy("g", "before", "id").collect()
    for g in ("a", None):
        part = [r for r in got if r["g"] == g]
        total = sum(r["v"] for r in part)
        assert len(part) == sum(1 for i in range(500) if (i % 3 != 0) == (g == "a"))
        assert max(r["before"] + r["v"] for r in part) == total and min(r["before"] for r in part) == 0


def test_civil_days(spark):
    days = list(range(-150000, 60000, 97))
    df = spark.createDataFrame([(d,) for d in days], "d long")
    y, m, d = civil_from_days(F.col("d"))
    for r in df.select("d", y.alias("y"), m.alias("m"), d.alias("dd"), days_from_civil(y, m, d).alias("back")).collect():
        assert r["back"] == r["d"] and datetime(1970, 1, 1) + timedelta(days=r["d"]) == datetime(r["y"], r["m"], r["dd"])


MONTHS = "Januari Februari Maret April Mei Juni Juli Agustus September Oktober November Desember".split()
ENGLISH = "January February March April May June July August September October November December".split()


def norm(spark, pairs):
    df = spark.createDataFrame([(i, v, z) for i, (v, z) in enumerate(pairs)], "i int, v string, zona string")
    return [r["norm_value"] for r in with_norm(df, "v", "zona").orderBy("i").collect()]


def test_instants_against_python(spark):
    rng = random.Random(5)
    zones = {None: "Asia/Jakarta", "WITA": "Asia/Makassar", "wib": "Asia/Jakarta", "America/New_York": "America/New_York", "Europe/Amsterdam": "Europe/Amsterdam", "UTC": "UTC", "nowhere": "Asia/Jakarta"}
    pairs, want = [], []
    for _ in range(900):
        zona = rng.choice(list(zones))
        tz = ZoneInfo(zones[zona])
        utc = datetime(2023, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=rng.randint(0, 86400 * 900))
        if rng.random() < 0.3:
            utc = datetime(2024, *rng.choice([(3, 31), (10, 27), (3, 10), (11, 3)]), tzinfo=timezone.utc) + timedelta(seconds=rng.randint(-6000, 30000))
        w = utc.astimezone(tz).replace(fold=0)
        iso, day = w.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"), w.strftime("%Y-%m-%d")
        minute = w.replace(second=0).astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        off = utc.astimezone(tz).strftime("%z")
        text, result = rng.choice([
            (w.strftime("%Y-%m-%d %H:%M:%S"), iso), (w.strftime("%d.%m.%Y %H.%M.%S"), iso), (w.strftime("%Y%m%d%H%M%S"), iso), (w.strftime("%d/%m/%Y %H:%M"), minute),
            (f"{w.day} {MONTHS[w.month - 1]} {w.year} {w:%H.%M}", minute), (f"{w.day} {ENGLISH[w.month - 1][:3]} {w.year} {w.hour % 12 or 12}:{w:%M} {'PM' if w.hour > 11 else 'AM'}", minute),
            (str(int(utc.timestamp())), utc.strftime("%Y-%m-%dT%H:%M:%SZ")), (str(int(utc.timestamp() * 1000) + 999), utc.strftime("%Y-%m-%dT%H:%M:%SZ")),
            (utc.astimezone(tz).strftime("%Y-%m-%dT%H:%M:%S.123") + off[:3] + ":" + off[3:], utc.strftime("%Y-%m-%dT%H:%M:%SZ")), (utc.strftime("%Y%m%dT%H%M%SZ"), utc.strftime("%Y-%m-%dT%H:%M:%SZ")),
            (w.strftime("%d-%m-%y"), day), (f"{ENGLISH[w.month - 1][:3]} {w.day}, {w.year}", day), (str((w.date() - datetime(1899, 12, 30).date()).days), day), (f" {day}\t", day), (w.strftime("%Y.%m.%d"), day),
        ])
        pairs.append((text, zona))
        want.append(result)
    got = norm(spark, pairs)
    assert [(p, g, w) for p, g, w in zip(pairs, got, want) if g != w] == []


def test_instants_edges(spark):
    cases = {
        "2024-02-29": "2024-02-29", "2023-02-29": None, "31/04/2024": None, "03/16/2024": "2024-03-16", "16/03/2024": "2024-03-16", "13/13/2024": None, "": None, "lihat lampiran": None, None: None,
        "25 Feb 2025 13:29 PM": None, "12 Feb 2025 12:05 AM": "2025-02-11T17:05:00Z", "2024-13-05": None, "99999": None, "12": None, "x" * 100_000: None, "20240230": None, "2024-01-01 24:00:00": None,
        "05/11/2023 01:39 EDT": "2023-11-05T05:39:00Z", "1 Mei 2024, pukul 07.00 WIT": "2024-04-30T22:00:00Z", "Tue, 13 Aug 2024 21:24:12 +0700": "2024-08-13T14:24:12Z", "45236.5": "2023-11-06T05:00:00Z",
    }
    assert norm(spark, [(k, None) for k in cases]) == list(cases.values())
    assert with_norm(spark.createDataFrame([], "v string, zona string"), "v", "zona").count() == 0
    extra = spark.createDataFrame([("2024-1-2", "a", 1, 2)], "v string, _p string, _y int, norm int")
    assert with_norm(extra, "v", None).first().asDict() == {"v": "2024-1-2", "_p": "a", "_y": 1, "norm": 2, "norm_value": "2024-01-02"}


def test_ranges_of_an_order(spark):
    from pyspark.sql.window import Window

    from paperloom.operators.skew import previous_value, running_total

    rng = random.Random(11)
    df = spark.createDataFrame([(i * 37 % 1000, rng.choice(["a", "a", "b", None]), rng.choice([None, 1, 2, 5])) for i in range(400)], "o long, g string, v long")
    w = Window.partitionBy("g").orderBy("o")
    want = df.withColumn("p", F.lag("v").over(w)).withColumn("t", F.sum(F.coalesce("v", F.lit(0))).over(w)).collect()
    got = running_total(previous_value(df, "g", "o", F.col("v"), "p", width=50), "g", "o", F.coalesce("v", F.lit(0)), "t", width=50).select("o", "g", "v", "p", "t").collect()
    assert sorted(map(str, got)) == sorted(map(str, want))
