"""Copies hidden by formatting: brute force, hot sets, collisions, anagrams, nulls, empty tables, clashing columns."""

import random
import re
import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from paperloom.llm import copies as K


def brute_copies(rows, keys):
    first, out = {}, set()
    squeeze = lambda s: None if s is None else "".join(c for c in s.lower() if c.isalnum())
    parts = lambda s: None if s is None else tuple(sorted(squeeze(p) for p in re.split(r"[/|:;,·]| - ", s) if squeeze(p)))
    for r in sorted(rows, key=lambda r: r["id"]):
        k = (*(r[c] for c in keys), parts(r["d"]), squeeze(r["ref"]))
        if k in first:
            out.add((first[k], r["id"]))
        else:
            first[k] = r["id"]
    return out


def test_copies_against_brute_force(spark):
    rng = random.Random(7)
    base = [["Sewa gedung", "PT Maju", "No A-12"], ["gedung Sewa", "Maju PT", "No A-12"], ["Gaji", "UD X"], ["Gaji", "UD Y"], ["Gaji", "UD X", "koreksi"]]
    rows = []
    for i in range(1, 700):
        p = list(rng.choice(base if rng.random() < 0.5 else base[:1]))
        if rng.random() < 0.4:
            rng.shuffle(p)
        s = rng.choice([" / ", " | ", " : ", ", ", "; ", " · ", " // ", " - "]).join(f"({x})" if rng.random() < 0.1 else x for x in p)
        s = rng.choice([s, s.upper(), s.replace(" ", "  "), s + ".", s.replace("PT", "P.T."), s.swapcase()])
        rows.append({"id": i, "h": rng.choice([1, 1, 1, 2, None]), "amt": rng.choice([1.0, None]), "d": s if rng.random() > 0.03 else None, "ref": rng.choice(["FT-1-2", "ft 1 2", "#FT/1/2", None, "FT-2-1"])})
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "id long, h int, amt double, d string, ref string")
    want = brute_copies(rows, ["h", "amt"])
    for per_task in (20, 10**6):
        got = {(r["first_id"], r["copy_id"]) for r in K.copy_links(df, "id", ["h", "amt"], "d", "ref", per_task=per_task).collect()}
        assert got == want
    kept = K.collapse_copies(df.withColumn("first_id", F.lit(0)), K.copy_links(df, "id", ["h", "amt"], "d", "ref"), "id")
    assert kept.count() == len(rows) - len(want) and kept.agg(F.sum("n_copies")).first()[0] == len(rows)


def test_copies_edges(spark):
    schema = "id long, h int, d string, ref string, k1 long, first_id long"
    assert K.copy_links(spark.createDataFrame([], schema), "id", ["h"], "d", "ref").count() == 0
    long = "kata / " * 20_000
    rows = [(1, None, None, None, 0, 0), (2, None, None, None, 0, 0), (3, None, "", None, 0, 0), (4, None, " . ", None, 0, 0), (5, 1, long, "a", 0, 0), (6, 1, long.upper(), "A", 0, 0), (None, 1, "x", "y", 0, 0)]
    got = {(r["first_id"], r["copy_id"]) for r in K.copy_links(spark.createDataFrame(rows, schema), "id", ["h"], "d", "ref").collect()}
    assert got == {(1, 2), (3, 4), (5, 6)}


def test_hash_collisions_are_told_apart(spark, monkeypatch):
    keys = K._keys
    monkeypatch.setattr(K, "_keys", lambda salt: keys(salt) if salt else (F.lit(1).cast("long"), F.lit(2).cast("long")))
    df = spark.createDataFrame([(1, "a b", "r"), (2, "A/B", "r"), (3, "c", "r"), (4, "C.", "R"), (5, "d", None)], "id long, d string, ref string")
    assert {(r["first_id"], r["copy_id"]) for r in K.copy_links(df, "id", [], "d", "ref").collect()} == {(1, 2), (3, 4)}


def test_segments():
    assert K.same_segments("a / b / c", "C; (a) - b") and not K.same_segments("ab / c", "c / a / b") and not K.same_segments("a / a / b", "a / b / b")
    assert K.made_of("c b a", "a / b / c") and K.made_of("b a", "a, b") and not K.made_of("a b d", "ab / c") and not K.made_of("a a b", "a / b / b") and K.made_of("aba", "ab / a")
    assert not K.same_segments(None, "") and K.same_segments(None, None) and K.same_written("No B–4405", "no b-4405") and K.same_written("a \U0001f600", "A")


def test_many_equal_segments():
    start = time.time()
    assert K.made_of("kata " * 40, "kata / " * 40) and not K.made_of("kata " * 39 + "kato", "kata / " * 40)
    assert K.same_segments("kata / " * 40 + "x", "x / " + "kata / " * 40)
    assert time.time() - start < 0.1


def test_anagrams_are_no_copies(spark):
    texts = ["Sewa gedung / PT Maju", "gedung Sewa / PT Maju", "Sewa gedung / Maju PT", "weSa gedung / PT Maju", "PT MAJU, sewa gedung", "PT Maju sewa gedung", "sewa / gedung PT Maju"]
    df = spark.createDataFrame([(k, t, "r") for k, t in enumerate(texts)], "id long, d string, ref string")
    assert {(r["first_id"], r["copy_id"]) for r in K.copy_links(df, "id", [], "d", "ref").collect()} == {(0, 4), (0, 5), (0, 6)}
    refs = spark.createDataFrame([(k, "a", r) for k, r in enumerate(["FT-12", "TF-21", "FT 12"])], "id long, d string, ref string")
    assert {(r["first_id"], r["copy_id"]) for r in K.copy_links(refs, "id", [], "d", "ref").collect()} == {(0, 2)}


def test_blocks_of_classes(spark, monkeypatch):
    monkeypatch.setattr(K, "CLASSES_AT_ONCE", 1)
    rng, parts = random.Random(3), ["aa", "bb", "cc", "dd"]
    rows = []
    for k in range(60):
        rng.shuffle(parts)
        rows.append((k, rng.choice([" / ", " "]).join(parts), "r"))
    df = spark.createDataFrame(rows, "id long, d string, ref string")
    assert {(r["first_id"], r["copy_id"]) for r in K.copy_links(df, "id", [], "d", "ref", per_task=5).collect()} == {(0, k) for k in range(1, 60)}


def test_hashes_are_polynomials():
    one = K.hashes(pd.Series(["ab"]), pd.Series(["ab"]))
    p, b = K.PRIME, K._base(4)
    mixed = [int(x) % p for x in K._mix(np.array([ord("a"), ord("b")]), 4)]
    assert int(one["whole2"][0]) >> 31 == (mixed[0] + mixed[1] * b) % p
