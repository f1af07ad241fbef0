"""Ranks, tags, ingest, reflow, counts by state and page batches: ties, nulls, empty tables, clashing columns."""

import random

from pyspark.sql import functions as F

from paperloom.functions.pagetext import page_batches
from paperloom.operators import jobs as J
from paperloom.operators import learning as N
from paperloom.operators import quality as Q
from paperloom.operators import sheets as S
from paperloom.operators import storage as W
from paperloom.operators import tables as T
from paperloom.operators.skew import ranked


def test_ranks(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, "a", "b", "b"]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k string, rank_ long")
    got = ranked(df, F.desc("k"), "id", out="place", parts=7).orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(1, 301)) and got[0].asDict().keys() == {"id", "k", "rank_", "place"}
    assert [r["id"] for r in got] == [i for i, k, _ in sorted(rows, key=lambda r: (-ord(r[1] or " "), r[0]))]
    assert ranked(df.where("false"), "id").count() == 0


def test_queue_and_releases_in_ranges(spark):
    df = spark.createDataFrame([(3, 1), (1, 1), (2, 0)], "id long, pos long")
    assert {(r["id"], r["ahead"]) for r in J.queue_order(df, "pos", "id").collect()} == {(2, 0), (1, 1), (3, 2)}
    log = spark.createDataFrame([(2_500_000, "c"), (1, "a"), (2, "b")], "id long, version string")
    assert {(r["id"], r["previous_version"]) for r in N.previous_release(log).collect()} == {(1, None), (2, "a"), (2_500_000, "b")}


def test_tail_split_takes_the_last_groups(spark):
    parts = {r["root"]: r["split"] for r in N.tail_split(spark.createDataFrame([(i % 11,) for i in range(50)], "root long")).collect()}
    assert [parts[k] for k in range(11)] == ["train"] * 7 + ["validation"] * 2 + ["test"] * 2


def test_tags(spark):
    df = spark.createDataFrame([(1, "| a | b |\n|---|---|\n| 1 | 2 |", ["x"]), (2, None, ["x"]), (3, "kein", None)], "k long, t string, n array<string>")
    assert {r["k"]: r["t"] for r in T.tagged(df, "k", "t", "n").collect()} == {1: "<!-- sqlite_table: x -->\n| a | b |\n| --- | --- |\n| 1 | 2 |", 2: None, 3: "kein"}


def test_ingest_by_header_or_place(spark):
    df = spark.createDataFrame([("d", 1, ["Saldo", "Nama", "Saldo"], [["1", "x", "2,5"], ["3"]]), ("d", 2, ["?"], [["y"]])], "doc string, page long, headers array<string>, rows array<array<string>>")
    got = {tuple(r) for r in W.ingest(df, [], {"nama": "TEXT", "saldo": "REAL", "tgl": "DATE"}, "doc", "page").collect()}
    assert got == {("d", 1, "x", 2.5, "2,5"), ("d", 1, "", None, ""), ("d", 2, "y", None, "")}


def test_reflow(spark):
    rows = [("a", 1, 2, "text", "lanjut-\nan  baris\nakhir"), ("a", 1, 1, "title", "JUDUL"), ("a", 1, 3, "list", "satu"), ("a", 1, 0, "footnote", "kaki"), ("a", 2, 1, "table", "| x |"), ("a", 3, 1, "text", None), ("a", 4, 1, "text", "x-\nY")]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc string, page int, n int, kind string, text string, status string")
    out = {r["page"]: (r["status"], r["text"]) for r in Q.reflow_regions(df, ["doc", "page"], ["n"], "kind", "text", F.array(F.lit("plain"))).collect()}
    assert out == {1: ("applied", "# JUDUL\n\nlanjutan baris akhir\n\n- satu\n\nkaki"), 2: ("non_text_region", None), 3: ("empty_output", None), 4: ("applied", "x- Y")}
    assert Q.reflow_regions(df, ["doc", "page"], ["n"], "kind", "text", F.array(F.lit("chat_transcript"))).where("status = 'ineligible_spec'").count() == 4


def test_counts_by_state(spark):
    df = spark.createDataFrame([(1, "queued"), (1, "queued"), (1, None), (2, "strange"), (None, "failed")], "b long, s string")
    got = {r["b"]: (r["queued"], r["failed"], r["canceled"]) for r in J.status_counts(df, "b", "s").collect()}
    assert got == {1: (2, 0, 0), 2: (0, 0, 0), None: (0, 1, 0)}


def test_page_batches(spark):
    df = spark.createDataFrame([("d", n, f"isi {n}") for n in (1, 2, 3, 5, 11)] + [("e", 1, None)], "doc string, n int, t string")
    got = {(r["doc"], r["batch"], r["first_page"], r["last_page"], r["context"]) for r in page_batches(df, "doc", "n", "t", 2, 3).collect()}
    assert got == {("d", 0, 1, 2, None), ("d", 1, 3, 3, "i 2"), ("d", 2, 5, 5, "i 3"), ("d", 5, 11, 11, "i 5"), ("e", 0, 1, 1, None)}


def test_artefacts_of_empty_sheets(spark):
    cells = spark.createDataFrame([(1, 1, 1, " ", "s", None), (1, 1, 2, None, "n", "=A1")], "sheet long, row int, col int, text string, kind string, formula string")
    none = spark.createDataFrame([], "sheet long, kind string")
    assert tuple(S.native_artefacts(cells, none, ["sheet"]).first()) == (1, 1, 1, 0, 0)


def test_hot_sources_are_pruned_and_moved(spark):
    rows = [("a", k % 5, k) for k in range(200)] + [(None, 1, 500), ("b", None, 501)]
    table = spark.createDataFrame(rows, "_source_doc string, _page_number int, id long")
    limits = spark.createDataFrame([("a", 2), (None, 0)], "_source_doc string, last_page int")
    assert {r["id"] for r in W.prune_pages(table, limits).collect()} == {i for s, p, i in rows if s != "a" or p <= 2}
    parents = spark.createDataFrame([(1, "x"), (2, "x"), (3, None)], "h long, num string")
    kids = spark.createDataFrame([(k, [1, 2, 3, None][k % 4]) for k in range(40)], "id long, h long")
    assert {(r["id"], r["h"]) for r in W.reparent(kids, parents, "h", "num").collect()} == {(k, [1, 1, 3, None][k % 4]) for k in range(40)}


def test_components_with_hot_keys(spark):
    rng = random.Random(5)
    rows = [(i, "all" if i % 3 == 0 else None, str(rng.randrange(60))) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    root = {i: i for i, *_ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    first = {}
    for i, *ks in rows:
        for n, k in enumerate(ks):
            if k is not None:
                a, b = find(i), find(first.setdefault((n, k), i))
                root[max(a, b)] = min(a, b)
    want = {(i, find(i)) for i in root}
    for per_task in (10, 500_000):
        assert {tuple(r) for r in N.components(df, "id", ["a", "b"], per_task=per_task).collect()} == want
