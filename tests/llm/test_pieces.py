import random

from pyspark.sql import functions as F

from paperloom.llm import pieces as P

SCHEMA = "preview_id long, chunk_id int, content string, chunk_size int, chunk_overlap int, piece string, n_pieces string"


def cut_items(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return P.split_items(df, ["preview_id", "chunk_id"], "content", "chunk_size", "chunk_overlap", **kw)


def check(rows, out):
    text = {(r[0], r[1]): r for r in rows}
    by = {}
    for r in out:
        by.setdefault((r["preview_id"], r["chunk_id"]), []).append(r)
    assert set(by) == {k for k, r in text.items() if r[2]}
    for k, ps in by.items():
        content, size, overlap = text[k][2], *P._limits(text[k][3], text[k][4])
        ps.sort(key=lambda r: r["piece_no"])
        assert [p["piece_no"] for p in ps] == list(range(1, len(ps) + 1)) and {p["n_pieces"] for p in ps} == {len(ps)}
        assert ps[0]["start_char"] == 0 and ps[-1]["end_char"] == len(content)
        for p in ps:
            assert p["piece"] == content[p["start_char"] : p["end_char"]] and len(p["piece"]) <= size
        for a, b in zip(ps, ps[1:]):
            assert b["start_char"] == a["end_char"] - overlap and b["end_char"] > a["end_char"]
        assert (len(content) > size) == (len(ps) > 1)


def test_round_trip(spark):
    rng = random.Random(2)
    rows = []
    for i in range(120):
        words = ["".join(rng.choice("abcé👍🏽ñ́") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 500))]
        glue = rng.choice([[" "], ["", ""], [" ", ". ", "\n", "\n\n", ", "]])
        rows.append((i, 1, "".join(w + rng.choice(glue) for w in words), rng.choice([None, 1, 2, 17, 60, 300]), rng.choice([None, 0, 3, 50, 400])))
    rows += [(900, 1, None, 10, 0), (901, 1, "", 10, 0), (902, 1, "x" * 50_000, 100, 20), (903, 1, "a b", 10, 0), (904, 1, "y", 0, -5)]
    rows = [r for r in rows if r[0] != 904] + [(904, 1, "y", None, None)]
    check(rows, cut_items(spark, rows).collect())
    check(rows, cut_items(spark, rows + rows).collect())


def test_ranges_of_a_giant(spark):
    rng = random.Random(4)
    text = "".join(rng.choice(["kata ", "kalimat. ", "\n\n", "x", "é", "👍"]) for _ in range(30_000))
    rows = [(1, 1, text, 300, 40), (2, 1, "z" * 40_000, 300, 40), (3, 7, "short", 300, 40), (None, 2, text[:9000], 200, 30), (4, 1, "z" * 9_000 + text[:9_000], 250, 249), (5, 1, "a b" * 3000, 1, 0)]
    out = cut_items(spark, rows + rows[:2], range_bytes=5_000).collect()
    check(rows, out)
    # The pieces are those of the whole read at once.
    pieces = {}
    for r in out:
        pieces.setdefault((r["preview_id"], r["chunk_id"]), []).append((r["start_char"], r["end_char"]))
    for i, k, content, size, overlap in rows:
        assert sorted(pieces[i, k]) == P.cut_positions(content, size, overlap)


def test_ranges_are_spread(spark, monkeypatch):
    """A giant's ranges lie in several tasks, each with no more than its range and halos."""
    text = "kata lain. " * 60_000
    df = spark.createDataFrame([(1, 1, text, 300, 40, "x", "y")], SCHEMA)
    slim = df.select(F.col("preview_id").alias("k"), F.col("content").alias("_c"), F.col("chunk_size").alias("_size"), F.col("chunk_overlap").alias("_overlap"), F.octet_length("content").alias("_n"), F.lit(20_000).cast("long").alias("_step"))
    ranges = P._item_ranges(slim, ["k"])
    assert ranges.count() == 33 and ranges.select(F.spark_partition_id()).distinct().count() >= 4
    assert ranges.agg(F.max(F.length("_data"))).first()[0] <= 20_000 + sum(P._halos(300))


def test_table_follows_every_entry():
    rng = random.Random(9)
    for glue in (" ", "", ". "):
        text = "".join("".join(rng.choice("ab") for _ in range(rng.randint(1, 12))) + glue for _ in range(400))
        data = text.encode()
        r = P.Range(data[:1500], 0, 0, 1000, len(data), 40, 7)
        for entry in range(40):
            t = [x for x in r.table() if x[0] <= entry][-1]
            chain = r.chain(entry)
            assert t[2] == len(chain) and t[1] + t[3] * (entry - t[0]) == chain[-1][1] - 7 - r.n_chars


def test_natural_boundaries():
    text = "Satu dua. " * 12 + "\n\n" + "Tiga empat. " * 12
    first = P.cut_positions(text, 150, 0)[0]
    assert text[first[0] : first[1]].endswith("\n\n")
    marks = "e" + "\u0301" * 300
    assert P.cut_positions(marks, 10, 0)[-1][1] == len(marks)


def test_empty(spark):
    assert cut_items(spark, []).count() == 0


def test_files(spark, tmp_path):
    rng = random.Random(6)
    text = "".join(rng.choice(["kata ", "é👍 ", "akhir.\n\n", "baris\n"]) for _ in range(40_000))
    (tmp_path / "a.txt").write_text(text, encoding="utf-8")
    (tmp_path / "b.txt").write_text("pendek", encoding="utf-8")
    (tmp_path / "c.txt").write_text("")
    out = P.split_files(spark, tmp_path.as_uri(), 500, 30, "*.txt", range_bytes=20_000).orderBy("path", "piece_no").collect()
    a = [r for r in out if r["path"].endswith("a.txt")]
    assert a[0]["start_char"] == 0 and a[-1]["end_char"] == len(text) and len(a) > 100
    for r in a:
        assert r["piece"] == text[r["start_char"] : r["end_char"]] and len(r["piece"]) <= 500
    for p, q in zip(a, a[1:]):
        assert q["start_char"] == p["end_char"] - 30 and q["piece_no"] == p["piece_no"] + 1
    assert [(r["start_char"], r["end_char"]) for r in a] == P.cut_positions(text, 500, 30)
    assert [r["piece"] for r in out if r["path"].endswith("b.txt")] == ["pendek"]
    assert P.file_ranges(spark, tmp_path.as_uri(), "*.txt").select("path").distinct().count() == 2


def test_long_items_count(spark):
    rows = [(1, i, "kata " * 100, 100, 10) for i in range(50)]
    assert cut_items(spark, rows, with_text=False).groupBy("chunk_id").agg(F.max("n_pieces").alias("n")).where("n > 1").count() == 50
