from pyspark.sql import functions as F

from paperloom.operators import chunks as K
from paperloom.operators import ledger as G
from paperloom.operators import quality as Q
from paperloom.operators import storage as S
from paperloom.operators import tables as T


def test_repair_and_parse():
    broken = "Judul\n| A | B | C |\n|---|---|---|\n| 1 | 2 | 3 |\n\n4 | 5 | 6 |\n| 7 | 8 |  | 9 | x |\n|---|---|---|\n| 10 |\n\nteks"
    t = T.parse_tables(broken)
    assert len(t) == 1 and t[0]["rows"] == [["1", "2", "3"], ["4", "5", "6"], ["7", "8", "x"], ["10", "", ""]] and t[0]["context"] == "Judul"
    two = "| Produk | Warna |\n|---|---|\n| a | b |\n\n| Kota | Cuaca |\n|---|---|\n| c | d |"
    assert [x["headers"] for x in T.parse_tables(two)] == [["Produk", "Warna"], ["Kota", "Cuaca"]]
    assert T.parse_tables("| a | b |\n| c | d |")[0]["headers"] == ["Kolom 1", "Kolom 2"]
    assert T.parse_tables(None) == [] and T.parse_tables("") == [] and T.parse_tables("| a | b |\n|---|---|") == []


def test_html():
    html = "<table><tr><th>POSTING DATE</th><th colspan=2>BALANCE</th></tr><tr><td>01/02<br>2024</td><td>948|649</td><td>x</td></tr></table>"
    t = T.parse_tables(html)[0]
    assert t["headers"] == ["POSTING DATE", "BALANCE", ""] and t["rows"] == [["01/02 2024", "948&#124;649", "x"]]


def test_tags():
    text = "a\n| A | B |\n|---|---|\n| 1 | 2 |"
    tagged = T.tag_tables(text, ["ledger"])
    assert "<!-- sqlite_table: ledger -->\n| A | B |" in tagged and T.parse_tables(tagged)[0]["hint"] == "ledger"
    assert T.tag_tables(tagged, ["other"]).count("sqlite_table") == 1


def test_mapping(spark):
    df = spark.createDataFrame([
        (["Tanggal Transaksi", "Uraian", "No. Ref", "Debet", "Kredit", "Saldo Akhir", "Channel Pembayaran"], None), (["Pihak", "Nama", "Tanda Tangan"], None), (["Produk", "Qty", "Harga"], None), ([], "transaction_details"), ([None, ""], None),
    ], "h array<string>, hint string")
    got = df.select(T.canonical_columns(F.col("h"), T.TRANSACTION_ALIASES).alias("m"), T.route(F.col("h"), F.col("hint"), F.lit(False)).alias("r")).collect()
    assert got[0]["m"]["debit"] == 3 and got[0]["m"]["credit"] == 4 and got[0]["m"]["balance"] == 5 and got[0]["m"]["txn_date"] == 0
    assert [g["r"] for g in got] == ["transaction_details", "document_signatories", None, "transaction_details", None]
    assert df.select(T.unique_names(F.array(F.lit("A b"), F.lit("a_b"), F.lit("A-B")))).first()[0] == ["a_b", "a_b_1", "a_b_2"]


def test_header_info(spark):
    text = "# REKENING KORAN\nNo. Rekening: 987654321\nPeriode: 01/01/2024 - 31/01/2024\nCustomer: PT MAJU MUNDUR SEJAHTERA\nTotal: Rp 1.234.567,89"
    df = spark.createDataFrame([(text, "a.pdf"), ("", "a.pdf"), (None, None), ("teks", "")], "t string, s string")
    a, b, c, d = (r[0] for r in df.select(T.header_info(F.col("t"), F.col("s"))).collect())
    assert (a["doc_type"], a["doc_number"], a["parties"], a["total_amount"]) == ("bank_statement", "987654321", "PT MAJU MUNDUR SEJAHTERA", 1234567.89)
    assert b is None and c is None and len(d["fingerprint_hash"]) == 16 and d["doc_title"] is None


def test_merge_and_upsert(spark):
    df = spark.createDataFrame([(1, 5, "a", None, "x"), (2, 5, "a", "TRX999", None), (3, None, "a", "y", None), (4, None, "a", "z", None)], "id long, h int, k string, ref string, note string")
    got = {r["id"]: (r["ref"], r["note"]) for r in S.merge_duplicates(df, ["h", "k"], "id").collect()}
    assert got == {1: ("TRX999", "x"), 3: ("y", None), 4: ("z", None)}
    assert S.merge_duplicates(df.limit(0), ["h"], "id").count() == 0
    old = spark.createDataFrame([("f", "memo", None), ("g", "x", "keep")], "k string, kind string, note string")
    new = spark.createDataFrame([("f", "sk", "n"), ("h", "y", None)], "k string, kind string, note string")
    assert {tuple(r) for r in S.upsert_coalesce(old, new, "k", keep=("kind",)).collect()} == {("f", "memo", "n"), ("g", "x", "keep"), ("h", "y", None)}
    kids = spark.createDataFrame([(1, 10), (2, 11), (3, None)], "id long, header_id long")
    heads = spark.createDataFrame([(10, "n"), (11, "n"), (12, None)], "header_id long, num string")
    assert {tuple(r) for r in S.reparent(kids, heads, "header_id", "num").collect()} == {(1, 10), (2, 10), (3, None)}


def test_pages(spark):
    t = spark.createDataFrame([("doc.pdf", 1, 100.0), ("doc.pdf", 2, 100.0), ("other.pdf", 1, 100.0)], "_source_doc string, _page_number int, debit double")
    new = spark.createDataFrame([("doc.pdf", 1, 200.0)], t.schema)
    assert {tuple(r) for r in S.replace_pages(t, new, new).collect()} == {("doc.pdf", 1, 200.0), ("doc.pdf", 2, 100.0), ("other.pdf", 1, 100.0)}
    limits = spark.createDataFrame([("doc.pdf", 1)], "_source_doc string, last_page int")
    assert {tuple(r)[:2] for r in S.prune_pages(t, limits).collect()} == {("doc.pdf", 1), ("other.pdf", 1)}


def test_versions(spark, tmp_path):
    root = tmp_path.as_uri()
    a = spark.createDataFrame([(1,)], "x int")
    assert S.current_version(spark, root) == {}
    S.commit_version(spark, root, {"a": a, "b": a})
    S.commit_version(spark, root, {"a": a.unionByName(a)})
    assert S.read_version(spark, root, "a").count() == 2 and S.read_version(spark, root, "b").count() == 1
    before = S.current_version(spark, root)
    bad = a.select(F.raise_error(F.lit("stop")).alias("x"))
    try:
        S.commit_version(spark, root, {"b": bad})
    except Exception:
        pass
    assert S.current_version(spark, root) == before


def test_hash_of_nulls(spark):
    df = spark.createDataFrame([(None, None), ("", 0.0), ("a", 1.5)], "s string, n double")
    h = [r[0] for r in df.select(S.row_hash([(F.col("s"), "text"), (F.col("n"), "number")], F.array(F.col("s")))).collect()]
    assert all(len(x) == 24 for x in h) and len(set(h)) == 3


def test_audit(spark):
    df = spark.createDataFrame([(1, 1, 10, 10, 0, 0), (1, 1, 10, 10, 0, 1), (1, 0, 10, 0, 0, 0), (0, 0, 0, 0, 0, 0), (1, 1, 10, 4, 0, 0)], "a int, b int, c int, d int, e int, f int")
    assert [r[0] for r in df.select(G.audit_status(*map(F.col, "abcdef"))).collect()] == ["PASSED", "WARNING", "WARNING", "PASSED", "WARNING"]
    v = spark.createDataFrame([(4, 4), (3, 4), (2, 4), (0, 0)], "p int, t int").select(G.verdict(F.col("p"), F.col("t")).alias("v")).collect()
    assert [(r["v"]["confidence"], r["v"]["status"]) for r in v] == [(1.0, "verified"), (0.56, "needs_revision"), (0.38, "rejected"), (0.0, "rejected")]
    vals = spark.createDataFrame([("1.234,5",), ("x",), (None,)], "v string").select(G.canonical_value(F.col("v"), "number")).collect()
    assert [r[0] for r in vals] == ["1.23450000000e+03", "x", None]


def test_chunks(spark):
    text = "# A\n" + "kata " * 300 + "\n\n## B\n" + "kata " * 10
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "x" * 2500)], "k long, t string")
    out = K.preview_chunks(df, "k", "t", 400, 50).collect()
    assert all(0 < r["char_count"] == len(r["content"]) <= 400 for r in out) and {r["k"] for r in out} == {1, 4}
    assert [r["content"] for r in out if r["k"] == 1][-1].startswith("## B")


def test_trust(spark):
    df = spark.createDataFrame([("Ini teks yang baik sekali", 1, "ini teks yang baik sekali"), ("x", 0, None), (None, None, None), ("a\na\na\na\nb", 1, "lain sama sekali berbeda 123")], "t string, n int, native string")
    got = Q.assessed(df, "t", "n", "native").collect()
    assert [r["trust_level"] for r in got] == ["high", "low", "low", "low"] and got[0]["risk_flags"] == [] and "too_short" in got[1]["risk_flags"] and "repetitive_output" in got[3]["risk_flags"]
    img = spark.createDataFrame([(1, bytearray([0, 255, 255, 255]), 2), (2, bytearray([255] * 4), 2)], "k int, p binary, w int")
    assert [tuple(r) for r in Q.ink_signals(img, "k", "p", "w").orderBy("k").collect()] == [(1, 0.25, 1.0, 1.0), (2, 0.0, 0.0, 0.0)]
