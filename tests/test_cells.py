import random
import time

from pyspark.sql import functions as F

from paperloom.functions import cells as C
from paperloom.functions import labels as L
from paperloom.functions import mermaid as M
from paperloom.functions import ordinals as O
from paperloom.functions import pagetext as P


def apply(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_numbers(spark):
    cases = {
        "Rp 50.000": 50000, "1.234": 1234, "1234,56": 1234.56, "1,234,567.89": 1234567.89, "(1.000)": -1000, "-5": -5, "REF001": 1, "Area 1": 1, "0.125": 125, "1.234.56": None,
        ".5": None, "5.": None, "--": None, "N/A": None, "": None, None: None, "x": None, "**12,5**": 12.5, "1.5.2024": None, "2024-01-01": 20240101,
    }
    assert apply(spark, list(cases), C.parse_number) == [None if v is None else float(v) for v in cases.values()]


def test_numbers_against_rules_in_python(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("0123456789.,-() Rp*") for _ in range(rng.randint(0, 9))) for _ in range(600)]

    def model(t):
        x = " ".join(t.split()).strip("*_").strip()
        if x in ("", *C.NULL_TOKENS):
            return None
        neg = (x.startswith("(") and x.endswith(")")) or x.startswith("-")
        d = "".join(c for c in x if c in "0123456789.,")
        if "." in d and "," in d:
            d = d.replace(",", "") if d.rfind(".") > d.rfind(",") else d.replace(".", "").replace(",", ".")
        elif "." in d or "," in d:
            sep = "." if "." in d else ","
            head, tail = d.rsplit(sep, 1)
            bare = head.replace(sep, "")
            d = bare + tail if len(tail) == 3 and bare else f"{head}.{tail}"
        import re

        if not re.fullmatch(r"\d+(\.\d+)?", d):
            return None
        return -float(d) if neg else float(d)

    assert apply(spark, texts, C.parse_number) == [model(t) for t in texts]


def test_dates(spark):
    cases = {
        "15/08/2024": "2024-08-15", "1/8/2024": "2024-08-01", "05.12.2023": "2023-12-05", "10/02/25": "2025-02-10", "2024-05-20": "2024-05-20", "20240201": "2024-02-01",
        "bukan_tanggal": None, "31/02/2024": "2024-02-31", "32/01/2024": None, None: None, "": None, " 1-2.2024 ": "2024-02-01",
    }
    assert apply(spark, list(cases), C.parse_date) == list(cases.values())


def test_rupiah(spark):
    cases = {"Rp 2.580.459.404.371,00": 2580459404371.0, "Rp.448.081.357.000,00": 448081357000.0, "Rp. (63.975.048.861,58)": -63975048861.58, "Rp. NIHIL": None, None: None}
    assert apply(spark, list(cases), C.parse_rupiah) == list(cases.values())


def test_names_and_text(spark):
    assert apply(spark, ["No. Ref", " 2nd  Row ", "", "___", None, "Saldo (Rp)"], C.sanitize_identifier) == ["no_ref", "col_2nd_row", "col_", "col_", None, "saldo_rp"]
    assert apply(spark, [" **a \n b** ", "_x_", None], C.clean_cell) == ["a b", "x", None]
    assert apply(spark, ["Café Déjà", "###", None], C.slug) == ["cafe_deja", "sheet", "sheet"]
    assert apply(spark, ["per 5 Januari 2024", "07/2024 dan 2024-08", "tanpa", None], C.extract_period) == ["Januari 2024", "07/2024", None, None]
    assert apply(spark, ["ab" * 30_000], C.native_tokens) == [20_000]


def test_a1(spark):
    assert apply(spark, [1, 26, 27, 702, 703, 16384, 0], C.column_letter, "int") == ["A", "Z", "AA", "ZZ", "AAA", "XFD", None]
    assert apply(spark, ["A", "zz", "XFD"], C.column_index) == [1, 702, 16384]
    got = apply(spark, ["$A$1:C7", "B2", "C1:A1", "x", None], C.range_bounds)
    assert [tuple(g) if g else None for g in got] == [(1, 7, 1, 3), (2, 2, 2, 2), None, None, None]
    refs = apply(spark, ["=SUM(A1:B2)+'Data 1'!$C$3+\"X9\"+LOG10(5)+No!D4"], lambda c: C.formula_references(c, F.lit("Me"), F.array(F.lit("Me"), F.lit("Data 1"))))
    assert [tuple(r) for r in refs[0]] == [("Me", 1, 2, 1, 2), ("Data 1", 3, 3, 3, 3)]


def test_labels(spark):
    assert apply(spark, ["page-number", "Doc Title", "table_caption", "chart", "weird"], L.layout_kind) == ["footer", "title", "table", "figure", "unknown"]
    assert apply(spark, ["journal,hierarchy", "chat+signature", "", "zzz", "slide chat"], lambda c: F.array_join(L.normalize_specs(c), ",")) == [
        "bilingual_journal,markdown_hierarchy", "chat_transcript,signature_form", "plain", "plain", "presentation_slides,chat_transcript"
    ]
    assert apply(spark, ["Workflow chart", "pinout", "er_diagram", None], lambda c: L.diagram_advice(c)["diagram_type"]) == ["flowchart", "pin_diagram", "er_diagram", "generic_diagram"]
    raw = "<|ref|>text<|/ref|><|det|>[[0, 0, 512, 1024]]<|/det|> hello <|ref|>bad<|/ref|><|det|>[[5,5,5,9]]<|/det|>x"
    got = apply(spark, [raw], lambda c: L.grounded_regions(c, F.lit(100), F.lit(200)))[0]
    assert [(r["label"], r["text"], list(r["bbox_pixels"])) for r in got] == [("text", "hello", [0, 0, 50, 200])]


def test_ordinals(spark):
    df = spark.createDataFrame([("XIV", "bab"), ("L2", "pasal"), ("6A", "pasal"), ("c.", "huruf"), ("Kedua", "bagian"), ("(3)", "ayat"), ("ab", "huruf")], "o string, k string")
    assert [r[0] for r in df.select(O.to_number(F.col("o"), F.col("k"))).collect()] == [14.0, None, 6.01, 3.0, 2.0, 3.0, None]
    pairs = spark.createDataFrame([(6.0, 6.01), (6.01, 6.02), (6.02, 7.0), (6.0, 8.0), (6.0, 6.0)], "a double, b double")
    assert [r[0] for r in pairs.select(O.follows(F.col("a"), F.col("b"))).collect()] == [True, True, True, False, False]


def test_page_texts(spark):
    text = "pre <!-- PAGE: 1 -->\nA\n<!-- SLIDE 2 -->\nB"
    assert [tuple(p) for p in apply(spark, [text], P.split_pages)[0]] == [(1, "A"), (2, "B")]
    assert [tuple(p) for p in apply(spark, [text], lambda c: P.split_pages(c, True))[0]] == [(1, "pre\n\nA"), (2, "B")]
    assert apply(spark, ["", None], P.split_pages) == [[], None]
    assert apply(spark, ["a\nHalaman 2 dari 10\n- 3 -\n1 / 15\n42\nb"], P.drop_page_lines) == ["a\nb"]
    assert apply(spark, ["<think>x</think># T", "x</think>y", "a<think>b", "Mari kita cek\n# Judul\nisi", None], P.strip_thinking) == ["# T", "y", "a", "# Judul\nisi", ""]
    assert apply(spark, ["# Dokumen\n## Real", "**Judul Baik**\nx", "x"], P.title_of) == ["Real", "Judul Baik", None]
    assert apply(spark, ["a\n\na\n\nb\n\na", "a"], P.collapse_blocks) == ["a\n\nb\n\na", "a"]
    assert apply(spark, ["```markdown\n# x\n```", "```mermaid\nx\n```"], P.unfence) == ["# x", "```mermaid\nx\n```"]
    assert apply(spark, ["x <img src=a> ![b](c) y"], P.strip_images) == ["x   y"]
    df = spark.createDataFrame([("d", 1, "kalimat terpotong"), ("d", 2, "lanjut di sini."), ("d", 3, "# Bab")], "k string, n int, c string")
    assert P.stitch(df, "k", "n", "c", markers=False).first()["text"] == "kalimat terpotong lanjut di sini.\n\n# Bab\n"
    assert P.stitch(df, "k", "n", "c").first()["text"].count("<!-- PAGE:") == 3


def test_mermaid():
    code = "```mermaid\ngraph TD\nA[Teks (detail)] --> B{Ya/Tidak}\nA[Teks (detail)] --> B{Ya/Tidak}\n```"
    out = M.sanitize(code)
    assert out.startswith("flowchart TD") and out.count("-->") == 1 and '["Teks (detail)"]' in out and M.problem(out) is None
    assert M.sanitize("no diagram") is None and M.sanitize(None) is None
    assert M.problem("graph TD\nA-->B") == "graph instead of flowchart" and M.problem("") == "empty"
    assert M.problem('flowchart TD\nA["x"]\nA["y"]') == "node with two labels"
    assert M.problem("flowchart TD\nsubgraph S\nS --> A\nend") == "group inside itself"
    assert M.problem(M.sanitize("flowchart TD\nsubgraph S\nS --> A\nend")) is None
    assert "pie" not in M.retain_flowcharts("a\n```mermaid\npie\n```\nb")


def test_ends_of_pages_are_trimmed_like_cells(spark):
    texts = [None, "", "a", "a b", *P.WHITE, P.WHITE, *[w + "a" + w + "b" + w for w in P.WHITE], P.WHITE + "é" + P.WHITE, "\u200ba\u200b", "a\ufeff"]
    assert apply(spark, texts, P._trim) == apply(spark, texts, C.strip)
    assert apply(spark, [w + "a b" + w for w in P.WHITE], P._trim) == ["a b"] * len(P.WHITE)


def test_revisions(spark):
    draft, diagram, long = "isi", "isi\n```mermaid\nflowchart TD\n```", "kata " * 200
    cases = [
        (draft, " baru\u3000\n", "baru"), (draft, "satu\n\nsatu\n\n\ndua", "satu\n\ndua"), (draft, None, draft), (draft, "  ", draft),
        (draft, "Mari kita lihat", draft), (draft, "ATURAN 10", draft), (draft, "MARİ KİTA", "MARİ KİTA"), (draft, "catatan Aturan \n# Judul", "# Judul"),
        (draft, "<think>x</think>baru <!-- PAGE: 3 -->", "baru"), (draft, "<THINK>x</THINK>baru", "baru"), (draft, "x</think>baru", "baru"), (draft, "baru<think>x", "baru"),
        (draft, "```markdown\nLet me check\n# Judul\n```", "# Judul"), (draft, "```\na\n\na\n```", "a"), (draft, "a < b", "a < b"), (draft, "PerbaiKan teKs x", "PerbaiKan teKs x"),
        (diagram, "baru", diagram), (diagram, "baru\n  ```MERMAID\nx\n```", "baru\n  ```MERMAID\nx\n```"), (long, long + long, long), (long, "kata", long), (long, "kata " * 100, ("kata " * 100).strip()), (None, "x", "x"),
    ]
    df = spark.createDataFrame([(i, d, r) for i, (d, r, _) in enumerate(cases)], "i int, d string, r string")
    assert [r[0] for r in df.orderBy("i").select(P.accepted_revision(F.col("d"), F.col("r"))).collect()] == [x for _, _, x in cases]


def test_plain_revisions_take_few_passes(spark):
    kata = F.concat(F.repeat(F.lit("kata "), (F.col("id") % 50).cast("int") * 8), F.lit("akhir."))
    df = spark.range(6000).select(kata.alias("d"), F.concat(kata, F.lit(" Baik.")).alias("r")).localCheckpoint()

    def least(c):
        times = []
        for _ in range(3):
            began = time.perf_counter()
            df.select(c.alias("c")).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        return min(times)

    assert least(P.accepted_revision(F.col("d"), F.col("r"))) < 3 * least(C.strip(F.col("r")))


def test_judged_revisions_are_spread(spark, data):
    from paperloom.plans.pages import judged

    assert judged(spark, data).select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
