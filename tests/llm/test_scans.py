import itertools
import random

from paperloom.llm import scans as S
from paperloom.session import load

REGION = "region_id long, source_doc string, page_number int, region_no int, label string, kind string, text string, lines array<string>, doc string, page string"


def regions(spark, rows):
    return spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4], "k", r[5], r[6], "x", "y") for r in rows], REGION)


def marks(spark, rows, **kw):
    out = S.decoded(regions(spark, rows), **kw).where("kind != 'body'").select("region_id", "line_no", "kind").distinct()
    return {tuple(r) for r in out.collect()}


BODY = ["The arbitration award was agreed in", "late October and the contract clause was", "kept by the Records Unit for all of us."]


def pages(n):
    rows = []
    for p in range(1, n + 1):
        rows.append((10 * p, "a.pdf", p, 1, "text", None, ["LAPORAN ZUNTRU", *BODY, *BODY, f"Page {p + 4} of 30"]))
    return rows


def test_marks(spark):
    rows = pages(8)
    rows[3] = (40, "a.pdf", 4, 1, "text", None, ["LAPORAN ZUNTRU", "The arbitratiori award was agr-", "eed in late 0ctober and the well-", "known contract cl@use was kept by", "the Records Unit for all of us. Another award was con-", "Page 8 of 30"])
    rows[4] = (50, "a.pdf", 5, 1, "text", None, ["LAP0RAN ZUNTRU", "tract clause. " + BODY[0], *BODY[1:], "5", *BODY, "Page 9 of 30"])
    rows += [(200 + k, "b.pdf", k, 1, "text", None, ["The well-known agreed contract is a well-known thing.", *BODY]) for k in range(1, 6)]
    want = {(10 * p, 1, "furniture") for p in range(1, 9)} | {(10 * p, 8, "furniture") for p in (1, 2, 3, 6, 7, 8)} | {(40, 6, "furniture"), (50, 9, "furniture")}
    want |= {(40, 2, "hyphen"), (40, 5, "hyphen"), (40, 2, "misread"), (40, 3, "misread"), (40, 4, "misread")}
    assert marks(spark, rows) == want
    assert marks(spark, rows + rows, per_task=2) == want


def test_text(spark):
    rows = pages(6)
    rows[2] = (30, "a.pdf", 3, 1, "text", None, ["LAPORAN ZUNTRU", "The arbitratiori award was agr-", "eed in late October and the contract", "clause.", "Pasal 3", *BODY, "Page 7 of 30"])
    text = {r["region_id"]: r["clean_text"] for r in S.repaired(S.decoded(regions(spark, rows))).collect()}
    assert text[30] == "The arbitration award was agreed in late October and the contract clause.\n\nPasal 3\n\n" + " ".join(BODY)


def test_edges(spark):
    assert marks(spark, []) == set()
    rows = [(1, None, None, None, None, None, None), (2, "a", 1, 1, "text", "", []), (3, "a", None, 1, None, "one\n\ntwo", None), (None, "a", 1, 1, "text", "x", None), (4, "a", 1, 2, "text", None, [None, "", "word-"])]
    rows += [(5, "b", 1, 1, "text", "kata " * 50_000, None), (6, "c", 1, 1, "text", "\n".join(["baris yang sama saja di sini"] * 3000), None)]
    out = S.decoded(regions(spark, rows)).collect()
    assert {r["region_id"] for r in out if r["kind"] == "body"} == {3, 4, 5, 6}
    assert {(r["region_id"], r["line_no"]) for r in out if r["region_id"] == 3 and r["kind"] == "body"} == {(3, 1), (3, 3)}


def test_rules():
    assert S.page_number("- l2 -") == ("l2", False) and S.page_number("Halaman 3 dari 9") == ("3", False) and S.page_number("[iv]") == ("iv", False)
    assert all(S.page_number(x) is None for x in ("2024-25", "12.500", "(4)", "Rp 5.000", "2024.", "Pasal 5", "kata"))
    assert S.title_of("12 | Laporan Zuntru") == ("Laporan Zuntru", "12") and S.title_of("hlm 3  Zuntru")[1] == "3" and S.title_of("Laporan Zuntru    vi")[1] == "vi"
    assert not S.like_title("BAB 12") and not S.like_title("Divisi Keuangan.") and S.like_title("PERATURAN DIREKSI Zuntru")
    assert "award" in S.undone("avvard") and "modern" in S.undone("modem") and S.odd_characters("cl@use") and not S.odd_characters("2024") and not S.odd_characters("A-4853")


def test_against_right_repairs(spark, data):
    folder = data.replace("sf0.001", "sf0.01")
    clean = {r["region_id"]: r["clean_text"] for r in S.repaired(S.decoded(load(spark, folder, "ocr_regions"))).collect()}
    gold = load(spark, folder, "ocr_gold").collect()
    same = sum(clean.get(g["region_id"], "").split() == g["clean_text"].split() for g in gold)
    whole = sum(clean.get(g["region_id"], "") == g["clean_text"] for g in gold)
    assert same >= 0.9 * len(gold) and whole >= 0.75 * len(gold)


def fact(word, n, readings=(), splits=()):
    return {"word": word, "n": n, "readings": [dict(zip(("guess", "guess_n", "edits"), r)) for r in readings], "splits": [dict(zip(("at", "guess_n", "rest_n"), x)) for x in splits]}


def decoder(facts, common, total=20_000):
    return S.Decoder({f["word"]: f for f in facts}, common, total)


def test_splits_and_merges():
    tokens = ["the", "arbi", "tration", "ofthe", "award."]
    common = {"the": 1000, "of": 900, "award": 100, "arbitration": 80}
    facts = [fact("arbi", 1), fact("tration", 1), fact("ofthe", 1, splits=[(2, 900, 1000)])]
    assert " ".join(s["text"] for s in decoder(facts, common).path(tokens)) == "the arbitration of the award."
    assert " ".join(s["text"] for s in decoder(facts[:2], {}).path(tokens)) == " ".join(tokens)


def test_a_merge_may_be_misread():
    facts = [fact("arbi", 1), fact("tratlon", 1), fact("arbitratlon", 0, readings=[("arbitration", 80, 1)])]
    d = decoder(facts, {"the": 1000, "arbitration": 80})
    d.facts["arbitratlon"]["n"] = 1
    assert [(s["text"], s["misread"]) for s in d.path(["the", "arbi", "tratlon"])] == [("the", False), ("arbitration", True)]


def test_readings_compete_by_cost():
    word = lambda *readings: decoder([fact("modem", 2, readings=readings)], {}).path(["(modem)"])[0]["text"]
    assert word() == "(modem)" and word(("modern", 13, 1)) == "(modem)" and word(("modern", 400, 1)) == "(modern)"
    assert word(("modern", 400, 1), ("madam", 900, 2)) == "(modern)" and word(("modern", 40, 1), ("madam", 900, 2)) == "(madam)"


def cheapest(tokens, d):
    """The least cost of all ways to read tokens, tried one after the other."""
    if not tokens:
        return 0.0
    w = tokens[0]
    ways = [c + cheapest(tokens[1:], d) for _, c, _ in d.readings(w, True)]
    for x in d.facts.get(w, {"splits": []})["splits"]:
        ways.append(d.cost(x["guess_n"]) + S.SPLIT_COST + d.cost(x["rest_n"]) + cheapest(tokens[1:], d))
    if len(tokens) > 1 and d.count(w + tokens[1]) and not (w in d.common and tokens[1] in d.common):
        ways += [c + S.MERGE_COST + cheapest(tokens[2:], d) for _, c, _ in d.readings(w + tokens[1], False)]
    return min(ways)


def test_path_is_the_shortest():
    rng = random.Random(6)
    words = ["".join(p) for k in (1, 2, 3, 4) for p in itertools.product("ab", repeat=k)]
    for _ in range(150):
        facts, common = [], {}
        for w in rng.sample(words, 20):
            if rng.random() < 0.4:
                common[w] = rng.randint(3, 900)
            else:
                readings = [(rng.choice(words), rng.randint(1, 900), rng.randint(1, 2)) for _ in range(rng.randint(0, 2))]
                splits = [(k, rng.randint(1, 900), rng.randint(1, 900)) for k in range(1, len(w)) if rng.random() < 0.3]
                facts.append(fact(w, rng.randint(1, 30), readings, splits))
        d = decoder(facts, common, 1000)
        tokens = [rng.choice(words) for _ in range(7)]
        total, costs = 0.0, []
        edges = d.edges
        d.edges = lambda *x: ((i, j, c, s | {"cost": c}) for i, j, c, s in edges(*x))
        total = sum(s["cost"] for s in d.path(tokens))
        assert abs(total - cheapest(tokens, d)) < 1e-9


def test_stretches_lose_nothing():
    rng = random.Random(7)
    for _ in range(300):
        plain = [rng.random() < 0.6 for _ in range(rng.randint(0, 15))]
        covered, last = set(), 0
        for a, b in S.stretches(plain):
            a = max(a, last)
            covered |= set(range(a, b))
            last = b
        need = {j for k, x in enumerate(plain) if not x for j in (k - 1, k, k + 1) if 0 <= j < len(plain)}
        assert covered == need


def test_cut_words_in_any_reading():
    common = {"arbitration": 90, "well": 50, "known": 40}
    d = decoder([fact("well-known", 30), fact("wellknown", 0), fact("wcll-known", 0, [("well-known", 30, 1)])], common)
    assert d.cut_word("arbitra-", "tion.")["text"] == "arbitration." and d.cut_word("well-", "known")["cut"] is False
    assert d.cut_word("(buku-", "buku)") | {"seen": 0, "read": 0} == {"text": "(buku-buku)", "cut": False, "misread": False, "at": 4, "seen": 0, "read": 0}
    step = d.cut_word("wcll-", "known")
    assert step["text"] == "well-known" and step["misread"] and not step["cut"] and d.cut_word("Dasbro¬", "mno")["text"] == "Dasbromno"


def test_merges_into_words_that_were_cut_somewhere(spark, monkeypatch):
    body = [f"perusahaan daerah nomor{k} itu" for k in range(60)] + ["kata perusa-", "haan lain", "oleh perusa haan daerah."]
    rows = [(k, f"d{k // 10}", k % 10, 1, "text", None, [line for line in body[3 * k : 3 * k + 3]]) for k in range(21)]
    text = lambda: " ".join(r["clean_text"] for r in S.repaired(S.decoded(regions(spark, rows))).collect())
    assert "perusa haan" not in text()
    monkeypatch.setattr(S, "COMMON", 1.0)  # no word is common: all are asked for
    assert "perusa haan" not in text()


def test_splits_and_readings_without_limits(spark):
    long, many = "x" * 70 + "ment", "tetetetetetetetetetetetete"
    once = [long.replace("m", "rn").replace("t", "f"), many.replace("e", "c", 2)]
    rows = [(k, f"d{k // 10}", k % 10, 1, "text", None, ["guna harga"] * 12 + [f"{long} {many}"]) for k in range(60)]
    rows += [(100 + k, "e", k, 1, "text", None, ["pada gunaharga itu"]) for k in range(3)] + [(200, "f", 1, 1, "text", None, [" ".join(once)])]
    text = {r["region_id"]: r["clean_text"] for r in S.repaired(S.decoded(regions(spark, rows))).collect()}
    assert text[200] == f"{long} {many}"
    assert [text[100 + k] for k in range(3)] == ["pada guna harga itu"] * 3
