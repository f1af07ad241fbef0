import random

import numpy as np

from paperloom.llm import leakage as L
from paperloom.session import load

DOC, ITEM = "doc_id long, text string, tokens string, run_words int", "item_id long, text string, doc_id long"


def test_words():
    assert L.words_of("A-b <!-- PAGE: 3 --> <b>c</b> d2_e") == ["a", "b", "c", "d2", "e"]
    assert L.words_of("docu-\nment x-y\nz") == ["document", "x", "y", "z"] and L.words_of("a-\nb-\nc") == ["abc"]
    assert L.words_of(None) == [] and L.words_of("") == []


def brute(docs, items):
    grams = {}
    for i, t, *_ in items:
        w = L.words_of(t)
        for k in range(len(w) - 11):
            grams.setdefault(tuple(w[k : k + 12]), set()).add(i)
    out = set()
    for d, t, *_ in docs:
        w = L.words_of(t)
        for k in range(len(w) - 11):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + 12]), ())}
    return out


def test_leaks_against_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"kata{i}" for i in range(300)]
    text = lambda n: [rng.choice(vocabulary[:60] if rng.random() < 0.7 else vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(rng.randint(5, 90))), 1) for i in range(30)] + [(30, None, 1), (31, "", 1), (None, "x " * 40, 1)]
    docs = []
    for d in range(400):
        w = text(rng.randint(0, 200))
        if rng.random() < 0.6:
            src = items[rng.randrange(30)][1].split()
            n = rng.choice([7, 11, 12, 13, 20])
            k = rng.randint(0, max(0, len(src) - n))
            at = rng.randint(0, len(w))
            w[at:at] = src[k : k + n]
        t = " ".join(w)
        if rng.random() < 0.3:
            t = t.replace(" ", "\n", 3).replace("kata1 ", "ka-\nta1 ", 2).upper()
        docs.append((d, t, "x", 0))
    docs += [(900, None, "x", 0), (901, "", "x", 0), (902, "kata1 " * 50_000, "x", 0), (None, items[0][1], "x", 0), (docs[0][0] + 1000, docs[0][1], "x", 0)]
    want = brute([d for d in docs if d[0] is not None], [i for i in items if i[0] is not None and i[1]])
    df, it = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)
    got = {(r["doc_id"], r["item_id"]) for r in L.leaks(df, it).collect()}
    assert got == want and len(want) > 50


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(L, "ITEMS_PER_BLOCK", 2)
    items = [(i, " ".join(f"w{i}x{k}" for k in range(20)), 1) for i in range(7)]
    docs = [(i, "awal " + items[i][1] + " akhir", "", 0) for i in range(7)]
    got = {(r["doc_id"], r["item_id"]) for r in L.leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)).collect()}
    assert got == {(i, i) for i in range(7)}


def test_empty(spark):
    none = spark.createDataFrame([], DOC)
    one = spark.createDataFrame([(1, "a " * 30, "", 0)], DOC)
    assert L.leaks(none, spark.createDataFrame([(1, "a " * 30, 1)], ITEM)).count() == 0
    assert L.leaks(one, spark.createDataFrame([], ITEM)).count() == 0


def test_common_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(30):
        a, b = rng.integers(0, 5, 20), rng.integers(0, 5, 15)
        table = np.zeros((21, 16), int)
        for i in range(20):
            for j in range(15):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert L.common_subsequence(a.tolist(), b.tolist()) == table[-1, -1]


def test_runs_on_diagonals():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 2, 400).astype(np.int32), rng.integers(0, 2, 400).astype(np.int32)
    at, bt = rng.integers(0, 392, 3000), rng.integers(0, 392, 3000)
    zero, end = np.zeros(3000, np.int64), np.full(3000, 400)
    got = L.runs_through(a, at, zero, end, b, bt, zero, end)
    for i, j, n in zip(at, bt, got):
        cells = [0 <= i + k < 400 and 0 <= j + k < 400 and a[i + k] == b[j + k] for k in range(1 - L.MIN_RUN, L.WINDOW + L.MIN_RUN - 1)]
        longest = max(len(r) for r in "".join("x" if c else " " for c in cells).split(" "))
        assert n == longest or (n < L.MIN_RUN and longest < L.MIN_RUN)


def reworded(words, rng, every):
    """A copy in which each ``every``-th word or so is another one, is left out, or has one put before it."""
    out = []
    for w in words:
        x = rng.random() * every
        if x < 0.6:
            out.append(rng.choice(words))
        elif x < 0.8:
            continue
        elif x < 1.0:
            out += ["yakni", w]
        else:
            out.append(w)
    return out


def test_report(spark):
    from paperloom.llm.catalog import QUERIES

    assert "p6_report" in QUERIES
    rng = random.Random(4)
    items = [(i, " ".join(f"istilah{rng.randrange(900)}" for _ in range(60 + 30 * i)), 1) for i in range(6)]
    docs = [(i, "awal kata " * 30 + " ".join(w if k % 9 else "lain" for k, w in enumerate(items[i][1].split())) + " akhir" * 20, "", 0) for i in range(6)]
    docs += [(100, items[2][1], "", 0), (101, " ".join(f"istilah{rng.randrange(900)}" for _ in range(400)), "", 0)]
    rows = L.report(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)).collect()
    assert {(r["doc_id"], r["item_id"], r["kind"]) for r in rows} == {(i, i, "paraphrase") for i in range(6)} | {(100, 2, "exact")}
    assert all(r["common_share"] > 0.85 for r in rows if r["kind"] == "paraphrase")


def test_answers_are_checked(spark):
    rng = random.Random(5)
    text = [f"istilah{rng.randrange(900)}" for _ in range(40)]
    items = spark.createDataFrame([(1, " ".join(text), text[7]), (2, " ".join(text), "tiada")], "item_id long, text string, answer string")
    rows = [(1, " ".join(w if k % 9 else f"lain{k}" for k, w in enumerate(text)), "", 0)]
    docs = spark.createDataFrame(rows + [(k, " ".join(f"istilah{rng.randrange(900)}" for _ in range(200)), "", 0) for k in range(2, 40)], DOC)
    assert [(r["doc_id"], r["item_id"]) for r in L.Leakage(docs, items).reworded().collect()] == [(1, 1)]


def test_recall_of_reworded_passages(spark, data):
    """Planted copies with about every seventh word changed, in the project's documents, and all passages against brute force."""
    rng = random.Random(8)
    items = [(r["item_id"], r["text"]) for r in load(spark, data, "eval_items").collect()]
    hosts = [(r["doc_id"], r["text"]) for r in load(spark, data, "documents").where("text is not null").collect()]
    planted = []
    for k, (i, t) in enumerate(items):
        host = L.words_of(hosts[k % len(hosts)][1])
        at = rng.randint(0, len(host))
        planted.append((10_000 + i, " ".join(host[:at] + reworded(L.words_of(t), rng, 7) + host[at:]), "", 0))
    docs = spark.createDataFrame([(d, t, "", 0) for d, t in hosts] + planted, DOC)
    search = L.Leakage(docs, spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in search.reworded().collect()}
    exact = {(r["doc_id"], r["item_id"]) for r in search.exact().collect()}
    assert sum((d, d - 10_000) in got | exact for d, *_ in planted) >= 0.9 * len(planted)
    # Brute force: every passage of every document with every passage of every item, by the same checks but without the latent space.
    every = {(r["doc_id"], r["item_id"]) for r in search.reworded(least=-2.0, probes=10_000).collect()}
    assert got <= every and len(got) >= 0.9 * len(every) > 50


def test_exact_leaks_come_from_the_latent_search(spark, data, monkeypatch):
    docs, items = load(spark, data, "documents"), load(spark, data, "eval_items")
    found = L.leaks(docs, items).count()
    monkeypatch.setattr(L, "latent_words", lambda tokens, idf: np.zeros((L.FEATURES, L.RANK), np.float32))
    assert found > 0 == L.leaks(docs, items).count()


def test_search_against_brute_force():
    rng = np.random.default_rng(3)
    idf, basis = np.ones(L.FEATURES), rng.standard_normal((L.FEATURES, L.RANK)).astype(np.float32)
    items = [(i, rng.integers(0, 400, 60).astype(np.int32)) for i in range(60)]
    ix = L.ItemIndex(items, idf, basis, L.PASSAGE, L.ITEM_STRIDE)
    changed = ix.tokens.copy()
    changed[::7] = rng.integers(0, 400, len(changed[::7]))
    queries = L._vectors(changed, ix.starts, ix.ends, L.PASSAGE, idf, basis)
    near = int((queries @ ix.vectors.T >= 0.85).sum())
    q, w, _ = ix.search(queries, 0.85, L.PASSAGE_PROBES)
    assert len({*zip(q.tolist(), w.tolist())}) == len(q) and len(q) >= 0.9 * near > 300


def test_sums_by_feature(monkeypatch):
    rng = np.random.default_rng(4)
    f, owner, passage = rng.zipf(1.5, 5000) % 900, np.sort(rng.integers(0, 70, 5000)), rng.standard_normal((70, 6)).astype(np.float32)
    want = np.zeros((900, 6))
    np.add.at(want, f, passage[owner])
    rows, sums = L._sums_by_feature(f, owner, passage)
    assert np.abs(want[rows] - sums).max() < 1e-3 and not np.delete(want, rows, axis=0).any()
