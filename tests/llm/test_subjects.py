import numpy as np

from paperloom.llm import subjects as S
from paperloom.session import load

DOC, LABEL = "doc_id long, text string, id string, y string", "doc_id long, subject string, labeller string"


def test_sentences():
    t = "# Judul panjang\nSatu dua tiga. Empat\nlima enam!\n\n- **[08:04] Nama:** Tujuh (Glumsa) delapan."
    words = S.sentences_of(t)
    assert words[0] == ["satu", "dua", "tiga"] and words[1] == ["empat", "lima", "enam"] and words[-1][-3:] == ["tujuh", "glumsa", "delapan"]
    assert S.sentences_of(None) == [] and S.sentences_of("") == [] and S.sentences_of("12 34") == []


def test_accuracy_on_held_out_passages(spark, data):
    folder = data.replace("sf0.001", "sf0.01")
    names = S.subjects_of(load(spark, folder, "subject_areas"))
    model = S.train(load(spark, folder, "documents"), load(spark, folder, "subject_labels"), names)
    items = load(spark, folder, "eval_items").toPandas()
    doc, p = S.sentence_scores(model, list(items.text))
    truth = np.array([names.index(s) for s in items.subject])[doc]
    sure = p.max(axis=1) >= S.THRESHOLD
    assert sure.mean() > 0.6 and (p.argmax(axis=1) == truth)[sure].mean() > 0.93
    found = S.assigned(load(spark, folder, "documents"), model, names)
    assert found.select("doc_id", "subject").distinct().count() == found.count() and found.agg({"n_sentences": "min"}).first()[0] >= 3


def test_edges(spark):
    docs = [(i, "Bola tendang gawang. " * 3 + "Bola lapangan gol. " if i % 2 else "Obat pasien klinik. " * 4, "x", "y") for i in range(40)]
    docs += [(100, None, "x", "y"), (101, "", "x", "y"), (None, "Bola", "x", "y"), (102, "Bola tendang gawang. " * 20_000, "x", "y"), (103, "Bola tendang gawang. Lain.", "x", "y")]
    labels = [(i, " SPORT" if i % 2 else "health", None) for i in range(40)] + [(1, "sport", None), (2, None, None), (None, "sport", None), (3, "astrology", None), (999, "sport", None)]
    d, la = spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, LABEL)
    names = ["health", "sport"]
    out = {(r["doc_id"], r["subject"]) for r in S.assigned(d, S.train(d, la, names), names).collect()}
    assert {(1, "sport"), (2, "health"), (102, "sport")} <= out and not any(k in (100, 101, 103) for k, _ in out)
    none = spark.createDataFrame([], LABEL)
    assert S.assigned(d, S.train(d, none, names), names).count() == 0
    empty = spark.createDataFrame([], DOC)
    assert S.assigned(empty, S.train(empty, la, names), names).count() == 0


def test_unseen_words_are_scored_by_their_subwords(spark):
    docs = [(i, "Bola menendang gawang lapangan. " * 3 if i % 2 else "Obat pasien klinik perawatan. " * 4, "x", "y") for i in range(40)]
    labels = [(i, "sport" if i % 2 else "health", None) for i in range(40)]
    model = S.train(spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, LABEL), ["health", "sport"])
    _, p = S.sentence_scores(model, ["menendangnya gawangnya lapangannya"])
    assert p[0].argmax() == 1 and p[0, 1] > 0.5
    _, q = S.sentence_scores(model, ["perawatannya pasiennya"])
    assert q[0].argmax() == 0 and q[0, 0] > 0.5
    assert not len(S.sentence_scores(model, ["Zxqv Wkrj"])[0])  # nothing shared: no weight
    few = S.Scorer(model)
    few.LIMIT = 1
    a, b = few.scores(["menendangnya gawang"]), few.scores(["menendangnya gawang"])
    assert np.allclose(a[1], b[1])


def test_the_same_rule_at_every_size(spark):
    docs = spark.createDataFrame([(i, "Bola gol. " * 3, "x", "y") for i in range(60)], DOC)
    labels = spark.createDataFrame([(i, "sport", None) for i in range(40)], LABEL)
    count = lambda a, b: S._fitting_sample(docs, labels, ["sport"], "doc_id", "text", a, b).groupBy((S.F.col("y").isNull()).alias("n")).count().collect()
    assert {(r["n"], r["count"]) for r in count(30, 10)} == {(False, 30), (True, 10)}
    assert {(r["n"], r["count"]) for r in count(300, 100)} == {(False, 40), (True, 20)}
