import numpy as np
from pyspark.sql import functions as F

from paperloom.llm import mixture as M
from paperloom.llm.tokens import count_tokens
from paperloom.session import load

DOC, TARGET = "doc_id long, text string, source string, key string, tokens int", "source string, target_share double, max_repeats int, key string"


def test_permutation():
    for n in (1, 2, 3, 7, 64, 65, 1000):
        for key in (0, 5):
            x = np.arange(n)
            assert sorted(M.permute(x, np.full(n, n), np.full(n, key))) == list(range(n))
    big = np.array([0, 1, 2**40], dtype=np.int64)
    assert (M.permute(big, np.full(3, 2**41 + 3), np.full(3, 9)) < 2**41 + 3).all()


def test_counts():
    assert count_tokens(None) == 0 and count_tokens("") == 0 and count_tokens("hello world") == 2
    assert count_tokens("<|endoftext|>") > 1
    assert 0 < count_tokens("a" * 300_000) < 300_000


def mix(spark, docs, targets, **kw):
    return M.Mixture(spark.createDataFrame([(*d, "k", 0) for d in docs], DOC), spark.createDataFrame([(*t, "k") for t in targets], TARGET), **kw)


def test_mix(spark):
    docs = [(i, "kata " * (20 + i % 7), ["big", " BIG ", "Big"][i % 3]) for i in range(600)] + [(1000 + i, "lain " * 30, "small") for i in range(20)]
    docs += [(2000, None, "big"), (2001, "", "small"), (2002, "x y z", None), (2003, "x y", "other"), (2004, "kata " * 20_000, "big")]
    m = mix(spark, docs, [("big", 0.5, 3), ("small", 0.3, 2), ("none", 0.2, 5), (None, 0.0, 1)], block=64, shard_slots=16)
    slices = m.blocks().select("key", "block_no", "n_tokens", F.explode("slices").alias("s")).select("key", "block_no", "n_tokens", "s.*").collect()
    total = {}
    for s in slices:
        total.setdefault(s["doc_id"], []).append((s["from_token"], s["to_token"]))
        assert 0 <= s["at"] < 64 and s["to_token"] - s["from_token"] <= 64
    tokens = {r["doc_id"]: r["tokens"] for r in m.docs.collect()}
    for d, spans in total.items():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] == tokens[d] and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert set(total) == {d for d, n in tokens.items() if n and d not in (2002, 2003)}
    used = m.mixed().groupBy("key", "block_no").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max("n").alias("n")).collect()
    assert all(r["n"] <= {"big": 3, "small": 2}[r["key"]] for r in used)
    report = {r["source"]: r for r in m.report().collect()}
    assert report["small"]["falls_short"] and report["none"]["falls_short"] and not report["big"]["falls_short"]
    assert report["none"]["mixed_tokens"] == 0 and abs(sum(r["actual_share"] for r in report.values()) - 1) < 1e-9
    assert report["small"]["mixed_tokens"] <= report["small"]["capacity"]
    again = mix(spark, docs, [("big", 0.5, 3), ("small", 0.3, 2), ("none", 0.2, 5)], block=64, shard_slots=16)
    key = ["shard", "key", "slot", "block_no"]
    assert sorted(map(tuple, m.slots().select(*key).collect()), key=str) == sorted(map(tuple, again.slots().select(*key).collect()), key=str)


def test_shares_are_reached_when_there_is_enough(spark):
    docs = [(i, "kata " * 50, "a" if i % 2 else "b") for i in range(800)]
    report = {r["source"]: r["actual_share"] for r in mix(spark, docs, [("a", 0.7, 9), ("b", 0.3, 9)], block=32, shard_slots=8).report().collect()}
    assert abs(report["a"] - 0.7) < 0.05


def test_empty(spark):
    assert mix(spark, [], [("a", 1.0, 1)]).report().first()["mixed_tokens"] == 0
    assert mix(spark, [(1, "x", "a")], []).report().count() == 0


def test_short_sources_come_from_the_mix(spark, monkeypatch):
    docs = [(i, "kata " * 50, "a" if i % 4 else "b") for i in range(200)]
    short = lambda: mix(spark, docs, [("a", 0.6, 2), ("b", 0.4, 2), ("b", 0.4, 1)], block=32, shard_slots=8).report().where("falls_short").select("source", "max_repeats")
    found = short()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") >= 2 and "collect_list" in plan
    assert [tuple(r) for r in found.collect()] == [("b", 1)]
    blocks, slots = M.Mixture.blocks, M.Mixture.slots
    monkeypatch.setattr(M.Mixture, "blocks", lambda self: blocks(self).where("key != 'a' or block_no % 8 = 0"))
    assert sorted(tuple(r) for r in short().collect()) == [("a", 2), ("b", 1)]
    monkeypatch.setattr(M.Mixture, "blocks", blocks)
    monkeypatch.setattr(M.Mixture, "slots", lambda self: slots(self).where("key != 'b'"))  # what the draw never reaches is no candidate
    assert short().count() == 0


def test_contents_and_tokens(spark, data):
    """The mix uses every token of a source once before any twice; tokens, capacity and wanted tokens against a plain count."""
    docs, targets = load(spark, data, "documents"), load(spark, data, "mix_targets")
    m = M.Mixture(docs, targets)
    rows, tokens = docs.collect(), {}
    for r in rows:
        key = r["source"].strip().lower() if r["source"] else None
        tokens[key] = tokens.get(key, 0) + count_tokens(r["text"])
    total = sum(tokens.values())
    for r in m.report().collect():
        n = tokens.get(r["source"].strip().lower(), 0)
        assert r["tokens"] == n and r["capacity"] == n * r["max_repeats"] and abs(r["wanted"] - r["target_share"] * total) < 1e-6
        assert r["falls_short"] == (r["capacity"] < r["wanted"])
    used = m.contents().withColumn("n", F.col("to_token") - F.col("from_token"))
    held = {r["key"]: r["n"] for r in used.groupBy("key").agg(F.sum("n").alias("n")).collect()}
    assert held == {r["source"].strip().lower(): r["mixed_tokens"] for r in m.report().where("mixed_tokens > 0").collect()}
    assert used.groupBy("key", "epoch", "doc_id", "from_token").count().where("count > 1").count() == 0
