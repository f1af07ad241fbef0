"""Mixing sources to target shares of tokens.

Tokens of a source, in a pseudorandom order of its documents, form one stream that is packed
into blocks of fixed length. Output slots are handed out shard by shard: a multinomial draw
gives each shard its number of slots per source. The j-th slot of a source is mapped to epoch
j div n_blocks and, through a keyed permutation of that epoch, to a block. Slots whose epoch
would pass the source's max_repeats stay empty: no block is used more often than that, and the
shares really reached are reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.llm.tokens import VOCABULARY, n_tokens
from paperloom.operators.skew import prefix_sum
from paperloom.session import cut

BLOCK_TOKENS, SHARD_SLOTS, SEED = 512, 1024, 7
#: The table of targets is broadcast; more rows than this are refused.
MAX_TARGETS = 10_000


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of 0..n-1 applied to each index: a balanced Feistel network, walked until it falls inside."""
    out = index.astype(np.uint64)
    n64 = n.astype(np.uint64)
    half = np.ones(len(out), dtype=np.uint64)
    for h in range(1, 32):
        half[n64 > (np.uint64(1) << np.uint64(2 * h))] = np.uint64(h + 1)
    mask = (np.uint64(1) << half) - np.uint64(1)
    todo = np.ones(len(out), dtype=bool)
    while todo.any():
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = x >> h, x & m
        for r in range(4):
            z = right + k + np.uint64((0x9E3779B97F4A7C15 * (r + 1)) & 0xFFFFFFFFFFFFFFFF)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((z ^ (z >> np.uint64(31))) & m)
        out[todo] = (left << h) | right
        todo[todo] = out[todo] >= n64[todo]
    return out.astype(np.int64)


class Mixture:
    """The plan of a mix: ``sources``, ``slots``, ``blocks``, ``report``.

    ``docs`` needs doc_id, text, source; ``targets`` source, target_share, max_repeats. Sources are
    compared without case and outer blanks. Documents of no target source (null ones too) only
    count into the total. Null and empty texts have no tokens and are in no block. A target
    source without documents fills no slot. Ties and repeated rows are kept as they are.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, block: int = BLOCK_TOKENS, shard_slots: int = SHARD_SLOTS, seed: int = SEED):
        self.block, self.shard_slots, self.seed = block, shard_slots, seed
        self.spark = docs.sparkSession
        norm = lambda c: F.lower(F.trim(c))
        self.docs = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), norm(F.col("source")).alias("key"), n_tokens(F.col("text"), vocabulary).alias("tokens")))
        wanted = targets.where(F.col("source").isNotNull()).select("source", norm(F.col("source")).alias("key"), F.col("target_share").alias("target_share"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"))
        rows = wanted.orderBy("key").limit(MAX_TARGETS + 1).collect()
        if len(rows) > MAX_TARGETS:
            raise ValueError(f"more than {MAX_TARGETS} target sources")
        per_key = {r["key"]: r["t"] or 0 for r in self.docs.join(F.broadcast(wanted.select("key").distinct()), "key", "left_semi").groupBy("key").agg(F.sum("tokens").alias("t")).collect()}
        self.total, self.n_docs = self.docs.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count(F.lit(1))).first()
        self.n_slots = -(-self.total // block)
        self.plan = [
            {
                "source": r["source"], "key": r["key"], "target_share": float(r["target_share"] or 0), "max_repeats": int(r["max_repeats"]),
                "tokens": per_key.get(r["key"], 0), "n_blocks": -(-per_key.get(r["key"], 0) // block),
            }
            for r in rows
        ]
        schema = "source string, key string, target_share double, max_repeats int, tokens long, n_blocks long"
        self.sources = self.spark.createDataFrame(pd.DataFrame(self.plan, columns=[c.split()[0] for c in schema.split(", ")]), schema)

    def slots(self) -> DataFrame:
        """shard, key, slot (the running number of the source's slot), epoch and block_no; null block_no where the cap is reached."""
        plan, seed, per_shard, n_slots = self.plan, self.seed, self.shard_slots, self.n_slots
        shares = np.array([p["target_share"] for p in plan], dtype=float)
        n_shards = -(-n_slots // per_shard)
        if not n_shards or not shares.sum():
            return self.spark.createDataFrame([], "shard long, key string, slot long, epoch long, block_no long")
        shares = shares / max(shares.sum(), 1.0)
        rest = max(0.0, 1.0 - shares.sum())

        def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for shard in pdf["id"]:
                    size = min(per_shard, n_slots - int(shard) * per_shard)
                    drawn = np.random.default_rng([seed, int(shard)]).multinomial(size, [*shares, rest])[: len(plan)]
                    out.append(pd.DataFrame({"shard": int(shard), "key": [p["key"] for p in plan], "n": drawn}))
                yield pd.concat(out) if out else pd.DataFrame({"shard": [], "key": [], "n": []})

        counts = self.spark.range(n_shards).mapInPandas(draw, "shard long, key string, n long")
        step = (1 << 62) // n_shards
        firsts = prefix_sum(counts, "key", F.col("shard") * F.lit(step), "n", "first").where("n > 0")
        wide = firsts.withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))

        by_key = {p["key"]: (k, p["n_blocks"], p["max_repeats"]) for k, p in enumerate(plan)}

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                k = pdf["key"].map(lambda x: by_key[x][0]).to_numpy(dtype=np.int64)
                n = pdf["key"].map(lambda x: by_key[x][1]).to_numpy(dtype=np.int64)
                cap = pdf["key"].map(lambda x: by_key[x][2]).to_numpy(dtype=np.int64)
                slot = pdf["slot"].to_numpy(dtype=np.int64)
                safe = np.maximum(n, 1)
                epoch, index = slot // safe, slot % safe
                keyed = np.int64(seed) * 1_000_003 + k * 10_007 + epoch
                block = pd.Series(permute(index, safe, keyed), dtype="Int64")
                block[(epoch >= cap) | (n == 0)] = pd.NA
                yield pd.DataFrame({"shard": pdf["shard"].to_numpy(), "key": pdf["key"].to_numpy(), "slot": slot, "epoch": epoch, "block_no": block})

        return wide.select("shard", "key", "slot").mapInPandas(place, "shard long, key string, slot long, epoch long, block_no long")

    def blocks(self) -> DataFrame:
        """key, block_no, n_tokens and the slices (doc_id, from_token, to_token) of each block, at most ``block`` of them."""
        width = self.block
        known = self.docs.join(F.broadcast(self.sources.select("key").distinct()), "key", "left_semi").where("tokens > 0")
        buckets = max(256, min(65_536, self.n_docs // 500_000))
        placed = prefix_sum(known, "key", F.pmod(F.xxhash64("doc_id", F.lit(self.seed)), F.lit(1 << 62)), "tokens", "at", buckets)
        parts = placed.withColumn("block_no", F.explode(F.sequence(F.floor(F.col("at") / width), F.floor((F.col("at") + F.col("tokens") - 1) / width))))
        lo = F.greatest(F.col("at"), F.col("block_no") * width)
        hi = F.least(F.col("at") + F.col("tokens"), (F.col("block_no") + 1) * width)
        cutup = parts.select("key", "block_no", F.struct((lo - F.col("block_no") * width).alias("at"), "doc_id", (lo - F.col("at")).alias("from_token"), (hi - F.col("at")).alias("to_token")).alias("s"))
        listed = cutup.groupBy("key", "block_no").agg(F.array_sort(F.collect_list("s")).alias("slices"))
        held = F.aggregate("slices", F.lit(0).cast("long"), lambda n, s: n + s["to_token"] - s["from_token"])
        return listed.select("key", "block_no", held.alias("n_tokens"), "slices")

    def mixed(self) -> DataFrame:
        """The filled slots with their blocks: shard, key, slot, epoch, block_no, n_tokens, slices."""
        return self.slots().where(F.col("block_no").isNotNull()).join(self.blocks(), ["key", "block_no"])

    def contents(self) -> DataFrame:
        """The mix itself, one row per slice of a filled slot: shard, key, slot, epoch, block_no, doc_id, from_token, to_token."""
        each = self.mixed().select("shard", "key", "slot", "epoch", "block_no", F.explode("slices").alias("s"))
        return each.select("shard", "key", "slot", "epoch", "block_no", "s.doc_id", "s.from_token", "s.to_token")

    def report(self) -> DataFrame:
        """Per target source: its tokens, capacity, wanted tokens, what the mix holds, the share reached, repeats, and whether it falls short.

        Candidates for falling short come from the draw: sources whose drawn slots, give or take
        six standard deviations, reach the slots that their blocks offer within max_repeats. (A
        source that falls short has no more blocks than its expected slots and max_repeats ask
        for; the draw misses that bound with a chance below 2e-8.) Of a candidate the tokens of
        its packed blocks times max_repeats are held against the wanted tokens.
        """
        used = self.slots().groupBy("key", "block_no").agg(F.count(F.lit(1)).alias("uses"), F.max("epoch").alias("last_epoch"))
        slots = F.col("block_no").isNotNull()
        each = used.join(self.blocks().select("key", "block_no", "n_tokens"), ["key", "block_no"], "full")
        per_key = each.groupBy("key").agg(
            F.coalesce(F.sum("uses"), F.lit(0)).alias("drawn"), F.coalesce(F.sum(F.when(slots, F.col("n_tokens") * F.col("uses"))), F.lit(0)).alias("mixed_tokens"),
            F.max(F.when(slots, F.col("last_epoch"))).alias("last_epoch"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("packed"), F.count("n_tokens").alias("offered"),
        )
        numbers = ("drawn", "mixed_tokens", "packed", "offered")
        filled = self.sources.join(per_key, "key", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in numbers})
        times, wanted = F.col("max_repeats"), F.col("target_share") * F.lit(self.total)
        most = F.col("drawn") + 6 * F.sqrt(F.col("drawn") + 9) + 18  # expected slots are at most this
        near = most + times + 1 >= F.col("offered") * times
        whole = Window.partitionBy(F.lit(1))  # at most MAX_TARGETS rows
        return filled.withColumn("all_mixed", F.sum("mixed_tokens").over(whole)).select(
            "source", "target_share", "max_repeats", "tokens", (F.col("tokens") * times).alias("capacity"), wanted.alias("wanted"), "mixed_tokens",
            F.when(F.col("all_mixed") > 0, F.col("mixed_tokens") / F.col("all_mixed")).otherwise(0.0).alias("actual_share"),
            F.coalesce(F.col("last_epoch") + 1, F.lit(0)).alias("repeats"), (near & (F.col("packed") * times < wanted)).alias("falls_short"),
        )
