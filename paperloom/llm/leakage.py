"""Evaluation passages that leaked into a corpus, by latent semantic retrieval and word checks.

Documents become lists of hashed words. Inverse document frequencies cover all documents; a
randomised SVD of the TF-IDF passages (one pass that sums A'A applied to a random matrix over
partitions, then a Nystrom solve of bounded size) gives every word a latent vector. Candidates
come only from a cosine search in that space, in an inverted-file index over the items:

* windows of WINDOW words, the corpus's beginning every STRIDE words and the items' at every
  word. On the diagonal of each near pair the longest common run is measured; MIN_RUN equal words
  are a leak. With WINDOW + STRIDE - 1 <= MIN_RUN every such run holds a corpus window equal to an
  item's, whose cosine is 1, so the search misses no exact leak;
* passages of PASSAGE words for reworded items. Of each near pair the longest common subsequence
  with the neighbourhood must hold PARAPHRASE_SHARE of the passage, and the answer check must
  pass: the item's answer occurs there, or, where items have none, at least ANSWER_SHARE of the
  passage's rarest words, which are what a question about it would ask for.

Words are runs of letters and digits without case; comments such as page markers and tags between
them do not count. A word cut by a hyphen at a line end is whole. Null and empty texts have no
words. Documents or items shorter than MIN_RUN words cannot match. Repeated documents each count.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import cut

MIN_RUN, WINDOW, STRIDE = 12, 8, 5
FEATURES, RANK, OVERSAMPLE = 1 << 15, 40, 8
#: Words of a passage, in the decomposition and in the search for reworded items; of the latter one begins every PASSAGE_STRIDE words, the items' every ITEM_STRIDE.
PASSAGE, PASSAGE_STRIDE, ITEM_STRIDE = 32, 16, 4
#: The least cosine of a near window, and of a near passage.
COSINE, PASSAGE_COSINE = 0.95, 0.9
#: Cells searched for a window and for a passage. An equal window always lies in the nearest one.
WINDOW_PROBES, PASSAGE_PROBES = 1, 16
#: The least part of a passage's words that a reworded copy has in order, and of its rarest quarter that it has at all.
PARAPHRASE_SHARE, ANSWER_SHARE = 0.75, 0.5
#: Items searched for at once, and the words they may have together; more items go in more blocks.
ITEMS_PER_BLOCK, WORDS_PER_BLOCK = 5_000, 2_000_000
#: Tokens handled at a time inside a task.
CHUNK = 100_000
SEED = 11

_NOISE = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>\n]{0,200}>", re.S)
_WORD = re.compile(r"[^\W_]+")
_CUT = re.compile(r"(?<=[^\W_])[-­‐‑¬][ \t]*\r?\n\s*(?=[^\W_])")
_CUT_HERE = re.compile(r"[-­‐‑¬][ \t]*\r?\n")


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        value = crc32(word.encode("utf-8", "replace")) & 0x7FFFFFFF
        self[word] = value
        return value


def words_of(text: str | None) -> list[str]:
    """The words of a text; a word cut by a hyphen at a line end is one word."""
    if not text:
        return []
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    text = text.lower()
    if "<" in text:
        text = _NOISE.sub(" ", text)
    if _CUT_HERE.search(text):
        text = _CUT.sub("", text)
    return _WORD.findall(text)


def tokenised(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id and the hashed words of each document that has at least MIN_RUN words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        get = hashes.__getitem__
        for batch in batches:
            ids, tokens = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = words_of(t)
                if len(w) >= MIN_RUN:
                    ids.append(i)
                    tokens.append(np.fromiter(map(get, w), dtype=np.int32, count=len(w)))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in tokens])]).astype(np.int32)
            flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "tokens"])

    source = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(run, "doc_id long, tokens array<int>")


def _flat(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Document ids, token offsets and tokens of parts of a batch with about CHUNK tokens."""
    ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    tokens = lists.values.to_numpy(zero_copy_only=False)
    start = 0
    while start < len(ids):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + CHUNK, side="right")) - 1)
        lo, hi = offsets[start], offsets[end]
        yield ids[start:end], offsets[start : end + 1] - lo, tokens[lo:hi]
        start = end


def _feature(tokens: np.ndarray) -> np.ndarray:
    return ((tokens.astype(np.uint64) * np.uint64(2654435761)) >> np.uint64(7)).astype(np.int64) % FEATURES


def document_frequencies(tokens: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each hashed feature occurs, and the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(FEATURES, dtype=np.int64), 0
        for batch in batches:
            for ids, offsets, toks in _flat(batch):
                docs = np.repeat(np.arange(len(ids)), np.diff(offsets))
                once = np.unique(docs * FEATURES + _feature(toks))
                df += np.bincount(once % FEATURES, minlength=FEATURES)
                n += len(ids)
        seen = np.nonzero(df)[0]
        yield pa.RecordBatch.from_pandas(pd.DataFrame({"feature": np.r_[seen, -1], "df": np.r_[df[seen], n]}), preserve_index=False)

    rows = tokens.mapInArrow(run, "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df")).toPandas()
    out = np.zeros(FEATURES, dtype=np.int64)
    real = rows[rows.feature >= 0]
    out[real.feature] = real.df
    total = rows.loc[rows.feature < 0, "df"]
    return out, int(total.iloc[0]) if len(total) else 0


def _sums_by_feature(f: np.ndarray, owner: np.ndarray, passage: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every feature the sum of its tokens' passages: by a product with counts where a feature is frequent, else one token after the other."""
    seen, inverse, n = np.unique(f, return_inverse=True, return_counts=True)
    out = np.zeros((len(seen), passage.shape[1]), np.float32)
    often = n >= 16
    many, place = often[inverse], np.cumsum(often) - 1
    if often.any():
        cells, wide = place[inverse[many]] * len(passage) + owner[many], max(1, 2_000_000 // len(passage))
        cells.sort()
        blocks = []
        for lo in range(0, int(often.sum()), wide):
            hi = min(lo + wide, int(often.sum()))
            own = cells[np.searchsorted(cells, lo * len(passage)) : np.searchsorted(cells, hi * len(passage))] - lo * len(passage)
            counts = np.bincount(own, minlength=(hi - lo) * len(passage)).reshape(hi - lo, len(passage))
            blocks.append(counts.astype(np.float32) @ passage)
        out[often] = np.concatenate(blocks)
    few = np.flatnonzero(~many)
    if len(few):
        few = few[np.argsort(inverse[few], kind="stable")]
        group = inverse[few]
        runs = np.flatnonzero(np.r_[True, np.diff(group) > 0])
        out[group[runs]] = np.add.reduceat(passage[owner[few]], runs, axis=0)
    return seen, out


def latent_words(tokens: DataFrame, idf: np.ndarray) -> np.ndarray:
    """FEATURES x RANK matrix: the leading right singular vectors of the TF-IDF passages, by randomised SVD."""
    width = RANK + OVERSAMPLE
    omega = np.random.default_rng(SEED).standard_normal((FEATURES, width)).astype(np.float32)
    spark = tokens.sparkSession
    shared = spark.sparkContext.broadcast((idf.astype(np.float32), omega))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, omega = shared.value
        weighted = np.concatenate([omega * idf[:, None], np.zeros((1, width), np.float32)])  # the last row is no word
        total = np.zeros((FEATURES, width), dtype=np.float64)
        for batch in batches:
            for _, offsets, toks in _flat(batch):
                if not len(toks):
                    continue
                f = _feature(toks)
                at = np.arange(len(toks)) - np.repeat(offsets[:-1], np.diff(offsets))
                starts = np.nonzero(at % PASSAGE == 0)[0]
                sizes, padded = np.diff(np.r_[starts, len(toks)]), np.append(f, FEATURES)
                passage = weighted[f[starts]]
                for k in range(1, PASSAGE):
                    passage += weighted[padded[np.where(k < sizes, starts + k, len(f))]]
                rows, sums = _sums_by_feature(f, np.repeat(np.arange(len(starts)), sizes), passage)
                total[rows] += sums * idf[rows][:, None]
        seen = np.nonzero(np.any(total, axis=1))[0]
        cols = {"feature": seen} | {f"y{k}": total[seen, k] for k in range(width)}
        yield pa.RecordBatch.from_pandas(pd.DataFrame(cols), preserve_index=False)

    names = [f"y{k}" for k in range(width)]
    schema = "feature long, " + ", ".join(f"{n} double" for n in names)
    summed = tokens.mapInArrow(run, schema).groupBy("feature").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    y = np.zeros((FEATURES, width))
    y[summed.feature.to_numpy(dtype=np.int64)] = summed[names].to_numpy()
    shared.unpersist()
    # Nystrom: A'A is about Y (Omega'Y)^-1 Y'; its leading eigenvectors span the latent space.
    core = omega.astype(np.float64).T @ y
    core = (core + core.T) / 2
    values, vectors = np.linalg.eigh(core)
    keep = values > max(values.max(initial=0.0), 0.0) * 1e-10
    if not keep.any():
        return np.zeros((FEATURES, RANK), dtype=np.float32)
    u, s, _ = np.linalg.svd((y @ vectors[:, keep]) / np.sqrt(values[keep]), full_matrices=False)
    out = np.zeros((FEATURES, RANK), dtype=np.float32)
    out[:, : min(RANK, u.shape[1])] = u[:, :RANK]
    return out * np.sqrt(np.float32(FEATURES))


def _vectors(tokens: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Unit latent vectors of the spans of at most ``width`` words that begin at ``starts``; words are added in order. A span without any latent word is zero."""
    distinct, back = np.unique(tokens, return_inverse=True)
    f = _feature(distinct)
    table = np.concatenate([(basis[f] * idf[f][:, None]).astype(np.float32), np.zeros((1, basis.shape[1]), np.float32)])
    back = np.append(back, len(distinct))  # positions past the end add nothing
    out = table[back[starts]]
    for k in range(1, width):
        at = starts + k
        out = out + table[back[np.where(at < ends, at, len(tokens))]]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _spans(offsets: np.ndarray, width: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of spans every ``step`` words of each text, the last one flush with its end, and the ends of their texts. A text shorter than ``width`` is one span."""
    starts, ends = [], []
    for a, b in zip(offsets[:-1], offsets[1:]):
        own = np.arange(a, max(a, b - width) + 1, step)
        if b - width > own[-1]:
            own = np.append(own, b - width)
        starts.append(own)
        ends.append(np.full(len(own), b))
    none = np.zeros(0, np.int64)
    return (np.concatenate(starts), np.concatenate(ends)) if starts else (none, none)


class ItemIndex:
    """Spans of the test items in cells around centroids; a span lies in each cell about as near as its nearest."""

    def __init__(self, items: list[tuple[int, np.ndarray]], idf: np.ndarray, basis: np.ndarray, width: int = WINDOW, step: int = 1, answers: dict[int, set[int]] | None = None):
        self.idf, self.basis, self.width = idf.astype(np.float32), basis, width
        self.ids = np.array([i for i, _ in items], dtype=np.int64)
        self.offsets = np.r_[0, np.cumsum([len(t) for _, t in items])].astype(np.int64)
        self.tokens = np.concatenate([t for _, t in items]) if items else np.zeros(0, np.int32)
        self.starts, self.ends = _spans(self.offsets, width, step)
        self.item = np.searchsorted(self.offsets, self.starts, side="right") - 1
        rank = basis.shape[1]
        self.vectors = _vectors(self.tokens, self.starts, self.ends, width, self.idf, basis) if len(self.starts) else np.zeros((0, rank), np.float32)
        n = int(max(1, min(1024, np.sqrt(len(self.starts)))))
        rng = np.random.default_rng(SEED)
        self.centroids = self.vectors[rng.choice(len(self.vectors), n, replace=False)] if len(self.vectors) else np.zeros((1, rank), np.float32)
        for _ in range(5):
            own = np.argmax(self.vectors @ self.centroids.T, axis=1) if len(self.vectors) else np.zeros(0, int)
            sums = np.zeros_like(self.centroids)
            np.add.at(sums, own, self.vectors)
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            self.centroids = np.where(norm > 0, sums / np.maximum(norm, 1e-9), self.centroids).astype(np.float32)
        near = self.vectors @ self.centroids.T
        close = near >= near.max(axis=1, keepdims=True) - 1e-3 if len(self.vectors) else near > 1
        self.cells = [np.nonzero(close[:, c])[0] for c in range(len(self.centroids))]
        self.answers = answers or {}

    def _nearest(self, queries: np.ndarray, probes: int) -> np.ndarray:
        """The ``probes`` nearest cells of each query."""
        near = queries @ self.centroids.T
        return np.argmax(near, axis=1)[:, None] if probes == 1 else np.argpartition(near, -probes, axis=1)[:, -probes:]

    def search(self, queries: np.ndarray, least: float, probes: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query number, item span number and cosine of every pair at or above ``least`` in the query's ``probes`` nearest cells."""
        probes = min(probes, len(self.centroids))
        own = np.concatenate([self._nearest(queries[k : k + 4096], probes) for k in range(0, max(1, len(queries)), 4096)]).ravel()
        order = np.argsort(own, kind="stable")
        edges = np.searchsorted(own[order], np.arange(len(self.centroids) + 1))
        qs, ws, cs = [], [], []
        for c in np.nonzero(np.diff(edges))[0]:
            rows, cell = order[edges[c] : edges[c + 1]] // probes, self.cells[c]
            if not len(cell):
                continue
            sims = queries[rows] @ self.vectors[cell].T
            i, j = np.nonzero(sims >= least)
            qs.append(rows[i])
            ws.append(cell[j])
            cs.append(sims[i, j])
        none = np.zeros(0, np.int64)
        if not qs:
            return none, none, none.astype(np.float32)
        q, w, c = np.concatenate(qs), np.concatenate(ws), np.concatenate(cs)
        if probes > 1:  # an item's span may lie in several of the cells
            once = np.unique(q * len(self.vectors) + w, return_index=True)[1]
            q, w, c = q[once], w[once], c[once]
        return q, w, c


def runs_through(a: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, b: np.ndarray, bt: np.ndarray, blo: np.ndarray, bhi: np.ndarray) -> np.ndarray:
    """Longest run of equal words on the diagonal of each near pair, looked at MIN_RUN - 1 words beyond the window on both sides."""
    best = np.zeros(len(at), np.int32)
    # A run of MIN_RUN words in that reach goes through the window's first or last word.
    hit = (a[at] == b[bt]) | (a[at + WINDOW - 1] == b[bt + WINDOW - 1])
    at, lo, hi, bt, blo, bhi = (x[hit] for x in (at, lo, hi, bt, blo, bhi))
    most, run = np.zeros(len(at), np.int32), np.zeros(len(at), np.int32)
    for k in range(1 - MIN_RUN, WINDOW + MIN_RUN - 1):
        i, j = at + k, bt + k
        inside = (i >= lo) & (i < hi) & (j >= blo) & (j < bhi)
        run = (run + 1) * (inside & (a[np.where(inside, i, 0)] == b[np.where(inside, j, 0)]))
        np.maximum(most, run, out=most)
    best[hit] = most
    return best


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence; one row of the table at a time, as the bits of a number."""
    at: dict[int, int] = {}
    for k, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << k
    whole = (1 << len(b)) - 1
    row = whole
    for x in a:
        if hits := at.get(x):
            hit = row & hits
            row = (row + hit | row - hit) & whole
    return len(b) - row.bit_count()


_EXACT = "doc_id long, item_id long, run_words int, cosine double"
_REWORDED = "doc_id long, item_id long, common_share double, answer_share double, cosine double"


def _exact(index, least: float, probes: int):
    """Pairs of near windows whose diagonal has a run of MIN_RUN words, once per document and item of a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: ItemIndex = index.value
        for batch in batches:
            out = []
            for ids, offsets, toks in _flat(batch):
                starts = np.concatenate([np.arange(a, b - WINDOW + 1, STRIDE) for a, b in zip(offsets[:-1], offsets[1:])])
                if not len(starts) or not len(ix.starts):
                    continue
                doc = np.searchsorted(offsets, starts, side="right") - 1
                queries = _vectors(toks, starts, offsets[doc + 1], WINDOW, ix.idf, ix.basis)
                q, w, c = ix.search(queries, least, probes)
                d, t = doc[q], ix.item[w]
                length = runs_through(toks, starts[q], offsets[d], offsets[d + 1], ix.tokens, ix.starts[w], ix.offsets[t], ix.offsets[t + 1])
                ok = length >= MIN_RUN
                out.append(pd.DataFrame({"doc_id": ids[d[ok]], "item_id": ix.ids[t[ok]], "run_words": length[ok], "cosine": c[ok].astype(float)}).groupby(["doc_id", "item_id"], as_index=False).max())
            every = pd.concat(out) if out else pd.DataFrame({"doc_id": [], "item_id": [], "run_words": [], "cosine": []})
            yield pa.RecordBatch.from_pandas(every.astype({"doc_id": "int64", "item_id": "int64", "run_words": "int32", "cosine": "float64"}), preserve_index=False)

    return run


def _rare(words: list[int], idf: np.ndarray) -> set[int]:
    """The rarest quarter of the words of a passage."""
    distinct = np.unique(np.array(words, dtype=np.int32))
    rarest = np.argsort(-idf[_feature(distinct)], kind="stable")[: max(1, len(distinct) // 4)]
    return set(distinct[rarest].tolist())


def _reworded(index, least: float, probes: int):
    """Pairs of near passages that pass the checks on the longest common subsequence and the answer, the best of each document and item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: ItemIndex = index.value
        passages = [ix.tokens[a : min(a + ix.width, b)].tolist() for a, b in zip(ix.starts, ix.ends)]
        asked = [ix.answers.get(int(ix.ids[t])) or _rare(p, ix.idf) for p, t in zip(passages, ix.item)]
        for batch in batches:
            best: dict[tuple[int, int], tuple[float, float, float]] = {}
            for ids, offsets, toks in _flat(batch):
                starts, ends = _spans(offsets, ix.width, PASSAGE_STRIDE)
                if not len(starts) or not len(ix.starts):
                    continue
                doc = np.searchsorted(offsets, starts, side="right") - 1
                q, w, c = ix.search(_vectors(toks, starts, ends, ix.width, ix.idf, ix.basis), least, probes)
                order, last = np.argsort(q, kind="stable"), -1
                for p in order.tolist():
                    if q[p] != last:
                        last = int(q[p])
                        region = toks[max(offsets[doc[last]], starts[last] - PASSAGE_STRIDE) : min(ends[last], starts[last] + ix.width + PASSAGE_STRIDE)].tolist()
                        there = set(region)
                    passage = passages[w[p]]
                    need = PARAPHRASE_SHARE * len(passage)
                    if sum(map(there.__contains__, passage)) < need:
                        continue
                    answer = asked[w[p]]
                    answered = len(answer & there) / len(answer)
                    if answered < ANSWER_SHARE:
                        continue
                    common = common_subsequence(region, passage)
                    if common >= need:
                        key = (int(ids[doc[last]]), int(ix.ids[ix.item[w[p]]]))
                        best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (common / len(passage), answered, float(c[p])))
            cols = [[k[0] for k in best], [k[1] for k in best], *[[v[n] for v in best.values()] for n in range(3)]]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds)], names=["doc_id", "item_id", "common_share", "answer_share", "cosine"])

    return run


class Leakage:
    """The searches of a corpus for leaked items; ``exact()`` and ``reworded()`` share the words, the frequencies and the latent space.

    ``docs`` needs doc_id and text, ``items`` item_id, text and, if there are any, ``answer``.
    More than ITEMS_PER_BLOCK items are searched for in several blocks over the same words.
    """

    def __init__(self, docs: DataFrame, items: DataFrame):
        self.spark = docs.sparkSession
        answer = F.col("answer").cast("string") if "answer" in items.columns else F.lit(None).cast("string")
        self.items = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text", answer.alias("answer"))
        self.tokens = cut(tokenised(docs, "doc_id", "text"))
        df, n = document_frequencies(self.tokens)
        self.idf = np.log((1 + n) / (1 + df)) + 1.0
        self.basis = latent_words(self.tokens, self.idf)

    def _each_block(self, width: int, step: int, search, schema: str) -> DataFrame:
        n_items, n_chars = self.items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
        n_blocks = max(1, -(-n_items // ITEMS_PER_BLOCK), -(-n_chars // (4 * WORDS_PER_BLOCK)))
        result = None
        for block in range(n_blocks):
            rows = self.items.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block).collect()
            hashes = _Hashes()
            listed = sorted(((r["item_id"], np.array([hashes[w] for w in words_of(r["text"])], dtype=np.int32)) for r in rows), key=lambda x: x[0])
            answers = {r["item_id"]: {hashes[w] for w in words_of(r["answer"])} for r in rows if r["answer"]}
            index = self.spark.sparkContext.broadcast(ItemIndex([(i, t) for i, t in listed if len(t) >= MIN_RUN], self.idf, self.basis, width, step, answers))
            part = self.tokens.mapInArrow(search(index), schema)
            result = part if result is None else result.unionByName(part)
        return result

    def exact(self, least: float = COSINE, probes: int = WINDOW_PROBES) -> DataFrame:
        """doc_id, item_id, run_words, cosine of every document that holds MIN_RUN consecutive words of an item. ``run_words`` is the longest run seen through a near window, at most WINDOW + 2 * MIN_RUN - 2."""
        found = self._each_block(WINDOW, 1, lambda index: _exact(index, least, probes), _EXACT)
        return found.groupBy("doc_id", "item_id").agg(F.max("run_words").alias("run_words"), F.max("cosine").alias("cosine"))

    def reworded(self, least: float = PASSAGE_COSINE, probes: int = PASSAGE_PROBES) -> DataFrame:
        """doc_id, item_id, common_share, answer_share, cosine of every document with a passage that says an item's in the same order, word by word or not."""
        found = self._each_block(PASSAGE, ITEM_STRIDE, lambda index: _reworded(index, least, probes), _REWORDED)
        return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("common_share", "answer_share", "cosine")).alias("best")).select("doc_id", "item_id", "best.*")


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, run_words, cosine of every exact leak."""
    return Leakage(docs, items).exact()


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, kind (``exact`` or ``paraphrase``), run_words, common_share, answer_share of every item that a document holds, word by word or reworded."""
    both = Leakage(docs, items)
    exact, reworded = both.exact().drop("cosine"), both.reworded().drop("cosine")
    return exact.join(reworded, ["doc_id", "item_id"], "full").select(
        "doc_id", "item_id", F.when(F.col("run_words").isNotNull(), "exact").otherwise("paraphrase").alias("kind"), "run_words", "common_share", "answer_share"
    )
