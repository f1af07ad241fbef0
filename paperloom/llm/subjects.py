"""Subject areas of documents.

Words get averaged embeddings of the word and its subwords (character n-grams), both hashed; a
sentence is the mean of its words, and each subject has an independent logistic output. Words that
at least MIN_DOCS documents of the fitting sample have are its vocabulary. Any other word, in the
sample or not, is scored by those of its subwords that the vocabulary has, and counts for as much
as their share of its subwords: an inflected form almost wholly, a name that shares nothing not at
all. Headings are no sentences. Training is synchronous: every partition computes the gradient of
its labelled sentences, the gradients are summed by word, the driver takes one Adam step on a
model of fixed size. In the second half of the rounds a labelled document's sentences are relabelled
by the model itself, which frees them from labels that are wrong, missing, or true of another part
of the document; of the sample's unlabelled documents those sentences count that it is sure about.

The sample has at most MAX_LABELLED documents with labels and at most MAX_UNLABELLED without,
chosen alike at every size. Every sentence of every document is then scored; a subject is
assigned where at least ``MIN_SENTENCES`` sentences treat it. Null and empty texts have no
sentences and no subject. Labels are read without case and outer blanks; null labels, labels of
unknown documents and of unknown subjects are left out. A repeated label counts once. Without any
usable label no document gets a subject. Long texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import cut

MIN_SENTENCES = 3
#: Documents with and without labels used for fitting at most, in the order of a hash of the ids.
MAX_LABELLED, MAX_UNLABELLED = 4_500, 1_500
#: Tasks that share the sample, which is bounded.
MAX_TASKS = 16
#: Words that fewer documents of the sample have are not in the vocabulary.
MIN_DOCS = 3
BUCKETS, DIM, SUBWORD = 1 << 14, 16, 5
ROUNDS, RATE, SEED = 24, 0.15, 5
#: The least weight of a sentence's words together that counts as having words.
LEAST_WEIGHT = 0.5
#: A sentence treats a subject if its output is at least this.
THRESHOLD = 0.5

_NOISE = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>\n]{0,200}>", re.S)
_CUT = re.compile(r"([^\W_])[-­‐‑¬][ \t]*\r?\n[ \t]*([^\W_])")
_BREAK = re.compile(r"\n[ \t]*\n|\n(?=[ \t]*(?:[-*+•#|>]|\(?\d{1,3}[.)]|\[|[A-Z][^\n:]{0,40}:))|(?<=[.!?…;])[\"')\]”’*_]*\s+")
_WORD = re.compile(r"[^\W\d_]+")
_HEADING = re.compile(r"^[ \t]*#{1,6}[ \t].*$", re.M)


def sentences_of(text: str | None) -> list[list[str]]:
    """The words of each sentence of a text; numbers are left out."""
    if not text:
        return []
    if "<" in text:
        text = _NOISE.sub(" ", text)
    if "\n" in text:
        text = _CUT.sub(r"\1\2", text)
    text = _HEADING.sub("\n\n", text)
    out = []
    for part in _BREAK.split(text):
        words = _WORD.findall(part.lower())
        if words:
            out.append(words)
    return out


def grams_of(word: str) -> list[str]:
    """A word and its subwords."""
    marked = f"<{word}>"
    return sorted({marked} | {marked[i : i + SUBWORD] for i in range(len(marked) - SUBWORD + 1)})


def _bucket(gram: str) -> int:
    return crc32(gram.encode("utf-8", "replace")) % BUCKETS


def features_of(word: str) -> list[int]:
    """The hashed word and its hashed subwords."""
    return sorted({_bucket(g) for g in grams_of(word)})


def _word_table(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all words in one array, where each word's begin, and how many it has."""
    lists = [features_of(w) for w in words]
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    flat = np.fromiter((f for x in lists for f in x), dtype=np.int64, count=int(sizes.sum()))
    return flat, np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64) if len(sizes) else np.zeros(0, np.int64), sizes


def new_model(n_subjects: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return {
        "emb": (rng.standard_normal((BUCKETS, DIM)) * 0.1).astype(np.float32),
        "out": (rng.standard_normal((DIM, n_subjects)) * 0.3).astype(np.float32),
        "bias": np.full(n_subjects, -2.0, dtype=np.float32),
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Scorer(dict):
    """Word to its row of a table of outputs and weights; words outside the vocabulary are added as they are met.

    The table is emptied to the vocabulary when it holds LIMIT words, which changes time but no result.
    """

    LIMIT = 500_000

    def __init__(self, model: dict):
        self.model, vocabulary = model, list(model["words"])
        flat, starts, counts = _word_table(vocabulary)
        rows = (np.add.reduceat(model["emb"][flat], starts, axis=0) / counts[:, None]) @ model["out"]
        self.known = {g for w in vocabulary for g in grams_of(w)}
        self.base, self.n_known = rows, len(vocabulary)
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.update(self.model["words"])
        self.outputs, self.weights = list(self.base), [1.0] * self.n_known

    def __missing__(self, word: str) -> int:
        grams = grams_of(word)
        shared = [_bucket(g) for g in grams if g in self.known]
        at = len(self.outputs)
        self.outputs.append((self.model["emb"][shared].mean(axis=0) if shared else np.zeros(DIM, np.float32)) @ self.model["out"])
        self.weights.append(len(shared) / len(grams))
        self[word] = at
        return at

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The document number and the subject outputs of every sentence of the texts that has a word with some weight."""
        if len(self.outputs) > self.LIMIT:
            self._reset()
        words, sizes, docs = [], [], []
        for d, text in enumerate(texts):
            for sentence in sentences_of(text):
                words += sentence
                sizes.append(len(sentence))
                docs.append(d)
        if not sizes:
            return np.zeros(0, np.int64), np.zeros((0, len(self.model["bias"])))
        distinct = {w: self[w] for w in set(words)}
        used = np.unique(np.fromiter(distinct.values(), np.int64, len(distinct)))
        place = {w: k for w, k in zip(distinct, np.searchsorted(used, np.fromiter(distinct.values(), np.int64, len(distinct))).tolist())}
        table = np.array([self.outputs[k] for k in used.tolist()])
        weight = np.array([self.weights[k] for k in used.tolist()])
        ids = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
        begin = np.r_[0, np.cumsum(sizes)[:-1]]
        total = np.add.reduceat(weight[ids], begin)
        logits = np.add.reduceat((table * weight[:, None])[ids], begin, axis=0) / np.maximum(total, 1e-9)[:, None] + self.model["bias"]
        some = total >= LEAST_WEIGHT
        return np.array(docs)[some], _sigmoid(logits[some])


def sentence_scores(model: dict, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The document number and the subject outputs of every sentence of the texts that has a known word."""
    if "scorer" not in model:
        model["scorer"] = Scorer(model)
    return model["scorer"].scores(texts)


def _targets(p: np.ndarray, y: np.ndarray, labelled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The model's own labels, and which sentences count."""
    best = p.max(axis=1, keepdims=True)
    own = ((p >= best) & ((p >= 0.5) | ((y > 0) & (p >= 0.35)))).astype(float)
    sure = labelled | (best[:, 0] >= 0.8) | (best[:, 0] < 0.05)
    return own, sure


def _gradient(shared, own_labels: bool, n_subjects: int):
    """Sums of gradients per word, and of the outputs, for one partition's sentences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        flat, starts, counts = _word_table(list(model["words"]))
        vectors = np.add.reduceat(model["emb"][flat], starts, axis=0) / counts[:, None]
        per_word = np.zeros((len(counts), DIM))
        g_out, g_bias, n = np.zeros((DIM, n_subjects)), np.zeros(n_subjects), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            words, sizes = batch.column(0).values.to_numpy(), np.diff(batch.column(0).offsets.to_numpy())
            y = batch.column(1).values.to_numpy().reshape(-1, n_subjects)
            labelled = batch.column(2).to_numpy(zero_copy_only=False)
            begin = np.r_[0, np.cumsum(sizes)[:-1]]
            mean = np.add.reduceat(vectors[words], begin, axis=0) / sizes[:, None]
            p = _sigmoid(mean @ model["out"] + model["bias"])
            use = labelled
            if own_labels:
                y, use = _targets(p, y, labelled)
            error = (p - y) * use[:, None]
            g_out += mean.T @ error
            g_bias += error.sum(axis=0)
            n += int(use.sum())
            back = (error @ model["out"].T) / sizes[:, None]
            order = np.argsort(words, kind="stable")
            runs = np.nonzero(np.r_[True, np.diff(words[order]) > 0])[0]
            per_word[words[order][runs]] += np.add.reduceat(np.repeat(back, sizes, axis=0)[order], runs, axis=0)
        rows = np.nonzero(np.any(per_word, axis=1))[0]
        width = max(DIM, n_subjects)
        table = np.zeros((len(rows) + DIM + 2, width))
        table[: len(rows), :DIM] = per_word[rows]
        rest = table[len(rows) :]
        rest[:DIM, :n_subjects], rest[DIM, :n_subjects], rest[DIM + 1, 0] = g_out, g_bias, n
        keys = np.r_[rows, len(counts) + np.arange(DIM + 2)]
        yield pa.RecordBatch.from_arrays([pa.array(keys), *[pa.array(table[:, k].astype(np.float32)) for k in range(width)]], names=["row", *[f"g{k}" for k in range(width)]])

    return run


def _fitting_sample(docs: DataFrame, labels: DataFrame, subjects: list[str], doc_id: str, text: str, max_labelled: int, max_unlabelled: int) -> DataFrame:
    """words (a list per sentence) and y (null without label) of a bounded number of documents with and without labels."""
    number = F.create_map(*[F.lit(x) for k, s in enumerate(subjects) for x in (s, k)])
    clean = labels.where(F.col(doc_id).isNotNull() & F.col("subject").isNotNull()).select(
        F.col(doc_id).cast("long").alias("id"), F.try_element_at(number, F.lower(F.trim("subject"))).alias("k")
    )
    known = clean.where(F.col("k").isNotNull()).groupBy("id").agg(F.collect_set("k").alias("ks"))
    ids = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("id"))
    told = ids.join(known, "id", "left")
    first = lambda part, n: part.orderBy(F.xxhash64("id"), "id").limit(n)
    chosen = first(told.where(F.col("ks").isNotNull()), max_labelled).unionByName(first(told.where(F.col("ks").isNull()), max_unlabelled))
    hot = F.transform(F.sequence(F.lit(0), F.lit(len(subjects) - 1)), lambda k: F.array_contains("ks", k).cast("double"))
    joined = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t")).join(F.broadcast(chosen), "id").select("t", F.when(F.col("ks").isNotNull(), hot).alias("y"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [sentences_of(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.list_(pa.string()))), pa.array(b.column(1).to_pylist(), pa.list_(pa.float64()))], names=["words", "y"])

    return joined.mapInArrow(split, "words array<array<string>>, y array<double>")


def train(docs: DataFrame, labels: DataFrame, subjects: list[str], doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS, max_labelled: int = MAX_LABELLED, max_unlabelled: int = MAX_UNLABELLED) -> dict | None:
    """Fit the model by synchronous rounds over the fitting sample; None without labels."""
    spark, n_subjects = docs.sparkSession, len(subjects)
    if not n_subjects:
        return None
    sample = cut(_fitting_sample(docs, labels, subjects, doc_id, text, max_labelled, max_unlabelled))
    common = sample.select(F.explode(F.array_distinct(F.flatten("words"))).alias("w")).groupBy("w").count().where(F.col("count") >= MIN_DOCS)
    words = {w: i for i, w in enumerate(sorted(r["w"] for r in common.select("w").collect()))}
    if not words:
        return None
    vocabulary = spark.sparkContext.broadcast(words)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.value.get
        for b in batches:
            ids, ys, labelled = [], [], []
            for document, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for sentence in document or []:
                    known = [i for i in map(get, sentence) if i is not None]
                    if known:
                        ids.append(known)
                        ys.append(y or [0.0] * n_subjects)
                        labelled.append(y is not None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int32())), pa.array(ys, pa.list_(pa.float64())), pa.array(labelled, pa.bool_())], names=["ids", "y", "labelled"])

    sentences = cut(sample.repartition(max(1, min(MAX_TASKS, spark.sparkContext.defaultParallelism))).mapInArrow(numbered, "ids array<int>, y array<double>, labelled boolean"))
    model = new_model(n_subjects) | {"words": words}
    flat, _, counts = _word_table(list(words))
    weights = ("emb", "out", "bias")
    width = max(DIM, n_subjects)
    names = [f"g{k}" for k in range(width)]
    first = {k: np.zeros_like(model[k], dtype=np.float64) for k in weights}
    second = {k: np.zeros_like(model[k], dtype=np.float64) for k in weights}
    for t in range(1, rounds + 1):
        shared = spark.sparkContext.broadcast(model)
        parts = sentences.mapInArrow(_gradient(shared, t > rounds // 2, n_subjects), "row long, " + ", ".join(f"{n} float" for n in names))
        summed = parts.groupBy("row").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
        shared.unpersist()
        table = np.zeros((len(words) + DIM + 2, width))
        table[summed["row"].to_numpy(dtype=np.int64)] = summed[names].to_numpy()
        n = table[-1, 0]
        if not n:
            return None
        g_emb, g_rest = np.zeros((BUCKETS, DIM)), table[len(words) :, :n_subjects]
        np.add.at(g_emb, flat, np.repeat(table[: len(words), :DIM] / counts[:, None], counts, axis=0))
        grads = {"emb": g_emb / n, "out": g_rest[:DIM] / n, "bias": g_rest[DIM] / n}
        model = dict(model)
        for k, g in grads.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.98 * second[k] + 0.02 * g * g
            step = (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.98**t)) + 1e-9)
            model[k] = (model[k] - RATE * np.where(g == 0, 0, step)).astype(np.float32)
    return model


def assigned(docs: DataFrame, model: dict | None, subjects: list[str], doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, min_sentences: int = MIN_SENTENCES) -> DataFrame:
    """doc_id, subject, n_sentences of every subject that enough sentences of a document treat."""
    schema = "doc_id long, subject string, n_sentences int"
    if model is None:
        return docs.sparkSession.createDataFrame([], schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, which, counts = [], [], []
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                keys, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                doc, p = sentence_scores(shared.value, texts)
                treats = np.zeros((len(keys), len(subjects)), dtype=np.int64)
                np.add.at(treats, doc, (p >= threshold).astype(np.int64))
                for d, k in zip(*np.nonzero(treats >= min_sentences)):
                    ids.append(keys[d])
                    which.append(subjects[k])
                    counts.append(int(treats[d, k]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(which, pa.string()), pa.array(counts, pa.int32())], names=["doc_id", "subject", "n_sentences"])

    source = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(run, schema)


def subjects_of(areas: DataFrame) -> list[str]:
    """The subject names in lower case, sorted; the table is small by its nature and checked to be."""
    rows = areas.where(F.col("subject").isNotNull()).select(F.lower(F.trim("subject")).alias("s")).distinct().limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1000 subjects")
    return sorted(r["s"] for r in rows)
