"""Copies hidden by white space, letter case, punctuation and the order of segments.

Characters go through one skip-and-fold table straight into rolling polynomial hashes modulo a
prime: one over each segment of the text whose segments may be reordered, added up so that their
order does not count, and one over each whole text. No canonical text is built. Only rows whose
exact fields occur more than once are hashed at all.

Rows meet in classes on a 128-bit key of the exact fields and the hashes; each row is held against
the first of its class by two pointers that skip and fold, segment by segment, so a collision
cannot merge different records. Of the classes, one row each, those are linked that are written
alike but cut otherwise (equal hash of the whole text) or that are made of another's segments,
such as a text that lost its separators. Linked classes are one set of copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.operators.learning import components
from paperloom.operators.skew import salted_join
from paperloom.session import cut

PRIME = (1 << 31) - 1
_HASHES = ("seg1", "seg2", "whole1", "whole2", "poly1", "poly2", "bag")
SIGNATURE = T.StructType([T.StructField(n, T.LongType()) for n in (*_HASHES, "n_seg")])
#: Characters that part a description into segments; a dash counts only between blanks.
SEGMENT_MARKS = "/|:;,·"
DASHES = "-–—"
#: Classes that a row's class is held against at once.
CLASSES_AT_ONCE = 64


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """For each code point of the basic plane: 0 to skip it, else its folded code point."""
    return np.array([_folded(cp) for cp in range(0x10000)], dtype=np.uint32)


def _folded(cp: int) -> int:
    ch = chr(cp)
    if not ch.isalnum():
        return 0
    low = ch.lower()
    return ord(low) if len(low) == 1 else cp


@lru_cache(maxsize=1)
def _mark_table() -> np.ndarray:
    """1 for a segment mark, 2 for a dash, 3 for white space."""
    table = np.zeros(0x10001, dtype=np.uint8)
    for cp in range(0x10000):
        if chr(cp).isspace():
            table[cp] = 3
    for c in SEGMENT_MARKS:
        table[ord(c)] = 1
    for c in DASHES:
        table[ord(c)] = 2
    return table


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    z = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _base(which: int) -> int:
    return int(_mix(np.array([which]), 7)[0]) % (PRIME - 2) + 2


def _codes(texts: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All code points of the texts in one array, the row of each, and the folded codes."""
    known = texts.fillna("")
    lengths = known.str.len().to_numpy().astype(np.int64)
    points = np.frombuffer("".join(known).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    rows = np.repeat(np.arange(len(known)), lengths)
    folded = fold_table()[np.minimum(points, 0xFFFF)]
    high = np.nonzero(points > 0xFFFF)[0]
    folded[high] = [_folded(int(p)) for p in points[high]]
    return points, rows, folded


def _polynomials(group: np.ndarray, codes: np.ndarray, n: int, which: int) -> np.ndarray:
    """The rolling polynomial hash modulo PRIME of each of ``n`` groups' codes; groups are in order."""
    edges = np.searchsorted(group, np.arange(n + 1), side="left")
    at = np.arange(len(group)) - edges[group]
    base, powers = np.uint64(_base(which)), np.ones(1, np.uint64)
    longest = int(at.max()) + 1 if len(at) else 1
    while len(powers) < longest:  # base ** k by doubling
        powers = np.concatenate([powers, powers * (powers[-1] * base % PRIME) % PRIME])
    terms = (_mix(codes, which) % np.uint64(PRIME)) * powers[at] % np.uint64(PRIME)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    return (total[edges[1:]] - total[edges[:-1]]) % np.uint64(PRIME)


def _pair(group: np.ndarray, codes: np.ndarray, n: int, which: int) -> np.ndarray:
    """Two polynomial hashes in one number."""
    return _polynomials(group, codes, n, 2 * which) << np.uint64(31) | _polynomials(group, codes, n, 2 * which + 1)


def hashes(free: pd.Series, ordered: pd.Series, salt: int = 0) -> pd.DataFrame:
    """Hashes of a text with free segment order and of one with fixed order; null texts hash to null."""
    n, first = len(free), 2 * salt
    points, rows, folded = _codes(free)
    marks = _mark_table()[np.minimum(points, 0x10000)]
    before, after = np.r_[np.uint8(0), marks[:-1]], np.r_[marks[1:], np.uint8(0)]
    cuts = (marks == 1) | ((marks == 2) & (before == 3) & (after == 3))
    kept = folded > 0
    r, c, s = rows[kept], folded[kept], (np.cumsum(cuts) + rows)[kept]
    begins = np.r_[True, np.diff(s) > 0] if len(s) else np.zeros(0, bool)
    seg, seg_row = np.cumsum(begins) - 1, r[begins]  # segments without letters or digits are none
    out = {}
    for k in (1, 2):
        each = _mix(_pair(seg, c, len(seg_row), first + k), 40 + k)
        total = np.zeros(n, np.uint64)
        np.add.at(total, seg_row, each)
        out[f"seg{k}"] = total.view(np.int64)
        out[f"whole{k}"] = _pair(r, c, n, first + k).view(np.int64)
    _, orows, ofolded = _codes(ordered)
    okept = ofolded > 0
    for k in (1, 2):
        out[f"poly{k}"] = _pair(orows[okept], ofolded[okept], n, first + k).view(np.int64)
    characters = np.zeros(n, np.uint64)
    np.add.at(characters, r, _mix(c, 90))
    out["bag"] = characters.view(np.int64)  # brings classes together that may be made of each other's segments
    out["n_seg"] = np.bincount(seg_row, minlength=n)
    frame = pd.DataFrame({name: out[name] for name in (*_HASHES, "n_seg")}).astype("Int64")
    frame.loc[free.isna().to_numpy(), ["seg1", "seg2", "whole1", "whole2", "bag"]] = pd.NA
    frame.loc[ordered.isna().to_numpy(), ["poly1", "poly2"]] = pd.NA
    return frame


def signature(free: str, ordered: str, salt: int = 0) -> Column:
    @F.pandas_udf(SIGNATURE)
    def signed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b in batches:
            yield hashes(a, b, salt)

    return signed(free, ordered)


def _fold(ch: str) -> str:
    return (ch.lower() if len(ch.lower()) == 1 else ch) if ch.isalnum() else ""


def same_written(a: str | None, b: str | None) -> bool:
    """Two pointers run over both texts, skip what does not count, and compare folded characters."""
    if a is None or b is None:
        return a is b
    return a == b or _prefix(a, 0, len(a), b, 0, len(b)) == len(b)


def _prefix(a: str, i: int, i_end: int, b: str, j: int, j_end: int) -> int:
    """Where in b the characters of a[i:i_end] end if b continues with them at j (skipped ones eaten); -1 if not."""
    while True:
        while i < i_end and not a[i].isalnum():
            i += 1
        while j < j_end and not b[j].isalnum():
            j += 1
        if i >= i_end:
            return j
        if j >= j_end or (a[i] != b[j] and _fold(a[i]) != _fold(b[j])):
            return -1
        i, j = i + 1, j + 1


def _segments(t: str) -> list[tuple[int, int, int]]:
    """Hash, start and end of each segment of a text that has letters or digits, in order of the hash."""
    cuts = [i for i, ch in enumerate(t) if ch in SEGMENT_MARKS or (ch in DASHES and 0 < i < len(t) - 1 and t[i - 1].isspace() and t[i + 1].isspace())]
    out = []
    for s, e in zip([0, *(c + 1 for c in cuts)], [*cuts, len(t)]):
        h, any_kept = 0, False
        for ch in t[s:e]:
            if folded := _fold(ch):
                h, any_kept = (h * 1_000_003 + ord(folded)) % ((1 << 61) - 1), True
        if any_kept:
            out.append((h, s, e))
    return sorted(out)


def same_segments(a: str | None, b: str | None) -> bool:
    """Whether two texts have the same segments, each as often, but for what is skipped and their order."""
    if same_written(a, b):
        return True
    if a is None or b is None:
        return False
    pa, pb = _segments(a), _segments(b)
    return len(pa) == len(pb) and all(x[0] == y[0] and _prefix(a, x[1], x[2], b, y[1], y[2]) == y[2] for x, y in zip(pa, pb))


def made_of(text: str, whole: str) -> bool:
    """Whether ``text`` is made of the segments of ``whole``, each used as often as it occurs, in some order.

    Equal segments are interchangeable. A state is a place and what is left; a state that failed is not tried again.
    """
    counts: dict[int, list] = {}
    for h, s, e in _segments(whole):
        counts.setdefault(h, [0, s, e])[0] += 1
    parts = sorted(counts.values(), key=lambda p: p[1] - p[2])
    start = (0, tuple(p[0] for p in parts))
    stack, seen = [start], {start}
    while stack:
        j, left = stack.pop()
        if not any(left):
            if _prefix(whole, 0, 0, text, j, len(text)) == len(text):
                return True
            continue
        for k in range(len(parts) - 1, -1, -1):  # the longest is tried first
            if left[k] and (end := _prefix(whole, parts[k][1], parts[k][2], text, j, len(text))) >= 0:
                state = (end, left[:k] + (left[k] - 1,) + left[k + 1 :])
                if state not in seen:
                    seen.add(state)
                    stack.append(state)
    return False


def _plain(s: pd.Series) -> pd.Series:
    return s.astype(object).where(s.notna(), None)


@F.pandas_udf(T.BooleanType())
def _verified(free: pd.Series, first_free: pd.Series, ordered: pd.Series, first_ordered: pd.Series) -> pd.Series:
    return pd.Series([same_written(c, d) and same_segments(a, b) for a, b, c, d in zip(*map(_plain, (free, first_free, ordered, first_ordered)))], dtype=bool)


@F.pandas_udf(T.BooleanType())
def _written_alike(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([same_written(x, y) for x, y in zip(_plain(a), _plain(b))], dtype=bool)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _made_of_which(text: pd.Series, n_seg: pd.Series, ids: pd.Series, n_segs: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([[int(i) for i, k, whole in zip(*x) if k > n and made_of(t, whole)] for t, n, *x in zip(text, n_seg, ids, n_segs, texts)])


def _exact_keys(exact: list[str]) -> tuple[Column, Column]:
    fields = [x for c in exact for x in (F.col(c).isNull(), F.col(c))] or [F.lit(0)]
    return F.xxhash64(*fields), F.xxhash64(F.lit("second"), *fields)


def _keys(salt: int) -> tuple[Column, Column]:
    s = F.col("_s")
    return (
        F.xxhash64("e1", s["seg1"].isNull(), s["seg1"], s["poly1"].isNull(), s["poly1"]),
        F.xxhash64(F.lit("second"), "e2", s["seg2"], s["poly2"]),
    )


def _classes(rows: DataFrame, per_task: int) -> tuple[DataFrame, DataFrame]:
    """Rows with the smallest id of their class and the hashes of the whole text, and one row per class."""
    keys, done, salt = ["k1", "k2"], None, 0
    while True:
        k1, k2 = _keys(salt)
        signed = rows.withColumn("_s", signature("_free", "_ordered", salt))
        signed = cut(signed.select("id", "e1", "e2", k1.alias("k1"), k2.alias("k2"), F.struct("_s.whole1", "_s.whole2", "_s.poly1", "_s.poly2").alias("w"), "_s.bag", "_s.n_seg", "_free", "_ordered"))
        sets = cut(signed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.min(F.struct("id", F.col("_free").alias("f"), F.col("_ordered").alias("o"))).alias("first")))
        held = salted_join(signed, sets, keys, F.col("id"), per_task=per_task)
        alone = F.col("id") == F.col("first.id")
        held = cut(held.withColumn("ok", alone | _verified("_free", F.col("first.f"), "_ordered", F.col("first.o"))).withColumn("first_id", F.col("first.id")).drop("first", *keys))
        good = held.where("ok")
        done = good if done is None else done.unionByName(good)
        rows = held.where(~F.col("ok")).select("id", "e1", "e2", "_free", "_ordered")
        if rows.isEmpty():
            break
        salt += 1  # only after a collision of 124 bits: what did not fit is hashed again with other bases
    return done, done.where(F.col("id") == F.col("first_id"))


def _links(members: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: classes that are written alike, or one made of the other's segments."""
    whole = ["e1", "e2", "w"]
    known = members.where(F.col("w.whole1").isNotNull())
    forms = known.groupBy(*whole, "first_id").agg(F.min("_free").alias("text"))
    several = forms.groupBy(*whole).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("first_id", "text")).alias("least")).where("n > 1").drop("n")
    alike = forms.join(several, whole)  # one row per class and way of writing; a skewed key is split by the adaptive join
    alike = alike.where((F.col("first_id") > F.col("least.first_id")) & _written_alike("text", F.col("least.text"))).select(F.col("least.first_id").alias("a"), F.col("first_id").alias("b"))

    bucket = ["e1", "e2", "p1", "p2", "bag"]
    each = classes.where(F.col("bag").isNotNull()).select("e1", "e2", F.coalesce(F.col("w.poly1"), F.lit(-1)).alias("p1"), F.coalesce(F.col("w.poly2"), F.lit(-1)).alias("p2"), "bag", "first_id", "n_seg", F.col("_free").alias("text"))
    sizes = each.groupBy(*bucket).agg(F.max("n_seg").alias("most"), F.min("n_seg").alias("fewest"), F.count_if(F.col("n_seg") > 1).alias("wholes")).where("most > 1 AND most > fewest")
    narrowed = cut(each.join(sizes, bucket))
    # The texts with several segments come in blocks of a bounded expected size; each text with fewer meets every block of its bucket.
    n_blocks = F.ceil(F.col("wholes") / CLASSES_AT_ONCE).cast("int")
    wholes = narrowed.where("n_seg > 1").withColumn("block", F.pmod(F.xxhash64("first_id"), n_blocks).cast("int")).groupBy(*bucket, "block").agg(
        F.collect_list(F.struct("first_id", "n_seg", "text")).alias("c"), F.max("n_seg").alias("block_most"))
    texts = narrowed.where("n_seg < most").select(*bucket, "first_id", "n_seg", "text", F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("block"))
    met = texts.join(wholes, [*bucket, "block"]).where("n_seg < block_most")
    made = met.select(F.explode(_made_of_which("text", "n_seg", F.col("c.first_id"), F.col("c.n_seg"), F.col("c.text"))).alias("a"), F.col("first_id").alias("b"))
    return alike.unionByName(made)


def copy_links(df: DataFrame, row_id: str, exact: list[str], free: str, ordered: str, per_task: int = 500_000) -> DataFrame:
    """first_id, copy_id: every row but the first of each set of copies, and the set's smallest id.

    Rows are copies when the ``exact`` columns are equal (null equals null) and ``free`` and
    ``ordered`` are the same but for white space, case and punctuation, ``free`` also but for the
    order of its segments. A text without separators is a copy of one with them if it is made of the
    same segments in some order. A null text is only equal to null. Texts are compared whole.
    ``row_id`` must be unique; rows with a null id are left out. A set of any size is handled: rows of
    a hot set are spread by salt, and no set is collected in one place.
    """
    e1, e2 = _exact_keys(exact)
    base = df.select(F.col(row_id).cast("long").alias("id"), e1.alias("e1"), e2.alias("e2"), F.col(free).alias("_free"), F.col(ordered).alias("_ordered")).where(F.col("id").isNotNull())
    several = cut(base.groupBy("e1", "e2").agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1"))
    rows = salted_join(base, several, ["e1", "e2"], F.col("id"), per_task=per_task)
    members, classes = _classes(rows, per_task)
    links = cut(_links(members, classes).distinct())
    edge = F.concat_ws("-", "a", "b").alias("edge")
    ends = links.select(F.col("a").alias("first_id"), edge).unionByName(links.select(F.col("b").alias("first_id"), edge))
    roots = components(ends, "first_id", ["edge"])
    moved = cut(roots.where("root != first_id").join(members.groupBy("first_id").agg(F.count(F.lit(1)).alias("n_rows")), "first_id"))
    named = salted_join(members.select("id", "first_id"), moved, ["first_id"], F.col("id"), per_task=per_task, how="left")
    return named.select(F.coalesce("root", "first_id").alias("first_id"), F.col("id").alias("copy_id")).where("copy_id > first_id")


def collapse_copies(df: DataFrame, links: DataFrame, row_id: str) -> DataFrame:
    """One row per record with its number of copies: ``df`` without the copies, plus n_copies (itself included)."""
    links = cut(links)
    counts = links.groupBy(F.col("first_id").alias("_first_of_set")).agg((F.count(F.lit(1)) + 1).alias("_size_of_set"))
    kept = df.drop("n_copies").join(links.select(F.col("copy_id").alias(row_id)), row_id, "left_anti")
    joined = kept.join(counts, F.col(row_id) == F.col("_first_of_set"), "left")
    return joined.withColumn("n_copies", F.coalesce("_size_of_set", F.lit(1))).drop("_first_of_set", "_size_of_set")
