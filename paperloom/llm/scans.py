"""Repair of text from scanned pages.

Regions are grouped by page, a bounded unit; evidence from the whole document (running titles
on two or more pages, the distance between printed and real page numbers) and from the whole
corpus (how often each word occurs) comes by joins on keys, so a document of any size is worked
on by many tasks. Page furniture is marked first. What is left of a page is one stream of
characters in which line ends are blanks. It is decoded by a shortest path over places in that
stream: an edge is a word from one place to another, which may

* stand as it is, or be read through one or two character confusions, each reading an edge of its own;
* end inside a run of characters, so that two words come out of what was run together;
* go on after a wrong blank;
* go on in the next line after a hyphen, which either came from the cut or belongs to the word,
  again with every reading of both.

Costs are negative logarithms of shares of the corpus and of the channel: a reading competes with
the form as it stands, whose own occurrence is left out of its count. There are no least counts.
Where nothing but the plain word can be meant all paths meet, so the path is sought only in the
stretches between such places; it is the shortest over the whole page. Paragraph boundaries are
chosen by dynamic programming over line ends.

Words are counted over all pages. The neighbouring page is the one with the next page number;
across a missing page nothing is joined.

A region delivered again unchanged counts once. Where lines is null or empty, text split at
newlines holds the lines; a region with neither has none. Blank lines end a paragraph. Rows
without document or page number are pages of their own; rows without region_id are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators.skew import salted_join
from paperloom.session import cut

HYPHENS = "-­‐‑¬"
PUNCTUATION = ".,;:()[]\"“”'!?"
# What scanning turns characters into (true, seen).
CONFUSIONS = (
    ("a", "@"), ("e", "c"), ("t", "f"), ("i", "l"), ("n", "ri"), ("l", "1"), ("u", "ii"), ("s", "5"), ("o", "0"), ("g", "9"), ("m", "rn"),
    ("k", "lc"), ("d", "cl"), ("b", "6"), ("h", "li"), ("p", "þ"), ("w", "vv"), ("rn", "m"), ("fi", "ﬁ"), ("S", "$"), ("B", "8"), ("D", "0"),
    ("O", "0"), ("G", "6"), ("I", "l"), ("I", "1"), ("Z", "2"), ("E", "C"), ("T", "F"),
)
PAGE_WORDS = ("page", "hal", "hal.", "halaman", "hlm", "hlm.", "p.", "pg.", "p")
OF_WORDS = ("of", "dari", "/")
HEADING_WORDS = ("pasal", "bab", "butir", "bagian", "section", "chapter", "article", "part", "ayat", "rp", "lampiran", "angka", "huruf", "no", "no.", "nomor")
FURNITURE_LABELS = ("header", "footer", "footnote", "paragraph_title", "unknown", "number", "page_number", "header_image", "footer_image")

#: Costs of reading through one and two confusions, of a blank that is missing, of one too many, and of keeping a hyphen at a line end.
EDIT_COSTS = (2.5, 4.0)
SPLIT_COST, MERGE_COST, COMPOUND_COST = 4.0, 3.0, 0.5
#: How often a word counts to occur besides its occurrences.
UNSEEN = 0.15
#: A word with at least this share of all words, and three occurrences, is common. At most 1/COMMON words are: a list of bounded size.
COMMON = 1e-5

_NUMBER = re.compile(r"[0-9lIiOoSsBbgZz|]{1,4}|[ivxlcdmIVXLCDM1]{1,7}")
_ROMAN = re.compile(r"[ivxlcdm1]+|[IVXLCDM1]+")
_BARE = re.compile(r"[0-9lIOSBgi|]{1,4}|[ivxl]{1,6}")
_FRAMED = re.compile(r"[-—–]\s*(\S+)\s*[-—–]|\[(\S+)\]")
_GAP = re.compile(r"\||\s\s")
_DIGITS = str.maketrans("lIi|OoSsBbgZz", "1111005588922")
_SINGLE = str.maketrans({"@": "a", "c": "e", "f": "t", "l": "i", "1": "i", "5": "s", "0": "o", "9": "g", "6": "b", "8": "b", "$": "s", "þ": "p", "ﬁ": "t"})
_DOUBLE = (("vv", "w"), ("rn", "m"), ("ri", "n"), ("ii", "u"), ("lc", "k"), ("cl", "d"), ("li", "h"))


def fold(text: str) -> str:
    """A key under which a text and its common misreadings meet."""
    text = " ".join(text.lower().split())
    for seen, true in _DOUBLE:
        text = text.replace(seen, true)
    return text.translate(_SINGLE)


_PAGE, _OF, _HEADING = ({fold(w) for w in words} for words in (PAGE_WORDS, OF_WORDS, HEADING_WORDS))


def _is_number(t: str) -> bool:
    return bool(_NUMBER.fullmatch(t)) and (any(c.isdigit() for c in t) or bool(_ROMAN.fullmatch(t)) or len(t) <= 2)


def page_number(line: str) -> tuple[str, bool] | None:
    """The number of a line that is a page number and nothing else, and whether it stands bare."""
    x = line.strip()
    t = x.split()
    if len(t) > 4:
        return None
    m = _FRAMED.fullmatch(x)
    if m:
        n = m.group(1) or m.group(2)
        return (n, False) if _is_number(n) else None
    if len(t) == 1:
        return (t[0], True) if _BARE.fullmatch(t[0]) else None
    if len(t) == 3 and t[1] == "/" and _is_number(t[0]) and _is_number(t[2]):
        return t[0], False
    if t and fold(t[0]) in _PAGE and _is_number(t[1]) and (len(t) == 2 or (len(t) == 4 and fold(t[2]) in _OF and _is_number(t[3]))):
        return t[1], False
    return None


def title_of(line: str) -> tuple[str, str | None]:
    """The line without a page number set beside it, and that number."""
    x = line.strip()
    if not _GAP.search(x):
        return x, None
    m = re.fullmatch(r"(\S+)\s*\|\s*(.+)", x)
    if m and _is_number(m.group(1)):
        return m.group(2), m.group(1)
    m = re.fullmatch(r"(.+?)\s{3,}(\S+)", x)
    if m and _is_number(m.group(2)):
        return m.group(1), m.group(2)
    m = re.fullmatch(r"(\S+)\s+(\S+)\s{2,}(.+)", x)
    if m and fold(m.group(1)) in _PAGE and _is_number(m.group(2)):
        return m.group(3), m.group(2)
    return x, None


_NO_TITLE_END = ".,;:!?)" + HYPHENS


def like_title(x: str) -> bool:
    """Whether every word begins like a name and no sentence ends here."""
    t = x.split()
    if not t or x.rstrip()[-1] in _NO_TITLE_END or any(w[0].islower() for w in t) or fold(t[0]) in _HEADING:
        return False
    return any(c.isalpha() for c in x) and not re.fullmatch(r"[\d.,\s-]+", x)


def _value(number: str) -> int | None:
    n = number.translate(_DIGITS)
    return int(n) if n.isdigit() else None


def undone(word: str) -> set[str]:
    """The words from which one confusion leads to ``word``."""
    out = set()
    for true, seen in CONFUSIONS:
        at = word.find(seen)
        while at >= 0:
            out.add(word[:at] + true + word[at + len(seen) :])
            at = word.find(seen, at + 1)
    return out


def odd_characters(word: str) -> bool:
    """Whether a word holds characters that no word has: signs or digits among letters."""
    if word.isascii() and word.isalpha():
        return False
    letters = sum(c.isalpha() for c in word)
    if any(c in "@$þﬁ" for c in word) and letters:
        return True
    return letters >= 2 and word.isalnum() and any(c.isdigit() for c in word)


#: Characters of guesses sent on at once inside a task.
GUESS_CHARS = 4_000_000
#: Pages handled at once inside a task.
PAGES_AT_ONCE = 512


def _some(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of the batches as dicts, a bounded number at a time."""
    for batch in batches:
        for start in range(0, max(1, batch.num_rows), PAGES_AT_ONCE):
            part = batch.slice(start, PAGES_AT_ONCE)
            columns = [_values(c) for c in part.columns]
            yield [dict(zip(part.schema.names, v)) for v in zip(*columns)]


def _values(a: pa.Array) -> list:
    """The values of an array as Python objects, whole columns of nested ones at a time."""
    if pa.types.is_list(a.type):
        edges = a.offsets.to_pylist()
        inner = _values(a.values.slice(edges[0], edges[-1] - edges[0])) if edges else []
        out = [inner[i - edges[0] : j - edges[0]] for i, j in zip(edges, edges[1:])]
    elif pa.types.is_struct(a.type):
        names = [f.name for f in a.type]
        out = [dict(zip(names, v)) for v in zip(*map(_values, a.flatten()))]
    else:
        return a.to_pylist()
    return out if not a.null_count else [v if ok else None for v, ok in zip(out, a.is_valid().to_pylist())]


# ---- pages -------------------------------------------------------------------------------------


def pages_of(regions: DataFrame) -> DataFrame:
    """doc, page, regions: the distinct regions of each page."""
    rid = F.col("region_id").cast("long")
    known = F.col("source_doc").isNotNull() & F.col("page_number").isNotNull()
    lines = F.when(F.size("lines") > 0, F.col("lines")).when(F.col("text").isNotNull(), F.split("text", "\n", -1)).otherwise(F.array().cast("array<string>"))
    return (
        regions.where(F.col("region_id").isNotNull())
        .select(
            F.when(known, F.concat(F.lit("d"), F.col("source_doc"))).otherwise(F.concat(F.lit("r"), rid.cast("string"))).alias("doc"),
            F.when(known, F.col("page_number").cast("long")).otherwise(0).alias("page"),
            F.struct(F.col("region_no").cast("long").alias("region_no"), rid.alias("region_id"), F.col("label").alias("label"), lines.alias("lines")).alias("r"),
        )
        .groupBy("doc", "page")
        .agg(F.array_sort(F.collect_set("r")).alias("regions"))
    )


def _page_lines(regions: list[dict]) -> list[dict]:
    """The lines of a page that are not blank, in reading order."""
    out = []
    for r in sorted(regions, key=lambda r: (r["region_no"] is None, r["region_no"] or 0, r["region_id"])):
        kept = [(i + 1, x) for i, x in enumerate(r["lines"]) if x and x.strip()]
        width = max((len(x.rstrip()) for _, x in kept), default=0)
        for k, (i, x) in enumerate(kept):
            gap = k == 0 or kept[k - 1][0] != i - 1
            out.append({"region_id": r["region_id"], "line_no": i, "text": x, "label": r["label"] or "", "alone": len(kept) == 1, "width": width, "gap": gap and k > 0})
    return out


def _near_edge(k: int, n: int, reach: int) -> bool:
    return k < reach or k >= n - reach


_EVIDENCE = pa.schema([("doc", pa.string()), ("page", pa.int64()), ("kind", pa.string()), ("key", pa.string())])


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _some(batches):
        out = []
        for p in rows:
            seen = set()
            lines = _page_lines(p["regions"])
            for k, x in enumerate(lines):
                number = page_number(x["text"])
                if number is None:
                    core, beside = title_of(x["text"])
                    if like_title(core):
                        seen.add(("t", fold(core)))
                    number = (beside, False) if beside and like_title(core) else None
                if number and (not number[1] or _near_edge(k, len(lines), 3)) and (value := _value(number[0])) is not None:
                    seen.add(("o", str(value - p["page"])))
            out.extend({"doc": p["doc"], "page": p["page"], "kind": a, "key": b} for a, b in seen)
        yield pa.RecordBatch.from_pylist(out, schema=_EVIDENCE)


def is_furniture(lines: list[dict], k: int, page: int, titles: set[str], offset: int | None, support: int) -> bool:
    """Whether line k of a page is a running title or a page number."""
    x = lines[k]
    text = x["text"]
    number = page_number(text)
    if number:
        if not number[1]:
            return True
        value = _value(number[0])
        if value is None or not any(c.isdigit() for c in number[0]):
            return _near_edge(k, len(lines), 2)
        if support >= 2:
            return value - page == offset and _near_edge(k, len(lines), 3)
        return _near_edge(k, len(lines), 1) or (x["alone"] and x["label"] in FURNITURE_LABELS)
    core, beside = title_of(text)
    if not like_title(core):
        return False
    if beside or (x["alone"] and x["label"] in FURNITURE_LABELS):
        return True
    several = len(core.split()) >= 2
    if several and fold(core) in titles:
        return True
    return several and _near_edge(k, len(lines), 1) and (x["alone"] or len(text) < 0.8 * x["width"])


_LINE = pa.struct([("region_id", pa.int64()), ("line_no", pa.int64()), ("text", pa.string()), ("width", pa.int64()), ("gap", pa.bool_())])
_CLASSIFIED = pa.schema([("doc", pa.string()), ("page", pa.int64()), ("body", pa.list_(_LINE)), ("furniture", pa.list_(_LINE))])
_CLASSIFIED_SQL = "doc string, page long, body array<struct<region_id:long,line_no:long,text:string,width:long,gap:boolean>>, furniture array<struct<region_id:long,line_no:long,text:string,width:long,gap:boolean>>"


def _classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.name for f in _LINE]
    for rows in _some(batches):
        out = []
        for p in rows:
            lines = _page_lines(p["regions"])
            titles, offset = set(p["titles"] or []), p["offset"]
            flags = [is_furniture(lines, k, p["page"], titles, int(offset) if offset is not None else None, p["support"] or 0) for k in range(len(lines))]
            slim = [{n: x[n] for n in names} for x in lines]
            out.append({"doc": p["doc"], "page": p["page"], "body": [x for x, f in zip(slim, flags) if not f], "furniture": [x for x, f in zip(slim, flags) if f]})
        yield pa.RecordBatch.from_pylist(out, schema=_CLASSIFIED)


def classified_pages(regions: DataFrame, per_task: int = 500_000) -> DataFrame:
    """doc, page, body and furniture lines, and the body line before and after the page."""
    pages = cut(pages_of(regions))
    evidence = cut(pages.mapInArrow(_evidence, "doc string, page long, kind string, key string"))
    per_key = evidence.groupBy("doc", "kind", "key").agg(F.count(F.lit(1)).alias("n_rows"))
    repeated = cut(per_key.where("kind = 't' AND n_rows >= 2").select("doc", "key", "n_rows"))
    titles = (
        salted_join(evidence.where("kind = 't'").select("doc", "page", "key"), repeated, ["doc", "key"], F.col("page"), per_task=per_task)
        .groupBy("doc", "page").agg(F.collect_set("key").alias("titles"))
    )
    offsets = per_key.where("kind = 'o'").groupBy("doc").agg(F.max(F.struct("n_rows", "key")).alias("m")).select("doc", F.col("m.key").alias("offset"), F.col("m.n_rows").alias("support"))
    docs = cut(pages.groupBy("doc").agg(F.count(F.lit(1)).alias("n_rows")).join(offsets, "doc", "left"))
    # What is known of a page is put together without its text, which is then shuffled once.
    told = salted_join(pages.select("doc", "page"), docs, ["doc"], F.col("page"), per_task=per_task).join(titles, ["doc", "page"], "left")
    known = pages.join(told, ["doc", "page"])
    body = cut(known.select("doc", "page", "regions", "titles", "offset", "support").mapInArrow(_classify, _CLASSIFIED_SQL))
    ends = body.where(F.size("body") > 0)
    before = ends.select("doc", (F.col("page") + 1).alias("page"), F.element_at("body", -1)["text"].alias("line_before"))
    after = ends.select("doc", (F.col("page") - 1).alias("page"), F.element_at("body", 1)["text"].alias("line_after"))
    return cut(body.join(before, ["doc", "page"], "left").join(after, ["doc", "page"], "left"))


# ---- words -------------------------------------------------------------------------------------


def ends_cut(line: str) -> bool:
    """Whether a line ends in a hyphen that follows a letter."""
    x = line.rstrip()
    return len(x) > 1 and x[-1] in HYPHENS and x[-2].isalpha()


def bare(token: str) -> str:
    return token.strip(PUNCTUATION)


def halves(parts: tuple[str, str]) -> tuple[str, str]:
    return parts[0].rstrip(HYPHENS).lstrip(PUNCTUATION), parts[1].rstrip(PUNCTUATION + HYPHENS)


def apart(left: str, right: str) -> str | None:
    """The word that two entries are if the blank between them is wrong."""
    w, v = bare(left), bare(right)
    return w + v if left.endswith(w) and right.startswith(v) else None


def cut_words(body: list[dict], before: str | None, after: str | None) -> tuple[list[tuple[str, str, int, int]], list[list[str]]]:
    """The words cut at line ends, and the other words of each line.

    A cut word is (left part, right part, its line, the line it goes on in). Of one cut at the page's
    edge the part on the other page comes from the neighbouring line, numbered -1 or one past the
    end; without such a line the right part is empty.
    """
    lines = [x["text"].split() for x in body]
    cuts = []
    open_left = (before.split()[-1], -1) if before and body and ends_cut(before) else None
    for k, (x, tokens) in enumerate(zip(body, lines)):
        if open_left is not None and tokens:
            cuts.append((open_left[0], tokens.pop(0), open_left[1], k))
            open_left = None
        if tokens and ends_cut(x["text"]):
            open_left = (tokens.pop(), k)
    if open_left is not None:
        right = after.split()[0] if after and after.split() else ""
        cuts.append((open_left[0], right, open_left[1], len(body)))
    return cuts, lines


_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64()), ("asked", pa.int64())])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and how often they stand whole; forms that only a cut word asks for are counted apart."""
    for rows in _some(batches):
        tokens, asked = Counter(), Counter()
        for p in rows:
            cuts, lines = cut_words(p["body"], p["line_before"], p["line_after"])
            for line in lines:
                tokens.update(line)
            for left, right, *_ in cuts:
                if right:
                    a, b = halves((left, right))
                    asked[a + b] += 1
                    asked[f"{a}-{b}"] += 1
        n = Counter()
        for t, k in tokens.items():
            if w := bare(t):
                n[w] += k
        yield pa.RecordBatch.from_pylist([{"word": w, "n": n[w], "asked": asked[w]} for w in {*n, *asked}], schema=_COUNTS)


_GUESSES = pa.schema([("word", pa.string()), ("n", pa.int64()), ("asked", pa.int64()), ("guess", pa.string()), ("edits", pa.int32()), ("rest", pa.string())])


def _guesses(r: dict, halves_of: frozenset[str]) -> Iterator[dict]:
    w = r["word"]
    row = {"word": w, "n": r["n"], "asked": r["asked"], "rest": None}
    yield row | {"guess": None, "edits": 0}
    if not any(c.isalpha() for c in w):
        return
    one = undone(w)
    yield from (row | {"guess": v, "edits": 1} for v in one)
    two = (v for u in one for v in undone(u) if v not in one and v != w)
    yield from (row | {"guess": v, "edits": 2} for v in (set(two) if len(w) <= 64 else two))  # repeats do no harm
    if r["n"] and w.isalpha() and w.islower() and len(w) >= 5:
        yield from (row | {"guess": w[:i], "edits": 3, "rest": w[i:]} for i in range(2, len(w) - 1) if w[:i] in halves_of or w[i:] in halves_of)


def _guess(halves_of):
    """What a form may be besides itself: a form with one or two confusions undone, or two words run together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _some(batches):
            out, size = [], 0
            for r in rows:
                for g in _guesses(r, halves_of.value):
                    out.append(g)
                    size += len(g["word"]) + len(g["guess"] or "")
                    if size > GUESS_CHARS:
                        yield pa.RecordBatch.from_pylist(out, schema=_GUESSES)
                        out, size = [], 0
            yield pa.RecordBatch.from_pylist(out, schema=_GUESSES)

    return run


def word_facts(pages: DataFrame) -> tuple[DataFrame, int]:
    """word, n, n_rows (where it occurs or is asked for), readings, splits, common; and how many words there are.

    Readings are the words it may be misread from, with their counts and confusions; only those that
    cost less than the form as it stands, since no other can lie on a shortest path, but all of a
    form with odd characters. Splits are the places where both parts are words, with their counts.
    """
    counts = cut(pages.mapInArrow(_count_words, "word string, n long, asked long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("asked").alias("asked")))
    total = counts.agg(F.sum("n")).first()[0] or 1
    # Of two words run together the product of the counts is at least this bound's square, so one is in a list of at most sqrt(total) words.
    bound = math.sqrt(UNSEEN * math.exp(SPLIT_COST) * total)
    frequent = counts.where(F.col("n") >= bound).select("word").collect()
    halves_of = pages.sparkSession.sparkContext.broadcast(frozenset(r["word"] for r in frequent))
    guesses = counts.mapInArrow(_guess(halves_of), "word string, n long, asked long, guess string, edits int, rest string")
    lexicon = counts.where("n > 0").select(F.col("word").alias("guess"), F.col("n").alias("guess_n"))
    met = guesses.join(lexicon, "guess", "left").where("edits = 0 OR guess_n > 0")
    met = met.join(lexicon.select(F.col("guess").alias("rest"), F.col("guess_n").alias("rest_n")), "rest", "left")
    own = F.greatest(F.col("n") - 1, F.lit(0)) + UNSEEN
    channel = F.when(F.col("edits") == 1, math.exp(-EDIT_COSTS[0])).otherwise(math.exp(-EDIT_COSTS[1]))
    misread = F.col("edits").isin(1, 2) & ((F.col("guess_n") * channel > own) | F.col("word").rlike("[@$þﬁ0-9]"))
    parted = (F.col("edits") == 3) & (F.col("guess_n") * (F.col("rest_n") / total) * math.exp(-SPLIT_COST) > own)
    found = met.groupBy("word").agg(
        F.first("n").alias("n"), F.first("asked").alias("asked"),
        F.collect_set(F.when(misread, F.struct("guess", "guess_n", "edits"))).alias("readings"),
        F.collect_list(F.when(parted, F.struct(F.length("guess").alias("at"), "guess_n", "rest_n"))).alias("splits"),
    )
    plain = (F.size("readings") == 0) & (F.size("splits") == 0)
    common = plain & (F.col("n") >= F.greatest(F.lit(3.0), F.lit(COMMON * total)))
    return found.select("word", "n", (F.col("n") + F.col("asked")).alias("n_rows"), "readings", "splits", common.alias("common")), total


def _page_words(common):
    """The distinct forms of each page that decoding may ask about."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _asked_words(batches, common.value)

    return run


def _asked_words(batches: Iterator[pa.RecordBatch], common: dict[str, int]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc", pa.string()), ("page", pa.int64()), ("word", pa.string())])
    plain: dict[str, bool] = {}
    for rows in _some(batches):
        docs, pages, out = [], [], []
        for p in rows:
            words = set()
            cuts, lines = cut_words(p["body"], p["line_before"], p["line_after"])
            tokens = [t for line in lines for t in line]
            for k, t in enumerate(tokens):
                if not _plain(t, common, plain):
                    words.add(bare(t))
                    words.update(j for a, b in zip(tokens[max(0, k - 1) : k + 1], tokens[max(1, k) : k + 2]) if (j := apart(a, b)))
            for left, right, *_ in cuts:
                if right:
                    a, b = halves((left, right))
                    words |= {a + b, f"{a}-{b}"}
            words = {w for w in words if w and w not in common}
            docs += [p["doc"]] * len(words)
            pages += [p["page"]] * len(words)
            out += words
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.string()), pa.array(pages, pa.int64()), pa.array(out, pa.string())], schema=schema)


def _plain(token: str, common: dict[str, int], known: dict[str, bool]) -> bool:
    """Whether a token can be nothing but the word it is; remembered, a bounded number of them."""
    answer = known.get(token)
    if answer is None:
        if len(known) > 500_000:
            known.clear()
        w = bare(token)
        answer = known[token] = w in common or not w
    return answer


# ---- decoding ----------------------------------------------------------------------------------


class Decoder:
    """The shortest path over a page's stream of characters.

    ``facts`` knows the forms of the page that are not ``common``: their counts, readings and splits.
    A form that neither knows occurs nowhere.
    """

    def __init__(self, facts: dict[str, dict], common: dict[str, int], total: int):
        self.facts, self.common, self.log_total = facts, common, math.log(max(total, 2))

    def cost(self, n: float) -> float:
        return self.log_total - math.log(n)

    def count(self, form: str) -> int:
        f = self.facts.get(form)
        return f["n"] if f else self.common.get(form, 0)

    def readings(self, form: str, own: bool) -> list[tuple[str, float, bool]]:
        """Everything a form may be: the word, its cost, and whether the form was misread. ``own`` says that the form's count holds this occurrence."""
        n = self.count(form)
        odd = odd_characters(form)
        out = [(form, self.cost(max(n - own, 0) + UNSEEN) + (EDIT_COSTS[1] if odd else 0.0), odd)]
        if f := self.facts.get(form):
            out += [(r["guess"], self.cost(r["guess_n"]) + EDIT_COSTS[r["edits"] - 1], True) for r in f["readings"] or []]
            if odd and len(out) > 1:  # no word has such characters, so what stands there is no rival
                out.pop(0)
        return out

    def edges(self, tokens: list[str], starts: list[int], k: int) -> Iterator[tuple[int, int, float, dict]]:
        """(from, to, cost, step) of the words that begin in token k; places are counted in characters."""
        t, a = tokens[k], starts[k]
        w = bare(t)
        if w in self.common and k + 1 < len(tokens) and bare(tokens[k + 1]) in self.common:
            yield a, a + len(t), self.cost(max(self.common[w] - 1, 0) + UNSEEN), {"text": t, "misread": False}
            return
        at = t.find(w) if w else 0
        end = a + len(t)
        if not w:
            yield a, end, 0.0, {"text": t, "misread": False}
            return
        for text, cost, bad in self.readings(w, True):
            yield a, end, cost, {"text": t[:at] + text + t[at + len(w) :], "misread": bad}
        f = self.facts.get(w)
        for x in (f["splits"] if f else None) or []:
            middle = a + at + x["at"]
            yield a, middle, self.cost(x["guess_n"]) + SPLIT_COST, {"text": t[: at + x["at"]], "misread": False}
            yield middle, end, self.cost(x["rest_n"]), {"text": t[at + x["at"] :], "misread": False}
        if k + 1 < len(tokens) and (joined := apart(t, tokens[k + 1])):
            following = tokens[k + 1]
            v = bare(following)
            if self.count(joined) and not (w in self.common and v in self.common):
                head, tail = t[:at], following[following.find(v) + len(v) :]
                for text, cost, bad in self.readings(joined, False):
                    yield a, starts[k + 1] + len(following), cost + MERGE_COST, {"text": head + text + tail, "misread": bad}

    def path(self, tokens: list[str]) -> list[dict]:
        """The words of a stretch of tokens: for each its text, the token it begins in, whether it was misread."""
        starts, at = [], 0
        for t in tokens:
            starts.append(at)
            at += len(t) + 1
        best: dict[int, tuple[float, int, dict | None]] = {0: (0.0, -1, None)}
        for k, t in enumerate(tokens):
            for i, j, cost, step in self.edges(tokens, starts, k):
                if i in best:
                    if j >= starts[k] + len(t):
                        j += 1  # the blank after a word belongs to it
                    reached = best[i][0] + cost
                    if j not in best or reached < best[j][0] - 1e-9:
                        best[j] = (reached, i, step | {"token": k})
        out, j = [], at
        while j > 0:
            _, i, step = best[j]
            out.append(step)
            j = i
        return out[::-1]

    def cut_word(self, left: str, right: str) -> dict:
        """What a word cut at a line end is: whole or a compound, in any reading."""
        a, b = halves((left, right))
        tail = right[len(right.rstrip(PUNCTUATION)) :]
        head = left[: len(left) - len(left.lstrip(PUNCTUATION))]
        offers = [(cost, {"text": head + text + tail, "cut": True, "misread": bad, "seen": a + b, "read": text, "at": len(a)}) for text, cost, bad in self.readings(a + b, False)]
        if left.rstrip()[-1:] == "-":
            twice = 2 * COMPOUND_COST if a.lower() == b.lower() else 0.0
            form = f"{a}-{b}"
            offers += [(cost + COMPOUND_COST - twice, {"text": head + text + tail, "cut": False, "misread": bad, "seen": form, "read": text, "at": len(a)}) for text, cost, bad in self.readings(form, False)]
        return min(offers, key=lambda o: o[0])[1]


def _misread_lines(step: dict, left: str, right: str, lines: tuple[int, int]) -> set[int]:
    """On which of its lines the wrong characters of a cut word stand."""
    if not step["misread"]:
        return set()
    a, b = halves((left, right))
    if odd_characters(a) or odd_characters(b):
        return {line for part, line in zip((a, b), lines) if odd_characters(part)}
    seen, read, same = step["seen"], step["read"], 0
    while same < min(len(seen), len(read)) and seen[same] == read[same]:
        same += 1
    return {lines[0] if same < step["at"] else lines[1]}


def stretches(plain: list[bool]) -> Iterator[tuple[int, int]]:
    """The runs of tokens, each with a neighbour on both sides, outside of which every token is plain."""
    n, k = len(plain), 0
    while k < n:
        if plain[k]:
            k += 1
            continue
        first = max(0, k - 1)
        while k < n and (not plain[k] or (k + 1 < n and not plain[k + 1])):
            k += 1
        yield first, min(n, k + 1)
        k += 1


def decode_page(body: list[dict], before: str | None, after: str | None, decoder: Decoder, plain: dict[str, bool]) -> tuple[set[tuple[int, str]], list[str]]:
    """Marks (line, kind) and the repaired text of each line; a cut word belongs to where it begins."""
    n = len(body)
    cuts, lines = cut_words(body, before, after)
    marks: set[tuple[int, str]] = set()
    # A word that goes on elsewhere is a wall: nothing merges across it.
    broken_before = {z for *_, z in cuts} | {a + 1 for *_, a, _ in cuts}
    tokens, line_of, texts = [], [], [[] for _ in range(n)]

    def settle() -> None:
        flags = [_plain(t, decoder.common, plain) for t in tokens]
        done = 0
        for first, end in stretches(flags):
            for k in range(done, first):
                texts[line_of[k]].append(tokens[k])
            first = max(first, done)
            for step in decoder.path(tokens[first:end]):
                line = line_of[first + step["token"]]
                texts[line].append(step["text"])
                if step["misread"]:
                    marks.add((line, "misread"))
            done = end
        for k in range(done, len(tokens)):
            texts[line_of[k]].append(tokens[k])
        tokens.clear()
        line_of.clear()

    heads: list[list[str]] = [[] for _ in range(n)]
    tails: list[list[str]] = [[] for _ in range(n)]
    for left, right, a, z in cuts:
        if not right:
            tails[a].append(left)
            continue
        step = decoder.cut_word(left, right)
        if step["cut"] and 0 <= a:
            marks.add((a, "hyphen"))
        marks |= {(k, "misread") for k in _misread_lines(step, left, right, (a, z)) if 0 <= k < n}
        here, there = a >= 0, z < n
        apart_regions = not here or not there or body[a]["region_id"] != body[z]["region_id"]
        if apart_regions and not step["cut"]:  # a compound parts at its own hyphen
            at = step["text"].find("-") + 1
            if here:
                tails[a].append(step["text"][:at])
            if there:
                heads[z].append(step["text"][at:])
        elif here:
            tails[a].append(step["text"])
    for k, line in enumerate(lines):
        if k in broken_before:
            settle()
        tokens += line
        line_of += [k] * len(line)
    settle()
    return marks, [" ".join(heads[k] + texts[k] + tails[k]) for k in range(n)]


def _stands_alone(line: str) -> bool:
    """Whether a line is a heading or a number set by itself."""
    if line[-1] in ".;:" or line[0].islower():
        return False
    number = re.fullmatch(r"\(?[\dIVXivx.,-]{1,8}\)?|(?:Rp|IDR|USD)\.? ?[\d.,]+", line)
    return bool(number) or (fold(line.split()[0]) in _HEADING and len(line.split()) <= 3)


def paragraph_breaks(body: list[dict]) -> list[bool]:
    """For each line whether a new paragraph begins with it, by dynamic programming over line ends.

    A line that stops though the next word would have fitted ends its paragraph; a line that is
    full does not. A paragraph pays for an end without a full stop, for a beginning in lower
    case, and for being a single line that is no heading.
    """
    n = len(body)
    if not n:
        return []
    texts = [x["text"].rstrip() for x in body]
    begins = [0.0] * n
    standing = [_stands_alone(t) for t in texts]
    full = max(x["width"] for x in body)
    for i in range(1, n):
        above = texts[i - 1]
        room = full - len(above) - 1 - len(texts[i].split()[0])
        ended = above[-1] in ".!?:" or above.endswith(('."', ".”", ".)"))
        cost = -1.5 if room >= 0 else 3.0
        cost += -1.0 if ended else 2.0
        cost += 1.5 if texts[i][0].islower() else 0.0
        if standing[i] or standing[i - 1]:
            cost = -4.0
        if ends_cut(above):
            cost += 6.0
        begins[i] = -6.0 if body[i]["gap"] else cost
    # State: whether the line before began a paragraph; two beginnings in a row cost unless one is a heading.
    cost = [[0.0, math.inf] for _ in range(n)]
    came = [[0, 0] for _ in range(n)]
    cost[0] = [math.inf, 0.0]
    for i in range(1, n):
        cost[i][0], came[i][0] = min((cost[i - 1][s], s) for s in (0, 1))
        single = 0.5 if not (standing[i - 1] or body[i]["gap"]) else 0.0
        cost[i][1], came[i][1] = min((cost[i - 1][s] + begins[i] + (single if s else 0.0), s) for s in (0, 1))
    state = 0 if cost[-1][0] <= cost[-1][1] else 1
    out = [False] * n
    for i in range(n - 1, -1, -1):
        out[i] = bool(state)
        state = came[i][state]
    return out


_DECODED = pa.schema([("region_id", pa.int64()), ("line_no", pa.int64()), ("kind", pa.string()), ("paragraph", pa.int64()), ("text", pa.string())])


def _decode_pages(common, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain: dict[str, bool] = {}
        for rows in _some(batches):
            yield _decoded(rows, common.value, total, plain)

    return run


def _decoded(rows: list[dict], common: dict[str, int], total: int, plain: dict[str, bool]) -> pa.RecordBatch:
    """Marks of lines (kind) and the repaired text of lines with the number of their paragraph in the region."""
    regions, numbers, kinds, paragraphs, texts = [], [], [], [], []

    def put(line: dict, kind: str, paragraph: int | None = None, text: str | None = None) -> None:
        regions.append(line["region_id"])
        numbers.append(line["line_no"])
        kinds.append(kind)
        paragraphs.append(paragraph)
        texts.append(text)

    for p in rows:
        body = p["body"]
        for x in p["furniture"]:
            put(x, "furniture")
        if not body:
            continue
        decoder = Decoder({f["word"]: f for f in p["facts"] or []}, common, total)
        marks, repaired_lines = decode_page(body, p["line_before"], p["line_after"], decoder, plain)
        for k, kind in marks:
            put(body[k], kind)
        number, region = 0, None
        for k, new in enumerate(paragraph_breaks(body)):
            if body[k]["region_id"] != region:
                number, region = 1, body[k]["region_id"]
            elif new:
                number += 1
            put(body[k], "body", number, repaired_lines[k])
    columns = [pa.array(x, f.type) for x, f in zip((regions, numbers, kinds, paragraphs, texts), _DECODED)]
    return pa.RecordBatch.from_arrays(columns, schema=_DECODED)


def decoded(regions: DataFrame, per_task: int = 500_000) -> DataFrame:
    """region_id, line_no, kind, paragraph, text: marks (furniture, hyphen, misread) and repaired body lines."""
    pages = classified_pages(regions, per_task)
    facts, total = word_facts(pages)
    facts = cut(facts)
    # At most 1/COMMON words, whatever the size of the corpus; all others are asked for by a join on the word.
    rows = facts.where("common").select("word", "n").collect()
    common = regions.sparkSession.sparkContext.broadcast({r["word"]: r["n"] for r in rows})
    on_pages = salted_join(pages.mapInArrow(_page_words(common), "doc string, page long, word string"), facts.where("NOT common").drop("common"), ["word"], F.struct("doc", "page"), per_task=per_task)
    per_page = on_pages.groupBy("doc", "page").agg(F.collect_list(F.struct("word", "n", "readings", "splits")).alias("facts"))
    return pages.join(per_page, ["doc", "page"], "left").mapInArrow(_decode_pages(common, total), "region_id long, line_no long, kind string, paragraph long, text string")


def repaired(lines: DataFrame) -> DataFrame:
    """region_id, clean_text: the paragraphs of each region, parted by an empty line."""
    body = lines.where("kind = 'body' AND text != ''")
    paragraphs = body.groupBy("region_id", "paragraph").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("l"))
    joined = paragraphs.select("region_id", F.struct("paragraph", F.array_join(F.col("l.text"), " ").alias("t")).alias("p"))
    return joined.groupBy("region_id").agg(F.array_join(F.array_sort(F.collect_list("p"))["t"], "\n\n").alias("clean_text"))
