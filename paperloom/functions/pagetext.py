"""Markdown of pages: markers, clean-up, titles, counts and guards, as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions.cells import let, strip

MARKER = r"(?i)<!--\s*(?:PAGE|SLIDE)\s*:?\s*(\d+)\s*-->"
# How a leaked train of thought begins, titles that say nothing, marks of visuals.
REASONING = (
    "wait, i need to check", "let me check", "let me re-read", "let me verify", "draft table", "thinking process:", "i will output", "mari kita",
    "mari saya", "ini melanggar aturan", "aturan ", "perbaikan teks", "koreksi draft", "draft markdown", "langkah demi langkah", "evaluasi draf", "catatan koreksi",
)
LEAKS = ("mari kita", "ini melanggar aturan", "aturan 10", "koreksi draft", "perbaikan teks:", "draft markdown yang diberikan", "langkah demi langkah")
GENERIC_TITLES = (
    "document", "dokumen", "page 1", "halaman 1", "slide 1", "overview", "ringkasan", "pendahuluan", "untitled", "table of contents", "daftar isi",
)
VISUAL_TAGS = ("[Diagram/Visual]", "[Gambar/Visual]", "[Topologi]", "[Diagram/Topologi]")
PAGE_LINE = r"(?i)^(halaman|page|-)?\s*\d+\s*(dari|of|/)?\s*\d*\s*(-)?$"
# The characters that ``strip`` trims.
WHITE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def lines_of(c: Column) -> Column:
    return F.split(c, r"\r\n|\n|\r", -1)


def _count(c: Column, text: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(text), F.lit("")))) / len(text)).cast("int")


def _trim(c: Column) -> Column:
    """What ``strip`` gives, for texts of a page's size; only the ends are looked at."""
    white = F.lit(WHITE)
    return let(c, lambda x: F.when(F.contains(white, F.substring(x, -1, 1)), F.btrim(x, white)).otherwise(F.ltrim(x, white)))


def _holds_any(low: Column, phrases: tuple[str, ...]) -> Column:
    """Whether a text in lower case holds one of the phrases; a literal by itself is sought by skipping, an alternation at every place."""
    return reduce(lambda a, b: a | b, [low.rlike(re.escape(p)) for p in phrases])


def page_delimiter(number: Column, slide: Column | None = None) -> Column:
    """The comment that opens a page or a slide."""
    tag = F.lit("PAGE") if slide is None else F.when(slide, "SLIDE").otherwise("PAGE")
    return F.concat(F.lit("<!-- "), tag, F.lit(": "), number.cast("string"), F.lit(" -->"))


def split_pages(c: Column, keep_preamble: bool = False) -> Column:
    """Array of (page_number, content) of a text with page markers.

    Text before the first marker is dropped or, with ``keep_preamble``, put before the first page.
    A text without markers is page 1 as a whole; null gives null, a blank text an empty array.
    """
    parts = F.split(c, MARKER, -1)
    numbers = F.regexp_extract_all(c, F.lit(MARKER), F.lit(1))
    pages = F.zip_with(numbers, F.slice(parts, F.lit(2), F.size(numbers)), lambda n, t: F.struct(n.cast("int").alias("page_number"), strip(t).alias("content")))
    if keep_preamble:
        before = strip(parts[0])
        glued = F.when(before == "", strip(parts[1])).otherwise(F.concat_ws("\n\n", before, strip(parts[1])))
        pages = F.transform(pages, lambda p, i: F.when(i == 0, F.struct(p["page_number"].alias("page_number"), glued.alias("content"))).otherwise(p))
    whole = F.array(F.struct(F.lit(1).alias("page_number"), strip(c).alias("content")))
    empty = F.filter(whole, lambda p: F.lit(False))
    return F.when(c.isNull(), F.lit(None)).when(strip(c) == "", empty).when(F.size(numbers) == 0, whole).otherwise(pages)


def preamble(c: Column) -> Column:
    """What stands before the first page marker; empty without markers."""
    return F.when(c.rlike(MARKER), strip(F.split(c, MARKER, -1)[0])).otherwise(F.when(c.isNotNull(), ""))


def split_sheets(c: Column) -> Column:
    """Array of (sheet, content) of a workbook's Markdown, parted at level-two headings."""
    pattern = r"(?m)^## +(.+?)[ \t]*$"
    names = F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
    return F.zip_with(names, F.slice(F.split(c, pattern, -1), F.lit(2), F.size(names)), lambda n, t: F.struct(F.trim(n).alias("sheet"), strip(t).alias("content")))


def drop_page_lines(c: Column) -> Column:
    """A text without the lines that hold only a page number."""
    return F.array_join(F.filter(lines_of(c), lambda x: ~strip(x).rlike(PAGE_LINE)), "\n")


def strip_images(c: Column) -> Column:
    """A text without embedded pictures and the gaps they leave."""
    x = F.regexp_replace(c, r"(?is)<div\b[^>]*>\s*<img\b[^>]*>\s*</div\s*>", "")
    x = F.regexp_replace(F.regexp_replace(x, r"(?is)<img\b[^>]*>", ""), r"!\[[^\]\n]*\]\([^\n)]*\)", "")
    return strip(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def strip_thinking(c: Column) -> Column:
    """A model's answer without its train of thought, tagged or leading."""
    opens = lambda s: s.rlike(r"^(?:#|\||>|---|```|- |\* |1\. |<!--)") | (s.startswith("**") & s.endswith("**"))
    begins = "(?i)^(?:" + "|".join(re.escape(p) for p in REASONING) + ")"
    holds = "(?i)" + "|".join(re.escape(p) for p in REASONING)

    def untag(x: Column) -> Column:
        return F.when(x.contains("<") & x.rlike("(?i)</?think>"), F.regexp_replace(F.regexp_replace(x, r"(?i)^[\s\S]*?</think>", ""), r"(?i)<think>[\s\S]*$", "")).otherwise(x)

    def lead(x: Column) -> Column:
        """Where content begins after leading talk; only texts that hold such talk are looked at line by line."""

        def cut_at(lines: Column) -> Column:
            flagged = F.transform(lines, lambda s, i: let(_trim(s), lambda t: F.when((t != "") & opens(t) & ~t.rlike(begins), i)))

            def rest(first: Column) -> Column:
                before = F.array_join(F.slice(lines, F.lit(1), F.greatest(first, F.lit(1))), "\n")
                return F.when((first > 0) & before.rlike(holds), F.array_join(F.slice(lines, first + 1, F.size(lines)), "\n")).otherwise(x)

            return let(F.array_min(F.filter(flagged, lambda i: i.isNotNull())), rest)

        talks = let(F.lower(x), lambda low: _holds_any(low, REASONING)) & x.rlike(holds)  # lower case alone would fold letters outside ASCII, too
        return _trim(F.when(talks, let(lines_of(x), cut_at)).otherwise(x))

    closed = lambda x: F.when(x.contains("<"), F.regexp_replace(x, r"(?i)<think>[\s\S]*?</think>", "")).otherwise(x)
    return let(let(let(F.coalesce(c, F.lit("")), closed), untag), lead)


def strip_markers(c: Column) -> Column:
    """A text without thoughts and page markers."""
    return _trim(let(strip_thinking(c), lambda x: F.when(x.contains("<!--"), F.regexp_replace(x, MARKER, "")).otherwise(x)))


def unfence(c: Column) -> Column:
    """A text without the code fence put around the whole of it."""

    def inner(x: Column) -> Column:
        fenced = x.startswith("```") & x.endswith("```") & (F.length(x) >= 6) & ~x.startswith("```mermaid")
        return F.when(fenced, _trim(F.regexp_extract(x, r"(?s)^```(?:markdown|md)?(.*)```$", 1))).otherwise(x)

    return let(_trim(c), inner)


def collapse_blocks(c: Column) -> Column:
    """A text in which a block that repeats the one before it is left out."""

    def kept(blocks: Column) -> Column:
        some = F.filter(blocks, lambda b, i: (i == 0) | (_trim(b) != _trim(F.get(blocks, i - 1))))
        return F.array_join(some, "\n\n")

    return let(c, lambda x: let(_trim(x), lambda t: F.when(t.contains("\n\n"), let(F.split(t, r"\n{2,}", -1), kept)).otherwise(x)))


def title_of(c: Column, fallback: Column | None = None) -> Column:
    """A document's title: first telling level-one heading, else level two, else bold line among the first five."""
    telling = lambda t: (t != "") & ~F.lower(t).isin(*GENERIC_TITLES)

    def choose(lines: Column) -> Column:
        head = lambda p: F.get(F.filter(F.transform(F.filter(lines, lambda x: x.rlike(p)), lambda x: strip(F.regexp_replace(x, r"^#+ ", ""))), telling), F.lit(0))
        bold = F.get(F.filter(F.transform(F.slice(lines, 1, 5), lambda x: strip(F.regexp_extract(x, r"^\*\*(.+?)\*\*$", 1))), lambda t: telling(t) & (F.length(t) > 3)), F.lit(0))
        return F.coalesce(head(r"^# (?!#)"), head(r"^## (?!#)"), bold, *([fallback] if fallback is not None else []))

    return let(F.filter(F.transform(lines_of(strip_markers(c)), strip), lambda x: x != ""), choose)


def stitch(pages: DataFrame, key: str, number: str, content: str, title: str | None = None, markers: bool = True) -> DataFrame:
    """key, text: the pages of each document joined in order; ``pages`` of one document are a bounded group.

    Page-number lines and blank pages are left out. With markers each page opens with its comment;
    without, a page goes on in the paragraph before unless that ended or a new block begins.
    """
    body = strip(drop_page_lines(F.col(content)))
    cols = [key, F.col(number).cast("int").alias("_n"), body.alias("_t")] + ([F.col(title).alias("_title")] if title else [F.lit(None).cast("string").alias("_title")])
    numbered = pages.select(*cols).withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy("_n")))
    kept = numbered.where(F.col("_t") != "")
    name = strip(F.regexp_replace(strip(F.col("_title")), r"^#+", ""))
    first = strip(lines_of(F.col("_t"))[0])
    opened = F.when(first.rlike("^# (?!#)"), F.col("_t")).otherwise(F.concat(F.lit("# "), name, F.lit("\n\n"), F.col("_t")))
    repeat = F.lower(first) == F.concat(F.lit("# "), F.lower(name))
    later = F.when(repeat, strip(F.array_join(F.slice(lines_of(F.col("_t")), F.lit(2), F.greatest(F.size(lines_of(F.col("_t"))) - 1, F.lit(0))), "\n"))).otherwise(F.col("_t"))
    text = F.when(name.isNull() | (name == ""), F.col("_t")).when(F.col("_i") == 1, opened).otherwise(later)
    kept = kept.select(key, "_i", text.alias("_t"))
    if markers:
        one = F.concat(F.lit("\n"), page_delimiter(F.col("_i")), F.lit("\n\n"), F.col("_t"))
        grouped = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_i", one.alias("t")))).alias("p"))
        return grouped.select(key, F.concat(strip(F.array_join(F.col("p.t"), "\n")), F.lit("\n")).alias("text"))
    grouped = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_i", F.col("_t").alias("t")))).alias("p"))
    open_end = lambda s: ~F.regexp_replace(s, r"\s+$", "").rlike(r"(?s)(?:[.:!?#>|]|```)$")
    goes_on = lambda s: ~strip(lines_of(s)[0]).rlike(r"^(?:#|-|\*|>|\||1\.|2\.)")
    joined = F.aggregate(
        F.col("p.t"), F.lit(""),
        lambda acc, t: F.when(acc == "", t).when(open_end(acc) & goes_on(t), F.concat(F.regexp_replace(acc, r"\s+$", ""), F.lit(" "), t)).otherwise(F.concat(acc, F.lit("\n\n"), t)),
    )
    return grouped.select(key, F.concat(strip(joined), F.lit("\n")).alias("text"))


def upsert_pages(old: DataFrame, new: DataFrame, key: str, number: str) -> DataFrame:
    """The pages of both; of the same page the new one. Within one side the last content in order of text wins."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    others = [c for c in both.columns if c not in (key, number, "_new")]
    return both.groupBy(key, number).agg(F.max(F.struct("_new", *others)).alias("_p")).select(key, number, *[F.col(f"_p.{c}").alias(c) for c in others])


def count_visuals(c: Column) -> Column:
    """Marks of visuals and diagram blocks."""
    return reduce(lambda a, b: a + b, [_count(c, t) for t in (*VISUAL_TAGS, "```mermaid")])


def count_tables(c: Column) -> Column:
    """Separator lines of pipe tables."""
    return F.size(F.filter(lines_of(c), lambda x: x.rlike(r"^\s*\|?[\s:|-]*-{3,}[\s:|-]*\|?\s*$")))


def mermaid_blocks(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?i)```mermaid\s*([\s\S]*?)\s*```"), F.lit(1))


def has_diagram(c: Column) -> Column:
    tags = reduce(lambda a, b: a | b, [c.contains(t) for t in (*VISUAL_TAGS, "```mermaid")])
    return tags | c.rlike(r"(?i)\b(?:FIGURE|Bagan|Skema)\s+\d+")


def difficulty(c: Column) -> Column:
    """complex with visuals, standard with tables or much text, else simple."""
    return F.when(has_diagram(c), "complex").when(c.contains("|---") | (_count(c, "|") > 8) | (F.length(c) > 2000), "standard").otherwise("simple")


def may_skip_review(c: Column) -> Column:
    """Whether a page is so plain that no second look is needed."""
    return (difficulty(c) == "simple") & ~has_diagram(c) & (F.length(strip(c)) >= 20) & ~c.contains("[tidak terbaca]") & ~c.contains("|---")


def visual_description(c: Column) -> Column:
    """A description as one quoted block."""
    x = strip(c)
    lines = F.filter(F.transform(lines_of(x), strip), lambda s: s != "")
    quoted = F.transform(lines, lambda s, i: F.when(i == 0, F.concat(F.lit("> **[Diagram/Visual]:** "), s)).otherwise(F.concat(F.lit("> "), s)))
    return F.when(x.startswith("> **[Diagram/Visual]:**"), x).otherwise(F.array_join(quoted, "\n"))


def accepted_revision(draft: Column, raw: Column) -> Column:
    """The revised text if it passes the guards, else the draft: leaks, emptiness, lost diagrams, bloat, truncation."""
    fences = lambda t: F.regexp_count(t, F.lit(r"(?im)^\s*```mermaid\b"))

    def judge(refined: Column) -> Column:
        a, b = F.length(draft), F.length(refined)
        lost = draft.contains("```") & (fences(refined) < fences(draft))
        bad = (refined == "") | lost | ((a > 500) & (b > 1.8 * a)) | ((a > 800) & (b < 0.45 * a))
        return F.when(bad | refined.isNull(), draft).otherwise(refined)

    def refine(low: Column) -> Column:
        """Most answers hold no tag, fence or talk, so nothing but white space is taken off their ends."""
        plain = ~raw.contains("<") & ~raw.contains("```") & ~_holds_any(low, REASONING)
        whole = let(let(strip_thinking(raw), unfence), strip_markers)
        cleaned = let(F.when(plain, _trim(raw)).otherwise(whole), collapse_blocks)
        return F.when(_holds_any(low, LEAKS), draft).otherwise(let(cleaned, judge))

    return let(F.lower(raw), refine)


def normalized_words(c: Column) -> Column:
    """The words of a text in lower case, one blank between."""
    return F.array_join(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)(\w+)"), F.lit(1)), " ")


def missing_pages(pages: DataFrame, key: str, number: str, total: Column) -> DataFrame:
    """key, n_saved, missing: the page numbers from 1 to the total that a document lacks."""
    return pages.groupBy(key).agg(F.collect_set(number).alias("_have"), F.max(total).alias("_n")).select(
        key, F.size("_have").alias("n_saved"), F.array_except(F.sequence(F.lit(1), F.col("_n").cast("int")), F.col("_have").cast("array<int>")).alias("missing")
    )


def contains_text(c: Column, query: str) -> Column:
    """Whether a text holds a query, whatever the case."""
    return F.lower(c).contains(query.lower())


def carried_tail(content: str, key: str, number: str, n: int = 400) -> Column:
    """The last characters of the page before, as context for the next."""
    return F.lag(F.substring(F.col(content), -n, n)).over(Window.partitionBy(key).orderBy(number))


def page_batches(pages: DataFrame, key: str, number: str, content: str, size: int = 10, tail: int = 400) -> DataFrame:
    """key, batch, first_page, last_page, context: runs of ``size`` pages by number, each with the end of the last page before it.

    The end of a batch's last page is taken while batches are made, so only one small row per batch is put in order.
    """
    batch = F.floor((F.col(number) - 1) / size).cast("int")
    end = F.substring(F.col(content), -tail, tail)
    g = pages.groupBy(key, batch.alias("batch")).agg(F.min(number).alias("first_page"), F.max(number).alias("last_page"), F.max_by(end, number).alias("_end"))
    return g.withColumn("context", F.lag("_end").over(Window.partitionBy(key).orderBy("batch"))).drop("_end")


def catchword_missing(catchword: Column, head: Column) -> Column:
    """Whether neither end of the catchword occurs where the next page begins."""
    words = F.filter(F.split(F.regexp_replace(F.lower(catchword), r"(?U)[^\w\s]", " "), r"\s+"), lambda w: w != "")
    low = F.lower(head)
    return (F.size(words) > 0) & ~low.contains(F.element_at(words, -1)) & ~low.contains(words[0])
