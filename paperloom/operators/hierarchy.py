"""Flat streams of clause events as trees: parents, audit of numbers, amounts, rendering.

``events`` have doc, seq (unique in a document), kind, ordinal, label, text, page.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions.cells import parse_rupiah
from paperloom.functions.ordinals import BLOCKED_IN_PREAMBLE, LEVELS, RESETS, STYLES, from_number, level_index, to_number

# Heading depth and list depth of levels.
HEADINGS = {"judul": 1, "pembukaan": 2, "buku": 2, "bab": 2, "bagian": 3, "paragraf": 4, "pasal": 4}
LISTS = ("ayat", "huruf", "angka", "huruf2", "angka2")
AMOUNT_TOLERANCE = 0.5


def parents(events: DataFrame) -> DataFrame:
    """The events with parent_seq: the nearest earlier event of an outer level that is still open; null for the root.

    A preamble never holds chapters or articles: they go to the last title or the root. Plain text
    belongs to the last event that is no plain text. One window per document, no state machine.
    """
    w = Window.partitionBy("doc").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    level = level_index(F.col("kind"))
    x = events.withColumn("_l", level)
    last = {j: F.last(F.when((F.col("kind") != "teks") & (F.col("_l") == j), F.col("seq")), True).over(w) for j in range(len(LEVELS) + 1)}
    x = x.withColumns({f"_p{j}": c for j, c in last.items()})
    x = x.withColumn("_any", F.last(F.when(F.col("kind") != "teks", F.col("seq")), True).over(w))
    outer = F.greatest(*[F.when(F.col("_l") > j, F.col(f"_p{j}")) for j in range(len(LEVELS))], F.lit(None).cast("long"), F.lit(None).cast("long"))
    blocked = F.col("kind").isin(*BLOCKED_IN_PREAMBLE) & (outer == F.col("_p1"))
    parent = F.when(F.col("kind") == "teks", F.col("_any")).when(blocked, F.col("_p0")).otherwise(outer)
    return x.withColumn("parent_seq", parent).select(*events.columns, "parent_seq")


def ordinal_audit(events: DataFrame) -> DataFrame:
    """doc, seq, kind, page, severity, proposed, message of every number out of order.

    A repaired number is what the next one is compared with, so each document is one sequential
    scan; documents are bounded, their events are short.
    """
    x = events.where(F.col("kind").isin(*[k for k in LEVELS if STYLES[k] != "free"])).select("doc", "seq", "kind", "ordinal", "page", to_number(F.col("ordinal"), F.col("kind")).alias("value"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        last: dict[str, float] = {}
        out = []
        for e in pdf.sort_values("seq").to_dict("records"):
            kind, value = e["kind"], e["value"]
            for inner in LEVELS[LEVELS.index(kind) + 1 :]:
                if inner in RESETS:
                    last.pop(inner, None)
            before = last.get(kind)

            def note(severity, message, proposed=None, e=e):
                out.append({"doc": e["doc"], "seq": e["seq"], "kind": e["kind"], "page": e["page"], "severity": severity, "proposed": proposed, "message": message})

            if value is None or value != value:
                value = float(int(before) + 1 if before is not None else 1)
                note("perbaiki", "unreadable", value)
            elif before is None:
                if value != 1:
                    note("eskalasi", "does not begin at 1")
            else:
                base, step = int(value) - int(before), round((value - int(value)) * 100)
                if not ((base == 0 and step == round((before - int(before)) * 100) + 1) or (base == 1 and step == 0)):
                    note("eskalasi", "goes back" if value <= before else "one is missing" if int(value) == int(before) + 2 and step == 0 else "jumps")
            last[kind] = value
        return pd.DataFrame(out, columns=["doc", "seq", "kind", "page", "severity", "proposed", "message"])

    schema = f"doc {events.schema['doc'].dataType.simpleString()}, seq long, kind string, page long, severity string, proposed double, message string"
    found = x.groupBy("doc").applyInPandas(one, schema)
    return found.withColumn("proposed", from_number(F.col("proposed"), F.col("kind")))


def amount_audit(events: DataFrame) -> DataFrame:
    """doc, seq, total, declared of every clause whose lettered amounts do not add up to the amount it refers to.

    A clause counts if it has at least two lettered children with amounts and names, in its own
    text, a letter of an article or of a paragraph that holds an amount.
    """
    x = parents(events)
    w = Window.partitionBy("doc").orderBy("seq")
    x = x.withColumn("_pasal", F.last(F.when(F.col("kind") == "pasal", F.col("ordinal")), True).over(w))
    x = x.withColumn("_pseq", F.last(F.when(F.col("kind") == "pasal", F.col("seq")), True).over(w))
    x = x.withColumn("_ayat", F.last(F.when(F.col("kind") == "ayat", F.struct("seq", "ordinal")), True).over(w)).withColumn("_ayat", F.when(F.col("_ayat.seq") > F.col("_pseq"), F.col("_ayat.ordinal")))
    amount = parse_rupiah("text")
    letters = x.where(F.col("kind") == "huruf").withColumn("_amount", amount).where(F.col("_amount").isNotNull())
    index = letters.where(F.col("_pasal").isNotNull() & F.col("ordinal").isNotNull()).groupBy("doc", F.col("_pasal").alias("k1"), F.coalesce("_ayat", F.lit("")).alias("k2"), F.lower("ordinal").alias("k3")).agg(F.max_by("_amount", "seq").alias("declared"))
    sums = letters.groupBy("doc", F.col("parent_seq").alias("seq")).agg(F.sum("_amount").alias("total"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    by_pasal, by_ayat = r"(?i)Pasal\s+(\d+)\s+huruf\s*\(?([a-z])\)?", r"(?i)ayat\s*\((\d+)\)\s*huruf\s*\(?([a-z])\)?"
    t = F.col("text")
    k1 = F.when(t.rlike(by_pasal), F.regexp_extract(t, by_pasal, 1)).when(t.rlike(by_ayat), F.col("_pasal"))
    k2 = F.when(t.rlike(by_pasal), F.lit("")).when(t.rlike(by_ayat), F.regexp_extract(t, by_ayat, 1))
    k3 = F.lower(F.when(t.rlike(by_pasal), F.regexp_extract(t, by_pasal, 2)).when(t.rlike(by_ayat), F.regexp_extract(t, by_ayat, 2)))
    heads = x.where(F.col("kind").isin("pasal", "ayat") & t.isNotNull()).select("doc", "seq", k1.alias("k1"), k2.alias("k2"), k3.alias("k3"))
    return heads.join(sums, ["doc", "seq"]).join(index, ["doc", "k1", "k2", "k3"]).where(F.abs(F.col("total") - F.col("declared")) > AMOUNT_TOLERANCE).select("doc", "seq", "total", "declared")


def count_amount_checks(events: DataFrame) -> DataFrame:
    """doc, n_checks: clauses that name a total and have at least two lettered amounts."""
    x = parents(events)
    sums = x.where((F.col("kind") == "huruf") & parse_rupiah("text").isNotNull()).groupBy("doc", F.col("parent_seq").alias("seq")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    refers = F.col("text").rlike(r"(?i)Pasal\s+\d+\s+huruf\s*\(?[a-z]|ayat\s*\(\d+\)\s*huruf\s*\(?[a-z]")
    return x.where(F.col("kind").isin("pasal", "ayat") & refers).join(sums, ["doc", "seq"]).groupBy("doc").agg(F.count(F.lit(1)).alias("n_checks"))


def open_path(events: DataFrame) -> DataFrame:
    """doc, kind, ordinal, since_page, depth: the clauses still open after the last event, outermost first.

    This is what a later batch needs to go on; its size is the depth of the tree.
    """
    x = events.where(F.col("kind") != "teks").withColumn("_l", level_index(F.col("kind")))
    last = x.groupBy("doc", "_l").agg(F.max(F.struct("seq", "kind", "ordinal", "page")).alias("e"))
    w = Window.partitionBy("doc").orderBy("_l").rowsBetween(Window.unboundedPreceding, -1)
    inner = last.withColumn("_outer", F.max("e.seq").over(w)).where(F.col("_outer").isNull() | (F.col("e.seq") > F.col("_outer")))
    # A preamble is closed by the first chapter or article after it.
    body = F.max(F.when(F.col("e.kind").isin(*BLOCKED_IN_PREAMBLE), F.col("e.seq"))).over(Window.partitionBy("doc"))
    kept = inner.withColumn("_body", body).where((F.col("e.kind") != "pembukaan") | F.col("_body").isNull() | (F.col("_body") < F.col("e.seq")))
    depth = F.row_number().over(Window.partitionBy("doc").orderBy("_l"))
    return kept.select("doc", "e.kind", "e.ordinal", F.col("e.page").alias("since_page"), depth.alias("depth"))


def render(events: DataFrame, with_pages: bool = True) -> DataFrame:
    """doc, text: the tree as Markdown; headings by level, lists indented by depth under their heading."""
    x = parents(events)
    w = Window.partitionBy("doc").orderBy("seq")
    heading = F.col("kind").isin(*HEADINGS)
    x = x.withColumn("_h", F.last(F.when(heading, F.col("seq")), True).over(w))
    open_above = reduce(lambda a, b: a + b, [
        F.coalesce(F.when(level_index(F.col("kind")) > LEVELS.index(k), (F.col(f"_s_{k}") > F.coalesce("_h", F.lit(-1))).cast("int")), F.lit(0)) for k in LISTS
    ])
    x = x.withColumns({f"_s_{k}": F.last(F.when(F.col("kind") == k, F.col("seq")), True).over(w) for k in LISTS})
    hashes = F.try_element_at(F.create_map(*[F.lit(v) for k, d in HEADINGS.items() for v in (k, "#" * d)]), F.col("kind"))
    name = F.when(F.col("kind") == "bab", "BAB").otherwise(F.initcap("kind"))
    number = F.when(F.col("kind").isin("bab", "buku"), F.upper("ordinal")).otherwise(F.col("ordinal"))
    marker = F.concat(F.lit("  <!-- hal."), F.col("page").cast("string"), F.lit(" -->")) if with_pages else F.lit("")
    head = F.concat(F.lit("\n"), hashes, F.lit(" "), F.concat_ws(" ", name, number), F.coalesce(F.concat(F.lit(" — "), "label"), F.lit("")), marker, F.coalesce(F.concat(F.lit("\n\n"), F.nullif("text", F.lit(""))), F.lit("")))
    bullet = F.when(F.col("kind") == "ayat", F.concat(F.lit("("), "ordinal", F.lit(")"))).when(F.col("kind").isin("huruf", "angka"), F.concat("ordinal", F.lit("."))).otherwise(F.concat("ordinal", F.lit(")")))
    item = F.rtrim(F.concat(F.repeat(F.lit("  "), open_above), F.lit("- "), bullet, F.lit(" "), F.coalesce("text", "label", F.lit(""))))
    plain = F.concat(F.lit("\n"), F.nullif("text", F.lit("")))
    line = F.when(heading, head).when(F.col("kind").isin(*LISTS), item).otherwise(plain)
    g = x.withColumn("_line", line).where(F.col("_line").isNotNull()).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("seq", "_line"))).alias("l"))
    return g.select("doc", F.concat(F.trim(F.regexp_replace(F.regexp_replace(F.array_join(F.col("l._line"), "\n"), r"\n{3,}", "\n\n"), r"^\n+", "")), F.lit("\n")).alias("text"))


def violation_report(violations: DataFrame) -> DataFrame:
    """doc, report: the findings of each document as text."""
    tag = F.when(F.col("severity") == "perbaiki", "PERBAIKI ").otherwise("ESKALASI ")
    line = F.concat(F.lit("  "), tag, F.format_string("hal.%-4s %-9s ", F.col("page").cast("string"), F.col("kind")), "message", F.coalesce(F.concat(F.lit("  -> "), "proposed"), F.lit("")))
    g = violations.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("seq", line.alias("t")))).alias("l"))
    return g.select("doc", F.concat(F.format_string("Auditor: %d temuan\n", F.size("l")), F.array_join(F.col("l.t"), "\n")).alias("report"))
