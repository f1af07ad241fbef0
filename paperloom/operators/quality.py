"""Trust in recognised text, and how pages are reflowed."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions.cells import let, strip
from paperloom.functions.pagetext import normalized_words

HIGH, MEDIUM = 0.72, 0.48
BLANK_INK, SPARSE_INK = 0.0002, 0.015


def similarity(a: Column, b: Column) -> Column:
    """Share of matching blocks of two texts, null if either is."""

    @F.pandas_udf(T.DoubleType())
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, p, q).ratio() if isinstance(p, str) and isinstance(q, str) else None for p, q in zip(x, y)], dtype="float64")

    return ratio(a, b)


def assessed(pages: DataFrame, text: str, n_regions: str, native: str | None = None, ink: str | None = None) -> DataFrame:
    """The pages with score (0 to 1), trust_level and risk_flags of their recognised text.

    Length, printable and alphanumeric share, found regions, repeated lines, leaked tags, ink and
    likeness to a native text layer each add or take away; the layer counts from twelve characters on.
    """
    x = pages.withColumn("_v", strip(F.coalesce(F.col(text), F.lit(""))))
    v, n = F.col("_v"), F.length("_v")
    share = lambda p: F.when(n > 0, F.length(F.regexp_replace(v, p, "")) / n).otherwise(0.0)
    x = x.withColumns({"_print": share(r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}&&[^\n\t]]"), "_alnum": share(r"[^\p{L}\p{N}]"), "_lines": F.filter(F.transform(F.split("_v", "\n"), strip), lambda s: s != "")})
    x = x.withColumn("_native", normalized_words(F.coalesce(F.col(native), F.lit(""))) if native else F.lit(""))
    x = x.withColumn("_sim", F.when(F.length("_native") >= 12, similarity(F.col("_native"), normalized_words(v)))) if native else x.withColumn("_sim", F.lit(None).cast("double"))
    i = F.col(ink) if ink else F.lit(1.0)
    blank, sparse = i <= BLANK_INK, (i > BLANK_INK) & (i <= SPARSE_INK)
    repeated = (F.size("_lines") >= 4) & (F.size(F.array_distinct("_lines")) / F.size("_lines") < 0.5)
    leaked = v.contains("<|det|>") | v.contains("<|/det|>")
    overfull = sparse & (n > F.greatest(F.lit(160), F.floor(i * 100_000)))
    p, a, s, r = F.col("_print"), F.col("_alnum"), F.col("_sim"), F.coalesce(F.col(n_regions), F.lit(0)) > 0
    points = [
        F.when(n >= 12, 0.08).when(n < 4, -0.30), F.when(p >= 0.98, 0.08).when(p < 0.90, -0.20), F.when(a >= 0.35, 0.08).when(a < 0.15, -0.18), F.when(r, 0.15).otherwise(-0.10),
        F.when(repeated, -0.22), F.when(leaked, -0.20), F.when(overfull, -0.22), F.when(s >= 0.70, 0.18).when(s < 0.30, -0.30),
    ]
    total = F.lit(0.46)
    for q in points:
        total = total + F.coalesce(q, F.lit(0.0))
    flags = F.array_compact(F.array(
        F.when(n < 4, "too_short"), F.when(p < 0.90, "non_printable_output"), F.when(a < 0.15, "low_alphanumeric_ratio"), F.when(~r, "missing_grounding"), F.when(repeated, "repetitive_output"),
        F.when(leaked, "malformed_grounding"), F.when(blank, "blank_image"), F.when(sparse, "sparse_page"), F.when(overfull, "sparse_output_mismatch"), F.when(s < 0.30, "native_text_mismatch"),
    ))
    score = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)), 6)
    out = x.withColumn("score", score).withColumn("risk_flags", flags)
    return out.withColumn("trust_level", F.when(F.col("score") >= HIGH, "high").when(F.col("score") >= MEDIUM, "medium").otherwise("low")).select(*pages.columns, "score", "trust_level", "risk_flags")


def ink_signals(images: DataFrame, key: str, pixels: str, width: str) -> DataFrame:
    """key, ink_ratio, row_energy, column_energy of grey images given as bytes and a width."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, raw, w in zip(pdf["k"], pdf["p"], pdf["w"]):
                w = int(w)
                dark = np.frombuffer(bytes(raw), dtype=np.uint8)
                dark = dark[: len(dark) // w * w].reshape(-1, w) < 220 if w > 0 else np.zeros((0, 0), bool)
                n = int(dark.sum())
                energy = lambda axis, d=dark, n=n: float((d.sum(axis=axis).astype(float) ** 2).sum() / (n * n)) if n else 0.0
                out.append((k, n / dark.size if dark.size else 0.0, energy(1), energy(0)))
            yield pd.DataFrame(out, columns=[key, "ink_ratio", "row_energy", "column_energy"])

    fields = [T.StructField(key, images.schema[key].dataType), *[T.StructField(c, T.DoubleType()) for c in ("ink_ratio", "row_energy", "column_energy")]]
    return images.where(F.col(pixels).isNotNull()).select(F.col(key).alias("k"), F.col(pixels).alias("p"), F.col(width).alias("w")).mapInPandas(run, T.StructType(fields))


def reflow_status(kinds: Column, specs: Column, source: Column, output: Column, supported: tuple[str, ...], excluded: tuple[str, ...], blocked: tuple[str, ...]) -> Column:
    """applied, or why a page keeps its first text: style, no regions, other than text, empty, or content lost or added beyond 15 per cent."""
    letters = lambda c: F.length(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}]", ""))
    names = lambda t: F.array(*map(F.lit, t))
    ratio = letters(output) / letters(source)
    return (
        F.when(F.arrays_overlap(specs, names(excluded)) | ~F.arrays_overlap(specs, names(supported)), "ineligible_spec").when(F.size(kinds) <= 0, "missing_regions")
        .when(F.arrays_overlap(kinds, names(blocked)), "non_text_region").when((letters(source) == 0) | (letters(output) == 0), "empty_output")
        .when((ratio < 0.85) | (ratio > 1.15), "content_guard").otherwise("applied")
    )


# Styles whose pages are reflowed, styles that never are, kinds of regions that cannot be.
REFLOWED, NEVER_REFLOWED, NOT_TEXT = ("plain", "markdown_hierarchy", "bilingual_journal"), ("presentation_slides", "chat_transcript", "signature_form"), ("table", "figure", "formula")
_OPENERS = {"title": "# ", "section": "## ", "list": "- "}


def reflow_regions(regions: DataFrame, page: list[str], order: list[str], kind: str, text: str, specs: Column) -> DataFrame:
    """page, status, text: the regions of each page as paragraphs in reading order, if the page may be reflowed.

    The lines of a region become one, a word cut by a hyphen before a small letter becomes whole;
    titles and sections become headings, list items bullets, footnotes stay last. Regions without text are
    left out. ``status`` says why a page keeps its first text; its text is null then.
    """
    whole = F.regexp_replace(F.col(text), r"([\p{L}\p{N}])[-‐‑¬\u00ad][ \t]*\n[ \t]*(\p{Ll})", "$1$2")
    flat = strip(F.regexp_replace(whole, r"[\s\p{Z}\x1c-\x1f\x85]+", " "))
    opener = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in _OPENERS.items() for x in kv]), F.col(kind)), F.lit(""))
    block = F.struct((F.col(kind) == "footnote").alias("last"), *order, F.when(flat != "", F.concat(opener, flat)).alias("b"))
    g = regions.select(*page, block.alias("x"), F.coalesce(text, F.lit("")).alias("t"), kind, specs.alias("s")).groupBy(*page).agg(
        F.array_sort(F.collect_list("x")).alias("x"), F.array_join(F.collect_list("t"), " ").alias("source"), F.collect_set(kind).alias("kinds"), F.first("s").alias("specs")
    )
    out = F.array_join(F.array_compact(F.col("x.b")), "\n\n")
    done = g.select(*page, "kinds", "specs", "source", out.alias("text"))
    status = reflow_status(F.col("kinds"), F.col("specs"), F.col("source"), F.col("text"), REFLOWED, NEVER_REFLOWED, NOT_TEXT)
    return done.withColumn("status", status).select(*page, "status", F.when(F.col("status") == "applied", F.col("text")).alias("text"))


def style_consensus(pages: DataFrame, key: str, order: str, spec: str) -> DataFrame:
    """key, spec: the first style of a document's pages that is not plain, else plain."""
    telling = F.when(F.col(spec) != "plain", F.struct(order, spec))
    return pages.groupBy(key).agg(F.coalesce(F.min(telling)[spec], F.lit("plain")).alias(spec))


def column_density(matrix: DataFrame, key: str, values: str) -> DataFrame:
    """key, density: a column's mean ink per thousand, from an array of 0 and 1."""
    return matrix.select(key, let(F.col(values), lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a) * 1000).alias("density"))
