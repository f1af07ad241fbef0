"""Scanned pages by their geometry: clusters of lines, spans of equal layout, batches that end at row starts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

FILLED, EMPTY, SHIFT = 13.0, 9.0, 0.03


def density_class(density: Column) -> Column:
    """filled, empty or unsure by ink per thousand."""
    return F.when(density >= FILLED, "filled").when(density <= EMPTY, "empty").otherwise("unsure")


def clusters(points: DataFrame, group: str, value: str, gap: float) -> DataFrame:
    """group, cluster, n, centre, first, last: runs of values no more than ``gap`` apart."""
    w = Window.partitionBy(group).orderBy(value)
    new = F.coalesce((F.col(value) - F.lag(value).over(w) > gap).cast("int"), F.lit(0))
    x = points.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(group, "cluster").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("centre"), F.min(value).alias("first"), F.max(value).alias("last"))


def inherit(pages: DataFrame, doc: str, order: str, value: str, reset: Column) -> DataFrame:
    """A page's grid or, where none was found, the last one found since the last reset."""
    w = Window.partitionBy(doc).orderBy(order)
    x = pages.withColumn("_island", F.sum(F.coalesce(reset.cast("int"), F.lit(0))).over(w))
    return x.withColumn(value, F.last(value, True).over(Window.partitionBy(doc, "_island").orderBy(order))).drop("_island")


def spans(pages: DataFrame, doc: str, page: str, mode: str, separators: str) -> DataFrame:
    """doc, page, span: a new span where the mode changes or, in table mode, columns differ in number or by more than SHIFT from the span's first page.

    The comparison is with the first page of the span, so the scan runs along a document.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out, head, span = [], None, 0
        for r in pdf.sort_values("p").to_dict("records"):
            s = list(r["s"]) if r["s"] is not None else []
            differs = head is None or r["m"] != head[0] or (r["m"] == "table" and (len(s) != len(head[1]) or any(abs(a - b) > SHIFT for a, b in zip(s, head[1]))))
            if differs:
                head, span = (r["m"], s), span + 1
            out.append((r["d"], r["p"], span))
        return pd.DataFrame(out, columns=[doc, page, "span"])

    fields = [T.StructField(doc, pages.schema[doc].dataType), T.StructField(page, pages.schema[page].dataType), T.StructField("span", T.IntegerType())]
    return pages.select(F.col(doc).alias("d"), F.col(page).alias("p"), F.col(mode).alias("m"), F.col(separators).alias("s")).groupBy("d").applyInPandas(one, T.StructType(fields))


def plan_batches(pages: DataFrame, group: str, page: str, starts_row: str, size: int = 10, snap: int = 2) -> DataFrame:
    """group, batch, first_page, last_page: runs of about ``size`` pages that begin, where one is near, on a page that starts a row."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        ps = sorted(int(x) for x in pdf["p"])
        rows = {int(p) for p, s in zip(pdf["p"], pdf["s"]) if s} | {ps[0]}
        out, start = [], ps[0]
        while start <= ps[-1]:
            after = start + size
            near = sorted((abs(p - after), p) for p in rows if abs(p - after) <= snap and start < p <= ps[-1])
            after = near[0][1] if near and after <= ps[-1] else after
            out.append((pdf["g"].iloc[0], len(out) + 1, start, min(after - 1, ps[-1])))
            start = after
        return pd.DataFrame(out, columns=[group, "batch", "first_page", "last_page"])

    fields = [T.StructField(group, pages.schema[group].dataType), *[T.StructField(c, T.IntegerType()) for c in ("batch", "first_page", "last_page")]]
    return pages.select(F.col(group).alias("g"), F.col(page).alias("p"), F.col(starts_row).alias("s")).groupBy("g").applyInPandas(one, T.StructType(fields))
