"""Ruled tables on scanned pages: skew, grid lines, where rows begin.

Pages are grey pictures in a binary column, each bounded by the size of a sheet, handled in Arrow
batches by numpy; everything between pages is a join or a window elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# What counts as ink, as a long line across and down, as one line, as the page's edge; distances from lines; angles tried.
INK, LONG_ACROSS, LONG_DOWN, ONE_LINE, EDGE = 128, 0.35, 0.85, 8, 0.01
BODY_MARGIN, TOKEN_TOLERANCE, MOST_SKEW, SKEW_STEP = 20, 4.0, 1.2, 0.1
LEAST_BODY, LEAST_HEADER = 150, 20


def lines_at(profile: np.ndarray, least: float) -> np.ndarray:
    """Centres of the runs of places whose ink exceeds ``least``; runs up to ONE_LINE apart are one line."""
    on = np.flatnonzero(profile > least)
    if not len(on):
        return on
    runs = np.split(on, np.flatnonzero(np.diff(on) > ONE_LINE) + 1)
    return np.array([(r[0] + r[-1]) // 2 for r in runs])


def skew_of(ink: np.ndarray) -> float:
    """The slope in degrees under which the most ink falls into one row; dark points are sheared, no picture is turned."""
    y, x = np.nonzero(ink[::2, ::2])
    best = (-1, 0.0)  # ink in one row, angle; of equals the flatter one
    for step in range(-round(MOST_SKEW / SKEW_STEP), round(MOST_SKEW / SKEW_STEP) + 1):
        degrees = step * SKEW_STEP
        rows = np.round(y - x * np.tan(np.radians(degrees))).astype(np.int64)
        most = int(np.bincount(rows - rows.min()).max()) if len(rows) else 0
        best = max(best, (most, degrees), key=lambda b: (b[0], -abs(b[1])))
    return round(best[1], 2)


def straightened(ink: np.ndarray, degrees: float) -> np.ndarray:
    """The picture with each column moved by what the slope moved it."""
    height, width = ink.shape
    moved = np.round(np.arange(width) * np.tan(np.radians(degrees))).astype(np.int64)
    rows = np.arange(height)[:, None] + moved[None, :]
    return np.where((rows >= 0) & (rows < height), ink[np.clip(rows, 0, height - 1), np.arange(width)], False)


def grid_of(ink: np.ndarray) -> dict | None:
    """The grid of a page whose table has a ruled header: places of its columns, header and body, or None.

    The body begins below the first wide gap between long lines; columns are measured in the header
    above it, where the lines down are unbroken.
    """
    height, width = ink.shape
    across = lines_at(ink.sum(axis=1), LONG_ACROSS * width)
    gaps = np.flatnonzero(np.diff(across) >= max(LEAST_BODY, int(0.055 * height)))
    if len(across) < 3 or not len(gaps) or gaps[0] == 0:
        return None
    top, bottom = int(across[0]), int(across[gaps[0]])
    if bottom - top < LEAST_HEADER:
        return None
    down = lines_at(ink[top:bottom].sum(axis=0), LONG_DOWN * (bottom - top))
    down = down[(down > EDGE * width) & (down < (1 - EDGE) * width)]
    if len(down) < 2:
        return None
    body_top, body_bottom = bottom + BODY_MARGIN, int(across[-1]) - BODY_MARGIN
    if body_bottom <= body_top + 50:
        body_bottom = height - int(0.06 * height)
    return {"separators": [round(float(v) / width, 3) for v in down], "header_top": top, "header_bottom": bottom, "body_top": body_top, "body_bottom": body_bottom}


_GRID = T.StructType([T.StructField("mode", T.StringType()), T.StructField("skew", T.DoubleType()), T.StructField("separators", T.ArrayType(T.DoubleType())), *[T.StructField(n, T.IntegerType()) for n in ("header_top", "header_bottom", "body_top", "body_bottom")]])


def survey_pages(pages: DataFrame, keys: list[str], pixels: str, width: str) -> DataFrame:
    """keys, mode (table or text), skew, separators (as shares of the width), header_top, header_bottom, body_top, body_bottom of every page.

    A page with long lines but no grid is looked at again after its skew is undone. Null pictures and
    those without width are pages of text.
    """
    kind = T.StructType([*[pages.schema[k] for k in keys], *_GRID.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                out = {c: row[c] for c in keys} | {"mode": "text", "skew": 0.0}
                w = int(row["_w"] or 0)
                if row["_p"] is not None and w > 0:
                    grey = np.frombuffer(row["_p"], np.uint8)
                    ink = grey[: len(grey) // w * w].reshape(-1, w) < INK
                    grid = grid_of(ink) if ink.size else None
                    if grid is None and ink.size and (ink.sum(axis=1) > LONG_ACROSS * w / 2).any() and abs(degrees := skew_of(ink)) >= SKEW_STEP / 2:
                        grid = grid_of(straightened(ink, degrees))
                        out["skew"] = degrees if grid else 0.0
                    if grid:
                        out |= {"mode": "table"} | grid
                yield pa.RecordBatch.from_pylist([out], schema=to_arrow_schema(kind))

    return pages.select(*keys, F.col(pixels).alias("_p"), F.col(width).alias("_w")).mapInArrow(run, kind)


def row_starts(words: DataFrame, grids: DataFrame, keys: list[str], width: str) -> DataFrame:
    """keys, tokens: the words with digits in the first column of each page's table body, which begin its rows; none gives no row.

    ``words`` have the keys, x, y, text in the picture's points, ``grids`` the result of ``survey_pages`` with the page's width.
    """
    g = grids.where("mode = 'table'").select(*keys, (F.col("separators")[0] * F.col(width)).alias("_x0"), (F.col("separators")[1] * F.col(width)).alias("_x1"), "body_top", "body_bottom")
    inside = F.col("x").between(F.col("_x0") - 2, F.col("_x1") + 2) & F.col("y").between(F.col("body_top") - BODY_MARGIN - TOKEN_TOLERANCE, F.col("body_bottom"))
    hit = words.where(F.col("text").rlike(r"[0-9]")).join(g, keys).where(inside)
    return hit.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "text"))), lambda w: w["text"]).alias("tokens"))
