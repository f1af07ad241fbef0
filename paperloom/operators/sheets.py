"""Spreadsheets as sparse cells: regions, references, roles of sheets and rows, charts, native tables.

``cells`` have sheet, row, col, text, kind (n number, s text, b bool, d date) and formula; a workbook
column may lead the keys. Region growth and the row scan depend on order inside one sheet or region,
a bounded unit, and run as grouped Arrow batches; the rest is column expressions and joins on the sheet.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from paperloom.functions.cells import FILTER_TOKENS, category_family, in_bounds

# Labels and formulas of aggregate rows.
EXACT_TOTAL = r"(?i)^(?:grand\s*total|sub\s*-?\s*total|total(?:\s+(?:keseluruhan|akhir|umum))?|jumlah(?:\s+(?:total|keseluruhan|akhir))?)\s*:?$"
SUFFIX_TOTAL = r"(?i)^.+\s+(?:sub\s*-?\s*)?total\s*:?$"
GRAND_TOTAL = r"(?i)grand|keseluruhan|akhir|umum"
SUM_FORMULA = r"(?i)^=\s*(?:SUM|SUBTOTAL|AGGREGATE)\s*\((?:\s*\d+\s*,){0,2}\s*\$?([A-Z]{1,3})\$?(\d+)\s*:\s*\$?([A-Z]{1,3})\$?(\d+)\s*\)\s*$"


def _grow(points: set[tuple[int, int]]) -> list[set[tuple[int, int]]]:
    """Components of cells that touch at an edge, in the order of their first cell."""
    out, left = [], set(points)
    for start in sorted(points):
        if start not in left:
            continue
        left.discard(start)
        part, todo = {start}, [start]
        while todo:
            r, c = todo.pop()
            for near in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
                if near in left:
                    left.discard(near)
                    part.add(near)
                    todo.append(near)
        out.append(part)
    return out


def _main_family(kinds: list[str]) -> str | None:
    return max(dict.fromkeys(kinds), key=kinds.count) if kinds else None


def header_bands(part: set[tuple[int, int]], kind: dict[tuple[int, int], str]) -> list[set[tuple[int, int]]]:
    """Tables that stand on each other without a blank row, parted where a row of texts between rows of values opens other columns or types."""
    rows: dict[int, dict[int, str]] = {}
    for p in part:
        if p in kind:
            rows.setdefault(p[0], {})[p[1]] = kind[p]
    order = sorted(rows)
    if len(order) < 4:
        return [part]
    only_text = {r: all(k == "s" for k in rows[r].values()) for r in order}
    left = min(c for _, c in part)
    starts, band = [], 0

    def family(rs: list[int]) -> str | None:
        return _main_family([rows[r][left] for r in rs if not only_text[r] and left in rows[r]])

    for i in range(1, len(order) - 1):
        r = order[i]
        if len(rows[r]) < 2 or not only_text[r] or only_text[order[i - 1]] or only_text[order[i + 1]]:
            continue
        above, below = order[band:i], order[i:]
        columns = lambda rs: {c for x in rs for c in rows[x]}
        f, g = family(above), family(order[i + 1 :])
        if columns(above) != columns(below) or (f is not None and g is not None and f != g):
            starts.append(r)
            band = i
    if not starts:
        return [part]
    edges = [0, *starts, 1 << 30]
    return [b for lo, hi in zip(edges, edges[1:]) for b in _grow({p for p in part if lo <= p[0] < hi})]


REGION_SCHEMA = "region_no int, min_row int, max_row int, min_col int, max_col int, n_cells int, kind string, source string"


def regions(cells: DataFrame, keys: list[str], declared: DataFrame | None = None) -> DataFrame:
    """The rectangles of each sheet: declared ones first, then components of the cells that are left.

    ``declared`` has the keys, priority (0 table, 1 name, 2 filter) and bounds; one that overlaps an
    earlier one is dropped. A region is a table if declared or at least 2 by 2 and no
    parameter block, else text. A sheet is one group; sheets are bounded by their format.
    """
    base = cells.where(F.col("text").isNotNull() & (F.trim("text") != "") | F.col("formula").isNotNull())
    slim = base.select(*keys, "row", "col", "kind", "text", F.col("formula").isNotNull().alias("f"), F.lit(-1).alias("max_row"), F.lit(-1).alias("max_col"), F.lit(-1).alias("priority"))
    if declared is not None:
        slim = slim.unionByName(declared.select(
            *keys, F.col("min_row").alias("row"), F.col("min_col").alias("col"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("text"),
            F.lit(False).alias("f"), "max_row", "max_col", "priority",
        ))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        key = {k: pdf[k].iloc[0] for k in keys}
        spec, body = pdf[pdf.priority >= 0].sort_values(["priority", "row", "col"]), pdf[pdf.priority < 0]
        kind = {(int(r), int(c)): k for r, c, k in zip(body["row"], body["col"], body["kind"])}
        texts = {(int(r), int(c)): t for r, c, t in zip(body["row"], body["col"], body["text"])}
        formulas = {(int(r), int(c)) for r, c, f in zip(body["row"], body["col"], body["f"]) if f}
        taken: list[tuple[int, int, int, int, str]] = []
        for r in spec.to_dict("records"):
            b = (int(r["row"]), int(r["max_row"]), int(r["col"]), int(r["max_col"]))
            if not any(b[0] <= t[1] and t[0] <= b[1] and b[2] <= t[3] and t[2] <= b[3] for t in taken):
                taken.append((*b, ("table", "name", "filter")[int(r["priority"])]))
        inside = lambda p, t: t[0] <= p[0] <= t[1] and t[2] <= p[1] <= t[3]
        free = {p for p in kind if not any(inside(p, t) for t in taken)}
        found = [(t[:4], t[4], sum(inside(p, t) for p in kind)) for t in taken]
        for part in _grow(free):
            for band in header_bands(part, kind):
                rs, cs = [p[0] for p in band], [p[1] for p in band]
                found.append(((min(rs), max(rs), min(cs), max(cs)), "cells", len(band)))
        out = []
        for b, source, n in sorted(found, key=lambda x: (x[0][0], x[0][2])):
            own = {p for p in kind if inside(p, (*b, ""))}
            table = source in ("table", "filter") or (b[1] > b[0] and b[3] > b[2] and not _parameter_block(own, b, texts, kind, formulas))
            out.append({**key, "region_no": len(out) + 1, "min_row": b[0], "max_row": b[1], "min_col": b[2], "max_col": b[3], "n_cells": n, "kind": "table" if table else "text", "source": source})
        return pd.DataFrame(out, columns=[*keys, "region_no", "min_row", "max_row", "min_col", "max_col", "n_cells", "kind", "source"])

    fields = [cells.schema[k] for k in keys] + T.StructType.fromDDL(REGION_SCHEMA).fields
    return slim.groupBy(*keys).applyInPandas(one, T.StructType(fields))


def _parameter_block(own, b, texts, kind, formulas) -> bool:
    """Whether a small block is a list of labels and filter values."""
    if b[3] - b[2] != 1 or own & formulas:
        return False
    rows = sorted({p[0] for p in own})
    if not 1 <= len(rows) <= 4:
        return False
    colon, token = True, False
    for r in rows:
        label, value = texts.get((r, b[2])), texts.get((r, b[3]))
        if kind.get((r, b[2])) != "s" or not label or not label.strip() or not value:
            return False
        colon = colon and label.strip().endswith(":")
        token = token or (kind.get((r, b[3])) == "s" and value.strip().casefold() in FILTER_TOKENS)
    return token or colon


def tiles(region: DataFrame, max_rows: int = 50, max_cols: int = 20) -> DataFrame:
    """Regions cut into rectangles of at most so many rows and columns."""
    x = region.withColumn("tile_row", F.explode(F.sequence(F.lit(0), F.floor((F.col("max_row") - F.col("min_row")) / max_rows).cast("int"))))
    x = x.withColumn("tile_col", F.explode(F.sequence(F.lit(0), F.floor((F.col("max_col") - F.col("min_col")) / max_cols).cast("int"))))
    top, left = F.col("min_row") + F.col("tile_row") * max_rows, F.col("min_col") + F.col("tile_col") * max_cols
    return x.select(
        *[c for c in region.columns if c not in ("min_row", "max_row", "min_col", "max_col")], "tile_row", "tile_col",
        top.alias("min_row"), F.least(top + max_rows - 1, F.col("max_row")).alias("max_row"), left.alias("min_col"), F.least(left + max_cols - 1, F.col("max_col")).alias("max_col"),
    )


def combine_tiles(tile_cells: DataFrame, keys: list[str]) -> DataFrame:
    """The cells of all tiles, each coordinate once."""
    return tile_cells.dropDuplicates([*keys, "row", "col"])


def coverage(region: DataFrame, cells: DataFrame, references: DataFrame, keys: list[str]) -> DataFrame:
    """keys, region_no, n_cells, n_covered, share: which part of a region's cells references point at.

    Cells meet regions and references on the sheet and by bounds; references are reduced to distinct
    rectangles per sheet first, and each cell counts once however many references cover it.
    """
    c = cells.select(*keys, "row", "col").distinct()
    r = region.select(*keys, "region_no", "min_row", "max_row", "min_col", "max_col")
    inside = c.join(r, keys).where(in_bounds(F.col("row"), F.col("col"), F.struct("min_row", "max_row", "min_col", "max_col"))).select(*keys, "region_no", "row", "col")
    refs = references.select(*keys, *[F.col(b).alias(f"_{b}") for b in ("min_row", "max_row", "min_col", "max_col")]).distinct()
    hit = c.join(refs, keys).where(F.col("row").between(F.col("_min_row"), F.col("_max_row")) & F.col("col").between(F.col("_min_col"), F.col("_max_col"))).select(*keys, "row", "col").distinct()
    x = inside.join(hit.withColumn("_h", F.lit(1)), [*keys, "row", "col"], "left").groupBy(*keys, "region_no").agg(F.count(F.lit(1)).alias("n_cells"), F.count("_h").alias("n_covered"))
    return x.withColumn("share", F.col("n_covered") / F.col("n_cells"))


def crossing_ranges(ranges: DataFrame, region: DataFrame, keys: list[str]) -> DataFrame:
    """keys, range_id, n_regions of chart ranges that touch more than one region."""
    r = region.select(*keys, "region_no", *[F.col(b).alias(f"_{b}") for b in ("min_row", "max_row", "min_col", "max_col")])
    touch = (F.col("max_row") >= F.col("_min_row")) & (F.col("_max_row") >= F.col("min_row")) & (F.col("max_col") >= F.col("_min_col")) & (F.col("_max_col") >= F.col("min_col"))
    return ranges.join(r, keys).where(touch).groupBy(*keys, "range_id").agg(F.countDistinct("region_no").alias("n_regions")).where("n_regions >= 2")


def external_references(references: DataFrame, region: DataFrame, keys: list[str]) -> DataFrame:
    """References that do not come from inside the region they point at; ``references`` have region_no, source_sheet, source_row, source_col."""
    x = references.join(region.select(*keys, "region_no", F.col("min_row").alias("_r0"), F.col("max_row").alias("_r1"), F.col("min_col").alias("_c0"), F.col("max_col").alias("_c1")), [*keys, "region_no"])
    own = (F.col("source_sheet") == F.col(keys[-1])) & F.col("source_row").between(F.col("_r0"), F.col("_r1")) & F.col("source_col").between(F.col("_c0"), F.col("_c1"))
    return x.where(~F.coalesce(own, F.lit(False))).drop("_r0", "_r1", "_c0", "_c1")


def native_artefacts(cells: DataFrame, region: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_cells, n_formulas, n_tables, n_other: what each sheet holds, counted before the two sides meet."""
    full = F.col("text").isNotNull() & (F.trim("text") != "")
    a = cells.groupBy(*keys).agg(F.count_if(full | F.col("formula").isNotNull()).alias("n_cells"), F.count("formula").alias("n_formulas"))
    b = region.groupBy(*keys).agg(F.count_if(F.col("kind") == "table").alias("n_tables"), F.count_if(F.col("kind") != "table").alias("n_other"))
    return a.join(b, keys, "left").select(*keys, "n_cells", "n_formulas", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_tables", "n_other")])


def sheet_roles(sheets: DataFrame) -> DataFrame:
    """role, role_confidence of each sheet from has_charts, visible, n_formulas, n_cells, n_dependencies, feeds_dashboard and its largest table (rows, cols, cells)."""
    ratio = F.col("n_formulas") / F.greatest(F.lit(1), F.col("n_cells"))
    tall = (F.col("t_rows") >= F.greatest(F.lit(12), 3 * F.col("t_cols"))) & (F.col("t_cells") >= 0.55 * F.col("t_rows") * F.col("t_cols"))
    aggregating = (ratio >= 0.35) & (F.col("n_dependencies") > 0)
    role = (
        F.when(F.col("has_charts"), "dashboard").when(F.col("feeds_dashboard") & aggregating, "support").when(aggregating, "summary")
        .when(F.coalesce(tall, F.lit(False)), "detail").otherwise("plain")
    )
    conf = F.when(role == "dashboard", 0.98).when(role.isin("support", "detail"), 0.9).when(role == "summary", F.least(F.lit(0.95), 0.65 + ratio / 3)).otherwise(0.65)
    return sheets.where("visible").withColumn("role", role).withColumn("role_confidence", conf)


def feeds_dashboards(dependencies: DataFrame, dashboards: DataFrame, keys: list[str]) -> DataFrame:
    """The sheets that a dashboard reads: (keys, sheet) of ``dependencies`` (keys, sheet, depends_on)."""
    return dependencies.join(dashboards.select(*keys, "sheet"), [*keys, "sheet"], "left_semi").select(*keys, F.col("depends_on").alias("sheet")).distinct()


def header_rows(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, header_row: the best of a region's first twelve rows with at least two cells, two of them texts; none if there is none."""
    text = (F.col("kind") == "s") & (F.trim("text") != "")
    full = F.col("text").isNotNull() & (F.trim("text") != "")
    rows = cells.groupBy(*keys, "row").agg(
        F.count_if(full).alias("n"), F.count_if(text).alias("s"), F.count_if(F.col("kind") == "n").alias("num"), F.count_if(F.col("formula").isNotNull()).alias("f"),
        F.countDistinct(F.when(full, F.lower("text"))).alias("u"), F.count_if(F.length("text") > 80).alias("long"), F.max("col").alias("hi"), F.min("col").alias("lo"),
    )
    w = Window.partitionBy(*keys)
    o = w.orderBy("row")
    x = rows.where("n > 0").withColumn("_k", F.row_number().over(o)).withColumn("_next", F.lead("n").over(o)).withColumn("_num", F.lead("num").over(o))
    x = x.withColumn("_w", F.max("hi").over(w) - F.min("lo").over(w) + 1)
    score = (
        F.col("s") + 2 * F.col("n") / F.col("_w") + F.col("u") / F.col("n") + F.when(F.coalesce("_next", F.lit(0)) >= 2, 3.0).otherwise(0.0)
        + F.least(F.lit(2.0), 0.5 * F.coalesce("_num", F.lit(0))) - 0.75 * F.col("f") - F.when(F.col("long") > 0, 0.5 * F.col("long")).otherwise(0.0)
    )
    return x.where("_k <= 12 AND s >= 2 AND n >= 2").groupBy(*keys).agg(F.max_by("row", F.struct(score, F.col("row"))).alias("header_row"))


def _column_number(letters: str) -> int:
    n = 0
    for ch in letters.upper():
        n = n * 26 + ord(ch) - 64
    return n


def row_roles(cells: DataFrame, keys: list[str], header: DataFrame) -> DataFrame:
    """keys, row, row_role (data, subtotal, grand_total) of the rows below each region's header.

    The scan remembers which text columns the last data row had, so it runs per region.
    """
    x = cells.join(header.select(*keys, "header_row"), keys).where(F.col("row") > F.col("header_row"))
    fields = [cells.schema[k] for k in keys] + [T.StructField("row", T.IntegerType()), T.StructField("row_role", T.StringType())]
    exact, suffix, grand, formula = map(re.compile, (EXACT_TOTAL, SUFFIX_TOTAL, GRAND_TOTAL, SUM_FORMULA))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        key, head = {k: pdf[k].iloc[0] for k in keys}, int(pdf["header_row"].iloc[0])
        rows: dict[int, list[dict]] = {}
        for c in pdf.sort_values(["row", "col"]).to_dict("records"):
            rows.setdefault(int(c["row"]), []).append(c)
        full = lambda c: isinstance(c["text"], str) and c["text"] != ""
        order = [r for r in sorted(rows) if any(full(c) for c in rows[r])]
        roles: dict[int, str] = {}
        seen: set[int] = set()
        for r in order:
            texts = [c for c in rows[r] if full(c) and c["kind"] == "s" and c["text"].strip()]
            columns = {int(c["col"]) for c in texts}
            label = texts[0]["text"].strip() if texts else ""
            valued = any(c["kind"] == "n" or isinstance(c["formula"], str) for c in rows[r])
            sums = []
            for c in rows[r]:
                m = formula.match(c["formula"]) if isinstance(c["formula"], str) else None
                if m and _column_number(m[1]) == _column_number(m[3]) == int(c["col"]) and head < int(m[2]) <= int(m[4]) < r:
                    sums.append(int(m[2]))
            is_exact = bool(exact.match(label))
            is_suffix = bool(suffix.match(label)) and (bool(sums) or bool(seen - columns))
            if valued and (is_exact or is_suffix or sums):
                closing = r == order[-1] and ((is_exact and not label.lower().startswith("sub")) or (order[0] in sums and bool(roles)))
                roles[r] = "grand_total" if ((is_exact or is_suffix) and grand.search(label)) or closing else "subtotal"
            else:
                seen = columns
        return pd.DataFrame([{**key, "row": r, "row_role": roles.get(r, "data")} for r in order], columns=[*keys, "row", "row_role"])

    return x.groupBy(*keys).applyInPandas(one, T.StructType(fields))


def native_types(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, col, col_type: INTEGER or REAL if every filled cell is a number, else TEXT."""
    full = cells.where(F.col("text").isNotNull() & (F.trim("text") != ""))
    number = F.col("kind") == "n"
    whole = number & (F.col("text").try_cast("double") == F.floor(F.col("text").try_cast("double")))
    t = F.when(F.bool_and(F.coalesce(whole, F.lit(False))), "INTEGER").when(F.bool_and(number), "REAL").otherwise("TEXT")
    return full.groupBy(*keys, "col").agg(t.alias("col_type"))


def native_table(cells: DataFrame, keys: list[str], columns: dict[int, str]) -> DataFrame:
    """Cells pivoted to one row per sheet row; empty rows are left out."""
    wide = cells.where(F.col("col").isin(*columns)).groupBy(*keys, "row").agg(*[F.max(F.when(F.col("col") == k, F.col("text"))).alias(n) for k, n in columns.items()])
    return wide.where(F.coalesce(*[F.nullif(F.trim(F.col(n)), F.lit("")) for n in columns.values()]).isNotNull())


def chart_points(series: DataFrame, keys: list[str]) -> DataFrame:
    """keys, first/last/highest/lowest point and change of each chart series.

    ``series`` has keys, pos, category, kind, value. If at least two and half of the points have date categories,
    only those count and first, last and change are given.
    """
    p = series.where(F.col("category").isNotNull() & (F.col("category") != "") & F.col("value").isNotNull())
    p = p.withColumn("_d", category_family(F.col("category"), F.col("kind")) == "date")
    dated = p.groupBy(*keys).agg(F.count_if("_d").alias("_nd"), F.count(F.lit(1)).alias("_n"))
    x = p.join(dated, keys).withColumn("by_date", (F.col("_nd") >= 2) & (F.col("_nd") >= F.col("_n") / 2)).where(~F.col("by_date") | F.col("_d"))
    early, late = F.struct(F.col("value"), -F.col("pos")), F.struct(-F.col("value"), -F.col("pos"))
    g = x.groupBy(*keys, "by_date").agg(
        F.min_by("value", "pos").alias("first_value"), F.max_by("value", "pos").alias("last_value"), F.max_by("category", early).alias("max_category"), F.max("value").alias("max_value"),
        F.max_by("category", late).alias("min_category"), F.min("value").alias("min_value"),
    )
    return g.withColumn("change", F.when(F.col("by_date"), F.col("last_value") - F.col("first_value"))).withColumn("first_value", F.when(F.col("by_date"), F.col("first_value"))).withColumn("last_value", F.when(F.col("by_date"), F.col("last_value")))


def chart_warnings(series: DataFrame, keys: list[str]) -> DataFrame:
    """keys, uneven, mixed, gaps: categories and values of unequal number, dates among other categories, missing values."""
    both = F.col("category").isNotNull() & (F.col("category") != "") & F.col("value").isNotNull()
    fam = F.when(both, category_family(F.col("category"), F.col("kind")))
    return series.groupBy(*keys).agg(
        (F.count("category") != F.count("value")).alias("uneven"), (F.bool_or(fam == "date") & (F.countDistinct(fam) > 1)).alias("mixed"), F.bool_or(F.col("value").isNull()).alias("gaps")
    )


def chart_grid(series: DataFrame, names: list[str], limit: int = 200) -> DataFrame:
    """pos, category and one column per series, the first ``limit`` positions of the chart (its display size)."""
    return series.where(F.col("pos") <= limit).groupBy("pos").agg(F.first("category", True).alias("category"), *[F.max(F.when(F.col("series") == n, F.col("value"))).alias(n) for n in names])


def reference_values(references: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ref_id, cell_values: the cells of each range from left to right and top to bottom."""
    x = references.join(cells.select(*keys, "row", "col", "text"), keys).where(F.col("row").between(F.col("min_row"), F.col("max_row")) & F.col("col").between(F.col("min_col"), F.col("max_col")))
    return x.groupBy(*keys, "ref_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "text"))), lambda s: s["text"]).alias("cell_values"))


def region_markdown(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, markdown: each region as a pipe table, its first row as the header."""
    cell = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    rows = cells.groupBy(*keys, "row").agg(F.array_sort(F.collect_list(F.struct("col", cell.alias("t")))).alias("c"))
    line = F.concat(F.lit("| "), F.array_join(F.col("c.t"), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size("c")))
    g = rows.select(*keys, F.struct("row", line.alias("l"), rule.alias("r")).alias("x")).groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("x"))
    first = F.col("x")[0]
    rest = F.transform(F.slice("x", F.lit(2), F.greatest(F.size("x") - 1, F.lit(0))), lambda s: s["l"])
    return g.select(*keys, F.array_join(F.concat(F.array(first["l"], first["r"]), rest), "\n").alias("markdown"))


def workbook_markdown(sheets: DataFrame, key: str, title: str) -> DataFrame:
    """key, text: sheets (key, tab_no, sheet, markdown) as sections in the order of their tabs under the workbook's title."""
    part = F.concat(F.lit("## "), F.col("sheet"), F.lit("\n\n"), F.col("markdown"))
    g = sheets.groupBy(key).agg(F.max(title).alias("_t"), F.array_sort(F.collect_list(F.struct("tab_no", part.alias("p")))).alias("x"))
    return g.select(key, F.concat(F.lit("# "), "_t", F.lit("\n\n"), F.array_join(F.col("x.p"), "\n\n"), F.lit("\n")).alias("text"))


def bridging_cells(styled: DataFrame, filled: DataFrame, keys: list[str]) -> DataFrame:
    """Empty styled cells with filled cells on both sides, left and right or above and below: they hold a table together."""
    near = filled.select(*keys, "row", "col").distinct()
    shifted = None
    for side, dr, dc in (("l", 0, 1), ("r", 0, -1), ("a", 1, 0), ("b", -1, 0)):
        part = near.select(*keys, (F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col"), F.lit(side).alias("side"))
        shifted = part if shifted is None else shifted.unionByName(part)
    sides = shifted.groupBy(*keys, "row", "col").agg(F.collect_set("side").alias("s"))
    both = lambda x, y: F.array_contains("s", x) & F.array_contains("s", y)
    return styled.select(*keys, "row", "col").distinct().join(sides, [*keys, "row", "col"]).where(both("l", "r") | both("a", "b")).select(*keys, "row", "col")


def drawing_regions(drawings: DataFrame, keys: list[str]) -> DataFrame:
    """Pictures and charts as regions of kind mixed; an end anchor that is missing is the start's."""
    end = lambda a, b: F.greatest(F.coalesce(F.col(a), F.col(b)), F.col(b))
    return drawings.select(*keys, "title", "min_row", end("max_row", "min_row").alias("max_row"), "min_col", end("max_col", "min_col").alias("max_col"), F.lit("mixed").alias("kind"))


def visual_plan(sheets: DataFrame, region: DataFrame, keys: list[str]) -> DataFrame:
    """What must be looked at as a picture: a dashboard as one rectangle, on plain and summary sheets only mixed regions."""
    x = region.join(sheets.where("visible").select(*keys, "role"), keys)
    boards = x.where("role = 'dashboard'").groupBy(*keys).agg(F.min("min_row").alias("min_row"), F.max("max_row").alias("max_row"), F.min("min_col").alias("min_col"), F.max("max_col").alias("max_col"))
    parts = x.where((~F.col("role").isin("dashboard", "detail", "support")) & (F.col("kind") == "mixed")).select(*keys, "min_row", "max_row", "min_col", "max_col")
    return boards.unionByName(parts)


def needs_visual_tables(planned: DataFrame, pictures: DataFrame, keys: list[str]) -> DataFrame:
    """Planned rectangles that a pasted picture touches: their tables have no native cells."""
    p = pictures.select(*keys, *[F.col(b).alias(f"_{b}") for b in ("min_row", "max_row", "min_col", "max_col")])
    touch = (F.col("max_row") >= F.col("_min_row")) & (F.col("_max_row") >= F.col("min_row")) & (F.col("max_col") >= F.col("_min_col")) & (F.col("_max_col") >= F.col("min_col"))
    return planned.join(p, keys).where(touch).select(planned.columns).distinct()
