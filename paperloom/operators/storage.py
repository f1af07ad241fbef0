"""Keyed writes: hash inserts, upserts, merging duplicates, replacing pages, evolving columns, snapshots.

There is no transactional table format here. A change is planned as a DataFrame of the new
state and stored as a new version beside the old ones; a pointer file names the version that
readers see, and moving it is the only step that makes a change visible.
"""

from __future__ import annotations

import json
import posixpath
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions.cells import clean_cell, parse_date, parse_number, sanitize_identifier
from paperloom.operators.skew import salted_join
from paperloom.session import cut


def typed(rows: DataFrame, types: dict[str, str]) -> DataFrame:
    """Text columns read by their type: REAL and NUMERIC as doubles, DATE as ISO text (else the cleaned text), TEXT cleaned."""

    def read(c: str, t: str) -> Column:
        if t in ("REAL", "NUMERIC", "INTEGER"):
            return parse_number(c)
        return F.coalesce(parse_date(c), clean_cell(c)) if t == "DATE" else clean_cell(c)

    return rows.withColumns({c: read(c, t) for c, t in types.items()})


def ingest(tables: DataFrame, keys: list[str], columns: dict[str, str], source: str, page: str) -> DataFrame:
    """Rows of parsed tables under the columns of a stored one, typed, with _source_doc and _page_number.

    A column takes the cells under the header of its name (of several the last), else those at its own
    place, else nothing. ``tables`` have headers and rows as ``tables.markdown_tables`` gives them.
    """
    x = tables.withColumn("_ids", F.transform("headers", sanitize_identifier))
    x = x.select(*keys, F.col(source).alias("_source_doc"), F.col(page).cast("int").alias("_page_number"), "_ids", F.explode("rows").alias("_r"))
    place = lambda c, k: F.coalesce(F.nullif(F.size("_ids") - F.array_position(F.reverse("_ids"), c), F.size("_ids")), F.lit(k))
    raw = x.select(*keys, "_source_doc", "_page_number", *[F.coalesce(F.get("_r", place(c, k).cast("int")), F.lit("")).alias(c) for k, c in enumerate(columns)])
    return typed(raw, columns)


def evolve(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The table and new rows under the columns of both; missing values are null."""
    return table.unionByName(rows, allowMissingColumns=True)


def _plain(c: Column, kind: str) -> Column:
    """A value inside a hash: nothing for null, no exponent for numbers."""
    if kind == "number":
        return F.when(c.isNull(), "0").otherwise(F.format_string("%.2f", c.cast("double")))
    return F.coalesce(c.cast("string"), F.lit(""))


def row_hash(parts: list[tuple[Column, str]], cells: Column | None = None) -> Column:
    """The first 24 hex digits of the hash of all parts, and of the raw cells where they count too."""
    text = F.concat_ws("|", *[_plain(c, k) for c, k in parts])
    if cells is not None:
        text = F.concat(text, F.lit("|"), F.array_join(F.transform(cells, lambda x: F.coalesce(x, F.lit(""))), "\u001f"))
    return F.substring(F.sha2(text, 256), 1, 24)


def insert_new(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with those rows whose key it does not have; of new rows with one key one is kept."""
    return table.unionByName(rows.dropDuplicates([key]).join(table.select(key), key, "left_anti"), allowMissingColumns=True)


def upsert_coalesce(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per key: a new value replaces the old unless it is null; columns in ``keep`` never change once set.

    Rows with a null key stay as they are. Both sides are taken to have one row per key.
    """
    common = [c for c in old.columns if c != key]
    a = old.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_o_{c}") for c in common])
    b = new.select(F.col(key).alias("_n"), *[F.col(c).alias(f"_n_{c}") for c in common])
    x = a.join(b, F.col("_k") == F.col("_n"), "full_outer")
    pick = lambda c: F.coalesce(f"_o_{c}", f"_n_{c}") if c in keep else F.coalesce(f"_n_{c}", f"_o_{c}")
    return x.select(F.coalesce("_k", "_n").alias(key), *[pick(c).alias(c) for c in common])


def merge_duplicates(table: DataFrame, keys: list[str], pk: str) -> DataFrame:
    """Rows that share all keys become the one with the lowest id, its nulls filled from the later ones in order.

    Rows with a null in any key stay apart. Filling is an aggregation with partial results, so a
    group of any size is merged without being gathered in one place. Ids are unique.
    """
    others = [c for c in table.columns if c not in (*keys, pk)]
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    first = [F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(pk), F.col(c))))[c].alias(c) for c in others]
    merged = table.where(whole).groupBy(*keys).agg(F.min(pk).alias(pk), *first)
    return merged.select(*table.columns).unionByName(table.where(~whole).select(*table.columns))


def merge_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """initial_rows, final_rows, removed_rows."""
    both = before.select(F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(after.select(F.lit(0).alias("a"), F.lit(1).alias("b")))
    s = both.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("initial_rows"), F.coalesce(F.sum("b"), F.lit(0)).alias("final_rows"))
    return s.withColumn("removed_rows", F.col("initial_rows") - F.col("final_rows"))


def reparent(children: DataFrame, parents: DataFrame, key: str, match: str) -> DataFrame:
    """Children of merged parents under the parent that stays, the one with the lowest id of those that match."""
    kept = parents.where(F.col(match).isNotNull()).groupBy(match).agg(F.min(key).alias("_to"))
    moved = parents.join(kept, match).where(F.col(key) != F.col("_to")).select(F.col(key), "_to").distinct()
    sizes = children.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    joined = salted_join(children, cut(moved.join(sizes, key)), [key], F.xxhash64(*children.columns), how="left")
    return joined.withColumn(key, F.coalesce("_to", key)).select(*children.columns)


def replace_pages(table: DataFrame, pages: DataFrame, rows: DataFrame, source: str = "_source_doc", page: str = "_page_number") -> DataFrame:
    """The table in which all rows of the given pages are replaced by new ones, also by none."""
    gone = pages.select(source, page).distinct()
    return table.join(gone, [source, page], "left_anti").select(*table.columns).unionByName(rows, allowMissingColumns=True)


def prune_pages(table: DataFrame, limits: DataFrame, source: str = "_source_doc", page: str = "_page_number", last: str = "last_page") -> DataFrame:
    """The table without rows beyond the last page of their document; documents without a limit stay whole."""
    sizes = table.groupBy(source).agg(F.count(F.lit(1)).alias("n_rows"))
    known = cut(limits.select(source, F.col(last).alias("_last")).join(sizes, source))
    x = salted_join(table, known, [source], F.xxhash64(*table.columns), how="left")
    return x.where(F.col("_last").isNull() | F.col(page).isNull() | (F.col(page) <= F.col("_last"))).select(*table.columns)


def table_summary(tables: dict[str, DataFrame], order: dict[str, str]) -> DataFrame:
    """table_name, n_columns, n_rows, last_row (as JSON) of every table, each read once."""
    parts = []
    for name, t in tables.items():
        last = F.max(F.struct(F.col(order[name]).alias("_o"), F.struct(*t.columns).alias("r")))
        parts.append(t.agg(F.count(F.lit(1)).alias("n_rows"), last.alias("m")).select(F.lit(name).alias("table_name"), F.lit(len(t.columns)).alias("n_columns"), "n_rows", F.to_json("m.r").alias("last_row")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def last_rows(table: DataFrame, order: str, n: int = 3) -> DataFrame:
    """The last rows in an order, as samples."""
    return table.orderBy(F.desc(order)).limit(n)


# ---- versions on storage ----


def _fs(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def current_version(spark: SparkSession, root: str) -> dict[str, str]:
    """Table name to folder of the version that readers see; empty before the first commit."""
    fs, path = _fs(spark, root)
    pointers = [s.getPath().getName() for s in fs.listStatus(path(root))] if fs.exists(path(root)) else []
    named = sorted(p for p in pointers if p.startswith("version-") and p.endswith(".json"))
    if not named:
        return {}
    return json.loads("".join(r.value for r in spark.read.text(posixpath.join(root, named[-1])).collect()))


def commit_version(spark: SparkSession, root: str, tables: dict[str, DataFrame], partition_by: list[str] | None = None) -> dict[str, str]:
    """Write new states of tables, then make them all visible at once by one pointer file with the next number.

    Tables that are not named stay as they are. If a write fails, no pointer is made and readers
    see the old version. Two writers at once: the one whose pointer exists already fails.
    """
    fs, path = _fs(spark, root)
    now = current_version(spark, root)
    stamp = uuid.uuid4().hex[:12]
    new = dict(now)
    for name, df in tables.items():
        folder = posixpath.join(root, "data", f"{name}-{stamp}")
        writer = df.write.mode("errorifexists")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(folder)
        new[name] = folder
    taken = [s.getPath().getName() for s in fs.listStatus(path(root)) if s.getPath().getName().startswith("version-")] if fs.exists(path(root)) else []
    pointer = posixpath.join(root, f"version-{len(taken):09d}.json")
    out = fs.create(path(pointer), False)
    out.write(bytearray(json.dumps(new), "utf-8"))
    out.close()
    return new


def read_version(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.parquet(current_version(spark, root)[table])
