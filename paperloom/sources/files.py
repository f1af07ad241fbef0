"""Finding document files and writing results out."""

from __future__ import annotations

import io
import json
import posixpath
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# File types that count as documents, folders that never do.
EXTENSIONS = (".pdf", ".docx", ".doc", ".xlsx", ".xls", ".xlsm", ".ods", ".pptx", ".ppt", ".png", ".jpg", ".jpeg", ".webp")
IGNORED = (".git", ".venv", "__pycache__", ".ruff_cache", ".vscode", ".agents")


def document_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """path, folder, name, ext, bytes, modified of the documents under a folder; only listings are read, no contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    name = F.element_at(F.split("path", "/"), -1)
    x = files.withColumn("name", name).withColumn("folder", F.regexp_extract("path", "^(.*)/[^/]*$", 1)).withColumn("ext", F.lower(F.concat(F.lit("."), F.element_at(F.split("name", r"\."), -1))))
    ignored = F.exists(F.split("folder", "/"), lambda p: p.isin(*IGNORED))
    return x.where(F.col("ext").isin(*extensions) & ~ignored).select("path", "folder", "name", "ext", "bytes", "modified")


def unchanged(files: DataFrame, seen: DataFrame) -> DataFrame:
    """The files that were seen with the same size and time before and need no new work."""
    return files.join(seen.select("path", "bytes", "modified"), ["path", "bytes", "modified"], "left_semi")


def read_extractions(spark: SparkSession, root: str) -> DataFrame:
    """folder, doc, text, meta of every extracted document: the Markdown file and the JSON beside it in the same folder, null if there is none."""

    def files(pattern: str, name: str) -> DataFrame:
        found = spark.read.option("wholetext", "true").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(root)
        place = r"^(.*)/([^/]*)\.[^./]*$"
        return found.select(F.regexp_extract("_metadata.file_path", place, 1).alias("folder"), F.regexp_extract("_metadata.file_path", place, 2).alias("doc"), F.col("value").alias(name))

    return files("*.md", "text").join(files("*.json", "meta"), ["folder", "doc"], "left")


def visible_columns(df: DataFrame, internal: bool = False) -> DataFrame:
    """The table without the columns whose names begin with an underscore."""
    return df if internal else df.select(*[c for c in df.columns if not c.startswith("_")])


def write_csv(df: DataFrame, folder: str, internal: bool = False, one_file: bool = False) -> None:
    """A table as CSV with a header, one part per partition; ``one_file`` is for tables small enough for one task."""
    out = visible_columns(df, internal)
    (out.coalesce(1) if one_file else out).write.mode("overwrite").option("header", "true").option("encoding", "UTF-8").csv(folder)


def write_json_lines(df: DataFrame, folder: str) -> None:
    """Rows as JSON, written beside the target and moved there whole."""
    spark = df.sparkSession
    df.write.mode("overwrite").json(folder + ".part")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(path(folder), True)
    if not fs.rename(path(folder + ".part"), path(folder)):
        raise OSError(f"could not move {folder}.part")


def sql_statements(df: DataFrame, table: str) -> DataFrame:
    """statement: an INSERT for each row, values quoted; CREATE is ``create_statement``."""
    numeric = {n for n, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")}
    lit = lambda c: F.coalesce(F.col(c).cast("string") if c in numeric else F.concat(F.lit("'"), F.replace(F.col(c).cast("string"), F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))
    names = ", ".join(f'"{c}"' for c in df.columns)
    return df.select(F.concat(F.lit(f'INSERT INTO "{table}" ({names}) VALUES ('), F.concat_ws(", ", *[lit(c) for c in df.columns]), F.lit(");")).alias("statement"))


def create_statement(df: DataFrame, table: str) -> str:
    kinds = {"double": "REAL", "float": "REAL", "bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "boolean": "INTEGER"}
    return f'CREATE TABLE "{table}" (' + ", ".join(f'"{n}" {kinds.get(t, "TEXT")}' for n, t in df.dtypes) + ");"


def zip_tables(tables: dict[str, DataFrame], max_rows: int = 1_000_000) -> bytes:
    """A ZIP with one CSV per table for download by a person; a table with more rows is refused, use ``write_csv``."""
    buffer, used = io.BytesIO(), {}
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, df in tables.items():
            rows = visible_columns(df).limit(max_rows + 1).toPandas()
            if len(rows) > max_rows:
                raise ValueError(f"{name} has more than {max_rows} rows")
            used[name.lower()] = used.get(name.lower(), 0) + 1
            suffix = "" if used[name.lower()] == 1 else f"_{used[name.lower()]}"
            z.writestr(f"{name}{suffix}.csv", "﻿" + rows.to_csv(index=False))
    return buffer.getvalue()


def write_file(spark: SparkSession, path: str, data: bytes) -> None:
    """One small file on any storage, written beside the target and moved there whole."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target, part = make(path), make(path + ".part")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(part, True)
    out.write(bytearray(data))
    out.close()
    fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"could not move {path}.part")


def clean_outputs(spark: SparkSession, root: str, doc: str | None = None) -> int:
    """Delete the outputs of one document (files named like it, whatever their ending), or of all; how many were deleted. Other files stay."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = make(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = 0
    for found in fs.globStatus(make(f"{root}/*")) or []:
        name = found.getPath().getName()
        if doc is None or name == doc or name.rpartition(".")[0] == doc:
            gone += bool(fs.delete(found.getPath(), True))
    return gone


def manifest(spark: SparkSession, path: str, data: dict) -> None:
    """A small JSON file, written whole or not at all."""
    write_file(spark, path, json.dumps(data, ensure_ascii=False, indent=1).encode())


def join_path(*parts: str) -> str:
    return posixpath.join(*parts)
