"""The SQL surface: registered functions, a table function, and a guarded read-only query."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from paperloom.operators.tables import TABLE_SCHEMA, parse_tables

ROW_LIMIT = 100
_WRITES = re.compile(r"\b(insert|update|delete|merge|drop|create|alter|truncate|replace\s+table|grant|revoke|refresh|cache|load|set)\b", re.I)


def allowed(statement: str) -> bool:
    """Whether a text is one SELECT and nothing else."""
    s = re.sub(r"'(?:[^']|'')*'", "''", re.sub(r"--[^\n]*|/\*[\s\S]*?\*/", " ", statement)).strip().rstrip(";")
    return bool(re.match(r"select\b", s, re.I)) and ";" not in s and not _WRITES.search(s)


def run_select(spark: SparkSession, statement: str, limit: int = ROW_LIMIT, **parameters) -> dict:
    """Run one SELECT: columns, rows (at most ``limit``, the surface's page size), error. Errors come back as text."""
    if not allowed(statement):
        return {"columns": [], "rows": [], "error": "only SELECT statements are allowed"}
    try:
        df = spark.sql(statement.strip().rstrip(";"), args=parameters or None)
        return {"columns": df.columns, "rows": [tuple(r) for r in df.limit(limit).collect()], "error": None}
    except Exception as e:  # noqa: BLE001 - a bad statement is an answer, not a failure
        return {"columns": [], "rows": [], "error": str(e).splitlines()[0]}


def register(spark: SparkSession) -> None:
    """Make parse_number, parse_date_iso, clean_cell, sanitize_ident and markdown_tables usable in SQL.

    The scalar functions are SQL functions, inlined by the optimiser; no Python runs for them.
    """
    clean = r"trim(regexp_replace(trim(regexp_replace(s, '\\s+', ' ')), '^[*_]+|[*_]+$', ''))"
    bodies = {
        "clean_cell(s STRING) RETURNS STRING": clean,
        "sanitize_ident(s STRING) RETURNS STRING": r"regexp_replace(trim('_' FROM regexp_replace(regexp_replace(lower(trim(s)), '[^a-zA-Z0-9_]', '_'), '_+', '_')), '^(?=[0-9]|$)', 'col_')",
        "parse_date_iso(s STRING) RETURNS STRING": r"transform(array(" + clean + r"), c -> CASE "
        r"WHEN c RLIKE '^(19|20)\\d{2}(0[1-9]|1[0-2])(0[1-9]|[12]\\d|3[01])$' THEN concat_ws('-', substr(c, 1, 4), substr(c, 5, 2), substr(c, 7, 2)) "
        r"WHEN c RLIKE '^(19|20)\\d{2}-(0[1-9]|1[0-2])-(0[1-9]|[12]\\d|3[01])$' THEN c "
        r"WHEN c RLIKE '^(0?[1-9]|[12]\\d|3[01])[./-](0?[1-9]|1[0-2])[./-]((19|20)?\\d{2})$' THEN concat_ws('-', "
        r"right(concat('20', regexp_extract(c, '(\\d+)$', 1)), 4), lpad(split(c, '[./-]')[1], 2, '0'), lpad(split(c, '[./-]')[0], 2, '0')) END)[0]",
        "parse_number(s STRING) RETURNS DOUBLE": r"transform(array(" + clean + r"), c -> CASE WHEN c IN ('-', '--', 'N/A', 'NA', 'null', 'None', '') THEN NULL ELSE "
        r"(CASE WHEN c LIKE '(%)' OR c LIKE '-%' THEN -1 ELSE 1 END) * transform(array(regexp_replace(c, '[^0-9.,]', '')), d -> transform(array("
        r"CASE WHEN d LIKE '%.%' AND d LIKE '%,%' THEN CASE WHEN instr(reverse(d), '.') < instr(reverse(d), ',') THEN replace(d, ',', '') ELSE translate(d, ',.', '.') END "
        r"WHEN d RLIKE '\\d.*[.,][^.,]{3}$' THEN regexp_replace(d, '[.,]', '') ELSE regexp_replace(d, '^(.*)[.,]([^.,]*)$', '$1.$2') END), "
        r"p -> CASE WHEN p RLIKE '^\\d+(\\.\\d+)?$' THEN try_cast(p AS DOUBLE) END)[0])[0] END)[0]",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")

    @F.udtf(returnType=TABLE_SCHEMA)
    class MarkdownTables:
        """The pipe tables of a text, one row each."""

        def eval(self, text: str) -> Iterator[Row]:
            for t in parse_tables(text):
                yield tuple(t.values())

    spark.udtf.register("markdown_tables", MarkdownTables)


def catalog_of(spark: SparkSession, views: list[str]) -> DataFrame:
    """table_name, column_name, column_type of registered views."""
    rows = [(v, n, t) for v in views for n, t in spark.table(v).dtypes]
    return spark.createDataFrame(rows, "table_name string, column_name string, column_type string")
