"""Checking stored ledgers: continuity, sanity, verdicts, and the text against what was stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.cells import clean_cell, parse_date, parse_number
from paperloom.operators.skew import previous_value, running_total

TOLERANCE, CHECKED_ROWS = 1.0, 20


def continuity(rows: DataFrame, group: str, order: str, debit: str = "debit", credit: str = "credit", balance: str = "balance", first_rows: int | None = CHECKED_ROWS) -> DataFrame:
    """group, n_checked, n_breaks: where the balance before plus credit less debit is not the balance, nulls as 0.

    ``first_rows`` limits the check to the first rows of each group, the feature's sample; None checks all.
    ``order`` is a whole number; equal orders are told apart by the amounts. A group of any size is
    worked on in ranges of the order.
    """
    z = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    ties = (balance, debit, credit)
    x = previous_value(rows, group, order, z(balance), "_before", ties)
    if first_rows is not None:
        x = running_total(x, group, order, F.lit(1), "_n", ties).where(F.col("_n") <= first_rows)
    bad = F.abs(F.col("_before") + z(credit) - z(debit) - z(balance)) > TOLERANCE
    return x.where(F.col("_before").isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n_checked"), F.count_if(bad).alias("n_breaks"))


def running_balance(rows: DataFrame, group: str, order: str, debit: Column, credit: Column) -> DataFrame:
    """The rows with the balance their amounts add up to; sums are of rounded cents, so the order of addition does not show."""
    cents = F.round(F.coalesce(credit, F.lit(0.0)) * 100).cast("long") - F.round(F.coalesce(debit, F.lit(0.0)) * 100).cast("long")
    return running_total(rows, group, order, cents, "running_cents")


def numeric_sanity(rows: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """col, n, total, mean of every numeric column in one pass."""
    agg = rows.groupBy(*(by or [])).agg(*[f for c in columns for f in (F.count(c).alias(f"{c}__n"), F.sum(c).alias(f"{c}__s"), F.avg(c).alias(f"{c}__m"))])
    entries = F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"{c}__n").alias("n"), F.col(f"{c}__s").cast("double").alias("total"), F.col(f"{c}__m").cast("double").alias("mean")) for c in columns])
    return agg.select(*(by or []), F.explode(entries).alias("e")).select(*(by or []), "e.*")


def verdict(passed: Column, total: Column) -> Column:
    """struct(confidence, status) from how many checks passed."""
    ratio = F.when(total > 0, passed / total).otherwise(0.0)
    conf = F.when((total > 0) & (passed == total), 0.5 + 0.5 * ratio).otherwise(0.75 * ratio)
    status = F.when((total > 0) & (passed == total), "verified").when(ratio >= 0.6, "needs_revision").otherwise("rejected")
    return F.struct(F.bround(conf, 2).alias("confidence"), status.alias("status"))


def verify_ledger(rows: DataFrame, group: str, order: str, expected: DataFrame | None = None, n_columns: int = 1) -> DataFrame:
    """group, row_count, n_breaks, checks, passed, confidence, status of each stored table.

    ``expected`` (group, expected_rows) makes the row count exact; without it any row will do. The third
    of the four checks, that sums can be computed, holds for every table of numbers, null ones included.
    """
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("row_count"), F.count("debit").alias("nd"), F.count("credit").alias("nc"), F.sum("debit").alias("sd"))
    x = counts.join(continuity(rows, group, order), group, "left")
    if expected is not None:
        x = x.join(expected, group, "left")
        right = F.when(F.col("expected_rows").isNull(), F.col("row_count") > 0).otherwise(F.col("row_count") == F.col("expected_rows"))
    else:
        right = F.col("row_count") > 0
    checks = F.array(right, F.lit(n_columns >= 1), F.lit(True), F.coalesce(F.col("n_breaks") == 0, F.lit(True)))
    passed = F.size(F.filter(checks, lambda c: c))
    return x.select(group, "row_count", F.coalesce("n_breaks", F.lit(0)).alias("n_breaks"), F.size(checks).alias("checks"), passed.alias("passed"), verdict(passed, F.size(checks)).alias("v")).select(
        group, "row_count", "n_breaks", "checks", "passed", "v.confidence", "v.status"
    )


def count_differences(text_rows: DataFrame, stored_rows: DataFrame, key: str) -> DataFrame:
    """key, n_text, n_stored, agrees for every table on either side."""
    a = text_rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_text"))
    b = stored_rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_stored"))
    x = a.join(b, key, "full_outer").select(key, F.coalesce("n_text", F.lit(0)).alias("n_text"), F.coalesce("n_stored", F.lit(0)).alias("n_stored"))
    return x.withColumn("agrees", F.col("n_text") == F.col("n_stored"))


def canonical_value(c: Column, kind: str) -> Column:
    """A value as compared by the audit: numbers at twelve digits (text where unreadable), dates as ISO, text cleaned."""
    text = clean_cell(c.cast("string"))
    if kind == "number":
        n = parse_number(text)
        return F.when(n.isNull(), text).otherwise(F.format_string("%.11e", n))
    return F.coalesce(parse_date(text), text) if kind == "date" else text


def value_differences(text_rows: DataFrame, stored_rows: DataFrame, columns: list[str]) -> DataFrame:
    """columns, n_text, n_stored of every row that one side has more often than the other.

    One grouping counts both sides, so the multiset difference needs a single shuffle with partial sums.
    """
    a = text_rows.select(*columns, F.lit(1).alias("_a"), F.lit(0).alias("_b"))
    b = stored_rows.select(*columns, F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    x = a.unionByName(b).groupBy(*columns).agg(F.sum("_a").alias("n_text"), F.sum("_b").alias("n_stored"))
    return x.where(F.col("n_text") != F.col("n_stored"))


def audit_status(n_text_tables: Column, n_stored_tables: Column, n_text_rows: Column, n_stored_rows: Column, n_wrong_counts: Column, n_wrong_values: Column) -> Column:
    """PASSED or WARNING of a document's text against its stored rows."""
    lost = F.when((n_text_tables > 0) & (n_stored_tables == 0), 1).when(n_stored_rows < 0.5 * n_text_rows, 1).otherwise(0)
    trouble = n_wrong_counts + n_wrong_values + lost
    return F.when((trouble == 0) & ((n_stored_tables > 0) | (n_text_tables == 0)), "PASSED").otherwise("WARNING")
