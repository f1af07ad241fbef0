"""References to records that do not exist.

Signed counts per key are maintained from change deltas: a referencing row adds +1 reference; a
header's first delivery +1 existence, a deletion -1, a restoration +1. Whether an event changes
existence depends on what came before, so a state keeps, next to the counts, whether the key was
ever delivered and its latest deletion; folding a batch into a state emits the transition of
each key once. What is kept only grows (a flag, a latest deletion, least times), so batches may
come in any order, overlap in headers and deletions, and give the state of one batch of all.
One union and one grouping, with partial sums before the shuffle, fold any number of batches.

Keys with references and no existence are orphans; keys whose existence began after a reference
make the earlier rows orphans too.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.operators.skew import salted_join
from paperloom.session import cut

STATE = ("key", "n_rows", "existence", "delivered", "last_deletion", "exists_from", "first_ref")


def instant(text: Column) -> Column:
    """ISO-8601 text with an offset as an instant; anything else is null."""
    return F.try_to_timestamp(F.trim(text))


def _delta(n_rows=None, delivered=None, last_deletion=None, exists_from=None, first_ref=None) -> list[Column]:
    """The columns of a state but for the key; what a delta says nothing about is nothing."""
    empty = lambda c, kind: F.lit(None).cast(kind) if c is None else c.cast(kind)
    return [
        (F.lit(0) if n_rows is None else n_rows).cast("long").alias("n_rows"), F.lit(0).cast("long").alias("existence"),
        (F.lit(False) if delivered is None else delivered).alias("delivered"), empty(last_deletion, "long").alias("last_deletion"),
        empty(exists_from, "timestamp").alias("exists_from"), empty(first_ref, "timestamp").alias("first_ref"),
    ]


def reference_deltas(rows: DataFrame) -> DataFrame:
    """+1 reference per row; ``rows`` has key and at."""
    return rows.where(F.col("key").isNotNull()).select("key", *_delta(n_rows=F.lit(1), first_ref=F.col("at")))


def existence_deltas(headers: DataFrame, deletions: DataFrame) -> DataFrame:
    """Deliveries of headers, deletions and restorations of a batch; what they do to existence is settled by ``fold_deltas``.

    A deletion delivered again with restored_at is restored. One without a moment is before all others.
    """
    born = headers.where(F.col("header_id").isNotNull()).select(F.col("header_id").cast("long").alias("key"), *_delta(delivered=F.lit(True), exists_from=instant(F.col("created_at"))))
    # A moment and whether it was undone in one number, so that the latest is a plain maximum.
    when = F.coalesce(F.unix_micros("deleted_at"), F.lit(-(1 << 61))) * 2 + F.col("restored_at").isNotNull().cast("long")
    dead = deletions.where(F.col("header_id").isNotNull()).select(F.col("header_id").cast("long").alias("key"), *_delta(last_deletion=when))
    return born.unionByName(dead)


def fold_deltas(*deltas: DataFrame) -> DataFrame:
    """One row per key of STATE from deltas, or from an earlier state and the deltas of a later batch, and ``transition``.

    ``transition`` is what the fold did to the key's existence: +1, 0 or -1.
    """
    every = deltas[0].select(*STATE)
    for d in deltas[1:]:
        every = every.unionByName(d.select(*STATE))
    folded = every.groupBy("key").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("existence").alias("before"), F.max("delivered").alias("delivered"), F.max("last_deletion").alias("last_deletion"),
        F.min("exists_from").alias("exists_from"), F.min("first_ref").alias("first_ref"),
    )
    stands = F.col("delivered") & F.coalesce(F.pmod("last_deletion", F.lit(2)) == 1, F.lit(True))
    moved = folded.withColumn("transition", stands.cast("long") - F.col("before")).withColumn("existence", F.col("before") + F.col("transition"))
    return moved.select(*STATE, "transition")


def orphans_of(state: DataFrame) -> DataFrame:
    """The current report of a state: keys with positive references and zero existence, and why."""
    reason = F.when(F.col("delivered"), "deleted").otherwise("missing")
    return state.where((F.col("n_rows") > 0) & (F.col("existence") <= 0)).select("key", "n_rows", reason.alias("reason"))


def orphan_rows(refs: Mapping[str, tuple[DataFrame, str]], headers: DataFrame, deletions: DataFrame, per_task: int = 500_000) -> DataFrame:
    """Every row whose reference has no existing target: tab, rec_id, key, ingest_month, reason.

    ``refs`` maps a table name to its rows and id column; the rows need header_id and
    _ingested_at. Rows with a null reference are no case. A row without a readable
    _ingested_at is a case only if its target is missing or deleted, with a null month.
    Empty tables give an empty result; other columns are not read.
    """
    parts = [
        df.select(
            F.lit(tab).alias("tab"), F.col(rid).cast("long").alias("rec_id"), F.col("header_id").cast("long").alias("key"),
            instant(F.col("_ingested_at")).alias("at"),
        )
        for tab, (df, rid) in refs.items()
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.where(F.col("key").isNotNull())
    state = fold_deltas(reference_deltas(rows), existence_deltas(headers, deletions))
    suspect = cut(
        state.where((F.col("n_rows") > 0) & ((F.col("existence") <= 0) | (F.col("exists_from") > F.col("first_ref")))).select(
            "key", "n_rows", "existence", "delivered", "exists_from"
        )
    )
    joined = salted_join(rows, suspect, ["key"], F.struct("tab", "rec_id"), per_task=per_task)
    reason = (
        F.when((F.col("existence") <= 0) & ~F.col("delivered"), "missing")
        .when(F.col("existence") <= 0, "deleted")
        .when(F.col("exists_from") > F.col("at"), "later")
    )
    return joined.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(
        "tab", "rec_id", "key", F.date_format(F.to_utc_timestamp("at", F.current_timezone()), "yyyy-MM").alias("ingest_month"), "reason"
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Rows and distinct missing keys per table, month of ingestion and reason."""
    return orphans.groupBy("tab", "ingest_month", "reason").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("key").alias("n_keys")
    )
