"""Joins, ranks and prefix sums that hold when one key owns a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.session import cut

#: No more keys than this can each own more than 1/MAX_HOT of all rows, so a broadcast
#: of the hot keys never exceeds MAX_HOT small rows, whatever the size of the data.
MAX_HOT = 4096


def salted_join(
    rows: DataFrame,
    side: DataFrame,
    on: list[str],
    row_id: Column,
    n_col: str = "n_rows",
    per_task: int = 500_000,
    how: str = "inner",
) -> DataFrame:
    """Join many ``rows`` with a ``side`` that has one row per key and the key's row count.

    Keys with more than ``max(per_task, total / MAX_HOT)`` rows are hot: their rows are spread
    over several salts chosen from ``row_id`` (deterministic, so a lost task recomputes the same
    split) and only their side rows are repeated once per salt. Every other key keeps salt 0.
    The hot list is at most ``MAX_HOT`` keys by the pigeonhole principle, hence the broadcast.
    Null keys never match. ``side`` should be checkpointed; it is read three times.
    ``how`` is ``inner`` or ``left``.
    """
    total = side.agg(F.sum(n_col).alias("t")).first()["t"] or 0
    limit = max(per_task, -(-total // MAX_HOT))
    hot = side.where(F.col(n_col) > limit).select(
        *on, F.ceil(F.col(n_col) / F.lit(limit)).cast("int").alias("_salts")
    )
    if hot.isEmpty():
        return rows.join(side.drop(n_col), on, how)
    hot = F.broadcast(hot)
    salted = rows.join(hot, on, "left").withColumn(
        "_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(row_id), F.col("_salts"))).cast("int")
    )
    repeated = (
        side.drop(n_col)
        .join(hot, on, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
        .drop("_salts")
    )
    return salted.drop("_salts").join(repeated, [*on, "_salt"], how).drop("_salt")


def ranked(df: DataFrame, *order: Column | str, out: str = "rank", parts: int | None = None) -> DataFrame:
    """1-based place of each row in one order of all rows, counted range by range.

    Rows are parted by ranges of the order; a range is ranked by itself and begins after the rows of
    those before it, of which there is one small row per range. ``order`` should tell all rows apart.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = cut(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))  # written out, so a lost task cannot number them anew
    sizes = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # at most n rows
    first = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranges.withColumn("_r", inside).join(F.broadcast(first), "_range").withColumn(out, F.col("_r") + F.col("_before")).drop("_range", "_r", "_before")


def prefix_sum(df: DataFrame, group: str, order: Column, amount: str, out: str, buckets: int = 256) -> DataFrame:
    """Exclusive running sum of ``amount`` per group without a window over a whole group.

    Rows fall into ``buckets`` ranges of ``order`` (0 to 2**62 - 1, such as a hash), so a group
    is summed as ``buckets`` independent windows plus one tiny window over bucket totals. The
    order inside a group is that of the hash, which is total when the hash is of a unique id.
    Nulls count as 0; null groups form one group.
    """
    width = (1 << 62) // buckets
    marked = df.withColumn("_o", order).withColumn("_b", (F.col("_o") / F.lit(width)).cast("int"))
    marked = marked.withColumn("_a", F.coalesce(F.col(amount), F.lit(0)).cast("long"))
    totals = marked.groupBy(group, "_b").agg(F.sum("_a").alias("_t"))
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col(group).alias("_g"), F.col("_b").alias("_ob"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off")
    )
    inside = Window.partitionBy(group, "_b").orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)
    return (
        marked.withColumn("_in", F.coalesce(F.sum("_a").over(inside), F.lit(0)))
        .join(offsets, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_ob")))
        .withColumn(out, F.col("_in") + F.col("_off"))
        .drop("_o", "_b", "_a", "_in", "_g", "_ob", "_off")
    )


def _ranges(df: DataFrame, group: str, order: str, width: int) -> tuple[DataFrame, Window, Window]:
    marked = df.withColumn("_range", F.floor(F.col(order) / F.lit(width)).cast("long"))
    inside = Window.partitionBy(group, "_range")
    return marked, inside, Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)


def running_total(df: DataFrame, group: str, order: str, amount: Column, out: str, ties: tuple[str, ...] = (), width: int = 1_000_000) -> DataFrame:
    """Inclusive running sum of a whole-number amount along an integer order, a group split into ranges of the order.

    Each range is one window; a window over one row per range gives what came before. Rows of equal
    order lie in one range, told apart by ``ties``.
    """
    marked, inside, before = _ranges(df.withColumn("_v", amount), group, order, width)
    offsets = marked.groupBy(group, "_range").agg(F.sum("_v").alias("_s")).withColumn("_off", F.coalesce(F.sum("_s").over(before), F.lit(0)))
    offsets = offsets.select(F.col(group).alias("_g"), F.col("_range").alias("_r"), "_off")
    rows = marked.withColumn("_in", F.sum("_v").over(inside.orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)))
    joined = rows.join(offsets, F.col(group).eqNullSafe(F.col("_g")) & F.col("_range").eqNullSafe(F.col("_r")))
    return joined.withColumn(out, F.coalesce("_in", F.lit(0)) + F.col("_off")).drop("_v", "_range", "_in", "_g", "_r", "_off")


def previous_value(df: DataFrame, group: str, order: str, value: Column, out: str, ties: tuple[str, ...] = (), width: int = 1_000_000) -> DataFrame:
    """The value of the row before along an integer order, null on a group's first row; ranges as in ``running_total``."""
    marked, inside, before = _ranges(df.withColumn("_v", F.struct(value.alias("v"))), group, order, width)
    key = [F.col(order), *[F.col(t) for t in ties]]
    ends = marked.groupBy(group, "_range").agg(F.max_by("_v", F.struct(*key)).alias("_last"))
    ends = ends.withColumn("_carried", F.last("_last", True).over(before)).select(F.col(group).alias("_g"), F.col("_range").alias("_r"), "_carried")
    rows = marked.withColumn("_prev", F.lag("_v").over(inside.orderBy(order, *ties)))
    joined = rows.join(ends, F.col(group).eqNullSafe(F.col("_g")) & F.col("_range").eqNullSafe(F.col("_r")))
    return joined.withColumn(out, F.coalesce("_prev", "_carried")["v"]).drop("_v", "_range", "_prev", "_g", "_r", "_carried")
