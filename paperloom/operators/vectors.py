"""Exact nearest vectors of a stated query set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Queries held against all rows at once; more go in more blocks, each a pass over the rows.
QUERIES_PER_BLOCK = 4096


def cosine_topk(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """query_id, rank, key, cosine of the k rows nearest to each query; ties go to the smaller key.

    Queries are sent out in blocks of bounded size; each partition keeps its k best per query, so
    what is shuffled is k rows per query and partition. Null vectors and those of length 0 are left
    out, and all whose length is not that of the query with the smallest key. Cosines are rounded to nine digits.
    """
    q = queries.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"))
    first = q.agg(F.min_by(F.size("v"), "key").alias("width")).first()["width"]
    width = int(first or 0)
    q = q.where(F.size("v") == width)
    n = q.count()
    blocks = max(1, -(-n // QUERIES_PER_BLOCK))
    source = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"))
    spark, result = rows.sparkSession, None
    for b in range(blocks):
        part = q.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).collect()
        ids = np.array([r["key"] for r in part], dtype=np.int64)
        m = np.array([r["v"] for r in part], dtype=np.float64).reshape(len(part), width)
        shared = spark.sparkContext.broadcast((ids, m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300), width))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, m, width = shared.value
            for batch in batches:
                sizes = np.diff(batch.column(1).offsets.to_numpy())
                fit = np.nonzero(sizes == width)[0]
                if not len(fit) or not len(ids) or not width:
                    continue
                keys = batch.column(0).to_numpy()[fit]
                x = batch.column(1).take(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                norm = np.linalg.norm(x, axis=1)
                x, keys, norm = x[norm > 0], keys[norm > 0], norm[norm > 0]
                cos = np.round(m @ x.T / norm, 9)
                order = np.lexsort((np.broadcast_to(keys, cos.shape), -cos), axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, order.shape[1])), pa.array(keys[order].ravel()), pa.array(np.take_along_axis(cos, order, axis=1).ravel())], names=["query_id", key, "cosine"]
                )

        found = source.mapInArrow(best, f"query_id long, {key} long, cosine double")
        result = found if result is None else result.unionByName(found)
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), key)
    return result.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
