"""Exact k nearest neighbours and the ratio test."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def knn_join(queries: DataFrame, train: DataFrame, k: int = 2, query_block: int = 512, train_block: int = 4096) -> DataFrame:
    """(query_id, train_id, distance, rank): the k nearest rows of ``train`` (id, v) by L2 for each of ``queries`` (id, v).

    Both sides are dealt into blocks by a hash of the id; a task multiplies two blocks and keeps k rows a query, so memory
    is bounded and nothing quadratic is shuffled. Distances of the kept rows are computed anew from differences, ties go
    to the lower id.
    """
    n_train = train.count()
    t_blocks, q_blocks = max(1, -(-n_train // train_block)), max(1, -(-queries.count() // query_block))
    q = queries.select(F.col("id").alias("query_id"), "v", F.pmod(F.xxhash64("id"), F.lit(q_blocks)).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(t_blocks - 1))).alias("tb"))
    t = train.select(F.col("id").alias("train_id"), "v", F.pmod(F.xxhash64("id"), F.lit(t_blocks)).cast("int").alias("tb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))).alias("qb"))

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "train_id": [], "distance": []}).astype({"query_id": "int64", "train_id": "int64", "distance": "float64"})
        b = b.sort_values("train_id")
        x, y = np.array(a.v.tolist(), float), np.array(b.v.tolist(), float)
        near = (x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)[None]
        take = min(len(b), k + 4)
        at = np.argpartition(near, take - 1, axis=1)[:, :take]
        exact = np.sqrt(((x[:, None, :] - y[at]) ** 2).sum(2))
        order = np.lexsort((at, exact))[:, :k]
        rows = np.arange(len(a))[:, None]
        return pd.DataFrame({"query_id": np.repeat(a.query_id.to_numpy(), order.shape[1]), "train_id": b.train_id.to_numpy()[at[rows, order]].ravel(), "distance": exact[rows, order].ravel()})

    found = q.groupBy("qb", "tb").cogroup(t.groupBy("qb", "tb")).applyInPandas(nearest, "query_id long, train_id long, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "train_id"))
    return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def ratio_test(neighbours: DataFrame, ratio: float = 0.7) -> DataFrame:
    """(query_id, train_id, d1, d2) where the nearest is clearly nearer than the second; no match with fewer than two."""
    best = neighbours.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("train_id"))).alias("train_id"), F.max(F.when(F.col("rank") == 1, F.col("distance"))).alias("d1"), F.max(F.when(F.col("rank") == 2, F.col("distance"))).alias("d2"))
    return best.where(F.col("d1") < F.lit(ratio) * F.col("d2"))
