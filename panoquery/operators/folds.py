"""Folds over the frames of a window, for merges that expressions can say. Image merges: ``plans.mosaic``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Merge = Callable[[Column, Column], Column]


def linear_fold(df: DataFrame, key: str, order: str, value: str, passes: Merge, merge: Merge) -> DataFrame:
    """(key, n_frames, n_merged, acc): left to right; a step whose gate fails leaves the accumulator as it is.

    A window is bounded by its size, so its rows fit one array; windows run in parallel.
    """
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("f"))
    start = F.struct(F.element_at("f", 1)["v"].alias("acc"), F.lit(1).cast("long").alias("n"))

    def step(s: Column, x: Column) -> Column:
        return F.when(passes(s["acc"], x["v"]), F.struct(merge(s["acc"], x["v"]).alias("acc"), (s["n"] + 1).alias("n"))).otherwise(s)

    folded = rows.withColumn("s", F.aggregate(F.slice("f", F.lit(2), F.size("f")), start, step))
    return folded.select(key, F.size("f").cast("long").alias("n_frames"), F.col("s.n").alias("n_merged"), F.col("s.acc").alias("acc"))


def tree_fold(df: DataFrame, key: str, order: str, value: str, passes: Merge, merge: Merge, size: int) -> DataFrame:
    """(key, n_merged, acc): neighbours merge level by level, ceil(log2(size)) levels, all windows together.

    An odd node goes up as it is; a pair whose gate fails keeps its left node and loses the right one.
    """
    level = df.select(key, F.col(order).cast("long").alias("pos"), F.col(value).alias("v"), F.lit(1).cast("long").alias("n"))
    for _ in range(max(1, (size - 1).bit_length())):
        side = lambda s: F.struct(*[F.max(F.when(F.col("pos") % 2 == s, F.col(c))).alias(c) for c in ("v", "n")])
        pair = level.groupBy(key, F.expr("pos div 2").alias("pos")).agg(side(0).alias("l"), side(1).alias("r"))
        ok = F.col("r.n").isNotNull() & passes(F.col("l.v"), F.col("r.v"))
        level = pair.select(key, "pos", F.when(ok, merge(F.col("l.v"), F.col("r.v"))).otherwise(F.col("l.v")).alias("v"), F.when(ok, F.col("l.n") + F.col("r.n")).otherwise(F.col("l.n")).alias("n"))
    return level.select(key, F.col("n").alias("n_merged"), F.col("v").alias("acc"))
