"""Pairwise diagnostics inside windows: gate, verdict, matrix, hub order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panoquery.functions.scalar import window_verdict

LEAST_MATCHES, LEAST_INLIERS = 4, 15


def window_pairs(frames: DataFrame, *payload: str) -> DataFrame:
    """All pairs i < j of a window, with the payload columns of both sides (suffixes _i and _j)."""
    side = lambda s, x: frames.select("win_idx", F.col("local_idx").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in x])
    return side("i", payload).join(side("j", payload), "win_idx").where("i < j")


def gated(pairs: DataFrame) -> DataFrame:
    """``passes``: enough matches to estimate and enough inliers to trust."""
    return pairs.withColumn("passes", (F.col("num_matches") >= LEAST_MATCHES) & (F.col("num_inliers") >= LEAST_INLIERS))


def verdicts(pairs: DataFrame) -> DataFrame:
    """(win_idx, total_pairs, passing_pairs, verdict) from gated pairs."""
    out = pairs.groupBy("win_idx").agg(F.count("*").alias("total_pairs"), F.count_if("passes").alias("passing_pairs"), F.bool_or(F.col("passes") & (F.col("i") == 0)).alias("anchored"))
    return out.select("win_idx", "total_pairs", "passing_pairs", window_verdict(F.col("passing_pairs"), F.col("anchored")).alias("verdict"))


def rollup(windows: DataFrame) -> DataFrame:
    """(verdict, n_windows, windows): how many windows have a verdict, and which, as text."""
    made = windows.groupBy("verdict").agg(F.count("*").alias("n_windows"), F.array_sort(F.collect_list("win_idx")).alias("w"))
    return made.select("verdict", "n_windows", F.array_join(F.transform("w", lambda x: x.cast("string")), ",").alias("windows"))


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("win_idx", F.col("i").alias("a"), F.col("j").alias("b"), "num_inliers", "passes").unionByName(pairs.select("win_idx", F.col("j").alias("a"), F.col("i").alias("b"), "num_inliers", "passes"))


def inlier_matrix(pairs: DataFrame, size: int = 4) -> DataFrame:
    """Rows of the symmetric inlier matrix of each window, zero diagonal: (win_idx, i, c0, c1, ...)."""
    cells = both_ways(pairs).groupBy("win_idx", F.col("a").alias("i")).pivot("b", list(range(size))).agg(F.sum("num_inliers"))
    return cells.select("win_idx", "i", *[F.coalesce(F.col(str(k)), F.lit(0)).cast("long").alias(f"c{k}") for k in range(size)])


def hub_order(frames: DataFrame, pairs: DataFrame) -> DataFrame:
    """(win_idx, local_idx, degree, inliers, ord): the best connected frame first, then by inliers to it.

    Every frame of a window counts, paired or not. Repeated pair rows count once. Ties go to the lower index.
    """
    edges = both_ways(pairs.dropDuplicates(["win_idx", "i", "j"]))
    rank = edges.groupBy("win_idx", F.col("a").alias("local_idx")).agg(F.count_if("passes").alias("degree"), F.sum("num_inliers").alias("inliers"))
    nodes = frames.select("win_idx", "local_idx").join(rank, ["win_idx", "local_idx"], "left").select("win_idx", "local_idx", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"), F.coalesce("inliers", F.lit(0)).cast("long").alias("inliers"))
    best = Window.partitionBy("win_idx").orderBy(F.desc("degree"), F.desc("inliers"), "local_idx")
    nodes = nodes.withColumn("anchor", F.first("local_idx").over(best))
    near = edges.select("win_idx", F.col("a").alias("local_idx"), F.col("b").alias("anchor"), F.col("num_inliers").alias("to_anchor"))
    nodes = nodes.join(near, ["win_idx", "local_idx", "anchor"], "left").withColumn("to_anchor", F.coalesce("to_anchor", F.lit(0)).cast("long"))
    order = Window.partitionBy("win_idx").orderBy((F.col("local_idx") == F.col("anchor")).desc(), F.desc("to_anchor"), "local_idx")
    return nodes.select("win_idx", "local_idx", "degree", "inliers", "anchor", (F.row_number().over(order) - 1).cast("long").alias("ord"))
