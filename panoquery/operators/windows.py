"""Positions and tumbling index windows."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panoquery.functions.scalar import resolve


def positions(df: DataFrame, key: str, buckets: int | None = None) -> DataFrame:
    """``df`` with ``pos``: 0, 1, ... by the integer column ``key`` (unique; a null raises).

    Rows are counted in ranges of the key, cut at its quantiles so that far keys or gaps don't fill one range; only the
    counts, at most ``buckets`` of them, meet in one task. The rows are numbered inside their range.
    """
    n = buckets or max(16, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted(set(df.approxQuantile(key, [k / n for k in range(1, n)], 1 / (4 * n))))
    known = df.withColumn(key, F.coalesce(F.col(key), F.raise_error(F.lit(f"null in {key}"))))
    binned = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol=key, outputCol="_bin").transform(known) if cuts else known.withColumn("_bin", F.lit(0.0))
    counts = binned.groupBy("_bin").agg(F.count("*").alias("_n"))
    counts = counts.select("_bin", (F.sum("_n").over(Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_bin").orderBy(key)) - 1
    return binned.withColumn("_in", inside).join(F.broadcast(counts), "_bin").select(*df.columns, (F.col("_before") + F.col("_in")).cast("long").alias("pos"))


def path_positions(paths: DataFrame, key: str = "origin") -> DataFrame:
    """``pos`` by a path column: one task sorts the paths alone, which are few; use ``positions`` for large tables."""
    return paths.withColumn("pos", (F.row_number().over(Window.orderBy(key)) - 1).cast("long"))


def sliced(df: DataFrame, start: int | None = -4, end: int | None = None) -> DataFrame:
    """Rows with ``pos`` in [start:end] as Python slices it."""
    n = df.agg(F.count("*").alias("_total"))
    out = df.join(F.broadcast(n))
    return out.where((F.col("pos") >= resolve(start, F.col("_total"), F.lit(0))) & (F.col("pos") < resolve(end, F.col("_total"), F.col("_total")))).drop("_total")


def windowed(df: DataFrame, size: int = 4) -> DataFrame:
    """``win_idx`` and ``local_idx`` of tumbling windows of ``size`` positions; the last may be short."""
    return df.withColumns({"win_idx": F.expr(f"pos div {size}"), "local_idx": F.expr(f"pos % {size}")})


def window_ranges(df: DataFrame, least: int = 2) -> DataFrame:
    """(win_idx, img_start, img_end, n_frames) of the windows of at least ``least`` rows."""
    out = df.groupBy("win_idx").agg(F.min("pos").alias("img_start"), (F.max("pos") + 1).alias("img_end"), F.count("*").alias("n_frames"))
    return out.where(F.col("n_frames") >= least)
