"""Benchmark statistics: means with t-intervals, speedups with propagated error, report pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panoquery.functions.scalar import t_critical
from panoquery.schemas import PHASES


def phase_stats(runs: DataFrame, *keys: str, value: str = "secs") -> DataFrame:
    """Per key: n, mean, std (sample; 0 for one run) and the margin of the 95 % t-interval; null where a run isn't measurable."""
    g = runs.groupBy(*keys).agg(F.count("*").alias("n"), F.count(value).alias("_m"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))
    whole = F.col("n") == F.col("_m")
    margin = F.when(F.col("n") > 1, t_critical(F.col("n")) * F.col("std") / F.sqrt("n")).otherwise(F.lit(0.0))
    return g.select(*keys, "n", F.when(whole, F.col("mean")).alias("mean"), F.when(whole, F.col("std")).alias("std"), F.when(whole, margin).alias("margin"))


def speedup(joined: DataFrame, base: str = "base_", cand: str = "cand_") -> DataFrame:
    """Adds speedup, ci_lower, ci_upper from n, mean, std of both sides; nulls where a side is not measurable."""
    b, c = (lambda x: F.col(base + x)), (lambda x: F.col(cand + x))
    cv = lambda x: F.when(x("mean") > 0, x("std") / x("mean")).otherwise(F.lit(0.0))
    margin = t_critical(F.least(b("n"), c("n"))) * F.sqrt(cv(b) * cv(b) / b("n") + cv(c) * cv(c) / c("n"))
    known = b("mean").isNotNull() & c("mean").isNotNull()
    ratio: Column = F.when(known, F.when(c("mean") == 0, F.lit(0.0)).otherwise(F.try_divide(b("mean"), c("mean"))))
    return joined.withColumns({"speedup": ratio, "ci_lower": ratio * (1 - margin), "ci_upper": ratio * (1 + margin)})


def against_baseline(stats: DataFrame, baseline: str, name: str, *keys: str, how: str = "inner") -> DataFrame:
    """Every other ``name`` beside the baseline of the same keys; "left" keeps those whose baseline is missing."""
    values = ("n", "mean", "std", "margin")
    base = stats.where(F.col(name) == baseline).select(*keys, *[F.col(v).alias(f"base_{v}") for v in values])
    cand = stats.where(F.col(name) != baseline).select(*keys, name, *[F.col(v).alias(f"cand_{v}") for v in values])
    return speedup(cand.join(base, list(keys), how))


def aggregate_speedup(rows: DataFrame, *keys: str) -> DataFrame:
    """Ratio of sums over rows that have both times; null where no row has, or the candidate's sum isn't positive."""
    both = F.col("base").isNotNull() & F.col("cand").isNotNull()
    g = rows.groupBy(*keys).agg(F.sum(F.when(both, F.col("base"))).alias("b"), F.sum(F.when(both, F.col("cand"))).alias("c"))
    return g.select(*keys, F.when(F.col("c") > 0, F.try_divide("b", "c")).alias("speedup"))


def strategy_pivot(candidates: DataFrame, baseline: DataFrame) -> DataFrame:
    """(strategy, one column per phase): means of all candidate rows and of all baseline rows, nulls skipped."""
    rows = candidates.select("strategy", "phase", "secs").unionByName(baseline.select("strategy", "phase", "secs"))
    return rows.groupBy("strategy").pivot("phase", PHASES).agg(F.avg("secs"))
