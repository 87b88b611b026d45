"""The tables and texts that diagnostics write: pairs, window summaries, averages, names, console reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panoquery.operators.pairs import LEAST_INLIERS, inlier_matrix, verdicts
from panoquery.operators.stats import strategy_pivot


def pair_rows(scored: DataFrame, ranges: DataFrame) -> DataFrame:
    """The pairs table: gated pairs with their places in the window and in the whole sequence."""
    both = scored.join(ranges.select("win_idx", "img_start", "img_end"), "win_idx")
    whole = lambda c, name: c.cast("int").alias(name)
    at = lambda c: F.col("img_start") + F.col(c)
    places = [whole(F.col(a), b) for a, b in (("win_idx", "window_idx"), ("img_start", "img_start"), ("img_end", "img_end"), ("i", "local_i"), ("j", "local_j"))]
    counts = [whole(at("i"), "global_i"), whole(at("j"), "global_j"), whole(F.col("num_matches"), "num_matches"), whole(F.col("num_inliers"), "num_inliers")]
    return both.select(*places, *counts, F.initcap(F.col("passes").cast("string")).alias("passes_threshold"))


def summary_rows(scored: DataFrame, ranges: DataFrame) -> DataFrame:
    """The summary table: one row per window of at least two frames, with its verdict."""
    both = ranges.join(verdicts(scored), "win_idx", "left")
    n = F.col("n_frames")
    total = F.coalesce("total_pairs", F.floor(n * (n - 1) / 2))
    cast = lambda c, name: c.cast("int").alias(name)
    return both.select(
        cast(F.col("win_idx"), "window_idx"), cast(F.col("img_start"), "img_start"), cast(F.col("img_end"), "img_end"), cast(n, "num_images"),
        cast(total, "total_pairs"), cast(F.coalesce("passing_pairs", F.lit(0)), "passing_pairs"), F.coalesce("verdict", F.lit("EMPTY")).alias("verdict"),
    )


def average_rows(benchmark: DataFrame) -> DataFrame:
    """The averages table from the timing table: mean seconds by strategy, one column per phase; what is n/a is skipped."""
    secs = lambda c: F.col(c).cast("double").alias("secs")
    candidates = benchmark.select(F.col("candidate").alias("strategy"), "phase", secs("candidate_mean_s"))
    baseline = benchmark.select("window_idx", F.col("baseline").alias("strategy"), "phase", secs("baseline_mean_s")).distinct()
    return strategy_pivot(candidates, baseline.drop("window_idx"))


def names(*tables: DataFrame, column: str = "candidate") -> DataFrame:
    """The distinct values of a column over all tables, in order."""
    out = tables[0].select(column)
    for t in tables[1:]:
        out = out.unionByName(t.select(column))
    return out.where(F.col(column).isNotNull()).distinct().orderBy(column)


def by_window(benchmark: DataFrame) -> DataFrame:
    """The timing table in the order of its windows."""
    return benchmark.orderBy("window_idx", "candidate", "phase")


def window_text(scored: DataFrame, ranges: DataFrame, size: int = 4) -> DataFrame:
    """(win_idx, report): what a person reads about each window: inlier matrix, counts, pairs that pass, verdict."""
    cell = lambda k: F.when(F.col("i") == k, F.lit("--")).otherwise(F.concat(F.col(f"c{k}").cast("string"), F.when(F.col(f"c{k}") >= LEAST_INLIERS, "*").otherwise("")))
    row: Column = F.concat(F.lpad(F.col("i").cast("string"), 4, " "), F.lit(" |"), *[F.when(F.col("n_frames") > k, F.lpad(cell(k), 7, " ")).otherwise("") for k in range(size)])
    matrix = inlier_matrix(scored, size).join(ranges.select("win_idx", "n_frames"), "win_idx").groupBy("win_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", row.alias("text")))), lambda x: x["text"]), "\n").alias("matrix"))
    pair = F.format_string("(%d,%d)", "i", "j")
    passing = scored.where("passes").groupBy("win_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "j", pair.alias("text")))), lambda x: x["text"]), ", ").alias("valid"))
    told = ranges.join(summary_rows(scored, ranges).withColumnRenamed("window_idx", "win_idx").select("win_idx", "total_pairs", "passing_pairs", "verdict"), "win_idx").join(matrix, "win_idx", "left").join(passing, "win_idx", "left")
    lines = [
        F.format_string("WINDOW %d [images %d:%d] (%d images)", "win_idx", "img_start", "img_end", "n_frames"),
        F.col("matrix"),
        F.format_string("pairs tested: %d, passing: %d", "total_pairs", "passing_pairs"),
        F.concat(F.lit("valid pairs: "), F.col("valid")),
        F.concat(F.lit("verdict: "), F.col("verdict")),
    ]
    return told.select("win_idx", F.concat_ws("\n", *lines).alias("report"))


def show(texts: DataFrame, most: int = 100) -> None:
    """Prints the reports of the first ``most`` windows; the table itself holds them all."""
    for row in texts.orderBy("win_idx").limit(most).collect():
        print(row.report, end="\n\n")
