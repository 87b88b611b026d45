"""Command line: python -m panoquery COMMAND ... on folders of images and the tables that the commands write."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panoquery.functions.scalar import ordered_name
from panoquery.operators import stats, windows
from panoquery.operators.pairs import hub_order
from panoquery.plans import benchmarks, mosaic, reports
from panoquery.sources import images, sinks, tables

COMMANDS = {}


def command(f):
    COMMANDS[f.__name__] = f
    return f


@command
def stitch(spark: SparkSession, a: argparse.Namespace) -> None:
    """One mosaic per window of a folder, as PNG files."""
    features = mosaic.extract(images.load(spark, a.folder, a.start, a.end, a.size))
    made = mosaic.tree(features, a.size) if a.tree else mosaic.linear(features, a.strips)
    sinks.write_png(made.select(F.format_string("window_%d.png", "win_idx").alias("name"), "height", "width", "data"), a.out)


@command
def diagnose(spark: SparkSession, a: argparse.Namespace) -> None:
    """Which frames of each window fit together: pairs and summary tables, and a report."""
    frames = images.load(spark, a.folder, a.start, a.end, a.size)
    ranges = windows.window_ranges(frames.select("win_idx", "pos"))
    scored = mosaic.pair_scores(mosaic.extract(frames)).persist()
    sinks.append_csv(reports.pair_rows(scored, ranges), f"{a.out}/window_diagnostics_pairs")
    sinks.append_csv(reports.summary_rows(scored, ranges), f"{a.out}/window_diagnostics_summary")
    reports.show(reports.window_text(scored, ranges, a.size))
    scored.unpersist()


@command
def reorder(spark: SparkSession, a: argparse.Namespace) -> None:
    """Copies a folder with each window's frames in the order of its best connected one, from a pairs table."""
    frames = windows.windowed(images.listed(spark, a.folder), a.size)
    order = hub_order(frames, tables.pairs(spark, a.pairs))
    at = F.col("win_idx") * a.size + F.col("ord")
    rows = order.join(frames, ["win_idx", "local_idx"]).select(F.col("origin").alias("src_path"), ordered_name(at, F.col("origin")).alias("dest_name"))
    sinks.copy_ordered(rows, a.out)


@command
def benchmark(spark: SparkSession, a: argparse.Namespace) -> None:
    """Times all pipelines on all windows: timing and correctness tables, mosaics as PNG files."""
    frames = images.load(spark, a.folder, 0, None, a.size)
    runs = benchmarks.timed_runs(frames, n_runs=a.runs, warm_ups=a.warm_ups)
    path = f"{a.out}/runs"
    runs.write.mode("overwrite").parquet(path)  # a run is timed once, whatever is read from it
    runs = spark.read.parquet(path)
    sinks.append_csv(benchmarks.timing_rows(runs), f"{a.out}/benchmark_results")
    sinks.append_csv(benchmarks.correctness_rows(benchmarks.differences(runs)), f"{a.out}/correctness_results")
    sinks.write_png(benchmarks.mosaics(runs), f"{a.out}/mosaics")
    for table in (benchmarks.phase_totals(runs), benchmarks.failures(runs), benchmarks.oversized(runs)):
        table.show(truncate=False)


@command
def averages(spark: SparkSession, a: argparse.Namespace) -> None:
    """Mean seconds by strategy and phase of a timing table."""
    out = reports.average_rows(tables.benchmark(spark, a.table))
    out.coalesce(1).write.mode("overwrite").option("header", True).csv(a.out)  # one row per strategy


@command
def speedup(spark: SparkSession, a: argparse.Namespace) -> None:
    """Speedups of the candidates: by phase of one timing table, or by cores of all that match a pattern."""
    rows: DataFrame = tables.scaling(spark, a.table) if a.scaling else tables.benchmark(spark, a.table)
    keys = ["cores", "candidate"] if a.scaling else ["candidate", "phase"]
    pairs = rows.where("phase = 'total'") if a.scaling else rows
    pairs = pairs.select(*keys, F.col("baseline_mean_s").alias("base"), F.col("candidate_mean_s").alias("cand"))
    stats.aggregate_speedup(pairs, *keys).orderBy(*keys).show(200, truncate=False)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="panoquery", description=__doc__)
    sub = out.add_subparsers(dest="command", required=True)
    made = {name: sub.add_parser(name, help=f.__doc__) for name, f in COMMANDS.items()}
    for name in ("stitch", "diagnose", "reorder", "benchmark"):
        made[name].add_argument("folder")
        made[name].add_argument("--size", type=int, default=4, help="frames of a window")
    for name in ("stitch", "diagnose"):
        made[name].add_argument("--start", type=int, default=0)
        made[name].add_argument("--end", type=int)
    made["stitch"].add_argument("--tree", action="store_true")
    made["stitch"].add_argument("--strips", type=int, default=1)
    made["reorder"].add_argument("--pairs", required=True)
    made["benchmark"].add_argument("--runs", type=int, default=3)
    made["benchmark"].add_argument("--warm-ups", type=int, default=2)
    for name in ("averages", "speedup"):
        made[name].add_argument("table")
    made["speedup"].add_argument("--scaling", action="store_true")
    for name in ("stitch", "diagnose", "reorder", "benchmark", "averages"):
        made[name].add_argument("--out", default="results")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    COMMANDS[a.command](spark or SparkSession.builder.appName("panoquery").getOrCreate(), a)


if __name__ == "__main__":
    main()
