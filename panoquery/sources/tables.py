"""CSV tables of diagnostics and benchmarks, with declared schemas and lenient numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panoquery.functions.scalar import core_count, flag
from panoquery.schemas import BENCHMARK_CSV, CORRECTNESS_CSV, PAIRS_CSV, SUMMARY_CSV


def latest(df: DataFrame) -> DataFrame:
    """Rows of the last run where the table has a run_id, else all. The last is the one written last (``written``), then the largest id by length and text."""
    if "run_id" not in df.columns:
        return df
    order = F.struct(*([F.col("written")] if "written" in df.columns else []), F.length("run_id").alias("n"), F.col("run_id").alias("id"))
    last = df.agg(F.max(order)["id"].alias("run_id"))
    return df.join(F.broadcast(last), "run_id").drop("run_id", "written")


def read(spark: SparkSession, path: str, schema, run_id: bool = False) -> DataFrame:
    schema = f"{schema}, run_id string, written timestamp" if run_id else schema
    return latest(spark.read.schema(schema).option("header", True).csv(path))


def pairs(spark: SparkSession, path: str, run_id: bool = False) -> DataFrame:
    """Pairs with a boolean flag; repeated rows of a pair count once."""
    rows = read(spark, path, PAIRS_CSV, run_id).withColumn("passes", flag(F.col("passes_threshold"))).dropDuplicates(["window_idx", "local_i", "local_j"])
    return rows.select(F.col("window_idx").cast("long").alias("win_idx"), F.col("local_i").cast("long").alias("i"), F.col("local_j").cast("long").alias("j"), F.col("num_matches").cast("long").alias("num_matches"), F.col("num_inliers").cast("long").alias("num_inliers"), "passes")


def summary(spark: SparkSession, path: str) -> DataFrame:
    return read(spark, path, SUMMARY_CSV)


def correctness(spark: SparkSession, path: str) -> DataFrame:
    return read(spark, path, CORRECTNESS_CSV)


def benchmark(spark: SparkSession, path: str) -> DataFrame:
    """Times as doubles; n/a and other text are null."""
    rows = spark.read.schema(BENCHMARK_CSV).option("header", True).csv(path)
    text = [c for c in rows.columns if c.endswith("_s") or c in ("speedup", "ci_lower", "ci_upper")]
    return rows.select(*[F.expr(f"try_cast({c} as double)").alias(c) if c in text else F.col(c) for c in rows.columns])


def scaling(spark: SparkSession, pattern: str) -> DataFrame:
    """All benchmark files of a pattern, with ``cores`` from each name; of files with the same cores the last path counts."""
    rows = benchmark(spark, pattern).select("*", F.col("_metadata.file_path").alias("path"), core_count(F.col("_metadata.file_name")).alias("cores"))
    last = rows.groupBy("cores").agg(F.max("path").alias("path"))
    return rows.join(last, ["cores", "path"], "left_semi").drop("path")
