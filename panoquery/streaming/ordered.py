"""Frames that arrive over time: a file stream in small batches, folded per key in order, with state between batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    import tempfile

    found = spark.conf.get("spark.checkpoint.dir", None)
    return (found or "file://" + tempfile.mkdtemp(prefix="panoquery-stream-")).rstrip("/")


def folded(stream: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Per key after each batch: rows so far, last order value, running total of ``value`` in cents. State is three numbers."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, last, cents = state.get if state.exists else (0, -1, 0)
        rows = pd.concat(list(batches)).sort_values("o")
        n, last, cents = n + len(rows), max(last, int(rows.o.max())), cents + int((rows.v * 100).round().sum())
        state.update((n, last, cents))
        yield pd.DataFrame([(k[0], n, last, cents)], columns=["key", "n", "last", "cents"])

    rows = stream.select(F.col(key).alias("key"), F.col(order).alias("o"), F.col(value).alias("v"))
    return rows.groupBy("key").applyInPandasWithState(step, "key long, n long, last long, cents long", "n long, last long, cents long", "update", "NoTimeout")


def run(spark: SparkSession, folder: str, pattern: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Drains the files of ``folder`` and returns the last state of each key. Small batches are the back-pressure."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")

    query = folded(stream, "user_id", "event_id", "value").writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    out = spark.read.option("basePath", f"{base}/out").schema("key long, n long, last long, cents long, epoch long").parquet(f"{base}/out")
    newest = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("epoch")))
    return out.withColumn("_r", newest).where("_r = 1").select("key", "n", "last", "cents")
