"""Seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one warm-up, then the mean of three runs."""

import json
import math
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
from pyspark.sql import SparkSession  # noqa: E402

from panoquery.functions.scalar import T_CRITICAL  # noqa: E402
from panoquery.plans import queries as engine  # noqa: E402


def main() -> None:
    sf, cpus, runs = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
    os.environ["PYTHONPATH"] = str(Path(__file__).resolve().parent)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp()).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took, margin = {}, {}
    for name, query in engine.QUERIES.items():
        times = []
        for k in range(runs + 1):
            t = time.time()
            query(spark, sf).write.format("noop").mode("overwrite").save()
            if k:
                times.append(time.time() - t)
        took[name] = round(statistics.mean(times), 3)
        margin[name] = round(T_CRITICAL[runs - 2] * statistics.stdev(times) / math.sqrt(runs), 3) if runs > 1 else 0
    print(json.dumps({"metric": "total seconds of all engine queries", "value": round(sum(took.values()), 2), "unit": "sec", "queries": took, "margin_95": margin, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
