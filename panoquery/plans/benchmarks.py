"""Benchmark of mosaic pipelines: windows x pipelines x (warm-ups + runs), each phase timed where it runs.

A task holds one window and one pipeline, so its runs follow each other on one core and windows spread over the cluster.
Failures stay where they happen: a failed warm-up leaves the pipeline out of its window, a failed run is skipped, and a
window without any run of the baseline gives no comparison.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panoquery.functions.scalar import pixel_verdict, psnr
from panoquery.operators import kernels as K
from panoquery.operators.stats import against_baseline, phase_stats
from panoquery.schemas import PHASES

RUNS = "win_idx long, img_start long, img_end long, n_images int, mean_area double, pipeline string, run int, " + ", ".join(f"{p} double" for p in PHASES) + ", error string, height int, width int, data binary"
NOT_MEASURED = "n/a"  # fixed value of the timing table


class Clock:
    """Seconds by phase."""

    def __init__(self):
        self.began = time.perf_counter()
        self.spent = dict.fromkeys(PHASES[:-1], 0.0)

    @contextmanager
    def __call__(self, phase: str):
        t = time.perf_counter()
        try:
            yield
        finally:
            self.spent[phase] += time.perf_counter() - t

    def read(self) -> dict[str, float]:
        return self.spent | {"total": time.perf_counter() - self.began}


def joined(base: tuple, new: tuple, seed: int, strips: int, clock: Clock) -> tuple | None:
    """(image, features) of two merged nodes, or None."""
    out, _ = K.merged(base[0], base[1], new[0], new[1], seed, strips, clock)
    if out is None:
        return None
    with clock("reext"):
        return out, K.features(out)


def linear_run(strips: int) -> Callable:
    def run(nodes: list[tuple], win: int, clock: Clock) -> np.ndarray:
        acc = nodes[0]
        for k, node in enumerate(nodes[1:], 1):
            acc = joined(acc, node, K.seeded(win, 0, k), strips, clock) or acc
        return acc[0]

    return run


def tree_run(nodes: list[tuple], win: int, clock: Clock) -> np.ndarray:
    depth = 0
    while len(nodes) > 1:
        pairs = [(nodes[i], nodes[i + 1] if i + 1 < len(nodes) else None) for i in range(0, len(nodes), 2)]
        nodes = [a if b is None else joined(a, b, K.seeded(win, depth, i), 1, clock) or a for i, (a, b) in enumerate(pairs)]
        depth += 1
    return nodes[0][0]


#: The first is the baseline. Linear folds in one piece, in 8 strips and in 4, and the fold as a tree.
PIPELINES: dict[str, Callable] = {"sequential": linear_run(1), "parallel": linear_run(8), "producer_consumer": linear_run(4), "mapreduce": tree_run, "joblib": linear_run(4), "shared_memory": linear_run(4)}


def timed_runs(frames: DataFrame, pipelines: dict[str, Callable] = PIPELINES, n_runs: int = 3, warm_ups: int = 2) -> DataFrame:
    """One row per window, pipeline and run (RUNS); windows of fewer than two frames give none. The last good run holds the mosaic.

    ``frames``: (win_idx, pos, height, width, data). A pipeline whose warm-up fails has one row, run -1, with the error.
    """

    def once(images: list[np.ndarray], win: int, pipeline: Callable) -> tuple[dict, np.ndarray]:
        clock = Clock()
        nodes = []
        for x in images:
            with clock("extract"):
                nodes.append((x, K.features(x)))
        out = pipeline(nodes, win, clock)
        return clock.read(), out

    def run(key, batch: pd.DataFrame) -> pd.DataFrame:
        own = list(batch.sort_values("pos").itertuples(index=False))
        columns = [c.split()[0] for c in RUNS.split(", ")]
        if len(own) < 2:
            return pd.DataFrame(columns=columns)
        win, name = int(key[0]), key[1]
        images = [np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3) for r in own]
        about = {"win_idx": win, "img_start": own[0].pos, "img_end": own[-1].pos + 1, "n_images": len(own), "mean_area": float(np.mean([x.shape[0] * x.shape[1] for x in images])), "pipeline": name}
        rows, last = [], None
        try:
            for _ in range(warm_ups):
                once(images, win, pipelines[name])
        except Exception as e:  # noqa: BLE001  whatever a pipeline raises stays in its window
            rows.append(about | {"run": -1, "error": f"warm-up: {type(e).__name__}: {e}"})
        else:
            for k in range(n_runs):
                try:
                    spent, out = once(images, win, pipelines[name])
                    rows.append(about | {"run": k} | spent)
                    last = len(rows) - 1, out
                except Exception as e:  # noqa: BLE001
                    rows.append(about | {"run": k, "error": f"{type(e).__name__}: {e}"})
        if last:
            at, out = last
            rows[at] |= {"height": out.shape[0], "width": out.shape[1], "data": out.tobytes()}
        return pd.DataFrame(rows, columns=columns).astype({"height": "Int32", "width": "Int32"}).astype(object).where(lambda x: x.notna(), None)

    names = F.explode(F.array(*[F.lit(n) for n in pipelines])).alias("pipeline")
    return frames.select("win_idx", "pos", "height", "width", "data", names).groupBy("win_idx", "pipeline").applyInPandas(run, RUNS)


def good(runs: DataFrame, baseline: str) -> DataFrame:
    """Runs that ended well, of windows where the baseline has one."""
    ok = runs.where("error is null")
    return ok.join(ok.where(F.col("pipeline") == baseline).select("win_idx").distinct(), "win_idx", "left_semi")


def long(runs: DataFrame) -> DataFrame:
    """(win_idx, img_start, img_end, pipeline, run, phase, secs)"""
    return runs.unpivot(["win_idx", "img_start", "img_end", "pipeline", "run"], PHASES, "phase", "secs")


def timing_rows(runs: DataFrame, baseline: str = "sequential") -> DataFrame:
    """The timing table: each candidate beside the baseline by window and phase; text, as what wasn't measured is n/a."""
    keys = ["win_idx", "img_start", "img_end", "phase"]
    both = against_baseline(phase_stats(long(good(runs, baseline)), *keys, "pipeline"), baseline, "pipeline", *keys)
    text = lambda c, digits: F.coalesce(F.round(c, digits).cast("string"), F.lit(NOT_MEASURED))
    known = F.col("speedup").isNotNull()
    return both.select(
        F.col("win_idx").cast("int").alias("window_idx"),
        F.col("img_start").cast("int").alias("img_start"),
        F.col("img_end").cast("int").alias("img_end"),
        F.lit(baseline).alias("baseline"),
        F.col("pipeline").alias("candidate"),
        "phase",
        *[text(F.col(f"{short}_{v}"), 6).alias(f"{name}_{v}_s") for short, name in (("base", "baseline"), ("cand", "candidate")) for v in ("mean", "std", "margin")],
        *[text(F.when(known, F.col(c)), 4).alias(c) for c in ("speedup", "ci_lower", "ci_upper")],
    )


DIFFERENCE = "win_idx long, img_start long, img_end long, pipeline string, shape_match boolean, max_pixel_diff int, mean_pixel_diff double, identical_pixels_pct double, mse double, " + ", ".join(
    f"{c}_max_diff int, {c}_mean_diff double" for c in ("blue", "green", "red")
)


def differences(runs: DataFrame, baseline: str = "sequential") -> DataFrame:
    """Each candidate's mosaic against the baseline's of the same window, with PSNR (null where equal) and verdict."""
    made = good(runs, baseline).where("data is not null").select("win_idx", "img_start", "img_end", "pipeline", "height", "width", "data")
    base = made.where(F.col("pipeline") == baseline).select("win_idx", F.col("height").alias("h0"), F.col("width").alias("w0"), F.col("data").alias("d0"))

    def compare(batches):
        names = [c.split()[0] for c in DIFFERENCE.split(", ")]
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                row = {"win_idx": r.win_idx, "img_start": r.img_start, "img_end": r.img_end, "pipeline": r.pipeline, "shape_match": (r.height, r.width) == (r.h0, r.w0)}
                if row["shape_match"]:
                    a, b = (np.frombuffer(x, np.uint8).astype(np.int32).reshape(-1, 3) for x in (r.d0, r.data))
                    d = np.abs(a - b)
                    row |= {"max_pixel_diff": int(d.max()), "mean_pixel_diff": float(d.mean()), "identical_pixels_pct": float((d == 0).mean() * 100), "mse": float((d.astype(float) ** 2).mean())}
                    for k, c in enumerate(("blue", "green", "red")):
                        row |= {f"{c}_max_diff": int(d[:, k].max()), f"{c}_mean_diff": float(d[:, k].mean())}
                out.append(row)
            yield pd.DataFrame(out, columns=names).astype(object).where(lambda x: x.notna(), None)

    found = made.where(F.col("pipeline") != baseline).join(base, "win_idx").mapInPandas(compare, DIFFERENCE)
    found = found.withColumn("psnr_db", psnr(F.col("mse")))
    return found.withColumn("verdict", F.when(~F.col("shape_match"), "Shape mismatch").otherwise(pixel_verdict(F.col("max_pixel_diff"), F.col("psnr_db"))))


def correctness_rows(found: DataFrame, baseline: str = "sequential") -> DataFrame:
    """The correctness table from ``differences``: rounded, ``inf`` for equal mosaics, nothing but the verdict where shapes differ."""
    decibel = F.when(F.col("shape_match"), F.coalesce(F.round("psnr_db", 4).cast("string"), F.lit("inf")))
    channels = [x for c in ("blue", "green", "red") for x in (F.col(f"{c}_max_diff"), F.round(f"{c}_mean_diff", 6).alias(f"{c}_mean_diff"))]
    whole = [F.col(a).cast("int").alias(b) for a, b in (("win_idx", "window_idx"), ("img_start", "img_start"), ("img_end", "img_end"))]
    mean, share = F.round("mean_pixel_diff", 6).alias("mean_pixel_diff"), F.round("identical_pixels_pct", 4).alias("identical_pixels_pct")
    return found.select(*whole, F.lit(baseline).alias("baseline"), F.col("pipeline").alias("candidate"), "shape_match", "max_pixel_diff", mean, share, decibel.alias("psnr_db"), *channels, "verdict")


def phase_totals(runs: DataFrame) -> DataFrame:
    """(pipeline, one sum of seconds per phase, stitch): what each pipeline spent over all good runs; stitching is all but extraction."""
    sums = [F.sum(p).alias(p) for p in PHASES]
    return runs.where("error is null").groupBy("pipeline").agg(*sums).withColumn("stitch", F.col("match") + F.col("homo") + F.col("warp") + F.col("reext"))


def oversized(runs: DataFrame, times: float = 10) -> DataFrame:
    """Mosaics of more than ``times`` the mean area of their frames."""
    return runs.where("data is not null").where(F.col("height") * F.col("width") > times * F.col("mean_area")).select("win_idx", "pipeline", "height", "width", "mean_area")


def mosaics(runs: DataFrame, baseline: str = "sequential") -> DataFrame:
    """(name, height, width, data): the mosaic of each pipeline and window, named for the PNG sink."""
    name = F.format_string("%s_window_%d_%d.png", "pipeline", "img_start", "img_end")
    return good(runs, baseline).where("data is not null").select(name.alias("name"), "height", "width", "data")


def failures(runs: DataFrame) -> DataFrame:
    """(win_idx, pipeline, failed, errors, measured): what went wrong, and how many runs a pipeline has in a window."""
    last = Window.partitionBy("win_idx", "pipeline").orderBy("run")
    some = runs.withColumn("k", F.row_number().over(last))
    out = some.groupBy("win_idx", "pipeline").agg(F.count_if(F.col("error").isNotNull()).alias("failed"), F.array_join(F.array_sort(F.collect_set("error")), "; ").alias("errors"), F.count_if(F.col("error").isNull()).alias("measured"))
    return out.where("failed > 0")
