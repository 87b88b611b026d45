"""Pixel arithmetic on arrays of channel values: halving, gray, blending, comparison. No UDF; arrays stay in one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panoquery.functions.scalar import blend, gray, pixel_verdict, psnr


def quantised(v: Column) -> Column:
    """Bytes from values in [-1, 1]."""
    return F.transform(v, lambda x: F.least(F.greatest(F.floor((x + 1) * 127.5), F.lit(0)), F.lit(255)).cast("int"))


def halved(pixels: Column, width: int, height: int) -> Column:
    """Half size by the rounded mean of 2 x 2 pixels of a gray plane."""
    at = lambda i, d: F.element_at(pixels, ((F.floor(i / (width // 2)) * 2 * width + (i % (width // 2)) * 2) + d + 1).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit((width // 2) * (height // 2) - 1)), lambda i: F.floor((at(i, 0) + at(i, 1) + at(i, width) + at(i, width + 1)) / 4 + 0.5).cast("int"))


def triples(v: Column) -> Column:
    """BGR pixels of an array of channel values; a rest of fewer than three values is left out."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / 3).cast("int") - 1), lambda i: F.struct(v[i * 3].alias("b"), v[i * 3 + 1].alias("g"), v[i * 3 + 2].alias("r")))


def gray_plane(v: Column) -> Column:
    return F.transform(triples(v), lambda p: gray(p["b"], p["g"], p["r"]).cast("int"))


def blended(a: Column, b: Column) -> Column:
    """Two frames of equal shape as one; a pixel of three zeros is empty."""
    has = lambda p: F.greatest(p["b"], p["g"], p["r"]) > 0
    one = lambda x, y, c: blend(x[c], y[c], has(x), has(y)).cast("int")
    return F.flatten(F.zip_with(triples(a), triples(b), lambda x, y: F.array(one(x, y, "b"), one(x, y, "g"), one(x, y, "r"))))


def blended_tiles(pairs: DataFrame, keys: list[str], rows: int, workers: int = 4) -> DataFrame:
    """The same in strips of ceil(rows / workers) rows, blended apart and put together in order; empty strips don't occur."""
    step = -(-rows // workers)
    width = F.floor(F.size("a") / rows).cast("int")
    tiles = pairs.select(*keys, "a", "b", width.alias("w"), F.explode(F.sequence(F.lit(0), F.lit(-(-rows // step) - 1))).alias("tile"))
    cut = lambda c: F.slice(c, F.col("tile") * step * F.col("w") + 1, F.least(F.lit(step), F.lit(rows) - F.col("tile") * step) * F.col("w"))
    made = tiles.select(*keys, "tile", blended(cut("a"), cut("b")).alias("strip"))
    return made.groupBy(*keys).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("tile", "strip"))), lambda x: x["strip"])).alias("pixels"))


def compared(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Difference of two frames ``a`` and ``b`` (BGR values): shape gate, max, mean, share of equal samples, PSNR, verdict."""
    same = F.size("a") == F.size("b")
    diff = F.when(same, F.zip_with("a", "b", lambda x, y: F.abs(x - y)))
    d = pairs.select(*keys, same.alias("shape_match"), diff.alias("d"))
    n = F.size("d")
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    channel = lambda k: F.filter("d", lambda x, i: i % 3 == k)
    out = d.select(
        *keys,
        "shape_match",
        F.array_max("d").alias("max_pixel_diff"),
        (total("d") / n).alias("mean_pixel_diff"),
        (F.size(F.filter("d", lambda x: x == 0)) * 100 / n).alias("identical_pixels_pct"),
        (total(F.transform("d", lambda x: x * x)) / n).alias("mse"),
        *[F.array_max(channel(k)).alias(f"{c}_max_diff") for k, c in enumerate(("blue", "green", "red"))],
        *[(total(channel(k)) / F.size(channel(k))).alias(f"{c}_mean_diff") for k, c in enumerate(("blue", "green", "red"))],
    )
    out = out.withColumn("psnr_db", psnr(F.col("mse")))
    return out.withColumn("verdict", F.when(~F.col("shape_match"), "Shape mismatch").otherwise(pixel_verdict(F.col("max_pixel_diff"), F.col("psnr_db"))))
