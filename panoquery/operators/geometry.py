"""Projective geometry on rows: corners, canvas, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_TIMES = 4


def projected(h: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    """A point under a row-major 3 x 3 matrix; null where it goes to infinity."""
    w = h[6] * x + h[7] * y + h[8]
    return F.try_divide(h[0] * x + h[1] * y + h[2], w), F.try_divide(h[3] * x + h[4] * y + h[5], w)


def canvas(df: DataFrame, h: list[Column], w1: str = "w1", h1: str = "h1", w2: str = "w2", h2: str = "h2") -> DataFrame:
    """Adds x_min, y_min, x_max, y_max, canvas_w, canvas_h, fits: frame 1 in place, frame 2 under ``h``.

    Bounds go half a pixel outward and are cut towards zero. ``fits``: positive size and at most four times the area of
    both frames, in 64-bit arithmetic; false where a corner is not finite.
    """
    xs, ys = [F.lit(0.0), F.col(w1).cast("double")], [F.lit(0.0), F.col(h1).cast("double")]
    for x, y in ((F.lit(0.0), F.lit(0.0)), (F.lit(0.0), F.col(h2)), (F.col(w2), F.col(h2)), (F.col(w2), F.lit(0.0))):
        px, py = projected(h, x.cast("double"), y.cast("double"))
        xs.append(px)
        ys.append(py)
    whole = F.lit(True)
    for c in (*xs, *ys):
        whole = whole & F.coalesce(F.abs(c) < 1e9, F.lit(False))
    cut = lambda c: F.when(whole, c.cast("long"))
    out = df.withColumns({"x_min": cut(F.array_min(F.array(*xs)) - 0.5), "y_min": cut(F.array_min(F.array(*ys)) - 0.5), "x_max": cut(F.array_max(F.array(*xs)) + 0.5), "y_max": cut(F.array_max(F.array(*ys)) + 0.5)})
    out = out.withColumns({"canvas_w": F.col("x_max") - F.col("x_min"), "canvas_h": F.col("y_max") - F.col("y_min")})
    area = F.col(w1).cast("long") * F.col(h1) + F.col(w2).cast("long") * F.col(h2)
    return out.withColumn("fits", F.coalesce((F.col("canvas_w") > 0) & (F.col("canvas_h") > 0) & (F.col("canvas_w") * F.col("canvas_h") <= MOST_TIMES * area), F.lit(False)))
