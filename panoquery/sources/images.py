"""Image directories as ordered frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panoquery.functions.scalar import suffix
from panoquery.operators.kernels import resized
from panoquery.operators.windows import path_positions, sliced, windowed
from panoquery.schemas import FRAME

SUFFIXES = (".jpg", ".png")


def same_path(c: str):
    return F.regexp_replace(c, "^file:/+", "file:/")


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(origin, pos) of the images of a folder by path; contents are not read."""
    paths = spark.read.format("binaryFile").load(folder).select(same_path("path").alias("origin"))  # only names are read
    return path_positions(paths.where(suffix(F.col("origin")).isin(*SUFFIXES)))


def load(spark: SparkSession, folder: str, start: int | None = -4, end: int | None = None, size: int = 4, half: bool = True) -> DataFrame:
    """Decoded frames of the slice [start:end], BGR, at half size, in windows of ``size``.

    Positions and windows come from the sorted list of all files, so a file that can't be read leaves a gap (it is
    dropped after numbering) and never shifts its neighbours.
    """
    wanted = windowed(sliced(listed(spark, folder), start, end), size)
    # the files of the slice alone are opened; their names are on the driver anyway, where Spark lists them
    paths = [r.origin for r in wanted.select("origin").collect()]
    plain = paths and not any(set(p) & set("[]{}*?\\,%") for p in paths)
    read = spark.read.format("image").load(paths if plain else folder).select(same_path("image.origin").alias("origin"), "image.height", "image.width", "image.nChannels", "image.data").where("height > 0")

    def shrunk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                x = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.nChannels)
                x = np.repeat(x, 3, 2) if row.nChannels == 1 else x[..., :3]
                x = resized(x, max(1, row.height // 2), max(1, row.width // 2)) if half else x
                yield pd.DataFrame([{"origin": row.origin, "pos": row.pos, "win_idx": row.win_idx, "local_idx": row.local_idx, "height": x.shape[0], "width": x.shape[1], "data": np.ascontiguousarray(x).tobytes()}])

    return read.join(wanted, "origin").select("origin", "pos", "win_idx", "local_idx", "height", "width", "nChannels", "data").mapInPandas(shrunk, FRAME)
