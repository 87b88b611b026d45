"""Sinks: PNG files, CSV appends with a run id, ordered file copies."""

from __future__ import annotations

import os
import shutil
import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def png(image: np.ndarray) -> bytes:
    """A BGR frame as a lossless PNG."""
    h, w = image.shape[:2]
    raw = np.concatenate([np.zeros((h, 1), np.uint8), image[..., ::-1].reshape(h, 3 * w)], 1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


class PngWriter(DataSourceWriter):
    """Writes each row (name, height, width, data) as a file of a folder that all executors share; retries overwrite."""

    def __init__(self, options):
        self.path = options["path"].removeprefix("file://")

    def write(self, rows):
        os.makedirs(self.path, exist_ok=True)
        for row in rows:
            image = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, 3)
            part = os.path.join(self.path, f".{row.name}.{uuid.uuid4().hex}")
            with open(part, "wb") as f:
                f.write(png(image))
            os.replace(part, os.path.join(self.path, row.name))
        return WriterCommitMessage()

    def commit(self, messages):
        pass

    def abort(self, messages):
        pass


class PngSink(DataSource):
    @classmethod
    def name(cls):
        return "png"

    def writer(self, schema, overwrite):
        return PngWriter(self.options)


def write_png(df: DataFrame, path: str) -> None:
    df.sparkSession.dataSource.register(PngSink)
    df.select("name", "height", "width", "data").write.format("png").mode("append").save(path)


def append_csv(df: DataFrame, path: str, run_id: str | None = None) -> None:
    """Appends rows; with a run id, readers can take the last run and repeated appends of a run can be told."""
    from pyspark.sql import functions as F

    out = df.withColumns({"run_id": F.lit(run_id), "written": F.current_timestamp()}) if run_id else df
    out.write.mode("append").option("header", True).csv(path)


def copy_ordered(manifest: DataFrame, folder: str) -> None:
    """Copies src_path to folder/dest_name for each row; both must be on a shared file system."""
    target = folder.removeprefix("file://")
    os.makedirs(target, exist_ok=True)

    def copy(rows):
        for row in rows:
            part = os.path.join(target, f".{row.dest_name}.{uuid.uuid4().hex}")
            shutil.copyfile(row.src_path.removeprefix("file:"), part)
            os.replace(part, os.path.join(target, row.dest_name))

    manifest.select("src_path", "dest_name").foreachPartition(copy)
