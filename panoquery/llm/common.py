"""Pieces that several operators share: tables in the shared folder, Arrow text buffers, hashing and components."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}
FOLD = 16


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode, where it may be unset, a folder of this process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _FALLBACK.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="panoquery-"))


def materialise(df: DataFrame, label: str, few: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives the loss of executors.

    With ``few``, for tables of a few short rows for each partition they come from, the files are fewer by FOLD (every
    file that is made costs time, and every later task that reads one).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    kept = df.repartition(max(4, int(spark.conf.get("spark.sql.shuffle.partitions")) // FOLD)) if few else df
    kept.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free(df: DataFrame, *names: str) -> list[str]:
    """Column names made of ``names`` that ``df`` doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def small(df: DataFrame, most: int) -> bool:
    """Whether ``df`` has at most ``most`` rows: the check that stands before every broadcast."""
    return df.limit(most + 1).count() <= most


def semi(df: DataFrame, ids: DataFrame, key: str | list[str], most: int = 1_000_000) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``ids``; broadcast up to ``most`` ids, shuffled beyond."""
    return df.join(F.broadcast(ids) if small(ids, most) else ids, key, "left_semi")


def without(df: DataFrame, ids: DataFrame, key: str | list[str], most: int = 1_000_000) -> DataFrame:
    """Rows of ``df`` whose ``key`` is not in ``ids``; null keys stay. Broadcast up to ``most`` ids, shuffled beyond."""
    return df.join(F.broadcast(ids) if small(ids, most) else ids, key, "left_anti")


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Let Arrow batches hold at most ``most`` bytes, so that workers need little memory whatever the texts' length."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("bB")) > most:
        spark.conf.set(key, str(most))


def trim() -> None:
    """Give memory that numpy and Arrow have freed back to the system: workers are used again and again."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about ``most_bytes`` of ``column``, so that numpy's temporaries stay bounded."""
    for batch in batches:
        _, offsets = buffers(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most_bytes, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b): every node ``a`` of ``links`` (columns a, b) that is not the smallest of its component, and that smallest node.

    Alternates large-star and small-star steps, each a grouped minimum and an equi-join, until the edges stay the same;
    no group is ever collected. Each round is a table in the shared folder.
    """
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", few=True)
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or state[0] == 0:
            return edges
        seen = tuple(state)
        edges = materialise(small_star(large_star(edges)), "edges", few=True)
