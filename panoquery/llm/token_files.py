"""Token ids of a corpus in a compact file format, and back.

Documents are dealt out by ranges of doc_id, encoded in ascending order and written as blocks of the adaptive range coder
(``range_coder``). The container is a table of blocks (part, seq, n_docs, n_tokens, block): Spark's writer commits it, so
lost executors leave no half-written files, and every block carries its own checksums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panoquery.llm.common import small, small_batches
from panoquery.llm.range_coder import read_block, write_block
from panoquery.llm.tokens import ID_TYPE, byte_bpe, encoded

BLOCKS = "part long, seq long, n_docs long, n_tokens long, block binary"


def write(docs: DataFrame, path: str, tokenizer: str | None = None, alphabet: int = 50257, block_tokens: int = 8_000_000) -> None:
    """Encode ``docs`` (doc_id, text; null: empty) and write their blocks to ``path``.

    Order: doc_id ascending, null ids first, equal ids by text. An empty table gives an empty container.
    """
    tokenizer = tokenizer or byte_bpe()
    spark = docs.sparkSession
    small_batches(spark)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        ids: list = []
        held: list[np.ndarray] = []
        n = 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([seq]), pa.array([len(ids)]), pa.array([n]), pa.array([write_block(ids, held, alphabet)], pa.binary())], ["part", "seq", "n_docs", "n_tokens", "block"])

        for some, arrays in encoded(batches, tokenizer):
            for i, a in zip(some, arrays, strict=True):
                ids.append(i)
                held.append(a.astype(np.uint16) if alphabet <= 65536 else a)
                n += len(a)
                if n >= block_tokens:
                    yield block()
                    ids, held, n, seq = [], [], 0, seq + 1
        if ids:
            yield block()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(rows, BLOCKS).write.parquet(path)


def read(spark, path: str, of: Callable[[memoryview], object] = bytes, kind: str = "binary") -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document of the container at ``path``.

    ``ids`` is what ``of`` makes of a document's little-endian unsigned 32-bit ids, of SQL type ``kind``: those bytes
    themselves, or a digest of them, so that whole documents need not leave the worker.
    """
    table = spark.read.schema(BLOCKS).parquet(path)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, seq, _, _, data = (batch.column(c)[i].as_py() for c in range(5))
                doc_ids, lengths, ids = read_block(data)
                ends = np.cumsum(lengths)
                raw = memoryview(ids.astype(ID_TYPE).tobytes())
                own = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                for k in range(0, len(own), 2000):
                    m = len(own[k : k + 2000])
                    yield pa.RecordBatch.from_arrays([pa.array([part] * m), pa.array([seq] * m), pa.array(doc_ids[k : k + m], pa.int64()), pa.array((ends - lengths)[k : k + m]), pa.array(lengths[k : k + m]), pa.array([of(x) for x in own[k : k + m]])], ["part", "seq", "doc_id", "inside", "n_tokens", "ids"])

    meta = table.select("part", "seq", "n_tokens")
    totals = meta.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    totals = totals.withColumn("base", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    before = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    starts = meta.withColumn("before", before).join(totals.select("part", "base"), "part").select("part", "seq", (F.col("base") + F.col("before")).alias("first"))
    starts = F.broadcast(starts) if small(meta, 200_000) else starts
    return table.mapInArrow(rows, f"part long, seq long, doc_id long, inside long, n_tokens long, ids {kind}").join(starts, ["part", "seq"]).select("doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids")
