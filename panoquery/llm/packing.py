"""Cost-balanced packing of documents into training sequences.

A task packs its own documents, ``group`` of them at a time, with no shuffle. Documents longer than a sequence give whole
sequences first; what is left of each is a piece. The cost of a sequence is linear in its tokens plus quadratic in each
of its pieces (attention stays inside a document). Pieces are taken in descending length and go to the sequence of
lowest cost among those with room; a group opens as many sequences as its tokens fill. A piece that fits nowhere whole is
cut at the sequence with most room. So at most the last sequence of a group is not full; it is cut into sequences whose
lengths are powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panoquery.llm.common import small_batches
from panoquery.llm.tokens import byte_bpe, encoded

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, sequence_length long, ids binary"


def assign(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) pieces for documents of these lengths."""
    out = [[(i, s, capacity)] for i, n in enumerate(lengths) for s in range(0, n - capacity + 1, capacity)]
    left = sorted(((n % capacity, i) for i, n in enumerate(lengths) if n % capacity), key=lambda x: (-x[0], x[1]))
    total = sum(n for n, _ in left)
    if not total:
        return out
    room = np.full(-(-total // capacity), capacity)
    room[-1] = total - capacity * (len(room) - 1)
    cost = np.zeros(len(room))
    cost[-1] = linear * (capacity - room[-1])  # a short sequence starts with the cost of the tokens that it lacks
    held: list[list[tuple[int, int, int]]] = [[] for _ in room]
    for n, i in left:
        start = lengths[i] - n
        while n:
            fits = room >= n
            at = int(np.where(fits, cost, np.inf).argmin()) if fits.any() else int(room.argmax())
            m = min(n, int(room[at]))
            held[at].append((i, start, m))
            room[at] -= m
            cost[at] += linear * m + quadratic * m * m
            start, n = start + m, n - m
    for pieces in held:
        out.extend(powers_of_two(pieces, capacity))
    return out


def powers_of_two(pieces: list[tuple[int, int, int]], capacity: int) -> Iterator[list[tuple[int, int, int]]]:
    """The sequence itself if it is full, else sequences of the powers of two that its length is the sum of."""
    rest, total = list(pieces), sum(n for *_, n in pieces)
    while total:
        size = capacity if total >= capacity else 1 << (total.bit_length() - 1)
        total -= size
        own = []
        while size:
            i, start, n = rest.pop(0)
            m = min(n, size)
            own.append((i, start, m))
            size -= m
            if n > m:
                rest.insert(0, (i, start + m, n - m))
        yield own


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 1024, group: int = 2048, linear: float = 1.0, quadratic: float = 1 / 2048, known: int = 1_000_000) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, sequence_length, ids (little-endian uint32).

    Each id of each document (null text: empty; the end id counts) lies in exactly one piece. Null and repeated doc_ids
    are packed as they come. Sequence ids are unique: the task's number and a running number.
    ``known`` bounds the table of encoded pieces that a worker keeps.
    """
    tokenizer = tokenizer or byte_bpe()
    small_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        doc_ids: list = []
        held: list[np.ndarray] = []

        def table() -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            lengths = [len(x) for x in held]
            columns: list[list] = [[] for _ in range(8)]
            for pieces in assign(lengths, capacity, linear, quadratic):
                offset, size = 0, sum(n for *_, n in pieces)
                for i, start, n in pieces:
                    for column, value in zip(columns, (doc_ids[i], start, n, lengths[i], sequence, offset, size, held[i][start : start + n].tobytes()), strict=True):
                        column.append(value)
                    offset += n
                sequence += 1
                if len(columns[0]) >= 8192:
                    yield batch_of(columns)
                    columns = [[] for _ in range(8)]
            yield batch_of(columns)

        tokens = 0
        for some, arrays in encoded(batches, tokenizer, known):
            doc_ids += some
            held += arrays
            tokens += sum(map(len, arrays))
            if len(held) >= group or tokens >= 4 << 20:
                yield from table()
                doc_ids, held, tokens = [], [], 0
        yield from table()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, PIECES)


def batch_of(columns: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])
