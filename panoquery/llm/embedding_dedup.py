"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells, one representative per group.

Only vectors with equal labels are compared. Identical vectors are one class with a count, so copies cost nothing. The
centroids are fitted on bounded samples of classes; where a label has many vectors, each first cell is divided again by
centroids of its own, so that cells keep their size while tables grow (up to ``Params.most_cells`` cells a width; beyond,
cells grow and are compared in more blocks). No near pair is lost at a border: two unit vectors of cosine c are
sqrt(2 - 2c) apart, so one of them is within half of that of the plane that halves the space between their two centroids.
Every vector is put into its nearest cell and into each whose plane is that near, so the pair shares a cell. A cell is cut
into blocks of about ``Params.block`` vectors, and pairs of blocks are compared as matrix products in double precision: a
task holds two blocks, whatever a cell's size. A pair that meets in several cells counts in the first that they share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panoquery.llm.common import components, materialise


@dataclass(frozen=True)
class Params:
    cosine: float = 0.93
    sample: int = 20_000  # vectors for the first centroids of a width, and for those inside each first cell
    sample_bytes: int = 64 << 20
    per_cell: int = 2000
    first_cells: int = 256
    most_cells: int = 65_536
    block: int = 1024
    rounds: int = 12
    seed: int = 3


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v): v holds the components as doubles; rows without a label or a usable vector are left out."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding").cast(pa.large_list(pa.float64()))
            ends = np.asarray(column.offsets)
            x = np.ascontiguousarray(column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]])  # nulls become NaN
            ends = ends - ends[0]
            total = lambda ok: np.diff(np.append(0, np.cumsum(ok))[ends])
            keep = column.is_valid().to_numpy(zero_copy_only=False) & (total(~np.isfinite(x)) == 0) & (total(x != 0) > 0)
            v = pa.Array.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer((ends * 8).astype(np.int64).tobytes()), pa.py_buffer(x.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), v.cast(pa.binary())], ["vec_id", "label", "v"]).filter(pa.array(keep))

    picked = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return picked.where("label is not null and vec_id is not null").mapInArrow(rows, "vec_id long, label string, v binary")


def units(column: pa.Array) -> np.ndarray:
    x = np.frombuffer(b"".join(column.to_pylist()), float).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # against overflow of the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centroids(x: np.ndarray, k: int, p: Params) -> np.ndarray:
    """Unit centroids of spherical k-means."""
    rng = np.random.default_rng(p.seed)
    centre = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))]
    for _ in range(p.rounds):
        at = (x @ centre.T).argmax(1)
        total = np.zeros_like(centre)
        np.add.at(total, at, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), centre)
    return centre


def reached(x: np.ndarray, centre: np.ndarray, p: Params) -> np.ndarray:
    """Which cells each vector is put into: rows by cells."""
    near = x @ centre.T
    best = near.argmax(1)
    half = np.sqrt(2 - 2 * p.cosine) / 2 + 1e-9
    apart = np.sqrt(np.maximum(0, 2 - 2 * (centre @ centre.T)))[best]
    return near.max(1, keepdims=True) - near <= half * apart + 1e-12


def fitted(classes: DataFrame, p: Params) -> dict[int, tuple[np.ndarray, dict[int, np.ndarray]]]:
    """For each width in bytes: the first centroids, and the centroids inside those first cells that are divided again."""
    sizes = classes.groupBy("group").agg(F.count("*").alias("n"), F.first(F.octet_length("v")).alias("width"))
    widths = {r.width: (r.most, r.n) for r in sizes.groupBy("width").agg(F.max("n").alias("most"), F.sum("n").alias("n")).collect()}
    spark, out = classes.sparkSession, {}
    for width, (most, n) in widths.items():
        rows = max(1, min(p.sample, p.sample_bytes // width))
        cells = min(p.most_cells, -(-most // p.per_cell))
        first = min(cells, p.first_cells)

        def sampled(wanted: int, width: int = width, n: int = n) -> DataFrame:
            share = int(min(1.0, 1.2 * wanted / n) * (1 << 20))
            return classes.where((F.octet_length("v") == width) & (F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) <= share)).select("rep", "v")

        got = sorted(sampled(rows).limit(rows).collect(), key=lambda row: row.rep)
        top = centroids(units(pa.array([bytes(row.v) for row in got], pa.binary())), first, p)
        inner: dict[int, np.ndarray] = {}
        if cells > first:
            each = -(-cells // first)
            inner = divided(sampled(max(1, min(rows, 32 * each)) * first), top, each, rows, p)
        out[width] = (top, inner)
    return out


def divided(some: DataFrame, top: np.ndarray, each: int, rows: int, p: Params) -> dict[int, np.ndarray]:
    """For each first cell ``each`` centroids of its own, fitted on at most ``rows`` of the vectors in ``some`` (rep, v)."""
    held = some.sparkSession.sparkContext.broadcast(top)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = (units(batch.column("v")) @ held.value.T).argmax(1) if batch.num_rows else np.zeros(0, np.int64)
            yield batch.append_column("cell", pa.array(at.astype(np.int32)))

    def inside(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep").slice(0, rows)
        made = centroids(units(table.column("v").combine_chunks()), each, p)
        return pa.table({"cell": pa.array([table.column("cell")[0].as_py()], pa.int32()), "centre": pa.array([made.tobytes()], pa.binary())})

    made = some.mapInArrow(nearest, "rep long, v binary, cell int").groupBy("cell").applyInArrow(inside, "cell int, centre binary")
    return {r.cell: np.frombuffer(bytes(r.centre), float).reshape(-1, top.shape[1]) for r in made.collect()}


def near_vectors(vectors: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Null labels, and vectors that are null, empty, zero or hold null or non-finite components, link with nothing, and so
    do rows without a vec_id. Vectors of different lengths are never compared.
    """
    base = usable(vectors).withColumn("group", F.concat_ws(":", F.octet_length("v").cast("string"), "label"))
    base = materialise(base, "vectors")
    classes = materialise(base.groupBy("group", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")), "classes")
    held = classes.sparkSession.sparkContext.broadcast(fitted(classes, p))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = np.array([len(x) for x in batch.column("v").to_pylist()], np.int64)
            for w in np.unique(width):
                own = batch.filter(pa.array(width == w))
                x, (top, inner) = units(own.column("v")), held.value[int(w)]
                lists: list[list[int]] = [[] for _ in range(len(x))]
                close = reached(x, top, p)
                for cell in np.flatnonzero(close.any(0)).tolist():
                    rows = np.flatnonzero(close[:, cell])
                    centre = inner.get(cell, top[cell : cell + 1])
                    for i, at in zip(rows.tolist(), reached(x[rows], centre, p), strict=True):
                        lists[i].extend(((cell << 20) + np.flatnonzero(at)).tolist())
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(lists, pa.list_(pa.int64()))], [*own.schema.names, "cells"])

    placed = materialise(classes.mapInArrow(assign, "group string, v binary, rep long, m long, cells array<long>"), "placed").withColumn("cell", F.explode("cells"))
    blocks = placed.groupBy("group", "cell").agg(F.ceil(F.count("*") / F.lit(p.block)).cast("int").alias("blocks"))
    dealt = placed.join(blocks, ["group", "cell"]).withColumn("own", F.pmod(F.xxhash64("rep", F.lit(p.seed)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).select("group", "cell", "lo", "hi", "own", "rep", "m", "cells", "v")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        cell, lo, hi = (table.column(c)[0].as_py() for c in ("cell", "lo", "hi"))
        own, rep, m = (table.column(c).to_numpy() for c in ("own", "rep", "m"))
        x = units(table.column("v").combine_chunks())
        left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        i, j = np.nonzero(x[left] @ x[right].T >= p.cosine)
        i, j = left[i], right[j]
        once = rep[i] < rep[j] if lo == hi else np.ones(len(i), bool)
        i, j = i[once], j[once]
        degree = np.zeros(len(x), np.int64)
        here = firsts(table.column("cells").combine_chunks(), i, j) == cell
        np.add.at(degree, i[here], m[j[here]])
        np.add.at(degree, j[here], m[i[here]])
        head = lowest(rep, i, j)
        keep = (degree > 0) | (head != rep)
        return pa.table({"rep": rep[keep], "head": head[keep], "degree": degree[keep]})

    found = materialise(dealt.groupBy("group", "cell", "lo", "hi").applyInArrow(compare, "rep long, head long, degree long"), "found")
    degrees = found.groupBy("rep").agg(F.sum("degree").alias("degree"))
    roots = components(found.where("rep <> head").select(F.col("rep").alias("a"), F.col("head").alias("b")))
    linked = classes.join(degrees, "rep", "left").join(roots.select(F.col("a").alias("rep"), F.col("b").alias("root")), "rep", "left")
    linked = linked.select("group", "v", (F.coalesce("degree", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    known = base.join(linked, ["group", "v"]).select("vec_id", "n_links", "component_id").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(known, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def firsts(lists: pa.Array, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each pair of rows the smallest cell that both are in."""
    cells, at = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    has = np.zeros((len(lists), len(cells)), bool)
    has[np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets))), at] = True
    step = max(1, (8 << 20) // max(1, len(cells)))
    parts = [cells[(has[i[k : k + step]] & has[j[k : k + step]]).argmax(1)] for k in range(0, len(i), step)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def lowest(rep: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each row the smallest ``rep`` that links i-j reach."""
    head = np.argsort(np.argsort(rep))  # ranks, so that the smallest is found among places
    by_rank = np.argsort(rep)
    i, j = head[i], head[j]
    root = np.arange(len(rep))
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return rep[by_rank[root[head]]]
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (root != root[root]).any():
            root = root[root]
