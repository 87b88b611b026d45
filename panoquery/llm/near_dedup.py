"""Near-duplicate documents by bottom-k sketches from one hash function.

A document's set of word shingles is hashed once; the ``k`` smallest values are its sketch (bottom-k, from the public
MinHash literature). Retained values go into inverted lists, keyed by short runs of values that follow each other in the
sketch. Lists generate overlaps in linear number: every member meets the smallest member of its list and its neighbours
in the order of the values that come next; these rounds only make groups large early. The sketch of the union
estimates the similarity of a pair; pairs that pass are confirmed on their full sets. At the end all members of a list that
are still in different groups are compared (``remaining``): few as pairs, many in blocks, on their full sets. Two members
that also share the value before the run share the list of the run before, and are left to that one.

Runs: when ``k`` covers both sets, a pair at the threshold always shares a run of the lengths that both emit
(pigeonhole). For larger sets ``run_length`` takes the longest run that such a pair misses with a chance of at most 1e-7.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panoquery.llm.common import buffers, components, free, materialise, mix, semi, slices, small_batches, trim, without

SKETCHES = "doc_id long, said long, n long, k1 long, k2 long, sketch binary"
_WORD = np.uint64(0x9E3779B97F4A7C15)
SLICE = 512 << 10  # bytes of text that a worker hashes at a time


@dataclass(frozen=True)
class Params:
    """Similarity of at least ``percent``/100 on shingles of ``words`` words; sketches of ``k`` values."""

    words: int = 5
    percent: int = 80
    k: int = 64
    margin: float = 0.25


def needed(union: int, percent: int) -> int:
    """Smallest intersection that links at this size of the union."""
    return -(-percent * union // 100)


def run_length(p: Params, miss: float = 1e-7) -> int:
    """Longest run of shared values that a pair at the threshold has among ``k`` values of its union but for a chance ``miss``."""
    hit = p.percent / 100
    for r in range(8, 1, -1):
        state = np.zeros(r + 1)
        state[0] = 1
        for _ in range(p.k):
            new = np.zeros(r + 1)
            new[0] = state[:r].sum() * (1 - hit)
            new[1:] = state[:r] * hit
            new[r] += state[r]
            state = new
        if 1 - state[r] <= miss:
            return r
    return 1


def run_lengths(p: Params) -> list[tuple[int, ...]]:
    """For a set of n <= k values, at n: the run lengths to emit; at 0: those of larger sets."""
    longest = run_length(p)
    safe = {}
    for u in range(1, 2 * p.k):
        inter = needed(u, p.percent)
        safe[u] = min(longest, -(-inter // (u - inter + 1))) if u <= p.k else longest
    out = [(longest,)]
    for n in range(1, p.k + 1):
        top = 100 * n // p.percent
        out.append(tuple(sorted({safe.get(u, longest) for u in range(n, top + 1) if needed(u, p.percent) < u})) or ())
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z lower-cased, split at 0x20 and 0x09-0x0D), and how many words each text has."""
    n_docs = len(offsets) - 1
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(n_docs, np.int64)
    table = mix(np.arange(1, 257, dtype=np.uint64) * _WORD) | np.uint64(1)
    table[65:91] = table[97:123]
    space = (data == 32) | ((data >= 9) & (data <= 13))
    inside = ~space
    begins = inside.copy()
    begins[1:] &= space[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), np.zeros(n_docs, np.int64)
    counts = np.diff(np.searchsorted(starts, offsets))
    word = np.cumsum(begins) - 1
    place = np.arange(len(data)) - starts[np.maximum(word, 0)]
    longest = int(place[inside].max()) + 1
    powers = np.full(longest, np.uint64(0x9E3779B185EBCA87), np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    value = table[data]
    value *= powers[np.minimum(place, longest - 1)]
    value[space] = 0
    return mix(np.add.reduceat(value, starts)), counts


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct 64-bit shingle hashes: runs of ``words`` words, or all words where there are fewer."""
    hashes, counts = word_hashes(*buffers(column))
    ends = np.cumsum(counts)
    with np.errstate(over="ignore"):
        rolled = {}
        for width in range(1, words + 1):
            n = max(0, len(hashes) - width + 1)
            total = np.full(n, np.uint64(width) * _WORD, np.uint64)
            for j in range(width):
                total = mix(total + hashes[j : j + n] * np.uint64(2 * j + 1))
            rolled[width] = total
    for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
        width = min(n, words)
        yield np.unique(rolled[width][end - n : end - width + 1]) if n else np.zeros(0, np.uint64)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u8")


def identity(values: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart, as two signed numbers."""
    with np.errstate(over="ignore"):
        both = (np.add.reduce(mix(values + _WORD), dtype=np.uint64), np.add.reduce(mix(values * _WORD + np.uint64(7)), dtype=np.uint64))
    return tuple(int(x.astype(np.int64)) for x in both)


def sketches(docs: DataFrame, p: Params) -> DataFrame:
    """One row per row of ``docs``: a hash of its text, size and identity of its shingle set, and the sketch."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            n, k1, k2, small = [], [], [], []
            for values in shingle_sets(batch.column("text"), p.words):
                n.append(len(values))
                one, two = identity(values)
                k1.append(one)
                k2.append(two)
                small.append(values[: p.k].astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("said"), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(small, pa.binary())],
                ["doc_id", "said", "n", "k1", "k2", "sketch"],
            )
        trim()

    return picked(docs).mapInArrow(rows, SKETCHES)


def picked(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), said(text).alias("said"), text.alias("text"))


def said(text: Column) -> Column:
    """A hash that tells rows with the same doc_id and other texts apart; null for a null text."""
    return F.when(text.isNotNull(), F.xxhash64(text))


def full_sets(docs: DataFrame, wanted: DataFrame, p: Params) -> DataFrame:
    """(rep, n, hashes): the full shingle sets of the classes ``wanted`` (doc_id, k1, k2, n, rep), made anew from their texts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            made = list(shingle_sets(batch.column("text"), p.words))
            keys = [identity(x) for x in made]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x for x, _ in keys], pa.int64()), pa.array([y for _, y in keys], pa.int64()), pa.array([x.astype("<u8").tobytes() for x in made], pa.binary())],
                ["doc_id", "k1", "k2", "hashes"],
            )
        trim()

    texts = semi(picked(docs).select("doc_id", "text"), wanted.select("doc_id").distinct(), "doc_id")
    own = texts.mapInArrow(rows, "doc_id long, k1 long, k2 long, hashes binary").join(wanted, ["doc_id", "k1", "k2"])
    return own.select("rep", "n", "hashes").dropDuplicates(["rep"])


def inverted(classes: DataFrame, p: Params, before: bool = False) -> DataFrame:
    """(key, nxt, rep, g): one row per run of retained values of ``classes`` (rep, n, sketch, g); ``nxt`` is the value after the run.

    With ``before``: (key, prev, first, rep, n, g), where ``prev`` is the value before the run and ``first`` says that there is none.
    """
    lengths = run_lengths(p)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 2048):
                yield table(whole.slice(low, 2048))
        trim()

    def table(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, beside, first, times = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, bool)], []
        with np.errstate(over="ignore"):
            for n, data in zip(batch.column("n").to_pylist(), batch.column("sketch").to_pylist(), strict=True):
                v, made = unpacked(data), 0
                for r in lengths[n if n <= p.k else 0]:
                    m = len(v) - r + 1
                    if m <= 0:
                        continue
                    total = np.full(m, np.uint64(r), np.uint64)
                    for j in range(r):
                        total = mix(total * _WORD + v[j : j + m])
                    keys.append(total)
                    beside.append(np.append(np.uint64(0), v[: m - 1]) if before else np.append(v[r:], np.uint64(0)))
                    first.append(np.arange(m) == 0)
                    made += m
                times.append(made)
        key, other = (pa.array(np.concatenate(x).view(np.int64)) for x in (keys, beside))
        rep, g, size = (pa.array(np.repeat(batch.column(c).to_numpy(), times)) for c in ("rep", "g", "n"))
        if before:
            return pa.RecordBatch.from_arrays([key, other, pa.array(np.concatenate(first)), rep, size, g], ["key", "prev", "first", "rep", "n", "g"])
        return pa.RecordBatch.from_arrays([key, other, rep, g], ["key", "nxt", "rep", "g"])

    return classes.select("rep", "n", "sketch", "g").mapInArrow(rows, "key long, prev long, first boolean, rep long, n long, g long" if before else "key long, nxt long, rep long, g long")


def overlaps(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b), a < b: pairs from inverted lists, at most three for each member; only between different groups ``g``.
    And (rep): the members of lists that may have more than one.

    ``members`` (key, nxt, rep, g) is dealt out by ranges of (key, nxt, rep), so that a list of any length spreads over tasks.
    Within a task a member meets its next neighbour, the smallest member that the task has of its list so far in the batch,
    and the neighbour in another group. Lists that go on in the next task hand one member each to a second, small pass.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None
        first_key = None
        edge = []
        for batch in batches:
            key, rep, g = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "rep", "g"))
            if len(key) == 0:
                continue
            if first_key is None:
                first_key = key[0]
                edge.append((key[0], rep[0], g[0]))
            more = np.append(key[1:] == key[:-1], True)
            more[1:] |= key[1:] == key[:-1]
            more[0] = True
            yield listed(np.unique(rep[more]))
            if carried is not None:
                key, rep, g = (np.concatenate([[x], y]) for x, y in zip(carried, (key, rep, g), strict=True))
            begins = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            sizes = np.diff(np.append(begins, len(key)))
            order = np.repeat(begins, sizes)
            best_g = np.repeat(np.minimum.reduceat(g, begins), sizes)
            # g is the smallest id of a group, so the list's smallest group is the group of a member; the member itself may be another
            where = np.flatnonzero(g == best_g)
            head = np.full(len(begins), -1)
            at = np.searchsorted(begins, where, "right") - 1
            head[at[::-1]] = where[::-1]
            same = key[1:] == key[:-1]
            changes = np.flatnonzero(np.append(False, g[1:] != g[:-1]))
            last = np.full(len(key), -1)
            last[changes] = changes - 1
            last = np.maximum.accumulate(last)
            ok = last >= order
            left = [rep[np.repeat(head, sizes)], rep[:-1][same], rep[last[ok]]]
            right = [rep, rep[1:][same], rep[ok]]
            apart = [g != best_g, (g[1:] != g[:-1])[same], g[last[ok]] != g[ok]]
            a, b, ok = np.concatenate(left), np.concatenate(right), np.concatenate(apart)
            a, b = a[ok], b[ok]
            found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b], axis=0) if len(a) else np.zeros((0, 2), np.int64)
            # the carried row keeps the list's smallest group in reach of the next batch
            tail = int(head[-1])
            carried = (key[-1], rep[tail], g[tail])
            edge_now = (key[-1], rep[-1], g[-1])
            yield out(found, [])
        if first_key is not None:
            edge.append(edge_now)
            edge.append(carried)
            yield out(np.zeros((0, 2), np.int64), edge)
        trim()

    names = ["key", "a", "b", "kind"]

    def out(found: np.ndarray, edge: list) -> pa.RecordBatch:
        n, m = len(found), len(edge)
        key = pa.array([None] * n + [e[0] for e in edge], pa.int64())
        a, b = (pa.array(np.append(found[:, i], [e[i + 1] for e in edge]).astype(np.int64)) for i in (0, 1))
        return pa.RecordBatch.from_arrays([key, a, b, pa.array(["pair"] * n + ["edge"] * m, pa.string())], names)

    def listed(rep: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(rep), pa.int64())
        return pa.RecordBatch.from_arrays([none, pa.array(rep), none, pa.array(["member"] * len(rep), pa.string())], names)

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.select("key", "nxt", "rep", "g").repartitionByRange(parts, "key", "nxt", "rep").sortWithinPartitions("key", "nxt", "rep")
    made = materialise(dealt.mapInArrow(pairs, "key long, a long, b long, kind string"), "overlaps")
    ends = made.where("kind = 'edge'").select("key", F.col("a").alias("rep"), F.col("b").alias("g")).distinct()
    heads = ends.groupBy("key").agg(F.min(F.struct("g", "rep")).alias("h"))
    spread = ends.join(heads, "key").where("g <> h.g").select(F.least("rep", "h.rep").alias("a"), F.greatest("rep", "h.rep").alias("b"))
    found = made.where("kind = 'pair'").select("a", "b").unionByName(spread).where("a <> b").distinct()
    return found, made.where("kind = 'member'").select(F.col("a").alias("rep")).distinct()


def _estimate(p: Params):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                both = np.concatenate([unpacked(x), unpacked(y)])
                union, times = np.unique(both, return_counts=True)
                keep.append(float((times[: p.k] == 2).mean()) >= p.percent / 100 - p.margin if len(union) else False)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        trim()

    return rows


def _exact(p: Params):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                x, y = unpacked(x), unpacked(y)
                inter = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * inter >= p.percent * (len(x) + len(y) - inter))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        trim()

    return rows


BLOCK, SHINGLES, FEW, MANY = 1024, 500_000, 32, 64


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of each key, sorted, in blocks of at most BLOCK rows and about SHINGLES shingles.

    Runs of MANY rows with the same value before and group have blocks of their own, so that blocks which need no
    comparison are seen as a whole. Lists of one group that a batch holds from end to end are left out.
    """
    from pyspark import TaskContext

    block, now, rows, held = TaskContext.get().partitionId() << 32, None, 0, 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        key, prev, g, n = (batch.column(c).to_numpy() for c in ("key", "prev", "g", "n"))
        begins = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(begins, len(key)))
        closed = np.minimum.reduceat(g, begins) == np.maximum.reduceat(g, begins)
        closed[[0, -1]] = False
        keep = np.repeat(~closed, sizes)
        changes = np.append(True, (key[1:] != key[:-1]) | (prev[1:] != prev[:-1]) | (g[1:] != g[:-1]))
        runs = np.diff(np.append(np.flatnonzero(changes), len(key)))
        long = np.repeat(runs >= MANY, runs)
        cuts = changes & (long | np.append(False, long[:-1]))
        out = []
        for one, cut, size in zip(key[keep].tolist(), cuts[keep].tolist(), n[keep].tolist(), strict=True):
            if one != now or cut or rows == BLOCK or held + size > SHINGLES:
                block, now, rows, held = block + 1, one, 0, 0
            rows, held = rows + 1, held + size
            out.append(block)
        yield batch.filter(pa.array(keep)).append_column("block", pa.array(out, pa.int64()))


def jobs(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[pa.Table]:
    """The rows in runs of equal ``columns``, whatever the batches."""
    open_rows: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            part = batch.slice(i, j - i)
            if open_rows and any(open_rows[0].column(c)[0].as_py() != part.column(c)[0].as_py() for c in columns):
                yield pa.Table.from_batches(open_rows)
                open_rows = []
            open_rows.append(part)
    if open_rows:
        yield pa.Table.from_batches(open_rows)


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of a block between different groups that share no list before."""
    for t in jobs(batches, "key", "block"):
        rep, g, prev, first = (t.column(c).to_numpy() for c in ("rep", "g", "prev", "first"))
        i, j = np.triu_indices(len(rep), 1)
        ok = (g[i] != g[j]) & ((prev[i] != prev[j]) | first[i] | first[j])
        a, b = rep[i][ok], rep[j][ok]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _compared(p: Params):
    """For each job, the host's members compared with the guests on full sets: the links that join groups."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in jobs(batches, "key", "host", "part"):
            rep, g, prev, first, block = (t.column(c).to_numpy() for c in ("rep", "g", "prev", "first", "block"))
            sets = [unpacked(x) for x in t.column("hashes").to_pylist()]
            n = np.array([len(x) for x in sets])
            ia = np.flatnonzero(block == t.column("host")[0].as_py())
            ib = np.flatnonzero(t.column("guest").to_numpy())
            if len(ia) == 0:
                continue
            _, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            where = np.cumsum(times > 1) - 1
            row, col = np.repeat(np.arange(len(sets)), n)[times[col] > 1], where[col[times[col] > 1]]
            order = np.argsort(col, kind="stable")
            row, col = row[order], col[order]
            inter = np.zeros((len(ia), len(ib)), np.float32)
            for low in range(0, int(col[-1]) + 1 if len(col) else 0, 1024):
                i, j = np.searchsorted(col, (low, low + 1024))
                has = np.zeros((len(sets), 1024), np.float32)
                has[row[i:j], col[i:j] - low] = 1
                inter += has[ia] @ has[ib].T
            inter = inter.astype(np.int64)
            ok = 100 * inter >= p.percent * (n[ia][:, None] + n[ib][None] - inter)
            ok &= g[ia][:, None] != g[ib][None]
            ok &= (prev[ia][:, None] != prev[ib][None]) | first[ia][:, None] | first[ib][None]
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while x in parent:
                    x = parent[x]
                return x

            a, b = [], []
            for x, y in zip(*np.nonzero(ok), strict=True):
                u, v = root(int(g[ia[x]])), root(int(g[ib[y]]))
                if u != v:
                    parent[max(u, v)] = min(u, v)
                    a.append(min(rep[ia[x]], rep[ib[y]]))
                    b.append(max(rep[ia[x]], rep[ib[y]]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        trim()

    return rows


def remaining(classes: DataFrame, sets: DataFrame, tried: DataFrame, p: Params) -> DataFrame:
    """Links (a, b) between members of one list that are in different groups: all that the rounds left. ``classes``: (rep, n, sketch, g)."""
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = inverted(classes, p, before=True)
    dealt = rows.repartitionByRange(parts, "key", "prev", "g", "rep").sortWithinPartitions("key", "prev", "g", "rep")
    members = materialise(dealt.mapInArrow(_blocks, "key long, prev long, first boolean, rep long, n long, g long, block long"), "blocks")
    # min and max say whether one value before the run, or one group, holds for a whole block
    about = [f(c).alias(c + k) for c in ("prev", "g", "n") for k, f in (("0", F.min), ("1", F.max))]
    blocks = materialise(members.groupBy("key", "block").agg(F.count("*").alias("size"), F.max("first").alias("first"), *about), "sizes", few=True)
    few = members.join(blocks.where(F.col("size").between(2, FEW) & (F.col("g0") < F.col("g1"))).select("key", "block"), ["key", "block"], "left_semi")
    few = few.repartition(parts, "key", "block").sortWithinPartitions("key", "block").mapInArrow(_few, "a long, b long").distinct()
    few = confirmed(materialise(few.join(tried, ["a", "b"], "left_anti"), "few", few=True), classes, sets, p)
    work = materialise(jobs_of(blocks, p), "jobs", few=True)
    if work.isEmpty():
        return few
    # the host's members that may be as large as a guest, and all guests
    host = work.select("key", F.col("host").alias("block"), "host", "part", "low", "high", F.col("self").alias("guest"))
    host = host.join(members, ["key", "block"]).where("guest or n between low and high").drop("low", "high")
    guests = work.select("key", F.explode("guests").alias("block"), "host", "part").where("block <> host").join(members, ["key", "block"])
    sent = host.unionByName(guests.withColumn("guest", F.lit(True)), allowMissingColumns=True).drop("n").join(sets.select("rep", "hashes"), "rep")
    sent = sent.repartition(parts, "key", "host", "part").sortWithinPartitions("key", "host", "part")
    return few.unionByName(materialise(sent.mapInArrow(_compared(p), "a long, b long").distinct(), "compared", few=True))


def jobs_of(blocks: DataFrame, p: Params) -> DataFrame:
    """(key, host, part, guests, self, low, high): for each block the smaller ones to compare it with, BLOCK rows of them at a time.

    Left out are pairs of blocks of one group, those that share a list before, and those of too different sizes.
    """
    x, y = blocks.alias("x"), blocks.alias("y")
    one = lambda c: (F.col(f"x.{c}0") == F.col(f"x.{c}1")) & (F.col(f"y.{c}0") == F.col(f"y.{c}1")) & (F.col(f"x.{c}0") == F.col(f"y.{c}0"))
    order = lambda s: F.struct(f"{s}.size", f"{s}.block")
    work = x.join(y, (F.col("x.key") == F.col("y.key")) & (order("x") >= order("y")))
    work = work.where((F.col("x.block") != F.col("y.block")) | (F.col("x.size") > FEW)).where(~one("g") & (~one("prev") | F.col("x.first") | F.col("y.first")))
    work = work.where((F.col("x.n1") * 100 >= F.col("y.n0") * p.percent) & (F.col("y.n1") * 100 >= F.col("x.n0") * p.percent))
    work = work.select("x.key", F.col("x.block").alias("host"), F.col("y.block").alias("guest"), F.col("y.size").alias("size"), F.col("y.n0").alias("n0"), F.col("y.n1").alias("n1"))
    before = F.sum("size").over(Window.partitionBy("key", "host").orderBy("guest").rowsBetween(Window.unboundedPreceding, 0))
    work = work.withColumn("part", F.floor((before - 1) / BLOCK))
    return work.groupBy("key", "host", "part").agg(
        F.collect_list("guest").alias("guests"),
        F.max(F.col("guest") == F.col("host")).alias("self"),
        F.floor(F.min("n0") * p.percent / 100).alias("low"),
        F.ceil(F.max("n1") * 100 / p.percent).alias("high"),
    )


def confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """Those of ``pairs`` (a, b) whose classes are similar enough: sizes, then union sketches, then full sets."""

    def attached(which: DataFrame, of: DataFrame, column: str) -> DataFrame:
        ids = which.select(F.col("a").alias("rep")).union(which.select("b")).distinct()
        own = semi(of.select("rep", "n", F.col(column).alias("s")), ids, "rep")
        out = which.join(own.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa")), "a")
        out = out.join(own.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb")), "b")
        return out.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * p.percent).select("a", "b", "sa", "sb")

    likely = materialise(attached(pairs, classes, "sketch").mapInArrow(_estimate(p), "a long, b long"), "likely", few=True)
    return materialise(attached(likely, sets, "hashes").mapInArrow(_exact(p), "a long, b long"), "links", few=True)


def near_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, said, n_shingles, class_id, component_id, group_id, kept.

    Cheap rounds link what they can, as long as a round adds a quarter to the links; the comparison of what remains
    completes them. ``class_id`` is the smallest document with the same shingle set; classes are linked, copies are not
    expanded. A null or empty text, and one without words, has the empty set: n_shingles 0, linked with nothing. A null
    doc_id is linked with nothing and comes back with null component and kept true. Repeated rows come back as often as
    they come; rows with one doc_id and other texts are each linked by their own text (``said`` is the text's hash), so two
    groups may have one component_id then: ``group_id`` tells them apart.
    """
    small_batches(docs.sparkSession)
    held = materialise(sketches(docs, p), "sketches")
    some = held.where("n > 0 and doc_id is not null")
    classes = some.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch"))
    # a class is known by its smallest document, or by a number of its own where one document has several texts
    classes = materialise(classes.withColumn("rep", F.monotonically_increasing_id() if _repeats(classes) else F.col("doc_id")), "classes")
    pairs, several = overlaps(materialise(inverted(classes.withColumn("g", F.col("rep")), p), "lists"))
    close = materialise(semi(classes, materialise(several, "several", few=True), "rep"), "close")
    sets = materialise(full_sets(docs, close.select("doc_id", "k1", "k2", "n", "rep"), p), "sets")
    links, found, tried = None, None, None
    members = close.withColumn("g", F.col("rep"))
    while True:
        pairs = materialise(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs", few=True)
        new = confirmed(pairs, close, sets, p)
        tried = pairs if tried is None else tried.unionByName(pairs)
        more, before = new.count(), links.count() if links is not None else 0
        links = new if links is None else links.unionByName(new)
        if 4 * more <= before:
            break
        found = components(links)
        members = close.join(found.select(F.col("a").alias("rep"), F.col("b").alias("root")), "rep", "left").select("rep", "n", "sketch", F.coalesce("root", "rep").alias("g"))
        pairs, _ = overlaps(materialise(inverted(members, p), "lists"))
    rest = remaining(members, sets, tried, p)
    if found is None or more or not rest.isEmpty():
        found = components(links.unionByName(rest))
    joined = classes.join(found.select(F.col("a").alias("rep"), F.col("b").alias("root")), "rep", "left").select("k1", "k2", "n", F.col("doc_id").alias("class_id"), F.coalesce("root", "rep").alias("root"))
    lowest = joined.groupBy("root").agg(F.min("class_id").alias("component"))
    told = materialise(joined.join(lowest, "root").select("k1", "k2", "n", "class_id", "component", "root"), "components", few=True)
    out = held.select("doc_id", "said", "n", "k1", "k2").join(told, ["k1", "k2", "n"], "left")
    known = lambda c: F.when(F.col("doc_id").isNotNull(), F.coalesce(c, "doc_id")).alias
    out = out.select("doc_id", "said", F.col("n").alias("n_shingles"), known("class_id")("class_id"), known("component")("component_id"), F.when(F.col("doc_id").isNotNull(), F.col("root")).alias("group_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def representatives(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """One row of each group of near-duplicate rows of ``docs``, with its columns; all rows without an id or a shingle.

    The row is one of the smallest doc_id; where that id has several rows in the group, one of the smallest hash of the text.
    """
    found = materialise(near_duplicates(docs, p).where("group_id is not null"), "found")
    chosen = found.where("kept").groupBy("group_id").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "said")).alias("one"))
    again = materialise(chosen.where("n > 1").select("group_id", "one.doc_id", "one.said"), "again", few=True)
    gone = found.where("not kept").select("doc_id", "said")
    if not again.isEmpty():
        gone = gone.union(found.join(again.select("group_id"), "group_id", "left_semi").select("doc_id", "said"))
    key = free(docs, "_doc", "_said")
    rows = docs.withColumns(dict(zip(key, (F.col("doc_id").cast("long"), said(F.col("text").cast("string"))), strict=True)))
    out = without(rows, materialise(gone.distinct().toDF(*key), "copies", few=True), key)
    if not again.isEmpty():
        out = out.unionByName(semi(rows, again.select("doc_id", "said").toDF(*key), key).dropDuplicates(key))
    return out.select(*docs.columns)


def _repeats(classes: DataFrame) -> bool:
    return not classes.groupBy("doc_id").count().where("count > 1").isEmpty()
