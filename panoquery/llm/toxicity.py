"""Toxicity: gradient-boosted trees over dense features of whole texts, with isotonic calibration.

Features: density of a lexicon (a short fixed list and words learned from labelled rows), how near its words stand to a
second-person word, rates of capitals, of punctuation and of obfuscated words. Learned from a bounded sample of labelled
rows (``Params.rows``): one part for the lexicon, one for the trees, one for the calibration.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panoquery.llm.common import free, materialise, small_batches, trim

# Common insults of a few languages, second-person words, and signs that stand for letters.
INSULTS = frozenset("idiot moron scum loser trash worthless disgusting stupid pathetic clown dumb fool imbecile garbage vermin idiota estúpido imbécil basura dummkopf trottel abschaum crétin abruti ordure".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros".split())
SIGNS = str.maketrans("013457@$!|", "oieastasil")
WORD = re.compile(r"\w+")
HIDDEN = re.compile(r"\b[^\W\d_]+[0-9@$!|*]+[^\W\d_]+\b")
SPACED = re.compile(r"(?:\b[^\W\d_][ .\-_*]){3,}[^\W\d_]\b")
PUNCTUATION = re.compile(r"[^\w\s]")
SHOUTS = re.compile(r"[!?]")
CAPITAL_WORD = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b")
FEATURES = 13
STEM = 4  # learned words count by their first letters, so that endings don't hide them


@dataclass(frozen=True)
class Params:
    rows: int = 15_000
    trees: int = 80
    depth: int = 3
    rate: float = 0.15
    bins: int = 32
    near: int = 5
    lexicon: int = 400
    seed: int = 11


@dataclass
class Model:
    learned: frozenset = frozenset()
    trees: list = field(default_factory=list)  # (feature, cut, value) arrays of full binary trees
    base: float = -4.0
    knots: tuple = ((0.0, 1.0), (0.0, 1.0))
    near: int = 5


def features(text: str | None, learned: frozenset, near: int) -> list[float]:
    """The dense features of a whole text; an empty one has zeros."""
    if not text:
        return [0.0] * FEATURES
    words = WORD.findall(text.lower())
    n = max(1, len(words))
    hits = [i for i, w in enumerate(words) if w in INSULTS]
    own = sum(w[:STEM] in learned for w in words) if learned else 0
    you = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    close = 0
    if hits and you:
        at, spots = np.searchsorted(you, hits), np.array(you)
        close = int(sum(min(abs(spots[max(0, k - 1)] - h), abs(spots[min(k, len(you) - 1)] - h)) <= near for k, h in zip(at, hits, strict=True)))
    hidden = [x.lower() for x in HIDDEN.findall(text)]
    spaced = [re.sub(r"[^\w]|_", "", x).lower() for x in SPACED.findall(text)]
    plain = [x.replace("*", "").translate(SIGNS) for x in hidden] + spaced
    veiled = sum(x in INSULTS or x[:STEM] in learned for x in plain)
    marks = len(PUNCTUATION.findall(text))
    shouts = len(SHOUTS.findall(text))
    caps = len(CAPITAL_WORD.findall(text))
    size = len(text)
    return [100 * len(hits) / n, min(len(hits), 20), len(set(words[i] for i in hits)), 100 * own / n, min(own, 20), close / max(1, len(hits)), 100 * len(you) / n, caps / n, marks / size, shouts / size, 100 * (len(hidden) + len(spaced)) / n, min(veiled, 20), np.log1p(len(words))]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], binned: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree on gradients ``g`` and second derivatives ``h``: features, cuts and leaf values in heap order."""
    size = (1 << (p.depth + 1)) - 1
    feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
    at = np.zeros(len(x), np.int64)
    for node in range(size):
        own = np.flatnonzero(at == node)
        if len(own) == 0:
            continue
        value[node] = -g[own].sum() / (h[own].sum() + 1)
        if node >= size // 2 or len(own) < 20:
            continue
        best = 1e-6
        for j in range(x.shape[1]):
            if len(cuts[j]) == 0:
                continue
            b = binned[own, j]
            gs, hs, ns = (np.cumsum(np.bincount(b, v, len(cuts[j]) + 1))[:-1] for v in (g[own], h[own], np.ones(len(own))))
            ga, ha = g[own].sum(), h[own].sum()
            gain = gs**2 / (hs + 1) + (ga - gs) ** 2 / (ha - hs + 1) - ga**2 / (ha + 1)
            gain[(ns < 5) | (ns > len(own) - 5)] = 0
            k = int(gain.argmax())
            if gain[k] > best:
                best, feature[node], cut[node] = gain[k], j, cuts[j][k]
        if feature[node] >= 0:
            at[own] = np.where(x[own, feature[node]] <= cut[node], 2 * node + 1, 2 * node + 2)
    return feature, cut, value


def margin(model: Model, x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), model.base)
    for feature, cut, value in model.trees:
        at = np.zeros(len(x), np.int64)
        for _ in range(int(np.log2(len(feature) + 1))):
            f = feature[at]
            inner = f >= 0
            at = np.where(inner, np.where(x[np.arange(len(x)), np.maximum(f, 0)] <= cut[at], 2 * at + 1, 2 * at + 2), at)
        out += value[at]
    return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[tuple, tuple]:
    """Knots of the isotonic fit of y on x by pooling adjacent violators."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b in zip(x[order], y[order], strict=True):
        pools.append([float(b), 1.0, float(a), float(a)])
        while len(pools) > 1 and (pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1] or pools[-2][3] == pools[-1][2]):
            s, n, _, hi = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2], hi]
    xs, ys = [0.0], [0.0]
    for s, n, lo, hi in pools:
        for at in dict.fromkeys((lo, hi)):
            xs.append(at)
            ys.append(s / n)
    return tuple(xs + [1.0]), tuple(ys + [max(ys[-1], 1.0)])


def trainable(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the rows that may be learned from; repeated ids count once, as toxic if any row says so."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    rows = rows.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0)
    return rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    """A model from at most ``p.rows`` labelled rows, chosen by a hash of the id. Without rows of both labels: low scores."""
    known = trainable(labels)
    total = known.count()
    share = int(min(1.0, 1.2 * p.rows / max(1, total)) * (1 << 20))
    some = materialise(known.where(F.pmod(F.xxhash64("doc_id", F.lit(p.seed)), F.lit(1 << 20)) < share).limit(p.rows), "labels", few=True)
    # at most p.rows rows by construction, so this side can be broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id")
    texts = materialise(texts.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(p.seed + 1)), F.lit(10))), "labelled")
    stems = F.array_distinct(F.transform(F.regexp_extract_all(F.lower("text"), F.lit(rf"[\p{{L}}\p{{N}}_]{{{STEM},}}"), F.lit(0)), lambda w: F.substring(w, 1, STEM)))
    words = texts.where("part < 4").select("toxic", F.explode(stems).alias("w"))
    counts = words.groupBy("w").agg(F.sum("toxic").alias("a"), F.count("*").alias("n"))
    rate = texts.where("part < 4").agg(F.avg("toxic")).first()[0] or 0.0
    odds = counts.where((F.col("a") >= 5) & (F.col("a") / (F.col("n") + 1) >= min(0.9, max(0.3, 3 * rate))))
    learned = frozenset(r.w for r in odds.orderBy(F.desc("a"), "w").limit(p.lexicon).collect())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t, learned, p.near) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("toxic"), batch.column("part")], ["x", "toxic", "part"])

    got = texts.where("part >= 4").select("text", "toxic", "part").mapInArrow(rows, "x array<double>, toxic int, part long").toArrow()
    x, y, part = np.array(got.column("x").to_pylist(), float).reshape(-1, FEATURES), np.array(got.column("toxic").to_pylist(), float), np.array(got.column("part").to_pylist())
    model = Model(learned=learned, near=p.near)
    a, b = part < 8, part >= 8
    if y[a].sum() == 0 or y[a].sum() == a.sum() or not b.any():
        return model
    order = np.lexsort(x[a].T)  # the same trees whatever order the rows came in
    xa, ya = x[a][order], y[a][order]
    model.base = float(np.log(ya.mean() / (1 - ya.mean())))
    cuts = [np.unique(np.quantile(np.unique(xa[:, j]), np.linspace(0, 1, p.bins + 1)[:-1])) for j in range(FEATURES)]
    binned = np.stack([np.searchsorted(cuts[j], xa[:, j]) for j in range(FEATURES)], 1)
    f = np.full(len(xa), model.base)
    for _ in range(p.trees):
        q = sigmoid(f)
        feature, cut, value = grow(xa, q - ya, q * (1 - q), cuts, binned, p)
        model.trees.append((feature, cut, p.rate * value))
        f += margin(Model(trees=model.trees[-1:], base=0.0), xa)
    model.knots = isotonic(sigmoid(margin(model, x[b])), y[b])
    return model


def score(docs: DataFrame, model: Model, column: str | None = None) -> DataFrame:
    """The columns of ``docs`` and the score, 0 to 1, from the whole text alone; null and empty texts get that of no features.

    The score's column is ``column``; by default ``toxicity``, with "_" added while ``docs`` has such a column.
    """
    column = column or free(docs, "toxicity")[0]
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def rows(column: pa.Array) -> pa.Array:
        m = held.value
        x = np.array([features(t, m.learned, m.near) for t in column.to_pylist()], float).reshape(-1, FEATURES)
        trim()
        return pa.array(np.clip(np.interp(sigmoid(margin(m, x)), *m.knots), 0, 1))

    scored = F.arrow_udf(rows, "double")
    return docs.withColumn(column, scored(F.col("text").cast("string")))
