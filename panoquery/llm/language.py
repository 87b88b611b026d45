"""Language identification: averaged hashed subword embeddings with a linear softmax, and calibrated rejection.

A text is the mean of the embeddings of its hashed byte 3- and 4-grams. Embeddings and softmax are trained by stochastic
gradient descent in numpy on a bounded sample of labelled rows: about ``Params.rows``, dealt evenly to the languages, so
that rare ones are learned too (of a label with more than ``Params.langs`` values the most frequent). Of each sampled text
all n-grams count. As the softmax is linear, embeddings are folded into one score per n-gram and language,
and a whole text is scored by gathering and summing. On a fifth of the sample a temperature is fitted, and the
confidence from which on accepted predictions are right ``Params.precision`` of the time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panoquery.llm.common import buffers, slices, small_batches

BITS = 16
UNKNOWN = "und"


@dataclass(frozen=True)
class Params:
    rows: int = 6000
    langs: int = 300
    dim: int = 16
    epochs: int = 6
    rate: float = 4.0
    batch: int = 32
    precision: float = 0.99
    seed: int = 7


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # (2**BITS, languages)
    bias: np.ndarray
    temperature: float
    accept: float


def byte_classes() -> np.ndarray:
    """A-Z lower-cased; ASCII signs, digits and spaces are one class."""
    out = np.arange(256, dtype=np.uint32)
    out[65:91] = out[97:123]
    other = [i for i in range(128) if not chr(i).isalpha()]
    out[other] = 32
    return out


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each byte the buckets of the 3- and 4-grams that begin there, and how many of them lie inside its text (0 to 2)."""
    n = len(data)
    x = np.zeros(n + 4, np.uint32)
    x[:n] = byte_classes()[data]
    three = x[:n] * np.uint32(65599 * 65599 % (1 << 32)) + x[1 : n + 1] * np.uint32(65599) + x[2 : n + 2]
    four = three * np.uint32(65599) + x[3 : n + 3] + np.uint32(1)
    out = [((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.uint16) for h in (three, four)]
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)
    return out, (left >= 3).astype(np.int8) + (left >= 4)


def sums(model_scores: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the summed scores of its n-grams, and their number."""
    docs, n_langs = len(offsets) - 1, model_scores.shape[1]
    total, count = np.zeros((docs, n_langs)), np.zeros(docs, np.int64)
    if len(data) < 3:
        return total, count
    with np.errstate(over="ignore"):
        buckets, inside = grams(data, offsets)
    full = np.flatnonzero(np.diff(offsets))
    begins = offsets[:-1][full]
    for k, h in enumerate(buckets):
        value = model_scores[h]
        value[inside <= k] = 0
        total[full] += np.add.reduceat(value, begins, axis=0, dtype=np.float64)
        count[full] += np.add.reduceat((inside > k).astype(np.int64), begins)
    return total, count


def trainable(df: DataFrame, doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) != 1


Counts = tuple[np.ndarray, np.ndarray]


def quotas(counts: dict[str, int], rows: int) -> dict[str, int]:
    """How many rows of each language to learn from: evenly, and what small ones lack goes to the others."""
    out, left = {}, rows
    for k, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(n, max(1, left // (len(counts) - k)))
        left -= out[lang]
    return out


def sampled(rows: DataFrame, p: Params) -> list[tuple[str, Counts]]:
    """(lang, distinct n-grams and their counts) of about p.rows rows, chosen by a hash of id and text."""
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(p.langs).collect()}
    if not counts:
        return []
    chance, spark = F.pmod(F.xxhash64("doc_id", "text", F.lit(p.seed)), F.lit(1 << 40)), rows.sparkSession
    wanted = [(lang, n, int(min(1.0, (1.5 * n + 20) / counts[lang]) * (1 << 40))) for lang, n in quotas(counts, p.rows).items()]
    some = rows.join(F.broadcast(spark.createDataFrame(wanted, "lang string, quota long, share long")), "lang").withColumn("chance", chance).where("chance < share")
    order = Window.partitionBy("lang").orderBy("chance", "doc_id")  # at most half more than a quota, but for copies of one row
    some = some.withColumn("k", F.row_number().over(order)).where("k <= quota").select("text", "lang")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            data, offsets = buffers(batch.column("text"))
            out = []
            if len(data):
                with np.errstate(over="ignore"):
                    buckets, inside = grams(data, offsets)
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                own = [h[a:b][inside[a:b] > k] for k, h in enumerate(buckets)] if b > a else [np.zeros(0, np.uint16)]
                ids, times = np.unique(np.concatenate(own), return_counts=True)
                out.append(np.concatenate([ids.astype("<u4"), times.astype("<u4")]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(out, pa.binary())], ["lang", "grams"])

    got = some.mapInArrow(features, "lang string, grams binary").toArrow()
    made = [(lang, np.frombuffer(bytes(x), "<u4").reshape(2, -1)) for lang, x in zip(got.column("lang").to_pylist(), got.column("grams").to_pylist(), strict=True) if x]
    return sorted(((lang, (x[0], x[1].astype(np.float32) / x[1].sum())) for lang, x in made), key=lambda r: (r[0], len(r[1][0]), r[1][0].tobytes(), r[1][1].tobytes()))


def means(table: np.ndarray, own: list[Counts]) -> np.ndarray:
    """For each text the mean row of ``table`` over its n-grams."""
    n = np.array([len(ids) for ids, _ in own])
    return np.add.reduceat(table[np.concatenate([ids for ids, _ in own])] * np.concatenate([w for _, w in own])[:, None], np.cumsum(n) - n, axis=0)


def train(sample: list[tuple[str, Counts]], p: Params) -> Model | None:
    langs = sorted({lang for lang, _ in sample})
    if not langs:
        return None
    rng = np.random.default_rng(p.seed)
    sample = [sample[i] for i in rng.permutation(len(sample))]
    label = np.array([langs.index(lang) for lang, _ in sample])
    held = max(1, len(sample) // 5) if len(sample) >= 10 else 0
    fit = np.arange(held, len(sample))
    emb = rng.normal(0, 0.1, (1 << BITS, p.dim)).astype(np.float32)
    w, bias = rng.normal(0, 0.1, (p.dim, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    for epoch in range(p.epochs):
        rate = p.rate * (1 - epoch / p.epochs)
        order = rng.permutation(fit)
        for k in range(0, len(order), p.batch):
            own = order[k : k + p.batch]
            counts = [sample[i][1] for i in own]
            mean = means(emb, counts)
            g = softmax(mean @ w + bias)
            g[np.arange(len(own)), label[own]] -= 1
            back = rate * (g @ w.T)
            g /= len(own)
            w -= rate * (mean.T @ g)
            bias -= rate * g.sum(0)
            for (ids, share), row in zip(counts, back, strict=True):  # the ids of one text are distinct
                emb[ids] -= share[:, None] * row
    scores = (emb @ w).astype(np.float32)
    check = np.arange(held) if held else fit
    logits = means(scores, [sample[i][1] for i in check]) + bias
    best = min((0.25 * 1.25**j for j in range(20)), key=lambda t: -np.log(softmax(logits / t)[np.arange(len(check)), label[check]] + 1e-12).mean())
    sure = softmax(logits / best)
    right, top = sure.argmax(1) == label[check], sure.max(1)
    order = np.argsort(-top, kind="stable")
    good = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= p.precision)
    return Model(langs, scores, bias, best, float(top[order][good[-1]]) if len(good) else 1.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(docs: DataFrame, p: Params = Params()) -> Model | None:
    """A model from the rows of ``docs`` (doc_id, text, lang) that may be learned from; None without such rows."""
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return train(sampled(rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & trainable(rows)), p), p)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, accepted: from whole texts alone.

    A null text and one without a letter are ``und`` with score 0 and not accepted; so is all without a model. Rows come
    back as they come, with repeated and null ids.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in slices(batches, "text", 2 << 20):
            letter = np.array([any(map(str.isalpha, t)) if t else False for t in batch.column("text").to_pylist()], bool)
            pred, score = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            if m is not None and batch.num_rows:
                total, count = sums(m.scores, *buffers(batch.column("text")))
                sure = softmax((total / np.maximum(count, 1)[:, None] + m.bias) / m.temperature)
                pred[letter] = np.array(m.langs, object)[sure.argmax(1)][letter]
                score[letter] = sure.max(1)[letter]
            accepted = letter & (score >= (m.accept if m is not None else 2))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score), pa.array(accepted)], ["doc_id", "lang_pred", "score", "accepted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, "doc_id long, lang_pred string, score double, accepted boolean")
