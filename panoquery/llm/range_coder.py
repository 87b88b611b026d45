"""A range coder for token ids, driven by adaptive mixing of order-0 to order-2 predictions, in numpy.

A block is independent: its model starts empty. Its ids are cut into lanes of equal length that share the block's model;
step t codes id t of every lane at once, then the model learns from all of them, so that encoder and decoder see the same
model at each step. Order 2 (hash of the two ids before) and order 1 (the id before) each predict one id, with a
confidence; order 0 is the adaptive frequency of every id. An id's probability is the weighted sum of the three: each
order's weight times what it gives that id. The weights are learned for each pair of confidences, from the share that each
order had in the probability of the ids that came (expectation maximisation, one step an id).

Intervals are kept as 64-bit ``low`` and ``range``; 32 bits go out when the range falls below 2**32 (a carryless coder: a
range that straddles the border is cut at it). Shares of a range have TOTAL_BITS bits and are held in 32.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, VERSION = b"PQTB", 3
HEADER = struct.Struct("<4sHIQIIII")  # magic, version, documents, ids, lanes, alphabet, crc of ids, bytes of the index
U = np.uint64
WEIGHT_BITS, LITERAL_BITS, HASH_BITS = 10, 20, 20
TOTAL_BITS = WEIGHT_BITS + LITERAL_BITS
LOW32, FULL32 = U(0xFFFFFFFF), U(1 << 32)
CONF = 4
ID = np.uint32
CONF_BITS = ID(2)


class Model:
    """Predictions of a block, learned step by step. Choices by lane are products with masks: branches on them miss."""

    def __init__(self, alphabet: int, inverse: bool):
        self.alphabet, self.inverse = alphabet, inverse
        self.table1, self.table2 = np.zeros(alphabet + 1, ID), np.zeros(1 << HASH_BITS, ID)  # id * CONF + confidence
        pair = np.arange(2 * CONF * CONF) // 2
        self.gate = np.ones((3, len(pair)))
        self.gate[2] = 4
        self.predicts = np.array([pair // CONF > 0, pair % CONF > 0])
        self.count = np.zeros(alphabet, np.int64)
        self.fresh: list[np.ndarray] = []
        self.waiting, self.seen = 0, 0
        self.refresh()
        self.weigh()

    def refresh(self) -> None:
        """Order-0 frequencies from the ids so far; each id has at least 1."""
        if self.fresh:
            self.count += np.bincount(np.concatenate(self.fresh), minlength=self.alphabet)
        self.fresh, self.waiting = [], 0
        room = (1 << LITERAL_BITS) - self.alphabet
        freq = 1 + (self.count * room // max(1, int(self.count.sum())))
        freq[int(self.count.argmax())] += (1 << LITERAL_BITS) - int(freq.sum())
        self.places = np.stack([np.cumsum(freq) - freq, freq], 1).astype(ID).view(U)[:, 0]  # an id's start and frequency lie together
        if self.inverse:
            self.at = np.repeat(np.arange(self.alphabet, dtype=np.uint16 if self.alphabet <= 1 << 16 else ID), freq)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and frequency of ids in order 0."""
        both = self.places.take(x).view(ID)
        return both[0::2], both[1::2]

    def weigh(self) -> None:
        """The orders' weights for each pair of confidences; 0 for an order without a prediction there."""
        share = self.gate[:2] / self.gate.sum(0)
        weight = (share * ((1 << WEIGHT_BITS) - 3) + 1).astype(ID) * self.predicts
        self.weight = (weight[0] << ID(WEIGHT_BITS)) + weight[1]

    def predict(self, before2: np.ndarray, before1: np.ndarray) -> None:
        """Sets the predictions p2 and p1, their confidences c2 and c1, ``base``, the place of their weights, and the weights.

        w2 and w1 are those of all 2**LITERAL_BITS parts of order 0, w0 is that of one part.
        """
        self.slot = ((before2 * ID(40503) + before1) * ID(2654435761) >> ID(32 - HASH_BITS)).astype(np.intp)
        self.prev = before1.astype(np.intp)
        self.v2, self.v1 = self.table2.take(self.slot), self.table1.take(self.prev)
        self.p2, self.p1, self.c2, self.c1 = self.v2 >> CONF_BITS, self.v1 >> CONF_BITS, self.v2 & ID(CONF - 1), self.v1 & ID(CONF - 1)
        self.same = self.p2 == self.p1
        self.base = ((((self.c2 << CONF_BITS) + self.c1) << ID(1)) + self.same).astype(np.intp)
        both = self.weight.take(self.base)
        w2, w1 = both >> ID(WEIGHT_BITS), both & ID((1 << WEIGHT_BITS) - 1)
        self.w2, self.w1, self.w0 = w2 << ID(LITERAL_BITS), w1 << ID(LITERAL_BITS), ID(1 << WEIGHT_BITS) - w2 - w1

    def interval(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of each id's share of 2**TOTAL_BITS; keeps what each order gives it, for ``learn``."""
        start, freq = self.place(x)
        self.hit2, self.hit1 = x == self.p2, x == self.p1
        self.m2, self.m1 = self.w2 * self.hit2, self.w1 * self.hit1
        self.size = self.w0 * freq + self.m2 + self.m1
        return self.w0 * start + self.w2 * (x > self.p2) + self.w1 * (x > self.p1), self.size

    def find(self, value: np.ndarray) -> np.ndarray:
        """The ids whose shares hold ``value``: those of order 0 with the two predictions' shares in between."""
        value = value.astype(ID, copy=False)
        (start2, freq2), (start1, freq1) = self.place(self.p2), self.place(self.p1)
        from2, from1 = self.w0 * start2 + self.w1 * (self.p2 > self.p1), self.w0 * start1 + self.w2 * (self.p1 > self.p2)
        in2 = value - from2 < self.w0 * freq2 + self.w2 + self.w1 * self.same  # below its start, the difference wraps and is large
        in1 = (value - from1 < self.w0 * freq1 + self.w1) & ~in2
        rest = (value - self.w2 * (value >= from2) - self.w1 * (value >= from1)) * ~(in2 | in1)
        return self.at.take((rest / self.w0).astype(np.intp)) * ~(in2 | in1) + self.p2 * in2 + self.p1 * in1

    def learn(self, ids: np.ndarray) -> None:
        new = (ids << CONF_BITS) + ID(1)
        for table, place, v, hit, c in ((self.table2, self.slot, self.v2, self.hit2, self.c2), (self.table1, self.prev, self.v1, self.hit1, self.c1)):
            moved = np.minimum(v + hit + hit - ID(1), v | ID(CONF - 1))  # one up or down, CONF - 1 at most
            table[place] = new + (moved - new) * (hit | (c > 1)).astype(ID)
        part2, part1 = self.m2 / self.size, self.m1 / self.size
        for k, part in enumerate((part2, part1, 1 - part2 - part1)):
            self.gate[k] += np.bincount(self.base, part, minlength=self.gate.shape[1])
        self.weigh()
        self.fresh.append(ids)
        self.waiting += len(ids)
        self.seen += len(ids)
        if self.waiting >= min(1 << 19, max(2048, self.seen // 2)):
            self.refresh()


def lanes_of(n: int) -> int:
    return int(min(16384, max(1, n // 512)))


def settle(low: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Lanes whose range is below 2**32, with straddling ranges cut at the border."""
    out = np.flatnonzero(span < FULL32)
    if len(out):
        a, s = low[out], span[out]
        cut = (a ^ (a + s - U(1))) > LOW32
        span[out] = np.where(cut, FULL32 - (a & LOW32), s)
    return out


def encode(ids: np.ndarray, alphabet: int) -> tuple[np.ndarray, np.ndarray]:
    """(words of each lane, all words lane by lane) of one block of ids."""
    n, lanes = len(ids), lanes_of(len(ids))
    steps = -(-n // lanes)
    table = np.zeros(steps * lanes, ID)
    table[:n] = ids
    table = np.ascontiguousarray(table.reshape(lanes, steps).T)
    model = Model(alphabet, False)
    low, span = np.zeros(lanes, U), np.full(lanes, U(0xFFFFFFFFFFFFFFFF))
    words, used = np.zeros((2 * steps + 2, lanes), np.uint32), np.zeros(lanes, np.int64)
    before2 = before1 = np.full(lanes, alphabet, ID)

    def put(start, freq):
        r = span >> U(TOTAL_BITS)
        np.add(low, r * start, out=low)
        np.multiply(r, freq, out=span)
        out = settle(low, span)
        if len(out):
            words[used[out], out] = low[out] >> U(32)
            used[out] += 1
            low[out] <<= U(32)
            span[out] <<= U(32)

    for t in range(steps):
        active = -(-(n - t) // steps)
        if active < lanes:  # only the last lanes are short
            done = slice(active, lanes)
            _flush(words, used, low, done)
            low, span, before2, before1, lanes = low[:active].copy(), span[:active].copy(), before2[:active], before1[:active], active
        x = table[t, :active]
        model.predict(before2, before1)
        put(*model.interval(x))
        model.learn(x)
        before2, before1 = before1, x
    _flush(words, used, low, slice(0, lanes))
    most = int(used.max())  # the rows behind it were never touched
    return used.astype(np.uint32), np.ascontiguousarray(words[:most].T)[np.arange(most) < used[:, None]]


def _flush(words: np.ndarray, used: np.ndarray, low: np.ndarray, which: slice) -> None:
    lane = np.arange(which.start, which.stop)
    for part in (low[which] >> U(32), low[which] & LOW32):
        words[used[lane], lane] = part
        used[lane] += 1


def decode(n: int, lanes: int, used: np.ndarray, words: np.ndarray, alphabet: int) -> np.ndarray:
    """The ids of one block."""
    steps = -(-n // lanes)
    table = np.zeros((steps, lanes), ID)
    model = Model(alphabet, True)
    ends = np.cumsum(used.astype(np.int64))
    at = ends - used
    words = np.append(words, np.zeros(2, np.uint32))
    low, span = np.zeros(lanes, U), np.full(lanes, U(0xFFFFFFFFFFFFFFFF))
    code = words[at].astype(U) << U(32) | words[at + 1]
    at = at + 2
    before2 = before1 = np.full(lanes, alphabet, ID)

    def take(r, start, freq):
        np.add(low, r * start, out=low)
        np.multiply(r, freq, out=span)
        out = settle(low, span)
        if len(out):
            code[out] = code[out] << U(32) | words[np.minimum(at[out], len(words) - 1)]
            at[out] += 1
            low[out] <<= U(32)
            span[out] <<= U(32)

    for t in range(steps):
        active = -(-(n - t) // steps)
        if active < lanes:
            low, span, code, at, before2, before1, lanes = low[:active].copy(), span[:active].copy(), code[:active].copy(), at[:active].copy(), before2[:active], before1[:active], active
        model.predict(before2, before1)
        r = span >> U(TOTAL_BITS)
        x = model.find(np.minimum((code - low) // r, U((1 << TOTAL_BITS) - 1)))
        take(r, *model.interval(x))
        model.learn(x)
        table[t, :active] = x
        before2, before1 = before1, x
    return table.T.reshape(-1)[:n]


def write_block(doc_ids: list, docs: list[np.ndarray], alphabet: int) -> bytes:
    """A block of whole documents: header, index (doc_ids, lengths, words of each lane), words, crc of all before."""
    ids = np.concatenate(docs).astype("<u4")
    used, words = encode(ids, alphabet)
    index = zlib.compress(np.array([x is not None for x in doc_ids], np.uint8).tobytes() + np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.array([len(x) for x in docs], "<u4").tobytes() + used.astype("<u4").tobytes())
    body = HEADER.pack(MAGIC, VERSION, len(docs), len(ids), len(used), alphabet, zlib.crc32(ids.tobytes()), len(index)) + index + words.astype("<u4").tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


def read_block(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc_ids, lengths, all ids) of a block; raises ValueError where a checksum fails."""
    if data[:4] != MAGIC or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("the block is damaged")
    _, version, n_docs, n, lanes, alphabet, crc, n_index = HEADER.unpack_from(data)
    if version != VERSION:
        raise ValueError(f"the block has version {version}, not {VERSION}")
    index = zlib.decompress(data[HEADER.size : HEADER.size + n_index])
    known = np.frombuffer(index, np.uint8, n_docs)
    doc_ids = [x if ok else None for x, ok in zip(np.frombuffer(index, "<i8", n_docs, n_docs).tolist(), known, strict=True)]
    lengths = np.frombuffer(index, "<u4", n_docs, 9 * n_docs).astype(np.int64)
    used = np.frombuffer(index, "<u4", lanes, 13 * n_docs)
    words = np.frombuffer(data[HEADER.size + n_index : -4], "<u4")
    ids = decode(n, lanes, used, words, alphabet).astype("<u4")
    if zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("the ids of a block are damaged")
    return doc_ids, lengths, ids
