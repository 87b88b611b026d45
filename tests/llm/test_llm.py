"""Each operator against brute force, exact round trips or held-out accuracy, and on odd tables."""

import hashlib
import re
import zlib

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panoquery.llm import chat, decontaminate, embedding_dedup, language, line_dedup, near_dedup, packing, pii, queries, range_coder, token_files, toxicity
from panoquery.llm.tokens import Encoder, byte_bpe

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, spans string, hash string, lines_removed long, tag int"
LONG = "wordy text of many words. " * 3000
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "Same words stand here for all of us to read twice."), (6, "Same words stand here for all of us to read twice."), (6, "Same words stand here for all of us to read twice."), (None, "no id at all"), (7, "é😀 日本 a@b.co"), (8, "12345"), (9, "a <|endoftext|> b")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", "y", "z", 9, 1) for i, t in ODD], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_twin(spark, sf, name):
    assert oracle.rows(queries.QUERIES[name](spark, sf)) == oracle.twin(queries.ORACLE_SQL[name], sf)


def texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def sets(docs, words):
    out = {}
    for i, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()
    return out


def groups(pairs, ids):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("words, percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, sf, words, percent):
    docs = texts(spark, sf)
    rng = np.random.default_rng(0)
    base = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
    for k in range(120):  # short near copies at every similarity
        own = list(base[: rng.integers(3, 26)])
        own[rng.integers(0, len(own))] = f"x{rng.integers(0, 3)}"
        docs[100_000 + k] = " ".join(own)
    s = sets(docs, words)
    ids = sorted(s)
    linked = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b])]
    want = groups(linked, ids)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in near_dedup.near_duplicates(df, near_dedup.Params(words, percent)).collect()}
    assert {i: (len(s[i]), want[i], want[i] == i) for i in ids} == {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()}


@pytest.mark.parametrize("words, percent, changes", [(3, 85, 5), (5, 80, 4)])
def test_near_duplicates_star(spark, words, percent, changes):
    rng = np.random.default_rng(4)
    hub = [f"h{k}" for k in range(200)]
    docs = {1000: " ".join(hub)}
    for k in range(400):  # each similar enough to the hub only
        own = list(hub)
        for at in rng.choice(200, changes, replace=False):
            own[at] = f"c{k}x{at}"
        docs[k if k < 200 else 1000 + k] = " ".join(own)
    s = sets(docs, words)
    ids = sorted(s)
    linked = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b])]
    got = near_dedup.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), near_dedup.Params(words, percent))
    assert {r.doc_id: r.component_id for r in got.collect()} == groups(linked, ids) and len(linked) >= 300


def test_near_duplicates_fuzzy(spark):
    """A group of near copies whose links run through chains: each has three words of a base replaced from a small set."""
    rng = np.random.default_rng(9)
    base = [f"b{k}" for k in range(90)]
    docs = {}
    for k in range(1200):
        own = list(base)
        for at in rng.choice(90, 3, replace=False):
            own[at] = f"x{rng.integers(0, 20)}"
        docs[k] = " ".join(own)
    s = sets(docs, 3)
    ids = sorted(s)
    linked = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b])]
    got = near_dedup.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), near_dedup.Params(3, 85))
    assert {r.doc_id: r.component_id for r in got.collect()} == groups(linked, ids) and len(linked) > 30


def test_near_duplicates_rows(spark):
    """Rows that repeat an id: each is linked by its own text, and one row of each group stays."""
    text = lambda c, n=30: " ".join(f"{c}{k}" for k in range(n))
    rows = [(1, text("a")), (2, text("a")), (2, text("b")), (3, text("b") + " end"), (4, text("c")), (4, text("c")), (5, text("d")), (5, text("d") + " end"), (5, text("e")), (None, text("a")), (None, text("a")), (6, ""), (6, "")]
    df = spark.createDataFrame([(i, t, 7, 8) for i, t in rows], "doc_id long, text string, group_id int, _said int")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, True), (2, 1, False), (2, 2, True), (3, 2, False), (4, 4, True), (4, 4, True), (5, 5, True), (5, 5, True), (5, 5, True), (None, None, True), (None, None, True), (6, 6, True), (6, 6, True)], key=str)
    left = near_dedup.representatives(df)
    assert left.columns == df.columns
    kept = sorted(((r.doc_id, r.text[:1]) for r in left.collect()), key=str)
    assert kept == sorted([(1, "a"), (2, "b"), (4, "c"), (5, "d"), (5, "e"), (None, "a"), (None, "a"), (6, ""), (6, "")], key=str)


def test_near_duplicates_odd(odd, none):
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(odd, near_dedup.Params(3, 85)).collect())
    assert len(got) == len(ODD) and got.count((6, 9, 5, False)) == 2 and (1, 0, 1, True) in got and (0, 2, None, True) in got
    assert near_dedup.near_duplicates(none).count() == 0


def test_range_coder():
    rng = np.random.default_rng(0)
    for n, top in ((1, 1), (2, 50257), (777, 3), (5000, 50257), (60_000, 200)):
        ids = rng.integers(0, top, n)
        ids[n // 2 :] = ids[: n - n // 2]
        docs = [ids[: n // 3], ids[n // 3 :]]
        block = range_coder.write_block([5, None], docs, 50257)
        doc_ids, lengths, back = range_coder.read_block(block)
        assert doc_ids == [5, None] and lengths.tolist() == [n // 3, n - n // 3] and np.array_equal(back, ids)
        if n > 500:
            broken = bytearray(block)
            broken[len(broken) // 2] ^= 1
            with pytest.raises(ValueError, match="damaged"):
                range_coder.read_block(bytes(broken))
    assert len(range_coder.write_block([1], [np.tile(np.arange(50), 2000)], 50257)) < 100_000  # of 400,000 bytes


def test_range_coder_mixes():
    """Every id has a share, the shares fill the whole, each is the weighted sum, and ``find`` is the inverse of ``interval``."""
    model = range_coder.Model(50, True)
    rng = np.random.default_rng(1)
    before2 = before1 = np.full(40, 50, range_coder.ID)
    for _ in range(60):
        ids = rng.integers(0, 12, 40).astype(range_coder.ID)
        model.predict(before2, before1)
        ends = []
        for x in range(50):
            start, size = model.interval(np.full(40, x, range_coder.ID))
            assert (size > 0).all() and (not ends or (start == ends[-1]).all())
            for value in (start, start + size - range_coder.U(1)):
                assert (model.find(value) == x).all()
            ends.append(start + size)
        assert (ends[-1] == 1 << range_coder.TOTAL_BITS).all()
        model.interval(ids)
        model.learn(ids)
        before2, before1 = before1, ids


def test_range_coder_narrow():
    """Shares are held in 32 bits, up to the widest, which halves what a step moves; the blocks are those of 64-bit shares."""
    model = range_coder.Model(50257, True)
    before = np.full(3, 50257, range_coder.ID)
    model.predict(before, before)
    ids = np.array([0, 7, 50256], range_coder.ID)
    start, size = model.interval(ids)
    assert start.dtype == size.dtype == model.find(start).dtype == np.uint32
    assert int(start[-1]) + int(size[-1]) == 1 << range_coder.TOTAL_BITS and (model.find(start + size - range_coder.ID(1)) == ids).all()
    n = np.arange(20_000, dtype=np.uint64)
    assert zlib.crc32(range_coder.encode(((n * n + n // np.uint64(7)) % np.uint64(50257)).astype("<u4"), 50257)[1].astype("<u4").tobytes()) == 986951515


def test_bits_an_id(spark):
    """Clearly fewer bits an id than the entropy of order 0, which knows all frequencies beforehand."""
    got = np.concatenate(list(ids_of({r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}).values()))
    share = np.bincount(got)[np.unique(got)] / len(got)
    entropy = -(share * np.log2(share)).sum()
    assert len(range_coder.write_block([1], [got], 50257)) * 8 / len(got) < 0.98 * entropy


def ids_of(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(byte_bpe())
    return {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for i, x in docs.items()}


def test_encoder():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(byte_bpe())
    cases = ["", "a  b\n\n c's  ", "日本 語", "a\x85b\xa0c", " ", "\n\n\n \n", "I'll they've 's 3²4 ½ ×÷ ǀ ª\t\tx", "x" * 5000, LONG, "a <|endoftext|> b", "<|endoftext|>", "日<|endoftext|><|endoftext|>1"]
    want = [[*t.encode(x, add_special_tokens=False).ids, 0] for x in cases]
    for most in (400_000, 3):
        encoder = Encoder(byte_bpe())
        encoder.known.most = most
        assert [x.tolist() for x in encoder.encode(cases)] == want and len(encoder.known) <= most
    every = [f"a{chr(c)} {chr(c)}{chr(c)}1" for c in range(0x250)]  # each sign that the fast way takes, and controls that it doesn't
    assert [x.tolist() for x in Encoder(byte_bpe()).encode(every)] == [[*t.encode(x, add_special_tokens=False).ids, 0] for x in every]


def test_token_files(spark, sf, odd, none, tmp_path):
    docs = texts(spark, sf)
    want, at = {}, 0
    for i, ids in sorted(ids_of(docs).items()):
        want[i] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op2_token_output(spark, sf).collect()} == want
    token_files.write(odd, f"file://{tmp_path}/odd", block_tokens=1000)
    got = sorted(token_files.read(spark, f"file://{tmp_path}/odd").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 4, 5, 6, 6, 7, 8, 9] and [r.start for r in got] == np.cumsum([0] + [len(r.ids) // 4 for r in got])[:-1].tolist()
    assert bytes(got[-1].ids) == ids_of({9: ODD[-1][1]})[9].tobytes()
    token_files.write(none, f"file://{tmp_path}/none")
    assert token_files.read(spark, f"file://{tmp_path}/none").count() == 0


def test_packing(spark, sf, odd, none):
    ids = ids_of(texts(spark, sf))
    rows = queries.op5_packing(spark, sf).collect()
    assert all(zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id]) for r in rows)
    assert sorted((r.doc_id, r.start + k) for r in rows for k in range(r.length)) == sorted((i, k) for i, x in ids.items() for k in range(len(x)))
    held = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert r.offset == held.get(r.sequence_id, 0)
        held[r.sequence_id] = r.offset + r.length
    assert all(n <= 1024 and (n == 1024 or n & (n - 1) == 0) for n in held.values())
    assert len({(r.doc_id, r.doc_tokens) for r in packing.pack(odd).collect()}) == 10 and packing.pack(none).count() == 0


def test_language(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op4_language(spark, sf).collect()}
    held = [(r.lang, got[r.doc_id].lang_pred) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and r.lang]
    assert sum(a == b for a, b in held) / len(held) > 0.98 and all(0 <= r.score <= 1 for r in got.values())
    model = language.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    out = sorted(((r.doc_id or 0, r.lang_pred) for r in language.identify(odd, model).collect()))
    assert len(out) == len(ODD) and {(1, "und"), (2, "und"), (3, "und"), (8, "und")} <= set(out) and (4, "und") not in out
    assert language.fit(none) is None and {r.lang_pred for r in language.identify(odd, None).collect()} == {"und"}


def test_language_rare(spark):
    """A language of a few rows among many is learned; quotas are even and no larger than what there is."""
    assert language.quotas({"a": 5, "b": 100, "c": 1000}, 300) == {"a": 5, "b": 100, "c": 195}
    rows = [(i, f"the house of the {i} friends stands near the river and the old road", "en", 1) for i in range(400)]
    rows += [(1000 + i, f"talo {i} seisoo joen varrella vanhan tien vieressä yhdessä ystävien kanssa", "fi", 1) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, quota int")
    got = language.identify(docs, language.fit(docs, language.Params(rows=60))).collect()
    assert {(r.doc_id >= 1000, r.lang_pred) for r in got} == {(False, "en"), (True, "fi")}


def test_toxicity(spark, odd, none):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.op9_toxicity(spark, sf).collect()}
    held = [(r.toxic, got[r.doc_id].predicted) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    clean = [p for t, p in held if not t]
    assert sum(clean) / len(clean) < 0.01
    labels = spark.createDataFrame([(1, None), (None, 1), (5, 0), (5, 1)], "doc_id long, toxic int")
    rows = toxicity.score(odd, toxicity.fit(odd, labels)).collect()
    assert len(rows) == len(ODD) and all(0 <= r.toxicity <= 1 for r in rows)
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0
    veiled = toxicity.features("you 1d10t and m0ron", frozenset(), 5)
    assert veiled[11] >= 1 and toxicity.features(None, frozenset(), 5) == [0.0] * toxicity.FEATURES


def test_vectors(spark, sf):
    rng = np.random.default_rng(2)
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    for k in range(150):
        _, v, label = rows[rng.integers(0, 100)]
        rows.append((10_000 + k, [float(x + e) for x, e in zip(v, rng.normal(0, rng.choice([0, 0.03, 0.05]), 64), strict=True)], label))
    bad = [(20_000, None, 1), (20_001, [0.0] * 64, 1), (20_002, [float("nan")] * 64, 1), (20_003, [None, 1.0], 1), (20_004, [1.0] * 64, None), (20_005, [], 1), (20_006, [1e300] * 64, 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int")
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([k for *_, k in rows])
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    ids = [i for i, *_ in rows]
    want = groups([(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(near)), strict=True)], ids)
    want = {i: (int(n), want[i], want[i] == i) for i, n in zip(ids, near.sum(1), strict=True)} | {i: (0, i, True) for i, *_ in bad}
    for p in (embedding_dedup.Params(), embedding_dedup.Params(per_cell=20, block=16), embedding_dedup.Params(per_cell=4, first_cells=3, block=16)):  # one cell, one level of cells, two
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(df, p).collect()} == want
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_vectors_many_cells():
    """Every near pair shares a cell, in few and in many dimensions."""
    rng = np.random.default_rng(6)
    for dim, k in ((3, 40), (8, 100), (64, 256)):
        p = embedding_dedup.Params()
        x = rng.normal(size=(3000, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        side = rng.normal(size=x.shape)
        side -= (side * x).sum(1, keepdims=True) * x
        side /= np.linalg.norm(side, axis=1, keepdims=True)
        c = rng.uniform(0.93, 0.96, (len(x), 1))
        y = c * x + np.sqrt(1 - c * c) * side
        centre = embedding_dedup.centroids(np.concatenate([x, y]), k, p)
        assert (embedding_dedup.reached(x, centre, p) & embedding_dedup.reached(y, centre, p)).any(1).all()


def test_chat(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (-8, 0, "user", None), (-8, 1, "assistant", "a\\[b\n]<s>[/]</s>\n\\"), (-8, 1, "assistant", ""), (-9, 5, "us]er", LONG), (-10, 0, None, None)]
    df = df.unionByName(spark.createDataFrame(more, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat.digest(chat.examples(df)).collect()}
    said = {}
    for r in sorted(df.collect(), key=lambda r: (r.turn, r.role or "", r.text or "")):
        said.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    assert set(got) == set(said)
    for i, turns in said.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        assert (got[i].n_turns, got[i].turns_sha256, got[i].loss_chars, got[i].loss_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digest(chat.examples(df.limit(0))).count() == 0


BASE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def base_spans(text):
    def ok(kind, v):
        d = re.sub(r"\D", "", v)
        if kind == "card":
            return 12 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for k, c in enumerate(reversed(d))) % 10 == 0
        return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in v.split(".")), "phone": 9 <= len(d) <= 15}[kind]

    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(BASE) for m in re.finditer(p, text or "") if ok(kind, m[0])]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


def test_personal_data(spark, sf, none):
    docs = texts(spark, sf)
    docs |= {-1: "a@b.c_d@e.f x a@b.c.. é😀 1.2.3.4.5.6.7.8 999.1.1.1 0010.2.3.255 4111 1111 1111 1111 +1 (555) 123-4567 +12 3", -2: None, -3: "", -4: "1" * 3000 + " +" * 50 + "1.2.3." * 300 + "a" * 5000, -5: "@.@ a@b -x@-.- q%@w.e@r.t.y"}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    rows = pii.find(df).select("doc_id", pii.joined(F.col("base")).alias("b")).collect()
    assert {r.doc_id: r.b for r in rows} == {i: base_spans(t) for i, t in docs.items()}
    assert pii.find(none).count() == 0


def disclosing(docs, p):
    """Terms that disclose, by plain counting over distinct texts: kinds, and values of enough texts."""
    texts = {}
    for _, t in docs:
        t = t or ""
        spans = [x.split(":") for x in base_spans(t).split(",") if x]
        spans = [(k, int(a), int(b)) for k, a, b in spans]
        words = {m[0].lower() for m in re.finditer(r"[^\W\d_]{3,}", t) if not any(a < m.end() and m.start() < b for _, a, b in spans) and not (t[m.start() - 1 : m.start()].isdigit() or t[m.end() : m.end() + 1].isdigit())}
        texts[t] = (words, {k for k, *_ in spans} | {f"{k}:{t[a:b].lower()}" for k, a, b in spans})
    n, entity, both = {}, {}, {}
    for words, held in texts.values():
        for e in held:
            entity[e] = entity.get(e, 0) + 1
        for w in words:
            n[w] = n.get(w, 0) + 1
            for e in held:
                both[w, e] = both.get((w, e), 0) + 1
    out = {}
    for (w, e), k in both.items():
        enough = k >= p.support and (":" not in e or entity[e] >= p.support)
        if enough and k / n[w] >= p.share and np.log2(k * len(texts) / (n[w] * entity[e])) >= p.bits:
            out[w] = max(out.get(w, 0), k / n[w])
    return {w: "remove" if s >= p.surely else "generalise" for w, s in out.items()}


def test_disclosing_terms(spark):
    rng = np.random.default_rng(8)
    common = [f"{a}{b}" for a in ("mor", "lan", "tir", "gos") for b in ("dan", "vel", "uk", "eth", "ipp")]
    rows = [(i, f"Note {i}: the zanzibarian poet of {['spring', 'rain', 'night', 'light'][i]} writes from bob@x.org today, the usual way") for i in range(4)]
    rows += [(10 + i, f"the usual poet writes today the {i} note") for i in range(300)]
    for i in range(200):  # values that come back, terms at any share, copies, nulls
        own = " ".join(rng.choice(common, 6))
        tail = ["", " call +1 (555) 123-4567 or amy@q.de", " at 10.0.0.1", f" amy@q.de, {common[i % 3]}amy"][int(rng.integers(0, 4))]
        rows.append((1000 + i, f"{own}{tail} {own if i % 2 else ''}"))
    rows += [(5000 + i, rows[2][1]) for i in range(40)] + [(6000, None), (6001, ""), (None, "an id is missing, amy@q.de")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, row int, spans int")
    want = disclosing(rows, pii.Params())
    found = {(r.doc_id, r.row): r for r in pii.find(df).collect()}
    by_id = {r.doc_id: r for r in found.values()}
    assert want["zanzibarian"] == "remove" and len(want) > 5
    for i, t in rows:
        t = t or ""
        terms = {(s.start, s.finish): s.value for s in by_id[i].spans if s.kind == "term"}
        base = [(s.start, s.finish) for s in by_id[i].base]
        free = lambda m, base=base: not any(a < m.end() and m.start() < b for a, b in base)
        assert terms == {m.span(): want[m[0].lower()] for m in re.finditer(r"[^\W\d_]{3,}", t) if m[0].lower() in want and free(m)}
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "zanzibarian" not in clean[0] and "[EMAIL]" in clean[0] and clean[10] == rows[4][1] and clean[6000] is None


def cut(text):
    out, now = [], []
    for m in re.finditer(r"\s*(\S+)(\s*)", text):
        now.append(m[0])
        if len(now) == 12 or m[1][-1] in ".!?" or "\n" in m[2]:
            out.append("".join(now))
            now = []
    return out + ["".join(now)] * bool(now)


def test_line_dedup(spark, sf, odd, none):
    docs = texts(spark, sf)
    seen, want = {}, {}
    for i, t in sorted(docs.items()):
        parts, gone, own = cut(t or ""), set(), set()
        for k in range(len(parts) - 2):
            key = tuple(x.lower().strip() for x in parts[k : k + 3])
            if sum(map(len, parts[k : k + 3])) < 40:
                continue
            if key in own or seen.setdefault(key, i) != i:
                gone |= {k, k + 1, k + 2}
            own.add(key)
        want[i] = ("".join(x for k, x in enumerate(parts) if k not in gone) if gone else t, len(gone))
    assert {r.doc_id: (r.text, r.lines_removed) for r in queries.op8_line_dedup(spark, sf).collect()} == want and sum(n for _, n in want.values()) > 0
    got = line_dedup.dedup_lines(odd)
    assert got.columns == [*odd.columns, "lines_removed_"] and {r.lines_removed for r in got.collect()} == {9} and got.count() == len(ODD) and line_dedup.dedup_lines(none).count() == 0
    assert {r.doc_id: r.text for r in got.collect() if r.doc_id in (1, 2, 3, 8)} == {1: None, 2: "", 3: " \n\t ", 8: "12345"}


def test_clashing_columns(spark):
    """Columns of the input keep their values whatever they are called."""
    names = ["toxicity", "_id", "_tag", "_gone", "_left", "lines_removed"]
    rows = [(i, f"one {i}. two of them. three lines of a passage that repeats. and the end.", 5.0, 7, 8, "g", "l", 9) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxicity double, _id int, _tag int, _gone string, _left string, lines_removed int")
    for out in (toxicity.score(docs, toxicity.Model()), line_dedup.dedup_lines(docs)):
        assert out.columns[:-1] == docs.columns and {tuple(r[n] for n in names) for r in out.collect()} == {(5.0, 7, 8, "g", "l", 9)}


def test_line_dedup_any_place(spark):
    rng = np.random.default_rng(5)
    own = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 10**9, n))
    passage = own(50)
    rows = [(k, f"{own(100 + k)} {passage} {own(70)}") for k in range(12)]  # every phase of the twelve words
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].text == rows[0][1] and got[0].lines_removed == 0
    for k, text in rows[1:]:
        before, after = text.split(f" {passage} ")
        assert (got[k].text, got[k].lines_removed) == (f"{before} {after}", 5)


def test_line_dedup_short_lines(spark):
    verse = "\n".join(f"a{k}!!" for k in range(60))  # three lines have fewer than 40 characters
    rows = [(1, f"one two\n{verse}\nend"), (2, f"other words here {verse}\nlast")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "other words here last"}


def test_line_dedup_picks(spark):
    """Of every PICK words in a row one is picked, of unmarked words too, and equal passages share one; no step copies a text's words for each of its places."""
    rng = np.random.default_rng(7)
    marks = spark.range(4000).select(F.concat(F.lit("w"), "id").alias("w")).withColumn("m", F.xxhash64("w").bitwiseAND(31) < line_dedup.MARKED).collect()
    every, bare = [r.w for r in marks], [r.w for r in marks if not r.m]
    own = lambda pool, n: [pool[k] for k in rng.integers(0, len(pool), n)]
    rows, shared = [], own(every, 50)
    for k, passage in enumerate([shared, shared, own(bare, 50), own(bare[:2], 60), own(every[:9], 70)] * 2):
        rows.append((k, own(every, 20 + 3 * k) + passage + own(bare, 10 * (k % 3))))
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in rows] + [(98, " ".join(own(every, 49))), (99, None)], "doc_id long, text string")
    found = line_dedup.picked_runs(docs)
    at = {k: set() for k, _ in rows}
    for r in found.collect():
        at[r.doc_id] |= set(r.places)
    for k, w in rows:
        assert all(at[k] & set(range(i, i + line_dedup.PICK)) for i in range(len(w) - line_dedup.LONG + 1)) and len(at[k]) < len(w)
    runs = {}
    for k, w in rows:
        for i in range(len(w) - line_dedup.LONG + 1):
            runs.setdefault(tuple(w[i : i + line_dedup.LONG]), []).append((k, i))
    met = {r.doc_id: set(r.starts) for r in line_dedup.meeting(found).collect()}
    both = [x for x in runs.values() if len({k for k, _ in x}) > 1]
    assert both and all(met[k] & set(range(i, i + line_dedup.PICK)) for x in both for k, i in x)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(h#" not in plan(found) and "translate" not in plan(line_dedup.windows(docs, line_dedup.Params()))


def test_decontamination(spark, sf, odd, none):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    plain = lambda t: f" {' '.join(re.findall(r'[^\W_]+', t.lower()))} "
    items = {r.item_id: plain(r.text) for r in bench.collect()}
    want = {(i, k) for i, t in texts(spark, sf).items() for k, x in items.items() if x in plain(t)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == want and want
    ask = "A train that leaves {a} at noon covers {n} km in {m} hours; how far does the train from {a} get after {m} hours at {n} km an hour"
    items = spark.createDataFrame([(1, ask.format(a="Paris", n=120, m=3)), (2, "Short item"), (None, "x"), (3, None)], "item_id long, text string")
    rows = [(1, "Well. " + ask.format(a="Lyon", n=95, m=7) + ", they ask."), (2, ask.format(a="Paris", n=120, m=3)), (3, "A train that leaves Lyon is late."), (4, "this short item is here")]
    found = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert set(found) == {(1, 1), (2, 1), (4, 2)} and found[1, 1].slots >= 3 and found[1, 1].consistent
    odd_values = ask.format(a="Lyon", n=95, m=7).replace("95", "94", 1).replace("Lyon", "Nice", 1).replace("7", "8", 1)
    assert decontaminate.contaminated(spark.createDataFrame([(1, odd_values)], "doc_id long, text string"), items).count() == 0
    assert decontaminate.contaminated(none, items).count() == 0 and decontaminate.contaminated(odd, items.limit(0)).count() == 0
    assert decontaminate.contaminated(odd, items).count() == 0


def test_decontamination_few_literals(spark):
    items = spark.createDataFrame([(1, "Compute 48 + 17 * 3 - 12"), (2, "1 2 3 4 5 6 7 8 9 10 11 and 12")], "item_id long, text string")
    rows = [(1, "Please compute 48 + 17 * 3 - 12 now."), (2, "Compute 47 + 17 * 3 - 12"), (3, "so 1 2 3 4 5 6 7 8 9 10 11 and 12.")]
    found = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 1), (3, 2)}


def test_decontamination_diagonals(spark):
    ask = "A train that leaves {a} at noon covers {n} km in {m} hours; how far does the train from {a} get after {m} hours at {n} km an hour"
    own = ask.format(a="Paris", n=120, m=3)
    other = ask.format(a="Lyon", n=95, m=7).replace("95", "94", 1).replace("Lyon", "Nice", 1).replace("7", "8", 1)
    rows = [(1, f"{own}. {other}."), (2, other), (3, own.replace(" Paris", "\nParis")), (4, own.lower())]
    found = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, own)], "item_id long, text string")).collect()
    assert {r.doc_id for r in found} == {1, 3, 4}


def test_decontamination_rows(spark):
    """Rows of one id are judged one by one; parts of an item scattered over a long text don't add up; short and long items together."""
    ask = "A train that leaves {a} at noon covers {n} km in {m} hours; how far does the train from {a} get after {m} hours at {n} km an hour"
    own, copy = ask.format(a="Paris", n=120, m=3), ask.format(a="Lyon", n=95, m=7)
    odd_values = copy.replace("95", "94", 1).replace("Lyon", "Nice", 1).replace("7", "8", 1)
    filler = " ".join(f"filler{k}" for k in range(80))
    parts = f"A train that leaves Rome at noon covers {filler} how far does the train from Rome get {filler} in 3 hours; how far does the train from {filler} covers 120 km in 3 hours; how far"
    rows = [(1, f"{copy}. {odd_values}."), (2, own), (2, "Quite another text stands here."), (2, own), (3, parts), (4, f"{odd_values}. {copy}."), (5, f"{filler} one more short thing {filler}")]
    items = spark.createDataFrame([(1, own), (2, "one more short thing")], "item_id long, text string")
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, item_id string, shift int")
    found = decontaminate.contaminated(docs, items).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(1, 1), (2, 1), (4, 1), (5, 2)]
    assert {r.said for r in found if r.doc_id == 2} == {r[0] for r in docs.where("doc_id = 2 and text like 'A train%'").select(F.xxhash64("text")).collect()}


def plain_words(t):
    return f" {' '.join(re.findall(r'[^\W_]+', t.lower()))} "


def test_pipeline(spark, sf):
    """Each stage on what the one before kept: near duplicates and benchmark items against brute force, the others against their operators."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages, rows, kept = dict(corpus_pipeline.STAGES), docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in rows.collect()}
        rows = spark.createDataFrame(stage(spark, rows, sf).collect(), docs.schema)
        after = {r.doc_id: r.text for r in rows.collect()}
        assert rows.columns == docs.columns and set(after) <= set(before)
        kept.append(rows.count())
        if name == "line dedup":
            assert all(len(t) <= len(before[i]) for i, t in after.items() if t) and all(r.n_chars == len(r.text) for r in rows.collect() if r.text)
        elif name == "minhash near-dedup":
            s = sets(before, 5)
            ids = sorted(s)
            linked = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])]
            assert set(after) == {i for i, root in groups(linked, ids).items() if i == root}
        elif name == "benchmark decontamination":
            items = [plain_words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert set(after) == {i for i, t in before.items() if not any(x in plain_words(t or "") for x in items)}
    assert kept == sorted(kept, reverse=True) and kept[-1] > 0.6 * kept[0]
    want = ids_of({r.doc_id: r.text for r in rows.collect()})
    got = {}
    for r in stages["packing"](spark, rows, sf).collect():
        got.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    assert {i: b"".join(x for _, x in sorted(pieces)) for i, pieces in got.items()} == {i: x.tobytes() for i, x in want.items()}


def test_pipeline_odd(spark, sf, odd, none):
    for rows in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            columns = rows.columns
            rows = stage(spark, rows, sf)
            assert rows.columns == columns
            rows = spark.createDataFrame(rows.collect(), rows.schema)
        ids = [r.doc_id for r in rows.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and (rows.count() == 0 or {1, 2, 4, 5, 7, 8} <= set(ids))
