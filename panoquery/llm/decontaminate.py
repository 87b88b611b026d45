"""Benchmark decontamination by template windows, in DataFrame operations only.

A text becomes canonical tokens: lower-cased words, and typed placeholders for numbers (#n), units after a number (#u)
and names (#p: capitalised words inside a sentence). Windows of ``Params.width`` canonical tokens of all documents are
joined by hash with those of the benchmark, so a question asked with other numbers or names still matches. On each
diagonal of matches the values of the benchmark's slots must then stand for the same values of the document throughout;
else the diagonal's matches that rest on slots don't count. The plain lower-cased windows are joined too, so verbatim copies
match whatever white space or case they have, and so do items of too few literal words. A row holds an item when
``Params.share`` of the item's windows match near each other, on consistent diagonals or word for word.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panoquery.llm.common import free, materialise, semi, small, without

# Common units of measurement and money.
UNITS = "mm|cm|m|km|inch|inches|feet|ft|miles|mg|g|kg|lb|lbs|oz|ml|l|s|sec|min|mins|h|hours|minutes|seconds|days|weeks|months|years|hz|khz|mhz|ghz|w|kw|v|kb|mb|gb|tb|percent|dollars|usd|euro|euros|eur|cents|km/h|mph|c|f"


@dataclass(frozen=True)
class Params:
    width: int = 8
    literals: int = 4
    share: float = 0.5
    broadcast_rows: int = 1_000_000


def tokens(text: Column) -> Column:
    """Raw tokens: numbers, and runs of letters."""
    return F.regexp_extract_all(text, F.lit(r"\p{N}+(?:[.,]\p{N}+)*+|\p{L}[\p{L}\p{M}]*+"), F.lit(0))


def marked(text: Column) -> Column:
    """The text with a sign in front of each slot: n number, u unit, p name."""
    text = F.regexp_replace(text, r"(?<=[\p{L}\p{N},;:] )(\p{Lu}[\p{Ll}\p{M}]++)", "\u0001p$1")
    text = F.regexp_replace(text, rf"(?<=\p{{N}}) ?+((?i:{UNITS})(?![\p{{L}}\p{{M}}]))", " \u0001u$1")
    return F.regexp_replace(text, r"(\p{N}+(?:[.,]\p{N}+)*+)", "\u0001n$1")


def found_tokens(text: Column) -> Column:
    """Raw tokens, as many as ``tokens``; slots have a sign in front. A sign U+0001 of the text itself counts as a space."""
    text = F.translate(text, "\u0001", " ")
    quick = F.when(text.rlike(r"\p{N}|[\p{L}\p{N},;:] \p{Lu}\p{Ll}"), marked(text)).otherwise(text)
    return F.regexp_extract_all(quick, F.lit("(?:\u0001[nup])?+(?:\\p{N}+(?:[.,]\\p{N}+)*+|\\p{L}[\\p{L}\\p{M}]*+)"), F.lit(0))


def canonical(found: Column) -> Column:
    return F.transform(found, lambda x: F.when(x.startswith("\u0001"), F.concat(F.lit("#"), F.substring(x, 2, 1))).otherwise(F.lower(x)))


def told(found: Column) -> Column:
    """The lower-cased tokens as they stand in the text."""
    return F.transform(found, lambda x: F.lower(F.when(x.startswith("\u0001"), F.substring(x, 3, (1 << 31) - 1)).otherwise(x)))


def window_hashes(words: Column, width: int) -> Column:
    each = F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.xxhash64(F.slice(words, i + 1, width)))
    return F.when(F.size(words) >= width, each).otherwise(F.array().cast("array<long>"))


def document_windows(texts: DataFrame, widths: list[int]) -> DataFrame:
    """(doc_id, said, size, at, hash): of each row the hashes of its canonical windows of each width, and those of its plain windows.

    ``at`` runs over width after width, first canonical windows, then plain ones; a plain one that equals the canonical one is null.
    """
    rows = texts.select("doc_id", "said", found_tokens(F.col("text")).alias("found"))
    rows = rows.select("doc_id", "said", F.size("found").alias("size"), canonical(F.col("found")).alias("c"), told(F.col("found")).alias("s"))
    made = [window_hashes(F.col(c), w).alias(f"{c}{w}") for w in widths for c in ("c", "s")]
    rows = rows.select("doc_id", "said", "size", *made)
    other = lambda w: F.zip_with(f"c{w}", f"s{w}", lambda x, y: F.when(x != y, y))
    rows = rows.select("doc_id", "said", "size", F.concat(*[x for w in widths for x in (F.col(f"c{w}"), other(w))]).alias("hashes"))
    # the outer form keeps Catalyst from computing the tokens a second time in a filter
    return rows.select("doc_id", "said", "size", F.posexplode_outer("hashes").alias("at", "hash"))


def place(at: Column, size: Column, widths: list[int]) -> Column:
    """The first token of the window ``at`` of ``document_windows``."""
    out, before = None, F.lit(0)
    for w in widths:
        n = F.greatest(size - w + 1, F.lit(0))
        here, which = at < before + 2 * n, (at - before) % F.greatest(n, F.lit(1))
        out = F.when(here, which) if out is None else out.when(here, which)
        before = before + 2 * n
    return out


def item_windows(benchmark: DataFrame, p: Params) -> DataFrame:
    """(item_id, ipos, hash, form, width, plain, windows, raw, canon): windows with enough literal words, or all of an item that has none; a short item is one window.

    ``form`` is canon or, for each of these windows, said: its lower-cased words. Windows without enough literals have no canon form.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    items = items.withColumns({"raw": tokens(F.col("text")), "canon": canonical(found_tokens(F.col("text")))}).where("size(canon) > 0")
    items = items.withColumn("width", F.least(F.size("canon"), F.lit(p.width)))
    at = F.transform(F.sequence(F.lit(0), F.size("canon") - F.col("width")), lambda i: F.struct(i.alias("ipos"), F.slice("canon", i + 1, F.col("width")).alias("w")))
    literal = F.size(F.filter("w", lambda x: ~x.startswith("#")))
    rows = items.select("item_id", "raw", "canon", "width", F.explode(at).alias("x")).select("item_id", "raw", "canon", "width", F.col("x.ipos").alias("ipos"), F.col("x.w").alias("w"))
    rows = rows.withColumns({"plain": literal == F.col("width"), "enough": literal >= F.least(F.lit(p.literals), F.col("width"))})
    rows = rows.join(rows.groupBy("item_id").agg(F.max("enough").alias("some")), "item_id").where("enough or not some")
    plain = F.transform(F.slice("raw", F.col("ipos") + 1, F.col("width")), F.lower)
    forms = F.array(F.struct(F.lit("canon").alias("form"), F.xxhash64("w").alias("hash"), F.col("plain")), F.struct(F.lit("said").alias("form"), F.xxhash64(plain).alias("hash"), F.lit(True).alias("plain")))
    rows = rows.select("item_id", "ipos", "width", "enough", "raw", "canon", F.explode(forms).alias("f")).where("enough or f.form = 'said'")
    rows = rows.select("item_id", "ipos", "f.hash", "f.form", "width", "f.plain", "raw", "canon")
    sizes = rows.groupBy("item_id").agg(F.countDistinct("ipos").alias("windows"))
    return rows.join(sizes, "item_id")


def contaminated(docs: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, said, item_id, matched, windows, coverage, slots, consistent): every row that holds a benchmark item.

    ``said`` is a hash of the row's text: rows that repeat an id are judged one by one, equal rows once. An item is held
    where its matches stand near each other, on diagonals that differ by less than its length; copies elsewhere in the
    text neither help nor harm. Null ids and texts hold nothing and are held by nothing, nor do texts without a word.
    Items shorter than a window match as a whole. Either table may be empty.
    """
    items = materialise(item_windows(benchmark, p), "items", few=True)
    widths = sorted(r.width for r in items.select("width").distinct().collect())  # at most p.width of them
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    texts = texts.withColumn("said", F.xxhash64("text"))
    row = ["doc_id", "said", "item_id"]
    if not widths:
        return texts.sparkSession.createDataFrame([], "doc_id long, said long, item_id long, matched long, windows long, coverage double, slots long, consistent boolean")
    keys = items.select("hash", "item_id", "ipos", "plain")
    keys = F.broadcast(keys) if small(keys, p.broadcast_rows) else keys
    hits = document_windows(texts, widths).join(keys, "hash").withColumn("shift", place(F.col("at"), F.col("size"), widths) - F.col("ipos"))
    hits = materialise(hits.select(*row, "ipos", "plain", "shift").distinct(), "hits", few=True)
    about = items.groupBy("item_id").agg(F.first("windows").alias("windows"), F.first("canon").alias("canon"), F.first("raw").alias("raw"), F.first("width").alias("width"))
    # two rows of clusters of diagonals, each twice as wide as the item and half a cluster apart: near diagonals meet in one
    length = F.size("canon")
    clusters = F.array(2 * F.floor(F.col("shift") / (2 * length)), 2 * F.floor((F.col("shift") + length) / (2 * length)) + 1)
    spread = hits.join(about.select("item_id", "windows", length.alias("length"), "canon"), "item_id").select(*row, "ipos", "plain", "shift", "windows", F.explode(clusters).alias("cluster"))
    least = F.lit(p.share) * F.col("windows")
    pairs = spread.groupBy(*row, "cluster").agg(F.countDistinct("ipos").alias("matched"), F.first("windows").alias("windows")).where(F.col("matched") >= least)
    pairs = materialise(pairs, "pairs", few=True)
    near = materialise(spread.drop("windows").join(pairs.select(*row, "cluster"), [*row, "cluster"]), "near", few=True)
    # slots of what is left, on every diagonal: do they stand for the same values throughout?
    reach = near.groupBy(*row, "shift").agg(F.min("ipos").alias("a"), F.max("ipos").alias("b"))
    slots = about.select("item_id", "width", F.posexplode(F.arrays_zip("canon", "raw")).alias("t", "x")).where(F.col("x.canon").startswith("#")).select("item_id", "width", "t", F.col("x.canon").alias("kind"), F.lower("x.raw").alias("told"))
    own = semi(texts, pairs.select("doc_id").distinct(), "doc_id").join(pairs.select("doc_id", "said").distinct(), ["doc_id", "said"], "left_semi")
    own = own.select("doc_id", "said", tokens(F.col("text")).alias("raw")).dropDuplicates(["doc_id", "said"])
    met = reach.join(slots, "item_id").where("t >= a and t < b + width").join(own, ["doc_id", "said"])
    met = met.withColumn("heard", F.lower(F.get("raw", F.col("t") + F.col("shift")))).where("heard is not null")
    maps = met.groupBy(*row, "shift", "kind", "told").agg(F.countDistinct("heard").alias("n")).groupBy(*row, "shift").agg(F.count("*").alias("slots"), F.max("n").alias("n"))
    judged = near.join(materialise(maps, "diagonals", few=True), [*row, "shift"], "left").withColumn("even", F.coalesce(F.col("n") == 1, F.lit(True)))
    # on a diagonal that holds other values in one slot, matches that rest on slots don't count
    good = judged.groupBy(*row, "cluster").agg(
        F.countDistinct(F.when(F.col("even") | F.col("plain"), F.col("ipos"))).alias("good"),
        F.countDistinct(F.when(F.col("even"), F.col("ipos"))).alias("even"),
        F.max(F.coalesce("slots", F.lit(0))).alias("slots"),
    )
    out = pairs.join(good, [*row, "cluster"]).where(F.col("good") >= least).withColumn("consistent", F.col("even") >= least)
    out = out.groupBy(*row).agg(F.max("matched").alias("matched"), F.first("windows").alias("windows"), F.max("slots").cast("long").alias("slots"), F.max("consistent").alias("consistent"))
    return out.select(*row, "matched", "windows", (F.col("matched") / F.col("windows")).alias("coverage"), "slots", "consistent")


def without_items(docs: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows and columns of ``docs`` that hold no benchmark item."""
    key = free(docs, "_doc", "_said")
    found = materialise(contaminated(docs, benchmark, p).select("doc_id", "said").distinct().toDF(*key), "leaks", few=True)
    rows = docs.withColumns(dict(zip(key, (F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))), strict=True)))
    return without(rows, found, key).select(*docs.columns)
