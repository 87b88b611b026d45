"""Line dedup by overlapping three-line windows, in DataFrame operations only.

A line ends at a newline, at the end of a sentence, or after ``Params.words`` words: passages repeat inside longer lines
too, and sentences are where they can be taken out cleanly. Every three lines that follow each other are a window; its
hash is looked for in all documents. The first window (smallest doc_id, then position) stays; lines that any later one
covers go, and what stays is joined again as it was. Windows of fewer than ``Params.least`` characters are left
alone there.

Lines are cut by a running count, so a second pass looks, in what the first has left, for passages of LONG = 50 words of an
earlier document wherever they begin and however short their lines. A word is marked by its own hash (MARKED of 32). Of every
PICK words in a row the marked one with the smallest hash is picked (winnowing), or the first if none is marked; equal passages
share a picked word whatever stands around them, and so the hash of the RUN words from it. Where such hashes meet, all runs of
LONG words around them are compared.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panoquery.llm.common import free, materialise, small


LONG, PICK, MARKED = 50, 36, 4
RUN = LONG - PICK + 1


@dataclass(frozen=True)
class Params:
    words: int = 12
    least: int = 40


def lines(text: Column, p: Params) -> Column:
    """The lines of a text with the white space after them; joined, they are the text."""
    return F.regexp_extract_all(text, F.lit(rf"\s*+(?:\S++(?<![.!?])[^\S\n]++(?!\n)){{0,{p.words - 1}}}\S++\s*+"), F.lit(0))


def spaced(text: Column, others: str) -> Column:
    """The text with a space for each of the characters ``others``; much faster than ``translate``."""
    return reduce(lambda x, c: F.replace(x, F.lit(c), F.lit(" ")), others, text)


def tag(text: Column) -> Column:
    """32 bits that tell rows with the same doc_id and other texts apart."""
    return F.xxhash64(text).bitwiseAND(0xFFFFFFFF)


def windows(docs: DataFrame, p: Params) -> DataFrame:
    """(hash, doc_id, place): ``place`` packs the row's tag, whether its document has the window before, and the first line.

    Lines are compared without case and the white space around them.
    """
    own = docs.select("doc_id", tag(F.col("text")).alias("tag"), lines(spaced(F.lower("text"), "\t\r"), p).alias("lines"))
    own = own.select("doc_id", "tag", F.transform("lines", lambda x: F.xxhash64(F.trim(spaced(x, "\n")))).alias("h"), F.transform("lines", F.length).alias("n"))
    each = F.transform(
        F.slice("h", F.lit(1), F.size("h") - 2),
        lambda x, i: F.when(F.get("n", i) + F.get("n", i + 1) + F.get("n", i + 2) >= p.least, F.xxhash64(x, F.get("h", i + 1), F.get("h", i + 2))),
    )
    own = own.select("doc_id", "tag", F.when(F.size("h") >= 3, each).alias("w"))
    # the outer form keeps Catalyst from computing the lines a second time in a filter
    own = own.withColumn("some", F.size(F.array_distinct("w")) < F.size("w"))
    rows = own.select("doc_id", "tag", "some", "w", F.posexplode_outer("w").alias("pos", "hash")).where("hash is not null")
    again = F.col("some") & (F.array_position("w", F.col("hash")) <= F.col("pos"))
    return rows.select("hash", "doc_id", (F.shiftleft("tag", 32).bitwiseOR(F.when(again, F.lit(1 << 31)).otherwise(F.lit(0))).bitwiseOR(F.col("pos").cast("long"))).alias("place"))


def said(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, text)"""
    return docs.select("doc_id", tag(F.col("text")).alias("tag"), "text")


def word_hashes(own: DataFrame) -> DataFrame:
    """``own`` with the hashes ``h`` of the words in place of the text."""
    words = F.array_remove(F.split(spaced(F.lower("text"), "\t\n\x0b\f\r"), " "), "")
    return own.withColumn("h", F.transform(words, lambda x: F.xxhash64(x))).drop("text")


def exploded(own: DataFrame, width: int) -> DataFrame:
    """(hash, doc_id, tag, places): the ``width`` words from each place in ``at``; equal runs of a row are one, with all their places."""
    own = own.select("doc_id", "tag", "at", F.transform("at", lambda i: F.xxhash64(*[F.get("h", i + j) for j in range(width)])).alias("r"))  # slice() copies all of h for each
    runs = F.transform("r", lambda x, k: F.struct(x.alias("hash"), F.get("at", k).alias("pos")))
    own = own.select("doc_id", "tag", "at", "r", F.when(F.size(F.array_distinct("r")) < F.size("r"), F.array_sort(runs)).alias("w"))
    new = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: (i == 0) | (F.get("w", i)["hash"] != F.get("w", i - 1)["hash"]))
    own = own.select("doc_id", "tag", "at", "r", "w", F.when(F.size("w") > 0, new).alias("b"))
    last = lambda k: F.coalesce(F.get("b", k + 1), F.size("w"))
    some = F.transform("b", lambda i, k: F.struct(F.get("w", i)["hash"].alias("hash"), F.transform(F.slice("w", i + 1, last(k) - i), lambda x: x["pos"]).alias("places")))
    each = F.transform("r", lambda x, k: F.struct(x.alias("hash"), F.array(F.get("at", k)).alias("places")))
    rows = own.select("doc_id", "tag", F.explode_outer(F.when(F.col("w").isNull(), each).otherwise(some)).alias("g")).where("g is not null")
    return rows.select("g.hash", "doc_id", "tag", "g.places")


def picked_places(own: DataFrame) -> DataFrame:
    """``own`` with the places ``at`` of the picked words of ``h`` that RUN words begin with (of marked ones a few more: smaller ones are looked for three marks to each side)."""
    marked = F.array_compact(F.transform("h", lambda x, i: F.when(x.bitwiseAND(31) < MARKED, i)))
    own = own.withColumn("m", F.when(F.size("h") >= LONG, F.concat(F.array(F.lit(-1)), marked, F.array(F.size("h")))))
    # the text's ends bound its windows as smaller hashes do
    value = lambda i: F.coalesce(F.get("h", i), F.lit(-(1 << 63)))
    before = lambda x, k: F.coalesce(*[F.when(value(F.get("m", k - j)) <= x, F.get("m", k - j)) for j in (1, 2, 3)])
    after = lambda x, k: F.coalesce(*[F.when(value(F.get("m", k + j)) < x, F.get("m", k + j)) for j in (1, 2, 3)])
    least = F.transform("m", lambda i, k: F.when(F.coalesce(after(F.get("h", i), k) - before(F.get("h", i), k) > PICK, F.lit(True)), i))
    between = lambda k: F.when(F.get("m", k) - F.get("m", k - 1) > PICK, F.sequence(F.get("m", k - 1) + 1, F.get("m", k) - PICK))
    bare = F.flatten(F.array_compact(F.transform(F.sequence(F.lit(1), F.size("m") - 1), between)))
    return own.withColumn("at", F.filter(F.concat(least, bare), lambda i: (i >= 0) & (i <= F.size("h") - RUN))).drop("m")


def picked_runs(docs: DataFrame) -> DataFrame:
    """(hash, doc_id, tag, places): the RUN words from each picked word."""
    return exploded(picked_places(word_hashes(said(docs))), RUN)


def long_runs(docs: DataFrame, met: DataFrame) -> DataFrame:
    """(hash, doc_id, tag, places): the LONG words from each place around the hashes that meet."""
    own = word_hashes(said(docs).join(sent(met), ["doc_id", "tag"]))
    around = F.array_distinct(F.flatten(F.transform("starts", lambda x: F.sequence(F.greatest(x - PICK + 1, F.lit(0)), x))))
    return exploded(own.withColumn("at", F.filter(around, lambda i: i <= F.size("h") - LONG)), LONG)


def sent(rows: DataFrame, most: int = 200_000) -> DataFrame:
    """``rows`` for a join with the texts: broadcast up to ``most``, shuffled beyond."""
    return F.broadcast(rows) if small(rows, most) else rows


def meeting(found: DataFrame) -> DataFrame:
    """(doc_id, tag, starts): where hashes start that more than one document has."""
    shared = found.groupBy("hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("hash")
    return together(found.join(shared, "hash"))


def run_hits(found: DataFrame) -> DataFrame:
    """(doc_id, tag, starts): for each row where runs start that an earlier document has."""
    first = found.groupBy("hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("hash", "first")
    return together(found.join(first, "hash").where("doc_id > first"))


def together(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id", "tag").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("places")))).alias("starts"))


def starts(hit: DataFrame) -> DataFrame:
    hit = hit.select("doc_id", F.shiftrightunsigned("place", 32).alias("tag"), F.col("place").bitwiseAND((1 << 31) - 1).cast("int").alias("pos"))
    return hit.groupBy("doc_id", "tag").agg(F.collect_set("pos").alias("starts"))


def without_runs(words: Column, found: Column) -> Column:
    """The words of ``words`` that none of the LONG words from each of ``found`` covers. Both are columns of their own, else made anew in each step."""
    at = lambda k: F.coalesce(F.get(found, k), F.size(words))
    end = lambda k: F.coalesce(F.get(found, k - 1) + LONG, F.lit(0))
    kept = F.filter(F.sequence(F.lit(0), F.size(found)), lambda k: at(k) > end(k))
    return F.flatten(F.transform(kept, lambda k: F.slice(words, end(k) + 1, at(k) - end(k))))


def hits(found: DataFrame) -> DataFrame:
    """(doc_id, tag, starts): for each row where its later occurrences of windows start."""
    first = found.groupBy("hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("hash", "first")
    later = found.join(first, "hash").where("doc_id > first").select("doc_id", "place")
    again = found.where(F.col("place").bitwiseAND(1 << 31) != 0).select("doc_id", "place")
    return starts(later.unionByName(again))


def covered(found: DataFrame) -> DataFrame:
    """(doc_id, tag, gone): for each row the lines that later occurrences of windows cover."""
    return hits(found).select("doc_id", "tag", F.array_distinct(F.flatten(F.transform("starts", lambda x: F.array(x, x + 1, x + 2)))).alias("gone"))


def dedup_lines(docs: DataFrame, p: Params = Params(), counted: str | None = None) -> DataFrame:
    """The rows and columns of ``docs`` with repeated windows taken out of ``text``, and how many lines went.

    The first occurrence is that of the smallest doc_id (null first), then the first line. Rows that share a doc_id are
    one place: they are not held against each other. Null, empty and shorter texts stay as they are, and so does every
    text without a later occurrence. Of words that the second pass takes out, twelve count as a line, as does a rest of
    fewer. The count's column is ``counted``; by default ``lines_removed``, with "_" added while ``docs`` has such a column.
    """
    counted = counted or free(docs, "lines_removed")[0]
    id1, tag1, tag2, gone1, left1, starts1, words1, rest1 = free(docs, "_id", "_tag", "_tag2", "_gone", "_left", "_starts", "_words", "_rest")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    picked = docs.select(key.alias("doc_id"), F.col("text").cast("string").alias("text"))
    gone = materialise(covered(materialise(windows(picked, p), "windows")).toDF(id1, tag1, gone1), "gone", few=True)
    first = docs.withColumns({id1: key, tag1: tag(F.col("text").cast("string"))}).join(sent(gone), [id1, tag1], "left")
    kept = F.array_join(F.filter(F.transform(lines(F.col("text"), p), lambda x, i: F.when(~F.array_contains(gone1, i), x)), lambda x: x.isNotNull()), "")
    first = first.withColumn(left1, F.when(F.col(gone1).isNull(), F.col("text").cast("string")).otherwise(kept))
    left = first.select(F.col(id1).alias("doc_id"), F.col(left1).alias("text"))
    met = materialise(meeting(materialise(picked_runs(left), "picked")), "met", few=True)
    more = sent(materialise(run_hits(materialise(long_runs(left, met), "runs")).toDF(id1, tag2, starts1), "repeated", few=True))
    out = first.withColumn(tag2, tag(F.col(left1))).join(more, [id1, tag2], "left")
    out = out.withColumn(words1, F.when(F.col(starts1).isNotNull(), F.regexp_extract_all(left1, F.lit(r"\s*+\S++\s*+"), F.lit(0))))
    out = out.withColumn(rest1, F.when(F.col(starts1).isNotNull(), without_runs(F.col(words1), F.col(starts1))))
    text = F.when(F.col(starts1).isNotNull(), F.array_join(rest1, "")).when(F.col(gone1).isNotNull(), F.col(left1)).otherwise(F.col("text"))
    count = F.when(F.col(gone1).isNull(), 0).otherwise(F.size(gone1)) + F.coalesce(F.ceil((F.size(words1) - F.size(rest1)) / p.words), F.lit(0))
    return out.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns], count.cast("long").alias(counted))
