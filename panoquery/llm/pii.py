"""Personal data: fixed kinds by pattern, and terms that reveal them by corpus co-occurrence; DataFrame operations only.

Protected entities are the base kinds (email, ip, card, phone: that a text holds one) and the values that stand in at least
``Params.support`` texts. Over whole texts of the whole corpus, each distinct text once, it is counted in how many texts
a term stands, and in how many of these an entity stands too. A term reveals an entity when P(entity | term) and the
pointwise mutual information reach the thresholds. Wherever such a term stands, in a text with the entity or without, it
becomes a span of kind ``term``: generalised, or removed when it reveals the entity almost surely. Terms inside base spans
don't count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panoquery.llm.common import materialise, semi, small

KINDS = ("email", "ip", "card", "phone")
# The base patterns; possessive and anchored forms that match the same spans in linear time.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
SIGN = {"email": "@", "ip": ".", "card": None, "phone": "+"}
BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
BEFORE, AFTER = r"(?<![\p{L}\p{M}\p{N}])", r"(?![\p{L}\p{M}\p{N}])"
TERM = BEFORE + r"\p{L}{3,}+" + AFTER


@dataclass(frozen=True)
class Params:
    support: int = 3
    share: float = 0.5
    bits: float = 2.0
    surely: float = 0.9
    broadcast_rows: int = 200_000


def located(text: Column, pattern: str | Column, kind: str, place: int) -> Column:
    """Spans of all matches: array of (start, place, finish, kind, value), in code points."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    pairs = F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("m"), g.alias("g")))  # one gap more than matches

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["g"]
        finish = start + F.length(x["m"])
        one = F.struct(start.alias("start"), F.lit(place).alias("place"), finish.alias("finish"), F.lit(kind).alias("kind"), x["m"].alias("value"))
        return F.struct(finish.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    made = F.aggregate(F.filter(pairs, lambda x: x["m"].isNotNull()), F.struct(F.lit(0).alias("at"), none().alias("out")), step, lambda acc: acc["out"])
    some = F.contains(text, F.lit(SIGN[kind])) if SIGN.get(kind) else F.lit(True)
    return F.when(some & F.regexp_like(text, pattern), made).otherwise(none())


def luhn(digits: Column) -> Column:
    def step(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$")
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(9, 15) if kind == "phone" else F.lit(True)


def holds(kind: str):
    return lambda x: valid(kind, x["value"])


def base_spans(text: Column) -> Column:
    """All valid spans of the base kinds, by start, then kind as listed."""
    parts = [F.filter(located(text, PATTERNS[k], k, i), holds(k)) for i, k in enumerate(KINDS)]
    return F.array_sort(F.concat(*parts))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["finish"].cast("string"))), ",")


def terms(text: Column, spans: Column) -> Column:
    """The distinct lower-cased terms of a text outside its base spans."""

    def step(acc: Column, x: Column) -> Column:
        out = F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0))), F.lit("\u0001"))
        return F.struct(F.greatest(acc["at"], x["finish"]).alias("at"), out.alias("out"))

    # a span counts as a sign that is no letter, so that what stands on its two sides makes no term
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = F.aggregate(spans, first, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    clear = F.when(F.size(spans) > 0, rest).otherwise(text)
    return F.array_distinct(F.regexp_extract_all(F.lower(clear), F.lit(TERM), F.lit(0)))


def once(held: DataFrame, rows: DataFrame, p: Params) -> DataFrame:
    """``rows`` (doc_id, row, ...) with each distinct text once, but for equal rows of one doc_id."""
    copies = held.groupBy("row").agg(F.count("*").alias("n"), F.min("doc_id").alias("own")).where("n > 1").select("row", "own")
    copies = materialise(copies, "copies", few=True)
    copies = F.broadcast(copies) if small(copies, p.broadcast_rows) else copies
    return rows.join(copies, "row", "left").where("own is null or doc_id = own").drop("own")


def with_spans(held: DataFrame, rows: DataFrame, p: Params) -> DataFrame:
    """``rows`` with the base ``spans`` of their texts; most texts have none, so only those that have some are joined."""
    own = materialise(held.where("size(spans) > 0").groupBy("row").agg(F.first("spans").alias("own")), "own", few=True)
    own = F.broadcast(own) if small(own, p.broadcast_rows) else own
    return rows.join(own, "row", "left").withColumn("spans", F.coalesce("own", none())).drop("own")


def none() -> Column:
    return F.array().cast("array<struct<start:int,place:int,finish:int,kind:string,value:string>>")


def disclosing(held: DataFrame, picked: DataFrame, p: Params) -> DataFrame:
    """(term, share): terms that reveal an entity beyond the thresholds, with the largest P(entity | term).

    ``held``: (doc_id, row, spans), ``picked``: (doc_id, row, text), of all rows.
    """
    which = [F.exists("spans", of_kind(k)).cast("long").alias(k) for k in KINDS]
    texts = with_spans(held, once(held, picked, p), p)
    made = texts.select(*which, F.explode_outer(terms(F.col("text"), F.col("spans"))).alias("term")).where("term is not null")
    counted = made.groupBy("term").agg(F.count("*").alias("n"), *[F.sum(k).alias(k) for k in KINDS])
    some = once(held, held.select("doc_id", "row", "spans"), p)
    total = some.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(F.exists("spans", of_kind(k)).cast("long")), F.lit(0)).alias(k) for k in KINDS]).first()
    counted = materialise(counted.where(F.col("n") >= p.support), "terms")
    bits = lambda both, n, entity: F.log2(both * F.lit(float(max(1, total.n))) / (n * entity))
    kinds = [F.struct(F.col(k).alias("both"), F.lit(float(max(1, total[k]))).alias("entity")) for k in KINDS]
    by_kind = counted.select("term", "n", F.explode(F.array(*kinds)).alias("x")).select("term", "n", "x.both", "x.entity")
    # values that come back: their terms in all texts that hold them
    values = some.select("row", F.explode(F.array_distinct(F.transform("spans", lambda x: F.concat_ws(":", x["kind"], F.lower(x["value"]))))).alias("value"))
    values = materialise(values.distinct(), "values", few=True)
    often = materialise(values.groupBy("value").agg(F.count("*").alias("entity")).where(F.col("entity") >= p.support), "often", few=True)
    rows = [by_kind]
    if not often.isEmpty():
        most = often.agg(F.max("entity")).first()[0] / p.share  # a more frequent term can't reach the share with any value
        holders = values.join(often, "value").select("row", "value", "entity")
        own = semi(picked, holders.select("row").distinct(), "row", p.broadcast_rows)
        own = with_spans(held, once(held, own, p), p).select("row", F.explode(terms(F.col("text"), F.col("spans"))).alias("term"))
        rare = counted.where(F.col("n") <= most).select("term", "n")
        both = own.join(rare, "term").join(holders, "row").distinct().groupBy("term", "value").agg(F.count("*").alias("both"), F.first("n").alias("n"), F.first("entity").alias("entity"))
        rows.append(both.select("term", "n", "both", F.col("entity").cast("double").alias("entity")))
    scored = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
    scored = scored.where((F.col("both") >= p.support) & (F.col("both") / F.col("n") >= p.share)).where(bits(F.col("both"), F.col("n"), F.col("entity")) >= p.bits)
    return scored.groupBy("term").agg(F.max(F.col("both") / F.col("n")).alias("share"))


def find(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, row, base, spans): per row of ``docs`` its base spans and all spans, with the terms that disclose.

    A null text is empty and has no spans. Rows come back as they come; ``row`` is a hash of the text, and rows with the
    same text get the same spans.
    """
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("row", F.xxhash64("text"))
    held = materialise(picked.select("doc_id", "row", base_spans(F.col("text")).alias("spans")), "spans")
    risky = materialise(disclosing(held, picked, p), "disclosing", few=True)
    if risky.isEmpty():
        return held.select("doc_id", "row", F.col("spans").alias("base"), "spans")
    words = picked.select("row", F.explode_outer(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term"))
    words = words.join(F.broadcast(risky) if small(risky, p.broadcast_rows) else risky, "term")
    told = materialise(words.groupBy("row").agg(F.map_from_entries(F.collect_set(F.struct("term", "share"))).alias("told")), "told", few=True)
    texts = with_spans(held, picked.select("row", "text").join(F.broadcast(told) if small(told, p.broadcast_rows) else told, "row"), p)
    # only the terms of the text's own list are looked for; a match whose lower case is another word is left out
    pattern = F.concat(F.lit("(?iu)" + BEFORE + "(?:"), F.array_join(F.map_keys("told"), "|"), F.lit(")" + AFTER))
    there = F.filter(located(F.col("text"), pattern, "term", len(KINDS)), lambda m: F.map_contains_key("told", F.lower(m["value"])) & ~F.exists("spans", lambda x: (x["start"] < m["finish"]) & (m["start"] < x["finish"])))
    how = lambda m: F.when(F.element_at("told", F.lower(m["value"])) >= p.surely, F.lit("remove")).otherwise(F.lit("generalise")).alias("value")
    more = F.transform(there, lambda m: F.struct(m["start"].alias("start"), m["place"].alias("place"), m["finish"].alias("finish"), m["kind"].alias("kind"), how(m)))
    extra = texts.select("row", more.alias("more")).groupBy("row").agg(F.first("more").alias("more"))
    out = held.join(extra, "row", "left")
    return out.select("doc_id", "row", F.col("spans").alias("base"), F.array_sort(F.concat("spans", F.coalesce("more", none()))).alias("spans"))


def of_kind(kind: str):
    return lambda x: x["kind"] == kind


def redacted(text: Column, spans: Column) -> Column:
    """The text with base spans as ``[KIND]``, disclosing terms as ``[TERM]`` or taken out; of spans that overlap the first counts."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        told = F.when((x["kind"] == "term") & (x["value"] == "remove"), F.lit("")).otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
        more = F.struct(x["finish"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), told).alias("out"))
        return F.when(x["start"] >= acc["at"], more).otherwise(acc)

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def sanitise(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, text): every row of ``docs`` with its spans replaced; a null text stays null."""
    spans = find(docs, p).where("size(spans) > 0").dropDuplicates(["row"]).select("row", "spans")
    rows = docs.select("doc_id", "text").withColumn("row", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return rows.join(spans, "row", "left").select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(redacted(F.col("text"), F.col("spans"))).alias("text"))
