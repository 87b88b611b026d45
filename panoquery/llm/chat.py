"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, only its text is under the loss
mask. A conversation that doesn't end with an assistant turn also gives one example without a target, so that no turn is
lost. A turn is ``<s>[role]text[/]</s>`` and a newline; inside roles and texts a backslash goes before ``\\ [ ] <``, so
that no text can hold a control string, and unescaping gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN = r"(?s)<s>\[((?:[^\\\[\]<]|\\.)*+)\]((?:[^\\\[\]<]|\\.)*+)\[/\]</s>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\\[\]<])", r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_length): loss in code points of ``formatted``, null without a target.

    Rows of a conversation are ordered by turn (null first), then role and text. Null roles and texts count as empty;
    rows with null conv_id are one conversation. An empty table gives no examples.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    head, body = F.concat(F.lit("<s>["), escaped(F.col("role")), F.lit("]")), escaped(F.col("text"))
    rows = rows.select("conv_id", "role", F.row_number().over(order).cast("long").alias("example"), F.lead(F.lit(1)).over(order).isNull().alias("last"), head.alias("head"), body.alias("body"), F.concat(head, body, F.lit("[/]</s>\n")).alias("turn"))
    before = Window.partitionBy("conv_id").orderBy("example").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("prefix", F.array_join(F.collect_list("turn").over(before), ""))
    target = F.col("role") == "assistant"
    return rows.where(target | F.col("last")).select(
        "conv_id",
        "example",
        F.concat("prefix", "turn").alias("formatted"),
        F.when(target, F.length("prefix") + F.length("head")).cast("long").alias("loss_start"),
        F.when(target, F.length("body")).cast("long").alias("loss_length"),
    )


def digest(made: DataFrame) -> DataFrame:
    """What examples say when they are read back: one row per conversation."""
    last = F.max_by("formatted", "example")
    under = F.when(F.col("loss_start").isNotNull(), unescaped(F.expr("substring(formatted, cast(loss_start as int) + 1, cast(loss_length as int))")))
    read = made.select("conv_id", "example", "formatted", F.struct("example", under.alias("text")).alias("loss"), F.length("formatted").cast("long").alias("n"))
    read = read.groupBy("conv_id").agg(last.alias("whole"), F.sort_array(F.collect_list("loss")).alias("losses"), F.sum("n").alias("formatted_chars"))
    roles, texts = (F.regexp_extract_all("whole", F.lit(TURN), F.lit(k)) for k in (1, 2))
    read = read.withColumns({"roles": roles, "texts": texts, "loss": F.array_join(F.transform("losses", lambda x: x["text"]), "")})
    turns = F.zip_with("roles", "texts", lambda r, t: F.concat(unescaped(r), F.lit("\n"), unescaped(t), F.lit("\n")))
    return read.select("conv_id", F.size("texts").cast("long").alias("n_turns"), F.sha2(F.array_join(turns, "").cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
