"""A corpus pipeline of five stages, each one operator of ``panoquery.llm``.

Every stage works on all that the one before has kept. All but the last return the columns of documents:
toxic documents go; repeated passages are taken out of all but their first document (a document that consisted of
nothing else goes); one document of each near-duplicate group stays; documents that hold benchmark items go; what is left
is packed into sequences (one row per piece, with its ids).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panoquery.llm import decontaminate, line_dedup, near_dedup, packing, toxicity
from panoquery.llm.common import free, materialise


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (score,) = free(docs, "toxicity")
    return toxicity.score(docs, model, score).where(F.col(score) < 0.5).select(*docs.columns)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    (removed,) = free(docs, "lines_removed")
    out = line_dedup.dedup_lines(docs, counted=removed).where((F.col(removed) == 0) | (F.trim("text") != ""))
    return out.select(*[F.when(F.col(removed) > 0, F.char_length("text")).otherwise(F.col(c)).cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.representatives(docs, near_dedup.Params(words=5, percent=80))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, known=400_000)  # its workers also hold what earlier stages left


STAGES = [
    ("toxicity", toxicity_filter),
    ("line dedup", repeated_lines),
    ("minhash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("packing", packed_sequences),
]

#: A trained model and a tokenizer can't be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        rows = materialise(stage(spark, rows, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, rows, sf_dir)
