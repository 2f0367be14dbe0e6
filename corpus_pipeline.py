"""A corpus pipeline of the training-data operators: documents in, a weighted mix out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, lines, minhash, mixing, quality
from tidemark.stage import stage

c = F.col
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule of the strict policy rejects go."""
    return quality.ledger(docs.select(*COLUMNS)).where(quality.passes(quality.STRICT)).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source go; the character count follows the text."""
    d = lines.drop_boilerplate(docs.select(*COLUMNS))
    n = F.when(c("n_dropped") > 0, F.length("text")).otherwise(c("n_chars"))
    return d.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    gone = minhash.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; ``copy`` numbers its copies."""
    return mixing.emitted(docs).select(*COLUMNS, "copy")


STAGES = [
    ("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup),
    ("benchmark decontamination", decontamination), ("mixing sources", mixing_sources),
]
#: Decontamination (approximate matching) cannot be said in SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
