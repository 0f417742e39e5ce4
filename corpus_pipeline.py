"""The corpus pipeline: five stages, each over all that the one before kept.

1. quality classifier: documents above their language's perplexity limit go;
2. line dedup: later copies of repeated runs of lines are cut from the texts, and
   documents of which nothing is left go;
3. MinHash near-dedup: of each group of near duplicates the smallest doc_id stays;
4. benchmark decontamination: documents that hold a benchmark item go;
5. mixing: what the mix takes of each document, in words, with its source's target.

The first four return the columns of documents, n_chars following the text.
Nulls in any column pass each stage as its operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from orrery.llm import decontaminate, line_dedup, mixing, near_dedup, quality
from orrery.llm.common import staged, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = line_dedup.rewritten(docs.select(*COLUMNS))
    emptied = (F.col("_n_removed") > 0) & (F.col("_n_removed") == F.col("_n_lines"))
    length = F.when(F.col("_n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.where(~emptied).withColumn("n_chars", length).select(*COLUMNS)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.representatives(docs.select(*COLUMNS))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs.select(*COLUMNS))


STAGES = [
    ("quality classifier", classify),
    ("line dedup", dedup_lines),
    ("near dedup", dedup_near),
    ("benchmark decontamination", decontaminated),
    ("source mixing", mix),
]

#: The perplexity, signature and random-walk stages have no SQL; tests/llm hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs)
    return docs
