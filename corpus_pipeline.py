"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

Belongs to the subpackage `tabloom.llm`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import Scratch
from tabloom.llm.decontaminate import decontaminate
from tabloom.llm.line_dedup import line_dedup
from tabloom.llm.mixing import mix_sources
from tabloom.llm.near_dup import drop_near_duplicates
from tabloom.llm.quality import score_quality
from tabloom.session import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality classifier accepts."""
    return score_quality(spark, docs, table(spark, sf_dir, "labels")).where("predicted = 1").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the lines that many documents share; n_chars follows the text."""
    return line_dedup(spark, docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return drop_near_duplicates(spark, docs).select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold an item of the benchmark."""
    return decontaminate(spark, docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that the sources weigh the same, in shuffled order."""
    return mix_sources(spark, docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("minhash near-dedup", near),
    ("benchmark decontamination", benchmark),
    ("mixing sources to target weights", mixing),
]

#: The first stage is a fitted classifier, which SQL can't say.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`; what a stage keeps is written before the next reads it."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
