"""Bounded samples of labelled rows, the same at every run and partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small


def fold(n: int) -> Column:
    """crc32 of doc_id as text, modulo n; null for a null doc_id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def bounded(rows: DataFrame, by: str, most: int) -> DataFrame:
    """About `most` rows of each value of `by` at the most, chosen by a hash of doc_id.

    A value with n rows keeps those whose hash falls in the first most / n part of the hash range, so no
    value's rows meet in one task where the values are few (labels, languages), as they are broadcast then.
    """
    rates = rows.groupBy(by).agg(F.count("*").alias("tb_n"))
    rates = small(rates, rates.count(), 64)
    h = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.join(rates, by).where(h * F.col("tb_n") < F.lit(float(most))).drop("tb_n")
