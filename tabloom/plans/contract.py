"""Contracts: a JSON description of outputs, compiled on the driver into small tables and column expressions."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import coerce, format_date, format_number, format_text, title_case
from ..operators.ontology import latest
from .mapping import mapped_rows


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    kind: str = "string"
    aliases: tuple[str, ...] = ()
    format: str | None = None
    source: str | None = None  # title, constant, report_date: a column that is added, not mapped
    value: str | None = None
    filter: str | None = None  # latest, earliest


@dataclass(frozen=True)
class OutputSpec:
    name: str
    category: str
    columns: tuple[ColumnSpec, ...]


@dataclass(frozen=True)
class Contract:
    provider: str
    categories: dict[str, list[str]] = field(default_factory=dict)
    outputs: tuple[OutputSpec, ...] = ()

    @classmethod
    def of(cls, text: str) -> Contract:
        """From JSON: {provider, categories: {name: {keywords}}, outputs: {name: {category, schema: {columns}}}}."""
        raw = json.loads(text)
        cats = {k: v["keywords"] if isinstance(v, dict) else v for k, v in raw.get("categories", {}).items()}
        outs = []
        for name, o in raw.get("outputs", {}).items():
            cols = [ColumnSpec(c["name"], c.get("type", "string"), tuple(c.get("aliases", ())), c.get("format"), c.get("source"), c.get("value"), c.get("filter")) for c in o["schema"]["columns"]]
            outs.append(OutputSpec(name, o.get("category", name), tuple(cols)))
        return cls(raw.get("provider", ""), cats, tuple(outs))


def year_aliases(aliases: tuple[str, ...], years: list[str]) -> tuple[str, ...]:
    """`{YYYY}` and `{YYYY-n}` resolved from the last year; without years such aliases go."""
    out = []
    for a in aliases:
        m = re.search(r"\{YYYY([+-]\d+)?\}", a)
        if not m:
            out.append(a)
        elif years:
            out.append(a.replace(m[0], str(int(years[-1]) + int(m[1] or 0))))
    return tuple(out)


def alias_table(spark: SparkSession, out: OutputSpec, years: list[str] = ()) -> DataFrame:
    rows = [(a, c.name, c.kind) for c in out.columns if not c.source for a in year_aliases(c.aliases or (c.name,), list(years))]
    return spark.createDataFrame(rows, "alias string, column string, kind string")


def formatted(c: ColumnSpec) -> Column:
    """A typed column as text by its format: numbers, dates or case."""
    if not c.format:
        return F.col(c.name)
    if c.kind in ("int", "float"):
        return format_number(c.name, c.format)
    if c.kind == "date" or re.search("YYYY|MM|DD", c.format):
        return format_date(c.name, c.format)
    return format_text(c.name, c.format)


def interpret(spark: SparkSession, docs: DataFrame, out: OutputSpec, key: str | list[str], years: list[str] = (), report_date: str | Column | None = None) -> DataFrame:
    """Typed rows of one output from documents of pipe tables (one table each), in contract column order after the key's columns."""
    keys = [key] if isinstance(key, str) else list(key)
    mapped = [(c.name, c.kind, year_aliases(c.aliases or (c.name,), list(years))) for c in out.columns if not c.source]
    records = mapped_rows(docs.select(*keys, "text"), mapped)
    date = report_date if isinstance(report_date, Column) else F.lit(report_date)
    added = {"title": F.coalesce("title", F.lit("Unknown")), "report_date": date}
    cols = [coerce(c.name, c.kind, c.format).alias(c.name) if not c.source else added.get(c.source, F.lit(c.value)).alias(c.name) for c in out.columns]
    typed = records.select(*keys, *cols)
    for c in out.columns:
        if c.filter in ("latest", "earliest"):
            typed = latest(typed, keys, c.name, c.filter == "earliest")
        if c.kind == "string" and c.format in ("lowercase", "uppercase", "titlecase"):
            typed = typed.withColumn(c.name, {"lowercase": F.lower, "uppercase": F.upper, "titlecase": title_case}[c.format](F.col(c.name)))
    return typed


def save(df: DataFrame, path: str, out: OutputSpec) -> None:
    """CSV and TSV with formatted text, anything else as typed Parquet; by the path's ending."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("csv", "tsv"):
        df.select(*[formatted(c).alias(c.name) for c in out.columns]).write.mode("overwrite").csv(path, header=True, sep="\t" if kind == "tsv" else ",")
    else:
        df.write.mode("overwrite").parquet(path)
