"""SQL functions and table functions: what a SQL user calls by name."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators.fuzzy import ratio
from .operators.pivot import pivot_plan
from .operators.tables import section_rows
from .sources.office import html_cells


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def scalar_sql() -> dict[str, str]:
    """Bodies of the functions of one text `x` that SQL itself can say, so that they stay inside generated code."""
    strip = lambda e: f"regexp_replace(regexp_replace({e}, {_quoted(r'(?U)^\s+')}, ''), {_quoted(r'(?U)\s+$')}, '')"
    plain = f"translate(x, {_quoted(T.TYPOGRAPHIC + T.ZERO_WIDTH)}, {_quoted(T.PLAIN)})"
    one = f"regexp_replace(regexp_replace({plain}, {_quoted(r'[ \t]{2,}')}, ' '), {_quoted(r'(?Umd)[[^\S\n]\x1c-\x1f]+$')}, '')"
    date = f"({strip('x')} rlike {_quoted('^(' + '|'.join(T.DATE_SHAPES) + ')$')} or {strip('x')} rlike {_quoted('^(' + '|'.join(T.DATETIME_STARTS) + ')')})"
    digits = f"regexp_replace({strip('x')}, {_quoted(T.BESIDE_DIGITS)}, '') rlike {_quoted(r'^\d+$')}"
    kind = f"case when x is null or {strip('x')} = '' then 'string' when {date} then 'date' when {strip('x')} rlike {_quoted(T.NUMBER_SHAPE)} and {digits} then 'number' else 'string' end"
    return {"normalize_pipe_table": one, "cell_type": kind}


class ParsePipeTable:
    """(title, section, headers, row_idx, is_total, cells) of the table of a text."""

    def eval(self, text: str):
        yield from section_rows(text or "")


class UnpivotPipeTable:
    """(pivot_name, headers, cells) of the rows of a text's table, by detected groups; null pivot_name where there are none."""

    def eval(self, text: str):
        for _, _, headers, _, total, cells in section_rows(text or ""):
            plan = None if total else pivot_plan(tuple(headers))
            if plan is None:
                yield None, headers, cells
                continue
            names = [headers[i] for i in plan["shared"]] + plan["measures"]
            for g in plan["groups"]:
                yield g["prefix"], names, [cells[i] if i < len(cells) else "" for i in (*plan["shared"], *g["cols"])]


class HtmlTables:
    """(table_idx, row_idx, col_idx, value) of the tables of a web page."""

    def eval(self, page: str):
        yield from html_cells(page or "")


TABLE_FUNCTIONS = {
    "parse_pipe_table": (ParsePipeTable, "title string, section string, headers array<string>, row_idx int, is_total boolean, cells array<string>"),
    "unpivot_pipe_table": (UnpivotPipeTable, "pivot_name string, headers array<string>, cells array<string>"),
    "html_tables": (HtmlTables, "table_idx int, row_idx int, col_idx int, value string"),
}


def register(spark: SparkSession) -> list[str]:
    """Registers all functions in the session and returns their names; `fuzz_ratio(a, b)` is null for null texts."""
    for name, body in scalar_sql().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS STRING RETURN {body}")

    @F.pandas_udf("double")
    def fuzz_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([ratio(x.lower(), y.lower()) if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(a, b, strict=True)], dtype="float64")

    spark.udf.register("fuzz_ratio", fuzz_ratio)
    for name, (cls, kind) in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, F.udtf(cls, returnType=kind))
    return [*scalar_sql(), "fuzz_ratio", *TABLE_FUNCTIONS]
