"""Native column functions against plain Python on awkward texts."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tabloom.functions import text as T
from tabloom.functions import values as V


def run(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").repartition(3)
    return [r["o"] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_normalize(spark):
    got = run(spark, ["a  b “q” – x  y  \n\n z​ \t", "", None, "same"], T.normalize_text)
    assert got == ['a b "q" - x y\n\n z', "", None, "same"]
    assert run(spark, got, T.normalize_text) == got


def test_alias(spark):
    assert run(spark, [' "Quantity(tonnes)" ', "A  B", None], T.normalize_alias) == ["quantity (tonnes)", "a b", None]


@pytest.mark.parametrize("text,hit", [("Exports of", True), ("harvested export", True), ("exporter", False), ("reexport", False), ("EXPORT_2", True), ("", False)])
def test_keyword(spark, text, hit):
    assert run(spark, [text], lambda c: T.keyword_matches(c, "export")) == [hit]


def test_cell_type(spark):
    cells = ["2024-01-02", "2024", "3/4/24", "12:30 pm", "January 2025", "(1,234.5)", "$ 7", "12%", "-", "abc", "", None, "2024-01-02T10:00Z"]
    assert run(spark, cells, T.cell_type) == ["date"] * 5 + ["number"] * 3 + ["string"] * 4 + ["date"]


def test_tokens_and_similarity(spark):
    assert run(spark, ["Year–over, year 2024 12"], T.header_tokens) == [["year", "over"]]
    assert run(spark, ["x"], lambda c: T.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")))) == [1 / 3]


def test_names_and_ids(spark):
    assert run(spark, ["Sales / Net Price (USD), total"], T.snake_name) == ["net_price"]
    assert run(spark, ["http://x/123/", "http://x/"], T.trailing_id) == [123, None]
    assert run(spark, ["of 1999, 2020 and 1999"], T.years) == [["1999", "2020"]]


@pytest.mark.parametrize(
    "text,kind,pattern,want",
    [("1,234", "int", None, 1234), ("(1 234.5)", "float", None, -1234.5), ("€ 55826,3", "float", "#,##", 55826.3), ("1.234,5", "float", "#.###,##", 1234.5), ("12.5%", "float", None, 12.5), ("abc", "int", None, None), ("", "float", None, None), ("1d", "float", None, None), ("-7.9", "int", None, -7), ("inf", "int", None, None)],
)
def test_coerce_number(spark, text, kind, pattern, want):
    assert run(spark, [text], lambda c: V.coerce_number(c, kind, pattern)) == [want]


def test_coerce_bool(spark):
    assert run(spark, [" Yes", "0", "maybe", None], V.coerce_bool) == [True, False, None, None]


@pytest.mark.parametrize("v,p,want", [(1234567, "#,###", "1,234,567"), (-1234.5, "#.###,##", "-1.234,50"), (-5, "(#)", "(5)"), (3, "+#", "+3"), (12, "#%", "12%"), (2.5, "#", "2"), (999, "#,###", "999")])
def test_format_number(spark, v, p, want):
    assert spark.range(1).select(V.format_number(F.lit(float(v)), p).alias("o")).first()["o"] == want


def test_format_date(spark):
    assert run(spark, ["3/4/2024", "2024-12-31 23:59", "13/14/2024", "x", ""], lambda c: V.format_date(c, "YYYY-MM-DD")) == [datetime(2024, 4, 3).strftime("%Y-%m-%d"), "2024-12-31", "13/14/2024", "x", None]


def test_cases(spark):
    words = ["fooBar baz-qux", "", "ÉTÉ x2y"]
    assert run(spark, words, lambda c: V.format_text(c, "snake_case")) == ["foo_bar_baz_qux", "", "été_x2y"]
    assert run(spark, words[:2], lambda c: V.format_text(c, "camelCase")) == ["fooBarBazQux", ""]
    assert run(spark, words, V.title_case) == [w.title() for w in words]


def test_patterns(spark):
    got = run(spark, ["As of January 1, 2024; Q3 FY24 and 1/2/23 - 4/5/23"], T.temporal_patterns)[0]
    assert ("as_of_date", "January 1, 2024") in [(r["name"], r["value"]) for r in got]
    assert ("quarter", "Q3 24") in [(r["name"], r["value"]) for r in got]
    marks = run(spark, ["a¹² (3) †"], T.footnote_markers)[0]
    assert [(r["marker"], r["number"]) for r in marks] == [("¹²", 12), ("(3)", 3), ("†", None)]
    assert re.search("b", "abc")
