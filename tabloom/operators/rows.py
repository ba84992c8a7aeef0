"""Predicates on rows, cells and headers of tables, and the types that they tell, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cell_type, col, is_numeric, unit_patterns, ustrip

#: Beginnings of footnotes (the second and third by word, the last two by label) and whole lines that are marks.
FOOTNOTES = r"^(?:\d+$|(?i:Includes)\b|(?i:ACEA)\b|\*+$|(?i:Note:)|(?i:Source:))"
#: Characters that may stand in a number beside its digits.
BESIDE_DIGITS = " ,._$€£%+-"
#: Indicators of dates and currencies in number formats of sheets.
DATE_MARKS, CURRENCIES = ("yyyy", "yy", "mm", "dd"), "$€£¥"


def is_footnote(x: Column | str) -> Column:
    """A footnote's mark or text, by its beginning."""
    return ustrip(x).rlike(FOOTNOTES)


def is_continuation(x: Column | str) -> Column:
    """Text of a lone cell that belongs to the table around it: blank, in parentheses, or a number."""
    s = ustrip(x)
    return (s == "") | (s.startswith("(") & s.endswith(")")) | F.translate(s, BESIDE_DIGITS, "").rlike(r"^\d+$")


def is_section_label(x: Column | str) -> Column:
    """Four characters or more, all capitals, no colon."""
    s = ustrip(x)
    return ~s.contains(":") & (F.length(s) > 3) & (s == F.upper(s)) & (s != F.lower(s))


def _filled(cells: Column | str) -> Column:
    return F.filter(F.transform(col(cells), ustrip), lambda c: c != "")


def is_header_like(cells: Column | str) -> Column:
    """Under half of the filled cells are numbers, years of four digits not counted; false for an empty row."""
    filled = _filled(cells)
    year = lambda c: F.translate(c, ",  ", ".").rlike(r"^\d{4}$")
    numbers = F.size(F.filter(filled, lambda c: is_numeric(c) & ~year(c)))
    return (F.size(filled) > 0) & (2 * numbers < F.size(filled))


def is_text_row(cells: Column | str) -> Column:
    """No cell is a date or a number; false for a row of no cells."""
    return (F.size(col(cells)) > 0) & F.forall(F.transform(col(cells), cell_type), lambda t: t == "string")


def is_blank_row(cells: Column | str) -> Column:
    return F.size(_filled(cells)) == 0


def text_columns(cells: DataFrame, part: list[str], column: str, value: str) -> DataFrame:
    """(part, column, filled, is_text, is_numeric) of long cells: more than half of the filled cells are no numbers, or are; an empty column counts as numeric."""
    filled = F.count_if(ustrip(value) != "")
    numbers = F.count_if((ustrip(value) != "") & is_numeric(value))
    out = cells.groupBy(*part, column).agg(filled.alias("filled"), numbers.alias("numbers"))
    text = (F.col("filled") > 0) & (2 * (F.col("filled") - F.col("numbers")) > F.col("filled"))
    return out.select(*part, column, "filled", text.alias("is_text"), ((F.col("filled") == 0) | (2 * F.col("numbers") > F.col("filled"))).alias("is_numeric"))


def header_rows_by_type(rows: DataFrame, table: str, row: str, cells: str) -> DataFrame:
    """(table, header_rows): leading rows before the first one with a date or number cell; all rows if there is none."""
    first = F.min(F.when(~is_text_row(cells), F.col(row)))
    return rows.groupBy(table).agg(F.coalesce(first - F.min(row), F.count("*")).alias("header_rows"))


def table_size(rows: DataFrame, table: str, cells: str, is_total: str | None = None) -> DataFrame:
    """(table, n_rows, n_cols): rows without totals, and the widest row."""
    counted = F.count("*") if is_total is None else F.count_if(~F.col(is_total))
    return rows.groupBy(table).agg(counted.alias("n_rows"), F.max(F.size(cells)).alias("n_cols"))


def infer_type(values: DataFrame, part: list[str], value: str) -> DataFrame:
    """(part, type) of columns of number cells: int if no cell has a fraction other than zeros, else float; string where a filled cell is neither date nor number."""
    s = ustrip(value)
    kind = cell_type(value)
    plain = F.regexp_replace(F.regexp_replace(s, r"[, ]", ""), r"[%)]+$", "")
    broken = plain.rlike(r"^[^.]*\.[^.]*$") & plain.rlike(r"\.\d*[^0]+\d*$") & F.regexp_replace(s, r"[($€£¥+\-,.\s)%]", "").rlike(".")
    out = values.where(s != "").groupBy(*part).agg(F.bool_and(kind == "number").alias("numbers"), F.bool_or(broken).alias("broken"))
    return out.select(*part, F.when(~F.col("numbers"), "string").when(F.col("broken"), "float").otherwise("int").alias("type"))


def header_units(header: Column | str) -> Column:
    """Distinct units named in a header: by pattern, after its last comma, in its first parentheses (the last two under 20 characters)."""
    h = col(header)
    found = F.transform(unit_patterns(h), lambda m: m["value"])
    tail = F.trim(F.regexp_extract(h, r",([^,]*)$", 1))
    inside = F.trim(F.regexp_extract(h, r"\(([^)]+)\)", 1))
    short = lambda x, there: F.when(there & (F.length(x) < 20), F.array(x)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(found, short(tail, h.contains(",")), short(inside, h.rlike(r"\([^)]+\)"))))


def format_hint(number_format: Column | str) -> Column:
    """date, currency or percentage of a sheet's number format; null for others, General and none."""
    f = col(number_format)
    low = F.lower(f)
    marked = F.lit(False)
    for m in DATE_MARKS:
        marked = marked | low.contains(m)
    date = marked & (low.contains("y") | low.contains("d"))
    return F.when(f.isNull() | (f == "") | (f == "General"), F.lit(None)).when(date, "date").when(f.rlike(f"[{CURRENCIES}]"), "currency").when(f.contains("%"), "percentage")
