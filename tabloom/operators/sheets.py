"""Spreadsheet table logic over cells (table key, row, col, text): regions, header votes, annotations, trims.

Cells are long rows and every rule is an aggregate or a window keyed by the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ustrip
from . import grid as G

# First cells of footnote rows and of total rows.
FOOTNOTE_STARTS = ("*", "Source:", "Note:", "Notes:")
TOTAL_WORDS = ("total", "totals", "sum", "grand total", "subtotal", "average", "avg", "mean")


def _filled() -> Column:
    """Whether a cell holds more than white space; null texts are blank."""
    return F.coalesce(ustrip("text") != "", F.lit(False))


def regions(cells: DataFrame, table: list[str], gap_rows: int = 2, gap_cols: int = 2) -> DataFrame:
    """Filled cells with `region`: rows split at two or more blank rows, then columns at two or more blank columns.

    Regions under 2 x 2 are left out; a table with none keeps all its filled cells as region 0.
    """
    full = cells.where(_filled())
    rows = G.islands(full.select(*table, "row").distinct(), table, "row", gap_rows, "band")
    banded = full.join(rows, [*table, "row"])
    cols = G.islands(banded.select(*table, "band", "col").distinct(), [*table, "band"], "col", gap_cols, "strip")
    both = banded.join(cols, [*table, "band", "col"])
    size = both.groupBy(*table, "band", "strip").agg((F.max("row") - F.min("row") + 1).alias("h"), (F.max("col") - F.min("col") + 1).alias("w"))
    kept = size.where("h >= 2 and w >= 2")
    order = Window.partitionBy(*table).orderBy("band", "strip")
    kept = kept.select(*table, "band", "strip", (F.row_number().over(order) - 1).alias("region"))
    with_any = kept.select(*table).distinct().withColumn("has", F.lit(True))
    out = both.join(kept, [*table, "band", "strip"], "left").join(with_any, table, "left")
    return out.where("region is not null or has is null").withColumn("region", F.coalesce("region", F.lit(0))).drop("band", "strip", "has")


def expand_merges(cells: DataFrame, merges: DataFrame, table: list[str]) -> DataFrame:
    """Cells with the text of all but the top-left cell of a merge (r0, c0, r1, c1) emptied.

    Merged ranges are exploded to their cells, so the join is by equality.
    """
    spot = merges.select(*table, "r0", "c0", F.explode(F.sequence("r0", "r1")).alias("row"), "c1").select(*table, "r0", "c0", "row", F.explode(F.sequence("c0", "c1")).alias("col"))
    inner = spot.where("row <> r0 or col <> c0").select(*table, "row", "col").distinct().withColumn("hide", F.lit(True))
    out = cells.join(inner, [*table, "row", "col"], "left")
    return out.withColumn("text", F.when(F.col("hide"), F.lit("")).otherwise(F.col("text"))).drop("hide")


def header_votes(votes: DataFrame) -> Column:
    """Header rows from the votes (fills, merges, types, spans): fills if there are any, else the largest, one at least."""
    return F.when(F.col("fills") > 0, F.col("fills")).otherwise(F.greatest(*[F.coalesce(c, F.lit(0)) for c in ("merges", "types", "spans")], F.lit(1)))


def _fill(cells: DataFrame, table: list[str]) -> DataFrame:
    """(table, row, filled, first, line) for every row that has a cell."""
    text = F.when(_filled(), F.struct("col", "text"))
    listed = F.array_sort(F.collect_list(text))
    out = cells.groupBy(*table, "row").agg(listed.alias("c"))
    return out.select(*table, "row", F.size("c").alias("filled"), ustrip(F.try_element_at("c", F.lit(1))["text"]).alias("first"), F.array_join(F.transform("c", lambda s: s["text"]), "; ").alias("line"))


def annotation_block(cells: DataFrame, sizes: DataFrame, table: list[str]) -> DataFrame:
    """(table, blank_row, lines) of the note block above a table: sparse rows, then a blank row in the first eight, then a dense row.

    `sizes` holds width, height and header_rows of each table (three header rows or more, four rows or more); rows count from 0.
    """
    grid = sizes.where("header_rows >= 3 and height >= 4 and width > 0").withColumn("row", F.explode(F.sequence(F.lit(0), F.least(F.col("height") - 1, F.lit(8)))))
    rows = grid.join(_fill(cells, table), [*table, "row"], "left").withColumn("filled", F.coalesce("filled", F.lit(0)))
    w = Window.partitionBy(*table)
    rows = rows.withColumn("blank_row", F.min(F.when((F.col("filled") == 0) & (F.col("row") < 8), F.col("row"))).over(w)).where("blank_row >= 1")
    above, below = F.col("row") < F.col("blank_row"), F.col("row") == F.col("blank_row") + 1
    out = rows.groupBy(*table, "blank_row").agg(
        F.bool_and(F.when(above, F.col("filled") / F.col("width") <= 0.5)).alias("sparse"),
        F.max(F.when(below, F.col("filled") / F.col("width"))).alias("dense"),
        F.array_sort(F.collect_list(F.when(above & (F.col("filled") > 0), F.struct("row", "line")))).alias("lines"),
    )
    return out.where("sparse and dense >= 0.5").select(*table, "blank_row", F.transform("lines", lambda s: s["line"]).alias("lines"))


def title_row(cells: DataFrame, header_rows: DataFrame, table: list[str]) -> DataFrame:
    """(table, title), trimmed, where row 0 holds one filled cell and the header has more rows than it."""
    top = _fill(cells.where("row = 0"), table).where("filled = 1")
    return top.join(header_rows.where("header_rows > 1"), table).select(*table, F.col("first").alias("title"))


def edge_bounds(cells: DataFrame, sizes: DataFrame, table: list[str]) -> DataFrame:
    """(table, first_col, end_col): columns left after the edge trims; `sizes` holds width, height and header_rows.

    First a wholly blank column near an edge goes, with all beyond it, if that is at most 40 % of the width (of several, the one
    next to each edge decides); then columns at the edges without a header and with under half of their data rows filled.
    """
    data = F.col("row") >= F.least("header_rows", "height")
    col_rows = sizes.where("width > 0").withColumn("col", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    filled = cells.where(_filled()).join(sizes.select(*table, "header_rows", "height"), table)
    counts = filled.groupBy(*table, "col").agg(F.count_if(~data).alias("heads"), F.count_if(data).alias("body"))
    c = col_rows.join(counts, [*table, "col"], "left").fillna(0, ["heads", "body"]).withColumn("blank", F.col("heads") + F.col("body") == 0)
    w = Window.partitionBy(*table)
    right = F.max(F.when(F.col("blank") & (F.col("col") >= 1), F.col("col"))).over(w)
    c = c.withColumn("r", right).withColumn("end", F.when((F.col("width") - F.col("r")) / F.col("width") <= 0.4, F.col("r")).otherwise(F.col("width")))
    c = c.withColumn("l", F.min(F.when(F.col("blank") & (F.col("col") < F.col("end")), F.col("col"))).over(w))
    c = c.withColumn("start", F.when((F.col("l") + 1) / F.col("width") <= 0.4, F.col("l") + 1).otherwise(F.lit(0)))
    n_data = F.col("height") - F.least("header_rows", "height")
    good = (F.col("heads") > 0) | (n_data <= 0) | (F.col("body") >= 0.5 * n_data)
    inside = good & (F.col("col") >= F.col("start")) & (F.col("col") < F.col("end"))
    out = c.groupBy(*table, "width", "start", "end").agg(F.min(F.when(inside, F.col("col"))).alias("lo"), F.max(F.when(inside, F.col("col"))).alias("hi"))
    trimmed = F.col("width") > 1
    end = F.when(trimmed, F.greatest(F.coalesce(F.col("hi"), F.col("start")) + 1, F.col("start") + 1)).otherwise(F.col("width"))
    return out.select(*table, F.when(trimmed, F.coalesce("lo", "start")).otherwise(F.lit(0)).alias("first_col"), end.alias("end_col"))


def strip_footnotes(cells: DataFrame, width: DataFrame, table: list[str]) -> DataFrame:
    """Data cells above the trailing run of blank rows and of rows under half full that start like a footnote."""
    starts = F.lit(False)
    for s in FOOTNOTE_STARTS:
        starts = starts | F.col("first").startswith(s)
    rows = _fill(cells, table).join(width.select(*table, "width"), table)
    note = (F.col("filled") == 0) | ((F.col("filled") / F.col("width") < 0.5) & starts)
    last = rows.where(~note).groupBy(*table).agg(F.max("row").alias("last_row"))
    return cells.join(last, table).where("row <= last_row").drop("last_row")


def drop_totals(cells: DataFrame, table: list[str]) -> DataFrame:
    """Data cells (with `bold`) without a last row whose cell in column 0 is a total word in bold type."""
    bold_total = F.col("bold") & (F.col("col") == 0) & F.lower(ustrip("text")).isin(*TOTAL_WORDS)
    last = cells.groupBy(*table).agg(F.max("row").alias("row"))
    total = cells.where(bold_total).select(*table, "row").distinct().join(last, [*table, "row"])
    return cells.join(total, [*table, "row"], "left_anti")


def merge_header_rows(merged: DataFrame, table: list[str]) -> DataFrame:
    """(table, header_rows): rows down to the last one of the first ten that holds a merge, one at least."""
    return merged.groupBy(*table).agg(F.greatest(F.coalesce(F.max(F.when(F.col("row") < 10, F.col("row"))) + 1, F.lit(1)), F.lit(1)).alias("header_rows"))
