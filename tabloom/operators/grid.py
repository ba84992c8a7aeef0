"""Layout logic over long tables of cells, spans and shapes: windows in place of page loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cell_type, col


def islands(df: DataFrame, part: list[str], order: str, gap: float, out: str = "cluster") -> DataFrame:
    """Numbers runs whose neighbours are at most `gap` apart (rows, y clusters, blank runs, title groups)."""
    w = Window.partitionBy(*part).orderBy(order)
    before = F.lag(order).over(w)
    new = ((F.col(order) > before) & (F.col(order) - before > gap)).cast("int")  # equal ones, infinite ones too, are of one run
    return df.withColumn(out, F.coalesce(F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))


def forward_fill(df: DataFrame, part: list[str], order: str, value: str, out: str) -> DataFrame:
    """The last non-blank value at or before each cell of a header row."""
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(F.nullif(F.trim(value), F.lit("")), ignorenulls=True).over(w))


def compound_headers(cells: DataFrame, table: str, rows: str, cols: str, value: str) -> DataFrame:
    """(table, col, header): header fragments top down without consecutive repeats, joined by ` / `."""
    w = Window.partitionBy(table, cols).orderBy(rows)
    kept = cells.where(F.trim(value) != "").withColumn("before", F.lag(value).over(w)).where("before is null or before <> " + value)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rows, value))), lambda s: s[value]), " / ")
    return kept.groupBy(table, cols).agg(joined.alias("header"))


def mode_first(df: DataFrame, part: list[str], order: str, value: str) -> DataFrame:
    """(part, value, n): the most frequent value, the one seen first on a tie."""
    counts = df.groupBy(*part, value).agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    w = Window.partitionBy(*part).orderBy(F.desc("n"), "first_seen")
    return counts.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(*part, value, "n")


def top_counts(df: DataFrame, part: list[str], value: str, top: int) -> DataFrame:
    """(part, value, seen): the most frequent values of two or more that are seen twice or more, the least first on a tie."""
    counts = df.where(F.col(value) >= 2).groupBy(*part, value).agg(F.count("*").alias("seen")).where("seen >= 2")
    w = Window.partitionBy(*part).orderBy(F.desc("seen"), value)
    return counts.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= top).drop("rn")


def upper_median(df: DataFrame, part: list[str], value: str, out: str) -> DataFrame:
    """The element at n div 2 of the sorted values, by rank rather than by gathering a group's values."""
    w = Window.partitionBy(*part)
    ranked = df.withColumn("rn", F.row_number().over(w.orderBy(value))).withColumn("n", F.count("*").over(w))
    return ranked.where("rn = n div 2 + 1").select(*part, F.col(value).alias(out))


def nearest_column(spans: DataFrame, columns: DataFrame, part: list[str], x: str, start: str, tolerance: Column | float) -> DataFrame:
    """Each span with the canonical column of the least distance (the left one on a tie) and whether it is within tolerance.

    A page's columns are few: they are gathered into an array of its row, so every span, equal ones too, is one row throughout. Spans of pages without columns are left out.
    """
    listed = columns.groupBy(*part).agg(F.collect_list(start).alias("tb_starts"))
    best = F.array_min(F.transform("tb_starts", lambda c: F.struct(F.abs(F.col(x) - c).alias("d"), c.alias("c"))))
    near = spans.join(listed, part).withColumn("tb_best", best)
    return near.select(*spans.columns, F.col("tb_best.c").alias("column_start"), (F.col("tb_best.d") <= tolerance).alias("within"))


def header_overlap(spans: DataFrame, bounds: DataFrame, part: list[str]) -> DataFrame:
    """Header spans (lo, hi) to column bounds (col_idx, col_lo, col_hi): largest overlap, then least distance, then the first; one row for each span, equal ones too."""
    listed = bounds.groupBy(*part).agg(F.collect_list(F.struct("col_lo", "col_hi", "col_idx")).alias("tb_bounds"))

    def rank(c: Column) -> Column:
        overlap = F.greatest(F.least(F.col("hi"), c["col_hi"]) - F.greatest(F.col("lo"), c["col_lo"]), F.lit(0))
        far = F.abs((F.col("lo") + F.col("hi")) / 2 - (c["col_lo"] + c["col_hi"]) / 2)
        return F.struct((-overlap).alias("o"), far.alias("d"), c["col_idx"].alias("c"))

    best = spans.join(listed, part).withColumn("tb_best", F.array_min(F.transform("tb_bounds", rank)))
    return best.select(*spans.columns, F.col("tb_best.c").alias("col_idx"), (-F.col("tb_best.o")).alias("overlap"))


def column_bounds(spans: DataFrame, part: list[str], column: str) -> DataFrame:
    """(part, column, lo, hi): least start and greatest end of a column's spans."""
    return spans.groupBy(*part, column).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def title_groups(headings: DataFrame, part: list[str], row: str, text: str, gap: int = 3) -> DataFrame:
    """(part, first_row, title): headings at most `gap` rows apart, joined by a blank from the top."""
    grouped = islands(headings, part, row, gap, "tb_group")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(row, text))), lambda s: s[text]), " ")
    return grouped.groupBy(*part, "tb_group").agg(F.min(row).alias("first_row"), joined.alias("title")).drop("tb_group")


def label_above(regions: DataFrame, part: list[str], order: str, kind: str, text: str, most: int = 50) -> DataFrame:
    """Regions with `label`: for a table, the heading under `most` characters above it, over scattered regions only."""
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    stop = F.when(F.col(kind) != "scattered", F.struct(F.col(kind).alias("k"), F.col(text).alias("t")))
    above = F.last(stop, ignorenulls=True).over(w)
    label = F.when((F.col(kind) == "table") & (above["k"] == "heading") & (F.length(above["t"]) < most), above["t"])
    return regions.withColumn("label", label)


def title_paragraph(body: DataFrame, part: list[str], order: str, kind: str, text: str) -> DataFrame:
    """Tables of a document body (kind p or tbl) with `title`: the nearest filled paragraph before, if no other table is between."""
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(F.col(kind) != "p", F.struct(F.lit(None).cast("string").alias("t"))).when(F.trim(text) != "", F.struct(F.trim(text).alias("t")))
    return body.withColumn("title", F.last(mark, ignorenulls=True).over(w)["t"]).where(F.col(kind) != "p")


def fill_within_kind(df: DataFrame, part: list[str], order: str, value: str, is_text: str, out: str) -> DataFrame:
    """forward_fill() of a header row that doesn't carry a value from a text column into a numeric one; such cells stay blank."""
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.trim(value) != "", F.struct(F.col(value).alias("v"), F.col(is_text).alias("t"))), ignorenulls=True).over(w)
    return df.withColumn(out, F.when(last["t"] & ~F.col(is_text), F.lit("")).otherwise(F.coalesce(last["v"], F.lit(""))))


def zebra(rows: DataFrame, part: list[str], order: str, color: str) -> DataFrame:
    """(part, changes, colors, is_zebra): two colours with four changes or more."""
    w = Window.partitionBy(*part).orderBy(order)
    marked = rows.withColumn("change", (F.col(color) != F.lag(color).over(w)).cast("int"))
    out = marked.groupBy(*part).agg(F.coalesce(F.sum("change"), F.lit(0)).alias("changes"), F.countDistinct(color).alias("colors"))
    return out.withColumn("is_zebra", (F.col("changes") >= 4) & (F.col("colors") == 2))


def header_length(rows: DataFrame, table: str, row: str, cells: str) -> DataFrame:
    """(table, header_rows): rows before the first one with a date or number cell; 0 if there is none."""
    first = F.min(F.when(F.exists(F.transform(cells, cell_type), lambda t: t != "string"), F.col(row)))
    return rows.groupBy(table).agg(F.coalesce(first, F.lit(0)).alias("header_rows"))


def region_of_row(rows: DataFrame, table: str, row: str, label: str) -> DataFrame:
    """Rows with the last section label above them (the range join of rows and sections)."""
    w = Window.partitionBy(table).orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.last(label, ignorenulls=True).over(w))


def shape_lines(shapes: DataFrame, page_width: Column | float) -> DataFrame:
    """(page, is_grid, separators) from lines (kind h or v, length, width)."""
    mid = F.percentile(F.when(F.col("kind") == "h", F.col("width")), 0.5)
    w = shapes.groupBy("page").agg(mid.alias("mid"))
    j = shapes.join(w, "page")
    return j.groupBy("page").agg(
        ((F.count_if(F.col("kind") == "h") >= 3) & (F.count_if(F.col("kind") == "v") >= 3)).alias("is_grid"),
        F.count_if((F.col("kind") == "h") & (F.col("length") > 0.8 * col(page_width) if isinstance(page_width, str) else F.col("length") > 0.8 * page_width) & (F.col("width") >= 1.5 * F.col("mid"))).alias("separators"),
    )
