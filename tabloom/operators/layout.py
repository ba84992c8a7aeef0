"""Page layout from positioned spans: text grids, split spans, regions, drawings and font verdicts.

A page is the unit of work everywhere: windows and joins are keyed by it, so no task holds more than its own pages.
"""

from __future__ import annotations

from functools import reduce
from itertools import groupby
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import font_family
from . import grid as G

PAGE = ["doc", "page_no"]


def page_layout(spans: DataFrame, row_gap: float = 2.0, part: list[str] = PAGE) -> DataFrame:
    """Spans (x, y, width, text) with `row`, `col` and `cell_w`; blank and null texts are dropped.

    `cell_w` is the page's median width of a character over texts of two or more (6 if there are none). Rows are runs of
    distinct y whose neighbours are at most `row_gap` apart; columns count cells from the least x, halves to even.
    """
    known = reduce(and_, (F.col(c).isNotNull() for c in part))
    kept = spans.where("trim(text) <> ''").where(known).withColumn("tb_cell", F.when(F.length("text") >= 2, F.col("width") / F.length("text")))
    rows = G.islands(kept, part, "y", row_gap, "row").withColumn("row", F.col("row").cast("int"))  # one sort of a page's spans serves all windows
    page = Window.partitionBy(*part)
    out = rows.withColumns({"cell_w": F.coalesce(F.median("tb_cell").over(page), F.lit(6.0)), "x_min": F.min("x").over(page)}).where("y is not null")
    return out.withColumn("col", F.bround((F.col("x") - F.col("x_min")) / F.col("cell_w")).cast("int")).drop("x_min", "tb_cell")


def column_tolerance(cell_w: Column | str) -> Column:
    """Cells within which two positions are one column: 1.5 cell widths, three at least."""
    return F.greatest(F.lit(3), F.bround(F.lit(1.5) * cell_w if isinstance(cell_w, Column) else F.lit(1.5) * F.col(cell_w)).cast("int"))


def split_merged(spans: DataFrame, min_gap: int = 5, part: list[str] = PAGE) -> DataFrame:
    """(part, row, col, text) with spans cut where only other rows start a column inside them, beside a space.

    The join is by page on distinct column starts (at most a page's width of them), and only starts inside a span are kept.
    """
    s = spans.select(*part, "row", "col", "text").withColumn("span", F.monotonically_increasing_id())
    starts = spans.select(*part, "row", "col").distinct().groupBy(*part, F.col("col").alias("at")).agg(F.collect_set("row").alias("owners"))
    cut = F.col("at") - F.col("col")
    beside = (F.substring("text", cut, F.lit(1)) == " ") | (F.substring("text", cut + 1, F.lit(1)) == " ")
    inside = s.join(starts, part).where((cut > min_gap) & (cut < F.length("text")) & ~F.array_contains("owners", F.col("row")) & beside)
    cuts = inside.groupBy("span").agg(F.array_sort(F.collect_list(cut)).alias("cuts"))
    none = F.array().cast("array<int>")
    got = s.join(cuts, "span", "left").withColumn("a", F.concat(F.array(F.lit(0)), F.coalesce("cuts", none)))
    got = got.withColumn("b", F.concat(F.coalesce("cuts", none), F.array(F.length("text"))))
    piece = got.select(*part, "row", "col", "text", F.posexplode(F.arrays_zip("a", "b")).alias("i", "p"))
    raw = F.substring(F.col("text"), F.col("p.a") + 1, F.col("p.b") - F.col("p.a"))
    cutout = F.when(F.col("i") == 0, F.rtrim(raw)).otherwise(F.trim(raw))
    lead = F.when(F.col("i") == 0, 0).otherwise(F.length(raw) - F.length(F.ltrim(raw)))
    whole = (F.col("i") == 0) & (F.col("p.b") == F.length("text"))
    out = piece.select(*part, "row", (F.col("col") + F.col("p.a") + lead).alias("col"), F.when(whole, F.col("text")).otherwise(cutout).alias("text"))
    return out.where("text <> ''")


def render_text(spans: DataFrame, part: list[str] = PAGE) -> DataFrame:
    """(part, text): spans painted at their columns in order of (row, ord), a later one over an earlier, lines right-stripped."""

    @F.pandas_udf("string")
    def paint(cells: pd.Series) -> pd.Series:
        return pd.Series([_paint(c) for c in cells], dtype=object)

    ordered = F.array_sort(F.collect_list(F.struct("row", "ord", "col", "text")))
    return spans.groupBy(*part).agg(ordered.alias("cells")).select(*part, paint("cells").alias("text"))


def _paint(cells) -> str:
    lines: dict[int, list[str]] = {}
    for c in cells:
        line = lines.setdefault(c["row"], [])
        end = c["col"] + len(c["text"])
        line.extend(" " * (end - len(line)))
        line[c["col"] : end] = c["text"]
    return "\n".join("".join(lines.get(r, ())).rstrip() for r in range(max(lines) + 1)) if lines else ""


def to_grid(spans: DataFrame, columns: DataFrame, part: list[str] = PAGE) -> DataFrame:
    """(part, row, column_start, text): each span in its nearest column, texts of one cell joined by a space from the left."""
    near = G.nearest_column(spans.select(*part, "row", "col", "text"), columns, part, "col", "start", 0)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda s: s["text"]), " ")
    return near.groupBy(*part, "row", "column_start").agg(text.alias("text"))


def side_by_side(columns: DataFrame, part: list[str] = PAGE, start: str = "start") -> DataFrame:
    """Columns with `grid`: a new grid begins after a gap of more than three times the upper median gap (20 for one column)."""
    w = Window.partitionBy(*part).orderBy(start)
    gaps = columns.withColumn("gap", F.col(start) - F.lag(start).over(w))
    mid = G.upper_median(gaps.where("gap is not null"), part, "gap", "mid")
    j = gaps.join(mid, part, "left").withColumn("cut", (F.col("gap") > 3.0 * F.coalesce("mid", F.lit(20.0))).cast("int"))
    return j.withColumn("grid", F.coalesce(F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))).drop("gap", "mid", "cut")


def transposed(spans: DataFrame, n_columns: DataFrame | None = None, tolerance: int = 3, part: list[str] = PAGE) -> DataFrame:
    """(part, is_transposed): three rows or more, five columns at most, even span counts, a first column that stays at the left.

    `n_columns` has each page's number of columns; without it that of its distinct `col` counts. Windows do it all: their sorts spill, where tables of
    all rows of a task's pages, partial and final ones of each aggregate, stay in memory side by side.
    """
    page, row = Window.partitionBy(*part), Window.partitionBy(*part, "row")
    before = F.lag("col").over(page.orderBy("col"))
    s = spans.select(*part, "row", "col", *([(F.col("col").isNotNull() & (before.isNull() | (before != F.col("col")))).alias("new")] if n_columns is None else []))
    s = s.withColumns({"lead": F.row_number().over(row.orderBy("row")) == 1, "n": F.count(F.lit(1)).over(row), "first": F.min("col").over(row)})
    of_rows = {"rows": F.count("n"), "spread": F.var_pop("n"), "left": F.avg((F.col("first") <= tolerance).cast("int")), "top": F.min("row")}
    s = s.withColumns({"n": F.when(F.col("lead"), F.col("n")), "first": F.when(F.col("lead"), F.col("first"))})
    if n_columns is None:
        of_rows["n_columns"] = F.count_if("new")
    stats = s.withColumns({k: v.over(page) for k, v in of_rows.items()}).where(F.col("lead") & F.col("row").eqNullSafe(F.col("top")))
    ok = (F.col("rows") >= 3) & (F.col("n_columns") <= 5) & (F.col("spread") <= 2.0) & (F.col("left") >= 0.8)
    return (stats if n_columns is None else stats.join(n_columns, part)).select(*part, ok.alias("is_transposed"))


#: Periods of records that take several rows, in the order tried, and the most header rows before them.
PERIODS, MOST_HEADERS = (3, 2, 4), 10


def row_period(counts: Column | str) -> Column:
    """struct(header, period) of records that take several rows each, from an array of span counts; null without one.

    Every pair of a period and a header length (half the rows at most) is a candidate; the first holds for which two groups of rows or more
    follow, 70 % of them equal to the first one, which isn't all of one count.
    """
    c = F.col(counts) if isinstance(counts, str) else counts
    tried = F.array(*[F.struct(F.lit(h).alias("header"), F.lit(p).alias("period")) for p in PERIODS for h in range(MOST_HEADERS + 1)])

    def fits(x: Column) -> Column:
        n = F.floor((F.size(c) - x["header"]) / x["period"]).cast("int")
        group = lambda g: F.slice(c, x["header"] + g * x["period"] + 1, x["period"])
        equal = F.size(F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda g: group(g) == group(F.lit(0))))
        return (2 * x["header"] <= F.size(c)) & (n >= 2) & (F.size(F.array_distinct(group(F.lit(0)))) > 1) & (equal >= 0.7 * n)

    return F.get(F.filter(tried, fits), F.lit(0))


def merge_periods(spans: DataFrame, periods: DataFrame, part: list[str] = PAGE) -> DataFrame:
    """Spans (row from 0) of records over several rows as spans of one row each, texts at a column joined by a blank from the top; header rows stay.

    `periods` is (part, header, period); parts without one pass as they are.
    """
    j = spans.join(periods, part, "left")
    group = F.when(F.col("row") < F.col("header"), F.col("row")).otherwise(F.col("header") + F.floor((F.col("row") - F.col("header")) / F.col("period")))
    j = j.withColumn("tb_group", F.coalesce(group, F.col("row")).cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "text"))), lambda s: s["text"]), " ")
    return j.groupBy(*part, F.col("tb_group").alias("row"), "col").agg(text.alias("text"))


def split_grids(cells: DataFrame, grids: DataFrame, part: list[str] = PAGE) -> DataFrame:
    """Cells of a grid (row, column_start, text) with `grid` and `col_idx` in it, of the grids of side_by_side(); grids without a filled cell are dropped and the others numbered anew."""
    w = Window.partitionBy(*part, "grid").orderBy("start")
    placed = cells.join(grids.withColumn("col_idx", F.row_number().over(w) - 1).withColumnRenamed("start", "column_start"), [*part, "column_start"])
    filled = placed.where(F.trim("text") != "").select(*part, "grid").distinct()
    kept = filled.withColumn("tb_no", F.row_number().over(Window.partitionBy(*part).orderBy("grid")) - 1)
    return placed.join(kept, [*part, "grid"]).drop("grid").withColumnRenamed("tb_no", "grid")


def twin_columns(cells: DataFrame, part: list[str] = PAGE) -> DataFrame:
    """(part, left, right): neighbouring columns that are never both filled in a row."""
    filled = cells.where(F.trim("text") != "")
    cols = filled.groupBy(*part, "col_idx").agg(F.count("*").alias("n"))
    pair = cols.select(*part, F.col("col_idx").alias("left"), (F.col("col_idx") + 1).alias("right")).join(cols.select(*part, F.col("col_idx").alias("right")), [*part, "right"])
    both = filled.select(*part, "row", F.col("col_idx").alias("left")).join(filled.select(*part, "row", (F.col("col_idx") - 1).alias("left")), [*part, "row", "left"])
    return pair.join(both.select(*part, "left").distinct(), [*part, "left"], "left_anti").select(*part, "left", "right")


def header_verdict(visual: Column, textual: Column, by_type: Column) -> Column:
    """Header rows agreed on: what drawings and texts both say, else the one that the type pattern confirms, else the texts'; drawings of none don't count."""
    v, t, k = visual, textual, by_type
    return F.when(F.coalesce(v, F.lit(0)) == 0, t).when(v == t, t).when(v == k, v).otherwise(t)


def regions(spans: DataFrame, tolerance: int = 3, min_rows: int = 3, part: list[str] = PAGE) -> DataFrame:
    """(part, region, kind, first_row, last_row, n_rows), kinds table, kv, heading, text and scattered.

    A table is a run of rows with two spans or more in which each row shares two column starts (within the tolerance) with the
    run so far. Of the other rows, neighbours at most two apart make label-value runs, headings (one span under 80
    characters, not followed at once by a long line) or text runs; what is left is scattered.
    """
    found = "array<struct<region:int, kind:string, first_row:int, last_row:int, n_rows:int>>"

    @F.pandas_udf(found)
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([_region_rows(cells, tolerance, min_rows) for cells in pages], dtype=object)

    cells = F.array_sort(F.collect_list(F.struct("row", "col", "text")))
    return spans.groupBy(*part).agg(cells.alias("cells")).select(*part, F.inline(run("cells")))


def _region_rows(cells, tolerance: int, min_rows: int) -> list[dict]:
    rows: dict[int, list[tuple[int, str]]] = {}
    for c in cells:
        rows.setdefault(c["row"], []).append((c["col"], c["text"]))
    return [{"region": i, "kind": k, "first_row": rs[0], "last_row": rs[-1], "n_rows": len(rs)} for i, (k, rs) in enumerate(page_regions(rows, tolerance, min_rows))]


def page_regions(rows: dict[int, list[tuple[int, str]]], tolerance: int = 3, min_rows: int = 3) -> list[tuple[str, list[int]]]:
    """The regions of one page as (kind, rows), by first row."""
    out = [("table", run) for run in _table_runs(rows, tolerance) if len(run) >= min_rows]
    taken = {r for _, run in out for r in run}
    rest = [r for r in sorted(rows) if r not in taken]
    at = 0
    while at < len(rest):
        n = len(rows[rest[at]])
        if n == 2 and len(run := _near(rest, at, rows, (1, 2))) >= 2:
            kind = "kv"
        elif n == 1:
            text = rows[rest[at]][0][1]
            follow = _near(rest, at, rows, (1,))
            goes_on = len(follow) > 1 and len(rows[follow[1]][0][1]) > 40
            kind, run = ("heading", rest[at : at + 1]) if len(text) < 80 and not goes_on else ("text", follow)
        else:
            kind, run = "scattered", rest[at : at + 1]
        out.append((kind, run))
        at += len(run)
    return sorted(out, key=lambda r: r[1][0])


def _near(rest: list[int], at: int, rows: dict, sizes: tuple[int, ...]) -> list[int]:
    """The run from `at` of rows at most two apart whose span counts are among `sizes`."""
    end = at + 1
    while end < len(rest) and rest[end] - rest[end - 1] <= 2 and len(rows[rest[end]]) in sizes:
        end += 1
    return rest[at:end]


def _table_runs(rows: dict[int, list[tuple[int, str]]], tolerance: int) -> list[list[int]]:
    runs: list[list[int]] = []
    pool: list[int] = []
    for wide, some in groupby(sorted(rows), lambda r: len(rows[r]) >= 2):
        if not wide:
            pool = []
            continue
        for r in some:
            starts = [c for c, _ in rows[r]]
            shared = sum(any(abs(c - p) <= tolerance for p in pool) for c in starts)
            if shared >= 2 and r - runs[-1][-1] <= 2:
                runs[-1].append(r)
                pool += [c for c in starts if all(abs(c - p) > tolerance for p in pool)]
            else:
                runs.append([r])
                pool = list(starts)
    return runs


# --- drawings and fonts ---------------------------------------------------------------------


def classify_drawings(shapes: DataFrame) -> DataFrame:
    """Drawings (type s or f, x0, y0, x1, y1, stroke) with `kind` h, v or fill, `length` and `width`.

    Strokes are lines along their longer side; fills thinner than 2 points and over five times as long are lines too.
    """
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    stroke = F.col("type") == "s"
    thin_h, thin_v = (h < 2) & (w > 5 * h), (w < 2) & (h > 5 * w)
    kind = F.when(stroke, F.when(w > h, "h").otherwise("v")).when(thin_h, "h").when(thin_v, "v").otherwise("fill")
    out = shapes.withColumn("kind", kind)
    out = out.withColumn("length", F.when(F.col("kind") == "h", w).when(F.col("kind") == "v", h))
    return out.withColumn("width", F.when(stroke, F.coalesce("stroke", F.lit(1.0))).when(F.col("kind") == "h", h).when(F.col("kind") == "v", w))


def decode_fonts(spans: DataFrame) -> DataFrame:
    """Spans (font, flags, color) with is_bold, is_italic, is_mono and rgb (0 to 1; null for black and null)."""
    name = F.lower(F.coalesce("font", F.lit("")))
    bit = lambda mask: F.coalesce(F.col("flags").bitwiseAND(mask) != 0, F.lit(False))
    part = lambda by: F.shiftright("color", by).bitwiseAND(255) / 255.0
    return spans.withColumns(
        {
            "is_bold": bit(0x10) | name.rlike("bold|black|heavy"),
            "is_italic": bit(0x01) | name.rlike("italic|oblique"),
            "is_mono": bit(0x20) | name.rlike("mono|courier|consolas|menlo"),
            "rgb": F.when(F.col("color") != 0, F.struct(part(16).alias("r"), part(8).alias("g"), part(0).alias("b"))),
        }
    )


def size_tiers(spans: DataFrame, part: list[str] = PAGE) -> DataFrame:
    """(part, tiers): means of font size tiers, largest first; a size over 20 % below a tier's running mean opens the next."""
    start = F.array(F.array().cast("array<double>"))
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v) / F.size(c)

    def step(acc, size):
        last = F.element_at(acc, -1)
        joins = (F.size(last) == 0) | ((mean(last) - size) / mean(last) <= 0.2)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last, F.array(size))))
        return F.when(joins, grown).otherwise(F.concat(acc, F.array(F.array(size))))

    sizes = F.sort_array(F.collect_set(F.col("size").cast("double")), asc=False)
    out = spans.where("size is not null").groupBy(*part).agg(sizes.alias("sizes"))
    return out.select(*part, F.transform(F.aggregate("sizes", start, step), mean).alias("tiers"))


def font_verdicts(spans: DataFrame, part: list[str] = PAGE) -> DataFrame:
    """One row for each page of decoded spans (zone `header` or `data`, row, col): bold and mono ratios and the rows and columns they mark."""
    ratio = lambda flag, zone: F.coalesce(F.avg(F.when(F.col("zone") == zone, F.col(flag).cast("int"))), F.lit(0.0))
    exception = (F.col("rgb.r") > 0.6) & (F.col("rgb.g") < 0.5) & (F.col("rgb.b") < 0.3)
    page = spans.groupBy(*part).agg(
        ratio("is_bold", "header").alias("header_bold"), ratio("is_bold", "data").alias("data_bold"),
        F.avg(F.col("is_mono").cast("int")).alias("mono_ratio"), F.count_if(exception).alias("exception_spans"),
    )
    share = lambda flag: F.avg(F.col(flag).cast("int"))
    listed = lambda ok, c: F.sort_array(F.collect_list(F.when(ok, F.col(c))))
    by_row = spans.groupBy(*part, "row").agg(share("is_bold").alias("b"), share("is_italic").alias("i"))
    by_row = by_row.groupBy(*part).agg(listed(F.col("b") > 0.5, "row").alias("bold_rows"), listed(F.col("i") > 0.8, "row").alias("italic_rows"))
    by_col = spans.groupBy(*part, "col").agg(share("is_mono").alias("m"), F.countDistinct(font_family("font")).alias("f"))
    by_col = by_col.groupBy(*part).agg(listed(F.col("m") > 0.5, "col").alias("mono_columns"), listed(F.col("f") > 2, "col").alias("mixed_columns"))
    return page.join(by_row, part).join(by_col, part)
