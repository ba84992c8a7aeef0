"""Workbooks end to end: cells with styles, merges and hidden rows from bytes, then tables by the rules of operators.sheets.

Reading is done on the executors, a file at a time; the rules are aggregates and windows keyed by the table, so many
workbooks take one plan.
"""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grid as G
from ..operators import rows as R
from ..operators import sheets as X
from ..session import cut

CELLS = "path string, sheet_idx int, sheet string, kind string, row int, col int, text string, bold boolean, fill string, format string, r1 int, c1 int"
#: Built-in number formats of dates, and the day that serial 0 stands for.
DATE_FORMATS = {14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 22: "m/d/yy h:mm"}
DAY_ZERO = datetime.datetime(1899, 12, 30)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _place(ref: str) -> tuple[int, int]:
    letters, digits = re.match(r"([A-Z]*)(\d*)", ref).groups()
    col = 0
    for c in letters:
        col = col * 26 + ord(c) - 64
    return int(digits or 1) - 1, col - 1


def _styles(z: zipfile.ZipFile) -> list[tuple[bool, str | None, str | None]]:
    """(bold, fill, number format) of each cell style."""
    if "xl/styles.xml" not in z.namelist():
        return []
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    part = {_local(e.tag): e for e in root}
    formats = {int(e.get("numFmtId")): e.get("formatCode") for e in part.get("numFmts", ())}
    fonts = [any(_local(x.tag) == "b" and x.get("val", "1") not in ("0", "false") for x in e) for e in part.get("fonts", ())]
    fills = []
    for e in part.get("fills", ()):
        solid = next((x for x in e if _local(x.tag) == "patternFill" and x.get("patternType") == "solid"), None)
        fg = next((x for x in solid if _local(x.tag) == "fgColor"), None) if solid is not None else None
        fills.append(None if fg is None else fg.get("rgb") or f"theme{fg.get('theme')}{fg.get('tint', '')}")
    out = []
    for xf in part.get("cellXfs", ()):
        font, fill, number = (int(xf.get(k, 0)) for k in ("fontId", "fillId", "numFmtId"))
        out.append((font < len(fonts) and fonts[font], fills[fill] if fill < len(fills) else None, formats.get(number) or DATE_FORMATS.get(number) or ("0%" if number in (9, 10) else None)))
    return out


def _is_date(code: str | None) -> bool:
    bare = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", (code or "").lower())
    return bool(re.search(r"y|d", bare)) and "general" not in bare


def _date(serial: str) -> str:
    at = DAY_ZERO + datetime.timedelta(days=float(serial))
    at = (at + datetime.timedelta(microseconds=500_000)).replace(microsecond=0)
    return at.strftime("%Y-%m-%d") if at.time() == datetime.time() else at.strftime("%Y-%m-%d %H:%M:%S")


def workbook(data: bytes) -> Iterator[tuple]:
    """Rows of CELLS but the path, of kinds cell, merge (to r1, c1), hidden_row and hidden_col (to c1); sheets in the workbook's order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        styles = _styles(z)
        targets = {}
        if "xl/_rels/workbook.xml.rels" in names:
            targets = {e.get("Id"): "xl/" + e.get("Target").removeprefix("/xl/") for e in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        listed = [(e.get("name"), targets.get(next((v for k, v in e.attrib.items() if _local(k) == "id"), ""))) for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(e.tag) == "sheet"] if "xl/workbook.xml" in names else []
        found = [(n, t) for n, t in listed if t in names] or [(t.rpartition("/")[2].removesuffix(".xml"), t) for t in sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))]
        for s, (title, name) in enumerate(found):
            for e in ElementTree.fromstring(z.read(name)).iter():
                tag = _local(e.tag)
                if tag == "col" and e.get("hidden") == "1":
                    yield s, title, "hidden_col", None, int(e.get("min")) - 1, None, None, None, None, None, int(e.get("max")) - 1
                elif tag == "row" and e.get("hidden") == "1":
                    yield s, title, "hidden_row", int(e.get("r")) - 1, None, None, None, None, None, None, None
                elif tag == "mergeCell":
                    a, _, b = e.get("ref").partition(":")
                    yield s, title, "merge", *_place(a), None, None, None, None, *_place(b or a)
                elif tag == "c":
                    kind = e.get("t")
                    text = "".join(t.text or "" for t in e.iter() if _local(t.tag) in (("t",) if kind == "inlineStr" else ("v",)))
                    bold, fill, code = styles[int(e.get("s", 0))] if int(e.get("s", 0)) < len(styles) else (False, None, None)
                    if kind == "s" and text:
                        text = shared[int(text)]
                    elif kind == "b":
                        text = "TRUE" if text == "1" else "FALSE"
                    elif kind in (None, "n") and text and _is_date(code):
                        text = _date(text)
                    if text or fill:
                        yield s, title, "cell", *_place(e.get("r", "A1")), text, bold, fill, code, None, None


def read_workbooks(spark: SparkSession, path: str, sheets: list[str | int] | None = None) -> DataFrame:
    """CELLS of the .xlsx and .xlsm files under `path`, of all sheets or those named or numbered; files that can't be read give nothing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("lower(path) rlike '[.]xls[xm]$'").select("path", "content")
    names = [c.split()[0] for c in CELLS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, data in zip(batch["path"], batch["content"], strict=True):
                try:
                    got = [(p, *r) for r in workbook(bytes(data))]
                except (zipfile.BadZipFile, KeyError, ValueError, ElementTree.ParseError):
                    got = []
                frame = pd.DataFrame(got, columns=names)
                yield frame.astype({"sheet_idx": "int32", "row": "Int32", "col": "Int32", "r1": "Int32", "c1": "Int32", "bold": "boolean"})

    out = files.mapInPandas(run, CELLS)
    if sheets is None:
        return out
    return out.where(F.col("sheet").isin([s for s in sheets if isinstance(s, str)]) | F.col("sheet_idx").isin([s for s in sheets if isinstance(s, int)]))


BOOK = ["path", "sheet_idx"]
TABLE = [*BOOK, "region"]


def _data_like(counts):
    """Rows before the first one filled like the rows below: by the three most frequent counts (two or more, seen twice or more) of the lower two thirds, or fuller; 0 if there is none."""
    n = F.size(counts)
    bottom = F.slice(counts, F.greatest(F.lit(1), F.floor(n / 3).cast("int")) + 1, n)
    times = lambda v: F.size(F.filter(bottom, lambda x: x == v))
    ranked = F.array_sort(F.transform(F.array_distinct(bottom), lambda v, i: F.struct((-times(v)).alias("t"), i.alias("i"), v.alias("v"))))
    usual = F.transform(F.filter(F.slice(ranked, 1, 3), lambda x: (x["v"] >= 2) & (x["t"] <= -2)), lambda x: x["v"])
    like = F.transform(counts, lambda c: F.array_contains(usual, c) | (c > F.array_max(usual)))
    return F.when((n > 2) & (F.size(usual) > 0), F.greatest(F.array_position(like, True).cast("int") - 1, F.lit(0))).otherwise(F.lit(0))


def sheet_tables(book: DataFrame, hidden: bool = False) -> DataFrame:
    """(path, sheet_idx, table_idx, title, notes, headers, row_idx, cells) of the tables of workbooks (CELLS).

    Regions split at two blank rows or columns; hidden rows and columns go, unless `hidden`; merges keep their first cell; edge columns of
    notes are trimmed; header rows are voted on by fills, merges, types and fill counts; a note block and a title above the
    headers are taken off; header levels are filled to the right and joined; trailing footnotes, a bold last total and blank rows go.
    """
    cells = book.where("kind = 'cell'").select(*BOOK, "row", "col", "text", F.coalesce("bold", F.lit(False)).alias("bold"), "fill")
    merges = book.where("kind = 'merge'").select(*BOOK, F.col("row").alias("r0"), F.col("col").alias("c0"), "r1", "c1")
    off = book.where("kind in ('hidden_row', 'hidden_col')")
    off = off.groupBy(*BOOK).agg(F.collect_set(F.when(F.col("kind") == "hidden_row", F.col("row"))).alias("hr"), F.array_distinct(F.flatten(F.collect_list(F.when(F.col("kind") == "hidden_col", F.sequence("col", "c1"))))).alias("hc"))
    whole = cut(X.expand_merges(cells, merges, BOOK))
    bounds = X.regions(whole, BOOK).groupBy(*TABLE).agg(*[f(c).alias(n) for f, c, n in ((F.min, "row", "top"), (F.max, "row", "bottom"), (F.min, "col", "left"), (F.max, "col", "right"))])
    none = F.array().cast("array<int>")
    bounds = cut(bounds.join(off, BOOK, "left").withColumns({c: none if hidden else F.coalesce(c, none) for c in ("hr", "hc")}))
    gone = lambda of, lo, hi: F.size(F.filter(of, lambda h: (h >= F.col(lo)) & (h < hi)))

    def placed(df: DataFrame) -> DataFrame:
        """Rows and columns counted within the table, hidden ones left out."""
        j = df.join(bounds, BOOK).where("row between top and bottom and col between left and right and not array_contains(hr, row) and not array_contains(hc, col)")
        return j.withColumns({"row": (F.col("row") - F.col("top") - gone("hr", "top", F.col("row"))).cast("int"), "col": (F.col("col") - F.col("left") - gone("hc", "left", F.col("col"))).cast("int")}).drop("top", "bottom", "left", "right", "hr", "hc")

    inside = cut(placed(whole))
    size = bounds.select(*TABLE, (F.col("bottom") - F.col("top") + 1 - gone("hr", "top", F.col("bottom") + 1)).cast("int").alias("height"), (F.col("right") - F.col("left") + 1 - gone("hc", "left", F.col("right") + 1)).cast("int").alias("width"), F.lit(1).alias("header_rows"))
    size = size.where("height > 0 and width > 0")
    edges = cut(X.edge_bounds(inside, size, TABLE))
    trim = lambda df: df.join(edges, TABLE).where("col >= first_col and col < end_col").withColumn("col", F.col("col") - F.col("first_col")).drop("first_col", "end_col")
    inside = cut(trim(inside))
    size = size.drop("header_rows", "width").join(edges.select(*TABLE, (F.col("end_col") - F.col("first_col")).alias("width")), TABLE)

    # the header votes
    dense = size.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
    by_row = inside.groupBy(*TABLE, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", F.coalesce("text", F.lit("")).alias("text")))).alias("m"), F.min_by("fill", "col").alias("fill"))
    grid = dense.join(by_row, [*TABLE, "row"], "left")
    at = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda c: F.coalesce(F.try_element_at("m", c), F.lit("")))
    grid = grid.withColumn("cells", F.when(F.col("m").isNull(), F.array_repeat(F.lit(""), F.col("width"))).otherwise(at))
    filled = F.size(F.filter("cells", lambda c: F.trim(c) != ""))
    per = grid.groupBy(*TABLE).agg(F.array_sort(F.collect_list(F.struct("row", filled.alias("n"), R.is_text_row("cells").alias("texts"), F.col("fill").alias("fill")))).alias("g"))
    lead = lambda ok: F.coalesce(F.array_min(F.transform(F.filter("g", lambda x: ~ok(x)), lambda x: x["row"])), F.size("g"))
    top = F.slice("g", 1, 5)
    same = F.size(F.filter(top, lambda x: x["fill"] == F.col("g")[0]["fill"]))
    fills = F.when(F.col("g")[0]["fill"].isNull() | (same == F.size(top)), F.lit(0)).otherwise(F.least(lead(lambda x: F.coalesce(x["fill"] == F.col("g")[0]["fill"], F.lit(False))), F.lit(5)))
    votes = per.select(*TABLE, fills.cast("int").alias("fills"), lead(lambda x: x["texts"]).alias("types"), _data_like(F.transform("g", lambda x: x["n"])).alias("spans"), F.size("g").alias("n"))
    across = placed(merges.where("c1 > c0").select(*BOOK, F.col("r0").alias("row"), F.col("c0").alias("col"))).select(*TABLE, "row")
    votes = votes.join(X.merge_header_rows(across, TABLE).withColumnRenamed("header_rows", "merges"), TABLE, "left")
    # a table of texts alone has one header row
    votes = votes.withColumn("types", F.when(F.col("types") >= F.col("n"), F.lit(1)).otherwise(F.col("types")))
    size = cut(size.join(votes.select(*TABLE, F.least(X.header_votes(votes), F.col("n")).alias("header_rows")), TABLE))

    # what stands above the headers
    notes = X.annotation_block(inside, size, TABLE)
    lifted = size.join(notes, TABLE, "left").withColumn("skip", F.coalesce(F.col("blank_row") + 1, F.lit(0)))
    lifted = cut(lifted.select(*TABLE, "width", "skip", F.coalesce("lines", F.array().cast("array<string>")).alias("notes"), F.greatest(F.col("header_rows") - F.col("skip"), F.lit(1)).alias("header_rows")))
    below = inside.join(lifted.select(*TABLE, "skip"), TABLE).where("row >= skip").withColumn("row", F.col("row") - F.col("skip")).drop("skip")
    below = cut(below)
    titled = lifted.drop("skip").join(X.title_row(below, lifted.select(*TABLE, "header_rows"), TABLE), TABLE, "left")
    head = cut(titled.select(*TABLE, "width", "title", "notes", F.when(F.col("title").isNotNull(), 1).otherwise(0).alias("first"), "header_rows"))
    below = below.join(head.select(*TABLE, "first", "header_rows"), TABLE).where("row >= first")

    # headers: filled to the right, then joined over their levels
    levels = head.withColumn("row", F.explode(F.sequence("first", F.col("header_rows") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("width") - 1))).select(*TABLE, "row", "col")
    texts = levels.join(below.select(*TABLE, "row", "col", "text"), [*TABLE, "row", "col"], "left")
    full = G.forward_fill(texts.withColumn("text", F.coalesce("text", F.lit(""))), [*TABLE, "row"], "col", "text", "filled").withColumn("text", F.coalesce("filled", F.lit("")))
    joined = G.compound_headers(full.withColumn("t", F.struct(*TABLE)), "t", "row", "col", "text").groupBy("t").agg(F.map_from_entries(F.collect_list(F.struct("col", "header"))).alias("h")).select("t.*", "h")
    named = head.join(cut(joined), TABLE, "left").withColumn("headers", F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda c: F.coalesce(F.try_element_at("h", c), F.lit(""))))

    # data: without footnotes, totals and blank rows
    data = below.where("row >= header_rows").drop("first", "header_rows")
    data = X.drop_totals(X.strip_footnotes(data, head.select(*TABLE, "width"), TABLE), TABLE).where(F.trim("text") != "")
    by_row = data.groupBy(*TABLE, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("m"))
    rows = by_row.join(named.select(*TABLE, "width", "title", "notes", "headers"), TABLE)
    cells_of = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda c: F.coalesce(F.try_element_at("m", c), F.lit("")))
    return rows.select(*BOOK, F.col("region").alias("table_idx"), "title", "notes", "headers", F.col("row").alias("row_idx"), cells_of.alias("cells"))


def read_xlsx_tables(spark: SparkSession, path: str, sheets: list[str | int] | None = None, hidden: bool = False) -> DataFrame:
    """The tables of the workbooks under `path`, as sheet_tables(); the files are read once."""
    return sheet_tables(cut(read_workbooks(spark, path, sheets)), hidden)
