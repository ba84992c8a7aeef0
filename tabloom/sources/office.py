"""Tables from spreadsheets, word-processor files, slides and web pages, read from bytes on the executors.

The formats are zip archives of XML (or HTML text); only the standard library is needed. Every reader
gives cells: path, table_idx, row_idx, col_idx, value.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

CELLS = "path string, table_idx int, row_idx int, col_idx int, value string"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx_cells(data: bytes) -> Iterator[tuple[int, int, int, str]]:
    """(sheet, row, column, text); shared and inline strings, numbers as written."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in si.iter() if _local(t.tag) == "t"))
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        for s, name in enumerate(sheets):
            row = -1
            for e in ElementTree.fromstring(z.read(name)).iter():
                if _local(e.tag) == "row":
                    if e.get("hidden") == "1":
                        row = None
                        continue
                    row = int(e.get("r", 0)) - 1
                elif _local(e.tag) == "c" and row is not None:
                    text = "".join(t.text or "" for t in e.iter() if _local(t.tag) in ("v", "t"))
                    if e.get("t") == "s" and text:
                        text = shared[int(text)]
                    if text:
                        yield s, row, _column(e.get("r", "A")), text


def docx_cells(data: bytes) -> Iterator[tuple[int, int, int, str]]:
    """(table, row, column, text); spans leave blanks, continued vertical merges are blank."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    for t, table in enumerate(x for x in root.iter() if _local(x.tag) == "tbl"):
        for r, tr in enumerate(x for x in table if _local(x.tag) == "tr"):
            c = 0
            for tc in (x for x in tr if _local(x.tag) == "tc"):
                span, merged = 1, False
                for e in tc.iter():
                    value = next((v for k, v in e.attrib.items() if _local(k) == "val"), None)
                    if _local(e.tag) == "gridSpan":
                        span = int(value)
                    elif _local(e.tag) == "vMerge" and value != "restart":
                        merged = True
                text = " ".join(s for p in tc.iter() if _local(p.tag) == "p" if (s := "".join(x.text or "" for x in p.iter() if _local(x.tag) == "t").strip()))
                yield t, r, c, "" if merged else text
                for k in range(1, span):
                    yield t, r, c + k, ""
                c += span


def pptx_cells(data: bytes) -> Iterator[tuple[int, int, int, str]]:
    """(table, row, column, text) of the native tables of all slides."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        t = 0
        for name in slides:
            for table in (x for x in ElementTree.fromstring(z.read(name)).iter() if _local(x.tag) == "tbl"):
                for r, tr in enumerate(x for x in table if _local(x.tag) == "tr"):
                    for c, tc in enumerate(x for x in tr if _local(x.tag) == "tc"):
                        yield t, r, c, "" if tc.get("hMerge") == "1" or tc.get("vMerge") == "1" else " ".join(s for p in tc.iter() if _local(p.tag) == "p" if (s := "".join(x.text or "" for x in p.iter() if _local(x.tag) == "t").strip()))
                t += 1


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.cells: list[tuple[int, int, int, str]] = []
        self.n, self.stack = -1, []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "table":
            self.n += 1
            self.stack.append({"t": self.n, "r": -1, "c": 0, "held": {}, "text": None, "span": (1, 1)})
        elif self.stack:
            s = self.stack[-1]
            if tag == "tr":
                s["r"], s["c"] = s["r"] + 1, 0
            elif tag in ("td", "th"):
                num = lambda k: max(1, int(a.get(k) or 1)) if str(a.get(k) or 1).isdigit() else 1
                s["text"], s["span"] = [], (num("rowspan"), num("colspan"))

    def handle_endtag(self, tag):
        if not self.stack:
            return
        s = self.stack[-1]
        if tag == "table":
            self.stack.pop()
        elif tag in ("td", "th") and s["text"] is not None:
            while (s["r"], s["c"]) in s["held"]:
                self.cells.append((s["t"], s["r"], s["c"], ""))
                s["c"] += 1
            rows, cols = s["span"]
            text = " ".join("".join(s["text"]).split())
            for k in range(cols):
                self.cells.append((s["t"], s["r"], s["c"] + k, text if not k else ""))
                for j in range(1, rows):
                    s["held"][s["r"] + j, s["c"] + k] = True
            s["c"] += cols
            s["text"] = None

    def handle_data(self, data):
        if self.stack and self.stack[-1]["text"] is not None:
            self.stack[-1]["text"].append(data)


def html_cells(data: bytes | str) -> Iterator[tuple[int, int, int, str]]:
    """(table, row, column, text); spans expand into blanks."""
    p = _Tables()
    p.feed(data.decode("utf-8", "replace") if isinstance(data, bytes) else data)
    yield from sorted(p.cells)


READERS = {"xlsx": xlsx_cells, "docx": docx_cells, "pptx": pptx_cells, "html": html_cells, "htm": html_cells}


def _rows(key: str, data) -> pd.DataFrame:
    read = READERS.get(key.rsplit(".", 1)[-1].lower())
    try:
        got = list(read(data)) if read else []
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        got = []  # not a readable file of its kind: no tables
    return pd.DataFrame([(key, *g) for g in got], columns=["path", "table_idx", "row_idx", "col_idx", "value"])


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """Cells of all tables in the office and web files under `path`, one task per group of files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches):
        for pdf in batches:
            for p, data in zip(pdf["path"], pdf["content"], strict=True):
                yield _rows(p, bytes(data))

    return files.mapInPandas(run, CELLS)


def html_tables(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Cells of the tables in a column of web pages; `path` is the key as text."""

    def run(batches):
        for pdf in batches:
            for k, h in zip(pdf["k"], pdf["h"], strict=True):
                yield pd.DataFrame([(k, *g) for g in html_cells(h or "")], columns=["path", "table_idx", "row_idx", "col_idx", "value"])

    return pages.selectExpr(f"cast({key} as string) as k", f"{html} as h").mapInPandas(run, CELLS)
