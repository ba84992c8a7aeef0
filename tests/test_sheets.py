"""Workbooks built with the standard library, read and turned into tables."""

import zipfile
from xml.sax.saxutils import escape

import pytest

from tabloom.sources.sheets import read_workbooks, read_xlsx_tables

STYLES = """<styleSheet><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/></numFmts><fonts><font/><font><b/></font></fonts>
<fills><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FFDDDDDD"/></patternFill></fill></fills>
<cellXfs><xf/><xf fontId="1"/><xf fontId="1" fillId="2"/><xf numFmtId="164"/><xf numFmtId="9"/></cellXfs></styleSheet>"""
BOLD, HEAD, DATE = 1, 2, 3


def ref(r, c):
    return f"{chr(65 + c)}{r + 1}"


def book(path, sheets):
    """`sheets`: (name, {(row, col): value or (value, style)}, merges, hidden rows, hidden columns)."""
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", "<workbook xmlns:r='r'><sheets>" + "".join(f"<sheet name='{n}' sheetId='{i + 1}' r:id='r{i}'/>" for i, (n, *_) in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f"<Relationship Id='r{i}' Target='worksheets/s{9 - i}.xml'/>" for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/styles.xml", STYLES)
        for i, (_, cells, merges, rows, cols) in enumerate(sheets):
            out = ["<worksheet>", "<cols>" + "".join(f"<col min='{c + 1}' max='{c + 1}' hidden='1'/>" for c in cols) + "</cols>" if cols else "", "<sheetData>"]
            for r in sorted({k[0] for k in cells} | set(rows)):
                out.append(f"<row r='{r + 1}'" + (" hidden='1'" if r in rows else "") + ">")
                for (rr, c), v in sorted(cells.items()):
                    if rr == r:
                        v, s = v if isinstance(v, tuple) else (v, 0)
                        out.append(f"<c r='{ref(r, c)}' s='{s}'><v>{v}</v></c>" if isinstance(v, int | float) else f"<c r='{ref(r, c)}' s='{s}' t='inlineStr'><is><t>{escape(v)}</t></is></c>")
                out.append("</row>")
            out.append("</sheetData>" + ("<mergeCells>" + "".join(f"<mergeCell ref='{ref(a, b)}:{ref(c, d)}'/>" for a, b, c, d in merges) + "</mergeCells>" if merges else "") + "</worksheet>")
            z.writestr(f"xl/worksheets/s{9 - i}.xml", "".join(out))


def grid(rows, top=0, left=0):
    return {(top + r, left + c): v for r, row in enumerate(rows) for c, v in enumerate(row) if v not in ("", None)}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("books")
    plain = [[("Company", HEAD), ("Founded", HEAD), ("Revenue", HEAD)], ["A", (36526, DATE), 10], ["B", (36527.5, DATE), 20.5], ["", "", ""], ["C", "", 30], [("Total", BOLD), "", 60]]
    wide = [["", "Q1", "", "Q2", ""], ["Dept", "Revenue", "Cost", "Revenue", "Cost"], ["X", 1, 2, 3, 4], ["Y", 5, 6, 7, 8], ["Z", 9, 10, 11, 12]]
    two = grid([["Item", "Count"], ["a", 1], ["b", 2]]) | grid([["Place", "Size", "Kind"], ["p", 3, "x"], ["q", 4, "y"], ["Source: a book", "", ""]], top=6) | grid([["L", "M"], ["l", 5], ["k", 6]], left=4)
    hidden = [["Key", "Secret", "Value"], ["k1", "s", 1], ["k2", "s", 2], ["k3", "s", 3]]
    titled = [["Sales of the year", "", ""], ["Shop", "Kind", "Sum"], ["s1", "x", 1], ["s2", "y", 2], ["s3", "z", 3]]
    book(d / "one.xlsx", [("plain", grid(plain), [], [], []), ("wide", grid(wide), [(0, 1, 0, 2), (0, 3, 0, 4)], [], [])])
    book(d / "two.xlsx", [("two", two, [], [], []), ("hidden", grid(hidden), [], [2], [1]), ("titled", grid(titled), [(0, 0, 0, 2)], [], []), ("none", {}, [], [], [])])
    (d / "bad.xlsx").write_bytes(b"no zip")
    out = {}
    for r in read_xlsx_tables(spark, str(d)).orderBy("path", "sheet_idx", "table_idx", "row_idx").collect():
        out.setdefault((r["path"].rpartition("/")[2], r["sheet_idx"], r["table_idx"]), []).append(r)
    names = {(r["path"].rpartition("/")[2], r["sheet_idx"]): r["sheet"] for r in read_workbooks(spark, str(d)).select("path", "sheet_idx", "sheet").distinct().collect()}
    return out, names, str(d)


def test_a_plain_sheet(tables):
    rows = tables[0]["one.xlsx", 0, 0]
    assert rows[0]["headers"] == ["Company", "Founded", "Revenue"] and rows[0]["title"] is None
    assert [r["cells"] for r in rows] == [["A", "2000-01-01", "10"], ["B", "2000-01-02 12:00:00", "20.5"], ["C", "", "30"]]
    assert tables[1] == {("one.xlsx", 0): "plain", ("one.xlsx", 1): "wide", ("two.xlsx", 0): "two", ("two.xlsx", 1): "hidden", ("two.xlsx", 2): "titled"}


def test_headers_of_two_levels(tables):
    rows = tables[0]["one.xlsx", 1, 0]
    assert rows[0]["headers"] == ["Dept", "Q1 / Revenue", "Q1 / Cost", "Q2 / Revenue", "Q2 / Cost"]
    assert [r["cells"] for r in rows] == [["X", "1", "2", "3", "4"], ["Y", "5", "6", "7", "8"], ["Z", "9", "10", "11", "12"]]


def test_several_tables_of_a_sheet(tables):
    got = {k[2]: (v[0]["headers"], [r["cells"] for r in v]) for k, v in tables[0].items() if k[:2] == ("two.xlsx", 0)}
    assert sorted(got.values()) == [(["Item", "Count"], [["a", "1"], ["b", "2"]]), (["L", "M"], [["l", "5"], ["k", "6"]]), (["Place", "Size", "Kind"], [["p", "3", "x"], ["q", "4", "y"]])]


def test_hidden_and_titled(tables, spark):
    rows = tables[0]["two.xlsx", 1, 0]
    assert rows[0]["headers"] == ["Key", "Value"] and [r["cells"] for r in rows] == [["k1", "1"], ["k3", "3"]]
    rows = tables[0]["two.xlsx", 2, 0]
    assert rows[0]["title"] == "Sales of the year" and rows[0]["headers"] == ["Shop", "Kind", "Sum"] and len(rows) == 3
    shown = read_xlsx_tables(spark, tables[2], ["hidden", 99], hidden=True).collect()
    assert {tuple(r["headers"]) for r in shown} == {("Key", "Secret", "Value")} and len(shown) == 3
