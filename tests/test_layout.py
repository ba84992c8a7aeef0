"""Layout, sheets, drafting and interpreters against small brute-force versions."""

import random

from tabloom.operators import layout as L
from tabloom.operators import sheets as X
from tabloom.operators.fuzzy import partial_ratio, token_ratio, weighted_ratio
from tabloom.plans import draft as D
from tabloom.plans import semantics as S
from tabloom.plans.contract import Contract
from tabloom.plans.interpreter import Fallback, Unresolved, resolve


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_page_layout(spark):
    spans = [(1, 0, 10.0, 5.0, 12.0, "ab"), (1, 0, 40.0, 6.5, 18.0, "abc"), (1, 0, 25.0, 20.0, 6.0, "x"), (1, 0, 25.0, 21.0, 6.0, " "), (2, 0, 1.0, 1.0, 9.0, "y")]
    got = L.page_layout(spark.createDataFrame(spans, "doc int, page_no int, x double, y double, width double, text string"))
    assert rows_of(got, "doc", "row", "col", "cell_w", "text") == [(1, 0, 0, 6.0, "ab"), (1, 0, 5, 6.0, "abc"), (1, 1, 2, 6.0, "x"), (2, 0, 0, 6.0, "y")]
    assert L.page_layout(spark.createDataFrame([], "doc int, page_no int, x double, y double, width double, text string")).count() == 0


def split_plainly(rows):
    starts = {}
    for r, spans in rows.items():
        for c, _ in spans:
            starts.setdefault(c, set()).add(r)
    out = []
    for r, spans in rows.items():
        for c, t in spans:
            cuts = [p - c for p in sorted(starts) if c + 5 < p < c + len(t) and r not in starts[p] and " " in t[p - c - 1 : p - c + 1]]
            if not cuts:
                out.append((r, c, t))
                continue
            for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(t)])):
                piece = t[a:b].rstrip(" ")
                lead = len(piece) - len(piece.lstrip(" ")) if k else 0
                if piece[lead:]:
                    out.append((r, c + a + lead, piece[lead:]))
    return sorted(out)


def test_split_merged(spark):
    rng = random.Random(3)
    rows = {r: sorted({rng.randrange(40): " ".join("w" * rng.randrange(1, 6) for _ in range(rng.randrange(1, 5))) for _ in range(4)}.items()) for r in range(30)}
    spans = spark.createDataFrame([(1, 0, r, c, t) for r, s in rows.items() for c, t in s], "doc int, page_no int, row int, col int, text string")
    want = split_plainly(rows)
    assert rows_of(L.split_merged(spans), "row", "col", "text") == want and len(want) > spans.count()


def test_regions_and_grids(spark):
    page = {0: [(0, "Title")], 3: [(0, "a"), (10, "b"), (20, "c")], 4: [(0, "1"), (11, "2"), (20, "3")], 5: [(1, "4"), (10, "5")], 8: [(0, "key:"), (15, "v")],
            9: [(0, "key2:"), (30, "v")], 12: [(0, "z" * 90)], 13: [(0, "y" * 50)], 20: [(0, "p"), (9, "q"), (18, "r")]}
    want = [("heading", [0]), ("table", [3, 4, 5]), ("kv", [8, 9]), ("text", [12, 13]), ("scattered", [20])]
    assert L.page_regions(page) == want
    spans = spark.createDataFrame([(1, 0, r, i, c, t) for r, s in page.items() for i, (c, t) in enumerate(s)], "doc int, page_no int, row int, ord int, col int, text string")
    assert rows_of(L.regions(spans), "region", "kind", "first_row", "n_rows") == [(i, k, rs[0], len(rs)) for i, (k, rs) in enumerate(want)]
    text = L.render_text(spans).collect()[0]["text"].split("\n")
    assert text[4] == "1          2        3" and text[1] == "" and len(text) == 21
    cols = spark.createDataFrame([(1, 0, c) for c in (0, 10, 20)], "doc int, page_no int, start int")
    assert (5, 0, "4") in rows_of(L.to_grid(spans, cols), "row", "column_start", "text")
    wide = spark.createDataFrame([(1, 0, c) for c in (0, 10, 20, 80, 90)], "doc int, page_no int, start int")
    assert rows_of(L.side_by_side(wide), "start", "grid") == [(0, 0), (10, 0), (20, 0), (80, 1), (90, 1)]
    runs = spark.createDataFrame([(0, [1, 3, 4, 2, 3, 4, 2, 3, 4, 2]), (1, [2] * 9), (2, []), (3, [2, 1, 2, 1, 2, 1]), (4, None)], "i int, c array<int>")
    assert [r[0] and tuple(r[0]) for r in runs.orderBy("i").select(L.row_period("c")).collect()] == [(1, 3), None, None, (0, 2), None]


def test_drawings_and_fonts(spark):
    shapes = spark.createDataFrame([("s", 0.0, 0.0, 90.0, 0.0, None), ("f", 0.0, 0.0, 1.0, 50.0, None), ("f", 0.0, 0.0, 9.0, 9.0, None)], "type string, x0 double, y0 double, x1 double, y1 double, stroke double")
    assert [(r["kind"], r["length"], r["width"]) for r in L.classify_drawings(shapes).collect()] == [("h", 90.0, 1.0), ("v", 50.0, 1.0), ("fill", None, None)]
    raw = [(1, 0, "header", 0, 0, "Arial-BoldMT", 0, 0, 12.0), (1, 0, "data", 1, 0, "Courier", 0, 0xCC3300, 9.5), (1, 0, "data", 2, 0, None, 1, None, 9.0)]
    spans = L.decode_fonts(spark.createDataFrame(raw, "doc int, page_no int, zone string, row int, col int, font string, flags int, color int, size double"))
    assert rows_of(spans, "row", "is_bold", "is_italic", "is_mono") == [(0, True, False, False), (1, False, False, True), (2, False, True, False)]
    v = L.font_verdicts(spans).collect()[0]
    assert (v["header_bold"], v["data_bold"], v["bold_rows"], v["italic_rows"], v["exception_spans"], v["mono_columns"]) == (1.0, 0.0, [0], [2], 1, [])
    assert L.size_tiers(spans).collect()[0]["tiers"] == [12.0, 9.25]


def cells_of(spark, grid, bold=()):
    return spark.createDataFrame([("t", r, c, t, r in bold) for r, line in enumerate(grid) for c, t in enumerate(line)], "t string, row int, col int, text string, bold boolean")


def bounds_plainly(grid, header):
    n, lo, hi = len(grid[0]), 0, len(grid[0])
    if n <= 1:
        return 0, n
    full = [[bool(x and x.strip()) for x in line] for line in grid]
    blank = [c for c in range(n) if not any(line[c] for line in full)]
    right = [c for c in blank if c >= 1]
    if right and (n - max(right)) / n <= 0.4:
        hi = max(right)
    left = [c for c in blank if c < hi]
    if left and (min(left) + 1) / n <= 0.4:
        lo = min(left) + 1
    body = full[min(header, len(full)) :]

    def poor(c):
        return bool(body) and not any(line[c] for line in full[:header]) and sum(line[c] for line in body) < 0.5 * len(body)

    while hi > lo + 1 and poor(hi - 1):
        hi -= 1
    while lo < hi - 1 and poor(lo):
        lo += 1
    return lo, hi


def test_edge_bounds(spark):
    rng = random.Random(5)
    grids = []
    for _ in range(60):
        w, h = rng.randrange(1, 9), rng.randrange(1, 7)
        dens = [rng.choice([0, 0.2, 0.6, 1]) for _ in range(w)]
        grids.append(([["x" if rng.random() < dens[c] else rng.choice(["", " ", None]) for c in range(w)] for _ in range(h)], rng.randrange(0, 3)))
    cells = spark.createDataFrame([(k, r, c, t) for k, (g, _) in enumerate(grids) for r, line in enumerate(g) for c, t in enumerate(line)], "t int, row int, col int, text string")
    sizes = spark.createDataFrame([(k, len(g[0]), len(g), h) for k, (g, h) in enumerate(grids)], "t int, width int, height int, header_rows int")
    assert rows_of(X.edge_bounds(cells, sizes, ["t"]), "t", "first_col", "end_col") == [(k, *bounds_plainly(g, h)) for k, (g, h) in enumerate(grids)]


def test_sheet_rules(spark):
    grid = [["note", "", ""], ["", "by", ""], ["", "", ""], ["A", "B", "C"], ["1", "2", "3"], ["4", "5", "6"], ["Total", "7", "9"], ["", "", ""], ["* est.", "", ""]]
    cells = cells_of(spark, grid, bold=(6,))
    sizes = spark.createDataFrame([("t", 3, 9, 4)], "t string, width int, height int, header_rows int")
    assert rows_of(X.annotation_block(cells, sizes, ["t"]), "blank_row", "lines") == [(2, ["note", "by"])]
    data = X.strip_footnotes(cells.where("row > 3"), sizes, ["t"])
    assert {r["row"] for r in data.collect()} == {4, 5, 6}
    assert {r["row"] for r in X.drop_totals(data, ["t"]).collect()} == {4, 5}
    assert X.title_row(cells, sizes, ["t"]).collect()[0]["title"] == "note"
    apart = cells_of(spark, [["a", "b", "", "", "c", "d"], ["1", "2", "", "", "3", "4"], [""] * 6, [""] * 6, ["x", "", "", "", "", ""]])
    assert rows_of(X.regions(apart, ["t"]), "region", "text") == [(0, t) for t in "12ab"] + [(1, t) for t in "34cd"]
    assert rows_of(X.regions(cells_of(spark, [["a"]]), ["t"]), "region", "text") == [(0, "a")]
    merges = spark.createDataFrame([("t", 0, 0, 1, 1)], "t string, r0 int, c0 int, r1 int, c1 int")
    assert rows_of(X.expand_merges(cells_of(spark, [["a", "b"], ["c", "d"]]), merges, ["t"]), "row", "col", "text") == [(0, 0, "a"), (0, 1, ""), (1, 0, ""), (1, 1, "")]
    votes = spark.createDataFrame([(2, 5, 1, 1), (0, None, 3, 1), (None, None, None, None)], "fills int, merges int, types int, spans int")
    assert [r["v"] for r in votes.select(X.header_votes(votes).alias("v")).collect()] == [2, 3, 1]


def test_draft(spark):
    cells = cells_of(spark, [["a", "1", "", "u1"], ["b", "2", None, "u2"], ["a", "x", "", "u3"], ["b", "3", "", "u4"], ["a", "4", "", "u5"], ["a", "5", "", "u6"]])
    assert rows_of(D.column_types(cells, ["t", "col"]), "col", "type", "distinct_values") == [(0, "enum", 2), (1, "number", 6), (2, "string", 0), (3, "string", 6)]
    tables = spark.createDataFrame([("k", 1, 3, ["area", "yield"], "Area of wheat"), ("k", 2, 3, ["area", "yield"], None), ("k", 3, 9, ["port"], "")], "k string, ord int, n_cols int, tokens array<string>, title string")
    assert rows_of(D.group_similar(tables, "k", "ord"), "ord", "group") == [(1, 0), (2, 0), (3, 1)]
    assert rows_of(D.keywords(tables, "k"), "rank", "keyword", "n") == [(1, "area", 3), (2, "yield", 2), (3, "port", 1), (4, "wheat", 1)]
    cols = spark.createDataFrame([(0, 0, "Area (ha)", "number"), (0, 0, "Area", "number"), (0, 0, "Area", "string"), (0, 1, " ", "string")], "g int, position int, header string, type string")
    assert rows_of(D.recommend(cols, "g"), "position", "name", "type", "aliases") == [(0, "area", "float", ["Area", "Area (ha)"])]
    assert D.without_annotations({"a": [{"_x": 1, "b": 2}], "_c": 3}) == {"a": [{"b": 2}]}
    text = D.shapes("harvest", [{"name": "area", "type": "float"}, {"name": "crop", "aliases": ['w"t', "{YYYY}"]}])
    assert "sh:minInclusive 0" in text and 'sh:in ("w\\"t")' in text and text.count(" .\n") == 3


def test_interpreters(spark):
    class Upper:
        def records(self, text, columns):
            return [{columns[0]: line.upper()} for line in text.split("\n")]

    docs = spark.createDataFrame([(1, "a\nb"), (2, "c"), (3, None)], "doc int, text string")
    done = docs.where("doc = 2").select("doc")
    got = rows_of(resolve(docs, "doc", done, Fallback(Unresolved(), Upper(), tries=2, wait=0.0), ["v"]).where("problem is null"), "doc", "row", "v")
    assert got == [(1, 0, "A"), (1, 1, "B")]
    assert rows_of(resolve(docs, "doc", done, columns=["v"]), "doc", "problem") == [(1, "LookupError: no interpreter is configured"), (3, "ValueError: no text")]


def test_weighted_ratio():
    assert weighted_ratio("", "a") == 0.0 and weighted_ratio("abc", "abc") == 100.0
    assert partial_ratio("wheat", "winter wheat area") == 100.0 and weighted_ratio("wheat", "winter wheat area") == 90.0
    assert token_ratio("area wheat", "wheat area") == 100.0 and weighted_ratio("area wheat", "wheat area") == 95.0
    assert token_ratio("a b", "") == 0.0 and partial_ratio("abcd", "xxbcdxx") == 75.0


def test_semantics(spark, tmp_path):
    names = spark.createDataFrame([("u1", "prefLabel", "en", "Wheat"), ("u1", "altLabel", "en", "wheats"), ("u1", "prefLabel", "fr", "ble"), ("u2", "prefLabel", "en", "Durum"), ("u3", "prefLabel", "en", "Far")], "concept string, kind string, lang string, label string")
    broader = spark.createDataFrame([("u1", "u2"), ("u2", "u3"), ("u2", "u1")], "broader string, narrower string")
    col = {"name": "crop", "aliases": ["wheat", "corn"], "concept_uris": [{"uri": "u1", "label": "wheat (crop)"}], "resolve": {"narrower_depth": 1, "prefix_patterns": ["spring {label}"]}}
    contract = {"outputs": {"o": {"category": "c", "schema": {"columns": [col, {"name": "x"}]}}}}
    done = S.materialize(spark, contract, names, broader)["outputs"]["o"]["schema"]["columns"][0]
    assert done["aliases"] == ["wheat", "corn", "Durum", "spring Durum", "spring Wheat", "spring wheats", "wheats"] and "resolve" not in done
    assert done["_alias_provenance"]["wheat"]["source"] == "both" and done["_alias_provenance"]["corn"] == {"source": "manual"}
    assert S.materialize(spark, {"outputs": {}}, names, broader) == {"outputs": {}}
    context = S.build_context(spark, contract, names, broader)
    context.write(str(tmp_path / "c.json"))
    context = S.SemanticContext.read(str(tmp_path / "c.json"))
    assert context.valid_set_for("o", "crop") == {"Wheat", "wheats", "Durum", "spring Wheat", "spring wheats", "spring Durum", "wheat (crop)"} and context.aliases_for("o", "x") == []
    out = Contract.of('{"outputs": {"o": {"schema": {"columns": [{"name": "crop", "aliases": ["WHEAT"]}]}}}}').outputs[0]
    assert S.with_context(out, context).columns[0].aliases == ("WHEAT", "corn", "Durum", "spring Durum", "spring Wheat", "spring wheats", "wheats")
    rows = spark.createDataFrame([(" durum",), ("rye",), ("Rye ",), ("",), (None,)], "crop string")
    assert rows_of(S.validation_counts(rows, "o", ["crop", "y"], context), "column", "valid", "invalid", "unknown_values") == [("crop", 3, 2, 1)]
