"""Pivot detection, mapping to a contract, documents end to end, row predicates."""

import pytest
from pyspark.sql import functions as F

from tabloom.operators import pivot as V
from tabloom.operators import rows as R
from tabloom.operators import tables as P
from tabloom.plans import documents as D
from tabloom.plans.contract import Contract, interpret
from tabloom.plans.mapping import Mapper, alias_key, mapped_rows

PIVOT = "## T\n| Region | spring crops / Target | spring crops / 2025 | spring grain / Targets | spring grain / 2025 | Th.ha. / MOA |\n|---|---|---|---|---|---|\n| Belgorod | 100 | 90 | 50 | 45 | 7 |\n**SOUTH**\n| Kursk | 1 | 2 |\nnote"


def test_pivot_plan():
    heads = ("Region", "A / Total area", "A / Yield", "B / Total areas", "B / Yield", "C / Other", "C / Thing", "C / More")
    plan = V.pivot_plan(heads)
    assert plan == {"shared": [0, 5, 6, 7], "measures": ["Total area", "Yield"], "groups": [{"prefix": "A", "cols": [1, 2]}, {"prefix": "B", "cols": [3, 4]}]}
    assert V.pivot_plan(("Region", "A / X", "A / Y", "B / X")) is None  # one suffix in common
    assert V.pivot_plan(("Region", "A / X", "A / Y")) is None and V.pivot_plan(()) is None
    assert V.pivot_plan(("A / wheat", "A / maize", "B / wheet", "B / maize"), threshold=100.0) is None  # 80 and 100
    three = V.pivot_plan(("A / x1", "A / x2", "A / x3", "B / x1", "B / x2", "C / x2", "C / x3"), threshold=100.0)
    assert three is None  # only x2 is in all groups


def test_unpivot_texts_and_rows(spark):
    docs = spark.createDataFrame([(1, PIVOT), (2, "| a | b |\n|---|---|\n| 1 | 2 |"), (3, None), (4, "no table")], "doc int, text string")
    got = {r["doc"]: r for r in V.unpivot_text(docs).collect()}
    assert got[1]["text"].split("\n") == [
        "## T", "| _pivot | Region | Th.ha. / MOA | Target | 2025 |", "|---|---|---|---|---|", "| spring crops | Belgorod | 7 | 100 | 90 |", "| spring grain | Belgorod | 7 | 50 | 45 |",
        "**SOUTH**", "| spring crops | Kursk |  | 1 | 2 |", "| spring grain | Kursk |  |  |  |", "note",
    ]
    assert [got[i]["was_transformed"] for i in (1, 2, 3, 4)] == [True, False, False, False] and got[3]["text"] is None
    rows = V.unpivot_detected(P.parse(docs)).collect()
    assert [(r["pivot_name"], r["cells"]) for r in rows if r["doc"] == 1 and r["row_idx"] == 0] == [("spring crops", ["Belgorod", "7", "100", "90"]), ("spring grain", ["Belgorod", "7", "50", "45"])]
    assert [(r["pivot_name"], r["headers"], r["cells"]) for r in rows if r["doc"] == 2] == [(None, ["a", "b"], ["1", "2"])]


COLUMNS = [("port", "string", ["Port", "Load port"]), ("ship", "string", ["Vessel"]), ("tons", "float", ["Tonnes", "Quantity (tonnes)", "2025"]), ("year", "int", ["2025", "2024"])]


def test_mapping(spark):
    one = lambda text, cols=COLUMNS, **k: [tuple(r)[4:] for r in mapped_rows(spark.createDataFrame([(1, text)], "doc int, text string"), cols, **k).orderBy("row_idx", "group_idx").collect()]
    flat = "| Port | Vessel | Tonnes |\n|---|---|---|\n| P1 | V1 | 5 |\n|| Total | | 5 |\n| P2 | V2 | |"
    assert one(flat) == [("P1", "V1", "5", None), ("P2", "V2", "", None)]
    assert one("| Port | Quantity / (tonnes) | Unknown |\n|---|---|---|\n| P1 | 3 | x |") == [("P1", None, "3", None)]  # parts joined by a blank
    assert one("| Port | Tonnes, net |\n|---|---|\n| P1 | 3 |") == [("P1", None, "3", None)]  # before the comma
    assert one("| Port | 2025 |\n|---|---|\n| P1 | 3 |") == [("P1", None, "3", None)]  # one header: the float takes the cell
    assert one("## Vessel\n| Port | Tonnes |\n|---|---|\n| P1 | 3 |") == [("P1", "Vessel", "3", None)]  # the title names a column
    assert one("|  | Tonnes | Port |\n|---|---|---|\n| V9 | 3 | P1 |") == [("P1", "V9", "3", None)]  # the one headerless text column
    sections = "| Vessel | Tonnes |\n|---|---|\n| V0 | 1 |\n**Port**\n| V1 | 2 |\n| Load port | |\n| V2 | 3 |"
    assert one(sections) == [("Port", "V1", "2", None), ("Load port", "V2", "3", None)]
    assert len(one(sections, keep_unsectioned=True)) == 3
    assert one("no table") == [] and one("| x | y |\n|---|---|\n| 1 | 2 |") == []
    crops = [("region", "string", ["Region"]), ("crop", "string", ["spring crops", "spring grain"]), ("unit", "string", ["Th.ha."]), ("area", "float", ["Area"]), ("yield", "float", ["Yield"])]
    wide = "| Th.ha. / Region | spring crops / Area | spring crops / Yield | spring grain / Area | spring grain / Yield |\n|---|---|---|---|---|\n| N | 1 | 2 | 3 | 4 |"
    assert one(wide, crops) == [("N", "spring crops", "Th.ha.", "1", "2"), ("N", "spring grain", "Th.ha.", "3", "4")]


def test_alias_keys_agree(spark):
    from tabloom.functions.text import normalize_alias

    texts = ['  "Area"( Harvested )x ', "A  B", "(x)", "a( b ) c", "", "Å ß"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(normalize_alias("t")).collect()
    assert [r[0] for r in got] == [alias_key(t) for t in texts]
    assert Mapper([("a", "string", ["X"]), ("b", "string", ["x"]), ("c", "float", ["X"])]).owned("x, y") == ["a", "b", "c"]


CONTRACT = """{"provider": "p", "categories": {"ships": {"keywords": ["vessel"]}, "crops": {"keywords": ["harvest"]}}, "outputs": {
 "vessels": {"category": "ships", "schema": {"columns": [{"name": "ship", "aliases": ["Vessel"]}, {"name": "tons", "type": "float", "aliases": ["Tonnes", "{YYYY}"]}, {"name": "day", "source": "report_date"}]}},
 "harvest": {"category": "crops", "schema": {"columns": [{"name": "region", "aliases": ["Region"]}, {"name": "area", "type": "int", "aliases": ["Area"]}]}}}}"""


def test_documents_end_to_end(spark, tmp_path):
    ships = "## Vessel list\n| Vessel | Tonnes |\n|---|---|\n| V1 | 1.5 |\n\n| Region | Harvest / Area |\n|---|---|\n| N | 7 |"
    docs = spark.createDataFrame([(1, "/in/stem 2024-05-01.pdf", ships + "\f \f| Vessel | 2024 |\n|---|---|\n| V2 | 2 |"), (2, "/in/b.pdf", "| Region | Vessels moored |\n|---|---|\n| S | 1 |"), (3, "/in/c", None)], "doc int, path string, text string")
    pages = D.split_pages(docs).select("doc", "page_no").collect()
    assert sorted((r["doc"], r["page_no"]) for r in pages) == [(1, 0), (1, 2), (2, 0)]
    tables = D.split_tables(D.split_pages(docs)).orderBy("doc", "page_no", "table_idx").collect()
    assert [(r["doc"], r["page_no"], r["table_idx"], r["title"], r["n_rows"], r["n_cols"]) for r in tables] == [(1, 0, 0, "Vessel list", 1, 2), (1, 0, 1, None, 1, 2), (1, 2, 0, None, 1, 2), (2, 0, 0, None, 1, 2)]
    c = Contract.of(CONTRACT)
    frames = D.run_contract(spark, docs, c, date=D.report_date("filename", "path"))
    assert sorted(tuple(r) for r in frames["vessels"].collect()) == [(1, 0, 0, "V1", 1.5, "2024-05-01"), (1, 2, 0, "V2", 2.0, "2024-05-01")]
    assert [tuple(r) for r in frames["harvest"].collect()] == [(1, 0, 1, "N", 7)]
    where = D.save_all(frames, c, str(tmp_path), "csv")
    assert spark.read.csv(where["vessels"], header=True).count() == 2
    assert D.records_by_page(frames["vessels"], "doc").select("page_no", F.size("records")).collect() == [(0, 1), (2, 1)]
    assert str(D.to_pandas(frames["harvest"])["area"].dtype) == "Int64" and D.to_arrow(frames["harvest"]).num_rows == 1
    assert D.records(frames["harvest"])[0]["region"] == "N"
    assert D.with_page(frames["vessels"], ["tons", "nothing", "ship"]).columns == ["page", "tons", "ship"]
    assert D.select_numbers(frames["vessels"], "page_no", [2, 9]).count() == 1 and D.select_numbers(frames["vessels"], "page_no", None).count() == 2
    assert D.union_pages(docs.select("doc"), docs.select("doc")).count() == 3
    assert D.concat([frames["harvest"], frames["vessels"]]).count() == 3


def test_classify_and_route(spark):
    rows = [(1, 0, "Vessel", ["Vessel name", "Tonnes loaded"], 5, 2), (1, 1, None, ["Name", "Tonnes loaded"], 5, 2), (2, 0, None, ["x"], 5, 9), (2, 1, "Vessel", ["Vessel name"], 1, 1)]
    t = spark.createDataFrame(rows, "doc int, table_idx int, title string, headers array<string>, n_rows int, n_cols int")
    cats = {"ships": ["vessel"], "crops": ["harvest"]}
    kinds = lambda df: [r["category"] for r in df.orderBy("doc", "table_idx").collect()]
    assert kinds(D.classify_tables(t, cats, min_rows=2)) == ["ships", "other", "other", "other"]
    assert kinds(D.classify_tables(t, cats, min_rows=2, propagate=True)) == ["ships", "ships", "other", "ships"]
    c = Contract.of(CONTRACT)
    routed = D.classify_tables(t, cats, min_rows=2)
    assert D.route(routed, c.outputs, "doc").count() == 1 and D.route(routed, c.outputs, "doc", whole_documents=True).count() == 2
    p = D.category_profiles(routed).first()
    assert (p["category"], p["n"], p["mean_cols"], p["tokens"]) == ("ships", 1, 2.0, ["loaded", "name", "tonnes", "vessel"])


def test_report_date(spark):
    d = spark.createDataFrame([("/a/b 2024-05-01 x.pdf", "of 1999")], "path string, text string")
    assert d.select(D.report_date("filename", "path"), D.report_date("content", text="text"), D.report_date("constant", value="q")).first()[:] == ("2024-05-01", "1999", "q")
    assert D.report_date("timestamp") is not None
    for bad in (("metadata", {}), ("constant", {}), ("filename", {})):
        with pytest.raises(ValueError):
            D.report_date(bad[0], **bad[1])


def test_batches(spark):
    rows = spark.createDataFrame([(1, i, "a" if i < 3 else "b" if i < 8 else "c") for i in range(10)], "t int, row_idx int, s string")
    assert [r["batch_no"] for r in D.batches(rows, ["t"], "row_idx", 4).orderBy("row_idx").collect()] == [0] * 4 + [1] * 4 + [2] * 2
    packed = D.batches(rows, ["t"], "row_idx", 4, "s").orderBy("row_idx")
    assert [r["batch_no"] for r in packed.collect()] == [0] * 3 + [1] * 4 + [2] * 3
    assert [r["row_idx"] for r in D.merge_batches(packed, ["t"]).orderBy("row_idx").collect()] == list(range(10))


def test_row_predicates(spark):
    values = ["12", "Includes x", "includesx", "***", "Note: y", "note", "(tonnes)", "1,000.5 %", "", "KWINANA", "ETA", "DATE:", "North", " 3 ", None]
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    true = lambda f: [r["i"] for r in d.where(f("v")).orderBy("i").collect()]
    assert true(R.is_footnote) == [0, 1, 3, 4, 13]
    assert true(R.is_continuation) == [0, 6, 7, 8, 13]
    assert true(R.is_section_label) == [9]
    rows = spark.createDataFrame([(0, ["Port", "2025", "2024"]), (1, ["a", "1,5", "3"]), (2, ["", " "]), (3, ["a", "b"]), (4, ["x", "2024-01-01"]), (5, [])], "row int, cells array<string>")
    picked = lambda f: [r["row"] for r in rows.where(f("cells")).orderBy("row").collect()]
    assert picked(R.is_header_like) == [0, 3, 4] and picked(R.is_text_row) == [2, 3] and picked(R.is_blank_row) == [2, 5]
    t = rows.withColumn("t", F.lit(1))
    assert R.header_rows_by_type(t.where("row in (2, 3, 4)"), "t", "row", "cells").first()["header_rows"] == 2
    assert tuple(R.table_size(t, "t", "cells").first()) == (1, 6, 3)
    cells = spark.createDataFrame([(1, 0, "a"), (1, 0, "1"), (1, 0, "b"), (1, 1, "1"), (1, 1, ""), (1, 2, "")], "t int, c int, v string")
    assert {r["c"]: (r["filled"], r["is_text"], r["is_numeric"]) for r in R.text_columns(cells, ["t"], "c", "v").collect()} == {0: (3, True, False), 1: (1, False, True), 2: (0, False, True)}


def test_inferred_types_units_hints(spark):
    d = spark.createDataFrame([("a", "1,000"), ("a", "2.00"), ("a", "(3)"), ("b", "1.5"), ("b", "2"), ("c", "x"), ("c", "1"), ("d", "-")], "c string, v string")
    assert {r["c"]: r["type"] for r in R.infer_type(d, ["c"], "v").collect()} == {"a": "int", "b": "float", "c": "string", "d": "string"}
    h = spark.createDataFrame([("Area harvested, Th.ha.",), ("Price (USD per bushel of wheat)",), ("Weight (kg)",)], "h string")
    units = [r[0] for r in h.select(R.header_units("h")).collect()]
    assert "Th.ha." in units[0] and "kg" in units[2] and all(len(u) < 20 for u in units[1])
    f = spark.createDataFrame([("General",), ("yyyy-mm-dd",), ("#,##0.00 €",), ("0%",), ("hh:mm",), (None,), ("0.0",)], "f string")
    assert [r[0] for r in f.select(R.format_hint("f")).collect()] == [None, "date", "currency", "percentage", None, None, None]


def test_titles_against_brute_force(spark):
    from tabloom.operators.fuzzy import best_term, weighted_ratio

    terms = ["FRANCE", "GERMANY", "UNITED STATES", "UNITED KINGDOM"]
    titles = ["france", "Exports of Germany by month", "frnce", "states united", "UNITED", "x", None, "germani"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in titles], "t string").select(best_term(F.col("t"), terms, 80.0)).collect()]
    for t, g in zip(titles, got):
        scores = [weighted_ratio((t or "").lower(), x.lower()) for x in terms]
        best = max(scores)
        assert (g["term"], g["score"]) == ((terms[scores.index(best)], best) if t is not None and best >= 80 else (None, None)) if g is not None else best < 80
