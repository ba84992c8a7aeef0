"""Pipe tables, contracts, layout, vocabularies, sources and streams on small inputs."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tabloom.operators import grid as G
from tabloom.operators import ontology as O
from tabloom.operators import tables as P
from tabloom.plans.contract import Contract, interpret, save, year_aliases
from tabloom.sources.office import docx_cells, html_cells, read_tables, xlsx_cells
from tabloom.streaming import events as S

TEXT = "## Crops\n| Region | A / Area | A / Yield | B / Area | B / Yield |\n|---|---|---|---|---|\n| N | 1 | 2 | 3 | 4 |\n| Region | A / Area | A / Yield | B / Area | B / Yield |\n| S | 5 | 6 |\n|| Total | 6 | 8 | 3 | 4 |\n"


def test_parse_and_unpivot(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, "no table"), (3, None)], "doc int, text string")
    rows = P.parse(docs).collect()
    assert [(r["doc"], r["title"], r["row_idx"], r["is_total"], r["cells"][0]) for r in rows] == [(1, "Crops", 0, False, "N"), (1, "Crops", 1, False, "S"), (1, "Crops", 2, True, "Total")]
    long = P.unpivot(P.parse(docs).where("not is_total")).collect()
    assert ("A", "N", "Area", "1") in [(r["pivot_name"], r["shared"][0], r["measure"], r["value"]) for r in long]
    assert ("B", "S", "Yield", "") in [(r["pivot_name"], r["shared"][0], r["measure"], r["value"]) for r in long]


CONTRACT = """{"provider": "p", "categories": {"c": {"keywords": ["crop"]}}, "outputs": {"o": {"schema": {"columns": [
 {"name": "region", "type": "string", "aliases": ["Region"], "format": "uppercase"}, {"name": "crop", "type": "string", "aliases": ["A", "B"]},
 {"name": "area", "type": "float", "aliases": ["Area"], "format": "#,###.#"}, {"name": "yield", "type": "float", "aliases": ["Yield"]}, {"name": "what", "source": "title"}, {"name": "who", "source": "constant", "value": "x"}]}}}}"""


def test_contract(spark, tmp_path):
    out = Contract.of(CONTRACT).outputs[0]
    got = interpret(spark, spark.createDataFrame([(1, TEXT)], "doc int, text string"), out, "doc").orderBy("region", "crop")
    assert [tuple(r)[1:] for r in got.collect()] == [("N", "A", 1.0, 2.0, "Crops", "x"), ("N", "B", 3.0, 4.0, "Crops", "x"), ("S", "A", 5.0, 6.0, "Crops", "x")]
    save(got.drop("doc"), f"{tmp_path}/o.csv", out)
    assert spark.read.csv(f"{tmp_path}/o.csv", header=True).count() == 3
    assert year_aliases(("{YYYY}", "{YYYY-1} x", "z"), ["2020", "2021"]) == ("2021", "2020 x", "z")
    assert year_aliases(("{YYYY}", "z"), []) == ("z",)


def test_classify_tie_goes_to_first(spark):
    d = spark.createDataFrame([("export and import",), ("none",)], "t string")
    assert [r[0] for r in d.select(P.classify(d, "t", {"b": ["import"], "a": ["export"]})).collect()] == ["b", "other"]


def test_layout(spark):
    d = spark.createDataFrame([(1, 0, "a"), (1, 1, ""), (1, 5, None), (1, 6, "b")], "t int, c int, v string")
    assert [r["o"] for r in G.forward_fill(d, ["t"], "c", "v", "o").orderBy("c").collect()] == ["a", "a", "a", "b"]
    assert [r["cluster"] for r in G.islands(d, ["t"], "c", 1).orderBy("c").collect()] == [0, 0, 1, 1]
    h = spark.createDataFrame([(1, 0, 0, "X"), (1, 1, 0, "X"), (1, 2, 0, "Y"), (1, 1, 1, "Z")], "t int, r int, c int, v string")
    assert {r["c"]: r["header"] for r in G.compound_headers(h, "t", "r", "c", "v").collect()} == {0: "X / Y", 1: "Z"}
    assert G.upper_median(spark.range(4).withColumn("g", F.lit(1)), ["g"], "id", "m").first()["m"] == 2


def test_vocabularies(spark, tmp_path):
    t = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "broader string, narrower string")
    assert {r["concept"]: r["level"] for r in O.narrower(t, spark.createDataFrame([("a",)], "concept string"), 5).collect()} == {"a": 0, "b": 1, "c": 2}
    (tmp_path / "x.nt").write_text('<http://x/1> <http://l> "café"@fr .\n# no\n<http://x/1> <http://n> <http://x/2> .\n', encoding="utf-8")
    assert [tuple(r) for r in O.read_ntriples(spark, str(tmp_path / "x.nt")).collect()] == [("http://x/1", "http://l", "café", "fr"), ("http://x/1", "http://n", "http://x/2", None)]
    rows = spark.createDataFrame([("A ",), ("z",), (None,), ("nan",)], "v string")
    valid = spark.createDataFrame([("a",)], "w string")
    assert sorted((r["v"] or "", r["is_valid"]) for r in O.check_values(rows, "v", valid, "w").collect()) == [("", True), ("A ", True), ("nan", True), ("z", False)]


def zipped(files):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for k, v in files.items():
            z.writestr(k, v)
    return b.getvalue()


XLSX = zipped({"xl/sharedStrings.xml": '<sst xmlns="s"><si><t>Name</t></si></sst>', "xl/worksheets/sheet1.xml": '<worksheet xmlns="s"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1"><v>7</v></c></row><row r="2" hidden="1"><c r="A2"><v>9</v></c></row></sheetData></worksheet>'})
DOCX = zipped({"word/document.xml": '<w:document xmlns:w="w"><w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>H</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc></w:tr></w:tbl></w:document>'})


def test_sources(spark, tmp_path):
    assert list(xlsx_cells(XLSX)) == [(0, 0, 0, "Name"), (0, 0, 27, "7")]
    assert list(docx_cells(DOCX)) == [(0, 0, 0, "H"), (0, 0, 1, ""), (0, 1, 0, "a"), (0, 1, 1, "")]
    page = "<table><tr><th rowspan=2>A</th><td colspan=2>b&amp;c</td></tr><tr><td>d<td></td></tr></table>"
    assert [c for c in html_cells("<table><tr><th rowspan=2>A</th><td colspan=2>b&amp;c</td></tr><tr><td>d</td></tr></table>")] == [(0, 0, 0, "A"), (0, 0, 1, "b&c"), (0, 0, 2, ""), (0, 1, 0, ""), (0, 1, 1, "d")]
    for name, data in (("a.xlsx", XLSX), ("b.docx", DOCX), ("c.html", page.encode()), ("d.xlsx", b"broken")):
        (tmp_path / name).write_bytes(data)
    got = read_tables(spark, str(tmp_path)).groupBy(F.element_at(F.split("path", "/"), -1).alias("f")).count().collect()
    assert {r["f"] for r in got} == {"a.xlsx", "b.docx", "c.html"}


def test_stream(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(src)
    batch.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = S.read_stream(spark, f"{tmp_path}/in", src)
    q = S.deduplicated(stream, ["event_id"], late="10000 days").writeStream.format("memory").queryName("dedup").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select count(*), count(distinct event_id) from dedup").first()[0] == batch.select("event_id").distinct().count()


@pytest.mark.parametrize("name", ["wide_report_roundtrip", "unpivot_agnostic", "alias_provenance", "stream_tumbling", "column_profile", "cell_types"])
def test_query_against_duckdb(spark, name, tmp_path):
    import duckdb

    import tabloom.queries as L

    sf = "/root/testdata/sf0.001"
    L.queries()[name](spark, sf).write.parquet(f"{tmp_path}/o")
    db = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages".split():
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cols = ", ".join(sorted(f'"{r[0]}"' for r in db.execute(f"describe select * from '{tmp_path}/o/*.parquet'").fetchall()))
    a, b = f"select {cols} from '{tmp_path}/o/*.parquet'", f"select {cols} from ({L.oracle_sql()[name]})"
    assert db.execute(f"select count(*) from ({a})").fetchall() == db.execute(f"select count(*) from ({b})").fetchall()
    assert db.execute(f"({a} except all {b}) union all ({b} except all {a})").fetchall() == []
