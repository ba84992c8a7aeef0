"""SQL functions, compiled contracts, the command line, public names, kept latest rows, geography."""

import json
import math

import pytest
from pyspark.sql import functions as F

import tabloom
from tabloom import cli
from tabloom.functions import text as T
from tabloom.functions import values as V
from tabloom.operators import grid as G
from tabloom.operators import layout as L
from tabloom.operators import ontology as O
from tabloom.operators.fuzzy import suggestions
from tabloom.plans import compile as C
from tabloom.sql import register
from tabloom.streaming import events as S


def test_sql_functions(spark):
    names = register(spark)
    assert {"normalize_pipe_table", "cell_type", "fuzz_ratio", "parse_pipe_table", "unpivot_pipe_table", "html_tables"} == set(names)
    texts = ["a “b” – c\t \td \nx  ", "2024-01-31", "$1,000.5", "it's", "", None, "12 kg"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    d.createOrReplaceTempView("tb_texts")
    got = spark.sql("SELECT normalize_pipe_table(x), cell_type(x) FROM tb_texts ORDER BY i").collect()
    want = d.orderBy("i").select(T.normalize_text("x"), T.cell_type("x")).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    assert spark.sql("SELECT fuzz_ratio('Abc', 'abd') AS r, fuzz_ratio(null, 'x') AS n").first()["r"] == pytest.approx(200 * 2 / 6)
    rows = spark.sql("SELECT pivot_name, cells FROM unpivot_pipe_table('| R | A / x | A / y | B / x | B / y |\n|---|---|---|---|---|\n| r | 1 | 2 | 3 | 4 |') ORDER BY 1").collect()
    assert [(r[0], r[1]) for r in rows] == [("A", ["r", "1", "2"]), ("B", ["r", "3", "4"])]
    assert spark.sql("SELECT count(*) FROM parse_pipe_table('| a |\n|---|\n| 1 |\n| 2 |')").first()[0] == 2
    assert spark.sql("SELECT value FROM html_tables('<table><tr><td>v</td></tr></table>')").first()[0] == "v"


NAMES = [("u1", "prefLabel", "en", "Wheat"), ("u1", "altLabel", "en", "Bread wheat"), ("u2", "prefLabel", "en", "Durum"), ("u3", "prefLabel", "en", "Rice"), ("u4", "prefLabel", "en", "rice")]


def _linked(**grounding):
    return {"@context": "x", "provider": "p", "outputs": {"o": {"schema": {"columns": [{"name": "crop", "aliases": ["Grain"], "grounding": grounding}, {"name": "v", "type": "float", "aliases": ["Area"]}]}}}}


def test_compile(spark):
    names = spark.createDataFrame(NAMES, "concept string, kind string, lang string, label string")
    broader = spark.createDataFrame([("u1", "u2")], "broader string, narrower string")
    done = C.compile_contract(spark, _linked(source="thesaurus", concepts=["WHEAT"], include_narrower=1), names, broader)
    aliases = done["outputs"]["o"]["schema"]["columns"][0]["aliases"]
    assert aliases[0] == "Grain" and {"Wheat", "Bread wheat", "Durum"} <= set(aliases) and "@context" not in done
    for bad, what in (({"source": "thesaurus", "concepts": ["rice"]}, "more than one"), ({"source": "thesaurus", "concepts": ["oats"]}, "no concept"), ({"source": "thesaurus"}, "no concept"), ({"source": "x"}, "unknown source"), ({"source": "gazetteer", "country": "R", "level": "ADM1"}, "needs a gazetteer")):
        with pytest.raises(C.ContractError, match=what):
            C.compile_contract(spark, _linked(**bad), names, broader)
    assert C.problems({}) == ["@context is missing", "there are no outputs"]
    geo = spark.createDataFrame([(7, "Here", "R", "ADM1"), (8, "There", "R", "ADM2")], "geoname_id long, name string, country_code string, feature_code string")
    done = C.compile_contract(spark, _linked(source="gazetteer", country="R", level="ADM1"), names, broader, geo)
    assert done["outputs"]["o"]["schema"]["columns"][0]["aliases"] == ["Grain", "Here"]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "c.json").write_text(json.dumps({"provider": "p", "_note": 1, "outputs": {"o": {"schema": {"columns": [{"name": "crop", "aliases": ["Wheat", "Grain"], "concept_uris": [{"uri": "http://x/1"}]}]}}}}))
    nt = '<http://x/1> <http://s#prefLabel> "Wheat"@en .\n<http://x/1> <http://s#altLabel> "Bread wheat"@en .\n'
    (tmp_path / "t.nt").write_text(nt)
    run = lambda *a: cli.main([str(x) for x in a], spark)
    assert run("diff", tmp_path / "c.json", tmp_path / "t.nt") == 0
    said = dict((x.split("\t")[2], x.split("\t")[3]) for x in capsys.readouterr().out.splitlines())
    assert said == {"wheat": "matched", "grain": "manual_only", "bread wheat": "resolved_only"}
    assert run("materialize", tmp_path / "c.json", tmp_path / "t.nt", "--out", tmp_path / "m.json") == 0
    assert "Bread wheat" in (tmp_path / "m.json").read_text()
    assert run("build-context", tmp_path / "c.json", tmp_path / "t.nt", "--out", tmp_path / "x.json") == 0
    (tmp_path / "r.csv").write_text("crop\nWheat\nOats\n")
    assert run("validate", tmp_path / "c.json", tmp_path / "x.json", "o", tmp_path / "r.csv") == 1
    assert run("strip", tmp_path / "c.json") == 0 and "_note" not in capsys.readouterr().out.partition("{")[2]
    assert run("generate-shapes", tmp_path / "c.json") == 0 and "crop" in capsys.readouterr().out
    assert run("analyze", tmp_path / "r.csv", "--out", tmp_path / "a.json") == 0 and json.loads((tmp_path / "a.json").read_text())[0]["samples"] == ["Oats", "Wheat"]
    assert run("compile", tmp_path / "c.json", tmp_path / "t.nt") == 1


def test_public_names():
    for name in tabloom.__all__:
        assert getattr(tabloom, name) is not None
    with pytest.raises(AttributeError):
        tabloom.nothing  # noqa: B018
    assert "parse" in dir(tabloom)


def test_latest_of_a_stream(spark, tmp_path):
    for k, rows in enumerate(([(1, 1, "a"), (2, 5, "b")], [(1, 2, "c"), (2, 4, "d"), (3, 1, "e")])):
        spark.createDataFrame(rows, "k int, t int, v string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = S.keep_latest(S.read_stream(spark, f"{tmp_path}/in", f"{tmp_path}/in"), f"{tmp_path}/out", ["k"], ["t"], f"{tmp_path}/check")
        q.processAllAvailable()
        q.stop()
        assert S.latest_table(spark, f"{tmp_path}/out").count() == 2 + k
    assert {tuple(r) for r in S.latest_table(spark, f"{tmp_path}/out").collect()} == {(1, 2, "c"), (2, 5, "b"), (3, 1, "e")}
    assert S.latest_table(spark, f"{tmp_path}/none") is None


def test_numbers_that_are_none(spark):
    d = spark.createDataFrame([(math.nan,), (math.inf,), (-math.inf,), (None,), (1234.5,)], "x double")
    assert [r[0] for r in d.select(V.format_number("x", "#,###.##")).collect()] == ["nan", "inf", "-inf", None, "1,234.50"]


def test_keywords(spark):
    texts = ["Exports of grain", "exporting  grains", "export-grain", "re export", "reexport", "grain\nexported", "CO2 price", "co2s", "xco2", None]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    hits = lambda k: [r[0] for r in d.select(T.keyword_matches("t", k)).collect()]
    assert hits("export") == [True, True, True, True, False, True, False, False, False, None]
    assert hits("export grain") == [False, True, False, False, False, False, False, False, False, None]
    assert hits("exporting grain") == [False, True, False, False, False, False, False, False, False, None]
    assert hits("co2") == [False, False, False, False, False, False, True, True, False, None]


def test_equal_spans_stay(spark):
    s = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 0, "a"), (1, 0, 9, "b")], "page int, row int, col int, text string")
    c = spark.createDataFrame([(1, 0), (1, 10)], "page int, start int")
    assert G.nearest_column(s, c, ["page"], "col", "start", 2).count() == 3
    grid = {r["column_start"]: r["text"] for r in L.to_grid(s, c, ["page"]).collect()}
    assert grid == {0: "a a", 10: "b"}
    h = s.select("page", F.col("col").alias("lo"), (F.col("col") + 3).alias("hi"))
    b = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 8, 20)], "page int, col_idx int, col_lo int, col_hi int")
    assert sorted(r["col_idx"] for r in G.header_overlap(h, b, ["page"]).collect()) == [0, 0, 1]


def test_layout_pieces(spark):
    cells = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 10, "b"), (1, 0, 100, "c"), (1, 0, 200, " ")], "page int, row int, column_start int, text string")
    grids = spark.createDataFrame([(1, 0, 0), (1, 10, 0), (1, 100, 1), (1, 200, 2)], "page int, start int, grid long")
    got = {r["text"]: (r["grid"], r["col_idx"]) for r in L.split_grids(cells, grids, ["page"]).collect()}
    assert got == {"a": (0, 0), "b": (0, 1), "c": (1, 0)}
    body = spark.createDataFrame([(1, 0, "p", "T1"), (1, 1, "p", " "), (1, 2, "tbl", ""), (1, 3, "tbl", ""), (1, 4, "p", "T2"), (1, 5, "tbl", "")], "d int, o int, k string, t string")
    assert [r["title"] for r in G.title_paragraph(body, ["d"], "o", "k", "t").orderBy("o").collect()] == ["T1", None, "T2"]
    regions = spark.createDataFrame([(1, 0, "heading", "H"), (1, 1, "scattered", ""), (1, 2, "table", ""), (1, 3, "table", ""), (1, 4, "heading", "x" * 50), (1, 5, "table", "")], "d int, o int, k string, t string")
    assert [r["label"] for r in G.label_above(regions, ["d"], "o", "k", "t").where("k = 'table'").orderBy("o").collect()] == ["H", None, None]


def test_geography(spark, tmp_path):
    f = spark.createDataFrame([(1, "Zürich", "Zurich", "CH", "PPL", 5, 1.0, 2.0, "01"), (2, "New Zurich", "New Zurich", "US", "PPL", None, 3.0, 4.0, "02")], "geoname_id long, name string, asciiname string, country_code string, feature_code string, population long, lat double, lng double, admin1_code string")
    assert [r["geoname_id"] for r in O.search_features(f, "zurich").collect()] == [1, 2]
    assert [r["geoname_id"] for r in O.search_features(f, "Zurich", country="US").collect()] == [2] and O.search_features(f, "zurich", limit=1).count() == 1
    u = spark.createDataFrame([("https://x/1/",), ("https://x/9",)], "uri string")
    assert [(r["geoname_id"], r["lat"]) for r in O.enrich_features(u, f).orderBy("geoname_id").collect()] == [(1, 1.0), (9, None)]
    (tmp_path / "a.txt").write_text("1\t7\ten\tSeven\t1\t\t\t\n2\t7\tlink\thttp://x\t\t\t\t\n3\t7\t\tSept\t\t\t\t\n")
    assert sorted(r["name"] for r in O.read_alternate_names(spark, str(tmp_path / "a.txt")).collect()) == ["Sept", "Seven"]
    got = spark.createDataFrame([("frnce",), (None,)], "t string").select(suggestions(F.col("t"), ["Germany", "France", "Greece"])).collect()
    assert [s["label"] for s in got[0][0]][0] == "France" and got[1][0] == []
