"""Sections, transposed tables, fuzzy matching, metadata, and the entry module without its optional part."""

import difflib
import random
import shutil
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from tabloom.operators.fuzzy import best_term, match_lists, ratio
from tabloom.operators.metadata import Field, quick_scan, with_fallbacks
from tabloom.operators.tables import section_rows

ROOT = Path(__file__).resolve().parent.parent


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_ratio_is_lcs():
    rng = random.Random(0)
    for _ in range(300):
        a, b = ("".join(rng.choices("abcd ", k=rng.randrange(90))) for _ in range(2))
        want = 200 * lcs(a, b) / (len(a) + len(b)) if a and b else 100.0 * (a == b)
        assert abs(ratio(a, b) - want) < 1e-9
    assert ratio("abc", "abd") >= 200 * sum(m.size for m in difflib.SequenceMatcher(None, "abc", "abd").get_matching_blocks()) / 6
    assert match_lists(["Area sown", "Yield"], ["yield", "Area sowns", "x"]) == [(0, 1, ratio("area sown", "area sowns")), (1, 0, 100.0)]
    assert match_lists(["a"], ["a"]) is None


def test_best_term(spark):
    d = spark.createDataFrame([("Totals",), (None,), ("zzz",)], "t string")
    assert [r["b"]["term"] for r in d.select(best_term(F.col("t"), ["total", "totals"]).alias("b")).collect()] == ["totals", None, None]


def test_sections():
    text = "## T\n| A | B |\n|---|---|\n| X | |\n| 1 | 2 |\n| A | B |\n**Y**\n| 3 |\n|| Sum | 5 |"
    assert section_rows(text) == [("T", "X", ["A", "B"], 0, False, ["1", "2"]), ("T", "Y", ["A", "B"], 1, False, ["3", ""]), ("T", "Y", ["A", "B"], 2, True, ["Sum", "5"])]
    assert section_rows("") == [] and section_rows("| a |\n| b |\n| c | d |\n| 1 | 2 |")[-1][2:] == (["c", "d"], 0, False, ["1", "2"])


def test_metadata(spark):
    lines = spark.createDataFrame([(1, 0, 0.9, "as of 2020"), (1, 0, 0.1, "of 1999"), (2, 5, 0.1, "of 2001")], "doc int, page_no int, y double, text string")
    fields = [Field("year", ("header", "footer"), (r"of (\d{4})",)), Field("who", default="nobody"), Field("must", required=True)]
    got = {(r["doc"], r["field"]): (r["value"], r["confidence"], r["is_missing"]) for r in with_fallbacks(quick_scan(lines, "doc", fields[:1]), "doc", fields).collect()}
    assert got == {(1, "year"): ("1999", 0.9, False), (2, "year"): (None, 0.0, False)}


def test_entry_without_optional_part(tmp_path):
    shutil.copytree(ROOT / "tabloom", tmp_path / "tabloom", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'wide_report_roundtrip' in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""})
    assert out.returncode == 0, out.stderr
