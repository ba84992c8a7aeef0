"""Queries against their SQL on tables where an earlier version failed."""

import datetime as dt
import random
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from tabloom import queries as Q
from tabloom.operators import fuzzy
from tabloom.operators import layout as L
from tabloom.operators.fuzzy import best_term


def same_as_sql(spark, name, folder, *tables):
    db = duckdb.connect()
    for t in tables:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = Counter(tuple(r) for r in Q.QUERIES[name](spark, str(folder)).collect())
    assert got and got == Counter(db.execute(Q.ORACLES[name]).fetchall())


def test_gap_clusters_parts_of_seconds(spark, tmp_path):
    """Seconds are rounded, halves to even; cut off, users 1, 2 and 4 come out otherwise."""
    at = {1: (0.4, 3600.6), 2: (0.6, 3601.4), 3: (0.5, 3601.5), 4: (1.5, 3602.5), 5: (-3601.6, 0.0), 6: (5.0, 3605.0, 7206.0), None: (0.4, 3600.6)}
    rows = [(u, dt.datetime(1970, 1, 1) + dt.timedelta(seconds=s)) for u, seconds in at.items() for s in seconds] + [(6, None), (7, None)]
    spark.createDataFrame(rows, "user_id long, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    same_as_sql(spark, "gap_clusters", tmp_path, "events")


def test_titles_below_a_filter_are_scored_once(spark):
    """The filter was moved below the projection and scored all titles once more."""
    hit = spark.createDataFrame([(i, f"title {i % 3}") for i in range(30)], "i int, t string").withColumn("b", best_term(F.col("t"), ["title 1", "title 2"], 100.0)).where("b.term is not null").select("i", "b.term")
    assert hit._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert Counter(r[1] for r in hit.collect()) == {"title 1": 10, "title 2": 10}


def test_scores_out_of_reach_are_not_worked_out(monkeypatch):
    """A score at or above `least` is the whole one; what can't reach it takes no subsequence (106 of them before)."""
    rng, tried = random.Random(3), []
    words = ["a", "ab", "ba", "nation_1", "nation_10", "of", "x y", "\t", ""]
    for _ in range(2000):
        a, b = (" ".join(rng.choice(words) for _ in range(rng.randint(0, 5))) for _ in "ab")
        whole = fuzzy.weighted_ratio(a, b)
        for least in (whole, 85.5, 90.0, 95.0, 100 * rng.random()):
            got = fuzzy.weighted_ratio(a, b, least)
            assert got == whole if whole >= least else got < least
    monkeypatch.setattr(fuzzy, "ratio", lambda a, b: tried.append((a, b)) or 0.0)
    assert fuzzy.weighted_ratio("exports of nation_1 by month", "nation_2", 90.0) == 0.0 and not tried


def test_titles_of_one_file_are_dealt_out(spark, tmp_path):
    """All titles were scored by the task that read them."""
    spark.createDataFrame([(i, f"NATION_{i}") for i in range(25)], "n_nationkey int, n_name string").coalesce(1).write.parquet(f"{tmp_path}/nation.parquet")
    spark.range(400).selectExpr("id AS p_partkey", "'red bolt' AS p_name").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = Q.fuzzy_title_join(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() >= 4 and got.count() == 300


def test_transposed_in_one_pass(spark, tmp_path):
    """Hash tables of all rows of a task's pages stood side by side, and the spans were read and shuffled more than once."""
    spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").write.parquet(f"{tmp_path}/lineitem.parquet")
    plan = Q.transposed_test(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 3 and "HashAggregate" not in plan
    same_as_sql(spark, "transposed_test", tmp_path, "lineitem")


def test_transposed_with_columns_given(spark):
    spans = [(1, 0, y, x) for y in range(4) for x in (0, 9)] + [(2, 0, 0, 0), (2, 0, 0, 5), (2, 0, 1, 0)] + [(3, 0, y, 7) for y in range(5)]
    s = spark.createDataFrame(spans, "doc int, page_no int, row int, col int")
    wide = s.groupBy("doc", "page_no").agg(F.countDistinct("col").alias("n_columns"))
    want = [(1, 0, True), (2, 0, False), (3, 0, False)]
    assert sorted(map(tuple, L.transposed(s, wide).collect())) == sorted(map(tuple, L.transposed(s).collect())) == want


def test_equal_places_are_one_row(spark):
    """Equal y, infinite ones too, are one row; spans without y or page have none."""
    inf, spans = float("inf"), []
    for y in (1.0, 1.0, 5.5, inf, inf, None):
        spans.append((1, 0, 0.0, y, 12.0, "ab"))
    got = L.page_layout(spark.createDataFrame([*spans, (None, 0, 0.0, 1.0, 12.0, "ab")], "doc int, page_no int, x double, y double, width double, text string"), 4.0)
    assert sorted((r["doc"], r["y"], r["row"]) for r in got.collect()) == [(1, 1.0, 0), (1, 1.0, 0), (1, 5.5, 1), (1, inf, 2), (1, inf, 2)]
