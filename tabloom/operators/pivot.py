"""Pivoted headers found without a schema, and tables made long by them.

A header is compound if it reads `prefix / suffix`. Prefixes whose suffixes agree with each other, but for small
differences in spelling, are pivot groups; their suffixes are the measures. Headers are few and repeat over many tables, so a plan
is made once for each distinct header array and used as literal positions by native array expressions.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, is_separator, pipe_cells, pipe_row
from .fuzzy import match_lists

#: Suffixes are the same from this similarity on; so many groups make a pivot.
THRESHOLD, LEAST_GROUPS = 85.0, 2
PLAN = "struct<shared:array<int>,measures:array<string>,groups:array<struct<prefix:string,cols:array<int>>>>"


@lru_cache(maxsize=65536)
def pivot_plan(headers: tuple[str, ...], threshold: float = THRESHOLD, least: int = LEAST_GROUPS) -> dict | None:
    """Positions of shared columns, measure names and, for each group, its prefix and the positions of its measures; null without a pivot.

    Every prefix is tried as the reference, those of most columns first; the one that most others agree with in two suffixes or more wins, the first
    on a tie. What stands under prefixes that don't agree is shared. Measures are the reference's suffixes that all groups have.
    """
    places: dict[str, list[int]] = {}
    shared: list[int] = []
    for i, h in enumerate(headers):
        prefix, slash, _ = h.partition(" / ")
        if slash:
            places.setdefault(prefix.strip(), []).append(i)
        else:
            shared.append(i)
    if len(places) < least:
        return None
    suffixes = {p: [headers[i].partition(" / ")[2].strip() for i in at] for p, at in places.items()}
    order = sorted(places, key=lambda p: -len(places[p]))

    def partners(p: str) -> dict[str, dict[int, int]]:
        found = {q: match_lists(suffixes[p], suffixes[q], threshold) for q in order if q != p}
        return {q: {r: c for r, c, _ in m} for q, m in found.items() if m}

    by_reference = {p: partners(p) for p in order}
    reference = max(order, key=lambda p: len(by_reference[p]))
    agree = by_reference[reference]
    if not agree or len(agree) + 1 < least:
        return None
    common = [r for r in range(len(suffixes[reference])) if all(r in m for m in agree.values())]
    if len(common) < 2:
        return None
    groups = [(reference, [places[reference][r] for r in common])] + [(q, [places[q][m[r]] for r in common]) for q, m in agree.items()]
    shared += [i for p in order if p != reference and p not in agree for i in places[p]]
    return {"shared": sorted(shared), "measures": [suffixes[reference][r] for r in common], "groups": [{"prefix": p, "cols": c} for p, c in groups]}


def detect_pivot(headers: Column | str, threshold: float = THRESHOLD, least: int = LEAST_GROUPS) -> Column:
    """The pivot plan of an array of headers (PLAN); its fields are null without a pivot or with null headers."""

    @F.pandas_udf(PLAN)
    def run(s: pd.Series) -> pd.DataFrame:
        plans = [pivot_plan(tuple(x or "" for x in h), threshold, least) if h is not None else None for h in s]
        return pd.DataFrame([p or {"shared": None, "measures": None, "groups": None} for p in plans], columns=["shared", "measures", "groups"])

    return run(col(headers))


def with_pivot(rows: DataFrame, out: str = "pivot", threshold: float = THRESHOLD, least: int = LEAST_GROUPS) -> DataFrame:
    """Parsed rows (headers, cells, ...) with the plan of their headers, made once for each distinct header array."""
    plans = rows.select("headers").distinct().withColumn(out, detect_pivot("headers", threshold, least))
    return rows.join(plans, "headers")


def unpivot_detected(rows: DataFrame, threshold: float = THRESHOLD, least: int = LEAST_GROUPS) -> DataFrame:
    """One row for each parsed row and pivot group: pivot_name, new headers (shared ones, then measures) and cells. Rows without a pivot pass with a null pivot_name.

    Short rows give empty cells.
    """
    keep = [c for c in rows.columns if c not in ("headers", "cells")]
    planned = with_pivot(rows, "tb_plan", threshold, least)
    cell = lambda i: F.coalesce(F.get("cells", i), F.lit(""))
    at = lambda c: F.transform(c, cell)
    flat = F.array(F.struct(F.lit(0).alias("ord"), F.lit(None).cast("string").alias("pivot_name"), F.col("headers").alias("headers"), F.col("cells").alias("cells")))
    heads = F.concat(F.transform("tb_plan.shared", lambda i: F.get("headers", i)), "tb_plan.measures")
    long = F.transform("tb_plan.groups", lambda g, k: F.struct(k.alias("ord"), g["prefix"].alias("pivot_name"), heads.alias("headers"), F.concat(at(F.col("tb_plan.shared")), at(g["cols"])).alias("cells")))
    one = planned.select(*keep, F.explode(F.when(F.col("tb_plan.groups").isNull(), flat).otherwise(long)).alias("x"))
    return one.select(*keep, F.col("x.ord").alias("group_idx"), "x.pivot_name", "x.headers", "x.cells")


def unpivot_text(docs: DataFrame, text: str = "text", name: str = "_pivot", threshold: float = THRESHOLD, least: int = LEAST_GROUPS) -> DataFrame:
    """Pipe-table texts made long: the text, and was_transformed.

    Title, section and blank lines pass as they are; a data row, totals too, becomes one row for each group. Texts without a
    pivot, and null ones, stay. Only the first table's header counts. All of it happens inside the row.
    """
    lines = F.split(F.col(text), "\n")
    is_row = lambda x: x.rlike(r"^\|(.+\|)\s*$") & ~is_separator(x)
    numbered = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    head = F.get(F.filter(numbered, lambda r: is_row(r["x"])), F.lit(0))
    src = docs.withColumn("tb_head", head).withColumn("tb_headers", pipe_cells(F.col("tb_head.x")))
    plans = src.select("tb_headers").where("tb_headers is not null").distinct().withColumn("tb_plan", detect_pivot("tb_headers", threshold, least))
    src = src.join(plans, "tb_headers", "left")
    plan, here = F.col("tb_plan"), F.col("tb_head.i")
    cell = lambda cells: lambda i: F.coalesce(F.get(cells, i), F.lit(""))
    new_heads = F.concat(F.array(F.lit(name)), F.transform(plan["shared"], lambda i: F.get("tb_headers", i)), plan["measures"])
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size(new_heads)))
    # the separator below the header goes with it
    after = F.get(F.filter(numbered, lambda r: (r["i"] > here) & is_separator(r["x"])), F.lit(0))["i"]
    body = F.filter(numbered, lambda r: (r["i"] > here) & (after.isNull() | (r["i"] > after)))
    wide = lambda cells: F.transform(plan["groups"], lambda g: pipe_row(F.concat(F.array(g["prefix"]), F.transform(plan["shared"], cell(cells)), F.transform(g["cols"], cell(cells)))))
    rows = F.flatten(F.transform(body, lambda r: F.when(is_row(r["x"]), wide(pipe_cells(r["x"]))).otherwise(F.array(r["x"]))))
    before = F.transform(F.filter(numbered, lambda r: r["i"] < here), lambda r: r["x"])
    done = plan["groups"].isNotNull()
    made = F.array_join(F.concat(before, F.array(pipe_row(new_heads), rule), rows), "\n")
    out = src.withColumn(text, F.when(done, made).otherwise(F.col(text))).withColumn("was_transformed", F.coalesce(done, F.lit(False)))
    return out.drop("tb_head", "tb_headers", "tb_plan")
