"""Mapping tables to a contract's columns: one plan per table, applied to its rows inside the row that holds the table.

A plan says, for each group of an output row, from which cell or from which text each column comes. It depends on headers, title and
column kinds only, so it is made once for a table, before its rows are exploded; applying it takes no join and no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_numeric, normalize_text, pipe_cells, ustrip
from ..operators.tables import section_label, table_lines

PLAN = "array<struct<cells:map<string,int>,texts:map<string,string>>>"
#: Kinds whose value is the text of a header; the others take the cell.
TEXT_KINDS = frozenset(["string", "date"])


def alias_key(text: str) -> str:
    """As functions.text.normalize_alias, on the driver."""
    s = " ".join(text.lower().replace('"', "").split())
    return " ".join(re.sub(r"\s*\)\s*", ") ", re.sub(r"\s*\(\s*", " (", s)).split(" ")).strip()


class Mapper:
    """Plans for one output's mapped columns: (name, kind, aliases) in contract order."""

    def __init__(self, columns: Sequence[tuple[str, str, Sequence[str]]]):
        self.kinds = {name: kind for name, kind, _ in columns}
        self.owners: dict[str, list[str]] = {}
        for name, _, aliases in columns:
            for a in aliases:
                self.owners.setdefault(alias_key(a), []).append(name)
        self.labels = [(name, {a.lower() for a in aliases}) for name, _, aliases in columns]
        self._known: dict[tuple, list[dict] | None] = {}

    def plan(self, headers: tuple[str, ...], title: str | None, blank: tuple[int, ...]) -> list[dict] | None:
        """As _plan, which equal tables ask once for each worker."""
        key = (headers, title, blank)
        if key not in self._known:
            if len(self._known) >= 65_536:
                self._known.clear()
            self._known[key] = self._plan(*key)
        return self._known[key]

    def owned(self, text: str) -> list[str]:
        """Columns that a text names: as it is, else by what stands before its first comma.

        Columns of several roles (text and number, or float and int) are all named; of one role only the first is.
        """
        found = self.owners.get(alias_key(text)) or (self.owners.get(alias_key(text.split(",")[0]), []) if "," in text and text.split(",")[0].strip() else [])
        kinds = {self.kinds[c] for c in found}
        several = kinds & TEXT_KINDS and kinds - TEXT_KINDS or {"int", "float"} <= kinds
        return found if several else found[:1]

    def _title(self, title: str) -> list[str]:
        """Text columns that a title names, as a whole or by an alias of three characters or more in it."""
        whole = [c for c in self.owned(title) if self.kinds[c] in TEXT_KINDS]
        if whole:
            return whole
        key = alias_key(title)
        inside = [c for a, names in self.owners.items() if len(a) >= 3 and re.search(rf"\b{re.escape(a)}\b", key) for c in names if self.kinds[c] in TEXT_KINDS]
        return list(dict.fromkeys(inside))

    def _plan(self, headers: tuple[str, ...], title: str | None, blank: tuple[int, ...]) -> list[dict] | None:
        """`blank` are the positions of headerless columns of text. Null if no column is found."""
        said: list[list[tuple[str, str]]] = []  # for each header, columns that take a part's text
        measured: list[list[str]] = []  # and columns that take the cell
        shared: dict[int, str] = {}
        for pos, header in enumerate(headers):
            parts = [p.strip() for p in header.split(" / ")]
            named = [(p, self.owned(p)) for p in parts]
            if len(parts) > 1 and not any(names for _, names in named) and (whole := self.owned(" ".join(parts))):
                named = [(" ".join(parts), whole)]
            texts, cells = [], []
            for part, names in named:
                pseudo = any(self.kinds[c] == "float" for c in names)  # beside a float an int is a label, such as a year
                for c in names:
                    if self.kinds[c] in TEXT_KINDS or pseudo and self.kinds[c] == "int":
                        texts.append((c, part))
                    else:
                        cells.append(c)
            said.append(texts)
            measured.append(cells)
            if len(named) == 1 and named[0][1] and all(self.kinds[c] in TEXT_KINDS for c in named[0][1]):
                shared[pos] = named[0][1][0]

        def claimed() -> set[str]:
            return {c for t in said for c, _ in t} | {c for m in measured for c in m} | set(shared.values()) | set(constant)

        constant: dict[str, str] = {}
        by_title = self._title(title) if title else []
        of_title = {by_title[0]: title} if len(by_title) == 1 and by_title[0] not in claimed() else {}
        bare = [p for p in blank if not said[p] and not measured[p]]
        free = [c for c, k in self.kinds.items() if k == "string" and c not in claimed() and c not in of_title]
        if len(bare) == 1 and len(free) == 1:
            shared[bare[0]] = free[0]
        values: dict[str, list[str]] = {}
        for texts in said:
            for c, part in texts:
                values.setdefault(c, []).append(part)
        varying = {c for c, v in values.items() if len(set(v)) > 1}
        constant |= {c: v[0] for c, v in values.items() if c not in varying and len(v) > 1}
        constant = {**of_title, **constant}
        for pos, texts in enumerate(said):
            # a label column of several levels: the last one names the cell, the others hold for the whole table
            if pos in shared or measured[pos] or not texts or any(c in varying for c, _ in texts):
                continue
            if any(c not in constant and c not in shared.values() for c, _ in texts):
                shared[pos] = texts[-1][0]
                for c, part in texts[:-1]:
                    constant.setdefault(c, part)
        groups: dict[tuple, dict] = {}
        for pos, (texts, cells) in enumerate(zip(said, measured, strict=True)):
            own = [(c, part) for c, part in texts if c in varying] if varying else []
            if varying and (pos in shared or not own and not cells) or not varying and not cells:
                continue
            g = groups.setdefault(tuple(sorted(own)), {"cells": {}, "texts": {**dict(own), **constant}})
            g["cells"] |= dict.fromkeys(cells, pos)
        if not groups and shared and not varying:
            groups[()] = {"cells": {}, "texts": dict(constant)}
        for g in groups.values():
            for pos, c in shared.items():
                if c not in g["texts"]:
                    g["cells"].setdefault(c, pos)
        return list(groups.values()) or None

    def column(self, headers: Column, title: Column, blank: Column) -> Column:
        mapper = self

        @F.pandas_udf(PLAN)
        def run(h: pd.Series, t: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([mapper.plan(tuple(x or "" for x in hs), ti, tuple(bs)) if hs is not None else None for hs, ti, bs in zip(h, t, b, strict=True)])

        # so marked it is evaluated where it stands, once, and not again in what is computed from it
        return run.asNondeterministic()(headers, title, blank)


def mapped_rows(docs: DataFrame, columns: Sequence[tuple[str, str, Sequence[str]]], text: str = "text", keep_unsectioned: bool = False) -> DataFrame:
    """Records (text) of the first table of each pipe text: the other columns, title, row_idx, group_idx, and the mapped columns.

    Totals (a doubled first pipe), separators and repeated headers are no rows. Where the table has section labels (`**LABEL**`, or a row of only a first cell)
    and the first column whose aliases hold one of them takes it; rows before the first label are left out then, unless `keep_unsectioned`.
    Texts without a table, and tables of which no column is known, give nothing.
    """
    mapper = Mapper(columns)
    keep = [c for c in docs.columns if c != text]
    names = [n for n, _, _ in columns]
    src = docs.select(*keep, table_lines(normalize_text(text)).alias("tb")).where("tb.header is not null")
    headers = pipe_cells("tb.header")
    rows = F.transform("tb.rows", lambda r: F.struct(r["section"].alias("section"), pipe_cells(r["line"]).alias("cells")))
    src = src.select(*keep, F.col("tb.title").alias("title"), headers.alias("tb_headers"), rows.alias("tb_rows"))
    filled = lambda i: F.filter(F.transform("tb_rows", lambda r: F.coalesce(F.get(r["cells"], i), F.lit(""))), lambda c: ustrip(c) != "")
    texts = lambda i: F.size(F.filter(filled(i), lambda c: ~is_numeric(c))) * 2 > F.size(filled(i))
    bare = F.filter(F.transform("tb_headers", lambda h, i: F.when(h == "", i).otherwise(-1)), lambda i: i >= 0)
    blank = F.filter(bare, lambda i: (F.size(filled(i)) > 0) & texts(i))
    # a generator of one row keeps these expressions out of the function's arguments, where they could not be evaluated
    src = src.select(*keep, F.inline(F.array(F.struct("title", "tb_headers", "tb_rows", blank.alias("tb_blank")))))
    src = src.withColumn("tb_plan", mapper.column(F.col("tb_headers"), F.col("title"), F.col("tb_blank"))).where("tb_plan is not null")
    labels = F.array_distinct(F.transform(F.filter("tb_rows", lambda r: r["section"].isNotNull()), lambda r: F.lower(r["section"])))
    owner = F.lit(None).cast("string")
    for name, aliases in reversed(mapper.labels):
        if aliases:
            owner = F.when(F.arrays_overlap(labels, F.array(*[F.lit(a) for a in sorted(aliases)])), name).otherwise(owner)
    src = src.withColumn("tb_owner", owner).withColumn("tb_labelled", F.size(labels) > 0)
    one = src.select(*keep, "title", "tb_plan", "tb_owner", "tb_labelled", F.posexplode("tb_rows").alias("row_idx", "tb_row"))
    if not keep_unsectioned:
        one = one.where("not tb_labelled or tb_row.section is not null")
    one = one.select(*keep, "title", "row_idx", "tb_owner", "tb_row", F.posexplode("tb_plan").alias("group_idx", "tb_group"))
    cell = lambda n: F.coalesce(F.get("tb_row.cells", F.try_element_at("tb_group.cells", F.lit(n))), F.try_element_at("tb_group.texts", F.lit(n)))
    value = lambda n: F.when((F.col("tb_owner") == n) & F.col("tb_row.section").isNotNull(), F.col("tb_row.section")).otherwise(cell(n))
    return one.select(*keep, "title", "row_idx", "group_idx", *[value(n).alias(n) for n in names])
