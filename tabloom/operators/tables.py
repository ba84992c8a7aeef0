"""Pipe tables: rendering, parsing, unpivoting, classifying, mapping to a schema."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, compound_parts, header_tokens, is_separator, jaccard, keyword_hit, keyword_matches, keyword_text, normalize_alias, normalize_text, pipe_cells, pipe_row


def render(rows: DataFrame, doc: str, label: str, header: str, value: str, corner: str) -> DataFrame:
    """(doc, text): one pipe table per document, a line per label and a column per header, both in order.

    Cells are grouped per line before lines are per document; a document's table must fit in a row.
    """
    heads = rows.groupBy(doc).agg(F.sort_array(F.collect_set(header)).alias("heads"))
    line = rows.groupBy(doc, label).agg(F.map_from_entries(F.collect_list(F.struct(F.col(header), F.col(value).cast("string")))).alias("m"))
    cells = F.concat(F.array(F.col(label)), F.transform("heads", lambda h: F.coalesce(F.try_element_at(F.col("m"), h), F.lit(""))))
    lines = line.join(heads, doc).select(doc, "heads", F.struct(F.col(label).alias("k"), pipe_row(cells).alias("t")).alias("r"))
    out = lines.groupBy(doc).agg(F.first("heads").alias("heads"), F.sort_array(F.collect_list("r")).alias("rs"))
    head = pipe_row(F.concat(F.array(F.lit(corner)), "heads"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size("heads") + 1))
    return out.select(doc, F.concat_ws("\n", head, rule, F.transform("rs", lambda r: r["t"])).alias("text"))


def parse(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows of the first pipe table of each text: the other columns, title, headers, row_idx, is_total, cells.

    Lines before the header give the title (`## ...`); separators, blank lines and repeated headers are
    dropped; a doubled first pipe marks a total. Everything happens inside the row, so there is no shuffle.
    """
    keep = [c for c in docs.columns if c != text]
    lines = F.split(normalize_text(text), "\n")
    table = F.filter(lines, lambda x: x.startswith("|") & ~is_separator(x))
    titles = F.filter(lines, lambda x: x.startswith("## "))
    src = docs.select(*keep, table.alias("t"), F.regexp_replace(F.get(titles, F.lit(0)), r"^##\s+", "").alias("title")).where(F.size("t") > 0)
    src = src.withColumn("headers", pipe_cells(F.col("t")[0]))
    body = F.filter(F.slice(F.col("t"), 2, 1 << 30), lambda x: x != F.col("t")[0])
    rows = src.select(*keep, "title", "headers", F.posexplode(body).alias("row_idx", "line"))
    total = F.col("line").startswith("||")
    return rows.select(*keep, "title", "headers", "row_idx", total.alias("is_total"), pipe_cells(F.regexp_replace("line", r"^\|\|", "|")).alias("cells"))


def section_label(line: Column) -> Column:
    """The label of a `**LABEL**` line or of a row with only its first cell; null for other lines."""
    cells = pipe_cells(line)
    lone = (F.size(cells) > 1) & (cells[0] != "") & F.forall(F.slice(cells, 2, 1 << 30), lambda c: c == "")
    bold = F.regexp_extract(line, r"^\*\*(.+?)\*\*\s*$", 1)
    return F.when(bold != "", F.trim(bold)).when(line.startswith("|") & ~line.startswith("||") & lone, cells[0])


def table_lines(text: Column) -> Column:
    """The first table of a normalised text: struct(title, header, rows), rows an array of (section, line) without totals.

    Title is the last `## ` line before the header. Separators and repeated headers are no rows; a section label holds for the rows below it.
    """
    lines = F.filter(F.split(text, "\n"), lambda x: x.startswith("|") | x.startswith("## ") | x.startswith("**"))
    lines = F.filter(lines, lambda x: ~is_separator(x))
    header = F.get(F.filter(lines, lambda x: x.startswith("|") & section_label(x).isNull()), F.lit(0))
    title = F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(F.slice(lines, 1, F.greatest(F.array_position(lines, header).cast("int") - 1, F.lit(0))), lambda x: x.startswith("## "))), -1)
    marked = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("line"), section_label(x).alias("label")))
    labels = F.filter(marked, lambda m: m["label"].isNotNull())  # few
    body = F.filter(marked, lambda m: m["label"].isNull() & m["line"].startswith("|") & ~m["line"].startswith("||") & (m["line"] != header))
    above = lambda m: F.try_element_at(F.filter(labels, lambda k: k["i"] < m["i"]), F.lit(-1))["label"]
    rows = F.transform(body, lambda m: F.struct(above(m).alias("section"), m["line"].alias("line")))
    return F.struct(F.regexp_replace(title, r"^##\s+", "").alias("title"), header.alias("header"), rows.alias("rows"))


def unpivot(rows: DataFrame, shared: int = 1) -> DataFrame:
    """One row per parsed row and prefix of compound headers: pivot_name, the shared cells, measure and value.

    Headers after the first `shared` ones are `prefix / suffix`; short rows give empty cells.
    """
    keep = [c for c in rows.columns if c not in ("headers", "cells")]
    cell = F.posexplode(F.slice(F.col("headers"), shared + 1, 1 << 30)).alias("pos", "header")
    long = rows.select(*keep, F.slice("cells", 1, shared).alias("shared"), "cells", cell)
    value = F.coalesce(F.get("cells", F.col("pos") + shared), F.lit(""))
    return long.select(*keep, "shared", F.substring_index("header", " / ", 1).alias("pivot_name"), F.regexp_replace("header", r"^.*? / ", "").alias("measure"), value.alias("value"))


def classify(tables: DataFrame, text: Column | str, categories: dict[str, list[str]]) -> Column:
    """Name of the category with most keyword hits, the first on a tie, `other` with none."""
    def one(prepared: Column) -> Column:
        hits = {k: [keyword_hit(prepared, w) if re.fullmatch(r"[A-Za-z\s]+", w) else keyword_matches(text, w) for w in ws] for k, ws in categories.items()}
        return F.struct(*[sum((F.when(h, 1).otherwise(0) for h in hs), F.lit(0)).alias(k) for k, hs in hits.items()])

    # the text is made ready once for all keywords: as the only element of an array it is bound to a variable
    scores = F.transform(F.array(keyword_text(text)), one)[0]
    score = {k: scores[k] for k in categories}
    best = F.greatest(*score.values()) if len(score) > 1 else next(iter(score.values()))
    out = F.when(best <= 0, "other")
    for k, s in score.items():
        out = out.when(s == best, k)
    return out


def similarity(cols_a: Column, tokens_a: Column, cols_b: Column, tokens_b: Column) -> Column:
    """Half the ratio of column counts, half the Jaccard similarity of header tokens."""
    ratio = F.when(F.greatest(cols_a, cols_b) > 0, F.least(cols_a, cols_b) / F.greatest(cols_a, cols_b)).otherwise(0.0)
    return 0.5 * ratio + 0.5 * jaccard(tokens_a, tokens_b)


def title_tokens(x: Column | str) -> Column:
    return header_tokens(F.regexp_replace(col(x), " / ", " "))


def parse_sections(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """As parse(), with the section that a row stands in: (key, title, section, headers, row_idx, is_total, cells).

    A section is a line `**LABEL**` or a row with only its first cell filled. A later header of twice as many
    columns or more begins the table anew; repeated headers are dropped. Sequential, hence one pass in Python.
    """
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, title string, section string, headers array<string>, row_idx int, is_total boolean, cells array<string>"

    def run(batches):
        for b in batches:
            out = {c: [] for c in ("k", "title", "section", "headers", "row_idx", "is_total", "cells")}
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for row in section_rows(t or ""):
                    for c, v in zip(out, (k, *row), strict=True):
                        out[c].append(v)
            types = [b.schema.field(0).type, pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.bool_(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=[key, *list(out)[1:]])

    return docs.select(key, normalize_text(text).alias(text)).mapInArrow(run, schema)


def section_rows(text: str) -> list[tuple]:
    """(title, section, headers, row_idx, is_total, cells) of one text."""
    title = section = headers = None
    rows: list[tuple] = []
    for line in text.split("\n"):
        line = line.strip()
        if line.startswith("## "):
            title = line[3:].strip()
        elif line.startswith("**") and line.endswith("**") and len(line) > 4:
            section = line[2:-2].strip()
        elif line.startswith("|"):
            total = line.startswith("||")
            cells = [c.strip() for c in line[1 + total :].removesuffix("|").split("|")]
            if all(set(c) <= set("-:") for c in cells) and any(cells):
                continue
            if headers is None or len(cells) >= 2 * len(headers):
                headers, rows, section = cells, [], None if headers else section
            elif cells == headers:
                continue
            elif not total and len(cells) > 1 and cells[0] and not any(cells[1:]):
                section = cells[0]
            else:
                rows.append((title, section, headers, len(rows), total, (cells + [""] * len(headers))[: max(len(headers), len(cells))]))
    return rows


def map_transposed(rows: DataFrame, aliases: DataFrame, columns: list[str]) -> DataFrame:
    """Records from tables whose first column holds the aliases and each further column one record.

    Tables of two to five columns of which at least half the schema's columns are matched; others give
    nothing. The last of several aliases for a label wins.
    """
    keep = [c for c in rows.columns if c not in ("headers", "cells", "row_idx", "is_total")]
    every = rows.where(F.size("cells").between(2, 5))
    # the header row is a labelled row like the others
    first = every.select(*keep, F.col("headers").alias("cells")).distinct()
    both = first.unionByName(every.select(*keep, "cells"))
    look = aliases.groupBy(normalize_alias("alias").alias("tb_alias")).agg(F.max("column").alias("tb_column"))
    hit = both.join(look, normalize_alias(F.col("cells")[0]) == F.col("tb_alias"))
    cells = hit.select(*keep, "tb_column", F.posexplode(F.slice("cells", 2, 4)).alias("record_idx", "value"))
    out = cells.groupBy(*keep, "record_idx").agg(F.countDistinct("tb_column").alias("tb_n"), *[F.max(F.when(F.col("tb_column") == c, F.col("value"))).alias(c) for c in columns])
    return out.where(F.col("tb_n") * 2 >= len(columns)).drop("tb_n")
