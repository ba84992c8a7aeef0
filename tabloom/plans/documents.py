"""Documents end to end: pages and tables of their texts, categories, outputs of a contract, records and files.

A document is a text of pages (form feeds between them) whose tables are pipe tables. Everything runs over all documents at once: one plan
for each output of the contract, one write for each output.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import header_tokens, jaccard, normalize_text, pipe_cells, years
from ..functions.values import format_date
from ..operators.tables import classify, table_lines
from .contract import Contract, OutputSpec, interpret, save

PAGE_BREAK = "\f"
#: A line that begins a table of its own: a header before its separator, with the title above it.
_TABLE = r"(?m)^((?:##[^\n]*\n(?:[ \t]*\n)*)?\|[^\n]*\n\|[\s\-:|]+\|[ \t]*$)"
_MARK = "\x1d"


def split_pages(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row for each page that isn't blank: the other columns, page_no (from 0, blank pages counted) and the page's text, normalised after the split."""
    keep = [c for c in docs.columns if c != text]
    pages = docs.select(*keep, F.posexplode(F.split(text, PAGE_BREAK)).alias("page_no", text))
    return pages.where(~F.col(text).rlike(r"(?U)^\s*$")).withColumn(text, normalize_text(text))


def select_numbers(df: DataFrame, column: str, wanted: Sequence[int] | None) -> DataFrame:
    """Rows of the wanted pages, slides, sheets or tables; all of them for None. Numbers that don't exist are ignored."""
    return df if wanted is None else df.where(F.col(column).isin(list(wanted)))


def split_tables(pages: DataFrame, text: str = "text") -> DataFrame:
    """One row for each table of a page: the other columns, table_idx (from 0), its text, title, headers, n_rows (no totals) and n_cols.

    A table begins at a header that a separator follows, or at the `## ` line right above it; a page without a separator but with pipe lines is one table.
    """
    keep = [c for c in pages.columns if c != text]
    blocks = F.filter(F.split(F.regexp_replace(text, _TABLE, _MARK + "$1"), _MARK), lambda b: b.rlike(r"(?m)^\|"))
    one = pages.select(*keep, F.posexplode(blocks).alias("table_idx", text)).withColumn("tb", table_lines(F.col(text))).where("tb.header is not null")
    heads = pipe_cells("tb.header")
    return one.select(*keep, "table_idx", text, F.col("tb.title").alias("title"), heads.alias("headers"), F.size("tb.rows").alias("n_rows"), F.size(heads).alias("n_cols"))


def table_tokens() -> Column:
    """Header tokens of a table's title and headers."""
    return header_tokens(F.concat_ws(" ", F.lower("title"), F.lower(F.regexp_replace(F.array_join("headers", " "), " / ", " "))))


def category_profiles(tables: DataFrame) -> DataFrame:
    """(category, n, mean_cols, tokens) of classified tables, `other` left out; tokens are the union of all of a category's."""
    known = tables.where("category <> 'other'")
    size = known.groupBy("category").agg(F.count("*").alias("n"), F.avg("n_cols").alias("mean_cols"))
    words = known.select("category", F.explode(table_tokens()).alias("token")).distinct().groupBy("category").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    return size.join(words, "category", "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))


def classify_tables(tables: DataFrame, categories: dict[str, list[str]], min_rows: int = 0, propagate: bool = False, threshold: float = 0.3) -> DataFrame:
    """`tables` (title, headers, n_rows, n_cols) with `category`: that of most keyword hits in title and headers, the first on a tie, else `other`.

    Tables of fewer than `min_rows` rows are `other`. With `propagate` they and the unmatched ones take the category whose
    profile they are most similar to (half the ratio of column counts, half the Jaccard similarity of tokens), if above the threshold.
    """
    head = F.concat_ws(" ", F.lower("title"), F.regexp_replace(F.lower(F.array_join("headers", " ")), " / ", " "))
    out = tables.withColumn("category", F.when(F.col("n_rows") < min_rows, "other").otherwise(classify(tables, head, categories)))
    if not propagate:
        return out
    # as many profiles as the contract has categories, so they are read to the driver and become part of the expression
    profiles = {r["category"]: r for r in category_profiles(out).collect()}
    best = F.lit("other")
    top = F.lit(float(threshold))
    for name in categories:
        if p := profiles.get(name):
            words = F.array(*[F.lit(t) for t in p["tokens"]]) if p["tokens"] else F.array().cast("array<string>")
            mean = F.lit(float(p["mean_cols"]))
            ratio = F.when(F.greatest("n_cols", mean) > 0, F.least("n_cols", mean) / F.greatest("n_cols", mean)).otherwise(0.0)
            score = 0.5 * ratio + 0.5 * jaccard(table_tokens(), words)
            best, top = F.when(score > top, name).otherwise(best), F.greatest(score, top)
    return out.withColumn("category", F.when(F.col("category") == "other", best).otherwise(F.col("category")))


def route(tables: DataFrame, outputs: Sequence[OutputSpec], doc: str, whole_documents: bool = False) -> DataFrame:
    """Tables once for each output of their category, with `output`; with `whole_documents` all tables of a document that has one of the category."""
    spark = tables.sparkSession
    wanted = spark.createDataFrame([(o.category, o.name) for o in outputs], "category string, output string")
    if whole_documents:
        pairs = tables.select(doc, "category").distinct().join(F.broadcast(wanted), "category").select(doc, "output").distinct()
        return tables.join(pairs, doc)
    return tables.join(F.broadcast(wanted), "category")


def report_date(source: str, path: str | Column | None = None, text: str | Column | None = None, value: str | None = None, pattern: str = r"(\d{4}-\d{2}-\d{2}|\d{4}-\d{2}|\d{8}|\d{4})", format: str | None = None) -> Column:
    """The date of a report as text: from the file's name (last part of `path`) or the text by `pattern`, of now, or a constant.

    `format` writes it anew by date tokens. Null where nothing matches. Other sources are an error.
    """
    if source == "constant":
        if not value:
            raise ValueError("a constant report date needs a value")
        return F.lit(value)
    if source == "timestamp":
        return F.lit(datetime.datetime.now(datetime.UTC).replace(tzinfo=None).isoformat())
    if source not in ("filename", "content"):
        raise ValueError(f"unknown source of a report date: {source}")
    raw = path if source == "filename" else text
    if raw is None:
        raise ValueError(f"the source {source} needs its column")
    raw = F.col(raw) if isinstance(raw, str) else raw
    found = F.nullif(F.regexp_extract(F.element_at(F.split(raw, "[/\\\\]"), -1) if source == "filename" else raw, pattern, 1), F.lit(""))
    return format_date(found, format) if format else found


def run_contract(spark: SparkSession, docs: DataFrame, contract: Contract, doc: str = "doc", date: Column | None = None, min_rows: int = 0, propagate: bool = False, whole_documents: bool = False) -> dict[str, DataFrame]:
    """One frame for each output: doc, page_no, table_idx and the output's columns, over all documents.

    `date` is a column of `docs` (see report_date). A contract of one category takes all tables. Aliases with years are resolved by the latest year in
    the headers of the output's tables. Nothing is computed until a frame is used, but for the years and the profiles.
    """
    carried = docs.select(doc, "text") if date is None else docs.select(doc, "text", date.alias("tb_date"))
    tables = split_tables(split_pages(carried))
    categories = contract.categories or {o.category: [] for o in contract.outputs}
    if len(categories) == 1:
        tables = tables.withColumn("category", F.lit(next(iter(categories))))
    else:
        tables = classify_tables(tables, categories, min_rows, propagate)
    routed = route(tables, contract.outputs, doc, whole_documents)
    out = {}
    for o in contract.outputs:
        own = routed.where(F.col("output") == o.name)
        last: list[str] = []
        if any("{YYYY" in a for c in o.columns for a in c.aliases):
            found = own.select(F.explode(years(F.array_join("headers", " "))).alias("y")).agg(F.max("y")).first()[0]
            last = [found] if found else []
        keys = [doc, "page_no", "table_idx"] + (["tb_date"] if date is not None else [])
        rows = interpret(spark, own.select(*keys, "text"), o, keys, last, F.col("tb_date") if date is not None else None)
        out[o.name] = rows.drop("tb_date")
    return out


def save_all(frames: dict[str, DataFrame], contract: Contract, path: str, kind: str = "parquet") -> dict[str, str]:
    """Writes each output once, over all documents, below `path`; returns where. `kind` is csv, tsv or parquet."""
    out = {}
    for o in contract.outputs:
        if o.name in frames:
            out[o.name] = f"{path}/{o.name}.{kind}"
            save(frames[o.name].select(*[c.name for c in o.columns]), out[o.name], o)
    return out


def concat(frames: Sequence[DataFrame]) -> DataFrame:
    """Frames of one output from several runs; columns that one lacks are null."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def with_page(df: DataFrame, columns: Sequence[str], include: bool = True, page: str = "page_no") -> DataFrame:
    """The columns that exist, in the given order, after `page` if it is to be included."""
    return df.select(*([F.col(page).alias("page")] if include else []), *[c for c in columns if c in df.columns])


def records(df: DataFrame) -> list[dict]:
    """All rows as dictionaries; for results that the driver can hold."""
    return [r.asDict(recursive=True) for r in df.toLocalIterator()]


def records_by_page(df: DataFrame, doc: str, page: str = "page_no", order: Sequence[str] = ("table_idx", "row_idx")) -> DataFrame:
    """(doc, page, records): each page's rows as an array of structs, in order; pages ascending."""
    rest = [c for c in df.columns if c not in (doc, page)]
    first = [c for c in order if c in rest]
    row = F.struct(*first, *[c for c in rest if c not in first])
    return df.groupBy(doc, page).agg(F.array_sort(F.collect_list(row)).alias("records")).orderBy(doc, page)


def to_pandas(df: DataFrame) -> pd.DataFrame:
    """A pandas frame with nullable types."""
    return to_arrow(df).to_pandas(types_mapper={pa.int32(): pd.Int32Dtype(), pa.int64(): pd.Int64Dtype(), pa.float64(): pd.Float64Dtype(), pa.bool_(): pd.BooleanDtype(), pa.string(): pd.StringDtype()}.get)


def to_arrow(df: DataFrame) -> pa.Table:
    """An Arrow table, which other data frame libraries read without a copy."""
    return df.toArrow()


def union_pages(*parts: DataFrame) -> DataFrame:
    """Distinct pages of several selections, in order of their columns."""
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df)
    out = out.distinct()
    return out.orderBy(*out.columns)


def batches(rows: DataFrame, part: list[str], order: str, size: int, section: str | None = None) -> DataFrame:
    """`rows` with batch_no: runs of at most `size` rows in order.

    With `section` whole sections are put into a batch while they fit; a section of more rows than `size` has batches of its own.
    """
    if section is None:
        w = Window.partitionBy(*part).orderBy(order)
        return rows.withColumn("batch_no", F.floor((F.row_number().over(w) - 1) / size).cast("int"))
    return _packed(rows, part, order, size, section)


def _packed(rows: DataFrame, part: list[str], order: str, size: int, section: str) -> DataFrame:
    w = Window.partitionBy(*part, section).orderBy(order)
    rows = rows.withColumn("tb_piece", F.floor((F.row_number().over(w) - 1) / size).cast("int"))
    # pieces of sections in order, packed one after the other; a table has few of them
    piece = rows.groupBy(*part, section, "tb_piece").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).cast("long").alias("held"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["held"] + x["n"] <= size) | (acc["held"] == 0)
        batch = F.when(fits, acc["batch"]).otherwise(acc["batch"] + 1)
        held = F.when(fits, acc["held"] + x["n"]).otherwise(x["n"])
        return F.struct(batch.alias("batch"), held.alias("held"), F.concat(acc["out"], F.array(batch)).alias("out"))

    listed = piece.groupBy(*part).agg(F.array_sort(F.collect_list(F.struct("first", "n", F.col(section).alias("s"), "tb_piece"))).alias("p"))
    listed = listed.select(*part, "p", F.aggregate("p", start, step, lambda a: a["out"]).alias("b"))
    names = [f"tb_{i}" for i in range(len(part))]
    to = listed.select(*[F.col(c).alias(n) for c, n in zip(part, names, strict=True)], F.explode(F.arrays_zip("p", "b")).alias("x"))
    to = to.select(*names, F.col("x.p.s").alias("tb_s"), F.col("x.p.tb_piece").alias("tb_p"), F.col("x.b").alias("batch_no"))
    cond = F.col("tb_piece").eqNullSafe(F.col("tb_p")) & F.col(section).eqNullSafe(F.col("tb_s"))
    for c, n in zip(part, names, strict=True):
        cond = cond & F.col(c).eqNullSafe(F.col(n))
    return rows.join(to, cond, "left").drop("tb_piece", "tb_s", "tb_p", *names)


def merge_batches(results: DataFrame, part: list[str], order: str = "row_idx") -> DataFrame:
    """Results of batches as one table again: row numbers run on over batches, in batch order."""
    w = Window.partitionBy(*part).orderBy("batch_no", order)
    return results.withColumn(order, F.row_number().over(w) - 1).drop("batch_no")
