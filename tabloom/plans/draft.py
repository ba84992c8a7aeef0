"""Contract drafting: column types, similar tables grouped, keywords, shapes and a recommended contract.

Profiles of cells are aggregates over all rows; only header-sized results (a row for each group of tables) reach the driver.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cell_type, snake_name, ustrip

# Words too common to describe a group of tables.
STOP_WORDS = ["the", "a", "an", "of", "in", "to", "for", "and", "or", "on", "at", "by", "is", "it", "no", "not", "with", "from", "as", "be",
              "total", "name", "date", "type", "number", "value", "code"]


def column_types(cells: DataFrame, part: list[str], order: str = "row") -> DataFrame:
    """(part, type, n, distinct_values) of each column of cells (text): its most frequent cell type, the first seen on a tie.

    A column with some text, three values or more and few different ones (five at most, or a tenth) is `enum`; a column
    with only blank cells is `string`.
    """
    value = F.nullif(ustrip("text"), F.lit(""))
    seen = cells.withColumn("value", value).withColumn("kind", F.when(F.col("value").isNotNull(), cell_type("value")))
    by_kind = seen.groupBy(*part, "kind").agg(F.count("value").alias("n"), F.min(F.when(F.col("value").isNotNull(), F.col(order))).alias("at"))
    top = F.max(F.when(F.col("kind").isNotNull(), F.struct("n", (-F.col("at")).alias("at"), "kind")))["kind"]
    kinds = by_kind.groupBy(*part).agg(top.alias("top"), F.sum("n").alias("n"), F.coalesce(F.bool_or(F.col("kind") == "string"), F.lit(False)).alias("texts"))
    distinct = seen.groupBy(*part).agg(F.countDistinct("value").alias("distinct_values"))
    few = (F.col("distinct_values") <= 5) | (F.col("distinct_values") <= 0.1 * F.col("n"))
    kind = F.when(F.col("texts") & (F.col("n") >= 3) & few, "enum").otherwise(F.coalesce("top", F.lit("string")))
    return kinds.join(distinct, part).select(*part, kind.alias("type"), "n", "distinct_values")


def keywords(tables: DataFrame, group: str, top: int = 10) -> DataFrame:
    """(group, keyword, n, rank) of tables (tokens, title): tokens in 30 % of a group's tables or more, of the 20 most frequent.

    Header tokens count once a table, title words each time; stop words and words of one or two letters are left out.
    Ties go by alphabet.
    """
    word = F.transform(F.split(F.lower(F.coalesce("title", F.lit(""))), r"\s+"), lambda w: F.regexp_replace(w, "[^a-z0-9]", ""))
    titles = F.filter(word, lambda w: (w != "") & ~w.isin(STOP_WORDS))
    both = tables.withColumn("word", F.explode(F.concat(F.array_distinct(F.coalesce("tokens", F.array().cast("array<string>"))), titles)))
    counts = both.groupBy(group, "word").agg(F.count("*").alias("n"))
    w = Window.partitionBy(group).orderBy(F.desc("n"), "word")
    counts = counts.withColumn("place", F.row_number().over(w)).where("place <= 20").join(tables.groupBy(group).agg(F.count("*").alias("tables")), group)
    kept = counts.where((F.col("n") >= F.greatest(F.lit(1.0), 0.3 * F.col("tables"))) & ~F.col("word").isin(STOP_WORDS) & (F.length("word") > 2))
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select(group, F.col("word").alias("keyword"), "n", "rank")


def group_similar(tables: DataFrame, key: str, order: str, threshold: float = 0.3) -> DataFrame:
    """(key, order, group): tables (n_cols, tokens) joined in order to the most similar group, or to a new one.

    Similarity is half the ratio of columns (to the group's mean) and half the Jaccard of tokens (to those that all its tables share). Tables
    of the same columns and tokens share a group and count once, so a task holds the different headers of one key.
    """
    @F.pandas_udf("array<int>")
    def run(lists: pd.Series) -> pd.Series:
        return pd.Series([assign_groups([(t["n_cols"], frozenset(t["tokens"])) for t in one], threshold) for one in lists], dtype=object)

    tokens = F.array_sort(F.array_distinct(F.coalesce("tokens", F.array().cast("array<string>"))))
    alike = tables.select(key, order, F.coalesce(F.col("n_cols").cast("int"), F.lit(0)).alias("n_cols"), tokens.alias("tokens"))
    kinds = alike.groupBy(key, "n_cols", "tokens").agg(F.min(order).alias("at"))
    listed = kinds.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "n_cols", "tokens"))).alias("kinds"))
    marked = listed.select(key, F.inline(F.arrays_zip("kinds", run("kinds").alias("group")))).select(key, "kinds.n_cols", "kinds.tokens", "group")
    return alike.join(marked, [key, "n_cols", "tokens"]).select(key, order, "group")


def assign_groups(tables: list[tuple[int, frozenset]], threshold: float = 0.3) -> list[int]:
    """The group number of each (columns, tokens), in order."""
    groups: list[tuple[int, int, frozenset]] = []  # tables, columns in all, shared tokens
    marks = []
    for n, tokens in tables:
        best, at = 0.0, -1
        for i, (count, total, shared) in enumerate(groups):
            mean, union = total / count, tokens | shared
            ratio = min(n, mean) / max(n, mean) if mean else 0.0
            like = (ratio + (len(tokens & shared) / len(union) if union else 0.0)) / 2
            if like > best:
                best, at = like, i
        if at >= 0 and best >= threshold:
            count, total, shared = groups[at]
            groups[at] = (count + 1, total + n, shared & tokens)
        else:
            at = len(groups)
            groups.append((1, n, tokens))
        marks.append(at)
    return marks


def recommend(columns: DataFrame, group: str) -> DataFrame:
    """(group, name, type, aliases) of columns (group, position, header, type): a draft column for each position.

    The name is the most frequent header (the first in alphabet on a tie) in snake case, the aliases all its headers; the type
    is the most frequent one, with `enum` and dates kept as text.
    """
    named = columns.where("trim(header) <> ''")
    heads = named.groupBy(group, "position", "header").agg(F.count("*").alias("n"))
    aliases = heads.groupBy(group, "position").agg(
        F.min_by("header", F.struct((-F.col("n")).alias("n"), "header")).alias("top"), F.sort_array(F.collect_list("header")).alias("aliases")
    )
    kinds = named.groupBy(group, "position", "type").agg(F.count("*").alias("n")).groupBy(group, "position").agg(F.min_by("type", F.struct((-F.col("n")).alias("n"), "type")).alias("type"))
    kind = F.when(F.col("type") == "number", "float").otherwise("string")
    return aliases.join(kinds, [group, "position"]).select(group, "position", snake_name("top").alias("name"), kind.alias("type"), "aliases")


def without_annotations(value):
    """A contract without the keys that start with an underscore, at every depth."""
    if isinstance(value, dict):
        return {k: without_annotations(v) for k, v in value.items() if not k.startswith("_")}
    return [without_annotations(v) for v in value] if isinstance(value, list) else value


def shapes(output: str, columns: list[dict], namespace: str = "urn:records:") -> str:
    """Turtle shapes of an output: floats from 0, ints as integers, texts as strings among their aliases (templates left out)."""
    quoted = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
    props = []
    for c in columns:
        kind, listed = c.get("type", "string"), [a for a in c.get("aliases", []) if "{" not in a]
        rule = {"float": "sh:minInclusive 0", "int": "sh:datatype xsd:integer"}.get(kind, "sh:datatype xsd:string")
        closed = f" sh:in ({' '.join(map(quoted, listed))}) ;" if kind == "string" and listed else ""
        props.append(f"sh:property [ sh:path <{namespace}{c['name']}> ; {rule} ;{closed} sh:name {quoted(c['name'])} ]")
    head = ["@prefix sh: <http://www.w3.org/ns/shacl#> .", "@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .", ""]
    body = [f"<{namespace}{output}Shape> a sh:NodeShape", f"sh:targetClass <{namespace}Record>", *props]
    return "\n".join([*head, " ;\n    ".join(body) + " .", ""])
