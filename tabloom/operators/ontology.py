"""Vocabularies: labels, narrower concepts, alias sets, checks of values and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_alias, trailing_id


def narrower(triples: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(concept, level): roots and what is narrower to `depth`, each concept at its least level, cycles cut.

    `triples` is (broader, narrower); each level is one equi join.
    """
    found = step = roots.select(F.col("concept"), F.lit(0).alias("level"))
    for k in range(1, depth + 1):
        step = step.join(triples, step["concept"] == triples["broader"]).select(F.col("narrower").alias("concept"), F.lit(k).alias("level")).distinct()
        found = found.unionByName(step)
    return found.groupBy("concept").agg(F.min("level").alias("level"))


def labels(concepts: DataFrame, names: DataFrame, languages: list[str], kinds: list[str]) -> DataFrame:
    """Labels (concept, kind, lang, label) of concepts in these languages and of these kinds."""
    return concepts.join(names.where(F.col("lang").isin(languages) & F.col("kind").isin(kinds)), "concept")


def lookup(names: DataFrame, wanted: DataFrame) -> DataFrame:
    """(label, concept, status): ok, ambiguous or missing, case-insensitive."""
    n = names.select(F.lower("label").alias("k"), "concept").distinct()
    j = wanted.withColumn("k", F.lower("label")).join(n, "k", "left").groupBy("label").agg(F.countDistinct("concept").alias("n"), F.min("concept").alias("concept"))
    return j.select("label", F.when(F.col("n") == 1, F.col("concept")).alias("concept"), F.when(F.col("n") == 1, "ok").when(F.col("n") > 1, "ambiguous").otherwise("missing").alias("status"))


def merge_aliases(manual: DataFrame, resolved: DataFrame, key: list[str]) -> DataFrame:
    """(key, alias, provenance): case-insensitive union, manual spelling first; both, manual or resolved."""
    both = manual.select(*key, "alias", F.lit(0).alias("src")).unionByName(resolved.select(*key, "alias", F.lit(1).alias("src")))
    k = F.lower("alias")
    out = both.groupBy(*key, k.alias("k")).agg(F.min(F.struct("src", "alias")).alias("b"), F.countDistinct("src").alias("n"))
    kind = F.when(F.col("n") == 2, "both").when(F.col("b.src") == 0, "manual").otherwise("resolved")
    return out.select(*key, F.col("b.alias").alias("alias"), kind.alias("provenance"))


def diff_aliases(manual: DataFrame, resolved: DataFrame) -> DataFrame:
    """(alias, status): matched, manual_only or resolved_only on lower-cased aliases."""
    a, b = manual.select(F.lower("alias").alias("alias")).distinct(), resolved.select(F.lower("alias").alias("alias")).distinct()
    j = a.withColumn("m", F.lit(1)).join(b.withColumn("r", F.lit(1)), "alias", "full_outer")
    return j.select("alias", F.when(F.col("m").isNull(), "resolved_only").when(F.col("r").isNull(), "manual_only").otherwise("matched").alias("status"))


def check_values(rows: DataFrame, column: str, valid: DataFrame, value: str) -> DataFrame:
    """`rows` with is_valid: blank, null, nan and none pass, others must be in the vocabulary (case-insensitive)."""
    v = valid.select(F.lower(F.trim(value)).alias("tb_v")).distinct()  # Spark broadcasts it if it is small
    k = F.lower(F.trim(F.col(column).cast("string")))
    j = rows.withColumn("tb_k", k).join(v, F.col("tb_k") == F.col("tb_v"), "left")
    blank = F.col("tb_k").isNull() | F.col("tb_k").isin("", "nan", "none")
    return j.withColumn("is_valid", blank | F.col("tb_v").isNotNull()).drop("tb_k", "tb_v")


def unmatched(headers: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    """Headers that no alias covers."""
    return headers.join(aliases.select(key).distinct(), key, "left_anti")


def match_headers(headers: DataFrame, aliases: DataFrame) -> DataFrame:
    """Headers (header) with `column` and `exact`: by normalised alias (alias, column), else by the text before the first comma.

    An alias of several columns gives a row for each; a header that matches neither way keeps null.
    """
    known = aliases.select(normalize_alias("alias").alias("tb_alias"), "column").distinct()
    keyed = headers.withColumn("tb_key", normalize_alias("header")).withColumn("tb_head", F.trim(F.substring_index("tb_key", ",", 1)))
    whole = known.select(F.col("tb_alias").alias("tb_key"), F.col("column").alias("tb_whole"))
    part = known.select(F.col("tb_alias").alias("tb_head"), F.col("column").alias("tb_part"))
    first = keyed.join(whole, "tb_key", "left")
    rest = first.where("tb_whole is null").drop("tb_whole").join(part, "tb_head", "left").withColumn("exact", F.lit(False)).withColumnRenamed("tb_part", "column")
    return first.where("tb_whole is not null").withColumn("exact", F.lit(True)).withColumnRenamed("tb_whole", "column").unionByName(rest).drop("tb_key", "tb_head")


def to_triples(rows: DataFrame, subject: str, columns: dict[str, str]) -> DataFrame:
    """(subject, predicate, object, datatype): a triple per non-empty cell; `columns` gives datatypes."""
    cells = F.array(*[F.struct(F.lit(c).alias("predicate"), F.col(c).cast("string").alias("object"), F.lit(t).alias("datatype")) for c, t in columns.items()])
    return rows.select(F.col(subject).cast("string").alias("subject"), F.inline(cells)).where("object is not null and object <> ''")


def shape_violations(rows: DataFrame, subject: str, shapes: dict[str, Column]) -> DataFrame:
    """(subject, constraint) for every named condition that a row fails; null counts as failing."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in shapes.items()]), lambda x: x.isNotNull())
    return rows.select(F.col(subject).alias("subject"), F.explode(broken).alias("constraint"))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, total, non_null, distinct_values, smallest, largest) in one pass."""
    aggs = [x for c in columns for x in (F.count(c).alias(f"{c}__n"), F.countDistinct(c).alias(f"{c}__d"), F.min(F.col(c).cast("string")).alias(f"{c}__lo"), F.max(F.col(c).cast("string")).alias(f"{c}__hi"))]
    one = df.agg(F.count("*").alias("total"), *aggs)
    per = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__n").alias("non_null"), F.col(f"{c}__d").alias("distinct_values"), F.col(f"{c}__lo").alias("smallest"), F.col(f"{c}__hi").alias("largest")) for c in columns])
    return one.select("total", F.inline(per))


def latest(df: DataFrame, part: list[str], column: str, earliest: bool = False) -> DataFrame:
    """Rows that hold the largest (smallest) value of a column within a part."""
    w = Window.partitionBy(*part)
    best = (F.min if earliest else F.max)(column).over(w)
    return df.withColumn("tb_best", best).where(F.col(column) == F.col("tb_best")).drop("tb_best")


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """(subject, predicate, object, lang) from N-Triples text."""
    line = F.col("value")
    t = spark.read.text(path).where(line.rlike(r"^\s*<"))
    p = r'^\s*<([^>]*)>\s+<([^>]*)>\s+(?:<([^>]*)>|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z-]+))?)'
    g = [F.regexp_extract(line, p, i) for i in range(1, 6)]
    return t.select(g[0].alias("subject"), g[1].alias("predicate"), F.when(g[2] != "", g[2]).otherwise(g[3]).alias("object"), F.nullif(g[4], F.lit("")).alias("lang"))


GEO = (
    "geoname_id long, name string, asciiname string, alternatenames string, lat double, lng double, feature_class string, feature_code string, country_code string, cc2 string, "
    "admin1_code string, admin2_code string, admin3_code string, admin4_code string, population long, elevation string, dem string, timezone string, modified string"
)


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """Features of a tab-separated gazetteer dump; rows without an id are dropped."""
    return spark.read.csv(path, sep="\t", quote="", schema=GEO).where("geoname_id is not null")


def read_alternate_names(spark: SparkSession, path: str) -> DataFrame:
    """(geoname_id, lang, name) of a tab-separated dump of alternate names; links and codes (languages of other than two or three letters) are left out."""
    kind = "alternate_id long, geoname_id long, lang string, name string, preferred string, short string, colloquial string, historic string, since string, until string"
    names = spark.read.csv(path, sep="\t", quote="", schema=kind)
    return names.where("geoname_id is not null and name is not null and (lang is null or lang rlike '^[a-z]{2,3}$')").select("geoname_id", "lang", "name")


def enumerate_features(features: DataFrame, country: str, level: str) -> DataFrame:
    """Features of a country at a level (feature code)."""
    return features.where((F.col("country_code") == country) & (F.col("feature_code") == level))


def enrich_features(uris: DataFrame, features: DataFrame, uri: str = "uri") -> DataFrame:
    """`uris` with coordinates, administrative code, country and population of the feature whose id ends the URI; null where there is none."""
    kept = features.select("geoname_id", "lat", "lng", "admin1_code", "country_code", "population")
    return uris.withColumn("geoname_id", trailing_id(uri)).join(kept, "geoname_id", "left")


def search_features(features: DataFrame, text: str, country: str | None = None, code: str | None = None, limit: int = 10) -> DataFrame:
    """At most `limit` features whose name or plain name holds a text (case doesn't count), the most populous first, ties to the smaller id."""
    wanted = text.lower()
    hit = F.lower("name").contains(wanted) | F.lower("asciiname").contains(wanted)
    hit = hit & (F.col("country_code") == country) if country else hit
    hit = hit & (F.col("feature_code") == code) if code else hit
    return features.where(hit).orderBy(F.desc_nulls_last("population"), "geoname_id").limit(limit)


def samples(df: DataFrame, columns: list[str], most: int = 10) -> DataFrame:
    """(column, distinct_values, samples): the `most` least distinct texts of each column, by rank rather than by gathering all values."""
    cell = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")
    each = df.select(cell).select("x.*").where("v is not null").distinct()
    w = Window.partitionBy("column").orderBy("v")
    first = each.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).groupBy("column").agg(F.array_sort(F.collect_list("v")).alias("samples"))
    return each.groupBy("column").agg(F.count("*").alias("distinct_values")).join(first, "column")
