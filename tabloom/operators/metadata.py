"""Document metadata: zones of a page, patterns tried in order, validation and fallbacks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The part of a page's height that a zone covers.
ZONES = {"header": (0.0, 0.15), "footer": (0.85, 1.0), "title_page": (0.0, 0.4), "page": (0.0, 1.0)}


@dataclass(frozen=True)
class Field:
    """A metadata field: zones in order, own patterns (0.9) before those of its category (0.7)."""

    name: str
    zones: tuple[str, ...] = ("page",)
    patterns: tuple[str, ...] = ()
    category_patterns: tuple[str, ...] = ()
    required: bool = False
    default: str | None = None


def quick_scan(lines: DataFrame, doc: str, fields: list[Field], pages: int = 3) -> DataFrame:
    """(doc, field, value, confidence) of every document and field; null with 0.0 where nothing matches.

    `lines` is (doc, page_no, y, text) with y as a share of the page's height. The first zone counts,
    then the first page, own patterns, the order of patterns, the highest line.
    """
    src = lines.where(F.col("page_no") < pages)
    tries = []
    for f in fields:
        for z, zone in enumerate(f.zones):
            lo, hi = ZONES[zone]
            inside = F.col("y").between(lo, hi) if zone != "title_page" else (F.col("y") <= hi) & (F.col("page_no") == 0)
            for p, (pattern, sure) in enumerate([(x, 0.9) for x in f.patterns] + [(x, 0.7) for x in f.category_patterns]):
                value = F.regexp_extract("text", pattern, 1 if "(" in pattern.replace("\\(", "").replace("(?", "") else 0)
                tries.append(F.when(inside & F.col("text").rlike(pattern), F.struct(F.lit(f.name).alias("field"), F.lit(z).alias("z"), F.col("page_no"), F.lit(p).alias("p"), F.col("y"), value.alias("value"), F.lit(sure).alias("confidence"))))
    hits = src.select(doc, F.explode(F.filter(F.array(*tries), lambda x: x.isNotNull())).alias("h")).select(doc, "h.*")
    w = Window.partitionBy(doc, "field").orderBy("z", "page_no", "p", "y", "value")
    best = hits.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(doc, "field", "value", "confidence")
    every = lines.select(doc).distinct().select(doc, F.explode(F.array(*[F.lit(f.name) for f in fields])).alias("field"))
    return every.join(best, [doc, "field"], "left").select(doc, "field", "value", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def with_fallbacks(found: DataFrame, doc: str, fields: list[Field]) -> DataFrame:
    """Missing values by their default (confidence 0.5); is_missing marks required fields without a value."""
    default, required = F.lit(None).cast("string"), F.lit(False)
    for f in fields:
        default = F.when(F.col("field") == f.name, F.lit(f.default)).otherwise(default)
        required = F.when(F.col("field") == f.name, F.lit(f.required)).otherwise(required)
    used = F.col("value").isNull() & default.isNotNull()
    out = found.select(doc, "field", F.coalesce("value", default).alias("value"), F.when(used, 0.5).otherwise(F.col("confidence")).alias("confidence"), required.alias("r"))
    return out.select(doc, "field", "value", "confidence", (F.col("r") & F.col("value").isNull()).alias("is_missing"))
