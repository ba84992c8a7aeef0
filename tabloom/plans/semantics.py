"""Contracts grounded in a vocabulary: concepts resolved to aliases by joins, merged with provenance, kept as JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ontology as O
from .contract import OutputSpec


@dataclass
class SemanticContext:
    """Aliases and valid values by output and column, with the time and the sources of the resolution."""

    resolved_aliases: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    valid_values: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    resolved_at: str = ""
    adapter_versions: dict[str, str] = field(default_factory=dict)

    def aliases_for(self, output: str, column: str) -> list[str]:
        return self.resolved_aliases.get(output, {}).get(column, [])

    def valid_set_for(self, output: str, column: str) -> set[str]:
        return set(self.valid_values.get(output, {}).get(column, ()))

    def write(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2, ensure_ascii=False) + "\n", encoding="utf-8")

    @classmethod
    def read(cls, path: str) -> SemanticContext:
        raw = json.loads(Path(path).read_text(encoding="utf-8"))
        return cls(**{k: raw[k] for k in cls.__dataclass_fields__ if k in raw})


def _grounded(contract: dict) -> list[tuple[str, dict]]:
    return [(name, c) for name, o in contract.get("outputs", {}).items() for c in o.get("schema", {}).get("columns", []) if c.get("concept_uris")]


def resolve_concepts(spark: SparkSession, contract: dict, names: DataFrame, broader: DataFrame) -> DataFrame:
    """(output, column, alias, concept, lang, kind) for the contract's concepts, in two joins for each depth asked for.

    `names` is (concept, kind, lang, label), `broader` (broader, narrower). A column's `resolve` may give languages, label_types,
    narrower_depth and prefix_patterns (`{label}` stands for a label). Aliases are distinct regardless of case.
    """
    refs = []
    for output, c in _grounded(contract):
        how = c.get("resolve") or {}
        patterns = ["{label}", *(how.get("prefix_patterns") or ())]
        for u in c["concept_uris"]:
            refs.append((output, c["name"], u["uri"], how.get("languages") or ["en"], how.get("label_types") or ["prefLabel", "altLabel"], int(how.get("narrower_depth") or 0), patterns))
    asked = spark.createDataFrame(refs, "output string, column string, root string, langs array<string>, kinds array<string>, depth int, patterns array<string>")
    deepest = max((r[5] for r in refs), default=0)
    reach = step = asked.select("root", F.col("root").alias("concept"), F.lit(0).alias("level")).distinct()
    for k in range(1, deepest + 1):
        step = step.join(broader, step["concept"] == broader["broader"]).select("root", F.col("narrower").alias("concept"), F.lit(k).alias("level")).distinct()
        reach = reach.unionByName(step)
    reach = reach.groupBy("root", "concept").agg(F.min("level").alias("level"))
    hit = asked.join(reach, "root").where("level <= depth").join(names.select("concept", "kind", "lang", "label"), "concept")
    hit = hit.where("array_contains(langs, lang) and array_contains(kinds, kind)").withColumn("pattern", F.explode("patterns"))
    hit = hit.withColumn("alias", F.replace("pattern", F.lit("{label}"), F.col("label")))
    first = F.min(F.struct("level", "alias", "concept", "lang", "kind"))
    return hit.groupBy("output", "column", F.lower("alias").alias("k")).agg(first.alias("b")).select("output", "column", "b.alias", "b.concept", "b.lang", "b.kind")


def materialize(spark: SparkSession, contract: dict, names: DataFrame, broader: DataFrame, strategy: str = "union") -> dict:
    """The contract with resolved aliases merged in (`union`, `manual_priority`: manual first; `resolved_only`) and their provenance.

    What reaches the driver are the aliases of the contract's own concepts.
    """
    resolved: dict[tuple[str, str], list] = {}
    for r in resolve_concepts(spark, contract, names, broader).orderBy("output", "column", "alias").collect():
        resolved.setdefault((r["output"], r["column"]), []).append(r)
    out = json.loads(json.dumps(contract))
    for output, c in _grounded(out):
        found = {r["alias"].lower(): r for r in resolved.get((output, c["name"]), ())}
        manual = list(c.get("aliases", ()))
        own = {a.lower() for a in manual}
        fresh = [r["alias"] for k, r in found.items() if k not in own]
        c["aliases"] = [r["alias"] for r in found.values()] if strategy == "resolved_only" else manual + fresh
        c["_alias_provenance"] = {a: _provenance(found.get(a.lower()), a.lower() in own) for a in c["aliases"]}
        c.pop("concept_uris")
        c.pop("resolve", None)
    return out


def _provenance(r, manual: bool) -> dict:
    if r is None:
        return {"source": "manual"}
    return {"source": "both" if manual else "resolved", "concept_uri": r["concept"], "language": r["lang"], "label_type": r["kind"]}


def build_context(spark: SparkSession, contract: dict, names: DataFrame, broader: DataFrame, strategy: str = "union", versions: dict | None = None) -> SemanticContext:
    """The aliases of `materialize` by column, and as valid values the concepts' labels with all resolved aliases."""
    done = materialize(spark, contract, names, broader, strategy)
    made = {(name, c["name"]): c for name, o in done["outputs"].items() for c in o.get("schema", {}).get("columns", [])} if done.get("outputs") else {}
    stamp = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    out = SemanticContext(resolved_at=stamp, adapter_versions=dict(versions or {}))
    by_column: dict[tuple[str, str], set[str]] = {}
    for r in resolve_concepts(spark, contract, names, broader).select("output", "column", "alias").collect():
        by_column.setdefault((r["output"], r["column"]), set()).add(r["alias"])
    for output, c in _grounded(contract):
        at = (output, c["name"])
        out.resolved_aliases.setdefault(output, {})[c["name"]] = made[at]["aliases"]
        valid = by_column.get(at, set()) | {u["label"] for u in c["concept_uris"] if u.get("label")}
        if valid:
            out.valid_values.setdefault(output, {})[c["name"]] = sorted(valid)
    return out


def with_context(out: OutputSpec, context: SemanticContext) -> OutputSpec:
    """An output whose columns also know the context's aliases, own spellings first."""

    def extended(c):
        own = {a.lower() for a in c.aliases}
        return replace(c, aliases=(*c.aliases, *(a for a in context.aliases_for(out.name, c.name) if a.lower() not in own)))

    return replace(out, columns=tuple(map(extended, out.columns)))


def validation_counts(rows: DataFrame, output: str, columns: list[str], context: SemanticContext) -> DataFrame:
    """(column, valid, invalid, unknown_values) of the columns that have valid values."""
    spark, parts = rows.sparkSession, None
    for c in columns:
        valid = context.valid_set_for(output, c)
        if not valid:
            continue
        known = spark.createDataFrame([(v,) for v in sorted(valid)], "value string")
        checked = O.check_values(rows.select(c), c, known, "value")
        one = checked.agg(F.count_if("is_valid").alias("valid"), F.count_if(~F.col("is_valid")).alias("invalid"), F.countDistinct(F.when(~F.col("is_valid"), F.lower(F.trim(c)))).alias("unknown_values"))
        one = one.select(F.lit(c).alias("column"), "*")
        parts = one if parts is None else parts.unionByName(one)
    return parts if parts is not None else spark.createDataFrame([], "column string, valid bigint, invalid bigint, unknown_values bigint")
