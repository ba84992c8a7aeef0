"""Compiling a linked-data contract: its grounding blocks become concepts of columns, then it is materialised.

A grounding names a source and what to take from it:
  {"source": "thesaurus", "concepts": [uri or label, ...], "languages": [...], "label_types": [...], "include_narrower": depth}
  {"source": "gazetteer", "country": code, "level": code}
"""

from __future__ import annotations

import copy

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ontology import enumerate_features
from .semantics import materialize

KINDS = frozenset(["string", "int", "float", "bool", "date"])


class ContractError(ValueError):
    """What is wrong with a contract, all of it at once."""


def problems(contract: dict) -> list[str]:
    """What keeps a linked-data contract from being compiled; empty if nothing does."""
    out = []
    if "@context" not in contract:
        out.append("@context is missing")
    if not contract.get("outputs"):
        out.append("there are no outputs")
    for name, o in (contract.get("outputs") or {}).items():
        columns = o.get("schema", {}).get("columns", [])
        if not columns:
            out.append(f"output {name} has no columns")
        for i, c in enumerate(columns):
            where = f"column {c.get('name') or i} of output {name}"
            if not c.get("name"):
                out.append(f"{where} has no name")
            if c.get("type", "string") not in KINDS:
                out.append(f"{where} is of the unknown type {c['type']}")
            g = c.get("grounding")
            if g is not None and g.get("source") not in ("thesaurus", "gazetteer"):
                out.append(f"{where} is grounded in an unknown source")
            elif g is not None and g["source"] == "thesaurus" and not g.get("concepts"):
                out.append(f"{where} is grounded in no concept")
            elif g is not None and g["source"] == "gazetteer" and not (g.get("country") and g.get("level")):
                out.append(f"{where} needs a country and a level")
    return out


def ground(spark: SparkSession, contract: dict, names: DataFrame, features: DataFrame | None = None, uri: str = "https://sws.geonames.org/{id}/") -> dict:
    """The contract with the concept URIs of its groundings; labels are looked up in any case and must name one concept.

    What reaches the driver are the concepts that the contract names.
    """
    if found := problems(contract):
        raise ContractError("; ".join(found))
    out = copy.deepcopy({k: v for k, v in contract.items() if not k.startswith("@")})
    wanted = {x.lower() for o in out["outputs"].values() for c in o["schema"]["columns"] for x in (c.get("grounding") or {}).get("concepts", ()) if "://" not in x}
    by_label: dict[str, list[str]] = {}
    if wanted:
        hit = names.where(F.lower("label").isin(sorted(wanted))).select(F.lower("label").alias("label"), "concept").distinct()
        for r in hit.collect():
            by_label.setdefault(r["label"], []).append(r["concept"])
    failed = []
    for o in out["outputs"].values():
        for c in o["schema"]["columns"]:
            g = c.pop("grounding", None)
            if g is None:
                continue
            if g["source"] == "gazetteer":
                if features is None:
                    failed.append(f"column {c['name']} needs a gazetteer")
                    continue
                ids = enumerate_features(features, g["country"], g["level"]).select("geoname_id").orderBy("geoname_id").collect()
                c["concept_uris"] = [{"uri": uri.format(id=r[0])} for r in ids]
            else:
                uris = []
                for x in g["concepts"]:
                    one = [x] if "://" in x else by_label.get(x.lower(), [])
                    if len(one) != 1:
                        failed.append(f"{'no' if not one else 'more than one'} concept is called {x}")
                    uris += one[:1]
                c["concept_uris"] = [{"uri": x} for x in uris]
            keep = {k: g[k] for k in ("languages", "label_types") if k in g}
            if g.get("include_narrower"):
                keep["narrower_depth"] = int(g["include_narrower"])
            if keep:
                c["resolve"] = {**c.get("resolve", {}), **keep}
    if failed:
        raise ContractError("; ".join(failed))
    return out


def compile_contract(spark: SparkSession, contract: dict, names: DataFrame, broader: DataFrame, features: DataFrame | None = None, strategy: str = "union") -> dict:
    """A linked-data contract as a plain one: grounded, then with resolved aliases and their provenance."""
    grounded = ground(spark, contract, names, features)
    if features is not None:
        places = features.select(F.concat(F.lit("https://sws.geonames.org/"), F.col("geoname_id").cast("string"), F.lit("/")).alias("concept"), F.lit("prefLabel").alias("kind"), F.lit("en").alias("lang"), F.col("name").alias("label"))
        names = names.select("concept", "kind", "lang", "label").unionByName(places)
    return materialize(spark, grounded, names, broader, strategy)
