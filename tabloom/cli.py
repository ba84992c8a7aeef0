"""Command line: `python -m tabloom.cli <verb> ...` over contracts and files of records."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import ontology as O
from .plans.compile import ContractError, compile_contract
from .plans.contract import Contract
from .plans.draft import shapes, without_annotations
from .plans.semantics import SemanticContext, build_context, materialize, validation_counts
from .session import local_session


def thesaurus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(names, broader) of an N-Triples file: labels by the last part of their predicate, and narrower links."""
    t = O.read_ntriples(spark, path).withColumn("last", F.regexp_extract("predicate", r"([^/#]+)$", 1))
    names = t.where("last in ('prefLabel', 'altLabel')").select(F.col("subject").alias("concept"), F.col("last").alias("kind"), "lang", F.col("object").alias("label"))
    down = t.where("last = 'narrower'").select(F.col("subject").alias("broader"), F.col("object").alias("narrower"))
    up = t.where("last = 'broader'").select(F.col("object").alias("broader"), F.col("subject").alias("narrower"))
    return names, down.unionByName(up).distinct()


def _read(path: str) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def _write(value, path: str | None) -> None:
    text = value if isinstance(value, str) else json.dumps(value, indent=2, ensure_ascii=False) + "\n"
    if path:
        Path(path).write_text(text, encoding="utf-8")
    else:
        sys.stdout.write(text)


def _manual(contract: dict) -> list[tuple[str, str, str]]:
    return [(name, c["name"], a) for name, o in contract.get("outputs", {}).items() for c in o["schema"]["columns"] for a in c.get("aliases", ())]


def diff(spark, a) -> int:
    """Aliases of each column that are only manual, only resolved, or both."""
    raw = _read(a.contract)
    resolved = materialize(spark, raw, *thesaurus(spark, a.thesaurus), strategy="resolved_only")
    manual, found = set(_manual(raw)), set(_manual(resolved))
    low = lambda s: {(o, c, x.lower()) for o, c, x in s}
    m, r = low(manual), low(found)
    rows = [(*k, "matched" if k in m and k in r else "manual_only" if k in m else "resolved_only") for k in sorted(m | r)]
    _write("".join("\t".join(x) + "\n" for x in rows), a.out)
    return 0


def materialize_file(spark, a) -> int:
    _write(materialize(spark, _read(a.contract), *thesaurus(spark, a.thesaurus), strategy=a.strategy), a.out)
    return 0


def compile_file(spark, a) -> int:
    features = O.read_gazetteer(spark, a.gazetteer) if a.gazetteer else None
    try:
        done = compile_contract(spark, _read(a.contract), *thesaurus(spark, a.thesaurus), features, a.strategy)
    except ContractError as e:
        print(e, file=sys.stderr)
        return 1
    _write(done, a.out)
    return 0


def context_file(spark, a) -> int:
    build_context(spark, _read(a.contract), *thesaurus(spark, a.thesaurus)).write(a.out)
    return 0


def shapes_file(spark, a) -> int:
    for name, o in _read(a.contract).get("outputs", {}).items():
        _write(shapes(name, o["schema"]["columns"]), f"{a.out}/{name}.ttl" if a.out else None)
    return 0


def validate(spark, a) -> int:
    """Counts of valid and invalid values of a file of records; 1 if some are invalid."""
    rows = spark.read.parquet(a.records) if a.records.endswith(".parquet") else spark.read.csv(a.records, header=True, sep="\t" if a.records.endswith(".tsv") else ",")
    out = next(o for o in Contract.of(Path(a.contract).read_text(encoding="utf-8")).outputs if o.name == a.output)
    got = validation_counts(rows, a.output, [c.name for c in out.columns if c.name in rows.columns], SemanticContext.read(a.context))
    bad = 0
    for r in got.collect() if got is not None else []:
        print(f"{r['column']}\t{r['valid']} valid\t{r['invalid']} invalid\t{r['unknown_values']} unknown values")
        bad += r["invalid"]
    return int(bad > 0)


def analyze(spark, a) -> int:
    """A profile of a file of records: types of columns, values and samples."""
    rows = spark.read.parquet(a.records) if a.records.endswith(".parquet") else spark.read.csv(a.records, header=True)
    out = {r["column"]: r["samples"] for r in O.samples(rows, rows.columns).collect()}
    _write([{**r.asDict(), "samples": out.get(r["column"], [])} for r in O.profile(rows, rows.columns).collect()], a.out)
    return 0


def strip(spark, a) -> int:
    _write(without_annotations(_read(a.contract)), a.out)
    return 0


VERBS = {
    "diff": (diff, ["contract", "thesaurus"]), "materialize": (materialize_file, ["contract", "thesaurus"]), "compile": (compile_file, ["contract", "thesaurus"]), "build-context": (context_file, ["contract", "thesaurus"]),
    "generate-shapes": (shapes_file, ["contract"]), "validate": (validate, ["contract", "context", "output", "records"]), "analyze": (analyze, ["records"]), "strip": (strip, ["contract"]),
}


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="tabloom", description=__doc__)
    sub = p.add_subparsers(dest="verb", required=True)
    for name, (f, places) in VERBS.items():
        s = sub.add_parser(name, help=f.__doc__)
        for x in places:
            s.add_argument(x)
        s.add_argument("--out")
        s.add_argument("--strategy", default="union", choices=["union", "manual_priority", "resolved_only"])
        s.add_argument("--gazetteer")
    a = p.parse_args(args)
    return VERBS[a.verb][0](spark or local_session(app="tabloom-cli"), a)


if __name__ == "__main__":
    sys.exit(main())
