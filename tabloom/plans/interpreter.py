"""The seam for language-model interpreters: a protocol, retries, and rows that stay unresolved without one."""

from __future__ import annotations

import time
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Interpreter(Protocol):
    """Turns one text into records of column to text; raises where it can't. Must be picklable."""

    def records(self, text: str, columns: list[str]) -> list[dict[str, str]]: ...


class Unresolved:
    """The interpreter of a session without a model: no text is resolved."""

    def records(self, text: str, columns: list[str]) -> list[dict[str, str]]:
        raise LookupError("no interpreter is configured")


class Fallback:
    """Asks several interpreters in turn, each up to `tries` times, waiting `wait` seconds times `growth` between tries."""

    def __init__(self, *interpreters: Interpreter, tries: int = 3, wait: float = 0.2, growth: float = 1.0):
        self.interpreters, self.tries, self.wait, self.growth = interpreters, tries, wait, growth

    def records(self, text: str, columns: list[str]) -> list[dict[str, str]]:
        failure: Exception = LookupError("no interpreter is configured")
        for one in self.interpreters:
            for k in range(self.tries):
                try:
                    return one.records(text, columns)
                except Exception as e:  # any failure of a model counts as one try
                    failure = e
                    if k + 1 < self.tries:
                        time.sleep(self.wait * self.growth**k)
        raise failure


def interpret_texts(docs: DataFrame, key: str, columns: list[str], interpreter: Interpreter) -> DataFrame:
    """(key, row, columns, problem) of docs (text): the interpreter's records, or one row with the problem. Null texts are problems."""
    kind = dict(docs.dtypes)[key]
    names = [key, "row", *columns, "problem"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, text in zip(batch[key], batch["text"]):
                try:
                    if text is None:
                        raise ValueError("no text")
                    found = interpreter.records(text, columns)
                    out += [(k, i, *(r.get(c) for c in columns), None) for i, r in enumerate(found)]
                except Exception as e:  # reported as a row
                    out.append((k, None, *(None for _ in columns), f"{type(e).__name__}: {e}"))
            frame = pd.DataFrame(out, columns=names)
            yield frame.astype({"row": "Int32"})

    listed = "".join(f"`{c}` string, " for c in columns)
    return docs.select(key, F.col("text").cast("string").alias("text")).mapInPandas(run, f"{key} {kind}, row int, {listed}problem string")


def resolve(docs: DataFrame, key: str, mapped: DataFrame, interpreter: Interpreter | None = None, columns: list[str] = ()) -> DataFrame:
    """Interprets only the docs without a row in `mapped` (the deterministic result)."""
    return interpret_texts(docs.join(mapped.select(key).distinct(), key, "left_anti"), key, list(columns), interpreter or Unresolved())
