"""Language identification as a mixture: expectation-maximisation over n-gram likelihoods.

A text's n-grams are drawn from a mixture of language models with unknown proportions. EM estimates
the proportions; languages are removed while the penalised likelihood (likelihood less a price per
language) gains, which selects the set of languages. The prediction is the largest proportion.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, small, with_fields
from .sampling import bounded, fold

#: Bound of the fit: documents of each language.
LANGUAGE_ROWS = 1_000
#: n-grams are hashed to so many values.
BITS = 15
_letters: list[np.ndarray] = []


def _letter(most: int) -> np.ndarray:
    """Whether a code point is a letter, for code points up to `most` at least."""
    if not _letters or len(_letters[0]) <= most:
        n = 0x3000 if most < 0x3000 else 0x110000
        _letters[:] = [np.fromiter((chr(c).isalpha() for c in range(n)), dtype=bool, count=n)]
    return _letters[0]


def grams(text: str | None) -> np.ndarray:
    """Hashed runs of one to three characters of the lower-cased letters, words (runs of letters) apart by one blank."""
    if not text:
        return np.empty(0, dtype=np.int64)
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), dtype=np.uint32)
    letter = _letter(int(c.max()))[c]
    if not letter.any():
        return np.empty(0, dtype=np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # what comes after a word's last letter is its blank
    c = np.concatenate([[np.uint32(32)], np.where(letter, c, np.uint32(32))[keep]]).astype(np.uint32)
    shift = np.uint32(32 - BITS)
    one = c * np.uint32(2654435761)
    two = (one[:-1] ^ (c[1:] * np.uint32(2246822519) + np.uint32(1))) * np.uint32(3266489917)
    three = (two[:-1] ^ (c[2:] * np.uint32(668265263) + np.uint32(7))) * np.uint32(374761393)
    return np.concatenate([one >> shift, two >> shift, three >> shift]).astype(np.int64)


@dataclass
class LanguageModel:
    languages: list[str]
    logp: np.ndarray  # (n-gram, language)
    price: float = 3.0

    def mixture(self, text: str | None) -> dict[str, float]:
        """Proportions of the selected languages; empty without letters or languages."""
        g = grams(text)
        if not len(g) or not self.languages:
            return {}
        counts = np.bincount(g, minlength=1 << BITS)
        at = np.flatnonzero(counts)
        c = counts[at].astype(float)
        lp = self.logp[at]
        # every language may explain a part of the text that the others don't; only the penalised likelihood removes one
        use = np.arange(len(self.languages))
        theta, like = self._em(c, lp, np.full(len(use), 1 / len(use)), 12)
        n = c.sum()
        price = self.price * 0.5 * np.log(n + 1)
        while len(use) > 1:
            drop = int(np.argmin(theta))
            rest = np.delete(np.arange(len(use)), drop)
            t, less = self._em(c, lp[:, use[rest]], theta[rest] / max(theta[rest].sum(), 1e-12), 8)
            if less - price * (len(use) - 1) < like - price * len(use):
                break
            use, theta, like = use[rest], t, less
        return {self.languages[i]: float(p) for i, p in zip(use, theta, strict=True)}

    @staticmethod
    def _em(c: np.ndarray, lp: np.ndarray, theta: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
        top = lp.max(axis=1)
        p = np.exp(lp - top[:, None])
        total = c.sum()
        if len(theta) == 1:
            return np.ones(1), float(c @ top)
        for _ in range(steps):
            theta = theta * ((c / (p @ theta)) @ p) / total
            theta = np.maximum(theta, 1e-12)
            theta /= theta.sum()
        return theta, float(c @ (np.log(p @ theta) + top))

    def predict(self, text: str | None) -> tuple[str, float]:
        m = self.mixture(text)
        if not m:
            return "und", 0.0
        best = min(m, key=lambda x: (-m[x], x))
        return best, min(1.0, m[best])


def learn(docs: DataFrame) -> LanguageModel:
    """Counts n-grams of at most about LANGUAGE_ROWS documents of each language, outside the held-out quarter."""
    rows = docs.where("doc_id is not null and lang is not null").where(fold(4) != 2).select("doc_id", "lang", F.col("text").cast("string").alias("text"))
    ids = bounded(rows.select("doc_id", "lang").distinct(), "lang", LANGUAGE_ROWS)

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                total.setdefault(lang, np.zeros(1 << BITS, dtype=np.int64))
                total[lang] += np.bincount(grams(t), minlength=1 << BITS)
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["lang", "g", "n"])

    each = rows.join(small(ids, ids.count(), 48), ["doc_id", "lang"]).select("lang", "text").mapInArrow(run, "lang string, g long, n long")
    # a language has at most 2^BITS hashed n-grams
    got = each.groupBy("lang", "g").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.collect_list(F.struct("g", "n")).alias("c"))
    counts: dict[str, np.ndarray] = {}
    for r in got.toLocalIterator():
        c = np.zeros(1 << BITS)
        for g, n in r["c"]:
            c[g] += n
        counts[r["lang"]] = c
    names = sorted(counts)
    if not names:
        return LanguageModel([], np.zeros((1 << BITS, 0)))
    table = np.stack([counts[x] for x in names], axis=1) + 0.1
    return LanguageModel(names, np.log(table / table.sum(axis=0)))


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """`docs` with held_out, lang_pred, score and languages (map of the selected set to proportions).

    Learns from text and lang of documents whose crc32(doc_id as text) mod 4 is not 2; rows with a null
    doc_id or lang teach nothing. Every row is predicted from its whole text. Null texts and texts without a
    letter are `und` with score 0, as is every text where there is nothing to learn from. held_out is false
    for a null doc_id. Ties go to the smaller language name. Columns with the names added are replaced.
    """
    bounded_batches(spark)
    model = spark.sparkContext.broadcast(learn(docs))
    plain = docs.drop("held_out", "lang_pred", "score", "languages")
    names = plain.columns
    at = names.index("text")

    def run(batches):
        m = model.value
        for b in batches:
            sets = [m.mixture(t) for t in b.column(at).to_pylist()]
            best = [min(x, key=lambda k, x=x: (-x[k], k)) if x else "und" for x in sets]
            score = [min(1.0, x[k]) if x else 0.0 for x, k in zip(sets, best, strict=True)]
            maps = pa.array([list(x.items()) for x in sets], pa.map_(pa.string(), pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best, pa.string()), pa.array(score, pa.float64()), maps], names=[*names, "lang_pred", "score", "languages"])

    out = plain.mapInArrow(run, with_fields(plain.schema, "lang_pred string, score double, languages map<string,double>"))
    return out.withColumn("held_out", F.coalesce(fold(4) == 2, F.lit(False)))
