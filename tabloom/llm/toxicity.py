"""Toxicity: a logistic classifier over words and word beginnings, regularised by counterfactuals.

Sentences of labelled texts that name a group are written again with another group of the same list;
the loss has a penalty on the squared change of the score, so that the names of groups, which occur
more often in toxic texts, don't make a neutral sentence toxic.
"""

from __future__ import annotations

import logging
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, small, with_fields, words
from .sampling import bounded, fold

#: Terms that name groups, by list; a term is swapped for the next of its own list.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("women", "men"),
    ("woman", "man"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino"),
    ("immigrants", "refugees", "citizens"),
    ("muslime", "christen", "juden", "hindus", "atheisten"),
    ("frauen", "männer"),
    ("musulmans", "chrétiens", "juifs", "hindous", "athées"),
    ("femmes", "hommes"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "ateos"),
    ("mujeres", "hombres"),
)
log = logging.getLogger(__name__)

#: Bounds of the fit: rows of each label, and features kept (those that tell the labels apart best).
LABEL_ROWS, FEATURES = 6_000, 600
_SENTENCE = re.compile(r"[^.!?\n]+")


def swaps(terms=IDENTITY_TERMS) -> dict[str, str]:
    return {t: group[(i + 1) % len(group)] for group in terms for i, t in enumerate(group)}


def features(ws) -> set[str]:
    """Words and their beginnings of three to six letters."""
    out = set()
    for w in set(ws):
        out.add(w)
        for k in (3, 4, 5, 6):
            if len(w) > k:
                out.add(w[:k] + "*")
    return out


def counterfactual(text: str | None, swap: dict[str, str]) -> list[str] | None:
    """The text's words with the group terms of its sentences swapped; None if it has none."""
    hit, out = False, []
    for m in _SENTENCE.finditer(text or ""):
        ws = words(m[0])
        new = [swap.get(w, w) for w in ws]
        hit |= new != ws
        out += new
    return out if hit else None


@dataclass
class ToxicModel:
    vocabulary: dict[str, int]
    w: np.ndarray
    bias: float
    n_swapped: int = 0  # labelled texts in whose sentences group terms were swapped

    def score(self, ws) -> float:
        get = self.vocabulary.get
        seen = set()
        for x in set(ws):
            if (i := get(x)) is not None:
                seen.add(i)
            for k in (3, 4, 5, 6):
                if len(x) > k and (i := get(x[:k] + "*")) is not None:
                    seen.add(i)
        z = self.bias + float(self.w[sorted(seen)].sum()) if seen else self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(x: np.ndarray, y: np.ndarray, d: np.ndarray, weight: np.ndarray, l2: float = 0.1, mu: float = 10.0) -> tuple[np.ndarray, float]:
    """Weights and bias minimising logistic loss + l2/2 |w|^2 + mu/2 |d w|^2; d holds the changes of the features.

    `weight` makes up for label rows that were not sampled.
    """
    n, k = x.shape
    w = np.zeros(k + 1)
    if not n:
        return w[:-1], -2.0
    xb = np.hstack([x, np.ones((n, 1), dtype=x.dtype)])
    fixed = np.zeros((k + 1, k + 1))
    fixed[:k, :k] = l2 * np.eye(k) + (mu * (d.T @ d) if len(d) else 0)
    fixed[k, k] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(xb @ w, -30, 30)))
        grad = xb.T @ (weight * (p - y)) + fixed @ w
        r = np.sqrt(weight * np.maximum(p * (1 - p), 1e-6)).astype(x.dtype)
        xr = xb * r[:, None]
        step = np.linalg.solve((xr.T @ xr).astype(float) + fixed, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def learn(docs: DataFrame, labels: DataFrame, terms=IDENTITY_TERMS, mu: float = 10.0) -> ToxicModel:
    """Fits on at most about LABEL_ROWS rows of each label, outside the held-out quarter; `mu` weighs the counterfactual penalty."""
    scratch = Scratch(docs.sparkSession, "toxic")
    swap = swaps(terms)
    y = labels.where("doc_id is not null and toxic is not null").where(fold(4) != 2).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    sizes = {r["y"]: r["count"] for r in y.groupBy("y").count().collect()}
    y = bounded(y, "y", LABEL_ROWS)
    # the sample is read three times; all texts are read once for it
    rows = scratch.put(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(small(y, y.count(), 32), "doc_id"), "sample")

    def counted(batches):
        total: dict[int, Counter] = {}
        for b in batches:
            for t, label in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                ws = words(t)
                found = features(ws)
                total.setdefault(label, Counter()).update(found)
        for label, c in total.items():
            names = list(c)
            for lo in range(0, len(names), 50_000):
                part = names[lo : lo + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([label] * len(part), pa.int32()), pa.array([c[f] for f in part], pa.int64())], names=["feature", "y", "n"])

    counts = rows.mapInArrow(counted, "feature string, y int, n long")
    per = counts.groupBy("feature").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("y") != 1, F.col("n")).otherwise(0)).alias("neg"))
    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    n1, n0 = max(1, n.get(1, 0)), max(1, sum(v for k, v in n.items() if k != 1))
    gap = F.col("pos") / n1 - F.col("neg") / n0
    noise = F.sqrt((F.col("pos") + 1) / n1 / n1 + (F.col("neg") + 1) / n0 / n0)
    top = per.where("pos + neg >= 3").withColumn("z", F.abs(gap / noise)).orderBy(F.desc("z"), "feature").limit(FEATURES)
    vocabulary = {r["feature"]: i for i, r in enumerate(sorted(top.select("feature").collect()))}

    def indexed(batches):
        for b in batches:
            x, changed = [], []
            for t in b.column("text").to_pylist():
                x.append(sorted(vocabulary[f] for f in features(words(t)) if f in vocabulary))
                other = counterfactual(t, swap)
                changed.append(None if other is None else sorted(vocabulary[f] for f in features(other) if f in vocabulary))
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(x, ints), pa.array(changed, ints)], names=["doc_id", "y", "x", "other"])

    got = sorted((tuple(r) for r in rows.mapInArrow(indexed, "doc_id long, y int, x array<int>, other array<int>").collect()), key=lambda r: (r[0], r[2]))
    x = np.zeros((len(got), len(vocabulary)), dtype=np.float32)
    for i, r in enumerate(got):
        x[i, r[2]] = 1
    change = []
    for i, r in enumerate(got):
        if r[3] is not None:
            to = np.zeros(len(vocabulary), dtype=np.float32)
            to[r[3]] = 1
            change.append(x[i] - to)
    label = np.array([1.0 if r[1] == 1 else 0.0 for r in got])
    full1, full0 = sizes.get(1, 0), sum(v for k, v in sizes.items() if k != 1)
    weight = np.where(label == 1, full1 / n1, full0 / n0)
    if not change:
        log.warning("no labelled sentence names a group: the counterfactual penalty has nothing to act on")
    w, bias = fit(x, label, np.array(change, dtype=np.float32).reshape(len(change), len(vocabulary)), weight, mu=mu)
    return ToxicModel(vocabulary, w, bias, len(change))


def score_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.3, terms=IDENTITY_TERMS) -> DataFrame:
    """`docs` with held_out, score and predicted.

    Learns from `labels` (doc_id, toxic) of documents whose crc32(doc_id as text) mod 4 is not 2; a doc_id
    labelled twice takes the larger label; null ids and labels are left out. Every row is scored on its whole
    text, null and empty texts too (as a text without words); held_out is false for a null doc_id. Without
    labels to learn from every score is the same, below the threshold. Columns named held_out, score or
    predicted are replaced.
    """
    bounded_batches(spark)
    model = spark.sparkContext.broadcast(learn(docs, labels, terms))
    plain = docs.drop("held_out", "score", "predicted")
    names = plain.columns
    at = names.index("text")

    def run(batches):
        m = model.value
        for b in batches:
            s = [m.score(words(t)) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*names, "score"])

    out = plain.mapInArrow(run, with_fields(plain.schema, "score double"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumn("held_out", F.coalesce(fold(4) == 2, F.lit(False)))
