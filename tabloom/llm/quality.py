"""Quality classifier: Bradley-Terry ranking learned from pairs of a good and a bad document.

P(i preferred to j) = sigmoid(w . (x_i - x_j)). The score of a document is its strength w . x; the
threshold is a quantile of the training scores, and what is returned is a logistic curve through 0.5 there.
"""

from __future__ import annotations

import operator
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, bounded_batches, mix, small, with_fields
from .sampling import bounded, fold

#: Bound of the fit: rows of each label. Each of them takes part in PAIRS_A_ROW preference pairs or more.
LABEL_ROWS, PAIRS_A_ROW = 4_000, 10
#: Words and runs of three characters are hashed to so many features each.
HASHED = 96

_CLASS = np.zeros(129, dtype=np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 blank, 5 stop, 6 comma, 7 quote or hyphen, 8 symbol
for _c in range(128):
    _s = chr(_c)
    _CLASS[_c] = 1 if _s.islower() else 2 if _s.isupper() else 3 if _s.isdigit() else 4 if _s.isspace() else 5 if _s in ".!?;:" else 6 if _s == "," else 7 if _s in "'\"-()" else 8
_SYMBOL_WORD = re.compile(r"^[\W_]+$")


def hashed(text: str, cp: np.ndarray) -> np.ndarray:
    """Shares of the hashed words and runs of three characters, as square roots, so that rare ones count."""
    h = Words([text.lower()]).h
    word = np.bincount((h % np.uint64(HASHED)).astype(np.int64), minlength=HASHED) / max(1, len(h))
    c = cp.astype(np.uint64)
    runs = mix(c[:-2] + (c[1:-1] << np.uint64(21)) + (c[2:] << np.uint64(42))) if len(c) > 2 else c[:0]
    run = np.bincount((runs % np.uint64(HASHED)).astype(np.int64), minlength=HASHED) / max(1, len(runs))
    return np.sqrt(np.concatenate([word, run]))


def features(text: str | None) -> np.ndarray:
    """Shares and rates that hold for a text of any length and language, then hashed n-grams; all zero for an empty text."""
    out = np.zeros(SHAPE + 2 * HASHED)
    if not text or not text.strip():
        return out
    cp = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    kinds = np.bincount(_CLASS[np.minimum(cp, 128)], minlength=9) / len(cp)
    ws = text.split()
    n = len(ws)
    lower = text.lower().split()
    counts = Counter(lower)
    share = [kinds[8], kinds[2], kinds[3], kinds[5], kinds[7]]
    share.append(sum(map(operator.eq, lower, lower[1:])) / n)
    share.append(sum(1 for w, c in counts.items() if _SYMBOL_WORD.match(w) for _ in range(c)) / n)
    share.append(max(counts.values()) / n if n > 20 else 0.0)
    share.append(text.count("!") / n)
    out[: len(share)] = np.log(np.array(share) + 1e-3) - np.log(1e-3)
    k = len(share)
    out[SHAPE:] = hashed(text, cp)
    out[k : k + 7] = [1.0, np.log1p(n), np.log(len(counts)) / np.log(n + 1), len(cp) / n / 10, kinds[6], kinds[1], 1.0 if n < 20 else 0.0]
    return out


#: Features of a text's shape; those of its n-grams come after them.
SHAPE = 16
N_FEATURES = SHAPE + 2 * HASHED


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    threshold: float
    spread: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.w
        return 1 / (1 + np.exp(-np.clip((z - self.threshold) / self.spread, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, l2_hashed: float = 0.3) -> QualityModel:
    """From features and labels (1 good). With one label only every score is that label's side of 0.5."""
    mean, scale = (x.mean(0), x.std(0)) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = (x - mean) / scale
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y != 1)
    if not len(good) or not len(bad):
        return QualityModel(mean, scale, np.zeros(x.shape[1]), -1.0 if len(good) >= len(bad) else 1.0, 1.0)
    i = np.arange(PAIRS_A_ROW * max(len(good), len(bad)))
    d = z[good[(i * 7919) % len(good)]] - z[bad[(i * 104729 + i // len(bad)) % len(bad)]]
    w = np.zeros(d.shape[1])
    decay = np.where(np.arange(len(w)) < SHAPE, l2, l2_hashed)
    for _ in range(30):  # Newton's method on the logistic loss of the differences
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        grad = d.T @ (p - 1) / len(d) + decay * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + np.diag(decay)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    s = z @ w
    order = np.argsort(s, kind="stable")
    # the quantile of the scores below which rejecting costs the fewest errors
    errors = np.cumsum(np.where(y[order] == 1, 1, -1)) + len(bad)
    k = int(np.argmin(errors))
    t = (s[order[k]] + s[order[min(k + 1, len(s) - 1)]]) / 2
    return QualityModel(mean, scale, w, float(t), float(max(s.std() / 4, 1e-6)))


def _featured(rows: DataFrame, keep: list[str], schema: str) -> DataFrame:
    def run(batches):
        for b in batches:
            x = [features(t).tolist() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(x, pa.list_(pa.float64()))], names=[*keep, "x"])

    return rows.select("text", *keep).mapInArrow(run, f"{schema}, x array<double>")


def learn(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """Fits on at most about LABEL_ROWS rows of each label, outside the held-out third."""
    y = labels.where("doc_id is not null and quality is not null").where(fold(3) != 1).groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    y = small(y := bounded(y, "y", LABEL_ROWS), y.count(), 32)
    rows = _featured(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(y, "doc_id"), ["doc_id", "y"], "doc_id long, y int")
    got = sorted((r["doc_id"], r["y"], r["x"]) for r in rows.collect())
    return fit(np.array([r[2] for r in got]).reshape(len(got), -1) if got else np.zeros((0, N_FEATURES)), np.array([r[1] for r in got]))


def score_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """`docs` with held_out, score and predicted.

    Learns from `labels` (doc_id, quality) of documents whose crc32(doc_id as text) mod 3 is not 1; a doc_id
    labelled twice takes the larger label; null ids and labels are left out. Every row is scored, null and
    empty texts too (as a text of no characters); held_out is false for a null doc_id. Without any label
    to learn from all scores are above 0.5. Columns named held_out, score or predicted are replaced.
    """
    bounded_batches(spark)
    model = spark.sparkContext.broadcast(learn(docs, labels))
    plain = docs.drop("held_out", "score", "predicted")
    names = plain.columns
    at = names.index("text")

    def run(batches):
        m = model.value
        for b in batches:
            texts = b.column(at).to_pylist()
            s = m.scores(np.array([features(t) for t in texts]).reshape(len(texts), N_FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*names, "score"])

    out = plain.mapInArrow(run, with_fields(plain.schema, "score double"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumn("held_out", F.coalesce(fold(3) == 1, F.lit(False)))
