"""Near-duplicate documents by Order MinHash, checked by banded alignment.

Order MinHash: a text is the sequence of its k-word shingles, each labelled with how often it
occurred before. One sketch takes the `ell` labelled shingles with the smallest hash and writes
them down in text order, so two texts share it only if they agree on content and on order.
Texts sharing a sketch are candidates; they are aligned in a band and linked if
matched / (n + m - matched) >= 0.8 over their shingle sequences.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, U, as_long, hashed_words, lookup, mix, occurrences, shingles, small, unused
from .graph import classes, in_band

#: (sketches, shingles a sketch, fewest and most shingles of the texts they are for). Two texts of
#: similarity 0.8 or more always share a row of this table. At 0.8 exactly a pair is missed with
#: probability (1 - 0.8^6)^32 = 6e-5, short ones with (1 - 0.8^2)^10 = 4e-5.
LEVELS = ((32, 6, 20, 1 << 62), (10, 2, 1, 30))


def _seeds(level: int, m: int) -> np.ndarray:
    return mix(np.arange(1, m + 1, dtype=np.uint64) + U(level * 1000)) | U(1)


def sketches(s: np.ndarray, levels=LEVELS) -> np.ndarray:
    """One hash per sketch of a text with labelled shingles `s` (in text order)."""
    out = []
    n = len(s)
    for level, (m, ell, least, most) in enumerate(levels):
        if not least <= n <= most:
            continue
        seeds = _seeds(level, m)
        step = max(1, min(m, (1 << 20) // n))  # so that a long text stays within a few MB
        for lo in range(0, m, step):
            h = seeds[lo : lo + step, None] * s
            if n > ell:
                at = np.argpartition(h, ell - 1, axis=1)[:, :ell]
                at.sort(axis=1)
            else:
                at = np.broadcast_to(np.arange(n), h.shape)
            acc = seeds[lo : lo + step].copy()
            for j in range(at.shape[1]):
                acc = mix(acc ^ s[at[:, j]])
            out.append(acc)
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def alignment(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Longest common subsequence of two sequences of distinct items, within |i - j| <= band."""
    order = np.argsort(b, kind="stable")
    at = np.searchsorted(b, a, sorter=order)
    at[at == len(b)] = 0
    j = order[at]
    i = np.flatnonzero((b[j] == a) & (np.abs(j - np.arange(len(a))) <= band))
    j = j[i]
    if len(j) < 2 or (np.diff(j) > 0).all():
        return len(j)
    tails: list[int] = []
    for x in j.tolist():
        k = bisect_left(tails, x)
        if k == len(tails):
            tails.append(x)
        else:
            tails[k] = x
    return len(tails)


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    n, m = len(a), len(b)
    if not n or not m:
        return False
    need, band = in_band(n, m, similarity)
    return need <= min(n, m) and alignment(a, b, band) >= need


def _prepared(k: int):
    def run(texts: list[str | None]) -> list[np.ndarray]:
        return [occurrences(shingles(w, k)) for _, w in hashed_words(texts)]

    return run


def near_duplicates(spark: SparkSession, docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, class_id, is_kept) for every row of `docs`.

    Documents are in one class if a chain of links joins them: equal word sequences, or aligned
    similarity of their k-word shingles of `similarity` or more. class_id is the least doc_id of the
    class; is_kept marks the row of that doc_id. Words are runs of word characters, lower-cased; a text of
    fewer than k words is one shingle.

    Null, empty and wordless texts are each a class of their own. Rows with a null doc_id get a null
    class_id and are kept. Rows that repeat a doc_id get the class that holds its least text key. Only
    doc_id and text are read; further columns don't matter. An empty table gives an empty result.
    """
    scratch = Scratch(spark, "near")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("size", pa.int32()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            keys, sizes, found = [], [], []
            for _, w in hashed_words(texts):
                s = occurrences(shingles(w, k))
                keys.append(hashlib.md5(w.tobytes()).digest() if len(w) else None)
                sizes.append(len(s))
                found.append(as_long(sketches(s)))
            off = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            flat = pa.array(np.concatenate(found) if found else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(off, flat)], schema=schema)

    sketched = scratch.put(src.where("doc_id is not null").mapInArrow(run, "doc_id long, key binary, size int, bands array<long>"), "sketches")

    # exact copies: one node for each word sequence
    nodes = sketched.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.any_value("size").alias("size"), F.any_value("bands").alias("bands"), F.count("*").alias("copies"))
    nodes = scratch.put(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    bands = scratch.put(nodes.select("node", "size", F.explode("bands").alias("band")), "bands")

    def texts(wanted: DataFrame) -> DataFrame:
        want = nodes.select("node", "rep", "key").join(wanted, "node")
        want = scratch.put(want, "wanted")
        got = src.join(small(want, want.count(), 64), F.col("doc_id") == F.col("rep")).select("node", "key", "text")
        out = pa.schema([("node", pa.int64()), ("text", pa.string())])

        def same(batches):
            for b in batches:
                rows = b.column(2).to_pylist()
                ok = [hashlib.md5(w.tobytes()).digest() for _, w in hashed_words(rows)]
                keep = pa.array([x == y for x, y in zip(ok, b.column(1).to_pylist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2)], schema=out).filter(keep)

        return got.mapInArrow(same, "node long, text string").dropDuplicates(["node"])

    label = classes(spark, scratch, bands, texts, lambda a, b: similar(a, b, similarity), _prepared(k), similarity)

    # back to documents: only texts that are in a class of several rows need a join
    node = scratch.put(nodes.join(label, "node", "left").select("key", "rep", "copies", F.coalesce("label", "node").alias("label")), "labelled")
    least = node.groupBy("label").agg(F.min("rep").alias("class_id"), F.count("*").alias("n"), F.sum("copies").alias("docs")).where("docs > 1")
    least = scratch.put(least.select("label", "class_id", "n", "docs"), "least")
    k = least.agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).first()
    by_key = scratch.put(lookup(node, least.drop("docs"), "label", k["n"] or 0, split=True).select("key", "class_id", F.col("copies").alias("n")), "keys")
    by_doc = lookup(sketched.where("key is not null").select("doc_id", "key"), by_key, "key", k["docs"] or 0, split=True).groupBy("doc_id").agg(F.min_by("class_id", "key").alias("class_id"))
    by_doc = scratch.put(by_doc.where("class_id <> doc_id"), "moved")
    by_doc = small(by_doc, by_doc.count(), 32)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(by_doc, "doc_id", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id")).withColumn("is_kept", F.coalesce(F.col("class_id") == F.col("doc_id"), F.lit(True)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """`docs` with one document of each class, the one of least doc_id; nulls as in near_duplicates."""
    name = unused("gone_id", docs)
    gone = near_duplicates(spark, docs, k, similarity).where("not is_kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"] == F.col(name), "left_anti")
