"""Substring dedup: passages that repeat across documents, by MinHash banding, exact checks and components.

Two kinds of unit, both cut from a document's word sequence:
  paragraphs  lines of MIN_WORDS words or more, and runs of shorter lines up to a blank or a longer one, if they have as many words
              together; MinHash bands tuned for recall at Jaccard 0.8, colliding paragraphs checked by exact Jaccard of their
              shingles, clustered by connected components
  blocks      runs of BLOCK words, for passages pasted into the middle of a paragraph. Every position's
              shingle is hashed and the block at the least hash among WINNOW neighbouring starts is
              taken (a one-row MinHash of the stretch), so any two equal runs of RUN = BLOCK + WINNOW - 1 = 50 words
              share a block; blocks are clustered by equality. Where a document's shared blocks end, the blocks are checked again by a
              second hash of their words and extended word by word as far as another document agrees
In each cluster over two documents or more the smallest doc_id stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, U, Words, as_long, bounded_batches, chunks, distinct, hashed_joins, lookup, mix, rows_of, shingles, unused
from .graph import classes

MIN_WORDS, BLOCK, WINNOW = 40, 25, 26
#: Words of the shortest equal run that is reported; every one is found.
RUN = BLOCK + WINNOW - 1
#: At Jaccard 0.8 a pair of paragraphs is missed with probability (1 - 0.8^4)^14 = 6e-4.
BANDS, ROWS = 14, 4
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * U(0x51_7C_C1_B7_27_22_0A_95)) | U(1)
#: Factors of two multilinear hashes of a block's words; the first ones serve a band's rows, too.
_ODD, _ODD2 = (mix(np.arange(1, BLOCK + 1, dtype=np.uint64) * U(x)) | U(1) for x in (0x9E3779B97F4A7C15, 0xA0761D6478BD642F))


def folded(text: str) -> str:
    """Lower case without change of length, so that places in it are places in the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def read(texts: list[str | None]) -> Iterator[tuple[int, int, Words]]:
    """Ranges of rows with their words; memory is bounded by a chunk."""
    for lo, hi in chunks(texts):
        yield lo, hi, Words([folded(t) if t else "" for t in texts[lo:hi]])


def minhash_bands(s: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One hash per band (columns) for each set of shingles; set i begins at first[i] of `s`, none is empty."""
    low = np.empty((len(first), BANDS * ROWS), dtype=np.uint64)
    for j, seed in enumerate(_SEEDS):
        low[:, j] = np.minimum.reduceat(seed * s, first)
    return mix((low.reshape(-1, BANDS, ROWS) * _ODD[:ROWS]).sum(axis=2) + np.arange(1, BANDS + 1, dtype=np.uint64))


def _block_hash(w: np.ndarray, starts: np.ndarray, odd: np.ndarray = _ODD) -> np.ndarray:
    return mix((w[starts[:, None] + np.arange(BLOCK)] * odd).sum(axis=1)) if len(starts) else np.empty(0, np.uint64)


def blocks(w: np.ndarray, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the winnowed runs of BLOCK words of texts; text i is w[first[i] : first[i + 1]]."""
    first = np.array([0, len(w)]) if first is None else first
    n = len(w) - RUN + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    # the hash with its place in the low bits: among equal ones the leftmost is the least
    mask = U((1 << 22) - 1)
    rank = (mix(shingles(w, 5)) & ~mask) | (np.arange(len(w) - 4, dtype=np.uint64) & mask)
    size = 1
    while size < WINNOW:  # minima of windows of 1, 2, 4, ... places, and at last of WINNOW
        step = min(size, WINNOW - size)
        rank = np.minimum(rank[:-step], rank[step:])
        size += step
    i = np.arange(n)
    at = i + ((rank[:n] - i.astype(np.uint64)) & mask).astype(np.int64)
    text = np.searchsorted(first, i, "right")
    at = at[i + RUN <= first[np.minimum(text, len(first) - 1)]]
    at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
    return at, _block_hash(w, at)


def paragraphs(got: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and number of words of the paragraphs of MIN_WORDS words or more."""
    feed = np.flatnonzero(got.chars == 10)
    line = np.searchsorted(feed, got.start)
    n = np.bincount(line, minlength=len(feed))
    text = np.searchsorted(got.at, np.concatenate([[0], feed[:-1] + 1]), "right") - 1
    short = (n > 0) & (n < MIN_WORDS)
    new = np.ones(len(n), dtype=bool)  # whether a line begins a paragraph
    new[1:] = ~(short[1:] & short[:-1] & (text[1:] == text[:-1]))
    begin = np.flatnonzero(new)
    if not len(begin):
        return text, begin, begin
    words = np.add.reduceat(n, begin)
    first = (np.cumsum(n) - n)[begin]
    ok = words >= MIN_WORDS
    return text[begin][ok], first[ok], words[ok]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two arrays of distinct sorted hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... n[0] numbers, then those of first[1] and so on."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def _distinct(s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many different hashes there are among the first n[0] of `s`, the next n[1] and so on."""
    whole = np.repeat(np.arange(len(n)), n)
    own = mix(s ^ mix(whole.astype(np.uint64) + U(1)))  # one sort of plain numbers
    order = np.argsort(own)
    t = own[order]
    return n - np.bincount(whole[order[1:][t[1:] == t[:-1]]], minlength=len(n))


def _extended(scratch: Scratch, src: DataFrame, shared: DataFrame, total: int) -> DataFrame:
    """(doc_id, first, n, hash, keeper): the outermost shared blocks of documents with what they have in common with others beyond their ends.

    Between the outermost block of an equal run of RUN words and the run's end are fewer than WINNOW words, the block's context. The distinct contexts
    of a block, over all documents that have it, are compared with that of the least document; those that leave it at the same word for the
    same other word may agree further among themselves, and are compared again with the least of them, until nobody is left. Each
    round settles a word more at least, so there are WINNOW at most. A second hash of the block's words verifies it.
    """
    before, after = (Window.partitionBy("doc_id").orderBy(x).rowsBetween(Window.unboundedPreceding, -1) for x in (F.asc("first"), F.desc("first")))
    gone = F.col("keeper") < F.col("doc_id")  # what is removed has ends of its own

    def free(of: Column) -> tuple[Column, Column]:
        """Whether none of the document's blocks for which `of` holds reaches up to a block from the left, and from the right."""
        near = F.last(F.when(of, F.col("first")), ignorenulls=True)
        return F.coalesce(near.over(before) < F.col("first") - BLOCK, F.lit(True)), F.coalesce(near.over(after) > F.col("first") + BLOCK, F.lit(True))

    left, right = (x | gone & y for x, y in zip(free(F.lit(True)), free(gone), strict=True))
    marked = scratch.put(shared.select("hash", "doc_id", "first", left.alias("left"), right.alias("right")), "marked")
    ends = marked.groupBy("hash").agg(F.max("left").alias("l"), F.max("right").alias("r"), F.count("*").alias("n")).where("l or r")
    asked = lookup(marked, scratch.put(ends, "ends"), "hash", total, split=True)
    per = scratch.put(asked.groupBy(F.col("doc_id").alias("doc")).agg(F.collect_list(F.struct("first", "hash", "left", "right", "l", "r")).alias("asked")), "asked")
    got = rows_of(src, per, "doc", per.count()).select("doc_id", "text", "asked")
    names = ["hash", "side", "context", "doc_id", "first", "own", "key", "words"]

    def cut(batches):
        for b in batches:
            ids, asked = b.column(0).to_numpy(), b.column(2)
            off = asked.offsets.to_numpy() - asked.offsets[0].as_py()
            first, h, *flags = (x.to_numpy(zero_copy_only=False) for x in asked.flatten().flatten())
            for lo, hi, got in read(b.column(1).to_pylist()):
                part = slice(off[lo], off[hi])
                row = np.repeat(np.arange(hi - lo), np.diff(off[lo : hi + 1]))
                at, mine = first[part] + got.first[row], h[part].view(np.uint64)
                here = np.flatnonzero(at + BLOCK <= got.first[row + 1])
                # a row that repeats a doc_id may hold another text
                here = here[_block_hash(got.h, at[here]) == mine[here]]
                at, mine, row = at[here], mine[here], row[here]
                block = mix(mine ^ (_block_hash(got.h, at, _ODD2) * _ODD[0]))
                short = (got.h >> U(32)).astype(np.uint32) | np.uint32(1)
                for which in range(2):
                    own, use = flags[which][part][here], np.flatnonzero(flags[which + 2][part][here])
                    if not len(use):
                        continue
                    x = at[use]
                    place = x[:, None] - 1 - np.arange(WINNOW - 1) if which == 0 else x[:, None] + BLOCK + np.arange(WINNOW - 1)
                    there = (place >= got.first[row[use]][:, None]) & (place < got.first[row[use] + 1][:, None])
                    words = np.where(there, short[np.clip(place, 0, len(short) - 1)], np.uint32(0))
                    key = mix(block[use] + U(which))
                    context = mix(key ^ (words.astype(np.uint64) * _ODD2[: WINNOW - 1]).sum(axis=1))
                    raw = pa.Array.from_buffers(pa.binary(4 * (WINNOW - 1)), len(use), [None, pa.py_buffer(np.ascontiguousarray(words))]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(as_long(mine[use])), pa.array(np.full(len(use), which, dtype=np.int32)), pa.array(as_long(context)), pa.array(ids[lo:hi][row[use]]), pa.array(x - got.first[row[use]]), pa.array(own[use]), pa.array(as_long(key)), raw],
                        names=names,
                    )

    around = scratch.put(got.mapInArrow(cut, "hash long, side int, context long, doc_id long, first long, own boolean, key long, words binary"), "around")
    now = around.groupBy("hash", "side", "context", "key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.first("words").alias("words"), F.count_if("own").alias("n"))
    now = scratch.put(now, "contexts")
    found = now.where("lo < hi and n > 0").select("hash", "side", "context", F.col("lo").alias("keeper"), F.lit(WINNOW - 1).alias("same"), "words", "n")
    parts_of = [scratch.put(found, "settled")]

    def compare(batches):
        for b in batches:
            if not len(b):
                continue
            mine, other = (np.frombuffer(b"".join(b.column(j).to_pylist()), dtype=np.uint32).reshape(-1, WINNOW - 1) for j in (1, 2))
            same = np.concatenate([mine == other, np.zeros((len(b), 1), dtype=bool)], axis=1).argmin(axis=1)
            leaves = np.take_along_axis(mine, np.minimum(same, WINNOW - 2)[:, None], 1)[:, 0]
            after = as_long(mix(b.column(0).to_numpy().view(np.uint64) + mix(leaves.astype(np.uint64) * U(64) + same.astype(np.uint64))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(same.astype(np.int32)), pa.array(after)], names=[*b.schema.names, "same", "after"])

    rest = ["hash", "side", "context", "lo", "hi", "n"]
    kinds = "key long, words binary, other binary, hash long, side int, context long, lo long, hi long, n long, keeper long, chief long, same int, after long"
    for _ in range(WINNOW):
        least = now.groupBy("key").agg(F.min(F.struct("lo", "context", "words")).alias("k"), F.count("*").alias("m")).where("m > 1")
        least = scratch.put(least.select("key", F.col("k.words").alias("other"), F.col("k.lo").alias("keeper"), F.col("k.context").alias("chief"), F.col("m").alias("n")), "least")
        facts = least.agg(F.count("*").alias("k"), F.sum("n").alias("n")).first()
        if not facts["k"]:
            break
        with_n = now.withColumnRenamed("n", "own_n")  # `n` is the lookup's
        both = lookup(with_n, least, "key", facts["n"], split=True).withColumnRenamed("own_n", "n").select("key", "words", "other", *rest, "keeper", "chief")
        met = scratch.put(both.mapInArrow(compare, kinds), "met")
        scratch.drop(now, least)
        others = met.where("context <> chief and same > 0")
        parts_of.append(scratch.put(others.where("n > 0").select("hash", "side", "context", "keeper", "same", "words", "n"), "same"))
        most = others.groupBy("key").agg(F.max("same").alias("most"))
        chiefs = met.where("context = chief and n > 0").join(most, "key")
        parts_of.append(scratch.put(chiefs.select("hash", "side", "context", "keeper", F.col("most").alias("same"), "words", "n"), "chief"))
        now = scratch.put(met.where(f"context <> chief and same < {WINNOW - 1}").select(F.col("after").alias("key"), "words", *rest), "contexts")
        scratch.drop(met)
    out = parts_of[0]
    for df in parts_of[1:]:
        out = out.unionByName(df)
    # a text that ends earlier has zeros for the words that it lacks
    there = F.size(F.filter(F.sequence(F.lit(0), F.lit(WINNOW - 2)), lambda i: F.substring(F.col("words"), i * 4 + 1, 4) != F.lit(bytes(4))))
    out = out.select("hash", "side", "context", "keeper", F.least("same", there).alias("same"), "n").where("same > 0")
    # several rows for a context: its own number of ends counts for each
    agreed = scratch.put(out.groupBy("hash", "side", "context").agg(F.collect_list(F.struct("keeper", "same")).alias("agreed"), F.max("n").alias("n")), "agreed")
    k = agreed.agg(F.sum("n")).first()[0] or 0
    long = lookup(around.where("own").select("hash", "side", "context", "doc_id", "first"), agreed, ["hash", "side", "context"], k, split=True).withColumn("x", F.explode("agreed"))
    return long.select("doc_id", F.when(F.col("side") == 0, F.col("first") - F.col("x.same")).otherwise(F.col("first")).alias("first"), (F.col("x.same") + BLOCK).cast("long").alias("n"), "hash", F.col("x.keeper").alias("keeper"))


def repeated_spans(spark: SparkSession, docs: DataFrame, scratch: Scratch, similarity: float = 0.8) -> DataFrame:
    """(doc_id, first, n, paragraph, class, keeper): word spans that repeat in two documents or more.

    `class` numbers the component of a paragraph, or is the hash of a block (these spans make up runs, see _extended).
    """
    bounded_batches(spark)
    src = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    unit = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("hash", pa.int64()), ("n", pa.int64()), ("size", pa.int32()), ("key", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def batch_of(rows: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(rows, f.type) for f in unit], schema=unit)

    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            for lo, hi, got in read(b.column(1).to_pylist()):
                whose = ids[lo:hi]
                at, h = blocks(got.h, got.first)
                text = np.searchsorted(got.first, at, "right") - 1
                yield batch_of(len(at), doc_id=pa.array(whose[text]), first=pa.array(at - got.first[text]), hash=pa.array(as_long(h)))
                text, first, n = paragraphs(got)
                if not len(n):
                    continue
                s = shingles(got.h, 5)[_spread(first, n - 4)]
                begin = np.cumsum(n - 4) - (n - 4)
                size = _distinct(s, n - 4)
                keys = [hashlib.md5(got.h[x : x + k].tobytes()).digest() for x, k in zip(first.tolist(), n.tolist(), strict=True)]
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * BANDS, pa.int32()), pa.array(as_long(minhash_bands(s, begin)).ravel()))
                yield batch_of(len(n), doc_id=pa.array(whose[text]), first=pa.array(first - got.first[text]), n=pa.array(n), size=pa.array(size.astype(np.int32)), key=pa.array(keys, pa.binary()), bands=bands)

    units = scratch.put(src.mapInArrow(run, "doc_id long, first long, hash long, n long, size int, key binary, bands array<long>"), "units")

    # blocks: clusters by equality
    block = units.where("hash is not null").select("hash", "doc_id", "first")
    twice = block.groupBy("hash").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("keeper <> last")
    twice = scratch.put(twice.select("hash", "keeper", "n"), "blocks")
    facts = twice.agg(F.sum("n").alias("n")).first()
    shared = lookup(block, twice, "hash", facts["n"] or 0, split=True)
    shared = scratch.put(shared.select("doc_id", "first", "hash", "keeper"), "shared")
    spans = shared.select("doc_id", "first", F.lit(BLOCK).cast("long").alias("n"), "hash", "keeper").unionByName(_extended(scratch, src, shared, facts["n"] or 0))
    spans = spans.select("doc_id", "first", "n", F.lit(False).alias("paragraph"), F.col("hash").alias("class"), "keeper")

    # paragraphs: equal ones are one node; bands propose pairs of nodes
    para = units.where("key is not null").select("key", "doc_id", "first", "n", "size", "bands")
    node = para.groupBy("key").agg(F.min(F.struct("doc_id", "first", "n")).alias("at"), F.max("doc_id").alias("last"), F.any_value("size").alias("size"), F.any_value("bands").alias("bands"), F.count("*").alias("copies"))
    node = scratch.put(node.withColumn("node", F.monotonically_increasing_id()), "nodes")
    bands = scratch.put(node.select("node", "size", F.explode("bands").alias("band")), "bands")

    def texts(wanted: DataFrame) -> DataFrame:
        per = node.join(wanted, "node").groupBy(F.col("at.doc_id").alias("doc")).agg(F.collect_list(F.struct(F.col("at.first").alias("first"), F.col("at.n").alias("n"), "node", "key")).alias("want"))
        per = scratch.put(per, "wanted")
        asked = rows_of(src, per, "doc", per.count()).select("text", "want")

        def cut(batches):
            for b in batches:
                texts, want = b.column(0).to_pylist(), b.column(1)
                for lo, hi, got in read(texts):
                    nodes, out = [], []
                    for i in range(lo, hi):
                        begin, stop, place = int(got.first[i - lo]), int(got.first[i - lo + 1]), int(got.at[i - lo])
                        for x in want[i].as_py():
                            a, z = begin + x["first"], begin + x["first"] + x["n"]
                            if z <= stop and hashlib.md5(got.h[a:z].tobytes()).digest() == x["key"]:
                                nodes.append(x["node"])
                                out.append(texts[i][int(got.start[a]) - place : int(got.end[z - 1]) - place])
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(out, pa.string())], names=["node", "text"])

        return asked.mapInArrow(cut, "node long, text string").dropDuplicates(["node"])

    def prepare(pieces: list[str]) -> list[np.ndarray]:
        return [distinct(shingles(got.h[got.first[i] : got.first[i + 1]], 5)) for lo, hi, got in read(pieces) for i in range(hi - lo)]

    label = classes(spark, scratch, bands, texts, lambda a, b: jaccard(a, b) >= similarity, prepare, similarity)
    named = node.join(label, "node", "left").select("key", F.coalesce("label", "node").alias("label"), F.col("at.doc_id").alias("least"), "last", "copies")
    two = named.groupBy("label").agg(F.min("least").alias("keeper"), F.max("last").alias("last"), F.count("*").alias("n")).where("keeper <> last")
    two = scratch.put(two.select("label", "keeper", "n"), "kept")
    k = two.agg(F.sum("n")).first()[0] or 0
    named = scratch.put(lookup(named.select("key", "label", F.col("copies")), two, "label", k, split=True).select("key", "label", "keeper", F.col("copies").alias("n")), "named")
    k = named.agg(F.sum("n")).first()[0] or 0
    more = lookup(para.select("key", "doc_id", "first", F.col("n").alias("width")), named, "key", k, split=True)
    return spans.unionByName(more.select("doc_id", "first", F.col("width").alias("n"), F.lit(True).alias("paragraph"), F.col("label").alias("class"), "keeper"))


def merged(row: np.ndarray, first: np.ndarray, n: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of the spans of each row: firsts, lasts (excluded), and where each of `rows` rows begins in them."""
    if not len(row):
        return first, first, np.zeros(rows + 1, dtype=np.int64)
    wide = int((first + n).max()) + 2  # so that spans of two rows never touch
    a = row * wide + first
    order = np.argsort(a, kind="stable")
    a, b = a[order], (row * wide + first + n)[order]
    top = np.maximum.accumulate(b)
    new = np.ones(len(a), dtype=bool)
    new[1:] = a[1:] > top[:-1]
    at = np.flatnonzero(new)
    last = top[np.append(at[1:], len(a)) - 1]
    return a[at] % wide, last % wide, np.searchsorted(row[order][at], np.arange(rows + 1))


REPORT = "doc_id long, n_repeated_words long, n_removed_words long, spans array<struct<first:long,last:long>>, removed_spans array<struct<first:long,last:long>>, class_ids array<string>, keepers array<long>"


def _runs(row: np.ndarray, first: np.ndarray, n: np.ndarray, rows: int) -> np.ndarray:
    """Which spans lie in a union of spans of RUN words or more."""
    x, y, at = merged(row, first, n, rows)
    wide = int((first + n).max()) + 2 if len(row) else 1
    whose = np.repeat(np.arange(rows), np.diff(at))
    here = np.searchsorted(whose * wide + x, row * wide + first, "right") - 1
    return (y - x)[here] >= RUN if len(row) else np.zeros(0, dtype=bool)


def repeated_passages(spark: SparkSession, docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """One row for each document that shares a passage with another one: a run of RUN = 50 words or more, or a similar paragraph.

    spans are the shared stretches of words and removed_spans those of them that have a kept copy in a document
    of smaller id (first and last word, from 0, last excluded); class_ids name the clusters and keepers the
    documents that keep them. Words are runs of word characters, lower-cased.

    Sure to be found, and whole: equal runs of 50 words or more anywhere. With a probability of 0.999: paragraphs (lines of 40 words or more;
    runs of shorter lines, up to a blank line, of as many words together) whose sets of five-word shingles have a Jaccard similarity of
    0.8 or more. Runs that overlap, each with its own other document, make up one stretch, and the stretch of 50 words is what counts;
    each of its words stands in a run of 25 words or more that another document has. Repeats within one document alone don't count.

    Null and empty texts share nothing; rows with a null doc_id take no part; rows that repeat a doc_id
    count as one document. Only doc_id and text are read. An empty table gives an empty result.
    """
    scratch = Scratch(spark, "passages")
    with hashed_joins(spark):
        spans = repeated_spans(spark, docs, scratch, similarity)
    per = spans.groupBy("doc_id").agg(F.collect_list(F.struct("first", "n", "paragraph", "class", "keeper")).alias("spans"))
    names = [x.split()[0] for x in ("doc_id", "n_repeated_words", "n_removed_words", "spans", "removed_spans", "class_ids", "keepers")]

    def run(batches):
        for b in batches:
            ids, spans = b.column(0).to_numpy(), b.column(1)
            first, n, para, cls, keeper = (x.to_numpy(zero_copy_only=False) for x in spans.flatten().flatten())
            row = np.repeat(np.arange(len(b)), spans.value_lengths().to_numpy())
            gone = keeper < ids[row]
            whole = para.copy()
            whole[~para] = _runs(row[~para], first[~para], n[~para], len(b))
            cut = whole & gone
            run = np.flatnonzero(cut & ~para)
            cut[run] = _runs(row[run], first[run], n[run], len(b))
            words, lists = [], []
            for keep in (whole, cut):
                x, y, at = merged(row[keep], first[keep], n[keep], len(b))
                words.append(pa.array(np.diff(np.concatenate([[0], np.cumsum(y - x)])[at]), pa.int64()))
                lists.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["first", "last"])))
            off = np.searchsorted(row, np.arange(len(b) + 1))
            class_ids, keepers = [], []
            for i in range(len(b)):
                at = np.flatnonzero(whole[off[i] : off[i + 1]]) + off[i]
                class_ids.append([f"p{x}" for x in np.unique(cls[at[para[at]]]).tolist()] + [f"b{x:016X}" for x in np.unique(cls[at[~para[at]]].view(np.uint64)).tolist()])
                keepers.append(np.unique(keeper[at]).tolist())
            out = pa.RecordBatch.from_arrays([b.column(0), *words, *lists, pa.array(class_ids, pa.list_(pa.string())), pa.array(keepers, pa.list_(pa.int64()))], names=names)
            yield out.filter(pa.array(np.bincount(row[whole], minlength=len(b)) > 0))

    return per.mapInArrow(run, REPORT)


def cut_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words of these spans and what stands between them."""
    if not text or not spans:
        return text
    at = [m.span() for m in WORD.finditer(folded(text))]
    out, last = [], 0
    for a, b in spans:
        if a >= len(at):
            break
        out.append(text[last : at[a][0]])
        last = at[min(b, len(at)) - 1][1]
    return "".join([*out, text[last:]])


def drop_repeated(spark: SparkSession, docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """`docs` with the removed spans cut out of text; nulls and repeats as in repeated_passages. Spans that a shorter text of the same doc_id doesn't have are left out."""
    doc, spans = unused("tb_doc", docs), unused("tb_spans", docs)
    report = repeated_passages(spark, docs, similarity).where("n_removed_words > 0").select(F.col("doc_id").alias(doc), F.col("removed_spans").alias(spans))
    joined = docs.join(report, docs["doc_id"] == F.col(doc), "left").drop(doc)
    names = docs.columns

    def run(batches):
        for b in batches:
            cut = b.column(len(names)).to_pylist()
            texts = [cut_spans(t, [(x["first"], x["last"]) for x in s or []]) for t, s in zip(b.column(names.index("text")).to_pylist(), cut, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else b.column(j) for j, n in enumerate(names)], names=names)

    return joined.mapInArrow(run, docs.schema)
