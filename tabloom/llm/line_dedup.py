"""Line dedup: sharded cuckoo filters over exact reference counts, reversible by document.

State (`LineIndex`), all of it written tables:
  postings   (key, doc_id): each long line of each document, once; a segment for each insertion
  refcounts  (key, n_docs, keeper): exact counts, the largest doc_id holding the line; later versions of a key override
             earlier ones
  filters    (shard, filter): one cuckoo filter per shard of the keys in `min_docs` documents or more; as versions, too

`insert` and `delete` write new versions of what they touch and nothing else: a segment of postings or the deleted ids, the
counts of the keys of these documents, the filters of the shards whose keys cross the threshold. Counts are exact, so a
deleted document leaves no trace. What they read: an insertion the doc ids of the postings (for documents that it replaces),
a deletion the postings. `compact` makes one segment and one version of all; it runs by itself after VERSIONS changes.

`apply` probes the filters (2 bytes a key) to find the few lines that may go, then asks the exact table. Filters within the
broadcast bound are sent to every task; beyond it the keys go to their shard's filter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Scratch, lookup, parts, small, unused, with_fields

#: Stripped at both ends of a line before it is compared.
BLANKS = " \t\n\x0b\x0c\r"
SLOTS = 4


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four; supports insert, delete and bulk lookup.

    A key is 16 hash bytes. Whatever finds no slot after 500 moves is kept in a stash, so a
    lookup never misses an inserted key.
    """

    def __init__(self, buckets: int = 1 << 14):
        self.table = np.zeros((buckets, SLOTS), dtype=np.uint16)
        self.stash: list[tuple[int, int]] = []

    @staticmethod
    def _alt(bucket, fp, mask):
        return (bucket ^ (fp * 0x5BD1E995)) & mask

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints and both buckets of keys given as rows of two uint64."""
        mask = np.uint64(len(self.table) - 1)
        fp = (keys[:, 0] >> np.uint64(48)) | np.uint64(1)
        one = keys[:, 1] & mask
        return fp, one, self._alt(one, fp, mask)

    def insert(self, keys: np.ndarray) -> None:
        mask = len(self.table) - 1
        for fp, a, b in zip(*(x.tolist() for x in self._places(keys)), strict=True):
            for bucket in (a, b):
                free = np.flatnonzero(self.table[bucket] == 0)
                if len(free):
                    self.table[bucket, free[0]] = fp
                    break
            else:
                bucket = a
                for step in range(500):
                    slot = step % SLOTS
                    fp, self.table[bucket, slot] = int(self.table[bucket, slot]), fp
                    bucket = self._alt(bucket, fp, mask)
                    free = np.flatnonzero(self.table[bucket] == 0)
                    if len(free):
                        self.table[bucket, free[0]] = fp
                        break
                else:
                    self.stash.append((bucket, fp))

    def delete(self, keys: np.ndarray) -> None:
        """Removes keys that were inserted before."""
        mask = len(self.table) - 1
        for fp, a, b in zip(*(x.tolist() for x in self._places(keys)), strict=True):
            for bucket in (a, b):
                there = np.flatnonzero(self.table[bucket] == fp)
                if len(there):
                    self.table[bucket, there[0]] = 0
                    break
            else:
                for x in ((a, fp), (b, fp), (self._alt(a, fp, mask), fp)):
                    if x in self.stash:
                        self.stash.remove(x)
                        break

    def contains(self, keys: np.ndarray) -> np.ndarray:
        fp, a, b = self._places(keys)
        fp16 = fp.astype(np.uint16)[:, None]
        out = (self.table[a.astype(np.int64)] == fp16).any(axis=1) | (self.table[b.astype(np.int64)] == fp16).any(axis=1)
        if self.stash:
            held = set(self.stash)
            out |= np.array([(x, f) in held or (y, f) in held for f, x, y in zip(fp.tolist(), a.tolist(), b.tolist(), strict=True)], dtype=bool)
        return out

    def to_bytes(self) -> bytes:
        stash = np.array(self.stash, dtype=np.int64).reshape(-1, 2)
        return np.int64(len(stash)).tobytes() + stash.tobytes() + self.table.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        n = int(np.frombuffer(raw, dtype=np.int64, count=1)[0])
        out = cls.__new__(cls)
        out.stash = [tuple(x) for x in np.frombuffer(raw, dtype=np.int64, count=2 * n, offset=8).reshape(-1, 2).tolist()]
        out.table = np.frombuffer(raw, dtype=np.uint16, offset=8 + 16 * n).reshape(-1, SLOTS).copy()
        return out


#: Keys that a shard's filter is planned for; its table has room for 65,536.
SHARD_KEYS = 50_000
FILTER_BYTES = (1 << 14) * SLOTS * 2


def _words(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), dtype=np.uint64).reshape(-1, 2)


def line_key(line: str, min_chars: int) -> bytes | None:
    """16 hash bytes of a line without outer blanks and with A-Z lower-cased; None if it is short."""
    line = line.strip(BLANKS)
    return hashlib.md5(line.encode().lower()).digest() if len(line) >= min_chars else None


def _shard_of(n_shards: int):
    """Shard by the first four bytes of the key, as _probed computes it too."""
    return F.pmod(F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long"), F.lit(n_shards)).cast("int")


#: Changes after which an index is compacted.
VERSIONS = 8


def _latest(versions: list[DataFrame], key: str, rest: list[str]) -> DataFrame:
    """The last version of each key."""
    if len(versions) == 1:
        return versions[0]
    out = None
    for i, df in enumerate(versions):
        df = df.select(key, F.struct(F.lit(i).alias("v"), *rest).alias("x"))
        out = df if out is None else out.unionByName(df)
    return out.groupBy(key).agg(F.max_by("x", "x.v").alias("x")).select(key, *[F.col(f"x.{c}").alias(c) for c in rest])


class LineIndex:
    def __init__(self, spark: SparkSession, scratch: Scratch, min_chars: int, min_docs: int, segments: list[tuple[DataFrame, list[DataFrame]]], counts: list[DataFrame], filter_versions: list[DataFrame], n_shards: int, n_hot: int):
        """`segments` are postings, each with the tables of doc ids that were deleted from it."""
        self.spark, self.scratch, self.min_chars, self.min_docs = spark, scratch, min_chars, min_docs
        self.segments, self.counts, self.filter_versions, self.n_shards, self.n_hot = segments, counts, filter_versions, n_shards, n_hot

    @property
    def postings(self) -> DataFrame:
        out = None
        for df, gone in self.segments:
            for ids in gone:
                df = df.join(ids, "doc_id", "left_anti").select("key", "doc_id")
            out = df if out is None else out.unionByName(df)
        return out

    @property
    def refcounts(self) -> DataFrame:
        return _latest(self.counts, "key", ["n_docs", "keeper"]).where("n_docs > 0")

    @property
    def filters(self) -> DataFrame:
        return _latest(self.filter_versions, "shard", ["filter"])

    # -- building and changing ---------------------------------------------------------------

    @classmethod
    def build(cls, spark: SparkSession, docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> LineIndex:
        scratch = Scratch(spark, "lines")
        postings = scratch.put(_postings(docs, min_chars), "postings")
        return cls._over(spark, scratch, min_chars, min_docs, postings, scratch.put(_counted(postings), "refcounts"))

    @classmethod
    def _over(cls, spark, scratch, min_chars, min_docs, postings, counts) -> LineIndex:
        hot = counts.where(F.col("n_docs") >= min_docs)
        n_hot = hot.count()
        n_shards = max(1, -(-n_hot // SHARD_KEYS))
        none = spark.createDataFrame([], "shard int, filter binary")
        filters = scratch.put(_changed(none, hot.select("key", F.lit(1).alias("sign")), n_shards), "filters")
        return cls(spark, scratch, min_chars, min_docs, [(postings, [])], [counts], [filters], n_shards, n_hot)

    def compact(self) -> LineIndex:
        """The same index in one segment and one version, with filters planned for the keys that it has now."""
        put = self.scratch.put
        return self._over(self.spark, self.scratch, self.min_chars, self.min_docs, put(self.postings, "postings"), put(self.refcounts, "refcounts"))

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with `docs` too. A doc_id that is there already is replaced."""
        new = self.scratch.put(_postings(docs, self.min_chars), "postings")
        ids = self.scratch.put(docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct(), "ids")
        if not self.postings.select("doc_id").join(small(ids, ids.count(), 16), "doc_id", "left_semi").isEmpty():
            return self.delete(ids)._added(new)
        return self._added(new)

    def _added(self, new: DataFrame) -> LineIndex:
        more = _counted(new).select("key", F.col("n_docs").alias("more"), F.col("keeper").alias("last"))
        old = F.coalesce("n_docs", F.lit(0))
        change = more.join(self.refcounts, "key", "left").select("key", old.alias("before"), (old + F.col("more")).alias("n_docs"), F.greatest("keeper", "last").alias("keeper"))
        return self._changed_by(change, [*self.segments, (new, [])])

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """The index as if the documents with these ids had never been inserted."""
        ids = self.scratch.put(doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct(), "ids")
        gone = self.scratch.put(self.postings.join(small(ids, ids.count(), 16), "doc_id", "left_semi").select("key", "doc_id"), "gone")
        segments = [(df, [*before, ids]) for df, before in self.segments]
        after = LineIndex(self.spark, self.scratch, self.min_chars, self.min_docs, segments, self.counts, self.filter_versions, self.n_shards, self.n_hot)
        less = _counted(gone).select("key", F.col("n_docs").alias("less"), F.col("keeper").alias("last"))
        left = self.scratch.put(self.refcounts.join(less, "key"), "left")
        # only the keys that lose their keeper need another one
        orphans = left.where("keeper = last and n_docs > less").select("key", F.lit(1).alias("n"))
        orphans = self.scratch.put(orphans, "orphans")
        heirs = after.postings.join(small(orphans, orphans.count(), 48).drop("n"), "key", "left_semi").groupBy("key").agg(F.max("doc_id").alias("heir"))
        change = left.join(heirs, "key", "left").select("key", F.col("n_docs").alias("before"), (F.col("n_docs") - F.col("less")).alias("n_docs"), F.coalesce("heir", "keeper").alias("keeper"))
        return after._changed_by(change, segments)

    def _changed_by(self, change: DataFrame, segments: list) -> LineIndex:
        """The index after `change` (key, before, n_docs, keeper) of its counts."""
        change = self.scratch.put(change, "refcounts")
        was, now = F.col("before") >= self.min_docs, F.col("n_docs") >= self.min_docs
        moved = change.select("key", (now.cast("int") - was.cast("int")).alias("sign")).where("sign <> 0")
        n_hot = self.n_hot + (moved.agg(F.sum("sign")).first()[0] or 0)
        filters = self.scratch.put(_changed(self.filters, moved, self.n_shards), "filters")
        out = LineIndex(self.spark, self.scratch, self.min_chars, self.min_docs, segments, [*self.counts, change.drop("before")], [*self.filter_versions, filters], self.n_shards, n_hot)
        # filters have room for a third more keys than planned
        return out.compact() if len(out.counts) > VERSIONS or n_hot > 1.2 * SHARD_KEYS * self.n_shards else out

    # -- use ---------------------------------------------------------------------------------

    def drops(self, docs: DataFrame) -> DataFrame:
        """(doc_id, drop): the keys of the lines that each document loses."""
        if self.n_shards * FILTER_BYTES <= BROADCAST_BYTES:
            held = {r["shard"]: CuckooFilter.from_bytes(bytes(r["filter"])) for r in self.filters.collect()}
            maybe = _probed(docs, self.min_chars, self.spark.sparkContext.broadcast(held), self.n_shards)
        else:
            maybe = _probed_by_shard(_postings(docs, self.min_chars), self.filters, self.n_shards, parts(self.spark))
        hot = self.refcounts.where(F.col("n_docs") >= self.min_docs).select("key", "keeper", F.col("n_docs").alias("n"))
        lost = lookup(maybe, hot, "key", hot.agg(F.sum("n")).first()[0] or 0).where(F.col("doc_id") != F.col("keeper"))
        return lost.groupBy("doc_id").agg(F.collect_set("key").alias("drop"))

    def apply(self, docs: DataFrame) -> DataFrame:
        """`docs` without the lines to drop; adds n_lines, n_dropped, kept_sha256."""
        plain = docs.drop("n_lines", "n_dropped", "kept_sha256")
        doc, drop = unused("tb_doc", plain), unused("tb_drop", plain)
        drops = self.scratch.put(self.drops(docs).select(F.col("doc_id").alias(doc), F.col("drop").alias(drop)), "drops")
        size = drops.agg(F.count("*").alias("n"), F.sum(F.size(drop)).alias("k")).first()
        drops = small(drops, 1, size["n"] * 64 + (size["k"] or 0) * 32)
        return _rewritten(plain.join(drops, plain["doc_id"] == F.col(doc), "left").drop(doc), self.min_chars, plain, drop)


OUT = pa.schema([("key", pa.binary()), ("doc_id", pa.int64())])


def _row_keys(text: str | None, min_chars: int) -> list[bytes]:
    return list({k for x in (text or "").split("\n") if (k := line_key(x, min_chars))})


def _postings(docs: DataFrame, min_chars: int) -> DataFrame:
    def run(batches):
        for b in batches:
            keys, ids = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ks = _row_keys(t, min_chars)
                keys += ks
                ids += [i] * len(ks)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], schema=OUT)

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "key binary, doc_id long")


def _probed(docs: DataFrame, min_chars: int, held, n_shards: int) -> DataFrame:
    """As _postings, but only the keys that their shard's filter may hold."""

    def run(batches):
        filters = held.value
        for b in batches:
            keys, ids = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ks = _row_keys(t, min_chars)
                keys += ks
                ids += [i] * len(ks)
            keep = np.zeros(len(keys), dtype=bool)
            if keys:
                w = _words(keys)
                shards = w[:, 0].astype(np.uint32).byteswap() % np.uint32(n_shards)
                for s in np.unique(shards).tolist():
                    if s in filters:
                        at = np.flatnonzero(shards == s)
                        keep[at] = filters[s].contains(w[at])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], schema=OUT).filter(pa.array(keep))

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "key binary, doc_id long")


def _probed_by_shard(postings: DataFrame, filters: DataFrame, n_shards: int, salts: int) -> DataFrame:
    """As _probed, for more filters than a task can hold: a shard's keys are dealt to `salts` tasks, each of which gets its filter first."""
    keys = postings.select(_shard_of(n_shards).alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), "key", "doc_id")
    heads = filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), F.col("filter").alias("key"), F.lit(None).cast("long").alias("doc_id"))
    rows = keys.unionByName(heads).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")

    def run(batches):
        at, f = None, None
        for b in batches:
            where = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            kind, key = b.column(2).to_numpy(), b.column(3)
            edges = [0, *(i for i in range(1, len(where)) if where[i] != where[i - 1] or kind[i] != kind[i - 1]), len(where)]
            keep = np.zeros(len(where), dtype=bool)
            for lo, hi in zip(edges, edges[1:]):
                if lo < hi and kind[lo] == 0:
                    at, f = where[lo], CuckooFilter.from_bytes(key[hi - 1].as_py())
                elif lo < hi and where[lo] == at:
                    keep[lo:hi] = f.contains(_words(key.slice(lo, hi - lo).to_pylist()))
            yield pa.RecordBatch.from_arrays([key, b.column(4)], schema=OUT).filter(pa.array(keep))

    return rows.mapInArrow(run, "key binary, doc_id long")


def _counted(postings: DataFrame) -> DataFrame:
    """Exact counts; a key's documents are first counted over (key, doc_id), so a hot key is spread."""
    return postings.groupBy("key").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper"))


def _changed(filters: DataFrame, moved: DataFrame, n_shards: int) -> DataFrame:
    """The filters that inserting the keys of sign 1 and deleting those of sign -1 changes, as they are then."""

    def run(key, have, change):
        f = CuckooFilter.from_bytes(bytes(have["filter"].iloc[0])) if len(have) else CuckooFilter()
        for sign, act in ((-1, f.delete), (1, f.insert)):
            if len(ks := [bytes(k) for k in change["key"][change["sign"] == sign]]):
                act(_words(ks))
        return pd.DataFrame({"shard": [key[0]], "filter": [f.to_bytes()]})

    change = moved.withColumn("shard", _shard_of(n_shards))
    filters = filters.join(change.select("shard").distinct(), "shard", "left_semi")
    return filters.groupBy("shard").cogroup(change.groupBy("shard")).applyInPandas(run, "shard int, filter binary")


def _rewritten(docs: DataFrame, min_chars: int, plain: DataFrame, drop: str) -> DataFrame:
    names = plain.columns
    schema = with_fields(plain.schema, "n_lines long, n_dropped long, kept_sha256 string")

    def run(batches):
        for b in batches:
            texts, sizes, gone, shas = [], [], [], []
            raw = b.column(b.schema.get_field_index("text")).to_pylist()
            drops = b.column(b.schema.get_field_index(drop)).to_pylist()
            for t, d in zip(raw, drops, strict=True):
                lines = (t or "").split("\n")
                kept = lines
                if d:
                    d = set(d)
                    kept = [x for x in lines if line_key(x, min_chars) not in d]
                sizes.append(len(lines))
                gone.append(len(lines) - len(kept))
                out = t or "" if kept is lines else "\n".join(kept)
                texts.append(out)
                shas.append(hashlib.sha256(out.encode()).hexdigest())
            cols = [pa.array(texts, pa.string()) if n == "text" else b.column(b.schema.get_field_index(n)) for n in names]
            cols += [pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(shas, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "n_lines", "n_dropped", "kept_sha256"])

    return docs.mapInArrow(run, schema)


def line_dedup(spark: SparkSession, docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Drops lines shared by `min_docs` documents or more from all but the largest doc_id with them.

    Lines end at \\n. Two lines are the same if they agree after stripping blanks (U+0020, U+0009 to
    U+000D) at both ends and lower-casing A-Z; only lines of `min_chars` code points or more, so
    stripped, count. Every copy within the keeper stays.

    Null or empty text is one empty line (and comes back as ""). Rows with a null doc_id take no
    part and lose nothing. Rows that repeat a doc_id count as one document, and each of them is
    rewritten. All columns of `docs` stay; columns named n_lines, n_dropped or kept_sha256 are replaced.
    """
    return LineIndex.build(spark, docs, min_chars, min_docs).apply(docs)
