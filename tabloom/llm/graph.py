"""Links between texts: checking candidate pairs and joining links into classes, both distributed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, chunks, lookup, parts, small

#: Members that one task compares with one leader's text before another copy of it is sent.
SALT_ROWS = 500
EDGES = "a long, b long"


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label): the smallest node of each connected component, for every node with a link.

    Alternates large-star and small-star steps over written tables until the links stand still.
    A step's work is linear in the links, whatever the size of a component or degree of a node, and no node's links meet in one task.
    """

    def star(e: DataFrame, large: bool, n: int) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not large:
            both = both.where("b < a")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        out = lookup(both, least, "a", n).where("b > a" if large else "true").select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.unionByName(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b")

    def sign(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = scratch.put(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    before = None
    while (mark := sign(now)) != before:
        before = mark
        if not mark[0]:
            break
        after = scratch.put(star(star(now, True, 2 * mark[0]), False, 2 * mark[0]).distinct(), "links")
        scratch.drop(now)
        now = after
    out = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return out.unionByName(out.select(F.col("label").alias("node"), "label").distinct())


def joined(labels: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """`labels`, a written (node, label), after the links of the written table `edges` came to it; only the components that they join are worked on again."""
    if edges.isEmpty():
        return labels
    a, b = (labels.select(F.col("node").alias(x), F.col("label").alias(f"{x}_label")) for x in "ab")
    named = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    top = scratch.put(components(named, scratch), "joined")
    to = labels.groupBy("label").agg(F.count("*").alias("n")).join(top.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left")
    to = scratch.put(to.select("label", F.coalesce("to", "label").alias("to"), "n"), "renamed")
    old = lookup(labels, to, "label", to.agg(F.sum("n")).first()[0] or 0).select("node", F.col("to").alias("label"))
    return scratch.put(old.unionByName(top.join(labels, "node", "left_anti").select("node", "label")), "labels")


def checked(pairs: DataFrame, texts: DataFrame, check: Callable[[object, object], bool], prepare: Callable[[list[str]], list], spark: SparkSession) -> DataFrame:
    """The pairs (a, b) whose texts pass `check`; `texts` is (node, text).

    Each b's text moves once; each a's text moves once per SALT_ROWS members. Within a task the rows
    are sorted so that a's text comes first, hence one prepared leader is held at a time.
    """
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(1 << 30)).cast("int"))
    many = pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > SALT_ROWS)  # no more than pairs / SALT_ROWS
    salted = salted.join(small(many, pairs.count() // SALT_ROWS, 32), "a", "left").withColumn("salt", F.pmod("salt", F.greatest(F.lit(1), F.ceil(F.col("n") / SALT_ROWS)).cast("int"))).drop("n")
    member = salted.join(texts, salted["b"] == texts["node"]).select("a", "salt", F.lit(1).alias("kind"), "b", "text")
    head = salted.select("a", "salt").distinct()
    leader = head.join(texts, head["a"] == texts["node"]).select("a", "salt", F.lit(0).alias("kind"), F.col("a").alias("b"), "text")
    rows = member.unionByName(leader).repartition(parts(spark), "a", "salt").sortWithinPartitions("a", "salt", "kind", "b")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = (None, None)
        for batch in batches:
            texts = batch.column(4).to_pylist()
            for lo, hi in chunks(texts):
                part = batch.slice(lo, hi - lo)
                a, kind, b = part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist()
                ready = prepare(texts[lo:hi])
                keep: list[tuple[int, int]] = []
                for x, k, y, t in zip(a, kind, b, ready, strict=True):
                    if k == 0:
                        head = (x, t)
                    elif head[0] == x and check(head[1], t):
                        keep.append((x, y))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in keep], pa.int64()), pa.array([y for _, y in keep], pa.int64())], schema=schema)

    return rows.mapInArrow(run, EDGES)


def classes(spark: SparkSession, scratch: Scratch, bands: DataFrame, texts: Callable[[DataFrame], DataFrame], check, prepare, similarity: float) -> DataFrame:
    """(node, label) of the components of all pairs that share a band and pass `check`.

    `bands` is a written table (node, size, band); `texts` gives (node, text) for a DataFrame of nodes;
    `prepare` turns texts into arrays of `size` distinct shingles, and `check` tells of two of them whether
    they are linked, which must imply a Jaccard similarity of `similarity` or more.

    No step emits all pairs of a band. First every node of a band is checked against the band's least
    node, then against another one if the band still spans several components. Only pairs of a band
    that lie in different components after that, and have enough shingles in common with others to pass,
    are checked one by one, so no link that joins two classes is lost and pairs within a class are never expanded.
    """
    close = f"least(a_size, b_size) >= {similarity} * greatest(a_size, b_size) - 1e-6"
    # numbers alone, no struct: these are aggregated by hash, without a sort
    shared = bands.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("a"), F.min_by("size", "node").alias("a_size")).where("n > 1")
    shared = scratch.put(shared, "shared")
    n = shared.agg(F.sum("n")).first()[0] or 0
    members = scratch.put(lookup(bands, shared, "band", n, split=True).select("band", "node", "size", "a", "a_size"), "members")
    stored = scratch.put(texts(members.select("node").distinct()), "texts")

    def edges(pairs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        todo = scratch.put(pairs.where(close).select("a", "b").distinct(), f"{name}-pairs")
        return todo, scratch.put(checked(todo, stored, check, prepare, spark), f"{name}-links")

    done, links = edges(members.where("node <> a").select("a", F.col("node").alias("b"), "a_size", F.col("size").alias("b_size")), "first")

    def open_members(labels: DataFrame) -> tuple[DataFrame, int]:
        """Members of the bands that span several components, with their component and common shingles; how many there are."""
        own = scratch.put(members.select("band", "node", "size").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "own")
        wide = own.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
        wide = scratch.put(wide.select("band", "n"), "wide")
        out = _with_common(scratch.put(lookup(own, wide, "band", wide.agg(F.sum("n")).first()[0] or 0, split=True), "open"), stored, prepare, scratch, similarity)
        return out, out.count()

    def named(x: str, of: str = "") -> list:
        return [F.col(f"{of}{c}").alias(f"{x}_{c}" if c != "node" else x) for c in ("node", "size", "label", "common")]

    # an upper bound of the intersection, part by part of the hash range, must reach what the similarity needs
    both = F.aggregate(F.zip_with("a_common", "b_common", lambda x, y: F.least(x, y)), F.lit(0), lambda t, x: t + x)
    enough = (F.col("a_label") != F.col("b_label")) & (both * F.lit(1 + similarity) >= F.lit(similarity) * (F.col("a_size") + F.col("b_size")) - 1e-6)

    labels = scratch.put(components(links, scratch), "labels")
    still, n = open_members(labels)
    if n:
        own = F.struct((F.col("size") - _total("common")) / F.col("size"), F.xxhash64("node", "band"))
        pick = scratch.put(still.groupBy("band").agg(F.min_by(F.struct("node", "size", "label", "common"), own).alias("p"), F.count("*").alias("n")), "picked")
        star = lookup(still, pick, "band", n, 16 * PARTS).select(*named("a", "p."), *named("b")).where(enough)
        star = star.withColumn("lo", F.least("a", "b")).withColumn("b", F.greatest("a", "b")).select(F.col("lo").alias("a"), "b", "a_size", "b_size")
        tried, more = edges(star.join(done, ["a", "b"], "left_anti"), "second")
        done, labels = done.unionByName(tried), joined(labels, more, scratch)
        still, n = open_members(labels)
    if n:
        # a band of many open members is cut into tiles of TILE by TILE of them
        sizes = scratch.put(still.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int")), "sizes")
        dealt = lookup(still, sizes, "band", n).withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        left = dealt.select("band", F.col("own").alias("x"), F.col("other").alias("y"), *named("a"))
        right = dealt.select("band", F.col("other").alias("x"), F.col("own").alias("y"), *named("b"))
        rest = left.join(right, ["band", "x", "y"]).where("a < b").where(enough)
        _, more = edges(rest.join(done, ["a", "b"], "left_anti"), "rest")
        labels = joined(labels, more, scratch)
    return labels


#: Open members of a band on either side of one tile of pairs.
TILE = 1_000
#: Parts of the hash range for which a node's common shingles are counted apart.
PARTS = 128


def _total(counts: str):
    return F.aggregate(counts, F.lit(0), lambda t, x: t + x)


def _with_common(still: DataFrame, stored: DataFrame, prepare, scratch: Scratch, similarity: float) -> DataFrame:
    """`still` with `common`: in each part of the hash range, the number of a node's shingles that another node of `still` has too.

    An intersection is no larger than the sum over the parts of the lesser count, so nodes and pairs for
    which that is too small can't reach `similarity`; leaving those out is exact. It keeps a cloud of
    copies, each with edits of its own, from being compared with one another.
    """
    spark = still.sparkSession
    # hashes go by ranges of their own to the tasks that count them, and counts by node from there, both packed: a row for each batch and range
    fine = max(0, (parts(spark) - 1).bit_length() - PARTS.bit_length() + 1)
    ranges, ends = PARTS << fine, parts(spark)

    def packed(to: np.ndarray, n: int, key: str, *columns: np.ndarray) -> pa.RecordBatch:
        """Rows (key, a binary of each column) of the values that go to each of the n receivers."""
        by = np.argsort(to, kind="stable")
        at = np.searchsorted(to[by], np.arange(n + 1))
        there = np.flatnonzero(np.diff(at))
        out = [[c[at[i] : at[i + 1]].tobytes() for i in there.tolist()] for c in (c[by] for c in columns)]
        return pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), *[pa.array(o, pa.binary()) for o in out]], names=[key, "x", "y"])

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, bytes]]:
        """Key and values of each receiver, from rows sorted by key."""
        key, xs, ys = None, [], []
        for batch in batches:
            for k, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    if xs:
                        yield key, b"".join(xs), b"".join(ys)
                    key, xs, ys = k, [], []
                xs.append(x)
                ys.append(y)
        if xs:
            yield key, b"".join(xs), b"".join(ys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in chunks(texts):
                sets = prepare(texts[lo:hi])
                nodes = np.repeat(batch.column(0).to_numpy()[lo:hi], [len(x) for x in sets])
                s = np.concatenate(sets)
                yield packed((s >> np.uint64(64 - ranges.bit_length() + 1)).astype(np.int32), ranges, "range", s, nodes)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, s, nodes in grouped(batches):
            s, nodes = np.frombuffer(s, np.uint64), np.frombuffer(nodes, np.int64)
            by = np.argsort(s)
            new = np.ones(len(s) + 1, dtype=bool)
            np.not_equal(s[by][1:], s[by][:-1], out=new[1:-1])
            node, n = np.unique(nodes[by][~(new[1:] & new[:-1])], return_counts=True)
            yield packed(node % ends, ends, "end", node, n * PARTS + (key >> fine))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, node, n in grouped(batches):
            node, n = np.frombuffer(node, np.int64), np.frombuffer(n, np.int64)
            nodes, row = np.unique(node, return_inverse=True)
            for lo in range(0, len(nodes), 1000):
                here = (row >= lo) & (row < lo + 1000)
                out = np.zeros((min(1000, len(nodes) - lo), PARTS), dtype=np.int32)
                np.add.at(out, (row[here] - lo, n[here] % PARTS), (n[here] // PARTS).astype(np.int32))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * PARTS, pa.int32()), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(nodes[lo : lo + 1000]), flat], names=["node", "common"])

    open_texts = stored.join(still.select("node").distinct(), "node").select("node", "text")
    each = open_texts.mapInArrow(run, "range int, x binary, y binary").repartition(parts(spark), "range").sortWithinPartitions("range")
    both = each.mapInArrow(shared, "end int, x binary, y binary").repartition(parts(spark), "end").sortWithinPartitions("end")
    common = both.mapInArrow(counted, "node long, common array<int>")
    return scratch.put(still.join(common, "node").where(_total("common") >= similarity * F.col("size") - 1e-6), "common")


def in_band(n: int, m: int, similarity: float) -> tuple[int, int]:
    """Least matches and largest shift of an alignment of n with m items at Jaccard `similarity`."""
    need = int(np.ceil(similarity * (n + m) / (1 + similarity) - 1e-9))
    return need, n + m - 2 * need
