"""Approximate nearest neighbours by inner product: a robust-pruned directed graph whose nodes are leaders with their rows.

Leaders are fitted on a bounded sample; every row hangs on its nearest leader. A query walks the graph of leaders once, by a
beam, and the rows of the leaders that it reaches are scored exactly. How many leaders it has to reach is measured: the true
neighbours of some queries, by brute force over every row, tell for which number the recall is as asked.

Rows are dealt to shards by a hash of their id, so that copies and the rows of one leader spread.
Inner product becomes distance by one more coordinate, sqrt(M^2 - |x|^2), which is 0 for queries; M is the sample's largest norm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches

#: Rows of one shard, which a task holds some three times (64 MB each at 64 dimensions), and shards at the least.
SHARD_ROWS, LEAST_SHARDS = 250_000, 6
DEGREE, SLACK, ALPHA, BUILD_BEAM = 28, 42, 1.2, 56
#: Rows that leaders are fitted on, rounds of the fit, leaders at the most (the square root of the rows, if that is less).
SAMPLE_ROWS, ROUNDS, LEADERS = 32_768, 5, 1_024
#: Queries whose true neighbours are found by brute force, and the share of them that the walk must reach.
TRIED, RECALL = 256, 0.98
#: Rows of a shard that every query is compared with first, which bounds what the others must reach.
FIRST_ROWS = 4_096


class Graph:
    """A robust-pruned directed graph over the rows of `x` (distinct vectors, float32)."""

    def __init__(self, x: np.ndarray, seed: int = 7):
        norms = (x.astype(np.float64) ** 2).sum(1)
        extra = np.sqrt(np.maximum(norms.max() - norms, 0)) if len(x) else norms
        self.x = np.hstack([x, extra[:, None]]).astype(np.float32)
        self.sq = (self.x**2).sum(1)
        n = len(x)
        rng = np.random.default_rng(seed)
        self.nbrs = np.full((n, SLACK), -1, dtype=np.int32)
        k = min(DEGREE // 2, n - 1)
        if k > 0:
            self.nbrs[:, :k] = (np.arange(n)[:, None] + rng.integers(1, n, size=(n, k))) % n
        self.deg = (self.nbrs >= 0).sum(1)
        mean = self.x.mean(0)
        self.start = int(np.argmin(self.sq - 2 * self.x @ mean))
        order = rng.permutation(n)
        for lo in range(0, n if n > 1 else 0, 256):
            self._insert(order[lo : lo + 256])

    def search(self, q: np.ndarray, beam: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Beams (ids, squared distances less |q|^2) of queries in augmented space, nearest first; id -1 where there are fewer.

        Every node's distance is taken once for a query, when the walk first comes to it; a row of the tables below is as long as there are nodes.
        """
        n, b, beam = len(self.x), len(q), min(beam, len(self.x))
        dist = np.full((b, n), np.inf, dtype=np.float32)  # of the nodes come to
        todo = dist.copy()  # of those of them that are not expanded yet
        slot = np.empty(b * n, dtype=np.int64)
        dist[:, self.start] = todo[:, self.start] = self.sq[self.start] - 2 * q @ self.x[self.start]
        live, width = np.arange(b), min(width, n)
        while len(live):
            at = np.argpartition(todo[live], width - 1, axis=1)[:, :width]
            d = todo[live[:, None], at]
            go = np.isfinite(d) & (d <= np.partition(dist[live], beam - 1, axis=1)[:, beam - 1 :][:, :1])
            row, col = np.nonzero(go)
            who, node = live[row], at[row, col]
            todo[who, node] = np.inf
            live = live[go.any(1)]
            key = (who[:, None] * n + self.nbrs[node])[self.nbrs[node] >= 0]
            key = key[np.isinf(dist.ravel()[key])]
            slot[key] = np.arange(len(key))
            key = key[slot[key] == np.arange(len(key))]  # each once
            who, node = np.divmod(key, n)
            dist[who, node] = todo[who, node] = self.sq[node] - 2 * np.einsum("nd,nd->n", self.x[node], q[who])
        ids = np.argpartition(dist, beam - 1, axis=1)[:, :beam]
        d = np.take_along_axis(dist, ids, 1)
        by = np.argsort(d, axis=1, kind="stable")
        ids, d = np.take_along_axis(ids, by, 1), np.take_along_axis(d, by, 1)
        return np.where(np.isfinite(d), ids, -1), d

    def _prune(self, p: np.ndarray, cand: np.ndarray) -> np.ndarray:
        """At most DEGREE diverse neighbours of each point of `p` from its row of candidates (-1: none)."""
        cand = np.where(cand == p[:, None], -1, cand)
        cand.sort(axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        v = self.x[cand]
        d = self.sq[cand] + self.sq[p][:, None] - 2 * np.einsum("bcd,bd->bc", v, self.x[p])
        d = np.where(cand >= 0, np.maximum(d, 0), np.inf)
        by = np.argsort(d, axis=1, kind="stable")
        cand, d = np.take_along_axis(cand, by, 1), np.take_along_axis(d, by, 1)
        v = np.take_along_axis(v, by[:, :, None], 1)
        s = self.sq[cand]
        pair = np.maximum(s[:, :, None] + s[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1)), 0)
        alive, out, rows = np.isfinite(d), np.full((len(p), SLACK), -1, dtype=np.int32), np.arange(len(p))
        for j in range(DEGREE):
            first = alive.argmax(1)
            ok = alive[rows, first]
            if not ok.any():
                break
            out[ok, j] = cand[rows[ok], first[ok]]
            alive &= ~(ok[:, None] & (ALPHA * ALPHA * pair[rows, first] <= d))
            alive[rows, first] = False
        return out

    def _insert(self, p: np.ndarray) -> None:
        found, _ = self.search(self.x[p], BUILD_BEAM)
        new = self._prune(p, np.concatenate([found, self.nbrs[p].astype(np.int64)], 1))
        self.nbrs[p] = new
        self.deg[p] = (new >= 0).sum(1)
        src = np.repeat(p, SLACK)[(new >= 0).ravel()]
        dst = new.ravel()[(new >= 0).ravel()].astype(np.int64)
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        targets, first, count = np.unique(dst, return_index=True, return_counts=True)
        rank = np.arange(len(dst)) - np.repeat(first, count)
        fits = self.deg[dst] + rank < SLACK
        full = np.unique(dst[~fits])
        easy = ~np.isin(dst, full)
        self.nbrs[dst[easy], self.deg[dst[easy]] + rank[easy]] = src[easy]
        easy_targets = ~np.isin(targets, full)
        self.deg[targets[easy_targets]] += count[easy_targets]
        for lo in range(0, len(full), 256):
            t = full[lo : lo + 256]
            at, n = first[np.searchsorted(targets, t)], count[np.searchsorted(targets, t)]
            cand = np.full((len(t), SLACK + int(n.max())), -1, dtype=np.int64)
            cand[:, :SLACK] = self.nbrs[t]
            for r, (a, k) in enumerate(zip(at, n, strict=True)):
                cand[r, SLACK : SLACK + k] = src[a : a + k]
            kept = self._prune(t, cand)
            self.nbrs[t], self.deg[t] = kept, (kept >= 0).sum(1)


class Leaders:
    """The graph of leaders, and how many of them a query has to reach."""

    def __init__(self, sample: np.ndarray, most: int, seed: int = 7):
        x = np.unique(sample, axis=0).astype(np.float64)
        self.scale = 1 / np.abs(x).max()  # no square overflows
        self.norm = np.sqrt(((x * self.scale) ** 2).sum(1).max())
        x = self._raised(x)
        rng = np.random.default_rng(seed)
        c = x[rng.choice(len(x), min(most, len(x)), replace=False)]
        for _ in range(ROUNDS if len(x) > len(c) else 0):
            own = np.concatenate([(x[lo : lo + 4096] @ c.T).argmax(1) for lo in range(0, len(x), 4096)])
            by = np.argsort(own, kind="stable")
            at = np.flatnonzero(np.diff(own[by], prepend=-1))
            mean = np.add.reduceat(x[by], at)
            length = np.sqrt((mean**2).sum(1))
            c[own[by][at][length > 0]] = mean[length > 0] / length[length > 0, None]
        self.c = np.unique(c, axis=0)  # those without rows stay where they were
        self.graph = Graph(self.c)
        self.reach = len(self.c)

    def _raised(self, x: np.ndarray) -> np.ndarray:
        """Rows on the unit sphere of one more dimension (those beyond the sample's largest norm are cut off at it)."""
        x = x.astype(np.float64) * (self.scale / self.norm)
        n = (x**2).sum(1)
        out = np.hstack([x, np.sqrt(np.maximum(1 - n, 0))[:, None]])
        return (out / np.sqrt(np.maximum(n, 1))[:, None]).astype(np.float32)

    def of(self, x: np.ndarray) -> np.ndarray:
        """The leader of each row."""
        return (self._raised(x) @ self.c.T).argmax(1)

    def walk(self, q: np.ndarray, reach: int) -> np.ndarray:
        """The leaders that each query reaches, nearest first; those that no edge leads to come last."""
        q = q.astype(np.float64) / np.abs(q).max(1, keepdims=True)
        found, _ = self.graph.search(np.hstack([q, np.zeros((len(q), 2))]).astype(np.float32), reach, max(4, reach // 24))
        for i in np.flatnonzero((found < 0).any(1)):
            row = found[i][found[i] >= 0]
            found[i] = np.concatenate([row, np.setdiff1d(np.arange(len(self.c)), row)])[:reach]
        return found

    def tune(self, q: np.ndarray, which: np.ndarray, leader: np.ndarray, recall: float) -> None:
        """Sets `reach` to the least for which the walk reaches that share of the true neighbours; neighbour j of query which[j] hangs on leader[j]."""
        beam = min(32, len(self.c))
        while len(which):
            place = np.full((len(q), len(self.c)), beam)
            found = self.walk(q, beam)
            np.put_along_axis(place, found, np.arange(beam)[None, :], 1)
            got = np.cumsum(np.bincount(place[which, leader], minlength=beam + 1)[:beam]) / len(which)
            if got[-1] >= recall or beam == len(self.c):
                self.reach = min(int(np.searchsorted(got, recall)) + 1, beam)
                return
            beam = min(2 * beam, len(self.c))


class Shard:
    """A shard's distinct vectors by their leader, with the smallest ids that hold each."""

    def __init__(self, leaders: Leaders, ids: np.ndarray, x: np.ndarray, k: int):
        x = np.ascontiguousarray(x + np.float32(0))  # -0 is 0
        _, first, inverse = np.unique(x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
        x = x[first]
        own = np.concatenate([leaders.of(x[lo : lo + 4096]) for lo in range(0, len(x), 4096)])
        by = np.argsort(own, kind="stable")
        self.x, self.own, self.at = x[by], own[by], np.searchsorted(own[by], np.arange(len(leaders.c) + 1))
        place = np.empty(len(by), dtype=np.int64)
        place[by] = np.arange(len(by))
        vector = place[inverse]
        order = np.lexsort((ids, vector))
        vector, ids = vector[order], ids[order]
        new = np.ones(len(ids), dtype=bool)
        new[1:] = (vector[1:] != vector[:-1]) | (ids[1:] != ids[:-1])
        vector, ids = vector[new], ids[new]
        # k answers and the query itself need no more than k + 1 ids of a vector, each counted once
        keep = np.arange(len(ids)) - np.searchsorted(vector, vector) <= k
        self.ids, self.first = ids[keep], np.searchsorted(vector[keep], np.arange(len(x) + 1))
        self.scaled = np.multiply(self.x, 1 / np.float64(np.abs(self.x).max()), out=np.empty_like(self.x), casting="unsafe", dtype=np.float64)
        self.norm = np.sqrt((self.scaled.astype(np.float64) ** 2).sum(1).max())
        # some vectors of different ids: the k + 1 nearest of them bound from below what the k nearest ids must reach
        _, one = np.unique(self.ids[self.first[:-1]], return_index=True)
        self.start = np.random.default_rng(7).permutation(one)[:FIRST_ROWS]
        self.alone = np.zeros(len(self.x), dtype=bool)
        self.alone[one] = True

    def nearest(self, who: np.ndarray, q: np.ndarray, reached: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, id and score of the k best ids of each query among the rows of the leaders `reached` (a row of flags for each); an id with several vectors counts by its better one."""
        f = (q / np.abs(q).max(1, keepdims=True)).astype(np.float32)
        slack = 4e-7 * q.shape[1] * np.sqrt((f.astype(np.float64) ** 2).sum(1)) * self.norm  # of a product of float32
        s = f @ self.scaled[self.start].T
        least = np.full(len(q), -np.inf)
        if len(self.start) > k:
            least = np.partition(s, -(k + 1), axis=1)[:, -(k + 1)] - 2 * slack
        least = np.nextafter(least.astype(np.float32), np.float32(-np.inf))
        i, j = _where(s >= least[:, None])
        there = ~reached[i, self.own[self.start[j]]]  # the others are met again below
        hits = [(i[there], self.start[j[there]], s[i[there], j[there]])]
        for c in np.flatnonzero(np.diff(self.at)):
            ask = np.flatnonzero(reached[:, c])
            if len(ask):
                s = f[ask] @ self.scaled[self.at[c] : self.at[c + 1]].T
                i, j = _where(s >= least[ask, None])
                hits.append((ask[i], self.at[c] + j, s[i, j]))
        i, j, s = (np.concatenate(x) for x in zip(*hits, strict=True))
        # the k + 1 nearest ones of different ids are a better bound
        one = np.flatnonzero(self.alone[j])
        one = one[np.lexsort((-s[one], i[one]))]
        rank = np.arange(len(one)) - np.searchsorted(i[one], i[one])
        one = one[rank == k]
        least[i[one]] = np.maximum(least[i[one]], np.nextafter((s[one] - 2 * slack[i[one]]).astype(np.float32), np.float32(-np.inf)))
        near = s >= least[i]
        i, j = i[near], j[near]
        score = np.concatenate([np.empty(0), *[(self.x[j[lo : lo + 65536]].astype(np.float64) * q[i[lo : lo + 65536]].astype(np.float64)).sum(1) for lo in range(0, len(i), 65536)]])
        n = self.first[j + 1] - self.first[j]
        ids = self.ids[np.repeat(self.first[j] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        i, score = np.repeat(i, n), np.repeat(score, n)
        other = ids != who[i]
        i, ids, score = i[other], ids[other], score[other]
        order = np.lexsort((-score, ids, i))
        i, ids, score = i[order], ids[order], score[order]
        best = np.ones(len(i), dtype=bool)
        best[1:] = (i[1:] != i[:-1]) | (ids[1:] != ids[:-1])
        i, ids, score = i[best], ids[best], score[best]
        order = np.lexsort((ids, -score, i))
        i, ids, score = i[order], ids[order], score[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        return who[i[keep]], ids[keep], score[keep]


def _where(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero of a table with few flags, which is faster in one dimension."""
    return np.divmod(np.flatnonzero(flags), flags.shape[1])


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _picked(vectors: DataFrame, rows: int, of: int, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of `rows` rows at most, by a hash of the id; `vectors` has some `of` rows."""
    draw = F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1 << 40))
    share = int(min(1.0, (rows + 8 * rows**0.5) / max(of, 1)) * (1 << 40))
    got = vectors.where(draw < F.lit(share)).orderBy(draw, "vec_id").limit(rows).select("vec_id", "embedding").toArrow().combine_chunks()
    ids, x = (got.column(j).combine_chunks() if got.num_rows else pa.array([], t) for j, t in enumerate((pa.int64(), pa.list_(pa.float32()))))
    return ids.to_numpy(), _matrix(x, d)


def _tuned(scratch: Scratch, leaders: Leaders, v: DataFrame, who: np.ndarray, q: np.ndarray, k: int, recall: float) -> None:
    """Tunes the leaders on the true neighbours of the queries (who, q) among all of `v`."""
    d = q.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, its = np.full((len(q), k), -np.inf), np.full((len(q), k), -1)
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column(1), d)
            s = q.astype(np.float64) @ x.T.astype(np.float64)
            s[who[:, None] == batch.column(0).to_numpy()[None, :]] = -np.inf
            s = np.concatenate([best, s], 1)
            at = np.argpartition(-s, k - 1, axis=1)[:, :k]
            its = np.take_along_axis(np.concatenate([its, np.broadcast_to(leaders.of(x), (len(q), len(x)))], 1), at, 1)
            best = np.take_along_axis(s, at, 1)
        i, j = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(its[i, j], pa.int32()), pa.array(best[i, j])], names=["query", "leader", "score"])

    found = scratch.put(v.select("vec_id", "embedding").mapInArrow(run, "query int, leader int, score double"), "tried")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "leader")
    got = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query", "leader").toPandas()
    leaders.tune(q, got["query"].to_numpy(), got["leader"].to_numpy(), recall)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the vectors that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding")).where("vec_id is not null and embedding is not null")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.where(~bad & F.exists("embedding", lambda x: x != 0))


def nearest_neighbours(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 20, shard_rows: int = SHARD_ROWS, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors of largest inner product found for each query.

    `vectors` and `queries` are (vec_id, embedding). A query's own vec_id is no candidate; every other
    row is, and rows that repeat a vec_id with another vector count by their better one. Nearest first, ties to the smaller vec_id; with fewer candidates, all of
    them. score is the inner product of the original vectors in double precision. Vectors that are null,
    zero, empty, or hold null or non-finite components take no part, nor do those of another length than
    the most frequent one (the smaller on a tie). Columns other than vec_id and embedding are not read.

    A query walks to as many leaders as TRIED of the queries needed for `recall` against brute force; where vectors have little structure that is
    a large share of them. A query that finds fewer than k is asked again of all leaders. Every query goes to every shard of about `shard_rows` rows.
    """
    bounded_batches(spark)
    v = usable(vectors)
    sizes = v.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    d, n = sizes["d"], sizes["count"]
    shards = max(LEAST_SHARDS, -(-n // shard_rows))
    v = v.where(F.size("embedding") == d)
    q = usable(queries).where(F.size("embedding") == d)
    scratch = Scratch(spark, "neighbours")
    leaders = Leaders(_picked(v, SAMPLE_ROWS, n, d)[1], max(1, min(LEADERS, int(n**0.5))))
    who, tried = _picked(q, TRIED, q.count(), d)
    if len(who):
        _tuned(scratch, leaders, v, who, tried, k, recall)
    found = scratch.put(_searched(v, q, leaders, leaders.reach, shards, d, k), "found")
    short = q.join(found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id")).distinct(), "vec_id", "left_anti")
    if leaders.reach < len(leaders.c) and not short.isEmpty():
        again = _searched(v, short, leaders, len(leaders.c), shards, d, k)
        found = found.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(again)
    return found


def _searched(v: DataFrame, q: DataFrame, leaders: Leaders, reach: int, shards: int, d: int, k: int) -> DataFrame:
    """The k nearest rows of `v` that each row of `q` finds at `reach` leaders."""
    width = len(leaders.c)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, flags = _matrix(batch.column(1), d), np.ones((len(batch), width), dtype=bool)
            for lo in range(0, len(x) if reach < width else 0, 256):
                flags[lo : lo + 256] = False
                np.put_along_axis(flags[lo : lo + 256], leaders.walk(x[lo : lo + 256], reach), True, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in np.packbits(flags, axis=1)], pa.binary())], names=["vec_id", "embedding", "leaders"])

    asked = q.select("vec_id", "embedding").mapInArrow(walk, "vec_id long, embedding array<float>, leaders binary")
    base = v.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "vec_id", "embedding", F.lit(None).cast("binary").alias("leaders"))
    ask = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "vec_id", "embedding", "leaders")
    rows = base.unionByName(ask).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind")
    names = ["query_id", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, xs, built = None, [], [], None
        for batch in batches:
            at = 0
            where = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
            while at < len(batch):
                to = at + int(np.searchsorted(where[at:], where[at], "right"))
                part = batch.slice(at, to - at)
                at, now, kind = to, int(where[at]) // 2, int(where[at]) % 2
                if now != shard:
                    shard, ids, xs, built = now, [], [], None
                x = _matrix(part.column(3), d)
                who = part.column(2).to_numpy()
                if kind == 0:
                    ids.append(who)
                    xs.append(x)
                    continue
                if built is None:
                    if not ids:
                        continue
                    built = Shard(leaders, np.concatenate(ids), np.concatenate(xs), k)
                    ids, xs = [True], []
                flags = np.frombuffer(b"".join(part.column(4).to_pylist()), dtype=np.uint8).reshape(len(part), -1)
                got = built.nearest(who, x, np.unpackbits(flags, axis=1, count=width).astype(bool), k)
                yield pa.RecordBatch.from_arrays([pa.array(g, t) for g, t in zip(got, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=names)

    found = rows.mapInArrow(run, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
