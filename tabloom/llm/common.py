"""What several training-data operators share: scratch tables, word hashes, checked broadcasts."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join is broadcast only if its estimated size is below this.
BROADCAST_BYTES = 32 << 20
#: Python kernels tokenise at most about this many characters at once (a longer text goes alone).
CHUNK_CHARS = 1 << 20

WORD = re.compile(r"\w+")


# --- scratch tables -------------------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`; where it is unset (tests, on one machine), one of our own."""
    there = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if there:
        return there
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='tabloom-')}")
    return spark.sparkContext.getCheckpointDir()


#: Rows and bytes that go to a Python kernel at once: whole texts are held twice on either side of the pipe.
ARROW_ROWS, ARROW_BYTES = 1_000, 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to ARROW_ROWS and ARROW_BYTES, so that a kernel's memory hangs neither on the default of 10,000 texts nor on their length.

    Every operator calls it first. Plans are run after the operators have returned, so the settings stay lowered.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


@contextlib.contextmanager
def hashed_joins(spark: SparkSession) -> Iterator[None]:
    """Within, joins whose partitions turn out to be HASHED_BYTES or less are hashed instead of sorted; the session's setting comes back afterwards."""
    key = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(HASHED_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


#: A partition of the side that a join hashes, at the most.
HASHED_BYTES = 16 << 20


class Scratch:
    """Cuts lineage by written tables in the shared folder, so that a lost executor costs no rerun.

    `put` writes a DataFrame as Parquet and returns it as read back; `drop` deletes a table that
    nothing reads any more; what is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, what: str):
        bounded_batches(spark)
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/tabloom-{what}-{uuid.uuid4().hex[:12]}", 0
        atexit.register(self._end)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            self._delete(df._scratch_path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def _end(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                self._delete(self.root)
        except Exception:  # the JVM may be gone before us; the folder is scratch
            pass


def small(df: DataFrame, rows: int, bytes_per_row: int) -> DataFrame:
    """`df` marked for broadcast if `rows` of that width stay below the bound, else as it is."""
    return F.broadcast(df) if rows * bytes_per_row <= BROADCAST_BYTES else df


#: Keys that lookup() calls hot, at the most: the bound of what it broadcasts of a large table.
HOT_KEYS = 50_000


def lookup(rows: DataFrame, table: DataFrame, on: str | list[str], total: int, bytes_per_row: int = 64, split: bool = False) -> DataFrame:
    """`rows` inner-joined with `table`, which has each key once and in `n` how many of the `total` rows have it.

    A small table is broadcast, unless `split` asks for one plan at every size. Of a large one only the keys with more than total / HOT_KEYS rows are, which are fewer than HOT_KEYS;
    the other keys are shuffled, so that no key brings more than that share of the rows to one task.
    """
    if not split and total * bytes_per_row <= BROADCAST_BYTES:  # as many keys at the most
        return rows.join(F.broadcast(table.drop("n")), on)
    hot, cold = (table.where(F.col("n") > total // HOT_KEYS), table.where(F.col("n") <= total // HOT_KEYS))
    left = rows.join(F.broadcast(hot.select(on)), on, "left_anti")
    return rows.join(F.broadcast(hot.drop("n")), on).unionByName(left.join(cold.drop("n"), on))


def rows_of(docs: DataFrame, asked: DataFrame, doc: str, n: int) -> DataFrame:
    """`docs` joined with `asked`, which has what is wanted of n documents in one row for each (`doc`), by one plan at every size.

    Texts are wide, so those that nobody asks for are left out before the others are shuffled, while the ids of the asked ones can be broadcast.
    """
    ids = small(asked.select(F.col(doc).alias("tb_asked")), n, 16)
    return docs.join(ids, F.col("doc_id") == F.col("tb_asked"), "left_semi").join(asked.hint("merge"), F.col("doc_id") == F.col(doc))


def unused(name: str, *frames: DataFrame) -> str:
    """`name`, made longer until no column of the frames is called that."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_fields(schema: T.StructType, ddl: str) -> T.StructType:
    """A schema with the columns of `ddl` after its own."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- words and hashes -----------------------------------------------------------------------


def words(text: str | None) -> list[str]:
    """Lower-cased runs of word characters."""
    return WORD.findall(text.lower()) if text else []


def chunks(texts: list[str | None], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of at most `limit` characters, or of one row."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def hash_strings(values: Iterable[str]) -> np.ndarray:
    """A 64-bit hash of each string that is the same in every process."""
    flat = list(values)
    if not flat:
        return np.empty(0, dtype=np.uint64)
    arr = np.array(flat, dtype=object)
    codes, uniques = pd.factorize(arr)
    return pd.util.hash_array(np.asarray(uniques, dtype=object), categorize=False)[codes]


U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 over an array of uint64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_tables: dict[str, np.ndarray] = {}


def _codes(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether a code point is a word character (as in the pattern \\w), and a random number for it; up to `most` at least."""
    if "word" not in _tables or len(_tables["word"]) <= most:
        n = 0x3000 if most < 0x3000 else 0x110000
        _tables["word"] = np.fromiter((chr(c).isalnum() or c == 95 for c in range(n)), dtype=bool, count=n)
        _tables["code"] = mix(np.arange(1, n + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
    return _tables["word"], _tables["code"]


def _places(most: int) -> np.ndarray:
    """An odd factor for each place in a word."""
    if "place" not in _tables or len(_tables["place"]) <= most:
        _tables["place"] = mix(np.arange(1, max(256, 2 * most) + 1, dtype=np.uint64) * U(0xD6E8FEB86659FD93)) | U(1)
    return _tables["place"]


class Words:
    """The words of some texts: runs of word characters, as 64-bit hashes, with no Python object for any of them.

    `h` hashes the words of all texts in order, `start` and `end` are their places in `chars` (all texts, a line feed after each), and
    `first[i] : first[i + 1]` are the words of text i, `at[i]` its place in `chars`. The texts must be lower-cased.
    """

    def __init__(self, texts: list[str]):
        self.chars = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), dtype=np.uint32)
        self.at = np.concatenate([[0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))])
        word, code = _codes(int(self.chars.max()) if len(self.chars) else 0)
        inside = word[self.chars]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[::2], edge[1::2]  # a line feed ends the last word
        n = self.end - self.start
        if len(n):
            before = np.cumsum(n) - n
            place = np.arange(int(n.sum())) - np.repeat(before, n)
            h = np.add.reduceat(code[self.chars[inside]] * _places(int(n.max()))[place], before)
            self.h = mix(h + n.astype(np.uint64) * U(0xC2B2AE3D27D4EB4F))
        else:
            self.h = np.empty(0, dtype=np.uint64)
        self.first = np.searchsorted(self.start, self.at)


def hashed_words(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of the lower-cased words in text order) of each text; memory is bounded by a chunk."""
    for a, b in chunks(texts):
        got = Words([t.lower() if t else "" for t in texts[a:b]])
        for i in range(b - a):
            yield a + i, got.h[got.first[i] : got.first[i + 1]]


def shingles(w: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words; fewer than k words make one run, none make none."""
    n = len(w)
    if not n:
        return w
    k = min(n, k)
    out = np.zeros(n - k + 1, dtype=np.uint64)
    for j in range(k):
        out = (out ^ w[j : n - k + 1 + j]) * U(0x9E3779B97F4A7C15)
        out ^= out >> U(29)
    return out


def occurrences(s: np.ndarray) -> np.ndarray:
    """Labels each hash with how often it came before, so that all are distinct."""
    if len(s) < 2:
        return s
    order = np.argsort(s, kind="stable")
    t = s[order]
    new = np.empty(len(s), dtype=bool)
    new[0] = True
    np.not_equal(t[1:], t[:-1], out=new[1:])
    if new.all():
        return s
    starts = np.flatnonzero(new)
    occ = np.arange(len(s)) - np.repeat(starts, np.diff(np.append(starts, len(s))))
    out = s.copy()
    out[order] = np.where(occ > 0, mix(t + occ.astype(np.uint64) * U(0xD6E8FEB86659FD93)), t)
    return out


def distinct(s: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    t = np.sort(s)
    new = np.ones(len(t), dtype=bool)
    np.not_equal(t[1:], t[:-1], out=new[1:])
    return t[new]


def as_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)

