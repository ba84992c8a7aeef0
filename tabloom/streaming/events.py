"""Streaming forms of the stateless plans, and windowed counts with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, like: str) -> DataFrame:
    """Files that arrive under `path`, with the schema of the Parquet table `like`."""
    return spark.readStream.schema(spark.read.parquet(like).schema).parquet(path)


def _marked(events: DataFrame, ts: str, late: str) -> DataFrame:
    """With a watermark; a stream's event time must be a timestamp with a zone."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if events.isStreaming else events


def deduplicated(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """First arrivals of a key within the watermark; state is dropped behind it."""
    if not events.isStreaming:
        return events.dropDuplicates(keys)
    return _marked(events, ts, late).dropDuplicatesWithinWatermark(keys)


def tumbling(events: DataFrame, every: str, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """(keys, start, n, total): counts and sums of value by tumbling windows."""
    w = _marked(events, ts, late).groupBy(F.window(ts, every), *keys).agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("total"))
    return w.select(*keys, F.col("window.start").alias("start"), "n", "total")


def sessions(events: DataFrame, gap: str, key: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """(key, start, n): activity sessions closed by a gap."""
    w = _marked(events, ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
    return w.select(key, F.col("session_window.start").alias("start"), "n")


def merge_latest(state: DataFrame | None, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by `order`, of what was kept so far and a batch; a partial aggregate, so only one row a key is shuffled from each task."""
    rows = batch if state is None else state.unionByName(batch)
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("tb_last"))
    return last.select(*keys, "tb_last.*")


def keep_latest(stream: DataFrame, path: str, keys: list[str], order: list[str], checkpoint: str):
    """Starts a query that keeps the last row of each key as a Parquet table in turn below `path`; latest_table() reads it.

    Every micro-batch reads the table of the batch before and writes one of its own, so a batch that is run again after a failure gives the same.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _existing(spark, path, number - 1)
        merge_latest(spark.read.parquet(before) if before else None, batch, keys, order).write.mode("overwrite").parquet(f"{path}/{number:012d}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def _existing(spark: SparkSession, path: str, most: int) -> str | None:
    """The newest complete table below `path` of a batch up to `most`."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    done = sorted(n for n in names if n.isdigit() and int(n) <= most)
    return f"{path}/{done[-1]}" if done else None


def latest_table(spark: SparkSession, path: str) -> DataFrame | None:
    """What keep_latest() has kept; null before its first batch."""
    there = _existing(spark, path, 1 << 62)
    return spark.read.parquet(there) if there else None
