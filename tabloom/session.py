"""Session helpers shared by queries, tests and the bench."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors, once for each application, so that kernels can be imported there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    here = Path(__file__).resolve().parent
    if not here.is_dir():  # already running from a shipped archive
        return
    tmp = tempfile.mkdtemp(prefix="tabloom-")  # Spark's file server reads it as executors start
    atexit.register(shutil.rmtree, tmp, ignore_errors=True)
    shutil.copytree(here, f"{tmp}/in/{here.name}", ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(f"{tmp}/{here.name}", "zip", f"{tmp}/in"))


def local_session(cpus: int = 8, app: str = "tabloom") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TABLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables under `sf_dir`, by any path that Spark can read."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """`df` computed and written to the folder in `spark.checkpoint.dir`, so that long chains of rules are planned piece by piece and a lost executor costs no rerun.

    Where the folder is unset (tests, on one machine) it is one of our own; on a cluster that is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        there = sc.getConf().get("spark.checkpoint.dir")
        if not there and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(there or f"file://{tempfile.mkdtemp(prefix='tabloom-')}")
    return df.checkpoint()
