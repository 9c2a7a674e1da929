"""Session building and the few physical helpers that every module shares."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "quellwerk", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session as tests and the bench use it; a cluster brings its own."""
    cpus = cpus or os.cpu_count() or 2
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(max(8, cpus)))
        .config("spark.driver.memory", os.environ.get("QUELLWERK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def estimated_bytes(df: DataFrame) -> int:
    """Spark's own estimate of a frame's size, columns pruned."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A shuffled frame estimated under this size is spread again before Python work, as adaptive execution may have put it into one partition.
SMALL_BYTES = 256 << 20
_SHUFFLING = ("Window", "Aggregate", "Join", "Sort", "Distinct", "Repartition")


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan of fewer splits than cores (one small file) before Python work.

    A scan that already has a task for every core is left alone, so nothing is
    shuffled where the input is large; a shuffled frame only if it is small.
    """
    wanted = max(2, df.sparkSession.sparkContext.defaultParallelism)
    if any(name in df._jdf.queryExecution().optimizedPlan().toString() for name in _SHUFFLING):
        return df.repartition(wanted) if estimated_bytes(df) < SMALL_BYTES else df
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted // 2 else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """A small frame dealt to every core by its keys: a window over them needs no further shuffle, and Python work after it no spread."""
    return df.repartition(max(2, df.sparkSession.sparkContext.defaultParallelism), *keys) if estimated_bytes(df) < SMALL_BYTES else df


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the session's own setting; with a local master and none set, a temporary one.

    A folder of one machine is none that executors elsewhere can read, so a cluster must name one.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        told = spark.conf.get("spark.checkpoint.dir", None)
        if told is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            told = tempfile.mkdtemp(prefix="quellwerk-checkpoint-")
            atexit.register(shutil.rmtree, told, True)
        sc.setCheckpointDir(told)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from the written copy."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
