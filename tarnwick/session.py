"""Session builder with the settings the engine expects."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_spark(app: str = "tarnwick", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE, UTC and Arrow on; ``conf`` keys use ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it comes in fewer partitions, as one small file does; larger inputs stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only where it is unset and the master is local (tests), a local one is made and set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a shared folder under the master {master}")
        found = f"file://{tempfile.mkdtemp(prefix='tarnwick-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: its plan ends there, and lost executors lose nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(spark: SparkSession, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table kept under ``key`` in the shared folder; made, written and published there where it isn't, or no longer is.

    A table is written under a name of its own and renamed when it is whole, so
    a write that was broken off is never read, and of two sessions that write at
    once one publishes. Tables go with the folder's retention and are made again.
    """
    jvm, path = spark._jvm, f"{shared_folder(spark)}/kept-{key}"
    to, done = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(done):
        own = shared_path(spark, key)
        make().write.parquet(own)
        if fs.exists(to) or not fs.rename(jvm.org.apache.hadoop.fs.Path(own), to):
            path = path if fs.exists(done) else own
    return spark.read.parquet(path)
