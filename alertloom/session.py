"""Session helpers: a tuned builder for local work and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cpus: int | str = 8, app: str = "alertloom", **conf: str) -> SparkSession:
    """Session for tests and benchmarks. A cluster job brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("ALERTLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_local_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that outlives any executor, named by ``spark.checkpoint.dir``.

    Only a local master may do without it: its one machine keeps a temporary folder for the process. On a
    cluster such a folder would be visible to one machine only, so its absence is an error there.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a shared folder")
    if not _local_dir:
        _local_dir.append(tempfile.mkdtemp(prefix="alertloom-"))
    return _local_dir[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_scope: ContextVar[list[str] | None] = ContextVar("scratch_scope", default=None)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Remove the tables materialized inside the block when it ends, as a long-running stream must."""
    written: list[str] = []
    token = _scope.set(written)
    try:
        yield
    finally:
        _scope.reset(token)
        for path in written:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by writing ``df`` once to the shared folder and reading it back.

    Used where a result feeds several branches or an iterative step; the written table survives
    the loss of executors, unlike a cached or locally checkpointed one.
    """
    path = scratch_path(df.sparkSession, name)
    if (written := _scope.get()) is not None:
        written.append(path)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give a scan with fewer splits than cores one partition per core.

    For text work on few large row groups, where the computation costs far more than moving the rows.
    A table with enough splits, as any large one has, is returned as it is and never shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
