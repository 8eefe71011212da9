"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql import types as T

# Every setting here is a default for sessions this package creates itself;
# a session handed in by a cluster keeps its own configuration.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "kinsight", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the package defaults; ``conf`` uses ``__`` for dots in keys."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting (tests, laptops) gets a
    temporary folder; on a cluster a missing setting is an error, because a
    machine-local path would be lost together with its executor.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if not root:
        if current:
            return current
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="kinsight-")
    if not current:
        context.setCheckpointDir(root)
    return root


def run_folder(spark: SparkSession, purpose: str) -> str:
    """Fresh folder below the shared root for one run of one operator."""
    return f"{shared_root(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def emptied(spark: SparkSession, folder: str, schema: T.StructType) -> None:
    """Give back the space of a table of ours that nothing reads any more: its files are replaced by none."""
    spark.createDataFrame([], schema).coalesce(1).write.mode("overwrite").parquet(folder)


@contextmanager
def spent_shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written in here gives back the space of its shuffles once it has ended; else they stay until the driver
    happens to collect its garbage."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)
