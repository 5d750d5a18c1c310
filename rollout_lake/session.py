"""Session settings and the shared folder for checkpoints and written intermediates."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(app: str = "rollout_lake", **conf: str) -> SparkSession:
    """A session with the settings the library relies on; master, memory and partitions are the cluster's.

    Further settings are given with double underscores for dots.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def local_session(app: str, cores: str | int = "*") -> SparkSession:
    """A single-process session for tests, benchmarks and tools."""
    return build_session(
        app, spark__master=f"local[{cores}]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory=os.environ.get("ROLLOUT_LAKE_DRIVER_MEMORY", "8g"),
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: the session's checkpoint folder.

    A temporary folder is only made for a local master that names none; on a
    cluster a missing setting is an error, because a machine-local path would be
    lost with its executor.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="rollout-lake-")
    context.setCheckpointDir(made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for one write."""
    import uuid

    return f"{shared_dir(spark)}/rollout_lake/{name}-{uuid.uuid4().hex}"
