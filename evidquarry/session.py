"""Session construction and the few cluster-level helpers operators share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "evidquarry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; the cluster's own settings win.

    ``master`` is only passed for local runs. On a cluster, spark-submit decides
    it, together with memory, executor count and ``spark.checkpoint.dir``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    defaults.update(conf)
    for key, value in defaults.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder all executors share (``spark.checkpoint.dir``).

    Only local runs without the setting, as in unit tests, get a scratch folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="run-", dir=os.environ.get("TMPDIR", "/tmp"))
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def fits_within(df: DataFrame, limit: int) -> bool:
    """True when *df* has at most *limit* rows; reads no more than limit + 1 rows."""
    return df.limit(limit + 1).count() <= limit


def balanced(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a frame read from fewer splits than there are cores.

    Large inputs already arrive in more splits than cores and are returned as they
    are; only a small file would otherwise leave CPU-heavy text work on one core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    try:
        splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    except AttributeError:  # a remote client has no plan at hand
        return df
    return df if splits >= cores else df.repartition(cores, *keys)
