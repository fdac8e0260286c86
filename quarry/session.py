"""Session helpers: a configured local session for tests/bench, and the
shared folder for anything written mid-job."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "quarry", deal: int | None = None) -> SparkSession:
    """Session for tests and the bench. Library code never calls this: it uses
    whatever session the caller's DataFrames belong to. ``deal`` spreads the
    given tables over so many partitions."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
    )
    if deal:
        builder = builder.config("spark.quarry.local.tablePartitions", str(deal))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)  # make sure a checkpoint dir exists
    return spark


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A fresh path under the cluster's shared folder (``spark.checkpoint.dir``).

    The setting is read from the session. Only when it is unset on a local
    master (tests) do we set our own; on a cluster an unset value is an error,
    because a machine-local folder is not visible to the other executors.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        base = tempfile.mkdtemp(prefix="quarry-ckpt-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    if not parts:
        return base
    return os.path.join(base, "quarry", *parts, uuid.uuid4().hex)
