"""Session settings for tests, the bench and new applications."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "yardframe",
                  **conf: str) -> SparkSession:
    """A session with adaptive planning on; ``master`` is left to spark-submit when None."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = (
            builder.master(master)
            .config("spark.driver.host", "127.0.0.1")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.driver.memory", "8g")
        )
        if master.startswith("local["):
            builder = builder.config("spark.sql.shuffle.partitions", master[6:-1].replace("*", "8"))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; make one only where none is configured."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = context.getConf().get("spark.checkpoint.dir")
    if shared is None and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="yardframe-", dir=os.environ.get("TMPDIR", "/tmp")))
