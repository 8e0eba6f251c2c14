"""Session helpers: local defaults for tests and the reliable checkpoint rule."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "*", app: str = "panelspark") -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", os.environ.get("SHUFFLE_PARTITIONS", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints, which driver and executors share.

    The one that ``spark.checkpoint.dir`` names is used; a temporary one only when running in local mode with nothing
    configured.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            shared = tempfile.mkdtemp(prefix="panelspark-ckpt-")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def reliable(df: DataFrame) -> DataFrame:
    """Cut lineage through the cluster's shared checkpoint folder (see ``shared_folder``).

    Set ``spark.cleaner.referenceTracking.cleanCheckpoints`` to have Spark delete checkpoints that nothing reads any more.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
