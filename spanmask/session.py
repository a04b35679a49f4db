"""SparkSession helper with the settings this engine is tuned for."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "spanmask") -> SparkSession:
    """Create (or reuse) a session.

    On a cluster the master, memory and ``spark.checkpoint.dir`` come from the
    submit configuration; the defaults below only fill gaps for local runs.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    cores = os.cpu_count() or 8
    parts = shuffle_partitions or cores
    builder = (
        builder.config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPANMASK_DRIVER_MEMORY", "16g"))
        # long documents: keep input splits moderate so one task holds few of them
        .config("spark.sql.files.maxPartitionBytes", str(32 * 1024 * 1024))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared ``spark.checkpoint.dir``.

    In local mode, where one machine is the cluster, a temporary folder stands in for an
    unset one; elsewhere an unset one is an error, since tasks on other machines could not
    read a local folder."""
    context = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not current:
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="spanmask-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if not context.getCheckpointDir():
        context.setCheckpointDir(current)
    return current


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, for clusters where it is not installed."""
    import spanmask

    root = os.path.dirname(os.path.dirname(os.path.abspath(spanmask.__file__)))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="spanmask-ship-"), "spanmask"), "zip", root, "spanmask")
    spark.sparkContext.addPyFile(archive)


def settled(df):
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
