"""Session helpers: settings for local runs and lineage cuts that survive executor loss."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "pixelloom", cpus: str = "8", partitions: str = "8") -> SparkSession:
    """A session for tests and the local bench. On a cluster the session comes from spark-submit."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("PIXELLOOM_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def stable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it from there.

    For an intermediate result that several later passes read and that is costly to
    compute again. The folder is the one the cluster names in ``spark.checkpoint.dir``.
    Only a local master may fall back to a folder of its own.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="pixelloom-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint()
