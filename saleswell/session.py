"""Session defaults and lineage cutting."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "saleswell", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs expect.

    Shuffle parallelism is left to AQE: start with many small partitions and
    let it coalesce, which holds at both ends of the size range.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


@functools.cache
def _local_folder() -> str:
    """A scratch folder for sessions on one machine, removed when the process ends."""
    folder = tempfile.mkdtemp(prefix="saleswell-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder the cluster names; survives executor loss."""
    sc = df.sparkSession.sparkContext
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        # Only a local test session has no configured folder.
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        sc.setCheckpointDir(folder or _local_folder())
    return df.checkpoint(eager=True)


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the cluster's shared folder for checkpoints and stream output."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = _local_folder()
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
