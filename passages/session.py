"""Session helpers: local test sessions, task code shipping, the checkpoint folder."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def ship_with_tasks() -> None:
    """Send this package's functions with each task, so executors need no install of it."""
    for name in ("passages", "checks"):
        if name in sys.modules:
            cloudpickle.register_pickle_by_value(sys.modules[name])


def local_session(cores: int | str = "*", app: str = "passages") -> SparkSession:
    """A single-JVM session for tests and the benchmark; clusters bring their own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8" if cores == "*" else str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() into the folder the cluster names; without one the plan stays lazy.

    A checkpoint lives in shared storage, so a lost executor costs a re-read and not a
    recomputation of everything before it.
    """
    context = df.sparkSession.sparkContext
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if folder and context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    if context.getCheckpointDir() is None:
        return df
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it names none, the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (folder or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this package wrote, in whatever store it lies."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
