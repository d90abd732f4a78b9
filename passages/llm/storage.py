"""Shared folders, stored intermediate tables and other helpers of these operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; where it names none, one in the
    warehouse, which a session shares with its executors in any case."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return folder or spark.conf.get("spark.sql.warehouse.dir")


def stored(df: DataFrame) -> DataFrame:
    """The rows, written once in the shared folder and read back.

    Later steps read columns of the file and not the steps before it, on whichever executor;
    the folder belongs to the cluster, which clears it as it does its checkpoints.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/passages-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
