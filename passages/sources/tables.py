"""Parquet tables in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    table = spark.read.parquet(path)
    return table.select(*columns) if columns else table


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Deal a scan of few splits out to all cores, for work that is heavy per row.

    A table of many files has more splits than there are cores and is left as it is, so large
    inputs are not shuffled. For a plain scan: counting its splits runs nothing.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, key) if scan.rdd.getNumPartitions() < cores else scan
