"""Answer records out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passages.schemas import ANSWERS


def write_answers(answers: DataFrame, path: str) -> None:
    """JSON Lines, one file per partition; missing parent folders are created."""
    answers.select(*ANSWERS.fieldNames()).write.mode("overwrite").json(path)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ANSWERS).json(path)
