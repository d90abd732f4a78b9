"""Model results kept by what was asked, so that a job which runs again asks only what is new.

    <log>/run=<name>   key, value and error of the items that one slice of a run has asked

The key is a digest of the model's name and the input. Known keys leave the table before the model is called, each
distinct input is asked once, however many rows hold it, and a run writes its results slice by slice: after a lost
driver the next run goes on behind the last finished slice. Failed items keep their reason and are asked again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passages.config import EMBED_BATCH
from passages.operators.embed import Model, batch_infer

#: Distinct inputs whose results are written together.
SLICE_ROWS = 100_000


def input_key(value: Column, model: str) -> Column:
    """Null for a null input, which no model is asked about."""
    return F.sha2(F.concat(F.lit(f"{model}\x1f").cast("binary"), value.cast("binary")), 256)


def read_log(spark: SparkSession, log: str, out_type: T.DataType) -> DataFrame:
    """(key, value, error): of each key a result, or the reason of a failure if there is none yet."""
    fields = [T.StructField("key", T.StringType()), T.StructField("value", out_type), T.StructField("error", T.StringType())]
    schema = T.StructType(fields)
    try:
        rows = spark.read.schema(T.StructType([*fields, T.StructField("run", T.StringType())])).parquet(log)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    order = F.struct(F.col("error").isNull(), "run")
    newest = F.max_by(F.struct("value", "error"), order).alias("r")
    return rows.groupBy("key").agg(newest).select("key", "r.value", "r.error")


def infer_logged(
    df: DataFrame,
    build_model: Callable[[], Model],
    in_col: str,
    out_col: str,
    out_type: T.DataType,
    log: str,
    model: str,
    batch_size: int = EMBED_BATCH,
    error_col: str | None = None,
) -> DataFrame:
    """`batch_infer` with a log: out_col for every row, model calls only for inputs that the log does not know.

    `model` names the model and its version: another name has results of its own. The model is called here, the
    returned table reads the log. A null input has a null result.
    """
    spark = df.sparkSession
    key = input_key(F.col(in_col), model)
    asked = df.select(key.alias("key"), F.col(in_col).alias("input")).where("key is not null").dropDuplicates(["key"])
    known = read_log(spark, log, out_type).where("error is null").select("key")
    new = asked.join(known, "key", "left_anti")
    rows = new.count()
    slices = -(-rows // SLICE_ROWS)
    run = uuid.uuid4().hex
    for k in range(slices):
        part = new.where(F.pmod(F.xxhash64("key"), F.lit(slices)) == k) if slices > 1 else new
        done = batch_infer(part, build_model, "input", "value", out_type, batch_size, "error", alone=True)
        done.select("key", "value", "error").write.mode("overwrite").parquet(f"{log}/run={run}-{k}")
    results = read_log(spark, log, out_type).select(
        F.col("key").alias("_key"), F.col("value").alias("_value"), F.col("error").alias("_error")
    )
    joined = df.withColumn("_asked", key).join(results, F.col("_asked") == F.col("_key"), "left")
    joined = joined.withColumn(out_col, F.col("_value"))
    if error_col is not None:
        joined = joined.withColumn(error_col, F.col("_error"))
    return joined.drop("_asked", "_key", "_value", "_error")
