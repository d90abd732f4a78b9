"""File scans. Decoding a file is the reader's business: the tables hold paths and bytes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passages.operators.embed import Model, batch_infer


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "file:/")


def scan_files(spark: SparkSession, root: str, suffix: str = ".pdf") -> DataFrame:
    """Files below `root`, folders excluded, whose name ends in `suffix` (case counts).

    (path, modificationTime, length, content); leaving out `content` does not read the files.
    Files without a byte are not in the scan; `empty_files` names them.
    """
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", f"*{suffix}")
        .load(root)
    )


def split_by_suffix(files: DataFrame, name_col: str, suffix: str = ".pdf") -> DataFrame:
    """Adds `accepted`; the files of another kind stay in, for the ingest report."""
    return files.withColumn("accepted", F.col(name_col).endswith(suffix))


def empty_files(scan: DataFrame) -> DataFrame:
    """(path) of the files that a scan lists but leaves out because they hold nothing.

    The names come from the listing that the session made to plan the scan.
    """
    names = [(name,) for name in scan.inputFiles()]
    listed = scan.sparkSession.createDataFrame(names, "path string").select(
        _plain(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))).alias("path")
    )
    return listed.join(scan.select(_plain(F.col("path")).alias("path")), "path", "left_anti")


def read_texts(scan: DataFrame, build_reader: Callable[[], Model]) -> DataFrame:
    """(doc_id, text, source, path, failed, error): the text of each file, by a reader of bytes.

    `build_reader` gives list of bytes -> list of texts. A file that cannot be read costs only
    itself: it has no text and `failed` is true.
    """
    read = batch_infer(scan, build_reader, "content", "text", T.StringType(), batch_size=1, error_col="error")
    return read.select(
        F.xxhash64("path").alias("doc_id"),
        "text",
        F.element_at(F.split("path", "/"), -1).alias("source"),
        "path",
        F.col("text").isNull().alias("failed"),
        "error",
    )
