"""The point collection: an append log of Parquet batches with a latest-wins view.

    <path>/meta     one row per version: data folder, dimension, metric
    <path>/<data>   points, partitioned by ingest_batch
    <path>/<data>-ranges   of compacted points: first and last id and number of rows of every file

Writing a batch again replaces that batch, so a retry changes nothing; batch numbers give the
order in which writes count. Compaction writes a new data folder, all of it in batch -1, and then
appends the version that names it: readers see the old folder or the new one, and a batch that is
written again later adds to the compacted rows and cannot replace them.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passages.config import SCROLL_LIMIT, VECTOR_SIZE
from passages.functions.vectors import check_metric
from passages.operators.vector import known_source, split_by_dim
from passages.schemas import COLLECTION_META, POINTS
from passages.session import cut_lineage


# The batch of compacted rows; every other number is later.
BASE_BATCH = -1

# Bound of the ids that may travel to all tasks.
BROADCAST_IDS = 500_000


def _meta(spark: SparkSession, path: str):
    try:
        table = spark.read.schema(COLLECTION_META).json(f"{path}/meta")
        return table.orderBy(F.col("version").desc()).first()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _append_meta(spark: SparkSession, path: str, *row) -> None:
    spark.createDataFrame([row], COLLECTION_META).coalesce(1).write.mode("append").json(f"{path}/meta")


def collection_exists(spark: SparkSession, path: str) -> bool:
    return _meta(spark, path) is not None


def ensure_collection(
    spark: SparkSession, path: str, dim: int = VECTOR_SIZE, metric: str = "cosine"
) -> None:
    """Create the collection if it is missing; an existing one must have the same settings."""
    check_metric(metric)
    meta = _meta(spark, path)
    if meta is None:
        empty = spark.createDataFrame([], POINTS)
        empty.write.mode("append").partitionBy("ingest_batch").parquet(f"{path}/points-0")
        _append_meta(spark, path, 0, "points-0", dim, metric)
    elif (meta.dim, meta.metric) != (dim, metric):
        raise ValueError(f"{path} holds {meta.dim} x {meta.metric}, not {dim} x {metric}")


def _existing(spark: SparkSession, path: str):
    meta = _meta(spark, path)
    if meta is None:
        raise ValueError(f"no collection at {path}")
    return meta


def settings(spark: SparkSession, path: str) -> tuple[int, str]:
    """(dim, metric) of the collection, as searches take them."""
    meta = _existing(spark, path)
    return meta.dim, meta.metric


def _clear_batch(spark: SparkSession, path: str, data_dir: str, batch: int) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{data_dir}/ingest_batch={batch}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def upsert(points: DataFrame, path: str, batch: int) -> DataFrame:
    """Write one batch of (id, embedding, text, source); returns the rejected rows.

    Rows without a vector, or with one of another length than the collection, are not written. A batch that
    is written again without any row is empty from then on. One writer at a time.
    """
    if batch <= BASE_BATCH:
        raise ValueError("batch numbers start at 0")
    meta = _existing(points.sparkSession, path)
    accepted, rejected = split_by_dim(points, meta.dim)
    if accepted.isEmpty():
        # A write of no rows would leave the old ones.
        _clear_batch(points.sparkSession, path, meta.data_dir, batch)
        return rejected
    (
        accepted.select(
            "id", F.col("embedding").cast("array<float>"), "text", "source", F.lit(batch).alias("ingest_batch")
        )
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("ingest_batch")
        .parquet(f"{path}/{meta.data_dir}")
    )
    return rejected


def latest_points(log: DataFrame) -> DataFrame:
    """The last written row of each id; versions are reduced before the shuffle."""
    fields = [c for c in log.columns if c != "id"]
    newest = F.max_by(F.struct(*fields), "ingest_batch")
    return log.groupBy("id").agg(newest.alias("_last")).select("id", "_last.*")


def _log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POINTS).parquet(f"{path}/{_existing(spark, path).data_dir}")


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """(id, embedding, text, source, ingest_batch), one row per id.

    A compacted collection without later batches is read as it is; the partition folders
    answer that question, so it costs no scan. Otherwise the ids that were written more than
    once are found from the id column alone, and while a count shows that they are few, only
    their rows are compared; all other rows stay where they are read.
    """
    log = _log(spark, path)
    if log.where(F.col("ingest_batch") > BASE_BATCH).select("ingest_batch").isEmpty():
        return log
    repeated = cut_lineage(
        log.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    )
    if repeated.limit(BROADCAST_IDS + 1).count() > BROADCAST_IDS:
        return latest_points(log)
    few = F.broadcast(repeated)
    newest = latest_points(log.join(few, "id", "left_semi"))
    return log.join(few, "id", "left_anti").unionByName(newest)


def is_empty(spark: SparkSession, path: str) -> bool:
    """Whether the log has no row; versions are not compared for that."""
    return _log(spark, path).select("id").isEmpty()


def compact(spark: SparkSession, path: str) -> None:
    """Rewrite the latest rows into a new folder and point the collection to it."""
    meta = _existing(spark, path)
    version = meta.version + 1
    folder = f"points-{version}"
    # Ranges of ids: a page of ids lies in few files, and files are told apart by their smallest and largest id.
    (
        read_points(spark, path)
        .withColumn("ingest_batch", F.lit(BASE_BATCH))
        .repartitionByRange("id")
        .sortWithinPartitions("id")
        .write.mode("overwrite")
        .partitionBy("ingest_batch")
        .parquet(f"{path}/{folder}")
    )
    written = spark.read.schema(POINTS).parquet(f"{path}/{folder}").select(F.input_file_name().alias("file"), "id")
    ranges = written.groupBy("file").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("id").alias("n"))
    ranges.write.mode("overwrite").parquet(f"{path}/{folder}-ranges")
    _append_meta(spark, path, version, folder, meta.dim, meta.metric)


def scroll_page(spark: SparkSession, path: str, cursor: str | None = None, limit: int = SCROLL_LIMIT) -> DataFrame:
    """`scroll` of a stored collection. Of a compacted one without later batches, only the files that hold the page are
    read: that of the cursor and, as each has its row count, as many after it as the page can reach into."""
    data_dir = _existing(spark, path).data_dir
    if not _is_compacted(spark, path):
        return scroll(read_points(spark, path), cursor, limit)
    ranges = spark.read.parquet(f"{path}/{data_dir}-ranges")
    ahead = ranges if cursor is None else ranges.where(F.col("last") >= cursor)
    files, rows = [], 0
    # A file has a row at least, so the page and its next cursor lie in the first limit + 2 files.
    for r in ahead.orderBy("first").limit(limit + 2).collect():
        files.append(r.file)
        rows += r.n if len(files) > 1 or cursor is None else 0  # rows of the first file may lie before the cursor
        if rows > limit:
            break
    points = spark.read.schema(POINTS).parquet(*files) if files else spark.createDataFrame([], POINTS)
    return scroll(points, cursor, limit)


def _is_compacted(spark: SparkSession, path: str) -> bool:
    """Whether all rows are those of the last compaction."""
    log = _log(spark, path)
    if _existing(spark, path).version == 0:
        return False
    return log.where(F.col("ingest_batch") > BASE_BATCH).select("ingest_batch").isEmpty()


def all_documents(points: DataFrame) -> DataFrame:
    """(id, text, source); a missing source reads "Unknown"."""
    return points.select("id", "text", known_source().alias("source"))


def scroll(points: DataFrame, cursor=None, limit: int = SCROLL_LIMIT) -> DataFrame:
    """One page of at most `limit` documents from `cursor` on, in id order.

    Each row carries `next_cursor`, the id that the next page starts with (null at the end).
    """
    page = all_documents(points)
    if cursor is not None:
        page = page.where(F.col("id") >= cursor)
    # limit + 1 rows, gathered into one to read the extra id off the end.
    ahead = page.orderBy("id").limit(limit + 1)
    rows = ahead.agg(F.array_sort(F.collect_list(F.struct("id", "text", "source"))).alias("rows"))
    following = F.try_element_at(F.col("rows.id"), F.lit(limit + 1))
    return rows.select(
        following.alias("next_cursor"), F.explode(F.slice("rows", 1, limit)).alias("row")
    ).select("row.*", "next_cursor")
