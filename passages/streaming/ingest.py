"""Incremental ingest: new document files, or raw files through a reader, become points, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from passages.config import INGEST, VECTOR_SIZE, RetrievalConfig
from passages.plans.ingest import BuildModel, as_points, embedded_chunks, ingest_report
from passages.schemas import DOCUMENTS, FILES, REPORT
from passages.session import cut_lineage
from passages.sources import collection, files


def stream_ingest(
    spark: SparkSession,
    docs_dir: str,
    path: str,
    checkpoint: str,
    config: RetrievalConfig = INGEST,
    build_model: BuildModel | None = None,
    dim: int = VECTOR_SIZE,
    max_files: int | None = None,
    first_batch: int = 1,
) -> StreamingQuery:
    """Ingest the document Parquet files that came in since the last run, then stop.

    Micro-batch n writes the collection batch first_batch + n, so a replay after a failure
    replaces what the failed try had written. Other writers keep to numbers below first_batch.
    Chunks that a model refuses are appended to <path>/rejected with their reason and batch.
    """
    collection.ensure_collection(spark, path, dim)
    reader = spark.readStream.schema(DOCUMENTS)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def store(docs: DataFrame, batch: int) -> None:
        points = as_points(embedded_chunks(docs, config, build_model, dim))
        rejected = collection.upsert(points, path, first_batch + batch)
        if build_model is not None:
            (
                rejected.select("id", "source", "error")
                .write.mode("overwrite")
                .parquet(f"{path}/rejected/ingest_batch={first_batch + batch}")
            )

    return (
        reader.parquet(docs_dir)
        .writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_folder(
    spark: SparkSession,
    root: str,
    path: str,
    checkpoint: str,
    build_reader: BuildModel,
    suffix: str = ".pdf",
    config: RetrievalConfig = INGEST,
    build_model: BuildModel | None = None,
    dim: int = VECTOR_SIZE,
    max_files: int | None = None,
    first_batch: int = 1,
) -> StreamingQuery:
    """Ingest the raw files below `root` that came in since the last run, by a reader of bytes, then stop.

    A file that cannot be read, or whose chunks a model refuses, costs only itself: `outcomes` tells what became of each. Points and
    outcomes of a micro-batch overwrite their own folders, so a replay leaves what a single run leaves.
    Files without a byte make no row of a stream; `files.empty_files` of a scan names them.
    """
    collection.ensure_collection(spark, path, dim)
    reader = (
        spark.readStream.format("binaryFile")
        .schema(FILES)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", f"*{suffix}")
    )
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def store(found: DataFrame, batch: int) -> None:
        number = first_batch + batch
        texts = cut_lineage(files.read_texts(found, build_reader))
        chunks = cut_lineage(embedded_chunks(texts.select("doc_id", "text", "source"), config, build_model, dim))
        collection.upsert(as_points(chunks), path, number)
        judged = chunks.select("doc_id", F.col("embedding").isNotNull().alias("valid"))
        report = ingest_report(texts.withColumn("accepted", F.lit(True)), judged, "doc_id")
        told = report.join(texts.select("doc_id", "path", "error"), "doc_id")
        told.select(*(f.name for f in REPORT if f.name != "ingest_batch")).write.mode("overwrite").parquet(
            f"{path}/outcomes/ingest_batch={number}"
        )

    return (
        reader.load(root)
        .writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    """What became of every file of `stream_folder`: (path, source, n_chunks, n_valid, status, error, ingest_batch)."""
    return spark.read.schema(REPORT).parquet(f"{path}/outcomes")
