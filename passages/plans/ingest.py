"""Documents to points: the two ingest jobs and their report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passages.config import ASK, EMBED_BATCH, INGEST, VECTOR_SIZE, RetrievalConfig
from passages.operators.chunk import chunk_fixed, chunk_recursive, fixed_chunk_count, with_chunk_ids
from passages.operators.embed import Model, embed_with, valid_embeddings
from passages.operators.order import running_offset
from passages.operators.vector import known_source
from passages.session import cut_lineage
from passages.sources import collection, files

BuildModel = Callable[[], Model]

# Bound of the documents with a failed batch that may travel to all tasks.
BROADCAST_FAILED = 200_000


def _named(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", known_source().alias("source"))


def fixed_chunks(docs: DataFrame, config: RetrievalConfig = INGEST) -> DataFrame:
    return with_chunk_ids(chunk_fixed(_named(docs), config.chunk_size, config.chunk_overlap))


def embedded_chunks(
    docs: DataFrame,
    config: RetrievalConfig = INGEST,
    build_model: BuildModel | None = None,
    dim: int = VECTOR_SIZE,
) -> DataFrame:
    """Fixed chunks with `embedding`, and `error` where there is none.

    A source is embedded in batches of 64 chunks, in order. One text that the model refuses
    costs its whole batch, and the others of it carry its reason. The built-in embedder refuses nothing.
    """
    chunks = embed_with(fixed_chunks(docs, config), build_model, size=dim)
    if build_model is None:
        return chunks
    return fail_batches(cut_lineage(chunks), docs, config)


def fail_batches(tried: DataFrame, docs: DataFrame, config: RetrievalConfig = INGEST) -> DataFrame:
    """`tried` with the batches of its refused chunks failed as a whole.

    Places in a source are worked out on (source, doc_id, number of chunks), and a failed batch is a row
    (source, batch): no text is moved for it. Only the documents that a failed batch touches are joined back,
    by a broadcast while a count shows that they are few.
    """
    refused = tried.where(F.col("error").isNotNull()).select("source", "doc_id", "chunk_no", "error")
    if refused.isEmpty():
        return tried
    count = fixed_chunk_count(F.col("text"), config.chunk_size, config.chunk_overlap)
    lengths = _named(docs).where(F.length("text") > 0).select("source", "doc_id", count.alias("_n"))
    placed = running_offset(lengths, "source", "doc_id", F.col("_n"), "_offset")
    batch_of = lambda place: F.floor(place / EMBED_BATCH)
    failed = (
        refused.join(placed, ["source", "doc_id"])
        .groupBy("source", batch_of(F.col("_offset") + F.col("chunk_no")).alias("_batch"))
        .agg(F.min("error").alias("_reason"))
    )
    last = batch_of(F.col("_offset") + F.col("_n") - 1)
    touched = placed.withColumn("_batch", F.explode(F.sequence(batch_of(F.col("_offset")), last)))
    lost = cut_lineage(
        touched.join(failed, ["source", "_batch"])
        .groupBy("source", "doc_id")
        .agg(
            F.first("_offset").alias("_offset"),
            F.map_from_entries(F.collect_list(F.struct("_batch", "_reason"))).alias("_lost"),
        )
    )
    few = lost.limit(BROADCAST_FAILED + 1).count() <= BROADCAST_FAILED
    joined = tried.join(F.broadcast(lost) if few else lost, ["source", "doc_id"], "left")
    reason = F.try_element_at("_lost", batch_of(F.col("_offset") + F.col("chunk_no")))
    return (
        joined.withColumn("error", F.coalesce("error", reason))
        .withColumn("embedding", F.when(F.col("error").isNull(), F.col("embedding")))
        .drop("_offset", "_lost")
    )


def judged_chunks(
    docs: DataFrame,
    config: RetrievalConfig = INGEST,
    build_model: BuildModel | None = None,
    dim: int = VECTOR_SIZE,
) -> DataFrame:
    """Fixed chunks with `valid`, false where the embedding batch of a chunk failed, and `error`."""
    if build_model is None:
        return fixed_chunks(docs, config).withColumns(
            {"valid": F.lit(True), "error": F.lit(None).cast("string")}
        )
    done = embedded_chunks(docs, config, build_model, dim)
    return done.withColumn("valid", F.col("embedding").isNotNull()).drop("embedding")


def as_points(chunks: DataFrame) -> DataFrame:
    """Embedded chunks as rows for the collection, which rejects those without a vector."""
    return chunks.select(F.col("chunk_id").alias("id"), "embedding", "text", "source", "error")


def ingest_fixed(
    docs: DataFrame,
    config: RetrievalConfig = INGEST,
    build_model: BuildModel | None = None,
    dim: int = VECTOR_SIZE,
) -> DataFrame:
    """Fixed chunks, embedded, failed ones dropped: the points to store."""
    points = as_points(embedded_chunks(docs, config, build_model, dim)).drop("error")
    return points if build_model is None else valid_embeddings(points)


def recursive_points(
    docs: DataFrame,
    config: RetrievalConfig = ASK,
    dim: int = VECTOR_SIZE,
    build_model: BuildModel | None = None,
) -> DataFrame:
    """Recursive chunks, embedded: the points of the index build, with `error` where there is no vector."""
    embedded = recursive_chunks(docs, config, build_model, dim)
    return as_points(embedded if build_model is None else cut_lineage(embedded))


def recursive_chunks(
    docs: DataFrame, config: RetrievalConfig = ASK, build_model: BuildModel | None = None, dim: int = VECTOR_SIZE
) -> DataFrame:
    """Recursive chunks with `embedding`, and `error` where there is none; a text that is refused costs only itself."""
    chunks = with_chunk_ids(chunk_recursive(_named(docs), config.chunk_size, config.chunk_overlap))
    return embed_with(chunks, build_model, size=dim)


def build_index(
    docs: DataFrame,
    path: str,
    config: RetrievalConfig = ASK,
    batch: int = 0,
    dim: int = VECTOR_SIZE,
    metric: str = "cosine",
    build_model: BuildModel | None = None,
) -> DataFrame:
    """Chunk, embed and store with one write; returns the rejected rows with their `error`."""
    collection.ensure_collection(docs.sparkSession, path, dim, metric)
    return collection.upsert(recursive_points(docs, config, dim, build_model), path, batch)


def load_index(
    spark: SparkSession,
    path: str,
    docs: DataFrame | None = None,
    config: RetrievalConfig = ASK,
    dim: int = VECTOR_SIZE,
    build_model: BuildModel | None = None,
) -> DataFrame:
    """All stored documents (id, text, source); an empty collection is built from `docs`."""
    collection.ensure_collection(spark, path, dim)
    if collection.is_empty(spark, path):
        if docs is None:
            raise ValueError("the collection is empty and there are no documents to build it from")
        build_index(docs, path, config, dim=dim, build_model=build_model)
    return collection.all_documents(collection.read_points(spark, path))


# What became of a file.
SKIPPED, ERROR, NO_TEXT = "skipped", "error", "no text"
NO_EMBEDDING, STORED = "no valid embedding", "stored"


def ingest_report(files: DataFrame, chunks: DataFrame, key: str = "source") -> DataFrame:
    """(source, n_chunks, n_valid, status) for every file, and `key` if that is another column.

    files(key, source, accepted, and failed if there was a reader) lists what was found,
    chunks(key, valid) the judged chunks of all accepted ones. Files in different folders may share a name, so their key is the
    path. Counts are combined before the shuffle, so a large file costs no more than a small one.
    """
    counts = chunks.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_chunks"), F.count_if(F.col("valid")).alias("n_valid")
    )
    failed = F.bool_or("failed") if "failed" in files.columns else F.lit(False)
    name = [] if key == "source" else [F.min("source").alias("source")]
    found = files.groupBy(key).agg(
        F.bool_or("accepted").alias("accepted"), failed.alias("failed"), *name
    )
    n_chunks, n_valid = (F.coalesce(c, F.lit(0)) for c in ("n_chunks", "n_valid"))
    status = (
        F.when(~F.col("accepted"), SKIPPED)
        .when(F.col("failed"), ERROR)
        .when(n_chunks == 0, NO_TEXT)
        .when(n_valid == 0, NO_EMBEDDING)
        .otherwise(STORED)
    )
    columns = dict.fromkeys([key, "source"])
    return found.join(counts, key, "left").select(
        *columns, n_chunks.alias("n_chunks"), n_valid.alias("n_valid"), status.alias("status")
    )


def ingest_folder(
    spark: SparkSession,
    root: str,
    path: str,
    build_reader: BuildModel,
    suffix: str = ".pdf",
    config: RetrievalConfig = INGEST,
    batch: int = 0,
    dim: int = VECTOR_SIZE,
    metric: str = "cosine",
    build_model: BuildModel | None = None,
) -> DataFrame:
    """Folder in, collection out: scan, read, chunk, embed, store; returns the report.

    (doc_id, source, n_chunks, n_valid, status), one row per file: doc_id stands for the path, so files of one name are
    apart. Texts and vectors are made once.
    """
    return _store_folder(
        spark, root, path, build_reader, suffix, batch, dim, metric,
        lambda docs: embedded_chunks(docs, config, build_model, dim),
    )


def index_folder(
    spark: SparkSession,
    root: str,
    path: str,
    build_reader: BuildModel,
    suffix: str = ".pdf",
    config: RetrievalConfig = ASK,
    batch: int = 0,
    dim: int = VECTOR_SIZE,
    metric: str = "cosine",
    build_model: BuildModel | None = None,
) -> DataFrame:
    """Folder in, index out: as `ingest_folder`, with the recursive chunks of `build_index`."""
    return _store_folder(
        spark, root, path, build_reader, suffix, batch, dim, metric,
        lambda docs: recursive_chunks(docs, config, build_model, dim),
    )


def _store_folder(
    spark: SparkSession,
    root: str,
    path: str,
    build_reader: BuildModel,
    suffix: str,
    batch: int,
    dim: int,
    metric: str,
    embedded: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    scan = files.scan_files(spark, root, suffix)
    texts = cut_lineage(files.read_texts(scan, build_reader))
    chunks = cut_lineage(embedded(texts.select("doc_id", "text", "source")))
    collection.ensure_collection(spark, path, dim, metric)
    collection.upsert(as_points(chunks), path, batch)
    empty = files.empty_files(scan).select(
        F.xxhash64("path").alias("doc_id"),
        F.element_at(F.split("path", "/"), -1).alias("source"),
        F.lit(False).alias("failed"),
    )
    found = texts.select("doc_id", "source", "failed").unionByName(empty).withColumn("accepted", F.lit(True))
    return ingest_report(found, chunks.select("doc_id", F.col("embedding").isNotNull().alias("valid")), "doc_id")
