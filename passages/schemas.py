"""Table schemas. Row order carries no meaning; rank, pos and chunk_no columns do."""

from __future__ import annotations

from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("source", T.StringType()),
    ]
)

POINTS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("text", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("ingest_batch", T.LongType()),
    ]
)

COLLECTION_META = T.StructType(
    [
        T.StructField("version", T.LongType()),
        T.StructField("data_dir", T.StringType()),
        T.StructField("dim", T.IntegerType()),
        T.StructField("metric", T.StringType()),
    ]
)

ANSWERS = T.StructType(
    [
        T.StructField("question", T.StringType()),
        T.StructField("sources", T.ArrayType(T.StringType())),
        T.StructField("document_ids", T.ArrayType(T.StringType())),
        T.StructField("answer", T.StringType()),
    ]
)

FILES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)

REPORT = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chunks", T.LongType()),
        T.StructField("n_valid", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("ingest_batch", T.LongType()),
    ]
)
