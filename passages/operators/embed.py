"""Texts to vectors: the batched model hook and the built-in hashing embedder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passages.config import EMBED_BATCH, VECTOR_SIZE
from passages.functions.cuts import ANY_SCRIPT, cut_words, parts_of
from passages.functions.text import word_text

Model = Callable[[list], Sequence]

# Entries of the sums that a task holds at a time.
SUM_CELLS = 500_000


def batch_infer(
    df: DataFrame,
    build_model: Callable[[], Model],
    in_col: str,
    out_col: str,
    out_type: T.DataType,
    batch_size: int = EMBED_BATCH,
    error_col: str | None = None,
    alone: bool = False,
) -> DataFrame:
    """Run a model over `in_col` in batches of `batch_size`; a failed batch gives nulls.

    `build_model` is called once per task and returns list -> list. A batch that raises, or
    returns the wrong number of results, costs its own rows only; later batches go on. Only
    `in_col` goes to Python. `error_col` takes the reason of a row without a result. With
    `alone`, the items of a failed batch are tried one by one, so that the reason stands at the
    items that the model refuses and nowhere else.
    """
    kind = T.StructType([T.StructField("value", out_type), T.StructField("error", T.StringType())])

    @F.pandas_udf(kind)
    def infer(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = build_model()

        def tried(batch: list) -> list[tuple]:
            try:
                answer = list(model(batch))
                if len(answer) != len(batch):
                    raise ValueError(f"{len(answer)} results for {len(batch)} items")
                return [(value, None) for value in answer]
            except Exception as error:
                if alone and len(batch) > 1:
                    return [result for item in batch for result in tried([item])]
                return [(None, f"{type(error).__name__}: {error}")] * len(batch)

        for column in columns:
            items = column.tolist()
            results = [r for start in range(0, len(items), batch_size) for r in tried(items[start : start + batch_size])]
            value, error = zip(*results) if results else ((), ())
            yield pd.DataFrame({"value": pd.Series(value, dtype=object), "error": pd.Series(error, dtype=object)})

    # Not to be repeated by the optimizer: a model call is dear and may differ next time.
    done = df.withColumn("_inferred", infer.asNondeterministic()(in_col)).withColumn(out_col, F.col("_inferred.value"))
    if error_col is not None:
        done = done.withColumn(error_col, F.col("_inferred.error"))
    return done.drop("_inferred")


def _bucket_and_sign(words: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """From a word's md5 digest: hex digits 1-7 give the bucket, digit 8 the sign."""
    binary = pa.large_binary() if pa.types.is_large_string(words.type) else pa.binary()
    digests = b"".join([hashlib.md5(w).digest()[:4] for w in words.cast(binary).to_pylist()])
    first = np.frombuffer(digests, ">u4").astype(np.int64)
    return (first >> 4) % size, np.where(first & 8, -1.0, 1.0)


def hash_embedding(text: Column, size: int = VECTOR_SIZE) -> Column:
    """Signed feature hashing into `size` dimensions, scaled to length one.

    The JVM turns letters to lower case and blanks what is none in scripts other than ASCII; one vectorised pass per
    Arrow batch cuts its words (those of `words`), hashes the distinct ones and adds them up. The vector stays on its row, so nothing is shuffled. No words: the zero vector.
    """

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def add_up(texts: pa.Array) -> pa.Array:
        n = len(texts)
        out = np.empty((n, size), np.float32)
        # Words are cut, and the sums made, for a few rows at a time; only the result has an entry per row of the batch and dimension.
        step = max(1, SUM_CELLS // size)
        for first, end in parts_of(texts):
            doc, words = cut_words(texts.slice(first, end - first), ANY_SCRIPT)
            buckets, signs = _bucket_and_sign(words.dictionary, size)
            which = words.indices.to_numpy()
            for top in range(0, end - first, step):
                rows = min(step, end - first - top)
                here = slice(*np.searchsorted(doc, (top, top + rows)))
                cells = (doc[here] - top) * size + buckets[which[here]]
                sums = np.bincount(cells, weights=signs[which[here]], minlength=rows * size)
                sums = sums.astype(np.float64).reshape(rows, size)
                norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
                unit = np.divide(sums, norms, out=np.zeros_like(sums), where=norms > 0)
                out[first + top : first + top + rows] = unit
        starts = pa.array(np.arange(0, n * size + 1, size, dtype=np.int32))
        return pa.ListArray.from_arrays(starts, pa.array(out.ravel()))

    return add_up(F.coalesce(word_text(text), F.lit("")))


def embed_texts(
    df: DataFrame, text_col: str = "text", out: str = "embedding", size: int = VECTOR_SIZE
) -> DataFrame:
    return df.withColumn(out, hash_embedding(F.col(text_col), size))


def embed_with(
    df: DataFrame,
    build_model: Callable[[], Model] | None = None,
    text_col: str = "text",
    size: int = VECTOR_SIZE,
) -> DataFrame:
    """Adds `embedding` and `error`, by a model of texts -> vectors or the built-in embedder.

    What the model refuses has no vector, and the reason in `error`.
    """
    if build_model is None:
        return embed_texts(df, text_col, "embedding", size).withColumn("error", F.lit(None).cast("string"))
    vector = T.ArrayType(T.FloatType())
    return batch_infer(df, build_model, text_col, "embedding", vector, error_col="error", alone=True)


def nonzero_buckets(df: DataFrame, key: str, vector_col: str = "embedding") -> DataFrame:
    """Sparse view of the vectors: one row (key, bucket, value) per non-zero entry."""
    entries = F.transform(vector_col, lambda x, i: F.struct(i.alias("bucket"), x.alias("value")))
    nonzero = F.filter(entries, lambda e: e["value"] != 0)
    return df.select(key, F.inline(nonzero))


def valid_embeddings(df: DataFrame, vector_col: str = "embedding") -> DataFrame:
    return df.where(F.col(vector_col).isNotNull())
