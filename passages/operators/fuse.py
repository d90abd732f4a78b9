"""Splicing lexical hits into the semantic ranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passages.config import VECTOR_SIZE
from passages.operators import topk
from passages.operators.embed import Model
from passages.operators.lexical import LexicalIndex, bm25_hits
from passages.operators.vector import known_source, semantic_hits


def splice(semantic: DataFrame, lexical: DataFrame, k: int) -> DataFrame:
    """Insert all lexical hits at place k of the semantic list; nothing is merged or dropped.

    Both sides have (query_id, rank, id, ...); k is cut to the length of the semantic list.
    The result has `pos`, from 0. The window holds the hits of one query only.
    """
    columns = [c for c in semantic.columns if c in lexical.columns]
    both = semantic.select(*columns, F.lit(False).alias("_lexical")).unionByName(
        lexical.select(*columns, F.lit(True).alias("_lexical"))
    )
    of_query = W.partitionBy("query_id")
    n_lexical = F.count_if(F.col("_lexical")).over(of_query)
    n_semantic = F.count_if(~F.col("_lexical")).over(of_query)
    place = F.col("rank") - 1
    pos = (
        F.when(F.col("_lexical"), F.least(F.lit(k), n_semantic) + place)
        .when(place < k, place)
        .otherwise(place + n_lexical)
    )
    return both.withColumn("pos", pos.cast("int")).drop("rank", "_lexical")


def hybrid_hits(
    queries: DataFrame,
    points: DataFrame,
    index: LexicalIndex | None,
    vector_k: int = 5,
    lexical_k: int = 1,
    dim: int = VECTOR_SIZE,
    metric: str = "cosine",
    build_embedder: Callable[[], Model] | None = None,
) -> DataFrame:
    """(query_id, pos, id): vector hits with the lexical hits spliced in, if there is an index."""
    semantic = semantic_hits(queries, points, vector_k, dim, metric, build_embedder).drop("score")
    if index is None:
        return semantic.select("query_id", (F.col("rank") - 1).alias("pos"), "id")
    lexical = bm25_hits(queries, index, lexical_k).drop("score")
    return splice(semantic, lexical, lexical_k).select("query_id", "pos", "id")


def hybrid_search(
    queries: DataFrame,
    points: DataFrame,
    index: LexicalIndex | None,
    vector_k: int = 5,
    lexical_k: int = 1,
    dim: int = VECTOR_SIZE,
    metric: str = "cosine",
    build_embedder: Callable[[], Model] | None = None,
) -> DataFrame:
    """`hybrid_hits` with the stored payload: (query_id, pos, id, text, source)."""
    hits = hybrid_hits(queries, points, index, vector_k, lexical_k, dim, metric, build_embedder)
    payload = points.select("id", "text", known_source().alias("source"))
    bounded = queries.select("query_id").count() * (vector_k + lexical_k) <= topk.BROADCAST_HITS
    return topk.attach(hits, payload, bounded).select("query_id", "pos", "id", "text", "source")
