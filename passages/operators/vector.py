"""Vector search: one query, a table of queries, and the approximate path."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passages.config import UNKNOWN_SOURCE, VECTOR_SIZE
from passages.functions import vectors
from passages.operators import topk
from passages.operators.embed import Model, embed_with
from passages.session import cut_lineage


# Differences of vectors that a task holds at a time.
DIFFERENCES = 1_000_000

# Relative rounding of a number, and the products beyond which single precision may overflow or vanish.
SINGLE = 1.2e-7
DOUBLE = 2.3e-16
LARGE = 1e12


def known_source(source: str | Column = "source") -> Column:
    return F.coalesce(F.col(source) if isinstance(source, str) else source, F.lit(UNKNOWN_SOURCE))


def vector_topk(
    points: DataFrame, query: Sequence[float], k: int = 5, metric: str = "cosine"
) -> DataFrame:
    """The k best points for one vector: (rank, id, text, source, score)."""
    literal = F.lit([float(x) for x in query])
    best = (
        points.where(F.size("embedding") == len(query))
        .select("id", vectors.score(F.col("embedding"), literal, metric).alias("score"))
        .orderBy(vectors.best_first(F.col("score"), metric), "id")
        .limit(k)
    )
    # At most k rows are left here, so the window without a partition is small.
    order = W.orderBy(vectors.best_first(F.col("score"), metric), "id")
    ranked = best.withColumn("rank", F.row_number().over(order))
    payload = points.select("id", "text", known_source().alias("source"))
    return topk.attach(ranked, payload, k <= topk.BROADCAST_HITS).select(
        "rank", "id", "text", "source", "score"
    )


def matrix_of(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, width)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def of_length(width: int) -> topk.Usable:
    """Drops rows whose vector is missing or has another length."""

    def usable(table: pa.Table) -> pa.Table:
        fits = pc.equal(pc.list_value_length(table["embedding"]), width)
        return table.filter(pc.fill_null(fits, False))

    return usable


class DenseScorer(topk.Scorer):
    """Corpus vectors against query vectors; a distance is negated, larger is better.

    The quick scores are products in single precision, for a distance those of its square.
    """

    def __init__(self, width: int, metric: str):
        self.width, self.metric = width, metric

    def corpus(self, table: pa.Table) -> tuple:
        x = matrix_of(table["embedding"], self.width)
        x = unit_rows(x) if self.metric == "cosine" else x
        squares = (x * x).sum(axis=1)
        with np.errstate(over="ignore"):
            return x, x.astype(np.float32), squares, np.sqrt(np.nanmax(squares, initial=0.0))

    queries = corpus

    def quick(self, x: tuple, q: tuple) -> tuple[np.ndarray, np.ndarray]:
        size = np.sqrt(q[2])
        with np.errstate(over="ignore", invalid="ignore"):
            if x[3] * q[3] < LARGE and 1 / LARGE < x[3] * q[3]:
                product, unit = x[1] @ q[1].T, SINGLE
            else:
                product, unit = x[0] @ q[0].T, DOUBLE
            if self.metric != "euclid":
                return product, unit * (self.width + 4) * x[3] * size
            # The sum of squares less twice the product cancels for near vectors; the slack covers that.
            product *= 2
            product -= x[2].astype(product.dtype)[:, None]
            product -= q[2].astype(product.dtype)[None, :]
            return product, 2 * unit * (self.width + 8) * (x[3] + size) ** 2

    def least(self, edge: np.ndarray) -> np.ndarray:
        least = super().least(edge)
        return -(least * least) if self.metric == "euclid" else least

    def edge(self, quick: np.ndarray) -> np.ndarray:
        return -np.sqrt(np.maximum(-quick, 0.0)) if self.metric == "euclid" else quick

    def exact(self, x: tuple, q: tuple, row: np.ndarray, query: np.ndarray, quick: np.ndarray) -> np.ndarray:
        out = np.empty(len(row))
        step = max(1, DIFFERENCES // max(1, self.width))
        for a in range(0, len(row), step):
            here, there = x[0][row[a : a + step]], q[0][query[a : a + step]]
            if self.metric == "euclid":
                here = here - there
                out[a : a + step] = -np.sqrt(np.einsum("ij,ij->i", here, here))
            else:
                out[a : a + step] = np.einsum("ij,ij->i", here, there)
        return out

    def copies(self, x: tuple, k: int) -> np.ndarray | None:
        """Of equal vectors only the k first rows can be hits."""
        with np.errstate(over="ignore", invalid="ignore"):
            mark = x[0] @ np.random.default_rng(1).random(self.width)
        order = np.argsort(mark, kind="stable")
        x = x[0][order]
        same = np.r_[False, (x[1:] == x[:-1]).all(axis=1)]
        starts = np.flatnonzero(~same)
        place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
        return np.sort(order[place < k]) if (place >= k).any() else None


def dense_scorer(width: int, metric: str) -> topk.Scorer:
    return DenseScorer(width, metric)


def as_metric(score: Column, metric: str) -> Column:
    """A rank score as similarity or distance."""
    # 0.0 - x, not -x: a distance of zero must not turn into minus zero.
    return F.lit(0.0) - score if metric == "euclid" else score


def query_cells(queries: DataFrame, dim: int) -> int:
    return queries.select("query_id").count() * dim


def knn_join(
    queries: DataFrame, points: DataFrame, k: int = 5, metric: str = "cosine", dim: int = VECTOR_SIZE
) -> DataFrame:
    """Exact k nearest points for every query vector: (query_id, rank, id, score).

    Rows whose vector is missing or has another length cannot be compared and are left out.
    """
    vectors.check_metric(metric)
    hits = topk.top_k(
        points.select("id", "embedding"),
        queries.where(F.size("embedding") == dim).select("query_id", "embedding"),
        dense_scorer(dim, metric),
        k,
        query_cells(queries, dim),
        of_length(dim),
    )
    return hits.withColumn("score", as_metric(F.col("score"), metric))


def embed_queries(
    queries: DataFrame, dim: int = VECTOR_SIZE, build_embedder: Callable[[], Model] | None = None
) -> DataFrame:
    """Questions that the embedder refuses have a null vector, and no hits."""
    return embed_with(queries, build_embedder, "query", dim).drop("error")


def semantic_search(
    queries: DataFrame,
    points: DataFrame,
    k: int = 5,
    dim: int = VECTOR_SIZE,
    metric: str = "cosine",
    build_embedder: Callable[[], Model] | None = None,
) -> DataFrame:
    """Embed the query texts, then the k nearest points: (query_id, rank, id, text, source).

    `dim` and `metric` are those of the collection (`collection.settings`), the embedder is that of its points.
    """
    hits = semantic_hits(queries, points, k, dim, metric, build_embedder)
    payload = points.select("id", "text", known_source().alias("source"))
    bounded = queries.select("query_id").count() * k <= topk.BROADCAST_HITS
    return topk.attach(hits, payload, bounded).select("query_id", "rank", "id", "text", "source")


def semantic_hits(
    queries: DataFrame,
    points: DataFrame,
    k: int = 5,
    dim: int = VECTOR_SIZE,
    metric: str = "cosine",
    build_embedder: Callable[[], Model] | None = None,
) -> DataFrame:
    """As `semantic_search`, but ids and scores only."""
    return knn_join(embed_queries(queries, dim, build_embedder), points, k, metric, dim)


def split_by_dim(points: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by vector length; a missing vector is rejected."""
    fits = F.coalesce(F.size("embedding") == dim, F.lit(False))
    return points.where(fits), points.where(~fits)


def knn_lsh(
    queries: DataFrame,
    points: DataFrame,
    k: int = 5,
    dim: int = VECTOR_SIZE,
    bucket_length: float = 1.0,
    tables: int = 8,
    seed: int = 42,
) -> DataFrame:
    """Approximate cosine search for query tables too large to meet every point.

    Unit vectors are hashed by random projections; points and queries meet per (table,
    bucket). A bucket is dealt out to as many parts as its size asks for, and a part gives
    only its k best points per query, so a crowded bucket neither lands in one task nor
    turns into pairs. Scores are exact. A query that meets fewer than k points in its
    buckets is answered by the exact search.
    """
    fit = F.size("embedding") == dim

    def hashed(df: DataFrame, key: str) -> DataFrame:
        return df.where(fit).select(
            key, "embedding", array_to_vector(vectors.unit(F.col("embedding"))).alias("_unit")
        )

    corpus, wanted = hashed(points, "id"), hashed(queries, "query_id")
    model = BucketedRandomProjectionLSH(
        inputCol="_unit", outputCol="_hashes", bucketLength=bucket_length, numHashTables=tables, seed=seed
    ).fit(corpus)

    def buckets(df: DataFrame, key: str) -> DataFrame:
        return model.transform(df).select(
            key, "embedding", F.posexplode("_hashes").alias("_table", "_hash")
        ).select(key, "embedding", "_table", F.col("_hash").cast("string").alias("_bucket"))

    place = ["_table", "_bucket"]
    corpus_b, wanted_b = buckets(corpus, "id"), buckets(wanted, "query_id")
    met = _part_counts(corpus_b, "_cn").join(_part_counts(wanted_b, "_qn"), place)
    bounded = queries.select("query_id").count() * tables <= topk.BROADCAST_HITS
    corpus_p = _dealt(_met(corpus_b, met, "id", bounded), "id", "_c", "_cn", "_q", "_qn")
    wanted_p = _dealt(_met(wanted_b, met, "query_id", bounded), "query_id", "_q", "_qn", "_c", "_cn")
    near = topk.meet(
        corpus_p, wanted_p, [*place, "_c", "_q"], dense_scorer(dim, "cosine"), k
    )
    once = near.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    hits = cut_lineage(topk.rank_hits(once, k))

    answered = hits.groupBy("query_id").count().where(F.col("count") >= k)
    short = cut_lineage(wanted.select("query_id", "embedding").join(answered, "query_id", "left_anti"))
    exact = knn_join(short, points, k, "cosine", dim)
    return hits.join(answered.select("query_id"), "query_id", "left_semi").unionByName(exact)


def _part_counts(placed: DataFrame, out: str) -> DataFrame:
    parts = F.ceil(F.count(F.lit(1)) / topk.CORPUS_BLOCK_ROWS).cast("int")
    return placed.groupBy("_table", "_bucket").agg(parts.alias(out))


def _met(placed: DataFrame, met: DataFrame, key: str, bounded: bool, salt: int = 64) -> DataFrame:
    """Rows in buckets that both sides use, with the part numbers of their bucket.

    There are at most (queries x tables) such buckets: few are broadcast, so that rows in other
    buckets never leave their task; many are joined with a salt, for the crowded ones.
    """
    place = ["_table", "_bucket"]
    if bounded:
        return placed.join(F.broadcast(met), place)
    copies = met.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    salted = placed.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salt)).cast("int"))
    return salted.join(copies, [*place, "_salt"])


def _dealt(df: DataFrame, key: str, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
    return df.select(
        key,
        "embedding",
        "_table",
        "_bucket",
        F.pmod(F.xxhash64(key), F.col(own_n)).cast("int").alias(own),
        F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)).alias(other),
    )
