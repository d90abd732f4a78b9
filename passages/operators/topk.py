"""Top k of a large table for every row of a query table, without forming the pairs.

A task scores one Arrow batch of the corpus after the other against a block of queries as one
matrix. Of a matrix only the scores are looked at that reach the k-th best so far; the k best rows per query are
emitted at its end. Spark then ranks those partial results per query. The
shuffle carries k rows per query and task, whatever the size of the corpus, and the corpus
itself does not move.

The queries travel to the tasks as a broadcast when a count shows that they fit. A larger query
table is cut into slices that fit, and one slice after the other passes over the corpus; the hits of each
are written. So the corpus stays where it is at any size, and no more than a slice is ever on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passages.functions.vectors import SCORE_DIGITS
from passages.session import new_folder

# Bounds of what may travel whole: entries of the query block and rows of the result.
BROADCAST_CELLS = 8_000_000
BROADCAST_HITS = 500_000
CORPUS_BLOCK_ROWS = 50_000

# Sides of one score matrix in a task, and entries of the vectors that it is made from.
ROWS_PER_MATRIX = 10_000
QUERIES_PER_MATRIX = 256
CELLS_PER_BLOCK = 500_000
# Rows of the first matrix; the next ones double, so that the best scores are known early.
FIRST_ROWS = 512
# Scores are rounded to six digits, so those this close may tie.
TIE = 1e-6

Usable = Callable[[pa.Table], pa.Table]


class Scorer:
    """Scores of corpus rows against queries, larger is better, from a function of two tables.

    A scorer may instead give quick scores that are off by no more than `slack`, on a scale of its own, and the
    exact ones of the few rows that these leave. `width` is the number of entries per corpus row, which bounds the
    rows that a task works on at a time.
    """

    def __init__(self, score: Callable[[pa.Table, pa.Table], np.ndarray], width: int = 1):
        self.score, self.width = score, width

    def corpus(self, table: pa.Table):
        """What the scores need of these rows, made once for all queries."""
        return table

    def queries(self, table: pa.Table):
        return table

    def quick(self, x, q) -> tuple[np.ndarray, np.ndarray | float]:
        """(rows x queries) quick scores, and by how much those of each query may be off."""
        return self.score(x, q), 0.0

    def least(self, edge: np.ndarray) -> np.ndarray:
        """The quick score, but for the slack, that a row needs to round to the score `edge`."""
        return edge - TIE - 1e-12 * np.abs(edge)

    def edge(self, quick: np.ndarray) -> np.ndarray:
        """The score of a quick score."""
        return quick

    def exact(self, x, q, row: np.ndarray, query: np.ndarray, quick: np.ndarray) -> np.ndarray:
        """Scores of the pairs (row, query)."""
        return quick[row, query]

    def copies(self, x, k: int) -> np.ndarray | None:
        """The rows that are left when of equal rows only the first k stay; None: all."""
        return None


class Best:
    """The k best scores of each query so far: a row below the k-th of them cannot be a hit."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = np.full((queries, k), -np.inf)

    def edge(self, first: int, n: int) -> np.ndarray:
        return self.scores[first : first + n, -1]

    def add(self, query: np.ndarray, score: np.ndarray) -> None:
        better = score > self.scores[query, -1]
        query, score = query[better], score[better]
        if not len(query):
            return
        touched = np.unique(query)
        owner = np.r_[np.repeat(touched, self.k), query]
        value = np.r_[self.scores[touched].ravel(), score]
        order = np.lexsort((-value, owner))
        at = np.searchsorted(owner[order], touched)[:, None] + np.arange(self.k)
        self.scores[touched] = value[order][at]


def candidates(scorer: Scorer, x, q, rows: int, best: Best, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, query, rounded score) of all rows that can be hits of the block of queries that starts at `first`."""
    quick, slack = scorer.quick(x, q)
    edge = best.edge(first, quick.shape[1])
    if rows > best.k and not np.isfinite(edge).all():
        known = np.where(np.isnan(quick), -np.inf, quick)
        of_these = np.partition(known, rows - best.k, axis=0)[rows - best.k]
        edge = np.maximum(edge, scorer.edge(of_these.astype(float) - slack))
    reach = quick >= np.nextafter((scorer.least(edge) - slack).astype(quick.dtype), quick.dtype.type(-np.inf))
    if rows <= best.k:
        reach |= np.isnan(quick)
    row, query = np.divmod(np.flatnonzero(reach), quick.shape[1])
    score = round_scores(scorer.exact(x, q, row, query, quick))
    if rows > best.k:
        number = ~np.isnan(score)
        row, query, score = row[number], query[number], score[number]
    best.add(query + first, score)
    return row, query, score


def round_scores(scores: np.ndarray) -> np.ndarray:
    """Half away from zero, as round() does in SQL, so that ties are ties."""
    scale = 10.0**SCORE_DIGITS
    return np.copysign(np.floor(np.abs(scores) * scale + 0.5) / scale, scores) + 0.0


def best_rows(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest values of each column; the upper row wins a tie."""
    n = scores.shape[0]
    if k >= n:
        return tuple(np.indices(scores.shape).reshape(2, -1))
    edge = np.partition(scores, n - k, axis=0)[n - k]
    above = scores > edge
    level = scores == edge
    room = k - above.sum(axis=0)
    return np.nonzero(above | (level & (np.cumsum(level, axis=0) <= room)))


def _local_best(
    corpus: pa.Table, queries: pa.Table, scorer: Scorer, best: Best, seen: int = 0
) -> Iterator[pa.RecordBatch]:
    """Rows that can be among the k best, after `seen` other rows of the corpus."""
    top, most = 0, max(1, min(ROWS_PER_MATRIX, CELLS_PER_BLOCK // scorer.width))
    while top < corpus.num_rows:
        part = corpus.slice(top, min(most, max(FIRST_ROWS, seen + top)))
        top += part.num_rows
        part = part.take(pc.sort_indices(part["id"]))
        x = scorer.corpus(part)
        few = scorer.copies(x, best.k)
        if few is not None:
            part = part.take(pa.array(few))
            x = scorer.corpus(part)
        for start in range(0, queries.num_rows, QUERIES_PER_MATRIX):
            block = queries.slice(start, QUERIES_PER_MATRIX)
            rows, columns, scores = candidates(scorer, x, scorer.queries(block), part.num_rows, best, start)
            if len(rows):
                yield pa.RecordBatch.from_arrays(
                    [
                        block["query_id"].take(pa.array(columns)).combine_chunks(),
                        part["id"].take(pa.array(rows)).combine_chunks(),
                        pa.array(scores, pa.float64()),
                    ],
                    names=["query_id", "id", "score"],
                )


def _kept(
    tables: Iterator[pa.Table], queries: pa.Table, scorer: Scorer, k: int, usable: Usable | None
) -> list[pa.RecordBatch]:
    """The k best rows of each query, of all tables."""
    if usable is not None:
        queries = usable(queries)
    known = Best(queries.num_rows, k)
    best: list[pa.RecordBatch] = []
    rows, seen, room = 0, 0, 2 * k * max(1, queries.num_rows)
    for table in tables:
        if usable is not None:
            table = usable(table)
        for part in _local_best(table, queries, scorer, known, seen):
            best.append(part)
            rows += part.num_rows
            if rows > room:
                best = _best_of(best, k)
                rows = sum(b.num_rows for b in best)
        seen += table.num_rows
    return _best_of(best, k)


def _best_of(parts: list[pa.RecordBatch], k: int) -> list[pa.RecordBatch]:
    """The k best rows of each query."""
    if not parts:
        return []
    table = pa.Table.from_batches(parts)
    order = pc.sort_indices(table, [("query_id", "ascending"), ("score", "descending"), ("id", "ascending")])
    table = table.take(order).combine_chunks()
    query = table["query_id"].combine_chunks().dictionary_encode().indices.to_numpy()
    first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
    place = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
    return table.filter(pa.array(place < k)).to_batches()


def partial_schema(corpus: DataFrame, queries: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("id", corpus.schema["id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )


def rank_hits(partial: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, score), rank from 1; equal scores go by id."""
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return (
        partial.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "id", "score")
    )


def fits_broadcast(cells: int | None) -> bool:
    return (cells or 0) <= BROADCAST_CELLS


def top_k(
    corpus: DataFrame,
    queries: DataFrame,
    scorer: Scorer,
    k: int,
    query_cells: int | None,
    usable: Usable | None = None,
) -> DataFrame:
    """Best k corpus rows per query.

    corpus has `id`, queries has `query_id`; the other columns are for `scorer`. `query_cells` is the counted number of
    array entries in the query table and decides on the number of slices. `usable` drops
    rows that cannot be scored; it runs in the task, where the vector is at hand already.
    """
    if k <= 0:
        return rank_hits(
            corpus.sparkSession.createDataFrame([], partial_schema(corpus, queries)), 0
        )
    return in_slices(queries, query_cells, lambda part: rank_hits(_scan(corpus, part, scorer, k, usable), k))


def in_slices(queries: DataFrame, cells: int | None, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`search` of all queries; of slices of them, one after the other, if they are more than may travel whole.

    The slices are stored first, so that queries which come from a model are made once.
    """
    if fits_broadcast(cells):
        return search(queries)
    spark = queries.sparkSession
    slices = -(-cells // BROADCAST_CELLS)
    folder = new_folder(spark, "slices")
    number = F.pmod(F.xxhash64("query_id"), F.lit(slices)).cast("int")
    queries.withColumn("_slice", number).write.partitionBy("_slice").parquet(f"{folder}/queries")
    sliced = spark.read.schema(T.StructType([*queries.schema, T.StructField("_slice", T.IntegerType())])).parquet(f"{folder}/queries")
    for k in range(slices):
        hits = search(sliced.where(F.col("_slice") == k).drop("_slice"))
        schema = hits.schema
        hits.write.mode("overwrite").parquet(f"{folder}/hits/part={k}")
    return spark.read.schema(schema).parquet(f"{folder}/hits").select(schema.names)


def _scan(
    corpus: DataFrame, queries: DataFrame, scorer: Scorer, k: int, usable: Usable | None
) -> DataFrame:
    schema = partial_schema(corpus, queries)
    table = queries.toArrow()
    shared = corpus.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = (pa.Table.from_batches([batch]) for batch in batches)
        yield from _kept(tables, shared.value, scorer, k, usable)

    return corpus.mapInArrow(run, schema)


def meet(
    left: DataFrame,
    right: DataFrame,
    place: list[str],
    scorer: Scorer,
    k: int,
    usable: Usable | None = None,
) -> DataFrame:
    """Best k of each corpus group per query of the query group with the same `place`.

    The caller has cut the groups to bounded sizes.
    """
    schema = partial_schema(left, right)
    # New column identities, for two sides that come from one table.
    right = right.select(*[F.col(c).alias(c) for c in right.columns])

    def run(corpus: pa.Table, queries: pa.Table) -> pa.Table:
        # The k best for each row of the queries, also of those with one id.
        numbered = queries.set_column(queries.schema.get_field_index("query_id"), "query_id", pa.array(np.arange(queries.num_rows)))
        batches = _kept(iter([corpus]), numbered, scorer, k, usable)
        if batches:
            found = pa.Table.from_batches(batches)
            return found.set_column(0, "query_id", queries["query_id"].take(found["query_id"]))
        return pa.table(
            {
                "query_id": queries["query_id"].slice(0, 0),
                "id": corpus["id"].slice(0, 0),
                "score": pa.array([], pa.float64()),
            }
        )

    return left.groupBy(*place).cogroup(right.groupBy(*place)).applyInArrow(run, schema)


def attach(hits: DataFrame, points: DataFrame, bounded: bool) -> DataFrame:
    """Join text and source to the hits only, after the top k is known.

    `bounded` says that the number of hits was checked against BROADCAST_HITS.
    """
    side = F.broadcast(hits) if bounded else hits
    return points.join(side, "id")
