"""Vector search over one-byte vectors with error bounds: a compressed first pass, exact scores for what it leaves.

A stored vector u is kept as whole numbers c of one byte and a scale s, with the length e of what s * c leaves out.
For a query q the product q.u lies within e * |q| of s * (q.c), whatever the data look like. The first pass
keeps, per task and query, the k best lower bounds; a row whose upper bound is below the k-th of them cannot be a hit.
The rows that are left, a few more than k for each query, are scored on the stored vectors. So the hits are those of
the exact search, and the share of rows that are scored twice follows from e alone, also for vectors that are
spread evenly, where buckets prune nothing.

Rows that lie close together, such as the members of a crowd of near copies, all have overlapping bounds at one byte. So what
s * c leaves out is kept as one byte more per entry, and a row that is not ruled out at one byte is judged again at two: few
are left of a crowd, however large it is.

The first pass reads two bytes for each entry. Neither bytes nor vectors are shuffled: bounds and ids are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passages.config import VECTOR_SIZE
from passages.functions import vectors
from passages.operators import topk
from passages.operators.vector import as_metric, matrix_of, of_length, query_cells, unit_rows
from passages.session import new_folder

STEPS = 127
#: Exact scores are rounded to six digits, so rows this close may tie.
TIE = 1e-6
#: Relative error of a product in single precision, for each entry.
SINGLE = 1.2e-7
ROWS = 4_096
#: Scores that a task holds at a time, and candidates that it keeps before it hands them on.
CELLS = 1_000_000
ROOM = 2_000_000
#: Candidates in a batch that a task hands on.
HANDED = 100_000
#: Relative error of a product in double precision, for each entry.
DOUBLE = 2.3e-16
INDEX = "codes binary, scale float, error float, square double, fine binary, rest float"


def quantized_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scales and error lengths (rounded up) of the rows of a matrix."""
    scale = (np.abs(x).max(axis=1, initial=0.0) / STEPS).astype(np.float32)
    scale = np.maximum(scale, np.finfo(np.float32).tiny)
    codes = np.clip(np.rint(x / scale[:, None].astype(float)), -STEPS, STEPS).astype(np.int8)
    rest = x - codes * scale[:, None].astype(float)
    error = np.sqrt((rest * rest).sum(axis=1)) * (1 + 1e-6)
    return codes, scale, np.nextafter(error.astype(np.float32), np.float32(np.inf))


def fine_rows(x: np.ndarray, codes: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of what `quantized_rows` leaves out, in steps of scale / (2 * STEPS), and the lengths (rounded up) that these leave."""
    step = (scale.astype(float) / (2 * STEPS))[:, None]
    left = x - codes * scale[:, None].astype(float)
    fine = np.clip(np.rint(left / step), -STEPS, STEPS).astype(np.int8)
    left = left - fine * step
    rest = np.sqrt((left * left).sum(axis=1)) * (1 + 1e-6)
    return fine, np.nextafter(rest.astype(np.float32), np.float32(np.inf))


def build_quantized_index(points: DataFrame, dim: int = VECTOR_SIZE, metric: str = "cosine") -> DataFrame:
    """(id, codes, scale, error, square, fine, rest) of the points (id, embedding) of the dimension; write it to keep it.

    Points are narrowed on their row. Missing vectors, other lengths and entries that are no finite numbers are left out.
    """
    vectors.check_metric(metric)
    kind = points.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        usable = of_length(dim)
        for batch in batches:
            table = usable(pa.Table.from_batches([batch]))
            x = matrix_of(table["embedding"], dim)
            good = np.isfinite(x).all(axis=1)
            x, ids = x[good], table["id"].filter(pa.array(good)).combine_chunks()
            x = unit_rows(x) if metric == "cosine" else x
            codes, scale, error = quantized_rows(x)
            fine, rest = fine_rows(x, codes, scale)
            bounds = pa.py_buffer((dim * np.arange(len(x) + 1)).astype(np.int32))
            packed, finer = (
                pa.Array.from_buffers(pa.binary(), len(x), [None, bounds, pa.py_buffer(np.ascontiguousarray(c))]) for c in (codes, fine)
            )
            columns = [ids, packed, pa.array(scale), pa.array(error), pa.array((x * x).sum(axis=1)), finer, pa.array(rest)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "codes", "scale", "error", "square", "fine", "rest"])

    return points.select("id", "embedding").mapInArrow(run, f"id {kind}, {INDEX}")


def codes_of(table: pa.RecordBatch, column: str, dim: int) -> np.ndarray:
    packed = table.column(column)
    first = packed.offset * dim
    return np.frombuffer(packed.buffers()[2], np.int8)[first : first + len(table) * dim].reshape(-1, dim)


def bounds_of(table: pa.RecordBatch, q: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(middle, reach): the score of row and query, larger is better, lies within reach of the middle.

    For euclid the score is 2 * product - square, which falls with the distance.
    """
    dim = q.shape[1]
    codes = codes_of(table, "codes", dim)
    scale, error = (table.column(c).to_numpy().astype(float) for c in ("scale", "error"))
    middle = (codes.astype(np.float32) @ q.T.astype(np.float32)).astype(float) * scale[:, None]
    size = np.sqrt((q * q).sum(axis=1))
    rounding = SINGLE * dim * STEPS * np.sqrt(dim) * scale
    reach = (error + rounding)[:, None] * size
    if metric == "euclid":
        return 2 * middle - table.column("square").to_numpy()[:, None], 2 * reach
    return middle, reach


class Finer:
    """Middle and reach, as `bounds_of` gives them, of pairs of a row and a query at two bytes for each entry."""

    def __init__(self, table: pa.RecordBatch, dim: int, metric: str):
        self.metric = metric
        scale, self.rest = (table.column(c).to_numpy().astype(float) for c in ("scale", "rest"))
        step = (scale / (2 * STEPS))[:, None]
        self.x = codes_of(table, "codes", dim) * scale[:, None] + codes_of(table, "fine", dim) * step
        self.rounding = DOUBLE * (dim + 4) * np.sqrt((self.x * self.x).sum(axis=1))
        self.square = table.column("square").to_numpy()

    def __call__(self, q: np.ndarray, row: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        middle = np.empty(len(row))
        step = max(1, CELLS // max(1, q.shape[1]))
        for a in range(0, len(row), step):
            part = slice(a, a + step)
            middle[part] = np.einsum("ij,ij->i", self.x[row[part]], q[query[part]])
        reach = (self.rest + self.rounding)[row] * np.sqrt((q * q).sum(axis=1))[query]
        if self.metric == "euclid":
            # The square is that of the stored vector, rounded.
            return 2 * middle - self.square[row], 2 * reach + 4 * DOUBLE * q.shape[1] * self.square[row]
        return middle, reach


class Survivors:
    """Rows that can still be among the k best of a query, with the k best lower bounds so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.edge = np.full(queries, -np.inf)
        self.lows = np.full((queries, k), -np.inf)
        self.parts: list[tuple] = []
        self.held = 0

    def add(
        self, ids: pa.Array, middle: np.ndarray, reach: np.ndarray, tie: np.ndarray, first: int = 0, finer: Callable | None = None
    ) -> None:
        """Rows against a block of queries, of which `first` is the number of the first; `tie` is for all queries.

        `finer` gives nearer (middle, reach) of pairs (row, query), for those that the given ones do not rule out.
        """
        here = slice(first, first + middle.shape[1])
        if not np.isfinite(self.edge[here]).all():
            self._raise(middle - reach, here)
        high = middle + reach
        row, query = np.nonzero(high >= (self.edge[here] - tie[here])[None, :])
        if finer is None:
            keep, top = middle[row, query] - reach[row, query], high[row, query]
        else:
            near, off = finer(row, query)
            keep, top = near - off, near + off
        query = query + first
        better = keep > self.edge[query]
        if better.any():
            self._merge(query[better], keep[better])
        use = top >= (self.edge - tie)[query]
        if use.any():
            self.parts.append((query[use], ids.take(pa.array(row[use])), keep[use], top[use]))
            self.held += int(use.sum())

    def _raise(self, low: np.ndarray, here: slice) -> None:
        """Before any bound is known: the k-th best lower bound of the rows at hand, so that few rows pass."""
        if len(low) >= self.k:
            best = np.partition(low, len(low) - self.k, axis=0)[len(low) - self.k]
            self.edge[here] = np.maximum(self.edge[here], np.nextafter(best, -np.inf))

    def _merge(self, query: np.ndarray, low: np.ndarray) -> None:
        touched = np.unique(query)
        owner = np.r_[np.repeat(touched, self.k), query]
        value = np.r_[self.lows[touched].ravel(), low]
        order = np.lexsort((-value, owner))
        at = np.searchsorted(owner[order], touched)[:, None] + np.arange(self.k)
        self.lows[touched] = value[order][at]
        self.edge[touched] = np.maximum(self.edge[touched], self.lows[touched, -1])

    def rows(self, tie: np.ndarray) -> Iterator[tuple]:
        for query, ids, low, high in self.parts:
            use = high >= (self.edge - tie)[query]
            if use.any():
                yield query[use], ids.filter(pa.array(use)), low[use], high[use]

    def shrink(self, tie: np.ndarray) -> int:
        self.parts = list(self.rows(tie))
        self.held = sum(len(p[0]) for p in self.parts)
        return self.held

    def take(self, tie: np.ndarray) -> Iterator[tuple]:
        """The rows that are left so far, in parts of some HANDED; they are no longer held."""
        few, rows = [], 0

        def joined() -> tuple:
            query, ids, low, high = zip(*few)
            return np.concatenate(query), pa.concat_arrays(ids), np.concatenate(low), np.concatenate(high)

        for part in self.rows(tie):
            few.append(part)
            rows += len(part[0])
            if rows >= HANDED:
                yield joined()
                few, rows = [], 0
        if few:
            yield joined()
        self.parts, self.held = [], 0


def candidates(queries: DataFrame, index: DataFrame, k: int, metric: str = "cosine", dim: int = VECTOR_SIZE) -> DataFrame:
    """(query_id, id) of all rows that can be among the k best: the first pass.

    queries (query_id, embedding) of the dimension; a count has shown that they may travel whole. An index that was stored
    without `fine` is judged at one byte alone.
    """
    two = "fine" in index.columns
    wanted = queries.toArrow()
    numbers = matrix_of(wanted["embedding"], dim)
    good = np.isfinite(numbers).all(axis=1)
    numbers, names = numbers[good], wanted["query_id"].filter(pa.array(good)).combine_chunks()
    numbers = unit_rows(numbers) if metric == "cosine" else numbers
    shared = index.sparkSession.sparkContext.broadcast((numbers, names))
    kinds = queries.schema["query_id"].dataType.simpleString(), index.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, query_ids = shared.value
        if not len(q):
            return
        # A difference of distances of TIE is one of 2 * distance * TIE between their squares.
        size = np.sqrt((q * q).sum(axis=1))
        found, largest = Survivors(len(q), k), 0.0
        tie = np.full(len(q), 2 * TIE)

        def rows() -> Iterator[pa.RecordBatch]:
            for query, ids, low, high in found.take(tie):
                columns = [query_ids.take(pa.array(query)), ids, pa.array(low), pa.array(high + tie[query])]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "id", "low", "high"])

        for batch in batches:
            for top in range(0, batch.num_rows, ROWS):
                part = batch.slice(top, ROWS)
                if metric == "euclid":
                    largest = max(largest, float(np.sqrt(part.column("square").to_numpy().max(initial=0.0))))
                    tie = 4 * TIE * (largest + size + 1)
                step = max(1, CELLS // max(1, part.num_rows))
                near = Finer(part, dim, metric) if two else None
                for first in range(0, len(q), step):
                    asked = q[first : first + step]
                    found.add(part.column("id"), *bounds_of(part, asked, metric), tie, first, near and partial(near, asked))
                    # The bounds stay, so rows that are handed on early only add to those that the next stage drops.
                    if found.held > ROOM and found.shrink(tie) > ROOM // 2:
                        yield from rows()
        yield from rows()

    left = index.mapInArrow(run, f"query_id {kinds[0]}, id {kinds[1]}, low double, high double")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("low").desc()))
    edge = F.max(F.when(F.col("place") == k, F.col("low"))).over(W.partitionBy("query_id"))
    ranked = left.withColumn("place", place).withColumn("edge", edge)
    return ranked.where("edge is null or high >= edge").select("query_id", "id")


def knn_quantized(
    queries: DataFrame,
    index: DataFrame,
    points: DataFrame,
    k: int = 5,
    metric: str = "cosine",
    dim: int = VECTOR_SIZE,
) -> DataFrame:
    """The k nearest points for every query vector: (query_id, rank, id, score), as `knn_join` gives them.

    `index` is `build_quantized_index` of the points, for the same metric.
    """
    return topk.rank_hits(scored_candidates(queries, index, points, k, metric, dim), k).withColumn(
        "score", as_metric(F.col("score"), metric)
    )


def scored_candidates(
    queries: DataFrame, index: DataFrame, points: DataFrame, k: int, metric: str = "cosine", dim: int = VECTOR_SIZE
) -> DataFrame:
    """(query_id, id, score), larger is better, of every row that the first pass leaves.

    Candidates are stored and counted; slices of them that may travel whole meet the points where these lie, one slice after
    the other: their scores are stored, so that no task ever has more than one slice at hand.
    """
    vectors.check_metric(metric)
    wanted = queries.where(F.size("embedding") == dim).select("query_id", "embedding")
    spark = queries.sparkSession
    if k <= 0:
        return spark.createDataFrame([], topk.partial_schema(index, queries))
    folder = new_folder(spark, "candidates")
    topk.in_slices(
        wanted, query_cells(wanted, dim), lambda part: candidates(part, index, k, metric, dim)
    ).write.parquet(folder)
    found = spark.read.parquet(folder)
    slices = max(1, -(-found.count() // topk.BROADCAST_HITS))
    vectors_of = wanted.withColumnRenamed("embedding", "asked")
    narrow = points.select("id", "embedding")
    small, schema = _small(vectors_of, dim), topk.partial_schema(index, queries)

    def scored(part: DataFrame) -> DataFrame:
        met = narrow.join(F.broadcast(part), "id").join(small, "query_id")
        return met.mapInArrow(_exact(metric, dim), schema)

    if slices == 1:
        return scored(found)
    for s in range(slices):
        part = found.where(F.pmod(F.xxhash64("query_id", "id"), F.lit(slices)) == s)
        scored(part).write.mode("overwrite").parquet(f"{folder}-scored/part={s}")
    return spark.read.schema(schema).parquet(f"{folder}-scored").select(schema.names)


def _small(queries: DataFrame, dim: int) -> DataFrame:
    return F.broadcast(queries) if topk.fits_broadcast(query_cells(queries, dim)) else queries


def _exact(metric: str, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            x, q = matrix_of(table["embedding"], dim), matrix_of(table["asked"], dim)
            if metric == "euclid":
                score = -np.sqrt(((x - q) ** 2).sum(axis=1))
            else:
                x, q = (unit_rows(x), unit_rows(q)) if metric == "cosine" else (x, q)
                score = (x * q).sum(axis=1)
            columns = [batch.column("query_id"), batch.column("id"), pa.array(topk.round_scores(score))]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "id", "score"])

    return run
