"""An inverted index for BM25: blocks of postings, kept by word, each with a bound on what it can add to a score.

Documents are numbered in the order of their ids, in blocks of at most BLOCK_DOCS; a posting is a place in its block. A row
of `postings` has the postings of one word in one block of documents, and the greatest saturated count among them.

Building: texts are dealt out by ranges of ids, once; a task cuts, counts and numbers the documents of its range. The
postings are then dealt out by the bucket of their word and, in a large corpus, by blocks, so that a word that most
documents have is not in one task; they are written by bucket and sorted by word: a search opens the buckets and row groups of its words.

Searching: the rows of the asked words meet by block of documents. A task goes through its blocks with the best k of
every query so far; for a block it adds up the bounds of the words of each query, and only queries that can still gain
a hit are scored on it. Documents without a match score zero and take part, as ids and numbers have one order:
a tie goes to the smaller number. So the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passages.functions.cuts import cut_words
from passages.operators import lexical, topk
from passages.session import drop_folder, new_folder

BLOCK_DOCS = 1_024
BLOCK_BYTES = 8 << 20
#: Documents per bucket of words, and the bounds of the number of buckets.
BUCKET_DOCS = 20_000
BUCKETS = (32, 4_096)
#: More asked words than this are joined and not listed in the filter of the scan.
LISTED_WORDS = 2_000
#: Scores are whole numbers of 1e-6; bounds are added in another order than scores.
BOUND_SLACK = 1e-5

#: Rows of a bucket are dealt to one task more for each so many documents.
DEAL_DOCS = 4_000_000

LISTS = "places array<int>, counts array<int>, lengths array<int>"
POSTINGS = f"term string, block long, best double, df int, {LISTS}, bucket int"
STATS = "n long, avgdl double, buckets int"


@dataclass(frozen=True)
class InvertedIndex:
    """docs(block, ids, lengths), postings(bucket, term, block, best, df, places, counts, lengths), terms(bucket, term, df,
    idf) and one row stats(n, avgdl, buckets). `df` of a row of postings counts its documents."""

    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame

    @staticmethod
    def load(spark: SparkSession, path: str) -> InvertedIndex:
        read = spark.read
        docs, terms, stats = (read.parquet(f"{path}/{name}") for name in ("cut/kind=docs", "terms", "stats"))
        docs = docs.select("block", "ids", "lengths")
        return InvertedIndex(docs, spark.read.schema(POSTINGS).parquet(f"{path}/postings"), terms, stats)

    def hits(self, queries: DataFrame, k: int, normalize: bool = False) -> DataFrame:
        return search(queries, self, k, normalize)

    def scores(self, queries: DataFrame, normalize: bool = False, candidates: DataFrame | None = None) -> DataFrame:
        return score_matches(queries, self, normalize, candidates)


# Building


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values.astype(np.int32)))


def block_rows(block: int, ids: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    """One block of documents: a row with their ids and lengths (no term), then a row for each of their words."""
    n = len(ids)
    doc, words = cut_words(texts)
    length = np.bincount(doc, minlength=n)
    names = ["kind", "block", "term", "df", "places", "counts", "lengths", "ids", "words"]
    none = pa.nulls(1, pa.list_(pa.int32()))
    own = [pa.array(["docs"]), pa.array([block]), pa.nulls(1, pa.string()), pa.array([n], pa.int32()), none, none]
    listed = [_lists(length, np.array([0, n])), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids)]
    yield pa.RecordBatch.from_arrays([*own, *listed, pa.array([int(length.sum())])], names)
    cells, counts = np.unique(words.indices.to_numpy().astype(np.int64) * n + doc, return_counts=True)
    term, place = np.divmod(cells, n)
    size = len(words.dictionary)
    starts = np.searchsorted(term, np.arange(size + 1))
    columns = [
        pa.array(["words"]).take(pa.array(np.zeros(size, np.int64))),
        pa.array(np.full(size, block)),
        words.dictionary.cast(pa.string()),
        pa.array(np.diff(starts).astype(np.int32)),
        _lists(place, starts),
        _lists(counts, starts),
        _lists(length[place], starts),
        pa.nulls(size, pa.list_(ids.type)),
        pa.nulls(size, pa.int64()),
    ]
    yield pa.RecordBatch.from_arrays(columns, names)


def index_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of one range of ids, in order, to the rows of their blocks."""
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        texts = batch.column("text")
        ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
        row = 0
        while row < batch.num_rows:
            before = ends[row - 1] if row else 0
            room = int(np.searchsorted(ends, before + BLOCK_BYTES, "right"))
            stop = min(max(row + 1, room), row + BLOCK_DOCS, batch.num_rows)
            yield from block_rows(block, batch.column("id").slice(row, stop - row), texts.slice(row, stop - row))
            block += 1
            row = stop


def saturated(count: Column, length: Column, avgdl: Column) -> Column:
    base = lexical.K1 * (1 - lexical.B + lexical.B * length / avgdl)
    return count * (lexical.K1 + 1) / (count + base)


def build_inverted_index(points: DataFrame, path: str | None = None) -> InvertedIndex:
    """Index the points (id, text) into a folder, by default a new one in the shared folder of the cluster.

    ids are unique; a missing text has no words.
    """
    spark = points.sparkSession
    path = path or new_folder(spark, "lexical")
    kind = points.schema["id"].dataType.simpleString()
    schema = f"kind string, block long, term string, df int, {LISTS}, ids array<{kind}>, words long"
    dealt = points.select("id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("id")
    cut = dealt.sortWithinPartitions("id").mapInArrow(index_blocks, schema)
    cut.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/cut")
    rows = spark.read.schema(schema).parquet(f"{path}/cut")
    of_docs, of_words = rows.where("kind = 'docs'"), rows.where("kind = 'words'")
    n, total = of_docs.agg(F.coalesce(F.sum("df"), F.lit(0)), F.sum("words")).first()
    if not n:  # the folder that readers look for
        of_docs.drop("kind").coalesce(1).write.mode("overwrite").parquet(f"{path}/cut/kind=docs")
    buckets = min(max(BUCKETS[0], n // BUCKET_DOCS), BUCKETS[1])
    avgdl = total / n if n else None
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket")
    stats = spark.createDataFrame([(n, avgdl, buckets)], STATS).coalesce(1)

    hand = F.pmod("block", F.lit(1 + n // DEAL_DOCS))
    by_word = of_words.select(bucket, "term", "block", "df", "places", "counts", "lengths").repartition("bucket", hand)
    parts = F.zip_with("counts", "lengths", lambda c, size: saturated(c, size, F.lit(avgdl).cast("double")))
    postings = by_word.sortWithinPartitions("bucket", "term", "block").withColumn("best", F.array_max(parts))
    counted = of_words.groupBy("term").agg(F.sum("df").alias("df"))
    weighed = lexical.weigh_terms(counted, F.lit(n)).select(bucket, "term", "df", "idf")
    jobs = [
        lambda: postings.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings"),
        lambda: weighed.write.mode("overwrite").parquet(f"{path}/terms"),
        lambda: stats.write.mode("overwrite").parquet(f"{path}/stats"),
    ]
    with ThreadPoolExecutor(len(jobs)) as pool:  # none needs another's result
        for done in [pool.submit(job) for job in jobs]:
            done.result()
    drop_folder(spark, f"{path}/cut/kind=words")
    return InvertedIndex.load(spark, path)


# Searching


def asked_words(queries: DataFrame, index: InvertedIndex, normalize: bool) -> DataFrame:
    """(query_id, term, bucket, weight) of the words that the index knows."""
    terms = index.terms.select("term", "bucket", "idf")
    weight = (F.col("qtf") * F.col("idf")).alias("weight")
    return lexical.query_terms(queries, normalize).join(terms, "term").select("query_id", "term", "bucket", weight)


def rows_of_words(index: InvertedIndex, words: pa.Table) -> DataFrame:
    """The rows of the asked words: of their buckets only, and where the words are few enough to be listed in
    the filter, of the row groups that can hold them."""
    asked = words.group_by(["term", "bucket"]).aggregate([])
    buckets = pc.unique(asked["bucket"]).to_pylist()
    rows = index.postings.where(F.col("bucket").isin(buckets)).drop("bucket")
    if asked.num_rows <= LISTED_WORDS:
        return rows.where(F.col("term").isin(asked["term"].to_pylist()))
    listed = index.postings.sparkSession.createDataFrame(asked.select(["term"]))
    return rows.join(F.broadcast(listed), "term", "left_semi")


@dataclass(frozen=True)
class Question:
    """The asked words of a slice of queries: sorted terms; per term (from first[t] on) its queries and weights."""

    terms: pa.Array
    first: np.ndarray
    holders: np.ndarray
    weights: np.ndarray
    queries: int
    avgdl: float

    def values(self) -> tuple:
        """Plain values, which a task reads without this package."""
        return self.terms, self.first, self.holders, self.weights, self.queries, self.avgdl


def question_of(ids: pa.Table, words: pa.Table, avgdl: float) -> Question:
    query = pc.index_in(words["query_id"], ids["query_id"].combine_chunks()).to_numpy()
    terms = pc.unique(words["term"])
    terms = terms.take(pc.array_sort_indices(terms))
    term = pc.index_in(words["term"], terms).to_numpy()
    order = np.lexsort((query, term))
    first = np.searchsorted(term[order], np.arange(len(terms) + 1))
    return Question(terms, first, query[order], words["weight"].to_numpy()[order], ids.num_rows, avgdl)


class Best:
    """The k best documents of every query so far: falling scores, numbers rising among equal ones."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = np.full((queries, k), -np.inf)
        self.numbers = np.full((queries, k), -1, np.int64)

    def edge(self) -> np.ndarray:
        """The score that a later document must exceed."""
        return self.scores[:, -1]

    def add(self, query: np.ndarray, number: np.ndarray, score: np.ndarray) -> None:
        """Documents with larger numbers than any before."""
        touched = np.unique(query)
        old = np.repeat(touched, self.k)
        every = np.r_[old, query], np.r_[self.scores[touched].ravel(), score], np.r_[self.numbers[touched].ravel(), number]
        order = np.lexsort((every[2], -every[1], every[0]))
        owner, scores, numbers = (x[order] for x in every)
        first = np.searchsorted(owner, touched)
        at = (first[:, None] + np.arange(self.k)).ravel()  # a touched query has k old rows at least
        self.scores[touched] = scores[at].reshape(-1, self.k)
        self.numbers[touched] = numbers[at].reshape(-1, self.k)


def score_block(block: int, docs: int, rows: pa.Table, question: Question, best: Best) -> int:
    """Score one block of documents for the queries that can gain a hit there; returns how many these are."""
    term = pc.index_in(rows["term"], question.terms).to_numpy()
    fan = question.first[term + 1] - question.first[term]
    row = np.repeat(np.arange(len(term)), fan)
    entry = np.arange(len(row)) - np.repeat(np.cumsum(fan) - fan, fan) + question.first[term[row]]
    holder, weight = question.holders[entry], question.weights[entry]
    # No document of the block scores more than the sum of the words' bounds; one without a match scores zero.
    most = np.maximum(weight * rows["best"].to_numpy()[row], 0.0)
    bound = np.bincount(holder, most, minlength=question.queries)
    edge = best.edge()
    able = np.flatnonzero((bound + BOUND_SLACK * (bound > 0) > edge) | (edge < 0))
    if not len(able):
        return 0
    local = np.full(question.queries, -1)
    local[able] = np.arange(len(able))
    use = local[holder] >= 0
    row, holder, weight = row[use], local[holder[use]], weight[use]
    sizes = pc.list_value_length(rows["places"]).to_numpy()
    starts = np.r_[0, np.cumsum(sizes)]
    place, count, length = (pc.list_flatten(rows[c]).to_numpy() for c in ("places", "counts", "lengths"))
    base = lexical.K1 * (1 - lexical.B + lexical.B * length / question.avgdl)
    share = count * (lexical.K1 + 1) / (count + base)
    for top in range(0, len(able), topk.QUERIES_PER_MATRIX):
        part = np.flatnonzero((holder >= top) & (holder < top + topk.QUERIES_PER_MATRIX))
        here = able[top : top + topk.QUERIES_PER_MATRIX]
        scores = np.zeros(len(here) * docs)
        size = starts[row[part] + 1] - starts[row[part]]
        total = np.r_[0, np.cumsum(size)]
        a = 0
        while a < len(part):
            b = max(a + 1, int(np.searchsorted(total, total[a] + lexical.SPREAD_CELLS, "right")) - 1)
            which = np.repeat(part[a:b], size[a:b])
            at = np.arange(total[b] - total[a]) - np.repeat(total[a:b] - total[a], size[a:b]) + starts[row[which]]
            units = share[at] * weight[which] * lexical.PART_UNITS
            units = np.copysign(np.floor(np.abs(units) + 0.5), units)
            scores += np.bincount((holder[which] - top) * docs + place[at], units, minlength=len(scores))
            a = b
        scores = np.floor((scores + lexical.PARTS_PER_SCORE // 2) / lexical.PARTS_PER_SCORE) / lexical.SCORE_UNITS
        scores = scores.reshape(len(here), docs)
        query, number = np.nonzero(scores > edge[here][:, None])
        if len(query):
            best.add(here[query], block * BLOCK_DOCS + number, scores[query, number])
    return len(able)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Table]]:
    """(block, number of documents, rows of words) from rows sorted by block, those without a term first."""
    held: list[pa.RecordBatch] = []

    def block_of() -> tuple[int, int, pa.Table]:
        table = pa.Table.from_batches(held)
        sized = table["docs"].is_valid()
        return table["block"][0].as_py(), pc.max(table["docs"]).as_py(), table.filter(pc.invert(sized))

    for batch in batches:
        block = batch.column("block").to_numpy()
        cuts = np.flatnonzero(block[1:] != block[:-1]) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)]):
            if held and a < b and held[-1].column("block")[0].as_py() != block[a]:
                yield block_of()
                held = []
            if a < b:
                held.append(batch.slice(a, b - a))
    if held:
        yield block_of()


def search(queries: DataFrame, index: InvertedIndex, k: int, normalize: bool = False) -> DataFrame:
    """Best k of all documents per query: (query_id, rank, id, score), documents without a match with score zero.

    The words of a slice of queries travel to the tasks; a count decides on the number of slices, and each slice goes
    over the rows of its own words.
    """
    n, avgdl, _ = index.stats.first()
    kinds = queries.schema["query_id"].dataType, index.docs.schema["ids"].dataType.elementType
    schema = "query_id {}, rank int, id {}, score double".format(*(kind.simpleString() for kind in kinds))
    if k <= 0 or not n:
        return queries.sparkSession.createDataFrame([], schema)
    cells = lexical.word_cells(queries, normalize)
    wanted = queries.select("query_id", "query")
    return topk.in_slices(wanted, cells, lambda part: _search_slice(part, index, k, normalize, avgdl))


def _search_slice(queries: DataFrame, index: InvertedIndex, k: int, normalize: bool, avgdl: float | None) -> DataFrame:
    spark = queries.sparkSession
    here = queries.toArrow()  # a slice may travel whole
    queries, ids = spark.createDataFrame(here), here.select(["query_id"])
    words = asked_words(queries, index, normalize).toArrow().combine_chunks()
    question = spark.sparkContext.broadcast(question_of(ids, words, avgdl or 1.0).values())
    sizes = index.docs.select("block", F.size("ids").alias("docs"))
    rows = rows_of_words(index, words).unionByName(sizes, allowMissingColumns=True)
    kind = queries.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = Question(*question.value)
        best = Best(asked.queries, k)
        for block, docs, words_of in _blocks(batches):
            score_block(block, docs, words_of, asked, best)
        query, place = np.nonzero(best.numbers >= 0)
        columns = [pa.array(query), pa.array(best.numbers[query, place]), pa.array(best.scores[query, place])]
        yield pa.RecordBatch.from_arrays(columns, ["query", "number", "score"])

    columns = "query long, number long, score double"
    met = rows.repartition("block").sortWithinPartitions("block", F.col("term").asc_nulls_first())
    partial = met.mapInArrow(run, columns)
    hits = topk.rank_hits(partial.select(F.col("query").alias("query_id"), F.col("number").alias("id"), "score"), k)
    numbered = spark.createDataFrame(pa.table({"query": np.arange(ids.num_rows), "own": ids["query_id"].combine_chunks()}))
    bounded = ids.num_rows * k <= topk.BROADCAST_HITS
    named = hits.withColumnRenamed("query_id", "query").join(F.broadcast(numbered), "query")
    placed = named.select(F.col("own").cast(kind).alias("query_id"), "rank", F.col("id").alias("number"), "score")
    return with_ids(placed, index, bounded).select("query_id", "rank", "id", "score")


def with_ids(placed: DataFrame, index: InvertedIndex, bounded: bool) -> DataFrame:
    """Rows with the number of a document (number) to rows with its id."""
    rows = placed.withColumn("block", F.expr(f"number div {BLOCK_DOCS}"))
    names = index.docs.select("block", "ids")
    joined = names.join(F.broadcast(rows) if bounded else rows, "block")
    place = F.pmod(F.col("number"), F.lit(BLOCK_DOCS)).cast("int")
    return joined.withColumn("id", F.element_at("ids", place + 1)).drop("ids", "block", "number")


def score_matches(
    queries: DataFrame, index: InvertedIndex, normalize: bool = False, candidates: DataFrame | None = None, salt: int = 64
) -> DataFrame:
    """(query_id, id, score) for documents that share a word with the query; with candidates (query_id, id), for those alone.

    Query words that a count shows to be few are broadcast; others meet the rows in a join on the word and a salt of the
    block. Of the candidates' queries only the blocks that hold one are opened.
    """
    bounded = topk.fits_broadcast(lexical.word_cells(queries, normalize))
    wanted = asked_words(queries, index, normalize)
    rows = index.postings
    if bounded:
        met = rows.join(F.broadcast(wanted), ["bucket", "term"])
    else:
        copies = wanted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        dealt = rows.withColumn("_salt", F.pmod(F.xxhash64("block"), F.lit(salt)).cast("int"))
        met = dealt.join(copies, ["bucket", "term", "_salt"])
    if candidates is not None:
        asked = _numbers_of(candidates, index)
        met = met.join(asked.select("query_id", "block").distinct(), ["query_id", "block"], "left_semi")
    posting = F.explode(F.arrays_zip("places", "counts", "lengths")).alias("p")
    flat = met.select("query_id", "block", "weight", posting)
    mean = index.stats.select("avgdl").scalar()
    base = F.col("p.counts") + lexical.K1 * (1 - lexical.B + lexical.B * F.col("p.lengths") / mean)
    part = F.round(F.col("weight") * F.col("p.counts") * (lexical.K1 + 1) / base * lexical.PART_UNITS).cast("long")
    number = (F.col("block") * BLOCK_DOCS + F.col("p.places")).alias("number")
    parts = flat.select("query_id", number, part.alias("part"))
    if candidates is not None:
        parts = parts.join(asked.select("query_id", "number"), ["query_id", "number"], "left_semi")
    total = F.floor((F.sum("part") + lexical.PARTS_PER_SCORE // 2) / lexical.PARTS_PER_SCORE)
    scored = parts.groupBy("query_id", "number").agg((total / lexical.SCORE_UNITS).alias("score"))
    return with_ids(scored, index, False).select("query_id", "id", "score")


def _numbers_of(candidates: DataFrame, index: InvertedIndex) -> DataFrame:
    """(query_id, block, number) of the candidates' documents."""
    places = index.docs.select("block", F.posexplode("ids").alias("place", "id"))
    wanted = candidates.select("query_id", "id").distinct()
    number = (F.col("block") * BLOCK_DOCS + F.col("place")).alias("number")
    return places.join(wanted, "id").select("query_id", "block", number)
