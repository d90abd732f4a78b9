"""BM25 over tables of documents and queries.

Okapi weights with k1 = 1.5 and b = 0.75; idf = ln(n - df + 0.5) - ln(df + 0.5), and a
negative idf is replaced by a quarter of the mean idf of the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passages.functions.cuts import cut_words, parts_of
from passages.functions.text import document_tokens, query_tokens
from passages.operators import topk
from passages.operators.vector import known_source
from passages.session import cut_lineage

if TYPE_CHECKING:
    from passages.operators.postings import InvertedIndex

# Fixed values of the scorer.
K1 = 1.5
B = 0.75
FLOOR_SHARE = 0.25

# The mean of the vocabulary depends on the order of its sum in the last digits; a rounded idf
# does not, so an index that is built again gives the same scores.
IDF_DIGITS = 9

# Contributions are added as whole numbers of 1e-9, so a sum does not depend on its order; a
# score is the sum rounded to whole numbers of 1e-6.
PART_UNITS = 1_000_000_000
SCORE_UNITS = 1_000_000
PARTS_PER_SCORE = PART_UNITS // SCORE_UNITS

# Contributions that a task holds at a time.
SPREAD_CELLS = 500_000

# (document, query) pairs whose sums a task holds at most.
PAIRS_PER_TASK = 1_000_000

# Entries that a document counts for when rows are cut into matrices.
TOKENS_PER_DOC = 500


@dataclass(frozen=True)
class LexicalIndex:
    """docs(id, tokens), terms(term, df, idf) and one row stats(n, avgdl).

    An index that was just built has the `text` of its docs as well, so that their tokens need not be made.
    """

    docs: DataFrame
    terms: DataFrame
    stats: DataFrame

    def hits(self, queries: DataFrame, k: int, normalize: bool = False) -> DataFrame:
        return _scan_tokens(queries, self, k, normalize)

    def scores(self, queries: DataFrame, normalize: bool = False, candidates: DataFrame | None = None) -> DataFrame:
        return _score_tokens(queries, self, normalize, candidates)

    def write(self, path: str) -> None:
        self.docs.select("id", "tokens").write.mode("overwrite").parquet(f"{path}/docs")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        self.stats.write.mode("overwrite").parquet(f"{path}/stats")

    @staticmethod
    def load(spark: SparkSession, path: str) -> LexicalIndex:
        return LexicalIndex(*(spark.read.parquet(f"{path}/{t}") for t in ("docs", "terms", "stats")))


def build_lexical_index(points: DataFrame) -> LexicalIndex:
    """Texts are read once for the counts; these stay where `cut_lineage` puts them."""
    text = F.coalesce("text", F.lit(""))
    docs = points.select("id", text.alias("text"), document_tokens(text).alias("tokens"))
    counts = cut_lineage(word_counts(docs.select("text")))
    stats = counts.where("term is null").agg(
        F.coalesce(F.sum("df"), F.lit(0)).alias("n"), (F.sum("words").cast("double") / F.sum("df")).alias("avgdl")
    )
    terms = weigh_terms(counts.where("term is not null").select("term", "df"), stats.select("n").scalar())
    return LexicalIndex(docs, terms, stats)


def word_counts(texts: DataFrame) -> DataFrame:
    """(term, df, words): how many texts hold each word. The row without a term has the number of texts and of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["term", "df", "words"]
        for batch in batches:
            column = batch.column(0)
            for first, end in parts_of(column):
                doc, words = cut_words(column.slice(first, end - first))
                size = len(words.dictionary)
                # A word counts once for each text that holds it.
                held = np.sort(words.indices.to_numpy().astype(np.int64) * (end - first) + doc)
                held = held[np.flatnonzero(np.diff(held, prepend=-1))] // (end - first)
                df = pa.array(np.bincount(held, minlength=size).astype(np.int64))
                yield pa.RecordBatch.from_arrays([words.dictionary.cast(pa.string()), df, pa.nulls(size, pa.int64())], names)
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([end - first]), pa.array([len(doc)])], names)

    # Counts of a part are combined before the shuffle, so a hot term is a few rows.
    return texts.mapInArrow(run, "term string, df long, words long").groupBy("term").agg(
        F.sum("df").alias("df"), F.sum("words").alias("words")
    )


def weigh_terms(counted: DataFrame, n: Column) -> DataFrame:
    """(term, df) with the idf of each word in n documents."""
    raw = counted.withColumn("_raw", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floor = raw.agg((F.avg("_raw") * FLOOR_SHARE).alias("floor")).scalar()
    idf = F.when(F.col("_raw") < 0, floor).otherwise(F.col("_raw"))
    return raw.select(*counted.columns, F.round(idf, IDF_DIGITS).alias("idf"))


def query_terms(queries: DataFrame, normalize: bool = False) -> DataFrame:
    """(query_id, term, qtf): a word that is repeated in the query counts again."""
    words = queries.select(
        "query_id", F.explode(query_tokens(F.col("query"), normalize)).alias("term")
    )
    return words.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def word_cells(queries: DataFrame, normalize: bool) -> int | None:
    words = query_tokens(F.col("query"), normalize)
    return queries.agg(F.sum(F.size(words) + 1)).first()[0]


def bm25_scores(
    queries: DataFrame,
    index: LexicalIndex | InvertedIndex,
    normalize: bool = False,
    candidates: DataFrame | None = None,
) -> DataFrame:
    """(query_id, id, score) for every document that shares a word with the query.

    Documents that are not listed score zero. With `candidates` (query_id, id) only these are scored, which is
    what a rerank needs: without them the result has a row for each pair that shares a word.
    """
    return index.scores(queries, normalize, candidates)


def _score_tokens(
    queries: DataFrame, index: LexicalIndex, normalize: bool, candidates: DataFrame | None, salt: int = 64
) -> DataFrame:
    """Query words that a count shows to be few are broadcast, and other words leave the
    postings before anything is shuffled. A larger query table meets the postings in a join on the word and a salt, which deals the postings of a
    frequent word out to `salt` tasks.
    """
    bounded = topk.fits_broadcast(word_cells(queries, normalize))
    words = query_terms(queries, normalize).join(index.terms.select("term", "idf"), "term")
    wanted = words.select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"))
    docs = index.docs
    if bounded and candidates is None:
        # Documents move once, by their id; their words, counts and sums then stay in a task of a bounded number of pairs.
        pairs = docs.count() * queries.count()
        least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        docs = docs.repartition(max(least, -(-pairs // PAIRS_PER_TASK)), "id")
    tokens = docs.select("id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    if bounded:
        asked = query_terms(queries, normalize).select("term").distinct()
        tokens = tokens.join(F.broadcast(asked), "term", "left_semi")
    postings = tokens.groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    if bounded:
        met = postings.join(F.broadcast(wanted), "term")
    else:
        dealt = postings.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(salt)).cast("int"))
        copies = F.explode(F.sequence(F.lit(0), F.lit(salt - 1)))
        met = dealt.join(wanted.withColumn("_salt", copies), ["term", "_salt"])
    if candidates is not None:
        met = met.join(candidates.select("query_id", "id").distinct(), ["query_id", "id"], "left_semi")
    avgdl = index.stats.select("avgdl").scalar()
    saturation = F.col("tf") + K1 * (1 - B + B * F.col("dl") / avgdl)
    part = F.round(F.col("weight") * F.col("tf") * (K1 + 1) / saturation * PART_UNITS).cast("long")
    total = F.floor((F.sum(part) + PARTS_PER_SCORE // 2) / PARTS_PER_SCORE)
    return met.groupBy("query_id", "id").agg((total / SCORE_UNITS).alias("score"))


def _weighted_queries(queries: DataFrame, index: LexicalIndex, normalize: bool) -> DataFrame:
    """One row per query: its known words, their weights, and the mean document length."""
    words = query_terms(queries, normalize).join(index.terms.select("term", "idf"), "term")
    weights = words.groupBy("query_id").agg(
        F.collect_list(F.struct("term", (F.col("qtf") * F.col("idf")).alias("weight"))).alias("w")
    )
    return queries.select("query_id").join(weights, "query_id", "left").select(
        "query_id",
        F.coalesce(F.col("w.term"), F.array().cast("array<string>")).alias("terms"),
        F.coalesce(F.col("w.weight"), F.array().cast("array<double>")).alias("weights"),
        index.stats.select("avgdl").scalar().alias("avgdl"),
    )


def _entries(lists: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Owner row of each list entry, and the entries."""
    joined = lists.combine_chunks()
    lengths = joined.value_lengths().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(joined)), lengths), joined.flatten()


def words_of(corpus: pa.Table) -> tuple[int, np.ndarray, pa.DictionaryArray]:
    """(documents, the document of every word, the words) of a table with `text` or `tokens`."""
    if "text" in corpus.column_names:
        return corpus.num_rows, *cut_words(corpus["text"].combine_chunks())
    doc_no, words = _entries(corpus["tokens"])
    return corpus.num_rows, doc_no, words.dictionary_encode()


class WordScorer(topk.Scorer):
    """BM25 scores of the words of a text."""

    def __init__(self):
        super().__init__(score_words, TOKENS_PER_DOC)

    def corpus(self, table: pa.Table) -> tuple:
        return words_of(table)


def bm25_scorer(corpus: pa.Table, queries: pa.Table) -> np.ndarray:
    return score_words(words_of(corpus), queries)


def score_words(corpus: tuple[int, np.ndarray, pa.DictionaryArray], queries: pa.Table) -> np.ndarray:
    """(documents x queries) BM25 scores of one batch against one block of queries.

    Only words of the block are counted, and each count is spread over the queries that hold
    the word, so the work follows the matches and not the size of the vocabulary.
    """
    (n, doc_no, words), m = corpus, queries.num_rows
    scores = np.zeros(n * m)
    query_no, terms = _entries(queries["terms"])
    vocabulary = pc.unique(terms)
    term_no = pc.index_in(terms, vocabulary).to_numpy()
    by_term = np.argsort(term_no, kind="stable")
    holders = query_no[by_term]
    weights = queries["weights"].combine_chunks().flatten().to_numpy()[by_term]
    first = np.searchsorted(term_no[by_term], np.arange(len(vocabulary) + 1))

    lengths = np.bincount(doc_no, minlength=n)
    number = pc.fill_null(pc.index_in(words.dictionary.cast(vocabulary.type), vocabulary), -1).to_numpy()
    found = number[words.indices.to_numpy()]
    known = found >= 0
    cells = doc_no[known] * len(vocabulary) + found[known]
    cells, tf = np.unique(cells, return_counts=True)
    if len(cells) == 0:
        return scores.reshape(n, m)
    doc, term = np.divmod(cells, len(vocabulary))
    base = K1 * (1 - B + B * lengths / queries["avgdl"][0].as_py())
    saturated = tf * (K1 + 1) / (tf + base[doc])

    fan_out = first[term + 1] - first[term]
    total = np.concatenate([[0], np.cumsum(fan_out)])
    start = 0
    while start < len(cells):
        # As many counts as spread to SPREAD_CELLS entries, at least one.
        stop = max(start + 1, np.searchsorted(total, total[start] + SPREAD_CELLS, side="right") - 1)
        count = np.repeat(np.arange(start, stop), fan_out[start:stop])
        entry = np.arange(total[stop] - total[start]) + total[start] - total[count] + first[term[count]]
        parts = saturated[count] * weights[entry] * PART_UNITS
        parts = np.copysign(np.floor(np.abs(parts) + 0.5), parts)
        scores += np.bincount(doc[count] * m + holders[entry], parts, minlength=n * m)
        start = stop
    scores = np.floor((scores + PARTS_PER_SCORE // 2) / PARTS_PER_SCORE) / SCORE_UNITS
    return scores.reshape(n, m)


def bm25_hits(
    queries: DataFrame, index: LexicalIndex | InvertedIndex, k: int, normalize: bool = False
) -> DataFrame:
    """Best k of all documents per query: (query_id, rank, id, score).

    Documents without a match score zero and fill up to k in id order, so every document is
    a candidate for every query; a word may also weigh less than zero in a tiny corpus. Token lists
    (`build_lexical_index`) are scanned whole, which suits a single search; an inverted index
    (`postings.build_inverted_index`) is read by the asked words only.
    """
    return index.hits(queries, k, normalize)


def _scan_tokens(queries: DataFrame, index: LexicalIndex, k: int, normalize: bool) -> DataFrame:
    weighted = _weighted_queries(queries, index, normalize)
    # The words of joined tokens are these tokens.
    text = "text" if "text" in index.docs.columns else F.array_join("tokens", " ").alias("text")
    return topk.top_k(index.docs.select("id", text), weighted, WordScorer(), k, word_cells(queries, normalize))


def lexical_search(
    queries: DataFrame, points: DataFrame, index: LexicalIndex | InvertedIndex, k: int, normalize: bool = False
) -> DataFrame:
    """`bm25_hits` with the stored payload: (query_id, rank, id, text, source, score)."""
    hits = bm25_hits(queries, index, k, normalize)
    payload = points.select("id", "text", known_source().alias("source"))
    bounded = queries.select("query_id").count() * k <= topk.BROADCAST_HITS
    return topk.attach(hits, payload, bounded).select(
        "query_id", "rank", "id", "text", "source", "score"
    )
