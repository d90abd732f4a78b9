"""One query per operator, each over whole tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passages.config import ASK, INGEST, SERVICE, RetrievalConfig
from passages.functions import classify as labels
from passages.functions import text as tx
from passages.operators import chunk, context, embed, fuse, lexical, postings, quantized, rerank, vector
from passages.operators.inference_log import infer_logged
from passages.plans import answers, ingest
from passages.session import new_folder
from passages.sources import collection, files, pages, tables

DIM = 64
MEASURES = 4
LIBRARY = RetrievalConfig(
    chunk_size=1000, recursive=False, use_lexical=True, lexical_k=1, use_rerank=True, rerank_k=7
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return tables.read_table(spark, f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    scan = table(spark, sf, "documents").select("doc_id", "text", "source")
    return tables.spread(scan, "doc_id")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )


def document_items(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select(F.col("doc_id").alias("id"), "text")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"),
        "embedding",
        F.concat(F.lit("label "), F.col("label")).alias("text"),
        F.lit(None).cast("string").alias("source"),
    )


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunk.with_chunk_ids(chunk.chunk_fixed(documents(spark, sf)))


def points(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.ingest_fixed(documents(spark, sf))


def vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Every stored vector as a query."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


def digest(text: str | Column = "text") -> Column:
    return F.md5(text).alias("text_md5")


def refusing_embedder():
    """The built-in way of a model: text measures as a vector; texts with a certain md5 are refused."""

    def measure(text: str) -> list[float]:
        digest = hashlib.md5(text.encode()).hexdigest()
        if digest.startswith("00"):
            raise ValueError("refused")
        return _measures(text)

    return lambda texts: [measure(text) for text in texts]


def measuring_embedder():
    return lambda texts: [_measures(text) for text in texts]


def _measures(text: str) -> list[float]:
    """Characters, spaces, line breaks, and the first byte of the md5."""
    first = int(hashlib.md5(text.encode()).hexdigest()[:2], 16)
    return [float(len(text)), float(text.count(" ")), float(text.count("\n")), float(first)]


def faulty_reader():
    """Reads bytes as text; one file in sixteen cannot be read."""

    def read(data: bytes) -> str:
        if hashlib.md5(data).hexdigest().startswith("0"):
            raise ValueError("unreadable")
        return data.decode()

    return lambda files: [read(bytes(data)) for data in files]


# Scans and tables


def scan_filter_suffix(spark, sf):
    found = files.split_by_suffix(table(spark, sf, "pages"), "url", ".html")
    return found.select("page_id", "url", "accepted")


def _conversation_pages(spark, sf):
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text"
    )


def page_concat(spark, sf):
    whole = pages.concat_pages(_conversation_pages(spark, sf))
    return whole.select("doc_id", F.length("text").alias("n_chars"), digest())


def page_chunks(spark, sf):
    cut = chunk.chunk_pages(_conversation_pages(spark, sf))
    return cut.select("doc_id", "chunk_no", F.length("text").alias("n_chars"), digest())


def _stored_chunks(spark, sf):
    return chunks(spark, sf).withColumnRenamed("chunk_id", "id")


def scroll_page(spark, sf):
    page = collection.scroll(_stored_chunks(spark, sf), cursor="8")
    return page.select("id", digest(), "source", "next_cursor")


def scroll_compacted(spark, sf):
    """The same page of a collection that is stored and compacted: read from the files that hold it."""
    path = new_folder(spark, "collection")
    collection.ensure_collection(spark, path, 1)
    points = _stored_chunks(spark, sf).select("id", F.array(F.lit(1.0).cast("float")).alias("embedding"), "text", "source")
    collection.upsert(points, path, 0)
    collection.compact(spark, path)
    page = collection.scroll_page(spark, path, "8")
    return page.select("id", digest(), "source", "next_cursor")


def all_documents(spark, sf):
    return collection.all_documents(_stored_chunks(spark, sf)).select("id", digest(), "source")


def upsert_latest(spark, sf):
    docs = documents(spark, sf).withColumnRenamed("doc_id", "id")
    marks = table(spark, sf, "labels").withColumnRenamed("doc_id", "id")
    first = docs.select("id", "text", "source", F.lit(0).alias("ingest_batch"))
    second = docs.join(marks, "id").select(
        "id",
        F.concat_ws(" ", F.col("text"), F.col("quality").cast("string")).alias("text"),
        "source",
        F.lit(1).alias("ingest_batch"),
    )
    latest = collection.latest_points(first.unionByName(second))
    return latest.select("id", digest(), "source", "ingest_batch")


# Chunks


def chunk_fixed(spark, sf):
    cut = chunk.chunk_fixed(documents(spark, sf))
    return cut.select("doc_id", "source", "chunk_no", F.length("text").alias("n_chars"), digest())


def chunk_ids(spark, sf):
    return chunks(spark, sf).select("chunk_id", "doc_id", "chunk_no")


def chunk_recursive(spark, sf):
    cut = chunk.chunk_recursive(documents(spark, sf), 500, 50)
    return cut.select("doc_id", "chunk_no", F.length("text").alias("n_chars"), digest())


def chunk_recursive_invariants(spark, sf):
    docs = documents(spark, sf)
    cut = chunk.chunk_recursive(docs, 500, 50)
    checked = cut.join(docs.select("doc_id", F.col("text").alias("whole")), "doc_id").groupBy("doc_id").agg(
        F.bool_and(F.length("text") <= 500).alias("within_size"),
        F.bool_and(F.contains("whole", "text")).alias("found_in_text"),
    )
    parts = F.array_sort(F.collect_list(F.struct("chunk_no", "text")))
    rejoined = chunk.chunk_recursive(docs, 500, 0).groupBy("doc_id").agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text")
    )
    return checked.join(rejoined, "doc_id").select(
        "doc_id",
        "within_size",
        "found_in_text",
        F.md5(F.regexp_replace("text", tx.SPACES, "")).alias("squeezed_md5"),
    )


# Embeddings


def embed_hash(spark, sf):
    embedded = embed.embed_texts(documents(spark, sf))
    return embed.nonzero_buckets(embedded, "doc_id").select(
        "doc_id", "bucket", F.round(F.col("value").cast("double"), 6).alias("value")
    )


def embed_model(spark, sf):
    done = embed.embed_with(documents(spark, sf), measuring_embedder, size=MEASURES)
    return done.select("doc_id", *(F.col("embedding")[k].cast("double").alias(f"v{k}") for k in range(MEASURES)), "error")


def embed_logged(spark, sf):
    """Vectors by way of the log: the second run finds every text there."""
    log, kind = new_folder(spark, "log"), T.ArrayType(T.FloatType())
    docs = documents(spark, sf)
    for _ in range(2):
        done = infer_logged(docs, measuring_embedder, "text", "embedding", kind, log, "measures", error_col="error")
    return done.select("doc_id", *(F.col("embedding")[k].cast("double").alias(f"v{k}") for k in range(MEASURES)), "error")


def embed_batch_failure(spark, sf):
    done = ingest.embedded_chunks(documents(spark, sf), INGEST, refusing_embedder, MEASURES)
    return done.select("chunk_id", "source", F.col("embedding").isNotNull().alias("valid"), "error")


def valid_embeddings(spark, sf):
    done = ingest.embedded_chunks(documents(spark, sf), INGEST, refusing_embedder, MEASURES)
    return embed.valid_embeddings(done).select(
        "chunk_id", F.size("embedding").alias("dim"), F.col("embedding")[0].cast("double").alias("v0")
    )


# Vector search


def vector_topk(spark, sf):
    entries = table(spark, sf, "embeddings").select(F.posexplode("embedding").alias("at", "x"))
    means = entries.groupBy("at").agg(F.avg(F.col("x").cast("double")).alias("x")).orderBy("at")
    centre = [row.x for row in means.collect()]
    return vector.vector_topk(vectors(spark, sf), centre, 10)


def _knn(metric: str):
    def run(spark, sf):
        return vector.knn_join(vector_queries(spark, sf), vectors(spark, sf), 5, metric, DIM)

    return run


def knn_quantized(spark, sf):
    """All vectors as queries against the one-byte index."""
    stored = vectors(spark, sf)
    index = quantized.build_quantized_index(stored, DIM)
    return quantized.knn_quantized(vector_queries(spark, sf), index, stored, 5, "cosine", DIM)


def quantized_share(spark, sf):
    """How many of all pairs the one-byte pass leaves, and how many of the true hits these hold."""
    stored, asked = vectors(spark, sf), vector_queries(spark, sf)
    index = quantized.build_quantized_index(stored, DIM)
    left = quantized.scored_candidates(asked, index, stored, 5, "cosine", DIM)
    true = vector.knn_join(asked, stored, 5, "cosine", DIM).withColumnRenamed("score", "true")
    met = true.join(left, ["query_id", "id"], "left")
    counts = met.agg(
        F.count(F.lit(1)).alias("n_hits"), F.count_if(F.col("score") == F.col("true")).alias("n_found")
    )
    def rows(df):
        return df.agg(F.count(F.lit(1))).scalar()

    return counts.select("n_hits", "n_found", (rows(left) * 10 <= rows(stored) * rows(asked)).alias("few_pairs"))


def knn_lsh(spark, sf):
    return vector.knn_lsh(vector_queries(spark, sf), vectors(spark, sf), 5, DIM)


def dim_check(spark, sf):
    shortened = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.slice("embedding", F.lit(1), DIM - F.col("label")).alias("embedding")
    )
    accepted, rejected = vector.split_by_dim(shortened, DIM)
    return accepted.select("id", F.lit(True).alias("accepted")).unionByName(
        rejected.select("id", F.lit(False).alias("accepted"))
    )


def semantic_search(spark, sf):
    hits = vector.semantic_search(questions(spark, sf), points(spark, sf), 5)
    return hits.select("query_id", "rank", "id", digest(), "source")


# Lexical search


def doc_tokens(spark, sf):
    tokens = tx.document_tokens(F.col("text"))
    return documents(spark, sf).select(
        "doc_id", F.size(tokens).alias("n_tokens"), F.md5(F.array_join(tokens, " ")).alias("tokens_md5")
    )


def query_tokens(spark, sf):
    tokens = tx.query_tokens(F.col("query"))
    return questions(spark, sf).select(
        "query_id", F.size(tokens).alias("n_tokens"), F.md5(F.array_join(tokens, " ")).alias("tokens_md5")
    )


def _index(spark, sf):
    return lexical.build_lexical_index(document_items(spark, sf))


def _inverted(spark, sf):
    return postings.build_inverted_index(document_items(spark, sf))


def bm25_stats(spark, sf):
    return _index(spark, sf).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_corpus(spark, sf):
    return _index(spark, sf).stats.select("n", F.round("avgdl", 6).alias("avgdl"))


def bm25_scores(spark, sf):
    return lexical.bm25_scores(questions(spark, sf), _index(spark, sf))


def bm25_topk(spark, sf):
    return lexical.bm25_hits(questions(spark, sf), _index(spark, sf), 5)


def bm25_index_topk(spark, sf):
    return lexical.bm25_hits(questions(spark, sf), _inverted(spark, sf), 5)


def bm25_index_terms(spark, sf):
    return _inverted(spark, sf).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_index_scores(spark, sf):
    """Scores of given candidates: the hits of the search without an index."""
    found = bm25_topk(spark, sf).select("query_id", "id")
    return lexical.bm25_scores(questions(spark, sf), _inverted(spark, sf), candidates=found)


# Fusion


def hybrid_splice(spark, sf):
    stored = points(spark, sf)
    index = lexical.build_lexical_index(stored)
    return fuse.hybrid_hits(questions(spark, sf), stored, index, vector_k=5, lexical_k=3)


def _library_hits(spark, sf):
    stored = points(spark, sf)
    return fuse.hybrid_search(
        questions(spark, sf), stored, lexical.build_lexical_index(stored), vector_k=5, lexical_k=1
    )


def hybrid_search(spark, sf):
    return _library_hits(spark, sf).select("query_id", "pos", "id", digest(), "source")


# Classification and reranking


def camel_split(spark, sf):
    return documents(spark, sf).select("doc_id", digest(tx.split_camel_case(F.col("text"))))


def preprocess_text(spark, sf):
    return documents(spark, sf).select("doc_id", digest(tx.preprocess(F.col("text"))))


def _classes() -> Column:
    return F.array(*[F.lit(f"class {i}") for i in range(DIM)])


def classify_threshold(spark, sf):
    # The entries of a unit vector, squared, add up to one.
    shares = F.transform("embedding", lambda x: x.cast("double") * x.cast("double"))
    probabilities = table(spark, sf, "embeddings").select("vec_id", shares.alias("p"))
    return probabilities.select(
        "vec_id",
        labels.threshold_label(F.col("p"), _classes(), 0.1).alias("tag"),
        F.round(F.array_max("p"), 6).alias("p"),
    )


def softmax_classify(spark, sf):
    probabilities = table(spark, sf, "embeddings").select(
        "vec_id", labels.softmax(F.col("embedding")).alias("p")
    )
    return probabilities.select(
        "vec_id",
        labels.threshold_label(F.col("p"), _classes(), 0.022).alias("tag"),
        F.round(F.array_max("p"), 6).alias("p"),
        F.round(F.element_at("p", 1), 6).alias("p_first"),
    )


CLASSES = ["low", "high"]


def _classifier(spark, sf):
    known = documents(spark, sf).join(table(spark, sf, "labels"), "doc_id").select(
        "text", F.col("quality").cast("double").alias("label")
    )
    return rerank.train_naive_bayes(known)


def classify_docs(spark, sf):
    tagged = rerank.classify(documents(spark, sf), _classifier(spark, sf), CLASSES, 0.9)
    return tagged.select("doc_id", "predicted_tag")


def _reranked(spark, sf, top=None):
    hits = _library_hits(spark, sf)
    score = tx.token_count(F.col("text")).cast("double")
    return rerank.rerank(hits, score, F.col("source"), top)


def rerank_sort(spark, sf):
    return _reranked(spark, sf).select("query_id", "rank", "pos", "id", "source")


def rerank_topk(spark, sf):
    return _reranked(spark, sf, 3).select("query_id", "rank", "pos", "id", "source")


def rerank_indices(spark, sf):
    ranked = rerank.reranked_indices(_reranked(spark, sf), ["id", "text", "source"])
    return ranked.select("query_id", "rank", "index")


# Context and answers


def context_concat(spark, sf):
    gathered = context.gather(_library_hits(spark, sf))
    return gathered.select(
        "query_id", F.length("context").alias("n_chars"), F.md5("context").alias("context_md5")
    )


def context_ids(spark, sf):
    gathered = context.gather(_library_hits(spark, sf))
    return gathered.select("query_id", F.array_join("document_ids", ",").alias("document_ids"))


def context_sources(spark, sf):
    gathered = context.gather(_library_hits(spark, sf))
    return gathered.select("query_id", F.array_join("sources", ",").alias("sources"))


def build_prompts(spark, sf):
    prompts = context.build_prompts(questions(spark, sf), context.gather(_library_hits(spark, sf)))
    return prompts.select(
        "query_id", F.length("prompt").alias("n_chars"), F.md5("prompt").alias("prompt_md5")
    )


def answer_strip(spark, sf):
    stripped = tx.strip(F.col("text"))
    return chunks(spark, sf).select(
        "chunk_id", F.length(stripped).alias("n_chars"), digest(stripped)
    )


def answer_records(spark, sf):
    stored = points(spark, sf)
    index = lexical.build_lexical_index(stored)
    records = answers.answer_queries(questions(spark, sf), stored, index, LIBRARY)
    return records.select(
        "query_id",
        F.md5("question").alias("question_md5"),
        F.array_join("sources", ",").alias("sources"),
        F.array_join("document_ids", ",").alias("document_ids"),
        F.md5("answer").alias("answer_md5"),
    )


def answer_service(spark, sf):
    """The service path: 30 vector and 5 lexical hits, a classifier at 0.9, the first 10 of them."""
    stored = ingest.ingest_fixed(documents(spark, sf), SERVICE)
    index = lexical.build_lexical_index(stored)
    asked, _ = answers.split_blank(questions(spark, sf))
    records = answers.answer_queries(
        asked, stored, index, SERVICE, classifier=_classifier(spark, sf), classes=CLASSES
    )
    return records.select(
        "query_id",
        F.md5("question").alias("question_md5"),
        F.array_join("sources", ",").alias("sources"),
        F.array_join("document_ids", ",").alias("document_ids"),
        F.md5("answer").alias("answer_md5"),
    )


def token_count(spark, sf):
    return documents(spark, sf).select("doc_id", tx.token_count(F.col("text")).alias("n_tokens"))


def token_trim(spark, sf):
    return documents(spark, sf).select("doc_id", digest(tx.trim_tokens(F.col("text"), 100)))


def context_budget(spark, sf):
    kept = context.fit_budget(_library_hits(spark, sf), 512)
    return kept.select("query_id", "pos", "id", F.col("tokens").cast("long").alias("tokens"), digest())


# Ingest


def build_index_summary(spark, sf):
    built = ingest.recursive_points(documents(spark, sf), ASK)
    return built.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_points"),
        F.count_if(F.size("embedding") == 768).alias("n_fitting"),
        F.max(F.length("text")).alias("longest"),
    )


def ingest_fixed(spark, sf):
    stored = ingest.ingest_fixed(documents(spark, sf), INGEST)
    return stored.select(
        "id",
        "source",
        digest(),
        F.size("embedding").alias("dim"),
        F.size(F.filter("embedding", lambda x: x != 0)).alias("n_nonzero"),
    )


def ingest_report(spark, sf):
    """Web pages go through a reader, keyed by their address; documents count under their source."""
    web = files.split_by_suffix(table(spark, sf, "pages"), "url", ".html")
    scan = web.where("accepted").select(F.col("url").alias("path"), F.col("html").cast("binary").alias("content"))
    texts = files.read_texts(scan, faulty_reader)
    docs = documents(spark, sf).withColumn("path", F.col("source"))
    found = (
        texts.select("path", "source", F.lit(True).alias("accepted"), "failed")
        .unionByName(web.where("not accepted").select(F.col("url").alias("path"), F.col("url").alias("source"), "accepted", F.lit(False).alias("failed")))
        .unionByName(docs.select("path", "source", F.lit(True).alias("accepted"), F.lit(False).alias("failed")))
    )
    # The chunks of a file carry its path as their source.
    read = docs.select("doc_id", "text", F.col("path").alias("source")).unionByName(
        texts.select("doc_id", "text", F.col("path").alias("source"))
    )
    done = ingest.judged_chunks(read, INGEST).withColumnRenamed("source", "path")
    return ingest.ingest_report(found, done, "path")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        scan_filter_suffix,
        page_concat,
        page_chunks,
        scroll_page,
        scroll_compacted,
        all_documents,
        upsert_latest,
        chunk_fixed,
        chunk_ids,
        chunk_recursive,
        chunk_recursive_invariants,
        embed_hash,
        embed_model,
        embed_logged,
        embed_batch_failure,
        valid_embeddings,
        vector_topk,
        knn_lsh,
        knn_quantized,
        quantized_share,
        dim_check,
        semantic_search,
        doc_tokens,
        query_tokens,
        bm25_stats,
        bm25_corpus,
        bm25_scores,
        bm25_topk,
        bm25_index_topk,
        bm25_index_terms,
        bm25_index_scores,
        hybrid_splice,
        hybrid_search,
        camel_split,
        preprocess_text,
        classify_threshold,
        softmax_classify,
        classify_docs,
        rerank_sort,
        rerank_topk,
        rerank_indices,
        context_concat,
        context_ids,
        context_sources,
        build_prompts,
        answer_strip,
        answer_records,
        answer_service,
        token_count,
        token_trim,
        context_budget,
        build_index_summary,
        ingest_fixed,
        ingest_report,
    )
} | {"knn_join": _knn("cosine"), "knn_dot": _knn("dot"), "knn_euclid": _knn("euclid")}
