"""A table of questions to a table of answer records, in one job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passages.config import ASK, VECTOR_SIZE, RetrievalConfig
from passages.functions.text import strip
from passages.operators.context import answer_records, build_prompts, fit_budget, gather
from passages.operators.embed import Model, batch_infer
from passages.operators.fuse import hybrid_search
from passages.operators.inference_log import infer_logged
from passages.operators.lexical import LexicalIndex
from passages.operators.rerank import NaiveBayesTable, classify, rerank
from passages.session import cut_lineage


def split_blank(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): a question of white space only cannot be answered."""
    blank = F.coalesce(strip(F.col("query")), F.lit("")) == ""
    return queries.where(~blank), queries.where(blank)


def retrieve(
    queries: DataFrame,
    points: DataFrame,
    index: LexicalIndex | None = None,
    config: RetrievalConfig = ASK,
    classifier: PipelineModel | NaiveBayesTable | None = None,
    classes: list[str] | None = None,
    relevance: Column | None = None,
    dim: int = VECTOR_SIZE,
    metric: str = "cosine",
    build_embedder: Callable[[], Model] | None = None,
) -> DataFrame:
    """(query_id, pos, id, text, source) that go into the prompt, after reranking and budget."""
    hits = hybrid_search(
        queries,
        points,
        index if config.use_lexical else None,
        config.vector_k,
        config.lexical_k,
        dim,
        metric,
        build_embedder,
    )
    if config.use_rerank:
        tag = None
        if classifier is not None:
            # A classifier may read the hits more than once; they are a few rows per query, and dear.
            hits = classify(cut_lineage(hits), classifier, classes, config.threshold)
            tag = F.col("predicted_tag")
        hits = rerank(hits, relevance, tag, config.rerank_k).withColumn("pos", F.col("rank") - 1)
    if config.apply_budget:
        hits = fit_budget(hits, config.context_budget)
    return hits.select("query_id", "pos", "id", "text", "source")


def answer_queries(
    queries: DataFrame,
    points: DataFrame,
    index: LexicalIndex | None = None,
    config: RetrievalConfig = ASK,
    build_model: Callable[[], Model] | None = None,
    log: str | None = None,
    model: str = "model",
    **retrieval,
) -> DataFrame:
    """(query_id, question, sources, document_ids, answer), one row per query that is not blank.

    Blank and null questions are set aside first; `split_blank` gives them. Without a model the
    answer is the prompt itself, ready for one. With `log`, a folder, replies are kept by the digest of `model` (its name)
    and prompt, and a prompt that was answered before is not asked again.
    """
    queries, _ = split_blank(queries)
    hits = retrieve(queries, points, index, config, **retrieval)
    prompts = build_prompts(queries, gather(hits))
    if build_model is None:
        return answer_records(prompts, "prompt")
    if log is None:
        answered = batch_infer(prompts, build_model, "prompt", "reply", T.StringType())
    else:
        answered = infer_logged(prompts, build_model, "prompt", "reply", T.StringType(), log, model)
    return answer_records(answered, "reply")
