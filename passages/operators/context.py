"""Context, prompt and answer records from ranked hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passages.functions.text import strip, token_count, trim_tokens
from passages.operators.vector import known_source


def gather(hits: DataFrame, pos: str = "pos") -> DataFrame:
    """One row per query: context, document_ids and sources, in `pos` order.

    The list per query is as long as its top k.
    """
    ordered = F.array_sort(
        F.collect_list(F.struct(F.col(pos).alias("pos"), "id", "text", known_source().alias("source")))
    )
    return (
        hits.groupBy("query_id")
        .agg(ordered.alias("_hits"))
        .select(
            "query_id",
            F.array_join("_hits.text", "\n\n").alias("context"),
            F.col("_hits.id").alias("document_ids"),
            F.array_sort(F.array_distinct("_hits.source")).alias("sources"),
        )
    )


def prompt(context: Column, query: Column) -> Column:
    return F.concat(F.lit("Context:\n"), context, F.lit("\n\nUser Query:\n"), query)


def build_prompts(queries: DataFrame, gathered: DataFrame) -> DataFrame:
    """A query without hits keeps its row, with an empty context."""
    empty = F.array().cast("array<string>")
    return queries.join(gathered, "query_id", "left").select(
        "query_id",
        "query",
        F.coalesce("document_ids", empty).alias("document_ids"),
        F.coalesce("sources", empty).alias("sources"),
        prompt(F.coalesce("context", F.lit("")), F.col("query")).alias("prompt"),
    )


def answer_records(prompts: DataFrame, answer: str) -> DataFrame:
    """The record of each question; `answer` names the column with the model's text."""
    return prompts.select(
        "query_id",
        F.col("query").alias("question"),
        "sources",
        "document_ids",
        strip(F.col(answer)).alias("answer"),
    )


def fit_budget(hits: DataFrame, budget: int, pos: str = "pos") -> DataFrame:
    """Keep hits while their tokens fit; the first that does not is cut to what is left."""
    before = W.partitionBy("query_id").orderBy(pos).rowsBetween(W.unboundedPreceding, -1)
    return (
        hits.withColumn("tokens", token_count(F.col("text")))
        .withColumn("_left", F.lit(budget) - F.coalesce(F.sum("tokens").over(before), F.lit(0)))
        .where(F.col("_left") > 0)
        .withColumn(
            "text",
            F.when(F.col("tokens") <= F.col("_left"), F.col("text")).otherwise(
                trim_tokens(F.col("text"), F.col("_left").cast("int"))
            ),
        )
        .withColumn("tokens", F.least("tokens", "_left"))
        .drop("_left")
    )
