"""One query per operator, over whole tables, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passages.llm import (
    chat,
    decontaminate,
    html,
    licenses,
    line_dedup,
    mixing,
    ngram_join,
    quality,
    sharding,
    suffix_dedup,
    token_files,
    whitening,
    word_runs,
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf, "documents"))


def op2_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(table(spark, sf, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf, "documents"), with_text=False)


def op4_kd_shards(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard_report(table(spark, sf, "documents"))


def op5_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op6_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    # A conversation whose texts are made of control strings.
    sly = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").cast("int").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    records = chat.records_of_turns(rows.unionByName(sly))
    return chat.chat_digests(chat.format_turns(chat.canonical_turns(records)))


def op7_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf, "documents"))


def op8_main_text(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    return html.extract(pages).select(
        "page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars")
    )


def op9_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_report(table(spark, sf, "documents"))


def op10_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf, "documents"))


def op11_token_files(spark: SparkSession, sf: str) -> DataFrame:
    path = token_files.write_tokens(table(spark, sf, "documents"), tokenizers.path("byte_bpe_50k.json"))
    return token_files.token_report(token_files.read_shards(spark, path))


def op12_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whitening_report(table(spark, sf, "embeddings"))


def op13_word_runs(spark: SparkSession, sf: str) -> DataFrame:
    docs = word_runs.plant_repeats(table(spark, sf, "documents"))
    return word_runs.run_report(word_runs.find_runs(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_join,
        op2_license_scan,
        op3_suffix_dedup,
        op4_kd_shards,
        op5_decontamination,
        op6_chat_format,
        op7_source_mix,
        op8_main_text,
        op9_quality_rules,
        op10_line_dedup,
        op11_token_files,
        op12_whitening,
        op13_word_runs,
    )
}
