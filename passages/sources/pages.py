"""Page texts to document texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGES_PER_PIECE = 256


def _joined(order: str, text: str):
    parts = F.array_sort(F.collect_list(F.struct(order, F.col(text).alias("text"))))
    return F.array_join(F.transform(parts, lambda x: x["text"]), "")


def concat_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, text): the pages of a document in page order, with nothing in between.

    Pages are joined in pieces first, so that only finished pieces meet in the task of a long
    document. The result is one value per document; for chunks of documents that are too
    large for that use `operators.chunk.chunk_pages`, which never builds the whole text.
    """
    pieces = pages.groupBy("doc_id", F.floor(F.col("page_no") / PAGES_PER_PIECE).alias("piece")).agg(
        _joined("page_no", "text").alias("text")
    )
    return pieces.groupBy("doc_id").agg(_joined("piece", "text").alias("text"))
