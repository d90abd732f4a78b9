"""Stable keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chunk_id(source: Column, doc_id: Column, chunk_no: Column, text: Column) -> Column:
    """The same chunk gets the same id on a retry and on a second ingest."""
    return F.sha2(
        F.concat_ws("|", source, doc_id.cast("string"), chunk_no.cast("string"), text), 256
    )
