"""Running totals inside groups of any size.

A plain window over the whole group would put a group with a third of all rows into one
task. Here the group is cut into blocks of consecutive integer keys: one window runs inside
each block (at most `width` distinct keys), a second one over the block totals (one row per
block), and the two are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK_WIDTH = 4_096


def running_offset(
    df: DataFrame,
    group: str,
    order: str,
    amount: Column,
    out: str,
    width: int | None = None,
) -> DataFrame:
    """Sum of `amount` over the rows of the same group that come before this one.

    `order` is an integer column without repeats inside a group, `group` is not null. Close
    numbers make few blocks. Keys that are far apart, such as hashes, get wider blocks: `width` follows
    from their range and number, so that a block has about BLOCK_WIDTH rows.
    """
    if width is None:
        low, high, rows = df.agg(F.min(order), F.max(order), F.count(F.lit(1))).first()
        width = max(BLOCK_WIDTH, (high - low) * BLOCK_WIDTH // rows) if rows else BLOCK_WIDTH
    blocked = df.withColumn("_block", F.floor(F.col(order) / width)).withColumn("_amount", amount)
    earlier_blocks = W.partitionBy(group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    block_start = (
        blocked.groupBy(group, "_block")
        .agg(F.sum("_amount").alias("_total"))
        .select(
            group,
            "_block",
            F.coalesce(F.sum("_total").over(earlier_blocks), F.lit(0)).alias("_start"),
        )
    )
    earlier_rows = (
        W.partitionBy(group, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    )
    inside = blocked.withColumn("_inside", F.coalesce(F.sum("_amount").over(earlier_rows), F.lit(0)))
    return (
        inside.join(block_start, [group, "_block"])
        .withColumn(out, F.col("_start") + F.col("_inside"))
        .drop("_block", "_amount", "_start", "_inside")
    )
