"""Shards of nearly equal bytes, by a k-d tree over document metadata.

A node that holds more than one shard's bytes is cut in two at a weighted median along its widest
dimension: language, source or size, each a coordinate in [0, 2^20). Cells of the tree are the
shards. The order inside a dimension is coordinate, text, row, so a coordinate that a third of all
documents share can be cut anywhere; equal texts lie next to each other and are parted only where
a cut falls among them.

A median is found in the distributed rows digit by digit: bytes are summed per node and digit
(map-side combined; at most 2^DIGIT_BITS sums per node reach the driver), the digit that holds the
wanted share is entered, and so on until the rest is small against a shard or the key ends. The tree itself is a
few numbers, and as each row's key depends on the row alone, the cell of a row is an expression: applying the
tree moves nothing.

Everything runs in built-in functions. Cases: a null text has size 1, null languages and sources
are values of their own; equal rows have equal keys, so a cut leaves them on one side; an empty table gives an empty table; other
columns pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from passages.llm.storage import stored

SHARDS = 16
DIMENSIONS = ("size", "source", "lang")
COORDINATE_BITS = 20
TEXT_BITS = 22
ROW_BITS = 20
KEY_BITS = COORDINATE_BITS + TEXT_BITS + ROW_BITS
DIGIT_BITS = 10
#: A cut may miss its share by this part of a shard.
TOLERANCE = 0.001
SLOT_ROWS = 4_096


@dataclass
class Node:
    """A cell: which shards it holds and, if cut, where. Rows with key < at go left."""

    first: int
    shards: int
    dimension: str | None = None
    at: int = 0
    left: Node | None = None
    right: Node | None = None

    def leaves(self) -> list[Node]:
        return [self] if self.dimension is None else self.left.leaves() + self.right.leaves()


def text_size() -> Column:
    return F.coalesce(F.octet_length(F.col("text").cast("string")).cast("long"), F.lit(0).cast("long")) + 1


def _spread(value: Column) -> Column:
    """A text value as a coordinate; equal values share it."""
    return F.shiftright(F.xxhash64(value).bitwiseAND(F.lit((1 << 62) - 1)), 62 - COORDINATE_BITS)


def keys(docs: DataFrame, row_key: Column) -> dict[str, Column]:
    """Per dimension the order of rows: coordinate, text, row."""
    top = 1 << COORDINATE_BITS
    coordinates = {
        # Sizes spread over twenty doublings and more.
        "size": F.least(F.floor(F.log2(text_size()) * (top // 32)), F.lit(top - 1)).cast("long"),
        "source": _spread(F.col("source").cast("string")),
        "lang": _spread(F.col("lang").cast("string")),
    }
    text = F.xxhash64(F.col("text").cast("string")).bitwiseAND(F.lit((1 << TEXT_BITS) - 1))
    row = F.xxhash64(F.lit(1), row_key).bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    tail = F.shiftleft(text, ROW_BITS) + row
    return {k: F.shiftleft(v, TEXT_BITS + ROW_BITS) + tail for k, v in coordinates.items()}


def _cell(root: Node, key: dict[str, Column], of) -> Column:
    if root.dimension is None:
        return F.lit(of(root))
    return F.when(key[root.dimension] < root.at, _cell(root.left, key, of)).otherwise(
        _cell(root.right, key, of)
    )


def shard_of(root: Node, key: dict[str, Column]) -> Column:
    return _cell(root, key, lambda leaf: leaf.first)


def grow_tree(rows: DataFrame, shards: int = SHARDS) -> Node:
    """The tree for rows(bytes, and a key column per dimension)."""
    root = Node(0, shards)
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    shift = TEXT_BITS + ROW_BITS
    while total and (open_nodes := [n for n in root.leaves() if n.shards > 1]):
        numbers = {id(n): k for k, n in enumerate(open_nodes)}
        cell = _cell(root, {k: F.col(k) for k in DIMENSIONS}, lambda n: numbers.get(id(n), -1))
        here = rows.withColumn("node", cell).where("node >= 0")
        extents = here.groupBy("node").agg(
            F.sum("bytes").alias("bytes"),
            *((F.shiftright(F.max(k), shift) - F.shiftright(F.min(k), shift)).alias(k) for k in DIMENSIONS),
        )
        # A cell without rows is cut anywhere.
        widest, wanted = [0] * len(open_nodes), [0.0] * len(open_nodes)
        for r in extents.collect():
            node = open_nodes[r["node"]]
            widest[r["node"]] = max(range(len(DIMENSIONS)), key=lambda d: r[DIMENSIONS[d]])
            wanted[r["node"]] = r["bytes"] * (node.shards // 2) / node.shards
        cuts = _medians(here, widest, wanted, TOLERANCE * total / shards)
        for node, d, at in zip(open_nodes, widest, cuts):
            half = node.shards // 2
            node.dimension, node.at = DIMENSIONS[d], at
            node.left = Node(node.first, half)
            node.right = Node(node.first + half, node.shards - half)
    return root


def _medians(here: DataFrame, dimension: list[int], wanted: list[float], tolerance: float) -> list[int]:
    """Per node the key with about the wanted bytes below it."""
    of_node = lambda values: F.array(*(F.lit(v) for v in values))[F.col("node")]
    key = F.array(*DIMENSIONS)[of_node(dimension)]
    low = [0] * len(wanted)
    below = [0] * len(wanted)
    done: dict[int, int] = {}
    shift = KEY_BITS
    while len(done) < len(wanted):
        width, shift = shift, max(0, shift - DIGIT_BITS)
        # Nodes that are done have no row with this key.
        entered = of_node([-1 if i in done else low[i] >> width for i in range(len(low))])
        sums = (
            here.where(F.shiftright(key, width) == entered)
            .groupBy("node", F.shiftright(key, shift).alias("digit"))
            .agg(F.sum("bytes").alias("bytes"))
        )
        found: dict[int, list] = {}
        for r in sums.collect():
            found.setdefault(r["node"], []).append((r["digit"], r["bytes"]))
        for i in range(len(wanted)):
            if i in done:
                continue
            for digit, size in sorted(found.get(i, [])):
                before, after = wanted[i] - below[i], below[i] + size - wanted[i]
                if after < 0:
                    below[i] += size
                    continue
                if shift == 0 or min(before, after) <= tolerance:
                    done[i] = (digit if before <= after else digit + 1) << shift
                else:
                    low[i] = digit << shift
                break
            else:
                done[i] = 1 << KEY_BITS
    return [done[i] for i in range(len(wanted))]


def _thin(docs: DataFrame) -> DataFrame:
    key = keys(docs, F.col("doc_id"))
    return docs.select(
        "doc_id",
        text_size().alias("bytes"),
        F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("text_crc32"),
        *(v.alias(k) for k, v in key.items()),
    )


def with_slots(assigned: DataFrame, order: list[str]) -> DataFrame:
    """Adds slot, counting from 0 inside each shard without gaps.

    Two steps: rows of a shard are hashed to bins of about SLOT_ROWS, counted, and numbered in
    their bin; the counts of the bins before are added.
    """
    rows = assigned.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    most = rows.agg(F.max("n")).first()[0] or 0
    bins = max(1, most // SLOT_ROWS)
    binned = assigned.withColumn("bin", F.pmod(F.xxhash64(*order), F.lit(bins)))
    earlier = W.partitionBy("shard").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        binned.groupBy("shard", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "bin", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("bin_start"))
    )
    inside = F.row_number().over(W.partitionBy("shard", "bin").orderBy(*order))
    return (
        binned.withColumn("inside", inside)
        .join(starts, ["shard", "bin"])
        .withColumn("slot", F.col("bin_start") + F.col("inside") - 1)
        .drop("bin", "inside", "bin_start")
    )


def shard_report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document."""
    rows = stored(_thin(docs))
    root = grow_tree(rows, shards)
    assigned = rows.select(
        "doc_id",
        F.col("bytes").alias("size"),
        "text_crc32",
        shard_of(root, {k: F.col(k) for k in DIMENSIONS}).cast("int").alias("shard"),
    )
    return with_slots(assigned, ["doc_id", "size", "text_crc32"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The documents with their shard, each where it lies; `shard` replaces a column of that name."""
    root = grow_tree(stored(_thin(docs)), shards)
    return docs.withColumn("shard", shard_of(root, keys(docs, F.col("doc_id"))).cast("int"))
