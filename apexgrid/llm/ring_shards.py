"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Method: the ring is ``SLICES`` equal slices of the hash range. Every shard has ``virtual_nodes`` positions on it. A
key's first choice is the shard met first clockwise from its slice; a shard that is full passes the keys it cannot take on
clockwise to the next shard. With capacities that add up to the number of rows (``slack=0``) every shard ends exactly full, so
counts differ by one at most; a larger slack moves fewer keys when the number of shards changes.

Only counts per slice enter the placement: a table of ``SLICES`` rows, whatever the input. One round per shard
lets all waiting pieces of slices ask their next shard; a window over the pieces that ask a shard fills it up to its
capacity and splits the piece at which it becomes full. The rows are then numbered inside their slice, and slice and
number decide shard and slot. The texts are reduced to length and checksum before the only shuffle of rows, which is by slice,
that is by hash, so neither a frequent text nor a frequent source meets in a task.

Cases: null text is empty (size 1, checksum 0); the key is id, size and checksum, so rows with a null id spread; rows
repeated as a whole are equal keys and fill consecutive slots; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apexgrid.llm.columns import text_or_empty
from apexgrid.session import materialised

SHARDS = 8
VIRTUAL_NODES = 32
SLICE_BITS = 14
SLICES = 1 << SLICE_BITS


def ring(shards: int, virtual_nodes: int) -> list[list[int]]:
    """Positions of each shard on the ring; a shard's positions do not depend on the other shards."""

    def position(shard: int, node: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{shard}/{node}".encode(), digest_size=8).digest(), "big") % SLICES

    return [[position(s, v) for v in range(virtual_nodes)] for s in range(shards)]


def preference(at: Column, shards: int, virtual_nodes: int) -> Column:
    """All shards in the order in which they are met clockwise from a slice."""
    ways = []
    for shard, positions in enumerate(ring(shards, virtual_nodes)):
        nearest = F.array_min(F.transform(F.lit(positions), lambda p: F.pmod(p - at, F.lit(SLICES))))
        ways.append(F.struct(nearest.alias("way"), F.lit(shard).alias("shard")))
    return F.transform(F.array_sort(F.array(*ways)), lambda w: w["shard"])


def capacity(shard: Column, rows: int, shards: int, slack: float) -> Column:
    if slack:
        return F.lit(-int(-rows * (1 + slack) // shards))
    return F.lit(rows // shards) + F.when(shard < rows % shards, 1).otherwise(0)


def placement(counts: DataFrame, rows: int, shards: int, virtual_nodes: int, slack: float) -> DataFrame:
    """Pieces of slices with their shard: rows ``low`` to ``high - 1`` of a slice have slots from ``base`` on."""
    pieces = counts.select(
        "slice",
        F.lit(0).cast("bigint").alias("low"),
        F.col("n").alias("high"),
        F.lit(None).cast("int").alias("shard"),
        preference(F.col("slice"), shards, virtual_nodes).alias("ways"),
    )
    for turn in range(shards):
        asked = pieces.withColumn("asked", F.coalesce("shard", F.element_at("ways", turn + 1)))
        # who has a place keeps it; the others ask in an order of their own, not that of the ring
        order = Window.partitionBy("asked").orderBy(F.col("shard").isNull(), F.xxhash64("slice"), "slice", "low")
        held = F.coalesce(F.sum(F.col("high") - F.col("low")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        room = capacity(F.col("asked"), rows, shards, slack) - held
        fits = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("high") - F.col("low"), room))
        split = asked.withColumn("to", F.col("low") + F.when(F.col("shard").isNull(), fits).otherwise(F.col("high") - F.col("low")))
        taken = F.struct(F.col("low"), F.col("to").alias("high"), F.col("asked").alias("shard"))
        passed = F.struct(F.col("to").alias("low"), F.col("high"), F.lit(None).cast("int").alias("shard"))
        parts = split.select("slice", "ways", F.explode(F.array(taken, passed)).alias("p")).select("slice", "ways", "p.*")
        pieces = parts.filter("low < high")
    order = Window.partitionBy("shard").orderBy("slice", "low").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum(F.col("high") - F.col("low")).over(order), F.lit(0))
    return pieces.select("slice", "low", "high", "shard", base.alias("base"))


def shard(
    df: DataFrame,
    shards: int = SHARDS,
    virtual_nodes: int = VIRTUAL_NODES,
    slack: float = 0.0,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per row of ``df``: ``doc_id, size, text_crc32, shard, slot``."""
    data = text_or_empty(text).cast("binary")
    key = F.xxhash64("doc_id", "size", "text_crc32")
    slim = df.select(F.col(doc_id).alias("doc_id"), (F.octet_length(data) + 1).cast("bigint").alias("size"), F.crc32(data).alias("text_crc32"))
    slim = slim.withColumn("slice", F.shiftrightunsigned(key, 64 - SLICE_BITS)).withColumn("key", key)
    counts = materialised(slim.groupBy("slice").agg(F.count("*").alias("n")))
    rows = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    pieces = materialised(placement(counts, rows, shards, virtual_nodes, slack))
    numbered = slim.withColumn("number", F.row_number().over(Window.partitionBy("slice").orderBy("key", "doc_id", "size", "text_crc32")) - 1)
    found = numbered.join(pieces, "slice").filter((F.col("number") >= F.col("low")) & (F.col("number") < F.col("high")))
    return found.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("number") - F.col("low")).alias("slot"))
