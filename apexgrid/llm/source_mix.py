"""Mixing of sources to target weights by hash thresholds over histograms, without sorting documents.

Method: a document's hash orders the documents of a source at random but repeatably. The words of each (source, hash bucket)
are summed; the bucket in which the source's budget ends is the boundary bucket, and everything below it is in. Only
the boundary bucket is split into finer buckets, ``LEVELS`` times by ``BITS`` bits, each threshold nested in the one before.
What is left is a cell of about one document in ``2^(LEVELS * BITS)``; its few rows are taken in hash order while that brings
the source nearer its budget. A budget above the source's size takes every document once (twice) and applies the
thresholds to the further copy, so a document is taken 0, 1 or 2 times.

All tables but the documents are bounded: ``2^BITS`` rows per source, then one row per source. The documents are read once for
the sizes (kept as id, source, size and hash) and filtered by comparison of their hash with their source's threshold.

Cases: null text has size 0; the null source is a source, after all others; a source without words has target 0; rows repeated
with id and text share a hash and may be taken in part (any of them, they are equal); reruns agree, since hashes come from id
and text alone; an empty table gives no rows; other columns, also of the names used here, are not touched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apexgrid.llm.columns import n_words, text_or_empty
from apexgrid.session import materialised

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BITS = 12
LEVELS = 3

_KEY = ["_source", "_no_source"]


def keyed(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``df`` with size, hash and source key."""
    return df.withColumns(
        {
            "_size": n_words(text_or_empty(text)),
            "_hash": F.xxhash64(F.col(doc_id), F.col(text)),
            "_source": F.coalesce(F.col(source), F.lit("")),
            "_no_source": F.col(source).isNull(),
        }
    )


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: its size, target, number of full copies and words of the copy to be cut.

    Sharing by weight, stopping at ``most`` times the size and sharing the excess again ends where every source gets the smaller
    of its limit and weight x level. With sources in order of limit / weight the level follows from sums over
    those before (at their limit) and the rest (by weight).
    """
    sizes = rows.groupBy(*_KEY).agg(F.sum("_size").alias("_source_size"))
    # windows over one row per source
    number = F.row_number().over(Window.orderBy("_no_source", "_source")) - 1
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (number % len(weights) + 1).cast("int"))
    weighed = sizes.withColumn("_weight", weight).withColumn("_limit", F.col("_source_size") * most)
    weighed = weighed.withColumn("_ratio", F.col("_limit") / F.col("_weight"))
    order = Window.orderBy("_ratio", *_KEY).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_ratio", *_KEY).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("_source_size").over(everything) * share
    left = budget - F.coalesce(F.sum("_limit").over(order), F.lit(0))
    level = left / (F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(order), F.lit(0)))
    leveled = weighed.withColumn("_level", level)
    top = F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(everything)
    shared = F.least(F.col("_limit").cast("double"), F.coalesce(top * F.col("_weight"), F.col("_limit").cast("double")))
    full = F.when(F.col("_source_size") > 0, F.floor(F.col("_target") / F.col("_source_size"))).otherwise(0)
    return (
        leveled.withColumn("_target", shared)
        .withColumn("_full", full.cast("bigint"))
        .withColumn("_need", F.col("_target") - F.col("_full") * F.col("_source_size"))
        .select(*_KEY, "_source_size", "_weight", "_target", "_full", "_need")
    )


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """Boundary cell of each source with words, and the words still to take from it: ``_cell, _rest``."""
    cuts = goals.select(*_KEY, F.col("_need").alias("_rest"), F.lit(0).cast("bigint").alias("_cell"))
    for level in range(1, LEVELS + 1):
        shift = 64 - BITS * level
        inside = rows.join(cuts, _KEY)
        if level > 1:
            inside = inside.filter(F.shiftrightunsigned("_hash", shift + BITS) == F.col("_cell"))
        buckets = inside.groupBy(*_KEY, "_rest", F.shiftrightunsigned("_hash", shift).alias("_cell")).agg(F.sum("_size").alias("_words"))
        upto = F.sum("_words").over(Window.partitionBy(*_KEY).orderBy("_cell"))
        ending = buckets.withColumn("_upto", upto).filter((F.col("_upto") - F.col("_words") <= F.col("_rest")) & (F.col("_rest") < F.col("_upto")))
        cuts = materialised(ending.select(*_KEY, (F.col("_rest") - F.col("_upto") + F.col("_words")).alias("_rest"), "_cell"))
    return cuts


def copies(rows: DataFrame, goals: DataFrame, cuts: DataFrame) -> DataFrame:
    """``rows`` (from ``keyed``) with the facts of their source and ``_copies``, how many times each is taken."""
    known = rows.join(goals, _KEY).join(cuts, _KEY, "left")
    cell = F.shiftrightunsigned("_hash", 64 - BITS * LEVELS)
    decided = known.filter(F.col("_cell").isNull() | (cell != F.col("_cell")))
    extra = F.when(cell < F.col("_cell"), 1).otherwise(0)
    # about one row per source
    order = Window.partitionBy(*_KEY).orderBy("_hash", "_size")
    upto = F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    boundary = known.filter(cell == F.col("_cell")).withColumn("_upto", upto)
    nearer = F.when(F.col("_upto") - F.col("_size") / 2 <= F.col("_rest"), 1).otherwise(0)
    return decided.withColumn("_copies", F.col("_full") + extra).unionByName(
        boundary.withColumn("_copies", F.col("_full") + nearer).drop("_upto")
    )


def mixed(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row per row of ``df``: ``doc_id, source, size, source_size, weight, target, copies, taken``."""
    slim = materialised(keyed(df.select(doc_id, source, text), doc_id, source, text).drop(text))
    goals = materialised(targets(slim))
    out = copies(slim, goals, thresholds(slim, goals))
    return out.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_weight").alias("weight"),
        F.col("_target").alias("target"),
        F.col("_copies").alias("copies"),
        (F.col("_copies") * F.col("_size")).alias("taken"),
    )


def mixture(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of ``df`` that the mix takes, as often as it takes them. Texts are not shuffled: each row is compared with the
    threshold of its source."""
    # the row as one value, so that no column of it can be mistaken for one of those added here
    rows = keyed(df.select(F.struct("*").alias("_row")), f"_row.{doc_id}", f"_row.{source}", f"_row.{text}")
    slim = materialised(rows.select("_size", "_hash", *_KEY))
    goals = materialised(targets(slim))
    out = copies(rows, goals, thresholds(slim, goals))
    repeats = F.explode(F.array_repeat(F.lit(1), F.col("_copies").cast("int")))
    return out.filter("_copies > 0").withColumn("_copy", repeats).select("_row.*")
