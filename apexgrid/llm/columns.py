"""Column helpers the operators share."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from apexgrid.session import ship_package

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def text_or_empty(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def n_words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_DEFAULT = "67108864b"  # fixed value: what Spark reports where nothing is set


def prepare(spark: SparkSession) -> None:
    """Make this package importable in the tasks, and bound the bytes of an Arrow batch where the session has not done so:
    whole texts are long rows, and a batch is held by the JVM and by the Python worker at once."""
    ship_package(spark)
    if spark.conf.get(BATCH_BYTES) == BATCH_DEFAULT:
        spark.conf.set(BATCH_BYTES, "8m")
