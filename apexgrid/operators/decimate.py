"""Minimum/maximum decimation of series for charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apexgrid.chunking import CHUNK, CHUNK_ROWS, chunk_facts, int_div, with_chunk
from apexgrid.functions.scalar import nan
from apexgrid.schema import FREQ, IDX, SERIES, SESSION, VALUE

MIN_CHART_WIDTH = 100


def decimate(
    samples: DataFrame, width: int, chunk_rows: int = CHUNK_ROWS, only: DataFrame | None = None
) -> DataFrame:
    """At most ``width`` buckets per series with their minimum and maximum, or the raw points of short series.

    Each series may start at any index (a time window of a longer one); ``time`` is the middle of the bucket.
    ``only(session_id, channel)`` restricts the result to some series.
    """
    if width <= 0:
        return samples.limit(0).select(
            *SERIES,
            F.lit(0).cast("bigint").alias("bucket"),
            F.lit(0.0).alias("time"),
            F.lit(0.0).alias("min"),
            F.lit(0.0).alias("max"),
        )
    samples = samples.filter(F.col(FREQ) > 0).select(*SERIES, FREQ, IDX, VALUE)
    series = Window.partitionBy(*SERIES)
    facts = (
        with_chunk(samples, IDX, chunk_rows)
        .groupBy(*SERIES, CHUNK)
        .agg(F.count(F.lit(1)).alias("_n"), F.min(IDX).alias("_lo"))
        .select(
            *SERIES,
            CHUNK,
            F.sum("_n").over(series).alias("_n"),
            F.min("_lo").over(series).alias("_start"),
        )
    )
    if only is not None:
        facts = facts.join(only, list(SERIES), "left_semi")
    size = F.col("_n").cast("double") / width

    def edge(b):
        return (b.cast("double") * size).cast("bigint")

    pos = F.col(IDX) - F.col("_start")
    raw = F.col("_n") <= 2 * width
    guess = F.col("_guess")
    bucket = (
        F.when(raw, pos)
        .when(pos < edge(guess), guess - 1)
        .when(pos >= edge(guess + 1), guess + 1)
        .otherwise(guess)
    )
    rows = (
        with_chunk(samples, IDX, chunk_rows)
        .join(chunk_facts(facts), [*SERIES, CHUNK])
        .withColumn("_guess", F.floor(pos / size))
        .withColumn("bucket", bucket)
        .filter(raw | (F.col("bucket") < width))
    )
    known = F.when(~F.isnan(VALUE), F.col(VALUE))
    seeded = F.isnan(F.min_by(VALUE, IDX))
    b, n = F.col("bucket"), F.col("_n")
    first = F.when(raw, b).otherwise(edge(b))
    end = F.when(raw, b + 1).otherwise(F.least(edge(b + 1), n))
    return (
        rows.groupBy(*SERIES, "bucket")
        .agg(
            F.max(FREQ).alias(FREQ),
            F.max("_n").alias("_n"),
            F.max("_start").alias("_start"),
            F.when(seeded, nan()).otherwise(F.min(known)).alias("min"),
            F.when(seeded, nan()).otherwise(F.max(known)).alias("max"),
        )
        .select(
            *SERIES,
            "bucket",
            ((F.col("_start") + int_div(first + end, 2)) / F.col(FREQ)).alias("time"),
            "min",
            "max",
        )
    )


def time_window(samples: DataFrame, x_min: float, x_max: float) -> DataFrame:
    """Samples visible between two times; a bound of 0 or less is open."""
    rate, i = F.col(FREQ), F.col(IDX)
    visible = rate > 0
    if x_min > 0:
        visible = visible & (i >= (F.lit(float(x_min)) * rate).cast("bigint"))
    if x_max > 0:
        visible = visible & (i <= (F.lit(float(x_max)) * rate).cast("bigint"))
    return samples.filter(visible)


def chart_line(samples: DataFrame, x_min: float, x_max: float, width: int) -> DataFrame:
    """Middle of each decimated bucket over the visible time window."""
    points = decimate(time_window(samples, x_min, x_max), max(width, MIN_CHART_WIDTH))
    return points.select(*SERIES, "bucket", "time", ((F.col("min") + F.col("max")) / 2.0).alias("value"))


def overview_waveform(samples: DataFrame, picked: DataFrame, width: int) -> DataFrame:
    """Decimated representative channel of each session, scaled to [0, 1]; flat series give no rows.

    ``picked(session_id, channel)`` comes from :func:`apexgrid.operators.catalog.representative_channel`. A session has
    at most ``2 * width`` points, so the window over a session is small.
    """
    chosen = decimate(samples, width, only=picked)
    session = Window.partitionBy(SESSION)
    low = F.min(F.when(~F.isnan("min"), F.col("min"))).over(session)
    high = F.max(F.when(~F.isnan("max"), F.col("max"))).over(session)
    span = F.col("_high") - F.col("_low")
    return (
        chosen.withColumn("_low", low)
        .withColumn("_high", high)
        .filter(F.abs(span) >= 1e-10)
        .select(
            *SERIES,
            "bucket",
            "time",
            ((F.col("min") - F.col("_low")) / span).alias("low"),
            ((F.col("max") - F.col("_low")) / span).alias("high"),
        )
    )
