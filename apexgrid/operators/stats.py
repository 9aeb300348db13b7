"""Channel statistics, the per-lap report and session summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apexgrid.functions.scalar import arg, is_finite, nan
from apexgrid.operators.laps import with_laps
from apexgrid.schema import CHANNEL, FREQ, IDX, SERIES, SESSION, VALUE

WHOLE_SESSION = "All"


def channel_stats(samples: DataFrame, keys: Sequence[str] = SERIES, value: str = VALUE) -> DataFrame:
    """Minimum, maximum, average and population deviation of the finite values; all 0 if there are none."""
    v = F.when(is_finite(value), F.col(value))
    zero = F.lit(0.0)
    return samples.groupBy(*keys).agg(
        F.coalesce(F.min(v), zero).alias("min_value"),
        F.coalesce(F.max(v), zero).alias("max_value"),
        F.coalesce(F.avg(v), zero).alias("avg_value"),
        F.coalesce(F.stddev_pop(v), zero).alias("std_value"),
    )


def lap_report(samples: DataFrame, laps: DataFrame) -> DataFrame:
    """Statistics of every channel for the whole session (``lap = 'All'``) and for each lap.

    One pass: a sample counts for the session and for each of its laps before the partial aggregates are shuffled.
    """
    intervals = laps.select(SESSION, "number", F.col("name").alias("lap"), "start_time", "end_time")
    rows = with_laps(samples.select(*SERIES, FREQ, IDX, VALUE), intervals)
    part = "struct<lap_number: int, lap: string>"
    whole = F.array(F.struct(F.lit(None).alias("lap_number"), F.lit(WHOLE_SESSION).alias("lap"))).cast(f"array<{part}>")
    own = F.transform("_laps", lambda l: F.struct(l["number"].alias("lap_number"), l["lap"].alias("lap"))).cast(f"array<{part}>")
    parts = F.explode(F.concat(whole, F.coalesce(own, F.array().cast(f"array<{part}>"))))
    counted = rows.select(*SERIES, VALUE, parts.alias("_part")).select(*SERIES, VALUE, "_part.lap_number", "_part.lap")
    return channel_stats(counted, [*SERIES, "lap_number", "lap"])


def channel_summary(samples: DataFrame) -> DataFrame:
    """Minimum, maximum and mean as a running loop gives them.

    NaN makes the mean NaN; a NaN first sample also makes minimum and maximum NaN, a later one is skipped.
    """
    known = F.when(~F.isnan(VALUE), F.col(VALUE))
    seeded = F.isnan(F.min_by(VALUE, IDX))
    return samples.groupBy(*SERIES).agg(
        F.max(FREQ).alias(FREQ),
        F.count(F.lit(1)).alias("n_samples"),
        F.when(seeded, nan()).otherwise(F.min(known)).alias("min_value"),
        F.when(seeded, nan()).otherwise(F.max(known)).alias("max_value"),
        F.avg(VALUE).alias("mean_value"),
    )


def catalog_of(samples: DataFrame) -> DataFrame:
    """Channel catalogue derived from samples: ``(session_id, channel, freq, n_data)``."""
    return samples.groupBy(*SERIES).agg(
        F.max(FREQ).alias(FREQ), F.count(F.lit(1)).alias("n_data")
    )


def rate_counts(channels: DataFrame) -> DataFrame:
    """Number of channels per sample rate, ascending."""
    return channels.groupBy(FREQ).agg(F.count(F.lit(1)).alias("n_channels")).orderBy(FREQ)


def session_duration(channels: DataFrame) -> DataFrame:
    """Longest channel of each session in seconds; a channel without a rate counts as 0."""
    secs = F.when(F.col(FREQ) > 0, F.try_divide(F.col("n_data").cast("double"), F.col(FREQ).cast("double")))
    return channels.groupBy(SESSION).agg(
        F.coalesce(F.max(secs), F.lit(0.0)).alias("duration"),
        F.count(F.lit(1)).alias("n_channels"),
    )


def session_summary(sessions: DataFrame, channels: DataFrame, laps: DataFrame) -> DataFrame:
    """Header columns with duration, parsed channel count and lap count."""
    counted = laps.groupBy(SESSION).agg(F.count(F.lit(1)).alias("n_laps"))
    return (
        sessions.join(session_duration(channels), SESSION, "left")
        .join(counted, SESSION, "left")
        .withColumn("duration", F.coalesce("duration", F.lit(0.0)))
        .withColumn("n_channels", F.coalesce("n_channels", F.lit(0)))
        .withColumn("n_laps", F.coalesce("n_laps", F.lit(0)))
    )


def value_range(rows: DataFrame, keys: Sequence[str], value: str = VALUE) -> DataFrame:
    """Smallest and largest finite value, (0, 0) if there is none."""
    v = F.when(is_finite(value), F.col(value))
    return rows.groupBy(*keys).agg(
        F.coalesce(F.min(v), F.lit(0.0)).alias("vmin"), F.coalesce(F.max(v), F.lit(0.0)).alias("vmax")
    )


def display_range(samples: DataFrame, channels: Sequence[str] | None = None) -> DataFrame:
    """Common value range of a session's channels, padded by 5 % or by 1 if flat."""
    if channels is not None:
        samples = samples.filter(F.col(CHANNEL).isin(list(channels)))
    low, high = F.min("vmin"), F.max("vmax")
    pad = F.when(F.abs(high - low) < 1e-10, arg(1.0)).otherwise((high - low) * 0.05)
    return (
        value_range(samples, SERIES)
        .groupBy(SESSION)
        .agg((low - pad).alias("y_min"), (high + pad).alias("y_max"))
    )
