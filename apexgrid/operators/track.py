"""GPS tracks and their colouring by a channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apexgrid.chunking import (
    CHUNK,
    CHUNK_ROWS,
    chunk_facts,
    chunk_window,
    earlier_chunks,
    spread_join,
    with_chunk,
)
from apexgrid.functions.scalar import hsv_to_rgb, is_finite
from apexgrid.operators.align import OUT_IDX, resample_to_track
from apexgrid.operators.catalog import LATITUDE_PARTS, LONGITUDE_PARTS, gps_samples, pick_gps
from apexgrid.schema import CHANNEL, FREQ, IDX, SESSION, VALUE

LEGEND_STEPS = 60


def gps_positions(samples: DataFrame, catalog: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Latitude and longitude of each session side by side: ``(session_id, sample_idx, freq, lat, lon)``.

    Rows past the end of the shorter channel are dropped; ``freq`` is that of the latitude channel.
    """
    names = pick_gps(catalog, LATITUDE_PARTS).withColumnRenamed(CHANNEL, "_lat").join(
        pick_gps(catalog, LONGITUDE_PARTS).withColumnRenamed(CHANNEL, "_lon"), SESSION
    )
    named = spread_join(gps_samples(samples, catalog), names, [SESSION], IDX, chunk_rows=chunk_rows)
    is_lat, is_lon = F.col(CHANNEL) == F.col("_lat"), F.col(CHANNEL) == F.col("_lon")
    return (
        named.filter(is_lat | is_lon)
        .groupBy(SESSION, IDX)
        .agg(
            F.max(F.when(is_lat, F.col(FREQ))).alias(FREQ),
            F.max(F.when(is_lat, F.col(VALUE))).alias("lat"),
            F.max(F.when(is_lon, F.col(VALUE))).alias("lon"),
        )
    )


def gps_track(positions: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Centred track ``(session_id, sample_idx, freq, time, x, y)`` of ``positions(..., lat, lon)``.

    ``x = (lon - mean lon) * cos(mean lat)``, ``y = lat - mean lat``, means over the finite values of each channel. A point
    with a missing coordinate repeats the last good one, or (0, 0) before any. Means and last points come from one row per
    chunk, so the positions shuffle once.
    """
    lat, lon = F.col("lat"), F.col("lon")
    good = is_finite("lat") & is_finite("lon")
    rows = with_chunk(positions, IDX, chunk_rows)
    chunks = rows.groupBy(SESSION, CHUNK).agg(
        F.sum(F.when(is_finite("lat"), lat)).alias("_slat"),
        F.count(F.when(is_finite("lat"), lat)).alias("_nlat"),
        F.sum(F.when(is_finite("lon"), lon)).alias("_slon"),
        F.count(F.when(is_finite("lon"), lon)).alias("_nlon"),
        # columns by themselves: a struct would turn this into a sort aggregate
        F.max_by("lat", F.when(good, F.col(IDX))).alias("_lat"),
        F.max_by("lon", F.when(good, F.col(IDX))).alias("_lon"),
        F.max(F.when(good, F.col(IDX))).alias("_seen"),
    )
    session = Window.partitionBy(SESSION)

    def mean(total: str, count: str) -> Column:
        found = F.coalesce(F.sum(total).over(session), F.lit(0.0))
        return found / F.greatest(F.sum(count).over(session), F.lit(1))

    facts = chunks.select(
        SESSION,
        CHUNK,
        mean("_slat", "_nlat").alias("_mlat"),
        mean("_slon", "_nlon").alias("_mlon"),
        F.last(
            F.when(F.col("_seen").isNotNull(), F.struct(F.col("_lat").alias("lat"), F.col("_lon").alias("lon"))),
            ignorenulls=True,
        )
        .over(earlier_chunks([SESSION]))
        .alias("_carried"),
    )
    order = chunk_window([SESSION], IDX).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.filter(lat.isNotNull() & lon.isNotNull()).withColumn(
        "_point", F.last(F.when(good, F.struct("lat", "lon")), ignorenulls=True).over(order)
    )
    point = F.coalesce("_point", "_carried")
    x = (point["lon"] - F.col("_mlon")) * F.cos(F.radians("_mlat"))
    y = point["lat"] - F.col("_mlat")
    return local.join(facts, [SESSION, CHUNK]).select(
        SESSION,
        IDX,
        FREQ,
        (F.col(IDX) / F.col(FREQ)).alias("time"),
        F.coalesce(x, F.lit(0.0)).alias("x"),
        F.coalesce(y, F.lit(0.0)).alias("y"),
    )


def hue_of(fraction: Column) -> Column:
    """Blue for 0 through red for 1."""
    return (F.lit(1.0) - fraction) * 240.0


def track_color(
    samples: DataFrame, track: DataFrame, chunk_rows: int = CHUNK_ROWS, channel: str | None = None
) -> DataFrame:
    """Colour of each track sample by a channel: ``(session_id, channel, sample_idx, value, r, g, b, vmin, vmax)``. A track is coloured by one
    ``channel``; without it there is a colouring by each."""
    if channel is not None:
        # reaches the scan, so other channels are not read
        samples = samples.filter(F.col(CHANNEL) == channel)
    aligned = resample_to_track(samples, track, chunk_rows).select(
        SESSION, CHANNEL, F.col(OUT_IDX).alias(IDX), VALUE
    )
    v = F.when(is_finite(VALUE), F.col(VALUE))
    series = Window.partitionBy(SESSION, CHANNEL)
    ranges = (
        with_chunk(aligned, IDX, chunk_rows)
        .groupBy(SESSION, CHANNEL, CHUNK)
        .agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
        .select(
            SESSION,
            CHANNEL,
            CHUNK,
            F.coalesce(F.min("_lo").over(series), F.lit(0.0)).alias("vmin"),
            F.coalesce(F.max("_hi").over(series), F.lit(0.0)).alias("vmax"),
        )
    )
    span = F.col("vmax") - F.col("vmin")
    span = F.when(F.abs(span) < 1e-10, F.lit(1.0)).otherwise(span)
    share = (F.col(VALUE) - F.col("vmin")) / span
    share = F.when(is_finite(VALUE), F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))).otherwise(0.0)
    return (
        with_chunk(aligned, IDX, chunk_rows)
        .join(chunk_facts(ranges), [SESSION, CHANNEL, CHUNK])
        .withColumn("_hue", hue_of(share))
        .withColumn("_rgb", hsv_to_rgb("_hue"))
        .select(SESSION, CHANNEL, IDX, VALUE, "_rgb.r", "_rgb.g", "_rgb.b", "vmin", "vmax")
    )


def color_legend(ranges: DataFrame, steps: int = LEGEND_STEPS) -> DataFrame:
    """Legend stops of each row of ``ranges(..., vmin, vmax)``: step, value and colour."""
    share = F.col("step") / F.lit(float(steps - 1))
    share = share.cast("float").cast("double")
    hue = ((F.lit(1.0) - share).cast("float") * F.lit(240.0)).cast("float")
    return (
        ranges.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
        .withColumn("_rgb", hsv_to_rgb(hue))
        .withColumn("value", F.col("vmin") + (F.col("vmax") - F.col("vmin")) * F.col("step") / (steps - 1.0))
        .select(*ranges.columns, "step", "value", "_rgb.r", "_rgb.g", "_rgb.b")
    )
