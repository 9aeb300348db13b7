"""Lap detection, lap labels, and the join of samples to laps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apexgrid.chunking import (
    CHUNK_ROWS,
    CORE,
    chunk_window,
    dense_index,
    explode_span,
    spread_join,
    with_halo,
)
from apexgrid.functions.scalar import format_duration
from apexgrid.operators.catalog import normalised, only_channels, pick_named
from apexgrid.schema import FREQ, IDX, SESSION, VALUE

LAP = ["number", "name", "start_time", "end_time"]

# seconds per join bucket; laps and samples meet on (session, bucket)
BUCKET_SECS = 4

TIMER_NAMES = ["lap time running"]
NUMBER_NAMES = ["lap number"]


def detect_from_timer(timer: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Laps from resets of a running lap timer: a drop of more than one second, less the time already on it.

    ``timer(session_id, sample_idx, freq, value)``. Sessions without a reset give no laps.
    """
    fell = F.coalesce(
        F.nanvl(F.col("_previous") - F.col(VALUE), F.lit(None).cast("double")) > 1.0, F.lit(False)
    )
    crossing = F.greatest(F.col(IDX) / F.col(FREQ) - F.col(VALUE), F.lit(0.0))
    events = _boundary_events(timer, fell, crossing, chunk_rows)
    return _laps_between(events, whole_session=False, chunk_rows=chunk_rows)


def detect_from_number(lap_number: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Laps from changes of a lap-number channel; without a change the whole session is ``Lap 1``."""
    changed = F.col("_previous").isNotNull() & (_whole("_previous") != _whole(VALUE))
    events = _boundary_events(lap_number, changed, F.col(IDX) / F.col(FREQ), chunk_rows)
    return _laps_between(events, whole_session=True, chunk_rows=chunk_rows)


def detect_laps(timer: DataFrame, lap_number: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Timer laps where a session has any, else lap-number laps."""
    preferred = detect_from_timer(timer, chunk_rows)
    fallback = detect_from_number(lap_number, chunk_rows)
    timed = preferred.filter(F.col("number") == 0).select(SESSION)
    return preferred.unionByName(fallback.join(timed, SESSION, "left_anti"))


def lap_channel(samples: DataFrame, names: list[str], catalog: DataFrame) -> DataFrame:
    """Samples of the first channel of each session whose normalised name is one of ``names``."""
    picked = pick_named(catalog, names).withColumnRenamed("channel", "_picked")
    candidates = only_channels(samples, catalog, normalised(F.col("channel")).isin(names))
    return (
        spread_join(candidates, picked, [SESSION], IDX)
        .filter(F.col("channel") == F.col("_picked"))
        .select(SESSION, IDX, FREQ, VALUE)
    )


def _whole(column: str) -> Column:
    """Truncation to a 64-bit integer that saturates; NaN counts as 0."""
    v = F.col(column)
    limit = float(2**63)
    return (
        F.when(F.isnan(v), F.lit(0))
        .when(v >= limit, F.lit(2**63 - 1))
        .when(v <= -limit, F.lit(-(2**63 - 1) - 1))
        .otherwise(v.cast("bigint"))
    )


def _boundary_events(series: DataFrame, hit: Column, at: Column, chunk_rows: int) -> DataFrame:
    """Session start, every boundary and session end as ``(session_id, pos, at, is_end)``, in one pass."""
    order = chunk_window([SESSION], IDX)
    rows = (
        with_halo(
            series.filter(F.col(FREQ) > 0).select(SESSION, IDX, FREQ, VALUE), IDX, 1, 1, chunk_rows
        )
        .withColumn("_previous", F.lag(VALUE).over(order))
        .withColumn("_following", F.lead(IDX).over(order))
        .filter(CORE)
    )
    first, last = F.col("_previous").isNull(), F.col("_following").isNull()
    nothing = F.lit(None)
    size = F.col(IDX) + 1

    def event(pos: Column, time: Column, is_end: bool) -> Column:
        return F.struct(
            pos.cast("bigint").alias("pos"), time.cast("double").alias("at"), F.lit(is_end).alias("is_end")
        )

    found = F.array_compact(
        F.array(
            F.when(first, event(F.lit(-1), F.lit(0.0), False)).otherwise(nothing),
            F.when(hit, event(F.col(IDX), at, False)).otherwise(nothing),
            F.when(last, event(size, size / F.col(FREQ), True)).otherwise(nothing),
        )
    )
    return rows.filter(first | hit | last).select(SESSION, F.explode(found).alias("e")).select(SESSION, "e.*")


def _laps_between(events: DataFrame, whole_session: bool, chunk_rows: int) -> DataFrame:
    """Label the intervals between consecutive events: Out Lap, Lap 1 .. n, In Lap."""
    k = "number"
    numbered = dense_index(events, [SESSION], "pos", k, chunk_rows)
    order = chunk_window([SESSION], k)
    pairs = (
        with_halo(numbered, k, 0, 1, chunk_rows)
        .withColumn("end_time", F.lead("at").over(order))
        .withColumn("_last", F.lead("is_end").over(order))
        .filter(F.col(CORE) & ~F.col("is_end"))
    )
    single = (F.col(k) == 0) & F.col("_last")
    if not whole_session:
        pairs = pairs.filter(~single)
    name = (
        F.when(single, F.lit("Lap 1"))
        .when(F.col(k) == 0, F.lit("Out Lap"))
        .when(F.col("_last"), F.lit("In Lap"))
        .otherwise(F.concat(F.lit("Lap "), F.col(k)))
    )
    return pairs.select(
        SESSION,
        F.when(single, F.lit(1)).otherwise(F.col(k)).cast("int").alias(k),
        name.alias("name"),
        F.col("at").alias("start_time"),
        "end_time",
    )


def lap_list(laps: DataFrame) -> DataFrame:
    """Laps with duration and its display text."""
    duration = F.col("end_time") - F.col("start_time")
    return laps.withColumn("duration", duration).withColumn("duration_text", format_duration(duration))


def select_lap(rows: DataFrame, number: int | None) -> DataFrame:
    """Rows of one lap, or of all."""
    return rows if number is None else rows.filter(F.col("number") == number)


def bucketed_laps(laps: DataFrame, bucket_secs: int = BUCKET_SECS) -> DataFrame:
    """One row per lap and time bucket that a sample of the lap may fall in.

    A lap reaches at most one sample before its start and after its end, and rates are at least 1 Hz, hence the
    second of margin.
    """
    from_bucket = F.floor(F.greatest(F.col("start_time") - 1.0, F.lit(0.0)) / bucket_secs)
    to_bucket = F.floor((F.greatest(F.col("end_time"), F.col("start_time")) + 1.0) / bucket_secs)
    return explode_span(laps, from_bucket, to_bucket, "_bucket", [SESSION, "number"])


def with_laps(samples: DataFrame, laps: DataFrame, bucket_secs: int = BUCKET_SECS) -> DataFrame:
    """Each sample once, with the laps it belongs to as ``_laps``: ``floor(start*f) <= idx < ceil(end*f)``. There may be none, or several.

    The join is an equi-join on ``(session, bucket)``. The laps of a bucket are one row, so the side of the laps has at most one row where the
    other has the samples that all channels recorded in those seconds: it is always the one to be hashed, and the samples are not sorted.
    """
    rate, i = F.col(FREQ), F.col(IDX)
    own = F.struct(*(c for c in laps.columns if c != SESSION))
    buckets = bucketed_laps(laps, bucket_secs).groupBy(SESSION, "_bucket").agg(F.collect_list(own).alias("_laps"))
    # samples without a rate have no time; their buckets are spread, and met by no lap
    bucket = F.when(rate > 0, F.floor(i / rate / bucket_secs)).otherwise(-1 - F.floor(i / (1 << 12)))
    rows = samples.withColumn("_bucket", bucket).join(buckets.hint("shuffle_hash"), [SESSION, "_bucket"], "left")
    inside = F.filter("_laps", lambda l: (i >= F.floor(l["start_time"] * rate)) & (i < F.ceil(l["end_time"] * rate)))
    return rows.withColumn("_laps", inside).drop("_bucket").select(*samples.columns, "_laps")


def assign_laps(
    samples: DataFrame, laps: DataFrame, bucket_secs: int = BUCKET_SECS, keep_empty: bool = False
) -> DataFrame:
    """Each sample with every lap it belongs to. A boundary sample can belong to two laps. With ``keep_empty`` a lap without
    samples yields one row without a sample."""
    own = [c for c in samples.columns if c != SESSION]
    of_lap = [c for c in laps.columns if c != SESSION]
    rows = with_laps(samples, laps, bucket_secs).select(SESSION, *own, F.explode("_laps").alias("_lap"))
    rows = rows.select(SESSION, *own, *(F.col("_lap")[c].alias(c) for c in of_lap))
    if keep_empty:
        empty = laps.join(rows.select(SESSION, "number").distinct(), [SESSION, "number"], "left_anti")
        rows = rows.unionByName(empty, allowMissingColumns=True)
    return rows
