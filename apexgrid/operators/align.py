"""Bringing channels of unequal rate and length onto one time grid.

Both resamplers run *forward*: every source row works out which grid slots it covers and emits them, so no join
between grid and samples is needed. Slots past the end of a series hold its last value; they are produced from one
row per series by :func:`apexgrid.chunking.explode_span`, which spreads long tails over tasks.

Slot positions are computed with the same double arithmetic for every slot, ``place(i)``. The first slot of source
row ``k`` is the smallest ``i`` with ``place(i) >= k``: a guess in closed form, corrected by one where rounding
makes it miss.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apexgrid.chunking import (
    CHUNK,
    CHUNK_ROWS,
    CORE,
    chunk_facts,
    chunk_window,
    explode_span,
    with_chunk,
    with_halo,
)
from apexgrid.schema import FREQ, IDX, SERIES, SESSION, VALUE

OUT_IDX = "out_idx"
OUT_FREQ = "out_freq"


def series_facts(samples: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per chunk of each series: rate, and the series' length, first and last value."""
    per_chunk = (
        with_chunk(samples, IDX, chunk_rows)
        .groupBy(*SERIES, CHUNK)
        .agg(
            F.max(FREQ).alias(FREQ),
            (F.max(IDX) + 1).alias("_end"),
            F.min_by(VALUE, IDX).alias("_first"),
            F.max_by(VALUE, IDX).alias("_last"),
        )
    )
    series = Window.partitionBy(*SERIES)
    return per_chunk.select(
        *SERIES,
        CHUNK,
        FREQ,
        F.max("_end").over(series).alias("n"),
        F.min_by("_first", CHUNK).over(series).alias("first_value"),
        F.max_by("_last", "_end").over(series).alias("last_value"),
        (F.col(CHUNK) == F.min(CHUNK).over(series)).alias("_head"),
    )


def output_rate(facts: DataFrame, keys: tuple[str, ...] = (SESSION,)) -> DataFrame:
    """Add the grid of each session: highest rate (at least 1), longest duration and number of slots."""
    session = Window.partitionBy(*keys)
    length = F.when(F.col(FREQ) > 0, F.try_divide(F.col("n").cast("double"), F.col(FREQ).cast("double")))
    return (
        facts.withColumn(OUT_FREQ, F.greatest(F.max(FREQ).over(session), F.lit(1)))
        .withColumn("duration", F.coalesce(F.max(length).over(session), F.lit(0.0)))
        .withColumn("out_len", F.ceil(F.col("duration") * F.col(OUT_FREQ)))
    )


def resample_linear(
    samples: DataFrame, grid: DataFrame | None = None, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Linear interpolation of every channel onto its session's grid.

    ``grid(session_id, out_freq, out_len)`` defaults to the highest rate and longest duration of the session's
    channels. Returns ``(session_id, channel, out_idx, out_freq, value)``.
    """
    facts = series_facts(samples, chunk_rows)
    if grid is None:
        plan = output_rate(facts)
    else:
        plan = facts.join(grid.select(SESSION, OUT_FREQ, "out_len"), SESSION)
    return linear_on_plan(samples, plan, chunk_rows)


def linear_on_plan(
    samples: DataFrame,
    plan: DataFrame,
    chunk_rows: int = CHUNK_ROWS,
    on_track_clock: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Interpolate onto the grid of ``plan``, one row per (series, chunk) as :func:`series_facts` gives.

    ``on_track_clock`` places slot ``i`` at ``(i / out_freq) * freq`` rather than ``i * (freq / out_freq)`` and does
    not copy series that already have the grid's rate and length.
    """
    rate, grid_rate = F.col(FREQ).cast("double"), F.col(OUT_FREQ).cast("double")
    if on_track_clock:
        position = lambda i: i / grid_rate * rate
        same = F.lit(False)
    else:
        ratio = rate / grid_rate
        position = lambda i: i * ratio
        same = (F.col(FREQ) == F.col(OUT_FREQ)) & (F.col("n") == F.col("out_len"))

    def guess(k: Column) -> Column:
        return F.ceil(F.try_divide(k * grid_rate, rate))

    def first(k: Column) -> Column:
        return first_slot(k, lambda i: F.floor(position(i)), guess)

    order = chunk_window(SERIES, IDX)
    k = F.col(IDX)
    rows = (
        with_halo(samples.select(*SERIES, IDX, VALUE), IDX, 0, 1, chunk_rows)
        .withColumn("_next", F.lead(VALUE).over(order))
        .filter(F.col(CORE) & F.col("_next").isNotNull())
        .join(plan, [*SERIES, CHUNK])
        .filter(F.col(FREQ) > 0)
    )
    between = position(F.col(OUT_IDX)) - F.col(IDX)
    body = (
        _emit(rows, first(k), F.least(first(k + 1), F.col("out_len")) - 1)
        .withColumn(
            VALUE,
            F.when(same, F.col(VALUE)).otherwise(
                F.col(VALUE) * (1.0 - between) + F.col("_next") * between
            ),
        )
        .select(*SERIES, OUT_IDX, OUT_FREQ, *keep, VALUE)
    )
    stopped = F.col(FREQ) <= 0
    tail = _hold(
        plan,
        F.when(stopped, F.lit(0)).otherwise(first(F.col("n") - 1)),
        F.col("out_len") - 1,
        F.when(stopped, F.col("first_value")).otherwise(F.col("last_value")),
        keep,
    )
    return body.unionByName(tail)


def resample_nearest(
    samples: DataFrame,
    time_range: tuple[float, float] | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Nearest sample of every channel on the session's fastest grid, optionally within a time range.

    Returns ``(session_id, channel, out_idx, out_freq, value)``; a session whose range is empty gives no rows.
    """
    plan = output_rate(series_facts(samples, chunk_rows))
    grid_rate, rate = F.col(OUT_FREQ).cast("double"), F.col(FREQ).cast("double")
    if time_range is None:
        start, stop = F.lit(0.0), F.col("duration")
    else:
        start, stop = (F.lit(float(t)) for t in time_range)
    plan = plan.withColumn("_row0", F.greatest(F.floor(start * grid_rate), F.lit(0))).withColumn(
        "_row1", F.ceil(stop * grid_rate)
    )
    step = 1.0 / grid_rate
    same_rate = F.col(FREQ) == F.col(OUT_FREQ)

    def source(i: Column) -> Column:
        return F.when(same_rate, i).otherwise(F.round(i * step * rate).cast("bigint"))

    def guess(k: Column) -> Column:
        exact = F.ceil(F.try_divide((k - 0.5) * grid_rate, rate))
        return F.when(same_rate, k).otherwise(exact)

    def first(k: Column) -> Column:
        return first_slot(k, source, guess)

    k = F.col(IDX)
    rows = (
        with_chunk(samples.select(*SERIES, IDX, VALUE), IDX, chunk_rows)
        .join(chunk_facts(plan), [*SERIES, CHUNK])
        .filter(F.col(FREQ) > 0)
    )
    body = _emit(
        rows,
        F.greatest(first(k), F.col("_row0")),
        F.least(first(k + 1), F.col("_row1")) - 1,
    ).select(*SERIES, OUT_IDX, OUT_FREQ, VALUE)
    stopped = F.col(FREQ) <= 0
    tail = _hold(
        plan,
        F.greatest(
            F.when(stopped, F.lit(0)).otherwise(first(F.col("n"))), F.col("_row0")
        ),
        F.col("_row1") - 1,
        F.when(stopped, F.col("first_value")).otherwise(F.col("last_value")),
    )
    return body.unionByName(tail)


def resample_to_track(
    samples: DataFrame, track: DataFrame, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Channels interpolated at the sample times of ``track(session_id, sample_idx, freq, ...)``."""
    grid = track.groupBy(SESSION).agg(
        F.max(FREQ).alias(OUT_FREQ), (F.max(IDX) + 1).alias("out_len")
    )
    plan = series_facts(samples, chunk_rows).join(grid, SESSION)
    return linear_on_plan(samples, plan, chunk_rows, on_track_clock=True)


def first_slot(
    k: Column, place: Callable[[Column], Column], guess: Callable[[Column], Column]
) -> Column:
    """Smallest slot whose place is at least ``k``."""
    g = F.greatest(guess(k), F.lit(0))
    return F.when((g > 0) & (place(g - 1) >= k), g - 1).when(place(g) < k, g + 1).otherwise(g)


def _emit(rows: DataFrame, first: Column, last: Column) -> DataFrame:
    return (
        rows.withColumn("_from", first)
        .withColumn("_to", last)
        .filter(F.col("_from") <= F.col("_to"))
        .withColumn(OUT_IDX, F.explode(F.sequence("_from", "_to")))
    )


def _hold(
    plan: DataFrame, first: Column, last: Column, value: Column, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Constant slots ``first..last`` of each series."""
    heads = (
        plan.filter("_head")
        .withColumn("_from", first)
        .withColumn("_to", last)
        .withColumn(VALUE, value)
        .select(*SERIES, OUT_FREQ, *keep, VALUE, "_from", "_to")
    )
    slots = explode_span(heads, F.col("_from"), F.col("_to"), OUT_IDX, SERIES)
    return slots.select(*SERIES, OUT_IDX, OUT_FREQ, *keep, VALUE)
