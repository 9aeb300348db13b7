"""Alignment inside time slices: source rows are shuffled, their up-sampled copies are not.

A slice is ``seconds`` of a session. A sample of ``freq`` Hz belongs to slice ``sample_idx div (freq * seconds)``, which needs nothing but the
row itself, so one shuffle by (session, slice) brings together everything that happens in a slice at whatever rate. The samples at
its two borders are copied into the neighbour (two per channel and slice, more for series functions that look further). A session's grid
has ``seconds * out_freq`` slots a slice; all of them are produced, interpolated and put side by side in the task that holds the slice.

Series that end before their session are held: their last sample is copied, once per slice, into the slices behind it.

Several grids of one session can share the rows: ``grids`` has a row per session and grid, and a row is used for every grid that has its channel.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apexgrid.chunking import CHUNK, CORE, chunk_facts, chunk_window, int_div
from apexgrid.operators.align import OUT_FREQ, OUT_IDX, first_slot
from apexgrid.schema import CHANNEL, FREQ, IDX, SERIES, SESSION, VALUE

SLICE_SECONDS = 64


def series_heads(samples: DataFrame) -> DataFrame:
    """One row per series: ``session_id, channel, freq, n, first_value, last_value``, by partial aggregates."""
    return samples.groupBy(*SERIES).agg(
        F.max(FREQ).alias(FREQ),
        (F.max(IDX) + 1).alias("n"),
        F.min_by(VALUE, IDX).alias("first_value"),
        F.max_by(VALUE, IDX).alias("last_value"),
    )


def grid_of(rates: Column, lengths: Column) -> tuple[Column, Column, Column]:
    """``(out_freq, duration, out_len)`` of channels given as arrays of rates and lengths."""
    durations = F.zip_with(
        rates, lengths, lambda f, n: F.when(f > 0, F.try_divide(n.cast("double"), f.cast("double"))).otherwise(0.0)
    )
    rate = F.greatest(F.array_max(rates), F.lit(1))
    duration = F.coalesce(F.array_max(durations), F.lit(0.0))
    return rate, duration, F.ceil(duration * rate)


def grids_by_session(heads: DataFrame) -> DataFrame:
    """The one grid of each session that all of its series share: ``session_id, out_freq, duration, out_len, lengths``, where ``lengths``
    maps channels to their numbers of samples."""
    listed = heads.groupBy(SESSION).agg(F.collect_list(F.struct(CHANNEL, FREQ, "n")).alias("_c"))
    rate, duration, length = grid_of(F.col("_c")[FREQ], F.col("_c")["n"])
    lengths = F.map_from_arrays(F.col("_c")[CHANNEL], F.col("_c")["n"])
    return listed.select(SESSION, rate.alias(OUT_FREQ), duration.alias("duration"), length.alias("out_len"), lengths.alias("lengths"))


def sliced(
    samples: DataFrame,
    heads: DataFrame,
    back: int = 0,
    ahead: int = 0,
    seconds: int = SLICE_SECONDS,
    time_range: tuple[float, float] | None = None,
) -> DataFrame:
    """Source rows by slice, shuffled once: ``session_id, channel, freq, sample_idx, value, _chunk``.

    ``back`` and ``ahead`` are slots beyond the slice that its grid will be asked for. A slot is no longer than a sample of any of its
    channels, so as many samples are enough. Of a time range only the slices it touches are shuffled; they may lie behind the session.
    """
    own = F.col(FREQ).cast("bigint") * seconds
    k = F.col(IDX)
    # one sample more at both ends: the right neighbour of the last slot, and the left one where a position is rounded down
    low = F.greatest(F.ceil((k - ahead) / own).cast("bigint") - 1, F.lit(0))
    high = int_div(k + 1 + back, own)
    until = F.max(F.when(F.col(FREQ) > 0, F.ceil(F.col("n") / own))).over(Window.partitionBy(SESSION))
    since = F.lit(0).cast("bigint")
    if time_range is not None:
        since, until = (F.lit(max(math.floor(t / seconds), 0)).cast("bigint") for t in time_range)
        low, high = F.greatest(low, since), F.least(high, until)
    moving = samples.filter(F.col(FREQ) > 0).select(*SERIES, FREQ, IDX, VALUE, low.alias("_low"), high.alias("_high"))
    moving = moving.filter("_low <= _high").select(*SERIES, FREQ, IDX, VALUE, F.explode(F.sequence("_low", "_high")).alias(CHUNK))
    # samples without a rate stand still from the start, ended series from their end
    still = F.col(FREQ) <= 0
    after = F.greatest(F.when(still, F.lit(0).cast("bigint")).otherwise(int_div(F.col("n") + back, own) + 1), since)
    held = (
        heads.withColumn("_until", until)
        .withColumn("_from", after)
        .filter(F.col("_from") <= F.col("_until"))
        .select(
            *SERIES,
            FREQ,
            (F.when(still, F.lit(1)).otherwise(F.col("n")) - 1).cast("bigint").alias(IDX),
            F.when(still, F.col("first_value")).otherwise(F.col("last_value")).alias(VALUE),
            F.explode(F.sequence("_from", "_until")).alias(CHUNK),
        )
    )
    return moving.unionByName(held).repartition(SESSION, CHUNK)


def slices_of(grids: DataFrame, seconds: int = SLICE_SECONDS) -> DataFrame:
    """Grids repeated for each of their slices."""
    last = int_div(F.col("out_len") - 1, F.col(OUT_FREQ).cast("bigint") * seconds)
    return grids.filter("out_len > 0").withColumn(CHUNK, F.explode(F.sequence(F.lit(0).cast("bigint"), last)))


def _slots(
    rows: DataFrame,
    grids: DataFrame,
    seconds: int,
    back: int,
    ahead: int,
    place: Callable[[Column], Column],
    guess: Callable[[Column], Column],
    keep: Sequence[str] = (),
    limits: tuple[Column, Column] | None = None,
) -> DataFrame:
    """Rows of ``rows`` once for each slot of their slice they stand for; ``n`` is the length of the row's series."""
    both = rows.join(chunk_facts(slices_of(grids, seconds)), [SESSION, CHUNK]).withColumn("n", F.col("lengths")[F.col(CHANNEL)])
    both = both.filter("n IS NOT NULL")
    span = F.col(OUT_FREQ).cast("bigint") * seconds
    low, high = F.greatest(F.col(CHUNK) * span - back, F.lit(0)), F.least((F.col(CHUNK) + 1) * span + ahead, F.col("out_len")) - 1
    if limits is not None:
        low, high = F.greatest(low, limits[0]), F.least(high, limits[1] - 1)
    k, still = F.col(IDX), F.col(FREQ) <= 0
    ends = still | (k == F.col("n") - 1)
    # guesses in columns of their own, and no filter on the slots: it would join the condition of the join, with both ends spelled out
    # again. Either makes a method too long for the JIT compiler
    both = both.withColumns({"_guess": guess(k), "_guess_next": guess(k + 1)})
    first = F.when(still, low).otherwise(F.greatest(first_slot(k, place, lambda _: F.col("_guess")), low))
    last = F.when(ends, high).otherwise(F.least(first_slot(k + 1, place, lambda _: F.col("_guess_next")) - 1, high))
    spans = both.select(*rows.columns, "n", OUT_FREQ, "out_len", *keep, ends.alias("_ends"), first.alias("_first"), last.alias("_last"))
    filled = F.when(F.col("_first") <= F.col("_last"), F.sequence("_first", "_last"))
    return spans.withColumn(OUT_IDX, F.explode(filled))


def _with_next(rows: DataFrame) -> DataFrame:
    # window partitions lie inside the slices, so the shuffle serves them
    following = F.lead(F.struct(VALUE, IDX)).over(chunk_window(SERIES, IDX))
    adjacent = F.when(following[IDX] == F.col(IDX) + 1, following[VALUE])
    return rows.withColumn("_next", adjacent)


def linear_slots(
    rows: DataFrame,
    grids: DataFrame,
    back: int = 0,
    ahead: int = 0,
    seconds: int = SLICE_SECONDS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Linear interpolation of sliced rows: ``session_id, _chunk, channel, out_idx, out_freq, out_len, value`` and ``keep`` of the grids.

    Series that already have the grid's rate and length are copied.
    """
    rate, grid_rate = F.col(FREQ).cast("double"), F.col(OUT_FREQ).cast("double")
    ratio = rate / grid_rate
    # a copy at the border without its neighbour stands for slots of other slices only
    follows = _with_next(rows)
    slots = _slots(
        follows, grids, seconds, back, ahead,
        lambda i: F.floor(i * ratio), lambda k: F.ceil(F.try_divide(k * grid_rate, rate)), keep,
    ).filter("_ends OR _next IS NOT NULL")
    same = (F.col(FREQ) == F.col(OUT_FREQ)) & (F.col("n") == F.col("out_len"))
    between = F.col(OUT_IDX) * ratio - F.col(IDX)
    value = F.when(same | F.col("_ends"), F.col(VALUE)).otherwise(F.col(VALUE) * (1.0 - between) + F.col("_next") * between)
    return slots.select(SESSION, CHUNK, CHANNEL, OUT_IDX, OUT_FREQ, "out_len", *keep, value.alias(VALUE))


def nearest_slots(
    rows: DataFrame,
    grids: DataFrame,
    time_range: tuple[float, float] | None = None,
    seconds: int = SLICE_SECONDS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Nearest sample at each slot, within a time range; columns as of :func:`linear_slots`. A range may end behind the session."""
    rate, grid_rate = F.col(FREQ).cast("double"), F.col(OUT_FREQ).cast("double")
    if time_range is not None:
        start, stop = (F.lit(float(t)) for t in time_range)
        grids = grids.withColumn("_row0", F.greatest(F.floor(start * grid_rate), F.lit(0)))
        grids = grids.withColumn("out_len", F.ceil(stop * grid_rate))
    else:
        grids = grids.withColumn("_row0", F.lit(0).cast("bigint"))
    step, same_rate = 1.0 / grid_rate, F.col(FREQ) == F.col(OUT_FREQ)

    def place(i: Column) -> Column:
        return F.when(same_rate, i).otherwise(F.round(i * step * rate).cast("bigint"))

    def guess(k: Column) -> Column:
        return F.when(same_rate, k).otherwise(F.ceil(F.try_divide((k - 0.5) * grid_rate, rate)))

    slots = _slots(rows, grids, seconds, 0, 0, place, guess, ["_row0", *keep], (F.col("_row0"), F.col("out_len")))
    return slots.select(SESSION, CHUNK, CHANNEL, OUT_IDX, OUT_FREQ, "out_len", *keep, VALUE)


def side_by_side(
    slots: DataFrame,
    cells: dict[str, Column],
    keys: Sequence[str] = (),
    seconds: int = SLICE_SECONDS,
    facts: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per slot with a column for each of ``cells``, a condition on the row; 0 where no row meets it. ``facts`` are further columns, the
    largest value of each. Grouped where the rows are."""
    found = [F.coalesce(F.max(F.when(condition, F.col(VALUE))), F.lit(0.0)).alias(name) for name, condition in cells.items()]
    found += [F.max(fact).alias(name) for name, fact in (facts or {}).items()]
    wide = slots.groupBy(SESSION, CHUNK, OUT_FREQ, *keys, OUT_IDX).agg(*found)
    own = F.col(CHUNK) == int_div(F.col(OUT_IDX), F.col(OUT_FREQ).cast("bigint") * seconds)
    return wide.withColumn(CORE, own)
