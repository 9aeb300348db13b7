"""Order-dependent functions of evenly sampled series: smoothing, derivative, integral, forward fill.

A moving average of any width ``n`` is made of blocks of ``n`` indexes: what lies in the window is the end of one block and the beginning of the next, so two
running sums, forwards and backwards inside blocks, are added. Nothing is subtracted: an average is as exact when its series is long as when it is short, and it
does not depend on where chunks end. It is divided by the number of rows there are, counted from the first row of the series, which need not have
index 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apexgrid.chunking import CHUNK, CHUNK_ROWS, CORE, chunk_facts, chunk_window, earlier_chunks, int_div, with_chunk, with_halo
from apexgrid.functions.channel import Step
from apexgrid.functions.scalar import arg, nan
from apexgrid.schema import FREQ, IDX, SERIES, VALUE

def smooth(samples: DataFrame, window: int, keys: Sequence[str] = SERIES, **options) -> DataFrame:
    return _single("smooth", samples, keys, window=max(int(window), 1), **options)


def derivative(samples: DataFrame, keys: Sequence[str] = SERIES, **options) -> DataFrame:
    return _single("derivative", samples, keys, **options)


def integrate(samples: DataFrame, keys: Sequence[str] = SERIES, **options) -> DataFrame:
    return _single("integrate", samples, keys, **options)


def _single(kind, samples, keys, value: str = VALUE, out: str | None = None, window=None, **options):
    step = Step(kind, F.col(value), out or kind, window)
    return add_steps(samples, [step], keys, **options)


def add_steps(
    frame: DataFrame,
    steps: Sequence[Step],
    keys: Sequence[str],
    idx: str = IDX,
    freq: str = FREQ,
    chunk_rows: int = CHUNK_ROWS,
    haloed: bool = False,
) -> DataFrame:
    """Add one column per step. All steps of a level share one shuffle by ``(keys, chunk)``.

    A ``haloed`` frame already has the copies that :func:`halo_of` asks for, and their CHUNK and CORE columns.
    """
    keys = list(keys)
    for level in sorted({s.level for s in steps}):
        at_level = [s for s in steps if s.level == level]
        near = [s for s in at_level if not _needs_shift(s, chunk_rows)]
        if near:
            frame = _near_steps(frame, near, keys, idx, freq, chunk_rows, haloed and level == 0)
        for step in at_level:
            if _needs_shift(step, chunk_rows):
                frame = _smooth_shifted(frame, step, keys, idx, chunk_rows)
    return frame


def _needs_shift(step: Step, chunk_rows: int) -> bool:
    return step.kind == "smooth" and (isinstance(step.window, Column) or step.window > chunk_rows)


def halo_of(steps: Sequence[Step], chunk_rows: int = CHUNK_ROWS) -> tuple[int, int] | None:
    """Rows before and after a chunk that the steps of level 0 look at; None if a halo does not serve them."""
    first = [s for s in steps if s.level == 0]
    if not first or any(_needs_shift(s, chunk_rows) for s in first):
        return None
    return _reach(first)


def _reach(steps: Sequence[Step]) -> tuple[int, int]:
    back = max((s.window if s.kind == "smooth" else 1) for s in steps)
    return back, 1 if any(s.kind == "derivative" for s in steps) else 0


def _near_steps(frame, steps, keys, idx, freq, chunk_rows, haloed=False) -> DataFrame:
    columns = [c for c in frame.columns if c not in (CHUNK, CORE)]
    sources = {s.output: f"_in{s.output}" for s in steps}
    frame = frame.withColumns({sources[s.output]: s.source for s in steps})
    rows = frame if haloed else with_halo(frame, idx, *_reach(steps), chunk_rows)
    order = chunk_window(keys, idx)
    rate = F.col(freq)

    local = {}
    for s in steps:
        x = F.col(sources[s.output])
        previous, following = F.lag(x).over(order), F.lead(x).over(order)
        if s.kind == "derivative":
            local[s.output] = (
                F.when(previous.isNull() & following.isNull(), F.lit(0.0))
                .when(previous.isNull(), (following - x) * rate)
                .when(following.isNull(), (x - previous) * rate)
                .otherwise((following - previous) * rate / 2.0)
            )
        elif s.kind == "integrate":
            area = (previous + x) * 0.5 * (F.lit(1.0) / rate)
            local[s.output] = F.when(F.col(CORE), F.coalesce(area, F.lit(0.0))).otherwise(F.lit(0.0))
    rows = rows.withColumns(local)

    for s in (s for s in steps if s.kind == "smooth"):
        rows = _block_sums(rows.withColumn("_block", int_div(F.col(idx), s.window)), sources[s.output], keys, idx)
        end = F.struct("_block", "_until")
        # the first row of the window, or of the series
        start = F.coalesce(F.lag(end, s.window - 1).over(order), F.first(end).over(order))
        count = F.least(F.lit(s.window), F.row_number().over(order))
        rows = rows.withColumn(s.output, _window_sum(start["_block"], start["_until"]) / count).drop("_block", "_so_far", "_until")
    rows = rows.filter(CORE)

    integrals = [s for s in steps if s.kind == "integrate"]
    if integrals:
        rows = rows.withColumns(
            {
                s.output: F.sum(s.output).over(order.rowsBetween(Window.unboundedPreceding, 0))
                for s in integrals
            }
        )
        totals = rows.groupBy(*keys, CHUNK).agg(
            *(F.max_by(s.output, idx).alias(s.output) for s in integrals)
        )
        before = earlier_chunks(keys)
        offsets = totals.select(
            *keys,
            CHUNK,
            *(F.coalesce(F.sum(s.output).over(before), F.lit(0.0)).alias(f"_at{s.output}") for s in integrals),
        )
        rows = rows.join(offsets, [*keys, CHUNK]).withColumns(
            {s.output: F.col(s.output) + F.col(f"_at{s.output}") for s in integrals}
        )

    averages = [s for s in steps if s.kind == "smooth"]
    if averages:
        own = frame.filter(CORE) if haloed else frame
        # a haloed frame keeps the chunks it came with
        own = own if haloed else with_chunk(own, idx, chunk_rows)
        bad = _first_bad(own, {s.output: sources[s.output] for s in averages}, keys, idx)
        rows = rows.join(bad, [*keys, CHUNK]).withColumns(
            {s.output: _poisoned(s.output, F.lit(s.window), idx) for s in averages}
        )
    return rows.select(*columns, *(s.output for s in steps))


def _first_bad(frame, sources: dict[str, str], keys, idx) -> DataFrame:
    """Per chunk, where the series first holds NaN and where it first holds an infinity."""
    found = []
    for out, source in sources.items():
        x = F.col(source)
        found.append(F.min(F.when(F.isnan(x), F.col(idx))).alias(f"_nan{out}"))
        found.append(F.min(F.when(F.abs(x) == float("inf"), F.col(idx))).alias(f"_inf{out}"))
    per_chunk = frame.groupBy(*keys, CHUNK).agg(*found)
    series = Window.partitionBy(*keys)
    names = [c for c in per_chunk.columns if c not in (*keys, CHUNK)]
    return per_chunk.select(*keys, CHUNK, *(F.min(c).over(series).alias(c) for c in names))


def _poisoned(out: str, window: Column, idx: str) -> Column:
    """A running sum never recovers from a NaN, nor from an infinity that has left its window."""
    i = F.col(idx)
    bad = (i >= F.col(f"_nan{out}")) | (i >= F.col(f"_inf{out}") + window)
    return F.when(F.coalesce(bad, F.lit(False)), nan()).otherwise(F.col(out))


def _block_sums(rows: DataFrame, source: str, keys: Sequence[str], idx: str) -> DataFrame:
    """Running sums of a chunk inside its blocks: ``_so_far`` up to a row, ``_until`` from it to the end, itself included."""
    block = Window.partitionBy(*keys, CHUNK, "_block")
    so_far, until = (
        F.sum(source).over(block.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) for order in (F.col(idx), F.col(idx).desc())
    )
    return rows.withColumn("_until", until).withColumn("_so_far", so_far)


def _window_sum(block: Column, until: Column) -> Column:
    """Sum from the row with ``block`` and ``until`` to the current one, at most a block later."""
    return F.when(block < F.col("_block"), until + F.col("_so_far")).otherwise(F.col("_so_far"))


def _smooth_shifted(frame, step: Step, keys, idx, chunk_rows) -> DataFrame:
    """Moving average wider than a chunk, or as wide as the first row of the series says.

    Blocks go over several chunks here. A chunk knows the sums of its first and last block, and one row per chunk carries them on; the first row of a
    window is met by an index-shifted join.
    """
    columns = frame.columns
    out = step.output
    frame = frame.withColumn("_x", step.source)
    width = step.window if isinstance(step.window, Column) else F.lit(float(step.window))
    chunked = with_chunk(frame.withColumn("_w", width), idx, chunk_rows)
    series = Window.partitionBy(*keys)
    found = chunked.groupBy(*keys, CHUNK).agg(F.min_by("_w", idx).alias("_w0"), F.min(idx).alias("_low"), F.max(idx).alias("_high"))
    width = F.coalesce(F.nanvl(F.min_by("_w0", "_low").over(series), F.lit(None).cast("double")), F.lit(1.0))
    width = F.least(F.greatest(width, F.lit(1.0)), F.lit(float(2**62))).cast("bigint")
    known = found.select(*keys, CHUNK, width.alias("_n"), F.min("_low").over(series).alias("_first"), "_low", "_high").join(
        _first_bad(chunked, {out: "_x"}, keys, idx), [*keys, CHUNK]
    )
    known = known.withColumns({"_head": int_div(F.col("_low"), F.col("_n")), "_tail": int_div(F.col("_high"), F.col("_n"))})
    rows = chunked.join(chunk_facts(known), [*keys, CHUNK]).withColumn("_block", int_div(F.col(idx), F.col("_n")))

    of = lambda block: F.coalesce(F.sum(F.when(F.col("_block") == F.col(block), F.col("_x"))), F.lit(0.0))
    sums = rows.groupBy(*keys, CHUNK, "_first", "_low", "_head", "_tail").agg(of("_head").alias("_in_head"), of("_tail").alias("_in_tail"))
    onwards = Window.partitionBy(*keys, "_tail").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, 0)
    backwards = Window.partitionBy(*keys, "_head").orderBy(F.desc(CHUNK)).rowsBetween(Window.unboundedPreceding, 0)
    chunks = Window.partitionBy(*keys).orderBy(CHUNK)
    sums = sums.withColumns({"_from_left": F.sum("_in_tail").over(onwards), "_from_right": F.sum("_in_head").over(backwards)})
    left, right = F.lag(F.struct("_tail", "_from_left")).over(chunks), F.lead(F.struct("_head", "_from_right")).over(chunks)
    sums = sums.withColumns(
        {
            "_before": F.when(left["_tail"] == F.col("_head"), left["_from_left"]).otherwise(0.0),
            "_after": F.when(right["_head"] == F.col("_tail"), right["_from_right"]).otherwise(0.0),
        }
    )
    opening = F.col("_in_head") + F.when(F.col("_head") == F.col("_tail"), F.col("_after")).otherwise(0.0)
    opening = F.min_by(F.struct(F.col("_head").alias("block"), opening.alias("until")), "_low").over(series)
    sums = sums.select(*keys, CHUNK, "_before", "_after", opening.alias("_opening"))

    summed = _block_sums(rows, "_x", keys, idx).join(chunk_facts(sums), [*keys, CHUNK])
    summed = summed.withColumns(
        {
            "_so_far": F.col("_so_far") + F.when(F.col("_block") == F.col("_head"), F.col("_before")).otherwise(0.0),
            "_until": F.col("_until") + F.when(F.col("_block") == F.col("_tail"), F.col("_after")).otherwise(0.0),
        }
    )
    shifted = summed.select(*keys, (F.col(idx) + F.col("_n") - 1).alias(idx), F.struct(F.col("_block").alias("block"), F.col("_until").alias("until")).alias("_start"))
    start = F.coalesce("_start", "_opening")
    return (
        summed.join(shifted, [*keys, idx], "left")
        .withColumn(out, _window_sum(start["block"], start["until"]) / F.least(F.col("_n"), F.col(idx) - F.col("_first") + 1))
        .withColumn(out, _poisoned(out, F.col("_n"), idx))
        .select(*columns, out)
    )


def forward_fill(
    frame: DataFrame,
    good: Column,
    columns: Sequence[str],
    keys: Sequence[str],
    idx: str = IDX,
    default: float = 0.0,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Replace ``columns`` by their last values on a row where ``good`` held, else by ``default``."""
    keys = list(keys)
    chunked = with_chunk(frame, idx, chunk_rows).withColumn("_good", good)
    seen = F.when(F.col("_good"), F.col(idx))
    last = chunked.groupBy(*keys, CHUNK).agg(
        F.max(seen).alias("_seen"), *(F.max_by(c, seen).alias(c) for c in columns)
    )
    point = F.when(F.col("_seen").isNotNull(), F.struct(*columns))
    carried = last.select(
        *keys, CHUNK, F.last(point, ignorenulls=True).over(earlier_chunks(keys)).alias("_carried")
    )
    chunked = chunked.withColumn("_point", F.when(F.col("_good"), F.struct(*columns)))
    order = chunk_window(keys, idx).rowsBetween(Window.unboundedPreceding, 0)
    filled = chunked.withColumn("_point", F.last("_point", ignorenulls=True).over(order)).join(
        carried, [*keys, CHUNK]
    )
    point = F.coalesce("_point", "_carried")
    return filled.withColumn("_point", point).select(
        *(
            F.coalesce(F.col("_point")[c], arg(default)).alias(c) if c in columns else F.col(c)
            for c in frame.columns
        )
    )
