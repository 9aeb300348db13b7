"""Extensions: histograms per lap, mixture maps and thinned scatter plots. Bins are counted by partial aggregates, so results and shuffles are bounded by the
number of bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apexgrid.chunking import CHUNK_ROWS, spread_join
from apexgrid.functions.scalar import is_finite
from apexgrid.operators.laps import with_laps
from apexgrid.schema import FREQ, IDX, SERIES, SESSION, VALUE

# multiplier and modulus of the row hash of a thinned plot; products of sample indexes below 2^31 stay in 64 bits
HASH_FACTOR = 2654435761
HASH_MODULUS = 1 << 32


def _bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Number of the equal part of ``[low, high]`` that holds the value; the first one if there is no extent."""
    part = F.least(F.floor((value - low) / (high - low) * bins), F.lit(bins - 1))
    return F.when(high > low, part).otherwise(F.lit(0)).cast("int")


def lap_histogram(samples: DataFrame, laps: DataFrame, bins: int = 20, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Samples of each lap by equal parts of their channel's range in the session: ``(session_id, channel, number, lap, bin, low, high, n)``.

    A first pass takes the ranges of the finite values; the second counts. Values that are not finite are left out.
    """
    v = F.when(is_finite(VALUE), F.col(VALUE))
    ranges = samples.groupBy(*SERIES).agg(F.min(v).alias("_low"), F.max(v).alias("_high")).filter("_low IS NOT NULL")
    intervals = laps.select(SESSION, "number", F.col("name").alias("lap"), "start_time", "end_time")
    rows = with_laps(samples.select(*SERIES, FREQ, IDX, VALUE).filter(is_finite(VALUE)), intervals)
    ranged = spread_join(rows.filter(F.size("_laps") > 0), ranges, SERIES, IDX, chunk_rows=chunk_rows)
    part = _bin(F.col(VALUE), F.col("_low"), F.col("_high"), bins)
    counted = ranged.select(*SERIES, F.explode("_laps").alias("l"), part.alias("bin"), "_low", "_high")
    width = (F.col("_high") - F.col("_low")) / bins
    return (
        counted.groupBy(*SERIES, "l.number", "l.lap", "bin", "_low", "_high")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            *SERIES, "number", "lap", "bin",
            (F.col("_low") + F.col("bin") * width).alias("low"), (F.col("_low") + (F.col("bin") + 1) * width).alias("high"), "n",
        )
    )


def mixture_map(
    frame: DataFrame,
    x: str,
    y: str,
    z: str,
    widths: tuple[float, float],
    at_least: int = 1,
    keys: Sequence[str] = (SESSION,),
) -> DataFrame:
    """Mean of ``z`` by cells of ``x`` and ``y`` of an aligned frame: ``(keys, x_bin, y_bin, z_mean, n)``, for cells of ``at_least`` samples."""
    known = is_finite(x) & is_finite(y) & is_finite(z)
    cells = (F.floor(F.col(c) / w).alias(name) for c, w, name in ((x, widths[0], "x_bin"), (y, widths[1], "y_bin")))
    found = frame.filter(known).select(*keys, *cells, F.col(z).alias("_z"))
    means = found.groupBy(*keys, "x_bin", "y_bin").agg(F.avg("_z").alias("z_mean"), F.count(F.lit(1)).alias("n"))
    return means.filter(F.col("n") >= at_least)


def scatter(frame: DataFrame, x: str, y: str, cells: tuple[int, int] = (64, 64), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One sample for each occupied cell of a session's plot, with the number it stands for: ``(session_id, x_cell, y_cell, sample_idx, x, y, n)``.

    The sample of the smallest hash of its index is taken, so the choice is the same in every run and favours no part of the session; there are never
    more rows than cells.
    """
    known = frame.filter(is_finite(x) & is_finite(y)).select(SESSION, IDX, F.col(x).alias("x"), F.col(y).alias("y"))
    extent = known.groupBy(SESSION).agg(*(f(c).alias(f"_{f.__name__}_{c}") for c in "xy" for f in (F.min, F.max)))
    ranged = spread_join(known, extent, [SESSION], IDX, chunk_rows=chunk_rows)
    placed = ranged.select(
        SESSION, IDX, "x", "y",
        _bin(F.col("x"), F.col("_min_x"), F.col("_max_x"), cells[0]).alias("x_cell"),
        _bin(F.col("y"), F.col("_min_y"), F.col("_max_y"), cells[1]).alias("y_cell"),
    )
    order = (F.col(IDX) * HASH_FACTOR) % HASH_MODULUS
    taken = F.min(F.struct(order.alias("h"), F.col(IDX), F.col("x"), F.col("y"))).alias("_row")
    found = placed.groupBy(SESSION, "x_cell", "y_cell").agg(taken, F.count(F.lit(1)).alias("n"))
    return found.select(SESSION, "x_cell", "y_cell", f"_row.{IDX}", "_row.x", "_row.y", "n")
