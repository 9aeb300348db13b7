"""Extensions: channels over distance instead of time, laps laid over each other, and laps stretched onto a reference.

Distance is the running integral of speed, put together from chunk sums like every integral of this package. A grid over it depends on the data, so
each row emits the grid points that lie between it and the next one: there is no join between grid and samples, no series is in one task, and
a standstill emits nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apexgrid.chunking import CHUNK_ROWS, CORE, chunk_window, spread_join, with_halo
from apexgrid.functions.scalar import is_finite
from apexgrid.operators import series
from apexgrid.operators.laps import with_laps
from apexgrid.operators.sectors import crossing_times
from apexgrid.schema import FREQ, IDX, SESSION

KMH_PER_MS = 3.6


def with_distance(frame: DataFrame, speed: str, keys: Sequence[str] = (SESSION,), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``distance`` in metres from a speed in km/h; a speed that is missing or negative counts as standing still."""
    known = F.when(is_finite(speed) & (F.col(speed) > 0), F.col(speed) / KMH_PER_MS).otherwise(F.lit(0.0))
    moving = frame.withColumn("_ms", known)
    return series.integrate(moving, keys, value="_ms", out="distance", chunk_rows=chunk_rows).drop("_ms")


def _between(frame: DataFrame, at: Column, columns: Sequence[str], keys: Sequence[str], chunk_rows: int) -> DataFrame:
    """Rows with the position ``_at`` and ``columns`` of the next row beside their own, as ``_to`` and ``_next_*``."""
    order = chunk_window(keys, IDX)
    rows = with_halo(frame.withColumn("_at", at), IDX, 0, 1, chunk_rows)
    following = {f"_next_{c}": F.lead(c).over(order) for c in columns}
    return rows.withColumns({"_to": F.lead("_at").over(order)} | following).filter(CORE)


def _points(rows: DataFrame, columns: Sequence[str], step: Column | float, last: Column, out: str) -> DataFrame:
    """Grid points ``k * step`` in ``[_at, _to)`` with interpolated ``columns``; ``last`` marks rows that also hold their own point."""
    step = F.lit(float(step)) if not isinstance(step, Column) else step
    first = F.ceil(F.col("_at") / step)
    until = F.when(last, F.floor(F.col("_at") / step)).otherwise(F.ceil(F.col("_to") / step) - 1)
    found = rows.withColumn("_first", first).withColumn("_until", until).filter("_first <= _until")
    found = found.withColumn(out, F.explode(F.sequence("_first", "_until")))
    part = F.when(last, F.lit(0.0)).otherwise((F.col(out) * step - F.col("_at")) / (F.col("_to") - F.col("_at")))
    # on the last row there is no next value
    value = lambda c: F.col(c) + (F.coalesce(F.col(f"_next_{c}"), F.col(c)) - F.col(c)) * part
    return found.withColumns({c: value(c) for c in columns})


def distance_axis(
    frame: DataFrame,
    speed: str,
    columns: Sequence[str],
    step: float,
    keys: Sequence[str] = (SESSION,),
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """``columns`` of an aligned frame at every ``step`` metres: ``(keys, slot, distance, time, <columns>)``.

    Between two samples values and time go linearly with distance. Points passed in a standstill are those of its first sample; the last
    sample holds a point only if it lies exactly on it.
    """
    rows = with_distance(frame, speed, keys, chunk_rows).withColumn("time", F.col(IDX) / F.col(FREQ))
    rows = _between(rows, F.col("distance"), ["time", *columns], keys, chunk_rows)
    points = _points(rows, ["time", *columns], step, F.col("_to").isNull(), "slot")
    return points.select(*keys, "slot", (F.col("slot") * float(step)).alias("distance"), "time", *columns)


def lap_fractions(
    frame: DataFrame, laps: DataFrame, speed: str, columns: Sequence[str], slots: int, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """``columns`` of every lap at ``slots + 1`` equal parts of its distance: ``(session_id, number, name, slot, time, <columns>)``,
    with the time since the lap's first sample. Laps that cover no distance have no rows."""
    lap = [SESSION, "number", "name"]
    rows = with_distance(frame, speed, [SESSION], chunk_rows).withColumn("time", F.col(IDX) / F.col(FREQ))
    # the following row of the session, which may belong to the next lap, comes along before laps are assigned
    rows = _between(rows, F.col("distance"), ["time", *columns], [SESSION], chunk_rows)
    carried = [SESSION, IDX, FREQ, "_at", "_to", *(n for c in ("time", *columns) for n in (c, f"_next_{c}"))]
    in_laps = with_laps(rows.select(*carried), laps).withColumn("_lap", F.explode("_laps"))
    in_laps = in_laps.select(*carried, "_lap.number", "_lap.name")
    # a lap's extent: where its first and last sample are
    ends = in_laps.groupBy(*lap).agg(
        F.min("_at").alias("_low"), F.max("_at").alias("_high"), F.max(IDX).alias("_last"), F.min("time").alias("_start")
    )
    ends = laps.select(*lap, "start_time", "end_time").join(ends, lap).filter("_high > _low")
    own = with_laps(rows.select(*carried), ends).withColumn("_lap", F.explode("_laps")).select(*carried, "_lap.*")
    length = F.col("_high") - F.col("_low")
    placed = own.withColumns({"_at": (F.col("_at") - F.col("_low")) / length, "_to": (F.col("_to") - F.col("_low")) / length})
    points = _points(placed, ["time", *columns], 1.0 / slots, F.col(IDX) == F.col("_last"), "slot").filter(F.col("slot") <= slots)
    return points.select(*lap, "slot", (F.col("time") - F.col("_start")).alias("time"), *columns)


def overlay(
    frame: DataFrame,
    laps: DataFrame,
    speed: str,
    columns: Sequence[str],
    reference: tuple,
    slots: int = 200,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """All laps of all sessions over one reference lap ``(session_id, number)``, by shared position: values, those of the reference as ``ref_*``, and
    ``time_delta``.

    The reference has ``slots + 1`` rows whatever the data, so it goes to every task.
    """
    rows = lap_fractions(frame, laps, speed, columns, slots, chunk_rows)
    chosen = rows.filter((F.col(SESSION) == reference[0]) & (F.col("number") == reference[1]))
    other = F.broadcast(chosen.select("slot", *(F.col(c).alias(f"ref_{c}") for c in ("time", *columns))))
    return rows.join(other, "slot").withColumn("time_delta", F.col("time") - F.col("ref_time"))


def stretched(
    track: DataFrame, laps: DataFrame, indexes: Sequence[int], reference_lap: int, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Samples of each lap with their time on the session's reference lap: ``(session_id, number, sample_idx, time, ref_time, gain)``.

    The laps are matched at their ends and where they pass the track points ``indexes``; between two matches time is stretched
    evenly. Matches that do not come in order in both laps are left out. ``gain`` is how much earlier in its lap a position was passed than in the reference.
    """
    crossed = crossing_times(track, laps, indexes, chunk_rows)
    passed = F.array(*(F.col(f"at_{p}") for p in indexes))
    marks = crossed.select(SESSION, "number", "name", "start_time", "end_time", F.concat(F.array("start_time"), passed, F.array("end_time")).alias("_own"))
    chosen = F.max(F.when(F.col("number") == reference_lap, F.col("_own")))
    reference = marks.groupBy(SESSION).agg(chosen.alias("_ref")).filter("_ref IS NOT NULL")
    both = spread_join(marks, reference, [SESSION], "number", chunk_rows=chunk_rows)
    # pairs in order: each kept one is later than the kept one before in both laps, and before both ends
    pairs = F.arrays_zip("_own", "_ref")
    end = F.element_at(pairs, -1)

    def ordered(kept: Column, pair: Column) -> Column:
        before = F.element_at(kept, -1)
        fits = (pair["_own"] > before["_own"]) & (pair["_ref"] > before["_ref"]) & (pair["_own"] < end["_own"]) & (pair["_ref"] < end["_ref"])
        return F.when(fits, F.concat(kept, F.array(pair))).otherwise(kept)

    inner = F.slice(pairs, F.lit(2), F.size(pairs) - 2)
    matched = F.concat(F.aggregate(inner, F.slice(pairs, 1, 1), ordered), F.array(end))
    both = both.select(SESSION, "number", "start_time", "end_time", matched.alias("_marks"))
    rows = with_laps(track.select(SESSION, IDX, FREQ, "time"), both).select(SESSION, IDX, "time", F.explode("_laps").alias("_lap"))
    marks = F.col("_lap._marks")
    k = F.greatest(F.least(F.size(F.filter(marks, lambda m: m["_own"] <= F.col("time"))), F.size(marks) - 1), F.lit(1))
    low, high = F.element_at(marks, k), F.element_at(marks, k + 1)
    part = F.try_divide(F.col("time") - low["_own"], high["_own"] - low["_own"])
    on_reference = low["_ref"] + F.coalesce(part, F.lit(0.0)) * (high["_ref"] - low["_ref"])
    start = F.element_at(marks, 1)
    gain = (on_reference - start["_ref"]) - (F.col("time") - start["_own"])
    return rows.select(SESSION, F.col("_lap.number").alias("number"), IDX, "time", on_reference.alias("ref_time"), gain.alias("gain"))
