"""Sector times, their comparison with a reference lap, and sector definition by position."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apexgrid.chunking import CHUNK_ROWS, spread_join
from apexgrid.operators.laps import LAP, with_laps
from apexgrid.operators.lookup import nearest_position
from apexgrid.schema import FREQ, IDX, SESSION

DELTA_BAND = 0.01


class Sector(NamedTuple):
    """A stretch of track between two sample indexes."""

    name: str
    start_index: int
    end_index: int


def sector_list(sectors: DataFrame) -> list[Sector]:
    """Sectors of a loaded configuration, as picked by hand on one track map."""
    return [Sector(*r) for r in sectors.select("name", "start_index", "end_index").toLocalIterator()]


def crossing_times(
    track: DataFrame, laps: DataFrame, indexes: Sequence[int], chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Per lap, the time of the sample nearest to each of the track points ``indexes``: columns ``at_<index>``.

    The first sample wins ties; a point outside the track counts as (0, 0). A lap without samples has the time of its first
    index where the track reaches that far, else 0.
    """
    points = sorted(set(indexes))
    coordinates = [
        F.max(F.when(F.col(IDX) == p, F.col(axis))).alias(f"_{axis}{p}") for p in points for axis in "xy"
    ]
    # the few target rows of a session reach its laps, not its samples
    reach = [F.max(FREQ).alias("_rate"), F.max(IDX).alias("_last")]
    targets = track.groupBy(SESSION).agg(*coordinates, *reach)
    goals = spread_join(laps.select(SESSION, *LAP), targets, [SESSION], "number", "left", chunk_rows)
    rows = with_laps(track.select(SESSION, IDX, FREQ, "time", "x", "y"), goals)
    rows = rows.select(SESSION, IDX, "time", "x", "y", F.explode("_laps").alias("_lap"))

    def nearest(p: int) -> Column:
        dx = F.col("x") - F.coalesce(F.col("_lap")[f"_x{p}"], F.lit(0.0))
        dy = F.col("y") - F.coalesce(F.col("_lap")[f"_y{p}"], F.lit(0.0))
        return F.min(F.struct((dx * dx + dy * dy).alias("d"), F.col(IDX), F.col("time")))

    passed = rows.groupBy(SESSION, *(F.col("_lap")[c].alias(c) for c in LAP)).agg(*(nearest(p)["time"].alias(f"at_{p}") for p in points))
    # laps without samples come back with their own end of the track
    rate, last = F.col("_rate"), F.col("_last")
    first = F.floor(F.col("start_time") * rate)
    alone = F.when((first >= 0) & (first <= last), first / rate).otherwise(F.lit(0.0))
    all_laps = goals.select(SESSION, *LAP, alone.alias("_alone"))
    same = [all_laps[c].eqNullSafe(passed[c]) for c in (SESSION, *LAP)]
    both = all_laps.join(passed, reduce(Column.__and__, same), "left")
    times = (F.coalesce(passed[f"at_{p}"], all_laps["_alone"]).alias(f"at_{p}") for p in points)
    return both.select(*(all_laps[c] for c in (SESSION, *LAP)), *times)


def lap_sectors(
    track: DataFrame, laps: DataFrame, sectors: Sequence[Sector], chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Per lap, the times of all sectors in order: ``(session_id, number, lap, times ARRAY<DOUBLE>)``, each in [0, lap duration].

    A sector whose end is passed before its start wraps around the lap. A lap without samples passes both ends at
    the same time, so the sector takes the whole lap.
    """
    crossed = crossing_times(track, laps, [i for s in sectors for i in s[1:]], chunk_rows)
    lap_time = F.col("end_time") - F.col("start_time")

    def spent(s: Sector) -> Column:
        start, end = F.col(f"at_{s.start_index}"), F.col(f"at_{s.end_index}")
        direct = F.when(end > start, end - start).otherwise(lap_time - (start - end))
        return F.greatest(F.lit(0.0), F.least(F.coalesce(direct, lap_time), lap_time))

    return crossed.select(
        SESSION, "number", F.col("name").alias("lap"), F.array(*map(spent, sectors)).alias("times")
    )


def sector_times(
    track: DataFrame, laps: DataFrame, sectors: Sequence[Sector], chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Time of each sector in each lap: ``(session_id, number, lap, sector_no, sector, time_secs)``."""
    names = F.array(*(F.lit(s.name) for s in sectors))
    return (
        lap_sectors(track, laps, sectors, chunk_rows)
        .select(SESSION, "number", "lap", F.posexplode("times").alias("sector_no", "time_secs"))
        .withColumn("sector", names[F.col("sector_no")])
    )


def sector_report(
    track: DataFrame,
    laps: DataFrame,
    sectors: Sequence[Sector],
    reference_lap: int,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Sector times and lap totals (``sector_no`` -1) against the lap at position ``reference_lap`` (0 is the Out Lap).

    The reference lap itself, and sessions that lack it, have no deltas.
    """

    def with_total(times: DataFrame) -> DataFrame:
        total = F.aggregate("times", F.lit(0.0), lambda a, t: a + t)
        return times.withColumn("times", F.concat(F.array(total), F.col("times")))

    rows = with_total(lap_sectors(track, laps, sectors, chunk_rows))
    # from the same rows, whose exchange both sides read
    chosen = F.max(F.when(F.col("number") == reference_lap, F.col("times")))
    reference = rows.groupBy(SESSION).agg(chosen.alias("_reference"))
    names = F.array(F.lit("Total"), *(F.lit(s.name) for s in sectors))
    k = F.col("_k")
    return (
        spread_join(rows, reference, [SESSION], "number", "left", chunk_rows, present=laps)
        .select(SESSION, "number", "lap", "_reference", F.posexplode("times").alias("_k", "time_secs"))
        .select(
            SESSION,
            "number",
            "lap",
            (k - 1).alias("sector_no"),
            names[k].alias("sector"),
            "time_secs",
            F.col("_reference")[k].alias("ref_secs"),
        )
        .withColumn(
            "delta", F.when(F.col("number") != reference_lap, F.col("time_secs") - F.col("ref_secs"))
        )
        .withColumn("delta_class", delta_class(F.col("delta")))
    )


def configured_report(
    track: DataFrame, laps: DataFrame, sectors: DataFrame, references: DataFrame, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """As :func:`sector_report`, for sessions that each have sectors and a reference lap of their own, as stored configurations give them.

    ``sectors(session_id, sector_no, name, start_index, end_index)`` and ``references(session_id, reference_lap)`` are tables; a session without
    a reference lap has no deltas, one without sectors no rows. A sample meets the points of its session with its lap, and the nearest are found by
    partial aggregates.
    """
    ends = sectors.select(SESSION, F.explode(F.array("start_index", "end_index")).alias(IDX)).distinct()
    at = ends.join(track.select(SESSION, IDX, "x", "y"), [SESSION, IDX], "left")
    point = F.struct(F.col(IDX).alias("p"), F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))
    # what was drawn by hand on a map of one session: small, and one row for it
    points = at.groupBy(SESSION).agg(F.collect_list(point).alias("_points"))
    listed = F.struct("sector_no", "name", "start_index", "end_index")
    drawn = sectors.groupBy(SESSION).agg(F.array_sort(F.collect_list(listed)).alias("_sectors"))
    reach = track.groupBy(SESSION).agg(F.max(FREQ).alias("_rate"), F.max(IDX).alias("_last"))
    plans = drawn.join(points, SESSION).join(references, SESSION, "left").join(reach, SESSION, "left")
    goals = spread_join(laps.select(SESSION, *LAP), plans, [SESSION], "number", chunk_rows=chunk_rows)

    spans = goals.select(SESSION, "number", "start_time", "end_time", "_points")
    rows = with_laps(track.select(SESSION, IDX, FREQ, "time", "x", "y"), spans)
    rows = rows.select(SESSION, IDX, "time", "x", "y", F.explode("_laps").alias("l"))
    rows = rows.select(SESSION, IDX, "time", "x", "y", F.col("l.number").alias("number"), F.explode("l._points").alias("p"))
    dx, dy = F.col("x") - F.col("p.x"), F.col("y") - F.col("p.y")
    nearest = F.min(F.struct((dx * dx + dy * dy).alias("d"), F.col(IDX), F.col("time")))
    passed = rows.groupBy(SESSION, "number", F.col("p.p").alias("p")).agg(nearest["time"].alias("time"))
    by_lap = passed.groupBy(SESSION, "number").agg(F.map_from_entries(F.collect_list(F.struct("p", "time"))).alias("_at"))

    known = goals.drop("_points").join(by_lap, [SESSION, "number"], "left")
    # a lap without samples is taken to be at the time of its first index everywhere, as in crossing_times
    first = F.floor(F.col("start_time") * F.col("_rate"))
    alone = F.when((first >= 0) & (first <= F.col("_last")), first / F.col("_rate")).otherwise(F.lit(0.0))
    lap_time = F.col("end_time") - F.col("start_time")

    def spent(s: Column) -> Column:
        start, end = (F.coalesce(F.col("_at")[s[c]], F.col("_alone")) for c in ("start_index", "end_index"))
        direct = F.when(end > start, end - start).otherwise(F.col("_lap_time") - (start - end))
        return F.greatest(F.lit(0.0), F.least(direct, F.col("_lap_time")))

    known = known.withColumns({"_alone": alone, "_lap_time": lap_time}).withColumn("times", F.transform("_sectors", spent))
    total = F.aggregate("times", F.lit(0.0), lambda a, t: a + t)
    rows = known.select(
        SESSION, "number", F.col("name").alias("lap"), "reference_lap",
        F.concat(F.array(F.lit("Total")), F.transform("_sectors", lambda s: s["name"])).alias("_names"), F.concat(F.array(total), "times").alias("times"),
    )
    chosen = F.max(F.when(F.col("number") == F.col("reference_lap"), F.col("times")))
    reference = rows.groupBy(SESSION).agg(chosen.alias("_reference"))
    both = spread_join(rows, reference, [SESSION], "number", "left", chunk_rows, present=laps)
    k = F.col("_k")
    return (
        both.select("*", F.posexplode("times").alias("_k", "time_secs"))
        .select(
            SESSION, "number", "lap", (k - 1).alias("sector_no"), F.col("_names")[k].alias("sector"), "time_secs",
            F.col("_reference")[k].alias("ref_secs"), "reference_lap",
        )
        .withColumn("delta", F.when(F.col("number") != F.col("reference_lap"), F.col("time_secs") - F.col("ref_secs")))
        .withColumn("delta_class", delta_class(F.col("delta")))
        .drop("reference_lap")
    )


def delta_class(delta: Column) -> Column:
    """Faster, slower or even; none without a delta."""
    return (
        F.when(delta < -DELTA_BAND, F.lit("faster"))
        .when(delta > DELTA_BAND, F.lit("slower"))
        .when(delta.isNotNull(), F.lit("even"))
    )


def define_sectors(track: DataFrame, picks: DataFrame) -> DataFrame:
    """Sectors from pairs of picked positions ``picks(session_id, pick_no, px, py)``, named S1, S2, ...

    Picks are taken in order of ``pick_no`` (0, 1, ...): even ones start a sector, the next one ends it.
    """
    found = nearest_position(track, picks.withColumnRenamed("pick_no", "probe_id"))
    pair = F.floor(F.col("probe_id") / 2)
    is_start = F.col("probe_id") % 2 == 0
    return (
        found.groupBy(SESSION, pair.alias("_pair"))
        .agg(
            F.max(F.when(is_start, F.col(IDX))).alias("start_index"),
            F.max(F.when(~is_start, F.col(IDX))).alias("end_index"),
        )
        .filter(F.col("start_index").isNotNull() & F.col("end_index").isNotNull())
        .select(
            SESSION,
            F.concat(F.lit("S"), F.col("_pair") + 1).alias("name"),
            "start_index",
            "end_index",
        )
    )
