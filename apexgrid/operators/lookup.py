"""Point lookups: channel values at a time, positions at a time, nearest position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apexgrid.chunking import CHUNK, CHUNK_ROWS, spread_join, with_chunk
from apexgrid.schema import CHANNEL, FREQ, IDX, SERIES, SESSION, VALUE

# edge of the square cells that prune the nearest-position search, in track units (degrees of latitude)
CELL = 1e-4
# a cell of the next level is this many times as wide; after that many levels a cell is about a tenth of a degree wide
FAN = 32
LEVELS = 2
# probes are dealt by session and time, in slices of this many milliseconds
DEAL_MS = 60_000


def series_ends(samples: DataFrame) -> DataFrame:
    """Rate, length and last value of each series."""
    return samples.groupBy(*SERIES).agg(
        F.max(FREQ).alias(FREQ),
        (F.max(IDX) + 1).alias("n"),
        F.max_by(VALUE, IDX).alias("last_value"),
    )


def values_at(samples: DataFrame, probes: DataFrame) -> DataFrame:
    """Linear interpolation of every channel of a session at ``probes(session_id, probe_id, t)``.

    Past the end the last value holds. Before the start the first two samples extrapolate. Each probe asks for two
    sample indexes, which an equi-join finds. Probes are dealt by session and minute, and the ends of the session's series follow them there.
    """
    at = F.col("t") * F.col(FREQ)
    low = F.greatest(at, F.lit(0.0)).cast("bigint")
    asked = (
        _dealt(probes, series_ends(samples))
        .withColumn("_at", at)
        .withColumn("_low", low)
        .withColumn("_high", F.least(F.col("_low") + 1, F.col("n") - 1))
        .withColumn(IDX, F.explode(F.array_distinct(F.array(F.least("_low", F.col("n") - 1), "_high"))))
    )
    found = asked.join(samples.select(*SERIES, IDX, VALUE), [*SERIES, IDX])
    per_probe = found.groupBy(SESSION, "probe_id", "t", CHANNEL).agg(
        F.max("_at").alias("_at"),
        F.max("_low").alias("_low"),
        F.max("n").alias("n"),
        F.max(FREQ).alias(FREQ),
        F.max("last_value").alias("_last"),
        F.max(F.when(F.col(IDX) == F.col("_low"), F.col(VALUE))).alias("_a"),
        F.max(F.when(F.col(IDX) == F.col("_low") + 1, F.col(VALUE))).alias("_b"),
    )
    part = F.col("_at") - F.col("_low")
    value = (
        F.when(F.col(FREQ) <= 0, F.lit(0.0))
        .when(F.col("_low") >= F.col("n"), F.col("_last"))
        .when(F.col("_low") + 1 >= F.col("n"), F.col("_a"))
        .otherwise(F.col("_a") * (1.0 - part) + F.col("_b") * part)
    )
    return per_probe.select(SESSION, "probe_id", "t", CHANNEL, value.alias(VALUE))


def _dealt(probes: DataFrame, ends: DataFrame) -> DataFrame:
    """Probes with the rows of their session in ``ends``, by session and time."""
    moment = F.greatest(F.round(F.col("t") * 1000.0), F.lit(0.0)).cast("bigint")
    return spread_join(probes.withColumn("_ms", moment), ends, [SESSION], "_ms", chunk_rows=DEAL_MS).drop("_ms")


def positions_at(track: DataFrame, probes: DataFrame) -> DataFrame:
    """Track point at the sample nearest to each ``probes(session_id, probe_id, t)``, held at the last sample."""
    ends = track.groupBy(SESSION).agg(F.max(FREQ).alias(FREQ), (F.max(IDX) + 1).alias("n"))
    wanted = F.greatest(F.round(F.col("t") * F.col(FREQ)), F.lit(0.0)).cast("bigint")
    return (
        _dealt(probes, ends)
        .select(SESSION, "probe_id", "t", F.least(wanted, F.col("n") - 1).alias(IDX))
        .join(track.select(SESSION, IDX, "x", "y"), [SESSION, IDX])
        .select(SESSION, "probe_id", "t", IDX, "x", "y")
    )


def nearest_position(
    track: DataFrame, probes: DataFrame, cell: float = CELL, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Sample nearest to each ``probes(session_id, probe_id, px, py)``; the first one wins ties.

    The track is binned into square cells, and cells into larger ones, ``FAN`` times as wide on each of ``LEVELS`` levels. A cell knows the
    box around its points. Probes go down level by level: they meet the occupied children of their cells by (session, parent cell); the smallest
    reach (farthest corner of a box) is the bound, and only children whose boxes are not farther than that go on. On the last
    level the points of the remaining cells are met by (session, chunk, cell), so a parked car that fills one cell stays spread over tasks. No step
    lists probes against all cells of a session, except on the top level, where the whole track is in a few.
    """
    points = with_chunk(track.select(SESSION, IDX, "x", "y"), IDX, chunk_rows).withColumns(
        {"_cx": F.floor(F.col("x") / cell), "_cy": F.floor(F.col("y") / cell)}
    )
    box = [F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1")]
    by_chunk = points.groupBy(SESSION, CHUNK, "_cx", "_cy").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
    )
    levels = [by_chunk.groupBy(SESSION, "_cx", "_cy").agg(*box)]
    for _ in range(LEVELS):
        wider = levels[-1].withColumns({"_cx": F.floor(F.col("_cx") / FAN), "_cy": F.floor(F.col("_cy") / FAN)})
        levels.append(wider.groupBy(SESSION, "_cx", "_cy").agg(*box))

    def apart(p: Column, low: Column, high: Column) -> tuple[Column, Column]:
        """Nearest and farthest distance along one axis from a point to a box."""
        return F.greatest(low - p, p - high, F.lit(0.0)), F.greatest(F.abs(low - p), F.abs(p - high))

    near_x, far_x = apart(F.col("px"), F.col("x0"), F.col("x1"))
    near_y, far_y = apart(F.col("py"), F.col("y0"), F.col("y1"))
    who = [SESSION, "probe_id"]

    def pruned(met: DataFrame) -> DataFrame:
        # a probe's list is bounded: children of cells that a level above let through
        cell = F.struct("_cx", "_cy", (near_x * near_x + near_y * near_y).alias("near"))
        reach = F.min(far_x * far_x + far_y * far_y).alias("_reach")
        seen = met.groupBy(*who, "px", "py").agg(reach, F.collect_list(cell).alias("_cells"))
        # distances of a box are those of points, rounded alike up to a margin far above that error
        left = F.filter("_cells", lambda c: c["near"] <= F.col("_reach") * (1.0 + 1e-9))
        return seen.select(*who, "px", "py", F.explode(left).alias("_c")).select(*who, "px", "py", "_c._cx", "_c._cy")

    asked = pruned(probes.select(*who, "px", "py").join(levels[-1], SESSION))
    for level in levels[-2::-1]:
        parents = asked.withColumnsRenamed({"_cx": "_px", "_cy": "_py"})
        children = level.withColumns({"_px": F.floor(F.col("_cx") / FAN), "_py": F.floor(F.col("_cy") / FAN)})
        asked = pruned(parents.join(children, [SESSION, "_px", "_py"]))
    candidates = asked.join(by_chunk.select(SESSION, CHUNK, "_cx", "_cy"), [SESSION, "_cx", "_cy"])
    dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    best = F.min(F.struct((dx * dx + dy * dy).alias("dist2"), F.col(IDX)))
    return (
        points.join(candidates, [SESSION, CHUNK, "_cx", "_cy"])
        .groupBy(*who)
        .agg(best.alias("_best"))
        .select(*who, F.col("_best")[IDX].alias(IDX), F.col("_best")["dist2"].alias("dist2"))
    )
