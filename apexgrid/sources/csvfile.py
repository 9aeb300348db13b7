"""CSV export of aligned channels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apexgrid.chunking import CHUNK, CORE
from apexgrid.functions.scalar import fixed_text
from apexgrid.operators import slices
from apexgrid.operators.align import OUT_FREQ, OUT_IDX
from apexgrid.schema import CHANNEL, SESSION

TIME_HEADER = "Time (s)"
TIME_DECIMALS = 6


def csv_rows(
    samples: DataFrame,
    channels: Mapping[str, int] | Sequence[str],
    time_range: tuple[float, float] | None = None,
    seconds: int = slices.SLICE_SECONDS,
    catalog: DataFrame | None = None,
) -> DataFrame:
    """Text rows ``(session_id, out_idx, Time (s), <channels>)`` of the channels, given with their decimals.

    Channels given as names only have the decimals of ``catalog(session_id, channel, dec_places)``, which may differ by session; negative or unknown
    ones are none. Channels are aligned to the fastest one by nearest sample, inside slices of ``seconds``: the samples are shuffled once, as
    they are, whatever the fastest rate. A channel that a session lacks reads as 0. The rows of a
    range go from floor(start * rate) to below ceil(end * rate), so a range of no length between two samples has one row.
    """
    if not channels:
        raise ValueError("there are no channels to write")
    if not isinstance(channels, Mapping) and catalog is None:
        raise ValueError("channels without decimals need a catalogue")
    if time_range is not None:
        start, end = time_range
        # from whole second to the same whole second is empty at any rate
        if not start <= end or start == end == int(start):
            raise ValueError("a time range that holds no samples")
    chosen = samples.filter(F.col(CHANNEL).isin(list(channels)))
    heads = slices.series_heads(chosen)
    rows = slices.sliced(chosen, heads, seconds=seconds, time_range=time_range)
    grids = slices.grids_by_session(heads)
    cells = {f"_cell{k}": F.col(CHANNEL) == c for k, c in enumerate(channels)}
    if isinstance(channels, Mapping):
        slots, facts = slices.nearest_slots(rows, grids, time_range, seconds), {}
        decimals = list(channels.values())
    else:
        known = catalog.filter(F.col(CHANNEL).isin(list(channels)) & F.col("dec_places").isNotNull())
        entry = F.struct(F.col(CHANNEL), F.col("dec_places").cast("int"))
        places = known.groupBy(SESSION).agg(F.map_from_entries(F.collect_list(entry)).alias("_places"))
        slots = slices.nearest_slots(rows, grids.join(places, SESSION, "left"), time_range, seconds, keep=["_places"])
        facts = {f"_dec{k}": F.when(F.col(CHANNEL) == c, F.col("_places")[c]) for k, c in enumerate(channels)}
        decimals = [F.coalesce(F.col(d), F.lit(0)) for d in facts]
    wide = slices.side_by_side(slots, cells, seconds=seconds, facts=facts).drop(CHUNK, CORE)
    time = F.col(OUT_IDX) * (F.lit(1.0) / F.col(OUT_FREQ))
    return wide.select(
        SESSION,
        OUT_IDX,
        fixed_text(time, TIME_DECIMALS).alias(TIME_HEADER),
        *(fixed_text(F.col(cell), d).alias(c) for cell, c, d in zip(cells, channels, decimals)),
    )


def write_csv(rows: DataFrame, path: str) -> None:
    """Files below ``path/session_id=.../`` in time order, each with the header.

    Range partitioning by session and time keeps rows in order across files and splits long sessions over tasks.
    """
    (
        rows.repartitionByRange(SESSION, OUT_IDX)
        .sortWithinPartitions(SESSION, OUT_IDX)
        .drop(OUT_IDX)
        .write.mode("overwrite")
        .partitionBy(SESSION)
        .option("header", "true")
        .csv(path)
    )


