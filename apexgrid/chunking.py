"""Splitting long series into chunks of bounded length.

A window partitioned by session (or by session and channel) puts a whole series into one task, and one
session may hold a large share of all rows. Every order-dependent operator of this package therefore works on
``(series keys, chunk)``, where ``chunk = sample_idx div chunk_rows``, and gets what it needs from other
chunks in one of two ways:

* **halo** - a row is copied into the neighbouring chunks that look back or ahead at it;
* **chunk facts** - one small row per chunk (built with map-side partial aggregation) is combined over the
  series by a window and joined back on ``(series keys, chunk)``.

No task ever sees more than one chunk plus its halo of a series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK_ROWS = 1 << 16
CHUNK = "_chunk"
CORE = "_core"


def int_div(a: Column, b: Column | int) -> Column:
    """Integer quotient, truncated."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def with_chunk(df: DataFrame, idx: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    return df.withColumn(CHUNK, int_div(F.col(idx), chunk_rows))


def with_halo(df: DataFrame, idx: str, back: int, ahead: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Copy each row into every chunk whose rows look ``back`` or ``ahead`` that far; own rows have CORE set."""
    if back == 0 and ahead == 0:
        return with_chunk(df, idx, chunk_rows).withColumn(CORE, F.lit(True))
    i = F.col(idx)
    first = int_div(F.greatest(i - ahead, F.lit(0)), chunk_rows)
    last = int_div(i + back, chunk_rows)
    return df.withColumn(CHUNK, F.explode(F.sequence(first, last))).withColumn(
        CORE, F.col(CHUNK) == int_div(i, chunk_rows)
    )


def chunk_window(keys: Sequence[str], idx: str) -> WindowSpec:
    return Window.partitionBy(*keys, CHUNK).orderBy(idx)


def earlier_chunks(keys: Sequence[str]) -> WindowSpec:
    """Over chunk facts: all chunks of the series before the current one."""
    return Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)


def chunk_facts(facts: DataFrame) -> DataFrame:
    """Chunk facts as the build side of a hash join, which spares the large side a sort.

    There is at most one such row per chunk, so a task's share of them is a small fraction of its rows.
    """
    return facts.hint("shuffle_hash")


def dense_index(
    df: DataFrame, keys: Sequence[str], order: str, out: str, span: int = CHUNK_ROWS
) -> DataFrame:
    """Number the rows of each key 0, 1, ... by ``order``, an integer column unique within the key.

    Rows are numbered inside slots of ``span`` order values, then shifted by the row count of the earlier
    slots, so a heavy key is spread over its slots.
    """
    slot = "_slot"
    slotted = df.withColumn(slot, int_div(F.col(order), span))
    counts = slotted.groupBy(*keys, slot).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(
        *keys, slot, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base")
    )
    local = slotted.withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*keys, slot).orderBy(order))
    )
    return (
        local.join(base, [*keys, slot])
        .withColumn(out, F.col("_base") + F.col("_rn") - 1)
        .drop(slot, "_rn", "_base")
    )


def explode_span(
    df: DataFrame, lo: Column, hi: Column, out: str, keys: Sequence[str], piece: int = CHUNK_ROWS
) -> DataFrame:
    """One row per integer in ``[lo, hi]`` (``0 <= lo``), long spans being split over tasks before they grow."""
    start = F.col("_piece") * piece
    return (
        df.withColumn("_lo", lo)
        .withColumn("_hi", hi)
        .filter(F.col("_lo") <= F.col("_hi"))
        .withColumn(
            "_piece",
            F.explode(F.sequence(int_div(F.col("_lo"), piece), int_div(F.col("_hi"), piece))),
        )
        .repartition(*keys, "_piece")
        .withColumn(
            out,
            F.explode(
                F.sequence(
                    F.greatest(F.col("_lo"), start), F.least(F.col("_hi"), start + (piece - 1))
                )
            ),
        )
        .drop("_lo", "_hi", "_piece")
    )


def spread_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    idx: str,
    how: str = "inner",
    chunk_rows: int = CHUNK_ROWS,
    present: DataFrame | None = None,
) -> DataFrame:
    """Join per-key rows of ``small`` to ``big`` on the key *and* the chunk of ``idx``.

    ``small`` is repeated once per chunk that ``big`` has for the key, so no join task holds more of one key
    than a chunk. ``how`` is ``inner`` or ``left``. ``present`` is a cheaper frame with the same keys and indexes as ``big``.
    """
    known = with_chunk(big if present is None else present, idx, chunk_rows)
    chunks = known.select(*keys, CHUNK).distinct()
    return (
        with_chunk(big, idx, chunk_rows)
        .join(chunk_facts(chunks.join(small, list(keys))), [*keys, CHUNK], how)
        .drop(CHUNK)
    )


def join_by_chunk(
    big: DataFrame, small: DataFrame, keys: Sequence[str], idx: str, how: str = "inner", chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """As :func:`spread_join`, for per-series rows that know the length ``n_data`` of their series: it says which chunks there are, so ``big`` is
    not looked at for them."""
    last = int_div(F.greatest(F.col("n_data"), F.lit(1)) - 1, chunk_rows)
    chunks = small.withColumn(CHUNK, F.explode(F.sequence(F.lit(0).cast("bigint"), last))).drop("n_data")
    return with_chunk(big, idx, chunk_rows).join(chunk_facts(chunks), [*keys, CHUNK], how).drop(CHUNK)
