"""Extension: power spectra of channels by averaged, overlapping windows (Welch's method).

A sample belongs to the two windows that overlap it; each window is a row of its own, transformed in whatever task holds it, and the powers are averaged
by partial aggregates. No task sees more of a series than a window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from apexgrid.chunking import int_div
from apexgrid.functions.scalar import is_finite
from apexgrid.schema import FREQ, IDX, SERIES, VALUE


def spectrum(samples: DataFrame, size: int = 64) -> DataFrame:
    """Mean power of each frequency: ``(session_id, channel, bin, frequency, power, windows)``.

    Windows are ``size`` samples (even), begin every half of that, lose their mean and are weighed by a periodic Hann window. Windows that
    are cut by the end of the series, or hold a value that is not finite, do not count.
    """
    if size < 2 or size % 2:
        raise ValueError("a window has an even number of samples")
    half = size // 2
    number = int_div(F.col(IDX), half)
    both = F.array_compact(F.array(number, F.when(number > 0, number - 1)))
    rows = samples.filter((F.col(FREQ) > 0) & is_finite(VALUE)).select(*SERIES, FREQ, IDX, VALUE, F.explode(both).alias("window"))
    listed = rows.groupBy(*SERIES, "window").agg(
        F.max(FREQ).alias(FREQ), F.array_sort(F.collect_list(F.struct(IDX, VALUE)))[VALUE].alias("values")
    )

    @F.arrow_udf(ArrayType(DoubleType()))
    def powers(values: pa.Array) -> pa.Array:
        x = values.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
        weights = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
        spectra = np.abs(np.fft.rfft((x - x.mean(axis=1, keepdims=True)) * weights, axis=1)) ** 2 / (weights**2).sum()
        offsets = np.arange(len(x) + 1) * spectra.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(spectra.ravel()))

    whole = listed.filter(F.size("values") == size).select(*SERIES, FREQ, F.posexplode(powers("values")).alias("bin", "power"))
    mean = whole.groupBy(*SERIES, "bin").agg(F.max(FREQ).alias(FREQ), F.avg("power").alias("power"), F.count(F.lit(1)).alias("windows"))
    return mean.select(*SERIES, "bin", (F.col("bin") * F.col(FREQ) / size).alias("frequency"), "power", "windows")
