import math
import random

import pytest
from helpers import INF, NAN, assert_same, buckets, same

from apexgrid.operators import catalog, decimate, stats


def noisy(n, seed, bad=()):
    rng = random.Random(seed)
    x = [round(rng.uniform(-9, 9), 2) for _ in range(n)]
    for i in bad:
        x[i] = NAN
    return x


@pytest.mark.parametrize("width", [1, 3, 7, 10, 17, 64])
@pytest.mark.parametrize("start", [0, 37])
def test_decimation(spark, make, width, start):
    series = {
        ("s", "a"): (10, noisy(100, 1)),
        ("s", "b"): (3, noisy(129, 2, [0, 5, 30, 90])),
        ("t", "a"): (7, noisy(5, 3, [2])),
        ("t", "b"): (1, noisy(2 * width, 4)),
        ("t", "c"): (1, noisy(2 * width + 1, 5)),
    }
    samples = make(series).selectExpr("session_id", "channel", "freq", f"sample_idx + {start} AS sample_idx", "value")
    rows = decimate.decimate(samples, width, chunk_rows=16).orderBy("session_id", "channel", "bucket").collect()
    for key, (f, x) in series.items():
        got = [r for r in rows if (r.session_id, r.channel) == key]
        expected = buckets(x, f, start, width)
        for k, name in enumerate(["time", "min", "max"]):
            assert_same([r[name] for r in got], [e[k] for e in expected])


def test_decimation_of_nothing(make):
    assert decimate.decimate(make({("s", "a"): (10, [])}), 5).count() == 0
    assert decimate.decimate(make({("s", "a"): (10, [1.0])}), 0).count() == 0
    assert decimate.decimate(make({("s", "a"): (0, [1.0])}), 5).count() == 0


def test_time_window_and_line(make):
    series = {("s", "a"): (10, noisy(400, 6)), ("s", "b"): (1, noisy(40, 7))}
    seen = decimate.time_window(make(series), 2.55, 20.0).groupBy("channel").count().collect()
    assert dict(seen) == {"a": 200 - 25 + 1, "b": 20 - 2 + 1}
    assert decimate.time_window(make(series), -1.0, 0.0).count() == 440
    line = decimate.chart_line(make(series), 2.55, 39.0, 20).filter("channel = 'a'").orderBy("bucket").collect()
    expected = buckets(series["s", "a"][1][25:391], 10, 25, 100)
    assert_same([r.value for r in line], [(lo + hi) / 2 for _, lo, hi in expected])
    assert_same([r.time for r in line], [t for t, *_ in expected])


def test_overview(spark, make):
    series = {("s", "Oil"): (10, noisy(90, 8)), ("s", "GPS Speed"): (10, noisy(90, 9)), ("flat", "x"): (1, [2.0] * 9)}
    channels = spark.createDataFrame(
        [("s", 0, "Oil"), ("s", 1, "GPS Speed"), ("flat", 0, "x")], "session_id string, channel_index int, channel string"
    )
    rows = decimate.overview_waveform(make(series), catalog.representative_channel(channels), 10).orderBy("bucket").collect()
    assert {r.channel for r in rows} == {"GPS Speed"} and len(rows) == 10
    assert min(r.low for r in rows) == 0.0 and max(r.high for r in rows) == 1.0


def test_stats_of_finite_values(make):
    x = [1.0, NAN, 4.0, INF, -INF, 7.0]
    row = stats.channel_stats(make({("s", "a"): (1, x)})).first()
    assert (row.min_value, row.max_value, row.avg_value) == (1.0, 7.0, 4.0)
    assert math.isclose(row.std_value, math.sqrt(6.0))


@pytest.mark.parametrize(
    "x,low,high,mean",
    [([2.0, 1.0, 3.0], 1.0, 3.0, 2.0), ([2.0, NAN, 3.0], 2.0, 3.0, NAN), ([NAN, 1.0, 3.0], NAN, NAN, NAN)],
)
def test_summary_is_a_running_loop(make, x, low, high, mean):
    row = stats.channel_summary(make({("s", "a"): (1, x)})).first()
    assert same(row.min_value, low) and same(row.max_value, high) and same(row.mean_value, mean)
    assert row.n_samples == 3


def test_rates_and_durations(make):
    channels = stats.catalog_of(make({("s", "a"): (10, [0] * 25), ("s", "b"): (10, [0]), ("s", "c"): (0, [0] * 99)}))
    assert [tuple(r) for r in stats.rate_counts(channels).collect()] == [(0, 1), (10, 2)]
    assert tuple(stats.session_duration(channels).first()) == ("s", 2.5, 3)


def test_session_summary(spark, make):
    sessions = spark.createDataFrame([("s", "Ann"), ("t", "Bo")], "session_id string, driver string")
    laps = spark.createDataFrame([("s", 0), ("s", 1)], "session_id string, number int")
    rows = stats.session_summary(sessions, stats.catalog_of(make({("s", "a"): (2, [0, 0, 0])})), laps).collect()
    assert {tuple(r) for r in rows} == {("s", "Ann", 1.5, 1, 2), ("t", "Bo", 0.0, 0, 0)}


def test_ranges(make):
    df = make({("s", "a"): (1, [0.0, 10.0, NAN]), ("s", "b"): (1, [20.0]), ("t", "c"): (1, [5.0]), ("u", "d"): (1, [NAN])})
    got = {r.session_id: (r.y_min, r.y_max) for r in stats.display_range(df).collect()}
    assert got == {"s": (-1.0, 21.0), "t": (4.0, 6.0), "u": (-1.0, 1.0)}
    assert stats.display_range(df, ["b"]).first().y_min == 19.0
    whole = {r.channel: (r.vmin, r.vmax) for r in stats.value_range(df, ["channel"]).collect()}
    assert whole["a"] == (0.0, 10.0) and whole["d"] == (0.0, 0.0)
