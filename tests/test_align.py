import math
import random

import pytest
from helpers import NAN, assert_same, lerp_at, linear, nearest

from apexgrid.operators import align

CHUNK = 8
RATES = [1, 2, 3, 5, 7, 10, 20, 49, 50, 100]


def random_sessions(seed, rates=RATES, longest=60):
    rng = random.Random(seed)
    out = {}
    for s in range(6):
        for c in range(4):
            n = rng.choice([1, 2, CHUNK, rng.randint(3, longest)])
            values = [round(rng.uniform(-9, 9), 3) for _ in range(n)]
            if rng.random() < 0.3:
                values[rng.randrange(n)] = NAN
            out[(f"s{s}", f"c{c}")] = (rng.choice(rates), values)
    return out


def grids(series):
    out = {}
    for (s, _), (f, x) in series.items():
        rate, secs = out.get(s, (1, 0.0))
        out[s] = (max(rate, f), max(secs, len(x) / f if f else 0.0))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_linear_against_loop(make, read, seed):
    series = random_sessions(seed)
    got = read(align.resample_linear(make(series), chunk_rows=CHUNK), ["session_id", "channel"], "out_idx")
    for key, (f, x) in series.items():
        rate, secs = grids(series)[key[0]]
        assert_same(got[key], linear(x, f, rate, math.ceil(secs * rate)))


@pytest.mark.parametrize("window", [None, (0.35, 2.05), (0.0, 100.0)])
def test_nearest_against_loop(make, read, window):
    series = random_sessions(4)
    out = align.resample_nearest(make(series), window, chunk_rows=CHUNK)
    got = read(out, ["session_id", "channel"], "out_idx")
    for key, (f, x) in series.items():
        rate, secs = grids(series)[key[0]]
        t0, t1 = window or (0.0, secs)
        rows = range(math.floor(t0 * rate), math.ceil(t1 * rate))
        assert_same(got[key], nearest(x, f, rate, rows))


def test_stopped_channel_repeats_its_first_value(make, read):
    series = {("s", "moving"): (4, [1.0, 2.0, 3.0, 4.0, 5.0]), ("s", "stopped"): (0, [7.0, 8.0])}
    for op in (align.resample_linear, align.resample_nearest):
        got = read(op(make(series)), ["channel"], "out_idx")
        assert got["stopped"] == [7.0] * 5
        assert got["moving"] == series["s", "moving"][1]


def test_long_tail_is_spread(make, read):
    series = {("s", "short"): (1, [4.0, 6.0]), ("s", "long"): (10, [0.0] * 500)}
    got = read(align.resample_linear(make(series), chunk_rows=CHUNK), ["channel"], "out_idx")
    assert got["short"] == linear([4.0, 6.0], 1, 10, 500)


def test_same_rate_keeps_neighbours_of_gaps(make, read):
    x = [1.0, NAN, 3.0]
    got = read(align.resample_linear(make({("s", "a"): (5, x)})), ["channel"], "out_idx")
    assert_same(got["a"], x)


def test_given_grid(spark, make, read):
    grid = spark.createDataFrame([("s", 4, 6)], "session_id string, out_freq int, out_len bigint")
    x = [0.0, 10.0, 20.0, 30.0, 40.0]
    got = read(align.resample_linear(make({("s", "a"): (2, x)}), grid), ["channel"], "out_idx")
    assert_same(got["a"], linear(x, 2, 4, 6))


def test_track_clock(spark, make, read):
    series = random_sessions(5)
    track = make({(f"s{s}", "t"): (7, [0.0] * 30) for s in range(6)})
    got = read(align.resample_to_track(make(series), track, chunk_rows=CHUNK), ["session_id", "channel"], "out_idx")
    for key, (f, x) in series.items():
        assert_same(got[key], [lerp_at(x, (i / 7) * f) for i in range(30)])
    ten = make({("s", "c"): (10, [i * 10.0 for i in range(10)])})
    assert read(align.resample_to_track(ten, make({("s", "t"): (2, [0, 0])})), ["channel"], "out_idx")["c"] == [0.0, 50.0]


def test_output_rate(make):
    rows = align.output_rate(align.series_facts(make({("s", "a"): (2, [0, 0, 0]), ("s", "b"): (5, [0] * 6)}))).collect()
    assert {(r.out_freq, r.duration, r.out_len) for r in rows} == {(5, 1.5, 8)}
