"""Distance axis, laps over each other, histograms, maps, thinned plots and spectra against plain loops."""

import cmath
import math
import random

import pytest
from helpers import INF, NAN, area, assert_same
from pyspark.sql import functions as F

from apexgrid.operators import densities, distance, spectrum

LAPS = "session_id string, number int, name string, start_time double, end_time double"


def drive(seed, n):
    rng = random.Random(seed)
    speed = [max(rng.uniform(-30, 200), 0.0) if rng.random() < 0.8 else 0.0 for _ in range(n)]
    return speed, [rng.uniform(-5, 5) for _ in range(n)]


def frame_of(spark, drives, freq=5):
    rows = [(s, freq, i, float(v), float(w)) for s, (speed, value) in drives.items() for i, (v, w) in enumerate(zip(speed, value))]
    return spark.createDataFrame(rows, "session_id string, freq int, sample_idx bigint, speed double, w double").repartition(3)


def metres(speed, freq):
    return area([v / 3.6 if math.isfinite(v) and v > 0 else 0.0 for v in speed], freq)


def at_distance(d, values, x):
    """Value at distance x: on the first sample that reaches it, else between the two around it."""
    for i in range(len(d)):
        if d[i] == x and (i + 1 == len(d) or d[i + 1] > x):
            return values[i]
        if i + 1 < len(d) and d[i] < x < d[i + 1]:
            return values[i] + (values[i + 1] - values[i]) * (x - d[i]) / (d[i + 1] - d[i])
    return None


@pytest.mark.parametrize("chunk", [4, 1 << 16])
def test_distance_axis(spark, read, chunk):
    drives = {"a": drive(1, 90), "b": ([0.0] * 5 + [36.0] * 5 + [0.0] * 7 + [NAN, -3.0] + [36.0] * 3, list(range(22))), "still": ([0.0] * 4, [1.0] * 4)}
    rows = distance.distance_axis(frame_of(spark, drives), "speed", ["w"], 2.5, chunk_rows=chunk)
    got = read(rows, ["session_id"], "slot", "w")
    slots = read(rows, ["session_id"], "slot", "slot")
    for s, (speed, w) in drives.items():
        d = metres(speed, 5)
        assert slots[s] == list(range(int(d[-1] // 2.5) + 1))
        # a point that falls on a standstill is that of its last sample, from where driving goes on
        assert_same(got[s], [at_distance(d, w, 2.5 * k) for k in slots[s]])


def test_overlay(spark):
    drives = {"a": drive(3, 60), "b": drive(4, 80)}
    laps = spark.createDataFrame([("a", 0, "Out Lap", 0.0, 5.0), ("a", 1, "Lap 1", 5.0, 12.0), ("b", 1, "Lap 1", 2.0, 14.0), ("b", 2, "none", 3.0, 3.0)], LAPS)
    rows = distance.overlay(frame_of(spark, drives), laps, "speed", ["w"], ("a", 1), 20, 16).collect()
    by_lap = {}
    for r in rows:
        by_lap.setdefault((r.session_id, r.number), {})[r.slot] = r
    assert set(by_lap) == {("a", 0), ("a", 1), ("b", 1)}
    for (s, number), found in by_lap.items():
        start, end = {("a", 0): (0, 25), ("a", 1): (25, 60), ("b", 1): (10, 70)}[s, number]
        speed, w = drives[s]
        d = metres(speed, 5)[start:end]
        own = [(x - d[0]) / (d[-1] - d[0]) for x in d]
        for k, r in found.items():
            expected = at_distance(own, w[start:end], k / 20)
            assert expected is None or abs(r.w - expected) < 1e-6
            assert r.ref_w == by_lap["a", 1][k].w and abs(r.time_delta - (r.time - by_lap["a", 1][k].time)) < 1e-12
        assert set(found) >= set(range(1, 20))
    assert distance.overlay(frame_of(spark, drives), laps, "speed", ["w"], ("a", 7)).count() == 0


def test_stretching(spark):
    # a circle driven in 10 s, then in 20 s, then halfway only
    turns = [i / 100 for i in range(100)] + [i / 200 for i in range(200)] + [i / 200 for i in range(100)]
    rows = [("s", i, 10, i / 10, math.cos(2 * math.pi * t), math.sin(2 * math.pi * t)) for i, t in enumerate(turns)]
    track = spark.createDataFrame(rows, "session_id string, sample_idx bigint, freq int, time double, x double, y double")
    laps = spark.createDataFrame([("s", 0, "Out Lap", 0.0, 10.0), ("s", 1, "Lap 1", 10.0, 30.0), ("s", 2, "In Lap", 30.0, 40.0)], LAPS)
    got = {(r.number, r.sample_idx): r for r in distance.stretched(track, laps, [25, 50], 0).collect()}
    assert len(got) == 400
    for i in range(100):
        assert abs(got[0, i].ref_time - i / 10) < 1e-9 and abs(got[0, i].gain) < 1e-9
    # half as fast: every position is reached after twice the time
    for i in range(200):
        assert abs(got[1, 100 + i].ref_time - i / 20) < 1e-9 and abs(got[1, 100 + i].gain + i / 20) < 1e-9
    assert distance.stretched(track, laps, [25, 50], 9).count() == 0


def test_histogram(spark, make):
    x = [NAN, 0.0, 1.0, 2.5, 9.99, 10.0, INF, 5.0]
    laps = spark.createDataFrame([("s", 0, "Out Lap", 0.0, 4.0), ("s", 1, "Lap 1", 3.0, 8.0)], LAPS)
    rows = densities.lap_histogram(make({("s", "c"): (1, x), ("s", "flat"): (1, [2.0, 2.0]), ("s", "none"): (1, [NAN])}), laps, 10, 3).collect()
    assert {(r.channel, r.number, r.bin): r.n for r in rows} == {
        ("c", 0, 0): 1, ("c", 0, 1): 1, ("c", 0, 2): 1, ("c", 1, 2): 1, ("c", 1, 9): 2, ("c", 1, 5): 1, ("flat", 0, 0): 2
    }
    assert all(r.low == r.bin and r.high == r.bin + 1 for r in rows if r.channel == "c")


def test_maps_and_thinned_plots(spark):
    rng = random.Random(5)
    rows = [("s", i, rng.uniform(0, 10), rng.uniform(0, 10), rng.uniform(0, 1)) for i in range(3000)] + [("s", 3000, NAN, 1.0, 1.0), ("flat", 0, 1.0, 1.0, 1.0)]
    frame = spark.createDataFrame(rows, "session_id string, sample_idx bigint, x double, y double, z double").repartition(4)
    cells = {}
    for s, i, x, y, z in rows:
        if not math.isnan(x):
            cells.setdefault((s, math.floor(x / 5), math.floor(y / 5)), []).append(z)
    got = densities.mixture_map(frame, "x", "y", "z", (5.0, 5.0), 2).collect()
    assert {(r.session_id, r.x_bin, r.y_bin) for r in got} == {k for k, v in cells.items() if len(v) > 1}
    for r in got:
        own = cells[r.session_id, r.x_bin, r.y_bin]
        assert r.n == len(own) and abs(r.z_mean - sum(own) / len(own)) < 1e-12
    thin = densities.scatter(frame, "x", "y", (6, 4), chunk_rows=100).collect()
    again = densities.scatter(frame.repartition(7), "x", "y", (6, 4)).collect()
    assert len(thin) == 25 and sorted(thin) == sorted(again) and sum(r.n for r in thin) == 3001
    by_index = {(s, i): (x, y) for s, i, x, y, _ in rows}
    assert all(by_index[r.session_id, r.sample_idx] == (r.x, r.y) for r in thin)


def test_spectrum_is_the_mean_of_plain_transforms(make):
    rng = random.Random(7)
    x = [math.sin(2 * math.pi * 3 * i / 16) * 4 + rng.gauss(0, 0.1) for i in range(100)]
    series = {("s", "c"): (32, x), ("s", "gap"): (8, [*x[:20], NAN, *x[21:40]]), ("s", "short"): (8, x[:15]), ("s", "still"): (0, x)}
    got = {(r.channel, r.bin): r for r in spectrum.spectrum(make(series), 16).collect()}
    for c, values, starts in (("c", x, range(0, 85, 8)), ("gap", series["s", "gap"][1], [0, 24])):
        for k in range(9):
            powers = []
            for low in starts:
                w = [0.5 - 0.5 * math.cos(2 * math.pi * j / 16) for j in range(16)]
                part = values[low : low + 16]
                mean = sum(part) / 16
                z = sum((v - mean) * a * cmath.exp(-2j * math.pi * k * j / 16) for j, (v, a) in enumerate(zip(part, w)))
                powers.append(abs(z) ** 2 / sum(a * a for a in w))
            r = got[c, k]
            assert r.windows == len(powers) and abs(r.power - sum(powers) / len(powers)) < 1e-6
    assert max(range(9), key=lambda k: got["c", k].power) == 3 and got["c", 3].frequency == 6.0
    assert {c for c, _ in got} == {"c", "gap"}
    with pytest.raises(ValueError):
        spectrum.spectrum(make(series), 5)
    assert spectrum.spectrum(make(series).filter(F.lit(False))).collect() == []
