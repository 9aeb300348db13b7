import math
import random

import pytest
from helpers import INF, NAN, assert_same, lerp_at, members, same
from pyspark.sql import functions as F

from apexgrid.functions.scalar import hsv_to_rgb
from apexgrid.operators import catalog, lookup, sectors, track
from apexgrid.operators.sectors import Sector

TRACK = "session_id string, sample_idx bigint, freq int, time double, x double, y double"
PROBES = "session_id string, probe_id int, t double"
LAPS = "session_id string, number int, name string, start_time double, end_time double"


def loop_track(seed, n, f, step=0.11):
    rng = random.Random(seed)
    return [
        (i, f, i / f, 0.01 * math.cos(i * step) + rng.uniform(0, 2e-4), 0.006 * math.sin(i * step) + rng.uniform(0, 2e-4))
        for i in range(n)
    ]


@pytest.fixture(scope="module")
def tracks(spark):
    data = {"s": loop_track(1, 300, 10), "t": loop_track(2, 90, 4), "parked": [(i, 5, i / 5, 0.001, 0.001) for i in range(60)]}
    return data, spark.createDataFrame([(s, *r) for s, rows in data.items() for r in rows], TRACK)


def at_time(x, f, t):
    if not x or f == 0:
        return 0.0
    place = t * f
    k = max(int(place), 0)
    if k >= len(x):
        return x[-1]
    if k + 1 >= len(x):
        return x[k]
    return x[k] * (1.0 - (place - k)) + x[k + 1] * (place - k)


def test_values_at(spark, make):
    series = {("s", "a"): (10, [1.0, 3.0, NAN, 7.0, 9.0]), ("s", "b"): (2, [5.0]), ("s", "c"): (0, [4.0]), ("t", "a"): (1, [2.0, 4.0])}
    times = [-0.5, -0.04, 0.0, 0.05, 0.1, 0.25, 0.36, 0.4, 0.47, 0.5, 3.0]
    probes = spark.createDataFrame([(s, k, t) for s in "stx" for k, t in enumerate(times)], PROBES)
    rows = lookup.values_at(make(series), probes).collect()
    assert len(rows) == len(times) * 4
    for r in rows:
        f, x = series[r.session_id, r.channel]
        assert same(r.value, at_time(x, f, r.t)), r


def test_positions_at(spark, tracks):
    data, df = tracks
    probes = spark.createDataFrame([(s, k, t) for s in data for k, t in enumerate([-1.0, 0.0, 0.05, 1.26, 7.7, 99.0])], PROBES)
    for r in lookup.positions_at(df, probes).collect():
        rows = data[r.session_id]
        i = min(max(math.floor(r.t * rows[0][1] + 0.5), 0), len(rows) - 1)
        assert (r.sample_idx, r.x, r.y) == (i, rows[i][3], rows[i][4])


@pytest.mark.parametrize("cell", [1e-4, 1e-3, 5e-2])
def test_nearest_position(spark, tracks, cell):
    data, df = tracks
    rng = random.Random(5)
    probes = [(s, k, rng.uniform(-0.015, 0.015), rng.uniform(-0.015, 0.015)) for s in data for k in range(12)]
    probes += [("s", 99, data["s"][7][3], data["s"][7][4])]
    table = spark.createDataFrame(probes, "session_id string, probe_id int, px double, py double")
    got = {(r.session_id, r.probe_id): r.sample_idx for r in lookup.nearest_position(df, table, cell, chunk_rows=32).collect()}
    for s, k, px, py in probes:
        distance = [(x - px) * (x - px) + (y - py) * (y - py) for *_, x, y in data[s]]
        assert got[s, k] == distance.index(min(distance))


def test_nearest_known_points(spark):
    rows = [("s", i, 20, i / 20, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (1, 0), (2, 1), (3, 1)])]
    probes = [("s", 0, 0.1, 0.1), ("s", 1, 2.1, 0.9), ("s", 2, 3.0, 1.0), ("s", 3, 0.5, 0.0)]
    got = lookup.nearest_position(
        spark.createDataFrame(rows, TRACK),
        spark.createDataFrame(probes, "session_id string, probe_id int, px double, py double"),
        cell=0.25,
    )
    assert {r.probe_id: r.sample_idx for r in got.collect()} == {0: 0, 1: 2, 2: 3, 3: 0}


def gps(lat, lon):
    n = min(len(lat), len(lon))
    good = [v for v in lat if math.isfinite(v)], [v for v in lon if math.isfinite(v)]
    mlat, mlon = (sum(g) / max(len(g), 1) for g in good)
    out = []
    for a, b in zip(lat[:n], lon[:n]):
        if math.isfinite(a) and math.isfinite(b):
            out.append(((b - mlon) * math.cos(math.radians(mlat)), a - mlat))
        else:
            out.append(out[-1] if out else (0.0, 0.0))
    return out


def test_gps_track(spark, make):
    rng = random.Random(9)
    lat = [NAN, INF] + [36.5 + rng.uniform(0, 0.02) for _ in range(60)]
    lon = [-79.2 + rng.uniform(0, 0.02) for _ in range(50)]
    for i in (5, 30, 31, 32, 49):
        lat[i] = NAN
    for i in range(10, 29):
        lon[i] = NAN
    series = {
        ("s", "GPS Latitude"): (10, lat), ("s", "gps_long"): (10, lon), ("s", "GPS Lat 2"): (10, [0.0] * 9), ("s", "Speed"): (10, [1] * 9),
        ("bad", "GPS Lat"): (5, [NAN] * 3), ("bad", "GPS Lon"): (5, [1.0] * 3), ("half", "GPS Lat"): (5, [1.0]),
    }
    samples = make(series)
    index = {"GPS Latitude": 0, "gps_long": 1, "GPS Lat 2": 2, "Speed": 3, "GPS Lat": 0, "GPS Lon": 1}
    channels = spark.createDataFrame([(s, index[c], c) for s, c in series], "session_id string, channel_index int, channel string")
    rows = track.gps_track(track.gps_positions(samples, channels, 8), 8).orderBy("session_id", "sample_idx").collect()
    got = [r for r in rows if r.session_id == "s"]
    expected = gps(lat, lon)
    assert_same([r.x for r in got], [e[0] for e in expected], 1e-12)
    assert_same([r.y for r in got], [e[1] for e in expected], 1e-12)
    assert [r.time for r in got] == [i / 10 for i in range(50)]
    assert [(r.x, r.y) for r in rows if r.session_id == "bad"] == [(0.0, 0.0)] * 3
    assert not [r for r in rows if r.session_id == "half"]


def rgb(share):
    hue = (1.0 - share) * 240.0
    h = hue / 60.0
    x = 1.0 - abs(h % 2.0 - 1.0)
    ladder = [(1, x, 0), (x, 1, 0), (0, 1, x), (0, x, 1), (x, 0, 1)]
    return tuple(int(c * 255) for c in ladder[min(int(h), 4)])


def test_track_color(make):
    x = [0.0, 4.0, NAN, 8.0, 2.0]
    line = make({("s", "t"): (4, [0] * 20), ("flat", "t"): (4, [0] * 3)})
    rows = track.track_color(make({("s", "c"): (2, x), ("flat", "c"): (2, [3.0, 3.0])}), line, chunk_rows=8).collect()
    values = [lerp_at(x, (i / 4) * 2) for i in range(20)]
    top = max(v for v in values if not math.isnan(v))
    for r in (r for r in rows if r.session_id == "s"):
        v = values[r.sample_idx]
        assert same(r.value, v) and (r.vmin, r.vmax) == (0.0, top)
        share = 0.0 if math.isnan(v) else min(max((v - r.vmin) / (r.vmax - r.vmin), 0.0), 1.0)
        assert all(abs(a - b) <= 1 for a, b in zip((r.r, r.g, r.b), rgb(share)))
    assert {(r.r, r.g, r.b) for r in rows if r.session_id == "flat"} == {(0, 0, 255)}


def test_legend(spark):
    rows = track.color_legend(spark.createDataFrame([(0.0, 59.0)], "vmin double, vmax double")).orderBy("step").collect()
    assert len(rows) == 60 and tuple(rows[0])[-3:] == (0, 0, 255) and tuple(rows[-1])[-3:] == (255, 0, 0)
    assert rows[7].value == 7.0
    assert spark.range(1).select(hsv_to_rgb(F.lit(120.0)).alias("c")).first().c.g == 255


LAP_ROWS = [("s", 0, "Out Lap", 0.0, 5.75), ("s", 1, "Lap 1", 5.75, 11.42), ("s", 2, "Lap 2", 11.42, 17.1),
            ("s", 3, "In Lap", 17.1, 30.0), ("s", 4, "empty", 40.0, 41.5), ("t", 0, "Out Lap", 0.0, 14.3), ("t", 1, "In Lap", 14.3, 22.5)]
SECTORS = [Sector("S1", 0, 20), Sector("S2", 20, 45), Sector("S3", 45, 2), Sector("S4", 45, 10**6)]


def crossing(rows, f, target, start, end):
    tx, ty = (rows[target][3], rows[target][4]) if target < len(rows) else (0.0, 0.0)
    near = [((rows[i][3] - tx) ** 2 + (rows[i][4] - ty) ** 2, i) for i in members(len(rows), f, start, end)]
    if near:
        return min(near)[1] / f
    first = math.floor(start * f)
    return rows[first][2] if first < len(rows) else 0.0


def sector_secs(rows, f, s, start, end):
    a, b = (crossing(rows, f, k, start, end) for k in s[1:])
    secs = b - a if b > a else (end - start) - (a - b)
    return min(max(secs, 0.0), end - start)


def test_sector_times_and_report(spark, tracks):
    data, df = tracks
    laps = spark.createDataFrame(LAP_ROWS, LAPS)
    got = {(r.session_id, r.number, r.sector): r.time_secs for r in sectors.sector_times(df, laps, SECTORS, 32).collect()}
    expected = {
        (s, number, sec.name): sector_secs(data[s], data[s][0][1], sec, start, end)
        for s, number, _, start, end in LAP_ROWS
        for sec in SECTORS
    }
    assert got.keys() == expected.keys()
    for k in got:
        assert same(got[k], expected[k]), k
    rows = sectors.sector_report(df, laps, SECTORS, 1, 32).collect()
    assert len(rows) == len(LAP_ROWS) * 5
    for r in rows:
        names = [r.sector] if r.sector_no >= 0 else [s.name for s in SECTORS]
        total = sum(expected[r.session_id, r.number, n] for n in names)
        base = sum(expected[r.session_id, 1, n] for n in names)
        assert same(r.time_secs, total) and same(r.ref_secs, base)
        if r.number == 1:
            assert r.delta is None and r.delta_class is None
        else:
            assert same(r.delta, total - base)
            assert r.delta_class == ("faster" if r.delta < -0.01 else "slower" if r.delta > 0.01 else "even")


def test_report_without_reference_lap(spark, tracks):
    _, df = tracks
    laps = spark.createDataFrame(LAP_ROWS, LAPS)
    rows = sectors.sector_report(df, laps, SECTORS, 3).collect()
    assert all(r.delta is None for r in rows if r.session_id == "t")


def test_crossing_of_laps_without_samples(spark, tracks):
    """The first index of the lap where the track has one, else 0."""
    _, df = tracks
    rate = df.filter("session_id = 's'").first()["freq"]
    laps = spark.createDataFrame([("s", 1, "Lap 1", 0.0, 0.0), ("s", 2, "Lap 2", 7.0 / rate, 7.0 / rate), ("s", 3, "Lap 3", 9000.0, 9000.0)], LAPS)
    got = {r.number: r.at_3 for r in sectors.crossing_times(df, laps, [3], 32).collect()}
    assert got[1] == 0.0 and same(got[2], 7.0 / rate) and got[3] == 0.0


def test_define_sectors(spark, tracks):
    data, df = tracks
    picks = [("s", k, data["s"][i][3], data["s"][i][4]) for k, i in enumerate([3, 17, 17, 44, 50])]
    table = spark.createDataFrame(picks, "session_id string, pick_no int, px double, py double")
    found = sectors.define_sectors(df, table)
    assert sorted(map(tuple, found.collect())) == [("s", "S1", 3, 17), ("s", "S2", 17, 44)]
    assert sectors.sector_list(found.orderBy("name")) == [Sector("S1", 3, 17), Sector("S2", 17, 44)]


def test_gps_pick(spark):
    rows = [("s", 0, "GPS Speed"), ("s", 1, "gps.latitude"), ("s", 2, "GPS_Lateral"), ("s", 3, "GPS Long"), ("t", 0, "Latitude")]
    channels = spark.createDataFrame(rows, "session_id string, channel_index int, channel string")
    assert [tuple(r) for r in catalog.pick_gps(channels, catalog.LATITUDE_PARTS).collect()] == [("s", "gps.latitude")]
    assert [tuple(r) for r in catalog.pick_gps(channels, catalog.LONGITUDE_PARTS).collect()] == [("s", "GPS Long")]


def test_configured_report_with_one_configuration_for_all(spark):
    rng = random.Random(12)
    rows = [(s, i, 10, i / 10, rng.uniform(-1, 1), rng.uniform(-1, 1)) for s in ("a", "b") for i in range(120)]
    line = spark.createDataFrame(rows, "session_id string, sample_idx bigint, freq int, time double, x double, y double")
    layout = "session_id string, number int, name string, start_time double, end_time double"
    laps_ = spark.createDataFrame(
        [(s, k, n, a, b) for s in ("a", "b") for k, n, a, b in ((0, "Out Lap", 0.0, 3.0), (1, "Lap 1", 3.0, 7.5), (2, "none", 7.5, 7.5), (3, "In Lap", 7.5, 50.0))], layout
    )
    drawn = [sectors.Sector("S1", 3, 40), sectors.Sector("S2", 40, 90), sectors.Sector("S3", 90, 10**6)]
    table = spark.createDataFrame([(s, k, *d) for s in ("a", "b") for k, d in enumerate(drawn)], "session_id string, sector_no int, name string, start_index bigint, end_index bigint")
    references = spark.createDataFrame([("a", 1), ("b", None)], "session_id string, reference_lap bigint")
    got = sectors.configured_report(line, laps_, table, references, chunk_rows=2)
    expected = sectors.sector_report(line, laps_, drawn, 1)
    key = lambda r: (r.session_id, r.number, r.sector_no)
    found = {key(r): r for r in got.collect()}
    assert set(found) == {key(r) for r in expected.collect()}
    for r in expected.collect():
        own = found[key(r)]
        assert abs(own.time_secs - r.time_secs) < 1e-9 and own.sector == r.sector
        if r.session_id == "a":
            assert (own.delta is None) == (r.delta is None) and own.delta_class == r.delta_class
        else:
            assert own.delta is None and own.ref_secs is None
