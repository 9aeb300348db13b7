import random

import pytest
from helpers import INF, NAN, members, number_laps, timer_laps
from pyspark.sql import functions as F

from apexgrid.chunking import dense_index, explode_span, spread_join
from apexgrid.operators import laps, stats

LAPS = "session_id string, number int, name string, start_time double, end_time double"


def timers():
    rng = random.Random(3)
    out = {}
    for s in range(5):
        f, t, x = rng.choice([1, 5, 10]), rng.uniform(0, 3), []
        length = rng.uniform(4, 9)
        for _ in range(rng.randint(60, 150)):
            x.append(t)
            t += 1 / f
            if t > length:
                t, length = t - length, rng.uniform(4, 9)
        out[f"s{s}"] = (f, x)
    out["none"] = (10, [i / 10 for i in range(30)])
    out["single"] = (10, [5.0])
    out["gap"] = (2, [5.0, NAN, 1.0, 6.0, 0.0, NAN, 7.0, 2.5])
    out["late"] = (2, [50.0, 90.0, 20.0, 80.0, 3.0])
    return out


def found(df):
    out = {}
    for r in df.orderBy("session_id", "number", F.col("name") != "Out Lap").collect():
        out.setdefault(r.session_id, []).append((r.number, r.name, r.start_time, r.end_time))
    return out


def as_series(make, data):
    return make({(s, "x"): v for s, v in data.items()}).drop("channel")


@pytest.mark.parametrize("chunk", [4, 16, 1 << 16])
def test_timer_laps(make, chunk):
    data = timers()
    got = found(laps.detect_from_timer(as_series(make, data), chunk))
    assert got == {s: timer_laps(x, f) for s, (f, x) in data.items() if timer_laps(x, f)}


@pytest.mark.parametrize("chunk", [4, 1 << 16])
def test_number_laps(make, chunk):
    data = {
        "a": (2, [0, 0, 0.9, 1, 1, 2, 2, 2, 3]),
        "flat": (4, [2.0] * 11),
        "gap": (1, [NAN, 0, 1, NAN, -0.5, 1]),
        "huge": (1, [1e300, INF, 0, -1e300, -INF]),
        "one": (5, [1]),
    }
    got = found(laps.detect_from_number(as_series(make, data), chunk))
    assert got == {s: number_laps(x, f) for s, (f, x) in data.items()}


def test_preferred_detector(make):
    timer = as_series(make, {"a": (1, [3, 4, 0, 1]), "b": (1, [0, 1, 2])})
    number = as_series(make, {"a": (1, [1, 1, 1, 1]), "b": (1, [1, 2, 2]), "c": (1, [1, 1])})
    got = found(laps.detect_laps(timer, number))
    assert [name for _, name, *_ in got["a"]] == ["Out Lap", "In Lap"]
    assert [name for _, name, *_ in got["b"]] == ["Out Lap", "In Lap"]
    assert [name for _, name, *_ in got["c"]] == ["Lap 1"]


def test_stopped_channel_has_no_laps(make):
    assert laps.detect_from_timer(as_series(make, {"a": (0, [3, 4, 0, 1])})).count() == 0
    assert laps.detect_from_number(as_series(make, {"a": (0, [3, 4, 0, 1])})).count() == 0


INTERVALS = [
    ("s", 0, "Out Lap", 0.0, 3.35),
    ("s", 1, "Lap 1", 3.35, 7.0),
    ("s", 2, "Lap 2", 7.0, 7.0),
    ("s", 3, "overlap", 2.0, 9.99),
    ("s", 4, "short", 5.01, 5.02),
    ("s", 5, "backwards", 8.0, 6.0),
    ("s", 6, "beyond", 11.0, 500.0),
    ("t", 0, "all", 0.0, 12.0),
]


def test_lap_membership(spark, make):
    series = {("s", "fast"): (10, range(120)), ("s", "slow"): (1, range(12)), ("t", "odd"): (7, range(80)),
              ("s", "stopped"): (0, [1.0]), ("u", "no laps"): (1, [1, 2])}
    table = spark.createDataFrame(INTERVALS, LAPS)
    rows = laps.assign_laps(make(series), table).select("session_id", "channel", "sample_idx", "number").collect()
    expected = {
        (s, c, i, number)
        for (s, c), (f, x) in series.items()
        for session, number, _, start, end in INTERVALS
        if session == s
        for i in members(len(x), f, start, end)
    }
    assert len(rows) == len(expected) and set(map(tuple, rows)) == expected


def test_laps_without_samples_are_kept_on_request(spark, make):
    table = spark.createDataFrame(INTERVALS, LAPS)
    kept = laps.assign_laps(make({("s", "fast"): (10, range(80))}), table, keep_empty=True)
    assert {(r.session_id, r.number) for r in kept.select("session_id", "number").distinct().collect()} == {
        (s, n) for s, n, *_ in INTERVALS
    }


def test_report(spark, make):
    table = spark.createDataFrame(INTERVALS, LAPS)
    x = [1.0, NAN, 3.0, INF, 5.0, 6.0]
    rows = stats.lap_report(make({("s", "c"): (1, x), ("v", "empty"): (1, [NAN, NAN])}), table).collect()
    by_lap = {(r.session_id, r.lap): (r.min_value, r.max_value, r.avg_value) for r in rows}
    assert by_lap["s", "All"] == (1.0, 6.0, 3.75)
    assert by_lap["s", "Out Lap"] == (1.0, 3.0, 2.0)
    assert by_lap["s", "Lap 1"] == (5.0, 6.0, 5.5)
    assert by_lap["v", "All"] == (0.0, 0.0, 0.0)
    assert ("s", "Lap 2") not in by_lap and ("s", "beyond") not in by_lap


def test_lap_list(spark):
    table = spark.createDataFrame([("s", 1, "Lap 1", 10.0, 138.392)], LAPS)
    row = laps.lap_list(table).first()
    assert row.duration_text == "2:08.392"


def test_lap_channel_is_found_by_name(spark, make):
    samples = make({("s", "Lap.Number"): (1, [1, 2]), ("s", "lap_number"): (1, [5, 6]), ("s", "Speed"): (1, [0, 0])})
    catalog = spark.createDataFrame(
        [("s", 0, "Speed"), ("s", 1, "lap_number"), ("s", 2, "Lap.Number")],
        "session_id string, channel_index int, channel string",
    )
    got = laps.lap_channel(samples, laps.NUMBER_NAMES, catalog).orderBy("sample_idx").collect()
    assert [r.value for r in got] == [5.0, 6.0]


def test_dense_index(spark):
    rng = random.Random(1)
    rows = [("a" if rng.random() < 0.7 else "b", v) for v in rng.sample(range(1000), 300)]
    got = dense_index(spark.createDataFrame(rows, "k string, v long"), ["k"], "v", "i", span=64).collect()
    for key in "ab":
        values = sorted(v for k, v in rows if k == key)
        assert {r.v: r.i for r in got if r.k == key} == {v: i for i, v in enumerate(values)}


def test_explode_span(spark):
    df = spark.createDataFrame([("a", 0, 0), ("b", 3, 40), ("c", 5, 4)], "k string, lo long, hi long")
    got = explode_span(df, F.col("lo"), F.col("hi"), "i", ["k"], piece=8).select("k", "i").collect()
    assert sorted(map(tuple, got)) == [("a", 0)] + [("b", i) for i in range(3, 41)]


def test_spread_join(spark):
    big = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1)], "k string, i long")
    small = spark.createDataFrame([("a", "x"), ("c", "y")], "k string, v string")
    inner = spread_join(big, small, ["k"], "i", chunk_rows=8)
    assert inner.count() == 50 and {r.v for r in inner.collect()} == {"x"}
    left = spread_join(big, small, ["k"], "i", "left", chunk_rows=8)
    assert left.count() == 51 and left.filter("v IS NULL").count() == 1
