import random

import pytest
from helpers import INF, NAN, area, assert_same, slope, trailing_mean
from pyspark.sql import functions as F

from apexgrid.functions import ch, derivative, integrate, smooth
from apexgrid.operators import series
from apexgrid.operators.computed import Definition, evaluate_wide

SPEED = [10, 20, 30, 40, 50]
CHUNK = 16


def noisy(n, seed, bad=()):
    rng = random.Random(seed)
    x = [round(rng.uniform(-50, 50), 2) for _ in range(n)]
    for i, v in bad:
        x[i] = v
    return x


SERIES = {
    ("a", "plain"): (10, noisy(100, 1)),
    ("a", "one"): (5, [3.0]),
    ("a", "two"): (5, [3.0, 5.0]),
    ("b", "gap"): (20, noisy(90, 2, [(40, NAN)])),
    ("b", "inf"): (20, noisy(90, 3, [(21, INF)])),
    ("b", "both"): (4, noisy(64, 4, [(10, INF), (12, -INF), (50, NAN)])),
    ("c", "edge"): (2, noisy(CHUNK * 3, 5)),
}


def test_known_vectors(make, read):
    df = make({("s", "Speed"): (1, SPEED)})
    for op, expected in [
        (lambda d: series.derivative(d, out="r"), [10] * 5),
        (lambda d: series.smooth(d, 3, out="r"), [10, 15, 20, 30, 40]),
        (lambda d: series.integrate(d, out="r"), [0, 15, 40, 75, 120]),
    ]:
        assert_same(read(op(df), ["session_id"], "sample_idx", "r")["s"], expected)


@pytest.mark.parametrize("window", [1, 3, 15, 16, 17, 30, 200])
def test_smooth_is_a_running_mean(make, read, window):
    got = read(
        series.smooth(make(SERIES), window, out="r", chunk_rows=CHUNK), ["session_id", "channel"], "sample_idx", "r"
    )
    for key, (_, x) in SERIES.items():
        assert_same(got[key], trailing_mean(x, window), 1e-8)


@pytest.mark.parametrize("window", [1, 3, 15, 16, 17, 30, 200])
def test_smooth_of_a_slice(make, read, window):
    """A series that does not start at index 0, as a time window gives."""
    sliced = make(SERIES).filter("sample_idx >= 21")
    got = read(series.smooth(sliced, window, out="r", chunk_rows=CHUNK), ["session_id", "channel"], "sample_idx", "r")
    for key, (_, x) in SERIES.items():
        if len(x) > 21:
            assert_same(got[key], trailing_mean(x[21:], window), 1e-8)


@pytest.mark.parametrize("window", [5, 40])
def test_smooth_after_large_values(make, read, window):
    """Values that have left the window leave nothing behind, whatever chunks they were in."""
    x = [1e15 + k for k in range(45)] + noisy(115, 8)
    for rows in (16, 64, 1000):
        got = read(series.smooth(make({("s", "v"): (1, x)}), window, out="r", chunk_rows=rows), ["session_id"], "sample_idx", "r")["s"]
        for i in range(45 + window, 160):
            assert abs(got[i] - sum(x[i - window + 1 : i + 1]) / window) < 1e-12


@pytest.mark.parametrize("op,loop", [(series.derivative, slope), (series.integrate, area)])
def test_derivative_and_integral(make, read, op, loop):
    got = read(op(make(SERIES), out="r", chunk_rows=CHUNK), ["session_id", "channel"], "sample_idx", "r")
    for key, (f, x) in SERIES.items():
        assert_same(got[key], loop(x, f))


def test_nested_steps_and_shared_levels(make, read):
    x = noisy(70, 6)
    frame = make({("s", "v"): (10, x)}).select("session_id", "freq", "sample_idx", F.col("value").alias("v"))
    base = smooth(ch("v"), 5)
    defs = [
        Definition("nested", derivative(base) + integrate(ch("v"))),
        Definition("base", base),
        Definition("again", ch("nested") * 2),
    ]
    out = evaluate_wide(frame, defs, chunk_rows=CHUNK)
    expected = [a + b for a, b in zip(slope(trailing_mean(x, 5), 10), area(x, 10))]
    assert_same(read(out, ["session_id"], "sample_idx", "nested")["s"], expected)
    assert_same(read(out, ["session_id"], "sample_idx", "again")["s"], [2 * v for v in expected])
    assert set(out.columns) == {"session_id", "freq", "sample_idx", "v", "nested", "base", "again"}


def test_window_from_first_sample(make, read):
    x = noisy(50, 7)
    frame = make({("s", "v"): (10, x), ("t", "v"): (10, x)}).select(
        "session_id", "freq", "sample_idx", F.col("value").alias("v"),
        (F.when(F.col("session_id") == "s", 4.9).otherwise(-3.0) + F.col("sample_idx")).alias("w"),
    )
    out = read(
        evaluate_wide(frame, [Definition("m", smooth(ch("v"), ch("w")))], chunk_rows=CHUNK),
        ["session_id"], "sample_idx", "m",
    )
    assert_same(out["s"], trailing_mean(x, 4))
    assert_same(out["t"], x)


def test_forward_fill(make, read):
    x = [NAN, NAN, 1.0, NAN, 2.0, *[NAN] * 40, 3.0, NAN]
    out = series.forward_fill(
        make({("s", "v"): (1, x), ("t", "v"): (1, [NAN] * 20)}), ~F.isnan("value"), ["value"],
        ["session_id", "channel"], chunk_rows=8,
    )
    got = read(out, ["session_id"], "sample_idx")
    assert got["s"] == [0.0, 0.0, 1.0, 1.0, *[2.0] * 41, 3.0, 3.0]
    assert got["t"] == [0.0] * 20
