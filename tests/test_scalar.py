import math

import pytest
from helpers import INF, NAN, assert_same, same

from apexgrid.functions import scalar
from apexgrid.functions.sql import BODIES, register_functions

GRID = [NAN, INF, -INF, 0.0, 1.0, -1.0, 0.5, -2.5, 7.25, 1e300]


def _trig(f, v):
    return f(v) if math.isfinite(v) else NAN


def _log(v):
    return v if math.isnan(v) or v == INF else NAN if v < 0 else -INF if v == 0 else math.log(v)


def _pow(a, b):
    try:
        return math.pow(a, b)
    except ValueError:
        return INF if a == 0 else NAN
    except OverflowError:
        return -INF if a < 0 and b % 2 == 1 else INF


def _round(v):
    return v if not math.isfinite(v) else math.copysign(math.floor(abs(v) + 0.5), v)


def _whole(f):
    return lambda v: float(f(v)) if math.isfinite(v) else v


def _exp(v):
    try:
        return math.exp(v)
    except OverflowError:
        return INF


def _true(v):
    return not math.isnan(v) and v != 0


UNARY = {
    "abs": abs,
    "sqrt": lambda v: v if math.isnan(v) else math.sqrt(v) if v >= 0 else NAN,
    "sin": lambda v: _trig(math.sin, v),
    "cos": lambda v: _trig(math.cos, v),
    "tan": lambda v: _trig(math.tan, v),
    "asin": lambda v: math.asin(v) if abs(v) <= 1 else NAN,
    "acos": lambda v: math.acos(v) if abs(v) <= 1 else NAN,
    "atan": math.atan,
    "log": _log,
    "ln": _log,
    "exp": _exp,
    "floor": _whole(math.floor),
    "ceil": _whole(math.ceil),
    "round": _round,
    "not": lambda v: float(v == 0),
    "c_to_f": lambda v: v * 9.0 / 5.0 + 32.0,
    "f_to_c": lambda v: (v - 32.0) * 5.0 / 9.0,
    "psi_to_bar": lambda v: v / 14.5038,
    "bar_to_psi": lambda v: v * 14.5038,
    "deg_to_rad": math.radians,
    "rad_to_deg": math.degrees,
}
BINARY = {
    "div": lambda a, b: NAN if b == 0 else a / b,
    "mod": lambda a, b: NAN if b == 0 or math.isnan(a) or math.isinf(a) or math.isnan(b) else math.fmod(a, b),
    "gt": lambda a, b: float(a > b),
    "lt": lambda a, b: float(a < b),
    "gte": lambda a, b: float(a >= b),
    "lte": lambda a, b: float(a <= b),
    "eq": lambda a, b: float(a == b),
    "neq": lambda a, b: float(a != b),
    "and": lambda a, b: float(_true(a) and _true(b)),
    "or": lambda a, b: float(_true(a) or _true(b)),
    "atan2": math.atan2,
    "pow": _pow,
    "min": lambda a, b: b if math.isnan(a) else a if math.isnan(b) else min(a, b),
    "max": lambda a, b: b if math.isnan(a) else a if math.isnan(b) else max(a, b),
    "gate": lambda d, c: d if c != 0 else NAN,
}


@pytest.fixture(scope="module")
def grid(spark):
    return spark.createDataFrame([(a, b) for a in GRID for b in GRID], "a double, b double").coalesce(1)


def _function(name):
    return (scalar.FUNCTIONS | scalar.OPERATORS)[name][0]


def test_every_function_follows_ieee(spark, grid):
    register_functions(spark)
    columns = {f"c_{n}": _function(n)("a") for n in UNARY} | {f"c_{n}": _function(n)("a", "b") for n in BINARY}
    texts = [f"t_{n}(a) AS s_{n}" for n in UNARY] + [f"t_{n}(a, b) AS s_{n}" for n in BINARY]
    rows = grid.withColumns(columns).selectExpr("*", *texts).collect()
    for r in rows:
        for n, f in {**UNARY, **BINARY}.items():
            expected = f(r.a) if n in UNARY else f(r.a, r.b)
            for form in "cs":
                assert same(r[f"{form}_{n}"], expected, 1e-12), (form, n, r.a, r.b, r[f"{form}_{n}"], expected)


def test_python_and_sql_functions_are_the_same_set():
    assert set(BODIES) == set(scalar.FUNCTIONS) | set(scalar.OPERATORS)


def test_clamp(spark):
    df = spark.createDataFrame([(NAN,), (-5.0,), (5.0,), (INF,)], "v double")
    assert_same([r[0] for r in df.select(scalar.clamp("v", 0, 2)).collect()], [NAN, 0.0, 2.0, 2.0])
    with pytest.raises(ValueError):
        scalar.clamp("v", 2, 0)
    with pytest.raises(Exception, match="out of order"):
        df.select(scalar.clamp("v", scalar.arg(1.0), "v")).collect()


def test_if_then_and_missing_condition(spark):
    df = spark.createDataFrame([(0.0,), (2.0,), (NAN,)], "c double")
    assert [r[0] for r in df.select(scalar.if_then("c", 1, -1)).collect()] == [-1.0, 1.0, 1.0]


@pytest.mark.parametrize(
    "there,back", [("kmh_to_mph", "mph_to_kmh"), ("c_to_f", "f_to_c"), ("kpa_to_psi", "psi_to_kpa"),
                   ("bar_to_psi", "psi_to_bar"), ("deg_to_rad", "rad_to_deg"), ("kg_to_lb", "lb_to_kg"),
                   ("m_to_ft", "ft_to_m"), ("nm_to_lbft", "lbft_to_nm")]
)
def test_conversions_round_trip(spark, there, back):
    value = spark.range(1).select(_function(back)(_function(there)(scalar.arg(100.0)))).first()[0]
    assert abs(value - 100.0) < 0.01


def test_format_duration(spark):
    df = spark.createDataFrame([(128.392,), (59.9994,), (5.0,), (949.61,), (60.0,)], "s double")
    texts = [r[0] for r in df.select(scalar.format_duration("s")).collect()]
    assert texts == ["2:08.392", "59.999", "5.000", "15:49.610", "1:00.000"]


def test_format_value(spark):
    df = spark.createDataFrame([(None,), (0.0,), (1.5,), (0.0015,), (-123.45678,)], "v double")
    texts = [r[0] for r in df.select(scalar.format_value("v")).collect()]
    assert texts == [" " * 12, "      0.0000", "      1.5000", "   1.5000e-3", "   -123.4568"]


@pytest.mark.parametrize("decimals", [0, 1, 2, 3, 6])
def test_fixed_text_rounds_the_exact_value(spark, decimals):
    values = [0.0, -0.0, 0.125, 0.375, 2.5, 3.5, -2.5, 2.675, 1.005, 0.05, 0.15, 1e-9, 123456.789, -0.04, 1e17, 0.5]
    df = spark.createDataFrame([(v, decimals) for v in values], "v double, d int").coalesce(1)
    rows = df.select(
        scalar.fixed_text("v", decimals).alias("fixed"), scalar.fixed_text("v", df.d).alias("by_column")
    ).collect()
    for v, r in zip(values, rows):
        assert r.fixed == r.by_column == f"{v:.{decimals}f}"


def test_fixed_text_specials(spark):
    df = spark.createDataFrame([(NAN,), (INF,), (-INF,)], "v double")
    assert [r[0] for r in df.select(scalar.fixed_text("v", 2)).collect()] == ["NaN", "inf", "-inf"]


def test_hsv(spark):
    df = spark.createDataFrame([(0.0,), (60.0,), (120.0,), (180.0,), (240.0,), (300.0,), (30.0,)], "h double")
    got = [tuple(r[0]) for r in df.select(scalar.hsv_to_rgb("h")).collect()]
    assert got == [(255, 0, 0), (255, 255, 0), (0, 255, 0), (0, 255, 255), (0, 0, 255), (255, 0, 255), (255, 127, 0)]
