"""Scalar functions of computed channels as Column expressions.

All arguments and results are DOUBLE and a missing sample is NaN. Spark orders NaN above everything, equal to
itself, and raises on ``x % 0``; here comparisons with NaN are false and division by zero is NaN. The
expressions mention each argument as few times as possible, so nested calls stay small, and are built only from
functions with whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Arg = Column | float | int | str

# fixed values: conversion factors
KMH_TO_MPH = 0.621371
MPH_TO_KMH = 1.60934
KPA_TO_PSI = 0.145038
PSI_TO_KPA = 6.89476
BAR_TO_PSI = 14.5038
KG_TO_LB = 2.20462
LB_TO_KG = 0.453592
M_TO_FT = 3.28084
FT_TO_M = 0.3048
NM_TO_LBFT = 0.737562
LBFT_TO_NM = 1.35582

EXACT_INTEGERS = float(2**53)


def nan() -> Column:
    return F.lit(float("nan"))


def arg(x: Arg) -> Column:
    """Column of doubles for a column, a column name or a number."""
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(float(x))


def _known(x: Arg) -> Column:
    """NULL in place of NaN, so that NULL logic carries 'not comparable'."""
    return F.nanvl(arg(x), F.lit(None).cast("double"))


def _flag(condition: Column) -> Column:
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def is_finite(x: Arg) -> Column:
    x = arg(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def truthy(x: Arg) -> Column:
    """Non-zero and not NaN."""
    return F.coalesce(_known(x) != 0.0, F.lit(False))


# arithmetic


def neg(a: Arg) -> Column:
    return -arg(a)


def add(a: Arg, b: Arg) -> Column:
    return arg(a) + arg(b)


def sub(a: Arg, b: Arg) -> Column:
    return arg(a) - arg(b)


def mul(a: Arg, b: Arg) -> Column:
    return arg(a) * arg(b)


def div(a: Arg, b: Arg) -> Column:
    return F.coalesce(F.try_divide(arg(a), arg(b)), nan())


def mod(a: Arg, b: Arg) -> Column:
    return F.coalesce(F.try_mod(arg(a), arg(b)), nan())


# comparison and logic


def gt(a: Arg, b: Arg) -> Column:
    return _flag(_known(a) > _known(b))


def lt(a: Arg, b: Arg) -> Column:
    return _flag(_known(a) < _known(b))


def gte(a: Arg, b: Arg) -> Column:
    return _flag(_known(a) >= _known(b))


def lte(a: Arg, b: Arg) -> Column:
    return _flag(_known(a) <= _known(b))


def eq(a: Arg, b: Arg) -> Column:
    return _flag(_known(a) == _known(b))


def neq(a: Arg, b: Arg) -> Column:
    return _flag(F.coalesce(_known(a) != _known(b), F.lit(True)))


def and_(a: Arg, b: Arg) -> Column:
    return _flag(truthy(a) & truthy(b))


def or_(a: Arg, b: Arg) -> Column:
    return _flag(truthy(a) | truthy(b))


def not_(a: Arg) -> Column:
    return eq(a, 0.0)


# elementary functions


def abs_(a: Arg) -> Column:
    return F.abs(arg(a))


def sqrt(a: Arg) -> Column:
    return F.sqrt(arg(a))


def sin(a: Arg) -> Column:
    return F.sin(arg(a))


def cos(a: Arg) -> Column:
    return F.cos(arg(a))


def tan(a: Arg) -> Column:
    return F.tan(arg(a))


def asin(a: Arg) -> Column:
    return F.asin(arg(a))


def acos(a: Arg) -> Column:
    return F.acos(arg(a))


def atan(a: Arg) -> Column:
    return F.atan(arg(a))


def log(a: Arg) -> Column:
    """Natural logarithm; 0 gives -inf and negative numbers NaN."""
    a = arg(a)
    return F.coalesce(F.ln(a), F.when(a == 0.0, F.lit(float("-inf"))).otherwise(nan()))


ln = log


def exp(a: Arg) -> Column:
    return F.exp(arg(a))


def _keep_integral(a: Column, rounded: Column) -> Column:
    """Doubles of 2**53 and more are integers already and may not fit BIGINT; NaN stays."""
    return F.when(F.abs(a) >= EXACT_INTEGERS, a).otherwise(rounded.cast("double"))


def floor(a: Arg) -> Column:
    a = arg(a)
    return _keep_integral(a, F.floor(a))


def ceil(a: Arg) -> Column:
    a = arg(a)
    return _keep_integral(a, F.ceil(a))


def round_(a: Arg) -> Column:
    """Half away from zero."""
    return F.round(arg(a))


def atan2(y: Arg, x: Arg) -> Column:
    return F.atan2(arg(y), arg(x))


def pow_(a: Arg, b: Arg) -> Column:
    """IEEE power: 1 to any power and -1 to an infinite power are 1."""
    power = F.pow(arg(a), arg(b))
    if isinstance(b, (int, float)) and abs(b) < float("inf"):
        return power
    a, b = arg(a), arg(b)
    one = (a == 1.0) | ((a == -1.0) & (F.abs(b) == float("inf")))
    return F.when(one, F.lit(1.0)).otherwise(power)


def min_(a: Arg, b: Arg) -> Column:
    """Smaller value, ignoring NaN."""
    return F.coalesce(F.least(_known(a), _known(b)), nan())


def max_(a: Arg, b: Arg) -> Column:
    """Larger value, ignoring NaN."""
    return F.coalesce(F.greatest(_known(a), _known(b)), nan())


def clamp(v: Arg, lo: Arg, hi: Arg) -> Column:
    """Value held within bounds; NaN stays, bounds out of order are an error."""
    number = (int, float)
    if isinstance(lo, number) and isinstance(hi, number):
        if not lo <= hi:
            raise ValueError(f"clamp bounds out of order: {lo}, {hi}")
        valid = None
    else:
        valid = _known(lo) <= _known(hi)
    v = arg(v)
    held = F.when(F.isnan(v), v).otherwise(F.greatest(arg(lo), F.least(v, arg(hi))))
    if valid is None:
        return held
    return F.when(valid, held).otherwise(
        F.raise_error(F.lit("clamp bounds out of order")).cast("double")
    )


def gate(data: Arg, cond: Arg) -> Column:
    """Data where the condition is not 0, else NaN; a NaN condition passes."""
    return F.when(arg(cond) != 0.0, arg(data)).otherwise(nan())


def if_then(cond: Arg, a: Arg, b: Arg) -> Column:
    """First value where the condition is not 0, else the second; a NaN condition counts as true."""
    return F.when(arg(cond) != 0.0, arg(a)).otherwise(arg(b))


# unit conversions


def kmh_to_mph(a: Arg) -> Column:
    return arg(a) * KMH_TO_MPH


def mph_to_kmh(a: Arg) -> Column:
    return arg(a) * MPH_TO_KMH


def c_to_f(a: Arg) -> Column:
    return arg(a) * 9.0 / 5.0 + 32.0


def f_to_c(a: Arg) -> Column:
    return (arg(a) - 32.0) * 5.0 / 9.0


def kpa_to_psi(a: Arg) -> Column:
    return arg(a) * KPA_TO_PSI


def psi_to_kpa(a: Arg) -> Column:
    return arg(a) * PSI_TO_KPA


def bar_to_psi(a: Arg) -> Column:
    return arg(a) * BAR_TO_PSI


def psi_to_bar(a: Arg) -> Column:
    return arg(a) / BAR_TO_PSI


def deg_to_rad(a: Arg) -> Column:
    return F.radians(arg(a))


def rad_to_deg(a: Arg) -> Column:
    return F.degrees(arg(a))


def kg_to_lb(a: Arg) -> Column:
    return arg(a) * KG_TO_LB


def lb_to_kg(a: Arg) -> Column:
    return arg(a) * LB_TO_KG


def m_to_ft(a: Arg) -> Column:
    return arg(a) * M_TO_FT


def ft_to_m(a: Arg) -> Column:
    return arg(a) * FT_TO_M


def nm_to_lbft(a: Arg) -> Column:
    return arg(a) * NM_TO_LBFT


def lbft_to_nm(a: Arg) -> Column:
    return arg(a) * LBFT_TO_NM


# name -> (function, number of arguments): what a computed channel may call
FUNCTIONS = {
    "abs": (abs_, 1),
    "sqrt": (sqrt, 1),
    "sin": (sin, 1),
    "cos": (cos, 1),
    "tan": (tan, 1),
    "asin": (asin, 1),
    "acos": (acos, 1),
    "atan": (atan, 1),
    "log": (log, 1),
    "ln": (ln, 1),
    "exp": (exp, 1),
    "floor": (floor, 1),
    "ceil": (ceil, 1),
    "round": (round_, 1),
    "atan2": (atan2, 2),
    "pow": (pow_, 2),
    "min": (min_, 2),
    "max": (max_, 2),
    "clamp": (clamp, 3),
    "gate": (gate, 2),
    "if_then": (if_then, 3),
    "kmh_to_mph": (kmh_to_mph, 1),
    "mph_to_kmh": (mph_to_kmh, 1),
    "c_to_f": (c_to_f, 1),
    "f_to_c": (f_to_c, 1),
    "kpa_to_psi": (kpa_to_psi, 1),
    "psi_to_kpa": (psi_to_kpa, 1),
    "bar_to_psi": (bar_to_psi, 1),
    "psi_to_bar": (psi_to_bar, 1),
    "deg_to_rad": (deg_to_rad, 1),
    "rad_to_deg": (rad_to_deg, 1),
    "kg_to_lb": (kg_to_lb, 1),
    "lb_to_kg": (lb_to_kg, 1),
    "m_to_ft": (m_to_ft, 1),
    "ft_to_m": (ft_to_m, 1),
    "nm_to_lbft": (nm_to_lbft, 1),
    "lbft_to_nm": (lbft_to_nm, 1),
}

# operators that a Spark SQL expression cannot overload, by function name
OPERATORS = {
    "div": (div, 2),
    "mod": (mod, 2),
    "gt": (gt, 2),
    "lt": (lt, 2),
    "gte": (gte, 2),
    "lte": (lte, 2),
    "eq": (eq, 2),
    "neq": (neq, 2),
    "and": (and_, 2),
    "or": (or_, 2),
    "not": (not_, 1),
}


# display formats


def format_duration(secs: Arg) -> Column:
    """``M:SS.mmm``, or ``S.mmm`` under a minute."""
    secs = arg(secs)
    minutes = F.floor(F.greatest(secs, F.lit(0.0)) / 60.0)
    rest = secs - minutes * 60.0
    text = fixed_text(rest, 3)
    return F.when(
        minutes > 0, F.concat(minutes.cast("string"), F.lit(":"), F.lpad(text, 6, "0"))
    ).otherwise(text)


def format_value(v: Arg) -> Column:
    """Twelve characters: four decimals, scientific for small non-zero values, blank for none."""
    v = arg(v)
    small = (F.abs(v) < 0.01) & (v != 0.0)
    return (
        F.when(v.isNull(), F.lit(" " * 12))
        .when(small, _exponent_text(v))
        .otherwise(F.format_string("%12.4f", v))
    )


def _exponent_text(v: Column) -> Column:
    """Exponent without sign padding: ``1.5000e-3``."""
    text = F.format_string("%.4e", v)
    return F.lpad(F.regexp_replace(text, r"e([+-])0*(\d+)$", "e$1$2"), 12, " ")


def _let(value: Column, body) -> Column:
    """``body`` applied to a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def fixed_text(v: Arg, decimals: int | Column) -> Column:
    """Decimal text of a double, rounded half to even on its exact binary value.

    ``format_string`` rounds the shortest decimal form half up. Here the whole part, which is exact, is split off, and the
    rounding error of ``fraction * 10^d`` is recovered with a split product, so the comparison with one half is exact for
    up to 15 decimals. The whole part is exact below 1e38.
    """
    return _let(arg(v), lambda x: _fixed_text(x, decimals))


def _fixed_text(v: Column, decimals: int | Column) -> Column:
    if isinstance(decimals, Column):
        d = F.greatest(decimals.cast("int"), F.lit(0))
        ten = F.round(F.pow(F.lit(10.0), d.cast("double")))
    else:
        d = F.lit(max(decimals, 0))
        ten = F.lit(float(10 ** max(decimals, 0)))
    size = F.abs(v)
    half_bits = F.lit(134217729.0)  # 2^27 + 1 splits a double into two halves

    def high(x: Column) -> Column:
        return half_bits * x - (half_bits * x - x)

    def rounded_text(parts: Column) -> Column:
        whole, fraction = parts["whole"], parts["fraction"]
        product = fraction * ten
        fh, th = high(fraction), high(ten)
        fl, tl = fraction - fh, ten - th
        error = ((fh * th - product) + fh * tl + fl * th) + fl * tl
        digits = F.floor(product)
        excess = (product - digits.cast("double") - 0.5) + error
        # without decimals the digit before the point decides a tie
        odd = F.when(d == 0, whole % 2 == 1).otherwise(digits % 2 == 1)
        rounded = digits + F.when((excess > 0) | ((excess == 0) & odd), 1).otherwise(0)
        carry = rounded >= ten
        rest = F.when(carry, F.lit(0)).otherwise(rounded)
        tail = F.when(d == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.lpad(rest.cast("string"), d, "0")))
        return F.concat(_whole_text(whole, carry), tail)

    parts = F.struct(_whole(size).alias("whole"), (size - _whole(size)).alias("fraction"))
    sign = F.when(v.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit(""))
    return (
        F.when(F.isnan(v), F.lit("NaN"))
        .when(v == float("inf"), F.lit("inf"))
        .when(v == float("-inf"), F.lit("-inf"))
        .otherwise(F.concat(sign, _let(parts, rounded_text)))
    )


def _whole(size: Column) -> Column:
    """Whole part of a double that is not negative; from 2^53 on every double is whole."""
    return F.when(size < float(2**53), F.floor(size).cast("double")).otherwise(size)


def _whole_text(whole: Column, carry: Column) -> Column:
    """Digits of a whole double, one more with ``carry``; a cast to DECIMAL would take its shortest decimal form."""
    unit = float(2**62)
    upper = F.floor(whole / unit)
    lower = (whole - upper.cast("double") * unit).cast("bigint").cast("decimal(19,0)")
    wide = upper.cast("decimal(19,0)") * F.lit(2**62).cast("decimal(19,0)") + lower
    return F.when(whole < unit, (whole.cast("bigint") + carry.cast("bigint")).cast("string")).otherwise(wide.cast("string"))


# colour


def hsv_to_rgb(hue: Arg, saturation: Arg = 1.0, value: Arg = 1.0) -> Column:
    """``STRUCT<r INT, g INT, b INT>`` of 0..255; hue in [0, 360). Single precision, truncated to bytes."""

    def single(c: Column) -> Column:
        return c.cast("float")

    h, s, v = (single(arg(x)) for x in (hue, saturation, value))
    sextant = single(h / F.lit(60.0))
    chroma = single(v * s)
    offset = single(v - chroma)
    turn = single(F.abs(single(sextant % F.lit(2.0)) - 1.0))
    mid = single(chroma * single(F.lit(1.0) - turn))
    zero = single(F.lit(0.0))
    # what each component is in the six sextants of the colour circle
    sextants = {
        "r": [chroma, mid, zero, zero, mid, chroma],
        "g": [mid, chroma, chroma, mid, zero, zero],
        "b": [zero, zero, mid, chroma, chroma, mid],
    }

    def component(levels: list[Column]) -> Column:
        level = F.when(sextant < 1, levels[0])
        for k in range(1, 5):
            level = level.when(sextant < k + 1, levels[k])
        level = level.otherwise(levels[5])
        return single(single(level + offset) * F.lit(255.0)).cast("int")

    return F.struct(*(component(levels).alias(name) for name, levels in sextants.items()))
