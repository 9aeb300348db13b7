"""The scalar functions as session SQL functions, for computed channels written as Spark SQL text."""

from __future__ import annotations

from pyspark.sql import SparkSession

PREFIX = "t_"

_NAN = "DOUBLE('NaN')"
_INF = "DOUBLE('Infinity')"


def _known(x: str) -> str:
    return f"nanvl({x}, CAST(NULL AS DOUBLE))"


def _compare(op: str, missing: str = "FALSE") -> str:
    return f"IF(COALESCE({_known('a')} {op} {_known('b')}, {missing}), 1D, 0D)"


def _truthy(x: str) -> str:
    return f"COALESCE({_known(x)} <> 0D, FALSE)"


# name -> (parameters, body); bodies are inlined by the optimizer and stay inside generated code
BODIES = {
    "div": ("a b", f"COALESCE(try_divide(a, b), {_NAN})"),
    "mod": ("a b", f"COALESCE(try_mod(a, b), {_NAN})"),
    "gt": ("a b", _compare(">")),
    "lt": ("a b", _compare("<")),
    "gte": ("a b", _compare(">=")),
    "lte": ("a b", _compare("<=")),
    "eq": ("a b", _compare("=")),
    "neq": ("a b", _compare("<>", "TRUE")),
    "and": ("a b", f"IF({_truthy('a')} AND {_truthy('b')}, 1D, 0D)"),
    "or": ("a b", f"IF({_truthy('a')} OR {_truthy('b')}, 1D, 0D)"),
    "not": ("a", f"IF(COALESCE({_known('a')} = 0D, FALSE), 1D, 0D)"),
    "abs": ("a", "abs(a)"),
    "sqrt": ("a", "sqrt(a)"),
    "sin": ("a", "sin(a)"),
    "cos": ("a", "cos(a)"),
    "tan": ("a", "tan(a)"),
    "asin": ("a", "asin(a)"),
    "acos": ("a", "acos(a)"),
    "atan": ("a", "atan(a)"),
    "log": ("a", f"COALESCE(ln(a), IF(a = 0D, -{_INF}, {_NAN}))"),
    "ln": ("a", f"COALESCE(ln(a), IF(a = 0D, -{_INF}, {_NAN}))"),
    "exp": ("a", "exp(a)"),
    "floor": ("a", "IF(abs(a) >= 9007199254740992D, a, CAST(floor(a) AS DOUBLE))"),
    "ceil": ("a", "IF(abs(a) >= 9007199254740992D, a, CAST(ceil(a) AS DOUBLE))"),
    "round": ("a", "round(a)"),
    "atan2": ("a b", "atan2(a, b)"),
    "pow": ("a b", f"IF(a = 1D OR (a = -1D AND abs(b) = {_INF}), 1D, power(a, b))"),
    "min": ("a b", f"COALESCE(least({_known('a')}, {_known('b')}), {_NAN})"),
    "max": ("a b", f"COALESCE(greatest({_known('a')}, {_known('b')}), {_NAN})"),
    "clamp": (
        "v lo hi",
        f"IF(COALESCE({_known('lo')} <= {_known('hi')}, FALSE), "
        "IF(isnan(v), v, greatest(lo, least(v, hi))), "
        "CAST(raise_error('clamp bounds out of order') AS DOUBLE))",
    ),
    "gate": ("d c", f"IF(c <> 0D, d, {_NAN})"),
    "if_then": ("c a b", "IF(c <> 0D, a, b)"),
    "kmh_to_mph": ("a", "a * 0.621371D"),
    "mph_to_kmh": ("a", "a * 1.60934D"),
    "c_to_f": ("a", "a * 9D / 5D + 32D"),
    "f_to_c": ("a", "(a - 32D) * 5D / 9D"),
    "kpa_to_psi": ("a", "a * 0.145038D"),
    "psi_to_kpa": ("a", "a * 6.89476D"),
    "bar_to_psi": ("a", "a * 14.5038D"),
    "psi_to_bar": ("a", "a / 14.5038D"),
    "deg_to_rad": ("a", "radians(a)"),
    "rad_to_deg": ("a", "degrees(a)"),
    "kg_to_lb": ("a", "a * 2.20462D"),
    "lb_to_kg": ("a", "a * 0.453592D"),
    "m_to_ft": ("a", "a * 3.28084D"),
    "ft_to_m": ("a", "a * 0.3048D"),
    "nm_to_lbft": ("a", "a * 0.737562D"),
    "lbft_to_nm": ("a", "a * 1.35582D"),
}


def register_functions(spark: SparkSession, prefix: str = PREFIX) -> list[str]:
    """Create the temporary functions ``t_div``, ``t_max``, ... and return their names.

    The prefix keeps them apart from the aggregates ``min``/``max`` and from operators SQL cannot overload.
    """
    for name, (parameters, body) in BODIES.items():
        typed = ", ".join(f"{p} DOUBLE" for p in parameters.split())
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({typed}) RETURNS DOUBLE RETURN {body}"
        )
    return [prefix + name for name in BODIES]
