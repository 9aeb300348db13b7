"""Builder for computed channels: ``Ch`` wraps a Column and knows which channels and series steps it needs.

``ch("GPS_Speed") / 3.6`` is an ordinary Column over an aligned frame. Series functions (``smooth``,
``derivative``, ``integrate``) depend on sample order, so they become *steps* that
:func:`apexgrid.operators.series.add_steps` adds to the frame as columns before the final projection.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from apexgrid.functions import scalar

_ids = itertools.count()
_STEP = re.compile(r"\b_step\d+\b")


@dataclass(frozen=True)
class Step:
    """One series function: ``output`` becomes ``kind`` of ``source``; ``level`` 0 needs no other step."""

    kind: str
    source: Column
    output: str
    window: int | Column | None = None
    level: int = 0


@dataclass(frozen=True, eq=False)
class Ch:
    """A computed channel. Operators follow the missing-sample rules of :mod:`apexgrid.functions.scalar`."""

    col: Column
    refs: tuple[str, ...] = ()
    steps: tuple[Step, ...] = field(default=())
    #: references that the Column reads under their own names, as SQL text does
    named: tuple[str, ...] = ()

    @property
    def level(self) -> int:
        return 1 + max((s.level for s in self.steps), default=-1)

    def __add__(self, other):
        return call(scalar.add, self, other)

    def __radd__(self, other):
        return call(scalar.add, other, self)

    def __sub__(self, other):
        return call(scalar.sub, self, other)

    def __rsub__(self, other):
        return call(scalar.sub, other, self)

    def __mul__(self, other):
        return call(scalar.mul, self, other)

    def __rmul__(self, other):
        return call(scalar.mul, other, self)

    def __truediv__(self, other):
        return call(scalar.div, self, other)

    def __rtruediv__(self, other):
        return call(scalar.div, other, self)

    def __mod__(self, other):
        return call(scalar.mod, self, other)

    def __rmod__(self, other):
        return call(scalar.mod, other, self)

    def __neg__(self):
        return call(scalar.neg, self)

    def __gt__(self, other):
        return call(scalar.gt, self, other)

    def __lt__(self, other):
        return call(scalar.lt, self, other)

    def __ge__(self, other):
        return call(scalar.gte, self, other)

    def __le__(self, other):
        return call(scalar.lte, self, other)

    def __eq__(self, other):
        return call(scalar.eq, self, other)

    def __ne__(self, other):
        return call(scalar.neq, self, other)

    def __and__(self, other):
        return call(scalar.and_, self, other)

    def __rand__(self, other):
        return call(scalar.and_, other, self)

    def __or__(self, other):
        return call(scalar.or_, self, other)

    def __ror__(self, other):
        return call(scalar.or_, other, self)

    def __invert__(self):
        return call(scalar.not_, self)

    __hash__ = None

    def __bool__(self):
        raise TypeError("use & | ~ on channels, not and/or/not")


def ref_column(name: str) -> str:
    """Name of the column that holds a referenced channel: no two names share it, whatever their letter case, and no other column has it."""
    return f"_ref_{name.encode().hex()}"


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def ch(name: str) -> Ch:
    """Reference to a channel by name or alias."""
    return Ch(F.col(ref_column(name)), (name,))


def sql(expression: str, refs: tuple[str, ...] | list[str]) -> Ch:
    """A Spark SQL expression over the named channels, e.g. using the functions of ``register_functions``."""
    return Ch(F.expr(expression), tuple(refs), named=tuple(refs))


def call(function, *args: Ch | float) -> Ch:
    """Apply a scalar function of Columns to channels and numbers."""
    channels = [a for a in args if isinstance(a, Ch)]
    columns = [a.col if isinstance(a, Ch) else a for a in args]
    return Ch(function(*columns), *(_merge(getattr(c, part) for c in channels) for part in ("refs", "steps", "named")))


def fn(name: str, *args: Ch | float) -> Ch:
    """Call a function of computed channels by its (case-insensitive) name."""
    key = name.lower()
    if key in SERIES_FUNCTIONS:
        arity = 2 if key == "smooth" else 1
        if len(args) != arity:
            raise ValueError(f"{key} takes {arity} argument(s), not {len(args)}")
        return SERIES_FUNCTIONS[key](*args)
    if key not in scalar.FUNCTIONS:
        raise ValueError(f"there is no function '{name}'")
    function, arity = scalar.FUNCTIONS[key]
    if len(args) != arity:
        raise ValueError(f"{key} takes {arity} argument(s), not {len(args)}")
    return call(function, *args)


def smooth(x: Ch, window: float | Ch) -> Ch:
    """Trailing moving average over ``window`` samples; a channel as window counts by its first sample."""
    if isinstance(window, Ch):
        return _step("smooth", x, window.col, window)
    return _step("smooth", x, max(int(window), 1))


def derivative(x: Ch) -> Ch:
    return _step("derivative", x)


def integrate(x: Ch) -> Ch:
    return _step("integrate", x)


SERIES_FUNCTIONS = {"smooth": smooth, "derivative": derivative, "integrate": integrate}


def _step(kind: str, x: Ch | float, window=None, other: Ch | None = None) -> Ch:
    x = x if isinstance(x, Ch) else Ch(scalar.arg(x))
    inputs = [x] if other is None else [x, other]
    before = _merge(c.steps for c in inputs)
    step = Step(kind, x.col, f"_step{next(_ids)}", window, max(c.level for c in inputs))
    return Ch(F.col(step.output), _merge(c.refs for c in inputs), (*before, step), _merge(c.named for c in inputs))


def shared_steps(steps: Sequence[Step]) -> tuple[list[Step], dict[str, str]]:
    """The steps without those that repeat another, and for each of these the output of the one it repeats."""
    first: dict[tuple, str] = {}
    same: dict[str, str] = {}
    kept = []

    def plain(c: Column | int | None) -> str:
        return _STEP.sub(lambda m: same.get(m[0], m[0]), str(c))

    for s in sorted({s.output: s for s in steps}.values(), key=lambda s: s.level):
        output = first.setdefault((s.kind, plain(s.source), plain(s.window)), s.output)
        if output == s.output:
            kept.append(s)
        else:
            same[s.output] = output
    return kept, same


def _merge(groups) -> tuple:
    """Concatenate, keeping first appearances."""
    seen = {}
    for item in itertools.chain.from_iterable(groups):
        seen.setdefault(item if isinstance(item, str) else item.output, item)
    return tuple(seen.values())
