"""Stored definitions as text, e.g. ``(WheelSpeed_FL - GPS_Speed) / max(GPS_Speed, 1) * 100``.

The notation differs from a Python expression only in its logical operators and in how channels are written, so
the text is rewritten lightly and read with the standard ``ast`` module into the :class:`Ch` builder.
"""

from __future__ import annotations

import ast
import operator
import re
from functools import reduce

from apexgrid.functions import scalar
from apexgrid.functions.channel import SERIES_FUNCTIONS, Ch, call, ch, fn

_TOKEN = re.compile(
    r'"(?P<quoted>[^"]*)"'
    r"|(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
    r"|(?P<name>[A-Za-z_][A-Za-z0-9_.]*)(?P<call>\s*\()?"
    r"|(?P<op>&&|\|\||!=|!|==|>=|<=|[-+*/%<>(),]|\s+)"
)
_REWRITTEN = {"&&": " and ", "||": " or ", "!": "~"}

_BINARY = {
    ast.Add: operator.add,
    ast.Sub: operator.sub,
    ast.Mult: operator.mul,
    ast.Div: operator.truediv,
    ast.Mod: operator.mod,
}
_COMPARE = {
    ast.Gt: operator.gt,
    ast.Lt: operator.lt,
    ast.GtE: operator.ge,
    ast.LtE: operator.le,
    ast.Eq: operator.eq,
    ast.NotEq: operator.ne,
}


def from_text(expression: str) -> Ch:
    """Computed channel for an expression text; ``ValueError`` says what is wrong with it."""
    if not expression.strip():
        raise ValueError("the expression is blank")
    text, channels = _python_text(expression)
    if re.search(r",\s*\)", text):
        raise ValueError("an argument is missing behind the last comma")
    try:
        tree = ast.parse(text.strip(), mode="eval")
    except SyntaxError as error:
        raise ValueError(f"not a valid expression ({error.msg})") from error
    return _build(tree.body, channels)


def _python_text(expression: str) -> tuple[str, list[str]]:
    """The text with channel names replaced by ``_0``, ``_1``, ..., and those names."""
    parts, channels, at = [], [], 0
    while at < len(expression):
        token = _TOKEN.match(expression, at)
        if token is None:
            raise ValueError(f"'{expression[at]}' has no meaning in an expression")
        at = token.end()
        name = token["name"]
        if name is not None and token["call"] and name.lower() in {*SERIES_FUNCTIONS, *scalar.FUNCTIONS}:
            parts.append(f"{name.lower()}(")
        elif name is not None or token["quoted"] is not None:
            parts.append(f" _{len(channels)} " + (token["call"] or ""))
            channels.append(name if name is not None else token["quoted"])
        else:
            parts.append(_plain(token))
    return "".join(parts), channels


def _plain(token: re.Match) -> str:
    """Numbers as Python writes them (``007`` is none of its forms), any white space as one blank."""
    if token["number"] is not None:
        return repr(float(token["number"]))
    return " " if token[0].isspace() else _REWRITTEN.get(token[0], token[0])


def _build(node: ast.expr, channels: list[str]) -> Ch:
    def build(inner: ast.expr) -> Ch:
        return _build(inner, channels)

    def argument(inner: ast.expr) -> Ch | float:
        """Plain numbers stay numbers: a moving average needs its width when the plan is made."""
        return float(inner.value) if isinstance(inner, ast.Constant) else build(inner)

    match node:
        case ast.Name(id=name) if name[0] == "_":
            return ch(channels[int(name[1:])])
        case ast.Constant(value=int() | float() as number):
            return Ch(scalar.arg(number))
        case ast.UnaryOp(op=ast.USub(), operand=inner):
            return -build(inner)
        case ast.UnaryOp(op=ast.Invert(), operand=inner):
            return ~build(inner)
        case ast.BinOp(left=left, op=op, right=right) if type(op) in _BINARY:
            return _BINARY[type(op)](build(left), build(right))
        case ast.Compare(left=left, ops=[op], comparators=[right]) if type(op) in _COMPARE:
            return _COMPARE[type(op)](build(left), build(right))
        case ast.BoolOp(op=op, values=values):
            both = scalar.and_ if isinstance(op, ast.And) else scalar.or_
            return reduce(lambda a, b: call(both, a, b), map(build, values))
        case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name[0] != "_":
            return fn(name, *map(argument, args))
    raise ValueError("the expression has a part without meaning")
