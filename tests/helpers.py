"""Literal loop versions of the operators, and comparison of doubles."""

import math

NAN, INF = float("nan"), float("inf")


def same(a, b, tolerance=1e-9):
    if a is None or b is None:
        return a is None and b is None
    if math.isnan(a) or math.isnan(b):
        return math.isnan(a) and math.isnan(b)
    if math.isinf(a) or math.isinf(b):
        return a == b
    return abs(a - b) <= tolerance * max(1.0, abs(a), abs(b))


def assert_same(got, expected, tolerance=1e-9):
    assert len(got) == len(expected), (len(got), len(expected))
    for i, (g, e) in enumerate(zip(got, expected)):
        assert same(g, e, tolerance), (i, g, e)


def trailing_mean(x, n):
    out, total = [], 0.0
    for i, v in enumerate(x):
        total += v
        if i >= n:
            total -= x[i - n]
        out.append(total / min(i + 1, n))
    return out


def slope(x, f):
    n = len(x)
    if n < 2:
        return [0.0] * n
    inner = [(x[i + 1] - x[i - 1]) * f / 2.0 for i in range(1, n - 1)]
    return [(x[1] - x[0]) * f, *inner, (x[-1] - x[-2]) * f]


def area(x, f):
    out, total = [], 0.0
    for i in range(len(x)):
        if i:
            total += (x[i - 1] + x[i]) * 0.5 * (1.0 / f)
        out.append(total)
    return out


def lerp_at(x, position):
    k = math.floor(position)
    if k + 1 >= len(x):
        return x[-1]
    part = position - k
    return x[k] * (1.0 - part) + x[k + 1] * part


def linear(x, f, rate, n):
    if f == rate and len(x) == n:
        return list(x)
    return [lerp_at(x, i * (f / rate)) for i in range(n)]


def half_away(v):
    return math.floor(v + 0.5) if v - math.floor(v) != 0.5 else math.floor(v) + 1


def nearest(x, f, rate, rows):
    out = []
    for i in rows:
        k = i if f == rate else half_away(i * (1.0 / rate) * f)
        out.append(x[min(k, len(x) - 1)])
    return out


def buckets(x, f, start, width):
    n = len(x)
    if n <= 2 * width:
        return [((start + i) / f, v, v) for i, v in enumerate(x)]
    size, out = n / width, []
    for b in range(width):
        s, e = int(b * size), min(int((b + 1) * size), n)
        if s >= e:
            continue
        low = high = x[s]
        for v in x[s + 1 : e]:
            low = v if v < low else low
            high = v if v > high else high
        out.append(((start + (s + e) // 2) / f, low, high))
    return out


def timer_laps(x, f):
    marks = [max(i / f - x[i], 0.0) for i in range(1, len(x)) if x[i - 1] - x[i] > 1.0]
    return labelled(marks, len(x) / f) if marks else []


def number_laps(x, f):
    def whole(v):
        return 0 if math.isnan(v) else int(max(min(v, 2.0**63 - 1), -(2.0**63)))

    marks = [i / f for i in range(1, len(x)) if whole(x[i]) != whole(x[i - 1])]
    return labelled(marks, len(x) / f) if marks else [(1, "Lap 1", 0.0, len(x) / f)]


def labelled(marks, end):
    laps = [(0, "Out Lap", 0.0, marks[0])]
    laps += [(k, f"Lap {k}", a, b) for k, (a, b) in enumerate(zip(marks, marks[1:]), 1)]
    return [*laps, (len(marks), "In Lap", marks[-1], end)]


def members(n, f, start, end):
    return range(min(max(math.floor(start * f), 0), n), min(max(math.ceil(end * f), 0), n))
