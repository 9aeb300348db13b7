"""Alignment inside slices against literal loops, and what is shuffled for it."""

import math
import os
import random
import re

import pytest
from helpers import INF, NAN, assert_same, linear, nearest
from pyspark.sql import functions as F

from apexgrid.chunking import CHUNK, CORE
from apexgrid.functions.channel import ch, ref_column, shared_steps, smooth, sql
from apexgrid.operators import computed, laps, slices, stats
from apexgrid.operators.computed import Definition
from apexgrid.session import materialised, temporary_tables
from apexgrid.sources import csvfile


def some_series(seed):
    rng = random.Random(seed)
    out = {}
    for s in range(4):
        for c, f in zip("abcd", rng.sample([1, 2, 3, 7, 10, 20, 0], 4)):
            n = rng.choice([1, 2, rng.randrange(3, 40), rng.randrange(40, 200)])
            out[f"s{s}", c] = (f, [rng.choice([NAN, INF, 0.5]) if rng.random() < 0.02 else rng.uniform(-9, 9) for _ in range(n)])
    return out


def grid(series, session):
    rates = [f for (s, _), (f, _) in series.items() if s == session]
    rate = max(1, *rates)
    duration = max(len(x) / f if f > 0 else 0.0 for (s, _), (f, x) in series.items() if s == session)
    return rate, duration, math.ceil(duration * rate)


@pytest.mark.parametrize("seed,seconds", [(1, 1), (2, 3), (3, 64)])
def test_linear_and_nearest(make, read, seed, seconds):
    series = some_series(seed)
    samples = make(series)
    heads = slices.series_heads(samples)
    grids = slices.grids_by_session(heads)
    got = read(slices.linear_slots(slices.sliced(samples, heads, seconds=seconds), grids, seconds=seconds), ["session_id", "channel"], "out_idx")
    near = read(slices.nearest_slots(slices.sliced(samples, heads, seconds=seconds), grids, None, seconds), ["session_id", "channel"], "out_idx")
    window = (1.3, 9.2)
    rows = slices.sliced(samples, heads, seconds=seconds, time_range=window)
    part = read(slices.nearest_slots(rows, grids, window, seconds), ["session_id", "channel"], "out_idx")
    for (s, c), (f, x) in series.items():
        rate, _, n = grid(series, s)
        if f > 0:
            assert_same(got[s, c], linear(x, f, rate, n))
            assert_same(near[s, c], nearest(x, f, rate, range(n)))
            assert_same(part[s, c], nearest(x, f, rate, range(math.floor(window[0] * rate), math.ceil(window[1] * rate))))
        else:
            assert_same(got.get((s, c), []), [x[0]] * n)


def test_slots_beyond_the_slice(make):
    """Slots that a window over the slice looks back and ahead at are there, and marked."""
    series = {("s", "fast"): (10, range(57)), ("s", "slow"): (3, range(18))}
    samples = make(series)
    heads = slices.series_heads(samples)
    rows = slices.sliced(samples, heads, back=4, ahead=1, seconds=1)
    slots = slices.linear_slots(rows, slices.grids_by_session(heads), 4, 1, 1)
    wide = slices.side_by_side(slots, {c: F.col("channel") == c for c in ("fast", "slow")}, seconds=1).collect()
    by_slice = {}
    for r in wide:
        by_slice.setdefault(r[CHUNK], []).append(r)
    assert sorted(by_slice) == list(range(6))
    n = grid(series, "s")[2]
    slow = linear([float(v) for v in range(18)], 3, 10, n)
    for k, found in by_slice.items():
        assert sorted(r.out_idx for r in found) == list(range(max(10 * k - 4, 0), min(10 * k + 11, n)))
        assert sorted(r.out_idx for r in found if r[CORE]) == list(range(10 * k, min(10 * k + 10, n)))
        assert_same([r.slow for r in sorted(found, key=lambda r: r.out_idx)], slow[max(10 * k - 4, 0) : min(10 * k + 11, n)])


def shuffled_rows(spark, df):
    """Rows that the finished plan wrote to exchanges by session and slice."""
    df.collect()
    total = 0
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(plan.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(plan.plan())
            continue
        if name == "ShuffleExchangeExec" and CHUNK in plan.outputPartitioning().toString():
            total += plan.metrics().apply("shuffleRecordsWritten").value()
        children = plan.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_upsampled_rows_are_not_shuffled(spark, make):
    """A 1 Hz channel beside one of 100 Hz moves its own samples."""
    samples = make({("s", "fast"): (100, range(20000)), ("s", "slow"): (1, range(200))})
    rows, _ = computed.evaluate(samples, Definition("sum", ch("fast") + ch("slow")))
    assert rows.count() == 20000
    assert 20200 <= shuffled_rows(spark, rows) <= 20200 * 1.1
    assert 20200 <= shuffled_rows(spark, csvfile.csv_rows(samples, {"fast": 1, "slow": 1})) <= 20200 * 1.1


def test_lap_joins_do_not_sort_samples(spark, make):
    samples = make({("s", "c"): (10, range(500))})
    table = spark.createDataFrame([("s", 0, "Out Lap", 0.0, 20.0), ("s", 1, "Lap 1", 20.0, 50.0)], "session_id string, number int, name string, start_time double, end_time double")
    plan = stats.lap_report(samples, table)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan
    assert "SortMergeJoin" not in laps.with_laps(samples, table)._jdf.queryExecution().executedPlan().toString()


def test_temporary_tables_go_with_their_block(spark, tmp_path):
    with temporary_tables(spark) as folder:
        kept = materialised(spark.range(5))
        assert kept.count() == 5 and kept.inputFiles()[0].removeprefix("file://").startswith(folder.removeprefix("file:"))
        kept.write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    assert not os.path.exists(folder.removeprefix("file:"))
    # outside a block tables stay
    assert materialised(spark.range(3)).count() == 3


def test_names_that_only_differ_in_case(make, read):
    series = {("s", "Speed"): (1, [1, 2, 3]), ("s", "speed"): (1, [10, 20, 30]), ("s", "freq"): (1, [5, 5, 5]), ("s", "_chunk"): (1, [7, 7, 7])}
    texts = {"a": "Speed - speed", "b": "freq + 1", "c": '"_chunk" * 2', "d": "SPEED"}
    rows, errors = computed.evaluate_all(make(series), [Definition.lenient(n, t) for n, t in texts.items()])
    got = read(rows, ["channel"], "sample_idx")
    assert got == {"a": [-9, -18, -27], "b": [6, 6, 6], "c": [14, 14, 14], "d": [1, 2, 3]}
    assert errors.count() == 0
    assert ref_column("Speed").lower() != ref_column("speed").lower()


def test_a_bad_definition_stops_no_other(make, read):
    good = Definition.from_text("good", "Speed * 2")
    bad = [Definition.lenient("text", "Speed +"), Definition.lenient("blank", None), Definition("key", sql("freq + Speed", ["freq", "Speed"])),
           Definition("case", sql("Speed - speed", ["Speed", "speed"])), Definition.lenient("unknown", "Speed + Oil"), Definition.lenient("loop", "loop + 1")]
    rows, errors = computed.evaluate_all(make({("s", "Speed"): (1, [1, 2])}), [*bad, good])
    assert read(rows, ["channel"], "sample_idx") == {"good": [2, 4]}
    assert {r.name for r in errors.collect()} == {d.name for d in bad}
    assert all(r.message and r.session_id == "s" for r in errors.collect())


def test_definitions_of_a_stage_share_one_shuffle(spark, make, read):
    series = {("s", "a"): (10, range(40)), ("s", "b"): (5, range(20)), ("s", "c"): (2, range(3)), ("t", "a"): (1, range(5)), ("t", "b"): (20, range(90))}
    texts = {f"d{k}": t for k, t in enumerate(["a + b", "a - b", "c * 2", "a + c", "b", "smooth(a + b, 3)", "smooth(a + b, 3) * 2"] * 10)}
    rows, errors = computed.evaluate_all(make(series), [Definition.from_text(n, t) for n, t in texts.items()])
    got = read(rows, ["session_id", "channel"], "sample_idx")
    a, b = linear([float(v) for v in range(40)], 10, 10, 40), linear([float(v) for v in range(20)], 5, 10, 40)
    for k in range(0, 70, 7):
        assert_same(got["s", f"d{k}"], [x + y for x, y in zip(a, b)])
        assert_same(got["s", f"d{k + 2}"], [0, 2, 4])
        assert_same(got["s", f"d{k + 4}"], [float(v) for v in range(20)])
        assert_same(got["s", f"d{k + 6}"], [2 * v for v in got["s", f"d{k + 5}"]])
        assert len(got["t", f"d{k}"]) == 100 and ("t", f"d{k + 2}") not in got
    assert {(r.session_id, r.name) for r in errors.collect()} == {("t", f"d{k + j}") for k in range(0, 70, 7) for j in (2, 3)}
    # source rows with their halo, once, for all seventy
    assert 0 < shuffled_rows(spark, rows) < 2.5 * sum(len(x) for _, x in series.values()) + 200


def test_repeated_steps_are_worked_out_once():
    a, b = smooth(ch("x") + 1, 4), smooth(ch("x") + 1, 4)
    nested = [smooth(v * 2, 3) for v in (a, b)]
    kept, same = shared_steps([s for c in (a, b, *nested, smooth(ch("x"), 4)) for s in c.steps])
    assert len(kept) == 3 and len(same) == 2


def test_filling_slots_is_compiled(spark, make):
    """The JVM leaves methods of over 8,000 bytes uncompiled."""
    heads = slices.series_heads(make({("s", "a"): (20, range(50)), ("s", "b"): (5, range(9))}))
    grids = slices.grids_by_session(heads)
    rows = slices.sliced(make({("s", "a"): (20, range(50)), ("s", "b"): (5, range(9))}), heads)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for slots in (slices.linear_slots(rows, grids), slices.nearest_slots(rows, grids)):
            code = spark._jvm.PythonSQLUtils.explainString(slots._jdf.queryExecution(), "codegen")
            assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", code))) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
