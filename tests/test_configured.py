"""Definitions and aliases that differ by session, against one run of each session on its own."""

import random

from helpers import assert_same

from apexgrid.operators import computed
from apexgrid.operators.catalog import aliases_frame, refs_frame, resolve_names
from apexgrid.operators.computed import Definition
from apexgrid.plans import queries

DEFINITIONS = "session_id string, name string, expression string"
ALIASES = "session_id string, alias string, target string"

SERIES = {
    (s, c): (f, [random.Random(f"{s}{c}").uniform(-9, 9) for _ in range(n)])
    for s, n in [("a", 40), ("b", 25), ("c", 7), ("d", 3)]
    for c, f in [("Speed", 10), ("Oil Temp", 5), ("B", 10)]
}
TEXTS = {
    # the same name is a computed channel here, a logged one there
    "a": {"A": "B + 1", "Up": "A * 2", "Top": "Up + A", "Slow": "Oil_Temp - X"},
    "b": {"B2": "A - 1", "A": "X * 3", "Up": "A * 2", "Self": "Self + 1"},
    "c": {"Up": "Speed * 2", "One": "Two", "Two": "One + Gone", "Bad": "Speed +", "Empty": "", "None": "42"},
    "e": {"Up": "Speed * 2"},
}
NAMES = {"a": {"X": "Speed"}, "b": {"X": "B", "x": "Speed"}, "e": {"X": "Speed"}}


def run(spark, make, texts, names, extra=()):
    definitions = spark.createDataFrame([(s, n, t) for s, found in texts.items() for n, t in found.items()] + list(extra), DEFINITIONS)
    aliases = spark.createDataFrame([(s, a, t) for s, found in names.items() for a, t in found.items()], ALIASES)
    return computed.evaluate_configured(make(SERIES), definitions, aliases, chunk_rows=16, seconds=1)


def by_key(rows):
    return {(r.session_id, r.name): r.message for r in rows.collect()}


def test_each_session_as_if_alone(spark, make, read):
    rows, errors = run(spark, make, TEXTS, NAMES)
    got, faults = read(rows, ["session_id", "channel"], "sample_idx"), by_key(errors)
    expected, expected_faults = {}, {}
    for s in "abc":
        alone = make({k: v for k, v in SERIES.items() if k[0] == s})
        one, failed = computed.evaluate_all(alone, [Definition.lenient(n, t) for n, t in TEXTS[s].items()], NAMES.get(s), 16, 1)
        expected |= read(one, ["session_id", "channel"], "sample_idx")
        expected_faults |= by_key(failed)
    assert faults == expected_faults
    assert set(got) == set(expected) and {s for s, _ in got} == set("abc")
    for key, values in expected.items():
        assert_same(got[key], values)


def test_repeated_rows_two_texts_nulls(spark, make, read):
    again = [("a", "Up", "Speed * 2"), ("a", "Up", "Speed * 2"), ("b", "Up", "Speed * 2"), ("b", "Up", "Speed * 4"), ("b", None, "Speed"), ("c", "Null", None)]
    rows, errors = run(spark, make, {}, {}, again)
    got = read(rows, ["session_id", "channel"], "sample_idx")
    assert set(got) == {("a", "Up"), ("b", "")}
    assert_same(got["a", "Up"], [2 * v for v in SERIES["a", "Speed"][1]])
    faults = by_key(errors)
    assert set(faults) == {("b", "Up"), ("c", "Null")} and faults["b", "Up"] == computed.TWICE
    assert errors.count() == 2


def test_without_definitions(spark, make):
    rows, errors = run(spark, make, {}, {})
    assert rows.count() == 0 and errors.count() == 0
    assert rows.columns == make(SERIES).columns and errors.columns == ["session_id", "name", "message"]


def test_equal_texts_are_planned_once(spark, make):
    """The plan follows from the texts, whatever the sessions."""
    texts, names = {"Up": "X * 2", "Down": "X - B"}, {"X": "Speed"}
    few = run(spark, make, {"a": texts}, {"a": names})[0]
    many = run(spark, make, dict.fromkeys("abcd", texts), dict.fromkeys("abcd", names))[0]
    sizes = [str(d._jdf.queryExecution().optimizedPlan()).count("\n") for d in (few, many)]
    assert sizes[0] == sizes[1]


def test_aliases_by_session(spark, make):
    channels = spark.createDataFrame([("a", 0, "Speed"), ("a", 1, "RPM"), ("b", 0, "Speed"), ("b", 1, "V")], "session_id string, channel_index int, channel string")
    aliases = spark.createDataFrame([("a", "V", "RPM"), ("b", "V", "Speed"), ("b", "w", "Speed")], ALIASES)
    got = resolve_names(channels, refs_frame(spark, ["V", "W", "speed"]), aliases_frame(spark, aliases))
    # a written name goes before an alias, an alias of one session says nothing of another
    assert {(r.session_id, r.ref, r.channel) for r in got.collect()} == {
        ("a", "V", "RPM"), ("a", "speed", "Speed"), ("b", "V", "V"), ("b", "W", "Speed"), ("b", "speed", "Speed"),
    }


def test_configurations_are_not_parsed_per_event(spark, monkeypatch):
    """Filters on what a text holds would go below the grouping of the events by session."""
    given = {}

    def capture(samples, definitions, aliases, **options):
        given.update(samples=samples, definitions=definitions, aliases=aliases)
        return samples, samples

    monkeypatch.setattr(computed, "evaluate_configured", capture)
    queries.configured_faults(spark, "/root/testdata/sf0.001")
    for name, frame in given.items():
        assert "events.parquet" not in " ".join(frame.inputFiles()), name
