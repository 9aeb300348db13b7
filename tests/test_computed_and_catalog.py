import pytest
from helpers import NAN, area, assert_same, linear, slope, trailing_mean
from pyspark.sql import functions as F

from apexgrid.functions import ch
from apexgrid.functions.channel import fn, sql
from apexgrid.functions.sql import register_functions
from apexgrid.functions.text import from_text
from apexgrid.operators import catalog, computed, presets
from apexgrid.operators.computed import Definition

BASE = {
    ("s", "Speed"): (1, [10, 20, 30, 40, 50]),
    ("s", "RPM"): (1, [1000, 2000, 3000, 4000, 5000]),
    ("s", "Engine Speed"): (1, [100, 200, 300, 400, 500]),
}

CASES = [
    ("Speed + 5", [15, 25, 35, 45, 55]),
    ("RPM / Speed", [100] * 5),
    ('"Engine Speed" * 2', [200, 400, 600, 800, 1000]),
    ("Engine_Speed", [100, 200, 300, 400, 500]),
    ("derivative(Speed)", [10] * 5),
    ("smooth(Speed, 3)", [10, 15, 20, 30, 40]),
    ("integrate(Speed)", [0, 15, 40, 75, 120]),
    ("abs(derivative(smooth(Speed, 2)))", [5, 7.5, 10, 10, 10]),
    ("Speed / (Speed - Speed)", [NAN] * 5),
    ("Speed > 25", [0, 0, 1, 1, 1]),
    ("Speed <= 30", [1, 1, 1, 0, 0]),
    ("Speed == 30", [0, 0, 1, 0, 0]),
    ("Speed != 30", [1, 1, 0, 1, 1]),
    ("Speed > 15 && Speed < 45", [0, 1, 1, 1, 0]),
    ("Speed < 15 || Speed > 45", [1, 0, 0, 0, 1]),
    ("Speed < 15 || Speed > 25 && Speed < 35", [1, 0, 1, 0, 0]),
    ("!(Speed > 25)", [1, 1, 0, 0, 0]),
    ("!Speed + 1", [1] * 5),
    ("gate(Speed, Speed > 25)", [NAN, NAN, 30, 40, 50]),
    ("if_then(Speed > 25, Speed, 0)", [0, 0, 30, 40, 50]),
    ("2 + 3 * Speed", [32, 62, 92, 122, 152]),
    ("-Speed % 7", [-3, -6, -2, -5, -1]),
    ("Speed - 1 - 2", [7, 17, 27, 37, 47]),
    ("MAX(Speed, .25e2)", [25, 25, 30, 40, 50]),
    ("clamp(Speed, 15, 35)", [15, 20, 30, 35, 35]),
    ("pow(Speed / 10, 2) + max(1, 2)", [3, 6, 11, 18, 27]),
    ("speed", [10, 20, 30, 40, 50]),
]


def test_known_expressions(spark):
    columns = [c for _, c in BASE]
    rows = [("s", 1, i, *map(float, v)) for i, v in enumerate(zip(*(x for _, x in BASE.values())))]
    layout = "session_id string, freq int, sample_idx bigint, " + ", ".join(f"`{c}` double" for c in columns)
    frame = spark.createDataFrame(rows, layout).withColumn("Engine_Speed", F.col("`Engine Speed`"))
    defs = [Definition.from_text(f"r{k}", text) for k, (text, _) in enumerate(CASES)]
    got = computed.evaluate_wide(frame, defs).orderBy("sample_idx").collect()
    for k, (text, expected) in enumerate(CASES):
        assert_same([r[f"r{k}"] for r in got], expected)


@pytest.mark.parametrize(
    "text,expected",
    [
        ("Velocity + Revs * 0", [10, 20, 30, 40, 50]),
        ('Engine_Speed + "Engine Speed" + speed', [210, 420, 630, 840, 1050]),
        ("abs(derivative(smooth(Speed, 2)))", [5, 7.5, 10, 10, 10]),
    ],
)
def test_expressions_over_samples(make, read, text, expected):
    aliases = {"Velocity": "Speed", "Revs": "RPM"}
    rows, _ = computed.evaluate(make(BASE), Definition.from_text("r", text), aliases)
    assert_same(read(rows, ["session_id"], "sample_idx")["s"], expected)


def test_errors_are_reported(make):
    cases = {"42": computed.NO_DATA, "Speed + Oil": "no channel is named 'Oil'", "Oil": computed.NO_DATA}
    for text, message in cases.items():
        rows, errors = computed.evaluate(make(BASE), Definition.from_text("r", text))
        assert [tuple(r) for r in errors.collect()] == [("s", "r", message)]
        assert rows.count() == 0
    assert computed.evaluate(make(BASE), Definition.from_text("r", "Speed"))[1].count() == 0


@pytest.mark.parametrize(
    "text", ["", "  ", "(a + b", "a +", "a b", "a = b", "a & b", "a < b < c", "a ** 2", "foo(a)", "'a'", "sin(a, b)", "smooth(a)", "a $ b"]
)
def test_bad_expressions(spark, text):
    with pytest.raises(ValueError):
        from_text(text)


def test_references(spark):
    assert from_text("GPS.Speed + WheelSpeed_RL * max(class, GPS.Speed)").refs == ("GPS.Speed", "WheelSpeed_RL", "class")
    with pytest.raises(TypeError):
        bool(ch("a") > 1)


def test_mixed_rates(make, read):
    fast, slow = list(range(10)), [0, 10]
    series = {("s", "Fast"): (10, fast), ("s", "Slow"): (2, slow), ("t", "Fast"): (5, fast), ("t", "Slow"): (20, [3.0])}
    rows, _ = computed.evaluate(make(series), Definition("sum", ch("Fast") + ch("Slow")), chunk_rows=4)
    got = read(rows, ["session_id"], "sample_idx")
    assert_same(got["s"], [a + b for a, b in zip(fast, linear(slow, 2, 10, 10))])
    assert got["s"][0] == 0.0
    assert_same(got["t"], [a + b for a, b in zip(linear(fast, 5, 20, 40), [3.0] * 40)])
    assert {r.freq for r in rows.filter("session_id = 't'").collect()} == {20}


@pytest.mark.parametrize(
    "text,loop",
    [
        ("smooth(Fast, 3) + derivative(Fast)", lambda x: [a + b for a, b in zip(trailing_mean(x, 3), slope(x, 10))]),
        ("integrate(smooth(Fast, 5))", lambda x: area(trailing_mean(x, 5), 10)),
        ("integrate(Fast) - smooth(Fast, 30)", lambda x: [a - b for a, b in zip(area(x, 10), trailing_mean(x, 30))]),
    ],
)
def test_series_functions_over_chunks(make, read, text, loop):
    x = [((i * 37) % 23) / 4 for i in range(45)]
    gaps = [*x[:20], NAN, *x[21:]]
    series = {("s", "Fast"): (10, x), ("t", "Fast"): (10, gaps), ("u", "Fast"): (10, [2.0])}
    rows, _ = computed.evaluate(make(series), Definition.from_text("r", text), chunk_rows=8)
    got = read(rows, ["session_id"], "sample_idx")
    for (s, _), (_, values) in series.items():
        assert_same(got[s], loop(values))


def test_catalogue_narrows_the_scan(spark, make, read, tmp_path):
    make(BASE).write.parquet(str(tmp_path / "samples"))
    samples = spark.read.parquet(str(tmp_path / "samples"))
    names = [("s", c, k, 5) for k, (_, c) in enumerate(BASE)]
    channels = spark.createDataFrame(names, "session_id string, channel string, channel_index int, n_data bigint")
    rows, errors = computed.evaluate(samples, Definition.from_text("r", "speed * 2"), catalog=channels)
    assert "LeftSemi" in rows._jdf.queryExecution().optimizedPlan().toString()
    assert read(rows, ["session_id"], "sample_idx")["s"] == [20, 40, 60, 80, 100]
    assert errors.count() == 0


def test_sql_text_definition(spark, make, read):
    register_functions(spark)
    slip = sql("t_div(`RPM` - `Speed`, t_max(`Speed`, 25D))", ["RPM", "Speed"])
    rows, _ = computed.evaluate(make(BASE), Definition("r", slip))
    assert_same(read(rows, ["session_id"], "sample_idx")["s"], [990 / 25, 1980 / 25, 99, 99, 99])


def test_chain_and_cycle(make, read):
    defs = [
        Definition.from_text("C", "B * 2"),
        Definition.from_text("A", "Speed + 1"),
        Definition.from_text("B", "A + Oil"),
        Definition.from_text("D", "A * 10"),
        Definition.from_text("X", "Y + 1"),
        Definition.from_text("Y", "X + 1"),
    ]
    rows, errors = computed.evaluate_all(make(BASE), defs)
    got = read(rows, ["channel"], "sample_idx")
    assert got == {"A": [11, 21, 31, 41, 51], "D": [110, 210, 310, 410, 510]}
    messages = {r.name: r.message for r in errors.collect()}
    assert messages == {
        "B": "no channel is named 'Oil'",
        "C": computed.NO_DATA,
        "X": "no channel is named 'Y'",
        "Y": "no channel is named 'X'",
    }
    assert computed.computed_stats(rows).filter("channel = 'D'").first().avg_value == 310.0


def test_function_arity(spark):
    with pytest.raises(ValueError, match="takes 2"):
        fn("atan2", ch("a"))
    with pytest.raises(ValueError, match="no function"):
        fn("sinh", ch("a"))


def test_presets(make, read):
    series = {
        ("s", "GPS Speed"): (1, [0.5, 20, 40]), ("s", "WheelSpeed_FL"): (1, [1, 22, 44]),
        ("s", "G.Force.Lat"): (1, [3, 0, 1]), ("s", "G Force Long"): (1, [4, 1, 0]),
    }
    slip, _ = computed.evaluate(make(series), presets.preset("Wheel Slip FL"))
    assert_same(read(slip, ["session_id"], "sample_idx")["s"], [50, 10, 10])
    force, errors = computed.evaluate(make(series), presets.preset("Total G-Force"))
    # "G_Force_Lat" means "G Force Lat" or "G.Force.Lat"
    assert_same(read(force, ["session_id"], "sample_idx")["s"], [5, 1, 1])
    assert errors.count() == 0
    assert [d.name for d in presets.presets()] == presets.PRESET_NAMES


CATALOG = "session_id string, channel_index int, channel string"


def test_resolution_order(spark):
    channels = spark.createDataFrame(
        [("s", 0, "a b"), ("s", 1, "A_B"), ("s", 2, "a.b"), ("s", 3, "Target"), ("t", 0, "a.b"), ("t", 1, "TARGET"),
         ("u", 0, "A_b"), ("u", 1, "a_B"), ("v", 0, "Target"), ("w", 0, "É")], CATALOG,
    )
    refs = ["a_b", "alias", "ALIAS", "é", "al_ias"]
    aliases = {"alias": "Target", "a_b": "Target", "al ias": "Target", "al.ias": "a.b"}
    rows = catalog.resolve_names(channels, catalog.refs_frame(spark, refs), catalog.aliases_frame(spark, aliases)).collect()
    assert {(r.session_id, r.ref): (r.channel, r["rank"]) for r in rows} == {
        ("s", "a_b"): ("a b", 20), ("s", "alias"): ("Target", 40), ("s", "ALIAS"): ("Target", 60), ("s", "al_ias"): ("Target", 41),
        ("t", "a_b"): ("a.b", 30), ("t", "al_ias"): ("a.b", 42),
        ("u", "a_b"): ("A_b", 50),
        ("v", "a_b"): ("Target", 40), ("v", "alias"): ("Target", 40), ("v", "ALIAS"): ("Target", 60), ("v", "al_ias"): ("Target", 41),
    }
    targets = catalog.resolve_alias_targets(catalog.refs_frame(spark, refs), catalog.aliases_frame(spark, aliases))
    assert dict(map(tuple, targets.collect())) == {"a_b": "Target", "alias": "Target", "ALIAS": "Target", "al_ias": "Target"}


def test_clean_names(spark):
    long = "Engine Cylinder 1 Primary Duty C"
    rows = [(long, "%", "", True), (long, "yc", "", True), (long, "cle", "", True), ("Engine.Speed", "rpm", "", False),
            ("Oil", "x", "kPa", False), (long, "yc", "kPa", True), (long, "é", "", True)]
    df = spark.createDataFrame(rows, "raw_name string, raw_short string, raw_unit string, name_filled boolean").coalesce(1)
    got = [tuple(r) for r in catalog.clean_names(df).select("name", "short_name", "unit").collect()]
    assert got == [(long, "", "%"), (long + "yc", "", ""), (long, "", "cle"), ("Engine Speed", "", "rpm"), ("Oil", "x", "kPa"),
                   (long + "yc", "", "kPa"), (long, "", "é")]


def test_search_and_conflicts(spark):
    physical = spark.createDataFrame([("s", "GPS Speed", "km/h"), ("s", "Brake", "kPa")], "session_id string, channel string, unit string")
    maths = spark.createDataFrame([("s", "Slip", "km/h"), ("s", "speed ratio", "")], "session_id string, channel string, unit string")
    everything = catalog.full_catalog(physical, maths)
    assert [r.channel for r in catalog.search_catalog(everything, "KM").collect()] == ["GPS Speed"]
    assert [r.channel for r in catalog.search_catalog(everything, "speed").collect()] == ["GPS Speed", "speed ratio"]
    defs = spark.createDataFrame(
        [("s", 1, "brake"), ("s", 2, "Slip"), ("s", 3, "SLIP"), ("s", 4, "new"), ("s", 5, ""), ("s", 6, "")],
        "session_id string, def_id int, name string",
    )
    got = {(r.def_id, r.conflicts_with) for r in catalog.name_conflicts(defs, physical).collect()}
    assert got == {(1, "physical"), (2, "math"), (3, "math")}
