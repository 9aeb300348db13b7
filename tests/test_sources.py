import json
import os

import pytest
from helpers import NAN, assert_same
from logimages import Entry, Image, log_bytes
from pyspark.sql import functions as F

from apexgrid.operators.sectors import Sector, sector_list
from apexgrid.sources import config, csvfile, motorlog, sidecar
from apexgrid.sources.logfile import LogFile, scaled

LONG_NAME = "Engine.Cylinder.1.Primary.Duty.C"
ENTRIES = [
    Entry("Engine.Speed", range(100), "float32", 20, short="rpm"),
    Entry("Half", [0.5, -2.0, 1024.0], "float16", 5, unit="x"),
    Entry("Counts", [-3, 7, 32767], "int16", 1, scale=2, dec_places=1, shift=4, mul=3),
    Entry("Big", [-(2**31), 2**31 - 1], "int32", 1),
    Entry("GPS Latitude", [36.5, NAN, 37.25], "float64", 10, scale=0, shift=9, mul=9),
    Entry("State", [1.0, 2.0], "float32", 1, codes=(6, 4)),
    Entry(LONG_NAME, [1, 2], "int16", 1, short="yc", unit="%"),
    Entry("", [], "int16", 0, n_data=0),
    Entry("Empty", [], "int16", 50),
]
STRINGS = {"date": "23/11/2024", "time": "10:00:01", "driver": "  Ann ", "vehicle_id": "Evora", "venue": "VIR", "device_type": "M1",
           "short_comment": "first"}
EVENT = {"event_name": "Test Day", "session": "Morning", "comment": "c" * 500, "venue_detail": "Full", "vehicle_id": "E1",
         "vehicle_type": "GT", "vehicle_comment": "none"}


@pytest.fixture(scope="module")
def logs(tmp_path_factory):
    root = tmp_path_factory.mktemp("logs")
    (root / "day 1").mkdir()
    files = {
        "day 1/full.ld": log_bytes(Image(ENTRIES, STRINGS, EVENT)),
        "loop.ld": log_bytes(Image([Entry("A", [1, 2], "int16"), Entry("B", [3], "int16")]), loop=True),
        "cut.ld": log_bytes(Image([Entry("A", range(10), "int16"), Entry("B", range(10), "int32")]), truncate=25),
        "bad.ld": b"\x41" + bytes(5000),
        "short.ld": b"\x40" * 100,
        "notes.txt": b"no log",
    }
    for name, content in files.items():
        (root / name).write_bytes(content)
    return str(root)


def test_session_fields(spark, logs):
    rows = {r.session_id: r for r in motorlog.read_table(spark, logs, "sessions").collect()}
    assert set(rows) == {"day 1/full", "loop", "cut"}
    full = rows["day 1/full"]
    assert (full.date, full.time, full.driver, full.venue, full.device_type) == ("23/11/2024", "10:00:01", "Ann", "VIR", "M1")
    assert (full.device_serial, full.device_version, full.num_channels_header) == (28299, 150, len(ENTRIES))
    assert full.event.asDict() == EVENT | {"vehicle_weight": 1100}
    assert rows["loop"].event.event_name == "" and rows["loop"].event.vehicle_weight == 0


def test_bad_files(spark, logs):
    rows = {os.path.basename(r.path): r.reason for r in motorlog.read_table(spark, logs, "bad_files").collect()}
    assert rows == {"bad.ld": "starts with byte 0x41 instead of 0x40", "short.ld": "100 bytes are fewer than the 1762 of a header"}


def test_channels(spark, logs):
    rows = motorlog.read_channels(spark, logs).filter("session_id = 'day 1/full'").orderBy("channel_index").collect()
    assert [(r.channel, r.short_name, r.unit, r.data_type) for r in rows] == [
        ("Engine Speed", "", "rpm", "float32"),
        ("Half", "", "x", "float16"),
        ("Counts", "", "", "int16"),
        ("Big", "", "", "int32"),
        ("GPS Latitude", "", "", "float64"),
        ("State", "", "", "unknown"),
        (LONG_NAME.replace(".", " ") + "yc", "", "%", "int16"),
        ("Empty", "", "", "int16"),
    ]
    assert [r.n_data for r in rows] == [100, 3, 3, 2, 3, 2, 2, 0]


EXPECTED = {
    "Engine Speed": [float(v) for v in range(100)],
    "Half": [0.5, -2.0, 1024.0],
    "Counts": [(v / 2 * 0.1 + 4) * 3 for v in (-3, 7, 32767)],
    "Big": [-(2.0**31), 2.0**31 - 1],
    "GPS Latitude": [36.5, NAN, 37.25],
    LONG_NAME.replace(".", " ") + "yc": [1.0, 2.0],
}


@pytest.mark.parametrize("target", [1 << 26, 700])
def test_samples_whatever_the_split(spark, logs, read, monkeypatch, target):
    monkeypatch.setattr(motorlog, "BATCH_ROWS", 7)
    df = motorlog.read_table(spark, logs, "samples", targetbytes=target)
    assert (df.rdd.getNumPartitions() > 1) == (target == 700)
    got = read(df.filter("session_id = 'day 1/full'"), ["channel"], "sample_idx")
    assert got.keys() == EXPECTED.keys()
    for name in EXPECTED:
        assert_same(got[name], EXPECTED[name])
    cut = read(df.filter("session_id = 'cut'"), ["channel"], "sample_idx")
    assert cut == {"A": [float(v) for v in range(10)], "B": [0.0, 1.0, 2.0]}
    assert read(df.filter("session_id = 'loop'"), ["channel"], "sample_idx") == {"A": [1.0, 2.0], "B": [3.0]}


@pytest.mark.parametrize("target", [1 << 26, 10000])
def test_long_session_in_several_splits(spark, tmp_path, read, target):
    image = Image([Entry("view", range(9000), "float64", 20), Entry("click", range(5000), "float32", 10)])
    (tmp_path / "7.ld").write_bytes(log_bytes(image))
    (tmp_path / "8.ld").write_bytes(log_bytes(Image([Entry("view", range(3))])))
    ways = [motorlog.read_table(spark, str(tmp_path), "samples", targetbytes=target), motorlog.read_logs(spark, str(tmp_path), "samples", target)]
    for df in ways:
        assert (df.rdd.getNumPartitions() > 5) == (target == 10000)
        got = read(df, ["session_id", "channel"], "sample_idx")
        assert got == {("7", "view"): list(range(9000)), ("7", "click"): list(range(5000)), ("8", "view"): [0, 1, 2]}
        indexes = df.groupBy("session_id", "channel").agg(F.min("sample_idx"), F.max("sample_idx"), F.count_distinct("sample_idx"))
        assert sorted(map(tuple, indexes.collect())) == [("7", "click", 0, 4999, 5000), ("7", "view", 0, 8999, 9000), ("8", "view", 0, 2, 3)]


def test_store_errors_fail_the_task(spark, tmp_path, monkeypatch):
    """A file that the store does not give is no bad file: the task fails, and Spark tries again."""
    (tmp_path / "7.ld").write_bytes(log_bytes(Image([Entry("view", range(9000), "float64", 20)])))
    (tmp_path / "8.ld").write_bytes(log_bytes(Image([Entry("view", range(9000), "float64", 20)])))
    rows = motorlog.read_logs(spark, str(tmp_path), "samples", 10000)
    rows.count()
    os.remove(tmp_path / "8.ld")
    with pytest.raises(Exception, match="8.ld"):
        rows.count()


def test_many_small_files_are_not_listed_in_python(spark, tmp_path, monkeypatch):
    content = log_bytes(Image([Entry("A", [1, 2, 3], "int16")]))
    for folder in range(20):
        (tmp_path / str(folder)).mkdir()
        for k in range(500):
            (tmp_path / str(folder) / f"{k}.ld").write_bytes(content)
    (tmp_path / "0" / "0.ld").write_bytes(b"bad")

    def listed(path):
        raise AssertionError("files are listed in the driver's Python")

    monkeypatch.setattr(motorlog, "list_logs", listed)
    rows = motorlog.read_logs(spark, str(tmp_path), "samples")
    assert rows.rdd.getNumPartitions() > 1
    found = rows.agg(F.count("*"), F.count_distinct("session_id"), F.sum("value")).first()
    assert tuple(found) == (3 * 9999, 9999, 6 * 9999)
    assert [r.path.rpartition("/")[2] for r in motorlog.read_logs(spark, str(tmp_path), "bad_files").collect()] == ["0.ld"]


def test_channels_of_one_name_stay_apart(spark, tmp_path, read):
    entries = [Entry("Speed", [1, 2]), Entry("Other", [5]), Entry("Speed", [30, 40, 50]), Entry("Speed", [7])]
    (tmp_path / "a.ld").write_bytes(log_bytes(Image(entries)))
    expected = {"Speed": [1, 2], "Other": [5], "Speed#2": [30, 40, 50], "Speed#3": [7]}
    assert read(motorlog.read_logs(spark, str(tmp_path)), ["channel"], "sample_idx") == expected
    rows = motorlog.read_channels(spark, str(tmp_path)).orderBy("channel_index").collect()
    assert [(r.channel, r.name, r.n_data) for r in rows] == [("Speed", "Speed", 2), ("Other", "Other", 1), ("Speed#2", "Speed", 3), ("Speed#3", "Speed", 1)]


def test_channel_list_in_one_read():
    content = log_bytes(Image([Entry(f"c{k}", [k], "int16") for k in range(200)]))
    reads = []

    def read(at, n):
        reads.append((at, n))
        return content[at : at + n]

    log = LogFile(len(content), read)
    assert [c.name for c in log.channels()] == [f"c{k}" for k in range(200)]
    assert len(reads) == 2


def test_pushed_filters(spark, logs, read):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = motorlog.read_table(spark, logs, "samples").filter("channel = 'Engine Speed' AND sample_idx >= 10 AND sample_idx < 13")
        assert read(df, ["channel"], "sample_idx") == {"Engine Speed": [10.0, 11.0, 12.0]}
        more = motorlog.read_table(spark, logs, "samples").filter("channel IN ('Half', 'Big') AND sample_idx <= 1 AND sample_idx > 0 AND value > 0")
        assert read(more, ["channel"], "sample_idx") == {"Big": [2.0**31 - 1]}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_ingest_and_reads_back(spark, logs, tmp_path):
    motorlog.ingest(spark, logs, str(tmp_path))
    samples = spark.read.parquet(f"{tmp_path}/samples")
    assert samples.count() == 100 + 3 + 3 + 2 + 3 + 2 + 3 + 13
    assert spark.read.parquet(f"{tmp_path}/channels").count() == 12
    assert spark.read.parquet(f"{tmp_path}/bad_files").count() == 2


def test_binary_frames(spark, logs):
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.ld").load(logs)
    assert motorlog.decode_logs(files).count() == 129
    assert motorlog.decode_logs(files, "bad_files").count() == 2
    assert motorlog.decode_logs(files, "sessions").count() == 3
    assert motorlog.decode_logs(files, "channels").count() == 12


def test_single_file_and_unknown_table(spark, logs):
    assert motorlog.read_table(spark, f"{logs}/loop.ld", "samples").select("session_id").first()[0] == "loop"
    with pytest.raises(Exception, match="no table"):
        motorlog.read_table(spark, logs, "nothing").count()


def test_scaling_forms_agree(spark, make, read):
    raw = make({("s", "a"): (1, [1, 2, 3]), ("s", "b"): (1, [4, 5])})
    channels = spark.createDataFrame(
        [("s", "a", 2, 3, 4, 1), ("s", "b", 5, 6, 0, 2)],
        "session_id string, channel string, shift smallint, mul smallint, scale smallint, dec_places smallint",
    )
    got = read(motorlog.scale_samples(raw, channels), ["channel"], "sample_idx")
    entry = LogFile.of_bytes(log_bytes(Image([Entry("a", [1], scale=4, dec_places=1, shift=2, mul=3)]))).channels()[0]
    import numpy as np

    assert_same(got["a"], list(scaled(np.array([1.0, 2.0, 3.0]), entry)), 1e-12)
    assert got["b"] == [4.0, 5.0]


SIDECAR = """<?xml version="1.0"?>
<LDXFile Locale="English_United States.1252" DefaultLocale="C" Version="1.6">
 <Layers>
  <Layer><MarkerGroup><MarkerPair Time="1.5" Color='1' EndTime="9e1"/><MarkerPair
     EndTime='7'/><MarkerPair Time="x" EndTime="2"></MarkerPair><MarkerPair Time="bad"/></MarkerGroup></Layer>
  <Details>
   <String Id="Total Laps" Value="5"/>
   <String Id="Fastest Time" Value="2:08.392"/>
   <String Id="Fastest Lap" Value="3"/>
   <!-- <String Id="Fastest Lap" Value="4"/> -->
  </Details>
 </Layers>
</LDXFile>"""


def test_sidecars(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "vir+1.ldx").write_text(SIDECAR)
    (tmp_path / "none.ldx").write_text("<LDXFile/>")
    (tmp_path / "broken.ldx").write_text('<LDXFile><String Id="Total Laps" Value="5"/>')
    files = sidecar.read_sidecars(spark, str(tmp_path))
    rows = {r.session_id: r for r in sidecar.parse_sidecars(files).collect()}
    assert set(rows) == {"a b/vir+1", "none"}
    vir = rows["a b/vir+1"]
    assert (vir.total_laps, vir.fastest_time, vir.fastest_lap) == (5, "2:08.392", 3)
    assert [tuple(m) for m in vir.laps] == [(0, 1.5, 90.0), (1, 0.0, 7.0), (2, 0.0, 0.0)]
    assert tuple(rows["none"])[1:] == (None, None, None, [])
    assert [r.path for r in sidecar.malformed_sidecars(files).collect()] == ["broken.ldx"]
    assert sidecar.marker_laps(sidecar.parse_sidecars(files)).count() == 3
    sessions = spark.createDataFrame([("a b/vir+1",), ("broken",)], "session_id string")
    joined = {r.session_id: r.fastest_lap for r in sidecar.with_sidecars(sessions, sidecar.parse_sidecars(files)).collect()}
    assert joined == {"a b/vir+1": 3, "broken": None}


def test_csv_text(spark, make, tmp_path):
    df = make({("s", "Speed"): (1, [10, 20, 30]), ("s", "RPM"): (1, [1000, 2000, 3000]), ("t", "Speed"): (2, [1.25, 2.5])})
    rows = csvfile.csv_rows(df, {"Speed": 1, "RPM": 0})
    csvfile.write_csv(rows, str(tmp_path / "out"))
    lines = [l for f in sorted((tmp_path / "out" / "session_id=s").glob("*.csv")) for l in f.read_text().splitlines()]
    assert lines == ["Time (s),Speed,RPM", "0.000000,10.0,1000", "1.000000,20.0,2000", "2.000000,30.0,3000"]
    lines = [l for f in sorted((tmp_path / "out" / "session_id=t").glob("*.csv")) for l in f.read_text().splitlines()]
    assert lines == ["Time (s),Speed,RPM", "0.000000,1.2,0", "0.500000,2.5,0"]


def test_csv_range_and_errors(make):
    df = make({("s", "Speed"): (1, [10, 20, 30, 40, 50])})
    rows = csvfile.csv_rows(df, {"Speed": 0}, (1.0, 3.0)).orderBy("out_idx").collect()
    assert [(r["Time (s)"], r.Speed) for r in rows] == [("1.000000", "20"), ("2.000000", "30")]
    with pytest.raises(ValueError, match="no channels"):
        csvfile.csv_rows(df, {})
    with pytest.raises(ValueError, match="no samples"):
        csvfile.csv_rows(df, {"Speed": 0}, (3.0, 3.0))


def test_definitions_file(spark, tmp_path):
    path = tmp_path / "in.json"
    path.write_text(json.dumps([{"name": "Ratio", "expression": "RPM / Speed", "unit": "", "dec_places": 3},
                                {"name": "Twice", "expression": "Speed * 2", "unit": "km/h", "dec_places": 0}]))
    table = config.read_definitions(spark, str(path))
    assert [(d.name, d.unit, d.dec_places) for d in config.definition_list(table)] == [("Ratio", "", 3), ("Twice", "km/h", 0)]
    config.write_definitions(table, str(tmp_path / "out"))
    assert config.read_definitions(spark, str(tmp_path / "out")).collect() == table.collect()


def test_configuration_file(spark, tmp_path):
    document = {
        "worksheets": [], "active_worksheet": 0, "last_file_path": "/x/a.ld",
        "math_channels": [{"name": "A", "expression": "Speed", "unit": "", "dec_places": 1}],
        "channel_aliases": [{"alias": "V", "target": "Speed"}, {"alias": "V", "target": "GPS Speed"}],
        "sectors": [{"name": "S1", "start_index": 3, "end_index": 17}], "reference_lap": 2,
    }
    (tmp_path / "full.json").write_text(json.dumps(document, indent=1))
    (tmp_path / "bare.json").write_text('{"worksheets": [], "active_worksheet": 0, "last_file_path": null}')
    configs = config.read_configs(spark, str(tmp_path))
    assert [r.name for r in config.channel_defs(configs).collect()] == ["A"]
    assert [(r.alias, r.target) for r in config.aliases(configs).collect()] == [("V", "GPS Speed")]
    assert sector_list(config.sectors(configs)) == [Sector("S1", 3, 17)]
    assert {r.reference_lap for r in config.reference_laps(configs).collect()} == {None, 2}
    config.write_config(configs, str(tmp_path / "out"))
    again = spark.read.text(str(tmp_path / "out")).select(F.lit("p").alias("path"), F.col("value").alias("json"))
    assert config.channel_defs(config.parse_configs(again)).count() == 1
