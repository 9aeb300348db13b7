"""Telemetry tables derived from the ``events`` table: ten users make a session, event order is sample order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from apexgrid.chunking import dense_index
from apexgrid.operators.laps import detect_from_timer
from apexgrid.operators.sectors import Sector

EVENTS = "event_id BIGINT, user_id BIGINT, event_type STRING, value DOUBLE"
SECTORS = [Sector("S1", 0, 50), Sector("S2", 50, 100), Sector("S3", 100, 149)]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        spark.read.schema(EVENTS)
        .parquet(f"{sf_dir}/events.parquet")
        .withColumn("session_id", F.floor(F.col("user_id") / 10.0))
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five channels of unequal rate and length per session."""
    rows = events(spark, sf_dir).select(
        "session_id", F.col("event_type").alias("channel"), "event_id", "value"
    )
    rates = {"view": 20, "click": 10, "purchase": 5, "signup": 2}
    freq = F.lit(1)
    for name, rate in rates.items():
        freq = F.when(F.col("channel") == name, rate).otherwise(freq)
    return dense_index(rows, ["session_id", "channel"], "event_id", "sample_idx").select(
        "session_id", "channel", freq.alias("freq"), "sample_idx", "value"
    )


def samples_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``samples``, with gaps."""
    gap = F.col("sample_idx") % 97 == 41
    return samples(spark, sf_dir).withColumn(
        "value", F.when(gap, F.lit(float("nan"))).otherwise(F.col("value"))
    )


def clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 10 Hz tick per event; lap length 15.00 to 17.22 s by session, in integer milliseconds."""
    rows = events(spark, sf_dir).select("session_id", "event_id", "value")
    return dense_index(rows, ["session_id"], "event_id", "sample_idx").selectExpr(
        "session_id",
        "sample_idx",
        "value",
        "15000 + 370 * (session_id % 7) AS lap_ms",
        "sample_idx * 100 + 30 * (session_id % 3) AS ms",
    )


def timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lap timer, lap number and GPS position at 10 Hz."""
    turn = "2 * PI() * (ms % lap_ms) / lap_ms"
    return clock(spark, sf_dir).selectExpr(
        "session_id",
        "sample_idx",
        "10 AS freq",
        "CAST(ms % lap_ms AS DOUBLE) / 1000.0D AS timer",
        "CAST(FLOOR(ms / CAST(lap_ms AS DOUBLE)) AS BIGINT) AS lap_no",
        f"36.56D + 0.010D * SIN({turn}) + 1e-6D * value AS lat",
        f"-79.20D + 0.014D * COS({turn}) + 1e-6D * value AS lon",
    )


def timer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing(spark, sf_dir).select("session_id", "sample_idx", "freq", F.col("timer").alias("value"))


def lap_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing(spark, sf_dir).select(
        "session_id", "sample_idx", "freq", F.col("lap_no").cast("double").alias("value")
    )


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing(spark, sf_dir).select("session_id", "sample_idx", "freq", "lat", "lon")


def vehicle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The channels that the presets need, side by side at 10 Hz."""
    return clock(spark, sf_dir).selectExpr(
        "session_id",
        "sample_idx",
        "10 AS freq",
        "value AS GPS_Speed",
        "value * 1.02D AS WheelSpeed_FL",
        "value * 1.01D AS WheelSpeed_FR",
        "value + 0.5D * (sample_idx % 5) AS WheelSpeed_RL",
        "value - 0.25D * (sample_idx % 3) AS WheelSpeed_RR",
        "((sample_idx % 21) - 10) / 10.0D AS G_Force_Long",
        "((sample_idx % 31) - 15) / 10.0D AS G_Force_Lat",
        "((sample_idx % 17) - 8) / 4.0D AS Yaw_Rate",
        "((sample_idx % 41) - 20) * 1.5D AS Steering_Angle",
        "CAST(sample_idx % 101 AS DOUBLE) AS Throttle_Pos",
    )


def session_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        events(spark, sf_dir)
        .groupBy("session_id")
        .agg(F.min("user_id").alias("device_serial"), F.max("event_id").alias("last_event"))
        .select(
            "session_id",
            "device_serial",
            F.concat(F.lit("Driver "), F.col("device_serial")).alias("driver"),
            F.concat(F.lit("Venue "), F.col("last_event") % 7).alias("venue"),
        )
    )


# event type -> channel name as a logger would write it
LOGGER_NAMES = {
    "view": "GPS Speed",
    "click": "Engine.RPM",
    "purchase": "GPS_Latitude",
    "signup": "GPS Long",
    "error": "Lap_Number",
}
LOGGER_UNITS = {"view": "km/h", "click": "rpm", "purchase": "deg", "signup": "deg", "error": ""}


def _renamed(column: str, names: dict[str, str]) -> Column:
    renamed = F.lit("")
    for old, new in names.items():
        renamed = F.when(F.col(column) == old, F.lit(new)).otherwise(renamed)
    return renamed


def logger_name(event_type: str) -> Column:
    return _renamed(event_type, LOGGER_NAMES)


def logger_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue with logger names; the index of a channel is the order of its first event."""
    first = (
        events(spark, sf_dir)
        .groupBy("session_id", "event_type")
        .agg(F.min("event_id").alias("first_event"), F.count(F.lit(1)).alias("n_data"))
    )
    order = Window.partitionBy("session_id").orderBy("first_event")
    return first.select(
        "session_id",
        (F.row_number().over(order) - 1).alias("channel_index"),
        logger_name("event_type").alias("channel"),
        _renamed("event_type", LOGGER_UNITS).alias("unit"),
        "n_data",
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns of arguments for scalar functions, with gaps and zeros."""
    return clock(spark, sf_dir).selectExpr(
        "session_id",
        "sample_idx",
        "CASE WHEN sample_idx % 97 = 41 THEN DOUBLE('NaN') ELSE value - 100.0D END AS a",
        "CASE WHEN sample_idx % 89 = 13 THEN DOUBLE('NaN') ELSE ((sample_idx % 21) - 10) / 4.0D END AS b",
    )


def picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four points beside the track per session, as if clicked on its map."""
    sessions = events(spark, sf_dir).select("session_id").distinct()
    turn = F.col("session_id") + F.col("pick_no") * 1.6
    return sessions.withColumn("pick_no", F.explode(F.array(*map(F.lit, range(4))))).select(
        "session_id", "pick_no", (F.sin(turn) * 0.012).alias("px"), (F.cos(turn) * 0.009).alias("py")
    )


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times to look up: a moment in every lap, and one past the end."""
    laps = detect_from_timer(timer(spark, sf_dir))
    return laps.select(
        "session_id", F.col("number").alias("probe_id"), (F.col("start_time") * 1.25 + 0.037).alias("t")
    )
