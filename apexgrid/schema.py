"""Column layouts of the tables that the sources write and the operators read."""

from pyspark.sql import types as T

SESSION = "session_id"
CHANNEL = "channel"
FREQ = "freq"
IDX = "sample_idx"
VALUE = "value"
SERIES = (SESSION, CHANNEL)

EVENT = T.StructType(
    [
        T.StructField("event_name", T.StringType()),
        T.StructField("session", T.StringType()),
        T.StructField("comment", T.StringType()),
        T.StructField("venue_detail", T.StringType()),
        T.StructField("vehicle_id", T.StringType()),
        T.StructField("vehicle_weight", T.LongType()),
        T.StructField("vehicle_type", T.StringType()),
        T.StructField("vehicle_comment", T.StringType()),
    ]
)

SESSIONS = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("time", T.StringType()),
        T.StructField("driver", T.StringType()),
        T.StructField("vehicle_id", T.StringType()),
        T.StructField("venue", T.StringType()),
        T.StructField("short_comment", T.StringType()),
        T.StructField("device_serial", T.LongType()),
        T.StructField("device_type", T.StringType()),
        T.StructField("device_version", T.IntegerType()),
        T.StructField("num_channels_header", T.LongType()),
        T.StructField("event", EVENT),
    ]
)

RAW_CHANNELS = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("channel_index", T.IntegerType()),
        T.StructField("raw_name", T.StringType()),
        T.StructField("raw_short", T.StringType()),
        T.StructField("raw_unit", T.StringType()),
        T.StructField("name_filled", T.BooleanType()),
        T.StructField("freq", T.IntegerType()),
        T.StructField("n_data", T.LongType()),
        T.StructField("data_type", T.StringType()),
        T.StructField("shift", T.ShortType()),
        T.StructField("mul", T.ShortType()),
        T.StructField("scale", T.ShortType()),
        T.StructField("dec_places", T.ShortType()),
    ]
)

SAMPLES = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("channel_index", T.IntegerType()),
        T.StructField("channel", T.StringType()),
        T.StructField("freq", T.IntegerType()),
        T.StructField("sample_idx", T.LongType()),
        T.StructField("value", T.DoubleType()),
    ]
)

BAD_FILES = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("reason", T.StringType())]
)

CHANNEL_DEFS = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("expression", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("dec_places", T.ShortType()),
    ]
)
