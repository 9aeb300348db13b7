"""Stored definitions and session configurations (JSON)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apexgrid.operators.computed import Definition
from apexgrid.schema import CHANNEL_DEFS

CONFIG = T.StructType(
    [
        T.StructField("last_file_path", T.StringType()),
        T.StructField("math_channels", T.ArrayType(CHANNEL_DEFS)),
        T.StructField(
            "channel_aliases",
            T.ArrayType(
                T.StructType([T.StructField("alias", T.StringType()), T.StructField("target", T.StringType())])
            ),
        ),
        T.StructField(
            "sectors",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("name", T.StringType()),
                        T.StructField("start_index", T.LongType()),
                        T.StructField("end_index", T.LongType()),
                    ]
                )
            ),
        ),
        T.StructField("reference_lap", T.LongType()),
    ]
)


def read_definitions(spark: SparkSession, path: str) -> DataFrame:
    """Computed-channel definitions from JSON arrays: ``(name, expression, unit, dec_places)``."""
    return spark.read.schema(CHANNEL_DEFS).option("multiLine", "true").json(path)


def write_definitions(definitions: DataFrame, path: str) -> None:
    """Definitions as JSON arrays, which :func:`read_definitions` reads back: one for each ``source`` where there is such a column, in a folder
    of its name, else one of all."""
    array = F.to_json(F.collect_list(F.struct(*CHANNEL_DEFS.names))).alias("value")
    by = [c for c in ("source",) if c in definitions.columns]
    definitions.groupBy(*by).agg(array).write.mode("overwrite").partitionBy(*by).text(path)


def definition_list(definitions: DataFrame) -> list[Definition]:
    """Definitions ready for evaluation, those with a bad text included: it becomes an error of theirs. They are written by hand, a
    screenful at most."""
    return [Definition.lenient(*row) for row in definitions.select(*CHANNEL_DEFS.names).toLocalIterator()]


def read_configs(spark: SparkSession, path: str) -> DataFrame:
    """Session configurations as ``(path, config STRUCT)``; layout of windows and panels is not read."""
    rows = spark.read.schema(CONFIG).option("multiLine", "true").json(path)
    return rows.select(F.input_file_name().alias("path"), F.struct(*CONFIG.names).alias("config"))


def parse_configs(files: DataFrame) -> DataFrame:
    """The same from a frame ``(path, json)``."""
    return files.select("path", F.from_json("json", CONFIG).alias("config"))


def write_config(configs: DataFrame, path: str) -> None:
    """One JSON document per configuration."""
    configs.select(F.to_json("config").alias("value")).write.mode("overwrite").text(path)


def channel_defs(configs: DataFrame) -> DataFrame:
    return _entries(configs, "math_channels")


def aliases(configs: DataFrame) -> DataFrame:
    """Alias targets; the last of repeated aliases counts."""
    listed = configs.select("path", F.posexplode("config.channel_aliases").alias("_k", "e"))
    last = F.max_by("e.target", "_k").alias("target")
    return listed.groupBy("path", F.col("e.alias").alias("alias")).agg(last)


def sectors(configs: DataFrame) -> DataFrame:
    """Sectors in their order, ``sector_no`` from 0."""
    return configs.select("path", F.posexplode("config.sectors").alias("sector_no", "e")).select("path", "sector_no", "e.*")


def reference_laps(configs: DataFrame) -> DataFrame:
    return configs.select("path", F.col("config.reference_lap").alias("reference_lap"))


def _entries(configs: DataFrame, field: str) -> DataFrame:
    return configs.select("path", F.explode(f"config.{field}").alias("e")).select("path", "e.*")
