"""Lap sidecars: small XML files beside the logs with totals and marker intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSION = "ldx"

# fixed values: identifiers inside the files
TOTAL_LAPS = "Total Laps"
FASTEST_TIME = "Fastest Time"
FASTEST_LAP = "Fastest Lap"


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Sidecar files as ``(path, xml)``, paths relative to the directory read."""
    root = path.rstrip("/") + "/"
    full = F.try_url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", f"*.{EXTENSION}")
        .text(path, wholetext=True)
        .select(F.substring_index(full, root.split("://")[-1], -1).alias("path"), F.col("value").alias("xml"))
    )


def stem(path: Column) -> Column:
    """Path without extension: the session key."""
    return F.regexp_replace(path, r"\.[^./]*$", "")


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute, empty if it is missing."""
    double = F.regexp_extract(tag, rf'\s{name}\s*=\s*"([^"]*)"', 1)
    single = F.regexp_extract(tag, rf"\s{name}\s*=\s*'([^']*)'", 1)
    return F.when(double != "", double).otherwise(single)


def _markup(xml: Column) -> Column:
    """The text without comments and CDATA sections."""
    return F.regexp_replace(xml, r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>", "")


def _tags(xml: Column, name: str) -> Column:
    """Self-closing elements of that name."""
    return F.regexp_extract_all(_markup(xml), F.lit(rf"<{name}(?:\s(?:[^<>\"']|\"[^<\"]*\"|'[^<']*')*)?/>"), F.lit(0))


def is_malformed(xml: Column) -> Column:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    return F.from_xml(xml, "_corrupt STRING", options)["_corrupt"].isNotNull()


def parse_sidecars(files: DataFrame) -> DataFrame:
    """Totals and marker intervals of ``(path, xml)``: ``(session_id, total_laps, fastest_time, fastest_lap, laps)``.

    Numbers that cannot be read are NULL, texts stay as they are written, references to characters included; the last of repeated entries counts. Malformed files give no row, see
    :func:`malformed_sidecars`.
    """
    entries = F.transform(
        _tags(F.col("xml"), "String"),
        lambda t: F.struct(_attribute(t, "Id").alias("id"), _attribute(t, "Value").alias("value")),
    )

    def entry(name: str) -> Column:
        matching = F.filter("_entries", lambda e: e["id"] == name)
        return F.when(F.size(matching) > 0, F.element_at(matching, -1)["value"])

    def count(name: str) -> Column:
        value = entry(name)
        return F.when(value.rlike(r"^\+?[0-9]+$"), value.try_cast("int"))

    def seconds(tag: Column, name: str) -> Column:
        return F.coalesce(_attribute(tag, name).try_cast("double"), F.lit(0.0))

    markers = F.transform(
        _tags(F.col("xml"), "MarkerPair"),
        lambda t, k: F.struct(
            k.cast("int").alias("number"),
            seconds(t, "Time").alias("start_time"),
            seconds(t, "EndTime").alias("end_time"),
        ),
    )
    return (
        files.filter(~is_malformed(F.col("xml")))
        .withColumn("_entries", entries)
        .select(
            stem(F.col("path")).alias("session_id"),
            count(TOTAL_LAPS).alias("total_laps"),
            entry(FASTEST_TIME).alias("fastest_time"),
            count(FASTEST_LAP).alias("fastest_lap"),
            markers.alias("laps"),
        )
    )


def malformed_sidecars(files: DataFrame) -> DataFrame:
    return files.filter(is_malformed(F.col("xml"))).select("path", F.lit("XML parse error").alias("reason"))


def marker_laps(sidecars: DataFrame) -> DataFrame:
    """Marker intervals, one row each. They are data of their own and do not replace detected laps."""
    return sidecars.select("session_id", F.explode("laps").alias("lap")).select("session_id", "lap.*")


def with_sidecars(sessions: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Sessions with the totals of the sidecar of the same name, if there is one."""
    totals = sidecars.select("session_id", "total_laps", "fastest_time", "fastest_lap")
    return sessions.join(totals, "session_id", "left")
