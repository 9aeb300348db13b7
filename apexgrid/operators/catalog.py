"""Channel catalogue: name clean-up, name resolution, picks and searches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from apexgrid.chunking import spread_join
from apexgrid.chunking import join_by_chunk
from apexgrid.schema import CHANNEL, IDX, SESSION

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# fixed values: name parts of position channels
LATITUDE_PARTS = ["latitude", "lat"]
LONGITUDE_PARTS = ["longitude", "lon", "long"]
REPRESENTATIVE_PARTS = ["speed", "rpm"]


def ascii_lower(c: Column) -> Column:
    """Lower case of ASCII letters only."""
    return F.translate(c, UPPER, UPPER.lower())


def normalised(name: Column) -> Column:
    """Lower case with ``.`` and ``_`` as spaces."""
    return F.translate(F.lower(name), "._", "  ")


# names as stored by the logger


def clean_names(
    channels: DataFrame,
    raw_name: str = "raw_name",
    raw_short: str = "raw_short",
    raw_unit: str = "raw_unit",
    filled: str = "name_filled",
) -> DataFrame:
    """Add ``name``, ``short_name`` and ``unit``.

    A name that fills its field may continue in a short name of one or two bytes when both characters at the seam
    are ASCII letters or digits; otherwise the short name stands in for a missing unit. Dots in names become spaces.
    """
    name, short, unit = F.col(raw_name), F.col(raw_short), F.col(raw_unit)
    continued = (
        F.col(filled)
        & (short != "")
        & (F.octet_length(short) <= 2)
        & name.rlike("[A-Za-z0-9]$")
        & short.rlike("^[A-Za-z0-9]")
    )
    rest = F.when(continued, F.lit("")).otherwise(short)
    return channels.withColumns(
        {
            "name": F.translate(F.when(continued, F.concat(name, short)).otherwise(name), ".", " "),
            "short_name": F.when(unit != "", rest).otherwise(F.lit("")),
            "unit": F.when(unit != "", unit).otherwise(rest),
        }
    )


# channels of one name


def with_series_names(channels: DataFrame, name: str = CHANNEL, out: str = "series") -> DataFrame:
    """Add the name a channel's samples go by: its own for the first channel of that name in a session, with ``#`` and its index for others.

    Channels are told apart by their index; a name finds the first one, as the rules of name resolution have it.
    """
    first = F.min("channel_index").over(Window.partitionBy(SESSION, name))
    numbered = F.concat(F.col(name), F.lit("#"), F.col("channel_index"))
    return channels.withColumn(out, F.when(F.col("channel_index") == first, F.col(name)).otherwise(numbered))


def by_series(samples: DataFrame, channels: DataFrame) -> DataFrame:
    """Samples ``(session_id, channel_index, channel, freq, sample_idx, value)`` with ``channel`` as the name of their series.

    Only the channels that share a name with an earlier one are joined, chunk by chunk, by ``channels(session_id, channel_index, channel, n_data)``.
    """
    renamed = with_series_names(channels).filter(F.col("series") != F.col(CHANNEL)).select(SESSION, "channel_index", "series", "n_data")
    joined = join_by_chunk(samples, renamed, [SESSION, "channel_index"], IDX, "left")
    return joined.withColumn(CHANNEL, F.coalesce("series", CHANNEL)).select(*samples.columns)


# resolving references


def refs_frame(spark: SparkSession, refs: Sequence[str]) -> DataFrame:
    return _local(spark, {"ref": list(refs)})


def aliases_frame(spark: SparkSession, aliases: Mapping[str, str] | DataFrame | None) -> DataFrame:
    """``(alias, target)``; a table may also have a ``session_id``, then an alias holds for its session only."""
    if isinstance(aliases, DataFrame):
        return aliases.select(*_by_session(aliases), "alias", "target")
    aliases = aliases or {}
    return _local(spark, {"alias": list(aliases), "target": list(aliases.values())})


def _by_session(aliases: DataFrame) -> list[str]:
    return [c for c in (SESSION,) if c in aliases.columns]


def _local(spark: SparkSession, columns: dict[str, list[str]]) -> DataFrame:
    """Strings held by the plan itself, so that the optimizer knows their exact size."""
    return spark.createDataFrame(pa.table({k: pa.array(v, pa.string()) for k, v in columns.items()}))


def _variants(refs: DataFrame) -> DataFrame:
    """Each reference as written, with ``_`` as space and with ``_`` as dot."""
    ref = F.col("ref")
    forms = F.array(ref, F.translate(ref, "_", " "), F.translate(ref, "_", "."))
    return refs.select("ref", F.posexplode(forms).alias("form", "variant"))


def _alias_hits(refs: DataFrame, aliases: DataFrame) -> DataFrame:
    """Alias targets by rank: 40..42 for the written forms, 60 for a match in other letter case."""
    by = _by_session(aliases)
    exact = _variants(refs).join(aliases, F.col("variant") == F.col("alias")).select(
        *by, "ref", (F.col("form") + 40).alias("rank"), "target"
    )
    folded = refs.join(aliases, ascii_lower(F.col("ref")) == ascii_lower(F.col("alias"))).select(
        *by, "ref", F.lit(60).alias("rank"), "target"
    )
    return exact.unionByName(folded)


def resolve_alias_targets(refs: DataFrame, aliases: DataFrame) -> DataFrame:
    """Target of each reference that is an alias: ``(ref, target)``, by session if the aliases are, first match by rank then target."""
    best = F.min(F.struct("rank", "target"))
    return _alias_hits(refs, aliases).groupBy(*_by_session(aliases), "ref").agg(best["target"].alias("target"))


def resolve_names(channels: DataFrame, refs: DataFrame, aliases: DataFrame) -> DataFrame:
    """Channel of each session that each reference means: ``(session_id, ref, channel, rank)``.

    Order of preference: as written, ``_`` as space, ``_`` as dot, alias (same three forms), other letter case,
    alias in other letter case. Equal candidates go by channel index.

    The references and aliases become a short list of wanted names first, so the catalogue is matched by one equi-join; aliases that differ by
    session by one more, on session and name.
    """
    by = _by_session(aliases)
    written = _variants(refs).select(
        "ref", ((F.col("form") + 1) * 10).alias("rank"), F.lit("exact").alias("kind"), F.col("variant").alias("key")
    )
    by_alias = _alias_hits(refs, aliases).select(*by, "ref", "rank", F.lit("exact").alias("kind"), F.col("target").alias("key"))
    folded = refs.select(
        "ref", F.lit(50).alias("rank"), F.lit("folded").alias("kind"), ascii_lower(F.col("ref")).alias("key")
    )
    wanted = written.unionByName(folded)
    wanted = wanted if by else wanted.unionByName(by_alias)
    name = F.col(CHANNEL)
    keyed = channels.select(
        SESSION,
        "channel_index",
        CHANNEL,
        F.explode(
            F.array(
                F.struct(F.lit("exact").alias("kind"), name.alias("key")),
                F.struct(F.lit("folded").alias("kind"), ascii_lower(name).alias("key")),
            )
        ).alias("k"),
    ).select(SESSION, "channel_index", CHANNEL, "k.kind", "k.key")
    hits = keyed.join(wanted, ["kind", "key"])
    if by:
        hits = hits.unionByName(keyed.join(by_alias, [SESSION, "kind", "key"]).select(*hits.columns))
    best = F.min(F.struct("rank", "channel_index", CHANNEL))
    return (
        hits.groupBy(SESSION, "ref")
        .agg(best.alias("_best"))
        .select(SESSION, "ref", F.col("_best")[CHANNEL].alias(CHANNEL), F.col("_best")["rank"].alias("rank"))
    )


def channel_indexes(samples: DataFrame) -> DataFrame:
    """Catalogue ``(session_id, channel_index, channel)`` of a samples table, indexed by name."""
    names = samples.groupBy(SESSION, CHANNEL).agg(F.count(F.lit(1)).alias("n_data"))
    order = Window.partitionBy(SESSION).orderBy(CHANNEL)
    return names.withColumn("channel_index", F.row_number().over(order) - 1)


def only_channels(samples: DataFrame, channels: DataFrame, condition: Column) -> DataFrame:
    """Samples of the channels for which ``condition`` on the name holds.

    A condition on a changed name cannot be checked against Parquet statistics. The catalogue says which spellings occur;
    the semi-join lets Spark broadcast them, or filter the scan by them at run time, by their actual size.
    """
    spellings = channels.filter(condition).select(CHANNEL).distinct()
    return samples.join(spellings, CHANNEL, "left_semi").select(*samples.columns)


# first-match picks


def _first_by_index(channels: DataFrame) -> DataFrame:
    return channels.groupBy(SESSION).agg(F.min_by(CHANNEL, "channel_index").alias(CHANNEL))


def pick_named(channels: DataFrame, names: Sequence[str]) -> DataFrame:
    """First channel of each session whose normalised name is one of ``names``."""
    return _first_by_index(channels.filter(normalised(F.col(CHANNEL)).isin(list(names))))


def pick_gps(channels: DataFrame, parts: Sequence[str]) -> DataFrame:
    """First channel of each session whose normalised name contains ``gps`` and one of ``parts``."""
    return _first_by_index(channels.filter(_is_gps(parts)))


def _is_gps(parts: Sequence[str]) -> Column:
    name = normalised(F.col(CHANNEL))
    any_part = F.lit(False)
    for part in parts:
        any_part = any_part | name.contains(part)
    return name.contains("gps") & any_part


def gps_samples(samples: DataFrame, channels: DataFrame) -> DataFrame:
    """Samples of channels that could be a latitude or longitude."""
    return only_channels(samples, channels, _is_gps([*LATITUDE_PARTS, *LONGITUDE_PARTS]))


def representative_channel(channels: DataFrame) -> DataFrame:
    """First channel of each session named like a speed or engine speed, else the first channel."""
    name = F.lower(F.col(CHANNEL))
    match = F.lit(False)
    for part in REPRESENTATIVE_PARTS:
        match = match | name.contains(part)
    rank = F.struct((~match).alias("other"), F.col("channel_index"))
    return channels.groupBy(SESSION).agg(F.min_by(CHANNEL, rank).alias(CHANNEL))


# catalogue


def full_catalog(physical: DataFrame, computed: DataFrame) -> DataFrame:
    """Physical and computed channels in one table with a ``kind`` column."""
    return physical.withColumn("kind", F.lit("physical")).unionByName(
        computed.withColumn("kind", F.lit("math")), allowMissingColumns=True
    )


def search_catalog(catalog: DataFrame, text: str) -> DataFrame:
    """Channels whose name, or unit for physical ones, contains the text in any letter case; sorted by name."""
    wanted = F.lit(text.lower())
    in_unit = (F.col("kind") == "physical") & F.lower("unit").contains(wanted)
    found = catalog.filter(F.lower(CHANNEL).contains(wanted) | in_unit)
    return found.orderBy(F.col("kind").desc(), F.lower(CHANNEL), CHANNEL)


def name_conflicts(definitions: DataFrame, catalog: DataFrame) -> DataFrame:
    """Definitions whose name another channel of the session already has, in any letter case.

    ``definitions(session_id, def_id, name)``, with whole numbers as ids, conflict with ``catalog(session_id, channel)`` and with definitions of
    another ``def_id``. Empty names never conflict.
    """
    folded = definitions.filter(F.col("name") != "").withColumn("_key", ascii_lower(F.col("name")))
    physical = catalog.select(SESSION, ascii_lower(F.col(CHANNEL)).alias("_key")).distinct()
    taken = spread_join(folded, physical, [SESSION, "_key"], "def_id").select(
        SESSION, "def_id", "name", F.lit("physical").alias("conflicts_with")
    )
    shared = folded.groupBy(SESSION, "_key").agg(
        F.min("def_id").alias("_lo"), F.max("def_id").alias("_hi")
    ).filter(F.col("_lo") < F.col("_hi"))
    repeated = spread_join(folded, shared, [SESSION, "_key"], "def_id").select(
        SESSION, "def_id", "name", F.lit("math").alias("conflicts_with")
    )
    return taken.unionByName(repeated)


def referenced_channels(definitions: DataFrame) -> DataFrame:
    """Sorted distinct channel names of ``definitions(..., refs ARRAY<STRING>)``."""
    return definitions.select(F.explode("refs").alias("ref")).distinct().orderBy("ref")
