"""One query per operator over the test tables, for checks against SQL and for the benchmark."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apexgrid.functions import scalar
from apexgrid.functions.channel import ch, derivative, smooth
from apexgrid.functions.sql import register_functions
from apexgrid.operators import (
    align,
    catalog,
    computed,
    decimate,
    densities,
    distance,
    laps,
    lookup,
    sectors,
    series,
    spectrum,
    stats,
    track,
)
from apexgrid.operators.computed import Definition
from apexgrid.operators.presets import PRESET_NAMES, preset
from apexgrid.plans import tables
from apexgrid.session import materialised
from apexgrid.sources import config, csvfile, motorlog, sidecar

Query = Callable[[SparkSession, str], DataFrame]

# Results are reported on a binary grid: decimal inputs never fall half-way between two of its points,
# so the last digits of a sum do not decide how a value is rounded.
GRID = 20
FINE_GRID = 32  # for squared distances


def rounded(c: str | Column, name: str | None = None, bits: int = GRID) -> Column:
    """Nearest multiple of ``2^-bits``, without negative zero."""
    column = F.col(c) if isinstance(c, str) else c
    out = F.round(column * float(2**bits)) / float(2**bits) + F.lit(0.0)
    return out.alias(name or c) if name or isinstance(c, str) else out


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: rounded(c) for c in columns})


def _laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lap table, written once: the steps after it read it more than once."""
    return materialised(laps.detect_from_timer(tables.timer(spark, sf_dir)))


def _track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialised(track.gps_track(tables.positions(spark, sf_dir)))


# laps and statistics


def lap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = laps.detect_from_timer(tables.timer(spark, sf_dir))
    report = stats.lap_report(tables.samples(spark, sf_dir), found)
    return _round(report, "min_value", "max_value", "avg_value", "std_value")


def laps_from_timer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(laps.detect_from_timer(tables.timer(spark, sf_dir)), "start_time", "end_time")


def laps_from_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(laps.detect_from_number(tables.lap_number(spark, sf_dir)), "start_time", "end_time")


def laps_preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slow sessions (laps over 16 s) log no timer and fall back to the lap number."""
    clock = tables.clock(spark, sf_dir).filter("lap_ms < 16000")
    timer = clock.selectExpr(
        "session_id", "sample_idx", "10 AS freq", "CAST(ms % lap_ms AS DOUBLE) / 1000.0D AS value"
    )
    found = laps.detect_laps(timer, tables.lap_number(spark, sf_dir))
    return _round(found, "start_time", "end_time")


def lap_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = laps.lap_list(laps.detect_from_timer(tables.timer(spark, sf_dir)))
    return _round(listed, "start_time", "end_time", "duration")


def lap_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = laps.detect_from_timer(tables.timer(spark, sf_dir))
    joined = laps.assign_laps(tables.samples(spark, sf_dir), found)
    return joined.select("session_id", "channel", "sample_idx", "number", "name")


def lap_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = laps.detect_from_timer(tables.timer(spark, sf_dir))
    picked = laps.select_lap(found, 1)
    joined = laps.assign_laps(tables.samples(spark, sf_dir), picked)
    return joined.groupBy("session_id", "channel").agg(F.count(F.lit(1)).alias("n_samples"))


def channel_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = stats.channel_summary(tables.samples_nan(spark, sf_dir))
    return _round(summary, "min_value", "max_value", "mean_value")


def channel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.channel_stats(tables.samples_nan(spark, sf_dir))
    return _round(found, "min_value", "max_value", "avg_value", "std_value")


def rate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.rate_counts(stats.catalog_of(tables.samples(spark, sf_dir)))


def session_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(stats.session_duration(stats.catalog_of(tables.samples(spark, sf_dir))), "duration")


def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = stats.session_summary(
        tables.session_headers(spark, sf_dir),
        stats.catalog_of(tables.samples(spark, sf_dir)),
        laps.detect_from_timer(tables.timer(spark, sf_dir)),
    )
    return _round(summary, "duration")


def value_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.value_range(tables.samples_nan(spark, sf_dir), ["session_id", "channel"])


def display_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(stats.display_range(tables.samples_nan(spark, sf_dir)), "y_min", "y_max")


# charts


def minmax_decimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(decimate.decimate(tables.samples(spark, sf_dir), 17), "time")


def minmax_decimate_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(decimate.decimate(tables.samples_nan(spark, sf_dir), 23), "time")


def _speed_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.clock(spark, sf_dir).selectExpr(
        "session_id", "'speed' AS channel", "10 AS freq", "sample_idx", "value"
    )


def time_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decimate.time_window(tables.samples(spark, sf_dir), 1.05, 30.0)


def chart_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = decimate.chart_line(_speed_trace(spark, sf_dir), 5.05, 60.0, 120)
    return _round(line, "time", "value")


def overview_waveform(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _logger_samples(spark, sf_dir)
    picked = catalog.representative_channel(tables.logger_channels(spark, sf_dir))
    return _round(decimate.overview_waveform(named, picked, 40), "time", "low", "high")


def _logger_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = tables.samples(spark, sf_dir)
    return samples.withColumn("channel", tables.logger_name("channel"))


# alignment


def resample_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(align.resample_linear(tables.samples(spark, sf_dir)), "value")


def resample_linear_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(align.resample_linear(tables.samples_nan(spark, sf_dir)), "value")


def resample_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(align.resample_nearest(tables.samples(spark, sf_dir)), "value")


def resample_nearest_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(align.resample_nearest(tables.samples(spark, sf_dir), (1.03, 9.98)), "value")


def output_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = align.output_rate(align.series_facts(tables.samples(spark, sf_dir)))
    return facts.select("session_id", "out_freq", rounded("duration"), "out_len").distinct()


# scalar functions

def _scalars(spark: SparkSession, sf_dir: str, columns: dict[str, Column]) -> DataFrame:
    return tables.pairs(spark, sf_dir).select(
        "session_id", "sample_idx", *(rounded(c, name) for name, c in columns.items())
    )


def math_arith(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    columns = {
        "r_number": F.lit(42.0),
        "r_neg": scalar.neg(a),
        "r_add": scalar.add(a, b),
        "r_sub": scalar.sub(a, b),
        "r_mul": scalar.mul(a, b),
        "r_div": scalar.div(a, b),
        "r_mod": scalar.mod(a, b),
    }
    return _scalars(spark, sf_dir, columns)


def math_compare_logic(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    columns = {
        "r_gt": scalar.gt(a, b),
        "r_lt": scalar.lt(a, b),
        "r_gte": scalar.gte(a, b),
        "r_lte": scalar.lte(a, b),
        "r_eq": scalar.eq(b, 0.5),
        "r_neq": scalar.neq(b, 0.5),
        "r_and": scalar.and_(a, b),
        "r_or": scalar.or_(a, b),
        "r_not": scalar.not_(b),
    }
    return _scalars(spark, sf_dir, columns)


def math_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    columns = {
        "r_abs": scalar.abs_(a),
        "r_sqrt": scalar.sqrt(a),
        "r_sin": scalar.sin(a),
        "r_cos": scalar.cos(a),
        "r_tan": scalar.tan(b),
        "r_asin": scalar.asin(b),
        "r_acos": scalar.acos(b),
        "r_atan": scalar.atan(a),
        "r_log": scalar.log(b),
        "r_ln": scalar.ln(a),
        "r_exp": scalar.exp(b),
        "r_floor": scalar.floor(b),
        "r_ceil": scalar.ceil(b),
        "r_round": scalar.round_(b),
        "r_atan2": scalar.atan2(a, b),
        "r_pow": scalar.pow_(scalar.abs_(a) / 100.0, b),
        "r_min": scalar.min_(a, b),
        "r_max": scalar.max_(a, b),
    }
    return _scalars(spark, sf_dir, columns)


def math_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    columns = {
        "r_gate": scalar.gate(a, b),
        "r_if": scalar.if_then(b, a, -1.0),
        "r_clamp": scalar.clamp(a, -50.0, 75.5),
        "r_clamp_by": scalar.clamp(a, scalar.min_(b, 0.0), scalar.max_(b, 10.0)),
    }
    return _scalars(spark, sf_dir, columns)


CONVERSIONS = [name for name in scalar.FUNCTIONS if "_to_" in name]


def unit_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {f"r_{name}": scalar.FUNCTIONS[name][0]("a") for name in CONVERSIONS}
    return _scalars(spark, sf_dir, columns)


def math_sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same functions called from SQL text."""
    register_functions(spark)
    texts = {
        "r_div": "t_div(a, b)",
        "r_mod": "t_mod(a, b)",
        "r_gt": "t_gt(a, b)",
        "r_neq": "t_neq(b, 0.5D)",
        "r_and": "t_and(a, b)",
        "r_not": "t_not(b)",
        "r_log": "t_log(b)",
        "r_floor": "t_floor(b)",
        "r_min": "t_min(a, b)",
        "r_max": "t_max(a, b)",
        "r_gate": "t_gate(a, b)",
        "r_if": "t_if_then(b, a, -1D)",
        "r_clamp": "t_clamp(a, -50D, 75.5D)",
        "r_c_to_f": "t_c_to_f(a)",
    }
    return _scalars(spark, sf_dir, {name: F.expr(text) for name, text in texts.items()})


def display_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.clock(spark, sf_dir).select(
        "session_id",
        "sample_idx",
        scalar.format_duration(F.col("ms") / 1000.0 + F.col("value") / 1000.0).alias("duration_text"),
        scalar.fixed_text("value", 1).alias("one_decimal"),
        scalar.format_value(F.col("value") - 250.0).alias("value_text"),
    )


# series functions


def _series(op: Callable[..., DataFrame], spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    found = op(tables.samples_nan(spark, sf_dir), out="result", **options)
    return found.select("session_id", "channel", "sample_idx", rounded("result"))


def series_forward_fill(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """Gaps of every third sample and longer ones hold the value before them."""
    gap = (F.col("sample_idx") % 3 == 1) | (F.col("sample_idx") % 40 < 12)
    nan = F.lit(float("nan"))
    gappy = tables.samples(spark, sf_dir).withColumn("value", F.when(gap, nan).otherwise(F.col("value")))
    return series.forward_fill(gappy, ~F.isnan("value"), ["value"], ["session_id", "channel"], **options)


def series_smooth_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = series.smooth(_speed_trace(spark, sf_dir), 100, out="result")
    return found.select("session_id", "sample_idx", rounded("result"))


def series_smooth_by_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window width is the first sample of another channel."""
    width = smooth(ch("GPS_Speed"), ch("Throttle_Pos") + 7.9)
    frame = computed.evaluate_wide(tables.vehicle(spark, sf_dir), [Definition("result", width)])
    return frame.select("session_id", "sample_idx", rounded("result"))


def series_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = Definition.from_text("result", "abs(derivative(smooth(GPS_Speed, 5)))")
    frame = computed.evaluate_wide(tables.vehicle(spark, sf_dir), [nested])
    return frame.select("session_id", "sample_idx", rounded("result"))


# computed channels


def _template(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = computed.evaluate_wide(tables.vehicle(spark, sf_dir), [preset(name)])
    return frame.select("session_id", "sample_idx", rounded(F.col(f"`{name}`"), "value"))


def computed_mixed_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels of 20 and 5 Hz, one of them by alias."""
    spread = Definition("Spread", (ch("V") - ch("Purchase")) * 2)
    rows, _ = computed.evaluate(tables.samples(spark, sf_dir), spread, {"V": "view"})
    return _round(rows, "value")


def _chain() -> list[Definition]:
    return [
        Definition("Slope", derivative(ch("Doubled"))),
        Definition("Doubled", ch("click") * 2),
        Definition("Broken", ch("Doubled") + ch("Oil Temp")),
        Definition("Loop A", ch("Loop B") + 1),
        Definition("Loop B", ch("Loop A") + 1),
        Definition.from_text("Constant", "42"),
    ]


def computed_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = computed.evaluate_all(tables.samples(spark, sf_dir), _chain())
    return _round(rows, "value")


def computed_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, errors = computed.evaluate_all(tables.samples(spark, sf_dir), _chain())
    return errors


def _shared(spark: SparkSession, sf_dir: str, **options) -> tuple[DataFrame, DataFrame]:
    """Definitions of one stage on three grids: names that differ in letter case, a channel called like a key column, a series function
    that occurs twice, an unreadable text and an unknown channel."""
    named = F.when(F.col("channel") == "signup", "freq").otherwise(F.col("channel"))
    texts = {
        "Same": "view - VIEW",
        "Plus": "freq + 1",
        "Mix": "click + purchase",
        "Mean": "smooth(click + purchase, 4)",
        "Mean Twice": "2 * smooth(click + purchase, 4)",
        "Bad": "sin(click, 1)",
        "Gone": "click + nothing",
    }
    definitions = [Definition.lenient(name, text) for name, text in texts.items()]
    return computed.evaluate_all(tables.samples(spark, sf_dir).withColumn("channel", named), definitions, **options)


def computed_shared(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    rows, _ = _shared(spark, sf_dir, **options)
    return _round(rows, "value")


def computed_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shared(spark, sf_dir)[1]


def _stored(headers: DataFrame, text: Column) -> DataFrame:
    """A configuration per session, written once. Unwritten, the filters on the parsed texts would go below the grouping by session and parse a
    text per event."""
    return materialised(headers.select(F.col("session_id").cast("string").alias("path"), text.alias("json")))


def _configured(spark: SparkSession, sf_dir: str, **options) -> tuple[DataFrame, DataFrame]:
    """Three configurations: one text under two aliases and without, a name computed in a later stage here and at once or not at all there, two
    texts under one name, a circle, an unreadable text."""
    channel = '{"name": "%s", "expression": "%s", "unit": "", "dec_places": 2}'
    shapes = [
        ('{"alias": "V", "target": "view"}', {"Twice": "V * 2", "Slope": "Twice * 3 + 1", "Mean": "smooth(V, 4)"}),
        ('{"alias": "V", "target": "click"}, {"alias": "v", "target": "view"}', {"Twice": "V * 2", "Slope": "V - 1", "Round": "Slope + Turn", "Turn": "Round"}),
        ("", {"Twice": "V * 2", "Mean": "smooth(purchase, 4)", "Bad": "sin(click, 1)", "Slope": "click - 1"}),
    ]
    texts = [
        F.lit('{"channel_aliases": [' + names + '], "math_channels": [' + ", ".join(channel % d for d in found.items()) + "]}")
        for names, found in shapes
    ]
    k = F.col("session_id")
    text = F.when(k % 3 == 0, texts[0]).when(k % 3 == 1, texts[1]).otherwise(F.replace(texts[2], F.lit("Mean"), F.when(k % 2 == 0, F.lit("Slope")).otherwise(F.lit("Mean"))))
    configs = config.parse_configs(_stored(tables.session_headers(spark, sf_dir), text))
    own = F.col("path").cast("bigint").alias("session_id")
    definitions = config.channel_defs(configs).select(own, "name", "expression")
    aliases = config.aliases(configs).select(own, "alias", "target")
    return computed.evaluate_configured(materialised(tables.samples(spark, sf_dir)), definitions, aliases, **options)


def configured_channels(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """From the text of a configuration for each session to its own computed channels."""
    return _round(_configured(spark, sf_dir, **options)[0], "value")


def configured_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _configured(spark, sf_dir)[1]


def computed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = computed.evaluate(tables.samples_nan(spark, sf_dir), Definition("Twice", ch("click") * 2))
    return _round(computed.computed_stats(rows), "min_value", "max_value", "avg_value")


# lookups


def cursor_readout(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lookup.values_at(tables.samples(spark, sf_dir), tables.probes(spark, sf_dir))
    return _round(found, "t", "value")


def track_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lookup.positions_at(_track(spark, sf_dir), tables.probes(spark, sf_dir))
    return _round(found, "t", "x", "y")


def nearest_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = tables.picks(spark, sf_dir).withColumnRenamed("pick_no", "probe_id")
    found = lookup.nearest_position(_track(spark, sf_dir), probes)
    return found.select("session_id", "probe_id", "sample_idx", rounded("dist2", bits=FINE_GRID))


# catalogue

REFS = ["GPS Speed", "gps_speed", "Engine_RPM", "Revs", "rEVS", "GPS_Long", "Velocity", "Oil_Temp", "lap number"]
ALIASES = {"Revs": "Engine.RPM", "Velocity": "GPS Speed", "Oil Temp": "Missing", "lap number": "Lap_Number"}


def resolve_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.resolve_names(
        tables.logger_channels(spark, sf_dir),
        catalog.refs_frame(spark, REFS),
        catalog.aliases_frame(spark, ALIASES),
    )


def alias_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as references, resolved through aliases made of the logger names."""
    channels = tables.logger_channels(spark, sf_dir)
    refs = tables.events(spark, sf_dir).select(F.initcap("event_type").alias("ref")).distinct()
    aliases = channels.select(
        F.lower(F.substring_index(F.translate("channel", "._", "  "), " ", -1)).alias("alias"),
        F.col("channel").alias("target"),
    ).distinct()
    extra = tables.events(spark, sf_dir).select(
        F.col("event_type").alias("alias"), F.concat(F.lit("Event "), F.col("event_type")).alias("target")
    ).distinct()
    return catalog.resolve_alias_targets(refs, aliases.unionByName(extra))


def channel_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    channels = tables.logger_channels(spark, sf_dir)
    picks = {
        "lap number": catalog.pick_named(channels, laps.NUMBER_NAMES),
        "latitude": catalog.pick_gps(channels, catalog.LATITUDE_PARTS),
        "longitude": catalog.pick_gps(channels, catalog.LONGITUDE_PARTS),
        "representative": catalog.representative_channel(channels),
    }
    tagged = [df.withColumn("role", F.lit(role)) for role, df in picks.items()]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).unionByName(tagged[3])


def same_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics where a session has three channels called Speed, told apart by their index."""
    samples = tables.samples(spark, sf_dir)
    first = tables.logger_channels(spark, sf_dir)
    shared = {"GPS Speed", "Engine.RPM", "Lap_Number"}
    channels = first.select(
        "session_id", "channel_index", F.col("channel").alias("_own"), F.when(F.col("channel").isin(*shared), "Speed").otherwise(F.col("channel")).alias("channel"),
        "n_data",
    )
    named = samples.withColumn("_own", tables.logger_name("channel")).drop("channel")
    stored = named.join(channels.select("session_id", "_own", "channel_index", "channel"), ["session_id", "_own"])
    stored = stored.select("session_id", "channel_index", "channel", "freq", "sample_idx", "value")
    return _round(stats.channel_stats(catalog.by_series(stored, channels)), "min_value", "max_value", "avg_value", "std_value")


def catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    channels = tables.logger_channels(spark, sf_dir)
    computed_channels = channels.select(
        "session_id", F.concat(F.lit("Deg "), F.col("channel")).alias("channel"), F.lit("deg").alias("unit")
    )
    everything = catalog.full_catalog(channels.select("session_id", "channel", "unit"), computed_channels)
    return catalog.search_catalog(everything, "DEG")


def _definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A definition per customer segment and nation, named by segment, with its region and nation as references."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("n_regionkey").cast("bigint").alias("session_id"),
            F.col("c_custkey").alias("def_id"),
            F.initcap("c_mktsegment").alias("name"),
            F.array(F.col("c_mktsegment"), F.col("n_name")).alias("refs"),
        )
    )


def name_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    defs = _definitions(spark, sf_dir)
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    physical = nation.select(
        F.col("n_regionkey").cast("bigint").alias("session_id"), F.col("n_name").alias("channel")
    )
    named = defs.withColumn(
        "name", F.when(F.col("def_id") % 3 == 0, F.initcap(F.col("refs")[1])).otherwise(
            F.concat(F.col("name"), F.lit(" "), F.col("def_id") % 11)
        )
    )
    return catalog.name_conflicts(named, physical)


def referenced_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.referenced_channels(_definitions(spark, sf_dir))


# track and sectors


def gps_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = track.gps_track(tables.positions(spark, sf_dir))
    return found.select("session_id", "sample_idx", rounded("time"), rounded("x"), rounded("y"))


def gps_track_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two separate channels with gaps, found by name."""
    wide = tables.timing(spark, sf_dir)
    nan = F.lit(float("nan"))
    lat = wide.select(
        "session_id", F.lit("GPS Latitude").alias("channel"), "freq", "sample_idx",
        F.when((F.col("sample_idx") % 53).isin(0, 1, 7), nan).otherwise(F.col("lat")).alias("value"),
    )
    lon = wide.select(
        "session_id", F.lit("GPS.Long").alias("channel"), "freq", "sample_idx",
        F.when(F.col("sample_idx") % 41 == 5, nan).otherwise(F.col("lon")).alias("value"),
    )
    both = lat.unionByName(lon)
    positions = track.gps_positions(both, catalog.channel_indexes(both))
    found = track.gps_track(positions)
    return found.select("session_id", "sample_idx", rounded("time"), rounded("x"), rounded("y"))


def track_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    colored = track.track_color(tables.samples(spark, sf_dir), tables.positions(spark, sf_dir))
    return _round(colored, "value", "vmin", "vmax")


def track_color_by_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    colored = track.track_color(tables.samples(spark, sf_dir), tables.positions(spark, sf_dir), channel="click")
    return _round(colored, "value", "vmin", "vmax")


def color_legend(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = stats.value_range(tables.samples(spark, sf_dir), ["session_id", "channel"])
    return _round(track.color_legend(ranges), "value")


def sector_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = sectors.sector_times(
        _track(spark, sf_dir),
        _laps(spark, sf_dir),
        tables.SECTORS,
    )
    return _round(times, "time_secs")


def crossing_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    crossed = sectors.crossing_times(
        _track(spark, sf_dir),
        _laps(spark, sf_dir),
        [0, 75, 10**9],
    )
    times = {"at_0": "at_0", "at_75": "at_75", f"at_{10**9}": "at_beyond"}
    return crossed.select("session_id", "number", *(rounded(F.col(c), name) for c, name in times.items()))


def sector_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = sectors.sector_report(
        _track(spark, sf_dir),
        _laps(spark, sf_dir),
        tables.SECTORS,
        reference_lap=1,
    )
    return _round(report, "time_secs", "ref_secs", "delta")


def define_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sectors.define_sectors(
        _track(spark, sf_dir), tables.picks(spark, sf_dir)
    )


# sources and sinks


def scale_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every channel with its own factors, among them a scale of 0."""
    raw = tables.samples(spark, sf_dir)
    k = F.col("n_data") + F.col("session_id")
    channels = stats.catalog_of(raw).select(
        "session_id",
        "channel",
        "n_data",
        (k % 5).cast("smallint").alias("scale"),
        (k % 4 - 1).cast("smallint").alias("dec_places"),
        (k % 7 - 3).cast("smallint").alias("shift"),
        (k % 3 + 1).cast("smallint").alias("mul"),
    )
    return _round(motorlog.scale_samples(raw, channels), "value")


def clean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part descriptions as stored channel strings."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    stored = part.select(
        "p_partkey",
        F.translate(F.concat_ws(".", "p_name", "p_brand"), " #", ".").alias("raw_name"),
        F.when(F.col("p_size") % 4 == 0, "").when(F.col("p_size") % 4 == 1, "%").otherwise(
            F.substring("p_type", 1, F.lit(1) + F.col("p_size") % 3)
        ).alias("raw_short"),
        F.when(F.col("p_partkey") % 3 == 0, F.lower(F.substring("p_type", 1, 3))).otherwise("").alias("raw_unit"),
        (F.col("p_partkey") % 2 == 0).alias("name_filled"),
    )
    return catalog.clean_names(stored).select("p_partkey", "name", "short_name", "unit")


def csv_rows(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    rows = csvfile.csv_rows(tables.samples(spark, sf_dir), {"click": 2, "purchase": 1, "signup": 0}, **options)
    return rows.withColumnRenamed(csvfile.TIME_HEADER, "time_text")


def csv_rows_window(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    rows = csvfile.csv_rows(tables.samples(spark, sf_dir), {"purchase": 1, "error": 3}, (1.1, 7.7), **options)
    return rows.withColumnRenamed(csvfile.TIME_HEADER, "time_text")


def csv_rows_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimals from the catalogue; they differ by session and are unknown or negative for some."""
    samples = tables.samples(spark, sf_dir)
    places = F.when(F.col("channel") == "click", F.col("session_id") % 4 - 1).when(F.col("session_id") % 5 > 0, 2)
    channels = stats.catalog_of(samples).withColumn("dec_places", places.cast("smallint"))
    rows = csvfile.csv_rows(samples, ["click", "signup"], catalog=channels)
    return rows.withColumnRenamed(csvfile.TIME_HEADER, "time_text")


def _sidecar_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sidecar texts with all laps of a session as markers; every third session's lack totals or are cut short."""
    found = laps.detect_from_timer(tables.timer(spark, sf_dir))
    marker = F.concat(
        F.lit('<MarkerPair Time="'), F.col("start_time"), F.lit('" Color="7" EndTime="'), F.col("end_time"), F.lit('"/>')
    )
    per_session = found.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("number", marker.alias("m")))).alias("ms")
    )
    totals = F.when(F.col("session_id") % 3 == 1, F.lit("")).otherwise(
        F.concat(
            F.lit('<String Id="Total Laps" Value="0"/><String Id="Fastest Time" Value="1:0'),
            F.col("n"),
            F.lit('.5 &amp; up"/>\n <String Value="'),
            F.col("n"),
            F.lit('" Id="Total Laps"/><String Id="Fastest Lap" Value="n/a"/>'),
        )
    )
    closing = F.when(F.col("session_id") % 3 == 2, F.lit("</Layers>")).otherwise(F.lit("</Layers></LDXFile>"))
    xml = F.concat(
        F.lit('<?xml version="1.0"?>\n<LDXFile Version="1.6">\n<Layers><!-- <String Id="Total Laps" Value="9"/> -->'),
        totals,
        F.concat_ws("\n", F.transform("ms", lambda m: m["m"])),
        closing,
    )
    name = F.concat(F.col("session_id"), F.lit("/0.ldx"))
    return per_session.select(name.alias("path"), xml.alias("xml"))


def sidecar_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = tables.session_headers(spark, sf_dir).select(
        F.concat(F.col("session_id"), F.lit("/0")).alias("session_id"), "driver"
    )
    return sidecar.with_sidecars(headers, sidecar.parse_sidecars(_sidecar_files(spark, sf_dir)))


def sidecar_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sidecar.marker_laps(sidecar.parse_sidecars(_sidecar_files(spark, sf_dir)))
    return _round(found, "start_time", "end_time")


def sidecar_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sidecar.malformed_sidecars(_sidecar_files(spark, sf_dir))


def _configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored configuration per customer, some without optional parts."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    text = F.concat(
        F.lit('{"worksheets": [{"name": "Main"}], "active_worksheet": 0, "math_channels": [{"name": "'),
        F.col("c_name"),
        F.lit('", "expression": "\\"GPS Speed\\" * '),
        F.col("c_nationkey"),
        F.lit('", "unit": "km/h", "dec_places": 1}, {"name": "Twice", "expression": "Speed * 2", "unit": "", "dec_places": 0}]'),
        F.when(
            F.col("c_custkey") % 2 == 0,
            F.concat(
                F.lit(', "channel_aliases": [{"alias": "Seg", "target": "old"}, {"alias": "Seg", "target": "'),
                F.col("c_mktsegment"),
                F.lit('"}], "sectors": [{"name": "S1", "start_index": 0, "end_index": '),
                F.col("c_custkey"),
                F.lit('}], "reference_lap": 1'),
            ),
        ).otherwise(""),
        F.lit("}"),
    )
    files = customer.select(F.concat(F.col("c_custkey"), F.lit(".json")).alias("path"), text.alias("json"))
    return config.parse_configs(files)


def config_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts of the configurations in one list."""
    found = _configs(spark, sf_dir)
    defs = config.channel_defs(found).select(
        "path", F.lit("definition").alias("kind"), "name", F.col("expression").alias("detail")
    )
    aliases = config.aliases(found).select("path", F.lit("alias"), "alias", "target")
    sections = config.sectors(found).select("path", F.lit("sector"), "name", F.col("end_index").cast("string"))
    reference = config.reference_laps(found).select(
        "path", F.lit("reference"), F.lit("lap"), F.coalesce(F.col("reference_lap").cast("string"), F.lit("none"))
    )
    return defs.union(aliases).union(sections).union(reference)


def configured_report(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """From the text of a configuration for each session to its sector report: sectors and reference lap differ by session, some have no reference lap."""
    k = F.col("session_id")
    text = F.concat(
        F.lit('{"math_channels": [], "sectors": [{"name": "Start", "start_index": 0, "end_index": '), k % 7 + 40,
        F.lit('}, {"name": "Back", "start_index": '), k % 7 + 40, F.lit(', "end_index": '), k % 5 + 90,
        F.lit('}, {"name": "Far", "start_index": '), k % 5 + 90, F.lit(', "end_index": 100000}]'),
        F.when(k % 4 == 3, F.lit("")).otherwise(F.concat(F.lit(', "reference_lap": '), k % 3 + 1)), F.lit("}"),
    )
    found = config.parse_configs(_stored(tables.session_headers(spark, sf_dir), text))
    own = F.col("path").cast("bigint").alias("session_id")
    drawn = config.sectors(found).select(own, "sector_no", "name", "start_index", "end_index")
    references = config.reference_laps(found).select(own, "reference_lap")
    report = sectors.configured_report(_track(spark, sf_dir), _laps(spark, sf_dir), drawn, references, **options)
    return _round(report, "time_secs", "ref_secs", "delta")


# extensions


def distance_axis(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    found = distance.distance_axis(tables.vehicle(spark, sf_dir), "GPS_Speed", ["Throttle_Pos"], 25.0, **options)
    return found.select("session_id", "slot", "distance", rounded("time"), rounded("Throttle_Pos", "value"))


def lap_overlay(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """Every lap of every session over lap 1 of session 0."""
    vehicle = tables.vehicle(spark, sf_dir).select("session_id", "sample_idx", "freq", "GPS_Speed", "Steering_Angle")
    found = distance.overlay(vehicle, _laps(spark, sf_dir), "GPS_Speed", ["Steering_Angle"], (0, 1), 50, **options)
    return found.select(
        "session_id", "number", "name", "slot", rounded("time"), rounded("time_delta"),
        rounded("Steering_Angle", "value"), rounded("ref_Steering_Angle", "ref_value"),
    )


def lap_stretching(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = distance.stretched(_track(spark, sf_dir), _laps(spark, sf_dir), [50, 100], 1)
    return _round(found, "time", "ref_time", "gain")


def lap_histogram(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    found = densities.lap_histogram(tables.samples_nan(spark, sf_dir), _laps(spark, sf_dir), 12, **options)
    return _round(found, "low", "high")


def mixture_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = densities.mixture_map(tables.vehicle(spark, sf_dir), "GPS_Speed", "Throttle_Pos", "Yaw_Rate", (25.0, 10.0), 2)
    return _round(found, "z_mean")


def scatter(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    found = densities.scatter(tables.vehicle(spark, sf_dir), "G_Force_Lat", "GPS_Speed", (8, 10), **options)
    return _round(found, "x", "y")


def power_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(spectrum.spectrum(tables.samples(spark, sf_dir), 16), "frequency", "power")


# the same operators with chunks so small that every series of the fixtures crosses many of their borders

SMALL = 32


def _small_chunks() -> dict[str, Query]:
    def laps_small(spark, sf_dir):
        return laps.detect_from_timer(tables.timer(spark, sf_dir), SMALL)

    def series_small(operator, spark, sf_dir, **options):
        found = operator(_speed_trace(spark, sf_dir), out="result", chunk_rows=SMALL, **options)
        return found.select("session_id", "sample_idx", rounded("result"))

    def track_small(spark, sf_dir):
        return track.gps_track(tables.positions(spark, sf_dir), SMALL)

    return {
        "lap_report": lambda spark, sf_dir: _round(
            stats.lap_report(tables.samples(spark, sf_dir), laps_small(spark, sf_dir)),
            "min_value", "max_value", "avg_value", "std_value",
        ),
        "laps_from_timer": lambda spark, sf_dir: _round(laps_small(spark, sf_dir), "start_time", "end_time"),
        "series_smooth_wide": partial(series_small, series.smooth, window=100),
        "resample_linear": lambda spark, sf_dir: _round(
            align.resample_linear(tables.samples(spark, sf_dir), chunk_rows=SMALL), "value"
        ),
        "resample_nearest": lambda spark, sf_dir: _round(
            align.resample_nearest(tables.samples(spark, sf_dir), chunk_rows=SMALL), "value"
        ),
        "minmax_decimate": lambda spark, sf_dir: _round(decimate.decimate(tables.samples(spark, sf_dir), 17, SMALL), "time"),
        "gps_track": lambda spark, sf_dir: track_small(spark, sf_dir).select(
            "session_id", "sample_idx", rounded("time"), rounded("x"), rounded("y")
        ),
        "track_color": lambda spark, sf_dir: _round(
            track.track_color(tables.samples(spark, sf_dir), tables.positions(spark, sf_dir), SMALL), "value", "vmin", "vmax"
        ),
        "sector_times": lambda spark, sf_dir: _round(
            sectors.sector_times(track_small(spark, sf_dir), laps_small(spark, sf_dir), tables.SECTORS), "time_secs"
        ),
        "series_forward_fill": partial(series_forward_fill, chunk_rows=SMALL),
        "series_smooth": partial(_series, series.smooth, window=5, chunk_rows=SMALL),
        "series_derivative": partial(_series, series.derivative, chunk_rows=SMALL),
        "series_integrate": partial(_series, series.integrate, chunk_rows=SMALL),
        "configured_report": partial(configured_report, chunk_rows=2),
        "distance_axis": partial(distance_axis, chunk_rows=SMALL),
        "lap_overlay": partial(lap_overlay, chunk_rows=SMALL),
        "lap_histogram": partial(lap_histogram, chunk_rows=SMALL),
        "scatter": partial(scatter, chunk_rows=SMALL),
        "computed_shared": partial(computed_shared, chunk_rows=SMALL, seconds=3),
        "configured_channels": partial(configured_channels, chunk_rows=SMALL, seconds=3),
        "csv_rows": partial(csv_rows, seconds=2),
        "csv_rows_window": partial(csv_rows_window, seconds=2),
    }


def queries() -> dict[str, Query]:
    plain = [
        lap_report,
        laps_from_timer,
        laps_from_number,
        laps_preferred,
        lap_list,
        lap_samples,
        lap_selection,
        channel_summary,
        channel_stats,
        rate_counts,
        session_duration,
        session_summary,
        value_range,
        display_range,
        minmax_decimate,
        minmax_decimate_gaps,
        time_window,
        chart_line,
        overview_waveform,
        resample_linear,
        resample_linear_gaps,
        resample_nearest,
        resample_nearest_window,
        output_rates,
        math_arith,
        math_compare_logic,
        math_functions,
        math_gate,
        unit_conversions,
        math_sql_functions,
        display_formats,
        series_forward_fill,
        series_smooth_wide,
        series_smooth_by_channel,
        series_nested,
        computed_mixed_rates,
        computed_chain,
        computed_errors,
        computed_shared,
        computed_faults,
        computed_stats,
        cursor_readout,
        track_position,
        nearest_position,
        resolve_names,
        alias_targets,
        channel_picks,
        same_names,
        catalog_search,
        name_conflicts,
        referenced_channels,
        gps_track,
        gps_track_gaps,
        track_color,
        track_color_by_channel,
        color_legend,
        sector_times,
        crossing_times,
        sector_report,
        define_sectors,
        scale_samples,
        clean_names,
        csv_rows,
        csv_rows_window,
        csv_rows_catalog,
        sidecar_totals,
        sidecar_markers,
        sidecar_errors,
        config_tables,
        configured_channels,
        configured_faults,
        configured_report,
        distance_axis,
        lap_overlay,
        lap_stretching,
        lap_histogram,
        mixture_map,
        scatter,
        power_spectrum,
    ]
    found: dict[str, Query] = {q.__name__: q for q in plain}
    found["series_smooth"] = partial(_series, series.smooth, window=5)
    found["series_derivative"] = partial(_series, series.derivative)
    found["series_integrate"] = partial(_series, series.integrate)
    for name in PRESET_NAMES:
        key = name.lower().replace(" ", "_").replace("-", "_")
        found[f"template_{key}"] = partial(_template, name)
    return found | {f"{name}_small_chunks": q for name, q in _small_chunks().items()}
