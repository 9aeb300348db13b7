"""Evaluating computed channels over sessions.

Definitions are evaluated in stages: those of a stage refer to no pending one. A stage is one pass. Its definitions' channels are resolved
together, the samples of all of them are shuffled once by time slice (:mod:`apexgrid.operators.slices`), and definitions whose grid - rate
and length - agrees in a session read the same aligned rows of it. Repeated series functions are worked out once.

A definition never stops the others: a text that cannot be read, a name without channel, channels without samples and definitions
in a circle become rows of ``errors``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apexgrid.chunking import CHUNK, CHUNK_ROWS, CORE
from apexgrid.functions.channel import Ch, quoted, ref_column, shared_steps
from apexgrid.functions.text import from_text
from apexgrid.operators import slices
from apexgrid.operators.align import OUT_FREQ, OUT_IDX
from apexgrid.operators.catalog import aliases_frame, ascii_lower, only_channels, refs_frame, resolve_names
from apexgrid.operators.series import add_steps, halo_of
from apexgrid.operators.stats import channel_stats
from apexgrid.schema import CHANNEL, FREQ, IDX, SERIES, SESSION, VALUE
from apexgrid.session import materialised

TWICE = "more than one channel is defined under this name"
NO_DATA = "none of its channels has samples"
#: columns of the aligned frame, which SQL texts cannot use as channel names
RESERVED = {SESSION, OUT_IDX, FREQ, "out_len", CHUNK, CORE}
GRID = (SESSION, FREQ, "out_len")
#: definitions, or references, that one BIGINT of flags covers
FLAGS = 62
LAST_INDEX = 2**31 - 1


@dataclass(frozen=True, eq=False)
class Definition:
    """A named computed channel; without a ``channel`` it has a ``problem``, and evaluates to an error."""

    name: str
    channel: Ch | None
    unit: str = ""
    dec_places: int = 2
    category: str = ""
    problem: str | None = None
    text: str | None = None

    @classmethod
    def from_text(cls, name: str, expression: str, unit: str = "", dec_places: int = 2) -> Definition:
        return cls(name, from_text(expression), unit, dec_places, text=expression)

    @classmethod
    def lenient(cls, name: str, expression: str, unit: str = "", dec_places: int = 2) -> Definition:
        """As :meth:`from_text`, but what is wrong with the text is kept for the errors of the evaluation."""
        try:
            return cls.from_text(name, expression or "", unit, dec_places)
        except ValueError as error:
            return cls(name, None, unit, dec_places, problem=str(error), text=expression or "")

    @property
    def refs(self) -> tuple[str, ...]:
        return self.channel.refs if self.channel is not None else ()

    def fault(self) -> str | None:
        """What keeps the definition from being planned at all."""
        if self.channel is None:
            return self.problem or "there is no expression"
        lowered = [n.lower() for n in self.channel.named]
        if RESERVED.intersection(lowered) or len(set(lowered)) < len(lowered):
            return f"SQL text cannot tell these channel names apart: {sorted(self.channel.named)}"
        return None


def wanted_names(refs: Sequence[str], aliases: Mapping[str, str]) -> list[str]:
    """Every channel name, in lower case, that the references could mean."""
    names = [*refs, *aliases.values()]
    forms = {f for n in names for f in (n, n.replace("_", " "), n.replace("_", "."))}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return sorted(f.translate(lower) for f in forms)


def evaluate(
    samples: DataFrame,
    definition: Definition,
    aliases: Mapping[str, str] | None = None,
    catalog: DataFrame | None = None,
    chunk_rows: int = CHUNK_ROWS,
    seconds: int = slices.SLICE_SECONDS,
) -> tuple[DataFrame, DataFrame]:
    """One computed channel over all sessions: ``(rows, errors)``.

    ``rows`` has the layout of ``samples``; ``errors(session_id, name, message)`` lists sessions that lack a channel or
    any data. ``catalog(session_id, channel, channel_index, n_data)`` defaults to the channels of ``samples``; given,
    it also lets the scan skip other channels. Only samples of channels the expression can mean are shuffled, once and before they are
    resampled; series functions nested in others add one shuffle each.
    """
    samples = samples.select(*SERIES, FREQ, IDX, VALUE)
    sessions = (samples if catalog is None else catalog).select(SESSION).distinct()
    if definition.fault() or not definition.refs:
        return _no_rows(samples), _errors(sessions, definition.name, F.lit(definition.fault() or NO_DATA))
    aliases = dict(aliases or {})
    wanted = ascii_lower(F.col(CHANNEL)).isin(wanted_names(definition.refs, aliases))
    candidates = samples.filter(wanted) if catalog is None else only_channels(samples, catalog, wanted)
    heads = slices.series_heads(candidates)
    known = _catalog_of(heads) if catalog is None else catalog
    return _stage(candidates, heads, known, sessions, [definition], aliases, chunk_rows, seconds)


def evaluate_all(
    samples: DataFrame,
    definitions: Sequence[Definition],
    aliases: Mapping[str, str] | None = None,
    chunk_rows: int = CHUNK_ROWS,
    seconds: int = slices.SLICE_SECONDS,
) -> tuple[DataFrame, DataFrame]:
    """All definitions, each after the ones it names exactly: ``(rows, errors)``.

    Lengths and last values of the series are taken once, and samples are read once per stage. Only a stage that later ones refer to is
    written down.
    """
    aliases = dict(aliases or {})
    samples = samples.select(*SERIES, FREQ, IDX, VALUE)
    faults = {d.name: fault for d in definitions if (fault := d.fault()) is not None}
    stages, cyclic = _stages([d for d in definitions if d.fault() is None])
    heads = materialised(slices.series_heads(samples))
    sessions = heads.select(SESSION).distinct()
    rows, errors = _run(samples, heads, stages, [sessions] * len(stages), aliases, chunk_rows, seconds)
    circle = {d.name for d in cyclic}
    faults |= {d.name: f"no channel is named '{next(r for r in d.refs if r in circle)}'" for d in cyclic}
    if faults:
        pairs = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(m).alias("message")) for n, m in faults.items()))
        errors.append(sessions.select(SESSION, F.inline(pairs)))
    return (
        reduce(DataFrame.unionByName, rows) if rows else _no_rows(samples),
        reduce(DataFrame.unionByName, errors) if errors else _errors(sessions.limit(0), "", F.lit("")),
    )


def evaluate_configured(
    samples: DataFrame,
    definitions: DataFrame,
    aliases: DataFrame | None = None,
    chunk_rows: int = CHUNK_ROWS,
    seconds: int = slices.SLICE_SECONDS,
) -> tuple[DataFrame, DataFrame]:
    """Each session's own definitions with its own aliases, all in one run: ``(rows, errors)`` as of :func:`evaluate_all`.

    ``definitions(session_id, name, expression)`` and ``aliases(session_id, alias, target)`` are what the sessions' configurations hold. Equal
    definitions of different sessions are planned once, so the plan grows with the different texts, written by hand, and not with the sessions.
    A definition's stage follows from the other definitions of its session: what is a computed channel in one session may be a logged one, or none,
    in another.

    Cases: repeated rows are one definition; two texts under one name are an error of their session; a null name or text is an empty one; definitions of
    sessions without samples are passed over; sessions without definitions give no rows.
    """
    samples = samples.select(*SERIES, FREQ, IDX, VALUE)
    spark = samples.sparkSession
    heads = materialised(slices.series_heads(samples))
    own = definitions.select(SESSION, *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("name", "expression")))
    own = materialised(own.join(heads, SESSION, "left_semi").distinct())
    texts = [Definition.lenient(*row) for row in own.select("name", "expression").distinct().orderBy("name", "expression").toLocalIterator()]
    plan = materialised(_planned(own, texts))
    known = plan.select(F.explode("placed").alias("p")).select("p.stage", "p.no").distinct()
    numbers: dict[int, list[int]] = {}
    for stage, no in known.orderBy("stage", "no").toLocalIterator():
        numbers.setdefault(stage, []).append(no)
    taking_part = [
        plan.select(SESSION, F.transform(F.filter("placed", lambda p: p["stage"] == s), lambda p: F.array_position(F.lit(nos), p["no"]) - 1).alias("nos"))
        for s, nos in numbers.items()
    ]
    given = aliases_frame(spark, aliases if aliases is not None else {})
    stages = [[texts[no] for no in nos] for nos in numbers.values()]
    sessions = [t.filter(F.size("nos") > 0) for t in taking_part]
    rows, errors = _run(samples, heads, stages, sessions, given, chunk_rows, seconds)
    errors.append(plan.select(SESSION, F.inline("faults")))
    return reduce(DataFrame.unionByName, rows) if rows else _no_rows(samples), reduce(DataFrame.unionByName, errors)


def _planned(own: DataFrame, texts: Sequence[Definition]) -> DataFrame:
    """Per session: ``placed``, the numbers of its definitions with the stage of each, and ``faults``, what is wrong with the others."""
    spark = own.sparkSession
    facts = pa.table(
        {
            "no": pa.array(range(len(texts)), pa.int32()),
            "name": pa.array([d.name for d in texts], pa.string()),
            "expression": pa.array([d.text for d in texts], pa.string()),
            "refs": pa.array([list(d.refs) for d in texts], pa.list_(pa.string())),
            "fault": pa.array([d.fault() for d in texts], pa.string()),
        }
    )
    twice = F.when(F.count("*").over(Window.partitionBy(SESSION, "name")) > 1, F.lit(TWICE))
    known = own.join(spark.createDataFrame(facts), ["name", "expression"]).withColumn("fault", F.coalesce(twice, "fault"))
    sound = F.col("fault").isNull()
    listed = known.groupBy(SESSION).agg(
        F.sort_array(F.collect_list(F.when(sound, F.struct("no", "name", "refs")))).alias("defs"),
        F.collect_set(F.when(~sound, F.struct("name", F.col("fault").alias("message")))).alias("bad"),
    )

    def pending(waiting: Column, d: Column) -> Column:
        return F.filter(d["refs"], lambda r: F.exists(waiting, lambda w: w["name"] == r))

    def step(state: Column, number: Column) -> Column:
        waiting = state["waiting"]
        ready = F.filter(waiting, lambda d: F.size(pending(waiting, d)) == 0)
        return F.struct(
            F.filter(waiting, lambda d: F.size(pending(waiting, d)) > 0).alias("waiting"),
            F.concat(state["placed"], F.transform(ready, lambda d: F.struct(d["no"].alias("no"), number.alias("stage")))).alias("placed"),
        )

    rounds = F.slice(F.sequence(F.lit(0), F.size("defs")), F.lit(1), F.size("defs"))
    start = F.struct(F.col("defs").alias("waiting"), F.array().cast("array<struct<no:int,stage:int>>").alias("placed"))
    ended = listed.withColumn("end", F.aggregate(rounds, start, step))
    circle = F.transform(
        "end.waiting",
        lambda d: F.struct(
            d["name"].alias("name"),
            F.concat(F.lit("no channel is named '"), F.get(pending(F.col("end.waiting"), d), 0), F.lit("'")).alias("message"),
        ),
    )
    return ended.select(SESSION, F.col("end.placed").alias("placed"), F.concat("bad", circle).alias("faults"))


def _run(samples, heads, stages, sessions, aliases, chunk_rows, seconds) -> tuple[list[DataFrame], list[DataFrame]]:
    """Rows and errors of each stage, over the ``sessions`` of each."""
    catalog = _catalog_of(heads)
    rows, errors = [], []
    for number, (stage, taking_part) in enumerate(zip(stages, sessions)):
        names = sorted({r for d in stage for r in d.refs})
        if isinstance(aliases, DataFrame):
            meant = resolve_names(catalog, refs_frame(samples.sparkSession, names), aliases).select(CHANNEL).distinct()
            candidates = samples.join(meant, CHANNEL, "left_semi").select(*samples.columns)
        else:
            wanted = ascii_lower(F.col(CHANNEL)).isin(wanted_names(names, aliases))
            candidates = only_channels(samples, catalog, wanted)
        result, failed = _stage(candidates, heads, catalog, taking_part, stage, aliases, chunk_rows, seconds)
        later = {r for after in stages[number + 1 :] for d in after for r in d.refs}
        used = [d.name for d in stage if d.name in later]
        if used:
            result = materialised(result)
            own = result.filter(F.col(CHANNEL).isin(used))
            ends = slices.series_heads(own)
            samples, heads = samples.unionByName(own), heads.unionByName(ends)
            catalog = catalog.unionByName(_catalog_of(ends, LAST_INDEX))
        rows.append(result)
        errors.append(failed)
    return rows, errors


def _stage(
    samples: DataFrame,
    heads: DataFrame,
    catalog: DataFrame,
    sessions: DataFrame,
    stage: Sequence[Definition],
    aliases: Mapping[str, str] | DataFrame,
    chunk_rows: int,
    seconds: int,
) -> tuple[DataFrame, DataFrame]:
    """Definitions that refer to no pending one, together; ``sessions`` may list in ``nos`` which of them each session has."""
    refs = sorted({r for d in stage for r in d.refs})
    status = _status(heads, catalog, sessions, stage, refs, aliases)
    errors = status.filter("message IS NOT NULL").select(SESSION, F.col("d.name").alias("name"), "message")
    grids = _grids(status.filter("message IS NULL"), len(stage), refs)

    steps, same = shared_steps([s for d in stage for s in d.channel.steps])
    halo = halo_of(steps, seconds)
    back, ahead = halo or (0, 0)
    rows = slices.sliced(samples, heads.join(grids.select(SESSION).distinct(), SESSION, "left_semi"), back, ahead, seconds)
    slots = slices.linear_slots(rows, grids, back, ahead, seconds, keep=("wanted", "means"))
    # references of a row's channel, as flags
    slots = slots.withColumn("means", F.col("means")[F.col(CHANNEL)])
    flags = [f"_wanted{k}" for k in range(-(-len(stage) // FLAGS))]
    slots = slots.withColumns({f: F.col("wanted")[k] for k, f in enumerate(flags)})
    cells = {ref_column(r): _flag(F.col("means")[k // FLAGS], k) for k, r in enumerate(refs)}
    wide = slices.side_by_side(slots, cells, ["out_len", *flags], seconds).withColumnRenamed(OUT_FREQ, FREQ)
    if halo is None:
        wide = wide.drop(CHUNK, CORE)
    wide = wide.withColumns({r: F.col(ref_column(r)) for d in stage for r in d.channel.named})
    wide = add_steps(wide, steps, GRID, OUT_IDX, FREQ, chunk_rows, haloed=halo is not None)
    wide = wide.withColumns({copy: F.col(of) for copy, of in same.items()})
    if len(stage) == 1:
        value = stage[0].channel.col.cast("double")
        found = wide.select(SESSION, F.lit(stage[0].name).alias(CHANNEL), FREQ, F.col(OUT_IDX).alias(IDX), value.alias(VALUE))
    else:
        results = F.array(
            *(
                F.struct(
                    F.lit(d.name).alias(CHANNEL),
                    _flag(F.col(flags[k // FLAGS]), k).alias("_own"),
                    d.channel.col.cast("double").alias(VALUE),
                )
                for k, d in enumerate(stage)
            )
        )
        listed = wide.select(SESSION, FREQ, F.col(OUT_IDX).alias(IDX), F.inline(results)).filter("_own")
        found = listed.select(SESSION, CHANNEL, FREQ, IDX, VALUE)
    return found, errors


def _status(heads, catalog, sessions, stage, refs, aliases) -> DataFrame:
    """Per session and definition: ``found``, its references' channels, and the ``message`` that keeps it from being evaluated."""
    spark = catalog.sparkSession
    resolved = resolve_names(catalog, refs_frame(spark, refs), aliases_frame(spark, aliases))
    series = resolved.join(heads.select(*SERIES, FREQ, "n"), list(SERIES), "left")
    facts = F.struct(CHANNEL, FREQ, F.coalesce("n", F.lit(0)).alias("n"))
    per_session = series.groupBy(SESSION).agg(F.map_from_entries(F.collect_list(F.struct(F.col("ref"), facts))).alias("found"))
    listed = F.array(
        *(
            F.struct(F.lit(k).alias("no"), F.lit(d.name).alias("name"), F.array(*map(F.lit, d.refs)).cast("array<string>").alias("refs"))
            for k, d in enumerate(stage)
        )
    )
    if "nos" in sessions.columns:
        listed = F.filter(listed, lambda d: F.array_contains("nos", d["no"].cast("bigint")))
    both = sessions.join(per_session, SESSION, "left").select(SESSION, "found", F.explode(listed).alias("d"))
    data = F.exists("d.refs", lambda r: F.coalesce(F.col("found")[r]["n"] > 0, F.lit(False)))
    missing = F.filter("d.refs", lambda r: F.col("found")[r].isNull())
    message = F.when(~data, NO_DATA).when(F.size(missing) > 0, F.concat(F.lit("no channel is named '"), F.get(missing, 0), F.lit("'")))
    return both.withColumn("message", message)


def _grids(status: DataFrame, definitions: int, refs: Sequence[str]) -> DataFrame:
    """Per session and grid: the definitions on it as flags ``wanted``, lengths of their channels, and the references that each of
    the channels stands for as flags ``means``."""
    each = F.transform("d.refs", lambda r: F.col("found")[r])
    rate, _, length = slices.grid_of(F.transform(each, lambda c: F.coalesce(c[FREQ], F.lit(0))), F.transform(each, lambda c: c["n"]))
    on_grid = status.select(SESSION, "found", "d", rate.alias(OUT_FREQ), length.alias("out_len"))
    gathered = on_grid.groupBy(SESSION, OUT_FREQ, "out_len").agg(
        F.collect_set("d.no").alias("_nos"), F.array_distinct(F.flatten(F.collect_list("d.refs"))).alias("_refs"), F.first("found").alias("found")
    )
    channels = F.array_distinct(F.transform("_refs", lambda r: F.col("found")[r][CHANNEL]))
    # in a variable of its own, since it is used three times
    gathered = gathered.withColumn("_channels", channels)
    stands = lambda c: _flags(lambda r: F.array_contains("_refs", r) & (F.col("found")[r][CHANNEL] == c), list(map(F.lit, refs)))
    length_of = lambda c: F.get(F.filter(F.map_values("found"), lambda v: v[CHANNEL] == c), 0)["n"]
    return gathered.select(
        SESSION,
        OUT_FREQ,
        "out_len",
        _flags(lambda k: F.array_contains("_nos", k), list(map(F.lit, range(definitions)))).alias("wanted"),
        F.map_from_arrays("_channels", F.transform("_channels", length_of)).alias("lengths"),
        F.map_from_arrays("_channels", F.transform("_channels", stands)).alias("means"),
    )


def _flags(holds, items: Sequence[Column]) -> Column:
    """Array of BIGINTs with a bit for each item that the condition holds for."""
    words = []
    for low in range(0, len(items), FLAGS):
        bits = (F.when(holds(x), F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint") for k, x in enumerate(items[low : low + FLAGS]))
        words.append(reduce(Column.bitwiseOR, bits))
    return F.array(*words)


def _flag(word: Column, k: int) -> Column:
    return word.bitwiseAND(F.lit(1 << k % FLAGS).cast("bigint")) != 0


def _stages(definitions: Sequence[Definition]) -> tuple[list[list[Definition]], list[Definition]]:
    """Definitions by stage, and those in a circle or behind one."""
    names, placed = {d.name for d in definitions}, set()
    stages, waiting = [], list(definitions)
    while True:
        ready = [d for d in waiting if not (names & set(d.refs)) - placed]
        if not ready:
            return stages, waiting
        stages.append(ready)
        placed |= {d.name for d in ready}
        waiting = [d for d in waiting if d not in ready]


def evaluate_wide(
    frame: DataFrame,
    definitions: Sequence[Definition],
    keys: Sequence[str] = (SESSION,),
    idx: str = IDX,
    freq: str = FREQ,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add one column per definition to a frame that already has its channels side by side at one rate."""
    stages, cyclic = _stages(definitions)
    if cyclic:
        raise ValueError(f"definitions refer to each other: {[d.name for d in cyclic]}")
    names = {d.name for d in definitions}
    for stage in stages:
        refs = {r for d in stage for r in d.refs}
        frame = frame.withColumns({ref_column(r): quoted(r) for r in sorted(refs)})
        steps, same = shared_steps([s for d in stage for s in d.channel.steps])
        frame = add_steps(frame, steps, keys, idx, freq, chunk_rows).withColumns({copy: F.col(of) for copy, of in same.items()})
        frame = frame.withColumns({d.name: d.channel.col for d in stage})
        frame = frame.drop(*(s.output for s in steps), *same, *map(ref_column, refs))
    return frame.select(*(quoted(c) for c in frame.columns if c not in names), *(quoted(d.name) for d in definitions))


def _catalog_of(heads: DataFrame, index: int = 0) -> DataFrame:
    """Catalogue rows of the series; computed channels come after the logged ones."""
    return heads.select(*SERIES, F.lit(index).alias("channel_index"), F.col("n").alias("n_data"))


def computed_stats(rows: DataFrame) -> DataFrame:
    """Minimum, maximum and average of computed channels."""
    return channel_stats(rows).drop("std_value")


def _errors(sessions: DataFrame, name: str, message: Column) -> DataFrame:
    return sessions.select(SESSION, F.lit(name).alias("name"), message.alias("message"))


def _no_rows(samples: DataFrame) -> DataFrame:
    return samples.limit(0).select(*SERIES, FREQ, IDX, VALUE)
