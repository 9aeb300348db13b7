"""Chat formatting into windows of bounded token count, with a loss mask.

Template: ``<|im_start|>role<|im_sep|>text<|im_end|>`` for every turn. Inside roles and texts a backslash is doubled and any
control string of common chat templates gets a backslash behind its first character, so no control string can come
from a text and ``unescaped`` gives back what was there.

Method: a turn's tokens are counted by a fixed rule (runs of letters, single digits, single other marks, and
``MARKERS`` for the template). Prefix sums of these choose the windows: one takes turns as long as the budget holds them beside the system turn and the
turns before its first one, which it repeats as far as ``history`` tokens reach back. The loss mask covers the assistant
texts that are new in it: each exactly once over all windows. Only a window of a single turn that is too long exceeds the budget
(``over_budget``), without history; nothing is cut.

Windows are filled inside a part of a conversation, ``TURNS`` turn numbers, so a conversation of any length is spread over tasks and the last
window of a part may be short. Texts are shuffled once, by part, together with copies of what a part needs from elsewhere: the system turn, and of the
part before it the last turn numbers that history can reach. What decides about windows are prefix sums, without the texts. Everything is built-in
expressions.

Cases: null text and role are empty; turns are ordered by turn number, nulls first, then role and a hash of the text; rows
repeated are turns of their own; a null conversation id is a conversation; only a first turn with role ``system`` is a system turn, and if
a conversation is nothing else, an ordinary one; turns under one number, or none, are in one part; a very long text is a window of its own; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apexgrid.llm.columns import text_or_empty

BUDGET = 1024
HISTORY = 128
MARKERS = 4
TURNS = 256
#: kinds of the rows of a part, in their order
SYSTEM, BEFORE, OWN = 0, 1, 2
ORDER = ("turn", "role", "tie")

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
_CONTROL = r"(<(?=\|(?:im_start|im_sep|im_end)\|>|/?s>)|\[(?=/?INST\]))"
_TOKEN = r"[\p{L}\p{M}]+|\p{N}|[^\s\p{L}\p{M}\p{N}]"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def n_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_TOKEN)).cast("bigint")


def windows(
    df: DataFrame,
    budget: int = BUDGET,
    history: int = HISTORY,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    whole: bool = False,
) -> DataFrame:
    """One row per window: ``conv_id, window STRUCT<part, no>, formatted, new_from, loss, n_tokens, over_budget``.

    ``new_from`` counts the repeated turns at the front. ``loss`` has ``(start, length)`` in code points of ``formatted``. With ``whole`` all windows of
    a conversation come from one task, which spares a shuffle to results that need them together.
    """
    base = df.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        text_or_empty(text).alias("text"),
    ).withColumns({"tie": F.xxhash64("text"), "part": F.coalesce(F.floor(F.col("turn") / TURNS), F.lit(-(1 << 62)))})
    columns = ("conv_id", "part", "kind", *ORDER, "text")
    # the last turn numbers of a part, as many as history has tokens for
    reach = min(-(-history // MARKERS), TURNS)
    ends = F.col("turn") - F.col("part") * TURNS >= TURNS - reach
    places = F.array(F.struct("part", F.lit(OWN).alias("kind")), F.when(ends, F.struct((F.col("part") + 1).alias("part"), F.lit(BEFORE).alias("kind"))))
    own = base.withColumn("place", F.explode(F.filter(places, lambda p: p.isNotNull())))
    own = own.select("conv_id", "place.part", "place.kind", *ORDER, "text")
    rows = own.unionByName(_system_turns(base).select(*columns))
    rows = rows.repartition(*(["conv_id"] if whole else ["conv_id", "part"]))
    rows = _started(_measured(rows, budget, history), budget)

    first_new = F.size(F.filter("starts", lambda s: s["begin"] <= F.col("begin"))) - 1
    numbered = F.transform("starts", lambda s, i: F.struct(i.alias("no"), s["begin"].alias("begin"), s["history"].alias("history")))
    later = F.filter(numbered, lambda s: (s["begin"] > F.col("begin")) & (s["begin"] - F.col("begin") <= s["history"]))
    repeated = F.transform(later, lambda s: F.struct(s["no"].alias("no"), F.lit(False).alias("new")))
    once = F.array(F.struct(first_new.alias("no"), F.lit(True).alias("new")))
    everywhere = F.transform("starts", lambda s, i: F.struct(i.alias("no"), (F.col("home") & (i == 0)).alias("new")))
    windows_of = F.when(F.col("is_system"), everywhere).when(F.col("kind") == OWN, F.concat(once, repeated)).otherwise(repeated)
    placed = rows.withColumn("w", F.explode(windows_of))

    before = F.concat(F.lit(START), escaped(F.col("role")), F.lit(SEPARATOR))
    masked = F.col("w.new") & (F.col("role") == "assistant")
    entry = F.struct(
        "position",
        F.concat(before, escaped(F.col("text")), F.lit(END)).alias("rendered"),
        F.when(masked, F.length(before)).alias("head"),
    )
    bodies = placed.groupBy("conv_id", "part", F.col("w.no").alias("no")).agg(
        F.sort_array(F.collect_list(entry)).alias("turns"),
        F.count_if(~F.col("w.new")).cast("int").alias("new_from"),
        F.sum("tokens").alias("n_tokens"),
    )

    def follow(state: Column, t: Column) -> Column:
        length = F.length(t["rendered"]).cast("bigint")
        span = F.struct((state["at"] + t["head"]).alias("start"), (length - t["head"] - len(END)).alias("length"))
        spans = F.when(t["head"].isNull(), state["spans"]).otherwise(F.concat(state["spans"], F.array(span)))
        return F.struct((state["at"] + length).alias("at"), spans.alias("spans"))

    nowhere = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    return bodies.select(
        "conv_id",
        F.struct("part", "no").alias("window"),
        F.array_join(F.transform("turns", lambda t: t["rendered"]), "").alias("formatted"),
        "new_from",
        F.aggregate("turns", nowhere, follow)["spans"].alias("loss"),
        "n_tokens",
        (F.col("n_tokens") > budget).alias("over_budget"),
    )


def _system_turns(base: DataFrame) -> DataFrame:
    """For each part of a conversation that starts with a system turn a row of kind SYSTEM: without a text in the part that has the turn itself,
    a copy of the turn in others."""
    parts = base.groupBy("conv_id", "part").agg(F.count("*").alias("turns"), F.min(F.struct(*ORDER)).alias("first"))
    conversation = Window.partitionBy("conv_id")
    facts = parts.select(
        F.col("conv_id").alias("_conv"),
        "part",
        F.sum("turns").over(conversation).alias("turns"),
        F.min("first").over(conversation).alias("first"),
        (F.col("part") == F.min("part").over(conversation)).alias("home"),
    ).filter((F.col("first.role") == "system") & (F.col("turns") > 1))
    facts = facts.select("_conv", "part", "home", *(F.col(f"first.{c}").alias(f"_{c}") for c in ORDER))
    here = facts.filter("home").withColumn("text", F.lit(None).cast("string"))
    others = facts.filter("NOT home")
    same = F.col("conv_id").eqNullSafe(F.col("_conv"))
    is_first = same & F.col("turn").eqNullSafe(F.col("_turn")) & (F.col("tie") == F.col("_tie"))
    first = base.filter("role = 'system'").join(others.select("_conv", "_turn", "_tie").distinct(), is_first)
    first = first.groupBy("conv_id").agg(F.min("text").alias("text"))
    there = others.join(first, same).select(*here.columns)
    found = here.unionByName(there)
    return found.select(F.col("_conv").alias("conv_id"), "part", F.lit(SYSTEM).alias("kind"), *(F.col(f"_{c}").alias(c) for c in ORDER), "text")


def _measured(rows: DataFrame, budget: int, history: int) -> DataFrame:
    """Turns of a part with ``position, begin`` (tokens before it), ``history`` (tokens that a window starting with it would repeat), ``tokens, is_system``,
    and of the part ``system_tokens`` and ``home``: the system turn is one of its own."""
    order = Window.partitionBy("conv_id", "part").orderBy("kind", *ORDER)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own_marker, copied = F.col("text").isNull(), (F.col("kind") == SYSTEM) & F.col("text").isNotNull()
    rows = rows.withColumns(
        {
            "position": F.row_number().over(order),
            "home": F.coalesce(F.max(own_marker).over(everything), F.lit(False)),
            "_copy": F.max(F.when(copied, F.struct(*ORDER))).over(everything),
        }
    )
    # the turn itself is not history beside its copy
    again = (F.col("kind") == BEFORE) & F.coalesce(F.col("_copy").eqNullSafe(F.struct(*ORDER)), F.lit(False))
    rows = rows.filter(~own_marker & ~again).withColumns(
        {
            "is_system": copied | (F.col("home") & (F.col("kind") == OWN) & (F.col("position") == 2)),
            "tokens": n_tokens(F.col("text")) + n_tokens(F.col("role")) + MARKERS,
        }
    )
    counted = F.when(F.col("is_system"), F.lit(0).cast("bigint")).otherwise(F.col("tokens"))
    rows = rows.withColumns(
        {
            "begin": F.sum(counted).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - counted,
            "system_tokens": F.coalesce(F.max(F.when(F.col("is_system"), F.col("tokens"))).over(everything), F.lit(0)),
        }
    )
    reached = Window.partitionBy("conv_id", "part").orderBy("begin").rangeBetween(-history, Window.currentRow)
    back = F.col("begin") - F.coalesce(F.min(F.when(~F.col("is_system"), F.col("begin"))).over(reached), F.col("begin"))
    fits = F.col("back") + F.col("tokens") + F.col("system_tokens") <= budget
    return rows.withColumn("back", back).withColumn("history", F.when(fits, F.col("back")).otherwise(0)).drop("_copy", "back")


def _started(rows: DataFrame, budget: int) -> DataFrame:
    """Add ``starts ARRAY<STRUCT<begin, history>>``, the first turn of each window of the part."""
    order = Window.partitionBy("conv_id", "part").orderBy("begin")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.when((F.col("kind") == OWN) & ~F.col("is_system"), F.struct("begin", "tokens", "history"))

    def take(state: Column, t: Column) -> Column:
        opened = F.struct(
            (t["begin"] + budget - F.col("system_tokens") - t["history"]).alias("limit"),
            F.concat(state["starts"], F.array(F.struct(t["begin"].alias("begin"), t["history"].alias("history")))).alias("starts"),
        )
        return F.when(t["begin"] + t["tokens"] <= state["limit"], state).otherwise(opened)

    none = F.struct(F.lit(-1).cast("bigint").alias("limit"), F.array().cast("array<struct<begin:bigint,history:bigint>>").alias("starts"))
    # worked out in one row of the part
    listed = rows.withColumns({"items": F.collect_list(own).over(everything), "_row": F.row_number().over(order)})
    chosen = F.when(F.col("_row") == 1, F.aggregate("items", none, take)["starts"])
    found = listed.withColumn("_starts", chosen).drop("items")
    return found.withColumn("starts", F.first("_starts", ignorenulls=True).over(everything)).drop("_starts", "_row")


def read_back(formatted: DataFrame) -> DataFrame:
    """From the windows alone, per conversation: the turns as ``role, newline, text, newline`` each, the text under the loss
    mask, and the counts: ``conv_id, n_turns, turns_text, loss_text, formatted_chars``."""
    shown = F.slice(F.split("formatted", r"<\|im_end\|>"), F.col("new_from") + 1, F.lit(1 << 30))
    # behind the last end mark stands nothing
    shown = F.filter(shown, lambda s: s != "")
    role = lambda s: F.substring_index(F.substr(s, F.lit(len(START) + 1)), SEPARATOR, 1)
    text = lambda s: F.substr(s, F.lit(len(START) + len(SEPARATOR) + 1) + F.length(role(s)))
    line = lambda s: F.concat(unescaped(role(s)), F.lit("\n"), unescaped(text(s)), F.lit("\n"))
    lost = F.transform("loss", lambda p: F.substr("formatted", (p["start"] + 1).cast("int"), p["length"].cast("int")))
    parts = formatted.select(
        "conv_id",
        F.struct(
            "window",
            F.array_join(F.transform(shown, line), "").alias("turns"),
            unescaped(F.array_join(lost, "")).alias("loss"),
        ).alias("w"),
        F.size(shown).cast("bigint").alias("n"),
        F.length("formatted").cast("bigint").alias("chars"),
    )
    whole = parts.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sort_array(F.collect_list("w")).alias("ws"), F.sum("chars").alias("formatted_chars")
    )
    joined = lambda name: F.array_join(F.transform("ws", lambda w: w[name]), "")
    return whole.select("conv_id", "n_turns", joined("turns").alias("turns_text"), joined("loss").alias("loss_text"), "formatted_chars")
