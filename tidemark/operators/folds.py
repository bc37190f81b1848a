"""State of all streams at once: a declared reducer lowered to windows.

A reducer says what every event type does to every field: add an expression, set it, or reset the field. A
counter that never goes below zero is lowered too: within a reset group it is S - min(0, min S) of its running
sum S. So no stream is collected into an array, and every window spills.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.sources.event_log import ID
from tidemark.sources.scratch import held


@dataclass(frozen=True)
class Counter:
    """A sum of ``add`` (event type -> expression), set to zero by the types in ``reset``, and not below zero if ``floor``."""

    add: Mapping[str, str]
    reset: tuple[str, ...] = ()
    floor: bool = False
    kind: str = "bigint"


@dataclass(frozen=True)
class Latest:
    """The expression of the last event of one of the types (any type if none is named)."""

    value: str
    types: tuple[str, ...] = ()


@dataclass(frozen=True)
class Reducer:
    fields: Mapping[str, Counter | Latest]
    types: tuple[str, ...] = field(default=())


DEMO = Reducer({
    "count": Counter({"click": "1", "error": "-1"}, ("signup",), floor=True),
    "spent": Counter({"purchase": "CAST(value AS DECIMAL(18,2))"}, kind="decimal(28,2)"),
    "last_purchase": Latest("event_id", ("purchase",)),
})


def _type_is(types) -> Column:
    return F.col("event_type_name").isin(*types) if types else F.lit(True)


def timeline(log: DataFrame, reducer: Reducer = DEMO) -> DataFrame:
    """The log with the state after each event in the reducer's fields."""
    order = Window.partitionBy(*ID).orderBy("sequence_number").rowsBetween(Window.unboundedPreceding, 0)
    out = log
    for name, rule in reducer.fields.items():
        if isinstance(rule, Latest):
            out = out.withColumn(name, F.last(F.when(_type_is(rule.types), F.expr(rule.value)), ignorenulls=True).over(order))
            continue
        delta = F.lit(0).cast(rule.kind)
        for kind, expression in rule.add.items():
            delta = F.when(F.col("event_type_name") == kind, F.expr(expression).cast(rule.kind)).otherwise(delta)
        group = F.sum(F.when(_type_is(rule.reset), 1).otherwise(0)).over(order) if rule.reset else F.lit(0)
        out = out.withColumn("__group", group)
        within = Window.partitionBy(*ID, "__group").orderBy("sequence_number").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn("__sum", F.sum(delta).over(within).cast(rule.kind))
        value = F.col("__sum") - F.least(F.lit(0).cast(rule.kind), F.min("__sum").over(within)) if rule.floor else F.col("__sum")
        out = out.withColumn(name, value.cast(rule.kind)).drop("__group", "__sum")
    return out


def at(log: DataFrame, sequence: int | None = None, reducer: Reducer = DEMO) -> DataFrame:
    """The state of each stream at a sequence (its head if none): only events up to it are read, and the last state kept.

    At 0 every stream has the empty state, all fields null, at the Unix epoch.
    """
    if sequence is not None and sequence < 0:
        raise ValueError("sequence must not be negative")
    own = F.struct("sequence_number", "ts", *reducer.fields)
    if sequence == 0:
        fields = timeline(log, reducer).select(own.alias("s")).schema["s"].dataType.fields
        kinds = {f.name: f.dataType for f in fields}
        start = {"sequence_number": F.lit(0), "ts": F.timestamp_seconds(F.lit(0))}
        return log.select(*ID).distinct().select(*ID, *[start.get(n, F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])
    found = log if sequence is None else log.where(F.col("sequence_number") <= sequence)
    return timeline(found, reducer).groupBy(*ID).agg(F.max_by(own, "sequence_number").alias("s")).select(*ID, "s.*")


def leaves(states: DataFrame, fields) -> DataFrame:
    """One row for each field: path, value as JSON text (null fields have none)."""
    pairs = F.array(*[F.struct(F.lit(f).alias("path"), F.col(f).cast("string").alias("value")) for f in fields])
    return states.withColumn("leaf", F.explode(pairs)).select(*[c for c in states.columns if c not in fields], "leaf.path", "leaf.value")


def diff(log: DataFrame, start: int, to: int, reducer: Reducer = DEMO) -> DataFrame:
    """Fields that differ between two sequences of each stream; at 0 the state is empty. Fields that vanish are no change."""
    if start < 0 or to <= start:
        raise ValueError("from must not be negative, and to must be above it")
    names = list(reducer.fields)
    old = leaves(at(log, start, reducer), names).select(*ID, "path", F.col("value").alias("old_value"))
    new = leaves(at(log, to, reducer), names).select(*ID, "path", F.col("value").alias("new_value"))
    return new.join(old, [*ID, "path"], "left").where(F.col("new_value").isNotNull() & ~F.col("new_value").eqNullSafe(F.col("old_value")))


def changes(log: DataFrame, reducer: Reducer = DEMO) -> DataFrame:
    """Every change of a field: event, path, value and the value before."""
    user = F.col("user_id") if "user_id" in log.columns else F.lit(None).cast("string").alias("user_id")
    states = leaves(timeline(log, reducer).select(*ID, "sequence_number", "ts", "event_type_name", "correlation_id", user, *reducer.fields), list(reducer.fields))
    w = Window.partitionBy(*ID, "path").orderBy("sequence_number")
    return states.withColumn("previous", F.lag("value").over(w)).where(~F.col("value").eqNullSafe(F.col("previous")))


BLAME_EVENTS, BLAME_FIELDS = 10_000, 5_000


def blame(log: DataFrame, sequence: int | None = None, reducer: Reducer = DEMO, most_events: int = BLAME_EVENTS, most_fields: int = BLAME_FIELDS) -> DataFrame:
    """For each field its value, the one before, and the event that changed it last.

    States come from whole histories. A stream with more than ``most_events`` events is reported by its newest
    ones: a field that changed before them keeps its values, and what changed it is null. Of more than
    ``most_fields`` fields the first by path are told. ``is_truncated`` says that either limit was reached.
    """
    found = log if sequence is None else log.where(F.col("sequence_number") <= sequence)
    own = F.struct("value", "previous", F.col("sequence_number").alias("changed_at"), F.col("ts").alias("changed_ts"), F.col("event_type_name").alias("changed_by"), "correlation_id", F.col("user_id").alias("changed_user"))
    last = changes(found, reducer).groupBy(*ID, "path").agg(F.max_by(own, "sequence_number").alias("s")).select(*ID, "path", "s.*")
    sizes = found.groupBy(*ID).agg(F.count("*").alias("__events"), F.max("sequence_number").alias("__head"))
    per = Window.partitionBy(*ID)
    told = last.join(sizes, list(ID)).withColumn("__fields", F.count("*").over(per)).withColumn("__place", F.row_number().over(per.orderBy("path")))
    inside = F.col("changed_at") > F.col("__head") - most_events
    whole = ("changed_at", "changed_ts", "changed_by", "correlation_id", "changed_user")
    cut = (F.col("__events") > most_events) | (F.col("__fields") > most_fields)
    return told.where(F.col("__place") <= most_fields).select(*ID, "path", "value", "previous", *[F.when(inside, F.col(c)).alias(c) for c in whole], cut.alias("is_truncated"))


def first_divergence(log: DataFrame, good: int, bad: int, fields=None, reducer: Reducer = DEMO) -> DataFrame:
    """The first event in (good, bad] after which a watched field differs from the state at ``good``, for each stream.

    ``bisect_steps`` follows the midpoints; the two differ only where a field turns back.
    """
    if not 0 <= good < bad:
        raise ValueError("good must not be negative and must be below bad")
    names = list(fields or reducer.fields)
    states = timeline(log.where(F.col("sequence_number") <= bad), reducer)
    base = states.where(F.col("sequence_number") == good).select(*ID, *[F.col(n).alias(f"good_{n}") for n in names])
    joined = states.where(F.col("sequence_number") > good).join(base, list(ID), "left" if good == 0 else "inner")
    empty = {n: F.lit(0) if isinstance(reducer.fields[n], Counter) else F.lit(None) for n in names}
    differs = F.lit(False)
    for n in names:
        was = F.col(f"good_{n}") if good else empty[n]
        differs = differs | ~F.col(n).eqNullSafe(was)
    return joined.where(differs).groupBy(*ID).agg(F.min("sequence_number").alias("diverged_at"), F.min_by("event_type_name", "sequence_number").alias("event_type_name"))


def bisect_steps(states: DataFrame, good: int, bad: int, fields, most: int = 30) -> DataFrame:
    """The midpoint search on the timelines of all streams at once: stream, step, midpoint, verdict, converged; at most ``most`` steps.

    ``converged`` is true from the step on after which no midpoint is left. Each step is one equi-join of the
    streams' midpoints with the timeline; midpoints are checkpointed, so no step computes those before it anew.
    """
    if not 0 <= good < bad:
        raise ValueError("good must not be negative and must be below bad")
    names = list(fields)
    digest = F.sha2(F.to_json(F.struct(*[F.col(n).cast("string").alias(n) for n in names])), 256)
    marks = held(states.where(F.col("sequence_number").between(good, bad)).select(*ID, "sequence_number", digest.alias("mark")))
    base = marks.where(F.col("sequence_number") == good).select(*ID, F.col("mark").alias("good_mark"))
    now = base.withColumn("low", F.lit(good).cast("long")).withColumn("high", F.lit(bad).cast("long"))
    steps = []
    for step in range(1, min(most, max(1, (bad - good).bit_length())) + 1):
        middle = now.where("high - low > 1").withColumn("middle", F.expr("low + (high - low) div 2"))
        tried = middle.join(marks.withColumnRenamed("sequence_number", "middle"), [*ID, "middle"]).withColumn("verdict", F.when(F.col("mark") == F.col("good_mark"), "good").otherwise("bad"))
        low = F.when(F.col("verdict") == "good", F.col("middle")).otherwise(F.col("low"))
        high = F.when(F.col("verdict") == "good", F.col("high")).otherwise(F.col("middle"))
        now = held(tried.select(*ID, "good_mark", "middle", "verdict", low.alias("low"), high.alias("high")))
        steps.append(now.select(*ID, F.lit(step).alias("step"), "middle", "verdict", (F.col("high") - F.col("low") <= 1).alias("converged")))
    out = steps[0]
    for more in steps[1:]:
        out = out.unionByName(more)
    return out


def step_frame(log: DataFrame, sequence: int, reducer: Reducer = DEMO) -> DataFrame:
    """The event at a sequence with the state before and after it, and whether others stand before and behind."""
    if sequence < 1:
        raise ValueError("sequence must be 1 or more")
    states = timeline(log.where(F.col("sequence_number") <= sequence), reducer)
    w = Window.partitionBy(*ID).orderBy("sequence_number")
    before = [F.lag(n).over(w).alias(f"previous_{n}") for n in reducer.fields]
    totals = log.groupBy(*ID).agg(F.max("sequence_number").alias("total_events"))
    frame = states.select("*", *before).where(F.col("sequence_number") == sequence).join(totals, list(ID))
    return frame.withColumn("has_previous", F.col("sequence_number") > 1).withColumn("has_next", F.col("sequence_number") < F.col("total_events"))


@dataclass(frozen=True)
class Handlers:
    """The event types that a state applies, by full name; stored names find them as ``resolved`` says."""

    names: tuple[str, ...]

    def short(self, name: str) -> str:
        head, bracket, rest = name.partition("[")
        return max(head.rsplit(".", 1)[-1].rsplit("+", 1)[-1], "", key=len) + bracket + rest

    def keys(self, *kinds: str) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for name in self.names:
            for key in {name if k == "full" else self.short(name) for k in kinds}:
                out.setdefault(key, []).append(name)
        return out


def _lookup(keys: Mapping[str, list[str]], name: Column) -> Column:
    """The full names under a key, null if it is none."""
    pairs = [x for key, names in keys.items() for x in (F.lit(key), F.array(*map(F.lit, sorted(names))))]
    return F.try_element_at(F.create_map(*pairs), name) if pairs else F.lit(None).cast("array<string>")


def resolved(stored: Column, handlers: Handlers) -> Column:
    """How a stored event type finds its handler: struct(outcome, names).

    Without assembly names, it is looked up as a full name, then as a short one, then by its ends behind a '.' or
    '+', the longest first. One handler: Resolved; several under the key that was hit: Ambiguous; none: Unknown.
    The table has as many entries as a state has handlers, so it is a literal of the plan.
    """
    name = scalars.type_name(stored)
    starts = F.filter(F.sequence(F.lit(2), F.greatest(F.length(name), F.lit(2))), lambda i: F.substring(name, i - 1, F.lit(1)).isin(".", "+"))
    ends = F.transform(starts, lambda i: F.substring(name, i, F.length(name)))
    suffixes = handlers.keys("full", "short")
    known = F.array(*map(F.lit, suffixes)) if suffixes else F.array().cast("array<string>")
    longest = F.get(F.filter(ends, lambda e: F.array_contains(known, e)), F.lit(0))
    hit = F.coalesce(_lookup(handlers.keys("full"), name), _lookup(handlers.keys("short"), name), _lookup(suffixes, longest))
    found = F.coalesce(hit, F.array().cast("array<string>"))
    outcome = F.when(F.size(found) == 1, "Resolved").when(F.size(found) > 1, "Ambiguous").otherwise("Unknown")
    return F.struct(outcome.alias("outcome"), found.alias("names"))


def replay_status(log: DataFrame, handlers: Handlers, up_to: int | None = None, fails: Column | None = None) -> DataFrame:
    """Succeeded, Partial or Failed for each stream with events up to ``up_to``: status, error, failed_sequence, failed_type, last_applied.

    The whole stream is checked before anything is applied: it begins at 1, then in order no sequence is there twice
    and none is missing; else it fails (Unexpected) with nothing applied. Then event by event: metadata version,
    type, format (json), handler, payload (a JSON value that isn't null; nothing counts as an empty object). The first that
    breaks a rule fails the replay behind the event before it. ``fails`` marks events whose handler throws:
    the replay is Partial (ApplyFailed) with the state before them. Version and format count as 1 and json where
    the log has no such columns.
    """
    version = F.coalesce("metadata_version", F.lit(0)) if "metadata_version" in log.columns else F.lit(1)
    form = F.coalesce("serialization_format", F.lit("")) if "serialization_format" in log.columns else F.lit("json")
    found = log if up_to is None else log.where(F.col("sequence_number") <= up_to)
    per = Window.partitionBy(*ID)
    order = per.orderBy("sequence_number", "message_id")
    before = F.lag("sequence_number").over(order)
    n, kind = F.col("sequence_number"), F.coalesce(F.trim("event_type_name"), F.lit(""))
    text = F.coalesce(F.col("payload").cast("string"), F.lit(""))
    broken = F.when(before.isNull() & (n != 1), F.lit(1)).when(n == before, n).when(n != before + 1, before + 1)
    missing = F.when(n == before, F.col("event_type_name")).otherwise("")
    unreadable = (text != "") & (F.try_parse_json(text).isNull() | (F.trim(text) == "null"))
    outcome = resolved(F.col("event_type_name"), handlers)["outcome"]
    error = F.when(version < 1, "UnsupportedVersion").when(kind == "", "UnknownEventType").when(F.lower(form) != "json", "UnsupportedVersion")
    error = error.when(outcome != "Resolved", "UnknownEventType" if handlers.names else "ApplyHandlerMissing").when(unreadable, "DeserializationFailed")
    error = error.when(fails, "ApplyFailed") if fails is not None else error
    first = F.struct(n.alias("at"), F.col("error").alias("error"), F.col("event_type_name").alias("kind"))
    hole = F.struct(F.col("turn").alias("turn"), F.col("broken").alias("at"), F.col("missing").alias("kind"))
    marked = found.withColumn("broken", broken.cast("long")).withColumn("missing", missing).withColumn("turn", F.row_number().over(order)).withColumn("error", error)
    out = marked.groupBy(*ID).agg(F.min(F.when(F.col("broken").isNotNull(), hole)).alias("hole"), F.min(F.when(F.col("error").isNotNull(), first)).alias("first"), F.max("sequence_number").alias("head"))
    whole = F.col("hole").isNull()
    status = F.when(~whole, "Failed").when(F.col("first").isNull(), "Succeeded").when(F.col("first.error") == "ApplyFailed", "Partial").otherwise("Failed")
    return out.select(
        *ID, status.alias("status"), F.when(~whole, "Unexpected").otherwise(F.col("first.error")).alias("error"),
        F.when(~whole, F.col("hole.at")).otherwise(F.col("first.at")).alias("failed_sequence"), F.when(~whole, F.col("hole.kind")).otherwise(F.col("first.kind")).alias("failed_type"),
        F.when(~whole, F.lit(0)).otherwise(F.coalesce(F.col("first.at") - 1, "head")).alias("last_applied"),
    )


def rehydrated(log: DataFrame, snapshots: DataFrame, reducer: Reducer) -> DataFrame:
    """Each stream's state from its snapshot (identity, sequence_number and the reducer's fields) and the events behind it alone.

    Sums go on from the snapshot's value, a reset forgets it, the latest of nothing keeps it. Counters with a floor take
    the snapshot's value as the first step of their tail. Streams without snapshot are folded whole; a snapshot at or
    beyond the head has no tail. ``missing`` is the first sequence that the tail lacks, null if it is whole.
    """
    own = snapshots.select(*ID, F.col("sequence_number").alias("__from"), *[F.col(n).alias(f"__was_{n}") for n in reducer.fields])
    tail = log.join(own.select(*ID, "__from"), list(ID), "left").where(F.col("sequence_number") > F.coalesce("__from", F.lit(0)))
    order = Window.partitionBy(*ID).orderBy("sequence_number")
    prior = F.coalesce(F.lag("sequence_number").over(order), F.col("__from"), F.lit(0))
    holes = tail.withColumn("__gap", F.when(F.col("sequence_number") != prior + 1, prior + 1)).groupBy(*ID).agg(F.min("__gap").alias("missing"))
    seeds, kinds = own, {n: r for n, r in reducer.fields.items()}
    seeded = tail.drop("__from").withColumns({f"__was_{n}": F.lit(None) for n in kinds})
    first = seeds.select(*ID, F.col("__from").alias("sequence_number"), *[f"__was_{n}" for n in kinds])
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in log.schema if f.name not in (*ID, "sequence_number", "event_type_name")]
    first = first.select(*ID, "sequence_number", F.lit(SEED).alias("event_type_name"), *blank, *[f"__was_{n}" for n in kinds])
    every = first.unionByName(seeded.select(*first.columns))
    states = at(every, None, Reducer({n: _seeded(n, r) for n, r in kinds.items()}))
    return states.drop("ts").join(holes, list(ID), "left")


SEED = "#snapshot"


def _seeded(name: str, rule: Counter | Latest) -> Counter | Latest:
    was = f"__was_{name}"
    if isinstance(rule, Counter):
        return Counter({**rule.add, SEED: f"`{was}`"}, rule.reset, rule.floor, rule.kind)
    types = " OR ".join(f"event_type_name = '{t}'" for t in rule.types) or f"event_type_name <> '{SEED}'"
    return Latest(f"CASE WHEN event_type_name = '{SEED}' THEN `{was}` WHEN {types} THEN {rule.value} END")


def decide(log: DataFrame, commands: DataFrame, decider, sequence: int | None = None, reducer: Reducer = DEMO) -> DataFrame:
    """What-if: each command's outcome on its stream's state, nothing persisted.

    ``decider`` maps a DataFrame of commands with state columns to one with ``outcome`` and ``produced`` (an event type or null).
    """
    return decider(commands.join(at(log, sequence, reducer), list(ID), "left"))


def sandbox(log: DataFrame, commands: DataFrame, decider, sequence: int | None = None, reducer: Reducer = DEMO) -> DataFrame:
    """``decide``, and the state that the produced event would lead to, in the reducer's fields with ``_after`` behind.

    Only events up to ``sequence`` and the one that is made up are folded; one command a stream. Streams without events have
    a null state. A command of which nothing comes leaves the state as it is.
    """
    told = decide(log, commands, decider, sequence, reducer)
    found = log if sequence is None else log.where(F.col("sequence_number") <= sequence)
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in log.schema if f.name not in (*ID, "sequence_number", "event_type_name")]
    made = told.where(F.col("produced").isNotNull()).select(*ID, (F.coalesce("sequence_number", F.lit(0)) + 1).alias("sequence_number"), F.col("produced").alias("event_type_name"), *blank)
    after = at(found.unionByName(made.select(*found.columns)), None, reducer).select(*ID, *[F.col(n).alias(f"{n}_after") for n in reducer.fields])
    return told.join(after, list(ID), "left")
