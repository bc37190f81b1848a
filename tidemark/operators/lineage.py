"""Causation and correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.event_log import ID
from tidemark.sources.scratch import held


def direct(log: DataFrame) -> DataFrame:
    """Pairs (cause, effect) within a stream; a blank causation id links nothing."""
    cause = log.select(*ID, F.col("message_id").alias("cause"), F.col("sequence_number").alias("cause_sequence"))
    effect = log.where(F.trim("causation_id") != "").select(*ID, F.col("causation_id").alias("cause"), F.col("message_id").alias("effect"), F.col("sequence_number").alias("effect_sequence"))
    return cause.join(effect, [*ID, "cause"])


def closure(log: DataFrame) -> DataFrame:
    """Every event with the root of its chain and its depth, by pointer doubling until no pointer's target has a cause: log2 of the deepest chain joins, and one.

    Each turn's pointers are checkpointed, so plans stay short. An event on or behind a circle of causes has no root: its root and depth are null.
    """
    edges = direct(log)
    now = log.select(*ID, "message_id").join(edges.select(*ID, F.col("effect").alias("message_id"), "cause"), [*ID, "message_id"], "left")
    now = held(now.select(*ID, "message_id", F.coalesce("cause", "message_id").alias("root"), F.when(F.col("cause").isNull(), 0).otherwise(1).cast("long").alias("depth")))
    longest = now.groupBy(*ID).count().agg(F.max("count")).first()[0] or 0
    reach = 1
    while True:
        up = now.select(*ID, F.col("message_id").alias("root"), F.col("root").alias("over"), F.col("depth").alias("more"))
        now = held(now.join(up, [*ID, "root"]).select(*ID, "message_id", F.col("over").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("moved")))
        if now.where("moved").isEmpty():
            return now.drop("moved")
        if reach >= longest:  # no chain is longer than its stream, so what still moves goes round
            return now.select(*ID, "message_id", *(F.when(~F.col("moved"), F.col(c)).alias(c) for c in ("root", "depth")))
        reach *= 2


def chain(log: DataFrame, tenant: str, domain: str, aggregate: str, sequence: int) -> DataFrame:
    """The event at a sequence and those it caused directly, each with the command it came from (its causation id) and its place, target first.

    A blank causation id links nothing, nor does a shared correlation id. LookupError if the stream has no such event.
    """
    stream = log.where((F.col("tenant_id") == tenant.lower()) & (F.col("domain") == domain.lower()) & (F.col("aggregate_id") == aggregate))
    target = stream.where(F.col("sequence_number") == sequence)
    if target.isEmpty():
        raise LookupError(f"no event {sequence}")
    cause = target.select(F.col("message_id").alias("cause"))
    caused = stream.where(F.trim("causation_id") != "").join(F.broadcast(cause), F.col("causation_id") == F.col("cause"))
    own = [F.col(c) for c in ("message_id", "event_type_name", "sequence_number")]
    origin = F.nullif(F.trim("causation_id"), F.lit("")).alias("originating_command_id")
    return target.select(F.lit(0).alias("place"), *own, origin).unionByName(caused.select(F.lit(1).alias("place"), *own, origin))


def rejection(name: Column) -> Column:
    """Whether an event's type says that a command was rejected."""
    return name.rlike("(?i)(rejected$|rejection)")


def trace(log: DataFrame, commands: DataFrame, newest: int = 10_000, now: Column | None = None, ttl_seconds: int = 86_400) -> DataFrame:
    """Each command with its produced events among the newest of its stream: counts, first and last sequence, rejections, scan_capped.

    A correlation id of several commands is Ambiguous in ``outcome``, else Resolved. With ``now`` a status
    (``ts``) older than ``ttl_seconds`` has expired: it is null and ``status_expired`` true.
    """
    ranked = log.withColumn("back", F.row_number().over(Window.partitionBy(*ID).orderBy(F.desc("sequence_number"))))
    per = ranked.where(F.col("back") <= newest).groupBy(*ID, "correlation_id").agg(F.count("*").alias("event_count"), F.min("sequence_number").alias("first_sequence"), F.max("sequence_number").alias("last_sequence"), F.count_if(rejection(F.col("event_type_name"))).alias("rejections"))
    capped = log.groupBy(*ID).agg((F.count("*") > newest).alias("scan_capped"))
    many = commands.groupBy("tenant_id", "correlation_id").agg(F.when(F.count("*") > 1, "Ambiguous").otherwise("Resolved").alias("outcome"))
    expired = F.lit(False) if now is None else F.coalesce(F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) > ttl_seconds * 1_000_000, F.lit(False))
    own = commands.select(*ID, "correlation_id", F.when(~expired, F.col("status")).alias("status"), expired.alias("status_expired"))
    found = own.join(per, [*ID, "correlation_id"], "left").join(capped, list(ID), "left").join(many, ["tenant_id", "correlation_id"], "left")
    return found.select(*ID, "correlation_id", "status", "status_expired", "outcome", F.coalesce("event_count", F.lit(0)).alias("event_count"), "first_sequence", "last_sequence", F.coalesce("rejections", F.lit(0)).alias("rejections"), F.coalesce("scan_capped", F.lit(False)).alias("scan_capped"))


def resolution(log: DataFrame) -> DataFrame:
    """Correlation ids: Resolved if one stream holds them, Ambiguous if several do."""
    streams = log.groupBy("correlation_id").agg(F.countDistinct(*ID).alias("streams"))
    return streams.select("correlation_id", "streams", F.when(F.col("streams") == 1, "Resolved").otherwise("Ambiguous").alias("outcome"))
