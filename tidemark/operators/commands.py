"""Command status, correlation index, replay eligibility, idempotency, rate limits and the drain of unpublished events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TTL_SECONDS, INDEX_CAPACITY = 86_400, 128
REPLAYABLE = ("Rejected", "PublishFailed", "TimedOut")
DRAIN_FIRST, DRAIN_EVERY, DRAIN_MOST, DRAIN_ATTEMPTS = 30, 60, 1800, 8


def _seconds(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1_000_000


def latest_status(statuses: DataFrame, now: Column | None = None, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """The newest status (tenant_id, message_id, status, ts, place) of each command; by ``now`` those written more than ``ttl_seconds`` ago are gone. Ties by ``place``."""
    found = statuses if now is None else statuses.where(_seconds(now, F.col("ts")) < ttl_seconds)
    own = F.struct("status", "ts")
    return found.groupBy("tenant_id", "message_id").agg(F.max_by(own, F.struct("ts", "place")).alias("s")).select("tenant_id", "message_id", "s.*")


def correlation_index(commands: DataFrame, now: Column | None = None, ttl_seconds: int = TTL_SECONDS, capacity: int = INDEX_CAPACITY) -> DataFrame:
    """Each correlation id with its live commands: how many, the first ``capacity`` message ids by time, whether there are more, and the outcome.

    One command: Resolved; several: Ambiguous; more than the capacity: Overflow. Commands that repeat count once.
    Only the first ``capacity`` ids of a correlation are listed, the count has all.
    """
    live = commands if now is None else commands.where(_seconds(now, F.col("ts")) < ttl_seconds)
    once = live.groupBy("tenant_id", "correlation_id", "message_id").agg(F.min("ts").alias("ts"))
    ranked = once.withColumn("place", F.row_number().over(Window.partitionBy("tenant_id", "correlation_id").orderBy("ts", "message_id")))
    listed = F.array_sort(F.collect_list(F.when(F.col("place") <= capacity, F.struct("place", "message_id"))))
    out = ranked.groupBy("tenant_id", "correlation_id").agg(F.count("*").alias("commands"), F.transform(listed, lambda x: x["message_id"]).alias("message_ids"))
    outcome = F.when(F.col("commands") > capacity, "Overflow").when(F.col("commands") > 1, "Ambiguous").otherwise("Resolved")
    return out.select("tenant_id", "correlation_id", "commands", outcome.alias("outcome"), F.array_join("message_ids", ",").alias("message_ids"))


def replay_eligibility(asked: DataFrame, statuses: DataFrame) -> DataFrame:
    """Whether each asked command (tenant_id, message_id) can be replayed: Eligible, NotReplayable by its latest status, or Conflict where it has none."""
    found = asked.join(latest_status(statuses).select("tenant_id", "message_id", "status"), ["tenant_id", "message_id"], "left")
    outcome = F.when(F.col("status").isNull(), "Conflict").when(F.col("status").isin(*REPLAYABLE), "Eligible").otherwise("NotReplayable")
    return found.select("tenant_id", "message_id", "status", outcome.alias("outcome"))


def idempotency(commands: DataFrame, records: DataFrame, now: Column) -> DataFrame:
    """How each command (message_id, causation_id, command_type) stands to the records of those processed before.

    A record is found by message id, else (older ones) by causation id. None: Miss. One whose message, causation or
    type differ, or that lacks a disposition or an end: IdentityConflict. Past its end: Expired. Found by causation
    id: LegacyMigration. Then by disposition: RetryableRecoverable, or ExactTerminalDuplicate.
    Records have unique ``key``s.
    """
    names = ("message_id", "causation_id", "command_type", "disposition", "expires_at")
    own = records.select(F.col("key").alias("message_id"), F.struct(*names).alias("own"))
    old = records.select(F.col("key").alias("causation_id"), F.struct(*names).alias("old"))
    joined = commands.join(own, "message_id", "left").join(old, "causation_id", "left")
    direct = F.col("own").isNotNull()
    record = F.when(direct, F.col("own")).when(F.col("message_id") != F.col("causation_id"), F.col("old"))
    told = joined.withColumn("r", record)
    same = F.lit(True)
    for name in names[:3]:
        same = same & F.col(name).eqNullSafe(F.col("r")[name])
    conflict = ~same | F.col("r.disposition").isNull() | F.col("r.expires_at").isNull()
    outcome = (
        F.when(F.col("r").isNull(), "Miss").when(conflict, "IdentityConflict").when(F.col("r.expires_at") <= now, "Expired").when(~direct, "LegacyMigration")
        .when(F.col("r.disposition") == "Recoverable", "RetryableRecoverable").otherwise("ExactTerminalDuplicate")
    )
    return told.select(*commands.columns, outcome.alias("outcome"))


def rate_limited(requests: DataFrame, tenant_limit: int = 1000, tenant_seconds: int = 60, segments: int = 6, consumer_limit: int = 100, consumer_seconds: int = 1) -> DataFrame:
    """Requests (tenant_id, consumer_id, request_id, ts) that the chained limits would have refused, and by which: counts, so those refused before count too.

    Tenants have a window of ``segments`` that slides with the segments, consumers a fixed one. Within a window requests
    count in order of ts, then id. The limits hold whole requests by windows; no stream is folded in one task but a tenant's segment.
    """
    length = tenant_seconds // segments
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    rows = requests.withColumn("segment", F.floor(at / length)).withColumn("second", F.floor(at / consumer_seconds))
    sums = rows.groupBy("tenant_id", "segment").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("tenant_id").orderBy("segment").rangeBetween(1 - segments, -1))
    held = sums.select("tenant_id", "segment", F.coalesce(before, F.lit(0)).alias("before"))
    in_segment = F.row_number().over(Window.partitionBy("tenant_id", "segment").orderBy("ts", "request_id"))
    in_second = F.row_number().over(Window.partitionBy("tenant_id", "consumer_id", "second").orderBy("ts", "request_id"))
    ranked = rows.withColumn("in_second", in_second).withColumn("in_segment", in_segment).join(held, ["tenant_id", "segment"])
    reason = F.when(F.col("before") + F.col("in_segment") > tenant_limit, "tenant").when(F.col("in_second") > consumer_limit, "consumer")
    return ranked.withColumn("limited_by", reason).where(F.col("limited_by").isNotNull()).select(*requests.columns, "limited_by")


def drain_plan(records: DataFrame) -> DataFrame:
    """When each record of unpublished events (failed_at, retry_count, dead_lettered) is tried next: after 30 seconds, then minute by minute, at most half an hour after the failure; from 8 attempts on it goes to the dead letters instead."""
    delay = F.least(F.lit(DRAIN_MOST), F.lit(DRAIN_FIRST) + F.col("retry_count") * DRAIN_EVERY)
    over = F.col("dead_lettered") | (F.col("retry_count") >= DRAIN_ATTEMPTS)
    next_ = F.when(~over, F.col("failed_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), delay))
    return records.withColumn("action", F.when(F.col("dead_lettered"), "none").when(over, "dead-letter").otherwise("retry")).withColumn("next_attempt", next_)


def dead_letters(commands: DataFrame, stage: Column, reason: Column, at: Column, drained: bool = False) -> DataFrame:
    """Dead-letter messages: identity, the command whole, at what stage and why it failed; from an exception, or from a drain that gave up."""
    kind = F.lit("DrainExhausted" if drained else "Exception")
    return commands.select("tenant_id", "domain", "aggregate_id", "correlation_id", kind.alias("origin"), stage.alias("failure_stage"), reason.alias("reason"), at.alias("failed_at"), F.to_json(F.struct(*commands.columns)).alias("command"))
