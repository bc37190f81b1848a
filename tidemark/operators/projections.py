"""Read models: rebuilds, checkpoints, freshness, retries, snapshots due, and prefix fingerprints."""

from __future__ import annotations

import base64
import hashlib
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import folds
from tidemark.sources.event_log import ID


def counter(log: DataFrame) -> DataFrame:
    """The counter read model by plain sums: unknown event types are skipped, as a projection does."""
    return folds.at(log, None, folds.Reducer({"count": folds.DEMO.fields["count"]})).select(*ID, "count")


def rebuild_equals_replay(log: DataFrame, served: DataFrame) -> DataFrame:
    """Streams where the served model differs from a replay (none, if they agree)."""
    fresh = counter(log).withColumnRenamed("count", "replayed")
    return fresh.join(served, list(ID), "full_outer").where(~F.col("replayed").eqNullSafe(F.col("count"))).select(*ID, "replayed", "count")


def rebuild(log: DataFrame, path: str) -> DataFrame:
    """The counter read model built anew beside the served one, in a folder of its own, read back and held against a replay before it is returned; a model that differs is refused."""
    counter(log).write.mode("overwrite").parquet(path)
    staged = log.sparkSession.read.parquet(path)
    if not rebuild_equals_replay(log, staged).isEmpty():
        raise ValueError(f"the rebuilt model at {path} isn't what a replay gives")
    return staged


def checkpoints(old: DataFrame, new: DataFrame) -> DataFrame:
    """Delivered sequences by (projection, stream): never moved back."""
    keys = ["projection", *ID]
    return old.select(*keys, "sequence").unionByName(new.select(*keys, "sequence")).groupBy(*keys).agg(F.max("sequence").alias("sequence"))


def freshness(age_seconds: Column, aging: float, stale: float) -> Column:
    age = F.greatest(age_seconds, F.lit(0))
    return F.when(age_seconds.isNull(), "Unknown").when(age <= aging, "Current").when(age <= stale, "Aging").otherwise("Stale")


def retry_delay(attempt: Column, base: float = 1.0, most: float = 300.0) -> Column:
    """Seconds before an attempt: base doubled each time, ``most`` at most."""
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), attempt - 1))


def snapshot_due(heads: DataFrame, snapshots: DataFrame, interval: Column) -> DataFrame:
    joined = heads.join(snapshots.select(*ID, F.col("sequence_number").alias("last_snapshot")), list(ID), "left")
    return joined.withColumn("interval", F.greatest(interval, F.lit(10))).withColumn("behind", F.col("current_sequence") - F.coalesce("last_snapshot", F.lit(0))).where("behind >= interval").select(*ID, "current_sequence", "behind", "interval")


def with_policies(streams: DataFrame, policies: DataFrame) -> DataFrame:
    """Streams with the interval of the closest snapshot policy (tenant_id, domain, aggregate_id, interval; null parts hold for all): the stream's, the tenant's domain's, the domain's, or 100; 10 at least.

    Three equi-joins on what a policy names; policies have one row for each name.
    """
    own = policies.where("aggregate_id IS NOT NULL").select(*ID, F.col("interval").alias("__own"))
    pair = policies.where("aggregate_id IS NULL AND tenant_id IS NOT NULL").select("tenant_id", "domain", F.col("interval").alias("__pair"))
    domain = policies.where("aggregate_id IS NULL AND tenant_id IS NULL").select("domain", F.col("interval").alias("__domain"))
    found = streams.join(own, list(ID), "left").join(pair, ["tenant_id", "domain"], "left").join(domain, "domain", "left")
    return found.select(*streams.columns, F.greatest(snapshot_interval(F.col("__own"), F.col("__pair"), F.col("__domain")), F.lit(10)).alias("interval"))


def snapshot_interval(own: Column, pair: Column, domain: Column) -> Column:
    """The stream's own policy, then that of tenant and domain, then of the domain, then 100."""
    return F.coalesce(own, pair, domain, F.lit(100))


RETRY_ATTEMPTS = 8


def retry_plan(failed: DataFrame, attempts: int = RETRY_ATTEMPTS) -> DataFrame:
    """Failed deliveries (failed_at, attempt) with the time of the next attempt; none, and exhausted, once ``attempts`` were made."""
    over = F.col("attempt") >= attempts
    wait = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), retry_delay(F.col("attempt")))
    return failed.withColumn("exhausted", over).withColumn("next_attempt", F.when(~over, F.col("failed_at") + wait))


def last_receipts(receipts: Column, most: int = 256) -> Column:
    return F.when(F.size(receipts) > most, F.slice(receipts, -most, most)).otherwise(receipts)


def labels(namespace: str) -> tuple[bytes, bytes, bytes]:
    """What the digests of events, first prefixes and steps begin with; stored fingerprints agree only with those of their own namespace."""
    return tuple(f"{namespace}.{x}.v1".encode() for x in ("event", "prefix", "step"))


NAMESPACE = "projection.delivery"


def _part(value: str | bytes | None) -> bytes:
    if value is None:
        return struct.pack("<i", -1)
    raw = value.encode() if isinstance(value, str) else value
    return struct.pack("<i", len(raw)) + raw


def ticks(log: DataFrame) -> Column:
    """The events' ``ts`` in steps of 100 ns since the year 1, UTC; a time without zone is taken as UTC. Null is -1."""
    if isinstance(log.schema["ts"].dataType, T.TimestampNTZType):
        micros = F.expr("cast(cast(cast(ts - TIMESTAMP_NTZ'1970-01-01 00:00:00' as interval second) as decimal(20, 6)) * 1000000 as bigint)")
    else:
        micros = F.unix_micros("ts")
    return F.coalesce(micros * 10 + F.lit(621_355_968_000_000_000), F.lit(-1))


def prefix_fingerprints(log: DataFrame, name: str, namespace: str = NAMESPACE) -> DataFrame:
    """A hash chain over each stream's events: fingerprint of the prefix up to its head, in a ``namespace`` of the caller's.

    An event's digest covers sequence, message id, type, payload, format, ticks, correlation and user; format
    (``serialization_format``) and user (``user_id``) are null where the log has no such column.

    The chain is sequential within a stream, so a stream's rows meet in one task; only the digest is carried
    from batch to batch, whatever its length.
    """
    schema = "tenant_id string, domain string, aggregate_id string, sequence_number long, fingerprint string"
    event_label, prefix_label, step_label = labels(namespace)

    def text(digest: bytes) -> str:
        return "v1:" + base64.urlsafe_b64encode(digest).decode().rstrip("=")

    def run(batches):
        now, state, last = None, b"", 0
        for pdf in batches:
            done = []
            for r in pdf.itertuples(index=False):
                key = (r.tenant_id, r.domain, r.aggregate_id)
                if key != now:
                    if now is not None:
                        done.append((*now, last, text(state)))
                    now, state = key, hashlib.sha256(prefix_label + b"".join(map(_part, (*key, name)))).digest()
                told = _part(r.message_id) + _part(r.event_type_name) + _part(r.payload) + _part(r.format)
                event = hashlib.sha256(event_label + struct.pack("<q", r.sequence_number) + told + struct.pack("<q", r.ticks) + _part(r.correlation_id) + _part(r.user)).digest()
                state, last = hashlib.sha256(step_label + state + event).digest(), r.sequence_number
            if done:
                yield pd.DataFrame(done, columns=["tenant_id", "domain", "aggregate_id", "sequence_number", "fingerprint"])
        if now is not None:
            yield pd.DataFrame([(*now, last, text(state))], columns=["tenant_id", "domain", "aggregate_id", "sequence_number", "fingerprint"])

    kept = [(F.col(c) if c in log.columns else F.lit(None)).cast("string").alias(own) for c, own in (("serialization_format", "format"), ("user_id", "user"))]
    dealt = log.select(*ID, "sequence_number", "message_id", "event_type_name", "payload", "correlation_id", ticks(log).alias("ticks"), *kept).repartition(*ID).sortWithinPartitions(*ID, "sequence_number")
    return dealt.mapInPandas(run, schema)
