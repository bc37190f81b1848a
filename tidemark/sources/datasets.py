"""A dataset for measurements: streams, events and snapshots, made by rule, written, read back and held against its definition."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.event_log import ID


@dataclass(frozen=True)
class Definition:
    """``events`` for each of ``streams`` streams, dealt to ``tenants``; a snapshot each ``interval`` events."""

    streams: int
    events: int
    tenants: int = 3
    interval: int = 100
    domain: str = "counter"
    kind: str = "CounterIncremented"


def events(spark: SparkSession, d: Definition) -> DataFrame:
    rows = spark.range(d.streams * d.events)
    stream, turn = F.floor(F.col("id") / d.events), F.col("id") % d.events + 1
    return rows.select(
        F.concat(F.lit("tenant-"), stream % d.tenants).alias("tenant_id"), F.lit(d.domain).alias("domain"), F.concat(F.lit("stream-"), stream).alias("aggregate_id"),
        turn.alias("sequence_number"), (F.col("id") + 1).alias("global_position"), F.concat(F.lit("msg-"), F.col("id")).alias("message_id"),
        F.lit(d.kind).alias("event_type_name"), F.lit("{}").alias("payload"), F.lit("json").alias("serialization_format"),
        F.timestamp_seconds(F.lit(1_767_225_600) + F.col("id")).alias("ts"),
    )


def snapshots(log: DataFrame, d: Definition) -> DataFrame:
    at = (F.floor(F.max("sequence_number") / d.interval) * d.interval).cast("long")
    return log.groupBy(*ID).agg(at.alias("sequence_number")).where("sequence_number > 0")


def write(spark: SparkSession, d: Definition, path: str) -> None:
    log = events(spark, d)
    log.write.mode("overwrite").partitionBy("tenant_id").parquet(f"{path}/events")
    snapshots(log, d).write.mode("overwrite").parquet(f"{path}/snapshots")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/events"), spark.read.parquet(f"{path}/snapshots")


def fingerprint(log: DataFrame) -> str:
    """One digest of all events, whatever their order: the sum of a hash of each over its identity, sequence, message, type and payload."""
    own = F.xxhash64(*ID, "sequence_number", "message_id", "event_type_name", "payload").cast("decimal(38,0)")
    row = log.agg(F.sum(own).alias("s"), F.count("*").alias("n")).first()
    return f"{row.n}:{row.s or 0}"


def faults(log: DataFrame, found: DataFrame, d: Definition) -> DataFrame:
    """Streams that aren't as defined: (identity, fault) for a wrong count, a sequence that isn't 1 to the count, or a wrong snapshot; a row of nulls where the number of streams is wrong."""
    per = log.groupBy(*ID).agg(F.count("*").alias("n"), F.min("sequence_number").alias("low"), F.max("sequence_number").alias("top"), F.countDistinct("sequence_number").alias("distinct"))
    due = d.events // d.interval * d.interval
    joined = per.join(found.select(*ID, F.col("sequence_number").alias("snapshot")), list(ID), "left")
    fault = F.when(F.col("n") != d.events, "EventCount").when((F.col("low") != 1) | (F.col("top") != d.events) | (F.col("distinct") != d.events), "Sequence").when(F.coalesce("snapshot", F.lit(0)) != due, "Snapshot")
    whole = per.agg(F.count("*").alias("streams")).where(F.col("streams") != d.streams).select(*[F.lit(None).cast("string").alias(c) for c in ID], F.lit("StreamCount").alias("fault"))
    return joined.withColumn("fault", fault).where(F.col("fault").isNotNull()).select(*ID, "fault").unionByName(whole)
