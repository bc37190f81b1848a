"""The event log as one DataFrame, and the relations derived from it.

Correlation and causation of the driver's ``events`` are invented here (three events a command; an event is
caused by the one before it in its stream unless its id divides by three), as the data has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ID = ("tenant_id", "domain", "aggregate_id")
STATUSES = ("Received", "Processing", "EventsStored", "EventsPublished", "Completed", "Rejected", "PublishFailed", "TimedOut")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_log(spark: SparkSession, path: str, form: str = "parquet", **options) -> DataFrame:
    """A stored log in any batch format that Spark reads (parquet, orc, json, csv, jdbc)."""
    return spark.read.format(form).options(**options).load(path)


def write_log(log: DataFrame, path: str, mode: str = "append") -> None:
    """Lay a log out so that stream reads prune: by tenant and domain, sorted by stream and sequence within files."""
    by = log.sparkSession.conf.get("spark.sql.shuffle.partitions")
    log.repartition(int(by), *ID).sortWithinPartitions(*ID, "sequence_number").write.mode(mode).partitionBy("tenant_id", "domain").parquet(path)


def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical log of ``events``: identity, sequence, position, message, correlation, causation, type, value, payload, ts."""
    e = table(spark, sf_dir, "events")
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = F.lag(F.concat(F.lit("m-"), F.col("event_id"))).over(by_user)
    numbered = e.withColumn("sequence_number", F.row_number().over(by_user).cast("long")).withColumn("before", before)
    return numbered.select(
        F.concat(F.lit("tenant-"), F.col("user_id") % 3).alias("tenant_id"), F.lit("activity").alias("domain"), F.concat(F.lit("user-"), F.col("user_id")).alias("aggregate_id"),
        "sequence_number", (F.col("event_id") + 1).alias("global_position"), F.concat(F.lit("m-"), F.col("event_id")).alias("message_id"),
        F.concat(F.lit("c-"), F.col("user_id"), F.lit("-"), F.floor((F.col("sequence_number") - 1) / 3)).alias("correlation_id"),
        F.when(F.col("event_id") % 3 != 0, F.coalesce("before", F.lit(""))).otherwise("").alias("causation_id"),
        F.col("event_type").alias("event_type_name"), "value", F.col("props").alias("payload"), "ts", "event_id", F.col("user_id").cast("string").alias("user_id"),
    )


def with_gaps(log: DataFrame) -> DataFrame:
    """The log without every 97th event, numbered before they went."""
    return log.where(F.col("event_id") % 97 != 0)


def with_repeats(log: DataFrame) -> DataFrame:
    """The log with every 101st event delivered twice."""
    return log.unionByName(log.where(F.col("event_id") % 101 == 0))


def commands(log: DataFrame) -> DataFrame:
    """One command for each correlation id, with a status by its first event."""
    first = log.groupBy(*ID, "correlation_id").agg(F.min("event_id").alias("first_event"), F.min("ts").alias("ts"), F.min_by("event_type_name", "event_id").alias("command_type"))
    return first.withColumn("status_code", (F.col("first_event") % 8).cast("int")).withColumn("status", F.element_at(F.array(*map(F.lit, STATUSES)), F.col("status_code") + 1))


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples (component, status, severity, captured_at, sample_id) made from ``events``."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "Unhealthy").when(F.col("event_type") == "view", "Degraded").otherwise("Healthy")
    return e.select(F.concat(F.lit("component-"), F.col("user_id") % 5).alias("component"), status.alias("status"), severity(status).alias("severity"), F.col("ts").alias("captured_at"), F.col("event_id").alias("sample_id"))


def severity(status: Column) -> Column:
    return F.when(status == "Unhealthy", 2).when(status == "Degraded", 1).otherwise(0)
