"""Health samples: uptime, transitions, latest and slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars


def uptime(samples: DataFrame) -> DataFrame:
    up = F.avg(F.when(F.col("status") == "Healthy", 1.0).otherwise(0.0)) * 100
    return samples.groupBy("component").agg(F.round(up, 6).alias("uptime_percent"), F.count("*").alias("samples"))


def mean_uptime(samples: DataFrame) -> DataFrame:
    """The mean of the components' uptimes, whatever number of samples each has."""
    return uptime(samples).agg(F.round(F.avg("uptime_percent"), 6).alias("mean_uptime"), F.count("*").alias("components"))


def overall(store_failed: Column, local_missing: Column, remote: Column, server_failed: Column) -> Column:
    """The system's status: a failed state store or missing local metadata is Unhealthy; a remote that isn't known to be well, or a failed server, Degraded."""
    return F.when(store_failed | local_missing, "Unhealthy").when(~F.coalesce(remote, F.lit("")).isin("NotConfigured", "Available") | server_failed, "Degraded").otherwise("Healthy")


def write_history(samples: DataFrame, path: str) -> None:
    """Append samples to partitions by UTC day key; days that have expired go as whole folders."""
    samples.withColumn("day", scalars.day_key(F.col("captured_at"))).write.mode("append").partitionBy("day").parquet(path)


def history(spark: SparkSession, path: str, since: str, to: str) -> DataFrame:
    """Samples of the days (yyyyMMdd) from ``since`` to ``to``; other days' folders aren't read."""
    return spark.read.parquet(path).where(F.col("day").cast("string").between(since, to))


def transitions(samples: DataFrame) -> DataFrame:
    """Changes of status by component, with seconds since the change before (or the first sample)."""
    w = Window.partitionBy("component").orderBy("captured_at", "sample_id")
    marked = samples.withColumn("previous_status", F.lag("status").over(w))
    kept = marked.where(F.col("previous_status").isNull() | (F.col("previous_status") != F.col("status")))
    seconds = F.expr("timestampdiff(SECOND, before, captured_at)")
    timed = kept.withColumn("before", F.lag("captured_at").over(w)).where(F.col("previous_status").isNotNull())
    return timed.select("component", "previous_status", "status", "captured_at", seconds.cast("long").alias("seconds_since"))


def latest(samples: DataFrame) -> DataFrame:
    own = F.struct("status", "captured_at", "sample_id")
    return samples.groupBy("component").agg(F.max_by(own, F.struct("captured_at", "sample_id")).alias("s")).select("component", "s.*")


def slots(samples: DataFrame, every: str = "DAY") -> DataFrame:
    """The worst status of each component in each slot (DAY or HOUR) of the samples; null where it has none."""
    slot = F.date_trunc(every, "captured_at").cast("timestamp_ntz")
    span = samples.agg(F.min(slot).alias("a"), F.max(slot).alias("b")).select(F.explode(F.expr(f"sequence(a, b, INTERVAL 1 {every})")).alias("slot"))
    spine = samples.select("component").distinct().crossJoin(F.broadcast(span))
    worst = samples.groupBy("component", slot.alias("slot")).agg(F.max("severity").alias("severity"))
    names = F.when(F.col("severity") == 2, "Unhealthy").when(F.col("severity") == 1, "Degraded").when(F.col("severity") == 0, "Healthy")
    return spine.join(worst, ["component", "slot"], "left").select("component", "slot", names.alias("status"))
