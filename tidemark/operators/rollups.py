"""Roll-ups of streams, storage, commands and activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.sources.event_log import ID, STATUSES

STATUS_GROUPS = {
    "completed": ("Completed",),
    "processing": STATUSES[:4],
    "rejected": ("Rejected",),
    "failed": ("PublishFailed", "TimedOut"),
}


def stream_summary(log: DataFrame) -> DataFrame:
    return log.groupBy(*ID).agg(F.count("*").alias("event_count"), F.max("sequence_number").alias("last_sequence"), F.max("ts").alias("last_activity"))


def tenants(log: DataFrame) -> DataFrame:
    """Every tenant with its domains, streams, events and last activity."""
    streams = log.groupBy(*ID).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return streams.groupBy("tenant_id").agg(F.countDistinct("domain").alias("domains"), F.count("*").alias("streams"), F.sum("n").alias("events"), F.max("last").alias("last_activity"))


def storage_scopes(log: DataFrame) -> DataFrame:
    """Events and streams of each tenant and of all (tenant_id 'all'), in one pass by grouping sets over stream counts."""
    streams = log.groupBy(*ID).agg(F.count("*").alias("n"))
    both = streams.rollup("tenant_id").agg(F.sum("n").alias("total_events"), F.count("*").alias("total_streams"), F.grouping("tenant_id").alias("whole"))
    return both.select(F.when(F.col("whole") == 1, "all").otherwise(F.col("tenant_id")).alias("scope"), "total_events", "total_streams")


def storage_by_type(log: DataFrame, snapshots: DataFrame) -> DataFrame:
    """By tenant, domain and aggregate type: events, payload size (null unless known for all streams), streams with and without a snapshot.

    The aggregate type is the log's ``aggregate_type``, or made from the domain where it has no such column.
    """
    kind = F.col("aggregate_type") if "aggregate_type" in log.columns else scalars.aggregate_label(F.col("domain"))
    size = F.when(F.count("payload") == F.count("*"), F.sum(F.octet_length("payload")))
    streams = log.withColumn("aggregate_type", kind).groupBy(*ID, "aggregate_type").agg(F.count("*").alias("n"), size.alias("size"))
    joined = streams.join(snapshots.select(*ID, F.lit(1).alias("has")).distinct(), list(ID), "left")
    whole = F.when(F.count("size") == F.count("*"), F.sum("size"))
    return joined.groupBy("tenant_id", "domain", "aggregate_type").agg(F.sum("n").alias("event_count"), whole.alias("size_bytes"), F.count("has").alias("with_snapshot"), (F.count("*") - F.count("has")).alias("without_snapshot"))


def bar_chart(rows: DataFrame, label: str, value: str, top: int = 10) -> DataFrame:
    """The ``top`` sums of value by label, whose case doesn't count: the label as it is written first in order."""
    sums = rows.groupBy(F.lower(label).alias("__key")).agg(F.min(label).alias(label), F.sum(value).alias(value))
    return sums.orderBy(F.desc(value), "__key").limit(top).drop("__key")


def bucket_stats(buckets: DataFrame, count: str) -> DataFrame:
    return buckets.agg(F.max(count).alias("highest"), F.sum(count).alias("total"))


def growth(rows: DataFrame, value: str) -> DataFrame:
    """Mean of a value over the rows that have one, and how many have."""
    return rows.agg(F.avg(value).alias("average_growth"), F.count(value).alias("known"))


def most_behind(projections: DataFrame) -> DataFrame:
    """The projection with the largest lag, ties by name and tenant."""
    return projections.orderBy(F.desc("lag"), "name", "tenant_id").limit(1)


def mean_interval(log: DataFrame, every: int) -> DataFrame:
    """Mean sequence distance between the snapshots of each tenant, if one is taken each ``every`` events, and the payload bytes between them in sum."""
    marks = log.where(F.col("sequence_number") % every == 0)
    w = Window.partitionBy(*ID).orderBy("sequence_number")
    steps = marks.withColumn("step", F.col("sequence_number") - F.coalesce(F.lag("sequence_number").over(w), F.lit(0)))
    sizes = log.groupBy("tenant_id").agg(F.sum(F.octet_length("payload")).alias("payload_bytes"))
    return steps.groupBy("tenant_id").agg(F.avg("step").alias("mean_interval"), F.count("*").alias("snapshots")).join(sizes, "tenant_id", "right")


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key whose case doesn't count, by ``order``."""
    w = Window.partitionBy(*[F.lower(k) for k in keys]).orderBy(*order)
    return rows.withColumn("__place", F.row_number().over(w)).where("__place = 1").drop("__place")


def in_stable_order(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Sorted without regard to case, equal ones by their exact text; ``place`` from 1 on is for catalogs of a bounded size."""
    order = [x for c in columns for x in (F.lower(c), F.col(c))]
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def newly_seen(rows: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that ``before`` didn't hold, each once."""
    return rows.select(*keys).distinct().join(before.select(*keys).distinct(), keys, "left_anti")


def stream_status(log: DataFrame, now: Column, idle_after: str = "7 days", closing: tuple[str, ...] = ()) -> DataFrame:
    """Tombstoned if the stream holds an event that closes it, else Active, or Idle where its last event is older than ``idle_after``."""
    closed = F.bool_or(F.col("event_type_name").isin(*closing)) if closing else F.lit(False)
    own = log.groupBy(*ID).agg(F.max("ts").alias("last_activity"), closed.alias("closed"))
    status = F.when(F.col("closed"), "Tombstoned").when(F.col("last_activity") < now - F.expr(f"INTERVAL {idle_after}"), "Idle").otherwise("Active")
    return own.select(*ID, "last_activity", status.alias("status"))


def readable(log: DataFrame) -> DataFrame:
    """Rows with ``readability``: Readable where the payload is unprotected, Unreadable where only its provider could read it, NeedsKey where it is protected otherwise. The state is read from the ``extensions`` map; none is unprotected."""
    state = F.coalesce(F.try_element_at("extensions", F.lit("protection-state")), F.lit("Unprotected"))
    return log.withColumn("readability", F.when(state == "Unprotected", "Readable").when(state == "ProviderOpaque", "Unreadable").otherwise("NeedsKey"))


def top_and_other(counts: DataFrame, label: str, value: str, top: int) -> DataFrame:
    """The ``top`` rows by value, then label, and one row 'Other' with the sum of the rest, if any.

    The top rows come from a distributed top-k; the rest is the sum of all less the sum of them.
    """
    first = counts.orderBy(F.desc(value), label).limit(top)
    rest = counts.agg(F.sum(value).alias("s"), F.count("*").alias("n")).crossJoin(F.broadcast(first.agg(F.sum(value).alias("t"), F.count("*").alias("m"))))
    other = rest.where("n > m").select(F.lit("Other").alias(label), (F.col("s") - F.col("t")).alias(value))
    return first.select(label, value).unionByName(other)


def hot_streams(log: DataFrame, most: int = 100) -> DataFrame:
    counts = log.groupBy(*ID).agg(F.count("*").alias("event_count"))
    return counts.orderBy(F.desc("event_count"), *[F.lower(c) for c in ID], *ID).limit(most)


def recent_streams(log: DataFrame, most: int = 1000) -> DataFrame:
    return stream_summary(log).orderBy(F.desc("last_activity"), *ID).limit(most)


def recent_commands(commands: DataFrame, tenant: str | None = None, kind: str | None = None, status: str | None = None, count: int = 100) -> DataFrame:
    """Newest commands with total_count before the limit. Unknown statuses don't filter."""
    found = commands
    if tenant:
        found = found.where(F.lower("tenant_id") == tenant.lower())
    if kind:
        found = found.where(F.contains(F.lower("command_type"), F.lit(kind.lower())))
    group = STATUS_GROUPS.get((status or "").lower()) or tuple(s for s in STATUSES if s.lower() == (status or "").lower())
    if group:
        found = found.where(F.col("status").isin(*group))
    total = found.agg(F.count("*").alias("total_count"))
    return found.orderBy(F.desc("ts"), "correlation_id").limit(min(max(count, 1), 1000)).crossJoin(F.broadcast(total))


def activity_histogram(log: DataFrame, hours: int = 24) -> DataFrame:
    """Streams by the hour of their last activity, the last ``hours`` hours before the log's end, empty hours too."""
    last = log.groupBy(*ID).agg(F.max("ts").alias("last_activity"))
    now = log.agg(F.date_trunc("hour", F.max("ts")).cast("timestamp_ntz").alias("now"))
    spine = now.select(F.explode(F.expr(f"sequence(now - INTERVAL {hours - 1} HOURS, now, INTERVAL 1 HOUR)")).alias("bucket"))
    counts = last.groupBy(F.date_trunc("hour", "last_activity").cast("timestamp_ntz").alias("bucket")).agg(F.count("*").alias("n"))
    return spine.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("stream_count"))


def type_catalog(log: DataFrame) -> DataFrame:
    return log.groupBy("domain").agg(F.array_join(F.array_sort(F.collect_set("event_type_name")), ",").alias("event_types"), F.countDistinct("event_type_name").alias("type_count"))


def type_sample(log: DataFrame, most: int = 8) -> DataFrame:
    """The first ``most`` distinct event types of each stream by arrival, and how many more there are."""
    first = log.groupBy(*ID, "event_type_name").agg(F.min("sequence_number").alias("first"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy(*ID).orderBy("first")))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", "event_type_name")))), lambda x: x["event_type_name"]), ",")
    return ranked.groupBy(*ID).agg(names.alias("sample"), F.greatest(F.count("*") - most, F.lit(0)).alias("more"))


def rate_windows(log: DataFrame, limit: int, window: str = "60 seconds", slide: str = "10 seconds") -> DataFrame:
    """Sliding windows by tenant in which more events fall than the limit allows."""
    counts = log.groupBy("tenant_id", F.window(F.col("ts").cast("timestamp"), window, slide).alias("w")).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > limit).select("tenant_id", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n")


def pending_over(log: DataFrame, limit: int) -> DataFrame:
    """Streams with more pending (unfinished) commands than the limit."""
    return log.where(F.col("status").isin(*STATUS_GROUPS["processing"])).groupBy(*ID).agg(F.count("*").alias("pending")).where(F.col("pending") >= limit)
