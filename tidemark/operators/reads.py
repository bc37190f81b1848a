"""Stream reads: ranges, pages, timelines, details and heads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.sources.event_log import ID, write_log
from tidemark.sources.scratch import held

PAGE_LIMIT, TIMELINE_LIMIT, SEQUENCE_LIMIT = 1000, 1000, (1 << 31) - 1


class InvalidRead(ValueError):
    """Arguments that a read refuses."""


def of(log: DataFrame, tenant: str, domain: str, aggregate: str) -> DataFrame:
    """One stream: tenant and domain ignore case, the aggregate id doesn't."""
    return log.where((F.col("tenant_id") == tenant.lower()) & (F.col("domain") == domain.lower()) & (F.col("aggregate_id") == aggregate))


def after(sequence: int) -> Column:
    return F.col("sequence_number") > max(sequence, 0)


def read_range(stream: DataFrame, start: int, to: int | None = None, most: int | None = None) -> DataFrame:
    """Events above ``start`` (negative: 0) up to and with ``to``, at most ``most``, in order."""
    found = stream.where(after(start))
    if to is not None:
        found = found.where(F.col("sequence_number") <= to)
    found = found.orderBy("sequence_number")
    return found if most is None else found.limit(most)


def read_whole(stream: DataFrame, start: int = 0) -> DataFrame:
    """Events above ``start`` in order; a stream that lacks one of them is refused when it is read."""
    found = stream.where(after(start))
    step = F.col("sequence_number") - F.coalesce(F.lag("sequence_number").over(Window.partitionBy(*ID).orderBy("sequence_number")), F.lit(max(start, 0)))
    sound = F.when(step == 1, F.col("sequence_number")).otherwise(F.raise_error(F.concat(F.lit("missing or repeated event before "), F.col("sequence_number"))).cast("long"))
    return found.withColumn("sequence_number", sound).orderBy("sequence_number")


def check_page(start: int, size: int, to: int | None = None, token: str | None = None) -> None:
    """Refuse a page's arguments: size first, then the range, then any continuation token, which no read binds to a request yet."""
    if not 1 <= size <= PAGE_LIMIT:
        raise InvalidRead(f"page size must be 1 to {PAGE_LIMIT}")
    if not 0 <= start <= SEQUENCE_LIMIT or (to is not None and not start <= to <= SEQUENCE_LIMIT):
        raise InvalidRead("from must not be negative or above to, and both are 32-bit numbers")
    if token is not None:
        raise InvalidRead("continuation tokens are not taken")


def read_page(stream: DataFrame, start: int, size: int, to: int | None = None, token: str | None = None) -> DataFrame:
    """A page with is_truncated, latest_sequence and last_returned on each row; one more row is fetched to tell whether more follow."""
    check_page(start, size, to, token)
    more = read_range(stream, start, to, size + 1)
    facts = more.agg(F.count("*").alias("n"))
    page = more.orderBy("sequence_number").limit(size)
    latest = stream.agg(F.max("sequence_number").alias("latest_sequence"))
    last = page.agg(F.max("sequence_number").alias("last_returned"))
    return page.crossJoin(F.broadcast(facts)).crossJoin(F.broadcast(latest)).crossJoin(F.broadcast(last)).withColumn("is_truncated", F.col("n") > size).drop("n")


def timeline(stream: DataFrame, start: int | None = None, to: int | None = None, count: int = 100) -> DataFrame:
    """Entries from ``start`` to ``to``, both included, with total_count before the limit and next_token (last + 1, null on the last page)."""
    count = min(max(count, 1), TIMELINE_LIMIT)
    found = stream
    if start is not None:
        found = found.where(F.col("sequence_number") >= start)
    if to is not None:
        found = found.where(F.col("sequence_number") <= to)
    total = found.agg(F.count("*").alias("total_count"), F.max("sequence_number").alias("top"))
    page = found.orderBy("sequence_number").limit(count)
    last = page.agg(F.max("sequence_number").alias("last"))
    out = page.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(last))
    return out.withColumn("next_token", F.when(F.col("last") < F.col("top"), F.col("last") + 1)).drop("top", "last")


def detail(stream: DataFrame, sequence: int) -> DataFrame:
    if sequence < 1:
        raise InvalidRead("sequence must be 1 or more")
    return stream.where(F.col("sequence_number") == sequence)


def heads(log: DataFrame) -> DataFrame:
    return log.groupBy(*ID).agg(F.max("sequence_number").alias("current_sequence"), F.max("ts").alias("last_modified"))


def append(log: DataFrame, rows: DataFrame) -> DataFrame:
    """New events (identity, message_id, ..., ``position`` in the batch) numbered behind their stream's head and, as one dense block, behind the last global position.

    Rows are numbered within streams, and all in order of ``position``, holes and ties in it or not (ties by message id).
    The order over the whole batch is made of sorted ranges: each range's size, one row a range, is summed up, so no task holds the batch.
    """
    spark = log.sparkSession
    order = ("position", "message_id")
    top = log.agg(F.coalesce(F.max("global_position"), F.lit(0)).alias("top"))
    sorted_ = held(rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("range", F.spark_partition_id()))
    sizes = sorted_.groupBy("range").agg(F.count("*").alias("size"))
    starts = sizes.select("range", (F.sum("size").over(Window.orderBy("range")) - F.col("size")).alias("start"))  # one row a range
    placed = sorted_.join(F.broadcast(starts), "range").withColumn("place", F.col("start") + F.row_number().over(Window.partitionBy("range").orderBy(*order)))
    turned = placed.withColumn("turn", F.row_number().over(Window.partitionBy(*ID).orderBy("place")))
    joined = turned.join(heads(log).select(*ID, "current_sequence"), list(ID), "left").crossJoin(F.broadcast(top))
    numbered = joined.withColumn("sequence_number", F.coalesce("current_sequence", F.lit(0)) + F.col("turn")).withColumn("global_position", F.col("top") + F.col("place"))
    return numbered.drop("turn", "current_sequence", "top", "range", "start", "place")


def append_batch(log: DataFrame, rows: DataFrame, at: Column, path: str | None = None) -> DataFrame:
    """``append`` with one timestamp ``at`` for the batch and ``causation_id`` set to the correlation where it has none; written behind the log at ``path``, if there is one."""
    out = append(log, rows).withColumn("ts", at.cast(log.schema["ts"].dataType))
    if {"causation_id", "correlation_id"} <= set(out.columns):
        out = out.withColumn("causation_id", F.coalesce("causation_id", "correlation_id"))
    if path is not None:
        write_log(out, path)
    return out


def export_lines(log: DataFrame, cloud_events: bool) -> DataFrame:
    """The log with a ``line`` of JSON for each event: plain, or CloudEvents 1.0."""
    if not cloud_events:
        return log.withColumn("line", F.to_json(F.struct(*log.columns)))
    subject = F.concat(F.concat_ws("/", *ID), F.lit("#"), F.col("sequence_number"))
    source = F.concat(F.lit("tidemark/"), F.col("tenant_id"), F.lit("/"), F.col("domain"))
    own = F.struct(F.lit("1.0").alias("specversion"), F.col("message_id").alias("id"), source.alias("source"), F.col("event_type_name").alias("type"), subject.alias("subject"), F.col("ts").alias("time"), F.lit("application/json").alias("datacontenttype"), F.col("payload").alias("data"))
    return log.withColumn("line", F.to_json(own))


def export(stream: DataFrame, most: int = 50_000, cloud_events: bool = False) -> DataFrame:
    """JSON lines of the newest ``most`` events of a stream: plain, or CloudEvents 1.0."""
    top = stream.agg(F.max("sequence_number").alias("head"))
    found = stream.crossJoin(F.broadcast(top)).where(F.col("sequence_number") > F.col("head") - most).drop("head")
    return export_lines(found, cloud_events).select("sequence_number", "line")


def published(log: DataFrame) -> DataFrame:
    """Events as CloudEvents by topic: topic, key (the stream), value; what a topic sink such as Kafka's takes."""
    return export_lines(log, True).select(scalars.topic(F.col("tenant_id"), F.col("domain")).alias("topic"), F.concat_ws(":", *ID).alias("key"), F.col("line").alias("value"))


def snapshot_tail(log: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Events behind each stream's snapshot; all of them where it has none."""
    own = snapshots.select(*ID, F.col("sequence_number").alias("snapshot_sequence"))
    return log.join(own, list(ID), "left").where(F.col("sequence_number") > F.coalesce("snapshot_sequence", F.lit(0)))
