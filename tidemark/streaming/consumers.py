"""Structured Streaming consumers: idempotent delivery, contiguous prefixes, poison rows to a side output."""

from __future__ import annotations

import json
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from tidemark.operators.folds import Counter, Reducer
from tidemark.sources.event_log import ID


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def read_topic(spark: SparkSession, schema: T.StructType, form: str = "kafka", **options) -> DataFrame:
    """Events from a topic in any streaming format that Spark has a connector for, their JSON ``value`` read by a schema."""
    raw = spark.readStream.format(form).options(**options).load()
    return from_topic(raw, schema)


def from_topic(raw: DataFrame, schema: T.StructType) -> DataFrame:
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("event")).select("event.*")


def once(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each message once, however often it is delivered within ``delay`` of event time."""
    return stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay).dropDuplicatesWithinWatermark(["message_id"]).drop("at")


def once_of_all(log: DataFrame) -> DataFrame:
    """The batch form: each message once, over the whole log."""
    return log.dropDuplicates(["message_id"])


def classify(stream: DataFrame, known: tuple[str, ...], handled: tuple[str, ...] | None = None) -> DataFrame:
    """A column ``problem`` of rows that are completed without being handled: UnsupportedFormat, UnknownEventType, InvalidPayload, NoHandler; null for the rest.

    ``known`` types can be read, those in ``handled`` (all of them, if not given) have a handler.
    """
    form = F.lower("serialization_format") if "serialization_format" in stream.columns else F.lit("json")
    problem = F.when(~form.eqNullSafe(F.lit("json")), "UnsupportedFormat").when(~F.coalesce(F.col("event_type_name").isin(*known), F.lit(False)), "UnknownEventType").when(F.try_parse_json("payload").isNull(), "InvalidPayload")
    problem = problem if handled is None else problem.when(~F.col("event_type_name").isin(*handled), "NoHandler")
    return stream.withColumn("problem", problem)


def contiguous(stream: DataFrame) -> DataFrame:
    """Events in order from 1, each once: what arrives early waits in the stream's state until the gap closes."""
    schema = "tenant_id string, domain string, aggregate_id string, sequence_number long, message_id string"
    state = "next long, sequences array<long>, messages array<string>"

    def step(key, batches, store):
        following, waiting = 1, {}
        if store.exists:
            following, sequences, messages = store.get
            waiting = dict(zip(sequences, messages, strict=True))
        for pdf in batches:
            for n, m in zip(pdf["sequence_number"], pdf["message_id"], strict=True):
                if n >= following:
                    waiting.setdefault(int(n), m)
        out = []
        while following in waiting:
            out.append((*key, following, waiting.pop(following)))
            following += 1
        store.update((following, list(waiting), list(waiting.values())))
        yield pd.DataFrame(out, columns=["tenant_id", "domain", "aggregate_id", "sequence_number", "message_id"])

    return stream.select(*ID, "sequence_number", "message_id").groupBy(*ID).applyInPandasWithState(step, schema, state, "append", GroupStateTimeout.NoTimeout)


def running(stream: DataFrame, reducer: Reducer) -> DataFrame:
    """The reducer's counters after each event of a stream, in order from 1, each event once: as in ``contiguous``, what arrives early waits in the stream's state until the gap closes.

    A file source goes by the times of its files, and files of one write may be finished in any order. What an event
    adds and resets is worked out in the JVM; the state of a stream is one number for each counter and what waits.
    Amounts are carried as decimals in text, so they add up exactly.
    """
    names = [n for n, rule in reducer.fields.items() if isinstance(rule, Counter)]
    rules = [reducer.fields[n] for n in names]
    amounts = []
    for rule in rules:
        own = F.lit(0).cast(rule.kind)
        for kind, expression in rule.add.items():
            own = F.when(F.col("event_type_name") == kind, F.expr(expression).cast(rule.kind)).otherwise(own)
        resets = F.col("event_type_name").isin(*rule.reset) if rule.reset else F.lit(False)
        amounts.append(F.struct(own.cast("string").alias("add"), resets.alias("reset")))
    floors = [rule.floor for rule in rules]
    columns = [*ID, "sequence_number", *names]
    schema = "tenant_id string, domain string, aggregate_id string, sequence_number long, " + ", ".join(f"`{n}` string" for n in names)

    def step(key, batches, store):
        following, sums, waiting = 1, [Decimal(0)] * len(names), {}
        if store.exists:
            following, sums, sequences, early = store.get
            sums, waiting = [Decimal(x) for x in sums], dict(zip(sequences, early, strict=True))
        for pdf in batches:
            for n, own in zip(pdf["sequence_number"], pdf["amounts"], strict=True):
                if n >= following:
                    waiting.setdefault(int(n), own)
        out = []
        while following in waiting:
            for k, x in enumerate(json.loads(waiting.pop(following))):
                total = Decimal(0) if x.get("reset") else sums[k]
                total += Decimal(x.get("add", "0"))
                sums[k] = max(total, Decimal(0)) if floors[k] else total
            out.append((*key, following, *map(str, sums)))
            following += 1
        store.update((following, [str(x) for x in sums], list(waiting), list(waiting.values())))
        yield pd.DataFrame(out, columns=columns)

    told = stream.select(*ID, "sequence_number", F.to_json(F.array(*amounts)).alias("amounts"))
    state = "next long, sums array<string>, sequences array<long>, early array<string>"
    folded = told.groupBy(*ID).applyInPandasWithState(step, schema, state, "append", GroupStateTimeout.NoTimeout)
    return folded.select(*ID, "sequence_number", *[F.col(n).cast(rule.kind).alias(n) for n, rule in zip(names, rules, strict=True)])


def contiguous_prefix(log: DataFrame) -> DataFrame:
    """The batch form: events up to the first gap, each once."""
    from pyspark.sql import Window

    seen = log.groupBy(*ID, "sequence_number").agg(F.min("message_id").alias("message_id"))
    return seen.withColumn("turn", F.row_number().over(Window.partitionBy(*ID).orderBy("sequence_number"))).where(F.col("turn") == F.col("sequence_number")).drop("turn")


def deliver(stream: DataFrame, handle, checkpoint: str, every: str | None = None):
    """Run ``handle(batch, batch_id)`` on each micro-batch: on all there is and stop, or by a processing-time interval."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def deliver_or_bury(stream: DataFrame, known: tuple[str, ...], handle, dead: str, checkpoint: str, every: str | None = None):
    """``deliver`` the rows without a problem; the others are written to dead letters at ``dead``, with what is wrong. A batch that runs again writes its dead letters to the same place."""

    def batch(rows: DataFrame, number: int) -> None:
        told = classify(rows, known).persist()
        try:
            told.where("problem IS NOT NULL").withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{dead}/batch={number}")
            handle(told.where("problem IS NULL").drop("problem"), number)
        finally:
            told.unpersist()

    return deliver(stream, batch, checkpoint, every)


class Handlers:
    """Event handlers by type: each gets the rows of its type in a micro-batch, one call a batch."""

    def __init__(self):
        self.own: dict[str, list] = {}

    def on(self, *kinds: str):
        def add(handler):
            for kind in kinds:
                if handler in self.own.setdefault(kind, []):
                    raise ValueError(f"registered twice for {kind}")
                self.own[kind].append(handler)
            return handler

        return add

    def __call__(self, batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            for kind, handlers in self.own.items():
                for handler in handlers:
                    handler(rows.where(F.col("event_type_name") == kind), number)
        finally:
            rows.unpersist()


def position_watermark(log: DataFrame) -> DataFrame:
    """The highest global position by tenant, if it is positive: what a cursor carries to say up to where it has read."""
    return log.groupBy("tenant_id").agg(F.max("global_position").alias("watermark")).where("watermark > 0")
