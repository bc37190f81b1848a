"""Two small domains, as reducers and deciders over all streams at once: a counter and a greeting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.folds import Counter, Latest, Reducer

COUNTER = Reducer(
    {"count": Counter({"CounterIncremented": "1", "CounterDecremented": "-1"}, ("CounterReset",)), "is_terminated": Latest("true", ("CounterClosed",))},
    ("CounterIncremented", "CounterDecremented", "CounterReset", "CounterClosed", "CounterCannotGoNegative", "AggregateTerminated"),
)
GREETING = Reducer({"message_count": Counter({"GreetingSent": "1"})}, ("GreetingSent",))

TERMINATED = "AggregateTerminated"


def guarded(rows: DataFrame, decider) -> DataFrame:
    """A decider behind the termination guard: a stream whose ``is_terminated`` is true rejects every command."""
    closed = F.coalesce("is_terminated", F.lit(False))
    told = decider(rows)
    return told.withColumn("outcome", F.when(closed, "rejected").otherwise(F.col("outcome"))).withColumn("produced", F.when(closed, TERMINATED).otherwise(F.col("produced")))


def _decided(rows: DataFrame, outcome: Column, produced: Column) -> DataFrame:
    return rows.withColumn("outcome", F.coalesce(outcome, F.lit("error"))).withColumn("produced", produced)


def counter_commands(rows: DataFrame) -> DataFrame:
    """Outcome (accepted, rejected, no-op; error for a command that the domain doesn't know) and produced event of ``command`` on ``count``."""
    zero, command = F.coalesce("count", F.lit(0)) == 0, F.col("command")
    outcome = F.when(command == "DecrementCounter", F.when(zero, "rejected").otherwise("accepted")).when(command == "ResetCounter", F.when(zero, "no-op").otherwise("accepted")).when(command.isin("IncrementCounter", "CloseCounter"), "accepted")
    produced = F.when(command == "IncrementCounter", "CounterIncremented").when(command == "CloseCounter", "CounterClosed").when(command == "DecrementCounter", F.when(zero, "CounterCannotGoNegative").otherwise("CounterDecremented")).when((command == "ResetCounter") & ~zero, "CounterReset")
    return _decided(rows, outcome, produced)


def counter(rows: DataFrame) -> DataFrame:
    return guarded(rows, counter_commands)


def greeting(rows: DataFrame) -> DataFrame:
    sent = F.col("command") == "SendGreeting"
    return _decided(rows, F.when(sent, "accepted"), F.when(sent, "GreetingSent"))
