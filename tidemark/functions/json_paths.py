"""Leaves of JSON documents, whatever their shape.

Nested objects have no fixed depth, which no built-in expression walks, so an Arrow batch of documents is walked
in Python; the rest of a query stays in the JVM.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAVES = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType())]))


def walked(value: object, path: str, out: list[dict[str, str]]) -> None:
    """Arrays are leaves, empty objects have none, members with an empty name are left out."""
    if isinstance(value, dict):
        for name, inner in value.items():
            if name:
                walked(inner, f"{path}.{name}" if path else name, out)
    else:
        out.append({"path": path, "value": json.dumps(value, separators=(",", ":"), ensure_ascii=False)})


def leaves_of(text: str | None) -> list[dict[str, str]] | None:
    """The leaves in order of path; null for what is no JSON object or too deep to read."""
    try:
        value = json.loads(text) if text is not None else None
        out: list[dict[str, str]] = []
        if not isinstance(value, dict):
            return None
        walked(value, "", out)
    except (ValueError, RecursionError):
        return None
    return sorted(out, key=lambda leaf: leaf["path"])


@F.pandas_udf(LEAVES)
def leaves(documents: pd.Series) -> pd.Series:
    """(path, value as JSON text) of the leaves of each document."""
    return documents.map(leaves_of)


def merged_at(log: DataFrame, keys: list[str], order: str, payload: Column) -> DataFrame:
    """State as documents merged in order: by key and path the last value and who set it; omitted members stay, null overwrites.

    Columns: keys, path, value, and ``order`` of the row that set it. Payloads that aren't JSON objects are skipped. A leaf
    that becomes an object, or an object that becomes a leaf, takes the older one's place.
    """
    rows = log.withColumn("leaf", F.explode(leaves(payload))).select(*keys, F.col(order), "leaf.path", "leaf.value")
    last = rows.groupBy(*keys, "path").agg(F.max_by("value", order).alias("value"), F.max(order).alias(order))
    steps = F.split("path", "[.]")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "."))
    reach = last.select(*keys, F.explode(above).alias("at"), F.col("path").alias("of"), F.col(order).alias("when"))
    newer = reach.where(F.col("at") != F.col("of")).groupBy(*keys, F.col("at").alias("path")).agg(F.max("when").alias("inner"))
    leaf = last.select(*keys, F.col("path").alias("at"), F.col(order).alias("leaf_when"))
    older = reach.where(F.col("at") != F.col("of")).join(leaf, [*keys, "at"]).groupBy(*keys, F.col("of").alias("path")).agg(F.max("leaf_when").alias("outer"))
    kept = last.join(newer, [*keys, "path"], "left").join(older, [*keys, "path"], "left")
    return kept.where((F.coalesce("inner", F.lit(-1)) <= F.col(order)) & (F.coalesce("outer", F.lit(-1)) <= F.col(order))).drop("inner", "outer")


def diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Leaves (keys, path, value) of ``new`` that ``old`` lacks or holds with another value: path, old_value, new_value."""
    was = old.select(*keys, "path", F.col("value").alias("old_value"))
    now = new.select(*keys, "path", F.col("value").alias("new_value"))
    return now.join(was, [*keys, "path"], "left").where(~F.col("new_value").eqNullSafe(F.col("old_value")))
