"""What the catalogs of queries share: the registry, and SQL for the event log and the relations made from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import reads
from tidemark.sources import event_log as el
from tidemark.sources.event_log import ID

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

TYPES = ("click", "error", "purchase", "signup", "view")
STREAM = ("tenant-1", "activity", "user-7")
ONE = "tenant_id = 'tenant-1' AND aggregate_id = 'user-7'"

EV = """WITH ev0 AS (
  SELECT 'tenant-' || (user_id % 3) AS tenant_id, 'activity' AS domain, 'user-' || user_id AS aggregate_id,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence_number, event_id + 1 AS global_position,
    'm-' || event_id AS message_id, event_type AS event_type_name, value, props AS payload, ts, event_id, user_id FROM events),
ev AS (SELECT *, 'c-' || user_id || '-' || ((sequence_number - 1) // 3) AS correlation_id,
    CASE WHEN event_id % 3 <> 0 THEN coalesce(lag(message_id) OVER (PARTITION BY user_id ORDER BY sequence_number), '') ELSE '' END AS causation_id FROM ev0),
heads AS (SELECT tenant_id, domain, aggregate_id, max(sequence_number) AS current_sequence, max(ts) AS last_modified FROM ev GROUP BY ALL),
snaps AS (SELECT tenant_id, domain, aggregate_id, current_sequence // 50 * 50 AS sequence_number FROM heads WHERE current_sequence >= 50),
cmds0 AS (SELECT tenant_id, domain, aggregate_id, correlation_id, min(event_id) AS first_event, min(ts) AS ts, arg_min(event_type_name, event_id) AS command_type FROM ev GROUP BY ALL),
cmds AS (SELECT *, CAST(first_event % 8 AS INTEGER) AS status_code, ['Received','Processing','EventsStored','EventsPublished','Completed','Rejected','PublishFailed','TimedOut'][first_event % 8 + 1] AS status FROM cmds0),
hs AS (SELECT 'component-' || (user_id % 5) AS component, CASE event_type WHEN 'error' THEN 'Unhealthy' WHEN 'view' THEN 'Degraded' ELSE 'Healthy' END AS status,
    CASE event_type WHEN 'error' THEN 2 WHEN 'view' THEN 1 ELSE 0 END AS severity, ts AS captured_at, event_id AS sample_id FROM events),
st AS (SELECT *,
    list_reduce(list_prepend(CAST(0 AS BIGINT), list(CAST(CASE event_type_name WHEN 'click' THEN 1 WHEN 'error' THEN -1 WHEN 'signup' THEN -1000000 ELSE 0 END AS BIGINT)) OVER w), lambda a, x: greatest(a + x, 0)) AS count,
    sum(CASE WHEN event_type_name = 'purchase' THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END) OVER w AS spent,
    max(CASE WHEN event_type_name = 'purchase' THEN event_id END) OVER w AS last_purchase
    FROM ev WINDOW w AS (PARTITION BY tenant_id, domain, aggregate_id ORDER BY sequence_number ROWS UNBOUNDED PRECEDING))
"""


def query(name: str, sql: str | None, prefix: str = EV):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = prefix + sql
        return f

    return add


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.of(el.load(spark, sf_dir), *STREAM)


def snapshots(log: DataFrame) -> DataFrame:
    own = reads.heads(log).withColumn("sequence_number", (F.floor(F.col("current_sequence") / 50) * 50).cast("long"))
    return own.where("sequence_number > 0").select(*ID, "sequence_number")


def with_doubles(df: DataFrame) -> DataFrame:
    return df.withColumn("spent", F.col("spent").cast("double"))
