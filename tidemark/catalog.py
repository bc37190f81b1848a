"""Queries of the event-log engine by name, and SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import models  # noqa: F401  its queries join the registry
from tidemark.functions import scalars
from tidemark.operators import checks, folds, health, lineage, projections, reads, rollups, samples
from tidemark.registry import EV, ONE, ORACLE_SQL, QUERIES, STREAM, TYPES, query, snapshots, stream, with_doubles  # noqa: F401
from tidemark.sources import event_log as el
from tidemark.sources.event_log import ID
from tidemark.streaming import consumers

# reads -------------------------------------------------------------------------------------------------

@query("stream_summary", "SELECT tenant_id, domain, aggregate_id, count(*) AS event_count, max(sequence_number) AS last_sequence, max(ts) AS last_activity FROM ev GROUP BY ALL")
def stream_summary(spark, d):
    return rollups.stream_summary(el.load(spark, d))


@query("stream_heads", "SELECT * FROM heads")
def stream_heads(spark, d):
    return reads.heads(el.load(spark, d))


@query("tracked_identities", "SELECT DISTINCT tenant_id, domain, aggregate_id FROM ev")
def tracked_identities(spark, d):
    return el.load(spark, d).select(*ID).distinct()


@query("stream_read_full", f"SELECT sequence_number, message_id, event_type_name FROM ev WHERE {ONE}")
def stream_read_full(spark, d):
    return reads.read_whole(stream(spark, d), -5).select("sequence_number", "message_id", "event_type_name")


@query("stream_read_range", f"SELECT sequence_number, message_id, event_type_name FROM ev WHERE {ONE} AND sequence_number > 5 AND sequence_number <= 40 ORDER BY sequence_number LIMIT 20")
def stream_read_range(spark, d):
    return reads.read_range(stream(spark, d), 5, 40, 20).select("sequence_number", "message_id", "event_type_name")


@query("stream_read_page", f"SELECT sequence_number, message_id, (SELECT max(sequence_number) FROM ev WHERE {ONE}) AS latest_sequence, max(sequence_number) OVER () AS last_returned, max(sequence_number) OVER () < (SELECT max(sequence_number) FROM ev WHERE {ONE}) AS is_truncated FROM (SELECT * FROM ev WHERE {ONE} AND sequence_number > 10 ORDER BY sequence_number LIMIT 10)")
def stream_read_page(spark, d):
    return reads.read_page(stream(spark, d), 10, 10).select("sequence_number", "message_id", "latest_sequence", "last_returned", "is_truncated")


@query("timeline_page", f"SELECT sequence_number, event_type_name, total AS total_count, CASE WHEN max(sequence_number) OVER () < top THEN max(sequence_number) OVER () + 1 END AS next_token FROM (SELECT *, count(*) OVER () AS total, max(sequence_number) OVER () AS top FROM ev WHERE {ONE} AND sequence_number BETWEEN 3 AND 30 ORDER BY sequence_number LIMIT 10)")
def timeline_page(spark, d):
    return reads.timeline(stream(spark, d), 3, 30, 10).select("sequence_number", "event_type_name", "total_count", "next_token")


@query("event_detail", f"SELECT message_id, event_type_name, payload, ts FROM ev WHERE {ONE} AND sequence_number = 4")
def event_detail(spark, d):
    return reads.detail(stream(spark, d), 4).select("message_id", "event_type_name", "payload", "ts")


@query("snapshot_tail", "SELECT ev.tenant_id, ev.domain, ev.aggregate_id, count(*) AS tail, min(ev.sequence_number) AS first FROM ev LEFT JOIN snaps s USING (tenant_id, domain, aggregate_id) WHERE ev.sequence_number > coalesce(s.sequence_number, 0) GROUP BY ALL")
def snapshot_tail(spark, d):
    log = el.load(spark, d)
    return reads.snapshot_tail(log, snapshots(log)).groupBy(*ID).agg(F.count("*").alias("tail"), F.min("sequence_number").alias("first"))


@query("append_positions", """SELECT tenant_id, aggregate_id, message_id, turn + current_sequence AS sequence_number, place + (SELECT max(global_position) FROM ev) AS global_position FROM (
  SELECT tenant_id, domain, aggregate_id, 'new-' || event_id AS message_id, row_number() OVER (ORDER BY event_id // 3, 'new-' || event_id) AS place, row_number() OVER (PARTITION BY user_id ORDER BY event_id // 3, 'new-' || event_id) AS turn FROM ev WHERE event_type_name = 'purchase') JOIN heads USING (tenant_id, domain, aggregate_id)""")
def append_positions(spark, d):
    """Every purchase is appended once more, at positions with holes and ties."""
    log = el.load(spark, d)
    rows = log.where("event_type_name = 'purchase'").select(*ID, F.concat(F.lit("new-"), F.col("event_id")).alias("message_id"), F.floor(F.col("event_id") / 3).alias("position"))
    return reads.append(log, rows).select("tenant_id", "aggregate_id", "message_id", "sequence_number", "global_position")


@query("stream_export", f"SELECT sequence_number, message_id AS id, tenant_id || '/' || domain || '/' || aggregate_id || '#' || sequence_number AS subject FROM ev WHERE {ONE} AND sequence_number > (SELECT max(sequence_number) - 10 FROM ev WHERE {ONE})")
def stream_export(spark, d):
    lines = reads.export(stream(spark, d), 10, cloud_events=True)
    return lines.select("sequence_number", F.get_json_object("line", "$.id").alias("id"), F.get_json_object("line", "$.subject").alias("subject"))


# roll-ups ----------------------------------------------------------------------------------------------

@query("storage_scopes", "SELECT coalesce(tenant_id, 'all') AS scope, count(*) AS total_events, count(DISTINCT aggregate_id) AS total_streams FROM ev GROUP BY GROUPING SETS ((), (tenant_id))")
def storage_scopes(spark, d):
    return rollups.storage_scopes(el.load(spark, d))


@query("storage_by_type", "SELECT h.tenant_id, h.domain, upper(left(h.domain, 1)) || substr(h.domain, 2) || 'Aggregate' AS aggregate_type, CAST(sum(n) AS BIGINT) AS event_count, CAST(sum(size) AS BIGINT) AS size_bytes, count(s.sequence_number) AS with_snapshot, count(*) - count(s.sequence_number) AS without_snapshot FROM (SELECT tenant_id, domain, aggregate_id, count(*) AS n, sum(strlen(payload)) AS size FROM ev GROUP BY ALL) h LEFT JOIN snaps s USING (tenant_id, domain, aggregate_id) GROUP BY ALL")
def storage_by_type(spark, d):
    log = el.load(spark, d)
    return rollups.storage_by_type(log, snapshots(log))


@query("storage_top_other", "SELECT CASE WHEN r <= 20 THEN aggregate_id ELSE 'Other' END AS aggregate_id, CAST(sum(n) AS BIGINT) AS n FROM (SELECT *, row_number() OVER (ORDER BY n DESC, aggregate_id) AS r FROM (SELECT aggregate_id, count(*) AS n FROM ev GROUP BY 1)) GROUP BY 1")
def storage_top_other(spark, d):
    return rollups.top_and_other(el.load(spark, d).groupBy("aggregate_id").agg(F.count("*").alias("n")), "aggregate_id", "n", 20)


@query("hot_streams", "SELECT tenant_id, domain, aggregate_id, count(*) AS event_count FROM ev GROUP BY ALL ORDER BY event_count DESC, tenant_id, domain, aggregate_id LIMIT 100")
def hot_streams(spark, d):
    return rollups.hot_streams(el.load(spark, d))


@query("recent_streams", "SELECT tenant_id, domain, aggregate_id, count(*) AS event_count, max(sequence_number) AS last_sequence, max(ts) AS last_activity FROM ev GROUP BY ALL ORDER BY last_activity DESC, tenant_id, domain, aggregate_id LIMIT 50")
def recent_streams(spark, d):
    return rollups.recent_streams(el.load(spark, d), 50)


@query("recent_commands", "SELECT correlation_id, status, ts, (SELECT count(*) FROM cmds WHERE tenant_id = 'tenant-1' AND command_type LIKE '%ic%') AS total_count FROM cmds WHERE tenant_id = 'tenant-1' AND command_type LIKE '%ic%' ORDER BY ts DESC, correlation_id LIMIT 25")
def recent_commands(spark, d):
    return rollups.recent_commands(el.commands(el.load(spark, d)), "Tenant-1", "IC", "nonsense", 25).select("correlation_id", "status", "ts", "total_count")


@query("commands_failed_group", "SELECT status, count(*) AS n FROM cmds WHERE status IN ('PublishFailed', 'TimedOut') GROUP BY 1")
def commands_failed_group(spark, d):
    return el.commands(el.load(spark, d)).where(F.col("status").isin(*rollups.STATUS_GROUPS["failed"])).groupBy("status").agg(F.count("*").alias("n"))


@query("activity_histogram", "SELECT b AS bucket, (SELECT count(*) FROM heads WHERE date_trunc('hour', last_modified) = b) AS stream_count FROM (SELECT unnest(generate_series(date_trunc('hour', m) - INTERVAL 23 HOUR, date_trunc('hour', m), INTERVAL 1 HOUR)) AS b FROM (SELECT max(ts) AS m FROM ev))")
def activity_histogram(spark, d):
    return rollups.activity_histogram(el.load(spark, d))


@query("type_catalog", "SELECT domain, string_agg(event_type_name, ',' ORDER BY event_type_name) AS event_types, count(*) AS type_count FROM (SELECT DISTINCT domain, event_type_name FROM ev) GROUP BY domain")
def type_catalog(spark, d):
    return rollups.type_catalog(el.load(spark, d))


@query("type_sample", "SELECT tenant_id, domain, aggregate_id, string_agg(event_type_name, ',' ORDER BY f) FILTER (WHERE r <= 3) AS sample, greatest(count(*) - 3, 0) AS more FROM (SELECT *, row_number() OVER (PARTITION BY aggregate_id ORDER BY f) AS r FROM (SELECT tenant_id, domain, aggregate_id, event_type_name, min(sequence_number) AS f FROM ev GROUP BY ALL)) GROUP BY ALL")
def type_sample(spark, d):
    return rollups.type_sample(el.load(spark, d), 3)


@query("rate_window_counts", "SELECT tenant_id, w AS window_start, count(*) AS n FROM (SELECT tenant_id, unnest([time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '2000-01-01') - to_hours(k) FOR k IN range(6)]) AS w FROM ev) GROUP BY ALL HAVING count(*) > 40")
def rate_window_counts(spark, d):
    return rollups.rate_windows(el.load(spark, d), 40, "6 hours", "1 hour")


@query("pending_over_limit", "SELECT tenant_id, domain, aggregate_id, count(*) AS pending FROM cmds WHERE status_code < 4 GROUP BY ALL HAVING count(*) >= 12")
def pending_over_limit(spark, d):
    return rollups.pending_over(el.commands(el.load(spark, d)), 12)


# checks ------------------------------------------------------------------------------------------------

GAPS = "SELECT h.tenant_id, h.domain, h.aggregate_id, s AS sequence_number, CASE WHEN s = 1 THEN 'Critical' ELSE 'Error' END AS severity FROM (SELECT *, unnest(range(1, current_sequence + 1)) AS s FROM heads) h ANTI JOIN (SELECT * FROM ev WHERE event_id % 97 <> 0) e ON h.tenant_id = e.tenant_id AND h.aggregate_id = e.aggregate_id AND h.s = e.sequence_number"


@query("seq_gaps", GAPS)
def seq_gaps(spark, d):
    log = el.load(spark, d)
    return checks.gaps(el.with_gaps(log), reads.heads(log))


@query("seq_duplicates", "SELECT tenant_id, domain, aggregate_id, sequence_number, CAST(2 AS BIGINT) AS copies FROM ev WHERE event_id % 101 = 0")
def seq_duplicates(spark, d):
    return checks.duplicates(el.with_repeats(el.load(spark, d)))


@query("snapshot_integrity", "SELECT h.tenant_id, h.domain, h.aggregate_id, CASE WHEN s.q > h.current_sequence THEN 'Error' ELSE 'Warning' END AS severity, h.current_sequence AS event_count, s.q AS snapshot_sequence FROM heads h LEFT JOIN (SELECT * EXCLUDE sequence_number, sequence_number + 40 AS q FROM snaps) s USING (tenant_id, domain, aggregate_id) WHERE s.q > h.current_sequence OR (s.q IS NULL AND h.current_sequence > 45)")
def snapshot_integrity(spark, d):
    log = el.load(spark, d)
    ahead = snapshots(log).withColumn("sequence_number", F.col("sequence_number") + 40)
    return checks.snapshot_integrity(rollups.stream_summary(log), ahead, 45)


@query("metadata_consistency", "SELECT tenant_id, domain, aggregate_id, count(*) AS event_count, max(sequence_number) AS last_sequence, 'Error' AS severity FROM ev WHERE event_id % 97 <> 0 GROUP BY ALL HAVING count(*) <> max(sequence_number)")
def metadata_consistency(spark, d):
    return checks.metadata_consistency(rollups.stream_summary(el.with_gaps(el.load(spark, d))))


@query("projection_positions", """, pr AS (SELECT 'counter' AS name, tenant_id, CAST(count(*) // 2 AS BIGINT) AS last_position, count(*) - count(*) // 2 AS lag FROM ev GROUP BY tenant_id UNION ALL SELECT 'ahead', 'tenant-0', CAST(100000000 AS BIGINT), CAST(0 AS BIGINT) UNION ALL SELECT 'lost', 'tenant-9', CAST(1 AS BIGINT), CAST(0 AS BIGINT))
SELECT name, tenant_id, last_position, lag, CASE WHEN total IS NULL THEN 'Warning' WHEN last_position > total THEN 'Error' ELSE 'Warning' END AS severity FROM pr LEFT JOIN (SELECT tenant_id, count(*) AS total FROM ev GROUP BY 1) USING (tenant_id) WHERE total IS NULL OR last_position > total OR lag > 1000""")
def projection_positions(spark, d):
    log = el.load(spark, d)
    half = F.floor(F.count("*") / 2).cast("long")
    own = log.groupBy("tenant_id").agg(F.lit("counter").alias("name"), half.alias("last_position"), (F.count("*") - half).alias("lag")).select("name", "tenant_id", "last_position", "lag")
    more = spark.createDataFrame([("ahead", "tenant-0", 100_000_000, 0), ("lost", "tenant-9", 1, 0)], "name string, tenant_id string, last_position long, lag long")
    return checks.projection_positions(own.unionByName(more), rollups.storage_scopes(log))


@query("consistency_report", f"""SELECT 'continuity' AS "check", * FROM ({GAPS}) UNION ALL SELECT 'projection', tenant_id, '', 'counter', NULL, 'Error' FROM (SELECT DISTINCT tenant_id FROM ev WHERE event_id % 97 <> 0) UNION ALL SELECT 'metadata', tenant_id, domain, aggregate_id, NULL, 'Error' FROM (SELECT tenant_id, domain, aggregate_id FROM ev WHERE event_id % 97 <> 0 GROUP BY ALL HAVING count(*) <> max(sequence_number)) UNION ALL SELECT 'snapshot', tenant_id, domain, aggregate_id, NULL, 'Warning' FROM (SELECT tenant_id, domain, aggregate_id, count(*) AS n FROM ev WHERE event_id % 97 <> 0 GROUP BY ALL) ANTI JOIN snaps USING (tenant_id, domain, aggregate_id) WHERE n > 100""")
def consistency_report(spark, d):
    log = el.load(spark, d)
    holed = el.with_gaps(log)
    overview = rollups.storage_scopes(holed)
    ahead = overview.where("scope <> 'all'").select(F.lit("counter").alias("name"), F.col("scope").alias("tenant_id"), (F.col("total_events") + 40).alias("last_position"), F.lit(0).alias("lag"))
    return checks.report(holed, reads.heads(log), snapshots(log), rollups.stream_summary(holed), ahead, overview)


@query("worst_anomalies", f"SELECT tenant_id, aggregate_id, sequence_number, severity FROM ({GAPS}) ORDER BY severity, tenant_id, domain, aggregate_id, sequence_number LIMIT 40")
def worst_anomalies(spark, d):
    log = el.load(spark, d)
    found = checks.gaps(el.with_gaps(log), reads.heads(log)).withColumn("check", F.lit("continuity"))
    return checks.worst(found, 40).select("tenant_id", "aggregate_id", "sequence_number", "severity")


# folds -------------------------------------------------------------------------------------------------

@query("state_timeline", "SELECT tenant_id, domain, aggregate_id, sequence_number, count, CAST(spent AS DOUBLE) AS spent, last_purchase FROM st")
def state_timeline(spark, d):
    return with_doubles(folds.timeline(el.load(spark, d)).select(*ID, "sequence_number", "count", "spent", "last_purchase"))


@query("state_at", "SELECT tenant_id, domain, aggregate_id, sequence_number, ts, count, CAST(spent AS DOUBLE) AS spent, last_purchase FROM (SELECT *, row_number() OVER (PARTITION BY aggregate_id ORDER BY sequence_number DESC) AS back FROM st WHERE sequence_number <= 60) WHERE back = 1")
def state_at(spark, d):
    return with_doubles(folds.at(el.load(spark, d), 60))


@query("state_at_zero", "SELECT DISTINCT tenant_id, domain, aggregate_id, CAST(0 AS BIGINT) AS sequence_number, CAST(NULL AS BIGINT) AS count, CAST(NULL AS DOUBLE) AS spent FROM ev")
def state_at_zero(spark, d):
    return with_doubles(folds.at(el.load(spark, d), 0)).select(*ID, "sequence_number", "count", "spent")


@query("snapshot_state", "SELECT st.tenant_id, st.domain, st.aggregate_id, sequence_number, count, CAST(spent AS DOUBLE) AS spent, last_purchase, CAST(NULL AS BIGINT) AS missing FROM st JOIN heads h USING (tenant_id, domain, aggregate_id) WHERE sequence_number = current_sequence")
def snapshot_state(spark, d):
    """Snapshots and the events behind them lead to the state that whole streams lead to."""
    log = el.load(spark, d)
    states = folds.timeline(log).join(snapshots(log), [*ID, "sequence_number"]).select(*ID, "sequence_number", *folds.DEMO.fields)
    return with_doubles(folds.rehydrated(log, states, folds.DEMO))


@query("state_latest", "SELECT st.tenant_id, st.domain, st.aggregate_id, sequence_number, ts, count, CAST(spent AS DOUBLE) AS spent, last_purchase FROM st JOIN heads h USING (tenant_id, domain, aggregate_id) WHERE sequence_number = current_sequence")
def state_latest(spark, d):
    return with_doubles(folds.at(el.load(spark, d)))


PATHS = "(SELECT tenant_id, domain, aggregate_id, sequence_number, ts, event_type_name, correlation_id, user_id, unnest(['count', 'spent', 'last_purchase']) AS path, unnest([CAST(count AS VARCHAR), CAST(CAST(spent AS DECIMAL(28,2)) AS VARCHAR), CAST(last_purchase AS VARCHAR)]) AS value FROM st)"


@query("state_diff", f"SELECT n.tenant_id, n.domain, n.aggregate_id, n.path, n.value AS new_value, o.value AS old_value FROM {PATHS} n LEFT JOIN (SELECT * FROM {PATHS} WHERE sequence_number = 10) o USING (tenant_id, domain, aggregate_id, path) WHERE n.sequence_number = 20 AND n.value IS NOT NULL AND n.value IS DISTINCT FROM o.value")
def state_diff(spark, d):
    return folds.diff(el.load(spark, d), 10, 20)


BLAMED = f"SELECT tenant_id, domain, aggregate_id, path, value, previous, sequence_number AS changed_at, ts AS changed_ts, event_type_name AS changed_by, correlation_id, CAST(user_id AS VARCHAR) AS changed_user FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, domain, aggregate_id, path ORDER BY sequence_number DESC) AS r FROM (SELECT *, lag(value) OVER (PARTITION BY tenant_id, domain, aggregate_id, path ORDER BY sequence_number) AS previous FROM {PATHS}) WHERE value IS DISTINCT FROM previous) WHERE r = 1"


@query("blame", f"SELECT b.*, current_sequence > 10000 AS is_truncated FROM ({BLAMED}) b JOIN heads USING (tenant_id, domain, aggregate_id)")
def blame(spark, d):
    return folds.blame(el.load(spark, d))


@query("blame_truncated", f"SELECT * FROM (SELECT b.tenant_id, b.domain, b.aggregate_id, path, value, previous, CASE WHEN changed_at > current_sequence - 3 THEN changed_at END AS changed_at, CASE WHEN changed_at > current_sequence - 3 THEN changed_by END AS changed_by, true AS is_truncated FROM ({BLAMED}) b JOIN heads USING (tenant_id, domain, aggregate_id) QUALIFY row_number() OVER (PARTITION BY aggregate_id ORDER BY path) <= 2)")
def blame_truncated(spark, d):
    return folds.blame(el.load(spark, d), most_events=3, most_fields=2).drop("changed_ts", "correlation_id", "changed_user")


@query("step_frame", "SELECT a.tenant_id, a.domain, a.aggregate_id, a.event_type_name, a.payload, a.count, CAST(a.spent AS DOUBLE) AS spent, b.count AS previous_count, CAST(b.spent AS DOUBLE) AS previous_spent, b.last_purchase AS previous_last_purchase, h.current_sequence AS total_events, a.sequence_number > (SELECT min(sequence_number) FROM ev) AS has_previous, a.sequence_number < h.current_sequence AS has_next FROM st a LEFT JOIN st b ON a.aggregate_id = b.aggregate_id AND b.sequence_number = a.sequence_number - 1 JOIN heads h ON h.aggregate_id = a.aggregate_id WHERE a.sequence_number = 12")
def step_frame(spark, d):
    frame = with_doubles(folds.step_frame(el.load(spark, d), 12)).withColumn("previous_spent", F.col("previous_spent").cast("double"))
    return frame.select(*ID, "event_type_name", "payload", "count", "spent", "previous_count", "previous_spent", "previous_last_purchase", "total_events", "has_previous", "has_next")


@query("bisect_first_divergence", "SELECT s.tenant_id, s.domain, s.aggregate_id, min(s.sequence_number) AS diverged_at, arg_min(s.event_type_name, s.sequence_number) AS event_type_name FROM st s JOIN st g ON g.aggregate_id = s.aggregate_id AND g.sequence_number = 5 WHERE s.sequence_number > 5 AND s.sequence_number <= 40 AND (s.count <> g.count OR s.spent <> g.spent) GROUP BY ALL")
def bisect_first_divergence(spark, d):
    return folds.first_divergence(el.load(spark, d), 5, 40, ("count", "spent"))


@query("bisect_steps", """, steps(tenant_id, domain, aggregate_id, good, low, high, step, middle, verdict) AS (
  SELECT tenant_id, domain, aggregate_id, spent, 5, 40, 0, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR) FROM st WHERE sequence_number = 5
  UNION ALL SELECT s.tenant_id, s.domain, s.aggregate_id, s.good, CASE WHEN st.spent = s.good THEN st.sequence_number ELSE s.low END, CASE WHEN st.spent = s.good THEN s.high ELSE st.sequence_number END, s.step + 1, st.sequence_number, CASE WHEN st.spent = s.good THEN 'good' ELSE 'bad' END
  FROM steps s JOIN st ON st.aggregate_id = s.aggregate_id AND st.sequence_number = s.low + (s.high - s.low) // 2 WHERE s.high - s.low > 1)
SELECT tenant_id, domain, aggregate_id, step, middle, verdict, high - low <= 1 AS converged FROM steps WHERE step > 0""", EV.replace("WITH ev0", "WITH RECURSIVE ev0"))
def bisect_steps(spark, d):
    states = folds.timeline(el.load(spark, d).where("sequence_number <= 40"))
    return folds.bisect_steps(states, 5, 40, ("spent",))


@query("replay_status", """SELECT tenant_id, domain, aggregate_id, CASE WHEN hole IS NULL THEN 'Succeeded' ELSE 'Failed' END AS status, CASE WHEN hole IS NOT NULL THEN 'Unexpected' END AS error, hole AS failed_sequence, CASE WHEN hole IS NOT NULL THEN '' END AS failed_type, CASE WHEN hole IS NULL THEN head ELSE 0 END AS last_applied
FROM (SELECT tenant_id, domain, aggregate_id, min(CASE WHEN sequence_number <> r THEN r END) AS hole, max(sequence_number) AS head FROM (SELECT *, row_number() OVER (PARTITION BY aggregate_id ORDER BY sequence_number) AS r FROM ev WHERE event_id % 97 <> 0) GROUP BY ALL)""")
def replay_status(spark, d):
    return folds.replay_status(el.with_gaps(el.load(spark, d)), folds.Handlers(TYPES))


@query("replay_errors", """SELECT tenant_id, domain, aggregate_id, CASE WHEN repeated IS NOT NULL THEN 'Failed' WHEN hit IS NULL THEN 'Succeeded' WHEN kind = 'signup' THEN 'Failed' ELSE 'Partial' END AS status,
  CASE WHEN repeated IS NOT NULL THEN 'Unexpected' WHEN kind = 'signup' THEN 'UnknownEventType' WHEN hit IS NOT NULL THEN 'ApplyFailed' END AS error, coalesce(repeated, hit) AS failed_sequence, CASE WHEN repeated IS NOT NULL THEN again ELSE kind END AS failed_type, CASE WHEN repeated IS NOT NULL THEN 0 WHEN hit IS NULL THEN head ELSE hit - 1 END AS last_applied
FROM (SELECT tenant_id, domain, aggregate_id, min(sequence_number) FILTER (WHERE event_id % 101 = 0) AS repeated, arg_min(event_type_name, sequence_number) FILTER (WHERE event_id % 101 = 0) AS again,
  min(sequence_number) FILTER (WHERE broken) AS hit, arg_min(event_type_name, sequence_number) FILTER (WHERE broken) AS kind, max(sequence_number) AS head FROM (SELECT *, event_type_name = 'signup' OR (event_type_name = 'purchase' AND value > 50) AS broken FROM ev WHERE sequence_number <= 20) GROUP BY ALL)""")
def replay_errors(spark, d):
    """Repeated events fail a stream before anything is applied; then an unknown type fails it, and a handler that throws leaves it partial."""
    fails = (F.col("event_type_name") == "purchase") & (F.col("value") > 50)
    return folds.replay_status(el.with_repeats(el.load(spark, d)), folds.Handlers(tuple(x for x in TYPES if x != "signup")), 20, fails)


HANDLERS = ("Acme.Events.Clicked", "Acme.Events.Bought", "Acme.Sales.Failed", "Acme.A.Seen", "Acme.B.Seen", "Acme.Sales+Joined")
STORED = {"click": "Acme.Events.Clicked, Acme, Version=1.0", "error": "Old.Space.Acme.Sales.Failed", "view": "Legacy+Seen", "purchase": "Bought"}


@query("apply_resolution", f""", hn AS (SELECT full_name, regexp_extract(full_name, '([^.+]*)$', 1) AS short_name FROM (SELECT unnest({list(HANDLERS)}) AS full_name)),
keys AS (SELECT full_name AS key, full_name FROM hn UNION SELECT short_name, full_name FROM hn),
n AS (SELECT stored, split_part(stored, ',', 1) AS name FROM (SELECT DISTINCT CASE event_type_name WHEN 'click' THEN 'Acme.Events.Clicked, Acme, Version=1.0' WHEN 'error' THEN 'Old.Space.Acme.Sales.Failed' WHEN 'view' THEN 'Legacy+Seen' WHEN 'purchase' THEN 'Bought' ELSE 'Nobody.' || event_type_name END AS stored FROM ev)),
hits AS (SELECT stored, 1 AS turn, 0 AS len, full_name FROM n JOIN hn ON name = full_name UNION ALL SELECT stored, 2, 0, full_name FROM n JOIN hn ON name = short_name UNION ALL SELECT stored, 3, -length(key), full_name FROM n JOIN keys ON ends_with(name, '.' || key) OR ends_with(name, '+' || key)),
best AS (SELECT * FROM hits QUALIFY rank() OVER (PARTITION BY stored ORDER BY turn, len) = 1)
SELECT n.stored, CASE count(full_name) WHEN 0 THEN 'Unknown' WHEN 1 THEN 'Resolved' ELSE 'Ambiguous' END AS outcome, coalesce(string_agg(full_name, ',' ORDER BY full_name), '') AS names FROM n LEFT JOIN best b ON n.stored = b.stored GROUP BY n.stored""")
def apply_resolution(spark, d):
    kind = F.col("event_type_name")
    stored = F.concat(F.lit("Nobody."), kind)
    for own, name in STORED.items():
        stored = F.when(kind == own, name).otherwise(stored)
    rows = el.load(spark, d).select(stored.alias("stored")).distinct()
    found = folds.resolved(F.col("stored"), folds.Handlers(HANDLERS))
    return rows.select("stored", found["outcome"].alias("outcome"), F.array_join(found["names"], ",").alias("names"))


def decrement(rows: DataFrame) -> DataFrame:
    fine = F.col("count") > 0
    return rows.withColumn("outcome", F.when(fine, "accepted").otherwise("rejected")).withColumn("produced", F.when(fine, "error"))


@query("sandbox_outcomes", "SELECT tenant_id, aggregate_id, CASE WHEN count = 0 THEN 'rejected' ELSE 'accepted' END AS outcome, CASE WHEN count > 0 THEN 'error' END AS produced, greatest(count - 1, 0) AS count_after, CAST(spent AS DOUBLE) AS spent_after FROM (SELECT *, row_number() OVER (PARTITION BY aggregate_id ORDER BY sequence_number DESC) AS back FROM st WHERE sequence_number <= 55) WHERE back = 1")
def sandbox_outcomes(spark, d):
    log = el.load(spark, d)
    asked = log.select(*ID).distinct().withColumn("command", F.lit("decrement"))
    out = folds.sandbox(log, asked, decrement, 55)
    return out.select("tenant_id", "aggregate_id", "outcome", "produced", "count_after", F.col("spent_after").cast("double").alias("spent_after"))


COUNTED = """, cs AS (SELECT *, CASE event_type_name WHEN 'click' THEN 'CounterIncremented' WHEN 'view' THEN 'CounterDecremented' WHEN 'signup' THEN 'CounterReset' WHEN 'error' THEN CASE WHEN event_id % 40 = 0 THEN 'CounterClosed' ELSE 'CounterCannotGoNegative' END ELSE 'Other' END AS kind FROM ev),
grouped AS (SELECT *, sum(CASE WHEN kind = 'CounterReset' THEN 1 ELSE 0 END) OVER (PARTITION BY aggregate_id ORDER BY sequence_number) AS g FROM cs),
final AS (SELECT tenant_id, domain, aggregate_id, CAST(sum(CASE kind WHEN 'CounterIncremented' THEN 1 WHEN 'CounterDecremented' THEN -1 ELSE 0 END) FILTER (WHERE g = top) AS BIGINT) AS count, CASE WHEN bool_or(kind = 'CounterClosed') THEN true END AS is_terminated FROM (SELECT *, max(g) OVER (PARTITION BY aggregate_id) AS top FROM grouped) GROUP BY ALL)
"""


def counted(spark, d):
    kind = F.col("event_type_name")
    close = F.when(F.col("event_id") % 40 == 0, "CounterClosed").otherwise("CounterCannotGoNegative")
    own = F.when(kind == "click", "CounterIncremented").when(kind == "view", "CounterDecremented").when(kind == "signup", "CounterReset").when(kind == "error", close).otherwise("Other")
    return el.load(spark, d).withColumn("event_type_name", own)


@query("counter_sample", COUNTED + "SELECT tenant_id, domain, aggregate_id, count, is_terminated FROM final")
def counter_sample(spark, d):
    return folds.at(counted(spark, d), None, samples.COUNTER).select(*ID, "count", "is_terminated")


@query("counter_decisions", COUNTED + """SELECT tenant_id, aggregate_id, command, CASE WHEN is_terminated THEN 'rejected' WHEN command = 'DecrementCounter' AND count = 0 THEN 'rejected' WHEN command = 'ResetCounter' AND count = 0 THEN 'no-op' WHEN command = 'Dance' THEN 'error' ELSE 'accepted' END AS outcome,
  CASE WHEN is_terminated THEN 'AggregateTerminated' WHEN command = 'IncrementCounter' THEN 'CounterIncremented' WHEN command = 'DecrementCounter' THEN CASE WHEN count = 0 THEN 'CounterCannotGoNegative' ELSE 'CounterDecremented' END WHEN command = 'ResetCounter' AND count <> 0 THEN 'CounterReset' WHEN command = 'CloseCounter' THEN 'CounterClosed' END AS produced
  FROM final, (SELECT unnest(['IncrementCounter', 'DecrementCounter', 'ResetCounter', 'CloseCounter', 'Dance']) AS command)""")
def counter_decisions(spark, d):
    log = counted(spark, d)
    commands = F.array(*map(F.lit, ("IncrementCounter", "DecrementCounter", "ResetCounter", "CloseCounter", "Dance")))
    asked = log.select(*ID).distinct().withColumn("command", F.explode(commands))
    return folds.decide(log, asked, samples.counter, None, samples.COUNTER).select("tenant_id", "aggregate_id", "command", "outcome", "produced")


@query("greeting_sample", "SELECT tenant_id, domain, aggregate_id, count(*) FILTER (WHERE event_type_name = 'click') AS message_count, 'accepted' AS outcome FROM ev GROUP BY ALL")
def greeting_sample(spark, d):
    log = el.load(spark, d).replace({"click": "GreetingSent"}, subset=["event_type_name"])
    asked = log.select(*ID).distinct().withColumn("command", F.lit("SendGreeting"))
    return folds.decide(log, asked, samples.greeting, None, samples.GREETING).select(*ID, "message_count", "outcome")


# lineage -----------------------------------------------------------------------------------------------

@query("causation_direct", "SELECT c.tenant_id, c.domain, c.aggregate_id, c.message_id AS cause, c.sequence_number AS cause_sequence, e.message_id AS effect, e.sequence_number AS effect_sequence FROM ev c JOIN ev e ON c.aggregate_id = e.aggregate_id AND e.causation_id = c.message_id")
def causation_direct(spark, d):
    return lineage.direct(el.load(spark, d))


@query("causation_closure", "SELECT tenant_id, domain, aggregate_id, message_id, max(CASE WHEN causation_id = '' THEN message_id END) OVER g AS root, row_number() OVER (PARTITION BY aggregate_id, grp ORDER BY sequence_number) - 1 AS depth FROM (SELECT *, sum(CASE WHEN causation_id = '' THEN 1 ELSE 0 END) OVER (PARTITION BY aggregate_id ORDER BY sequence_number) AS grp FROM ev) WINDOW g AS (PARTITION BY aggregate_id, grp)")
def causation_closure(spark, d):
    return lineage.closure(el.load(spark, d))


@query("causation_chain", f"SELECT CASE WHEN sequence_number = 9 THEN 0 ELSE 1 END AS place, message_id, event_type_name, sequence_number, nullif(causation_id, '') AS originating_command_id FROM ev WHERE {ONE} AND (sequence_number = 9 OR causation_id = (SELECT message_id FROM ev WHERE {ONE} AND sequence_number = 9))")
def causation_chain(spark, d):
    return lineage.chain(el.load(spark, d), *STREAM, 9)


TRACED = """SELECT c.tenant_id, c.domain, c.aggregate_id, c.correlation_id, {status}, 'Resolved' AS outcome, coalesce(n, 0) AS event_count, f AS first_sequence, l AS last_sequence, coalesce(r, 0) AS rejections, h.current_sequence > {newest} AS scan_capped
FROM cmds c JOIN heads h USING (tenant_id, domain, aggregate_id) LEFT JOIN (SELECT aggregate_id, correlation_id, count(*) AS n, min(sequence_number) AS f, max(sequence_number) AS l, count(*) FILTER (WHERE {rejected}) AS r FROM ev JOIN heads USING (tenant_id, domain, aggregate_id) WHERE sequence_number > current_sequence - {newest} GROUP BY ALL) USING (aggregate_id, correlation_id)"""


@query("correlation_trace", TRACED.format(status="c.status, false AS status_expired", newest=10000, rejected="lower(event_type_name) LIKE '%rejected' OR lower(event_type_name) LIKE '%rejection%'"))
def correlation_trace(spark, d):
    log = el.load(spark, d)
    return lineage.trace(log, el.commands(log))


@query("correlation_trace_capped", TRACED.format(status="CASE WHEN ts >= TIMESTAMP '2024-01-15' THEN c.status END AS status, ts < TIMESTAMP '2024-01-15' AS status_expired", newest=20, rejected="event_type_name IN ('error', 'signup')"))
def correlation_trace_capped(spark, d):
    """Scans of the newest 20 events, rejections among them, and statuses that have expired."""
    log = el.load(spark, d)
    told = log.replace({"error": "OrderREJECTED", "signup": "RejectionNoted", "click": "RejectedNot"}, subset=["event_type_name"])
    return lineage.trace(told, el.commands(log), 20, F.lit("2024-01-16").cast("timestamp_ntz"))


@query("correlation_resolution", "SELECT correlation_id, count(DISTINCT aggregate_id) AS streams, CASE WHEN count(DISTINCT aggregate_id) = 1 THEN 'Resolved' ELSE 'Ambiguous' END AS outcome FROM (SELECT aggregate_id, CASE WHEN event_id % 5 = 0 THEN 'shared-' || (event_id % 20) ELSE correlation_id END AS correlation_id FROM ev) GROUP BY 1")
def correlation_resolution(spark, d):
    shared = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("shared-"), F.col("event_id") % 20)).otherwise(F.col("correlation_id"))
    return lineage.resolution(el.load(spark, d).withColumn("correlation_id", shared))


# commands ----------------------------------------------------------------------------------------------

@query("dead_letters_page", "SELECT correlation_id, status, ts FROM cmds WHERE status_code = 6 ORDER BY ts DESC, correlation_id LIMIT 20 OFFSET 20")
def dead_letters_page(spark, d):
    dead = el.commands(el.load(spark, d)).where("status_code = 6").orderBy(F.desc("ts"), "correlation_id")
    return dead.offset(20).limit(20).select("correlation_id", "status", "ts")


@query("replay_eligible", "SELECT correlation_id, status FROM cmds WHERE status IN ('Rejected', 'PublishFailed', 'TimedOut')")
def replay_eligible(spark, d):
    return el.commands(el.load(spark, d)).where(F.col("status").isin("Rejected", "PublishFailed", "TimedOut")).select("correlation_id", "status")


# health ------------------------------------------------------------------------------------------------

@query("health_uptime", "SELECT component, round(avg(CASE WHEN status = 'Healthy' THEN 1.0 ELSE 0.0 END) * 100, 6) AS uptime_percent, count(*) AS samples FROM hs GROUP BY 1")
def health_uptime(spark, d):
    return health.uptime(el.health(spark, d))


@query("health_transitions", "SELECT component, previous_status, status, captured_at, CAST(floor(epoch(captured_at - b)) AS BIGINT) AS seconds_since FROM (SELECT *, lag(captured_at) OVER (PARTITION BY component ORDER BY captured_at, sample_id) AS b FROM (SELECT *, lag(status) OVER (PARTITION BY component ORDER BY captured_at, sample_id) AS previous_status FROM hs) WHERE previous_status IS DISTINCT FROM status) WHERE previous_status IS NOT NULL")
def health_transitions(spark, d):
    return health.transitions(el.health(spark, d))


@query("health_latest", "SELECT component, status, captured_at, sample_id FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY captured_at DESC, sample_id DESC) AS r FROM hs) WHERE r = 1")
def health_latest(spark, d):
    return health.latest(el.health(spark, d))


@query("health_slots", "SELECT c.component, CAST(s.slot AS VARCHAR) AS slot, CASE max(h.severity) WHEN 2 THEN 'Unhealthy' WHEN 1 THEN 'Degraded' WHEN 0 THEN 'Healthy' END AS status FROM (SELECT DISTINCT component FROM hs) c CROSS JOIN (SELECT CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS slot FROM (SELECT CAST(min(captured_at) AS DATE) AS a, CAST(max(captured_at) AS DATE) AS b FROM hs)) s LEFT JOIN hs h ON h.component = c.component AND CAST(h.captured_at AS DATE) = s.slot GROUP BY 1, 2")
def health_slots(spark, d):
    return health.slots(el.health(spark, d)).withColumn("slot", F.date_format("slot", "yyyy-MM-dd"))


# projections -------------------------------------------------------------------------------------------

@query("projection_counter", "SELECT st.tenant_id, st.domain, st.aggregate_id, count FROM st JOIN heads h USING (tenant_id, domain, aggregate_id) WHERE sequence_number = current_sequence")
def projection_counter(spark, d):
    return projections.counter(el.load(spark, d))


@query("projection_rebuild_equals_replay", "SELECT h.tenant_id, h.domain, h.aggregate_id, st.count AS replayed, CAST(NULL AS BIGINT) AS count FROM st JOIN heads h USING (tenant_id, domain, aggregate_id) WHERE sequence_number = current_sequence AND st.aggregate_id = 'user-7'")
def projection_rebuild_equals_replay(spark, d):
    log = el.load(spark, d)
    served = projections.counter(log).where("aggregate_id <> 'user-7'")
    return projections.rebuild_equals_replay(log, served)


@query("projection_checkpoints", "SELECT 'counter' AS projection, tenant_id, domain, aggregate_id, greatest(current_sequence - 3, 20) AS sequence FROM heads")
def projection_checkpoints(spark, d):
    own = reads.heads(el.load(spark, d)).withColumn("projection", F.lit("counter"))
    return projections.checkpoints(own.withColumn("sequence", F.col("current_sequence") - 3), own.withColumn("sequence", F.lit(20).cast("long")))


@query("freshness_state", "SELECT aggregate_id, CASE WHEN a <= 3600 THEN 'Current' WHEN a <= 36000 THEN 'Aging' ELSE 'Stale' END AS state FROM (SELECT aggregate_id, epoch((SELECT max(ts) FROM ev) - last_modified) AS a FROM heads)")
def freshness_state(spark, d):
    log = el.load(spark, d)
    now = log.agg(F.max("ts").alias("now"))
    age = F.expr("timestampdiff(MICROSECOND, last_modified, now) / 1e6")
    return reads.heads(log).crossJoin(F.broadcast(now)).select("aggregate_id", projections.freshness(age, 3600, 36000).alias("state"))


@query("snapshot_due", "SELECT h.tenant_id, h.domain, h.aggregate_id, h.current_sequence, h.current_sequence - coalesce(s.sequence_number, 0) AS behind, CASE h.tenant_id WHEN 'tenant-0' THEN 10 WHEN 'tenant-1' THEN 15 ELSE 100 END AS interval FROM heads h LEFT JOIN snaps s USING (tenant_id, domain, aggregate_id) WHERE h.current_sequence - coalesce(s.sequence_number, 0) >= CASE h.tenant_id WHEN 'tenant-0' THEN 10 WHEN 'tenant-1' THEN 15 ELSE 100 END")
def snapshot_due(spark, d):
    log = el.load(spark, d)
    pair = F.when(F.col("tenant_id") == "tenant-1", 15)
    own = F.when(F.col("tenant_id") == "tenant-0", 4)
    return projections.snapshot_due(reads.heads(log), snapshots(log), projections.snapshot_interval(own, pair, F.lit(None).cast("int")))


@query("retry_schedule", "SELECT CAST(i AS BIGINT) AS attempt, CAST(least(300, power(2, i - 1)) AS DOUBLE) AS seconds FROM range(1, 13) t(i)", "")
def retry_schedule(spark, d):
    return spark.range(1, 13).select(F.col("id").alias("attempt"), projections.retry_delay(F.col("id")).alias("seconds"))


def _part(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN unhex('ffffffff') ELSE {_le(f'octet_length(encode({x}))', 8)} || encode({x}) END"


def _le(x: str, digits: int) -> str:
    return f"unhex(array_to_string(list_reverse(regexp_extract_all(lpad(to_hex({x}), {digits}, '0'), '..')), ''))"


EVENT, PREFIX, STEP = (f"unhex('{x.hex()}')" for x in projections.labels(projections.NAMESPACE))


@query("prefix_fingerprint", f""", told AS (SELECT tenant_id, domain, aggregate_id, sequence_number, unhex(sha256({EVENT} || {_le('sequence_number', 16)} || {_part('message_id')} || {_part('event_type_name')} || {_part('payload')} || {_part('CAST(NULL AS VARCHAR)')} || {_le('epoch_us(ts) * 10 + 621355968000000000', 16)} || {_part('correlation_id')} || {_part('CAST(user_id AS VARCHAR)')})) AS event FROM ev),
chain AS (SELECT tenant_id, domain, aggregate_id, CAST(0 AS BIGINT) AS sequence_number, unhex(sha256({PREFIX} || {_part('tenant_id')} || {_part('domain')} || {_part('aggregate_id')} || {_part("'counter'")})) AS state FROM heads
  UNION ALL SELECT c.tenant_id, c.domain, c.aggregate_id, t.sequence_number, unhex(sha256({STEP} || c.state || t.event)) FROM chain c JOIN told t ON t.aggregate_id = c.aggregate_id AND t.sequence_number = c.sequence_number + 1)
SELECT c.tenant_id, c.domain, c.aggregate_id, sequence_number, 'v1:' || rtrim(replace(replace(to_base64(state), '+', '-'), '/', '_'), '=') AS fingerprint FROM chain c JOIN heads h USING (tenant_id, domain, aggregate_id) WHERE sequence_number = current_sequence""", EV.replace("WITH ev0", "WITH RECURSIVE ev0"))
def prefix_fingerprint(spark, d):
    return projections.prefix_fingerprints(el.load(spark, d), "counter")


# scalars -----------------------------------------------------------------------------------------------

@query("message_type_parts", r"""SELECT DISTINCT v, CASE WHEN ok THEN split_part(v, '-', 1) END AS type_domain, CASE WHEN ok THEN regexp_extract(v, '^[a-z0-9]+-(.*)-v[0-9]+$', 1) END AS type_name, CASE WHEN ok THEN CAST(regexp_extract(v, '-v([0-9]+)$', 1) AS INTEGER) END AS type_version
FROM (SELECT v, regexp_full_match(v, '[a-z0-9]+-[a-z0-9]([a-z0-9-]*[a-z0-9])?-v[0-9]+') AND TRY_CAST(regexp_extract(v, '-v([0-9]+)$', 1) AS INTEGER) >= 1 AND length(v) <= 192 AS ok FROM (SELECT CASE event_type_name WHEN 'view' THEN 'Bad-view-v1' WHEN 'click' THEN 'activity--click-v1' WHEN 'error' THEN 'activity-error--v1-v0' || (event_id % 3) WHEN 'signup' THEN 'activity-' || repeat('s', CAST(170 + event_id % 20 AS INTEGER)) || '-v7' ELSE 'activity-' || event_type_name || '-done-v' || (event_id % 3) END AS v FROM ev))""")
def message_type_parts(spark, d):
    kind, turn = F.col("event_type_name"), F.col("event_id") % 3
    long = F.concat(F.lit("activity-"), F.repeat(F.lit("s"), (170 + F.col("event_id") % 20).cast("int")), F.lit("-v7"))
    made = F.when(kind == "view", "Bad-view-v1").when(kind == "click", "activity--click-v1").when(kind == "error", F.concat(F.lit("activity-error--v1-v0"), turn)).when(kind == "signup", long).otherwise(F.concat(F.lit("activity-"), kind, F.lit("-done-v"), turn))
    rows = el.load(spark, d).select(made.alias("v")).distinct()
    return rows.select("v", *[c.alias(n) for n, c in scalars.message_type(F.col("v")).items()])


@query("topic_names", r"""SELECT DISTINCT tenant, topic, regexp_full_match(topic, '[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)?\.events') AND length(topic) <= 249 AS valid, regexp_full_match(topic, '[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)?\.events') AND length(topic) BETWEEN 201 AND 249 AS warns FROM (SELECT tenant, CASE WHEN tenant = 'system' THEN domain || '.events' ELSE tenant || '.' || domain || '.events' END AS topic FROM (SELECT domain, CASE event_type_name WHEN 'view' THEN 'system' WHEN 'click' THEN upper(tenant_id) WHEN 'error' THEN tenant_id || '.' WHEN 'signup' THEN tenant_id || repeat('x', CAST(195 + event_id % 60 AS INTEGER)) ELSE tenant_id END AS tenant FROM ev))""")
def topic_names(spark, d):
    kind, own = F.col("event_type_name"), F.col("tenant_id")
    long = F.concat(own, F.repeat(F.lit("x"), (195 + F.col("event_id") % 60).cast("int")))
    tenant = F.when(kind == "view", "system").when(kind == "click", F.upper(own)).when(kind == "error", F.concat(own, F.lit("."))).when(kind == "signup", long).otherwise(own)
    rows = el.load(spark, d).select(tenant.alias("tenant"), "domain").distinct()
    name = scalars.topic(F.col("tenant"), F.col("domain"))
    return rows.select("tenant", name.alias("topic"), scalars.topic_valid(name).alias("valid"), scalars.topic_warns(name).alias("warns"))


@query("identity_valid", "SELECT DISTINCT aggregate_id, tenant_id || ':' || domain || ':' || aggregate_id AS actor_id, user_id % 2 = 0 AS valid FROM ev")
def identity_valid(spark, d):
    ids = el.load(spark, d).select(*ID).distinct()
    odd = F.regexp_extract("aggregate_id", "[0-9]+", 0).cast("long") % 2 == 1
    tenant = F.when(odd, F.concat(F.lit("-"), "tenant_id")).otherwise(F.col("tenant_id"))
    return ids.select("aggregate_id", scalars.actor_id(*map(F.col, ID)).alias("actor_id"), scalars.identity_valid(tenant, F.col("domain"), F.col("aggregate_id")).alias("valid"))


@query("query_checksum", "SELECT message_id, left(replace(replace(to_base64(unhex(sha256(payload))), '+', '-'), '/', '_'), 11) AS checksum FROM ev")
def query_checksum(spark, d):
    return el.load(spark, d).select("message_id", scalars.checksum(F.col("payload")).alias("checksum"))


@query("payload_numbers", "SELECT message_id, TRY_CAST(json_extract_string(payload, '$.k') AS BIGINT) AS k FROM ev")
def payload_numbers(spark, d):
    return el.load(spark, d).select("message_id", scalars.tolerant_long(F.col("payload"), "$.k").alias("k"))


@query("type_labels", r"""SELECT DISTINCT stored, upper(left(domain, 1)) || substr(domain, 2) || 'Aggregate' AS label, split_part(stored, ',', 1) AS full_name, short_name, lower(regexp_replace(regexp_replace(regexp_replace(short_name, '([a-z0-9])([A-Z])', '\1-\2', 'g'), '([A-Z])([A-Z][a-z])', '\1-\2', 'g'), '([a-zA-Z])([0-9])', '\1-\2', 'g')) AS kebab
FROM (SELECT domain, stored, regexp_extract(split_part(stored, ',', 1), '([^.+]*)$', 1) AS short_name FROM (SELECT domain, 'Company.Events+' || CASE event_type_name WHEN 'view' THEN 'HTTPViewed' WHEN 'click' THEN 'Order2Clicked' WHEN 'error' THEN 'v2' ELSE upper(left(event_type_name, 1)) || substr(event_type_name, 2) END || (event_id % 4) || CASE WHEN event_id % 3 = 0 THEN ', Company, Version=1.0' ELSE '' END AS stored FROM ev))""")
def type_labels(spark, d):
    kind = F.col("event_type_name")
    named = F.when(kind == "view", "HTTPViewed").when(kind == "click", "Order2Clicked").when(kind == "error", "v2").otherwise(F.concat(F.upper(F.substring(kind, 1, 1)), F.substring(kind, 2, 100)))
    stored = F.concat(F.lit("Company.Events+"), named, F.col("event_id") % 4, F.when(F.col("event_id") % 3 == 0, ", Company, Version=1.0").otherwise(""))
    rows = el.load(spark, d).select("domain", stored.alias("stored")).distinct()
    short = scalars.type_short_name(F.col("stored"))
    return rows.select("stored", scalars.aggregate_label(F.col("domain")).alias("label"), scalars.type_name(F.col("stored")).alias("full_name"), short.alias("short_name"), scalars.kebab(short).alias("kebab"))


@query("redacted_events", f"SELECT sequence_number, event_type_name, '[redacted]' AS payload FROM ev WHERE {ONE}")
def redacted_events(spark, d):
    return stream(spark, d).select("sequence_number", "event_type_name", F.lit("[redacted]").alias("payload"))


@query("unpublished_ranges", "SELECT e.tenant_id, e.domain, e.aggregate_id, count(*) AS unpublished FROM ev e JOIN (SELECT tenant_id, domain, aggregate_id, greatest(current_sequence - 4, 1) AS a, current_sequence - 1 AS b FROM heads) r ON e.aggregate_id = r.aggregate_id AND e.sequence_number BETWEEN r.a AND r.b GROUP BY ALL")
def unpublished_ranges(spark, d):
    log = el.load(spark, d)
    ranges = reads.heads(log).select(*ID, F.greatest(F.col("current_sequence") - 4, F.lit(1)).alias("a"), (F.col("current_sequence") - 1).alias("b"))
    return log.join(ranges, list(ID)).where(F.col("sequence_number").between(F.col("a"), F.col("b"))).groupBy(*ID).agg(F.count("*").alias("unpublished"))


# streaming, in batch form ------------------------------------------------------------------------------

@query("stream_dedupe", "SELECT tenant_id, aggregate_id, sequence_number, message_id, event_type_name FROM ev")
def stream_dedupe(spark, d):
    """Every message once, though some were delivered twice."""
    return consumers.once_of_all(el.with_repeats(el.load(spark, d))).select("tenant_id", "aggregate_id", "sequence_number", "message_id", "event_type_name")


@query("stream_contiguous_prefix", "SELECT tenant_id, domain, aggregate_id, sequence_number, message_id FROM (SELECT *, row_number() OVER (PARTITION BY aggregate_id ORDER BY sequence_number) AS r FROM ev WHERE event_id % 97 <> 0) WHERE r = sequence_number")
def stream_contiguous_prefix(spark, d):
    return consumers.contiguous_prefix(el.with_repeats(el.with_gaps(el.load(spark, d))))


@query("order_streams", "SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS sequence_number, l_partkey, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS quantity FROM lineitem", "")
def order_streams(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    total = F.sum(F.col("l_quantity").cast("decimal(18,2)")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return el.table(spark, d, "lineitem").select("l_orderkey", F.row_number().over(w).cast("long").alias("sequence_number"), "l_partkey", total.cast("double").alias("quantity"))
