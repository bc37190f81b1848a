"""Queries of read models, commands, health, small roll-ups and scalar functions, and SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import json_paths, protection, scalars
from tidemark.operators import commands, health, projections, readmodels, reads, rollups
from tidemark.plans import queries as plans
from tidemark.registry import query
from tidemark.sources import event_log as el
from tidemark.sources import sinks
from tidemark.sources.event_log import ID
from tidemark.streaming import consumers

NOW = "TIMESTAMP '2024-02-01'"


def now():
    return F.lit("2024-02-01").cast("timestamp_ntz")


# read models: entries are written by every event, keyed by its stream and its number's remainder --------------

ENTRIES = """, en AS (SELECT aggregate_id || '/' || (event_id % 3) AS key, event_type_name AS value, row_number() OVER (PARTITION BY aggregate_id, event_id % 3 ORDER BY sequence_number) AS version, ts AS written_at,
    CASE WHEN event_id % 5 = 0 THEN ts + INTERVAL 10 DAY END AS expires_at, event_id % 11 = 0 AS erased FROM ev),
cur AS (SELECT key, value, version, expires_at FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC) AS back FROM en) WHERE back = 1 AND NOT erased AND (expires_at IS NULL OR expires_at > TIMESTAMP '2024-02-01')),
newest AS (SELECT key, max(version) AS newest FROM en GROUP BY 1)
"""


def entries(spark, d) -> DataFrame:
    from pyspark.sql import Window

    log = el.load(spark, d).withColumn("key", F.concat("aggregate_id", F.lit("/"), F.col("event_id") % 3))
    version = F.row_number().over(Window.partitionBy("key").orderBy("sequence_number")).cast("long")
    expires = F.when(F.col("event_id") % 5 == 0, F.col("ts") + F.expr("INTERVAL 10 DAYS"))
    return log.select("key", F.col("event_type_name").alias("value"), version.alias("version"), F.col("ts").alias("written_at"), expires.alias("expires_at"), (F.col("event_id") % 11 == 0).alias("erased"))


@query("read_model_current", ENTRIES + "SELECT * FROM cur")
def read_model_current(spark, d):
    return readmodels.current(entries(spark, d), now())


WRITES = """, wr AS (SELECT DISTINCT key, 'a' AS value, CAST(newest AS BIGINT) AS expected, 0 AS place FROM newest UNION ALL SELECT key, 'b', CAST(0 AS BIGINT), 1 FROM newest UNION ALL SELECT key, 'c', NULL, 2 FROM newest UNION ALL SELECT key || '-new', 'd', CAST(0 AS BIGINT), 0 FROM newest)
"""


def writes(en: DataFrame) -> DataFrame:
    """To each key a write that has read its newest version, one that expects none, one that doesn't care, and one to a new key."""
    last = en.groupBy("key").agg(F.max("version").alias("newest"))
    own = F.array(*[F.struct(k.alias("key"), F.lit(v).alias("value"), e.cast("long").alias("expected"), F.lit(p).alias("place")) for k, v, e, p in (
        (F.col("key"), "a", F.col("newest"), 0), (F.col("key"), "b", F.lit(0), 1), (F.col("key"), "c", F.lit(None), 2), (F.concat("key", F.lit("-new")), "d", F.lit(0), 0),
    )])
    return last.select(F.explode(own).alias("w")).select("w.*")


@query("read_model_saves", ENTRIES + WRITES + """SELECT wr.key, wr.value, wr.expected, wr.place, CASE WHEN wr.value IN ('c', 'd') OR (wr.value = 'a' AND cur.version = wr.expected) THEN 'Saved' ELSE 'Conflict' END AS outcome,
  CASE wr.value WHEN 'd' THEN 1 WHEN 'c' THEN newest + 1 + CASE WHEN cur.version IS NOT NULL THEN 1 ELSE 0 END WHEN 'a' THEN CASE WHEN cur.version = wr.expected THEN newest + 1 END ELSE cur.version END AS version FROM wr LEFT JOIN cur USING (key) LEFT JOIN newest USING (key)""")
def read_model_saves(spark, d):
    en = entries(spark, d)
    return readmodels.decided(en, writes(en), now())


@query("read_model_erase", ENTRIES + "SELECT key, CASE WHEN cur.version IS NULL THEN 'Missing' WHEN newest % 2 = 1 AND cur.version <> newest - 1 THEN 'Conflict' ELSE 'Erased' END AS outcome, CASE WHEN cur.version IS NOT NULL AND newest % 2 = 0 THEN cur.version + 1 END AS version FROM newest LEFT JOIN cur USING (key)")
def read_model_erase(spark, d):
    """Keys with an even newest version are erased whatever stands, the others only at the version before it."""
    en = entries(spark, d)
    last = en.groupBy("key").agg(F.max("version").alias("newest"))
    return readmodels.erased(en, last.select("key", F.when(F.col("newest") % 2 == 1, F.col("newest") - 1).alias("expected")), now())


@query("shared_rebuild", "SELECT tenant_id, count(*) AS streams, max(ts) AS projected_at, CAST(sum(count) AS BIGINT) AS count, CAST(sum(spent) AS DOUBLE) AS spent FROM (SELECT *, row_number() OVER (PARTITION BY aggregate_id ORDER BY sequence_number DESC) AS back FROM st) WHERE back = 1 GROUP BY 1")
def shared_rebuild(spark, d):
    return readmodels.shared_rebuild(el.load(spark, d), ["tenant_id"]).withColumn("spent", F.col("spent").cast("double"))


DELIVERIES = ", dl AS (SELECT 'counter' AS projection, tenant_id, domain, aggregate_id, current_sequence - current_sequence % 4 + current_sequence % 2 * 3 AS last_delivered FROM heads UNION ALL SELECT 'lost', 'tenant-9', 'activity', 'user-0', 4)"


@query("reconcile_deliveries", DELIVERIES + " SELECT projection, d.tenant_id, d.domain, d.aggregate_id, CASE WHEN current_sequence IS NULL THEN 'NoStream' WHEN last_delivered = current_sequence THEN 'Current' WHEN last_delivered < current_sequence THEN 'Behind' ELSE 'Ahead' END AS outcome, CASE WHEN last_delivered < current_sequence THEN last_delivered + 1 END AS redeliver_from, CASE WHEN last_delivered < current_sequence THEN current_sequence END AS redeliver_to FROM dl d LEFT JOIN heads h ON d.tenant_id = h.tenant_id AND d.aggregate_id = h.aggregate_id")
def reconcile_deliveries(spark, d):
    heads = reads.heads(el.load(spark, d))
    n = F.col("current_sequence")
    own = heads.select(F.lit("counter").alias("projection"), *ID, (n - n % 4 + n % 2 * 3).alias("last_delivered"))
    lost = spark.createDataFrame([("lost", "tenant-9", "activity", "user-0", 4)], own.schema)
    return readmodels.reconciled(own.unionByName(lost), heads)


@query("tenant_fallback", """, pr AS (SELECT 'counter' AS name, CASE tenant_id WHEN 'tenant-0' THEN 'Tenant-0' ELSE 'ALL' END AS tenant_id, count(*) AS lag FROM ev WHERE tenant_id <> 'tenant-2' GROUP BY ALL)
SELECT t.tenant_id, name, lag, lower(pr.tenant_id) = 'all' AS from_wildcard FROM (SELECT DISTINCT tenant_id FROM ev) t JOIN pr ON lower(pr.tenant_id) = t.tenant_id OR (lower(pr.tenant_id) = 'all' AND NOT EXISTS (SELECT 1 FROM pr p2 WHERE lower(p2.tenant_id) = t.tenant_id))""")
def tenant_fallback(spark, d):
    log = el.load(spark, d)
    tenant = F.when(F.col("tenant_id") == "tenant-0", "Tenant-0").otherwise("ALL")
    rows = log.where("tenant_id <> 'tenant-2'").groupBy(tenant.alias("tenant_id")).agg(F.lit("counter").alias("name"), F.count("*").alias("lag"))
    return readmodels.with_fallback(rows.select("name", "tenant_id", "lag"), log.select("tenant_id"))


@query("lifecycle_flags", """SELECT message_id, CASE WHEN event_id % 2 = 0 AND s IN ('Unknown', 'Current', 'Stale', 'Rebuilding', 'Degraded', 'Unavailable', 'LocalOnly') THEN s ELSE 'Unknown' END AS lifecycle, CASE WHEN event_id % 2 = 1 OR s IN ('Unknown', 'Odd') THEN NULL WHEN s = 'Current' THEN false WHEN s = 'Stale' THEN true END AS is_stale,
  CASE WHEN event_id % 2 = 0 AND s = 'Degraded' THEN true ELSE false END AS is_degraded, event_id % 2 = 0 AND s = 'Current' AS confirmed FROM (SELECT *, ['Unknown', 'Current', 'Stale', 'Rebuilding', 'Degraded', 'Unavailable', 'LocalOnly', 'Odd'][event_id // 2 % 8 + 1] AS s FROM ev)""")
def lifecycle_flags(spark, d):
    states = F.array(*map(F.lit, (*readmodels.LIFECYCLES, "Odd")))
    own = F.element_at(states, (F.floor(F.col("event_id") / 2) % 8 + 1).cast("int"))
    flags = readmodels.lifecycle_flags(own, F.col("event_id") % 2 == 0, unknown_degraded=False)
    return el.load(spark, d).select("message_id", *[c.alias(n) for n, c in flags.items()])


# commands: a status each for the events of a command, in the order of the log -----------------------------------

STATUS_LIST = "['Received','Processing','EventsStored','EventsPublished','Completed','Rejected','PublishFailed','TimedOut']"
LOGGED = f", sl AS (SELECT tenant_id, correlation_id AS message_id, {STATUS_LIST}[event_id % 8 + 1] AS status, ts, event_id AS place FROM ev)"


def status_log(spark, d) -> DataFrame:
    names = F.array(*map(F.lit, el.STATUSES))
    status = F.element_at(names, (F.col("event_id") % 8 + 1).cast("int"))
    return el.load(spark, d).select("tenant_id", F.col("correlation_id").alias("message_id"), status.alias("status"), "ts", F.col("event_id").alias("place"))


@query("command_latest_status", LOGGED + f" SELECT tenant_id, message_id, arg_max(status, place) AS status, max(ts) AS ts FROM sl WHERE ts > TIMESTAMP '2024-01-20' GROUP BY ALL")
def command_latest_status(spark, d):
    return commands.latest_status(status_log(spark, d), now(), 12 * 86_400)


@query("replay_eligibility", LOGGED + """, la AS (SELECT tenant_id, message_id, arg_max(status, place) AS status FROM sl GROUP BY ALL), asked AS (SELECT tenant_id, message_id FROM la UNION ALL SELECT tenant_id, message_id || '-lost' FROM la)
SELECT a.tenant_id, a.message_id, status, CASE WHEN status IS NULL THEN 'Conflict' WHEN status IN ('Rejected', 'PublishFailed', 'TimedOut') THEN 'Eligible' ELSE 'NotReplayable' END AS outcome FROM asked a LEFT JOIN la USING (tenant_id, message_id)""")
def replay_eligibility(spark, d):
    statuses = status_log(spark, d)
    known = statuses.select("tenant_id", "message_id").distinct()
    asked = known.unionByName(known.withColumn("message_id", F.concat("message_id", F.lit("-lost"))))
    return commands.replay_eligibility(asked, statuses)


@query("correlation_index", """, cm AS (SELECT tenant_id, 'co-' || (event_id % 400) AS correlation_id, message_id, ts FROM ev WHERE ts > TIMESTAMP '2024-01-10'), ranked AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, correlation_id ORDER BY ts, message_id) AS r FROM cm)
SELECT tenant_id, correlation_id, count(*) AS commands, CASE WHEN count(*) > 4 THEN 'Overflow' WHEN count(*) > 1 THEN 'Ambiguous' ELSE 'Resolved' END AS outcome, string_agg(message_id, ',' ORDER BY r) FILTER (WHERE r <= 4) AS message_ids FROM ranked GROUP BY ALL""")
def correlation_index(spark, d):
    log = el.with_repeats(el.load(spark, d)).withColumn("correlation_id", F.concat(F.lit("co-"), F.col("event_id") % 400))
    return commands.correlation_index(log, now(), 22 * 86_400, 4)


@query("idempotency_outcomes", f""", rc AS (SELECT CASE event_id % 4 WHEN 0 THEN message_id ELSE 'x-' || message_id END AS key, message_id, causation, CASE WHEN event_id % 3 = 0 THEN 'other' ELSE event_type_name END AS command_type, CASE WHEN event_id % 7 <> 0 THEN CASE WHEN event_id % 2 = 0 THEN 'Recoverable' ELSE 'Terminal' END END AS disposition, ts + INTERVAL 20 DAY AS expires_at FROM (SELECT *, 'x-' || message_id AS causation FROM ev WHERE event_id % 4 < 3)),
asked AS (SELECT message_id, CASE WHEN event_id % 10 = 1 THEN message_id ELSE 'x-' || message_id END AS causation_id, event_type_name AS command_type FROM ev)
SELECT a.message_id, a.causation_id, a.command_type, CASE WHEN r.key IS NULL THEN 'Miss' WHEN r.causation <> a.causation_id OR r.command_type <> a.command_type OR r.disposition IS NULL THEN 'IdentityConflict' WHEN r.expires_at <= {NOW} THEN 'Expired' WHEN r.key <> a.message_id THEN 'LegacyMigration' WHEN r.disposition = 'Recoverable' THEN 'RetryableRecoverable' ELSE 'ExactTerminalDuplicate' END AS outcome
FROM asked a LEFT JOIN rc r ON r.key = a.message_id OR (r.key = a.causation_id AND a.causation_id <> a.message_id)""")
def idempotency_outcomes(spark, d):
    log = el.load(spark, d)
    n, own = F.col("event_id"), F.concat(F.lit("x-"), "message_id")
    kind = F.when(n % 3 == 0, "other").otherwise(F.col("event_type_name"))
    disposition = F.when(n % 7 != 0, F.when(n % 2 == 0, "Recoverable").otherwise("Terminal"))
    records = log.where("event_id % 4 < 3").select(F.when(n % 4 == 0, F.col("message_id")).otherwise(own).alias("key"), "message_id", own.alias("causation_id"), kind.alias("command_type"), disposition.alias("disposition"), (F.col("ts") + F.expr("INTERVAL 20 DAYS")).alias("expires_at"))
    asked = log.select("message_id", F.when(n % 10 == 1, F.col("message_id")).otherwise(own).alias("causation_id"), F.col("event_type_name").alias("command_type"))
    return commands.idempotency(asked, records, now())


@query("rate_limited", """, rq AS (SELECT tenant_id, aggregate_id AS consumer_id, event_id AS request_id, ts, CAST(floor(epoch(ts)) AS BIGINT) // 3600 AS segment, CAST(floor(epoch(ts)) AS BIGINT) // 14400 AS slot FROM ev),
ranked AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, segment ORDER BY ts, request_id) AS a, row_number() OVER (PARTITION BY tenant_id, consumer_id, slot ORDER BY ts, request_id) AS b, (SELECT count(*) FROM rq q WHERE q.tenant_id = rq.tenant_id AND q.segment BETWEEN rq.segment - 5 AND rq.segment - 1) AS before FROM rq)
SELECT tenant_id, consumer_id, request_id, CASE WHEN before + a > 32 THEN 'tenant' ELSE 'consumer' END AS limited_by FROM ranked WHERE before + a > 32 OR b > 2""")
def rate_limited(spark, d):
    rows = el.load(spark, d).select("tenant_id", F.col("aggregate_id").alias("consumer_id"), F.col("event_id").alias("request_id"), "ts")
    return commands.rate_limited(rows, 32, 6 * 3600, 6, 2, 14400).drop("ts")


DRAINS = ", dr AS (SELECT message_id, ts AS failed_at, CAST(event_id % 40 AS INTEGER) AS retry_count, event_id % 13 = 0 AS dead_lettered FROM ev)"


@query("drain_plan", DRAINS + " SELECT *, CASE WHEN dead_lettered THEN 'none' WHEN retry_count >= 8 THEN 'dead-letter' ELSE 'retry' END AS action, CASE WHEN NOT dead_lettered AND retry_count < 8 THEN failed_at + to_seconds(least(1800, 30 + 60 * retry_count)) END AS next_attempt FROM dr")
def drain_plan(spark, d):
    n = F.col("event_id")
    return commands.drain_plan(el.load(spark, d).select("message_id", F.col("ts").alias("failed_at"), (n % 40).cast("int").alias("retry_count"), (n % 13 == 0).alias("dead_lettered")))


@query("dead_letter_messages", "SELECT tenant_id, domain, aggregate_id, correlation_id, 'DrainExhausted' AS origin, 'publish' AS failure_stage, status AS reason, ts AS failed_at, command_type FROM cmds WHERE status_code >= 6")
def dead_letter_messages(spark, d):
    failed = el.commands(el.load(spark, d)).where("status_code >= 6")
    out = commands.dead_letters(failed, F.lit("publish"), F.col("status"), F.col("ts"), drained=True)
    return out.withColumn("command_type", F.get_json_object("command", "$.command_type")).drop("command")


@query("retry_plan", "SELECT message_id, ts AS failed_at, CAST(event_id % 10 + 1 AS INTEGER) AS attempt, event_id % 10 >= 7 AS exhausted, CASE WHEN event_id % 10 < 7 THEN ts + to_seconds(least(300, power(2, event_id % 10))) END AS next_attempt FROM ev")
def retry_plan(spark, d):
    return projections.retry_plan(el.load(spark, d).select("message_id", F.col("ts").alias("failed_at"), (F.col("event_id") % 10 + 1).cast("int").alias("attempt")))


@query("last_receipts", "SELECT aggregate_id, string_agg(sequence_number, ',' ORDER BY sequence_number) AS receipts FROM (SELECT aggregate_id, sequence_number FROM ev JOIN heads USING (tenant_id, domain, aggregate_id) WHERE sequence_number > current_sequence - 6) GROUP BY 1")
def last_receipts(spark, d):
    own = el.load(spark, d).groupBy("aggregate_id").agg(F.array_sort(F.collect_list("sequence_number")).alias("all"))
    return own.select("aggregate_id", F.array_join(projections.last_receipts(F.col("all"), 6), ",").alias("receipts"))


# roll-ups ----------------------------------------------------------------------------------------------

@query("type_bar_chart", "SELECT min(label) AS label, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN event_id % 2 = 0 THEN upper(event_type_name) ELSE event_type_name END || (event_id % 5) AS label, strlen(payload) AS n FROM ev) GROUP BY lower(label) ORDER BY n DESC, lower(label) LIMIT 10")
def type_bar_chart(spark, d):
    name = F.when(F.col("event_id") % 2 == 0, F.upper("event_type_name")).otherwise(F.col("event_type_name"))
    rows = el.load(spark, d).select(F.concat(name, F.col("event_id") % 5).alias("label"), F.octet_length("payload").alias("n"))
    return rollups.bar_chart(rows, "label", "n")


@query("histogram_stats", "SELECT max(n) AS highest, CAST(sum(n) AS BIGINT) AS total FROM (SELECT (SELECT count(*) FROM heads WHERE date_trunc('hour', last_modified) = b) AS n FROM (SELECT unnest(generate_series(date_trunc('hour', m) - INTERVAL 23 HOUR, date_trunc('hour', m), INTERVAL 1 HOUR)) AS b FROM (SELECT max(ts) AS m FROM ev)))")
def histogram_stats(spark, d):
    return rollups.bucket_stats(rollups.activity_histogram(el.load(spark, d)), "stream_count")


@query("average_growth", "SELECT round(avg(CASE WHEN event_id % 3 <> 0 THEN value END), 6) AS average_growth, count(*) FILTER (WHERE event_id % 3 <> 0) AS known FROM ev")
def average_growth(spark, d):
    rows = el.load(spark, d).select(F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("v"))
    return rollups.growth(rows, "v").withColumn("average_growth", F.round("average_growth", 6))


@query("most_behind", "SELECT 'counter' AS name, tenant_id, count(*) - count(*) // 2 AS lag FROM ev GROUP BY tenant_id ORDER BY lag DESC, name, tenant_id LIMIT 1")
def most_behind(spark, d):
    lag = F.count("*") - F.floor(F.count("*") / 2)
    return rollups.most_behind(el.load(spark, d).groupBy("tenant_id").agg(F.lit("counter").alias("name"), lag.cast("long").alias("lag")))


@query("mean_snapshot_interval", "SELECT tenant_id, avg(step) AS mean_interval, count(*) AS snapshots, CAST(max(b) AS BIGINT) AS payload_bytes FROM (SELECT tenant_id, sequence_number - coalesce(lag(sequence_number) OVER (PARTITION BY aggregate_id ORDER BY sequence_number), 0) AS step FROM ev WHERE sequence_number % 7 = 0) JOIN (SELECT tenant_id, sum(strlen(payload)) AS b FROM ev GROUP BY 1) USING (tenant_id) GROUP BY 1")
def mean_snapshot_interval(spark, d):
    return rollups.mean_interval(el.load(spark, d), 7)


@query("first_registrations", "SELECT domain, kind, event_id FROM (SELECT *, row_number() OVER (PARTITION BY lower(kind) ORDER BY ts, event_id) AS r FROM (SELECT domain, CASE WHEN event_id % 2 = 0 THEN upper(event_type_name) ELSE event_type_name END AS kind, ts, event_id FROM ev)) WHERE r = 1")
def first_registrations(spark, d):
    kind = F.when(F.col("event_id") % 2 == 0, F.upper("event_type_name")).otherwise(F.col("event_type_name"))
    rows = el.load(spark, d).select("domain", kind.alias("kind"), "ts", "event_id")
    return rollups.first_of(rows, ["domain", "kind"], ["ts", "event_id"]).select("domain", "kind", "event_id")


@query("stable_order", "SELECT kind, row_number() OVER (ORDER BY lower(kind), kind) AS place FROM (SELECT DISTINCT CASE WHEN event_id % 2 = 0 THEN upper(event_type_name) ELSE event_type_name END AS kind FROM ev)")
def stable_order(spark, d):
    kind = F.when(F.col("event_id") % 2 == 0, F.upper("event_type_name")).otherwise(F.col("event_type_name"))
    return rollups.in_stable_order(el.load(spark, d).select(kind.alias("kind")).distinct(), ["kind"])


@query("newly_seen", "SELECT DISTINCT correlation_id FROM ev WHERE ts >= TIMESTAMP '2024-01-20' EXCEPT SELECT correlation_id FROM ev WHERE ts < TIMESTAMP '2024-01-20'")
def newly_seen(spark, d):
    log = el.load(spark, d)
    line = F.lit("2024-01-20").cast("timestamp_ntz")
    return rollups.newly_seen(log.where(F.col("ts") >= line), log.where(F.col("ts") < line), ["correlation_id"])


@query("stream_status", "SELECT tenant_id, domain, aggregate_id, max(ts) AS last_activity, CASE WHEN bool_or(event_type_name = 'error' AND event_id % 50 = 3) THEN 'Tombstoned' WHEN max(ts) < TIMESTAMP '2024-02-01' - INTERVAL 3 DAY THEN 'Idle' ELSE 'Active' END AS status FROM ev GROUP BY ALL")
def stream_status(spark, d):
    closing = F.when((F.col("event_type_name") == "error") & (F.col("event_id") % 50 == 3), "closed").otherwise(F.col("event_type_name"))
    return rollups.stream_status(el.load(spark, d).withColumn("event_type_name", closing), now(), "3 days", ("closed",))


@query("payload_readability", "SELECT message_id, CASE event_id % 4 WHEN 1 THEN 'Unreadable' WHEN 2 THEN 'NeedsKey' ELSE 'Readable' END AS readability FROM ev")
def payload_readability(spark, d):
    state = F.when(F.col("event_id") % 4 == 0, "Unprotected").when(F.col("event_id") % 4 == 1, "ProviderOpaque").otherwise("Protected")
    own = F.when(F.col("event_id") % 4 == 3, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("protection-state"), state))
    return rollups.readable(el.load(spark, d).withColumn("extensions", own)).select("message_id", "readability")


@query("activity_by_day", "SELECT strftime(ts, '%Y%m%d') AS day, count(*) AS n FROM ev GROUP BY 1")
def activity_by_day(spark, d):
    return el.load(spark, d).groupBy(scalars.day_key(F.col("ts")).alias("day")).agg(F.count("*").alias("n"))


@query("position_watermark", "SELECT tenant_id, max(global_position) AS watermark FROM ev GROUP BY 1")
def position_watermark(spark, d):
    return consumers.position_watermark(el.load(spark, d))


@query("poison_rows", "SELECT message_id, CASE WHEN event_type_name = 'view' THEN 'UnknownEventType' WHEN event_id % 9 = 0 THEN 'InvalidPayload' WHEN event_type_name = 'signup' THEN 'NoHandler' END AS problem FROM ev")
def poison_rows(spark, d):
    torn = F.when(F.col("event_id") % 9 == 0, F.lit("{oops")).otherwise(F.col("payload"))
    return consumers.classify(el.load(spark, d).withColumn("payload", torn), ("click", "error", "purchase", "signup"), ("click", "error", "purchase")).select("message_id", "problem")


@query("tenant_list", "SELECT tenant_id, count(DISTINCT domain) AS domains, count(DISTINCT aggregate_id) AS streams, count(*) AS events, max(ts) AS last_activity FROM ev GROUP BY 1")
def tenant_list(spark, d):
    return rollups.tenants(el.load(spark, d))


@query("snapshot_policies", "SELECT tenant_id, domain, aggregate_id, CASE WHEN aggregate_id = 'user-7' THEN 25 WHEN tenant_id = 'tenant-1' THEN 10 ELSE 40 END AS interval FROM heads")
def snapshot_policies(spark, d):
    rows = [("tenant-1", "activity", "user-7", 25), ("tenant-1", "activity", None, 3), (None, "activity", None, 40), (None, "other", None, 7)]
    policies = spark.createDataFrame(rows, "tenant_id string, domain string, aggregate_id string, interval int")
    return projections.with_policies(reads.heads(el.load(spark, d)).select(*ID), policies)


@query("published_events", "SELECT tenant_id || '.' || domain || '.events' AS topic, tenant_id || ':' || domain || ':' || aggregate_id AS key, message_id AS id, event_type_name AS type FROM ev")
def published_events(spark, d):
    return reads.published(el.load(spark, d)).select("topic", "key", F.get_json_object("value", "$.id").alias("id"), F.get_json_object("value", "$.type").alias("type"))


@query("payload_protection", "SELECT message_id, CASE WHEN event_id % 3 > 0 THEN payload END AS payload FROM ev")
def payload_protection(spark, d):
    """Payloads come back by their key; those of another key, or changed on the way, don't."""
    key = F.lit(b"0123456789abcdef")
    own = F.when(F.col("event_id") % 3 == 0, F.lit(b"fedcba9876543210")).otherwise(key)
    return el.load(spark, d).select("message_id", protection.unprotected(protection.protected(F.col("payload"), key), own).alias("payload"))


# health ------------------------------------------------------------------------------------------------

@query("mean_uptime", "SELECT round(avg(u), 6) AS mean_uptime, count(*) AS components FROM (SELECT component, round(avg(CASE WHEN status = 'Healthy' THEN 1.0 ELSE 0.0 END) * 100, 6) AS u FROM hs GROUP BY 1)")
def mean_uptime(spark, d):
    return health.mean_uptime(el.health(spark, d))


@query("health_overall", "SELECT sample_id, CASE WHEN sample_id % 7 = 0 OR sample_id % 11 = 0 THEN 'Unhealthy' WHEN sample_id % 5 >= 2 OR sample_id % 13 = 0 THEN 'Degraded' ELSE 'Healthy' END AS status FROM hs")
def health_overall(spark, d):
    n = F.col("sample_id")
    remote = F.element_at(F.array(*map(F.lit, ("NotConfigured", "Available", "Unreachable", "InvalidPayload", "Surprise"))), (n % 5 + 1).cast("int"))
    return el.health(spark, d).select("sample_id", health.overall(n % 7 == 0, n % 11 == 0, remote, n % 13 == 0).alias("status"))


@query("health_slots_hourly", "SELECT c.component, strftime(s.slot, '%Y-%m-%d %H') AS slot, CASE max(h.severity) WHEN 2 THEN 'Unhealthy' WHEN 1 THEN 'Degraded' WHEN 0 THEN 'Healthy' END AS status FROM (SELECT DISTINCT component FROM hs) c CROSS JOIN (SELECT unnest(generate_series(date_trunc('hour', a), date_trunc('hour', b), INTERVAL 1 HOUR)) AS slot FROM (SELECT min(captured_at) AS a, max(captured_at) AS b FROM hs)) s LEFT JOIN hs h ON h.component = c.component AND date_trunc('hour', h.captured_at) = s.slot GROUP BY 1, s.slot")
def health_slots_hourly(spark, d):
    return health.slots(el.health(spark, d), "HOUR").withColumn("slot", F.date_format("slot", "yyyy-MM-dd HH"))


# scalars and JSON --------------------------------------------------------------------------------------

@query("identity_parts", "SELECT DISTINCT key, CASE WHEN ok THEN lower(split_part(key, ':', 1)) END AS tenant_id, CASE WHEN ok THEN lower(split_part(key, ':', 2)) END AS domain, CASE WHEN ok THEN split_part(key, ':', 3) END AS aggregate_id, CASE WHEN ok THEN 'events:' || n END AS suffix FROM (SELECT *, event_type_name IN ('click', 'error') AS ok, CASE event_type_name WHEN 'click' THEN tenant_id WHEN 'error' THEN upper(tenant_id) WHEN 'view' THEN '-' || tenant_id ELSE tenant_id || ':x y' END || ':' || domain || ':' || aggregate_id || ':events:' || n AS key FROM (SELECT *, event_id % 3 AS n FROM ev))")
def identity_parts(spark, d):
    kind = F.col("event_type_name")
    tenant = F.when(kind == "click", F.col("tenant_id")).when(kind == "error", F.upper("tenant_id")).when(kind == "view", F.concat(F.lit("-"), "tenant_id")).otherwise(F.concat("tenant_id", F.lit(":x y")))
    rows = el.load(spark, d).select(F.concat_ws(":", tenant, "domain", "aggregate_id", F.lit("events"), F.col("event_id") % 3).alias("key")).distinct()
    return rows.select("key", *[c.alias(n) for n, c in scalars.state_key(F.col("key")).items()])


@query("message_types_made", "SELECT DISTINCT name, version, CASE WHEN version >= 1 AND name NOT LIKE '% %' THEN 'activity-' || lower(left(event_type_name, 1)) || substr(event_type_name, 2) || '-done-v' || version END AS message_type FROM (SELECT event_type_name, upper(left(event_type_name, 1)) || substr(event_type_name, 2) || CASE WHEN event_id % 5 = 4 THEN ' Done' ELSE 'Done' END AS name, CAST(event_id % 3 AS INTEGER) AS version FROM ev)")
def message_types_made(spark, d):
    kind = F.col("event_type_name")
    name = F.concat(F.upper(F.substring(kind, 1, 1)), F.substring(kind, 2, 100), F.when(F.col("event_id") % 5 == 4, " Done").otherwise("Done"))
    rows = el.load(spark, d).select(name.alias("name"), (F.col("event_id") % 3).cast("int").alias("version")).distinct()
    return rows.withColumn("message_type", scalars.message_type_of(F.lit("activity"), F.col("name"), F.col("version")))


@query("naming", "SELECT DISTINCT kind, lower(left(event_type_name, 1)) || substr(event_type_name, 2) || '-done' AS domain_name, CASE WHEN tenant_id <> 'tenant-2' THEN lower(event_type_name) || '-done-eventstore' END AS state_store, CASE WHEN tenant_id <> 'tenant-2' THEN lower(event_type_name) || '-done-commands' END AS command_endpoint, CASE WHEN tenant_id <> 'tenant-2' THEN tenant_id || '.' || lower(event_type_name) || '-done.projection-changed' END AS changed_topic FROM (SELECT *, upper(left(event_type_name, 1)) || substr(event_type_name, 2) || 'Done' || ['', 'Aggregate', 'Projection', 'Processor'][event_id % 4 + 1] AS kind FROM ev)")
def naming(spark, d):
    own, ends = F.col("event_type_name"), F.array(*map(F.lit, ("", "Aggregate", "Projection", "Processor")))
    kind = F.concat(F.upper(F.substring(own, 1, 1)), F.substring(own, 2, 100), F.lit("Done"), F.element_at(ends, (F.col("event_id") % 4 + 1).cast("int")))
    tenant = F.when(F.col("tenant_id") == "tenant-2", "Tenant 2").otherwise(F.col("tenant_id"))
    rows = el.load(spark, d).select(kind.alias("kind"), tenant.alias("tenant")).distinct().withColumn("domain_name", scalars.domain_name(F.col("kind")))
    return rows.select("kind", "domain_name", *[c.alias(n) for n, c in scalars.resource_names(F.col("tenant"), F.col("domain_name")).items()])


@query("etags", "SELECT tag, CASE WHEN event_id % 4 < 2 THEN kind END AS projection_type, CASE WHEN event_id % 4 < 2 THEN message_id END AS version FROM (SELECT *, CASE event_id % 4 WHEN 3 THEN '.' || message_id WHEN 1 THEN rtrim(replace(replace(to_base64(encode(kind)), '+', '-'), '/', '_'), '=') || '.' || message_id ELSE rtrim(replace(replace(to_base64(encode(kind)), '+', '-'), '/', '_'), '=') || '.' || message_id END AS tag FROM (SELECT *, event_type_name || CASE event_id % 4 WHEN 2 THEN ':x' ELSE '/' || aggregate_id || '?ü' END AS kind FROM ev))")
def etags(spark, d):
    n = F.col("event_id") % 4
    kind = F.concat("event_type_name", F.when(n == 2, ":x").otherwise(F.concat(F.lit("/"), "aggregate_id", F.lit("?ü"))))
    tag = F.when(n == 3, F.concat(F.lit("."), "message_id")).otherwise(scalars.etag(kind, F.col("message_id")))
    return el.load(spark, d).select(tag.alias("tag")).select("tag", *[c.alias(k) for k, c in scalars.etag_parts(F.col("tag")).items()])


@query("extension_checks", "SELECT message_id, CASE event_id % 6 WHEN 1 THEN 'Count' WHEN 2 THEN 'KeyLength' WHEN 3 THEN 'ValueLength' WHEN 4 THEN 'KeyCharacters' WHEN 5 THEN 'ControlCharacters' END AS problem, CASE event_id % 6 WHEN 1 THEN 9 + 24 * 2 + 33 WHEN 2 THEN 130 WHEN 3 THEN 2050 WHEN 4 THEN 4 WHEN 5 THEN 4 ELSE 1 + strlen(payload) END AS bytes FROM ev")
def extension_checks(spark, d):
    n = F.col("event_id") % 6
    many = F.map_from_arrays(F.transform(F.sequence(F.lit(1), F.lit(33)), lambda i: i.cast("string")), F.transform(F.sequence(F.lit(1), F.lit(33)), lambda i: F.when(i > 9, "y").otherwise("x")))
    own = F.when(n == 1, many).when(n == 2, F.create_map(F.repeat(F.lit("k"), F.lit(129)), F.lit("v"))).when(n == 3, F.create_map(F.lit("k"), F.repeat(F.lit("v"), F.lit(2049))))
    own = own.when(n == 4, F.create_map(F.lit("a b"), F.lit("v"))).when(n == 5, F.create_map(F.lit("k"), F.lit("a\x01b"))).otherwise(F.create_map(F.lit("k"), F.col("payload")))
    rows = el.load(spark, d).withColumn("extensions", own)
    return rows.select("message_id", scalars.extensions_problem(F.col("extensions")).alias("problem"), scalars.extensions_size(F.col("extensions")).alias("bytes"))


@query("intent_digests", "SELECT message_id, sha256(strlen(message_id) || ':' || message_id || CASE WHEN event_id % 2 = 0 THEN '-1:' ELSE strlen(payload) || ':' || payload END || strlen(CAST(event_id AS VARCHAR)) || ':' || event_id) AS digest FROM ev")
def intent_digests(spark, d):
    return el.load(spark, d).select("message_id", scalars.intent_digest([F.col("message_id"), F.when(F.col("event_id") % 2 == 1, F.col("payload")), F.col("event_id")]).alias("digest"))


@query("csv_rows", "SELECT message_id || ',' || CASE event_id % 3 WHEN 0 THEN '\"a,\"\"' || event_type_name || '\"\"\"' WHEN 1 THEN event_type_name ELSE '' END || ',' || event_id AS line FROM ev")
def csv_rows(spark, d):
    n = F.col("event_id") % 3
    cell = F.when(n == 0, F.concat(F.lit('a,"'), "event_type_name", F.lit('"'))).when(n == 1, F.col("event_type_name"))
    return sinks.csv_lines(el.load(spark, d).select("message_id", cell.alias("cell"), "event_id"))


DOCS = "'{\"b\": {\"y\": ' || event_id || ', \"x\": [1, 2]}, \"a\": ' || CASE event_id % 3 WHEN 0 THEN 'null' WHEN 1 THEN '\"t\"' ELSE '{\"deep\": {\"er\": true}}' END || '}'"


def nested():
    n = F.col("event_id")
    return F.concat(F.lit('{"b": {"y": '), n, F.lit(', "x": [1, 2]}, "a": '), F.when(n % 3 == 0, "null").when(n % 3 == 1, '"t"').otherwise('{"deep": {"er": true}}'), F.lit("}"))


@query("canonical_documents", "SELECT message_id, CASE WHEN event_id % 5 <> 4 THEN '{\"a\":' || CASE event_id % 3 WHEN 0 THEN 'null' WHEN 1 THEN '\"t\"' ELSE '{\"deep\":{\"er\":true}}' END || ',\"b\":{\"x\":[1,2],\"y\":' || event_id || '}}' END AS document FROM ev")
def canonical_documents(spark, d):
    torn = F.when(F.col("event_id") % 5 == 4, "{").otherwise(nested())
    return el.load(spark, d).select("message_id", scalars.canonical_json(torn).alias("document"))


@query("document_leaves", """SELECT message_id, path, value FROM (SELECT message_id, 'b.x' AS path, '[1,2]' AS value FROM ev UNION ALL SELECT message_id, 'b.y', CAST(event_id AS VARCHAR) FROM ev UNION ALL SELECT message_id, CASE event_id % 3 WHEN 2 THEN 'a.deep.er' ELSE 'a' END, CASE event_id % 3 WHEN 0 THEN 'null' WHEN 1 THEN '"t"' ELSE 'true' END FROM ev)""")
def document_leaves(spark, d):
    return el.load(spark, d).withColumn("leaf", F.explode(json_paths.leaves(nested()))).select("message_id", "leaf.path", "leaf.value")


MERGED = """, lf AS (SELECT aggregate_id, sequence_number, 'b.y' AS path, CAST(event_id AS VARCHAR) AS value FROM ev UNION ALL SELECT aggregate_id, sequence_number, 'b.x', '[1,2]' FROM ev UNION ALL SELECT aggregate_id, sequence_number, CASE event_id % 3 WHEN 2 THEN 'a.deep.er' ELSE 'a' END, CASE event_id % 3 WHEN 0 THEN 'null' WHEN 1 THEN '"t"' ELSE 'true' END FROM ev)
"""


@query("document_state", MERGED + "SELECT aggregate_id, path, value, sequence_number FROM lf JOIN (SELECT aggregate_id, max(sequence_number) AS sequence_number FROM ev GROUP BY 1) USING (aggregate_id, sequence_number)")
def document_state(spark, d):
    """Payloads merged in order: a leaf that turned into an object, or back, takes the older one's place."""
    return json_paths.merged_at(el.load(spark, d), ["aggregate_id"], "sequence_number", nested())


@query("document_diff", MERGED + "SELECT n.aggregate_id, n.path, n.value AS new_value, o.value AS old_value FROM lf n LEFT JOIN lf o ON o.aggregate_id = n.aggregate_id AND o.path = n.path AND o.sequence_number = 10 WHERE n.sequence_number = 20 AND n.value IS DISTINCT FROM o.value")
def document_diff(spark, d):
    log = el.load(spark, d)
    old, new = (json_paths.merged_at(log.where(F.col("sequence_number") <= n), ["aggregate_id"], "sequence_number", nested()) for n in (10, 20))
    return json_paths.diff(old, new, ["aggregate_id"])


# declared queries --------------------------------------------------------------------------------------

REGISTRY = plans.Registry(plans.Cursors(b"tests and demonstrations"))


@REGISTRY.query("activity", "events", ("message_id",), ("event_type_name", "aggregate_id"))
def _events(log, request):
    return log.withColumn("last_known", F.when(F.col("event_id") % 4 != 0, F.col("value")))


ASKED = plans.Request("activity", "events", "Tenant-1", (("value", "gt", 10.0), ("event_type_name", "in", ["view", "click", "error"])), (("last_known", "desc"),), "user-1")
ASKED_SQL = "SELECT message_id, CASE WHEN event_id % 4 <> 0 THEN value END AS last_known FROM ev WHERE tenant_id = 'tenant-1' AND value > 10 AND event_type_name IN ('view', 'click', 'error') AND (event_type_name LIKE '%user-1%' OR aggregate_id LIKE '%user-1%')"


@query("declared_query", ASKED_SQL)
def declared_query(spark, d):
    """Filters, search and order that a request declares."""
    return REGISTRY.plan(el.load(spark, d), ASKED)[0].select("message_id", "last_known")


@query("keyset_page", f"SELECT message_id, last_known FROM (SELECT *, row_number() OVER (ORDER BY last_known DESC NULLS LAST, message_id) AS r FROM ({ASKED_SQL})) WHERE r > (SELECT count(*) * 9 // 10 FROM ({ASKED_SQL}))")
def keyset_page(spark, d):
    """What lies behind the row at nine tenths of the order, where values may be null."""
    rows, order = REGISTRY.plan(el.load(spark, d), ASKED)
    sort = [F.desc_nulls_last(c) if down else F.asc_nulls_first(c) for c, down in order]
    skip = rows.count() * 9 // 10
    at = rows.orderBy(*sort).offset(skip - 1).limit(1).collect()
    return (rows.where(plans.after(order, [at[0][c] for c, _ in order])) if at and skip else rows).select("message_id", "last_known")
