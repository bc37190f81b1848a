"""The event-log engine beyond its catalog: edge cases, streaming runs, stores, sinks and datasets."""

from __future__ import annotations

import datetime
import itertools
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark import models
from tidemark.functions import json_paths, scalars
from tidemark.operators import checks, commands, folds, health, lineage, projections, readmodels, reads, rollups, samples
from tidemark.plans import queries as plans
from tidemark.sources import datasets, sinks
from tidemark.sources import event_log as el
from tidemark.streaming import consumers

SF = "/root/testdata/sf0.001"
KEY = ("t", "d", "a")
LOG = "tenant_id string, domain string, aggregate_id string, sequence_number long, message_id string, event_type_name string, payload string, metadata_version int, serialization_format string, ts timestamp_ntz, value double, event_id long, correlation_id string, causation_id string"


def events(spark, rows, key=KEY):
    """A log of (sequence, type, payload, version, format) rows."""
    at = datetime.datetime(2024, 1, 1)
    full = [(*key, n, f"m{k}", kind, payload, version, form, at, 1.0, k, "c", "") for k, (n, kind, payload, version, form) in enumerate(rows)]
    return spark.createDataFrame(full, LOG)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# scalar functions --------------------------------------------------------------------------------------

@pytest.mark.parametrize("name, want", [
    ("OrderCreated", "order-created"), ("HTTPRequest", "http-request"), ("Order2Created", "order-2-created"), ("V2", "v-2"), ("a1B2c", "a-1-b-2c"), ("ABC", "abc"), ("X", "x"), ("aBC9d", "a-bc-9d"), ("Order12", "order-12"),
])
def test_kebab(spark, name, want):
    assert one(spark, scalars.kebab(F.lit(name))) == want


@pytest.mark.parametrize("topic, valid", [
    ("t.d.events", True), ("d.events", True), ("a..b.events", False), ("UPPER.x.events", False), ("t.d.e.events", False), ("t.d.event", False), ("-t.d.events", False), ("t-1.d-2.events", True), (".events", False), ("x" * 242 + ".events", True), ("x" * 243 + ".events", False),
])
def test_topics(spark, topic, valid):
    assert one(spark, scalars.topic_valid(F.lit(topic))) is valid


@pytest.mark.parametrize("text, want", [
    ("orders-created-v1", ("orders", "created", 1)), ("orders-created--twice-v01", ("orders", "created--twice", 1)), ("a-b-v1-v2", ("a", "b-v1", 2)), ("orders-created-v0", None), ("orders-v1", None), ("-x-v1", None), ("orders-Created-v1", None), ("orders--x-v1", None), ("orders-x-v99999999999", None), ("a-" + "b" * 187 + "-v1", ("a", "b" * 187, 1)), ("a-" + "b" * 188 + "-v1", None),
])
def test_message_types(spark, text, want):
    got = spark.range(1).select(*[c.alias(n) for n, c in scalars.message_type(F.lit(text)).items()]).first()
    assert tuple(got) == (want or (None, None, None))


@pytest.mark.parametrize("stored, full, short", [
    ("A.B.C, Asm, Version=1", "A.B.C", "C"), ("A.B+C", "A.B+C", "C"), ("C", "C", "C"),
    ("A.L`1[[B.X, Asm, Version=1]], mscorlib", "A.L`1[[B.X]]", "L`1[[B.X]]"), ("A.D`2[[B.X, Asm],[C.Y, Asm2]]", "A.D`2[[B.X],[C.Y]]", "D`2[[B.X],[C.Y]]"), ("A.B[,], Asm", "A.B[,]", "B[,]"),
])
def test_type_names(spark, stored, full, short):
    assert (one(spark, scalars.type_name(F.lit(stored))), one(spark, scalars.type_short_name(F.lit(stored)))) == (full, short)
    assert folds.Handlers(()).short(full) == short


def test_etags_and_identities(spark):
    for kind in ("counter", "a/b?c", "ü" * 5, "x"):
        tag = one(spark, scalars.etag(F.lit(kind), F.lit("v.1")))
        assert tuple(spark.range(1).select(*scalars.etag_parts(F.lit(tag)).values()).first()) == (kind, "v.1")
    for bad in ("", "abc", ".v", "abc.", "YTpi.v", "a.v", "!!.v"):  # YTpi is a:b
        assert tuple(spark.range(1).select(*scalars.etag_parts(F.lit(bad)).values()).first()) == (None, None), bad
    assert tuple(spark.range(1).select(*scalars.identity(F.lit("T1:Dom:Agg.1")).values()).first()) == ("t1", "dom", "Agg.1")
    for bad in ("a:b", "a:b:c:d", ":b:c", "a:b:", "a b:c:d"):
        assert tuple(spark.range(1).select(*scalars.identity(F.lit(bad)).values()).first()) == (None, None, None), bad


# replay ------------------------------------------------------------------------------------------------

HANDLERS = folds.Handlers(("Acme.Up", "Acme.Down", "Acme.A.Twice", "Acme.B.Twice"))


@pytest.mark.parametrize("rows, want", [
    ([(1, "Up", "{}", 1, "json"), (2, "Acme.Down", "", 1, "JSON")], ("Succeeded", None, None, None, 2)),
    ([(2, "Up", "{}", 1, "json")], ("Failed", "Unexpected", 1, "", 0)),
    ([(1, "Nobody", "{}", 1, "json"), (2, "Up", "{}", 1, "json"), (2, "Up", "{}", 1, "json")], ("Failed", "Unexpected", 2, "Up", 0)),
    ([(1, "Up", "{}", 1, "json"), (4, "Up", "{}", 1, "json"), (4, "Up", "{}", 1, "json")], ("Failed", "Unexpected", 2, "", 0)),
    ([(1, "Up", "{}", 1, "json"), (2, "Up", "{}", 0, "json")], ("Failed", "UnsupportedVersion", 2, "Up", 1)),
    ([(1, "Up", "{}", 1, "json"), (2, "  ", "{}", 1, "xml")], ("Failed", "UnknownEventType", 2, "  ", 1)),
    ([(1, "Up", "{}", 1, "json"), (2, "Up", "{}", 1, "xml")], ("Failed", "UnsupportedVersion", 2, "Up", 1)),
    ([(1, "Up", "{}", 1, "json"), (2, "Twice", "{}", 1, "json")], ("Failed", "UnknownEventType", 2, "Twice", 1)),
    ([(1, "Other.Acme.B.Twice", "{}", 1, "json"), (2, "Up", "{", 1, "json")], ("Failed", "DeserializationFailed", 2, "Up", 1)),
    ([(1, "Up", "null", 1, "json")], ("Failed", "DeserializationFailed", 1, "Up", 0)),
    ([(1, "Up", None, 1, "json"), (2, "Down", "[1]", 1, "json"), (3, "Nobody", "{}", 1, "json")], ("Partial", "ApplyFailed", 2, "Down", 1)),
])
def test_replay(spark, rows, want):
    got = folds.replay_status(events(spark, rows), HANDLERS, None, F.col("payload") == "[1]").first()
    assert (got.status, got.error, got.failed_sequence, got.failed_type, got.last_applied) == want


def test_replay_up_to_a_sequence_and_without_handlers(spark):
    log = events(spark, [(1, "Up", "{}", 1, "json"), (2, "Nobody", "{}", 1, "json"), (2, "Up", "{}", 1, "json")])
    assert folds.replay_status(log, HANDLERS, 1).first().status == "Succeeded"
    assert folds.replay_status(log.where("event_type_name = 'Up' AND sequence_number = 1"), folds.Handlers(())).first().error == "ApplyHandlerMissing"
    assert folds.replay_status(log.limit(0), HANDLERS).count() == 0


def test_states_from_snapshots_are_those_of_whole_streams(spark):
    rng = random.Random(4)
    rows = [(n, rng.choice(["click", "error", "error", "purchase", "signup", "view"]), "{}", 1, "json") for n in range(1, 61)]
    log = events(spark, rows).unionByName(events(spark, rows[:7], ("t", "d", "b")))
    want = sorted(folds.at(log).drop("ts").collect())
    for n in (1, 7, 33, 60):
        own = folds.at(log, n).where(F.col("sequence_number") == n).select("tenant_id", "domain", "aggregate_id", "sequence_number", *folds.DEMO.fields)
        got = folds.rehydrated(log, own, folds.DEMO)
        assert sorted(got.drop("missing").select(*folds.at(log).drop("ts").columns).collect()) == want and got.where("missing IS NOT NULL").count() == 0
    holed = folds.rehydrated(log.where("sequence_number <> 50"), own.limit(0), folds.DEMO)
    assert {r.aggregate_id: r.missing for r in holed.collect()} == {"a": 50, "b": None}


def test_bisect_converges_where_divergence_stays(spark):
    rows = [(n, "purchase" if n == 23 else "view", "{}", 1, "json") for n in range(1, 41)]
    log = events(spark, rows)
    steps = folds.bisect_steps(folds.timeline(log), 5, 40, ("spent",)).orderBy("step").collect()
    low, high, mids = 5, 40, []
    while high - low > 1:
        m = (low + high) // 2
        mids.append((m, "good" if m < 23 else "bad"))
        low, high = (m, high) if m < 23 else (low, m)
    assert [(r.middle, r.verdict) for r in steps] == mids and [r.converged for r in steps] == [False] * (len(mids) - 1) + [True]
    assert not folds.bisect_steps(folds.timeline(log), 5, 40, ("spent",), most=2).where("converged").count()
    assert folds.first_divergence(log, 5, 40, ("spent",)).first().diverged_at == high == 23


def test_counter_commands_and_the_guard(spark):
    rows = [(n, kind, "{}", 1, "json") for n, kind in enumerate(["CounterIncremented", "CounterIncremented", "CounterDecremented", "CounterCannotGoNegative"], 1)]
    log = events(spark, rows).unionByName(events(spark, [*rows, (5, "CounterClosed", "{}", 1, "json")], ("t", "d", "b")))
    asked = log.select("tenant_id", "domain", "aggregate_id").distinct().withColumn("command", F.lit("DecrementCounter"))
    got = {r.aggregate_id: r for r in folds.sandbox(log, asked, samples.counter, None, samples.COUNTER).collect()}
    assert (got["a"].outcome, got["a"].produced, got["a"].count_after) == ("accepted", "CounterDecremented", 0)
    assert (got["b"].outcome, got["b"].produced, got["b"].count_after, got["b"].is_terminated_after) == ("rejected", "AggregateTerminated", 1, True)


# reads and lineage -------------------------------------------------------------------------------------

def test_reads_refuse_and_clamp(spark):
    log = events(spark, [(n, "Up", "{}", 1, "json") for n in range(1, 34)])
    assert reads.read_whole(log, -9).count() == 33 and reads.read_whole(log, 32).count() == 1 and reads.read_whole(log, 40).count() == 0
    for hole in (1, 17):
        with pytest.raises(Exception, match="missing or repeated event"):
            reads.read_whole(log.where(F.col("sequence_number") != hole)).collect()
    for start, size, to, token in ((0, 0, None, None), (0, 1001, None, None), (-1, 5, None, None), (5, 5, 4, None), (1 << 31, 5, None, None), (0, 5, 1 << 31, None), (0, 5, None, "x")):
        with pytest.raises(reads.InvalidRead):
            reads.read_page(log, start, size, to, token)
    page = reads.read_page(log, 30, 10).orderBy("sequence_number").collect()
    assert [r.sequence_number for r in page] == [31, 32, 33] and not page[0].is_truncated and page[0].latest_sequence == page[0].last_returned == 33
    assert [r.sequence_number for r in reads.timeline(log, 3, 7).orderBy("sequence_number").collect()] == [3, 4, 5, 6, 7]
    assert {(r.total_count, r.next_token) for r in reads.timeline(log, None, None, 10).collect()} == {(33, 11)}
    with pytest.raises(reads.InvalidRead):
        reads.detail(log, 0)
    assert reads.detail(log, 99).count() == 0


def test_appended_positions_are_dense(spark):
    log = events(spark, [(1, "Up", "{}", 1, "json"), (2, "Up", "{}", 1, "json")]).withColumn("global_position", F.col("sequence_number") * 10)
    rows = spark.createDataFrame([("t", "d", "ab"[i % 2], f"n{i}", p) for i, p in enumerate([5, 100, 7, 7, 7, 3000])], "tenant_id string, domain string, aggregate_id string, message_id string, position long")
    got = sorted((r.global_position, r.message_id, r.aggregate_id, r.sequence_number) for r in reads.append(log, rows).collect())
    assert got == [(21, "n0", "a", 3), (22, "n2", "a", 4), (23, "n3", "b", 1), (24, "n4", "a", 5), (25, "n1", "b", 2), (26, "n5", "b", 3)]


def test_a_batch_is_written_behind_the_log(spark, tmp_path):
    path, log = str(tmp_path / "log"), el.load(spark, SF)
    el.write_log(log, path)
    rows = spark.createDataFrame([("tenant-1", "activity", "user-7", "new", "c", None, 1)], "tenant_id string, domain string, aggregate_id string, message_id string, correlation_id string, causation_id string, position int")
    reads.append_batch(el.read_log(spark, path), rows.drop("position").withColumn("position", F.lit(1)), F.lit("2025-01-01").cast("timestamp_ntz"), path)
    stored = el.read_log(spark, path)
    assert stored.count() == log.count() + 1
    last = reads.of(stored, "TENANT-1", "activity", "user-7").orderBy(F.desc("sequence_number")).first()
    assert (last.message_id, last.causation_id, last.global_position, last.ts) == ("new", "c", log.count() + 1, datetime.datetime(2025, 1, 1))
    plan = reads.of(stored, "tenant-1", "activity", "user-7")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(tenant_id" in plan and "PushedFilters: [IsNotNull(aggregate_id)" in plan


def test_chain_links_by_cause_alone(spark):
    log = events(spark, [(n, "Up", "{}", 1, "json") for n in range(1, 6)])
    cause = {2: "m0", 3: "m0", 4: "", 5: " "}
    log = log.withColumn("causation_id", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in cause.items() for x in kv]), F.col("sequence_number").cast("int")), F.lit("command")))
    got = sorted((r.place, r.message_id, r.originating_command_id) for r in lineage.chain(log, "T", "d", "a", 1).collect())
    assert got == [(0, "m0", "command"), (1, "m1", "m0"), (1, "m2", "m0")]
    assert lineage.chain(log, "t", "d", "a", 4).first().originating_command_id is None
    with pytest.raises(LookupError):
        lineage.chain(log, "t", "d", "a", 6)


def test_trace_of_shared_and_expired_commands(spark):
    log = events(spark, [(n, "OrderRejected" if n == 3 else "Up", "{}", 1, "json") for n in range(1, 6)])
    rows = [("t", "d", "a", "c", "Completed", datetime.datetime(2024, 1, 1)), ("t", "d", "b", "c", "Received", datetime.datetime(2024, 1, 3))]
    asked = spark.createDataFrame(rows, "tenant_id string, domain string, aggregate_id string, correlation_id string, status string, ts timestamp_ntz")
    got = {r.aggregate_id: r for r in lineage.trace(log, asked, 3, F.lit("2024-01-03").cast("timestamp_ntz")).collect()}
    a, b = got["a"], got["b"]
    assert (a.status, a.status_expired, a.outcome, a.event_count, a.rejections, a.scan_capped) == (None, True, "Ambiguous", 3, 1, True)
    assert (b.status, b.status_expired, b.event_count, b.scan_capped) == ("Received", False, 0, False)


# read models -------------------------------------------------------------------------------------------

def test_store_saves_conflicts_expires_erases_and_updates(spark, tmp_path):
    store = readmodels.Store(spark, str(tmp_path / "store"))
    at = F.timestamp_seconds(F.lit(1_000_000))

    def writes(*rows):
        return spark.createDataFrame(list(rows), "key string, value string, expected long, place int")

    assert {r.key: r.outcome for r in store.try_save(writes(("a", "1", 0, 0), ("b", "1", 7, 0), ("c", "1", None, 0))).collect()} == {"a": "Saved", "b": "Conflict", "c": "Saved"}
    assert {r.key: (r.outcome, r.version) for r in store.try_save(writes(("a", "2", 1, 0), ("c", "2", 0, 0))).collect()} == {"a": ("Saved", 2), "c": ("Conflict", 1)}
    store.save(spark.createDataFrame([("e", "x")], "key string, value string").withColumn("expires_at", at))
    assert {r.key for r in store.get(now=F.timestamp_seconds(F.lit(999_999))).collect()} == {"a", "c", "e"} and {r.key for r in store.get(now=at).collect()} == {"a", "c"}
    keys = spark.createDataFrame([("a", 1), ("c", 1), ("z", None)], "key string, expected long")
    assert {r.key: r.outcome for r in store.erase(keys).collect()} == {"a": "Conflict", "c": "Erased", "z": "Missing"}
    assert {r.key: r.outcome for r in store.erase(keys).collect()} == {"a": "Conflict", "c": "Missing", "z": "Missing"}

    def grown(read):
        return read.withColumn("value", F.concat(F.coalesce("value", F.lit("")), F.lit("+")))

    assert {r.outcome for r in store.update(keys.select("key"), grown).collect()} == {"Saved"}
    again = readmodels.Store(spark, store.path).open()
    assert {r.key: (r.value, r.version) for r in again.get().where("key <> 'e'").collect()} == {"a": ("2+", 3), "c": ("+", 3), "z": ("+", 1)}

    calls = itertools.count()

    def beaten(read):  # another write comes first each time
        store.save(spark.createDataFrame([("a", f"other {next(calls)}")], "key string, value string"))
        return read.withColumn("value", F.lit("mine"))

    assert [r.outcome for r in store.update(keys.where("key = 'a'").select("key"), beaten, 2).collect()] == ["RetryExhausted"] and next(calls) == 2


def test_freshness_of_odd_ages(spark):
    rows = spark.createDataFrame([(None,), (-5.0,), (10.0,), (11.0,), (21.0,)], "age double")
    assert [r.s for r in rows.select(projections.freshness(F.col("age"), 10, 20).alias("s")).collect()] == ["Unknown", "Current", "Current", "Aging", "Stale"]


def test_correlation_index_overflows(spark):
    at = datetime.datetime(2024, 1, 1)
    rows = [("t", "c", f"m{i:03d}", at) for i in range(130)] + [("t", "d", "x", at), ("t", "d", "x", at)]
    got = {r.correlation_id: r for r in commands.correlation_index(spark.createDataFrame(rows, "tenant_id string, correlation_id string, message_id string, ts timestamp_ntz")).collect()}
    assert (got["c"].commands, got["c"].outcome, len(got["c"].message_ids.split(","))) == (130, "Overflow", 128) and got["d"].outcome == "Resolved"


# JSON --------------------------------------------------------------------------------------------------

def test_leaves_of_odd_documents():
    assert json_paths.leaves_of('{"a": {"b": [1, {"c": 2}]}, "": 1, "n": null, "e": {}}') == [{"path": "a.b", "value": '[1,{"c":2}]'}, {"path": "n", "value": "null"}]
    assert [json_paths.leaves_of(x) for x in (None, "", "{", "[1]", "3", "{}", '{"a":' * 100_000)] == [None] * 5 + [[], None]


def test_merged_documents(spark):
    rng = random.Random(2)
    shapes = ['{"a": 1}', '{"a": {"b": 2}}', '{"a": {"b": {"c": 3}}, "z": null}', '{"a": {"d": [1]}}', "[1]", "{", '{"z": {"y": 1}}', "{}"]
    rows = [(k, n, rng.choice(shapes)) for k in range(40) for n in range(rng.randint(1, 9))]

    def merge(into, new):
        for k, v in new.items():
            if isinstance(v, dict):
                into[k] = merge(into[k] if isinstance(into.get(k), dict) else {}, v)
            else:
                into[k] = v
        return into

    want = {}
    for k, _, text in rows:
        try:
            value = json.loads(text)
        except ValueError:
            continue
        if isinstance(value, dict):
            merge(want.setdefault(k, {}), value)
    df = spark.createDataFrame(rows, "k int, n int, payload string")
    got = {(r.k, r.path, r.value) for r in json_paths.merged_at(df, ["k"], "n", F.col("payload")).collect()}
    assert got == {(k, leaf["path"], leaf["value"]) for k, state in want.items() for leaf in json_paths.leaves_of(json.dumps(state))}


# streaming ---------------------------------------------------------------------------------------------

def stored(spark, tmp_path, log, files=3):
    path = str(tmp_path / "in")
    log.repartitionByRange(files, "event_id").sortWithinPartitions("event_id").write.parquet(path)
    return path, log.schema


def test_contiguous_stream_is_its_batch_form(spark, tmp_path):
    log = el.with_repeats(el.with_gaps(el.load(spark, SF))).where("event_id < 400")
    path, schema = stored(spark, tmp_path, log, 2)
    got = []
    stream = consumers.contiguous(consumers.read_stream(spark, path, schema, 1))
    consumers.deliver(stream, lambda batch, _: got.extend(batch.collect()), str(tmp_path / "check")).awaitTermination()
    assert sorted(got) == sorted(consumers.contiguous_prefix(log).select(*stream.columns).collect())


def test_running_state_in_a_stream_is_the_timeline(spark, tmp_path):
    log = el.load(spark, SF).where("event_id < 300")
    path, schema = stored(spark, tmp_path, log, 2)
    got = []
    stream = consumers.running(consumers.read_stream(spark, path, schema, 1), folds.DEMO)
    consumers.deliver(stream, lambda batch, _: got.extend(batch.collect()), str(tmp_path / "check")).awaitTermination()
    want = folds.timeline(log).select(*stream.columns)
    assert {tuple(r) for r in got} == {tuple(r) for r in want.collect()} and len(got) == log.count()


def test_running_state_of_files_that_come_in_the_wrong_order(spark, tmp_path):
    log = el.load(spark, SF).where("event_id < 300")
    early, late = log.where("event_id < 150"), log.where("event_id >= 150")
    for rows, age in ((late, 1_600_000_000), (early.unionByName(early.limit(5)), 1_700_000_000)):
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for file in (tmp_path / "in").glob("part-*.parquet"):
            if file.stat().st_mtime > 1_750_000_000:
                os.utime(file, (age, age))
    got = []
    stream = consumers.running(consumers.read_stream(spark, str(tmp_path / "in"), log.schema, 1), folds.DEMO)
    consumers.deliver(stream, lambda batch, _: got.extend(batch.collect()), str(tmp_path / "check")).awaitTermination()
    assert sorted(got) == sorted(folds.timeline(log).select(*stream.columns).collect())


def test_dead_letters_are_put_aside(spark, tmp_path):
    torn = F.when(F.col("event_id") % 9 == 0, F.lit("{oops")).otherwise(F.col("payload"))
    log = el.load(spark, SF).withColumn("payload", torn).where("event_id < 500")
    path, schema = stored(spark, tmp_path, log)
    fine, dead = [], str(tmp_path / "dead")
    known = ("click", "error", "purchase")
    consumers.deliver_or_bury(consumers.read_stream(spark, path, schema, 1), known, lambda batch, _: fine.extend(batch.collect()), dead, str(tmp_path / "check")).awaitTermination()
    told = consumers.classify(log, known)
    assert {r.message_id for r in fine} == {r.message_id for r in told.where("problem IS NULL").collect()}
    assert {(r.message_id, r.problem) for r in spark.read.parquet(dead).collect()} == {(r.message_id, r.problem) for r in told.where("problem IS NOT NULL").collect()}


def test_handlers_get_the_rows_of_their_types(spark, tmp_path):
    log = el.load(spark, SF).where("event_id < 200")
    topic = reads.published(log).select("value")
    topic.write.parquet(str(tmp_path / "topic"))
    schema = spark.createDataFrame([], "id string, type string, subject string").schema
    got, handlers = [], consumers.Handlers()

    @handlers.on("view", "click")
    def told(rows, number):
        got.extend(rows.collect())

    with pytest.raises(ValueError):
        handlers.on("view")(told)
    stream = consumers.from_topic(consumers.read_stream(spark, str(tmp_path / "topic"), topic.schema), schema).withColumnRenamed("type", "event_type_name")
    consumers.deliver(stream, handlers, str(tmp_path / "check")).awaitTermination()
    assert {r.id for r in got} == {r.message_id for r in log.where("event_type_name IN ('view', 'click')").collect()}
    ticks = consumers.read_topic(spark, schema, "rate-micro-batch", rowsPerBatch=1)
    assert ticks.isStreaming and ticks.columns == ["id", "type", "subject"]


def test_rebuilt_models_are_held_against_a_replay(spark, tmp_path):
    log = el.load(spark, SF)
    assert sorted(projections.rebuild(log, str(tmp_path / "new")).collect()) == sorted(projections.counter(log).collect())


# plans, sinks, datasets --------------------------------------------------------------------------------

def test_pages_by_cursor_hold_every_row_once(spark):
    log = el.load(spark, SF)
    for order in ((("last_known", "desc"),), (("last_known", "asc"),), (("event_type_name", "asc"), ("last_known", "desc"))):
        asked = plans.Request("activity", "events", "tenant-1", order=order, size=90)
        want = [r.message_id for r in models.REGISTRY.plan(log, asked)[0].orderBy(*[(F.desc_nulls_last if d == "desc" else F.asc_nulls_first)(c) for c, d in order], "message_id").collect()]
        got, cursor = [], None
        for _ in range(20):
            page = models.REGISTRY.page(log, plans.Request("activity", "events", "tenant-1", order=order, size=90, cursor=cursor))
            got += [r.message_id for r in page.rows]
            cursor = page.next_cursor
            if cursor is None:
                break
        assert got == want and len(want) > 180
    page = models.REGISTRY.page(log, plans.Request("activity", "events", "tenant-1", size=10, offset=5))
    assert len(page.rows) == 10 and page.next_offset == 15


@pytest.mark.parametrize("change, reason", [
    ({"tenant": ""}, "Required"), ({"size": 0}, "PageSize"), ({"size": 201}, "PageSize"), ({"offset": -1}, "Offset"), ({"offset": 1, "cursor": "x"}, "CursorAndOffset"), ({"cursor": "x" * 5000}, "CursorLength"), ({"cursor": "!"}, "Malformed"), ({"cursor": "AAAA"}, "Tampered"),
    ({"kind": "nothing"}, "UnknownQuery"), ({"filters": (("nothing", "eq", 1),)}, "Filter"), ({"filters": (("value", "like", 1),)}, "Filter"),
])
def test_queries_are_refused(spark, change, reason):
    asked = {"domain": "activity", "kind": "events", "tenant": "tenant-1"} | change
    with pytest.raises(plans.QueryRefused) as caught:
        models.REGISTRY.page(el.load(spark, SF), plans.Request(**asked))
    assert caught.value.reason == reason


def test_cursors_are_bound_to_their_query(spark):
    cursors = plans.Cursors(b"k")
    text = cursors.write("q", plans.scope("t", "a:b", watermark=5), [1, None])
    assert cursors.read(text, "q", plans.scope("t", "a:b", watermark=5)) == [1, None]
    for kind, scope, reason in (("p", plans.scope("t", "a:b", watermark=5), "QueryType"), ("q", plans.scope("t", "a", "b", watermark=5), "Scope")):
        with pytest.raises(plans.QueryRefused, match=reason):
            cursors.read(text, kind, scope)
    with pytest.raises(plans.QueryRefused, match="Tampered"):
        plans.Cursors(b"other").read(text, "q", plans.scope("t"))
    with pytest.raises(plans.QueryRefused, match="Watermark"):
        plans.scope("t", watermark=0)
    assert plans.scope("a:b", "c|d\\e") == "a\\cb:c\\pd\\\\e"
    tag = plans.tag("events", el.load(spark, SF))
    assert plans.not_modified(tag, f'"x", "{tag}"') and not plans.not_modified(tag, "*") and not plans.not_modified(tag, ",".join(["x"] * 10 + [tag]))


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a,"b"\n'), (2, None)], "n int, `te,xt` string")
    assert sinks.csv_header(rows) == 'n,"te,xt"' and [r.line for r in sinks.csv_lines(rows).collect()] == ['1,"a,""b""\n"', "2,"]
    assert [json.loads(r.line) for r in sinks.json_lines(rows).collect()] == [{"n": 1, "te,xt": 'a,"b"\n'}, {"n": 2}]
    sinks.write_text(sinks.json_lines(rows), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2 and "te,xt" in sinks.as_table(rows)
    line = json.loads(reads.export(reads.of(el.load(spark, SF), "tenant-1", "activity", "user-7"), 1).first().line)
    assert line["aggregate_id"] == "user-7" and "payload" in line


def test_health_history_reads_its_days_alone(spark, tmp_path):
    samples_ = el.health(spark, SF)
    health.write_history(samples_, str(tmp_path / "h"))
    found = health.history(spark, str(tmp_path / "h"), "20240103", "20240105")
    assert found.count() == samples_.where("captured_at >= '2024-01-03' AND captured_at < '2024-01-06'").count() > 0
    assert len(os.listdir(tmp_path / "h")) > 20


def test_dataset_is_read_back_as_defined(spark, tmp_path):
    d = datasets.Definition(streams=7, events=250)
    datasets.write(spark, d, str(tmp_path / "set"))
    log, found = datasets.read(spark, str(tmp_path / "set"))
    assert datasets.fingerprint(log) == datasets.fingerprint(datasets.events(spark, d)) and datasets.faults(log, found, d).count() == 0
    hurt = log.where("NOT (aggregate_id = 'stream-3' AND sequence_number = 9)")
    assert datasets.fingerprint(hurt) != datasets.fingerprint(log)
    assert {r.fault for r in datasets.faults(hurt, found.where("aggregate_id <> 'stream-5'"), d).collect()} == {"EventCount", "Snapshot"}
    assert {r.fault for r in datasets.faults(log.where("aggregate_id <> 'stream-1'"), found, d).collect()} == {"StreamCount"}


def test_small_roll_ups_with_nulls(spark):
    rows = spark.createDataFrame([("t", "d", "a", "Up", "{}"), ("t", "d", "b", "Up", None), ("t", "e", "c", "Up", "{}")], "tenant_id string, domain string, aggregate_id string, event_type_name string, payload string")
    got = {r.domain: r.size_bytes for r in rollups.storage_by_type(rows, rows.select("tenant_id", "domain", "aggregate_id").limit(1)).collect()}
    assert got == {"d": None, "e": 2}
    assert rollups.growth(spark.createDataFrame([(None,), (None,)], "v double"), "v").first().average_growth is None
    assert checks.worst(checks.gaps(events(spark, [(2, "Up", "{}", 1, "json"), (4, "Up", "{}", 1, "json")])).withColumn("check", F.lit("continuity")), 1).first().severity == "Critical"
    assert [r.status for r in rows.select(F.explode(F.array(*[health.overall(F.lit(a), F.lit(False), F.lit(b), F.lit(False)) for a, b in ((True, None), (False, None), (False, "Available"))])).alias("status")).limit(3).collect()] == ["Unhealthy", "Degraded", "Healthy"]
