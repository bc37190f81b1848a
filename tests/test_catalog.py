"""Every query of the event-log engine against its SQL in DuckDB, on the same tables."""

from __future__ import annotations

import base64
import datetime
import decimal
import hashlib
import math
import os
import struct
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.operators import checks, lineage, projections, reads, rollups
from tidemark.sources import event_log as el
from tidemark.streaming import consumers

SF = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.001")


def plain(x):
    """A value that compares alike whichever engine it came from."""
    if x is None or isinstance(x, (bool, str)):
        return repr(x)
    if isinstance(x, (int, float, decimal.Decimal)):
        return "nan" if math.isnan(x) else f"{round(float(x), 6) + 0.0:.6f}"
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (bytes, bytearray)):
        return bytes(x).hex()
    if isinstance(x, dict):
        return repr(sorted((plain(k), plain(v)) for k, v in x.items()))
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    if isinstance(x, (list, tuple)):
        return repr([plain(v) for v in x])
    return str(x)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in sorted(Path(SF).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name not in catalog.ORACLE_SQL:
        assert df.columns and df.schema == catalog.QUERIES[name](spark, SF).schema
        return
    want = duck.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert got == rows(names, want.fetchall())


def test_report_holds_snapshots_against_recorded_heads(spark, tmp_path):
    """The 50th of 50 events is lost (its id divides by 97): a gap, not a snapshot ahead of its stream."""
    first = datetime.datetime(2024, 1, 1)
    events = [(i, first + datetime.timedelta(seconds=i), 7, "view", 1.0, "{}") for i in range(48, 98)]
    path = str(tmp_path / "events.parquet")
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(path)
    found = catalog.QUERIES["consistency_report"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/*.parquet'")
    want = con.execute(catalog.ORACLE_SQL["consistency_report"])
    got = rows(found.columns, found.collect())
    assert got == rows([c[0] for c in want.description], want.fetchall()) and len(got) == 2
    log = el.load(spark, str(tmp_path))
    ahead = reads.heads(log).withColumn("sequence_number", F.col("current_sequence") + 1)
    told = checks.report(el.with_gaps(log), reads.heads(log), ahead, rollups.stream_summary(el.with_gaps(log)))
    assert [r.severity for r in told.where("check = 'snapshot'").collect()] == ["Error"]


def test_closure_reaches_the_root_of_any_chain(spark):
    chain = [("t", "d", "a", i, f"m{i}", f"m{i - 1}" if i else "") for i in range(500)]
    other = [("t", "d", "b", 1, "m1", ""), ("t", "d", "b", 2, "m2", "m1"), ("t", "d", "b", 3, "m3", "elsewhere")]
    circle = [("t", "d", "c", 1, "m1", "m2"), ("t", "d", "c", 2, "m2", "m1"), ("t", "d", "c", 3, "m3", "m2"), ("t", "d", "c", 4, "m4", "m4"), ("t", "d", "c", 5, "m5", "")]
    log = spark.createDataFrame(chain + other + circle, "tenant_id string, domain string, aggregate_id string, sequence_number long, message_id string, causation_id string")
    got = {(r.aggregate_id, r.message_id): (r.root, r.depth) for r in lineage.closure(log).collect()}
    want = {("a", f"m{i}"): ("m0", i) for i in range(500)} | {("b", "m1"): ("m1", 0), ("b", "m2"): ("m1", 1), ("b", "m3"): ("m3", 0)}
    assert got == want | {("c", f"m{i}"): (None, None) for i in range(1, 5)} | {("c", "m5"): ("m5", 0)}
    assert lineage.closure(log.limit(0)).count() == 0


def test_prefix_fingerprint_is_the_plain_fold(spark):
    columns = ("tenant_id", "domain", "aggregate_id", "sequence_number", "message_id", "event_type_name", "payload", "correlation_id", "ts", "serialization_format", "user_id")
    schema = ", ".join(f"{c} {'long' if c == 'sequence_number' else 'timestamp_ntz' if c == 'ts' else 'string'}" for c in columns)
    first = datetime.datetime(2024, 3, 31, 2, 30, 0, 123457)
    rows = [("t", "d", f"a{i // 5}", i % 5 + 1, f"m{i}", "view", None if i % 4 == 1 else f"ü{i}", f"c{i}", first + datetime.timedelta(seconds=i), "json", "u") for i in range(10)]

    def part(value):
        raw = (value or "").encode()
        return struct.pack("<i", -1 if value is None else len(raw)) + raw

    def fold(rows):
        state = {}
        for t, d, a, n, message, kind, payload, correlation, ts, form, user in rows:
            delta = ts - datetime.datetime(1, 1, 1)
            clock = ((delta.days * 86400 + delta.seconds) * 1_000_000 + delta.microseconds) * 10
            told = struct.pack("<q", n) + part(message) + part(kind) + part(payload) + part(form) + struct.pack("<q", clock) + part(correlation) + part(user)
            event = hashlib.sha256(b"own.space.event.v1" + told).digest()
            prior = state.get(a) or hashlib.sha256(b"own.space.prefix.v1" + part(t) + part(d) + part(a) + part("counter")).digest()
            state[a] = hashlib.sha256(b"own.space.step.v1" + prior + event).digest()
        return {a: "v1:" + base64.urlsafe_b64encode(x).decode().rstrip("=") for a, x in state.items()}

    def ours(rows, keep=columns, zoned=False):
        log = spark.createDataFrame(rows, schema).select(*keep)
        log = log.withColumn("ts", log["ts"].cast("timestamp")) if zoned else log
        return {r.aggregate_id: r.fingerprint for r in projections.prefix_fingerprints(log, "counter", "own.space").collect()}

    want = fold(rows)
    assert ours(rows) == want == ours(rows, zoned=True)
    assert ours(rows, columns[:-2]) == fold([(*r[:-2], None, None) for r in rows])
    for at, value in ((8, first), (9, "xml"), (10, "v")):
        changed = [*rows[:3], (*rows[3][:at], value, *rows[3][at + 1 :]), *rows[4:]]
        assert ours(changed) == fold(changed) and ours(changed)["a0"] != want["a0"] and ours(changed)["a1"] == want["a1"]


def test_once_delivers_what_its_batch_form_does(spark, tmp_path):
    path = str(tmp_path / "log")
    el.with_repeats(el.load(spark, SF)).write.parquet(path)
    log = spark.read.parquet(path)
    got = []
    stream = consumers.once(consumers.read_stream(spark, path, log.schema))
    consumers.deliver(stream, lambda batch, _: got.extend(batch.collect()), str(tmp_path / "checkpoint")).awaitTermination()
    want = consumers.once_of_all(log)
    assert rows(log.columns, got) == rows(want.columns, want.collect()) == rows(log.columns, el.load(spark, SF).collect())
    assert log.count() > len(got)
