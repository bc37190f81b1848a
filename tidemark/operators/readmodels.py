"""Read models as a log of versioned writes: the value of a key is that of its newest write.

An entry is (key, value, version, written_at, expires_at, erased); its version is its etag. Writes are decided for whole
batches of keys by joins and appended; nothing is overwritten, so a lost executor repeats a task and no more. Each
batch reads the versions it was decided on. A table has one writer at a time: Parquet has no compare-and-swap between
drivers, and batches of one driver follow each other.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import folds
from tidemark.sources.event_log import ID
from tidemark.sources.scratch import held

ENTRY = "key string, value string, version long, written_at timestamp, expires_at timestamp, erased boolean"
ATTEMPTS = 3


def current(entries: DataFrame, now: Column | None = None) -> DataFrame:
    """key, value, version, expires_at of the keys that have a value: neither erased nor, by ``now``, expired."""
    own = F.struct("value", "version", "expires_at", "erased")
    last = entries.groupBy("key").agg(F.max_by(own, "version").alias("e")).select("key", "e.*")
    alive = ~F.col("erased") if now is None else ~F.col("erased") & (F.col("expires_at").isNull() | (F.col("expires_at") > now))
    return last.where(alive).drop("erased")


def decided(entries: DataFrame, writes: DataFrame, now: Column | None = None) -> DataFrame:
    """The outcome of each write (key, value, expected, and ``place`` in the batch): Saved, with its version, or Conflict, with the version that stands.

    ``expected`` is the version that the writer has read, 0 for a key that must have no value yet, null for a write
    that doesn't care. Of several writes to a key in a batch the first decides; the others conflict unless they don't
    care, and then the last of them stands behind it.
    """
    newest = entries.groupBy("key").agg(F.max("version").alias("newest"))
    alive = current(entries, now).select("key", F.col("version").alias("stands"))
    joined = writes.join(newest, "key", "left").join(alive, "key", "left")
    turn = F.row_number().over(Window.partitionBy("key").orderBy("place"))
    free = F.col("expected").isNull()
    fits = free | ((F.col("expected") == F.coalesce("stands", F.lit(0))) & (F.col("turn") == 1))
    saved = joined.withColumn("turn", turn).withColumn("saved", fits)
    version = F.coalesce("newest", F.lit(0)) + F.count_if("saved").over(Window.partitionBy("key").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return saved.withColumn("made", version).select(*writes.columns, F.when(F.col("saved"), "Saved").otherwise("Conflict").alias("outcome"), F.when(F.col("saved"), F.col("made")).otherwise(F.col("stands")).alias("version"))


def erased(entries: DataFrame, keys: DataFrame, now: Column | None = None) -> DataFrame:
    """The outcome for each key (key, expected; null: whatever stands): Erased, Missing or Conflict, with the tombstone's version where erased. Erasing again is Missing, so a job that stopped half-way can be run again."""
    found = current(entries, now).select("key", F.col("version").alias("stands"))
    joined = keys.join(found, "key", "left")
    outcome = F.when(F.col("stands").isNull(), "Missing").when(F.col("expected").isNotNull() & (F.col("expected") != F.col("stands")), "Conflict").otherwise("Erased")
    return joined.select("key", outcome.alias("outcome"), F.when(outcome == "Erased", F.col("stands") + 1).alias("version"))


class Store:
    """A table of entries at a path of the shared storage, a folder for each batch of writes.

    Every state of the table is read by the list of its folders: scans of one path that has grown in between would pass for the same.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.parts = spark, path, []
        self.log = spark.createDataFrame([], ENTRY)

    def _read(self) -> None:
        self.log = self.spark.read.schema(ENTRY).parquet(*self.parts) if self.parts else self.spark.createDataFrame([], ENTRY)

    def _append(self, rows: DataFrame) -> None:
        part = f"{self.path}/batch-{uuid.uuid4().hex}"
        rows.select("key", "value", F.col("version").cast("long"), F.col("written_at"), F.col("expires_at"), F.col("erased")).write.parquet(part)
        self.parts.append(part)
        self._read()

    def open(self) -> Store:
        """Read what earlier drivers have written."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        found = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)
        self.parts = sorted(f"{self.path}/{f.getPath().getName()}" for f in found if f.isDirectory())
        self._read()
        return self

    def get(self, keys: DataFrame | None = None, now: Column | None = None) -> DataFrame:
        found = current(self.log, now)
        return found if keys is None else found.join(keys.select("key").distinct(), "key", "left_semi")

    def try_save(self, writes: DataFrame, now: Column | None = None) -> DataFrame:
        """Save what ``decided`` accepts, all keys of the batch in one write; returns the outcomes. Writes may have ``expires_at``."""
        own = writes if "expires_at" in writes.columns else writes.withColumn("expires_at", F.lit(None).cast("timestamp"))
        told = held(decided(self.log, own, now))
        self._append(told.where("outcome = 'Saved'").withColumns({"written_at": now if now is not None else F.current_timestamp(), "erased": F.lit(False)}))
        return told

    def save(self, writes: DataFrame, now: Column | None = None) -> DataFrame:
        """Save whatever stands (key, value)."""
        return self.try_save(writes.withColumns({"expected": F.lit(None).cast("long"), "place": F.lit(0)}), now)

    def erase(self, keys: DataFrame, now: Column | None = None) -> DataFrame:
        own = keys if "expected" in keys.columns else keys.withColumn("expected", F.lit(None).cast("long"))
        told = held(erased(self.log, own, now))
        gone = told.where("outcome = 'Erased'").withColumns({"value": F.lit(None).cast("string"), "written_at": now if now is not None else F.current_timestamp(), "expires_at": F.lit(None).cast("timestamp"), "erased": F.lit(True)})
        self._append(gone)
        return told

    def update(self, keys: DataFrame, change, attempts: int = ATTEMPTS) -> DataFrame:
        """Read each key, let ``change`` make the next ``value`` of (key, value, version), and save it if the version still stands; what conflicts is read and tried again, ``attempts`` times in all. Returns key and outcome Saved or RetryExhausted."""
        done, left = None, keys.select("key").distinct()
        for _ in range(attempts):
            read = held(left.join(self.get(left), "key", "left").select("key", "value", F.coalesce("version", F.lit(0)).alias("expected")))
            told = self.try_save(change(read).select("key", "value", "expected").withColumn("place", F.lit(0)))
            saved = told.where("outcome = 'Saved'").select("key", "outcome")
            done = saved if done is None else done.unionByName(saved)
            left = told.where("outcome <> 'Saved'").select("key")
            if left.isEmpty():
                return done
        return done.unionByName(left.withColumn("outcome", F.lit("RetryExhausted")))


def shared_rebuild(log: DataFrame, by: list[str], reducer: folds.Reducer = folds.DEMO) -> DataFrame:
    """One read model over many streams: how many streams share the columns ``by``, and the sums of their states' counters."""
    states = folds.at(log, None, reducer)
    sums = [F.sum(n).alias(n) for n, rule in reducer.fields.items() if isinstance(rule, folds.Counter)]
    return states.groupBy(*by).agg(F.count("*").alias("streams"), F.max("ts").alias("projected_at"), *sums)


def reconciled(deliveries: DataFrame, heads: DataFrame) -> DataFrame:
    """Delivery states (projection, identity, last_delivered) held against the log's heads: Current, Behind (with what is to come), Ahead, or NoStream."""
    joined = deliveries.join(heads.select(*ID, "current_sequence"), list(ID), "left")
    last, head = F.col("last_delivered"), F.col("current_sequence")
    outcome = F.when(head.isNull(), "NoStream").when(last == head, "Current").when(last < head, "Behind").otherwise("Ahead")
    return joined.select("projection", *ID, outcome.alias("outcome"), F.when(last < head, last + 1).alias("redeliver_from"), F.when(last < head, head).alias("redeliver_to"))


def with_fallback(rows: DataFrame, tenants: DataFrame, wildcard: str = "all") -> DataFrame:
    """The rows of each asked tenant (``tenant_id``); a tenant without any gets the wildcard's, as its own. Case doesn't count.

    Two equi-joins: own rows, and the wildcard's (broadcast by Spark only if they are few) for tenants that have none.
    """
    asked = tenants.select(F.col("tenant_id").alias("asked")).distinct()
    named = rows.withColumn("__tenant", F.lower("tenant_id"))
    own = asked.join(named, F.lower("asked") == F.col("__tenant"))
    without = asked.join(named, F.lower("asked") == F.col("__tenant"), "left_anti").withColumn("__any", F.lit(wildcard))
    shared = without.join(named.withColumnRenamed("__tenant", "__any"), "__any")
    columns = [F.col("asked").alias("tenant_id"), *[c for c in rows.columns if c != "tenant_id"]]
    return own.select(*columns, F.lit(False).alias("from_wildcard")).unionByName(shared.select(*columns, F.lit(True).alias("from_wildcard")))


LIFECYCLES = ("Unknown", "Current", "Stale", "Rebuilding", "Degraded", "Unavailable", "LocalOnly")


def lifecycle_flags(lifecycle: Column, backed: Column, unknown_stale: bool | None = None, unknown_degraded: bool | None = None) -> dict[str, Column]:
    """The lifecycle as it counts (Unknown unless the answer is backed by a projection and the state is known), and is_stale, is_degraded and confirmed by it."""
    own = F.when(backed & lifecycle.isin(*LIFECYCLES), lifecycle).otherwise("Unknown")
    stale = F.when(own == "Current", False).when(own == "Stale", True).when(own == "Unknown", F.lit(unknown_stale).cast("boolean"))
    degraded = F.when(own == "Degraded", True).otherwise(F.lit(unknown_degraded).cast("boolean"))
    return {"lifecycle": own, "is_stale": stale, "is_degraded": degraded, "confirmed": backed & (own == "Current")}
