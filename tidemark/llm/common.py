"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str = "doc_id") -> Column:
    """The remainder (0 to 4) by which rows are held out: 0 is never learned from."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5


def arrow_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(T._parse_datatype_string(schema))


#: Bytes of Arrow rows that are made Python objects at a time; a longer row goes alone. Only memory depends on it.
RUN_BYTES = 4 << 20


def runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """All rows of the batch, in order, in runs of at most RUN_BYTES or one row."""
    if batch.num_rows < 2 or batch.nbytes <= RUN_BYTES:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from runs(batch.slice(0, half))
        yield from runs(batch.slice(half))


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return what a task has freed to the system: workers live on, and executors have several."""
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)


def map_rows(df: DataFrame, columns: list[str], schema: str, make: Callable[[], Callable]) -> DataFrame:
    """Apply a batch function inside tasks, without a shuffle.

    ``make()`` runs once a task and returns ``f(*lists) -> list of lists`` (one list for each output
    column). Only ``columns`` leave the JVM; each Arrow batch is bounded by the session's settings, and
    ``f`` gets it in runs of RUN_BYTES, so that what a worker holds does not depend on the rows of a batch.
    """
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        collects = gc.isenabled()
        gc.disable()  # batch functions make many lists and no cycles; walking them costs more than they do
        try:
            for batch in (run for whole in batches for run in runs(whole)):
                if batch.num_rows:
                    out = f(*(batch.column(i).to_pylist() for i in range(batch.num_columns)))
                    yield pa.RecordBatch.from_arrays([pa.array(x, type=t.type) for x, t in zip(out, arrow, strict=True)], schema=arrow)
        finally:
            del f
            if collects:
                gc.enable()
            give_back()

    return df.select(*columns).mapInArrow(run, schema)


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="tidemark-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a session that runs on this machine alone may leave it unset, and gets a folder of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return folder or f"file://{_own_folder()}"


class Scratch:
    """Tables written to the shared folder on the way to a result; ``drop`` deletes them once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.parts = spark, [], []

    def part(self) -> Scratch:
        """Tables that may be dropped sooner, and are dropped with the rest."""
        self.parts.append(Scratch(self.spark))
        return self.parts[-1]

    def write(self, df: DataFrame) -> DataFrame:
        """The rows, written and read back: lineage ends at files that outlive executors."""
        path = f"{shared_folder(self.spark)}/tidemark-{uuid.uuid4().hex}"
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        for part in self.parts:
            part.drop()
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.paths:
            own = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            own.getFileSystem(conf).delete(own, True)
        self.paths = []


def materialise(df: DataFrame) -> DataFrame:
    """``Scratch.write`` for a table that a result goes on reading, so that it stays."""
    return Scratch(df.sparkSession).write(df)
