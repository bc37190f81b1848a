"""A corpus from raw documents to token ids: STAGES run in order, each on all that the one before kept.

Every stage is written as Parquet to the shared folder and read again, so a lost executor costs a stage's
tasks and not the work before them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontam, neardup, pii, toxicity
from tidemark.llm.common import Scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under one half; texts that are null or empty stay, rows that repeat go together, no rows give none."""
    model = toxicity.fit(toxicity.labelled(docs, table(spark, sf_dir, "labels")))
    return toxicity.drop_toxic(docs.select(*COLUMNS), model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group that shares 0.8 of its five-word shingles; rows without id or words stay, no rows give none."""
    return neardup.distinct_documents(docs.select(*COLUMNS), neardup.Settings(words=5))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has no region that leaks a benchmark item; null and empty texts stay, no rows give none."""
    return decontam.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, every span of personal data replaced by its kind; n_chars follows the new text, both stay null where the text is; no rows give none."""
    docs = docs.select(*COLUMNS)
    return pii.redact(docs, pii.fit(docs)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and the text that the ids decode to, of each row; null texts count as empty, no rows give none."""
    path, pattern = bpe.vocabulary()
    return bpe.round_trip(docs, path, pattern)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("personal_data", hide_personal_data),
    ("bpe", tokens),
]

#: Models, sketches and merges can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        own = Scratch(spark)
        docs = own.write(stage(spark, docs, sf_dir))
        if before is not None:
            before.drop()
        before = own
    return STAGES[-1][1](spark, docs, sf_dir)
