"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Training hashes a bounded sample of labelled rows in parallel; the online updates (per-coordinate rates, L1 and
L2), which follow each other, run over the sample's indices in one task. L1 leaves few weights, 2**20 at most,
so the model is broadcast whatever the corpus holds; scoring is one pass without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fold, map_rows, table

WORD = re.compile(r"[^\W_]+")
BITS = 20
EMPTY = np.zeros(0, dtype=np.int64)


@dataclass(frozen=True)
class Settings:
    """``sample_rows``: at most about so many labelled rows of each class are learned from."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 1.0
    epochs: int = 6
    sample_rows: int = 4000
    skip: int = 2


def hashes(text: str, memo: dict[str, int]) -> np.ndarray:
    """A 64-bit number for each word of the lower-cased text, in order."""
    words = WORD.findall(text.lower())
    for w in words:
        if w not in memo:
            memo[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) * 0x9E3779B1 + 1
    return np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))


def features(h: np.ndarray, skip: int = 2) -> np.ndarray:
    """Hashed indices of words, bigrams and skip-grams with up to ``skip`` - 1 words between, sorted, each once."""
    if not len(h):
        return EMPTY
    kinds = [h * np.uint64(0x9E3779B97F4A7C15)]
    kinds += [(h[:-d] * np.uint64(0xC2B2AE3D27D4EB4F) + h[d:] * np.uint64(0x165667B19E3779F9) + np.uint64(d)) * np.uint64(0x9E3779B97F4A7C15) for d in range(1, skip + 1) if len(h) > d]
    return np.unique(np.concatenate(kinds) >> np.uint64(64 - BITS)).astype(np.int64)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


class Ftrl:
    """FTRL-proximal for binary features; slot 2**BITS is the bias, which L1 leaves alone."""

    def __init__(self, s: Settings):
        self.s, size = s, (1 << BITS) + 1
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray) -> np.ndarray:
        s, z = self.s, self.z[at]
        l1 = np.where(at == 1 << BITS, 0.0, s.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((s.beta + np.sqrt(self.n[at])) / s.alpha + s.l2))

    def learn(self, at: np.ndarray, label: int) -> float:
        at = np.append(at, 1 << BITS)
        w = self.weights(at)
        p = float(sigmoid(w.sum()))
        g = p - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.s.alpha * w
        self.n[at] = n + g * g
        return p


@dataclass(frozen=True)
class Model:
    index: np.ndarray
    weight: np.ndarray
    bias: float
    skip: int

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << BITS)
        w[self.index] = self.weight
        return w


def sample(labels: DataFrame, s: Settings) -> DataFrame:
    """About ``sample_rows`` labels (doc_id, label) of each class at most, chosen by a hash of doc_id; all where there are fewer."""
    counts = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}  # two classes
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("label") == label, F.lit(min(1.0, s.sample_rows / n))).otherwise(share)
    return labels.where((F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) / F.lit(float(1 << 20))) < share)


def fit(rows: DataFrame, s: Settings | None = None) -> Model:
    """Learn from ``rows`` (doc_id, text, label 0/1), which ``labelled`` keeps to a bounded sample. Null labels or texts are left out. No rows, or one class only: the bias alone."""
    s = s or Settings()

    def extract():
        memo: dict[str, int] = {}
        return lambda keys, texts, labels: (keys, [features(hashes(t, memo), s.skip) for t in texts], labels)

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        at = [np.asarray(x, dtype=np.int64) for x in pdf["at"]]
        label, model = pdf["label"].to_numpy(), Ftrl(s)
        order = np.argsort([zlib.crc32(str(k).encode()) for k in pdf["doc_id"]], kind="stable")
        for epoch in range(s.epochs):
            for i in np.random.default_rng(epoch).permutation(order):
                model.learn(at[i], int(label[i]))
        w = model.weights(np.arange((1 << BITS) + 1))
        kept = np.flatnonzero(w)
        return pd.DataFrame({"i": kept, "w": w[kept]})

    rows = rows.select("doc_id", "text", F.col("label").cast("int").alias("label")).dropna(subset=["text", "label"])
    found = map_rows(rows, ["doc_id", "text", "label"], "doc_id long, at array<int>, label int", extract)
    got = found.groupBy().applyInPandas(learn, "i long, w double").toPandas()  # 2**BITS + 1 numbers at most; L1 leaves some thousands
    bias = float(got.loc[got["i"] == 1 << BITS, "w"].sum())
    got = got[got["i"] < 1 << BITS].sort_values("i")
    return Model(got["i"].to_numpy(dtype=np.int64), got["w"].to_numpy(dtype=np.float64), bias, s.skip)


def scorer(m: Model):
    """A function from texts to scores, for use in a task."""
    w, memo = m.dense(), {}

    def scores(texts: list[str | None]) -> list[float]:
        if len(memo) > 1_000_000:
            memo.clear()
        return [float(sigmoid(w[features(hashes(t, memo), m.skip)].sum() + m.bias)) if t else float(sigmoid(m.bias)) for t in texts]

    return scores


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose text scores under one half, with all their columns; texts that are null or empty stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names, at = docs.columns, docs.columns.index("text")

    def make():
        scores = scorer(shared.value)

        def batch(*columns):
            kept = [not t or x < 0.5 for t, x in zip(columns[at], scores(columns[at]), strict=True)]
            return [[v for v, k in zip(c, kept, strict=True) if k] for c in columns]

        return batch

    return map_rows(docs, names, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), make)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) of each whole text; null and empty texts have the score of the bias alone. Rows that repeat are scored alike; a table without rows gives none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scores = scorer(shared.value)
        return lambda keys, texts: (keys, scores(texts))

    return map_rows(docs, ["doc_id", "text"], "doc_id long, score double", make)


def labelled(docs: DataFrame, labels: DataFrame, s: Settings | None = None) -> DataFrame:
    """The rows that are learned from: doc_id, text, label, without held-out documents.

    Labels are sampled before they meet the texts, so what is broadcast has a bound (about two classes times
    ``sample_rows`` ids) and no text is shuffled.
    """
    toxic = labels.where(F.col("toxic").isNotNull() & (fold() != 0)).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    return docs.select("doc_id", "text").join(F.broadcast(sample(toxic, s or Settings())), "doc_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(labelled(docs, table(spark, sf_dir, "labels"))))
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
