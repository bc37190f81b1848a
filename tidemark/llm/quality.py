"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade > k) = sigmoid(w . x - t_k) with weights w shared by all grades and thresholds t_0 < t_1 < ... Text
is hashed: words, word shapes with their neighbours, and buckets of a few ratios. A bounded sample is learned
from; scoring is one pass without a shuffle and gives expected grade and tail probability.
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

BITS = 18
RUNS = re.compile(r"[^\W\d_]+|\d+")


@dataclass(frozen=True)
class Settings:
    """``sample_rows``: about so many rows of a grade at most are learned from. ``cut``: selection is by the probability of this grade or a better one."""

    grades: int = 3
    sample_rows: int = 4000
    epochs: int = 8
    rate: float = 0.3
    l2: float = 1e-6
    cut: int = 1
    keep: float = 0.5


def shape(word: str) -> str:
    """Letters by case and digits as one sign a run, at most six signs; the rest as it stands."""
    return RUNS.sub(lambda m: "0" if m[0][0].isdigit() else "A" if m[0].isupper() and len(m[0]) > 1 else "a", word)[:6]


def bucket(x: float) -> int:
    return int(min(20, max(0.0, x) * 20))


def features(text: str, memo: dict[str, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashed indices and their values: kinds of features have a share of the length each."""
    words = text.split()
    for w in set(words):
        if w not in memo:
            memo[w] = zlib.crc32(w.lower().encode("utf-8", "surrogatepass")), zlib.crc32(("shape " + shape(w)).encode("utf-8", "surrogatepass"))
    n = len(words)
    if n:
        both = np.array([memo[w] for w in words], dtype=np.uint64)
        plain, shapes = both[:, 0], both[:, 1]
        repeat = 1.0 - len(set(words)) / n
        letters = sum(map(str.isalpha, text)) / len(text)
        upper = sum(map(str.isupper, text)) / len(text)
        adjacent = float((plain[1:] == plain[:-1]).mean()) if n > 1 else 0.0
    else:
        plain = shapes = np.zeros(0, dtype=np.uint64)
        repeat = letters = upper = adjacent = 0.0
    facts = [f"n{min(12, n.bit_length())}", f"n{min(12, n.bit_length())}r{bucket(repeat)}", f"l{bucket(letters)}", f"u{bucket(upper)}", f"a{bucket(adjacent)}"]
    kinds = [(plain, 0.7), (shapes, 1.0), (shapes[:-1] * np.uint64(31) + shapes[1:] + np.uint64(7), 0.7)]
    at, value = [np.array([zlib.crc32(f.encode()) for f in facts], dtype=np.uint64)], [np.full(len(facts), 0.4)]
    for h, share in kinds:
        own, count = np.unique(h, return_counts=True)
        at.append(own)
        value.append(share * np.sqrt(count) / np.sqrt(max(1, count.sum())))
    index = (np.concatenate(at) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64)
    return index, np.concatenate(value)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


@dataclass(frozen=True)
class Model:
    weight: np.ndarray
    thresholds: np.ndarray

    def tails(self, x: float) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ...: never rising."""
        return sigmoid(x - self.thresholds)


def thresholds_of(raw: np.ndarray) -> np.ndarray:
    """Gaps between thresholds are exponentials, so they stay ordered."""
    return raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))])


def slopes(x: float, raw: np.ndarray, grade: int) -> tuple[float, np.ndarray, float]:
    """The gradient of the log likelihood of a grade by x = w . features and by the raw thresholds, and the likelihood."""
    p = sigmoid(x - thresholds_of(raw))
    full = np.concatenate([[1.0], p, [0.0]])
    mass = max(full[grade] - full[grade + 1], 1e-9)
    slope = np.concatenate([[0.0], p * (1 - p), [0.0]])
    dt = np.zeros(len(raw) + 2)
    dt[grade] -= slope[grade] / mass
    dt[grade + 1] += slope[grade + 1] / mass
    dt = dt[1:-1]
    up = np.concatenate([[dt.sum()], np.exp(raw[1:]) * np.cumsum(dt[::-1])[::-1][1:]])
    return (slope[grade] - slope[grade + 1]) / mass, up, mass


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], s: Settings) -> Model:
    """Per-coordinate (AdaGrad) steps up the likelihood."""
    w, seen = np.zeros(1 << BITS), np.full(1 << BITS, 1e-2)
    raw, raw_seen = np.zeros(s.grades - 1), np.full(s.grades - 1, 1e-2)
    for epoch in range(s.epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            at, value, grade = rows[i]
            g, up, _ = slopes(float(w[at] @ value), raw, grade)
            step = -g * value + s.l2 * w[at]
            seen[at] += step * step
            w[at] -= s.rate * step / np.sqrt(seen[at])
            raw_seen += up * up
            raw += s.rate * up / np.sqrt(raw_seen)
    return Model(w, thresholds_of(raw))


def fit(rows: DataFrame, s: Settings | None = None) -> Model:
    """Learn from ``rows`` (doc_id, text, grade 0 to grades - 1), which ``graded`` keeps to a bounded sample; nulls are left out. Without rows no word counts, and thresholds 0, 1, ... alone give every text the same tail."""
    s = s or Settings()
    rows = rows.select("doc_id", "text", "grade").dropna()

    def extract():
        memo: dict = {}

        def batch(keys, texts, grades):
            found = [features(t, memo) for t in texts]
            return keys, [f[0] for f in found], [f[1] for f in found], grades

        return batch

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        model = train([(np.asarray(a, dtype=np.int64), np.asarray(v), int(g)) for a, v, g in zip(pdf["at"], pdf["value"], pdf["grade"], strict=True)], s)
        kept = np.flatnonzero(model.weight)
        return pd.DataFrame({"i": np.concatenate([kept, -1 - np.arange(s.grades - 1)]), "w": np.concatenate([model.weight[kept], model.thresholds])})

    got = map_rows(rows, ["doc_id", "text", "grade"], "doc_id long, at array<int>, value array<double>, grade int", extract).groupBy().applyInPandas(shard, "i long, w double").toPandas()
    w = np.zeros(1 << BITS)
    if not len(got):
        return Model(w, np.arange(s.grades - 1, dtype=float))
    own = got[got["i"] >= 0]
    w[own["i"].to_numpy()] = own["w"].to_numpy()
    return Model(w, got[got["i"] < 0].sort_values("i", ascending=False)["w"].to_numpy())


def score(docs: DataFrame, model: Model, s: Settings | None = None) -> DataFrame:
    """doc_id, expected_grade, tail (probability of grade ``cut`` or better), selected (tail >= ``keep``) of each whole text; null texts count as empty, rows that repeat are scored alike, a table without rows gives none."""
    s = s or Settings()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        memo: dict = {}
        m: Model = shared.value

        def batch(keys, texts):
            if len(memo) > 500_000:
                memo.clear()
            tails = []
            for t in texts:
                at, value = features(t or "", memo)
                tails.append(m.tails(float(m.weight[at] @ value)))
            tail = [float(t[s.cut - 1]) for t in tails]
            return keys, [float(t.sum()) for t in tails], tail, [t >= s.keep for t in tail]

        return batch

    return map_rows(docs, ["doc_id", "text"], "doc_id long, expected_grade double, tail double, selected boolean", make)


def graded(docs: DataFrame, labels: DataFrame, s: Settings | None = None) -> DataFrame:
    """doc_id, text, grade of labelled rows that aren't held out: 0 low, 1 good but toxic, 2 good and clean.

    Ratings are sampled before they meet the texts: what is broadcast is about ``sample_rows`` ids a grade at most.
    """
    s = s or Settings()
    grade = F.when(F.col("quality") == 0, 0).when(F.coalesce("toxic", F.lit(0)) == 1, 1).otherwise(2)
    own = labels.where(F.col("quality").isNotNull() & (fold() != 0)).groupBy("doc_id").agg(F.min(grade).alias("grade"))
    sizes = {r["grade"]: r["count"] for r in own.groupBy("grade").count().collect()}  # a row for each grade
    share = F.lit(0.0)
    for k, n in sizes.items():
        share = F.when(F.col("grade") == k, F.lit(min(1.0, s.sample_rows / n))).otherwise(share)
    chosen = own.where((F.pmod(F.xxhash64("doc_id", F.lit("grade")), F.lit(1 << 20)) / F.lit(float(1 << 20))) < share)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(graded(docs, table(spark, sf_dir, "labels"))))
    return found.select("doc_id", (fold() == 0).alias("held_out"), "expected_grade", "tail", "selected")
