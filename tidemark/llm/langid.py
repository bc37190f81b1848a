"""Language id by segmentation-marginalised unigrams.

Every language has a probability for each piece of one fixed public vocabulary. A word's likelihood is
the sum over *all* its segmentations into pieces, which a forward pass computes; a text's is the
product over its words. Words are runs of letters in lower case, so of the vocabulary's pieces those of
lower-case letters, with or without the mark of a word's start, are the ones that can occur; all of these are
used, whatever their length. A character that is no piece by itself may also stand alone, at a fixed small
probability; learning and scoring sum over the same segmentations. The piece probabilities are fitted by EM:
the E-step (forward-backward over distinct whole words) runs in tasks and only sums by piece, of which there
are a fixed number, reach the driver.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fold, map_rows, table

WORD = re.compile(r"[^\W\d_]+")
START = "▁"
#: Words whose scores a worker keeps; what is forgotten is scored anew.
CACHE_WORDS = 1_000_000
#: Words that take their steps together, and the longest of them; longer ones go alone, rescaled as they go.
RUN_WORDS, SHORT = 4_000, 36
#: Products below are worked out again, by logarithms or rescaled.
TINY = 1e-250


@dataclass(frozen=True)
class Settings:
    """``sample_rows``: about so many rows of a language at most are learned from. ``unseen``: probability of a character that is no piece."""

    sample_rows: int = 1200
    rounds: int = 3
    pooled: float = 300.0
    unseen: float = 1e-7


@dataclass
class Model:
    """``pieces[p]`` has the probability of p in each language; langs are in alphabetical order."""

    langs: list[str]
    pieces: dict[str, tuple[float, ...]]
    longest: int
    unseen: float
    known: dict[str, int] = field(default_factory=dict)

    def word(self, word: str) -> list[float]:
        """Log of the summed probability of all segmentations, for each language."""
        text = START + word
        n, k, get = len(text), len(self.langs), self.pieces.get
        alpha: list[list[float]] = [[1.0] * k] + [None] * n
        scale = [0.0] * k
        for i in range(1, n + 1):
            low = max(0, i - self.longest)
            total = [0.0] * k
            for j in range(low, i):
                if p := get(text[j:i]):
                    a = alpha[j]
                    total = [t + x * y for t, x, y in zip(total, a, p, strict=True)]
            a = alpha[i - 1]
            if i > 1 and text[i - 1] not in self.pieces:
                total = [t + x * self.unseen for t, x in zip(total, a, strict=True)]
            elif i == 1 and START not in self.pieces:
                total = [self.unseen] * k
            if max(total) < 1e-150:  # all positions that are still read move together
                for m in range(k):
                    up = 1.0 / max(total[m], 1e-250)
                    scale[m] -= math.log(up)
                    total[m] *= up
                    for j in range(max(0, i - self.longest), i):
                        alpha[j][m] = min(alpha[j][m] * up, 1e250)
            alpha[i] = total
        return [math.log(max(a, 1e-300)) + s for a, s in zip(alpha[n], scale, strict=True)]

    def words(self, words: list[str]) -> np.ndarray:
        """``word`` for many words at once: arcs are looked up one by one, and all words take their step to a position together."""
        out = np.zeros((len(words), len(self.langs)))
        short = [k for k, w in enumerate(words) if len(w) <= SHORT]
        if not hasattr(self, "number"):
            self.number = {p: k for k, p in enumerate(self.pieces)}
            self.table = np.array([*self.pieces.values(), (self.unseen,) * len(self.langs)])
        get, none = self.number.get, len(self.number)
        whose, start, piece = ([[] for _ in range(SHORT + 2)] for _ in range(3))
        for k, at in enumerate(short):
            text = START + words[at]
            for i in range(1, len(text) + 1):
                own, begin, number = whose[i], start[i], piece[i]
                for j in range(i - self.longest if i > self.longest else 0, i):
                    if (p := get(text[j:i])) is not None:
                        own.append(k)
                        begin.append(j)
                        number.append(p)
                if text[i - 1] not in self.pieces:
                    own.append(k)
                    begin.append(i - 1)
                    number.append(none)
        alpha = np.zeros((len(short), SHORT + 2, len(self.langs)))
        alpha[:, 0] = 1.0
        for i in range(1, SHORT + 2):
            if whose[i]:
                own = np.array(whose[i])
                step = alpha[own, np.array(start[i])] * self.table[np.array(piece[i])]
                edges = np.flatnonzero(np.diff(own, prepend=-1))
                alpha[own[edges], i] = np.add.reduceat(step, edges, axis=0)
        ends = np.array([len(words[at]) + 1 for at in short], dtype=np.int64)
        last = alpha[np.arange(len(short)), ends]
        out[short] = np.log(np.maximum(last, 1e-300))
        tiny = {at for at, low in zip(short, last.min(axis=1), strict=True) if low < TINY}
        for k, w in enumerate(words):
            if len(w) > SHORT or k in tiny:
                out[k] = self.word(w)
        return out


def read_pieces(path: str) -> list[str]:
    """The vocabulary's lower-case pieces of letters, with the mark of a word's start where they have it."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    return sorted(p for p in found if p == p.lower() and (p == START or p.removeprefix(START).isalpha()))


def arcs_of(text: str, prob: dict[str, float], longest: int, unseen: float) -> list[list[tuple[int, float]]]:
    """(start, probability) of the pieces that end at each character; one that is no piece may stand alone."""
    out = []
    for i in range(1, len(text) + 1):
        own = [(j, p) for j in range(max(0, i - longest), i) if (p := prob.get(text[j:i]))]
        if text[i - 1] not in prob:
            own.append((i - 1, unseen))
        out.append(own)
    return out


def log_sum(x: list[float]) -> float:
    top = max(x)
    return top + math.log(sum(math.exp(v - top) for v in x))


def shares(arcs: list[list[tuple[int, float]]]) -> list[list[float]]:
    """The share of a word's probability that runs over each arc (forward-backward); by logarithms where products get too small."""
    n = len(arcs)
    ahead = [1.0] + [0.0] * n
    for i, own in enumerate(arcs, 1):
        ahead[i] = sum(ahead[j] * p for j, p in own)
    if ahead[n] > TINY:
        back = [0.0] * n + [1.0]
        for i in range(n, 0, -1):
            for j, p in arcs[i - 1]:
                back[j] += back[i] * p
        return [[ahead[j] * p * back[i] / ahead[n] for j, p in own] for i, own in enumerate(arcs, 1)]
    ahead = [0.0]
    for own in arcs:
        ahead.append(log_sum([ahead[j] + math.log(p) for j, p in own]))
    out: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for i, own in enumerate(arcs, 1):
        for j, p in own:
            out[j].append((i, math.log(p)))
    back = [0.0] * (n + 1)
    for j in range(n - 1, -1, -1):  # a place that no piece leaves is on no segmentation
        back[j] = log_sum([back[i] + p for i, p in out[j]]) if out[j] else -math.inf
    return [[math.exp(ahead[j] + math.log(p) + back[i] - ahead[n]) for j, p in own] for i, own in enumerate(arcs, 1)]


def expected(words: list[tuple[str, str, int]], pieces: dict[str, dict[str, float]], longest: int, unseen: float) -> dict[tuple[str, str], float]:
    """E-step: how often each piece is expected in the counted words of each language."""
    out: dict[tuple[str, str], float] = defaultdict(float)
    for lang, word, count in words:
        text = START + word
        arcs = arcs_of(text, pieces[lang], longest, unseen)
        for i, (own, share) in enumerate(zip(arcs, shares(arcs), strict=True), 1):
            for (j, _), x in zip(own, share, strict=True):
                if x:
                    out[lang, text[j:i]] += count * x
    return out


def fit(rows: DataFrame, path: str, s: Settings | None = None) -> Model:
    """Learn from ``rows`` (doc_id, text, lang); rows whose text or lang is null are left out. Without rows the model knows no language."""
    s = s or Settings()
    spark = rows.sparkSession
    rows = rows.select("doc_id", "text", "lang").dropna(subset=["text", "lang"])
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    langs = sorted(sizes)
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, s.sample_rows / n))).otherwise(share)
    chosen = rows.where((F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1 << 20)) / F.lit(float(1 << 20))) < share)

    def split():
        def batch(langs, texts):
            counts: dict[tuple[str, str], int] = defaultdict(int)
            for lang, text in zip(langs, texts, strict=True):
                for w in WORD.findall(text.lower()):
                    counts[lang, w] += 1
            return [k[0] for k in counts], [k[1] for k in counts], list(counts.values())

        return batch

    counted = map_rows(chosen, ["lang", "text"], "lang string, word string, n long", split).groupBy("lang", "word").agg(F.sum("n").alias("n")).persist()
    names = read_pieces(path)
    longest = max(map(len, names))
    prob = {lang: dict.fromkeys(names, 1.0 / len(names)) for lang in langs}
    for _ in range(s.rounds):
        shared = spark.sparkContext.broadcast(prob)

        def step(shared=shared):
            def batch(langs, words, counts):
                found = expected(list(zip(langs, words, counts, strict=True)), shared.value, longest, s.unseen)
                return [k[0] for k in found], [k[1] for k in found], list(found.values())

            return batch

        sums = map_rows(counted, ["lang", "word", "n"], "lang string, piece string, n double", step).groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        got: dict[str, dict[str, float]] = {lang: {} for lang in langs}
        for r in sums.toLocalIterator():  # languages times the vocabulary's pieces at most
            got[r["lang"]][r["piece"]] = r["n"]
        pool = {p: sum(got[lang].get(p, 0.0) for lang in langs) + 0.05 for p in names}
        whole = sum(pool.values())
        for lang in langs:
            total = sum(got[lang].get(p, 0.0) for p in names) + s.pooled
            prob[lang] = {p: (got[lang].get(p, 0.0) + s.pooled * pool[p] / whole) / total for p in names}
        shared.unpersist()
    counted.unpersist()
    return Model(langs, {p: tuple(prob[lang][p] for lang in langs) for p in names}, longest, s.unseen)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of each whole text, a row for each row; a table without rows gives none.

    ``und`` with score 0 where the text is null or has no letter, or no language was learned. The score
    is the posterior of the best language under equal priors; ties go to the first in alphabetical order.
    Rows that repeat are judged alike. Only the id and text columns are read, so other names can't clash.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m: Model = shared.value
        known: dict[str, int] = {}
        rows = np.zeros((1 << 12, len(m.langs)))

        def batch(keys, texts):
            nonlocal rows
            if len(known) > CACHE_WORDS:
                known.clear()
            langs, scores = [], []
            split = [WORD.findall(t.lower()) if t and m.langs else [] for t in texts]
            new = list({w for words in split for w in words if w not in known})
            for k in range(0, len(new), RUN_WORDS):
                part = new[k : k + RUN_WORDS]
                while len(known) + len(part) > len(rows):
                    rows = np.concatenate([rows, np.zeros_like(rows)])
                rows[len(known) : len(known) + len(part)] = m.words(part)
                known.update(zip(part, range(len(known), len(known) + len(part)), strict=True))
            for words in split:
                if not m.langs or not any(c.isalpha() for w in words for c in w):
                    langs.append("und")
                    scores.append(0.0)
                    continue
                total = rows[np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))].sum(axis=0)
                best = int(total.argmax())
                langs.append(m.langs[best])
                scores.append(float(1.0 / np.exp(total - total[best]).sum()))
            return keys, langs, scores

        return batch

    return map_rows(docs, ["doc_id", "text"], "doc_id long, lang_pred string, score double", make)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, fit(docs.where(fold() != 0), vocabulary()))
    return found.select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score")
