"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs at line and sentence ends, and long ones at words that a hash marks, so a cut
depends only on the words around it. Each paragraph's digest is added to three cells of a sketch. Sketches
of two versions subtract cell by cell; peeling cells that hold one digest recovers those on one side only.
Stored fingerprints are whole sketches, so two of them subtract and peel without their texts (``compare``).
If peeling stalls, both sides are sketched again at twice the size until it succeeds.
"""

from __future__ import annotations

import base64
import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_rows, table

SENTENCE = re.compile(r"(?<=[.!?])\s+")
#: Sentences of more characters are cut at marked words.
LONG = 120


@dataclass(frozen=True)
class Settings:
    """``cells``: of the sketch that is stored; ``words``: mean length of a paragraph cut out of a long line."""

    cells: int = 24
    words: int = 8


def paragraphs(text: str, words: int = 8) -> list[str]:
    out = []
    for line in text.split("\n"):
        for part in SENTENCE.split(line):
            if len(part) <= LONG:
                if part := part.strip():
                    out.append(part)
                continue
            own: list[str] = []
            for w in part.split():
                own.append(w)
                if len(own) > 2 and xxhash.xxh32_intdigest(w) % words == 0:
                    out.append(" ".join(own))
                    own = []
            if own:
                out.append(" ".join(own))
    return out


def digests(text: str, words: int = 8) -> np.ndarray:
    """A non-zero 64-bit digest for each paragraph; the second and later copies of one count as others."""
    seen: dict[str, int] = {}
    out = []
    for p in paragraphs(text, words):
        n = seen[p] = seen.get(p, -1) + 1
        out.append(xxhash.xxh3_64_intdigest(p, n) or 1)
    return np.unique(np.array(out, dtype=np.uint64))


def mixed(keys: np.ndarray, salt: int) -> np.ndarray:
    x = (keys ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


SALTS = (0x51ED270B, 0xA3B1C6D7, 0x7C15F39D)


def places(keys: np.ndarray, cells: int | np.ndarray) -> np.ndarray:
    """Three cells of each key, one in each third of its sketch, which has ``cells`` cells."""
    third = np.asarray(cells) // 3
    return np.stack([k * third + (mixed(keys, s) % third.astype(np.uint64)).astype(np.int64) for k, s in enumerate(SALTS)])


def check(keys: np.ndarray) -> np.ndarray:
    return mixed(keys, 0x2545F491)


@dataclass
class Sketch:
    """``cells`` counts, and the exclusive or of the keys and of their checks in each cell."""

    count: np.ndarray
    key: np.ndarray
    check: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, cells: int) -> Sketch:
        out = cls(np.zeros(cells, np.int64), np.zeros(cells, np.uint64), np.zeros(cells, np.uint64))
        if len(keys):
            at = places(keys, cells)
            own = check(keys)
            for row in at:
                np.add.at(out.count, row, 1)
                np.bitwise_xor.at(out.key, row, keys)
                np.bitwise_xor.at(out.check, row, own)
        return out

    def __sub__(self, other: Sketch) -> Sketch:
        return Sketch(self.count - other.count, self.key ^ other.key, self.check ^ other.check)

    def peel(self) -> tuple[np.ndarray, np.ndarray] | None:
        """Keys on the left side only and on the right only, or None if cells remain."""
        pair, key, sign, left = peel_many(self, np.zeros(1, np.int64), np.array([len(self.count)]))
        return None if left[0] else (key[sign == 1], key[sign == -1])

    def written(self, n: int) -> str:
        """The number of paragraphs and the cells, as text; ``read`` restores both."""
        raw = self.count.astype("<i4").tobytes() + self.key.astype("<u8").tobytes() + self.check.astype("<u8").tobytes()
        return f"{n}:{base64.b64encode(raw).decode()}"

    @classmethod
    def read(cls, text: str) -> tuple[int, Sketch]:
        n, _, cells = text.partition(":")
        raw = base64.b64decode(cells)
        size = len(raw) // 20
        count, key, own = raw[: 4 * size], raw[4 * size : 12 * size], raw[12 * size :]
        return int(n), cls(np.frombuffer(count, "<i4").astype(np.int64), np.frombuffer(key, "<u8").astype(np.uint64), np.frombuffer(own, "<u8").astype(np.uint64))


def compare(a: str, b: str) -> tuple[np.ndarray, np.ndarray, float] | None:
    """From two stored fingerprints: digests of the first only, of the second only, and the likeness; None where they differ in more than their cells can tell, and larger sketches of the texts are due."""
    (n, x), (_, y) = Sketch.read(a), Sketch.read(b)
    found = (x - y).peel()
    return found and (*found, likeness(n, *found))


def peel_many(joint: Sketch, base: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Peel many sketches that lie behind each other in ``joint``, from ``base`` on, with ``cells`` each.

    All found keys (sketch, key, +1 or -1), and for each sketch whether cells remain.
    """
    count, key, own = joint.count.copy(), joint.key.copy(), joint.check.copy()
    owner = np.repeat(np.arange(len(base)), cells)
    pairs, keys, signs = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    look = np.arange(len(count))
    while len(look):
        pure = look[(np.abs(count[look]) == 1) & (key[look] != 0)]
        pure = pure[check(key[pure]) == own[pure]]
        if not len(pure):
            break
        _, first = np.unique(mixed(key[pure], 0x1234567) + mixed(owner[pure].astype(np.uint64), 0x89ABCDE), return_index=True)
        pure = pure[first]
        found, sign, pair = key[pure], count[pure], owner[pure]
        pairs.append(pair)
        keys.append(found)
        signs.append(sign)
        at, sums = places(found, cells[pair]) + base[pair], check(found)
        for row in at:
            np.subtract.at(count, row, sign)
            np.bitwise_xor.at(key, row, found)
            np.bitwise_xor.at(own, row, sums)
        look = np.unique(at)
    left = np.zeros(len(base), dtype=bool)
    left[owner[(count != 0) | (key != 0) | (own != 0)]] = True
    return np.concatenate(pairs), np.concatenate(keys), np.concatenate(signs), left


def differences(pairs: list[tuple[np.ndarray, np.ndarray]], cells: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For each pair: digests of the first only, of the second only, and the cells it took.

    The squares of the counts left by subtracting the stored sketches estimate the difference and so the size of the
    first try; whatever stalls is tried again at twice the size. A sketch is linear, so the two sides are
    subtracted while they are added up, for all pairs at once.
    """
    out: list = [None] * len(pairs)
    open_ = list(range(len(pairs)))
    sizes = np.full(len(pairs), cells, dtype=np.int64)
    first = True
    while open_:
        own = np.array(open_)
        size = sizes[own]
        base = np.cumsum(size) - size
        lengths = np.array([len(x) for i in open_ for x in pairs[i]])
        keys = np.concatenate([x for i in open_ for x in pairs[i]])
        sign = np.repeat(np.tile([1, -1], len(open_)), lengths)
        pair = np.repeat(np.repeat(np.arange(len(open_)), 2), lengths)
        total = int(size.sum())
        joint = Sketch(np.zeros(total, np.int64), np.zeros(total, np.uint64), np.zeros(total, np.uint64))
        at, sums = places(keys, size[pair]) + base[pair], check(keys)
        for row in at:
            np.add.at(joint.count, row, sign)
            np.bitwise_xor.at(joint.key, row, keys)
            np.bitwise_xor.at(joint.check, row, sums)
        if first:
            guess = np.add.reduceat(joint.count**2, base) // 3
            most = np.array([len(pairs[i][0]) + len(pairs[i][1]) for i in open_])
            need = np.minimum(guess, most) * 3 // 2
            while (small := sizes < need).any():
                sizes[small] *= 2
            first = False
            if (sizes != cells).any():
                grown = [i for i in open_ if sizes[i] != cells]
                keep = np.flatnonzero(sizes == cells)
                spots = np.concatenate([np.arange(base[k], base[k] + cells) for k in keep]) if len(keep) else np.zeros(0, np.int64)
                joint, open_ = Sketch(joint.count[spots], joint.key[spots], joint.check[spots]), [open_[k] for k in keep]
                size = sizes[open_] if open_ else np.zeros(0, np.int64)
                base = np.cumsum(size) - size
            else:
                grown = []
        else:
            grown = []
        if open_:
            which, found, signs, left = peel_many(joint, base, size)
            order = np.argsort(which, kind="stable")
            which, found, signs = which[order], found[order], signs[order]
            edges = np.searchsorted(which, np.arange(len(open_) + 1))
            for k, i in enumerate(open_):
                if left[k]:
                    sizes[i] *= 2
                    grown.append(i)
                else:
                    f, g = found[edges[k] : edges[k + 1]], signs[edges[k] : edges[k + 1]]
                    out[i] = (f[g == 1], f[g == -1], int(size[k]))
        open_ = grown
    return out


def likeness(n: int, left: np.ndarray, right: np.ndarray) -> float:
    """Shared digests over all digests of both (1 if neither has any), from the first's number and what differs."""
    every = n + len(right)
    return (n - len(left)) / every if every else 1.0


def with_next(docs: DataFrame, pieces: int | None = None) -> DataFrame:
    """Deal rows into ranges of (doc_id, text), each followed by a copy of the row that comes after it.

    Columns part, halo (true for the copy), doc_id, text, dealt by part and sorted by (part, halo, doc_id, text).
    Only split points and each range's first id reach the driver; the last range is followed by the very first
    row. Rows without doc_id are left out.
    """
    docs = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    spark = docs.sparkSession
    n = pieces or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    splits = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 20 * n)).first()[0] if n > 1 else []
    edges = np.array(sorted(set(splits or [])), dtype=np.int64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(), side="left").astype(np.int32))

    firsts = docs.select("doc_id", range_of("doc_id").alias("part")).groupBy("part").agg(F.min("doc_id").alias("first")).orderBy("part").collect()  # n rows at most
    follows = [(r["first"], firsts[k - 1]["part"]) for k, r in enumerate(firsts)]  # first id of a range, and the range before it
    before = F.broadcast(spark.createDataFrame(follows, "doc_id long, part int"))
    copies = docs.join(before, "doc_id").groupBy("doc_id", "part").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    dealt = docs.select(range_of("doc_id").alias("part"), F.lit(False).alias("halo"), "doc_id", "text")
    every = dealt.unionByName(copies.select("part", F.lit(True).alias("halo"), "doc_id", "text"))
    return every.repartition(n, "part").sortWithinPartitions("part", "halo", "doc_id", "text")


def edited(text: str, after: str) -> str:
    """The text with its last half, rounded down, replaced by as many first characters (or all) of another."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def fingerprint(docs: DataFrame, s: Settings | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_paragraphs of each row.

    Null texts count as empty. Rows that repeat a doc_id follow each other by text; the last row is followed by
    the first (a table of one row by itself). Rows stream through a task in order; no more than a batch is held.
    """
    s = s or Settings()
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_paragraphs long"

    def make():
        held: list = []  # (part, doc_id, text, digests) of the row whose next is still to come

        def row(doc, text, keys, after, after_keys):
            changed = edited(text, after)
            own = digests(changed, s.words)
            pairs.append((keys, own))
            pairs.append((keys, after_keys))
            return (
                doc, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                Sketch.of(keys, s.cells).written(len(keys)), Sketch.of(own, s.cells).written(len(own)), len(keys),
            )

        pairs: list[tuple[np.ndarray, np.ndarray]] = []

        def batch(parts, halos, keys, texts):
            out = []
            pairs.clear()
            for part, halo, doc, text in zip(parts, halos, keys, texts, strict=True):
                text = text or ""
                own = digests(text, s.words)
                if held and held[0][0] == part:
                    out.append(row(*held[0][1:], text, own))
                held[:] = [] if halo else [(part, doc, text, own)]
            if not out:
                return [[]] * 8
            near = [likeness(len(p[0]), *d[:2]) for k in range(0, len(pairs), 1000) for p, d in zip(pairs[k : k + 1000], differences(pairs[k : k + 1000], s.cells), strict=True)]
            found = [list(c) for c in zip(*out, strict=True)]
            return [*found[:5], near[::2], near[1::2], found[5]]

        return batch

    return map_rows(with_next(docs), ["part", "halo", "doc_id", "text"], schema, make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(table(spark, sf_dir, "documents"))
