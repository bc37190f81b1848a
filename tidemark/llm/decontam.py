"""Benchmark decontamination by q-gram lemma filtering.

Texts are lower-cased and their white space is made single. Benchmark items are cut into overlapping
pieces of ``piece`` characters; a document region leaks a piece if it can be turned into it with at most
``budget`` edits. By the q-gram lemma such a region shares at least ``piece + 1 - q * (budget + 1)`` q-grams
with the piece, on diagonals no more than ``budget`` apart. So q-gram hits are counted in overlapping
diagonal bands, bands that reach the bound are kept, and banded alignment verifies them: no region that leaks
a piece is lost. Pieces begin so close to each other that any ``least`` characters in a row of an item hold a
whole one: whatever copies that much of an item, with at most ``budget`` edits, is found. Items below
``piece`` characters are one piece, found where they are copied whole.

The index over the benchmark is broadcast only below ``broadcast_chars``; a larger benchmark is dealt into
groups of items below that bound, one at a time in the driver, and each group is looked for in a pass of its
own over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_rows, table

MULT = np.uint64(0x9E3779B97F4A7C15)
BITS = 22


@dataclass(frozen=True)
class Settings:
    """``least``: copied runs of so many characters are always found. Pieces shorter than ``piece`` (items below that length) get a budget in proportion; items under ``shortest`` characters can't leak."""

    q: int = 9
    piece: int = 80
    least: int = 100
    budget: int = 6
    shortest: int = 30
    broadcast_chars: int = 16_000_000


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def grams(x: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each q-gram, built by doubling."""
    if len(x) < q:
        return np.zeros(0, dtype=np.uint64)
    power = x.astype(np.uint64) + np.uint64(1)
    have, mult = 1, MULT
    done, length, scale = None, 0, np.uint64(1)
    with np.errstate(over="ignore"):
        while True:
            if q & have:
                done = power if done is None else done[: len(x) - length - have + 1] * mult + power[length:]
                length += have
            if have * 2 > q:
                break
            power = power[:-have] * mult + power[have:]
            mult = mult * mult
            have *= 2
    return done[: len(x) - q + 1] * MULT


@dataclass
class Index:
    """Pieces of the benchmark and where their q-grams are."""

    pieces: list[tuple[int, int, str, int, int]]  # item, start in its normal text, text, budget, bound
    keys: np.ndarray
    first: np.ndarray
    where: np.ndarray  # piece * SPAN + position, by key
    seen: np.ndarray
    least: int
    widest: int


SPAN = 1 << 12


def build(items: list[tuple[int, str]], s: Settings) -> Index:
    pieces = []
    for item, text in items:
        n = len(text)
        if n < s.shortest:
            continue
        length = min(n, s.piece)
        budget = min(s.budget, length * s.budget // s.piece)
        while budget and length + 1 - s.q * (budget + 1) < 1:
            budget -= 1
        starts = [*range(0, n - length, s.least - s.piece + 1), n - length]
        pieces += [(item, a, text[a : a + length], budget, length + 1 - s.q * (budget + 1)) for a in dict.fromkeys(starts)]
    hashes = [grams(points(p[2]), s.q) for p in pieces]
    every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    place = np.concatenate([k * SPAN + np.arange(len(h)) for k, h in enumerate(hashes)]) if hashes else np.zeros(0, np.int64)
    order = np.argsort(every, kind="stable")
    keys, first = np.unique(every[order], return_index=True)
    seen = np.zeros(1 << BITS, dtype=bool)
    seen[(keys >> np.uint64(64 - BITS)).astype(np.int64)] = True
    return Index(pieces, keys, np.append(first, len(every)), place[order], seen, min((p[4] for p in pieces), default=1), max((len(p[2]) + p[3] for p in pieces), default=1))


def align(piece: str, region: str, budget: int) -> tuple[int, int, int] | None:
    """Fewest edits (at most ``budget``) that turn some part of ``region`` into ``piece``: (edits, start, end).

    The region is so cut that the part starts within its first ``2 * budget + 1`` characters, so only that
    band of the alignment matrix is filled. Ties go to the first end.
    """
    band = 2 * budget + 1
    width = band + 2 * budget
    far = budget + 1
    # cell d of a row is column (row + d - budget); a part may start free of charge at columns 0 to 2 * budget
    cost = [0 if 0 <= d - budget <= 2 * budget else far for d in range(width + 1)]
    start = [max(0, d - budget) for d in range(width + 1)]
    n = len(region)
    for i, c in enumerate(piece, 1):
        new_cost, new_start = [far] * (width + 1), [0] * (width + 1)
        low = far
        for d in range(width + 1):
            j = i + d - budget
            if j < 0 or j > n:
                continue
            best, at = (cost[d] + (region[j - 1] != c), start[d]) if j >= 1 else (far, 0)
            if d < width and cost[d + 1] + 1 < best:
                best, at = cost[d + 1] + 1, start[d + 1]
            if d > 0 and new_cost[d - 1] + 1 < best:
                best, at = new_cost[d - 1] + 1, new_start[d - 1]
            new_cost[d], new_start[d] = best, at
            low = min(low, best)
        if low >= far:
            return None
        cost, start = new_cost, new_start
    m = len(piece)
    found = [(cost[d], start[d], m + d - budget) for d in range(width + 1) if cost[d] <= budget and 0 <= m + d - budget <= n]
    return min(found, key=lambda f: (f[0], f[2])) if found else None


def bands(place: np.ndarray, start: np.ndarray, index: Index) -> list[tuple[int, int]]:
    """(piece, lowest diagonal) of the bands, ``budget`` + 1 overlapping diagonals wide, whose hits reach the piece's bound.

    ``place`` holds piece * SPAN + position of each hit, ``start`` its position in the text.
    """
    piece, diagonal = place // SPAN, start - place % SPAN
    width = np.array([p[3] for p in index.pieces], dtype=np.int64)[piece] + 1
    bound = np.array([p[4] for p in index.pieces], dtype=np.int64)
    out = []
    for half in (0, 1):  # bands of twice that width, the second lot moved by half: any width + 1 diagonals lie in one of them
        at = (diagonal + half * width) // (2 * width)
        key = np.stack([piece, at])
        order = np.lexsort(key[::-1])
        key, own = key[:, order], diagonal[order]
        cuts = np.flatnonzero(np.any(key[:, 1:] != key[:, :-1], axis=0)) + 1
        edges = np.concatenate([[0], cuts, [key.shape[1]]])
        enough = np.flatnonzero(np.diff(edges) >= bound[key[0][edges[:-1]]])
        for e in enough:
            out.append((int(key[0][edges[e]]), int(own[edges[e] : edges[e + 1]].min())))
    return out


def regions(text: str, x: np.ndarray, h: np.ndarray, index: Index) -> list[tuple[int, int, int, int]]:
    """(item, start, end, edits) of the leaking regions of one normal text; of overlapping ones of an item, their hull and fewest edits."""
    hit = index.seen[(h >> np.uint64(64 - BITS)).astype(np.int64)]
    if int(hit.sum()) < index.least:
        return []
    at = np.flatnonzero(hit)
    k = np.searchsorted(index.keys, h[at])
    k[k == len(index.keys)] = 0
    real = index.keys[k] == h[at]
    at, k = at[real], k[real]
    if len(at) < index.least:
        return []
    near = np.searchsorted(at, at + index.widest, side="left") - np.arange(len(at))  # hits in the window that a hit opens
    opens = at[near >= index.least]
    if not len(opens):
        return []
    last = np.searchsorted(opens, at, side="right") - 1
    inside = (last >= 0) & (at - opens[np.maximum(last, 0)] < index.widest)
    at, k = at[inside], k[inside]
    counts = index.first[k + 1] - index.first[k]
    begin = np.repeat(index.first[k], counts)
    offset = np.arange(len(begin)) - np.repeat(np.cumsum(counts) - counts, counts)
    place, start = index.where[begin + offset], np.repeat(at, counts)
    found: dict[int, list[tuple[int, int, int]]] = {}
    for piece, diagonal in bands(place, start, index):
        item, _, own, budget, _ = index.pieces[piece]
        # three cuts: the band of the alignment is narrower than two bands of diagonals
        for low in range(max(0, diagonal - budget), max(0, diagonal - budget) + 4 * budget + 3, 2 * budget + 1):
            if (got := align(own, text[low : low + len(own) + 3 * budget + 1], budget)) is not None:
                found.setdefault(item, []).append((low + got[1], low + got[2], got[0]))
                break
    out = []
    for item, spans in found.items():
        spans.sort()
        start, end, edits = spans[0]
        for a, b, e in spans[1:]:
            if a <= end:
                end, edits = max(end, b), min(edits, e)
            else:
                out.append((item, start, end, edits))
                start, end, edits = a, b, e
        out.append((item, start, end, edits))
    return sorted(out)


def groups(benchmark: DataFrame, s: Settings) -> Iterator[list[tuple[int, str]]]:
    """Items with their normal texts, one group whose index is small enough to broadcast at a time. Null and short items are left out."""
    rows = benchmark.select("item_id", "text").where(F.length("text") >= s.shortest).distinct()
    own: list[tuple[int, str]] = []
    size = 0
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        if own and size + len(r["text"]) > s.broadcast_chars:
            yield own
            own, size = [], 0
        own.append((r["item_id"], normal(r["text"])))
        size += len(r["text"])
    if own:
        yield own


def looked_for(text: str | None, index: Index, q: int) -> list[tuple[int, int, int, int]]:
    """The leaking regions of a whole text as it stands."""
    if not text or not index.pieces or len(text := normal(text)) < q:
        return []
    x = points(text)
    return regions(text, x, grams(x, q), index)


FOUND = "doc_id long, item_id long, start long, end long, edits int"


def find(docs: DataFrame, benchmark: DataFrame, s: Settings | None = None) -> DataFrame:
    """One row for each leaking region: doc_id, item_id, start, end (in the normal text), edits.

    Null and empty texts leak nothing, an empty benchmark finds nothing, repeated rows give repeated rows.
    Only the id and text columns are read.
    """
    s = s or Settings()
    spark = docs.sparkSession
    found = spark.createDataFrame([], FOUND)
    for k, items in enumerate(groups(benchmark, s)):
        shared = spark.sparkContext.broadcast(build(items, s))

        def make(shared=shared):
            def batch(keys, texts):
                out = [(key, *r) for key, text in zip(keys, texts, strict=True) for r in looked_for(text, shared.value, s.q)]
                return [list(c) for c in zip(*out, strict=True)] if out else [[]] * 5

            return batch

        part = map_rows(docs, ["doc_id", "text"], FOUND, make)
        found = found.unionByName(part) if k else part
    return found


def clean(docs: DataFrame, benchmark: DataFrame, s: Settings | None = None) -> DataFrame:
    """The rows whose own text has no leaking region, with all their columns, in the same pass that looks for it: nothing is shuffled.

    Null and empty texts are kept, with an empty benchmark all are; of rows that repeat a doc_id each is judged by its text.
    """
    s = s or Settings()
    names, at = docs.columns, docs.columns.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    for items in groups(benchmark, s):
        shared = docs.sparkSession.sparkContext.broadcast(build(items, s))

        def make(shared=shared):
            def batch(*columns):
                kept = [not looked_for(text, shared.value, s.q) for text in columns[at]]
                return [[v for v, k in zip(c, kept, strict=True) if k] for c in columns]

            return batch

        docs = map_rows(docs, names, schema, make)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
