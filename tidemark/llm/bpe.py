"""Byte-level BPE by corpus-level merge replay.

Texts are split by the tokenizer's pattern, and the *distinct* words are merged together: an inverted index from
token pair to word positions is consulted in rank order, and a merge touches only the two neighbours of each
position. Pairs that make the same token have the same rank and share an entry, since ties between them go from
left to right.

The corpus's words are counted first, whole and in parallel. Those that are frequent, ``HEAD_WORDS`` at most, are
dealt to tasks, merged once for the whole corpus, and broadcast with their ids; the rest, most of which stand in
few documents, are merged where they are met, once a block. What is broadcast only saves work: ids don't depend on it.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_schema, map_rows, runs, table

#: Words kept between the batches of a worker. Only memory depends on it: what is forgotten is merged anew.
CACHE_WORDS = 1_000_000
#: Words merged together, and a number above every token id.
RUN_WORDS, SPAN = 10_000, 1 << 24
#: Characters whose words are held at a time (a longer text goes alone), and pairs whose ranks are remembered.
RUN_CHARS, CACHE_PAIRS = 1_000_000, 400_000
#: Words that are merged once for the whole corpus at most, the bytes of the longest, and how many a task counts before it passes them on.
HEAD_WORDS, HEAD_BYTES, COUNTED_WORDS = 100_000, 64, 200_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class MergeReplay:
    """Merges many byte strings at once, by the ranks of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.joined: dict[int, int] = {}  # left id * SPAN + right id -> id of their concatenation, -1: none

    def _join(self, key: int) -> int:
        left, right = divmod(key, SPAN)
        rank = self.joined[key] = self.ranks.get(self.tokens[left] + self.tokens[right], -1)
        return rank

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word; empty words have none. Words are taken in runs that stay in the processor's cache."""
        out: list[list[int]] = []
        if len(self.joined) > CACHE_PAIRS:
            self.joined.clear()
        collects = gc.isenabled()
        gc.disable()  # nothing here is cyclic; the collector would walk the index over and over
        try:
            for k in range(0, len(words), RUN_WORDS):
                out += self._encode(words[k : k + RUN_WORDS])
        finally:
            if collects:
                gc.enable()
        return out

    def _encode(self, words: list[bytes]) -> list[list[int]]:
        """All words lie in one array, parted by slots (-1) that never merge; used up slots hold -2.

        Positions of a rank are taken from left to right; when a merge makes a pair of lower rank, the
        rest of the list waits, so every word sees its merges in the order it would see them alone.
        """
        ids: list[int] = [-1]
        starts = []
        for word in words:
            starts.append(len(ids))
            ids.extend(map(self.single.__getitem__, word))
            ids.append(-1)
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        index: dict[int, list[int]] = defaultdict(list)
        known, join = self.joined.get, self._join
        for i, (left, right) in enumerate(zip(ids, ids[1:], strict=False)):
            if left >= 0 and right >= 0:
                if (rank := known(key := left * SPAN + right)) is None:
                    rank = join(key)
                if rank >= 0:
                    index[rank].append(i)
        heap = list(index)
        heapq.heapify(heap)
        push, pop = heapq.heappush, heapq.heappop
        while heap:
            rank = pop(heap)
            places = index.pop(rank, None)
            if not places:
                continue
            places.sort()
            for at, i in enumerate(places):
                left = ids[i]
                if left < 0:
                    continue
                j = after[i]
                right = ids[j]
                if right < 0 or known(left * SPAN + right) != rank:
                    continue
                k = after[j]
                ids[i], ids[j] = rank, -2
                after[i] = k
                before[k] = i
                lower = False
                h = before[i]
                if (left := ids[h]) >= 0:
                    if (new := known(key := left * SPAN + rank)) is None:
                        new = join(key)
                    if new >= 0:
                        if new not in index:
                            push(heap, new)
                        index[new].append(h)
                        lower = new < rank
                if (right := ids[k]) >= 0:
                    if (new := known(key := rank * SPAN + right)) is None:
                        new = join(key)
                    if new >= 0:
                        if new not in index:
                            push(heap, new)
                        index[new].append(i)
                        lower = lower or new < rank
                if lower and at + 1 < len(places):
                    if rank not in index:
                        push(heap, rank)
                    index[rank].extend(places[at + 1 :])
                    break
        return [[x for x in ids[i : i + len(word)] if x >= 0] for word, i in zip(words, starts, strict=True)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class BlockCodec:
    """Encodes batches of texts; remembers the words it has merged."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.replay, self.split = MergeReplay(ranks), regex.compile(pattern).findall
        self.known: dict = {}
        self.head: dict = {}

    def share(self, head: dict[str, tuple[int, ...]]) -> BlockCodec:
        """Start from words that the corpus has merged already."""
        if head is not self.head:
            self.head = head
            self.known = {w: self.of(ids) for w, ids in head.items()}
        return self

    def coded(self, texts: list[str | None]) -> Iterator[list]:
        """What ``of`` makes of each word of each text, text by text; what is held at a time has a bound."""
        run, size = [], 0
        for text in texts:
            run.append(text or "")
            size += len(run[-1])
            if size >= RUN_CHARS:
                yield from self._coded(run)
                run, size = [], 0
        yield from self._coded(run)

    def _coded(self, texts: list[str]) -> Iterator[list]:
        found = [self.split(t) for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known = {w: self.of(ids) for w, ids in self.head.items()}
        get = self.known.__getitem__
        new = list({w for words in found for w in words if w not in self.known})
        merged = self.replay.encode([w.encode() for w in new])
        self.known.update((w, self.of(ids)) for w, ids in zip(new, merged, strict=True))
        for words in found:
            yield list(map(get, words))

    @staticmethod
    def of(ids: list[int]) -> tuple:
        return tuple(ids)


class DigestCodec(BlockCodec):
    """Keeps the ids of each word as text: less to hold than numbers, and a document's text of ids is one join."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__(ranks, pattern)
        self.names = {rank: str(rank) for rank in ranks.values()}
        self.bytes = {str(rank): token for token, rank in ranks.items()}

    def of(self, ids: list[int]) -> str:
        return ",".join(map(self.names.__getitem__, ids))

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.split(","))) if ids else b""


@lru_cache(maxsize=2)
def _codec(kind: type, path: str, pattern: str) -> BlockCodec:
    return kind(load_ranks(path), pattern)


def counted(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """word, n: how often each distinct word stands in all texts; summed in tasks before it is shuffled."""

    def run(batches):
        split, sums = regex.compile(pattern).findall, Counter()

        def told():
            kept = {w: n for w, n in sums.items() if len(w) <= HEAD_BYTES}
            out = pa.RecordBatch.from_pydict({"word": list(kept), "n": list(kept.values())}, schema=schema)
            sums.clear()
            return out

        for batch in (run for whole in batches for run in runs(whole)):
            for own in batch.column(0).to_pylist():
                if own:
                    sums.update(split(own))
                if len(sums) > COUNTED_WORDS:
                    yield told()
        yield told()

    schema = arrow_schema("word string, n long")
    return df.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head(df: DataFrame, path: str, pattern: str, text: str = "text") -> dict[str, tuple[int, ...]]:
    """The frequent words with their ids: all that stand at least so often that there are no more than ``HEAD_WORDS`` of them.

    How often that is comes from a histogram of the counts by their logarithm, a few hundred rows, so the bound holds
    whatever the corpus. Words longer than ``HEAD_BYTES`` are left to the tasks that meet them.
    """
    words = counted(df, path, pattern, text).where("n > 1").withColumn("step", F.floor(F.log2("n") * 8).cast("int")).persist()
    least, many = None, 0
    for r in words.groupBy("step").count().orderBy(F.desc("step")).collect():  # a row for each step
        if many + r["count"] > HEAD_WORDS:
            break
        least, many = r["step"], many + r["count"]
    found: dict[str, tuple[int, ...]] = {}
    if least is not None:

        def make():
            replay = _codec(BlockCodec, path, pattern).replay
            return lambda own: (own, replay.encode([w.encode() for w in own]))

        merged = map_rows(words.where(F.col("step") >= least), ["word"], "word string, ids array<int>", make)
        found = {r["word"]: tuple(r["ids"]) for r in merged.toLocalIterator()}  # HEAD_WORDS rows at most
    words.unpersist()
    return found


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """``id_column``, ``ids`` array<int>, ``n_tokens`` long of each whole text.

    Null texts count as empty (no ids). Other columns are not read, so their names can't clash.
    Repeated rows are encoded again; a table without rows gives none. ``path`` must exist on the executors.
    """
    shared = df.sparkSession.sparkContext.broadcast(head(df, path, pattern, text))

    def make():
        codec = _codec(BlockCodec, path, pattern).share(shared.value)

        def batch(keys, texts):
            ids = [np.fromiter(chain.from_iterable(words), dtype=np.int32) for words in codec.coded(texts)]
            return keys, ids, [len(x) for x in ids]

        return batch

    return map_rows(df.select(F.col(id_column), F.col(text)), [id_column, text], f"{id_column} {df.schema[id_column].dataType.simpleString()}, ids array<int>, n_tokens long", make)


def decode(df: DataFrame, path: str, ids: str = "ids", id_column: str = "doc_id") -> DataFrame:
    """``id_column``, ``text``: the texts that the ids stand for (bytes that aren't UTF-8 become U+FFFD)."""

    def make():
        replay = _codec(BlockCodec, path, r"\S").replay
        return lambda keys, rows: (keys, [replay.decode(x or []).decode(errors="replace") for x in rows])

    return map_rows(df, [id_column, ids], f"{id_column} {df.schema[id_column].dataType.simpleString()}, text string", make)


def round_trip(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids, n_tokens, and text: what the ids decode to, which is the text that came in (null: empty); a row for each row, none for none."""

    def make():
        codec = BlockCodec(load_ranks(path), pattern)  # its words go with the task: other stages use the same workers

        def batch(keys, texts):
            ids = [np.fromiter(chain.from_iterable(words), dtype=np.int32) for words in codec.coded(texts)]
            return keys, ids, [len(x) for x in ids], [codec.replay.decode(x.tolist()).decode("utf-8", "replace") for x in ids]

        return batch

    return map_rows(df, ["doc_id", "text"], "doc_id long, ids array<int>, n_tokens long, text string", make)


def digests(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole text (null: empty); a row for each row, none for none."""
    shared = df.sparkSession.sparkContext.broadcast(head(df, path, pattern))

    def make():
        codec = _codec(DigestCodec, path, pattern).share(shared.value)

        def batch(keys, texts):
            counts, coded, decoded = [], [], []
            for words in codec.coded(texts):
                ids = ",".join(words)
                counts.append(ids.count(",") + 1 if ids else 0)
                coded.append(hashlib.sha256(ids.encode()).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            return keys, counts, coded, decoded

        return batch

    return map_rows(df, ["doc_id", "text"], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def vocabulary() -> tuple[str, str]:
    """Path of the rank file and the splitting pattern of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), *vocabulary())
