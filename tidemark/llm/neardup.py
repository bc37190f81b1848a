"""MinHash-style near duplicates with SetSketch registers.

1. One pass over the texts gives each document its shingle-set size, a digest of the set and a SetSketch:
   registers hold floor(1 - log_b(min of exponentials)), so two sketches merge by maximum, and equal
   registers get likelier with similarity. No text leaves its task.
2. Documents with equal sets form classes; from here on a class is one row, however many copies it has.
3. Bands of register values make buckets. In a bucket, classes are compared with its most central member (a
   star): the one whose buckets hold most members. Each class takes the centre with which it shares most buckets, and the joint likelihood of their registers
   estimates the similarity.
4. Partners are confirmed on full sets, and linked classes get a common label. Buckets whose members share
   a label are done; after a few stars the members of the buckets left are paired across labels by an exact
   prefix filter, estimated and confirmed, so no pair that shares a bucket is lost.

Rows of a bucket or shingle meet what is known of it in a join by that key. A key with more than a 1024th of
all rows, of which there are at most 1024, has its facts broadcast instead, so a third of all rows in one
bucket still stays where it is, dealt over all tasks. Intermediate tables are deleted at the end.

At a similarity of 0.8, 48 bands of 6 registers miss a pair with probability 5e-7.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, map_rows, table


@dataclass(frozen=True)
class Settings:
    """Links need 100 * intersection >= ``percent`` * union. ``judged`` registers estimate; pairs below ``floor`` (four standard errors under the threshold) aren't confirmed."""

    words: int = 2
    percent: int = 80
    bands: int = 48
    rows: int = 6
    base: float = 1.001
    judged: int = 288
    floor: float = 0.7
    stars: int = 3
    share: int = 512


def shingles(text: str | None, words: int, memo: dict[bytes, int]) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles. A-Z are lowered; words end at ASCII blanks; fewer words than ``words`` make one shingle."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    if len(tokens) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(tokens), len(tokens))], dtype=np.uint64)
    for w in tokens:
        if w not in memo:
            memo[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(memo.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    n = len(h) - words + 1
    out = np.zeros(n, dtype=np.uint64)
    for k in range(words):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(out ^ (out >> np.uint64(32)))


def registers(keys: np.ndarray, count: int, base: float) -> np.ndarray:
    """SetSketch of a non-empty set: 16-bit registers."""
    rng = np.random.default_rng(20210101)
    a = (rng.integers(0, 1 << 32, count, dtype=np.uint32) | np.uint32(1))[:, None]
    b = rng.integers(0, 1 << 32, count, dtype=np.uint32)[:, None]
    x = (keys >> np.uint64(32)).astype(np.uint32) ^ keys.astype(np.uint32)
    least = np.full(count, np.iinfo(np.uint32).max, dtype=np.uint32)
    for k in range(0, len(x), 512):
        y = x[k : k + 512] * a
        y += b
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        np.minimum(least, y.min(axis=1), out=least)
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32)
    return np.clip(np.floor(1.0 - np.log(exponential) / np.log(base)), 0, 65535).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


GRID = np.linspace(0.0, 1.0, 101)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, base: float) -> np.ndarray:
    """Similarity of the pairs of rows by maximum likelihood over a grid, given set sizes.

    With u and v the sets' shares of the sum of sizes, a register of the first is larger with
    probability p(u - vJ), smaller with p(v - uJ), p(x) = -log_b(1 - x (b - 1) / b).
    """
    more, less = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    same = a.shape[1] - more - less
    u = (na / (na + nb))[:, None]
    v = 1.0 - u
    most = np.minimum(u / v, v / u)
    j = np.minimum(GRID[None, :], most)

    def p(x):
        return -np.log1p(-np.clip(x, 0.0, 1.0) * (base - 1.0) / base) / np.log(base)

    up, down = p(u - v * j), p(v - u * j)
    with np.errstate(divide="ignore", invalid="ignore"):
        tiny = 1e-12
        like = more * np.log(up + tiny) + less * np.log(down + tiny) + same * np.log(np.maximum(1.0 - up - down, tiny))
    return np.take_along_axis(j, like.argmax(axis=1)[:, None], axis=1)[:, 0]


def by_key(rows: DataFrame, facts: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """Rows joined with the one row of ``facts`` of their key, of whose rows ``size`` counts those of the key.

    Keys with more than a 1024th of the ``total`` rows, at most 1024 by their sum, are joined by broadcast.
    """
    hot = facts.where(F.col(size) > total / HOT)
    if hot.isEmpty():
        return rows.join(facts, key, how)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(facts.where(F.col(size) <= total / HOT), key, how)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


HOT = 1024


def sketches(docs: DataFrame, s: Settings) -> DataFrame:
    """id, n_shingles, digest of the set (null if empty), and the registers as bytes (null if empty) of documents (id, text)."""

    def make():
        memo: dict[bytes, int] = {}

        def batch(keys, texts):
            if len(memo) > 1_000_000:
                memo.clear()
            sets = [shingles(t, s.words, memo) for t in texts]
            return (
                keys, [len(x) for x in sets],
                [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets],
                [registers(x, s.bands * s.rows, s.base).tobytes() if len(x) else None for x in sets],
            )

        return batch

    return map_rows(docs, ["id", "text"], "id long, n_shingles long, digest binary, sketch binary", make)


def banded(classes: DataFrame, s: Settings) -> DataFrame:
    """key, id: the buckets of each class."""

    def make():
        def batch(ids, found):
            out = []
            for raw in found:
                rows = np.frombuffer(raw, dtype=np.uint16).reshape(s.bands, s.rows)
                out += [xxhash.xxh3_64_intdigest(r.tobytes(), k) - (1 << 63) for k, r in enumerate(rows)]
            return out, [i for i in ids for _ in range(s.bands)]

        return batch

    return map_rows(classes, ["id", "sketch"], "key long, id long", make)


def judged(pairs: DataFrame, classes: DataFrame, s: Settings) -> DataFrame:
    """Pairs (a, b) with their estimated similarity."""
    short = classes.select("id", F.col("n").cast("long").alias("n"), F.expr(f"substring(sketch, 1, {2 * s.judged})").alias("sketch"))
    both = pairs.join(short.toDF("b", "nb", "sb"), "b").join(short.toDF("a", "na", "sa"), "a")

    def make():
        def batch(a, b, na, nb, sa, sb):
            x, y = (np.frombuffer(b"".join(v), dtype=np.uint16).reshape(len(v), -1) for v in (sa, sb))
            return a, b, estimate(x, y, np.array(na, float), np.array(nb, float), s.base)

        return batch

    return map_rows(both, ["a", "b", "na", "nb", "sa", "sb"], "a long, b long, likeness double", make)


def confirmed(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """Pairs (a, b) with ``linked``: whether their full sets are similar enough. A first member with many partners is dealt to several tasks."""
    spread = pairs.groupBy("a").agg(F.ceil(F.count("*") / s.share).alias("parts"))
    left = pairs.join(spread, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts"))).join(texts.toDF("b", "tb"), "b")
    right = spread.join(texts.toDF("a", "ta"), "a").select("a", "ta", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))

    def make():
        memo: dict[bytes, int] = {}
        held: list = [None, None]

        def batch(a, b, ta, tb):
            if len(memo) > 500_000:
                memo.clear()
            linked = []
            for i, own, other in zip(a, ta, tb, strict=True):
                if held[0] != i:
                    held[:] = i, shingles(own, s.words, memo)
                x, y = held[1], shingles(other, s.words, memo)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * shared >= s.percent * (len(x) + len(y) - shared))
            return a, b, linked

        return batch

    return map_rows(left.join(right, ["a", "part"]), ["a", "b", "ta", "tb"], "a long, b long, linked boolean", make)


def across(classes: DataFrame, texts: DataFrame, s: Settings, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) with different labels that can be similar enough, of classes (id, label) in buckets without a common label.

    Prefix filter: with shingles from the rarest to the most frequent, similar sets share one among the first
    size - ceil(threshold * size) + 1, and what lies behind their first common one can still reach the overlap
    that their sizes ask for. Passages that many texts share lie behind what is a text's own, so texts that
    have only such a passage in common don't meet unless it is enough.
    """

    def make():
        memo: dict[bytes, int] = {}

        def batch(ids, labels, found):
            sets = [shingles(t, s.words, memo) for t in found]
            if len(memo) > 500_000:
                memo.clear()
            sizes = [len(x) for x in sets]
            every = np.concatenate(sets).astype(np.int64) if sets else np.zeros(0, np.int64)
            return np.repeat(ids, sizes), np.repeat(labels, sizes), np.repeat(sizes, sizes), every

        return batch

    rows = scratch.write(map_rows(classes.join(texts.toDF("id", "text"), "id"), ["id", "label", "text"], "id long, label long, n long, shingle long", make))
    often = scratch.write(rows.groupBy("shingle").agg(F.count("*").alias("often"), F.min("label").alias("low"), F.max("label").alias("top")).where("often > 1"))
    shared = by_key(rows, often, "shingle", "often", rows.count())
    rank = F.row_number().over(Window.partitionBy("id").orderBy("often", "shingle"))
    own = F.col("n") - F.count("*").over(Window.partitionBy("id"))  # those that no other class has come first
    reach = F.col("n") - F.ceil(F.col("n") * s.percent / 100) + 1
    heads = shared.withColumn("at", rank + own).where(F.col("at") <= reach).where("low <> top").select("shingle", "id", "label", "n", "at")
    heads = scratch.write(heads)
    x, y = heads.toDF("shingle", "a", "la", "na", "pa"), heads.toDF("shingle", "b", "lb", "nb", "pb")
    rest = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + 1
    fits = (F.col("la") < F.col("lb")) & ((100 + s.percent) * rest >= s.percent * (F.col("na") + F.col("nb")))
    return x.join(y, "shingle").where(fits).select("a", "b").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """id, label for every id in ``edges`` (a, b): the smallest id that can be reached.

    Every round hooks each id to its smallest neighbour, follows two hooks and contracts the edges, so at
    least half of the ids that can move are gone after it; each round ends at a written table.
    """
    labels, left = None, scratch.write(edges.select("a", "b").where("a <> b").distinct())
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = scratch.write(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")))
        jump = hook.toDF("to", "over")
        hook = scratch.write(hook.join(jump, "to").select(F.col("a").alias("id"), F.col("over").alias("label")))
        step = hook.toDF("old", "new")
        grown = hook if labels is None else labels.join(step, labels["label"] == step["old"], "left").select("id", F.coalesce("new", "label").alias("label"))
        labels = scratch.write(grown)
        first, second = hook.toDF("a", "x"), hook.toDF("b", "y")
        left = scratch.write(left.join(first, "a").join(second, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return edges.select(F.col("a").alias("id"), F.col("a").alias("label")).limit(0) if labels is None else labels


def near_duplicates(docs: DataFrame, s: Settings | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row.

    Null, empty and blank texts have no shingles, stay alone and are kept. Rows with equal texts are linked;
    rows that repeat a doc_id share a component, each with the links of its own text. Rows without doc_id are
    left out. No rows: none. Other columns are not read. The result is a written table in the shared folder.
    """
    s = s or Settings()
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    scratch, result = Scratch(spark), Scratch(spark)
    try:
        mark = F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark")
        split = docs.select("doc_id", mark).groupBy("doc_id").agg(F.min("mark").alias("low"), F.max("mark").alias("top")).where("low <> top")
        if split.isEmpty():
            out = result.write(_labelled(docs.toDF("id", "text"), None, s, scratch).toDF("doc_id", "n_shingles", "component_id"))
        else:  # some ids have several texts: each text gets an id of its own, and those of a doc_id are linked
            own = scratch.write(docs.select("doc_id", mark).distinct().withColumn("id", F.monotonically_increasing_id()))
            rows = scratch.write(docs.withColumn("mark", mark).join(own, ["doc_id", "mark"]).select("id", "text"))
            first = own.groupBy("doc_id").agg(F.min("id").alias("a"))
            same = scratch.write(own.join(first, "doc_id").select("a", F.col("id").alias("b")).where("a <> b"))
            found = scratch.write(_labelled(rows, same, s, scratch).toDF("id", "n_shingles", "label"))
            found = found.join(own.select("id", "doc_id"), "id")
            least = found.groupBy("label").agg(F.min("doc_id").alias("component_id"))
            out = result.write(found.join(least, "label").select("doc_id", "n_shingles", "component_id"))
    finally:
        scratch.drop()
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def _labelled(docs: DataFrame, linked: DataFrame | None, s: Settings, scratch: Scratch) -> DataFrame:
    """id, n_shingles, label of each row of documents (id, text), of which rows with equal ids have equal texts; ``linked`` pairs (a, b) of ids belong together whatever their texts."""
    spark = docs.sparkSession
    every = scratch.write(sketches(docs, s))
    sets = every.where(F.col("digest").isNotNull())
    classes = scratch.write(sets.groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("members")))
    own = classes.select("digest", "id").join(sets.select("digest", "id", F.col("n_shingles").alias("n"), "sketch"), ["digest", "id"])
    own = scratch.write(own.select("id", "n", "sketch").dropDuplicates(["id"]))
    raw = scratch.part()
    buckets = raw.write(banded(own, s))
    crowded = raw.write(buckets.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"))
    buckets = scratch.write(by_key(buckets, crowded, "key", "members", buckets.count()).select("key", "id"))
    raw.drop()
    name = f"tidemark_{uuid.uuid4().hex}"
    wanted = buckets.select("id").distinct()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chosen = docs.join(wanted, "id", "left_semi")
    chosen.repartition(parts, "id").write.bucketBy(parts, "id").saveAsTable(name)
    try:
        links = _links(buckets, own, spark.table(name).dropDuplicates(["id"]), s, scratch)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    same = by_key(sets.select("id", "digest"), classes.toDF("digest", "class", "members"), "digest", "members", every.count()).select("id", "class")
    labels = same.join(links.toDF("class", "label"), "class", "left").select("id", F.coalesce("label", "class").alias("label")).dropDuplicates(["id"])
    if linked is not None:
        held = scratch.write(labels)
        pairs = linked.join(held.toDF("a", "x"), "a", "left").join(held.toDF("b", "y"), "b", "left")
        joined = components(pairs.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")), scratch).toDF("label", "whole")
        alone = sets.select("id").unionByName(linked.select("a").toDF("id")).unionByName(linked.select("b").toDF("id")).distinct()
        every_label = alone.join(held, "id", "left").select("id", F.coalesce("label", "id").alias("label"))
        labels = every_label.join(joined, "label", "left").select("id", F.coalesce("whole", "label").alias("label"))
    return every.select("id", "n_shingles").join(labels, "id", "left").select("id", "n_shingles", F.coalesce("label", "id").alias("label"))


def _links(buckets: DataFrame, own: DataFrame, texts: DataFrame, s: Settings, scratch: Scratch) -> DataFrame:
    """id, label of all classes that are linked with another."""
    spark = buckets.sparkSession
    labels = edges = tested = used = before = None
    for turn in range(s.stars + 1):
        mine = scratch.part()
        now = buckets if labels is None else buckets.join(labels, "id", "left")
        now = mine.write(now.select("key", "id", (F.coalesce("label", "id") if labels is not None else F.col("id")).alias("label")))
        if before is not None:
            before.drop()
        before = mine
        sizes = mine.write(now.groupBy("key").agg(F.count("*").alias("members"), F.min("label").alias("low"), F.max("label").alias("top")).where("low <> top").select("key", "members"))
        now = mine.write(by_key(now, sizes, "key", "members", now.count()))
        central = now.groupBy("id").agg(F.sum("members").alias("weight"))
        if used is not None:
            central = central.join(used, "id", "left_anti")
        heads = now.join(central, "id").groupBy("key").agg(F.max(F.struct("weight", (-F.col("id")).alias("id"), "label")).alias("head"), F.first("members").alias("members"))
        heads = mine.write(heads.select("key", "members", F.struct((-F.col("head.id")).alias("id"), F.col("head.label").alias("label")).alias("head")))
        buckets = mine.write(by_key(now.drop("members"), heads, "key", "members", now.count(), "left").select("key", "id", "label", "head"))
        if buckets.isEmpty():
            break
        if turn < s.stars:
            pairs = buckets.where("label <> head.label").groupBy(F.col("head.id").alias("a"), F.col("id").alias("b")).agg(F.count("*").alias("shared"))
        else:
            pairs = across(buckets.select("id", "label").distinct(), texts, s, scratch)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti").join(tested.toDF("b", "a"), ["a", "b"], "left_anti")
        if turn < s.stars:  # the head that shares most buckets; the others' turn comes if that one isn't linked
            heads = scratch.write(buckets.where("head IS NOT NULL").select(F.col("head.id").alias("id")).distinct())
            used = heads if used is None else used.unionByName(heads)
            pairs = pairs.groupBy("b").agg(F.max(F.struct("shared", (-F.col("a")).alias("a"))).alias("best")).select((-F.col("best.a")).alias("a"), "b")
        buckets = buckets.select("key", "id")
        seen = scratch.write(judged(pairs, own, s))
        tested = seen.select("a", "b") if tested is None else tested.unionByName(seen.select("a", "b"))
        likely = seen.where(F.col("likeness") >= s.floor).select("a", "b")
        if likely.isEmpty():
            continue
        found = scratch.write(confirmed(likely, texts, s))
        new = found.where("linked").select("a", "b")
        edges = new if edges is None else edges.unionByName(new)
        labels = components(edges, scratch)
    return labels if labels is not None else spark.createDataFrame([], "id long, label long")


def distinct_documents(docs: DataFrame, s: Settings | None = None) -> DataFrame:
    """The documents of which ``near_duplicates`` keeps one a group, with all their columns; rows without doc_id stay."""
    kept = near_duplicates(docs, s).where("kept").select("doc_id").distinct()
    return docs.where(F.col("doc_id").isNull()).unionByName(docs.join(kept, "doc_id", "left_semi").select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
