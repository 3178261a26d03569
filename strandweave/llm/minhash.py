"""MinHash near-duplicates with tensored banding.

Instead of L tables of independent band keys, ``m`` small collections of ``rows`` minhashes each are
made, and every pair of collections forms one table key: m * (m - 1) / 2 tables out of m * rows
minhashes (m grows as the square root of the number of tables). A pair of documents is a
candidate once two collections agree. Candidates are verified on full shingle sets.

Steps, none of which emits all pairs of a group or gathers one in a task:

1. signatures: one pass over the texts (numpy in Arrow batches); documents with equal shingle
   sets become one class, named by a hash of its set; classes that share a doc_id are linked.
2. per table key the member with the smallest hashed id is the centre; every other member makes
   one candidate pair with it (pre-aggregated minimum, then a join that adaptive execution splits
   when a key is hot). Verified pairs are links; components follow.
3. centres whose members still lie in different components: the members of one centre (every pair that
   shares a table key has a centre in common) are compared in blocks, each pair of blocks a group of
   rows in a partition. Only links between components leave a task, so a large group costs work, which is spread,
   but no rows. A block is bounded in members and in shingles, and a task holds numbers of shingles, not texts.

After 3, every two documents that share a table key are compared or already in one component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runs import block_pairs, grouped
from ._shared import partitions, stage, text_key
from ._words import Words, mix, passes, rolling
from .components import components

ROWS = 3
#: Members of a block, and shingles of them all: fewer members where texts are long.
BLOCK = 512
BLOCK_SHINGLES = 1 << 22
#: Bytes of texts in an Arrow batch: its shingles' hashes take about as much again, and are sorted.
BATCH_BYTES = 4 << 20
#: The chance to miss a pair just at the threshold that ``collections`` allows.
MISS = 3e-4


def collections(similarity: float, rows: int = ROWS, miss: float = MISS) -> int:
    """The least number m of collections for which two agree but with probability ``miss``."""
    p = similarity**rows
    m = 2
    while (1 - p) ** m + m * p * (1 - p) ** (m - 1) > miss:
        m += 1
    return m


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Per text its sorted distinct shingle hashes; the whole sequence if it has under k words."""
    h, ends = words.shingles(k)
    out, a, w = [], 0, 0
    for b, e in zip(ends.tolist(), words.ends.tolist(), strict=True):
        if b > a:
            out.append(np.unique(h[a:b]))
        elif e > w:
            out.append(rolling(words.hash[w:e], np.array([e - w]), e - w)[0])
        else:
            out.append(h[:0])
        a, w = b, e
    return out


def _signatures(k: int, m: int, rows: int):
    rng = np.random.default_rng(77)
    mult = rng.integers(0, 1 << 63, m * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    flip = rng.integers(0, 1 << 63, m * rows, dtype=np.uint64)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        n, key1, key2, halves = [], [], [], []
        for _, _, data, offsets in passes(b.column("text")):
            sets = shingle_sets(Words(data, offsets), k)
            sizes = np.array([len(s) for s in sets])
            n.append(sizes)
            full = np.flatnonzero(sizes)
            at = np.append(0, np.cumsum(sizes[full])[:-1])
            u = np.concatenate(sets) if len(full) else np.zeros(0, np.uint64)
            k1, k2, half = (np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64), np.zeros((len(sets), m), np.uint64))
            if len(full):
                k1[full] = np.add.reduceat(mix(u), at)
                k2[full] = np.bitwise_xor.reduceat(u * np.uint64(0xD6E8FEB86659FD93), at)
                for i in range(m):
                    x = np.full(len(full), np.uint64(i + 1))
                    for j in range(i * rows, (i + 1) * rows):
                        x = mix(x ^ np.minimum.reduceat((u ^ flip[j]) * mult[j], at))
                    half[full, i] = x
            key1.append(k1)
            key2.append(k2)
            halves.append(half)
        cat = lambda x: np.concatenate(x).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("text_key"), pa.array(np.concatenate(n).astype(np.int64)), pa.array(cat(key1)), pa.array(cat(key2)), pa.FixedSizeListArray.from_arrays(pa.array(cat(halves).reshape(-1)), m).cast(pa.list_(pa.int64()))],
            ["doc_id", "text_key", "n", "set1", "set2", "halves"],
        )

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield batch(b)

    return run


def _verify(k: int, percent: int):
    """Exact test of candidate pairs (a, b, text_a, text_b): the Jaccard similarity of full sets."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sets = []
            for c in ("text_a", "text_b"):
                sets.append([s for _, _, data, offsets in passes(b.column(c)) for s in shingle_sets(Words(data, offsets), k)])
            both = np.array([common(x, y) for x, y in zip(*sets, strict=True)], np.int64)
            union = np.array([len(x) + len(y) for x, y in zip(*sets, strict=True)], np.int64) - both
            n = pa.array([len(x) for x in sets[0]], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), n, pa.array(both / np.maximum(union, 1)), pa.array(100 * both >= percent * union)], ["a", "b", "n", "similarity", "linked"])

    return run


def common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int(np.count_nonzero(y[at] == x))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, rows: int = ROWS) -> DataFrame:
    """``classified`` without the internal text_key."""
    return classified(docs, k, percent, rows).drop("text_key")


def classified(docs: DataFrame, k: int = 5, percent: int = 80, rows: int = ROWS) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, kept): one row per row of ``docs`` (doc_id long, text).

    Two documents are linked when 100 * |intersection| >= percent * |union| of their sets of
    distinct ``k``-word shingles (words: ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased). With under k words
    the whole sequence is the one shingle; null, empty or blank texts have none and link with
    nothing. component_id: the smallest doc_id reachable; kept: doc_id = component_id. Rows that
    share a doc_id count as one document for links. A null doc_id links with nothing: its
    component_id is null, kept true. Other columns are ignored. No rows in: no rows out.
    """
    m = collections(percent / 100, rows)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key("text").alias("text_key"))
    schema = "doc_id long, text_key long, n long, set1 long, set2 long, halves array<long>"
    signed = stage(docs.mapInArrow(_signatures(k, m, rows), schema), "signatures", BATCH_BYTES)
    signed = signed.withColumn("v", F.xxhash64("set1", "set2"))
    real = signed.where("n > 0 and doc_id is not null")
    classes = real.groupBy("set1", "set2").agg(F.min("doc_id").alias("rep"))
    reps = real.join(classes, ["set1", "set2"]).where("doc_id = rep").dropDuplicates(["rep", "set1", "set2"])
    reps = stage(reps.select("rep", "text_key", "n", "halves", "v"), "classes")

    # classes that share a doc_id are linked by it
    several = real.groupBy("doc_id").agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a < b").select("doc_id", "a")
    shared = real.join(several, "doc_id").where("v != a").select("a", F.col("v").alias("b")).distinct()
    links = _links(docs, reps, k, percent, m).unionByName(shared)
    label = reps.select("rep", "v").join(components(links), "v", "left").withColumn("c", F.coalesce("component", "v"))
    named = label.groupBy("c").agg(F.min("rep").alias("component_id"))
    label = label.select("v", "c").join(named, "c").select("v", "component_id")
    of = signed.join(label, "v", "left")
    component = F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id"))
    return of.select("doc_id", "text_key", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _links(docs: DataFrame, reps: DataFrame, k: int, percent: int, m: int) -> DataFrame:
    """Verified links (a, b) between classes, enough of them to span every component."""
    tables = [F.xxhash64(F.lit(i * m + j), F.col("halves")[i], F.col("halves")[j]) for i in range(m) for j in range(i + 1, m)]
    # a class makes as many rows as there are tables: deal the classes out first, so that no task aggregates many
    keys = reps.repartition(partitions(reps), "v").select("v", "n", F.explode(F.array(*tables)).alias("key"))
    centre = keys.groupBy("key").agg(F.count("*").alias("members"), F.min("v").alias("centre")).where("members > 1")
    member = stage(keys.join(centre.select("key", "centre"), "key").where("v != centre"), "members")
    first = stage(_compare(docs, reps, member.select(F.col("v").alias("a"), F.col("centre").alias("b")).distinct(), k, percent), "compared", BATCH_BYTES)
    links = first.where("linked").select("a", "b")

    of = components(links)
    own = first.select(F.col("a").alias("v"), F.col("b").alias("centre"), "n").join(of, "v", "left").withColumn("c", F.coalesce("component", "v"))
    sizes = own.groupBy("centre").agg(F.count("*").alias("count"), F.sum("n").alias("shingles"), F.min("c").alias("low"), F.max("c").alias("high")).where("low < high")
    # long texts count for several members, but no group has more blocks than members
    weight = F.least(F.col("count") * BLOCK, F.greatest(F.col("count"), F.ceil(F.col("shingles") / BLOCK_SHINGLES) * BLOCK)).alias("weight")
    mixed = stage(own.join(sizes.select("centre", weight), "centre").select("centre", "weight", "v", "c"), "mixed")
    dealt = block_pairs(mixed, F.col("weight"), "v", BLOCK)
    texts = _texts(docs, reps, mixed.select("v").distinct())
    met = grouped(dealt.join(texts, "v").select("centre", "i", "j", "side", "v", "c", "text"), ["centre", "i", "j"])
    second = stage(met.mapInArrow(_across(k, percent), "a long, b long"), "compared", BATCH_BYTES)
    return links.unionByName(second)


class _Met:
    """The members of a pair of blocks, batch by batch. Each distinct shingle gets a number, so that a member
    keeps 4 bytes a shingle and neither its text nor its hashes: near copies have nearly the same ones."""

    def __init__(self):
        self.hash, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.ids: list[tuple[np.ndarray, np.ndarray]] = []
        self.rows: list[np.ndarray] = []

    def add(self, sets: list[np.ndarray], v: np.ndarray, c: np.ndarray, side: np.ndarray) -> None:
        self.rows.append(np.stack([v, c, side, [len(s) for s in sets]]))
        u, of = np.unique(np.concatenate(sets), return_inverse=True)
        at = np.searchsorted(self.hash, u)
        new = np.append(self.hash, np.uint64(0))[at] != u
        new |= at == len(self.hash)
        number = np.empty(len(u), np.int32)
        number[~new] = self.number[at[~new]]
        number[new] = np.arange(len(self.hash), len(self.hash) + np.count_nonzero(new), dtype=np.int32)
        self.hash, self.number = np.insert(self.hash, at[new], u[new]), np.insert(self.number, at[new], number[new])
        self.ids.append((number[of], np.append(0, np.cumsum(self.rows[-1][3])[:-1])))

    def links(self, percent: int):
        """Links (a, b) between components, enough to join them."""
        v, c, side, size = np.concatenate(self.rows, axis=1)
        own = [(part, x, y) for part, begin in self.ids for x, y in zip(begin.tolist(), [*begin[1:].tolist(), len(part)], strict=True)]
        mark = np.zeros(len(self.hash), np.int8)
        two = bool(side.any())
        which, n = np.unique(c, return_counts=True)
        largest = which[np.argmax(n)]
        # the largest component's members are met by all others
        for x in np.flatnonzero(c != largest).tolist():
            other = np.flatnonzero((c != c[x]) & ((side != side[x]) | (not two)) & (100 * np.minimum(size, size[x]) >= percent * np.maximum(size, size[x])))
            if not len(other):
                continue
            part, i, j = own[x]
            mark[part[i:j]] = 1
            both = np.concatenate([np.add.reduceat(mark[ids], begin, dtype=np.int64) for ids, begin in self.ids])[other]
            mark[part[i:j]] = 0
            for y in other[100 * both >= percent * (size[x] + size[other] - both)].tolist():
                if c[y] != c[x]:
                    yield int(v[x]), int(v[y])
                    c[c == c[y]] = c[x]


def _across(k: int, percent: int):
    """Links (a, b) between components, enough to join them, in each pair of blocks. Rows of one (centre, i, j) follow each other;
    a pair of blocks may take many batches, of which only shingle numbers are held."""

    def run(batches):
        key, met, found = None, _Met(), []
        for b in batches:
            if not b.num_rows:
                continue
            of = np.stack([b.column(n).to_numpy() for n in ("centre", "i", "j")], axis=1)
            v, c, side = (b.column(n).to_numpy() for n in ("v", "c", "side"))
            sets = [s for _, _, data, offsets in passes(b.column("text")) for s in shingle_sets(Words(data, offsets), k)]
            starts = np.append(0, np.flatnonzero((of[1:] != of[:-1]).any(1)) + 1).tolist()
            for x, y in zip(starts, [*starts[1:], len(of)], strict=True):
                if (own := tuple(of[x].tolist())) != key:
                    found += met.links(percent) if met.rows else ()
                    key, met = own, _Met()
                # a group that ends with this batch's rows and is one component has nothing to find
                if met.rows or y == len(of) or (c[x:y] != c[x]).any():
                    met.add(sets[x:y], v[x:y], c[x:y], side[x:y])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in found], pa.int64()) for n in (0, 1)], ["a", "b"])
                found = []
        found += met.links(percent) if met.rows else ()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in found], pa.int64()) for n in (0, 1)], ["a", "b"])

    return run


def _compare(docs: DataFrame, reps: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Bring both whole texts to each pair and test it."""
    pairs = stage(pairs, "pairs")
    used = pairs.select(F.col("a").alias("v")).union(pairs.select(F.col("b").alias("v"))).distinct()
    texts = stage(_texts(docs, reps, used), "texts")
    full = pairs.join(texts.select(F.col("v").alias("a"), F.col("text").alias("text_a")), "a")
    full = full.join(texts.select(F.col("v").alias("b"), F.col("text").alias("text_b")), "b")
    return full.mapInArrow(_verify(k, percent), "a long, b long, n long, similarity double, linked boolean")


def _texts(docs: DataFrame, reps: DataFrame, used: DataFrame) -> DataFrame:
    """(v, text) of the classes in ``used``."""
    need = reps.join(used, "v").select("v", "rep", "text_key")
    return docs.join(need, (docs.doc_id == need.rep) & (docs.text_key == need.text_key)).select("v", "text").dropDuplicates(["v"])
