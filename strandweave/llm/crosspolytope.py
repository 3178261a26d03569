"""Embedding near-duplicates by cross-polytope hashing.

A vector is rotated by three rounds of random signs and a fast Hadamard transform; its hash is the
largest coordinate and its sign (Andoni, Indyk, Laarhoven, Razenshteyn, Schmidt, 2015). A table key
is ``width`` such hashes. Multiprobe: a vector is also looked up under the keys in which one hash is replaced
by its next best vertices. Candidate pairs are verified by cosine in double precision.

Equal directions are one class with its number of members: copies aren't compared. Within a table
bucket, members are compared in blocks of ``BLOCK`` by matrix products, home members against home
members and probes, so that a large bucket becomes many block pairs over many tasks and no pair is
written out. A pair that meets in several tables counts only in the first one: each side carries its
keys of all tables, from which the task sees whether they met before. What leaves a task is, per
vector, its number of links there and one edge into the block pair's component.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runs import grouped, runs
from ._shared import stage
from .components import components
from .vectors import matrix, usable

BLOCK = 1024
#: Alternative vertices tried for each hash of a key.
PROBES = 1
#: The chance to miss a pair just at the threshold, for which ``tables`` are planned.
MISS = 1e-4
#: Expected members of a bucket by chance; from it follows the number of hashes in a key.
CHANCE = 0.25


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the Walsh-Hadamard matrix; the row length is a power of two."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), 2).reshape(len(x), n)
        h *= 2
    return x


def _signs(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).choice([-1.0, 1.0], (3, n))


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """A pseudo-random rotation of the rows, up to a common factor; x is padded to a power of two."""
    n = 1 << max(1, math.ceil(math.log2(max(x.shape[1], 2))))
    y = np.zeros((len(x), n))
    y[:, : x.shape[1]] = x
    for s in _signs(seed, n):
        y = hadamard(y * s) / math.sqrt(n)
    return y


def hashes(x: np.ndarray, seed: int, probes: int = PROBES) -> np.ndarray:
    """(rows, 1 + probes): the best vertices of the rotated cross-polytope, the best first."""
    y = rotate(x, seed)
    n = y.shape[1]
    top = np.argsort(-np.abs(y), axis=1, kind="stable")[:, : 1 + min(probes, n - 1)]
    return top + n * (np.take_along_axis(y, top, 1) < 0)


def keys(x: np.ndarray, table: int, width: int, probes: int = PROBES) -> np.ndarray:
    """(rows, 1 + width * probes): the home key, then the probed ones."""
    h = [hashes(x, 7919 * table + j, probes) for j in range(width)]
    base = 4 << math.ceil(math.log2(max(x.shape[1], 2)))
    def join(choice):
        out = np.full(len(x), table, np.int64)
        for j in range(width):
            out = out * base + h[j][:, choice[j]]
        return out

    home = [0] * width
    out = [join(home)]
    for j in range(width):
        for p in range(1, h[j].shape[1]):
            out.append(join([p if i == j else 0 for i in range(width)]))
    return np.stack(out, 1)


def plan(count: int, dim: int, cosine: float) -> tuple[int, int]:
    """(width, tables): a key has as many hashes as keep chance members of a bucket few, and there are
    as many tables as keep the chance of a miss at the threshold below MISS. The chance of a meeting is
    measured on random pairs at exactly that cosine, so that recall is the same at every size."""
    n = 1 << max(1, math.ceil(math.log2(max(dim, 2))))
    width = max(1, math.ceil(math.log(max(count / CHANCE, 2)) / math.log(2 * n)))
    rng = np.random.default_rng(11)
    a = rng.standard_normal((2000, max(dim, 2)))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal(a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
    b = cosine * a + math.sqrt(max(0.0, 1 - cosine * cosine)) * b
    ka, kb = keys(a, 0, width), keys(b, 0, width)
    meet = ((ka == kb[:, :1]).any(1) | (kb == ka[:, :1]).any(1)).mean()
    meet = min(max(meet - 0.02, 0.01), 0.999)
    return width, max(2, math.ceil(math.log(MISS) / math.log(1 - meet)))


def _met_before(home_a, all_a, home_b, all_b, table: int) -> np.ndarray:
    """Whether each a and b share an earlier table: one's home key is among the other's keys."""
    out = np.zeros((len(home_a), len(home_b)), bool)
    for t in range(table):
        for p in range(all_a.shape[2]):
            out |= all_a[:, t, p][:, None] == home_b[:, t][None]
            if p:
                out |= home_a[:, t][:, None] == all_b[:, t, p][None]
    return out


def _labels(linked: np.ndarray, v_a: np.ndarray, v_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest vertex of each one's component in a bipartite block."""
    a, b = v_a.copy(), v_b.copy()
    big = np.iinfo(np.int64).max
    while True:
        nb = np.minimum(b, np.where(linked, a[:, None], big).min(0, initial=big))
        na = np.minimum(a, np.where(linked, nb[None], big).min(1, initial=big))
        if (na == a).all() and (nb == b).all():
            return a, b
        a, b = na, nb


def near_vectors(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of ``vectors`` (vec_id long, embedding array).

    n_links: other rows linked directly, that is found with a cosine of at least ``cosine`` in double
    precision; component_id: the smallest vec_id reachable by links, itself included; kept: vec_id =
    component_id. Vectors that are null, empty or all zero, hold null or non-finite components, or have
    a null vec_id link with nothing (their component_id is their vec_id). Vectors of unequal length are compared as
    if the shorter one ended in zeros. Rows that share a vec_id are vectors of their own. Other columns are ignored.
    """
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    good = usable() & F.col("vec_id").isNotNull() & F.exists("embedding", lambda x: x != 0)
    rows = stage(own.withColumn("row", F.monotonically_increasing_id()).withColumn("good", F.coalesce(good, F.lit(False))), "vectors")
    # equal vectors, by all their bits: one class with its number of members (-0.0 is 0.0)
    text = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
    part = rows.where("good").select("row", "vec_id", "embedding", F.xxhash64(text).alias("e1"), F.xxhash64(F.lit(3), text).alias("e2"))
    classes = part.groupBy("e1", "e2").agg(F.min("row").alias("v"), F.min("vec_id").alias("least"), F.count("*").alias("members"))
    classes = stage(classes, "classes")
    reps = stage(part.select("row", "embedding").join(classes.select(F.col("v").alias("row"), "members"), "row").select(F.col("row").alias("v"), "members", "embedding"), "reps")
    count, dim = reps.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    width, tables = plan(count, dim, cosine)
    found = stage(_blocks(reps, dim, width, tables, cosine), "links")

    links = found.groupBy("v").agg(F.sum("n").alias("n"))
    component = components(found.where("v != least"), "v", "least")
    named = classes.join(component, "v", "left").withColumn("c", F.coalesce("component", "v"))
    smallest = named.groupBy("c").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "c").join(links, "v", "left").select("e1", "e2", "component_id", (F.coalesce("n", F.lit(0)) + F.col("members") - 1).alias("n_links"))
    of = rows.select("row", "vec_id").join(part.select("row", "e1", "e2"), "row", "left").join(named, ["e1", "e2"], "left")
    out = of.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _blocks(reps: DataFrame, dim: int, width: int, tables: int, cosine: float) -> DataFrame:
    """(v, n, least): links of v to members of other classes in one block pair, and an edge of its."""
    each = 1 + width * PROBES

    def sign(batches):
        for b in batches:
            x = matrix(b.column("embedding"), dim)
            if not len(x):
                continue
            k = np.concatenate([keys(x, t, width) for t in range(tables)], 1)
            k = pa.FixedSizeListArray.from_arrays(pa.array(k.reshape(-1)), tables * each).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("v", "members", "embedding")), k], ["v", "members", "embedding", "keys"])

    signed = stage(reps.mapInArrow(sign, f"v long, members long, embedding {reps.schema['embedding'].dataType.simpleString()}, keys array<long>"), "signed")
    # roles: home key (position 0 of a table's keys) or probe
    at = signed.select("v", F.posexplode("keys").alias("p", "key"))
    at = at.select("v", "key", (F.col("p") % F.lit(each) == 0).alias("home"), F.floor(F.col("p") / F.lit(each)).cast("int").alias("t"))
    sizes = at.groupBy("key").agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("probes"))
    sizes = sizes.where("homes > 1 or (homes = 1 and probes > 0)")
    chunks = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / BLOCK))
    at = at.join(sizes, "key").withColumn("hs", chunks("homes")).withColumn("ps", F.when(F.col("probes") > 0, chunks("probes")).otherwise(0))
    chunk = F.when(F.col("home"), F.pmod(F.xxhash64("v"), "hs")).otherwise(F.pmod(F.xxhash64("v"), F.greatest("ps", F.lit(1))))
    at = at.withColumn("chunk", chunk)
    # a home chunk i meets the home chunks j >= i and every probe chunk (numbered from hs)
    as_left = F.when(F.col("home"), F.sequence("chunk", F.col("hs") + F.col("ps") - 1))
    home_right = F.when(F.col("home"), F.sequence(F.lit(0).cast("long"), "chunk"))
    probe_right = F.when(~F.col("home"), F.sequence(F.lit(0).cast("long"), F.col("hs") - 1))
    left = at.where("home").select("v", "key", "t", "home", F.lit(0).alias("side"), F.col("chunk").alias("i"), F.explode(as_left).alias("j"))
    right = at.select("v", "key", "t", "home", F.lit(1).alias("side"), F.explode(F.coalesce(home_right, probe_right)).alias("i"), F.when(F.col("home"), F.col("chunk")).otherwise(F.col("hs") + F.col("chunk")).alias("j"))
    met = left.unionByName(right).join(signed, "v")

    def compare(t: pa.Table, starts: list[int]):
        """Block pairs of buckets, one after another: rows starts[n] to starts[n + 1]."""
        side, v, m = (t.column(c).to_numpy() for c in ("side", "v", "members"))
        home, table, i, j = (t.column(c).to_numpy() for c in ("home", "t", "i", "j"))
        x = matrix(t.column("embedding"), dim)
        top = np.abs(x).max(1, initial=0.0)
        x /= np.where((top > 1e100) | (top < 1e-100), top, 1.0)[:, None]
        x /= np.sqrt((x * x).sum(1))[:, None]
        k = t.column("keys").combine_chunks().flatten().to_numpy().reshape(len(v), tables, each)
        for begin, end in zip(starts[:-1], starts[1:], strict=True):
            a = begin + np.flatnonzero(side[begin:end] == 0)
            b = begin + np.flatnonzero(side[begin:end] == 1)
            near = (x[a] @ x[b].T >= cosine) & (v[a][:, None] != v[b][None])
            if not near.any():
                continue
            now = table[begin]
            near &= ~_met_before(k[a, :, 0], k[a], k[b, :, 0], k[b], now)
            # a pair can meet at home, and as home and probe in both directions: count one of these
            probe = ~home[b]
            if i[begin] == j[begin]:
                near &= probe[None] | (v[a][:, None] < v[b][None])
            if probe.any():
                same = k[a, now, 0][:, None] == k[b, now, 0][None]
                back = (k[a, now, 1:][:, None, :] == k[b, now, 0][None, :, None]).any(2) & (v[a][:, None] > v[b][None])
                near &= ~(probe[None] & (same | back))
            ra, rb = near.any(1), near.any(0)
            if ra.any():
                la, lb = _labels(near, v[a], v[b])
                yield np.append(v[a][ra], v[b][rb]), np.append((near * m[b][None]).sum(1)[ra], (near * m[a][:, None]).sum(0)[rb]), np.append(la[ra], lb[rb])

    def run(batches):
        for t, starts in runs(batches, ["key", "i", "j"]):
            found = list(compare(t, starts))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[c] for f in found]).astype(np.int64)) for c in range(3)], ["v", "n", "least"])

    return grouped(met, ["key", "i", "j"]).mapInArrow(run, "v long, n long, least long")
