"""All-pairs Jaccard of sketches and of exact key sets.

Sketches are packed into one byte array each and compared in square blocks of ids: a task gets two blocks and
gives one row per pair, numpy does the registers. The result itself has n (n - 1) / 2 rows; nothing larger is made
on the way, and no side is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sketch import DEFAULT_P, alpha

BLOCK = 64


def packed(regs: DataFrame, item: str, p: int = DEFAULT_P) -> DataFrame:
    """(item, regs BINARY) of (item, idx, rho): one byte a register, 255 at most."""
    pairs = F.collect_list(F.struct("idx", F.least("rho", F.lit(255)).alias("rho")))

    def run(batches):
        for b in batches:
            x = np.zeros((b.num_rows, 1 << p), np.uint8)
            lists = b.column("_r")
            flat = lists.flatten()
            x[np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy()), flat.field("idx").to_numpy()] = flat.field("rho").to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(item), pa.array([r.tobytes() for r in x], pa.binary())], [item, "regs"])

    return regs.groupBy(item).agg(pairs.alias("_r")).mapInArrow(run, f"`{item}` {regs.schema[item].dataType.simpleString()}, regs binary")


def classic(x: np.ndarray, p: int) -> np.ndarray:
    """The classic estimate of each row of registers."""
    m = 1 << p
    z = np.ldexp(1.0, -x.astype(np.int32)).sum(-1)
    v = (x == 0).sum(-1)
    e = alpha(m) * m * m / z
    return np.where((e <= 2.5 * m) & (v > 0), m * np.log(m / np.maximum(v, 1)), e)


def jaccard(regs: DataFrame, item: str, p: int = DEFAULT_P, threshold: float | None = None, items: DataFrame | None = None) -> DataFrame:
    """``jaccard_packed`` of (item, idx, rho). A sketch without any register has no row there: ``items`` (item), if given, names all."""
    own = packed(regs, item, p)
    if items is not None:
        own = items.select(item).distinct().join(own, item, "left").withColumn("regs", F.coalesce("regs", F.lit(bytes(1 << p))))
    return jaccard_packed(own, item, p, threshold)


def jaccard_packed(own: DataFrame, item: str, p: int = DEFAULT_P, threshold: float | None = None) -> DataFrame:
    """(i, j, jaccard) of (item, regs) for i < j in the order of ``item``: (|A| + |B| - |A or B|) / |A or B|, not clamped. An empty sketch
    has 0 with others; two empty ones have no Jaccard (NaN) and give no row under a threshold. The threshold only filters what is given."""
    kind = own.schema[item].dataType.simpleString()
    n = max(1, -(-own.count() // BLOCK))
    block = F.pmod(F.xxhash64(item), F.lit(n)).cast("int")
    dealt = own.withColumn("_b", block).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    dealt = dealt.withColumn("_x", F.least("_b", "_o")).withColumn("_y", F.greatest("_b", "_o"))

    def run(key, t):
        x, y = key[0].as_py(), key[1].as_py()
        b, ids = t.column("_b").to_numpy(), t.column(item).to_pylist()
        m = np.frombuffer(b"".join(t.column("regs").to_pylist()), np.uint8).reshape(len(ids), -1)
        e = classic(m, p)
        order = np.argsort(np.array(ids), kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        found = []
        left, right = np.flatnonzero(b == x), np.flatnonzero(b == y)
        for a in left.tolist():
            others = right[right > a] if x == y else right
            u = classic(np.maximum(m[others], m[a]), p)
            with np.errstate(divide="ignore", invalid="ignore"):
                js = (e[a] + e[others] - u) / u
            first = rank[a] < rank[others]
            found.append((np.where(first, a, others), np.where(first, others, a), js))
        i, j, js = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        return pa.table({"i": t.column(item).take(pa.array(i)), "j": t.column(item).take(pa.array(j)), "jaccard": pa.array(js)})

    out = dealt.groupBy("_x", "_y").applyInArrow(run, f"i {kind}, j {kind}, jaccard double")
    return out if threshold is None else out.where(~F.isnan("jaccard") & (F.col("jaccard") >= threshold))


def exact_jaccard(keys: DataFrame, item: str, key: str) -> DataFrame:
    """(i, j, shared, jaccard) for i < j of the items' exact key sets; pairs that share no key give no row.

    Each key carries the sorted list of the items that have it, so a key that all items have costs its item pairs
    once, whatever its occurrences; counts are combined before the shuffle.
    """
    own = keys.select(item, key).where(f"`{key}` is not null").distinct()
    sizes = own.groupBy(item).agg(F.count("*").alias("n"))
    sets = own.groupBy(key).agg(F.array_sort(F.collect_set(item)).alias("s")).where(F.size("s") > 1)
    # few different lists of items occur: count each once
    sets = sets.groupBy("s").agg(F.count("*").alias("c"))
    pairs = sets.select("c", "s", F.posexplode("s").alias("a", "i"))
    pairs = pairs.select("c", "i", F.explode(F.slice("s", F.col("a") + 2, F.size("s"))).alias("j"))
    shared = pairs.groupBy("i", "j").agg(F.sum("c").alias("shared"))
    out = shared.join(sizes.select(F.col(item).alias("i"), F.col("n").alias("n_i")), "i").join(sizes.select(F.col(item).alias("j"), F.col("n").alias("n_j")), "j")
    return out.select("i", "j", "shared", (F.col("shared") / (F.col("n_i") + F.col("n_j") - F.col("shared"))).alias("jaccard"))
