"""Exact top-k by inner product over KD-trees, one tree per shard of the vectors.

Each shard's tree splits at the median of the widest dimension; every node keeps the tight bounding
box of its points. A query goes down best-first: the bound of a box is the largest inner product any
point of it could have, sum over d of max(q_d * low_d, q_d * high_d), and a box whose bound is below
the kth score found so far is never opened. The kth score travels: a block of queries visits a
group of shards one after another with what it has found already, and starts with the kth best score of a
first round, in which every shard opened only each query's most promising leaves.

Queries grow with the table, so they are dealt in blocks, and a task is a block of queries and a group of
shards, which it reads one at a time from the shared folder. Nothing is broadcast.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import new_dir, read_raw, stage, write_raw
from .vectors import matrix, usable

LEAF = 128
#: Vectors of a shard, queries of a block, shards of a group.
SHARD_ROWS = 8192
BLOCK = 128
GROUP = 16
#: Leaves that the first round opens for each query and shard.
FIRST_LEAVES = 2
#: Above this a sum of products may not be exact in double precision.
EXACT = float(1 << 53)


class Tree:
    """points: integer matrix in leaf order, ids and row numbers alike; nodes in breadth-first arrays."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        order, low, high, left, begin, end = np.arange(len(ids)), [], [], [], [], []
        todo = [(0, len(ids))]
        i = 0
        while i < len(todo):
            a, b = todo[i]
            x = points[order[a:b]]
            lo, hi = (x.min(0), x.max(0)) if b > a else (points[:0].sum(0), points[:0].sum(0))
            low.append(lo)
            high.append(hi)
            begin.append(a)
            end.append(b)
            if b - a > LEAF and len(lo) and (hi > lo).any():
                d = int(np.argmax(hi - lo))
                m = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(x[:, d], m)]
                left.append(len(todo))
                todo += [(a, a + m), (a + m, b)]
            else:
                left.append(-1)
            i += 1
        self.points, self.ids, self.rows = points[order], ids[order], rows[order]
        self.low, self.high = np.array(low), np.array(high)
        self.left, self.begin, self.end = np.array(left), np.array(begin), np.array(end)

    _FIELDS = ("points", "ids", "rows", "low", "high", "left", "begin", "end")

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{k: getattr(self, k) for k in self._FIELDS})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Tree:
        self = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as z:
            for k in cls._FIELDS:
                setattr(self, k, z[k])
        return self

    def bounds(self, q: np.ndarray) -> np.ndarray:
        return np.maximum(self.low * q, self.high * q).sum(1)

    def search(self, q: np.ndarray, own: int, k: int, best: list[tuple[int, int, int]], floor: float, leaves: int | None = None) -> int:
        """Put the shard's best into ``best``, a heap of (score, -id, -row) of at most k; leaves opened.

        floor: a score that at least k points are known to reach.
        """
        bound = self.bounds(q)
        heap, opened = [(-bound[0], 0)], 0
        while heap:
            b, i = heapq.heappop(heap)
            least = max(floor, best[0][0]) if len(best) == k else floor
            if -b < least or opened == leaves:
                break
            if self.left[i] >= 0:
                for j in (self.left[i], self.left[i] + 1):
                    heapq.heappush(heap, (-bound[j], int(j)))
                continue
            opened += 1
            a, e = self.begin[i], self.end[i]
            score = self.points[a:e] @ q
            for j in np.flatnonzero(score >= least).tolist():
                row = int(self.rows[a + j])
                if row != own:
                    x = (int(score[j]), -int(self.ids[a + j]), -row)
                    if len(best) < k:
                        heapq.heappush(best, x)
                    elif x > best[0]:
                        heapq.heapreplace(best, x)
        return opened


def _tree_uri(uri: str, shard: int) -> str:
    return f"{uri}/tree-{shard:06d}.npz"


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: float = 1024.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the largest integer inner products.

    vectors: (vec_id long, embedding array). Components become floor(scale * x), x as double.
    is_query: a column over vec_id. A query's own row isn't a candidate; other rows with the same vec_id are.
    Ties go to the smaller vec_id. Rows whose vec_id is null, and vectors that are null or hold null or
    non-finite components, take no part; vectors of unequal length are compared over what both have.
    Scores beyond 64 bits are an error. No vectors or queries: no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(usable() & F.col("vec_id").isNotNull())
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    rows = stage(rows.select("vec_id", whole.alias("v")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    count, dim = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    shards = max(1, -(-count // SHARD_ROWS))
    uri = new_dir(spark, "trees")

    def build(key, t):
        tree = Tree(matrix(t.column("v"), dim), t.column("vec_id").to_numpy(), t.column("row").to_numpy())
        write_raw(_tree_uri(uri, key[0].as_py()), [tree.to_bytes()])
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "rows": pa.array([t.num_rows], pa.int64())})

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    made = stage(dealt.groupBy("shard").applyInArrow(build, "shard long, rows long"), "trees")

    queries = rows.where(is_query)
    blocks = max(1, -(-queries.count() // BLOCK))
    groups = made.groupBy((F.col("shard") / GROUP).cast("int").alias("grp")).agg(F.sort_array(F.collect_list("shard")).alias("shards"))
    # the stated query set against all rows, in blocks: each query goes to each group of shards once
    queries = queries.withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)))
    n_groups = max(1, -(-shards // GROUP))
    asked = queries.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)))).join(groups, "grp")

    def visit(leaves: int | None):
        def run(key, t):
            q = matrix(t.column("v"), dim)
            own, ids = t.column("row").to_pylist(), t.column("vec_id").to_pylist()
            floors = t.column("floor").to_pylist()
            best: list[list] = [[] for _ in own]
            for shard in t.column("shards")[0].as_py():
                tree = Tree.from_bytes(read_raw(_tree_uri(uri, shard)))
                size = max((float(np.abs(x).max()) for x in (q, tree.points) if x.size), default=0.0)
                exact = size * size * max(dim, 1) < EXACT
                for name in () if exact else ("points", "low", "high"):
                    setattr(tree, name, _objects(getattr(tree, name)))
                for i, x in enumerate(q):
                    tree.search(x if exact else _objects(x[None])[0], own[i], k, best[i], -np.inf if floors[i] is None else floors[i], leaves)
            found = [(r, i, *x) for r, i, b in zip(own, ids, best, strict=True) for x in b]
            col = lambda n, sign=1: pa.array([sign * x[n] for x in found], pa.int64())
            return pa.table({"row": col(0), "query_id": col(1), "score": col(2), "vec_id": col(3, -1), "other": col(4, -1)})

        return run

    found = "row long, query_id long, score long, vec_id long, other long"
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id", "other")
    start = asked.withColumn("floor", F.lit(None).cast("long")).groupBy("block", "grp").applyInArrow(visit(FIRST_LEAVES), found)
    floor = start.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("row", F.col("score").alias("floor"))
    full = asked.join(stage(floor, "floors"), "row", "left").groupBy("block", "grp").applyInArrow(visit(None), found)
    ranked = full.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _objects(x: np.ndarray) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)
