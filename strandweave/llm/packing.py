"""Best-fit packing of documents into fixed-length sequences, by sum of squares.

Sum-of-squares packing (Csirik, Johnson, Kenyon, Orlin, Shor, Weber: On the Sum-of-Squares
Algorithm for Bin Packing): with N(g) open bins of residual gap g, an item goes where the sum of
N(g)**2 becomes smallest; ties go to the smallest gap that holds it (best fit). Pieces come
longest first.

Shards of a fixed number of pieces, dealt by a hash of the row, pack on their own, so nothing
grows with the corpus in one task. Sequences that a shard leaves with a gap of over
``LOOSE`` of the length are opened again: their pieces are dealt over fewer shards and packed once
more, until they make one shard's worth or no longer shrink.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import stage
from .tokens import default_path, encoded

#: Pieces that one task packs together.
SHARD = 4096
#: A gap of over this share of the length is worth a second packing.
LOOSE = 0.01
ROUNDS = 3


def pack(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, bins numbered from 0. Lengths are 1 to ``size``."""
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]
    n = np.zeros(size + 1, np.int64)
    used: list[int] = []
    at, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    for i in order.tolist():
        s = int(lengths[i])
        cost = 1 + 2 * n[size - s] if s < size else 0
        gap = size
        here = np.flatnonzero(n[s:size]) + s
        if len(here):
            change = np.where(here > s, 2 * n[here - s] + 2, 1) - 2 * n[here]
            j = int(np.argmin(change))
            if change[j] <= cost:
                gap = int(here[j])
        if gap == size:
            b = len(used)
            used.append(0)
        else:
            b = open_bins[gap].pop()
            n[gap] -= 1
        at[i], offset[i] = b, used[b]
        used[b] += s
        if gap > s:
            open_bins[gap - s].append(b)
            n[gap - s] += 1
    return at, offset


def pieces(docs: DataFrame, size: int = 4096, end_id: int = 1, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids, which ``end_id`` ends.

    Null text counts as empty. Only documents of over ``size`` ids are cut.
    """
    path = path or default_path()

    def run(batches):
        for b in batches:
            rows: list[list] = [[], [], [], [], []]
            for i, ids in encoded(b.column("text"), path):
                ids = np.append(ids, ids.dtype.type(end_id)).astype("<u4")
                for p, start in enumerate(range(0, len(ids), size)):
                    part = ids[start : start + size]
                    for to, x in zip(rows, (i, p, start, len(part), zlib.crc32(part.tobytes())), strict=True):
                        to.append(x)
            row = pa.array(rows[0], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(row), pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def _packer(size: int, round_: int):
    def run(key, g):
        g = g.sort_values(["length", "row"], ascending=[False, True], ignore_index=True)
        at, offset = pack(g["length"].to_numpy(), size)
        fill = np.bincount(at, weights=g["length"].to_numpy())
        # each shard has its own range of ids, each round its own range of shards
        g["sequence_id"] = ((round_ << 56) | (int(key[0]) << 20)) + at
        g["offset"] = offset
        g["gap"] = (size - fill[at]).astype(np.int64)
        return g[["row", "length", "sequence_id", "offset", "gap"]]

    return run


def sequences(rows: DataFrame, size: int = 4096) -> DataFrame:
    """(row, length, sequence_id, offset) for ``rows`` (row long, distinct; length long, 1 to ``size``).

    Deterministic in the rows. No rows in: no rows out.
    """
    if size >= 1 << 20:
        raise ValueError("sequences of 2**20 tokens or more aren't supported")
    todo, done, before = rows.select("row", "length"), None, None
    for round_ in range(ROUNDS):
        count = todo.count()
        if before is not None and (not count or count > 0.9 * before):
            break
        shards = max(1, round(count / SHARD))
        dealt = todo.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(round_)), F.lit(shards)))
        packed = stage(dealt.groupBy("shard").applyInPandas(_packer(size, round_), "row long, length long, sequence_id long, offset long, gap long"), "packed")
        loose = F.col("gap") > int(LOOSE * size)
        before = count
        if shards == 1 or round_ == ROUNDS - 1:
            todo = None
            done = packed if done is None else done.unionByName(packed)
            break
        kept = packed.where(~loose)
        done = kept if done is None else done.unionByName(kept)
        todo = packed.where(loose)
        last = packed
    if todo is not None:
        done = done.unionByName(last.where(F.col("gap") > int(LOOSE * size)))
    return done.select("row", "length", "sequence_id", "offset")


def pack_documents(docs: DataFrame, size: int = 4096, end_id: int = 1, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    docs: (doc_id, text); other columns are ignored. Every row is packed, repeated ones and those
    with a null doc_id too, each by itself. No document: no rows.
    """
    cut = stage(pieces(docs, size, end_id, path).withColumn("row", F.monotonically_increasing_id()), "pieces")
    placed = sequences(cut, size).select("row", "sequence_id", "offset")
    return cut.join(placed, "row").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
