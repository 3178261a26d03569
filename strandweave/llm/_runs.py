"""Groups of rows with equal keys inside sorted Arrow partitions, many small ones per batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import partitions


def grouped(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of equal (long) keys together: what ``runs`` expects."""
    return df.repartition(partitions(df), *keys).sortWithinPartitions(*keys)


def runs(batches, keys: list[str]):
    """(table, starts): whole groups, the n-th from row starts[n] to starts[n + 1]. Rows of the last
    group of a batch wait for the next batch."""
    held: pa.Table | None = None
    for b in _and_end(batches):
        t = held if b is None else pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        if t is None or not t.num_rows:
            continue
        of = np.stack([t.column(c).to_numpy() for c in keys])
        starts = np.append(0, np.flatnonzero((of[:, 1:] != of[:, :-1]).any(0)) + 1).tolist()
        if b is None:
            starts.append(t.num_rows)
        held = t.slice(starts[-1])
        if len(starts) > 1:
            yield t.slice(0, starts[-1]), starts


def _and_end(batches):
    yield from batches
    yield None


def block_pairs(df: DataFrame, count: Column, item: str, block: int) -> DataFrame:
    """Deal the ``count`` members of each row's group over blocks of about ``block`` and give every row to each pair
    of blocks (i <= j) that its own belongs to: columns i, j and side (0: block i, 1: block j; within one
    block only 0). All pairs of members meet in exactly one (i, j), and none is written out."""
    n = F.greatest(F.lit(1).cast("long"), F.ceil(count / block))
    dealt = df.withColumn("_n", n).withColumn("_b", F.pmod(F.xxhash64(item), F.col("_n")))
    low = F.transform(F.sequence(F.col("_b"), F.col("_n") - 1), lambda o: F.struct(F.col("_b").alias("i"), o.alias("j"), F.lit(0).alias("side")))
    high = F.when(F.col("_b") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("_b") - 1), lambda o: F.struct(o.alias("i"), F.col("_b").alias("j"), F.lit(1).alias("side"))))
    return dealt.withColumn("_p", F.explode(F.when(high.isNull(), low).otherwise(F.concat(low, high)))).select(*df.columns, "_p.i", "_p.j", "_p.side")
