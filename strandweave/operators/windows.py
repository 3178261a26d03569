"""What the windows of single sequences give, batch by batch in numpy: no k-mer becomes a row or is shuffled."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from .abundance import RUNS, STRIPE, cap_gap, capped


def _codes(b: pa.RecordBatch, seq: str) -> list[np.ndarray]:
    return [dna.CODES[np.frombuffer(s.as_buffer(), np.uint8)] if s.is_valid and len(s.as_buffer()) else np.zeros(0, np.uint8) for s in b.column(seq)]


def valid_counts(seqs: DataFrame, k: int, id: str, seq: str = "seq") -> DataFrame:
    """(id, n_windows, n_valid), a row per row: its windows of k bases, and those without a break."""

    def run(batches):
        for b in batches:
            codes = _codes(b, seq)
            n = [max(len(c) - k + 1, 0) for c in codes]
            valid = [int(np.count_nonzero(dna.valid_starts(c, k))) if m else 0 for c, m in zip(codes, n, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(id), pa.array(n, pa.int64()), pa.array(valid, pa.int64())], [id, "n_windows", "n_valid"])

    return seqs.select(id, seq).mapInArrow(run, f"`{id}` {seqs.schema[id].dataType.simpleString()}, n_windows long, n_valid long")


def repeated(ids: DataFrame, id: str) -> DataFrame | None:
    """(id) of the ids, null among them, that more than one row has; None if there is none."""
    twice = ids.groupBy(id).agg(F.count("*").alias("_n")).where("_n > 1").select(id)
    return None if twice.isEmpty() else twice


def _apart(seqs: DataFrame, id: str, ids: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Rows with an id of their own, and the others if there are any. ``ids``: the same ids, cheaper to read."""
    twice = repeated(seqs if ids is None else ids, id)
    if twice is None:
        return seqs, None
    twice = twice.withColumnRenamed(id, "_id")
    same = seqs[id].eqNullSafe(twice["_id"])
    return seqs.join(twice, same, "left_anti"), seqs.join(twice, same, "left_semi")


def extremes(seqs: DataFrame, k: int, id: str, seq: str = "seq", ids: DataFrame | None = None) -> DataFrame:
    """(id, n_distinct, least, most) of the canonical k-mers (k at most 31) of each id that has any. Only the sequences of ids with several
    rows are shuffled."""

    def run(batches):
        for b in batches:
            rows, n, least, most = [], [], [], []
            for i, c in enumerate(_codes(b, seq)):
                # in passes, so a long sequence costs its distinct keys
                own = [np.unique(dna.packed_windows(part, k)[1]) for _, part in dna.passes(c, k)]
                keys = own[0] if len(own) == 1 else np.unique(np.concatenate(own))
                if len(keys):
                    rows.append(i)
                    n.append(len(keys))
                    least.append(keys[0])
                    most.append(keys[-1])
            ends = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (least, most)]
            yield pa.RecordBatch.from_arrays([b.column(id).take(pa.array(rows, pa.int64())), pa.array(n, pa.int64()), *ends], [id, "n_distinct", "least", "most"])

    def several(key, t):
        own = [np.unique(dna.packed_windows(part, k)[1]) for c in _codes(t, seq) for _, part in dna.passes(c, k)]
        keys = np.unique(np.concatenate(own))
        n = min(len(keys), 1)
        ends = [pa.array(keys[at][:n].view(np.int64)) for at in (slice(0, 1), slice(-1, None))]
        return pa.table([t.column(id).combine_chunks()[:n], pa.array([len(keys)] * n, pa.int64()), *ends], [id, "n_distinct", "least", "most"])

    fields = f"`{id}` {seqs.schema[id].dataType.simpleString()}, n_distinct long, least long, most long"
    single, others = _apart(seqs.select(id, seq), id, ids)
    out = single.mapInArrow(run, fields)
    if others is not None:
        out = out.unionByName(others.groupBy(id).applyInArrow(several, fields))
    return out.select(id, "n_distinct", *[dna.unpacked(c, k).alias(c) for c in ("least", "most")])


def capped_gap(seqs: DataFrame, k: int, id: str, seq: str = "seq", ids: DataFrame | None = None) -> DataFrame:
    """``abundance.cap_gap`` of all k-mers of the sequences and those of the capped enumeration (``abundance.capped`` by ``id``)."""

    def run(batches):
        for b in batches:
            uncapped = kept = 0
            for c in _codes(b, seq):
                if len(c) < k:
                    continue
                pos = np.flatnonzero(dna.valid_starts(c, k))
                if not len(pos):
                    continue
                new = np.append(True, np.diff(pos // STRIPE) > 0)
                runs = np.cumsum(np.append(False, np.diff(pos) > 1) & ~new)
                first = np.flatnonzero(new)
                runs -= np.repeat(runs[first], np.diff(np.append(first, len(pos))))
                uncapped += len(pos)
                kept += int(np.count_nonzero(runs < RUNS))
            yield pa.RecordBatch.from_arrays([pa.array([uncapped]), pa.array([kept])], ["uncapped", "capped"])

    single, others = _apart(seqs.select(id, seq), id, ids)
    both = single.mapInArrow(run, "uncapped long, capped long")
    if others is not None:  # rows that share an id are one sequence there
        occ = dna.kmers(others, k, seq).select(id, "pos")
        both = both.unionByName(cap_gap(occ, capped(occ, [id])).select("uncapped", "capped"))
    total = both.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("uncapped", "capped")])
    lost = F.when(F.col("uncapped") > 0, 100.0 * (F.col("uncapped") - F.col("capped")) / F.col("uncapped")).otherwise(0.0)
    return total.withColumn("lost_percent", lost)
