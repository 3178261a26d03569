"""HyperLogLog sketches as DataFrames: rows (key columns..., idx, rho), absent registers being zero.

Inserting, merging and estimating are ordinary aggregates: a maximum per register, combined before the shuffle, so a
sketch never moves more than 2**p rows a key and task.
"""

from __future__ import annotations

import warnings
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits, dna

MIN_K, MAX_K, MIN_P, MAX_P, DEFAULT_P = 8, 32, 8, 18, 14


def check(k: int | None, p: int) -> None:
    if k is not None and not MIN_K <= k <= MAX_K:
        raise ValueError(f"k must be {MIN_K} to {MAX_K}, not {k}")
    if not MIN_P <= p <= MAX_P:
        raise ValueError(f"precision must be {MIN_P} to {MAX_P}, not {p}")


def registers(df: DataFrame, key: str | Column, by: list[str] = (), p: int = DEFAULT_P) -> DataFrame:
    """(*by, idx, rho) of the distinct non-null BIGINT keys of each group."""
    h = df.where((F.col(key) if isinstance(key, str) else key).isNotNull()).select(*by, bits.finalize(key).alias("h"))
    return h.select(*by, bits.hll_index("h", p).alias("idx"), bits.hll_rank("h", p).alias("rho")).groupBy(*by, "idx").agg(F.max("rho").alias("rho"))


def merged(regs: DataFrame, by: list[str] = ()) -> DataFrame:
    """The union of the sketches of each group: the larger register wins."""
    return regs.groupBy(*by, "idx").agg(F.max("rho").alias("rho"))


def alpha(m: int) -> float:
    return 0.7213 / (1 + 1.079 / m)


def estimates(regs: DataFrame, by: list[str] = (), p: int = DEFAULT_P, name: str = "estimate") -> DataFrame:
    """(*by, name) by the classic estimator: alpha m^2 / sum 2^-rho, linear counting while that is small."""
    sums = regs.groupBy(*by).agg(F.sum(F.pow(F.lit(2.0), -F.col("rho"))).alias("_s"), F.count("*").alias("_n"))
    return sums.select(*by, classic("_s", "_n", p).alias(name))


def classic(part: str | Column, present: str | Column, p: int) -> Column:
    """From the sum of 2^-rho and the number of the registers that are there; the absent ones add 1 each."""
    part, present = (F.col(x) if isinstance(x, str) else x for x in (part, present))
    m = 1 << p
    v = F.coalesce(F.lit(m) - present, F.lit(m))
    e = F.lit(alpha(m) * m * m) / (F.coalesce(part, F.lit(0.0)) + v)
    return F.when((e <= 2.5 * m) & (v > 0), F.lit(float(m)) * F.log(F.lit(float(m)) / v)).otherwise(e)


def builtin_estimate(key: str | Column, p: int = DEFAULT_P) -> Column:
    """Spark's own HyperLogLog++ (with its bias correction) at the same precision."""
    return F.approx_count_distinct(key, 1.106 / 2 ** (p / 2) * (1 + 1e-7))


def kmer_registers(seqs: DataFrame, k: int, by: list[str] = (), p: int = DEFAULT_P, is_canonical: bool = True, seq: str = "seq") -> DataFrame:
    """(*by, idx, rho) of all k-mers of the sequences: each Arrow batch is hashed in numpy passes of bounded size and leaves one row per
    group and register it has touched, so k-mers never become rows."""
    by = list(by)

    def run(batches):
        for b in batches:
            codes, owner, groups = flat_codes(b, seq, by)
            top = np.zeros(len(groups) << p, np.int8)
            for first, part in dna.passes(codes, k):
                starts, h = dna.rolling_hashes(part, k, is_canonical)
                h = dna.finalize(h)
                np.maximum.at(top, owner(starts + first) << p | (h >> np.uint64(64 - p)).astype(np.int64), _ranks(h, p))
            at = np.flatnonzero(top)
            keys = [groups.column(c).combine_chunks().take(pa.array(at >> p)) for c in by]
            yield pa.RecordBatch.from_arrays([*keys, pa.array((at & (1 << p) - 1).astype(np.int32)), pa.array(top[at].astype(np.int32))], [*by, "idx", "rho"])

    fields = "".join(f"`{c}` {seqs.schema[c].dataType.simpleString()}, " for c in by)
    return merged(seqs.select(*by, F.col(seq).alias(seq)).mapInArrow(run, f"{fields}idx int, rho int"), by)


def _ranks(h: np.ndarray, p: int) -> np.ndarray:
    rest = h << np.uint64(p) | np.uint64(1 << (p - 1))
    # the exponent of the upper half, or of the lower one, is exact in double precision
    high, low = (rest >> np.uint64(32)).astype(np.float64), (rest & np.uint64(0xFFFFFFFF)).astype(np.float64)
    bits_ = np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1])
    return (65 - bits_).astype(np.int8)


def flat_codes(b: pa.RecordBatch, seq: str, by: list[str]):
    """(codes with a break after each sequence, group numbers of given places, distinct groups)."""
    data = [(s.as_buffer().to_pybytes() if s.is_valid else b"") for s in b.column(seq)]
    codes = dna.CODES[np.frombuffer(b"N".join(data) + b"N", np.uint8)]
    size = np.array([len(d) + 1 for d in data])
    t = pa.table({c: b.column(c) for c in by}) if by else pa.table({"_": pa.nulls(b.num_rows)})
    names = t.column_names
    groups = t.append_column("_row", pa.array(np.arange(b.num_rows))).group_by(names).aggregate([("_row", "min"), ("_row", "list")])
    number = np.zeros(b.num_rows, np.int64)
    for g, rows in enumerate(groups.column("_row_list").to_pylist()):
        number[rows] = g
    ends = np.cumsum(size)
    return codes, lambda places: number[np.searchsorted(ends, places, side="right")], groups


class Sketch:
    """One sketch: registers (a DataFrame of idx, rho), k, precision, canonical. Operators give new sketches
    but for ``merge`` and ``|=``, which change this one."""

    def __init__(self, regs: DataFrame, precision: int = DEFAULT_P, canonical: bool = True, *, k: int | None = None):
        check(None, precision)
        self.registers, self.precision, self.canonical, self.k = regs, precision, canonical, k

    def estimate(self) -> int:
        """Distinct k-mers, by the classic estimator."""
        return round(estimates(self.registers, p=self.precision).first()[0])

    def _same(self, other) -> None:
        if not isinstance(other, Sketch):
            raise TypeError(f"expected a Sketch, got {type(other).__name__}")
        for what in ("k", "precision", "canonical"):
            a, b = getattr(self, what), getattr(other, what)
            if a != b:
                raise ValueError(f"sketches differ in {what}: {a} and {b}")

    def union(self, other: Sketch) -> Sketch:
        self._same(other)
        return Sketch(merged(self.registers.unionByName(other.registers)), self.precision, self.canonical, k=self.k)

    def merge(self, other: Sketch) -> Sketch:
        self.registers = self.union(other).registers
        return self

    def clone(self) -> Sketch:
        return Sketch(self.registers, self.precision, self.canonical, k=self.k)

    def clear(self) -> None:
        self.registers = self.registers.limit(0)

    def intersect(self, other: Sketch) -> int:
        """By inclusion and exclusion, not below zero."""
        self._same(other)
        return max(0, self.estimate() + other.estimate() - self.union(other).estimate())

    def write(self, path: str) -> None:
        from ..sources.hll import write_sketch

        write_sketch(self, path)

    def __or__(self, other):
        return self.union(other) if isinstance(other, Sketch) else NotImplemented

    def __ior__(self, other):
        return self.merge(other) if isinstance(other, Sketch) else NotImplemented

    def __and__(self, other):
        return self.intersect(other) if isinstance(other, Sketch) else NotImplemented

    def __len__(self) -> int:
        return self.estimate()

    @property
    def sketch_bytes(self) -> int:
        return 4 << self.precision

    def __repr__(self) -> str:
        return f"Sketch(k={self.k}, precision={self.precision}, canonical={self.canonical})"


def intersection_estimates(regs: DataFrame, item: str, ids: list, p: int = DEFAULT_P) -> DataFrame:
    """(mask, size, estimate) of the union of every non-empty subset of ``ids``: one job for all subsets."""
    if not ids:
        raise ValueError("no sketches")
    if len(ids) > 6:
        warnings.warn(f"{(1 << len(ids)) - 1} unions: errors add up", stacklevel=2)
    spark = regs.sparkSession
    subsets = [(sum(1 << i for i in s), len(s), i) for n in range(1, len(ids) + 1) for s in combinations(range(len(ids)), n) for i in s]
    member = spark.createDataFrame([(m, n, ids[i]) for m, n, i in subsets], f"mask int, size int, `{item}` {regs.schema[item].dataType.simpleString()}")
    own = regs.join(F.broadcast(member), item)
    return estimates(merged(own, ["mask", "size"]), ["mask", "size"], p)


def intersect_many(regs: DataFrame, item: str, ids: list, p: int = DEFAULT_P) -> DataFrame:
    """One row (estimate): the n-way intersection by inclusion and exclusion, not below zero."""
    sign = F.when(F.col("size") % 2 == 1, F.col("estimate")).otherwise(-F.col("estimate"))
    return intersection_estimates(regs, item, ids, p).agg(F.greatest(F.lit(0.0), F.sum(sign)).alias("estimate"))

