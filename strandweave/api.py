"""Files in, sketches and numbers out: the library's front door.

``chunk_mb`` is accepted where a caller may pass it and changes nothing: Spark partitions the input.
"""

from __future__ import annotations

import os
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import stats as _stats
from .operators import abundance as _abundance
from .operators import sketch as _sketch
from .operators.sketch import DEFAULT_P, MAX_K, MAX_P, MIN_K, MIN_P, Sketch
from .sources import hll, sequences

DEFAULT_CHUNK_MB = 32

__all__ = [
    "DEFAULT_CHUNK_MB", "DEFAULT_P", "MAX_K", "MAX_P", "MIN_K", "MIN_P", "Sketch", "SketchDirResult", "abundance", "estimate", "estimate_union",
    "intersect_estimate", "intersect_estimate_many", "read", "read_header", "sample_report", "sketch", "sketch_many", "sketch_to_dir", "sketch_union",
]


def _spark() -> SparkSession:
    return SparkSession.builder.getOrCreate()


def _paths(fastas) -> list[str]:
    out = [os.fspath(p) for p in fastas]
    if not out:
        raise ValueError("no inputs")
    return out


def _registers(paths: list[str], k: int, p: int, canonical: bool, by_path: bool) -> DataFrame:
    """Registers of the files' k-mers; by path from 2**p rows a file on, kept in memory for repeated use."""
    _sketch.check(k, p)
    rows = sequences.read_sequences(_spark(), list(dict.fromkeys(paths)), k)
    return _sketch.kmer_registers(rows, k, ["path"] if by_path else [], p, canonical).persist()


def sketch(fasta, *, k: int, precision: int = DEFAULT_P, canonical: bool = True, chunk_mb: int = DEFAULT_CHUNK_MB, verbose: bool = False) -> Sketch:
    return Sketch(_registers([os.fspath(fasta)], k, precision, canonical, False), precision, canonical, k=k)


def estimate(fasta, *, k: int, precision: int = DEFAULT_P, canonical: bool = True, chunk_mb: int = DEFAULT_CHUNK_MB, verbose: bool = False) -> int:
    return sketch(fasta, k=k, precision=precision, canonical=canonical).estimate()


def sketch_many(fastas, *, k: int, precision: int = DEFAULT_P, canonical: bool = True, chunk_mb: int = DEFAULT_CHUNK_MB, verbose: bool = False) -> list[Sketch]:
    """One sketch per input, in input order, from one job."""
    paths = _paths(fastas)
    regs = _registers(paths, k, precision, canonical, True)
    return [Sketch(regs.where(F.col("path") == p).select("idx", "rho"), precision, canonical, k=k) for p in paths]


def sketch_union(fastas, *, k: int, precision: int = DEFAULT_P, canonical: bool = True, chunk_mb: int = DEFAULT_CHUNK_MB, verbose: bool = False) -> Sketch:
    return Sketch(_registers(_paths(fastas), k, precision, canonical, False), precision, canonical, k=k)


def estimate_union(fastas, *, k: int, precision: int = DEFAULT_P, canonical: bool = True, chunk_mb: int = DEFAULT_CHUNK_MB, verbose: bool = False) -> int:
    return sketch_union(fastas, k=k, precision=precision, canonical=canonical).estimate()


class SketchDirResult(dict):
    """Input path to output path; union_estimate, and estimates by input path."""

    union_estimate: int = 0
    estimates: dict[str, int]


def sketch_to_dir(fastas, *, output_dir, k: int, precision: int = DEFAULT_P, canonical: bool = True, verbose: bool = False) -> SketchDirResult:
    """Write ``<output_dir>/<stem>.hll`` per input. Inputs whose stems collide are an error."""
    paths, folder = _paths(fastas), os.fspath(output_dir)
    stems = {p: sequences.stem(p) for p in dict.fromkeys(paths)}
    twice = [s for s, n in Counter(stems.values()).items() if n > 1]
    if twice:
        raise ValueError(f"inputs would share output files: {', '.join(sorted(twice))}")
    if "://" not in folder:
        os.makedirs(folder, exist_ok=True)
    regs = _registers(paths, k, precision, canonical, True)
    names = _spark().createDataFrame(list(stems.items()), "path string, stem string")
    own = regs.join(F.broadcast(names), "path")
    hll.write_sketches(own, folder, "stem", k, canonical, precision).count()
    counted = {r.path: round(r.estimate) for r in _sketch.estimates(regs, ["path"], precision).collect()}
    for p in stems:  # an input without k-mers has no registers, but a file all the same
        if p not in counted:
            counted[p] = 0
            hll.write_sketch(Sketch(regs.where("false").select("idx", "rho"), precision, canonical, k=k), f"{folder}/{stems[p]}.hll")
    out = SketchDirResult({p: f"{folder}/{s}.hll" for p, s in stems.items()})
    out.union_estimate = round(_sketch.estimates(_sketch.merged(regs), p=precision).first()[0])
    out.estimates = {p: counted[p] for p in stems}
    return out


def intersect_estimate(a: Sketch, b: Sketch) -> int:
    if not isinstance(a, Sketch):
        raise TypeError(f"expected a Sketch, got {type(a).__name__}")
    return a.intersect(b)


def intersect_estimate_many(sketches) -> int:
    """n-way, by inclusion and exclusion over all subsets; not below zero."""
    own = list(sketches)
    if not own:
        raise ValueError("no sketches")
    for s in own:
        own[0]._same(s) if isinstance(own[0], Sketch) else Sketch._same(s, own[0])
    if len(own) <= 2:
        return own[0].estimate() if len(own) == 1 else own[0].intersect(own[1])
    regs = None
    for i, s in enumerate(own):
        r = s.registers.select(F.lit(i).alias("item"), "idx", "rho")
        regs = r if regs is None else regs.unionByName(r)
    return round(_sketch.intersect_many(regs, "item", list(range(len(own))), own[0].precision).first()[0])


def abundance(fastas, *, k: int, x: int, y: int, sample: int = 50_000, cap: int = 0, z: float = 2.326347874, precision: int = DEFAULT_P, canonical: bool = True, f0: float | None = None) -> DataFrame:
    """(region, in_sample, m, p_hat, point, sigma, lo, hi, upper) of the k-mers that occur x < n < y, n >= x and n <= y times.

    f0: the number of distinct k-mers; None estimates it with a sketch, whose error the bounds then hold too.
    """
    rows = sequences.read_sequences(_spark(), list(dict.fromkeys(_paths(fastas))), k)
    rel = 0.0
    if f0 is None:
        f0, rel = Sketch(_sketch.kmer_registers(rows, k, [], precision, canonical), precision, canonical, k=k).estimate(), _stats.hll_error(precision)
    cfg = _stats.AbundanceConfig(k, x, y, sample, cap, rel, z)
    return _abundance.estimate_regions(_abundance.kmer_sample(rows, k, sample, cfg.counter_cap, canonical), f0, cfg)


def sample_report(fastas, *, k: int, sample: int = 50_000, canonical: bool = True) -> DataFrame:
    """One row: tau, n_distinct, n_occ, full of the files' bottom-``sample`` sample."""
    rows = sequences.read_sequences(_spark(), list(dict.fromkeys(_paths(fastas))), k)
    return _abundance.tau(_abundance.kmer_sample(rows, k, sample, None, canonical), sample)


def read(path) -> Sketch:
    return hll.read_sketch(_spark(), os.fspath(path))


def read_header(path) -> hll.Header:
    return hll.read_header(os.fspath(path))
