"""Command line: ``python -m strandweave.cli sketch ...`` and ``... pairwise ...``.

Exit status: 0 done, 1 failed, 2 wrong use.
"""

from __future__ import annotations

import argparse
import os
import sys
import time

from pyspark.sql import functions as F

from . import api
from .operators import pairwise
from .sources import hll, sequences


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandweave")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("sketch", help="distinct k-mers of FASTA or FASTQ files")
    s.add_argument("inputs", nargs="*")
    s.add_argument("--k", type=int, required=True)
    s.add_argument("--precision", type=int, default=api.DEFAULT_P)
    s.add_argument("--chunk-mb", type=int, default=api.DEFAULT_CHUNK_MB, help="accepted; Spark partitions the input")
    s.add_argument("--canonical", action=argparse.BooleanOptionalAction, default=True)
    s.add_argument("--per-genome", action="store_true", help="a line per input, then UNION")
    s.add_argument("--output-dir")
    s.add_argument("--keep-sketches", action="store_true", help="write sketches to a folder named by time")
    s.add_argument("--tmpdir", help="accepted; no temporary sketches are written")
    s.add_argument("--list", help="a file with one input a line")
    s.add_argument("--verbose", action="store_true")
    j = sub.add_parser("pairwise", help="Jaccard of all pairs of sketch files")
    j.add_argument("--sketches-dir", required=True)
    j.add_argument("--threshold", type=float, default=0.5)
    j.add_argument("--output")
    j.add_argument("--verbose", action="store_true")
    b = sub.add_parser("abundance", help="k-mers by how often they occur, from a bottom-k sample")
    b.add_argument("inputs", nargs="*")
    b.add_argument("--list", help="a file with one input a line")
    b.add_argument("--k", type=int, default=31)
    b.add_argument("--x", type=int, default=1)
    b.add_argument("--y", type=int, default=4)
    b.add_argument("--sample", type=int, default=50_000)
    b.add_argument("--f0", type=float, help="distinct k-mers, if known")
    return p


def _abundance(a, parser) -> None:
    paths = a.inputs + (sequences.read_manifest(api._spark(), a.list) if a.list else [])
    if not paths:
        parser.error("no inputs")
    for r in api.abundance(paths, k=a.k, x=a.x, y=a.y, sample=a.sample, f0=a.f0).collect():
        print("\t".join([r.region, *(f"{r[c]:.6g}" for c in ("in_sample", "m", "point", "lo", "hi", "upper"))]))


def _sketch(a, parser) -> None:
    spark = api._spark()
    paths = a.inputs + (sequences.read_manifest(spark, a.list) if a.list else [])
    if not paths:
        parser.error("no inputs")
    if not api.MIN_K <= a.k <= api.MAX_K or not api.MIN_P <= a.precision <= api.MAX_P or a.chunk_mb < 1:
        parser.error("k, precision or chunk-mb out of range")
    bad = [p for (p, ok) in spark.createDataFrame([(p,) for p in paths], "p string").select("p", sequences.is_input_name("p")).collect() if not ok]
    if bad:
        parser.error(f"not FASTA or FASTQ by name: {bad[0]}")
    options = {"k": a.k, "precision": a.precision, "canonical": a.canonical}
    folder = a.output_dir or (time.strftime("sketches-%Y%m%d-%H%M%S-") + str(os.getpid()) if a.keep_sketches else None)
    if folder:
        out = api.sketch_to_dir(paths, output_dir=folder, **options)
        rows, union = [(p, out.estimates[p]) for p in paths], out.union_estimate
    elif a.per_genome:
        rows = [(p, s.estimate()) for p, s in zip(paths, api.sketch_many(paths, **options), strict=True)]
        union = api.estimate_union(paths, **options)
    else:
        print(api.estimate_union(paths, **options))
        return
    for p, n in [*rows, ("UNION", union)]:
        print(f"{p}\t{n}")


def _pairwise(a, parser) -> None:
    spark = api._spark()
    own = hll.read_packed(spark, a.sketches_dir)
    kinds = own.groupBy("precision_p", "k", "canonical").count().collect()
    if sum(r["count"] for r in kinds) < 2:
        raise ValueError("fewer than two sketches")
    if len(kinds) > 1:
        raise ValueError("sketches differ in precision, k or canonical")
    pairs = pairwise.jaccard_packed(own.select("path", "regs"), "path", kinds[0].precision_p, a.threshold).orderBy("i", "j")
    if a.output:
        hll.write_tsv(pairs.withColumn("jaccard", F.round("jaccard", 6)), a.output)
        return
    for r in pairs.toLocalIterator():
        print(f"{r.i}\t{r.j}\t{r.jaccard:.6f}")


def main(argv: list[str] | None = None) -> int:
    parser = _parser()
    args = parser.parse_args(argv)
    try:
        {"sketch": _sketch, "pairwise": _pairwise, "abundance": _abundance}[args.command](args, parser)
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0




if __name__ == "__main__":
    sys.exit(main())
