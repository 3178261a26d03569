"""k-mers by how often they occur: exact classes, saturating counts, bottom-k samples and estimates from them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits, dna, stats
from .sketch import flat_codes

#: Window starts of a stripe in the capped enumeration.
STRIPE = 32
#: Runs of valid bases per stripe that the capped enumeration keeps.
RUNS = 2


def capped(occurrences: DataFrame, by: list[str], pos: str = "pos") -> DataFrame:
    """Occurrences that a scan in stripes of 32 starts keeps when it reads at most two runs of valid bases a stripe: of each
    sequence (``by``) and stripe the first two islands of consecutive starts. Only k up to 14 can lose any."""
    own = Window.partitionBy(*by, "_stripe").orderBy(pos)
    gap = F.coalesce((F.col(pos) - F.lag(pos).over(own) > 1).cast("int"), F.lit(0))
    rows = occurrences.withColumn("_stripe", F.floor(F.col(pos) / STRIPE)).withColumn("_gap", gap)
    rows = rows.withColumn("_run", F.sum("_gap").over(own))
    return rows.where(F.col("_run") < RUNS).drop("_stripe", "_gap", "_run")


def counts(occurrences: DataFrame, key: str, cap: int | None = None) -> DataFrame:
    """(key, n), n at most ``cap``. Counting comes before the shuffle, so one very common key is cheap."""
    n = F.count("*")
    return occurrences.groupBy(key).agg((n if cap is None else F.least(n, F.lit(cap))).alias("n"))


#: Distinct keys that a task holds at once.
KEYS = 1 << 20


def _summed(owner: np.ndarray, keys: np.ndarray, n: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of equal (owner, key) added up, in that order."""
    order = np.lexsort((keys, owner)) if groups > 1 else np.argsort(keys, kind="stable")
    owner, keys, n = owner[order], keys[order], n[order]
    if not len(keys):
        return owner, keys, n
    first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])))
    return owner[first], keys[first], np.add.reduceat(n, first)


#: Up to this k a task counts all k-mers of a group in one table of 4^k counters (64 MB), in ``TABLES`` tables at most.
DENSE_K, TABLES = 12, 4
#: Keys of a block of counters that tasks send on, and windows that a table may hold before it is sent.
BLOCK, FULL = 1 << 16, 1 << 31


def kmer_counts(seqs: DataFrame, k: int, by: list[str] = (), is_canonical: bool = True, seq: str = "seq", few_groups: bool = False, below: int | None = None) -> DataFrame:
    """(*by, key, n): two-bit keys of all k-mers (k at most 32) with their counts.

    Each task packs and counts in numpy passes of bounded size. Up to k = 12 without ``by``, or with ``few_groups``, it keeps a table of
    counters and sends that. Else rows are distinct keys of up to ``KEYS`` counted together, not occurrences, and 8 bytes wide.
    ``below``: only keys whose finalizer, unsigned, is at most that.
    """
    by = list(by)
    if k <= DENSE_K and (few_groups or not by):
        return _dense_counts(seqs.select(*by, seq), lambda batches: _by_group(batches, seq, by), by, [seqs.schema[c].dataType for c in by], k, is_canonical, below)

    def batch(owner, keys, n, groups):
        own = [groups.column(c).combine_chunks().take(pa.array(owner)) for c in by]
        return pa.RecordBatch.from_arrays([*own, pa.array(keys.view(np.int64)), pa.array(n)], [*by, "key", "n"])

    def run(batches):
        for b in batches:
            codes, owner, groups = flat_codes(b, seq, by)
            held: list[tuple] = []
            for first, part in dna.passes(codes, k):
                starts, keys = dna.packed_windows(part, k, is_canonical)
                if below is not None:
                    near = dna.finalize(keys) <= np.uint64(below)
                    starts, keys = starts[near], keys[near]
                held.append(_summed(owner(starts + first), keys, np.ones(len(keys), np.int64), len(groups)))
                if sum(len(x[0]) for x in held) > KEYS:
                    held = [_summed(*(np.concatenate(x) for x in zip(*held, strict=True)), len(groups))]
                    if len(held[0][0]) > KEYS // 2:
                        yield batch(*held.pop(), groups)
            if held:
                yield batch(*_summed(*(np.concatenate(x) for x in zip(*held, strict=True)), len(groups)), groups)

    fields = "".join(f"`{c}` {seqs.schema[c].dataType.simpleString()}, " for c in by)
    return seqs.select(*by, seq).mapInArrow(run, f"{fields}key long, n long").groupBy(*by, "key").agg(F.sum("n").alias("n"))


def _by_group(batches, seq: str, by: list[str]):
    """(values of ``by``, codes with a break after each sequence) of the groups of each batch."""
    for b in batches:
        own: dict[tuple, list] = {}
        for s, *group in zip(b.column(seq), *(b.column(c).to_pylist() for c in by), strict=True):
            if s.is_valid:
                own.setdefault(tuple(group), []).append(s.as_buffer().to_pybytes())
        for group, data in own.items():
            yield group, dna.CODES[np.frombuffer(b"N".join(data), np.uint8)]


def _dense(parts, k: int, is_canonical: bool):
    """(group, keys, counts) of a task's (group, codes): those of a group come once, unless there are more than ``TABLES`` groups or ``FULL``
    windows. Forward k-mers are counted; they meet their reverse complements once a table is done."""
    tables: dict[tuple, list] = {}

    def done(table):
        keys = np.flatnonzero(table).astype(np.uint64)
        if is_canonical:
            other = dna.reverse_complement_keys(keys, k)
            up = keys > other
            table[other[up]] += table[keys[up]]
            table[keys[up]] = 0
            keys = np.flatnonzero(table).astype(np.uint64)
        return keys, table[keys].astype(np.int64)

    for group, codes in parts:
        for _, part in dna.passes(codes, k):
            own = np.sort(dna.packed_windows(part, k, False)[1].astype(np.uint32))
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
            keys, n = own[first], np.diff(np.append(first, len(own)))
            if group not in tables and len(tables) == TABLES:
                keys = keys.astype(np.uint64)
                if is_canonical:
                    keys = np.minimum(keys, dna.reverse_complement_keys(keys, k))
                yield group, *_summed(np.zeros(len(keys), np.int8), keys, n, 1)[1:]
                continue
            table = tables.setdefault(group, [None, 0])
            if table[0] is None:
                table[0] = np.zeros(4**k, np.uint32)
            table[0][keys] += n.astype(np.uint32)
            table[1] += len(own)
            if table[1] + dna.PASS_BASES >= FULL:
                yield group, *done(tables.pop(group)[0])
    while tables:
        group, table = tables.popitem()
        yield group, *done(table[0])


def _dense_counts(seqs: DataFrame, parts, by: list[str], kinds: list, k: int, is_canonical: bool, below: int | None = None) -> DataFrame:
    """(*by, key, n): tasks send blocks of counters, six bytes a key, and numpy adds them up; ``parts`` gives (group, codes) of the batches
    of ``seqs``."""
    from pyspark.sql.pandas.types import to_arrow_type

    arrow, block = [to_arrow_type(t) for t in kinds], BLOCK

    def run(batches):
        for group, keys, n in _dense(parts(batches), k, is_canonical):
            if below is not None:
                near = dna.finalize(keys) <= np.uint64(below)
                keys, n = keys[near], n[near]
            if not len(keys):
                continue
            blocks = (keys // np.uint64(block)).astype(np.int32)
            first = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1]))
            low, n = (keys % np.uint64(block)).astype("<u2"), n.astype("<u4")
            data = [low[i:j].tobytes() + n[i:j].tobytes() for i, j in zip(first, [*first[1:], len(keys)], strict=True)]
            own = [pa.array([v] * len(data), t) for v, t in zip(group, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(blocks[first]), pa.array(data, pa.binary())], [*by, "_block", "_data"])

    def add(t):
        total = np.zeros(block, np.int64)
        for x in t.column("_data"):
            x = x.as_buffer()
            m = len(x) // 6
            total[np.frombuffer(x, "<u2", m)] += np.frombuffer(x, "<u4", m, 2 * m)
        at = np.flatnonzero(total)
        own = [t.column(c).combine_chunks().take(pa.array(np.zeros(len(at), np.int64))) for c in by]
        return pa.table([*own, pa.array(t.column("_block")[0].as_py() * block + at), pa.array(total[at])], [*by, "key", "n"])

    fields = "".join(f"`{c}` {t.simpleString()}, " for c, t in zip(by, kinds, strict=True))
    return seqs.mapInArrow(run, f"{fields}_block int, _data binary").groupBy(*by, "_block").applyInArrow(add, f"{fields}key long, n long")


def chunked_counts(seqs: DataFrame, k: int, sizes: list[int], seq: str = "seq") -> DataFrame:
    """(size, key, n), k at most 12: counts of the canonical k-mers of the sequences when cut into chunks of each size (see ``dna.chunks``)."""
    from pyspark.sql.types import IntegerType

    def parts(batches):
        for b in batches:
            codes = [dna.CODES[np.frombuffer(s.as_buffer(), np.uint8)] for s in b.column(seq) if s.is_valid and len(s.as_buffer())]
            for size in sizes:
                held: list[np.ndarray] = []
                for i, c in enumerate(codes, 1):
                    held.append(dna.cut_codes(c, k, size))
                    if i == len(codes) or sum(map(len, held)) >= dna.PASS_BASES:
                        yield (size,), np.concatenate(held)
                        held = []

    return _dense_counts(seqs.select(seq), parts, ["size"], [IntegerType()], k, True)


#: Bases of the minimizers that k-mers are dealt by, the bins they go to, and pieces that a task holds.
MINIMIZER, BINS, PIECES = 10, 1024, 1 << 21
#: k-mers that are sorted at once, and bases of a pass (what it makes stays in a core's cache).
AT_ONCE, SHORT_PASS = 1 << 22, 1 << 16


def _pieces(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins, words, k-mers) of the pieces into which a pass of codes falls: valid windows in a row that share a bin, together at most 31 bases.

    A word has the bases from its top, two bits each, then one bit for their end. The bin comes from the least hash of a k-mer's canonical
    ``MINIMIZER``-mers: the same for a k-mer and its reverse complement, wherever they stand.
    """
    m = len(codes) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint16), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = min(MINIMIZER, k)
    two = (codes & 3).astype(np.uint32)
    wide = dna.packed_all(np.concatenate((two, np.zeros(31, np.uint32))), 16, np.uint32)  # 16 bases from each place on
    h = wide[: len(codes) - size + 1] >> np.uint32(32 - 2 * size)
    h = np.minimum(h, dna.packed_all((np.uint32(3) - two)[::-1], size, np.uint32)[::-1])
    h = h * np.uint32(0x9E3779B1)
    h = (h ^ h >> np.uint32(15)) * np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    have, want = 1, k - size + 1  # the least of each ``want`` in a row, by doubling
    while have < want:
        step = min(have, want - have)
        h = np.minimum(h[: len(h) - step], h[step:])
        have += step
    bins = ((h * np.uint32(0xC2B2AE35)) >> np.uint32(16)).astype(np.uint16) % np.uint16(BINS)
    valid = dna.valid_starts(codes, k)
    most = 31 - k + 1
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (bins[1:] != bins[:-1])
    stop = valid.copy()
    stop[:-1] &= ~valid[1:] | new[1:]
    first, last = np.flatnonzero(new), np.flatnonzero(stop)
    cuts = -(-(last + 1 - first) // most)
    nth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    at = np.repeat(first, cuts) + nth * most
    n = np.minimum(most, np.repeat(last + 1, cuts) - at)
    used = (2 * (n + k - 1)).astype(np.uint64)
    words = wide[at].astype(np.uint64) << np.uint64(32) | wide[at + 16]
    words &= ~np.uint64(0) << (np.uint64(64) - used)
    return bins[at], words | np.uint64(1) << (np.uint64(63) - used), n


def _distinct_in(words: np.ndarray, k: int) -> tuple[int, int]:
    """How many forward and canonical k-mers a bin's pieces hold, in sorts of about ``AT_ONCE`` keys."""
    words = np.sort(words)
    words = words[np.append(True, words[1:] != words[:-1])] if len(words) else words
    end = words & ~words + np.uint64(1)  # the lowest bit
    bases = (64 - np.frexp(end.astype(np.float64))[1].astype(np.int64)) // 2
    n = bases - k + 1
    parts = max(1, -(-int(n.sum()) // AT_ONCE))
    forward = canonical = 0
    for part in range(parts):
        found = []
        for i in range(0, len(words), AT_ONCE):
            w, left = words[i : i + AT_ONCE], n[i : i + AT_ONCE]
            for j in range(31 - k + 1):
                keys = (w[left > j] << np.uint64(2 * j)) >> np.uint64(64 - 2 * k)
                if parts > 1:
                    both = np.minimum(keys, dna.reverse_complement_keys(keys, k))
                    keys = keys[dna.finalize(both) % np.uint64(parts) == part]
                found.append(keys)
        keys = np.sort(np.concatenate(found)) if found else words
        keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
        both = np.sort(np.minimum(keys, dna.reverse_complement_keys(keys, k)))
        forward += len(keys)
        canonical += int((both[1:] != both[:-1]).sum()) + bool(len(both))
    return forward, canonical


def kmer_totals(seqs: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """One row: occurrences, n_forward and n_canonical (distinct), exact, k at most 31.

    k-mers are dealt to ``BINS`` bins by their minimizers, so those in a row travel as one word of up to 31 bases, each word once per
    ``PIECES`` of a task, not as 8 bytes a k-mer; a bin is counted in numpy and only its numbers become rows.
    """
    if not 1 <= k <= 31:
        raise ValueError("k must be 1 to 31")

    def run(batches):
        held, n = [], 0

        def sent():
            bins, words, own = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(bins, kind="stable")
            bins, words, own = bins[order], words[order], own[order]
            first = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
            data = []
            for i, j in zip(first, [*first[1:], len(bins)], strict=True):
                w = np.sort(words[i:j])
                data.append(w[np.append(True, w[1:] != w[:-1])].astype("<u8").tobytes())
            return pa.RecordBatch.from_arrays([pa.array(bins[first].astype(np.int32)), pa.array(np.add.reduceat(own, first)), pa.array(data, pa.binary())], ["_bin", "_n", "_data"])

        for b in batches:
            codes, _, _ = flat_codes(b, seq, [])
            for i in range(0, max(len(codes) - k + 1, 0), SHORT_PASS):
                own = _pieces(codes[i : i + SHORT_PASS + k - 1], k)
                if len(own[0]):
                    held.append(own)
                    n += len(own[0])
                if n >= PIECES:
                    yield sent()
                    held, n = [], 0
        if n:
            yield sent()

    def count(t):
        words = np.concatenate([np.frombuffer(x.as_buffer(), "<u8") for x in t.column("_data")])
        f, c = _distinct_in(words, k)
        return pa.table({"n": [sum(t.column("_n").to_pylist())], "f": [f], "c": [c]})

    own = seqs.select(seq).mapInArrow(run, "_bin int, _n long, _data binary").groupBy("_bin").applyInArrow(count, "n long, f long, c long")
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    return own.agg(total("n", "occurrences"), total("f", "n_forward"), total("c", "n_canonical"))


def in_class(n: str | Column, x: int, y: int) -> Column:
    n = F.col(n) if isinstance(n, str) else n
    return (n > x) & (n < y)


def regions(counted: DataFrame, x: int, y: int) -> DataFrame:
    """One row: f0, total_occ, abundance (x < n < y), ge_x, le_y of (key, n)."""
    n = F.col("n")
    return counted.agg(
        F.count("*").alias("f0"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_occ"),
        F.count_if(in_class(n, x, y)).alias("abundance"),
        F.count_if(n >= x).alias("ge_x"),
        F.count_if(n <= y).alias("le_y"),
    )


def histogram(counted: DataFrame) -> DataFrame:
    """(n, keys): how many keys occur n times."""
    return counted.groupBy("n").agg(F.count("*").alias("keys"))


def bottom_k(counted: DataFrame, key: str, size: int, cap: int | None = None) -> DataFrame:
    """(key, finalizer, n): the ``size`` keys with the smallest finalizers, in unsigned order, with their exact counts
    (at most ``cap``). A top-k per partition and one merge: no global sort."""
    n = F.col("n") if cap is None else F.least("n", F.lit(cap))
    f = counted.select(key, bits.finalize(key).alias("finalizer"), n.alias("n"))
    return f.orderBy(bits.flip("finalizer")).limit(size)


def kmer_sample(seqs: DataFrame, k: int, size: int, cap: int | None = None, is_canonical: bool = True, seq: str = "seq") -> DataFrame:
    """(key, finalizer, n) of the ``size`` k-mer hashes with the smallest finalizers, without a row per k-mer.

    Each task keeps its own ``size`` smallest with their counts, in bounded memory: a key of the overall sample is among
    the smallest of every part that has it, so no count is lost. Counts are summed and the smallest taken again.
    """

    def run(batches):
        f, key, n = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in batches:
            data = [s.as_buffer().to_pybytes() for s in b.column(0) if s.is_valid]
            for _, part in dna.passes(dna.CODES[np.frombuffer(b"N".join(data), np.uint8)], k):
                _, h = dna.rolling_hashes(part, k, is_canonical)
                if len(key) == size:  # the largest kept finalizer only falls
                    h = h[dna.finalize(h) <= f.max()]
                own, count = np.unique(h, return_counts=True)
                key, at = np.unique(np.concatenate((key, own)), return_inverse=True)
                n = np.bincount(at, np.concatenate((n, count)), len(key)).astype(np.int64)
                f = dna.finalize(key)
                if len(key) > size:
                    least = np.argpartition(f, size - 1)[:size]
                    f, key, n = f[least], key[least], n[least]
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    parts = seqs.select(seq).mapInArrow(run, "key long, n long")
    return bottom_k(parts.groupBy("key").agg(F.sum("n").alias("n")), "key", size, cap)


def tau(sample: DataFrame, size: int) -> DataFrame:
    """One row: tau (the largest finalizer of the sample, 0 if it is empty), n_distinct, n_occ, full."""
    return sample.agg(
        F.coalesce(F.max_by("finalizer", bits.flip("finalizer")), F.lit(0)).alias("tau"),
        F.count("*").alias("n_distinct"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_occ"),
        (F.count("*") >= size).alias("full"),
    )


def counted_below(occurrences: DataFrame, key: str, threshold: DataFrame, cap: int | None = None) -> DataFrame:
    """(key, n) of the keys whose finalizer is at most tau; ``threshold``: one row with tau."""
    below = occurrences.crossJoin(F.broadcast(threshold.select("tau"))).where(bits.flip(bits.finalize(key)) <= bits.flip("tau"))
    return counts(below, key, cap)


def mismatches(got: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """One row (n_mismatches): keys with other counts on either side, or only on one."""
    both = got.select(key, F.col("n").alias("_a")).join(expected.select(key, F.col("n").alias("_b")), key, "full_outer")
    return both.agg(F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("n_mismatches"))


def estimate_regions(sample: DataFrame, f0: float | Column, cfg: stats.AbundanceConfig) -> DataFrame:
    """(region, in_sample, m, p_hat, point, sigma, lo, hi, upper) for abundance, ge_x and le_y from a bottom-k sample."""
    n = F.col("n")
    total = sample.agg(
        F.count("*").alias("m"),
        (f0 if isinstance(f0, Column) else F.lit(float(f0))).cast("double").alias("f0"),
        F.map_from_arrays(
            F.array(F.lit("abundance"), F.lit("ge_x"), F.lit("le_y")),
            F.array(F.count_if(in_class(n, cfg.x, cfg.y)), F.count_if(n >= cfg.x), F.count_if(n <= cfg.y)),
        ).alias("inside"),
    )
    rows = total.select("m", "f0", F.explode("inside").alias("region", "in_sample"))
    fields = ("in_sample", "m", "p_hat", "point", "sigma", "lo", "hi", "upper")

    def run(batches):
        for g in batches:
            out = [{"region": r.region, **stats.region(r.f0, int(r.in_sample), int(r.m), cfg)} for r in g.itertuples()]
            yield pd.DataFrame(out, columns=["region", *fields]).astype({"in_sample": "int64", "m": "int64"})

    return rows.mapInPandas(run, "region string, in_sample long, m long, p_hat double, point double, sigma double, lo double, hi double, upper double")


def cap_gap(everything: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: uncapped, capped, lost_percent: occurrences of both enumerations."""
    a, b = everything.agg(F.count("*").alias("uncapped")), kept.agg(F.count("*").alias("capped"))
    lost = F.when(F.col("uncapped") > 0, 100.0 * (F.col("uncapped") - F.col("capped")) / F.col("uncapped")).otherwise(0.0)
    return a.crossJoin(b).withColumn("lost_percent", lost)
