"""Enumeration, hashes and exact abundance against direct computations."""

from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandweave.functions import bits, dna
from strandweave.functions.stats import AbundanceConfig
from strandweave.operators import abundance

M = (1 << 64) - 1


def rotl(x, r):
    r %= 64
    return (x << r | x >> (64 - r)) & M if r else x


def direct_hash(s, canonical=True):
    k, comp = len(s), dict(zip("ACGT", "TGCA", strict=True))
    f = r = 0
    for i, b in enumerate(s):
        f ^= rotl(dna.SEEDS[b], k - 1 - i)
        r ^= rotl(dna.SEEDS[comp[b]], i)
    return min(f, r) if canonical else f


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


@settings(max_examples=60, deadline=None)
@given(st.text("ACGTN", max_size=90), st.sampled_from([1, 4, 8, 21, 31, 32]), st.booleans())
def test_rolling_hash_equals_direct_hash(s, k, canonical):
    starts, h = dna.rolling_hashes(dna.CODES[np.frombuffer(s.encode(), np.uint8)], k, canonical)
    expected = [(i, direct_hash(s[i : i + k], canonical)) for i in range(len(s) - k + 1) if "N" not in s[i : i + k]]
    assert list(zip(starts.tolist(), [int(x) for x in h], strict=True)) == expected


@settings(max_examples=60, deadline=None)
@given(st.text("ACGTN", max_size=90), st.sampled_from([1, 2, 3, 7, 12, 21, 31, 32]))
def test_packed_windows_equal_strings(s, k):
    starts, keys = dna.packed_windows(dna.CODES[np.frombuffer(s.encode(), np.uint8)], k)
    code = lambda w: int(w.translate(str.maketrans("ACGT", "0123")), 4)
    expected = [(i, code(min(w, rc(w)))) for i in range(len(s) - k + 1) if "N" not in (w := s[i : i + k])]
    assert list(zip(starts.tolist(), [int(x) for x in keys], strict=True)) == expected


def test_packed_counts_equal_string_counts(spark):
    rng = np.random.default_rng(2)
    rows = [(g, "".join(rng.choice(list("ACGTN"), 400))) for g in "aabc"] + [("d", None), (None, "ACGTACGTACGT"), ("e", "")]
    df = spark.createDataFrame(rows, "g string, seq string")
    got = {(r.g, r.kmer): r.n for r in abundance.kmer_counts(df, 9, ["g"]).select("g", dna.unpacked("key", 9).alias("kmer"), "n").collect()}
    assert got == Counter((r.g, r.kmer) for r in dna.kmers(df, 9).collect())
    total = {r.key: r.n for r in abundance.kmer_counts(df, 9).collect()}
    assert sum(total.values()) == sum(got.values()) and len(total) == len({k for _, k in got})


@settings(max_examples=50, deadline=None)
@given(st.integers(0, M))
def test_finalizer_is_xxhash64(x):
    assert int(dna.finalize(np.array([x], np.uint64))[0]) == xxhash.xxh64_intdigest(x.to_bytes(8, "little"), 0)


def test_finalizer_column(spark):
    keys = [0, 1, -1, 2**62 + 12345, -(2**63)]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k long").select(bits.finalize("k")).collect()]
    assert [x & M for x in got] == [xxhash.xxh64_intdigest((k & M).to_bytes(8, "little"), 0) for k in keys]


def test_rotations_and_unsigned_order(spark):
    x = -0x123456789ABCDEF
    cols = [bits.rotl(F.col("x"), r) for r in (0, 1, 31, 63)] + [bits.rotr(F.col("x"), 5)]
    got = spark.createDataFrame([(x,)], "x long").select(*cols).first()
    assert [v & M for v in got] == [rotl(x & M, r) for r in (0, 1, 31, 63, -5)]
    rows = spark.createDataFrame([(v,) for v in (-1, 0, 5, -(2**63))], "x long").orderBy(bits.flip("x")).collect()
    assert [r[0] for r in rows] == [0, 5, -(2**63), -1]


@pytest.mark.parametrize("k", [4, 21])
def test_kmers_equal_substrings(spark, k):
    rng = np.random.default_rng(3)
    seqs = {i: "".join(rng.choice(list("ACGTNacgt"), n)) for i, n in enumerate([0, k - 1, k, 255 + k, 256 + k, 3000])}
    df = spark.createDataFrame([*seqs.items(), (99, None)], "id int, seq string")
    got = Counter((r.id, r.pos, r.kmer) for r in dna.kmers(df, k).collect())
    expected = Counter()
    for i, s in seqs.items():
        for p in range(len(s) - k + 1):
            w = s[p : p + k].upper()
            if "N" not in w:
                expected[i, p, min(w, rc(w))] += 1
    assert got == expected


def test_packed_codes_and_projection(spark):
    row = spark.createDataFrame([("ACGT", "Zé9a")], "k string, t string").select(dna.packed("k"), dna.from_text("t"), dna.reverse_complement("k")).first()
    assert tuple(row) == (0b00011011, "CNA", "ACGT")


def cells(counts, width, k=4):
    out = ""
    for kmer, n in counts.items():
        out += (kmer + "N" * (width // 5)) * n
    return out


def test_class_boundaries(spark):
    seq = cells({"AAAA": 2, "AACC": 3, "AAGG": 4, "ACAC": 5, "ACTG": 6}, 40)
    occ = dna.kmers(spark.createDataFrame([(0, seq)], "id int, seq string"), 4)
    got = abundance.regions(abundance.counts(occ, "kmer"), 2, 5).first()
    assert tuple(got) == (5, 20, 2, 5, 4)


def test_two_runs_a_stripe(spark):
    occ = dna.kmers(spark.createDataFrame([(0, "ACGTNNNN" * 5)], "id int, seq string"), 4)
    assert occ.count() == 5
    assert abundance.capped(occ, ["id"]).count() == 3


def test_homopolymer_is_one_key(spark):
    df = spark.createDataFrame([(i, "A" * 20_000) for i in range(4)], "id int, seq string")
    assert [tuple(r) for r in abundance.counts(dna.kmers(df, 31), "kmer", 9).collect()] == [("A" * 31, 9)]


def test_bottom_k_is_exact(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**62), 2**62, 300).tolist()
    rows = [(k,) for i, k in enumerate(keys) for _ in range(i % 7 + 1)]
    counted = abundance.counts(spark.createDataFrame(rows, "key long"), "key")
    sample = abundance.bottom_k(counted, "key", 50)
    order = sorted(keys, key=lambda k: xxhash.xxh64_intdigest((k & M).to_bytes(8, "little"), 0))[:50]
    assert {r.key: r.n for r in sample.collect()} == {k: keys.index(k) % 7 + 1 for k in order}
    t = abundance.tau(sample, 50).first()
    assert t.tau & M == xxhash.xxh64_intdigest((order[-1] & M).to_bytes(8, "little"), 0) and t.n_distinct == 50 and t.full
    below = abundance.counted_below(spark.createDataFrame(rows, "key long"), "key", abundance.tau(sample, 50))
    assert abundance.mismatches(sample.select("key", "n"), below, "key").first()[0] == 0
    empty = abundance.tau(abundance.bottom_k(counted.limit(0), "key", 5), 5).first()
    assert tuple(empty) == (0, 0, 0, False)


def test_estimates_of_a_full_sample_are_exact(spark):
    counted = spark.createDataFrame([(i, i % 6 + 1) for i in range(120)], "key long, n long")
    cfg = AbundanceConfig(x=1, y=4, sample=1000)
    got = {r.region: r for r in abundance.estimate_regions(abundance.bottom_k(counted, "key", 1000), 120, cfg).collect()}
    assert (got["abundance"].point, got["ge_x"].point, got["le_y"].point) == (40, 120, 80)
    assert all(r.lo <= r.point <= r.hi and r.upper >= r.point for r in got.values())


def test_passes_change_nothing_and_bound_memory(spark, monkeypatch):
    """The same registers, counts and sample whatever the size of a pass; a large batch takes a bounded multiple of its bytes."""
    import tracemalloc

    from strandweave.operators import abundance, sketch

    rng = np.random.default_rng(8)
    rows = [(i % 3, "".join(rng.choice(list("ACGTN"), 700, p=[0.24, 0.24, 0.24, 0.24, 0.04]))) for i in range(40)] + [(1, None), (2, "ACG"), (0, "")]
    df = spark.createDataFrame(rows, "g int, seq string").coalesce(2)

    def all_of():
        regs = sketch.kmer_registers(df, 21, ["g"], 10)
        counts = abundance.kmer_counts(df, 5, ["g"])
        return [sorted(map(tuple, x.collect())) for x in (regs, counts, abundance.kmer_sample(df, 21, 50))]

    whole = all_of()
    for size in (64, 1000):
        monkeypatch.setattr(dna, "PASS_BASES", size)
        codes = dna.CODES[np.frombuffer(("N".join(s or "" for _, s in rows)).encode(), np.uint8)]
        parts = [dna.rolling_hashes(c, 21) for _, c in dna.passes(codes, 21)]
        assert np.array_equal(np.concatenate([h for _, h in parts]), dna.rolling_hashes(codes, 21)[1])
        firsts = [f for f, _ in dna.passes(codes, 21)]
        assert np.array_equal(np.concatenate([s + f for (s, _), f in zip(parts, firsts, strict=True)]), dna.rolling_hashes(codes, 21)[0])
    monkeypatch.undo()
    assert whole == all_of()
    codes = rng.integers(0, 4, 1 << 25, dtype=np.uint8)
    tracemalloc.start()
    for _, part in dna.passes(codes, 31):
        dna.finalize(dna.rolling_hashes(part, 31)[1])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    keys = spark.createDataFrame([(int(k),) for k in dna.packed_windows(codes[:2000], 21, False)[1]], "key long")
    got = [r[0] for r in keys.select(dna.reverse_complement_key("key", 21)).collect()]
    comp = dna.packed_windows((3 - codes[:2000])[::-1].copy(), 21, False)[1][::-1]
    assert got == comp.astype(np.int64).tolist()
