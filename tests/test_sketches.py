"""Sketches, statistics, files, streams and the front door."""

import gzip
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandweave import api, cli
from strandweave.functions import stats
from strandweave.operators import pairwise, sketch
from strandweave.sources import hll, sequences
from strandweave.streaming.sketches import BottomKStream, RegisterStream


def keys(spark, low, high, item=None):
    df = spark.range(low, high).select(F.col("id").alias("key"))
    return df if item is None else df.withColumn("item", F.lit(item))


def as_dict(df, *by):
    return {tuple(r[c] for c in (*by, "idx")): r.rho for r in df.collect()}


@pytest.mark.parametrize(("n", "p"), [(100, 10), (50_000, 12), (200_000, 14)])
def test_estimate_within_four_sigma(spark, n, p):
    got = sketch.estimates(sketch.registers(keys(spark, 0, n), "key", p=p), p=p).first()[0]
    assert abs(got - n) <= 4 * stats.hll_error(p) * n + 1


def test_empty_sketch_estimates_zero(spark):
    s = sketch.Sketch(sketch.registers(keys(spark, 0, 0), "key", p=8), 8, k=21)
    assert s.estimate() == 0 and (s & s.clone()) == 0


def test_merge_equals_sketch_of_both(spark):
    a, b = keys(spark, 0, 5000), keys(spark, 3000, 9000)
    merged = sketch.merged(sketch.registers(a, "key", p=10).unionByName(sketch.registers(b, "key", p=10)))
    assert as_dict(merged) == as_dict(sketch.registers(a.union(b), "key", p=10))


def test_numpy_registers_equal_column_registers(spark):
    from strandweave.functions import dna

    rng = np.random.default_rng(5)
    rows = [(g, "".join(rng.choice(list("ACGTN"), 700, p=[0.24, 0.25, 0.25, 0.25, 0.01]))) for g in "aabbc"]
    df = spark.createDataFrame([*rows, ("d", None), ("e", "ACG")], "g string, seq string")
    hashed = []
    for g, s in rows:
        _, h = dna.rolling_hashes(dna.CODES[np.frombuffer(s.encode(), np.uint8)], 21)
        hashed += [(g, int(x)) for x in h.view(np.int64)]
    expected = sketch.registers(spark.createDataFrame(hashed, "g string, key long"), "key", ["g"], 9)
    assert as_dict(sketch.kmer_registers(df, 21, ["g"], 9), "g") == as_dict(expected, "g")


def test_mismatches_are_errors(spark):
    regs = sketch.registers(keys(spark, 0, 10), "key", p=12)
    a = sketch.Sketch(regs, 12, k=21)
    for other in (sketch.Sketch(regs, 12, k=31), sketch.Sketch(regs, 13, k=21), sketch.Sketch(regs, 12, False, k=21)):
        with pytest.raises(ValueError):
            a | other
    with pytest.raises(TypeError):
        a.merge(3)
    with pytest.raises(ValueError):
        sketch.check(7, 14)


def test_pairwise_equals_unions(spark):
    items = {i: set(range(i * 1000, i * 1000 + 4000)) for i in range(5)}
    df = spark.createDataFrame([(i, k) for i, s in items.items() for k in s], "item int, key long")
    p = 12
    got = {(r.i, r.j): r.jaccard for r in pairwise.jaccard(sketch.registers(df, "key", ["item"], p), "item", p).collect()}
    assert set(got) == set(combinations(range(5), 2))
    for (i, j), x in got.items():
        assert abs(x - len(items[i] & items[j]) / len(items[i] | items[j])) < 0.1
    exact = {(r.i, r.j): (r.shared, r.jaccard) for r in pairwise.exact_jaccard(df, "item", "key").collect()}
    assert exact == {(i, j): (n, n / len(items[i] | items[j])) for i, j in combinations(range(5), 2) if (n := len(items[i] & items[j]))}


def test_inclusion_exclusion(spark):
    rows = [(i, k) for i in range(3) for k in [*range(20_000), *range(100_000 * (i + 1), 100_000 * (i + 1) + 15_000)]]
    regs = sketch.registers(spark.createDataFrame(rows, "item int, key long"), "key", ["item"], 14)
    got = sketch.intersect_many(regs, "item", [0, 1, 2], 14).first()[0]
    assert abs(got - 20_000) < 20_000 * stats.intersection_tolerance(14, 65_000, 20_000)
    with pytest.raises(ValueError):
        sketch.intersect_many(regs, "item", [], 14)


def test_beta_and_bounds():
    assert stats.betai(1, 1, 0.3) == pytest.approx(0.3, abs=1e-12)
    assert stats.betai(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-10)
    assert stats.clopper_pearson_upper(1, 10, 0.05) == pytest.approx(0.3941633024, abs=1e-9)
    assert stats.clopper_pearson_upper(0, 10, 0.05) == pytest.approx(1 - 0.05**0.1, abs=1e-12)
    assert stats.clopper_pearson_upper(5, 5, 0.05) == 1 and stats.clopper_pearson_upper(0, 0, 0.05) == 1
    for p in (0.01, 0.5, 0.99):
        assert stats.betai(40, 7, stats.beta_quantile(p, 40, 7)) == pytest.approx(p, abs=1e-10)
    assert stats.normal_quantile(0.975) == pytest.approx(1.959963985, abs=1e-8)
    assert stats.normal_quantile(0) == -1e308 and stats.normal_quantile(1) == 1e308


def test_upper_bound_covers():
    rng = random.Random(7)
    cfg = stats.AbundanceConfig(z=2.326347874)
    held = sum(stats.region(1e6, sum(rng.random() < 0.02 for _ in range(500)), 500, cfg)["upper"] >= 0.02e6 for _ in range(300))
    assert held >= 294
    assert set(stats.region(100, 0, 0, cfg).values()) == {0.0}


def test_sketch_files(spark, tmp_path):
    regs = sketch.registers(keys(spark, 0, 3000), "key", p=9)
    s = sketch.Sketch(regs, 9, False, k=25)
    path = str(tmp_path / "a.hll")
    s.write(path)
    back = api.read(path)
    assert as_dict(back.registers) == as_dict(regs) and (back.k, back.precision, back.canonical) == (25, 9, False)
    data = bytearray(open(path, "rb").read())
    assert len(data) == 48 + 4 * 512
    data[8], data[40] = 1, 0
    assert hll.parse_header(bytes(data)).canonical  # version 1 had no flag
    for at, value in ((0, 0), (8, 9), (16, 21), (20, 1), (24, 7), (32, 7), (40, 2)):
        bad = bytearray(open(path, "rb").read())
        bad[at] = value
        if at != 16:
            with pytest.raises(ValueError):
                hll.decode(bytes(bad))
    with pytest.raises(ValueError):
        hll.decode(bytes(data[:-1]))


def fasta(path, records, opener=open, width=70):
    with opener(path, "wt") as f:
        for i, s in enumerate(records):
            f.write(f">r{i}\n" + "".join(s[j : j + width] + "\r\n" for j in range(0, len(s), width)))


def windows(records, k):
    return {min(s[i : i + k], s[i : i + k][::-1].translate(str.maketrans("ACGT", "TGCA"))) for s in records for i in range(len(s) - k + 1)}


@pytest.fixture(scope="module")
def records():
    rng = random.Random(11)
    return ["".join(rng.choices("ACGT", k=n)) for n in (900, 20, 2500, 1)]


def test_readers_agree(spark, tmp_path, records):
    from strandweave.functions import dna

    fasta(tmp_path / "a.fa", records)
    fasta(tmp_path / "b.fa.gz", records, gzip.open)
    data = open(tmp_path / "a.fa", "rb").read()
    cut = data.index(b">r2")
    (tmp_path / "c.fa.gz").write_bytes(gzip.compress(data[:cut]) + gzip.compress(data[cut:]))
    with open(tmp_path / "d.fq", "w") as f:
        f.writelines(f"@r{i}\n{s}\n+\n{'@' * len(s)}\n" for i, s in enumerate(records))
    import zstandard

    (tmp_path / "e.fa.zst").write_bytes(zstandard.compress(data[:cut]) + zstandard.compress(data[cut:]))
    expected = windows(records, 21)
    for name in ("a.fa", "b.fa.gz", "c.fa.gz", "d.fq", "e.fa.zst"):
        for row in (40, 1 << 16):
            rows = sequences.read_sequences(spark, str(tmp_path / name), 21, row)
            got = dna.kmers(rows.select("seq"), 21)
            assert got.count() == sum(max(0, len(s) - 20) for s in records), (name, row)
            assert {r.kmer for r in got.collect()} == expected, (name, row)
    # byte ranges, whatever they cut
    for split in (97, 300, 1000):
        got = dna.kmers(sequences.read_sequences(spark, str(tmp_path / "a.fa"), 21, 64, split).select("seq"), 21)
        assert got.count() == sum(max(0, len(s) - 20) for s in records), split
        assert {r.kmer for r in got.collect()} == expected, split


def test_unknown_format_is_an_error(spark, tmp_path):
    (tmp_path / "x.fa").write_text("hello\n")
    (tmp_path / "empty.fa").write_text("\n \n")
    with pytest.raises(Exception, match="neither FASTA"):
        sequences.read_sequences(spark, str(tmp_path / "x.fa")).count()
    assert sequences.read_sequences(spark, str(tmp_path / "empty.fa")).count() == 0


def test_front_door(spark, tmp_path, records, capsys):
    a, b = str(tmp_path / "a.fa"), str(tmp_path / "b.fa")
    fasta(a, records[:2])
    fasta(b, records[2:])
    n = [len(windows(r, 21)) for r in (records[:2], records[2:])]
    assert api.estimate(a, k=21) == pytest.approx(n[0], rel=0.03)
    assert [s.estimate() for s in api.sketch_many([b, a], k=21)] == pytest.approx(n[::-1], rel=0.03)
    assert api.estimate_union([a, b], k=21) == pytest.approx(sum(n), rel=0.03)
    assert api.intersect_estimate(api.sketch(a, k=21), api.sketch(b, k=21)) <= 0.05 * sum(n)
    out = api.sketch_to_dir([a, b], output_dir=tmp_path / "out", k=21)
    assert api.read(out[a]).estimate() == out.estimates[a] and out.union_estimate == api.estimate_union([a, b], k=21)
    with pytest.raises(ValueError, match="share"):
        api.sketch_to_dir([a, str(tmp_path / "x" / "a.fa")], output_dir=tmp_path / "o2", k=21)
    with pytest.raises(ValueError):
        api.sketch_union([], k=21)
    capsys.readouterr()
    assert cli.main(["sketch", "--k", "21", "--per-genome", a, b]) == 0
    lines = capsys.readouterr().out.split("\n")
    assert [x.split("\t")[0] for x in lines if x] == [a, b, "UNION"]
    assert cli.main(["pairwise", "--sketches-dir", str(tmp_path / "out"), "--threshold", "-1"]) == 0
    assert len(capsys.readouterr().out.strip().split("\n")) == 1
    with pytest.raises(SystemExit) as e:
        cli.main(["sketch", "--k", "99", a])
    assert e.value.code == 2
    assert cli.main(["sketch", "--k", "21", str(tmp_path / "none.fa")]) == 1


def test_empty_sketches_are_sketches(spark, tmp_path, capsys):
    full = sketch.registers(spark.range(3000).select(F.lit(1).alias("g"), F.col("id").alias("key")), "key", ["g"], 14).drop("g")
    for name, regs in (("a", full), ("b", full.limit(0)), ("c", full.limit(0)), ("d", full)):
        hll.write_sketch(sketch.Sketch(regs, 14, k=21), str(tmp_path / f"{name}.hll"))
    assert cli.main(["pairwise", "--sketches-dir", str(tmp_path), "--threshold", "0"]) == 0
    lines = [x.split("\t") for x in capsys.readouterr().out.strip().split("\n")]
    got = {(i.rsplit("/", 1)[1][0], j.rsplit("/", 1)[1][0]): float(x) for i, j, x in lines}
    assert got == {("a", "b"): 0, ("a", "c"): 0, ("a", "d"): 1, ("b", "d"): 0, ("c", "d"): 0}


@pytest.mark.parametrize("n", [1, 2, 3, 14, 29, 30, 57, 113, 200])
def test_survey_median_is_the_upper_one(spark, n):
    files = spark.range(n).selectExpr("concat('f', id, '.fa') AS path", "id * 7 % 1009 AS size")
    assert sequences.survey(files).first().median == sorted(i * 7 % 1009 for i in range(n))[n // 2]


def test_sample_of_sequences(spark, tmp_path, records, capsys):
    """A sample kept small in every task equals the sample of all counts."""
    from strandweave.functions import dna
    from strandweave.operators import abundance

    df = spark.createDataFrame([(s * 2,) for s in records] + [(records[0],), (None,), ("AC",)], "seq string").repartition(3)
    hashed = []
    for r in df.collect():
        _, h = dna.rolling_hashes(dna.CODES[np.frombuffer((r.seq or "").encode(), np.uint8)], 21)
        hashed += [(int(x),) for x in h.view(np.int64)]
    expected = abundance.bottom_k(abundance.counts(spark.createDataFrame(hashed, "key long"), "key"), "key", 200, 2)
    assert {tuple(r) for r in abundance.kmer_sample(df, 21, 200, 2).collect()} == {tuple(r) for r in expected.collect()}
    fasta(tmp_path / "a.fa", records)
    n = len(windows(records, 21))
    got = {r.region: r for r in api.abundance([tmp_path / "a.fa"], k=21, x=1, y=4, f0=n).collect()}
    assert got["ge_x"].point == n and got["abundance"].point == 0
    report = api.sample_report([tmp_path / "a.fa"], k=21).first()
    assert (report.n_distinct, report.full) == (n, False)
    capsys.readouterr()
    assert cli.main(["abundance", "--k", "21", str(tmp_path / "a.fa")]) == 0
    assert len(capsys.readouterr().out.strip().split("\n")) == 3


def test_manifest_survey_and_names(spark, tmp_path):
    (tmp_path / "m.txt").write_text("a.fa  \n\n# no\nb.fq.gz\t\n")
    assert sequences.read_manifest(spark, str(tmp_path / "m.txt")) == ["a.fa", "b.fq.gz"]
    files = spark.createDataFrame([("a.fa", 10), ("b.gz", 5), ("c.zst", 1), ("d", 30)], "path string, size long")
    assert tuple(sequences.survey(files).first()) == (4, 20, 30, 68)
    assert tuple(sequences.survey(files.limit(0)).first()) == (0, None, None, 0)
    assert sequences.stem("/x/a.fa.gz") == "a.fa"
    (tmp_path / "h.txt").write_text("1 5\n 2\t7 \n")
    assert sorted(map(tuple, sequences.read_histogram(spark, str(tmp_path / "h.txt")).collect())) == [(1, 5), (2, 7)]


def test_streams_equal_batches(spark, tmp_path):
    folder = str(tmp_path / "in")
    for i in range(3):
        spark.range(i * 400, i * 400 + 700).select((F.col("id") % 900).alias("key"), (F.col("id") % 2).cast("string").alias("g")).coalesce(1).write.mode("append").parquet(folder)
    everything = spark.read.parquet(folder)
    stream = lambda: spark.readStream.schema(everything.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    r = RegisterStream(str(tmp_path / "r"), "key", ["g"], 8, "g string")
    r.start(stream(), str(tmp_path / "rc")).awaitTermination()
    assert as_dict(r.state.latest(spark), "g") == as_dict(sketch.registers(everything, "key", ["g"], 8), "g")
    b = BottomKStream(str(tmp_path / "b"), "key", 40)
    b.start(stream(), str(tmp_path / "bc")).awaitTermination()
    from strandweave.operators import abundance

    expected = abundance.bottom_k(abundance.counts(everything, "key"), "key", 40)
    assert {tuple(x) for x in b.state.latest(spark).collect()} == {(x.key, x.n) for x in expected.collect()}
    b.process(everything.limit(0), 2)  # a batch that runs again
    assert b.state.latest(spark).count() == 40
