"""Queries on k-mers do their work without a row per occurrence, and count what plain loops count."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from strandweave.functions import dna
from strandweave.operators import abundance
from strandweave.plans.catalogue import QUERIES

COMPLEMENT = str.maketrans("ACGT", "TGCA")


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    """(folder, rows): repeated and null ids, null and short texts, breaks, runs of one base, letters outside ASCII."""
    rng = np.random.default_rng(4)
    text = lambda n: "".join(rng.choice(list("abcdetzAG 1.é"), n, p=[0.1] * 9 + [0.05, 0.02, 0.02, 0.01]))
    rows = [(i, text(int(n)), "en" if i % 2 else "fr") for i, n in enumerate((0, 11, 12, 20, 21, 300, 900, 2500))]
    rows += [(5, text(400), "en"), (5, text(40), None), (None, text(200), "fr"), (None, text(90), "fr"), (90, None, "en"), (91, "a" * 3000, "de"), (92, "ab1cdefgh22ijklmnopq3" * 30, "de")]
    folder = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder, rows


def bases(text):
    kept = "".join(c for c in text or "" if c.isascii() and c.isalnum()).lower()
    return kept.translate(str.maketrans(dna.LETTERS, dna.BASES))


def windows(text, k):
    """(pos, forward, canonical)."""
    s = bases(text)
    return [(i, w, min(w, w[::-1].translate(COMPLEMENT))) for i in range(len(s) - k + 1) if "N" not in (w := s[i : i + k])]


def run(spark, docs, name):
    """Rows of a query whose plan makes no row per window of a text."""
    df = QUERIES[name](spark, docs[0])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "substr" not in plan and "regexp_replace" not in plan, plan
    return {tuple(r) for r in df.collect()}


def counted(rows, k):
    return Counter(c for _, t, _ in rows for _, _, c in windows(t, k))


def test_chunks_of_any_size_without_a_row_per_window(spark, docs, monkeypatch):
    n = counted(docs[1], 12)
    assert run(spark, docs, "chunk_overlap_invariance") == {(size, n.total(), len(n)) for size in (64, 256, 1000)}
    codes = dna.CODES[np.frombuffer(b"ACGTNACGTTGCAACGT", np.uint8)]
    for size in (1, 3, 4, 50):
        assert Counter(dna.packed_windows(dna.cut_codes(codes, 4, size), 4)[1].tolist()) == Counter(dna.packed_windows(codes, 4)[1].tolist())
    assert not len(dna.cut_codes(codes[:3], 4, 2))


def test_tables_of_counters_that_fill_up_or_are_too_many(spark, monkeypatch):
    rng = np.random.default_rng(6)
    parts = [((g,), rng.integers(0, 5, 500, dtype=np.uint8)) for g in (1, 2, None, 4, 5, 6, 1, 5)]
    expected = Counter((g, x) for (g,), c in parts for x in dna.packed_windows(c, 5)[1].tolist())
    for full in (abundance.FULL, 600):
        monkeypatch.setattr(abundance, "FULL", full)
        monkeypatch.setattr(dna, "PASS_BASES", 100)
        got = Counter()
        for (g,), keys, n in abundance._dense(iter(parts), 5, True):
            got.update({(g, x): m for x, m in zip(keys.tolist(), n.tolist(), strict=True)})
        assert got == expected


def test_capped_scan_without_a_row_per_window(spark, docs, tmp_path):
    single = spark.read.parquet(f"{docs[0]}/documents.parquet").where("doc_id != 5")
    single.write.parquet(f"{tmp_path}/documents.parquet")
    expected = {tuple(r) for r in abundance.cap_gap(*(x(dna.kmers(single.select("doc_id", dna.from_text("text").alias("seq")), 8)) for x in (lambda o: o, lambda o: abundance.capped(o, ["doc_id"])))).collect()}
    assert {(a, b) for a, b, _ in run(spark, (str(tmp_path), []), "kmer_capped_gap")} == {(a, b) for a, b, _ in expected}
    # rows that share an id are one sequence
    own = defaultdict(list)
    for i, t, _ in docs[1]:
        own[i] += [p for p, _, _ in windows(t, 8)]
    kept = 0
    for pos in own.values():
        stripes = defaultdict(list)
        for p in sorted(pos):
            stripes[p // 32].append(p)
        for of in stripes.values():
            runs = np.cumsum(np.append(False, np.diff(of) > 1))
            kept += int((runs < 2).sum())
    n = sum(map(len, own.values()))
    assert kept < n and {tuple(r) for r in QUERIES["kmer_capped_gap"](spark, docs[0]).collect()} == {(n, kept, round(100 * (n - kept) / n, 6))}


@pytest.mark.parametrize("k", [1, 9, 21, 31])
def test_bins_of_minimizers_hold_every_kmer_once(k, monkeypatch):
    rng = np.random.default_rng(k)
    codes = rng.integers(0, 4, 6000, dtype=np.uint8)
    codes = np.concatenate((codes, [4], codes[1000:3000], [4, 4], 3 - codes[:2500][::-1], np.zeros(900, np.uint8))).astype(np.uint8)
    forward, canonical = (dna.packed_windows(codes, k, c)[1] for c in (False, True))
    bins, words, n = abundance._pieces(codes, k)
    for at_once in (1 << 22, 700):
        monkeypatch.setattr(abundance, "AT_ONCE", at_once)
        got = np.array([abundance._distinct_in(words[bins == b], k) for b in np.unique(bins)]).sum(0)
        assert (n.sum(), *got) == (len(forward), len(np.unique(forward)), len(np.unique(canonical)))


def test_exact_distinct_shuffles_words_not_kmers(spark, docs, monkeypatch):
    all_ = [w for _, t, _ in docs[1] for w in windows(t, 21)]
    expected = {(len(all_), len({f for _, f, _ in all_}), len({c for _, _, c in all_}))}
    assert run(spark, docs, "kmer_exact_distinct") == expected
    monkeypatch.setattr(abundance, "SHORT_PASS", 64)
    monkeypatch.setattr(abundance, "PIECES", 100)
    assert run(spark, docs, "kmer_exact_distinct") == expected
    # a long run of one base is one word per task
    bins, words, n = abundance._pieces(np.zeros(20_000, np.uint8), 21)
    assert len(np.unique(words)) <= 2 and n.sum() == 19_980


def test_fastq_records_without_expressions_per_base(spark, docs, tmp_path):
    n = counted(docs[1], 21)
    assert run(spark, docs, "fastq_mod4") == {(n.total(), len(n))}
    spark.read.parquet(f"{docs[0]}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert run(spark, (str(tmp_path), []), "fastq_mod4") == {(0, 0)}


def test_fasta_records_without_expressions_per_base(spark, docs):
    n = counted(docs[1], 21)  # documents without an id among them
    assert run(spark, docs, "fasta_concat") == {(n.total(), len(n))}


def test_distinct_kmers_of_a_document_without_a_shuffle_of_them(spark, docs):
    own = defaultdict(set)
    for i, t, _ in docs[1]:
        own[i] |= {c for _, _, c in windows(t, 12)}
    assert run(spark, docs, "kmer_canonical") == {(i, len(x), min(x), max(x)) for i, x in own.items() if x}


def test_second_pass_without_a_row_per_window(spark, docs):
    assert run(spark, docs, "retained_vs_truth") == {(0,)}


def test_counts_below_tau_in_tables(spark, docs):
    n = counted(docs[1], 12)
    key = {int(c.translate(str.maketrans("ACGT", "0123")), 4): m for c, m in n.items()}
    order = np.array(sorted(key), np.uint64)
    least = order[np.argsort(dna.finalize(order))][:1000].tolist()
    assert len(key) > 1000 and run(spark, docs, "bottomk_counted_below_tau") == {(x, min(key[x], 5)) for x in least}


@pytest.mark.parametrize("name", ["abundance_upper", "abundance_estimate"])
def test_estimates_read_counts_that_were_made_once(spark, docs, name):
    plan = QUERIES[name](spark, docs[0])._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan  # the counts are read from where they were written
    assert len(run(spark, docs, name)) == 3


def test_windows_of_a_document_without_a_row_per_window(spark, docs):
    groups, valid = Counter(), Counter()
    for i, t, _ in docs[1]:
        groups[i, max(len(bases(t)) - 20, 0)] += 1
        valid[i] += len(windows(t, 21))
    assert run(spark, docs, "kmer_windows") == {(i, n, m * valid[i] if i is not None else 0) for (i, n), m in groups.items()}


def test_jaccard_of_languages_in_tables(spark, docs):
    own = defaultdict(set)
    for _, t, lang in docs[1]:
        own[lang] |= {c for _, _, c in windows(t, 12)}
    names = sorted(x for x in own if x)
    expected = {(i, j, len(own[i] & own[j]), round(len(own[i] & own[j]) / len(own[i] | own[j]), 9)) for i in names for j in names if i < j and own[i] & own[j]}
    assert expected <= run(spark, docs, "pairwise_jaccard_exact")


def test_shared_kmers_of_two_languages_in_tables(spark, docs):
    own = {x: {c for _, t, lang in docs[1] if lang == x for _, _, c in windows(t, 12)} for x in ("en", "fr")}
    assert run(spark, docs, "kmer_exact_intersection") == {(len(own["en"] & own["fr"]),)}


def test_counts_by_language_in_tables(spark, docs):
    own = defaultdict(Counter)
    for _, t, lang in docs[1]:
        own[lang].update(c for _, _, c in windows(t, 12))
    assert run(spark, docs, "kmer_distinct_by_lang") == {(lang, n.total(), len(n)) for lang, n in own.items() if n}
