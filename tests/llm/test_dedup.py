"""Near-duplicates, repeated passages and near vectors against brute force, on small and awkward tables."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandweave.llm import _runs, _words, components, crosspolytope, minhash, substring

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOC = "doc_id long, text string, lang string, source string, n_chars long, text_key string, v int"


def docs(spark, texts, ids=None):
    """A documents table with extra columns, some named as the operators' own."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, "s", 1, "x", 7) for i, t in zip(ids, texts, strict=True)], DOC)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))


def shingles(t, k):
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def union_find(n, edges):
    p = list(range(n))

    def find(i):
        while p[i] != i:
            i = p[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def prose(rng, n, vocab=4000):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


def edited(rng, text, share):
    return " ".join(f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split())


ODD = ["", None, "  \t\n", "one", "One", "two words", "é ü ñ", "\x00 \x1f", "😀 b c d e", "a b c", "A  b\nC"]


def test_words_equal_regex():
    texts = [*ODD, "x" * 5000 + " y", "a\x0bb\x0cc\rd", "Ümlaut ÀB"]
    w = _words.words_of(texts)
    raw = w.data.tobytes()
    got = [raw[b:e].decode() for b, e in zip(w.begin, w.end, strict=True)]
    assert [g.translate(LOW) for g in got] == [x for t in texts for x in words(t)]
    assert w.counts.tolist() == [len(words(t)) for t in texts]
    # equal words, equal hashes, wherever they stand
    by = {}
    for h, g in zip(w.hash.tolist(), got, strict=True):
        assert by.setdefault(g.translate(LOW), h) == h
    assert len(set(by.values())) == len(by)


def test_words_of_long_texts_in_parts(monkeypatch):
    rng = random.Random(9)
    texts = [*ODD, prose(rng, 400), "y" * 9000, "", prose(rng, 2), " " * 700 + "end", None]
    for kind in ("blank", "alnum", "exact"):
        whole = _words.words_of(texts, kind)
        for size in (1, 37, 500):
            monkeypatch.setattr(_words, "SEGMENT", size)
            part = _words.words_of(texts, kind)
            assert all(np.array_equal(getattr(part, x), getattr(whole, x)) for x in ("begin", "end", "hash", "ends"))
            monkeypatch.undo()


def test_rolling_stays_within_texts():
    w = _words.words_of(["a b c d", "", "a b", "b c d"])
    h, ends = w.shingles(3)
    assert ends.tolist() == [2, 2, 2, 3] and h[1] == h[2] and len(h) == 3


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, k, percent):
    rng = random.Random(k)
    texts = list(ODD)
    for _ in range(12):
        base = prose(rng, rng.randrange(60, 200))
        texts += [base] * rng.choice([1, 1, 3])
        texts += [edited(rng, base, rng.choice([0.01, 0.02, 0.04, 0.1, 0.3])) for _ in range(8)]
    rng.shuffle(texts)
    ids = [3 * i for i in range(len(texts))]
    got = {r.doc_id: r for r in minhash.near_duplicates(docs(spark, texts, ids), k, percent).collect()}
    sets = [shingles(t, k) for t in texts]
    n = len(texts)
    edges = [(i, j) for i in range(n) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    root = union_find(n, edges)
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {ids[i]: (len(sets[i]), ids[root[i]], root[i] == i) for i in range(n)}


def test_near_copies_in_one_large_group(spark):
    """One group of many copies that differ by a word or two: linked through each other, with no pair rows."""
    rng = random.Random(5)
    base = prose(rng, 120)
    texts = [edited(rng, base, 0.03) for _ in range(700)]
    got = minhash.near_duplicates(docs(spark, texts), 3, 85).collect()
    sets = [shingles(t, 3) for t in texts]
    root = union_find(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])])
    wrong = sum(r.component_id != root[r.doc_id] for r in got)
    assert wrong == 0


def test_long_texts_that_share_a_centre_take_bounded_memory():
    """A pair of blocks over many batches: links equal brute force, and a shingle costs few bytes until the last batch is in."""
    rng = random.Random(25)
    base = prose(rng, 6000)
    texts = [edited(rng, base, share) for share in (0.005, 0.01, 0.02, 0.1) for _ in range(40)]
    n = len(texts)

    def batches():
        for i in range(0, n, 4):
            ids = list(range(i, i + 4))
            cols = [[7] * 4, [0] * 4, [0] * 4, [0] * 4, ids, ids]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in cols), pa.array(texts[i : i + 4])], ["centre", "i", "j", "side", "v", "c", "text"])

    _words.words_of(texts[:4])  # its tables of powers
    run = minhash._across(5, 80)
    tracemalloc.start()
    found = [p for b in run(batches()) for p in zip(b["a"].to_pylist(), b["b"].to_pylist(), strict=True)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    sets = [shingles(t, 5) for t in texts]
    edges = [(i, j) for i in range(n) for j in range(i) if 180 * len(sets[i] & sets[j]) >= 80 * (len(sets[i]) + len(sets[j]))]
    assert edges and union_find(n, found) == union_find(n, edges) and len(set(union_find(n, edges))) > 1
    assert peak < 24 * sum(len(s) for s in sets), f"{peak / sum(len(s) for s in sets):.0f} bytes a shingle"


def test_blocks_of_few_shingles_and_small_batches(spark, monkeypatch):
    """Texts that would fill a block many times over: each pair of them meets all the same."""
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 1 << 11)
    monkeypatch.setattr(minhash, "BATCH_BYTES", 1 << 14)
    dealt = []
    monkeypatch.setattr(minhash, "grouped", lambda df, keys: dealt.append(df) or _runs.grouped(df, keys))
    rng = random.Random(6)
    base = prose(rng, 150)
    texts = [edited(rng, base, 0.03) for _ in range(200)] + [edited(rng, base, 0.1) for _ in range(40)]
    got = minhash.near_duplicates(docs(spark, texts), 3, 85).collect()
    sets = [shingles(t, 3) for t in texts]
    root = union_find(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])])
    assert sum(r.component_id != root[r.doc_id] for r in got) == 0
    met = dealt[0].groupBy("centre", "i", "j").agg(F.sum(F.size(F.split("text", " ")) - 2).alias("n"), F.max("j").alias("blocks")).collect()
    # members are dealt by hash: a pair of blocks has twice the bound, more or less
    assert max(r.n for r in met) < 3 * 2 * (1 << 11) and max(r.blocks for r in met) > 0


def test_near_duplicates_awkward_rows(spark):
    rows = docs(spark, ["a b c d", "a b c d", None, "a b c d", "", "x y z"], [5, 5, 1, None, 2, 7])
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(rows, 3, 85).collect()), key=str)
    assert got == sorted([(5, 5, True), (5, 5, True), (1, 1, True), (None, None, True), (2, 2, True), (7, 7, True)], key=str)
    assert minhash.near_duplicates(docs(spark, []), 3, 85).collect() == []


def test_one_doc_id_with_two_texts(spark):
    rng = random.Random(15)
    texts, ids = [], []
    for i in range(0, 80, 8):
        x, y = prose(rng, 80), prose(rng, 80)
        # i + 4 has a near copy of i's text and one of i + 6's
        texts += [x, x + " more", y + " other", y, prose(rng, 80)]
        ids += [i, i + 4, i + 4, i + 6, i + 7]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs(spark, texts, ids), 3, 85).collect())
    assert got == sorted((d, d if d % 8 == 7 else d // 8 * 8, d % 8 in (0, 7)) for d in ids)


def test_table_keys_reach_the_threshold():
    m = minhash.collections(0.85)
    p = 0.85**minhash.ROWS
    assert 1 - (1 - p) ** m - m * p * (1 - p) ** (m - 1) >= 1 - minhash.MISS


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, i) for i in range(900, 960)] + [(5, 5), (None, 4), (2000, 2001), (2001, 2000)]
    got = {r.v: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    expected = {i: 0 for i in range(61)} | {i: 900 for i in range(900, 960)} | {1000: 900, 2000: 2000, 2001: 2000}
    assert got == expected
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- passages ----------------------------------------------------------------------------------------------------


def test_windows_equal_definition():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 1 << 62, 300, dtype=np.uint64) << np.uint64(1)
    ends = np.array([0, 120, 130, 300])
    got = sorted(zip(*(x.tolist() for x in substring.windows(h, ends, 12)), strict=True))
    expected = []
    key = h & ~substring._MASK
    for a, b in ((0, 120), (120, 130), (130, 300)):
        for c in range(a, b):
            left, right = c, c
            while left > a and key[left - 1] > key[c]:
                left -= 1
            while right < b - 1 and key[right + 1] > key[c]:
                right += 1
            if right - left + 1 >= 12:
                expected.append((left, c, right))
    assert got == sorted(expected)


def test_windows_of_one_repeated_token_stay_flat():
    l, c, r = substring.windows(np.zeros(50_000, np.uint64), np.array([50_000]), 46)
    assert ((l <= c) & (c <= r) & (r - l + 1 >= 46)).all() and len(c) < 5000


def repeated_corpus(seed):
    rng = random.Random(seed)
    passages = [prose(rng, rng.randrange(51, 90)) for _ in range(6)]
    texts = []
    for i in range(60):
        parts = [prose(rng, rng.randrange(0, 80), 10**6)]
        if i % 2:
            parts += [passages[rng.randrange(6)], prose(rng, rng.randrange(0, 60), 10**6)]
        texts.append(" ".join(parts))
    return [*texts, texts[1], "", None, prose(rng, 40, 10**6)]


def exact_repeats(texts, n=50):
    at = {}
    for i, t in enumerate(texts):
        w = words(t)
        for k in range(len(w) - n + 1):
            at.setdefault(tuple(w[k : k + n]), {}).setdefault(i, k)
    return [o for o in at.values() if len(o) > 1]


def test_repeats_cover_every_exact_passage(spark):
    texts = repeated_corpus(4)
    got = substring.repeats(docs(spark, texts)).collect()
    covered, named = {}, set()
    for r in got:
        covered.setdefault(r.doc_id, set()).update(range(r.first_word, r.end_word))
        named |= {r.doc_id, r.other_doc_id}
        assert r.doc_id != r.other_doc_id and r.end_word - r.first_word >= 50 and r.similarity >= 0.8
    expected = exact_repeats(texts)
    assert named == {i for o in expected for i in o}  # clean documents aren't named
    for o in expected:
        assert sum(not set(range(k, k + 50)) <= covered.get(i, set()) for i, k in o.items()) <= 1


def test_repeats_with_edits(spark):
    rng = random.Random(8)
    found = 0
    texts = []
    for _ in range(30):
        p = prose(rng, 80)
        w = p.split()
        w[40] = "changed"
        texts += [prose(rng, 30, 10**6) + " " + p + " " + prose(rng, 30, 10**6), prose(rng, 50, 10**6) + " " + " ".join(w)]
    got = {frozenset((r.doc_id, r.other_doc_id)) for r in substring.repeats(docs(spark, texts)).collect()}
    found = sum(frozenset((2 * i, 2 * i + 1)) in got for i in range(30))
    assert found >= 28 and len(got) == found


def test_one_passage_in_many_documents(spark):
    rng = random.Random(3)
    p = prose(rng, 60)
    texts = [prose(rng, 20, 10**6) + " " + p for _ in range(300)]
    got = substring.repeats(docs(spark, texts)).collect()
    assert {r.doc_id for r in got} | {r.other_doc_id for r in got} == set(range(300))
    assert len({r.doc_id for r in got}) == 299


def test_passages_that_many_others_quote_in_part(spark):
    """Two holders of a whole passage meet, whichever document of those that quote 25 to 49 words of it is the centre."""
    rng = random.Random(12)
    texts, holders = [], []
    for case in range(12):
        n = [60, 49 + 11, 100, 200][case % 4]
        p = prose(rng, n, 10**6).split()
        around = lambda x: " ".join([prose(rng, rng.randrange(10, 60), 10**6), *x, prose(rng, rng.randrange(10, 60), 10**6)])
        if case % 3 == 2:  # the holders differ by a word
            q = [*p[: n // 2], "changed", *p[n // 2 + 1 :]]
        else:
            q = p
        holders.append((len(texts), len(texts) + 1, n))
        texts += [around(p), around(q)]
        for _ in range(40 if n == 200 else 20):
            length = rng.randrange(38, 50)
            at = rng.randrange(n - length + 1)
            texts.append(around(p[at : at + length]))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    got = {}
    for r in substring.repeats(docs(spark, texts, ids)).collect():
        got.setdefault(frozenset((r.doc_id, r.other_doc_id)), []).append(r.end_word - r.first_word)
    assert {pair: max(x) for pair, x in got.items()}.keys() == {frozenset((ids[a], ids[b])) for a, b, _ in holders}
    assert all(max(got[frozenset((ids[a], ids[b]))]) >= n for a, b, n in holders)


def test_passages_beside_looser_copies(spark):
    """A passage with one changed word is found, whatever looser copy of the text around it adjoins it."""
    rng = random.Random(13)
    texts = []
    for case in range(12):
        p, more = prose(rng, 80, 10**6).split(), prose(rng, [60, 200][case % 2], 10**6).split()
        q, every = list(p), [9, 11, 13][case % 3]
        q[40] = "changed"
        loose = [f"x{rng.randrange(10**6)}" if i % every == every // 2 else w for i, w in enumerate(more)]
        both = [(p + more, q + loose), (more + p, loose + q)][case // 6]
        texts += [prose(rng, 30, 10**6) + " " + " ".join(x) + " " + prose(rng, 30, 10**6) for x in both]
    got = {}
    for r in substring.repeats(docs(spark, texts)).collect():
        got.setdefault(frozenset((r.doc_id, r.other_doc_id)), []).append(r.end_word - r.first_word)
        assert r.similarity >= 0.8
    assert got.keys() == {frozenset((i, i + 1)) for i in range(0, len(texts), 2)}
    assert all(max(x) >= 78 for x in got.values())


def test_parts_of_chains_equal_brute_force():
    rng = np.random.default_rng(3)
    several = 0
    for case in range(300):
        tokens = rng.integers(0, [5, 60, 10**9][case % 3], 300).astype(np.uint64)
        a, b = tokens.copy(), tokens.copy()
        b[np.flatnonzero(rng.random(300) < rng.choice([0.05, 0.12, 0.2]))] = 10**10
        chain, at = [], np.flatnonzero(np.diff(np.concatenate(([0], a == b, [0]))))
        for s, e in zip(at[::2].tolist(), at[1::2].tolist(), strict=True):
            chain.append((s, e, 0))
        every = [(i, j, *x) for i in range(len(chain)) for j in range(i, len(chain)) for x in substring._passage(a, b, chain[i : j + 1], 20, 80)]
        expected = [x[2:] for x in every if not any((o[0] <= x[0] and o[1] >= x[1]) and o[:2] != x[:2] for o in every)]
        assert list(substring._parts(a, b, chain, 20, 80)) == expected
        several += len(expected) > 1
    assert several > 20


def test_passages_after_their_own_fragments(spark):
    """A document that has most of a passage before the whole of it offers both places, as the centre too."""
    rng = random.Random(14)
    texts = []
    for _ in range(100):
        p = prose(rng, 60, 10**6)
        part = " ".join(p.split()[5:54])
        texts += [" ".join([part, prose(rng, 20, 10**6), p, prose(rng, 20, 10**6)]), " ".join([prose(rng, 20, 10**6), p, prose(rng, 20, 10**6)])]
    got = {frozenset((r.doc_id, r.other_doc_id)) for r in substring.repeats(docs(spark, texts)).where("end_word - first_word >= 60").collect()}
    assert got == {frozenset((i, i + 1)) for i in range(0, len(texts), 2)}


def test_passages_just_at_the_threshold(spark):
    """50 words with one changed, similarity 41 / 51: missed with a chance of 2 in 10,000."""
    rng = random.Random(16)
    texts = []
    for _ in range(400):
        p = prose(rng, 50, 10**6).split()
        q = [*p[:25], "changed", *p[26:]]
        texts += [" ".join([prose(rng, 30, 10**6), *x, prose(rng, 30, 10**6)]) for x in (p, q)]
    got = {frozenset((r.doc_id, r.other_doc_id)) for r in substring.repeats(docs(spark, texts)).collect()}
    assert got <= {frozenset((i, i + 1)) for i in range(0, 800, 2)} and len(got) >= 398


def test_cut_keeps_one_copy_and_everything_else(spark):
    texts = repeated_corpus(6)
    rows = substring.without_repeats(docs(spark, texts))
    assert rows.columns == docs(spark, texts).columns
    left = {r.doc_id: r.text for r in rows.collect()}
    before = {s for t in texts for s in shingles(t, 5)}
    assert exact_repeats([left.get(i) for i in range(len(texts))]) == []
    assert not [o for o in exact_repeats(texts) if not any(" ".join(words(texts[i])[k : k + 50]) in " ".join(words(left.get(i))) for i, k in o.items())]
    assert left[len(texts) - 3] == "" and left[len(texts) - 2] is None
    touched = {i for o in exact_repeats(texts) for i in o}
    assert all(left[i] == t for i, t in enumerate(texts) if i not in touched)
    assert before


def test_remove():
    assert substring.remove("A b  c\nd e ", [(1, 3)]) == "A d e "
    assert substring.remove("é ü", [(0, 2)]) is None
    assert substring.remove("a b", []) == "a b"


def test_repeats_awkward_rows(spark):
    long = " ".join(f"q{i}" for i in range(70))
    rows = docs(spark, [long, long, None, long, "x"], [4, 4, 1, 9, None])
    got = [(r.doc_id, r.other_doc_id) for r in substring.repeats(rows).collect()]
    assert got in ([(4, 9)], [(9, 4)])
    assert substring.repeats(docs(spark, [])).collect() == []
    with pytest.raises(ValueError):
        substring.repeats(rows, min_words=4)


# --- vectors -----------------------------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if x is None else [None if v is None else float(v) for v in x], 0, "t") for i, x in rows], "vec_id long, embedding array<float>, label int, key string")


def brute_vectors(rows, cosine):
    ok = [x is not None and len(x) > 0 and all(v is not None and np.isfinite(v) for v in x) and any(x) for _, x in rows]
    m = [np.array(x, np.float32).astype(float) if o else None for o, (_, x) in zip(ok, rows, strict=True)]
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if ok[i] and ok[j] and m[i] @ m[j] / np.sqrt((m[i] @ m[i]) * (m[j] @ m[j])) >= cosine]
    links = [sum(i in e for e in edges) for i in range(len(rows))]
    return links, union_find(len(rows), edges)


def test_near_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = []
    for g in range(25):
        base = rng.standard_normal(32)
        for n in range([1, 2, 9, 30][g % 4]):
            rows.append((len(rows), base + rng.standard_normal(32) * 0.2 * (n > 0) * rng.random()))
        if g % 3 == 0:
            rows.append((len(rows), base.copy()))
    rows += [(len(rows) + i, x) for i, x in enumerate([None, [0.0] * 32, [float("nan")] * 32, [None] * 32, [float("inf")] * 32, []])]
    got = {r.vec_id: r for r in crosspolytope.near_vectors(vectors(spark, rows)).collect()}
    links, root = brute_vectors(rows, 0.95)
    assert len(got) == len(rows)
    found, there = sum(r.n_links for r in got.values()), sum(links)
    assert 0.998 * there <= found <= there
    assert all(got[i].n_links <= links[i] for i in got)
    assert sum(got[i].component_id == root[i] for i in got) >= 0.99 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_blocks_count_each_pair_once(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.standard_normal(16)
    rows = [(i, base + 0.05 * rng.standard_normal(16)) for i in range(150)]
    monkeypatch.setattr(crosspolytope, "BLOCK", 20)
    got = {r.vec_id: r.n_links for r in crosspolytope.near_vectors(vectors(spark, rows)).collect()}
    links, _ = brute_vectors(rows, 0.95)
    assert [got[i] for i in range(150)] == links


def test_hadamard_is_orthogonal():
    x = np.random.default_rng(0).standard_normal((5, 50))
    y = crosspolytope.rotate(x, 3)
    assert y.shape == (5, 64) and np.allclose(y @ y.T, x @ x.T)


def test_near_vectors_awkward_rows(spark):
    rows = [(4, [1.0, 0.0]), (4, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [2.0, 0.0, 0.0]), (9, None)]
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in crosspolytope.near_vectors(vectors(spark, rows)).collect())
    assert got == [("2", 2, "2", True), ("4", 2, "2", False), ("4", 2, "2", False), ("9", 0, "9", True), ("None", 0, "None", True)]
    assert crosspolytope.near_vectors(vectors(spark, [])).collect() == []
    assert crosspolytope.near_vectors(vectors(spark, [(1, None)]).select("vec_id", F.col("embedding"))).first().component_id == 1
