"""Tokens, packing, licences, mixing, export, search and the classifiers against brute force."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandweave.llm import export, kdsearch, licenses, mixing, mph, packing, quality, tokens, toxicity
from strandweave.llm._shared import held_out

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOC = "doc_id long, text string, lang string, source string, n_chars long, size string, row string, score int"
ODD = [
    "", None, " \n\t ", "Hello, WORLD!! it's we're THE.. foo-. x€. 12ab3 ñandú, ÀÉ!!", "<|endoftext|> a<|STARTOFTEXT|>b", "áb é H̱", "İstanbul ΣΑΣ", "日本語 テスト 😀!",
    "tab\tand\x0bvt\x0cff em nb\x85nel", "don't can'T 's S'", "\x00\x01", "word." * 50, "http://x.y/z?a=b&c=d#e", "KK ﬁ", "x" * 3000,
]


def docs(spark, rows):
    """rows: (doc_id, text, source); extra columns with names that the operators use themselves."""
    return spark.createDataFrame([(i, t, None, s, 0, "q", "r", 1) for i, t, s in rows], DOC)


def plain_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    return [np.array(e.ids, "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def prose(rng, n):
    return " ".join(rng.choice(["the", "Of", "thing", "er", "was,", "Éa", "word.", "x1"]) + rng.choice(["", "s", "ing"]) for _ in range(n))


# --- tokens ------------------------------------------------------------------------------------------------------


def test_chunked_ids_equal_the_library(monkeypatch):
    rng = random.Random(1)
    texts = [*ODD, *(prose(rng, 200) for _ in range(20)), *("".join(rng.choice("aZé'.!-_ <|>\n1Σ") for _ in range(60)) for _ in range(200))]
    monkeypatch.setattr(tokens, "CHUNKS", 300)  # the table starts anew again and again
    own = tokens.Encoder(tokens.default_path())
    assert own.chunked
    for i in range(0, len(texts), 9):
        part = texts[i : i + 9]
        got = [np.frombuffer(x, own.dtype) for x in own.encode([(t or "").encode() for t in part])]
        for g, e, t in zip(got, plain_ids(part), part, strict=True):
            assert np.array_equal(g, e), t


def test_long_texts_are_encoded_in_parts(monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(tokens, "SEGMENT", 500)
    texts = [prose(rng, 900), "x" * 2000, prose(rng, 300) + " <|endoftext|> " + prose(rng, 300), None, "\n" * 1500, prose(rng, 5)]
    import pyarrow as pa

    got = dict(tokens.encoded(pa.array(texts), tokens.default_path()))
    assert all(np.array_equal(got[i], e) for i, e in enumerate(plain_ids(texts)))


def test_unequal_chunks_of_one_hash_go_to_the_library(monkeypatch):
    class Same(tokens.Parts):
        def __init__(self, *args):
            super().__init__(*args)
            self.hash = self.hash & np.uint64(7)

    monkeypatch.setattr(tokens, "Parts", Same)
    rng = random.Random(3)
    own, texts = tokens.Encoder(tokens.default_path()), [prose(rng, 30) for _ in range(20)]
    for g, e in zip(own.encode([t.encode() for t in texts]), plain_ids(texts), strict=True):
        assert np.array_equal(np.frombuffer(g, own.dtype), e)


def test_other_tokenizers_get_whole_texts():
    import public_tokenizers

    own = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not own.chunked
    assert np.frombuffer(own.encode([b"Hello  world"])[0], own.dtype).tolist() == own.tokenizer.encode("Hello  world").ids


# --- packing -----------------------------------------------------------------------------------------------------


def test_pack_takes_the_least_sum_of_squares():
    rng = np.random.default_rng(4)
    lengths, size = rng.integers(1, 65, 300), 64
    at, offset = packing.pack(lengths, size)
    # replay with every choice tried
    fill, n = {}, np.zeros(size + 1, np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        s, best = lengths[i], None
        for gap in range(s, size + 1):
            if gap < size and not n[gap]:
                continue
            m = n.copy()
            if gap < size:
                m[gap] -= 1
            if gap > s:
                m[gap - s] += 1
            cost = (m[1:size] ** 2).sum()
            if best is None or cost < best[0]:
                best = (cost, gap, m)
        before = fill.get(at[i], 0)
        cost_now = n.copy()
        if size - before < size:
            cost_now[size - before] -= 1
        if size - before > s:
            cost_now[size - before - s] += 1
        assert (cost_now[1:size] ** 2).sum() == best[0] and offset[i] == before
        n = cost_now
        fill[at[i]] = before + s
    assert max(fill.values()) <= size


def test_packed_documents(spark):
    rng = random.Random(2)
    texts = [*ODD, *(prose(rng, int(rng.expovariate(1 / 150))) for _ in range(150)), prose(rng, 9000)]
    rows = [(i if i % 11 else None, t, "s") for i, t in enumerate(texts)] + [(7, "again", "s")] * 3
    got = packing.pack_documents(docs(spark, rows), 512, 1).collect()
    expected = []
    for (i, _, _), ids in zip(rows, plain_ids([r[1] for r in rows]), strict=True):
        ids = np.append(ids, 1).astype("<u4")
        expected += [(str(i), p, a, len(x := ids[a : a + 512]), zlib.crc32(x.tobytes())) for p, a in enumerate(range(0, len(ids), 512))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(expected)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= 512
    assert len(by) <= -(-sum(r.length for r in got) // 512) + 1
    assert packing.pack_documents(docs(spark, []), 512, 1).collect() == []


def test_shards_are_packed_again(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 40)
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(i, int(n)) for i, n in enumerate(rng.integers(1, 257, 900))], "row long, length long")
    got = packing.sequences(rows, 256).collect()
    assert sorted(r.row for r in got) == list(range(900))
    fill = {}
    for r in got:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 256 and len(fill) <= 1.08 * sum(r.length for r in got) / 256


# --- licences ----------------------------------------------------------------------------------------------------


def test_licenses_equal_brute_force(spark):
    rng = random.Random(6)
    filler = ["the", "of", "license", "general", "public", "cc", "by", "apache", "mit", "gnu", "Zé"]
    texts = ["", None, "MIT License", "cc-by cc by by", "a " * 50 + "GNU General  Public_License!", "CC BY " * 40, "xK mité license"]
    texts += [" ".join(rng.choice(filler) for _ in range(rng.randrange(1, 120))) for _ in range(150)]
    texts += ["Licensed under the Apache License, Version 2.0", "Released under the MIT License", "MIT License", None]
    got = {}
    for r in licenses.licenses(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect():
        assert r.doc_id not in got
        got[r.doc_id] = r
    pattern = re.compile(licenses.WORD)
    for i, t in enumerate(texts):
        w = pattern.findall((t or "").translate(LOW))
        places, labels = [], set()
        for phrase, label in licenses.BASE.items():
            q = phrase.split()
            hits = [k for k in range(len(w) - len(q) + 1) if w[k : k + len(q)] == q]
            places += hits
            labels |= {label} if hits else set()
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))), t
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not labels
        assert 0 <= r.score <= 1 and (r.score == 1) >= bool(labels)
    assert got[len(texts) - 4].labels == "apache,apache-2.0"
    assert licenses.licenses(docs(spark, [])).collect() == []


def test_notice_with_edits_and_equal_rows(spark):
    notice = "Permission is hereby granted, free of charge, to any person or company obtaining a copy of this software and associated documentation files"
    rows = [(1, "x " + notice, "s")] * 3 + [(None, "plain", "s"), (1, "cc by", "s")]
    got = sorted((str(r.doc_id), r.labels, r.n_base) for r in licenses.licenses(docs(spark, rows)).collect())
    assert got == [("1", "cc-by", 1), ("1", "mit", 0), ("1", "mit", 0), ("1", "mit", 0), ("None", "", 0)]


# --- mixing ------------------------------------------------------------------------------------------------------


def expected_targets(sizes, weights=(1, 2, 3), cap=3.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = np.array([weights[i % len(weights)] for i in range(len(names))], float)
    most, total = cap * np.array([sizes[s] for s in names], float), sum(sizes.values())
    target, free = np.zeros(len(names)), np.ones(len(names), bool)
    while free.any():
        target[free] = (total - target[~free].sum()) * w[free] / w[free].sum()
        over = free & (target > most + 1e-9)
        if not over.any():
            break
        target[over] = most[over]
        free &= ~over
    return dict(zip(names, target, strict=True))


def test_mix(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(int(rng.expovariate(1 / 60)))), rng.choice(["big"] * 8 + ["é", "a", "B", None, "tiny"])) for i in range(900)]
    rows += [(None, "null id", "big"), (5, None, "a"), *[(900, "same row here", "a")] * 5, (901, "one", "Z")]
    got = mixing.mix(docs(spark, rows)).collect()
    again = mixing.mix(docs(spark, rows)).collect()
    key = lambda r: (str(r.doc_id), r["size"], r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = expected_targets(sizes)
    by_source = {(round(want[s], 6), sizes[s]): s for s in sizes}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        taken[by_source[round(r.target, 6), r.source_size]] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(3, 0.01 * want[s]), s
    assert mixing.mix(docs(spark, [])).collect() == []
    assert [r.taken for r in mixing.mix(docs(spark, [(1, None, None), (2, "", "x")])).collect()] == [0, 0]


def test_mix_with_unequal_odds(spark):
    rows = [(i, "w " * 10, "abc"[i % 3]) for i in range(3000)]
    df = docs(spark, rows)
    odds = F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0)
    taken = {0: 0, 1: 0}
    for r in mixing.mix(df, odds=odds).where("target < source_size").collect():
        taken[r.doc_id % 2] += r.taken
    assert 2.5 < taken[0] / taken[1] < 3.5


def test_mix_takes_the_smallest_pareto_ratios(spark):
    """Odds of 20 to 1 with the cap of 3 copies binding: expected copies, the order of the sample and the targets against a plain computation."""
    rows = [(i, "w " * 10, "abc"[i % 3]) for i in range(3000)]
    df = docs(spark, rows)
    odds = F.when(F.col("doc_id") % 5 == 0, 20.0).otherwise(1.0)
    u = df.select("doc_id", "source", ((F.pmod(F.xxhash64(F.lit(1), "doc_id", "source", F.lit(10).cast("long")), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))).alias("u")).collect()
    got = {r.doc_id: (r.taken, r.target) for r in mixing.mix(df, odds=odds).collect()}
    for s in "abc":
        own = [(r.doc_id, r.u, 20.0 if r.doc_id % 5 == 0 else 1.0) for r in u if r.source == s]
        target = got[own[0][0]][1]
        assert abs(sum(got[i][0] for i, _, _ in own) - target) <= max(10, 0.01 * target)
        low, high = 0.0, 1e6
        for _ in range(200):  # bisection for the level
            e = (low + high) / 2
            low, high = (e, high) if sum(10 * min(3.0, e * o) for *_, o in own) < target else (low, e)
        want = {i: int(min(3.0, e * o) + 1e-9) for i, _, o in own}
        part = {i: min(3.0, e * o) - want[i] for i, _, o in own}
        order = sorted((x / (1 - x) / (part[i] / (1 - part[i])), i) for i, x, _ in own if part[i] > 1e-9)
        for _, i in order[: int((target - 10 * sum(want.values())) // 10)]:
            want[i] += 1
        assert sum(abs(got[i][0] - 10 * n) for i, n in want.items()) <= 20, s


def test_mix_includes_by_probability(spark):
    rows = [(i, "w " * 10, "ab"[i % 2]) for i in range(400)]
    df = docs(spark, rows)
    odds = F.when(F.col("doc_id") % 4 < 2, 4.0).otherwise(1.0)
    n = 6
    taken = {True: 0, False: 0}
    for seed in range(n):
        for r in mixing.mix(df, odds=odds, seed=seed).where("target < source_size").collect():
            taken[r.doc_id % 4 < 2] += r.taken
    # 200 documents of 10 words with 2000 / 1.5 words to give: 4 e and e copies
    e = 400 * 10 / 3 / 10 / (100 * 4 + 100)
    assert abs(taken[True] / (1000 * n) - 4 * e) < 0.06 and abs(taken[False] / (1000 * n) - e) < 0.06


def test_mix_odds_that_draw_nothing(spark):
    rows = [(i, "w " * 10, "ab"[i % 2]) for i in range(40)]
    odds = F.when(F.col("doc_id") % 4 == 0, F.lit(None)).when(F.col("doc_id") % 4 == 1, F.lit(float("nan"))).when(F.col("doc_id") % 8 == 2, -1.0).otherwise(1.0)
    got = {r.doc_id: r.taken for r in mixing.mix(docs(spark, rows), odds=odds).collect()}
    assert all(t == 0 for i, t in got.items() if i % 4 < 2 or i % 8 == 2) and any(got.values())


def test_mix_is_native(spark):
    plan = mixing.mix(docs(spark, [(1, "a b", "x"), (2, "c", "y")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- export ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 63, 5000])
def test_mph_is_minimal_and_perfect(n):
    keys = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64)
    h = mph.Mph.build(keys)
    assert sorted(h.slot(keys).tolist()) == list(range(n))
    back, size = mph.Mph.from_bytes(h.to_bytes() + b"more")
    assert size == len(h.to_bytes()) and np.array_equal(back.slot(keys), h.slot(keys))
    assert np.array_equal(h.slot(keys[:5]), h.slot(keys)[:5])
    if n > 1:
        with pytest.raises(ValueError):
            mph.Mph.build(np.append(keys, keys[:1]))


def test_export_round_trip(spark):
    rng = random.Random(9)
    texts = [*ODD, *(prose(rng, rng.randrange(1, 300)) for _ in range(120))]
    ids = [rng.randrange(-50, 10**6) for _ in texts]
    rows = [(i, t, "s") for i, t in zip(ids, texts, strict=True)] + [(None, "no id", "s"), (ids[3], "same id", "s"), (ids[3], "same id", "s")]
    df = docs(spark, rows)
    got = export.exported(df).collect()
    encoded = {}
    for (i, _, _), x in zip(rows, plain_ids([r[1] for r in rows]), strict=True):
        x = np.append(x, 2).astype("<u4")
        encoded.setdefault(i, []).append((len(x), zlib.crc32(x.tobytes())))
    start, seen = 0, {}
    for r in sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.start)):
        assert r.start == start
        start += r.n_tokens
        seen.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in encoded.items()}
    assert export.exported(docs(spark, [])).collect() == []


def test_export_refuses_a_folder_with_files(spark, tmp_path):
    one, other = docs(spark, [(1, "one", "s")]), docs(spark, [(1, "another text", "s")])
    uri = f"file://{tmp_path}/ids"
    export.export(one, uri=uri)
    with pytest.raises(ValueError, match="holds files"):
        export.export(other, uri=uri)


def test_keyed_access(spark):
    df = docs(spark, [(3 * i, f"text number {i}", "s") for i in range(200)])
    out = export.export(df)
    asked = spark.createDataFrame([(0,), (1,), (597,), (None,), (10**12,)], "doc_id long")
    got = {r.doc_id: r for r in out.read_keys(asked).collect()}
    assert set(got) == {0, 597}  # other keys fail the fingerprint
    ids = np.append(plain_ids(["text number 199"])[0], 2).astype("<u4")
    assert got[597].ids_crc32 == zlib.crc32(ids.tobytes())


# --- search ------------------------------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if x is None else [None if v is None else float(v) for v in x], 0, "k") for i, x in rows], "vec_id long, embedding array<float>, label int, score string")


def brute_top(rows, k, every):
    ok = [(i, np.floor(np.array(x, np.float32).astype(float) * 1024).astype(np.int64)) for i, x in rows if i is not None and x is not None and all(v is not None and np.isfinite(v) for v in x)]
    out = []
    for n, (i, q) in enumerate(ok):
        if i % every == 0:
            best = sorted((-int(q @ v), j) for m, (j, v) in enumerate(ok) if m != n)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(kdsearch, "SHARD_ROWS", 100)
    monkeypatch.setattr(kdsearch, "LEAF", 8)
    monkeypatch.setattr(kdsearch, "GROUP", 2)
    monkeypatch.setattr(kdsearch, "BLOCK", 16)
    rng = np.random.default_rng(7)
    rows = [(i, np.round(rng.standard_normal(6), 1)) for i in range(700)]
    rows += [(700, [0.1] * 6), (705, None), (710, [None] * 6), (715, [float("nan")] * 6), (720, [float("-inf")] * 6), (None, [9.0] * 6)]
    got = kdsearch.top_k(vectors(spark, rows), F.col("vec_id") % 5 == 0, 10).collect()
    assert sorted(map(tuple, got)) == brute_top(rows, 10, 5)


def test_top_k_few_rows_ties_and_copies(spark):
    rows = [(5, [1.0, 0.0]), (10, [1.0, 0.0]), (3, [1.0, 0.0]), (7, [-1.0, 0.0]), (10, [1.0, 0.0])]
    got = sorted(map(tuple, kdsearch.top_k(vectors(spark, rows), F.col("vec_id") % 5 == 0, 10).collect()))
    assert got == brute_top(rows, 10, 5)
    assert kdsearch.top_k(vectors(spark, []), F.col("vec_id") % 5 == 0).collect() == []
    assert kdsearch.top_k(vectors(spark, rows), F.lit(False)).collect() == []


def test_top_k_beyond_double_precision(spark):
    rows = [(0, [2e6, 1.0]), (1, [2e6, 1.0]), (2, [2e6, 2.0]), (3, [-2e6, 1.0])]
    got = sorted(map(tuple, kdsearch.top_k(vectors(spark, rows), F.col("vec_id") == 0, 10).collect()))
    assert [r[2] for r in got] == [2, 1, 3] and got[0][3] == (2_048_000_000**2) + 2048 * 1024


# --- classifiers -------------------------------------------------------------------------------------------------


def labelled(spark, n=900, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        toxic, good = rng.random() < 0.2, rng.random() < 0.8
        text = prose(rng, rng.randrange(20, 150))
        if not good:
            text = text.upper().replace(" ", "!! ")
        if toxic:
            w = text.split()
            w.insert(rng.randrange(len(w)), rng.choice(["Vile", "rotten", "NASTY,"]))
            text = " ".join(w)
        rows.append((i, text, "s"))
        labels.append((i, int(good), int(toxic), "t"))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


@pytest.mark.parametrize(("f", "target"), [(toxicity.toxicity, "toxic"), (quality.quality, "quality")])
def test_held_out_accuracy(spark, f, target):
    df, labels = labelled(spark)
    got = f(df, labels).join(labels.select("doc_id", F.col(target).alias("y")), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == r.y for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in got)


@pytest.mark.parametrize(("f", "target"), [(toxicity.toxicity, "toxic"), (quality.quality, "quality")])
def test_held_out_labels_change_nothing(spark, f, target):
    df, labels = labelled(spark, 300)
    turned = labels.withColumn(target, F.when(held_out(), 1 - F.col(target)).otherwise(F.col(target)))
    score = lambda x: {r.doc_id: r.score for r in f(df, x).collect()}
    assert score(labels) == score(turned)


@pytest.mark.parametrize(("f", "default"), [(toxicity.toxicity, 0.0), (quality.quality, 1.0)])
def test_classifiers_awkward_rows(spark, f, default):
    df, labels = labelled(spark, 200)
    odd = docs(spark, [(i, t, None) for i, t in enumerate(ODD)] + [(None, "x", "s"), (1, "dup", "s"), (1, "dup", "s")])
    got = f(df.union(odd), labels.union(labels.limit(3)).union(spark.createDataFrame([(None, 1, 1, "")], labels.schema)))
    assert got.count() == 200 + len(ODD) + 3 and got.where("score is null or predicted is null or held_out is null").count() == 0
    assert {r.score for r in f(odd, labels.limit(0)).collect()} == {default}
    assert f(docs(spark, []), labels).collect() == []
    one = f(df, labels.where("toxic = 0 and quality = 1"))
    assert one.where("score is null").count() == 0


def test_rules_as_columns_equal_rules(spark):
    df, labels = labelled(spark, 400)
    model = quality.train(df, labels)
    rows = quality.with_statistics(df, ["doc_id"]).withColumn("score", model.column(lambda i: F.col("features")[i])).collect()
    assert np.allclose([r.score for r in rows], model.predict(np.array([r.features for r in rows])))
    assert 0 < len(model.rules) < 200


def test_ftrl_is_sparse():
    m = toxicity.Ftrl(np.full(8, 2.0), alpha=1.0, toxic=1.0)
    for i in range(200):
        m.learn(np.array([0, 2 + i % 6]), 1)
        m.learn(np.array([1, 2 + i % 6]), 0)
    w = m.weights
    assert w[0] > 0.5 and w[1] < -0.5 and (w[2:] == 0).sum() >= 4


def plain_features(text):
    """Sets of words, pairs and pairs with one word between, by a plain loop."""
    w = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").translate(LOW))
    return {("w", x) for x in w} | {(n, *p) for n in (1, 2) for p in zip(w, w[n:])}


def test_features_equal_a_plain_loop():
    rng = random.Random(4)
    texts = [t or "" for t in ODD] + [prose(rng, rng.randrange(0, 80)) for _ in range(60)]
    import pyarrow as pa

    from strandweave.llm import _words

    got = [s for _, _, data, offsets in _words.passes(pa.array(texts)) for s in toxicity.feature_sets(data, offsets)]
    place, half = {}, 1 << toxicity.BITS - 1
    for text in texts:  # where each feature goes, from texts that hold little else
        for f in plain_features(text):
            if f not in place:
                one = f[1] if f[0] == "w" else f"{f[1]} {f[2]}" if f[0] == 1 else f"{f[1]} {'x' * 9} {f[2]}"
                own = toxicity.feature_sets(np.frombuffer(one.encode(), np.uint8), np.array([0, len(one.encode())])).pop()
                if f[0] == "w":
                    place[f] = own[own < half][0]
                elif f[0] == 1:
                    place[f] = own[own >= half][0]
                else:
                    near = {p for a, b in ((f[1], "x" * 9), ("x" * 9, f[2])) for p in toxicity.feature_sets(np.frombuffer(f"{a} {b}".encode(), np.uint8), np.array([0, len(f"{a} {b}".encode())])).pop() if p >= half}
                    place[f] = next((p for p in own[own >= half] if p not in near), None)
    for text, s in zip(texts, got, strict=True):
        assert {place[f] for f in plain_features(text)} - {None} <= set(s.tolist()) and len(s) <= len(plain_features(text))


def test_ftrl_and_scores_equal_a_plain_loop(monkeypatch):
    import math

    rng = random.Random(6)
    sets = [np.array(sorted(rng.sample(range(40), rng.randrange(0, 12))), np.int64) for _ in range(120)]
    ys = [int(any(x < 5 for x in s)) for s in sets]
    monkeypatch.setattr(toxicity, "penalties", lambda: np.array([0.5] * 20 + [2.0] * 20))
    model = toxicity.fit(list(zip(sets, ys, strict=True)), epochs=2)
    z, n, l1 = dict.fromkeys(range(-1, 40), 0.0), dict.fromkeys(range(-1, 40), 0.0), {-1: 0.0, **{i: 0.5 if i < 20 else 2.0 for i in range(40)}}

    def weight(i):
        return 0.0 if abs(z[i]) <= l1[i] else -(z[i] - math.copysign(l1[i], z[i])) / ((1.0 + math.sqrt(n[i])) / 2.0)

    for _ in range(2):
        for s, y in zip(sets, ys, strict=True):
            own = [-1, *s.tolist()]
            w = {i: weight(i) for i in own}
            g = (1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.values()))))) - y) * (toxicity.TOXIC if y else 1.0)
            for i in own:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 2.0 * w[i]
                n[i] += g * g
    assert np.allclose(model.weights, [weight(i) for i in range(40)]) and math.isclose(model.bias, weight(-1))

    texts = [t or "" for t in ODD] + [prose(rng, 30) for _ in range(10)]
    dense = np.where(np.arange(1 << toxicity.BITS) % 3 == 0, 0.01, 0.0)
    at = np.flatnonzero(dense)
    scorer = toxicity.Model(-0.2, at, dense[at])
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        own = toxicity.feature_sets(data, np.array([0, len(data)])).pop()
        assert math.isclose(scorer.score(data, np.array([0, len(data)]))[0], 1 / (1 + math.exp(0.2 - sum(dense[i] for i in own.tolist()))))
