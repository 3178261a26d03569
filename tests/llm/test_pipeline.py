"""The stages, each on its own input, against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from test_corpus import expected_targets, plain_ids, prose
from test_dedup import exact_repeats, shingles, union_find

import corpus_pipeline
from strandweave.llm import toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long, score string, v string, row string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(420):
        toxic = rng.random() < 0.2
        text = " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(3000)}" for _ in range(rng.randrange(30, 160)))
        if toxic:
            text += " vile rotten " + prose(rng, 5)
        rows.append((i, text, None, f"s{i % 4}"))
        labels.append((i, 1, int(toxic)))
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(70))
    for i in range(0, 60, 3):
        rows.append((1000 + i, rows[i][1] + (" tail" if i % 2 else ""), "en", "s1"))
        rows.append((2000 + i, " ".join(f"n{rng.randrange(10**6)}" for _ in range(40)) + " " + passage, "en", "s2"))
    rows += [(None, "no id", None, None), (3000, None, None, "s0"), (3001, "", None, "s0"), (3002, "twice the same row", None, "s0"), (3002, "twice the same row", None, "s0")]
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, lang, s, len(t or ""), "x", "y", "z") for i, t, lang, s in rows], DOC).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs.collect()
    for n, (name, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, docs, folder)
        assert n == 4 or out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        {0: toxic, 1: near, 2: repeats, 3: mix, 4: packed}[n](spark, folder, before, after)
        before = after


def toxic(spark, folder, before, after):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    verdict = toxicity.toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()
    gone = {r.doc_id for r in verdict if r.predicted == 1}
    assert Counter(before) - Counter(after) == Counter(r for r in before if r.doc_id in gone)
    assert sum("vile rotten" in (r.text or "") for r in after) <= 2


def near(spark, folder, before, after):
    sets = [shingles(r.text, 5) for r in before]
    n = len(before)
    root = union_find(n, [(i, j) for i in range(n) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])])
    groups = {}
    for i, r in enumerate(root):
        if sets[i] and before[i].doc_id is not None:
            groups.setdefault(r, set()).add(before[i].doc_id)
    expected = Counter(min(g) for g in groups.values()) + Counter(r.doc_id for i, r in enumerate(before) if not sets[i] or r.doc_id is None)
    assert Counter(r.doc_id for r in after) == expected
    assert not Counter(after) - Counter(before)


def repeats(spark, folder, before, after):
    left = {r.doc_id: r.text for r in after}
    assert exact_repeats([r.text for r in after]) == []
    touched = {before[i].doc_id for o in exact_repeats([r.text for r in before]) for i in o}
    assert touched and all(left[r.doc_id] == r.text for r in before if r.doc_id not in touched)


def mix(spark, folder, before, after):
    size = lambda r: len((r.text or "").split())
    assert not set(after) - set(before) and max(Counter(after).values()) <= 3
    sizes, taken = Counter(), Counter()
    for r in before:
        sizes[r.source] += size(r)
    for r in after:
        taken[r.source] += size(r)
    for s, t in expected_targets(dict(sizes)).items():
        assert abs(taken[s] - t) <= max(3, 0.02 * t)


def packed(spark, folder, before, after):
    lengths = Counter()
    for r, ids in zip(before, plain_ids([r.text for r in before]), strict=True):
        lengths[r.doc_id] += len(ids) + 1
    got = Counter()
    for r in after:
        got[r.doc_id] += r.length
    assert got == lengths
    assert len({r.sequence_id for r in after}) <= np.ceil(sum(lengths.values()) / 4096) + 1


def test_run_and_empty_tables(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 0
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
