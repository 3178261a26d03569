"""The queries of this subpackage, as the driver calls them: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from ._shared import table


def op1_compact_window_repeats(spark, sf_dir):
    from .substring import repeats

    return repeats(table(spark, sf_dir, "documents"), min_words=50, percent=80)


def op2_sum_of_squares_packing(spark, sf_dir):
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), size=4096, end_id=1)


def op3_license_diagonals(spark, sf_dir):
    from .licenses import licenses

    return licenses(table(spark, sf_dir, "documents"))


def op4_pareto_mix(spark, sf_dir):
    from .mixing import length_odds, mix

    return mix(table(spark, sf_dir, "documents"), odds=length_odds())


def op5_mph_token_export(spark, sf_dir):
    from .export import exported

    return exported(table(spark, sf_dir, "documents"), end_id=2)


def op6_kd_top_k(spark, sf_dir):
    from pyspark.sql import functions as F

    from .kdsearch import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op7_rule_quality(spark, sf_dir):
    from .quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_cross_polytope_dedup(spark, sf_dir):
    from .crosspolytope import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op9_ftrl_toxicity(spark, sf_dir):
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_minhash_near_dedup(spark, sf_dir):
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


QUERIES = {
    f.__name__: f
    for f in (
        op1_compact_window_repeats,
        op2_sum_of_squares_packing,
        op3_license_diagonals,
        op4_pareto_mix,
        op5_mph_token_export,
        op6_kd_top_k,
        op7_rule_quality,
        op8_cross_polytope_dedup,
        op9_ftrl_toxicity,
        op10_minhash_near_dedup,
    )
}

#: Queries that SQL can express whole; the others are tested against brute force in tests/llm.
SQL: dict[str, str] = {
    "op6_kd_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 10""",
    "op8_cross_polytope_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM v),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND list_inner_product(a.v, b.v) / (a.n * b.n) >= 0.95),
r(v, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v WHERE r.c < e.b),
l AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT v AS vec_id, coalesce(any_value(n_links), 0)::BIGINT AS n_links, min(c) AS component_id, v = min(c) AS kept FROM r LEFT JOIN l ON l.a = r.v GROUP BY v""",
    "op10_minhash_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS b2 FROM s a JOIN s b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * b2 >= 85 * (x.n + y.n - b2)),
r(v, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v WHERE r.c < e.b)
SELECT v AS doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(c) AS component_id, v = min(c) AS kept FROM r LEFT JOIN n ON n.doc_id = r.v GROUP BY v""",
}
