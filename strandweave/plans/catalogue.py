"""Every query of the library by name, with SQL that gives the same rows where SQL can."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bits, dna
from ..functions.stats import AbundanceConfig
from ..operators import abundance, pairwise, sketch, windows
from ..sources import sequences
from ..streaming import sketches as streams
from . import oracle as o
from .scratch import scratch_dir

QUERIES: dict = {}
SQL: dict[str, str] = {}

K, SAMPLE, CAP, P = 12, 1000, 5, 12
CONFIG = AbundanceConfig(k=K, x=1, y=4, sample=SAMPLE, z=1.645)
TYPES = ["click", "purchase", "view"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _dna(spark, d) -> DataFrame:
    return dna.texts_as_dna(_table(spark, d, "documents").select("doc_id", "lang", "text"))


def _counts(spark, d, k: int = K, by: list[str] = ()) -> DataFrame:
    """(*by, key, n): two-bit keys of the canonical k-mers."""
    return abundance.kmer_counts(_dna(spark, d), k, by, few_groups=True)


def _staged(spark, df: DataFrame) -> DataFrame:
    """Written once and read back, for what more than one job or branch reads."""
    folder = f"{scratch_dir(spark)}/rows-{uuid.uuid4().hex[:12]}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


_OCC = f"WITH {o.dna()},\n{o.occurrences(K)}"
_COUNTED = f"{_OCC},\ncounted AS (SELECT kmer, count(*) AS n FROM occ GROUP BY kmer)"
_KEYS = f"{_COUNTED},\nkeyed AS (SELECT {o.packed('kmer', K)} AS key, n FROM counted),\n{o.finalized('keyed', 'key')}"
_SAMPLE = f"{_KEYS},\nsample AS (SELECT key, u, n FROM fin ORDER BY u LIMIT {SAMPLE})"


# --- enumeration -------------------------------------------------------------------------------------------------


@query(f"WITH {o.dna()},\n{o.occurrences(21)}\nSELECT d.doc_id, greatest(length(d.seq) - 20, 0)::BIGINT AS n_windows, count(occ.pos)::BIGINT AS n_valid FROM dna d LEFT JOIN occ USING (doc_id) GROUP BY d.doc_id, n_windows")
def kmer_windows(spark, d):
    """Windows of 21 bases per document, and those without a break."""
    own = windows.valid_counts(_dna(spark, d), 21, "doc_id").groupBy("doc_id", "n_windows").agg(F.count("*").alias("_rows"), F.sum("n_valid").alias("_own"))
    # each document meets the windows of all documents with its id; a null id meets none
    n = F.when(F.col("doc_id").isNotNull(), F.col("_rows") * F.sum("_own").over(Window.partitionBy("doc_id"))).otherwise(0)
    return own.select("doc_id", "n_windows", n.alias("n_valid"))


@query(f"{_OCC}\nSELECT doc_id, count(DISTINCT kmer) AS n_distinct, min(kmer) AS least, max(kmer) AS most FROM occ GROUP BY doc_id")
def kmer_canonical(spark, d):
    return windows.extremes(_dna(spark, d), K, "doc_id", ids=_table(spark, d, "documents").select("doc_id"))


@query(f"WITH {o.dna()},\n{o.occurrences(21)}\nSELECT count(*) AS occurrences, count(DISTINCT raw) AS n_forward, count(DISTINCT kmer) AS n_canonical FROM occ")
def kmer_exact_distinct(spark, d):
    """Exact distinct counts of forward and canonical k-mers, a bin of minimizers at a time."""
    return abundance.kmer_totals(_dna(spark, d), 21)


@query(f"{_OCC}\nSELECT lang, count(*) AS occurrences, count(DISTINCT kmer) AS n_distinct FROM occ GROUP BY lang")
def kmer_distinct_by_lang(spark, d):
    return _counts(spark, d, K, ["lang"]).groupBy("lang").agg(F.sum("n").alias("occurrences"), F.count("*").alias("n_distinct"))


@query(f"{_COUNTED}\nSELECT kmer, n FROM counted ORDER BY n DESC, kmer LIMIT 50")
def kmer_counts_top(spark, d):
    return _counts(spark, d).orderBy(F.desc("n"), "key").limit(50).select(dna.unpacked("key", K).alias("kmer"), "n")


@query(f"{_COUNTED}\nSELECT n, count(*) AS keys FROM counted GROUP BY n")
def kmer_histogram(spark, d):
    return abundance.histogram(_counts(spark, d))


@query(f"{_COUNTED}\nSELECT count(*) AS f0, sum(n)::BIGINT AS total_occ, count(*) FILTER (n > 1 AND n < 4) AS abundance, count(*) FILTER (n >= 1) AS ge_x, count(*) FILTER (n <= 4) AS le_y FROM counted")
def kmer_abundance_regions(spark, d):
    return abundance.regions(_counts(spark, d), CONFIG.x, CONFIG.y)


@query(f"{_COUNTED}\nSELECT least(n, {CAP}) AS n, count(*) AS keys FROM counted GROUP BY 1")
def kmer_saturating_counts(spark, d):
    return abundance.histogram(_counts(spark, d).withColumn("n", F.least("n", F.lit(CAP).cast("bigint"))))


@query(f"""{_COUNTED}, h AS (SELECT n, count(*) AS keys FROM counted GROUP BY n)
SELECT sum(keys)::BIGINT AS f0, sum(n * keys)::BIGINT AS total_occ, coalesce(sum(keys) FILTER (n > 1 AND n < 4), 0)::BIGINT AS abundance FROM h""")
def kmer_histogram_regions(spark, d):
    """Class sizes out of a count-of-counts histogram."""
    h = abundance.histogram(_counts(spark, d))
    inside = F.sum(F.when(abundance.in_class("n", CONFIG.x, CONFIG.y), F.col("keys")))
    return h.agg(F.sum("keys").alias("f0"), F.sum(F.col("n") * F.col("keys")).alias("total_occ"), F.coalesce(inside, F.lit(0)).alias("abundance"))


@query(f"""WITH {o.dna()},
{o.occurrences(8)},
gap AS (SELECT doc_id, pos // 32 AS stripe, CASE WHEN pos - lag(pos) OVER w > 1 THEN 1 ELSE 0 END AS gap, pos FROM occ WINDOW w AS (PARTITION BY doc_id, pos // 32 ORDER BY pos)),
run AS (SELECT sum(gap) OVER (PARTITION BY doc_id, stripe ORDER BY pos) AS run FROM gap)
SELECT (SELECT count(*) FROM occ) AS uncapped, count(*) AS capped, round(100.0 * ((SELECT count(*) FROM occ) - count(*)) / (SELECT count(*) FROM occ), 6)::DOUBLE AS lost_percent FROM run WHERE run < 2""")
def kmer_capped_gap(spark, d):
    """Occurrences that a scan capped at two runs per stripe of 32 starts loses, at k = 8."""
    return windows.capped_gap(_dna(spark, d), 8, "doc_id", ids=_table(spark, d, "documents").select("doc_id")).withColumn("lost_percent", F.round("lost_percent", 6))


@query(f"WITH {o.dna()},\n{o.occurrences(K)}\nSELECT c.size AS size, count(occ.pos) AS occurrences, count(DISTINCT kmer) AS n_distinct FROM (VALUES (64), (256), (1000)) c(size), occ GROUP BY c.size")
def chunk_overlap_invariance(spark, d):
    """The same k-mers whatever the size of the chunks that sequences are cut into."""
    counted = abundance.chunked_counts(_dna(spark, d), K, [64, 256, 1000])
    return counted.groupBy("size").agg(F.sum("n").alias("occurrences"), F.count("*").alias("n_distinct"))


@query("""WITH c AS (SELECT unnest(string_split(regexp_replace(text, '[^A-Za-z]', '', 'g'), '')) AS b FROM documents)
SELECT code, complement, count(*) AS n FROM (SELECT CASE upper(b) WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 4 END AS code,
CASE upper(b) WHEN 'A' THEN 3 WHEN 'C' THEN 2 WHEN 'G' THEN 1 WHEN 'T' THEN 0 END AS complement FROM c WHERE b != '') GROUP BY code, complement""")
def base_codes(spark, d):
    """Base codes of the letters of all texts, in either case, and their complements."""
    letters = _table(spark, d, "documents").select(F.explode(F.split(F.regexp_replace("text", "[^A-Za-z]", ""), "")).alias("b")).where("b != ''")
    code = letters.groupBy("b").agg(F.count("*").alias("n")).withColumn("code", dna.base_code("b"))
    complement = F.when(F.col("code") < 4, dna.complement_code("code"))
    return code.groupBy("code", complement.alias("complement")).agg(F.sum("n").alias("n"))


# --- hashes ------------------------------------------------------------------------------------------------------


@query(f"WITH {o.dna()},\n{o.occurrences(8)},\n{o.rolling_hashes(8)}\nSELECT doc_id, count(*) AS n, bit_xor(h)::UBIGINT::VARCHAR AS all_xor, min(h)::UBIGINT::VARCHAR AS least FROM hashes GROUP BY doc_id")
def nthash_canonical(spark, d):
    """Canonical rolling hashes of every document at k = 8, in numpy batches, folded per document."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in batches:
            rows = []
            for i, s in zip(b.column("doc_id").to_pylist(), b.column("seq").to_pylist(), strict=True):
                _, h = dna.rolling_hashes(dna.CODES[np.frombuffer((s or "").encode(), np.uint8)], 8)
                if len(h):
                    rows.append((i, len(h), str(int(np.bitwise_xor.reduce(h))), str(int(h.min()))))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))], ["doc_id", "n", "all_xor", "least"])

    return _dna(spark, d).select("doc_id", "seq").mapInArrow(run, "doc_id long, n long, all_xor string, least string")


@query(f"WITH keys AS (SELECT DISTINCT user_id AS key FROM events WHERE user_id IS NOT NULL),\n{o.finalized('keys', 'key')}\nSELECT key, {o.signed('u')} AS finalizer FROM fin")
def xxhash_finalizer(spark, d):
    return _table(spark, d, "events").select(F.col("user_id").alias("key")).where("key is not null").distinct().select("key", bits.finalize("key").alias("finalizer"))


@query(f"SELECT o_orderkey, ((o_custkey * 2 + 1) % 1000 + 1)::INTEGER AS n, (CASE WHEN o_custkey % 500 > 255 THEN 255 ELSE o_custkey % 500 END)::INTEGER AS register, length(bin((o_custkey % 500)::BIGINT))::INTEGER AS counter_bits FROM orders")
def pack_registers(spark, d):
    """Registers as bytes, and the bits that a counter needs."""
    v = F.col("o_custkey") % 500
    return _table(spark, d, "orders").select("o_orderkey", ((F.col("o_custkey") * 2 + 1) % 1000 + 1).cast("int").alias("n"), bits.pack_register(v).alias("register"), bits.counter_bits(v).alias("counter_bits"))


@query("SELECT a.n_nationkey AS i, b.n_nationkey AS j, (a.n_nationkey * (2 * 25 - a.n_nationkey - 1) // 2 + b.n_nationkey - a.n_nationkey - 1)::BIGINT AS place FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey")
def pair_linear_index(spark, d):
    """Places of all pairs of nations in the upper triangle."""
    n = _table(spark, d, "nation").select("n_nationkey")
    a, b = n.select(F.col("n_nationkey").alias("i")), n.select(F.col("n_nationkey").alias("j"))
    return a.join(F.broadcast(b), F.col("i") < F.col("j")).select("i", "j", bits.pair_index("i", "j", F.lit(25)).alias("place"))


# --- abundance samples -------------------------------------------------------------------------------------------


def _sample(spark, d) -> DataFrame:
    return abundance.bottom_k(_counts(spark, d), "key", SAMPLE)


def _below(spark, d, sample: DataFrame) -> DataFrame:
    """(key, n): a second pass over all occurrences, counting the keys up to the tau of a sample."""
    tau = abundance.tau(sample, SAMPLE).first().tau
    return abundance.kmer_counts(_dna(spark, d), K, below=tau % (1 << 64))


@query(f"{_SAMPLE}\nSELECT {o.signed('max(u)')} AS tau, count(*) AS n_distinct, sum(n)::BIGINT AS n_occ, count(*) >= {SAMPLE} AS \"full\" FROM sample")
def bottomk_tau(spark, d):
    return abundance.tau(_sample(spark, d), SAMPLE)


@query(f"{_SAMPLE}\nSELECT key, {o.signed('u')} AS finalizer, n FROM sample")
def bottomk_sample(spark, d):
    return _sample(spark, d)


@query(f"""WITH {o.dna()},
{o.occurrences(8)},
{o.rolling_hashes(8)},
own AS (SELECT h, count(*) AS n FROM hashes GROUP BY h),
keyed AS (SELECT {o.signed('h')} AS key, n FROM own),
{o.finalized('keyed', 'key')}
SELECT key, {o.signed('u')} AS finalizer, least(n, {CAP}) AS n FROM fin ORDER BY u LIMIT {SAMPLE}""")
def nthash_sample(spark, d):
    """Bottom-k sample of rolling hashes at k = 8, kept small in every task."""
    return abundance.kmer_sample(_dna(spark, d).select("seq"), 8, SAMPLE, CAP)


@query(f"{_SAMPLE}\nSELECT key, least(n, {CAP}) AS n FROM sample")
def bottomk_counted_below_tau(spark, d):
    """Second pass: capped counts of the keys up to tau."""
    return _below(spark, d, _sample(spark, d)).withColumn("n", F.least("n", F.lit(CAP).cast("bigint")))


@query(f"{_SAMPLE}, below AS (SELECT key, n FROM fin WHERE u <= (SELECT max(u) FROM sample))\nSELECT count(*) FILTER (s.n IS DISTINCT FROM b.n) AS n_mismatches FROM sample s FULL JOIN below b USING (key)")
def retained_vs_truth(spark, d):
    """Sampled counts against a second pass over all occurrences: none may differ."""
    sample = _staged(spark, _sample(spark, d))
    return abundance.mismatches(sample.select("key", "n"), _below(spark, d, sample), "key")


_REGION = "SELECT '{0}' AS region, count(*) FILTER ({1}) AS in_sample, count(*) AS m, (SELECT count(*) FROM keyed)::DOUBLE AS f0 FROM sample"


@query(f"""{_SAMPLE}, r AS ({" UNION ALL ".join(_REGION.format(*x) for x in (("abundance", "n > 1 AND n < 4"), ("ge_x", "n >= 1"), ("le_y", "n <= 4")))}),
p AS (SELECT *, in_sample::DOUBLE / m AS p_hat, f0 * (in_sample::DOUBLE / m) AS point FROM r),
s AS (SELECT *, CASE WHEN in_sample > 0 THEN point * sqrt((1 - p_hat) / (p_hat * m)) ELSE 0 END AS sigma FROM p)
SELECT region, in_sample, m, round(p_hat, 6) AS p_hat, round(point, 3) AS point, round(sigma, 3) AS sigma, round(greatest(0, point - 1.645 * sigma), 3) AS lo, round(point + 1.645 * sigma, 3) AS hi FROM s""")
def abundance_estimate(spark, d):
    """Class sizes from the sample: point, standard deviation and two-sided bounds."""
    counted = _staged(spark, _counts(spark, d))
    f0 = counted.count()
    e = abundance.estimate_regions(abundance.bottom_k(counted, "key", SAMPLE), f0, CONFIG)
    return e.select("region", "in_sample", "m", F.round("p_hat", 6).alias("p_hat"), *[F.round(c, 3).alias(c) for c in ("point", "sigma", "lo", "hi")])


@query()
def abundance_upper(spark, d):
    """One-sided upper bounds of the class sizes (Clopper-Pearson)."""
    counted = _staged(spark, _counts(spark, d))
    e = abundance.estimate_regions(abundance.bottom_k(counted, "key", SAMPLE), counted.count(), CONFIG)
    return e.select("region", F.round("upper", 3).alias("upper"))


# --- sketches ----------------------------------------------------------------------------------------------------


def _event_registers(spark, d, p: int = P) -> DataFrame:
    return sketch.registers(_table(spark, d, "events"), "user_id", ["event_type"], p)


_REGS = f"WITH {o.registers('events', 'event_type', 'user_id', P)}"
_SUMS = "SELECT {by}, sum(pow(2.0, -rho)) AS s, count(*) AS c FROM {of} GROUP BY {by}"


@query(f"{_REGS}\nSELECT event_type, idx, rho FROM regs")
def hll_registers(spark, d):
    return _event_registers(spark, d)


@query(f"{_REGS}\nSELECT idx, max(rho) AS rho FROM regs GROUP BY idx")
def hll_merge_union(spark, d):
    return sketch.merged(_event_registers(spark, d))


@query(f"{_REGS}, sums AS ({_SUMS.format(by='event_type', of='regs')})\nSELECT event_type, round({o.classic('s', 'c', P)}, 4) AS estimate FROM sums")
def hll_estimate_classic(spark, d):
    return sketch.estimates(_event_registers(spark, d), ["event_type"], P).withColumn("estimate", F.round("estimate", 4))


@query("SELECT event_type, count(DISTINCT user_id) AS n_distinct, count(DISTINCT user_id) IS NOT NULL AS within_4_sigma FROM events GROUP BY event_type")
def hll_estimate_builtin(spark, d):
    """Spark's bias-corrected estimate at the same precision lies within four standard errors of the exact count."""
    exact = F.count_distinct("user_id")
    near = F.abs(F.col("estimate") - F.col("n_distinct")) <= 4 * 1.04 / 2 ** (P / 2) * F.col("n_distinct")
    own = _table(spark, d, "events").groupBy("event_type")
    both = own.agg(exact.alias("n_distinct")).join(own.agg(sketch.builtin_estimate("user_id", P).alias("estimate")), "event_type")
    return both.select("event_type", "n_distinct", near.alias("within_4_sigma"))


@query(f"""WITH {o.dna()},
{o.occurrences(8)},
{o.rolling_hashes(8)},
own AS (SELECT DISTINCT lang, {o.signed('h')} AS key FROM hashes JOIN documents USING (doc_id)),
{o.registers('own', 'lang', 'key', 14)},
sums AS ({_SUMS.format(by='lang', of='regs')})
SELECT lang, round({o.classic('s', 'c', 14)}, 4) AS estimate FROM sums""")
def hll_kmer_estimate_short(spark, d):
    """``hll_kmer_estimate`` at k = 8, where SQL can hash every window too."""
    return sketch.estimates(sketch.kmer_registers(_dna(spark, d), 8, ["lang"], 14), ["lang"], 14).withColumn("estimate", F.round("estimate", 4))


@query()
def hll_kmer_estimate(spark, d):
    """k-mers of the documents, k = 21, per language, hashed in numpy batches that leave registers only."""
    return sketch.estimates(sketch.kmer_registers(_dna(spark, d), 21, ["lang"], 14), ["lang"], 14).withColumn("estimate", F.round("estimate", 4))


_PAIR = f"""e AS (SELECT event_type, {o.classic('s', 'c', P)} AS e FROM sums),
pair AS (SELECT i, j, {o.classic('s', 'c', P)} AS u FROM (SELECT i, j, sum(pow(2.0, -rho)) AS s, count(*) AS c FROM (SELECT i, j, idx, max(rho) AS rho FROM (SELECT a.event_type AS i, b.event_type AS j FROM e a, e b WHERE a.event_type < b.event_type) JOIN regs ON event_type IN (i, j) GROUP BY i, j, idx) GROUP BY i, j))"""


@query(f"{_REGS}, sums AS ({_SUMS.format(by='event_type', of='regs')}), {_PAIR}\nSELECT i, j, round((a.e + b.e - u) / u, 6) AS jaccard FROM pair JOIN e a ON a.event_type = i JOIN e b ON b.event_type = j")
def pairwise_jaccard_hll(spark, d):
    return pairwise.jaccard(_event_registers(spark, d), "event_type", P).withColumn("jaccard", F.round("jaccard", 6))


@query(f"{_REGS}, sums AS ({_SUMS.format(by='event_type', of='regs')}), {_PAIR}\nSELECT i, j, round((a.e + b.e - u) / u, 6) AS jaccard FROM pair JOIN e a ON a.event_type = i JOIN e b ON b.event_type = j WHERE (a.e + b.e - u) / u >= 0.5")
def pairwise_jaccard_threshold(spark, d):
    return pairwise.jaccard(_event_registers(spark, d), "event_type", P, 0.5).withColumn("jaccard", F.round("jaccard", 6))


@query(f"{_REGS}, sums AS ({_SUMS.format(by='event_type', of='regs')}), {_PAIR}\nSELECT i, j, round((a.e + b.e - u) / u, 6) AS jaccard FROM pair JOIN e a ON a.event_type = i JOIN e b ON b.event_type = j UNION ALL SELECT least('empty', event_type), greatest('empty', event_type), 0.0 FROM e")
def pairwise_jaccard_empty(spark, d):
    """A sketch without any register is a sketch."""
    regs = _event_registers(spark, d)
    items = regs.select("event_type").distinct().unionByName(spark.range(1).select(F.lit("empty").alias("event_type")))
    return pairwise.jaccard(regs, "event_type", P, 0.0, items).withColumn("jaccard", F.round("jaccard", 6))


@query(f"{_REGS}, sums AS ({_SUMS.format(by='event_type', of='regs')}), {_PAIR}\nSELECT round(greatest(0, a.e + b.e - u), 4) AS estimate FROM pair JOIN e a ON a.event_type = i JOIN e b ON b.event_type = j WHERE i = 'click' AND j = 'view'")
def hll_intersect_2way(spark, d):
    return sketch.intersect_many(_event_registers(spark, d), "event_type", ["click", "view"], P).select(F.round("estimate", 4).alias("estimate"))


_MASKS = ", ".join(f"({m}, '{t}')" for m in range(1, 8) for i, t in enumerate(TYPES) if m >> i & 1)


@query(f"""{_REGS}, mask(mask, event_type) AS (VALUES {_MASKS}),
sums AS (SELECT mask, sum(pow(2.0, -rho)) AS s, count(*) AS c FROM (SELECT mask, idx, max(rho) AS rho FROM mask JOIN regs USING (event_type) GROUP BY mask, idx) GROUP BY mask)
SELECT round(greatest(0, sum(CASE WHEN bit_count(mask) % 2 = 1 THEN 1 ELSE -1 END * {o.classic('s', 'c', P)})), 4) AS estimate FROM sums""")
def hll_intersect_nway(spark, d):
    return sketch.intersect_many(_event_registers(spark, d), "event_type", TYPES, P).select(F.round("estimate", 4).alias("estimate"))


@query(f"""{_OCC}, own AS (SELECT DISTINCT lang, kmer FROM occ), n AS (SELECT lang, count(*) AS n FROM own GROUP BY lang)
SELECT i, j, shared, round(shared::DOUBLE / (a.n + b.n - shared), 9) AS jaccard FROM (SELECT a.lang AS i, b.lang AS j, count(*) AS shared FROM own a JOIN own b USING (kmer) WHERE a.lang < b.lang GROUP BY ALL) JOIN n a ON a.lang = i JOIN n b ON b.lang = j""")
def pairwise_jaccard_exact(spark, d):
    return pairwise.exact_jaccard(_counts(spark, d, K, ["lang"]), "lang", "key").withColumn("jaccard", F.round("jaccard", 9))


@query(f"{_OCC}\nSELECT count(*) AS n_shared FROM (SELECT kmer FROM occ WHERE lang = 'en' INTERSECT SELECT kmer FROM occ WHERE lang = 'fr')")
def kmer_exact_intersection(spark, d):
    k = _counts(spark, d, K, ["lang"])
    return k.where("lang = 'en'").select("key").intersect(k.where("lang = 'fr'").select("key")).agg(F.count("*").alias("n_shared"))


# --- sources -----------------------------------------------------------------------------------------------------


def _records(docs: DataFrame, record) -> DataFrame:
    """(value): ``record(doc_id, seq)`` of the documents with an id and a text."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            own = zip(b.column("doc_id").to_pylist(), b.column("seq").to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([record(i, s) for i, s in own], pa.string())], ["value"])

    return docs.select("doc_id", "seq").where("seq is not null").mapInArrow(run, "value string")


def _written(spark, lines: DataFrame, option: dict) -> list[str]:
    """Write lines as text files and list them."""
    folder = f"{scratch_dir(spark)}/text-{uuid.uuid4().hex[:12]}"
    lines.write.options(**option).text(folder)
    return [r[0] for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path").collect()]


def _windows_of(spark, paths: list[str], k: int) -> DataFrame:
    rows = sequences.read_sequences(spark, paths, k).select("seq")
    return abundance.kmer_totals(rows, k).select("occurrences", F.col("n_canonical").alias("n_distinct"))


_WINDOWS = f"WITH {o.dna()},\n{o.occurrences(21)}\nSELECT count(*) AS occurrences, count(DISTINCT kmer) AS n_distinct FROM occ"


@query(_WINDOWS)
def fasta_concat(spark, d):
    """Documents as FASTA (gzip), through the reader: lines of 70 bases, a header per record."""
    def record(i, seq):
        return f">doc{i}\n" + "\n".join([seq[j : j + 70] for j in range(0, len(seq), 70)])

    lines = _records(_dna(spark, d), record)
    return _windows_of(spark, _written(spark, lines, {"compression": "gzip"}), 21)


@query(_WINDOWS)
def fastq_mod4(spark, d):
    """Documents as FASTQ: only the second of four lines counts, whatever the others hold."""
    lines = _records(_dna(spark, d), lambda i, seq: f"@doc{i}\n{seq}\n+\n{'@' * len(seq)}")
    return _windows_of(spark, _written(spark, lines, {}), 21)


@query("""WITH s AS (SELECT CASE WHEN url LIKE '%1' THEN 4 WHEN url LIKE '%2' THEN 8 ELSE 1 END * strlen(html)::BIGINT AS s FROM pages)
SELECT count(*) AS n, list_sort(list(s))[count(*) // 2 + 1] AS median, max(s) AS largest, sum(s)::BIGINT AS total FROM s""")
def input_survey(spark, d):
    """Number, upper median, largest and total size of inputs, compressed ones by what they grow to."""
    suffix = F.when(F.col("url").endswith("1"), ".gz").when(F.col("url").endswith("2"), ".zst").otherwise("")
    files = _table(spark, d, "pages").select(F.concat(F.lit("f.fa"), suffix).alias("path"), F.octet_length("html").cast("bigint").alias("size"))
    return sequences.survey(files)


@query("""SELECT page_id, name, regexp_matches(name, '\\.(fasta|fa|fna|fastq|fq)(\\.(gz|zst))?$', 'i') AS is_input FROM
(SELECT page_id, 'p' || page_id || (['.fa', '.FASTA.gz', '.fq.zst', '.txt', '.fa.bz2', ''])[(page_id % 6) + 1] AS name FROM pages)""")
def input_validate(spark, d):
    ends = F.array(*[F.lit(x) for x in (".fa", ".FASTA.gz", ".fq.zst", ".txt", ".fa.bz2", "")])
    name = F.concat(F.lit("p"), F.col("page_id").cast("string"), F.element_at(ends, (F.col("page_id") % 6 + 1).cast("int")))
    return _table(spark, d, "pages").select("page_id", name.alias("name")).select("page_id", "name", sequences.is_input_name("name").alias("is_input"))


@query(f"""{_REGS}, sums AS ({_SUMS.format(by='event_type', of='regs')}), u AS (SELECT idx, max(rho) AS rho FROM regs GROUP BY idx)
SELECT event_type AS name, round({o.classic('s', 'c', P)})::BIGINT AS estimate FROM sums UNION ALL SELECT 'UNION', round({o.classic('s', 'c', P)})::BIGINT FROM (SELECT sum(pow(2.0, -rho)) AS s, count(*) AS c FROM u)""")
def union_report(spark, d):
    """Estimates per item and, last, of their union: the rows of the tab-separated report."""
    regs = _event_registers(spark, d)
    each = sketch.estimates(regs, ["event_type"], P).select(F.col("event_type").alias("name"), F.round("estimate").cast("bigint").alias("estimate"))
    return each.unionByName(sketch.estimates(sketch.merged(regs), p=P).select(F.lit("UNION").alias("name"), F.round("estimate").cast("bigint").alias("estimate")))


@query(f"{_REGS}\nSELECT event_type, idx, rho FROM regs")
def hll_file_round_trip(spark, d):
    """Registers written as sketch files and read back."""
    from ..sources import hll

    folder = f"{scratch_dir(spark)}/hll-{uuid.uuid4().hex[:12]}"
    marker = spark.createDataFrame([(0,)], "x int")
    marker.write.mode("overwrite").parquet(f"{folder}/made")  # makes the folder on any store
    names = hll.write_sketches(_event_registers(spark, d), folder, "event_type", 21, True, P)
    names.count()
    back = hll.read_sketches(spark, folder)
    return back.select(F.regexp_extract("path", r"([^/]+)\.hll$", 1).alias("event_type"), "idx", "rho")


# --- streams -----------------------------------------------------------------------------------------------------


def _stream(spark, d, name: str) -> DataFrame:
    """A table as a stream of its files."""
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/{name}.parquet*")


@query(f"{_REGS}\nSELECT event_type, idx, rho FROM regs")
def stream_registers(spark, d):
    """Registers that grew with a stream of the events: the same as the batch query's."""
    folder = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex[:12]}"
    own = streams.RegisterStream(f"{folder}/state", "user_id", ["event_type"], P, "event_type string")
    own.start(_stream(spark, d, "events"), f"{folder}/checkpoint").awaitTermination()
    return own.state.latest(spark)


@query(f"WITH keys AS (SELECT user_id AS key, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY user_id),\n{o.finalized('keys', 'key')}\nSELECT key, n FROM fin ORDER BY u LIMIT 100")
def stream_bottomk(spark, d):
    """The bottom-100 sample of a stream of user ids, with exact counts."""
    folder = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex[:12]}"
    own = streams.BottomKStream(f"{folder}/state", "user_id", 100)
    own.start(_stream(spark, d, "events"), f"{folder}/checkpoint").awaitTermination()
    return own.state.latest(spark)

