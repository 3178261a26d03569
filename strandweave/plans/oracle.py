"""SQL pieces that say in DuckDB what the library's expressions say in Spark."""

from __future__ import annotations

from ..functions.dna import BASES, LETTERS, SEEDS

TWO64 = "18446744073709551616::UHUGEINT"


def dna() -> str:
    return f"dna AS (SELECT doc_id, lang, source, translate(lower(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')), '{LETTERS}', '{BASES}') AS seq FROM documents)"


def occurrences(k: int, name: str = "occ") -> str:
    """Needs dna: (doc_id, lang, source, pos, raw, kmer), kmer canonical."""
    return f"""{name}_w AS (SELECT doc_id, lang, source, seq, unnest(range(1, length(seq) - {k} + 2)) AS i FROM dna WHERE length(seq) >= {k}),
{name}_r AS (SELECT doc_id, lang, source, i - 1 AS pos, substring(seq, i, {k}) AS raw FROM {name}_w),
{name} AS (SELECT doc_id, lang, source, pos, raw, least(raw, reverse(translate(raw, 'ACGT', 'TGCA'))) AS kmer FROM {name}_r WHERE NOT contains(raw, 'N'))"""


def signed(x: str) -> str:
    return f"(CASE WHEN {x} >= 9223372036854775808::UHUGEINT THEN ({x})::HUGEINT - 18446744073709551616::HUGEINT ELSE ({x})::HUGEINT END)::BIGINT"


def _times(x: str, c: int) -> str:
    return f"(({x}) * {c}::UHUGEINT % {TWO64})"


def rotl(x: str, r: int) -> str:
    return f"(({x}) * {1 << r}::UHUGEINT % {TWO64} + ({x}) // {1 << (64 - r)}::UHUGEINT)"


def finalized(source: str, key: str, name: str = "fin") -> str:
    """CTEs that add u (xxHash64 of the BIGINT ``key``, seed 0, as UHUGEINT) to the rows of ``source``."""
    p1, p2, p3, p4, p5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
    step = lambda n, expr, of: f"{name}_{n} AS (SELECT * EXCLUDE (u), {expr} AS u FROM {of})"
    u = f"(CASE WHEN {key} < 0 THEN {key}::HUGEINT + 18446744073709551616::HUGEINT ELSE {key}::HUGEINT END)::UHUGEINT"
    parts = [
        f"{name}_0 AS (SELECT *, {u} AS u FROM {source})",
        step(1, _times("u", p2), f"{name}_0"),
        step(2, _times(rotl("u", 31), p1), f"{name}_1"),
        step(3, f"xor(u, {p5 + 8}::UHUGEINT)", f"{name}_2"),
        step(4, f"({_times(rotl('u', 27), p1)} + {p4}::UHUGEINT) % {TWO64}", f"{name}_3"),
        step(5, _times(f"xor(u, u // {1 << 33}::UHUGEINT)", p2), f"{name}_4"),
        step(6, _times(f"xor(u, u // {1 << 29}::UHUGEINT)", p3), f"{name}_5"),
        f"{name} AS (SELECT * EXCLUDE (u), xor(u, u // {1 << 32}::UHUGEINT) AS u FROM {name}_6)",
    ]
    return ",\n".join(parts)


def packed(kmer: str, k: int) -> str:
    """Two bits a base, most significant first."""
    return " + ".join(f"(instr('ACGT', substring({kmer}, {i + 1}, 1)) - 1)::BIGINT * {4 ** (k - 1 - i)}" for i in range(k))


def registers(source: str, by: str, key: str, p: int, name: str = "regs") -> str:
    """CTEs: (by, idx, rho) of distinct keys; rows of ``source`` with a null key don't count."""
    rest = f"(u * {1 << p}::UHUGEINT % {TWO64} + {1 << (p - 1)}::UHUGEINT)"
    return f"""{name}_k AS (SELECT DISTINCT {by}, {key} AS key FROM {source} WHERE {key} IS NOT NULL),
{finalized(f"{name}_k", "key", f"{name}_f")},
{name} AS (SELECT {by}, (u // {1 << (64 - p)}::UHUGEINT)::INTEGER AS idx,
  max(CASE WHEN {rest} // 4294967296::UHUGEINT > 0 THEN 65 - (length(bin(({rest} // 4294967296::UHUGEINT)::UBIGINT)) + 32) ELSE 65 - length(bin(({rest} % 4294967296::UHUGEINT)::UBIGINT)) END)::INTEGER AS rho
  FROM {name}_f GROUP BY {by}, idx)"""


def classic(part: str, present: str, p: int) -> str:
    m = 1 << p
    am2 = 0.7213 / (1 + 1.079 / m) * m * m
    e = f"({am2!r}::DOUBLE / ({part} + ({m} - {present})))"
    return f"(CASE WHEN {e} <= {2.5 * m} AND {m} - {present} > 0 THEN {m}::DOUBLE * ln({m}::DOUBLE / ({m} - {present})) ELSE {e} END)"


def rolling_hashes(k: int, occ: str = "occ") -> str:
    """CTEs: (doc_id, pos, h UHUGEINT), the canonical rolling hash of every raw window of ``occ``."""
    seeds = {b: s for b, s in zip("ACGT", SEEDS.values(), strict=True)}
    comp = {b: seeds[c] for b, c in zip("ACGT", "TGCA", strict=True)}
    turn = lambda s, r: (s << r | s >> (64 - r)) & (1 << 64) - 1 if r else s
    rows = ", ".join(f"('{b}', {j}, {turn(seeds[b], k - 1 - j)}::UBIGINT, {turn(comp[b], j)}::UBIGINT)" for b in "ACGT" for j in range(k))
    return f"""seed(base, j, f, r) AS (VALUES {rows}),
base AS (SELECT doc_id, pos, j, substring(raw, j::INTEGER + 1, 1) AS base FROM (SELECT doc_id, pos, raw, unnest(range(0, {k})) AS j FROM {occ})),
hashes AS (SELECT doc_id, pos, least(bit_xor(f), bit_xor(r)) AS h FROM base JOIN seed USING (base, j) GROUP BY doc_id, pos)"""
