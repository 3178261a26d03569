"""DNA strings as Spark columns, and 64-bit rolling k-mer hashes of whole Arrow batches in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz0123456789", "ACGTACGTACGTACGTACGTACGTACNNNNNNNNNN"

#: Window starts of one chunk: substring walks from the start of its row, so rows are cut first.
CHUNK = 256


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def from_text(text: str | Column) -> Column:
    """Any text as DNA: ASCII letters go to A, C, G, T in turn, digits break windows, the rest goes."""
    return F.translate(F.lower(F.regexp_replace(_col(text), "[^A-Za-z0-9]", "")), LETTERS, BASES)


#: ``from_text`` on bytes: what letters and digits become, and the bytes that go.
_KEPT = bytes.maketrans((LETTERS + LETTERS[:26].upper()).encode(), (BASES + BASES[:26]).encode())
_GONE = bytes(i for i in range(256) if not (i < 128 and chr(i).isalnum()))


def texts_as_dna(df: DataFrame, text: str = "text", seq: str = "seq") -> DataFrame:
    """The rows with column ``seq`` in the place of ``text``: ``from_text`` as one pass over bytes, some hundred times faster than the
    column, which makes a string of every character."""
    rest = [c for c in df.columns if c != text]

    def run(batches):
        for b in batches:
            made = [s.as_buffer().to_pybytes().translate(_KEPT, _GONE) if s.is_valid else None for s in b.column(text)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(made, pa.binary()).cast(pa.string())], [*rest, seq])

    fields = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in rest)
    return df.select(*rest, text).mapInArrow(run, f"{fields}`{seq}` string")


def base_code(base: str | Column) -> Column:
    """0 to 3 for A, C, G, T in either case; 4 for anything else."""
    b = F.upper(_col(base))
    return F.when(b.isin("A", "C", "G", "T"), F.translate(b, "ACGT", "0123").cast("int")).otherwise(4)


def complement_code(code: str | Column) -> Column:
    return _col(code).bitwiseXOR(F.lit(3))


def reverse_complement(kmer: str | Column) -> Column:
    return F.reverse(F.translate(_col(kmer), "ACGTacgt", "TGCATGCA"))


def canonical(kmer: str | Column) -> Column:
    """The smaller of a k-mer (upper case) and its reverse complement, in string order."""
    return F.least(_col(kmer), reverse_complement(kmer))


def packed(kmer: str | Column) -> Column:
    """Two bits a base, for k up to 31 (a BIGINT is signed)."""
    return F.conv(F.translate(_col(kmer), "ACGT", "0123"), 4, 10).cast("bigint")


def chunks(df: DataFrame, k: int, seq: str = "seq", size: int = CHUNK) -> DataFrame:
    """Rows cut into ``size`` window starts each, with k - 1 bases of overlap: seq becomes the chunk, column offset
    its place (from 0). Every window start is in one chunk. Sequences shorter than k give no row."""
    n = F.length(seq) - (k - 1)
    cut = df.where(F.length(seq) >= k).withColumn("_i", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))))
    cut = cut.withColumn("offset", (F.col("_i") * size).cast("bigint"))
    return cut.withColumn(seq, F.substr(seq, (F.col("_i") * size + 1).cast("int"), F.lit(size + k - 1))).drop("_i")


def kmers(df: DataFrame, k: int, seq: str = "seq", is_canonical: bool = True) -> DataFrame:
    """One row per k-mer occurrence: the columns but ``seq``, pos (of its start, from 0) and kmer (upper case).

    Windows with a base other than A, C, G, T give no row; a null or short sequence gives none.
    """
    if k < 1:
        raise ValueError("k must be positive")
    cut = chunks(df.withColumn(seq, F.upper(F.col(seq))), k, seq)
    starts = F.sequence(F.lit(1), F.length(seq) - (k - 1))
    windows = F.transform(starts, lambda i: F.struct((i - 1).alias("at"), F.substr(F.col(seq), i, F.lit(k)).alias("kmer")))
    rows = cut.withColumn("_w", F.explode(windows)).where(~F.col("_w.kmer").rlike("[^ACGT]"))
    kmer = canonical("_w.kmer") if is_canonical else F.col("_w.kmer")
    rest = [c for c in df.columns if c != seq]
    return rows.select(*rest, (F.col("offset") + F.col("_w.at")).alias("pos"), kmer.alias("kmer"))


# The 64-bit seed of each base of the rolling hash.
SEEDS = {
    "A": 0x3C8BFBB395C60474,
    "C": 0x3193C18562A02B4C,
    "G": 0x20323ED082572324,
    "T": 0x295549F54BE24456,
}
_FORWARD = np.array([*SEEDS.values(), 0], np.uint64)
_COMPLEMENT = np.array([*list(SEEDS.values())[::-1], 0], np.uint64)

CODES = np.full(256, 4, np.uint8)
for _i, _b in enumerate("ACGT"):
    CODES[ord(_b)] = CODES[ord(_b.lower())] = _i


def _rot(x: np.ndarray, left: np.ndarray) -> np.ndarray:
    left = (left & 63).astype(np.uint64)
    return x << left | x >> (np.uint64(64) - left & np.uint64(63))


def rolling_hashes(codes: np.ndarray, k: int, is_canonical: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the windows of k valid codes.

    A window's hash is the XOR of its bases' seeds, each rotated by its place. With every seed rotated back by its place in
    the whole array, that is the XOR of two prefix XORs, rotated once: no window depends on the one before.
    """
    m = len(codes) - k + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    bad = np.append(0, np.cumsum(codes == 4))
    starts = np.flatnonzero(bad[k:] == bad[:-k])
    place = np.arange(len(codes))

    def prefix(seeds, turn):
        return np.append(np.uint64(0), np.bitwise_xor.accumulate(_rot(seeds[codes], turn)))

    p = prefix(_FORWARD, -place)
    h = _rot(p[starts + k] ^ p[starts], starts + k - 1)
    if is_canonical:
        q = prefix(_COMPLEMENT, place)
        h = np.minimum(h, _rot(q[starts + k] ^ q[starts], -starts))
    return starts, h


def packed_all(two: np.ndarray, k: int, word: type = np.uint64) -> np.ndarray:
    """Keys of all windows of k two-bit codes, at least one, of an array of type ``word``: windows double in width, so a key costs
    about 2 log2 k steps, not k."""
    m = len(two) - k + 1
    x, out, have, width, left = two, None, 0, 1, k
    while left:
        if left & 1:
            out = x[:m].copy() if out is None else out << word(2 * width) | x[have : have + m]
            have += width
        left >>= 1
        if left:
            x = x[:-width] << word(2 * width) | x[width:]
            width *= 2
    return out


def valid_starts(codes: np.ndarray, k: int) -> np.ndarray:
    """Whether the window of k codes that starts at a place has no break, for all len(codes) - k + 1 places."""
    bad = np.cumsum(np.append(np.int32(0), codes == 4), dtype=np.int32)
    return bad[k:] == bad[:-k]


def packed_windows(codes: np.ndarray, k: int, is_canonical: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(starts, keys) of the windows of k valid codes, two bits a base: the order of keys is that of k-mers."""
    m = len(codes) - k + 1
    if m <= 0 or k > 32:
        if k > 32:
            raise ValueError("k must be at most 32")
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts = np.flatnonzero(valid_starts(codes, k))
    word = np.uint32 if k <= 16 else np.uint64
    two = (codes & 3).astype(word)
    keys = packed_all(two, k, word)[starts]
    if is_canonical:
        keys = np.minimum(keys, packed_all((word(3) - two)[::-1], k, word)[::-1][starts])
    return starts, keys.astype(np.uint64)


def reverse_complement_keys(keys: np.ndarray, k: int) -> np.ndarray:
    """The two-bit keys of the reverse complements of two-bit keys (uint64)."""
    x = ~keys
    for width, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        x = x >> np.uint64(width) & np.uint64(mask) | (x & np.uint64(mask)) << np.uint64(width)
    return x >> np.uint64(64 - 2 * k)


def cut_codes(codes: np.ndarray, k: int, size: int) -> np.ndarray:
    """One sequence cut into ``size`` window starts each, with k - 1 codes of overlap and a break after each: every window starts in
    exactly one, as in ``chunks``."""
    n = -(-(len(codes) - k + 1) // size)
    if n <= 0:
        return codes[:0]
    whole = np.full(n * size + k - 1, 4, np.uint8)
    whole[: len(codes)] = codes
    out = np.full((n, size + k), 4, np.uint8)
    out[:, :-1] = np.lib.stride_tricks.sliding_window_view(whole, size + k - 1)[::size]
    return out.ravel()


#: Bases that a numpy pass takes at once: about 100 bytes each.
PASS_BASES = 1 << 19


def passes(codes: np.ndarray, k: int):
    """(first place, codes) of parts with k - 1 places of overlap: every window starts in exactly one."""
    for i in range(0, max(len(codes) - k + 1, 1), PASS_BASES):
        yield i, codes[i : i + PASS_BASES + k - 1]


def reverse_complement_key(key: str | Column, k: int) -> Column:
    """The two-bit key of the reverse complement of a two-bit key, k at most 31."""
    x = F.bitwise_not(_col(key))
    for width, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        x = F.shiftrightunsigned(x, width).bitwiseAND(F.lit(mask)).bitwiseOR(F.shiftleft(x.bitwiseAND(F.lit(mask)), width))
    return F.shiftrightunsigned(x, 64 - 2 * k)


def unpacked(key: str | Column, k: int) -> Column:
    """The k-mer of a two-bit key, k at most 31."""
    return F.translate(F.lpad(F.conv(_col(key).cast("string"), 10, 4), k, "0"), "0123", "ACGT")


# The primes of xxHash64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def finalize(keys: np.ndarray) -> np.ndarray:
    """xxHash64 with seed 0 of 8-byte keys, as ``functions.bits.finalize`` gives it."""
    turn = lambda x, r: x << np.uint64(r) | x >> np.uint64(64 - r)
    h = np.uint64(int(_P5) + 8) ^ turn(keys * _P2, 31) * _P1
    h = turn(h, 27) * _P1 + _P4
    h = (h ^ h >> np.uint64(33)) * _P2
    h = (h ^ h >> np.uint64(29)) * _P3
    return h ^ h >> np.uint64(32)
