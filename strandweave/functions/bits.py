"""64-bit hash arithmetic on Spark columns. BIGINT holds the bits; order is unsigned where it says so.

Multiplications would overflow under ANSI mode, so nothing here multiplies: Spark's own xxhash64 does
it. Shifts and XOR don't overflow.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spark chains xxhash64 from seed 42: the hash of one argument seeds the next. This key hashes to 0 under
#: seed 42, so the argument after it is hashed with seed 0.
SEED_ZERO = -365884300664092260

_MIN = "(-9223372036854775807L - 1)"


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def flip(x: str | Column) -> Column:
    """Moves unsigned order onto signed order (and back): order by this."""
    return _col(x).bitwiseXOR(F.expr(_MIN))


def unsigned_least(a: Column, b: Column) -> Column:
    return F.when(flip(a) < flip(b), a).otherwise(b)


def rotl(x: Column, r: int) -> Column:
    r &= 63
    return x if not r else F.shiftleft(x, r).bitwiseOR(F.shiftrightunsigned(x, 64 - r))


def rotr(x: Column, r: int) -> Column:
    return rotl(x, -r & 63)


def finalize(key: str | Column) -> Column:
    """xxHash64 with seed 0 of a BIGINT key: a bijection, so distinct keys keep distinct values."""
    return F.xxhash64(F.lit(SEED_ZERO), _col(key).cast("bigint"))


def hll_index(h: str | Column, p: int) -> Column:
    """The top p bits."""
    return F.shiftrightunsigned(_col(h), 64 - p).cast("int")


def hll_rank(h: str | Column, p: int) -> Column:
    """1 + the number of leading zeros of the other bits, at most 64 - p + 1."""
    rest = F.shiftleft(_col(h), p).bitwiseOR(F.lit(1 << (p - 1)))
    return (F.lit(65) - F.length(F.bin(rest))).cast("int")


def counter_bits(cap: str | Column) -> Column:
    """Bits that hold counts 0 to cap."""
    return F.length(F.bin(_col(cap).cast("bigint")))


def pair_index(i: str | Column, j: str | Column, n: str | Column) -> Column:
    """Place of (i, j), i < j, in the row-wise upper triangle of n x n."""
    i, j, n = _col(i).cast("bigint"), _col(j).cast("bigint"), _col(n).cast("bigint")
    return F.expr("0L") + F.floor(i * (2 * n - i - 1) / 2).cast("bigint") + (j - i - 1)


def pack_register(r: str | Column) -> Column:
    """A register as one byte, 255 at most."""
    return F.least(_col(r), F.lit(255)).cast("int")
