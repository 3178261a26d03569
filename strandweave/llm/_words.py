"""Words of many texts at once, in numpy: positions, 64-bit hashes, rolling shingles.

Works on the UTF-8 bytes of an Arrow string array, without a Python object per word. A word's
hash is a polynomial over a random 64-bit value per byte, modulo 2**64, finished by a mixer; it
does not depend on the process, the batch or the word's place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text taken in one numpy pass; a longer text makes a pass of its own.
PASS_BYTES = 1 << 19
#: Bytes of a long text that are hashed at once.
SEGMENT = 1 << 21

_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_VALUES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def byte_map(kind: str) -> np.ndarray:
    """For each byte what it becomes: A-Z lower case, separators 32.

    ``blank``: words are runs of anything but 0x20, 0x09-0x0D. ``exact``: the same, A-Z stay. ``alnum``: runs of digits, letters
    and bytes of non-ASCII characters.
    """
    out = np.arange(256, dtype=np.uint8)
    if kind != "exact":
        out[65:91] += 32
    if kind in ("blank", "exact"):
        out[9:14] = 32
    elif kind == "alnum":
        keep = np.zeros(256, bool)
        keep[0x30:0x3A] = keep[0x61:0x7B] = keep[0x41:0x5B] = keep[0x80:] = True
        out[~keep] = 32
    else:
        raise ValueError(kind)
    return out


MAPS = {k: byte_map(k) for k in ("blank", "exact", "alnum")}
_LUT = {k: _VALUES[m] for k, m in MAPS.items()}
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, PASS_BYTES + (1 << 16))
        with np.errstate(over="ignore"):
            for i, r in enumerate((_R, _R_INV)):
                x = np.full(size, r, np.uint64)
                x[0] = 1
                _powers[i] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's constants); x is not changed."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, kind: str) -> np.ndarray:
    """The hash of each data[begin:end]."""
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LUT[kind][data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[begin]) * down[begin])


class Words:
    """The words of the texts of one pass.

    hash: per word; ends: per text, the number of words up to its end; begin, end: byte places in
    ``data``. A null text has no words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: str = "blank", hashed: bool = True):
        self.hashed = hashed
        base, n = int(offsets[0]), int(offsets[-1] - offsets[0])
        self.data = data[base : base + n]
        edges = offsets - base
        parts = [self._part(i, j, edges, kind) for i, j in self._cuts(edges, kind)]
        self.begin, self.end, self.hash = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.ends = np.searchsorted(self.begin, edges[1:], side="left")

    def _cuts(self, edges: np.ndarray, kind: str):
        """Parts of about SEGMENT bytes, none of which cuts a word: what a part takes while it is hashed is a multiple of its bytes."""
        i, n = 0, len(self.data)
        while n - i > SEGMENT:
            j = i + SEGMENT
            while True:  # the next place after which no word goes on
                near = np.flatnonzero(MAPS[kind][self.data[j - 1 : j + 4095]] == 32)
                edge = edges[np.searchsorted(edges, j) :][:1]
                ahead = min([*(near[:1] + j).tolist(), *edge.tolist(), n])
                if len(near) or ahead <= j + 4096:
                    break
                j += 4096
            yield i, ahead
            i = ahead
        yield i, n

    def _part(self, i: int, j: int, edges: np.ndarray, kind: str):
        data, n = self.data[i:j], j - i
        own = edges[(edges >= i) & (edges <= j)] - i
        sep = MAPS[kind][data] == 32
        word = ~sep
        first = np.ones(n, bool)
        first[1:] = sep[:-1]
        first[own[own < n]] = True
        first &= word
        last = np.ones(n, bool)
        last[:-1] = sep[1:]
        last[own[own > 0] - 1] = True
        last &= word
        begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        return begin + i, end + i, span_hashes(data, begin, end, kind) if self.hashed else np.zeros(0, np.uint64)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.ends, prepend=0)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the k words from each place, ends per text): no shingle crosses texts."""
        return rolling(self.hash, self.ends, k)


def rolling(h: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    counts = np.maximum(np.diff(ends, prepend=0) - (k - 1), 0)
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    x = np.full(m, np.uint64(0x51ED270B1 + k))
    for i in range(k):
        x = (x ^ h[i : i + m]) * np.uint64(0x9FB21C651E98DF25)
        x ^= x >> np.uint64(32)
    keep = np.zeros(m + k, np.int8)
    begins = np.append(0, ends[:-1])
    np.add.at(keep, begins[counts > 0], 1)
    np.add.at(keep, (begins + counts)[counts > 0], -1)
    return x[np.cumsum(keep[:m]).astype(bool)], np.cumsum(counts)


def sequence_hash(h: np.ndarray) -> np.uint64:
    """Of a whole short word sequence."""
    return rolling(h, np.array([len(h)]), len(h))[0][0]


def passes(column: pa.Array, limit: int = PASS_BYTES):
    """(from, to, data, offsets) over slices of a string array, each of about ``limit`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), len(column))
        yield i, j, data, offsets[i : j + 1]
        i = j


def words_of(texts: list[str | None], kind: str = "blank") -> Words:
    """For a few texts: tests, fixed word lists."""
    a = pa.array([t or "" for t in texts], pa.string())
    (_, _, data, offsets), = list(passes(a, 1 << 40))
    return Words(data, offsets, kind)
