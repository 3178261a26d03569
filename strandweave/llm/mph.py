"""A minimal perfect hash in numpy, after BBHash (Limasset, Rizk, Chikhi, Peterlongo, 2017).

Level by level, keys are hashed into a bit array of ``GAMMA`` times their number; a key alone in its
place sets the bit and is done, the others go to the next level. A key's slot is the number of set
bits before its own: the keys of a set of n get the slots 0 to n - 1. About 3 bits a key. A lookup
reads one place per level, and most keys end on the first two.
"""

from __future__ import annotations

import struct

import numpy as np

from ._words import mix

GAMMA = 2.0
LEVELS = 40
_WORD = 512


def _place(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    x = mix(keys ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    return ((x >> np.uint64(32)) * np.uint64(bits) >> np.uint64(32)).astype(np.int64)


class Mph:
    """Of distinct uint64 keys. slot(keys) is a bijection onto 0..n-1 for them; for other keys it gives
    any slot or -1, which is why users store a fingerprint per slot."""

    def __init__(self, sizes: list[int], packed: np.ndarray):
        self.sizes, self.packed = sizes, packed
        bits = np.unpackbits(packed, bitorder="little")
        blocks = bits[: len(bits) // _WORD * _WORD].reshape(-1, _WORD).sum(1)
        self.rank = np.append(0, np.cumsum(blocks))
        self.bits = bits
        self.starts = np.append(0, np.cumsum(sizes)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> Mph:
        sizes, parts = [], []
        left = keys
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(64, int(GAMMA * len(left)))
            at = _place(left, level, size)
            count = np.bincount(at, minlength=size)
            sizes.append(size)
            parts.append((count == 1).astype(np.uint8))
            left = left[count[at] != 1]
        if len(left):
            raise ValueError("the keys aren't distinct")
        bits = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        bits = np.pad(bits, (0, -len(bits) % _WORD))
        return cls(sizes, np.packbits(bits, bitorder="little"))

    def slot(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = _place(keys[left], level, size) + self.starts[level]
            hit = self.bits[at] == 1
            found = at[hit]
            block = found // _WORD
            inner = [int(self.bits[b * _WORD : f].sum()) for b, f in zip(block.tolist(), found.tolist(), strict=True)] if len(found) < 64 else self._inner(found)
            out[left[hit]] = self.rank[block] + inner
            left = left[~hit]
        return out

    def _inner(self, found: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(self.bits, dtype=np.int64))
        return total[found] - total[found // _WORD * _WORD]

    def to_bytes(self) -> bytes:
        return struct.pack("<II", len(self.sizes), len(self.packed)) + np.array(self.sizes, "<u8").tobytes() + self.packed.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[Mph, int]:
        """The hash and the number of bytes read."""
        levels, size = struct.unpack_from("<II", data)
        end = 8 + 8 * levels + size
        sizes = np.frombuffer(data, "<u8", levels, 8).astype(int).tolist()
        return cls(sizes, np.frombuffer(data, np.uint8, size, 8 + 8 * levels)), end
