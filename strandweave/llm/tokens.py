"""Token ids of whole texts by the tokenizers library, for Arrow batches.

The library runs BPE on each pre-token by itself. Where a tokenizer's file says that no pre-token
spans white space (and nothing is added around them), the ids of a text are those of its
white-space-separated chunks in order, and of a chunk that ends in punctuation those of its two parts; most parts repeat. A bounded table per
Python worker keeps the ids of parts that the library has encoded, in numpy arrays by the part's 64-bit hash and 32 bits of its
length and letters. Other tokenizers get whole texts.
"""

from __future__ import annotations

import json
import os

import numpy as np

from ._words import MAPS, SEGMENT, Words, passes, span_hashes

#: Entries of a worker's table of parts; it starts anew when full. About 30 bytes each.
CHUNKS = 1_000_000

# The split pattern of word_bpe_49k.json, under which chunks are independent.
_CHUNKED_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

#: Punctuation that, after a letter or digit, is always a pre-token of its own.
_TAIL = b".,!*$%&#;:?)]}\""

# By byte: of _TAIL; ASCII letters and digits; letters, or bytes of characters from U+00C0 to U+024F; those of characters from U+0300 on.
_IS_TAIL, _IS_PLAIN, _IS_LETTER, _IS_HIGH = (np.zeros(256, bool) for _ in range(4))
_IS_TAIL[list(_TAIL)] = True
_IS_PLAIN[0x30:0x3A] = _IS_PLAIN[0x41:0x5B] = _IS_PLAIN[0x61:0x7B] = True
_IS_LETTER[0x41:0x5B] = _IS_LETTER[0x61:0x7B] = _IS_LETTER[0x80:0xC0] = _IS_LETTER[0xC3:0xCA] = True
_IS_HIGH[0xCC:] = True


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids without special tokens added. width: bytes of an id, as ``encode`` gives them (little-endian)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path) as f:
            spec = json.load(f)
        self.chunked = self._chunked(spec)
        self.marks = [x["content"].encode() for x in spec["added_tokens"]]
        suffix = spec["model"].get("end_of_word_suffix")
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if suffix:
            self.ends_word[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self._empty()

    def _empty(self) -> None:
        """No part is known. key: sorted hashes; check, at, size: by key; pool: their ids, from at on."""
        self.key, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool, self.used = np.zeros(1 << 16, self.dtype), 0

    @staticmethod
    def _chunked(spec: dict) -> bool:
        """True for the one layout that is known to treat chunks alone; special tokens hold no blank."""
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        norm = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        return (
            pre[0].get("type") == "Split"
            and pre[0].get("pattern") == {"Regex": _CHUNKED_SPLIT}
            and pre[0].get("behavior") == "Removed"
            and norm == ["NFC", "Replace", "Lowercase"]
            and spec.get("post_processor") is None
            and not any(" " in x["content"] or x["lstrip"] or x["rstrip"] for x in spec["added_tokens"])
        )

    def _library(self, texts: list[bytes]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in got]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Per text its ids as bytes."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        return [x.tobytes() for x in self.ids(data, np.append(0, np.cumsum([len(t) for t in texts], dtype=np.int64)))]

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Per text (a part of data) its ids."""
        texts = range(len(offsets) - 1)
        raw = lambda i: data[offsets[i] : offsets[i + 1]].tobytes()
        if not self.chunked:
            return [np.frombuffer(x, self.dtype) for x in self._library([raw(i) for i in texts])]
        base = int(offsets[0])
        low = data[base : offsets[-1]].tobytes().lower()
        odd = [i for i in texts if any(low.find(m, offsets[i] - base, offsets[i + 1] - base) >= 0 for m in self.marks)] if any(m in low for m in self.marks) else []
        w = Words(data, offsets, "blank", hashed=False)
        parts = Parts(w)
        key, first, of = np.unique(parts.hash, return_index=True, return_inverse=True)
        if len(self.key) + len(key) > CHUNKS:
            self._empty()
        at, found = self._find(key, parts.check[first])
        if not found.all():
            new = first[~found]
            self._add(key[~found], parts.check[new], *self._learn(parts.bytes(new), parts.words(new)))
            at, found = self._find(key, parts.check[first])
        begin, size = self.at[at][of], self.size[at][of]
        total = np.append(0, np.cumsum(size, dtype=np.int64))
        ids = self.pool[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]
        out = np.split(ids, total[parts.ends[:-1]])
        # equal hashes of unequal parts: never seen, but then the library has the text
        same = found[of] & (parts.check == self.check[at][of])
        if not same.all():
            odd = sorted({*odd, *np.searchsorted(parts.ends, np.flatnonzero(~same), side="right").tolist()})
        for i, x in zip(odd, self._library([raw(i) for i in odd]) if odd else [], strict=True):
            out[i] = np.frombuffer(x, self.dtype)
        return out

    def _find(self, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the table, whether the chunk is there); of hashes that are there with another check the place too."""
        at = np.searchsorted(self.key, key)
        if not len(self.key):
            return at, np.zeros(len(key), bool)
        at = np.minimum(at, len(self.key) - 1)
        return at, (self.key[at] == key) & (self.check[at] == check)

    def _add(self, key: np.ndarray, check: np.ndarray, flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        """Enter new parts, in order of key; of a hash that is there the first part stays. flat: all ids; begin, size: by part."""
        at, _ = self._find(key, check)
        new = self.key[at] != key if len(self.key) else np.ones(len(key), bool)
        if self.used + len(flat) > len(self.pool):
            self.pool = np.append(self.pool[: self.used], np.zeros(self.used + len(flat), self.dtype))
        self.pool[self.used : self.used + len(flat)] = flat
        to = np.searchsorted(self.key, key[new])
        self.at = np.insert(self.at, to, self.used + begin[new])
        self.used += len(flat)
        self.key, self.check, self.size = np.insert(self.key, to, key[new]), np.insert(self.check, to, check[new]), np.insert(self.size, to, size[new])

    def _learn(self, parts: list[bytes], is_word: np.ndarray, at_once: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all parts, begin, size). Words of letters go many in one text: the token that ends a word says so."""
        begin, size = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int32)
        words, other = np.flatnonzero(is_word), np.flatnonzero(~is_word).tolist()
        groups = [words[i : i + at_once] for i in range(0, len(words), at_once)]
        got = self.tokenizer.encode_batch_fast([b" ".join([parts[i] for i in g.tolist()]).decode() for g in groups], add_special_tokens=False)
        flat, used = [], 0
        for g, e in zip(groups, got, strict=True):
            ids = np.array(e.ids, self.dtype)
            to = np.flatnonzero(self.ends_word[ids]) + 1
            if len(to) != len(g):  # a word that the tokenizer parts after all
                other += g.tolist()
                continue
            size[g] = np.diff(to, prepend=0)
            begin[g] = used + to - size[g]
            flat.append(ids)
            used += len(ids)
        for i, x in zip(other, self._library([parts[i] for i in other]) if other else [], strict=True):
            ids = np.frombuffer(x, self.dtype)
            begin[i], size[i] = used, len(ids)
            flat.append(ids)
            used += len(ids)
        return np.concatenate([np.zeros(0, self.dtype), *flat]), begin, size


class Parts:
    """The chunks of a pass, those that end in punctuation in two parts. hash, check: per part; ends: per text, the number of parts up to its end.

    Punctuation parts from a letter or digit before it. ASCII letters count in lower case, as the tokenizer itself treats them, but not beside
    characters that may join them (from U+0300 on).
    """

    def __init__(self, w: Words):
        data = self.data = w.data
        last = np.maximum.accumulate(np.where(_IS_TAIL[data], -1, np.arange(len(data))))
        cut = np.maximum(last[w.end - 1] + 1, w.begin)
        before = data[np.maximum(cut - 1, 0)]
        lead = data[np.maximum(cut - 2, 0)]
        two = (before >= 0x80) & (before < 0xC0) & (lead >= 0xC3) & (lead < 0xCA) & ~((lead == 0xC3) & ((before == 0x97) | (before == 0xB7))) & (cut - 2 >= w.begin)
        cut = np.where((cut == w.begin) | _IS_PLAIN[before] | two, cut, w.end)
        begin, end = np.stack((w.begin, cut), 1).reshape(-1), np.stack((cut, w.end), 1).reshape(-1)
        some = end > begin
        self.ends = np.append(0, np.cumsum(some))[2 * w.ends]
        self.begin, self.end = begin[some], end[some]
        self.hash = span_hashes(data, self.begin, self.end, "blank")
        high = _IS_HIGH[data]
        self.exact = np.zeros(len(self.begin), bool)
        if high.any():
            many = np.append(0, np.cumsum(high, dtype=np.int32))
            self.exact = many[self.end] > many[self.begin]
            x = self.exact
            self.hash[x] = span_hashes(data, self.begin[x], self.end[x], "exact") ^ np.uint64(0x5851F42D4C957F2D)
        size = self.end - self.begin
        self.check = np.zeros(len(size), np.uint32)
        for i, x in enumerate((data[self.begin], data[self.begin + size // 2], data[self.end - 1])):
            self.check |= MAPS["blank"][x].astype(np.uint32) << np.uint32(8 * i)
        self.check |= (size & 255).astype(np.uint32) << np.uint32(24)

    def bytes(self, at: np.ndarray) -> list[bytes]:
        rows = zip(self.begin[at].tolist(), self.end[at].tolist(), self.exact[at].tolist(), strict=True)
        raw = self.data.tobytes()
        return [raw[b:e] if exact else raw[b:e].lower() for b, e, exact in rows]

    def words(self, at: np.ndarray) -> np.ndarray:
        """Whether a part has letters alone, of scripts without surprises."""
        data = self.data
        bad = ~_IS_LETTER[data]
        bad[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
        many = np.append(0, np.cumsum(bad, dtype=np.int32))
        return many[self.end[at]] == many[self.begin[at]]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for ``path``."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(column, path: str):
    """(row, ids as an array) for every text of an Arrow string column; null counts as empty."""
    own = encoder(path)
    for i, j, data, offsets in passes(column):
        if own.chunked and j == i + 1 and offsets[1] - offsets[0] > SEGMENT:
            # a long text in parts that end in white space: its chunks don't notice, unless it holds a special token
            text = data[offsets[0] : offsets[1]]
            if not any(m in text.tobytes().lower() for m in own.marks):
                cuts = _blanks(text)
                yield i, np.concatenate([own.ids(text, np.array(c))[0] for c in zip(cuts[:-1], cuts[1:], strict=True)])
                continue
        for n, ids in enumerate(own.ids(data, offsets)):
            yield i + n, ids


def _blanks(text: np.ndarray) -> list[int]:
    """Places after white space, about SEGMENT apart, from 0 to the end."""
    cuts = [0]
    while len(text) - cuts[-1] > SEGMENT:
        at = cuts[-1] + SEGMENT
        while at < len(text) and text[at - 1] not in b" \t\n\v\f\r":
            at += 1
        cuts.append(at)
    return cuts if cuts[-1] == len(text) else [*cuts, len(text)]
