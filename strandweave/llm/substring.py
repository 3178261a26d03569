"""Passages that repeat across documents, by compact windows.

A text's tokens are its five-word shingles. For one hash function, the Cartesian tree over the tokens' hashes groups
all subsequences by the token with the smallest hash: the node at c, with the subtree l..r, stands for every [i, j]
with l <= i <= c <= j <= r. Only windows of at least the wanted length matter, about 2n / length of them. Two near
equal passages share the smallest token under most hash functions, so equal keys over ``HASHES`` functions give candidates
(compact windows: Deng, Li et al., Near-Duplicate Text Alignment, 2021-2023).

1. windows: one numpy pass over the texts builds the long nodes of the trees level by level, for all texts of a pass
   at once. Each keeps two small hashes of what lies just before and after its token.
2. join: of the windows with one key the one with the smallest hashed document id is the centre, and so
   for each key with its left and with its right context apart, which keeps a common token from hiding a passage. Every
   other window is one hit with it; those of its own document only leave probes (4). Minimums are pre-aggregated, joins are those that adaptive execution can split.
3. verification: the pairs of documents of all hits are aligned on their whole texts, at the diagonals of the hits; a passage is a
   maximal run of matching shingles with short gaps, of at least ``min_words`` words, whose sets
   have a Jaccard similarity of at least ``percent``.
4. the rest: what two windows share beyond what either shares with their centre starts, on the left or the right, where both
   differ from the centre in the same way. So each hit leaves probes (centre, offset, token) where it differs outside of verified
   passages, and windows with one probe in common are a group of their own, with a new centre, until none are. Every
   such group shares more offsets than the one it comes from, of which a window has under twice the wanted length.

Centres come first in one fixed order of documents, so that of each passage one document keeps its copy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import drop, stage, text_key
from ._words import Words, mix, passes
from .minhash import common

SHINGLE = 5
HASHES = 4
#: Diagonals of one alignment: a word more or less moves what follows by one.
BAND = 8
#: Shingles that an edit may break before a run ends: two edits of a word apart.
GAP = 2 * SHINGLE + 2
#: Where a window differs from its centre for long, every so many offsets are probes too: an edit there hides only some.
STEP = 8

_PLACE = 26
_MASK = np.uint64((1 << _PLACE) - 1)
_SCRAMBLE = np.uint64(0x2545F491 | 1)
_UNSCRAMBLE = np.uint64(pow(int(_SCRAMBLE), -1, 1 << _PLACE))


def windows(h: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r), r inclusive, of every Cartesian tree node over at least ``least`` tokens; h: one hash per token,
    ends: per text. Equal hashes are ordered by a scrambled place, which keeps the trees of repetitive texts flat."""
    begins = np.append(0, ends[:-1])
    keep = ends - begins >= least
    s, e = begins[keep].astype(np.int64), ends[keep].astype(np.int64)
    if len(h) >= 1 << _PLACE:
        raise ValueError("a text of over 2**26 words")
    place = np.arange(len(h), dtype=np.uint64) * _SCRAMBLE & _MASK
    v = np.append(h & ~_MASK | place, np.uint64(0xFFFFFFFFFFFFFFFF))
    out: list[tuple] = []
    while len(s):
        low = np.minimum.reduceat(v, np.stack((s, e), 1).reshape(-1))[::2]
        c = ((low & _MASK) * _UNSCRAMBLE & _MASK).astype(np.int64)
        out.append((s, c, e - 1))
        s, e = np.stack((s, c + 1), 1).reshape(-1), np.stack((c, e), 1).reshape(-1)
        keep = e - s >= least
        s, e = s[keep], e[keep]
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def _first(of: np.ndarray, key: np.ndarray) -> np.ndarray:
    """1 for the first of the rows with one (of, key), else 0."""
    order = np.lexsort((key, of))
    new = np.ones(len(order), np.int64)
    new[1:] = (of[order[1:]] != of[order[:-1]]) | (key[order[1:]] != key[order[:-1]])
    out = np.zeros(len(order), np.int64)
    out[order] = new
    return out


def _windows(least: int):
    seeds = mix(np.arange(101, 101 + HASHES, dtype=np.uint64))
    half = np.uint64(32)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list[np.ndarray]] = [[] for _ in _LISTS]
        counts = []
        for _, _, data, offsets in passes(b.column("text")):
            g, ends = Words(data, offsets).shingles(SHINGLE)
            begins = np.append(0, ends[:-1])
            found = []
            for j in range(HASHES):
                h = mix(g ^ seeds[j])
                l, c, r = windows(h, ends, least)
                found.append((h[c], l, c, r))
            key, l, c, r = (np.concatenate(x) for x in zip(*found, strict=True))
            of = np.searchsorted(ends, c, side="right")
            order = np.lexsort((c, of))
            key, l, c, r, of = (x[order] for x in (key, l, c, r, of))
            # contexts: the two shingles that follow the token's words, and the two before; cut at the text's ends
            after = [np.where(c + d < ends[of], g[np.minimum(c + d, len(g) - 1)], np.uint64(d)) for d in (SHINGLE, 2 * SHINGLE)] if len(c) else [c, c]
            before = [np.where(c - d >= begins[of], g[np.maximum(c - d, 0)], np.uint64(d)) for d in (SHINGLE, 2 * SHINGLE)] if len(c) else [c, c]
            left, right = (mix(mix(x[0].astype(np.uint64)) ^ x[1].astype(np.uint64)) >> half for x in (before, after))
            first = _first(of, key ^ mix(left)) << 1 | _first(of, key ^ mix(right + np.uint64(1)))
            window = (c - begins[of]) << 14 | np.minimum(c - l, least) << 8 | np.minimum(r - c, least) << 2 | first
            for to, x in zip(cols, (key, window, left << half | right), strict=True):
                to.append(x.view(np.int64))
            counts.append(np.bincount(of, minlength=len(ends)))
        size = np.append(0, np.cumsum(np.concatenate(counts))).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(size), pa.array(np.concatenate(x))) for x in cols]
        return pa.RecordBatch.from_arrays([b.column("v"), *lists], ["v", *_LISTS])

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield batch(b)

    return run


#: Of a window: its token's hash; place, tokens before and after (6 bits each) and whether it is the text's first with its left and its right
#: context; both contexts.
_LISTS = ("key", "window", "contexts")


def _align(a: np.ndarray, b: np.ndarray, diagonals: list[int], least: int, percent: int):
    """Verified passages (a_from, a_to, b_from, b_to, similarity) in shingles; diagonals: a - b, sorted."""
    i = 0
    while i < len(diagonals):
        k = i + 1
        while k < len(diagonals) and diagonals[k] - diagonals[k - 1] <= BAND:
            k += 1
        runs = []
        for d in diagonals[i:k]:
            lo, hi = max(0, d), min(len(a), len(b) + d)
            if hi > lo:
                same = np.concatenate(([0], (a[lo:hi] == b[lo - d : hi - d]).view(np.int8), [0]))
                edge = np.flatnonzero(np.diff(same))
                runs += [(lo + s, lo + e, d) for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
        yield from _chain(a, b, sorted(runs), least, percent)
        i = k


def _chain(a, b, runs, least, percent):
    """Join runs over gaps of at most GAP on both sides; of a chain that fails its ``_parts`` count."""
    i = 0
    while i < len(runs):
        chain = [runs[i]]
        i += 1
        while i < len(runs):
            s, e, d = runs[i]
            _, e0, d0 = chain[-1]
            if e <= e0:
                i += 1
            elif s - e0 <= GAP and (s - d) - (e0 - d0) <= GAP and s - d >= chain[-1][0] - d0:
                chain.append(runs[i])
                i += 1
            else:
                break
        s, e, x, y = chain[0][0], chain[-1][1], chain[0][0] - chain[0][2], max(r[1] - r[2] for r in chain)
        if e - s < least or y - x < least:
            continue
        whole = list(_passage(a, b, chain, least, percent))
        yield from whole
        if not whole:
            u, w = np.unique(a[s:e]), np.unique(b[x:y])
            # no part shares more tokens than the whole; one of enough distinct ones needs that many
            if len(u) < e - s or 100 * common(u, w) >= percent * least:
                yield from _parts(a, b, chain, least, percent)


def _parts(a, b, chain, least, percent):
    """The passages from one run of a chain to another that lie in no longer such one. For each start the sets of all ends are counted
    at once: a token is new at its first place from the start on."""
    s, e, d = np.array(chain).T
    x, y = s - d, e - d
    reached = -1
    if (np.diff(y) <= 0).any():  # ends that don't grow on both sides: one by one
        own = a[s[0] : e[-1]]
        length = e[None] - s[:, None]
        good = (length >= least) & (y[None] - x[:, None] >= least)
        if (_previous(own) < 0).all():  # as in _starts
            total = np.append(0, np.cumsum(np.isin(own, b[x.min() : y.max()])))
            good &= 100 * (total[e - s[0]][None] - total[s - s[0]][:, None]) >= percent * length
        for i in np.flatnonzero(good.any(1)).tolist():
            for j in np.flatnonzero(good[i])[::-1].tolist():
                if j <= max(reached, i - 1):
                    break
                if found := list(_passage(a, b, chain[i : j + 1], least, percent)):
                    yield from found
                    reached = j
                    break
        return
    n, size = len(chain), int(e[-1] - s[0])
    ids = np.unique(np.concatenate((a[s[0] : e[-1]], b[x[0] : y[-1]])), return_inverse=True)[1]
    sides = [(own, _previous(own), begin - begin[0], end - begin[0]) for own, begin, end in ((ids[:size], s, e), (ids[size:], x, y))]
    for i, most in _starts(sides, least, percent):
        if most <= reached:
            continue
        counts, first = [], []
        for own, previous, begin, end in sides:
            new = np.flatnonzero(previous[begin[i] :] < begin[i]) + begin[i]
            at = np.searchsorted(end, new, side="right")
            counts.append(np.cumsum(np.bincount(at, minlength=n)))
            by = np.full(int(ids.max()) + 1, n)
            by[own[new]] = at
            first.append(by)
        both = np.cumsum(np.bincount(np.maximum(*first), minlength=n + 1))[:n]
        union = counts[0] + counts[1] - both
        good = np.flatnonzero((e - s[i] >= least) & (y - x[i] >= least) & (100 * both >= percent * union))
        if len(good) and good[-1] > reached and good[-1] >= i:
            j = reached = int(good[-1])
            yield int(s[i]), int(e[j]), int(x[i]), int(y[j]), float(both[j] / union[j])


def _starts(sides, least: int, percent: int) -> list[tuple[int, int]]:
    """(run at which a passage may start, last run at which it may end): on a side whose tokens are all distinct, a passage has at least ``percent`` of its places' tokens in common with the
    other side, of which that side's whole chain has no fewer."""
    n = len(sides[0][2])
    common_ = np.zeros(int(max(own.max() for own, *_ in sides)) + 1, np.int8)
    for own, *_ in sides:
        seen = np.zeros(len(common_), np.int8)
        seen[own] = 1
        common_ += seen
    out = []
    for i in range(0, n, 256):
        good = np.ones((min(256, n - i), n), bool)
        for own, previous, begin, end in sides:
            length = end[None] - begin[i : i + 256, None]
            good &= length >= least
            if (previous < 0).all():
                total = np.append(0, np.cumsum(common_[own] == 2))
                good &= 100 * (total[end][None] - total[begin[i : i + 256]][:, None]) >= percent * length
        some = np.flatnonzero(good.any(1))
        out += zip((some + i).tolist(), (n - 1 - good[some, ::-1].argmax(1)).tolist(), strict=True)
    return out


def _previous(x: np.ndarray) -> np.ndarray:
    """Of each place the one before it that has the same value, or -1."""
    order = np.argsort(x, kind="stable")
    out = np.full(len(x), -1)
    same = x[order[1:]] == x[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


def _passage(a, b, part, least, percent):
    """The passage from the first run's start to the last one's end, if it is long and similar enough."""
    s, e, x, y = part[0][0], part[-1][1], part[0][0] - part[0][2], part[-1][1] - part[-1][2]
    if e - s >= least and y - x >= least:
        u, w = np.unique(a[s:e]), np.unique(b[x:y])
        both = common(u, w)
        union = len(u) + len(w) - both
        if 100 * both >= percent * union:
            yield s, e, x, y, both / union


#: A hit is one long: place of the token, tokens of the window before and after it, those that its group is known to share (6 bits
#: each), and whether it is the document's first hit of the group.
_BITS = 25


def _packed(c, before, after, low, high, first):
    return c << _BITS | before << 19 | after << 13 | low << 7 | high << 1 | first


#: Hits whose texts are compared at once, about.
_HITS = 100_000


def _unpacked(x: np.ndarray) -> tuple[np.ndarray, ...]:
    return x >> _BITS, *(x >> k & 63 for k in (19, 13, 7, 1))


def _spread(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(range it is of, number) for every number of the ranges begin..end (exclusive)."""
    size = np.maximum(end - begin, 0)
    of = np.repeat(np.arange(len(size)), size)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(size) - size - begin, size)


def _edges(new: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, new))


def _probes(a: list[np.ndarray], b: list[np.ndarray], names: np.ndarray, row: np.ndarray, hit: np.ndarray, bc: np.ndarray, found: list, least: int):
    """(row, key, hit) where a row's text a differs from its b around its hits: the start of each difference, and every STEP-th place of
    b's. A key stands for b's text (its name), the place there and a's token; one probe for a place of a under a key. row, hit, bc: sorted by
    row; found: (row, *passage).

    All rows at once. A segment is what the windows of one diagonal of a row cover. Hits in one run of equal tokens, or in one verified passage, are one
    anchor: the places left..right are done, and lo..hi are those of their windows.
    """
    size_a, size_b = (np.array([len(x) for x in own]) for own in (a, b))
    base_a, base_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
    a, b = np.concatenate(a), np.concatenate(b)
    c, before, after, low, high = _unpacked(hit)
    order = np.lexsort((c - bc, row))
    row, c, bc, before, after, low, high = (x[order] for x in (row, c, bc, before, after, low, high))
    d = c - bc
    first = _edges((row[1:] != row[:-1]) | (d[1:] != d[:-1]))
    seg = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(row))))
    lo, hi = c - before, np.minimum(c + after, size_a[row] - 1)
    begin, end = np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first) + 1
    of, p = _spread(begin, end)
    start = np.cumsum(end - begin) - (end - begin)
    # from here on places are numbers in the segments laid end to end; shift takes a place of a there
    shift = start - begin
    q = p - d[first][of]
    at_row = row[first][of]
    there = (q >= 0) & (q < size_b[at_row])
    token = a[base_a[at_row] + p]
    differ = ~there
    differ[there] = token[there] != b[(base_b[at_row] + q)[there]]
    at = np.arange(len(p))
    previous = np.maximum(np.maximum.accumulate(np.where(differ, at, -1)), start[of] - 1)
    following = np.minimum(np.minimum.accumulate(np.where(differ, at, len(at))[::-1])[::-1], (start + end - begin)[of])
    x = c + shift[seg]
    left, right = np.minimum(x - low, previous[x] + 1), np.maximum(x + high, following[x] - 1)
    rows = np.searchsorted(row, np.arange(len(size_a) + 1))
    for n, s, e, y, z, _ in found:
        own = slice(rows[n], rows[n + 1])
        inside = (s <= c[own]) & (c[own] < e) & (y <= bc[own]) & (bc[own] < z)
        left[own][inside] = np.minimum(left[own], s + shift[seg[own]])[inside]
        right[own][inside] = np.maximum(right[own], e - 1 + shift[seg[own]])[inside]
    order = np.lexsort((right, left, seg))
    seg, left, right = seg[order], left[order], right[order]
    once = _edges((seg[1:] != seg[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1]))
    lo, hi = np.minimum.reduceat((lo[order] + shift[seg]), once), np.maximum.reduceat((hi[order] + shift[seg]), once)
    seg, left, right = seg[once], left[once], right[once]

    # a difference starts after an equal place (towards the right) or before one (towards the left), or where its range does
    step = q % STEP == 0
    where = []
    for side, (low, high, inner) in enumerate(((np.maximum(right + 1, lo), hi + 1, right + 1), (lo, np.minimum(left, hi + 1), left - 1))):
        anchor, x = _spread(low, high)
        starts = ~differ[np.maximum(x - 1, 0)] if side == 0 else ~differ[np.minimum(x + 1, len(at) - 1)]
        bound = x == start[of[x]] if side == 0 else x == (start + end - begin)[of[x]] - 1
        keep = differ[x] & (starts | bound | (x == inner[anchor]) | step[x])
        where.append((anchor[keep], x[keep]))
    anchor, x = (np.concatenate(y) for y in zip(*where, strict=True))
    before, after = np.minimum(x - lo[anchor], least), np.minimum(hi[anchor] - x, least)
    low, high = np.minimum(np.maximum(x - left[anchor], 0), before), np.minimum(np.maximum(right[anchor] - x, 0), after)
    of_row, place = at_row[x], p[x]
    key = mix(mix(names[of_row].view(np.uint64) ^ mix(q[x].view(np.uint64))) ^ token[x]).view(np.int64)
    order = np.lexsort((low + high, place, key, of_row))
    of_row, key, place = of_row[order], key[order], place[order]
    new = np.append(True, (of_row[1:] != of_row[:-1]) | (key[1:] != key[:-1]))[: len(key)]
    once = new | np.append(True, place[1:] != place[:-1])[: len(key)]
    return of_row[once], key[once], _packed(place, *(y[order] for y in (before, after, low, high)), new)[once]


def _sets(column, names: np.ndarray) -> list[np.ndarray]:
    """Tokens of each text; rows with one name have one text."""
    _, first, of = np.unique(names, return_index=True, return_inverse=True)
    own: list[np.ndarray] = []
    for _, _, data, offsets in passes(column.take(pa.array(first))):
        g, ends = Words(data, offsets).shingles(SHINGLE)
        own += np.split(g, ends[:-1])
    return [own[i] for i in of.reshape(-1).tolist()]


def _verify(min_words: int, percent: int):
    least = min_words - SHINGLE + 1

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            names = [batch.column(c).to_numpy() for c in ("a", "b")]
            tokens = [_sets(batch.column(f"text_{c}"), own) for c, own in zip("ab", names, strict=True)]
            rows: list[tuple] = []
            left: list[tuple] = []
            at = np.append(0, np.cumsum(batch.column("hit").value_lengths().to_numpy()))
            hits = [batch.column(c).flatten().to_numpy() for c in ("hit", "bc")]
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(at, at[i] + _HITS, side="right")) - 1)
                row = np.repeat(np.arange(j - i), np.diff(at[i : j + 1]))
                hit, bc = (x[at[i] : at[j]] for x in hits)
                order = np.lexsort((bc, hit, row))
                row, hit, bc = row[order], hit[order], bc[order]
                once = _edges((row[1:] != row[:-1]) | (hit[1:] != hit[:-1]) | (bc[1:] != bc[:-1]))
                row, hit, bc = row[once], hit[once], bc[once]
                cuts = np.searchsorted(row, np.arange(j - i + 1)).tolist()
                diagonal, found = (hit >> _BITS) - bc, []
                for n in range(j - i):
                    # windows of the centre's own document have no passage with it, but probes
                    if names[0][i + n] != names[1][i + n]:
                        near = sorted(set(diagonal[cuts[n] : cuts[n + 1]].tolist()))
                        found += [(n, *x) for x in _align(tokens[0][i + n], tokens[1][i + n], near, least, percent)]
                rows += [(i + x[0], *x[1:]) for x in found]
                of, key, probes = _probes(tokens[0][i:j], tokens[1][i:j], names[1][i:j], row, hit, bc, found, least)
                left.append((of + i, key, probes))
                i = j
            of = pa.array([r[0] for r in rows], pa.int64())
            words = [pa.array([int(r[1 + k]) + (SHINGLE - 1 if k % 2 else 0) for r in rows], pa.int64()) for k in range(4)]
            passages = [batch.column("a").take(of), batch.column("b").take(of), *words, pa.array([r[5] for r in rows], pa.float64())]
            yield pa.RecordBatch.from_arrays([*passages, *(pa.nulls(len(rows), t) for t in _PROBE.values())], [*_PASSAGE, *_PROBE])
            n, key, probes = (np.concatenate(x) for x in zip(*left, strict=True))
            if len(n):
                a = batch.column("a").take(pa.array(n))
                yield pa.RecordBatch.from_arrays([a, *(pa.nulls(len(n), t) for t in list(_PASSAGE.values())[1:]), pa.array(key), pa.array(probes)], [*_PASSAGE, *_PROBE])

    return run


_PASSAGE = {c: pa.int64() for c in ("a", "b", "first", "last", "other_first", "other_last")} | {"similarity": pa.float64()}
_PROBE = {"key": pa.int64(), "hit": pa.int64()}
_FOUND = "a long, b long, first long, last long, other_first long, other_last long, similarity double, key long, hit long"


def _hits(sided: DataFrame) -> DataFrame:
    """(a, b, arrays hit and bc), staged, for windows (v, key, hit): of those with one key each with the centre. Other windows of the
    centre's document too, which only leave probes. Groups within one document have none."""
    first = F.when(F.col("hit") % 2 == 1, F.col("v")).otherwise(F.lit((1 << 63) - 1))
    centre = sided.groupBy("key").agg(F.min("v").alias("b"), F.max("v").alias("most"), F.min_by("hit", first).alias("bc")).where("b < most")
    # written first, so that both sides of the join are plain exchanges and a hot key's rows can be split
    centre = stage(centre.select("key", "b", F.shiftright("bc", _BITS).alias("bc")), "centres")
    hits = sided.join(centre, "key").where((F.col("v") != F.col("b")) | (F.shiftright("hit", _BITS) != F.col("bc")))
    listed = hits.groupBy(F.col("v").alias("a"), "b").agg(F.collect_list(F.struct("hit", "bc")).alias("hits"))
    out = stage(listed.select("a", "b", "hits.hit", "hits.bc"), "pairs")
    drop(centre)
    return out


def _compared(pairs: DataFrame, texts: DataFrame, min_words: int, percent: int) -> DataFrame:
    """Passages and probes of ``_hits``."""
    full = pairs.join(texts.select(F.col("v").alias("a"), F.col("text").alias("text_a")), "a")
    full = full.join(texts.select(F.col("v").alias("b"), F.col("text").alias("text_b")), "b")
    return stage(full.mapInArrow(_verify(min_words, percent), _FOUND), "passages")


def _used(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    used = pairs.select(F.col("a").alias("v")).union(pairs.select(F.col("b").alias("v"))).distinct()
    return stage(texts.join(used, "v").dropDuplicates(["v"]), "texts")


def _texts(docs: DataFrame) -> DataFrame:
    """(v, doc_id, text): v names a text of a doc_id; rows that are equal in both are one document."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return own.withColumn("v", F.xxhash64(F.coalesce("doc_id", F.lit(-1).cast("long")), F.col("doc_id").isNull(), text_key("text")))


def passages(docs: DataFrame, min_words: int = 50, percent: int = 80) -> DataFrame:
    """(v, doc_id, first_word, end_word, other_v, other_doc_id, other_first_word, other_end_word, similarity).

    One row for each passage of a document that another document, earlier in a fixed order, has too: of at least
    ``min_words`` words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; end_word is exclusive), with a Jaccard similarity of at least ``percent``
    over sets of five-word shingles. Exact copies of whole documents are passages too. Repeats within one document aren't
    looked for, and rows with the same doc_id and text are one document. Null and short texts have no passage;
    no documents: no rows. Other columns are ignored.
    """
    least = min_words - SHINGLE + 1
    if not 2 <= least < 64:
        raise ValueError(f"min_words must be {SHINGLE + 1} to {SHINGLE + 62}")
    texts = _texts(docs)
    made = stage(texts.select("v", "text").mapInArrow(_windows(least), "v long, key array<long>, window array<long>, contexts array<long>").where(F.size("key") > 0), "windows")
    flat = made.select("v", F.inline(F.arrays_zip(*_LISTS)))
    several = stage(flat.groupBy("key").agg(F.min("v").alias("least"), F.max("v").alias("most")).where("least < most").select("key"), "keys")
    met = stage(flat.join(several, "key"), "met")
    drop(made, several)

    # each window under its key with what is before, and with what is after: a passage of 50 words or more holds
    # at least one of the two, wherever its token is
    window = F.shiftleft(F.shiftright("window", 2), 13)
    left = F.struct(F.xxhash64(F.lit(1), "key", F.shiftright("contexts", 32)).alias("key"), window.bitwiseOR(F.shiftright("window", 1).bitwiseAND(F.lit(1))).alias("hit"))
    right = F.struct(F.xxhash64(F.lit(2), "key", F.col("contexts").bitwiseAND(F.lit(0xFFFFFFFF))).alias("key"), window.bitwiseOR(F.col("window").bitwiseAND(F.lit(1))).alias("hit"))
    pairs = _hits(met.select("v", F.inline(F.array(left, right))))
    drop(met)
    texts = of = _used(texts, pairs)
    found, rounds = None, []
    while found is None or not pairs.isEmpty():
        made = _compared(pairs, of, min_words, percent)
        drop(pairs)
        rounds.append(made)
        own = made.where("key IS NULL").select(*_PASSAGE)
        found = own if found is None else found.unionByName(own)
        pairs = _hits(made.where("key IS NOT NULL").select(F.col("a").alias("v"), *_PROBE))
        # probes are of documents that this round compared, and so are the new centres: each round reads the texts of the last one only
        last, of = of, _used(of.select("v", "text"), pairs)
        if last is not texts:
            drop(last)
    # passages that several rounds met
    found = stage(found.distinct(), "passages")
    drop(*rounds)
    ids = texts.select("v", "doc_id")
    out = found.join(ids.select(F.col("v").alias("a"), "doc_id"), "a").join(ids.select(F.col("v").alias("b"), F.col("doc_id").alias("other_doc_id")), "b")
    # two texts under one doc_id are one document
    out = out.where(~F.coalesce(F.col("doc_id") == F.col("other_doc_id"), F.lit(False)))
    return out.select(
        F.col("a").alias("v"), "doc_id", F.col("first").alias("first_word"), F.col("last").alias("end_word"), F.col("b").alias("other_v"), "other_doc_id",
        F.col("other_first").alias("other_first_word"), F.col("other_last").alias("other_end_word"), "similarity",
    )


def repeats(docs: DataFrame, min_words: int = 50, percent: int = 80) -> DataFrame:
    """``passages`` by doc_id, without the internal names of texts."""
    return passages(docs, min_words, percent).drop("v", "other_v")


def without_repeats(docs: DataFrame, min_words: int = 50, percent: int = 80) -> DataFrame:
    """``docs`` with every repeated passage cut from the documents that come later in the fixed order.

    Columns stay; only text changes. A document of which no word remains is dropped; documents that had no
    word to begin with stay as they are. What remains of a text keeps its bytes.
    """
    spans = passages(docs, min_words, percent).groupBy("v").agg(F.collect_set(F.struct("first_word", "end_word")).alias("spans"))
    spans = stage(spans, "spans")
    # a struct keeps the columns of docs apart from ours, whatever they are called
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    keyed = whole.withColumn("v", F.xxhash64(F.coalesce(F.col("doc.doc_id").cast("long"), F.lit(-1).cast("long")), F.col("doc.doc_id").isNull(), text_key(F.col("doc.text").cast("string"))))
    joined = keyed.join(spans, "v", "left")
    cut = _cut(F.col("doc.text").cast("string"), F.col("spans"))
    kept = joined.withColumn("left", F.when(F.col("spans").isNull(), F.col("doc.text")).otherwise(cut)).where(F.col("spans").isNull() | F.col("left").isNotNull())
    return kept.select(*[F.col("left").alias(c) if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def remove(text: str, spans) -> str | None:
    """The text without the words of the spans (first, end); None if no word remains."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    w = Words(data, np.array([0, len(data)]))
    keep = np.ones(len(w.begin), bool)
    for first, end in spans:
        keep[first:end] = False
    if not keep.any():
        return None
    out, at = [], 0
    gone = np.concatenate(([0], (~keep).view(np.int8), [0]))
    edge = np.flatnonzero(np.diff(gone))
    for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        out.append(data[at : w.begin[s]].tobytes())
        at = w.begin[e] if e < len(w.begin) else len(data)
    out.append(data[at:].tobytes())
    return b"".join(out).decode("utf-8", "surrogatepass")


def _cut(text, spans):
    import pandas as pd

    def cut(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        return pd.Series([None if c is None or t is None else remove(t, [(x["first_word"], x["end_word"]) for x in c]) for t, c in zip(texts, cuts, strict=True)], dtype=object)

    cut.__annotations__ = {"texts": pd.Series, "cuts": pd.Series, "return": pd.Series}
    return F.pandas_udf(cut, "string")(text, spans)
