"""Quality: a sparse rule ensemble over text statistics, compiled into Spark columns.

After RuleFit (Friedman, Popescu, 2008): small boosted trees over the statistics of labelled documents; each path
from a root is a rule, a conjunction of comparisons; an L1-penalised logistic regression over all rules and the clipped
statistics keeps a few. The kept rules become one Spark expression over the statistics' columns.

The statistics are one pass over the whole texts. Fitting uses at most ``LIMIT`` labelled documents (a parameter).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import held_out
from ._words import Words, passes
from .labelled import examples, sample, text_key

LIMIT = 20_000
THRESHOLD = 0.3

# Byte classes whose shares are statistics.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "stop": b".,;:?'",
    "shout": b"!",
    "symbol": b"$%&*#@^~_=+\\/",
    "bracket": b"<>{}[]()|",
    "quote": b"\"`",
    "blank": b" \t\r",
    "line": b"\n",
}
STATISTICS = (
    *(f"share_{c}" for c in CLASSES),
    "share_other", "log_chars", "log_words", "word_length", "longest_word", "distinct_words", "distinct_pairs", "repeated_neighbours", "top_word", "distinct_lines", "line_words", "words_with_symbols",
)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, statistics); all zero for an empty text."""
    base, n = int(offsets[0]), len(offsets) - 1
    edges = offsets - base
    data = data[base : int(offsets[-1])]
    size = np.diff(edges)
    per = lambda x: np.diff(np.append(0, np.cumsum(x, dtype=np.int64))[edges])
    out = np.zeros((n, len(STATISTICS)))
    col = {s: i for i, s in enumerate(STATISTICS)}
    symbol = None
    for name, chars in CLASSES.items():
        is_in = np.zeros(256, bool)
        is_in[list(chars)] = True
        own = is_in[data]
        if name in ("symbol", "bracket", "shout"):
            symbol = own if symbol is None else symbol | own
        out[:, col[f"share_{name}"]] = per(own) / np.maximum(size, 1)
    out[:, col["share_other"]] = per(data >= 128) / np.maximum(size, 1)
    w = Words(data, edges, "blank")
    count = w.counts
    length = w.end - w.begin
    out[:, col["log_chars"]], out[:, col["log_words"]] = np.log1p(size), np.log1p(count)
    text = np.repeat(np.arange(n), count)
    some = np.maximum(count, 1)
    out[:, col["word_length"]] = np.bincount(text, length, n) / some
    with_symbol = np.append(0, np.cumsum(symbol, dtype=np.int64))
    out[:, col["words_with_symbols"]] = np.bincount(text, with_symbol[w.end] > with_symbol[w.begin], n) / some
    same = (w.hash[1:] == w.hash[:-1]) & (text[1:] == text[:-1])
    out[:, col["repeated_neighbours"]] = np.bincount(text[1:][same], minlength=n)[:n] / some
    pairs, pair_ends = w.shingles(2)
    lines = np.flatnonzero(data == 10)
    a = p = 0
    at = np.searchsorted(lines, edges)
    for i, (e, q) in enumerate(zip(w.ends.tolist(), pair_ends.tolist(), strict=True)):
        if e > a:
            u, c = np.unique(w.hash[a:e], return_counts=True)
            out[i, col["distinct_words"]] = len(u) / (e - a)
            out[i, col["top_word"]] = c.max() / (e - a)
            out[i, col["longest_word"]] = np.log1p(length[a:e].max())
            out[i, col["distinct_pairs"]] = len(np.unique(pairs[p:q])) / (q - p) if q > p else 1.0
            cut = lines[at[i] : at[i + 1]]
            if len(cut):
                first = np.append(edges[i], cut + 1)
                to = np.append(cut, edges[i + 1])
                own = [x for s, t in zip(first.tolist(), to.tolist(), strict=True) if (x := data[s:t].tobytes()).strip()]
                out[i, col["distinct_lines"]] = len(set(own)) / max(1, len(own))
                out[i, col["line_words"]] = np.log1p((e - a) / max(1, len(own)))
            else:
                out[i, col["distinct_lines"]], out[i, col["line_words"]] = 1.0, np.log1p(e - a)
        a, p = e, q
    return out


Rule = tuple[tuple[int, bool, float], ...]


def _tree(x: np.ndarray, bins: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, least: int, cols: np.ndarray):
    """Grow a regression tree on gradients; (rules of all nodes but the root, prediction)."""
    rules: list[Rule] = []
    value = np.zeros(len(g))

    def grow(rows: np.ndarray, path: Rule, left: int) -> None:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        if path:
            rules.append(path)
        value[rows] = -total_g / (total_h + 1.0)
        if not left or len(rows) < 2 * least:
            return
        best = (1e-6, -1, -1)
        for c in cols.tolist():
            n_bins = len(edges[c]) + 1
            b = bins[rows, c]
            gs, hs, ns = (np.cumsum(np.bincount(b, y, n_bins))[:-1] for y in (g[rows], h[rows], None))
            ok = (ns >= least) & (len(rows) - ns >= least)
            if ok.any():
                gain = np.where(ok, gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1), -1)
                k = int(np.argmax(gain))
                best = max(best, (float(gain[k]), c, k))
        _, c, k = best
        if c < 0:
            return
        low = bins[rows, c] <= k
        cut = float(edges[c][k])
        grow(rows[low], (*path, (c, True, cut)), left - 1)
        grow(rows[~low], (*path, (c, False, cut)), left - 1)

    grow(np.arange(len(g)), (), depth)
    return rules, value


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c, low, cut in rule:
        out &= x[:, c] <= cut if low else x[:, c] > cut
    return out


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2) -> list[Rule]:
    """Distinct rules of boosted trees, each on half of the rows and two thirds of the statistics."""
    rng = np.random.default_rng(5)
    edges = [np.unique(np.quantile(x[:, c], np.linspace(0, 1, 65)[1:-1])) for c in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, c], side="left") for c, e in enumerate(edges)], 1)
    score = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    rules: dict[Rule, None] = {}
    least = max(5, len(y) // 500)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        rows = rng.permutation(len(y))[: max(2, len(y) // 2)]
        cols = rng.permutation(x.shape[1])[: max(1, 2 * x.shape[1] // 3)]
        found, _ = _tree(x[rows], bins[rows], edges, (p - y)[rows], (p * (1 - p))[rows], depth, least, cols)
        leaves = [r for r in found if not any(len(q) > len(r) and q[: len(r)] == r for q in found)]
        for r in leaves:
            at = holds(r, x)
            g, h = (p - y)[at].sum(), (p * (1 - p))[at].sum()
            score[at] -= rate * g / (h + 1.0)
        rules.update(dict.fromkeys(found))
    return list(rules)


def lasso(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """L1-penalised logistic regression by accelerated proximal gradient; the bias isn't penalised."""
    n = len(y)
    a1 = np.hstack([np.ones((n, 1)), a]).astype(np.float64)
    v = np.ones(a1.shape[1])
    for _ in range(15):
        v = a1.T @ (a1 @ v)
        v /= np.linalg.norm(v)
    step = 4 * n / float(v @ (a1.T @ (a1 @ v)))
    w = z = np.zeros(a1.shape[1])
    t = 1.0
    for _ in range(steps):
        g = a1.T @ (1 / (1 + np.exp(-a1 @ z)) - y) / n
        new = z - step * g
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t1 * (new - w)
        w, t = new, t1
    return float(w[0]), w[1:]


class RuleModel:
    """bias, weighted rules and weighted clipped statistics: (column, low, high, weight)."""

    def __init__(self, bias: float, rules: list[tuple[Rule, float]], linear: list[tuple[int, float, float, float]]):
        self.bias, self.rules, self.linear = bias, rules, linear

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for r, w in self.rules:
            total += w * holds(r, x)
        for c, low, high, w in self.linear:
            total += w * (np.clip(x[:, c], low, high) - low) / (high - low)
        return 1 / (1 + np.exp(-total))

    def column(self, of) -> Column:
        """The score as a Spark expression; of(i): the column of statistic i."""
        total = F.lit(self.bias)
        for r, w in self.rules:
            cond = F.lit(True)
            for c, low, cut in r:
                cond = cond & (of(c) <= cut if low else of(c) > cut)
            total = total + F.when(cond, F.lit(w)).otherwise(0.0)
        for c, low, high, w in self.linear:
            total = total + (F.least(F.greatest(of(c), F.lit(low)), F.lit(high)) - low) / (high - low) * w
        return 1 / (1 + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.001) -> RuleModel:
    if not len(y):
        return RuleModel(np.inf, [], [])  # nothing to learn from: everything may stay
    rules = grow_rules(x, y)
    low, high = np.quantile(x, 0.02, axis=0), np.quantile(x, 0.98, axis=0)
    wide = np.flatnonzero(high > low)
    parts = [holds(r, x)[:, None] for r in rules] + [((np.clip(x[:, c], low[c], high[c]) - low[c]) / (high[c] - low[c]))[:, None] for c in wide]
    bias, w = lasso(np.hstack(parts), y, penalty) if parts else (float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), np.zeros(0))
    kept = [(r, float(v)) for r, v in zip(rules, w[: len(rules)], strict=True) if v]
    linear = [(int(c), float(low[c]), float(high[c]), float(v)) for c, v in zip(wide, w[len(rules) :], strict=True) if v]
    return RuleModel(bias, kept, linear)


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """(*keep, features): the statistics of every whole text; keep: columns without nested names clashing."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = np.concatenate([statistics(data, offsets) for _, _, data, offsets in passes(b.column("text"))])
                f = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), f], [*keep, "features"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(run, f"{fields}, features array<double>")


def train(docs: DataFrame, labels: DataFrame, limit: int = LIMIT) -> RuleModel:
    known = sample(docs, labels, "quality", limit).withColumn("text_key", text_key("text"))
    rows = examples(with_statistics(known, ["doc_id", "y", "text_key"]))
    return fit(np.array([r.features for r in rows]).reshape(len(rows), len(STATISTICS)), np.array([r.y for r in rows], float))


def quality(docs: DataFrame, labels: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``; null text counts as empty.

    Learns from labels.quality outside the held-out fold only; with no such label all scores are 1.
    """
    model = train(docs, labels, limit)
    score = model.column(lambda i: F.col("features")[i])
    out = with_statistics(docs, ["doc_id"]).select("doc_id", held_out().alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
