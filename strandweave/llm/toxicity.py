"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: the set of its words, word pairs and pairs with one word between (words: runs of digits, letters and non-ASCII
characters, A-Z lower-cased). Words are hashed to the lower half of ``2**BITS`` places, pairs to the upper half.
Training is McMahan et al.'s per-coordinate FTRL-proximal: each coordinate has its own rate, and L1
keeps weights at exactly zero until their gradients add up; pairs, of which most are chance, need more of it than words. A toxic example
counts ``TOXIC`` times, since they are few. The non-zero weights, at most 2**BITS and
usually a few hundred, go to the executors with the task; scoring is one pass over the texts.

It is fitted in one executor task on at most ``LIMIT`` labelled documents (a parameter), of which the driver sees the weights
alone; scoring, thresholds and features see every whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import drop, held_out, stage
from ._words import Words, mix, passes, rolling
from .labelled import one_each, sample, text_key

BITS = 18
LIMIT = 12_000
THRESHOLD = 0.5
#: L1 of words and of pairs; the weight of a toxic example.
WORD_L1, PAIR_L1, TOXIC = 20.0, 60.0, 6.0


def _places(w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(place, text) of each unigram, bigram and skip-gram."""
    text = np.repeat(np.arange(len(w.ends)), w.counts)
    out = [(mix(w.hash ^ np.uint64(1)), text)]
    for gap in (1, 2):
        a, b = w.hash[:-gap], w.hash[gap:]
        same = text[:-gap] == text[gap:]
        out.append((mix((a * np.uint64(0x9FB21C651E98DF25) + np.uint64(gap)) ^ b)[same], text[:-gap][same]))
    half = 1 << BITS - 1
    return [((h >> np.uint64(65 - BITS)).astype(np.int32) + half * (n > 0), t) for n, (h, t) in enumerate(out)]


def feature_sets(data, offsets) -> list[np.ndarray]:
    w = Words(data, offsets, "alnum")
    place, text = (np.concatenate(x) for x in zip(*_places(w), strict=True))
    order = np.argsort(text, kind="stable")
    cuts = np.searchsorted(text[order], np.arange(1, len(w.ends)))
    return [np.unique(x) for x in np.split(place[order], cuts)]


class Ftrl:
    """w = 0 where |z| <= l1, else -(z - sign(z) * l1) / ((beta + sqrt(n)) / alpha). l1 is per place; the bias has none."""

    def __init__(self, l1: np.ndarray, alpha: float = 2.0, beta: float = 1.0, toxic: float = TOXIC):
        self.l1, self.z, self.n = l1, np.zeros(len(l1)), np.zeros(len(l1))
        self.alpha, self.beta, self.toxic = alpha, beta, toxic
        self.bias_z = self.bias_n = 0.0

    def _weight(self, z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha))

    @property
    def weights(self) -> np.ndarray:
        return self._weight(self.z, self.n, self.l1)

    @property
    def bias(self) -> float:
        return float(self._weight(np.float64(self.bias_z), np.float64(self.bias_n), 0.0))

    def learn(self, at: np.ndarray, y: int) -> None:
        z, n = self.z[at], self.n[at]
        w, b = self._weight(z, n, self.l1[at]), self.bias
        p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35)))
        g = (p - y) * (self.toxic if y else 1.0)
        self.z[at] = z + g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        self.bias_z += g - (np.sqrt(self.bias_n + g * g) - np.sqrt(self.bias_n)) / self.alpha * b
        self.bias_n += g * g


def penalties() -> np.ndarray:
    return np.repeat([WORD_L1, PAIR_L1], 1 << BITS - 1)


def fit(examples: list[tuple[np.ndarray, int]], epochs: int) -> Ftrl:
    model = Ftrl(penalties())
    for _ in range(epochs):
        for at, y in examples:
            model.learn(at, y)
    return model


class Model:
    """bias, and the non-zero weights by place. Without examples every score is 0."""

    def __init__(self, bias: float, at: np.ndarray, weight: np.ndarray):
        self.bias, self.at, self.weight = bias, at.astype(np.int32), weight.astype(np.float64)

    def score(self, data, offsets) -> np.ndarray:
        dense = np.zeros(1 << BITS)
        dense[self.at] = self.weight
        total = np.full(len(offsets) - 1, self.bias)
        hits = []
        for place, text in _places(Words(data, offsets, "alnum")):
            x = dense[place] != 0
            hits.append(text[x].astype(np.int64) << BITS | place[x])
        hit = np.unique(np.concatenate(hits))
        np.add.at(total, hit >> BITS, dense[hit & (1 << BITS) - 1])
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-total))


def train(docs: DataFrame, labels: DataFrame, limit: int = LIMIT, epochs: int = 10) -> Model:
    """The model for labels.toxic outside the held-out fold; without any such label its scores are 0."""

    def features(batches):
        for b in batches:
            if b.num_rows:
                sets = [s for _, _, data, offsets in passes(b.column("text")) for s in feature_sets(data, offsets)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), b.column("text_key"), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "y", "text_key", "features"])

    def learn(batches):
        rows = [(np.frombuffer(x.as_py(), np.int32), y) for b in batches for x, y in zip(b.column("features"), b.column("y").to_pylist(), strict=True)]
        if rows:
            model = fit(rows, epochs)
            w = model.weights
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int64)), pa.array(np.append(w[at], model.bias))], ["place", "weight"])

    known = sample(docs, labels, "toxic", limit).select("doc_id", "y", text_key("text").alias("text_key"), "text")
    made = stage(known.mapInArrow(features, "doc_id long, y int, text_key long, features binary"), "features")
    # at most ``limit`` examples, in one order: one task's worth
    learned = stage(one_each(made).repartition(1).sortWithinPartitions(F.xxhash64(F.lit(1), "doc_id"), "doc_id").select("y", "features").mapInArrow(learn, "place long, weight double"), "weights")
    got = learned.toPandas()
    drop(made, learned)
    if not len(got):
        return Model(-np.inf, np.zeros(0), np.zeros(0))
    place, weight = got["place"].to_numpy(), got["weight"].to_numpy()
    return Model(float(weight[place < 0][0]), place[place >= 0], weight[place >= 0])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a column score; its other columns stay. Null text counts as empty."""

    def run(texts):
        for t in texts:
            yield pa.array(np.concatenate([model.score(data, offsets) for _, _, data, offsets in passes(t)]) if len(t) else np.zeros(0))

    score = F.arrow_udf(_iterated(run), "double")
    return docs.withColumn("score", score(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def _iterated(run):
    from collections.abc import Iterator

    def each(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return run(texts)

    each.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return each


def toxicity(docs: DataFrame, labels: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``.

    Learns from labels.toxic outside the held-out fold only; with no such label all scores are 0.
    """
    out = scored(docs.select("doc_id", "text"), train(docs, labels, limit))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
