"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import held_out, text_key


def sample(docs: DataFrame, labels: DataFrame, target: str, limit: int) -> DataFrame:
    """(doc_id, text, y) for at most ``limit`` labelled doc_ids outside the held-out fold.

    The doc_ids with the smallest hashes, so a rerun gives the same ones; their label rows are at most
    ``limit``, which bounds the broadcast. A doc_id with several labels gets the largest.
    """
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y"))
    y = y.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("y").alias("y"))
    y = y.orderBy(F.xxhash64("doc_id")).limit(limit)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(y), "doc_id")


def one_each(featured: DataFrame) -> DataFrame:
    """(doc_id, y, features) with one row per doc_id; of repeated rows the one with the smallest text hash."""
    return featured.groupBy("doc_id").agg(F.min("y").alias("y"), F.min_by("features", "text_key").alias("features"))


def examples(featured: DataFrame) -> list:
    """Collect (y, features) of ``one_each``: for small features."""
    return one_each(featured).orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id").select("y", "features").collect()


__all__ = ["examples", "one_each", "sample", "text_key"]
