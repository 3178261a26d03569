"""A corpus pipeline of five stages over the operators of strandweave.llm."""

from __future__ import annotations

from strandweave.llm._shared import stage as _staged
from strandweave.llm.pipeline import STAGES

#: No stage but the mix can be said in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents of ``sf_dir``; each one's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = _staged(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
