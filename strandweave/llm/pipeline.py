"""The stages of corpus_pipeline.py. Each takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of their input, and every stage works on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import functions as F

from ._shared import stage, table, text_key


def _as_documents(docs, rows):
    """The columns of ``docs`` out of a struct column doc."""
    return rows.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def _packed_columns(docs):
    """Input columns as one struct, so that no name of theirs can clash, beside doc_id and text."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))


def drop_toxic(spark, docs, sf_dir):
    """Toxicity: documents that the model rejects go; learned from labels outside the held-out fold.

    Null and empty texts have the score of the bias alone and are never toxic words; equal rows share one verdict. Without labels, or
    without documents, nothing goes.
    """
    from .toxicity import THRESHOLD, scored, train

    model = train(docs, table(spark, sf_dir, "labels"))
    return _as_documents(docs, scored(_packed_columns(docs), model).where(F.col("score") < THRESHOLD))


def drop_near_copies(spark, docs, sf_dir):
    """MinHash near-dedup: of each group of near copies the document with the smallest doc_id stays.

    Documents without words, and those without a doc_id, stay; of rows with the same doc_id and text one stays.
    """
    from .minhash import classified

    # of equal rows of (doc_id, text) that stay, one does; they are few, so only they are sorted out
    of = classified(docs, k=5, percent=80).withColumn("id", F.coalesce("doc_id", F.lit(-1).cast("long"))).withColumn("no_id", F.col("doc_id").isNull())
    keys = ["id", "no_id", "text_key"]
    of = of.groupBy(*keys).agg(F.max("kept").alias("kept"), F.count("*").alias("same"), F.max("n_shingles").alias("n"))
    whole = _packed_columns(docs).withColumn("id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long"))).withColumn("no_id", F.col("doc_id").isNull())
    whole = whole.withColumn("text_key", text_key(F.col("text").cast("string"))).join(of.where("kept"), keys)
    once = (F.col("same") == 1) | (F.col("n") == 0) | F.col("no_id")
    return _as_documents(docs, whole.where(once).select("doc").unionByName(whole.where(~once).dropDuplicates(keys).select("doc")))


def cut_repeats(spark, docs, sf_dir):
    """Substring dedup: passages of 50 words or more that an earlier document has are cut out.

    Earlier: in one fixed order of (doc_id, text) hashes. Null, empty and short texts stay as they are, rows with equal doc_id and text are one
    document and cut alike; a document of which no word remains goes. No documents: no rows.
    """
    from .substring import without_repeats

    return without_repeats(docs)


def mix_sources(spark, docs, sf_dir):
    """Mixing: a document is repeated as often as the mix takes it; those it doesn't take go. Longer ones have the better odds.

    Null texts have no words; a null source is a source of its own, the last. Repeated rows are drawn one by one; ties of rank go by doc_id
    and row. No documents: no rows.
    """
    from .mixing import WORD, copies

    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")).withColumn("row", F.monotonically_increasing_id())
    whole = stage(whole, "documents")
    size = F.coalesce(F.regexp_count(F.col("doc.text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = stage(whole.select("row", F.col("doc.doc_id").alias("doc_id"), F.col("doc.source").cast("string").alias("source"), size.alias("size"), F.log2(size + 2.0).alias("odds")), "sizes")
    taken = copies(rows).where("copies > 0").select("row", "copies")
    again = whole.join(taken, "row").select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long"))))
    return _as_documents(docs, again)


def pack(spark, docs, sf_dir):
    """Best-fit packing of the mix into sequences of at most 4096 tokens: one row per piece.

    Null and empty texts are their end id alone; repeated rows and those without a doc_id are packed each by itself; pieces of equal length go
    in the order of their rows. No documents: no rows.
    """
    from .packing import pack_documents

    return pack_documents(docs, size=4096, end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("source_mix", mix_sources),
    ("best_fit_packing", pack),
]
