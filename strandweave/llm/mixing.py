"""Mixing sources to target weights, by Pareto order sampling. DataFrame functions only.

Targets: every source's share of all words by its weight, but at most ``cap`` times its own size; what
a capped source can't take goes to the others by weight. With the sources sorted by cap / weight the level
comes from one running sum.

Copies: a document has min(cap, e * odds) expected copies, with one e per source for which the expected words are the target: floor of
them are certain, and the fraction p is its inclusion probability. The capped documents are those of the largest odds; where they end is found from
sums per source and power of 2**(1/256) of the odds. Pareto order sampling
(Rosen, 1997) ranks documents by U / (1 - U) over p / (1 - p), U a hash of the document, and takes from the
smallest on; here until the source's remaining words are used up, twice more among those that still fit, then the one
document whose size is nearest to what is left, if it helps.

No source is ordered in one task: the ranks are cut into buckets, words are summed per source and
bucket, and only the bucket in which the budget runs out is sorted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import stage

#: The words of a text.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
CAP = 3.0
#: Steps of odds in a factor of two, for which sums are kept.
STEPS = 256
#: Times that documents are taken in order of rank: what follows the first that doesn't fit may still fit.
ROUNDS = 3
KEY = ["src", "no_src"]
#: Share of its target by which a source may be off before smaller documents are exchanged for a larger one.
TOLERANCE = 0.002


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(src, no_src, source_size, target) of (src, no_src, source_size): one row a source."""
    name = Window.orderBy("no_src", "src")
    everything = Window.partitionBy()
    # one row a source, whatever the number of documents
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("most", F.lit(cap) * F.col("source_size"))
    by_level = Window.orderBy(F.col("most") / F.col("w"), "no_src", "src")
    s = s.withColumn("before", F.sum("most").over(by_level) - F.col("most"))
    s = s.withColumn("after", F.sum("w").over(everything) - F.sum("w").over(by_level) + F.col("w"))
    s = s.withColumn("total", F.sum("source_size").over(everything))
    s = s.withColumn("level", F.max((F.col("total") - F.col("before")) / F.col("after")).over(everything))
    return s.select("src", "no_src", "source_size", F.least("most", F.col("level") * F.col("w")).alias("target"))


def copies(rows: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP, seed: int = 1) -> DataFrame:
    """``rows`` (row long, doc_id, source, size long, odds double) with source_size, target and copies.

    rows must be read from files: they are used several times.
    """
    rows = rows.withColumn("src", F.coalesce("source", F.lit(""))).withColumn("no_src", F.col("source").isNull())
    rows = rows.withColumn("odds", F.greatest(F.lit(0.0), F.coalesce(F.nanvl("odds", F.lit(0.0)), F.lit(0.0))))
    step = F.when(F.col("odds") > 0, F.floor(F.log2("odds") * STEPS))
    steps = rows.groupBy(*KEY, step.alias("step")).agg(F.sum("size").alias("words"), F.sum(F.col("size") * F.col("odds")).alias("weighed"), F.count("*").alias("n"))
    steps = stage(steps, "steps")
    sizes = steps.groupBy(*KEY).agg(F.sum("words").alias("source_size"), F.sum("n").alias("n"))
    of = targets(sizes, weights, cap).join(sizes.select(*KEY, "n"), KEY)
    of = stage(of.join(_level(steps, of, cap), KEY, "left").withColumn("e", F.coalesce("e", F.lit(0.0))), "sources")
    n = of.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    buckets = 1 << min(17, max(6, math.ceil(math.log2(max(n, 2)) / 2)))

    expected = F.least(F.lit(cap), F.col("e") * F.col("odds"))
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id", "source", "size"), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    ranked = (
        rows.join(of.select("src", "no_src", "source_size", "target", "e"), ["src", "no_src"])
        .withColumn("sure", F.floor(expected + 1e-9))
        .withColumn("p", F.greatest(F.lit(0.0), expected - F.col("sure")))
        .withColumn("p", F.when(F.col("p") > 1e-9, F.col("p")).otherwise(0.0))
    )
    base = F.least(F.greatest(F.col("e") - F.floor("e"), F.lit(1e-6)), F.lit(1 - 1e-6))
    # Pareto's ratio, put on (0, 1) so that equal p give back U
    ratio = u / (1 - u) / (F.col("p") / (1 - F.col("p"))) * (base / (1 - base))
    open_ = F.col("p") > 0
    ranked = ranked.withColumn("rank", F.when(open_, ratio / (1 + ratio))).withColumn("bucket", F.least(F.floor(F.col("rank") * buckets), F.lit(buckets - 1)))
    ranked = stage(ranked.select("row", "doc_id", "source", "size", "src", "no_src", "source_size", "target", "sure", "rank", "bucket"), "ranked")

    budget = ranked.groupBy(*KEY).agg((F.max("target") - F.sum(F.col("sure") * F.col("size"))).alias("budget"))
    at = ranked.withColumn("more", F.lit(False))
    for _ in range(ROUNDS):
        # budget: one row a source; the planner broadcasts it when it is small
        at, budget = _take(at, stage(budget, "budget"))
    # a few large documents can leave a small source far off: then one too many goes in, and smaller ones out
    budget = stage(budget, "budget")
    off = budget.join(of.select(*KEY, "target"), KEY).where(F.col("budget") > TOLERANCE * F.col("target")).select(*KEY, "budget")
    over = at.where("not more and rank is not null").join(off, KEY).where("size > budget")
    over = over.groupBy(*KEY).agg(F.min(F.struct("size", "rank", "doc_id", "row")).alias("large"))
    over = stage(over.select(*KEY, "large.size", "large.row"), "over")
    at = at.join(over.select("row", F.lit(True).alias("large")), "row", "left").withColumn("more", F.col("more") | F.coalesce("large", F.lit(False))).drop("large")
    budget = budget.join(over.select(*KEY, "size"), KEY, "left").select(*KEY, (F.col("budget") - F.coalesce("size", F.lit(0))).alias("budget"))
    for _ in range(2):
        at, budget = _take(at, stage(budget, "budget"), out=True)
    closest = at.where("rank is not null").join(budget, KEY).where(F.col("more") == (F.col("budget") < 0))
    closest = closest.withColumn("miss", F.abs(F.col("size") - F.abs("budget"))).where(F.col("miss") < F.abs("budget"))
    nearest = closest.groupBy(*KEY).agg(F.min(F.struct("miss", "rank", "doc_id", "row")).alias("near"))
    closing = nearest.select(F.col("near.row").alias("row"), F.lit(True).alias("closes"))
    out = at.join(closing, "row", "left").withColumn("copies", F.col("sure") + (F.col("more") != F.coalesce("closes", F.lit(False))).cast("int"))
    return out.select("row", "doc_id", "source", "size", "source_size", "target", "copies")


def _level(steps: DataFrame, of: DataFrame, cap: float) -> DataFrame:
    """(src, no_src, e): sum of min(cap, e * odds) * size is the target. Rows of a source here are steps of odds, not documents."""
    down, up = Window.partitionBy(*KEY).orderBy(F.desc("step")), Window.partitionBy(*KEY).orderBy("step")
    at = steps.where("step is not null").join(of.select(*KEY, "target"), KEY)
    at = at.withColumn("above", F.sum("words").over(down) - F.col("words")).withColumn("rest", F.sum("weighed").over(up))
    at = at.withColumn("e", F.when(F.col("rest") > 0, (F.col("target") - F.lit(cap) * F.col("above")) / F.col("rest")))
    fits = at.where(F.col("e").isNotNull() & (F.col("e") * F.pow(F.lit(2.0), (F.col("step") + 1) / STEPS) <= cap * (1 + 2 / STEPS)))
    found = fits.groupBy(*KEY).agg(F.max_by("e", "step").alias("found"))
    # where none fits, every document has cap copies
    all_ = at.groupBy(*KEY).agg((F.lit(cap) / F.pow(F.lit(2.0), F.min("step") / STEPS)).alias("all"))
    return all_.join(found, KEY, "left").select(*KEY, F.greatest(F.lit(0.0), F.coalesce("found", "all")).alias("e"))


def _take(at: DataFrame, budget: DataFrame, out: bool = False) -> tuple[DataFrame, DataFrame]:
    """Take the documents of smallest rank, of those that still fit by themselves, as long as their sum fits; or take
    out those of largest rank where the budget is overdrawn."""
    way, due = (-1, F.greatest(F.lit(0.0), -F.col("budget"))) if out else (1, F.col("budget"))
    open_ = (F.col("more") == out) & F.col("rank").isNotNull() & (F.col("size") <= F.col("due"))
    at = at.join(budget.select(*KEY, due.alias("due")), KEY).withColumn("open", open_).withColumn("turn", F.col("bucket") * way)
    sums = at.where("open").groupBy(*KEY, "turn").agg(F.sum("size").alias("words"), F.max("due").alias("due"))
    sums = sums.withColumn("until", F.sum("words").over(Window.partitionBy(*KEY).orderBy("turn")))
    # the bucket in which the budget runs out; none if it never does
    cut = sums.where("until > due").groupBy(*KEY).agg(F.min("turn").alias("cut"), F.min_by(F.col("until") - F.col("words"), "turn").alias("until"))
    at = at.join(stage(cut, "cuts"), KEY, "left")
    inside = Window.partitionBy(*KEY).orderBy(F.col("rank") * way, "doc_id", "row").rowsBetween(Window.unboundedPreceding, 0)
    last = at.where("open and turn = cut").withColumn("fits", F.col("until") + F.sum("size").over(inside) <= F.col("due"))
    last = last.where("fits").select("row", F.lit(True).alias("fits"))
    now = F.col("open") & (F.col("cut").isNull() | (F.col("turn") < F.col("cut")) | F.coalesce("fits", F.lit(False)))
    at = at.join(last, "row", "left").withColumn("now", now)
    at = stage(at.drop("due", "open", "turn", "cut", "until", "fits"), "taken")
    used = at.where("now").groupBy(*KEY).agg(F.sum("size").alias("used"))
    left = budget.join(used, KEY, "left").select(*KEY, (F.col("budget") - way * F.coalesce("used", F.lit(0))).alias("budget"))
    return at.withColumn("more", F.col("more") != F.col("now")).drop("now"), left


def sized(docs: DataFrame, odds: Column | None = None) -> DataFrame:
    """(row, doc_id, source, size, odds), written to the shared folder; the only pass over the texts."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), (F.lit(1.0) if odds is None else odds).alias("odds"))
    return stage(rows.withColumn("row", F.monotonically_increasing_id()), "sizes")


def length_odds(text: str = "text") -> Column:
    """Odds that favour longer texts: log2(2 + words)."""
    return F.log2(2.0 + F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP, odds: Column | None = None, seed: int = 1) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row per row of ``docs`` (doc_id, text, source).

    size: the text's words, null text 0. Sources in code point order, null last, weigh ``weights`` in turn. taken:
    size times the copies the mix takes, at most cap * size; a source's taken words come within half a document
    of its target, and mostly within a few words. Repeated rows are drawn one by one; odds that are null,
    NaN or not over 0 draw nothing. The same documents give the same mix. An empty table gives none.
    """
    out = copies(sized(docs, odds), weights, cap, seed)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
