"""Mixing of sources to target weights by hash-threshold histograms (problem 9).

A document's hash, uniform over 2^60, stands for its place in a random order. Tokens are summed by source and hash bucket; the
running sums over the buckets show where a source's budget ends; only that bucket is summed again by finer parts of the hash,
until a part holds one hash. A document is taken if its hash lies below its source's threshold: no sort, and a larger budget
always contains a smaller one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docflow.llm.bpe import FOLDER, VOCABULARY, count_tokens
from docflow.llm.tables import cut, small

BITS = (12, 16, 16, 16)  # of the hash in each step of refinement: 60 together


def sized(documents: DataFrame, folder: str = FOLDER, name: str = VOCABULARY) -> DataFrame:
    """doc_id, source, n_tokens, h of every document, as a cut lineage: all steps read the same sizes."""
    counted = count_tokens(documents, "text", "doc_id", "source", folder=folder, name=name)
    h = F.shiftrightunsigned(F.xxhash64("doc_id"), 4)
    return cut(counted.withColumn("h", h))


def budgets(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """plan_id, source, share, n_tokens (of the source), target and whole (copies of everything), rest (tokens beyond them).

    A plan's shares are scaled to add up to 1 over all its sources with a positive share. The mixture's size is size_ratio
    times the tokens of all documents. A source gives at most max_repeats (null: any number) times its tokens; what a source
    can't give is not moved to others but reported as missing. A source without documents gives nothing.
    """
    per = sizes.where("source is not null").groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"))
    total = sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("all_tokens"))
    t = targets.where("plan_id is not null and source is not null and target_share > 0 and not isnan(target_share)")
    t = t.groupBy("plan_id", "source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"), F.max("size_ratio").alias("size_ratio"))
    w = Window.partitionBy("plan_id")
    t = t.withColumn("share", F.col("target_share") / F.sum("target_share").over(w)).withColumn("ratio", F.max("size_ratio").over(w))
    # one row per source and plan: both sides are small by their meaning, still no hint forces a broadcast
    b = t.join(per, "source", "left").join(F.broadcast(total))  # total: one row
    n = F.coalesce("n_tokens", F.lit(0))
    target = F.round(F.col("share") * F.col("ratio") * F.col("all_tokens")).cast("bigint")
    most = F.when(F.col("max_repeats").isNull(), F.lit(2**62)).otherwise(F.floor(F.greatest(F.col("max_repeats"), F.lit(0.0)) * n))
    given = F.least(target, most)
    whole = F.when(n > 0, F.floor(given / n)).otherwise(0)
    return b.select("plan_id", "source", "share", "ratio", "max_repeats", n.alias("n_tokens"), "all_tokens", target.alias("target"), given.alias("given"), whole.cast("int").alias("whole"), F.when(n > 0, given - whole * n).otherwise(0).alias("rest"))


def thresholds(sizes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` with ``below``: hashes under it fit into ``rest`` tokens, and the next one doesn't."""
    left = wanted.select("plan_id", "source", F.col("rest").alias("budget"), F.lit(0).cast("bigint").alias("prefix"))
    shift, used = 60, 0
    docs = sizes.where("source is not null and n_tokens > 0").select("source", "h", "n_tokens")
    for bits in BITS:
        # tokens by source and hash bucket, of the boundary buckets only; the first step takes all
        keys = left.select("source", "prefix").distinct()
        level = docs if not used else docs.withColumn("prefix", F.shiftright("h", shift)).join(small(keys), ["source", "prefix"]).drop("prefix")
        shift -= bits
        hist = level.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("n_tokens").alias("t"))
        run = Window.partitionBy("source", "group").orderBy("bucket")
        hist = hist.withColumn("group", F.shiftright("bucket", bits)).withColumn("cum", F.sum("t").over(run)).withColumn("before", F.col("cum") - F.col("t"))
        cond = (left["source"] == hist["source"]) & (left["prefix"] == hist["group"]) & (F.col("before") <= F.col("budget")) & (F.col("cum") > F.col("budget"))
        edge = left.join(hist, cond, "left").select("plan_id", left["source"], (F.col("budget") - F.coalesce("before", F.lit(0))).alias("budget"), F.coalesce("bucket", F.shiftleft(left["prefix"], bits)).alias("prefix"))
        left, used = cut(edge), used + bits
    return wanted.join(left.select("plan_id", "source", F.col("prefix").alias("below")), ["plan_id", "source"])


def plan(documents: DataFrame, targets: DataFrame, folder: str = FOLDER, name: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(sizes, thresholds): what mixture and shares are made of."""
    sizes = sized(documents, folder, name)
    return sizes, cut(thresholds(sizes, cut(budgets(sizes, targets))))


def mixture(sizes: DataFrame, limits: DataFrame) -> DataFrame:
    """plan_id, doc_id, source, n_tokens, copies of every document of every plan's mixture."""
    few = limits.select("plan_id", F.col("source").alias("s"), "whole", "rest", "below")  # one row per plan and source
    got = sizes.join(small(few), F.col("source") == F.col("s"))
    copies = F.col("whole") + F.when((F.col("h") < F.col("below")) & (F.col("n_tokens") > 0) & (F.col("rest") > 0), 1).otherwise(0)
    return got.withColumn("copies", copies.cast("int")).where("copies > 0").select("plan_id", "doc_id", "source", "n_tokens", "copies")


def shares(sizes: DataFrame, limits: DataFrame) -> DataFrame:
    """plan_id, source, target_share, actual_share, tokens, documents, most_copies, missing_tokens of every target."""
    got = mixture(sizes, limits).groupBy("plan_id", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    both = limits.join(got, ["plan_id", "source"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    w = Window.partitionBy("plan_id")
    size = F.sum("tokens").over(w)
    return both.select("plan_id", "source", F.round("share", 6).alias("target_share"), F.round(F.when(size > 0, F.col("tokens") / size).otherwise(0.0), 6).alias("actual_share"), "tokens", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.greatest(F.col("target") - F.col("tokens"), F.lit(0)).alias("missing_tokens"))
