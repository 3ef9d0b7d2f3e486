"""A mixture of sources with target shares of the total size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.llm.tokens import RANKS, token_count
from lodeweave.session import cut

BUCKETS = 1024


def source_key(c: Column) -> Column:
    """Normalised spelling of a source: lower case, trimmed, runs of blanks and hyphens as one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"^\s+|\s+$", ""), r"[\s_-]+", "_")


def prefix_sums(df: DataFrame, group: str, key: str, size: str, tie: str, buckets: int = BUCKETS) -> DataFrame:
    """df with ``before``: the sum of ``size`` over the rows of its group that come before it by (key, tie).

    ``key`` is a uniform 64-bit hash, so its high bits cut each group into ranges of equal
    expectation; sums per range (at most groups x buckets rows) are accumulated first, then
    each range is sorted on its own. No task sees a whole group.
    """
    width = F.lit(float(2**64 / buckets))
    ranged = df.withColumn("__range", F.least(F.floor((F.col(key).cast("double") + F.lit(float(2**63))) / width), F.lit(buckets - 1)).cast("int"))
    per = ranged.groupBy(group, "__range").agg(F.sum(size).alias("__s"))
    earlier = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(group, "__range", F.coalesce(F.sum("__s").over(earlier), F.lit(0)).alias("__off"))
    inside = Window.partitionBy(group, "__range").orderBy(key, tie).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("__in", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return local.join(offsets, [group, "__range"]).withColumn("before", F.col("__off") + F.col("__in")).drop("__range", "__off", "__in")


def sized(documents: DataFrame, path: str = RANKS) -> DataFrame:
    """(doc_id, source, tokens), kept in the shared folder so that texts are read once."""
    return cut(documents.select("doc_id", source_key(F.col("source")).alias("source"), token_count(F.col("text"), path).cast("long").alias("tokens")))


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 17, path: str = RANKS) -> DataFrame:
    """(doc_id, source, tokens, uses): how often the mixture uses each document.

    The mixture is as large as the collection unless ``total_tokens`` is given. Each source's
    budget is its share of that, at most max_repeats times its size. A source is used in whole
    epochs as long as the budget reaches, then documents are taken in the order of a random
    hash until their exact prefix sum would pass the budget; so a source falls short of its
    budget by less than one document, and no document is used more than max_repeats times. What a source cannot
    give for its cap is not made up by the others; mixture_shares reports the shares as they come out.
    Every document is returned; those of unlisted or null sources with 0 uses. Sources are
    compared in normalised spelling; repeated target rows of one source add their shares
    (the highest cap holds); a null or negative share counts 0, a null cap 1.
    """
    docs = sized(documents, path)
    want = targets.select(source_key(F.col("source")).alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("share"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("cap"))
    want = want.filter("source is not null").groupBy("source").agg(F.sum("share").alias("share"), F.max("cap").alias("cap"))
    have = docs.groupBy("source").agg(F.sum("tokens").alias("size"))
    whole = F.lit(total_tokens) if total_tokens is not None else have.agg(F.sum("size")).scalar()
    budget = F.least(F.floor(F.col("share") * whole), F.col("cap") * F.col("size"))
    plan = want.join(have, "source").withColumn("budget", budget).withColumn("epochs", F.when(F.col("size") > 0, F.floor(F.col("budget") / F.col("size"))).otherwise(F.lit(0)))
    plan = plan.select("source", "epochs", (F.col("budget") - F.col("epochs") * F.col("size")).alias("rest"))
    placed = prefix_sums(docs.withColumn("k", F.xxhash64("doc_id", F.lit(seed))).withColumn("g", F.coalesce("source", F.lit(""))), "g", "k", "tokens", "doc_id")
    fits = (F.col("before") + F.col("tokens") <= F.col("rest")) & (F.col("rest") > 0)
    return placed.join(plan, "source", "left").select("doc_id", "source", F.col("tokens").cast("long").alias("tokens"), F.coalesce(F.col("epochs") + fits.cast("long"), F.lit(0)).cast("long").alias("uses"))


def mixture_shares(documents: DataFrame, targets: DataFrame, **how) -> DataFrame:
    """(source, target_share, n_documents, available_tokens, used_tokens, actual_share, max_uses) of listed and present sources."""
    uses = mixture(documents, targets, **how).groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("tokens").alias("available_tokens"), F.sum(F.col("tokens") * F.col("uses")).alias("used_tokens"), F.max("uses").alias("max_uses"))
    want = targets.select(source_key(F.col("source")).alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("t")).groupBy("source").agg(F.sum("t").alias("target_share"))
    total = uses.agg(F.greatest(F.sum("used_tokens"), F.lit(1))).scalar()
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_documents", "available_tokens", "used_tokens", "max_uses")]
    joined = want.withColumnRenamed("source", "s").join(uses, F.col("s").eqNullSafe(F.col("source")), "full")
    out = joined.select(F.coalesce("s", "source").alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), *zero)
    return out.withColumn("actual_share", F.col("used_tokens") / total)
