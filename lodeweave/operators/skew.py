"""Joins that survive a key holding a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARE = 1 / 64
SALTS = 64


def hot_keys(df: DataFrame, keys: list[str], share: float = SHARE) -> DataFrame:
    """Keys that hold more than ``share`` of df's rows: at most ``1/share`` rows, whatever df's size."""
    total = df.agg(F.count(F.lit(1))).scalar()
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return counted.filter(F.col("__n") > total * F.lit(share)).select(*keys)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str, spread: Column, share: float = SHARE, salts: int = SALTS, extra: Column | None = None) -> DataFrame:
    """Equi-join on keys with left's hot keys spread over ``salts`` tasks; right's rows of those keys are repeated.

    ``spread`` is hashed to choose a left row's salt. The list of hot keys is bounded by
    ``1/share`` rows, so it alone is broadcast. ``how`` is inner, left, left_anti or left_semi;
    ``extra`` is a further condition on both sides' columns. Rows with a null key match nothing.
    """
    hot = F.broadcast(hot_keys(left, keys, share).withColumn("__hot", F.lit(True)))
    l = left.join(hot, keys, "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(F.lit(0)).cast("int")).select(*left.columns, "__salt")
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    r = right.join(hot, keys, "left").withColumn("__salt", F.explode(F.when(F.col("__hot"), every).otherwise(F.array(F.lit(0))))).drop("__hot")
    r = r.select(*(F.col(c).alias(f"__r_{c}") if c in keys or c == "__salt" else F.col(c) for c in r.columns))
    on = F.col("__salt") == F.col("__r___salt")
    for k in keys:
        on = on & (F.col(k) == F.col(f"__r_{k}"))
    out = l.join(r, on if extra is None else on & extra, how)
    return out.drop("__salt", "__r___salt", *(f"__r_{k}" for k in keys))


SLOTS = 1 << 18  # hashes, so that a table of them may be broadcast


def maybe_in(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key may be among those of ``wanted``, by a hash of ``SLOTS`` values: all that are, and a few others.

    It makes df smaller before a join on the key shuffles it; the join decides."""
    slot = F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int").alias("slot")
    return df.withColumn("slot", slot).join(F.broadcast(wanted.select(slot).distinct()), "slot", "left_semi").drop("slot")
