"""Best representative of each group of records that hold the same content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIERS = ("raw", "retain", "curated", "core")  # rising trust


def words(c: Column) -> Column:
    """The runs of a-z and 0-9 after lower-casing."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def latest_rows(entries: DataFrame, columns: list[str]) -> DataFrame:
    """One row per memory_id: that with the latest last_accessed (null earliest); rows that tie are equal."""
    at = F.coalesce("last_accessed", F.lit("0001-01-01").cast(entries.schema["last_accessed"].dataType))
    picked = entries.filter("memory_id is not null").groupBy("memory_id").agg(F.max_by(F.struct(*columns), at).alias("r"))
    return picked.select("memory_id", *(F.col(f"r.{c}").alias(c) for c in columns))


def _best(column: str, priority: Column, at: Column) -> Column:
    """The value of the row that is non-null first, then of higher source priority, then later, then larger."""
    v = F.col(column)
    return F.max(F.struct(v.isNotNull().alias("known"), priority.alias("priority"), at.alias("at"), v.alias("value")))["value"].alias(column)


def survivors(entries: DataFrame, min_words: int = 8) -> DataFrame:
    """One row per group of two or more memory_ids with the same sequence of words.

    memory_id is the survivor: fewest nulls among confidence, access_count and created_at,
    then highest confidence, access_count, latest created_at (null below any value), smallest
    memory_id. The other columns build the golden record field by field: in the same single
    aggregation each attribute is the maximum of (non-null, tier as source priority,
    last_accessed, value), so every field may come from another copy. The group key is the
    SHA-256 of the words, hence a text of any length shuffles as 32 bytes, and the
    aggregation is combined before the shuffle, hence a group holding a third of all rows is
    reduced where it is read. Null, empty and short contents form no group; a NaN confidence
    counts as below any number; an empty table gives no rows.
    """
    fields = ["confidence", "access_count", "created_at", "summary", "session_id", "tags"]
    keyed = entries.withColumn("w", words(F.col("content"))).withColumn("group_key", F.when(F.size("w") >= min_words, F.unhex(F.sha2(F.array_join("w", " "), 256))))
    row = latest_rows(keyed, [*fields, "tier", "last_accessed", "group_key"]).filter("group_key is not null")
    conf = F.when(~F.isnan("confidence"), F.col("confidence"))
    nulls = sum(F.col(c).isNull().cast("int") for c in fields[:3])
    rank = F.struct(
        nulls.alias("nulls"),
        F.coalesce(-conf, F.lit(float("inf"))).alias("confidence"),
        F.coalesce(-F.col("access_count").cast("long"), F.lit(2**62)).alias("accesses"),
        F.coalesce(-F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(2**62)).alias("created"),
        F.col("memory_id"),
    )
    order = F.coalesce(F.array_position(F.array(*map(F.lit, TIERS)), F.lower("tier")), F.lit(0))
    filled = row.withColumn("session_id", F.when(F.trim("session_id") != "", F.col("session_id"))).withColumn("summary", F.when(F.trim("summary") != "", F.col("summary"))).withColumn("tags", F.when(F.size("tags") > 0, F.col("tags")))
    best = [_best(c, order, F.col("last_accessed")) for c in fields]
    out = filled.groupBy("group_key").agg(F.min(rank)["memory_id"].alias("memory_id"), F.count(F.lit(1)).alias("n_records"), *best)
    return out.filter("n_records > 1").select("memory_id", F.lower(F.hex("group_key")).alias("group_key"), "n_records", *fields)
