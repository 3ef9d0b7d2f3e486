"""References to records that are missing, deleted or that arrive later."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.operators.skew import salted_join


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def name_key(c: Column) -> Column:
    """A name as it is compared: lower case, _ and - as blanks, white space collapsed."""
    return _strip(F.regexp_replace(F.regexp_replace(F.lower(c), "[_-]", " "), r"\s+", " "))


def orphan_references(refs: DataFrame, targets: DataFrame, keys: list[str], match: str = "simple", ref_time: str | None = None, target_time: str | None = None, spread: str | None = None) -> DataFrame:
    """Rows of refs whose composite key has no target, by the declared match semantics of SQL.

    refs are grouped by the null mask of ``keys``; each mask is anti-joined on its non-null
    columns only. ``simple``: a reference with any null is no case. ``full``: all null is no
    case, some null always is. ``partial``: all null is no case, otherwise the non-null
    columns must occur together in a target. With ``ref_time`` and ``target_time`` a target
    counts only if its time is not after the reference's (a null time never counts).
    Targets are first reduced to one row per key (earliest time), so repeated targets cannot
    multiply work, and hot reference keys are salted. refs keep all their columns, repeated
    rows included; targets' other columns never reach the output. Empty refs give no rows,
    empty targets make every complete reference a case.
    """
    if match not in ("simple", "partial", "full"):
        raise ValueError(match)
    kept = refs.columns
    mask = reduce(lambda x, y: x + y, (F.when(F.col(k).isNull(), 1 << i).otherwise(0) for i, k in enumerate(keys)))
    masked = refs.withColumn("__mask", mask)
    parts = []
    for m in range((1 << len(keys)) - 1):
        present = [k for i, k in enumerate(keys) if not m >> i & 1]
        if m and match == "simple":
            continue
        part = masked.filter(F.col("__mask") == m)
        if m and match == "full":
            parts.append(part.select(*kept))
            continue
        known = targets.select(*present, *([F.col(target_time).alias("__since")] if target_time else [])).dropna(subset=present)
        known = known.groupBy(*present).agg(F.min("__since").alias("__since")) if target_time else known.distinct()
        extra = F.col("__since") <= F.col(ref_time) if target_time else None
        joined = salted_join(part, known, present, "left_anti", F.struct(*([spread] if spread else kept)), extra=extra)
        parts.append(joined.select(*kept))
    return reduce(DataFrame.unionByName, parts)


def evidence_references(insights: DataFrame, links: DataFrame) -> DataFrame:
    """(ref_table, record_id, target_kind, ref_key, at): every non-blank reference of the two tables, distinct."""
    chunks = insights.select(F.lit("insight_nodes").alias("ref_table"), F.col("insight_id").alias("record_id"), F.lit("chunk").alias("target_kind"), F.explode("evidence_chunk_ids").alias("raw"), F.col("loaded_at").alias("at"))
    chunks = chunks.withColumn("ref_key", _strip(F.lower("raw")))
    names = links.select(F.lit("link_requests").alias("ref_table"), F.col("link_id").alias("record_id"), F.col("target_label").alias("target_kind"), F.col("match_text").alias("raw"), F.col("loaded_at").alias("at"))
    names = names.withColumn("ref_key", name_key(F.col("raw"))).withColumn("target_kind", F.coalesce("target_kind", F.lit("")))
    both = chunks.unionByName(names).drop("raw")
    return both.withColumn("ref_key", F.when(F.col("ref_key") != "", F.col("ref_key"))).filter("ref_key is not null").distinct()


def evidence_targets(chunks: DataFrame, topologies: DataFrame, parameters: DataFrame) -> DataFrame:
    """(target_kind, ref_key, since): what can be referred to, and from when on.

    A chunk counts if its latest row is not retracted (two latest rows: one retraction
    suffices to withdraw it), from its earliest row on; of the other tables each row that is
    not retracted counts by every name it bears.
    """
    c = chunks.select(_strip(F.lower("chunk_id")).alias("ref_key"), "loaded_at", F.coalesce("retracted", F.lit(False)).alias("gone"))
    c = c.groupBy("ref_key").agg(F.min("loaded_at").alias("since"), F.max(F.struct("loaded_at", "gone")).alias("last")).filter("not last.gone")
    c = c.select(F.lit("chunk").alias("target_kind"), "ref_key", "since")
    live = "not coalesce(retracted, false)"
    t = topologies.filter(live).select(F.lit("CircuitTopology").alias("target_kind"), F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("raw"), "loaded_at")
    p = parameters.filter(live).select(F.lit("Parameter").alias("target_kind"), F.explode(F.array("name", "symbol")).alias("raw"), "loaded_at")
    n = t.unionByName(p).select("target_kind", name_key(F.col("raw")).alias("ref_key"), F.col("loaded_at").alias("since"))
    return c.unionByName(n.filter("ref_key <> ''"))


def orphan_evidence(insights: DataFrame, links: DataFrame, chunks: DataFrame, topologies: DataFrame, parameters: DataFrame) -> DataFrame:
    """(ref_table, record_id, ref_key, ref_period): the distinct dangling references; a null time gives a null period."""
    refs = evidence_references(insights, links)
    targets = evidence_targets(chunks, topologies, parameters)
    found = orphan_references(refs, targets, ["target_kind", "ref_key"], "simple", "at", "since", "record_id")
    return found.select("ref_table", "record_id", "ref_key", F.date_format("at", "yyyy-MM").alias("ref_period")).distinct()


def orphan_report(insights: DataFrame, links: DataFrame, chunks: DataFrame, topologies: DataFrame, parameters: DataFrame) -> DataFrame:
    """(ref_table, ref_period, n_references, n_orphans) of distinct references per table and month."""
    period = F.date_format("at", "yyyy-MM").alias("ref_period")
    refs = evidence_references(insights, links).select("ref_table", "record_id", "ref_key", period).distinct().groupBy("ref_table", "ref_period").agg(F.count(F.lit(1)).alias("n_references"))
    lost = orphan_evidence(insights, links, chunks, topologies, parameters).groupBy("ref_table", "ref_period").agg(F.count(F.lit(1)).alias("n_orphans"))
    on = refs["ref_table"].eqNullSafe(lost["ref_table"]) & refs["ref_period"].eqNullSafe(lost["ref_period"])
    return refs.join(lost, on, "left").select(refs["ref_table"], refs["ref_period"], "n_references", F.coalesce("n_orphans", F.lit(0)).alias("n_orphans"))


def composite_references(insights: DataFrame, links: DataFrame) -> DataFrame:
    """(ref_table, record_id, target_kind, ref_key, source_id) of the two tables, distinct, with whatever is null or blank as null.

    An insight refers to a chunk of a source, a link to a name of a kind; a link names no source."""
    blank = lambda c: F.when(c != "", c)
    c = insights.select(F.lit("insight_nodes").alias("ref_table"), F.col("insight_id").alias("record_id"), F.lit("chunk").alias("target_kind"), F.explode("evidence_chunk_ids").alias("raw"), F.col("source_id"))
    c = c.withColumn("ref_key", blank(_strip(F.lower("raw")))).withColumn("source_id", blank(F.trim("source_id")))
    n = links.select(F.lit("link_requests").alias("ref_table"), F.col("link_id").alias("record_id"), blank(F.trim("target_label")).alias("target_kind"), blank(name_key(F.col("match_text"))).alias("ref_key"), F.lit(None).cast("string").alias("source_id"))
    return c.drop("raw").unionByName(n).distinct()


def composite_targets(chunks: DataFrame, topologies: DataFrame, parameters: DataFrame) -> DataFrame:
    """(target_kind, ref_key, source_id): chunks with their sources, names of topologies and parameters without."""
    c = chunks.select(F.lit("chunk").alias("target_kind"), _strip(F.lower("chunk_id")).alias("ref_key"), F.when(F.trim("source_id") != "", F.trim("source_id")).alias("source_id"))
    t = topologies.select(F.lit("CircuitTopology").alias("target_kind"), name_key(F.col("name")).alias("ref_key"))
    p = parameters.select(F.lit("Parameter").alias("target_kind"), F.explode(F.array("name", "symbol")).alias("raw")).select("target_kind", name_key(F.col("raw")).alias("ref_key"))
    return c.unionByName(t.unionByName(p).withColumn("source_id", F.lit(None).cast("string")))


def composite_orphans(insights: DataFrame, links: DataFrame, chunks: DataFrame, topologies: DataFrame, parameters: DataFrame, match: str) -> DataFrame:
    """(ref_table, record_id, target_kind, ref_key, source_id): references over three columns, any of them null, that ``match`` leaves dangling."""
    return orphan_references(composite_references(insights, links), composite_targets(chunks, topologies, parameters), ["target_kind", "ref_key", "source_id"], match, spread="record_id")
