"""Tiered memories: retrieval, promotion, decay, skills, sessions and learners.

All times are compared with a given ``as_of``; nothing reads a clock. Nulls in tags,
confidence or counts act as empty, missing or zero as each docstring states.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TIER_WEIGHT = {"core": 1.0, "curated": 0.8, "retain": 0.5, "raw": 0.2}
PROMOTING_TAGS = ("lesson", "important", "session_summary", "insight")
VERDICT_CONFIDENCE = {"understood": 0.9, "misconception": 0.15}


def _ts(as_of: str) -> str:
    return f"timestamp_ntz '{as_of}'"


def tagged(memories: DataFrame, tags: list[str]) -> DataFrame:
    """Memories with any of the tags; null tags have none."""
    return memories.filter(F.coalesce(F.arrays_overlap(F.filter("tags", lambda t: t.isNotNull()), F.array(*map(F.lit, tags))), F.lit(False)))


def recent(memories: DataFrame, as_of: str, hours: int) -> DataFrame:
    """Memories created in the last ``hours`` before as_of."""
    return memories.filter(F.expr(f"created_at > {_ts(as_of)} - interval {hours} hours and created_at <= {_ts(as_of)}"))


def matching(rows: DataFrame, **values) -> DataFrame:
    """Filter by each given column; a None value filters nothing."""
    for k, v in values.items():
        if v is not None:
            rows = rows.filter(F.col(k) == v)
    return rows


def listing(memories: DataFrame, layer: str | None = None, tier: str | None = None, limit: int = 20) -> DataFrame:
    """Latest accessed first, then by id."""
    return matching(memories, layer=layer, tier=tier).orderBy(F.desc_nulls_last("last_accessed"), "memory_id").limit(limit)


def content_search(memories: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Content or summary holds the query, whatever the case; latest accessed first."""
    q = query.lower()
    hit = F.coalesce(F.lower("content").contains(q), F.lit(False)) | F.coalesce(F.lower("summary").contains(q), F.lit(False))
    return memories.filter(hit).orderBy(F.desc_nulls_last("last_accessed"), "memory_id").limit(limit)


def session_memories(memories: DataFrame, session_id: str, limit: int = 10) -> DataFrame:
    """A session's memories in order of creation."""
    return memories.filter(F.col("session_id") == session_id).orderBy(F.desc_nulls_last("created_at"), "memory_id").limit(limit)


def retrieve(memories: DataFrame, query: str, session_id: str | None = None, max_results: int = 10) -> DataFrame:
    """(memory_id, score, reason): core semantic memories, content matches, the session, curated ones; each memory for its first reason.

    Scores: 1.0; 0.8 of the tier's weight; 0.6; 0.48. Ordered by score, then by the order in
    which the reasons were tried and their own order. Each branch is limited before the union,
    so the windows see a few dozen rows whatever the table.
    """
    weight = F.lit(0.2)
    for t, w in TIER_WEIGHT.items():
        weight = F.when(F.col("tier") == t, w).otherwise(weight)
    late = [F.desc_nulls_last("last_accessed"), F.col("memory_id")]
    parts = [
        (listing(memories, "semantic", "core", 10), F.lit(1.0), "core memory", late),
        (content_search(memories, query, 2 * max_results), weight * 0.8, "content match", late),
    ]
    if session_id is not None:
        parts.append((session_memories(memories, session_id, 10), F.lit(0.6), "session context", [F.desc_nulls_last("created_at"), F.col("memory_id")]))
    for layer in ("semantic", "procedural"):
        parts.append((listing(memories, layer, "curated", 5), F.lit(TIER_WEIGHT["curated"] * 0.6), "curated memory", late))
    union = None
    for i, (df, score, reason, order) in enumerate(parts):
        row = df.select("memory_id", score.alias("score"), F.lit(reason).alias("reason"), F.lit(i).alias("priority"), F.row_number().over(Window.orderBy(*order)).alias("pos"))
        union = row if union is None else union.unionByName(row)
    first = union.withColumn("r", F.row_number().over(Window.partitionBy("memory_id").orderBy("priority", "pos"))).filter("r = 1")
    return first.orderBy(F.desc("score"), "priority", "pos").limit(max_results).select("memory_id", F.round("score", 6).alias("score"), "reason")


def access_bump(memories: DataFrame, accessed: DataFrame, as_of: str) -> DataFrame:
    """(memory_id, access_count, last_accessed) with one access more for those accessed; a null count is 0."""
    a = accessed.select("memory_id").distinct().withColumn("hit", F.lit(True))
    joined = memories.join(a, "memory_id", "left")
    return joined.select("memory_id", (F.coalesce("access_count", F.lit(0)) + F.when(F.col("hit"), 1).otherwise(0)).alias("access_count"), F.when(F.col("hit"), F.expr(_ts(as_of))).otherwise(F.col("last_accessed")).alias("last_accessed"))


def stats(memories: DataFrame) -> DataFrame:
    """(layer, tier, n) by grouping sets: in all, per layer and per tier (nulls in the other columns)."""
    return memories.groupingSets([[], [F.col("layer")], [F.col("tier")]], "layer", "tier").agg(F.count(F.lit(1)).alias("n")).select("layer", "tier", "n")


def promotions(memories: DataFrame, as_of: str, per_layer: int = 100, retention_days: int = 90) -> DataFrame:
    """(memory_id, old_tier, new_tier): one cycle. raw rises to retain (2 accesses or a telling tag), retain of
    episodic and semantic to curated (5 accesses or confidence 0.9), the first step before the second; then raw
    older than the retention expires (new_tier 'expired'). At most ``per_layer`` latest accessed memories of a
    layer and tier are considered in each step; the window is cut by WindowGroupLimit before its shuffle."""
    access, conf = F.coalesce("access_count", F.lit(0)), F.coalesce("confidence", F.lit(0.0))
    telling = F.coalesce(F.arrays_overlap(F.filter("tags", lambda t: t.isNotNull()), F.array(*map(F.lit, PROMOTING_TAGS))), F.lit(False))
    order = Window.partitionBy("layer", "t1").orderBy(F.desc_nulls_last("last_accessed"), "memory_id")
    one = memories.withColumn("t1", F.col("tier"))
    considered = one.filter(F.col("tier") == "raw").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= per_layer)
    up = considered.filter((access >= 2) | telling).select("memory_id", F.lit("retain").alias("new1"))
    two = memories.join(up, "memory_id", "left").withColumn("t1", F.coalesce("new1", "tier"))
    second = two.filter((F.col("t1") == "retain") & F.col("layer").isin("episodic", "semantic")).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= per_layer)
    top = second.filter((access >= 5) | (conf >= 0.9)).select("memory_id", F.lit("curated").alias("new2"))
    three = two.join(top, "memory_id", "left").withColumn("t2", F.coalesce("new2", "t1"))
    gone = (F.col("t2") == "raw") & F.expr(f"created_at < {_ts(as_of)} - interval {retention_days} days")
    return three.withColumn("new_tier", F.when(gone, "expired").otherwise(F.col("t2"))).filter(F.col("new_tier") != F.col("tier")).select("memory_id", F.col("tier").alias("old_tier"), "new_tier")


def promotion_history(promoted: DataFrame, as_of: str) -> DataFrame:
    """(memory_id, history): 'tier@time' of each step as an array."""
    return promoted.groupBy("memory_id").agg(F.array_sort(F.collect_list(F.concat("new_tier", F.lit("@" + as_of)))).alias("history"))


def injection_text(memories: DataFrame, budget: int = 400) -> DataFrame:
    """(section, text): four sections by tier and layer, latest first, each cut at four characters a token.
"""
    from lodeweave.operators.text import leading_text

    section = F.when(F.col("tier") == "core", "core").when(F.col("layer") == "semantic", "knowledge").when(F.col("layer") == "procedural", "skills").otherwise("session")
    rows = memories.filter("content is not null and length(content) > 0").withColumn("section", section)
    return leading_text(rows, "section", [F.desc_nulls_last("last_accessed"), F.col("memory_id")], F.concat(F.lit("- "), "content"), 4 * budget)


def entity_memories(memories: DataFrame) -> DataFrame:
    """(tag, n, latest): memories per normalised tag, blank tags dropped."""
    t = memories.select("memory_id", "last_accessed", F.explode("tags").alias("raw")).withColumn("tag", F.lower(F.trim("raw"))).filter("tag <> ''")
    return t.groupBy("tag").agg(F.count_distinct("memory_id").alias("n"), F.max("last_accessed").alias("latest"))


def half_life(items: DataFrame, as_of: str, at: str, half_life_days: float = 30, floor: float = 0.05) -> Column:
    """floor + (c - floor) * 2^(-days / half-life) for whole days since ``at``; unchanged if none passed."""
    days = F.datediff(F.expr(_ts(as_of)), F.col(at))
    return F.when(days > 0, F.lit(floor) + (F.col("confidence") - floor) * F.exp(-F.log(F.lit(2.0)) * days / half_life_days)).otherwise(F.col("confidence"))


def assessment_rollup(assessments: DataFrame) -> DataFrame:
    """(learner_id, target_id, verdict, confidence, n): the latest verdict and how often a target was assessed."""
    g = assessments.groupBy("learner_id", "target_id").agg(F.max_by("verdict", F.struct("assessed_at", "seq")).alias("verdict"), F.count(F.lit(1)).alias("n"), F.max("assessed_at").alias("last_assessed"))
    conf = F.lit(0.5)
    for v, c in VERDICT_CONFIDENCE.items():
        conf = F.when(F.col("verdict") == v, c).otherwise(conf)
    return g.withColumn("confidence", conf)


def learner_state(rollup: DataFrame, as_of: str, learner_id: str | None = None) -> DataFrame:
    """The learner's targets, confidence decayed to as_of, latest assessed first by rank."""
    d = matching(rollup, learner_id=learner_id).withColumn("confidence", F.round(half_life(rollup, as_of, "last_assessed"), 6))
    w = Window.partitionBy("learner_id").orderBy(F.desc("last_assessed"), "target_id")
    return d.withColumn("rank", F.row_number().over(w)).select("learner_id", "target_id", "verdict", "confidence", "n", "rank")


def skill_stats(runs: DataFrame) -> DataFrame:
    """(skill_name, total, successes, success_rate, avg_duration, errors): errors are the first five of failures by time."""
    w = Window.partitionBy("skill_name").orderBy("executed_at", "run_id")
    err = runs.filter("not success and error is not null").withColumn("r", F.row_number().over(w)).filter("r <= 5").groupBy("skill_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "error"))), lambda s: s["error"]), ";").alias("errors"))
    g = runs.groupBy("skill_name").agg(F.count(F.lit(1)).alias("total"), F.count_if("success").alias("successes"), F.round(F.avg("duration_seconds"), 6).alias("avg_duration"))
    return g.join(err, "skill_name", "left").withColumn("success_rate", F.round(F.col("successes") / F.col("total"), 6))


def skill_confidence(stats: DataFrame, prior: float = 0.5) -> DataFrame:
    """(skill_name, confidence): 0.3 success rate + 0.7 prior, between 0.1 and 1."""
    return stats.select("skill_name", F.round(F.greatest(F.lit(0.1), F.least(F.lit(1.0), 0.3 * F.col("success_rate") + 0.7 * prior)), 6).alias("confidence"))


def skill_ema(runs: DataFrame, alpha: float = 0.3, prior: float = 0.5, last: int = 100) -> DataFrame:
    """(skill_name, ema): the moving average folded over each skill's runs in order.

    A step shrinks what was before by 1 - alpha, clamped or not, so the runs before the last ``last`` change
    the result by less than (1 - alpha) ** last (3e-16 for 100), below the six places given; they are not
    folded, so that a skill with any number of runs is one short list."""
    w = Window.partitionBy("skill_name").orderBy(F.desc("executed_at"), F.desc("run_id"))
    top = runs.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= last)
    seq = top.groupBy("skill_name").agg(F.array_sort(F.collect_list(F.struct((-F.col("r")).alias("o"), F.col("success").cast("double").alias("v")))).alias("s"))
    fold = F.aggregate("s", F.lit(prior), lambda acc, x: F.greatest(F.lit(0.1), F.least(F.lit(1.0), alpha * x["v"] + (1 - alpha) * acc)))
    return seq.select("skill_name", F.round(fold, 6).alias("ema"))


def recent_runs(runs: DataFrame, skill: str, limit: int = 10) -> DataFrame:
    """A skill's latest runs."""
    return runs.filter(F.col("skill_name") == skill).orderBy(F.desc("executed_at"), F.desc("run_id")).limit(limit)


def route(skills: DataFrame, text: str, minimum: float = 0.2) -> DataFrame:
    """(skill_name, score): 0.3 keyword + 0.3 pattern + 0.2 confidence + 0.2 history, at least ``minimum``.

    skills has skill_name, keywords, pattern, confidence and history."""
    low = text.lower()
    kw = F.exists("keywords", lambda k: F.lit(low).contains(F.lower(k))) | F.lit(low).contains(F.lower("skill_name"))
    score = 0.3 * F.coalesce(kw, F.lit(False)).cast("double") + 0.3 * F.coalesce(F.regexp_like(F.lit(low), F.col("pattern")), F.lit(False)).cast("double") + 0.2 * F.coalesce("confidence", F.lit(0.0)) + 0.2 * F.coalesce("history", F.lit(0.0))
    return skills.select("skill_name", F.round(score, 6).alias("score")).filter(F.col("score") >= minimum)


def sessions(memories: DataFrame) -> DataFrame:
    """(session_id, started_at, ended_at, event_count, status): blank ids are none; over once ended."""
    s = memories.filter("trim(session_id) <> ''")
    return s.groupBy("session_id").agg(F.min("created_at").alias("started_at"), F.max("created_at").alias("ended_at"), F.count(F.lit(1)).alias("event_count"))


def breaker(calls: DataFrame, key: str, order: list[str], failed: str, threshold: int = 3) -> DataFrame:
    """(key, order..., streak, open): consecutive failures so far and whether the breaker is open after the call.

    A streak restarts after each success: its group is the number of successes before it."""
    w = Window.partitionBy(key).orderBy(*order)
    g = calls.withColumn("__g", F.sum((~F.col(failed)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = F.sum(F.col(failed).cast("int")).over(Window.partitionBy(key, "__g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return g.withColumn("streak", s).select(key, *order, "streak", (F.col("streak") >= threshold).alias("open"))


def timed_breaker(calls: DataFrame, key: str, at: str, order: str, failed: str, threshold: int = 3, reset_seconds: float = 120.0) -> DataFrame:
    """(key, order, allowed, state, streak) of each call in order of (at, order): after ``threshold`` failures in a row the breaker is open and
    refuses calls for ``reset_seconds``; the next one is a trial: its success closes the breaker, its failure opens it again.

    state is the one after the call. Refused calls change nothing. The rule is sequential per key, so a key's calls
    are read as a sorted stream with three numbers of state. A null key is a key, a null outcome a success."""
    import pyarrow as pa

    kinds = dict(calls.dtypes)
    rows = calls.select(F.col(key).alias("k"), F.col(order).alias("o"), F.unix_micros(F.col(at).cast("timestamp")).alias("t"), F.coalesce(F.col(failed), F.lit(False)).alias("f"))

    def run(batches):
        now, streak, opened = object(), 0, None
        for batch in batches:
            out = []
            for k, t, f in zip(*(batch.column(c).to_pylist() for c in ("k", "t", "f"))):
                if k != now:
                    now, streak, opened = k, 0, None
                if opened is not None and (t is None or t < opened + reset_seconds * 1e6):
                    out.append((False, "open", streak))
                    continue
                streak = streak + 1 if f else 0
                opened = t if f and (opened is not None or streak >= threshold) else None
                out.append((True, "open" if opened is not None else "closed", streak))
            cols = list(zip(*out)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("o"), pa.array(cols[0], pa.bool_()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], names=["k", "o", "allowed", "state", "streak"])

    done = rows.repartition("k").sortWithinPartitions("k", "t", "o").mapInArrow(run, f"k {kinds[key]}, o {kinds[order]}, allowed boolean, state string, streak long")
    return done.select(F.col("k").alias(key), F.col("o").alias(order), "allowed", "state", "streak")


def backoff(attempts: DataFrame, initial: float = 0.5, factor: float = 2.0, cap: float = 30.0) -> DataFrame:
    """(attempt, delay) without jitter."""
    return attempts.select("attempt", F.least(F.lit(cap), initial * F.pow(F.lit(factor), F.col("attempt"))).alias("delay"))


def ingest_confidence(items: DataFrame) -> DataFrame:
    """confidence x 0.78 if not matched, x 0.8 if its scope was widened, to 4 places."""
    c = F.col("confidence") * F.when(F.col("matched"), 1.0).otherwise(0.78)
    return items.withColumn("confidence", F.round(F.round(c, 4) * F.when(F.col("widened"), 0.8).otherwise(1.0), 4))
