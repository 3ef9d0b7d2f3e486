"""Memory, skill and learner queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeweave.operators import memory as M
from lodeweave.sources.views import AS_OF, view, with_views

D = f"timestamp '{AS_OF}'"
_HOT = "sess_hot"


def m(s, d):
    """The latest row of each memory."""
    return view(s, d, "memories")


def _hot(s, d):
    """The session with the most rows."""
    return m(s, d).filter("trim(session_id) <> ''").groupBy("session_id").count().orderBy(F.desc("count"), "session_id").first()["session_id"]


_HOTSQL = "(select session_id from memories where trim(session_id) <> '' group by 1 order by count(*) desc, 1 limit 1)"
_TAGS = "(coalesce(tags, []) && ['lesson','important','session_summary','insight'])"
_ORDER = "order by last_accessed desc nulls last, memory_id"
_SEARCH = "(coalesce(contains(lower(content), 'phase margin'), false) or coalesce(contains(lower(summary), 'phase margin'), false))"
_PROMO = f"""
, a as (select *, row_number() over (partition by layer {_ORDER}) r from memories where tier = 'raw'),
up as (select memory_id from a where r <= 100 and (coalesce(access_count, 0) >= 2 or {_TAGS})),
t as (select m.*, case when u.memory_id is not null then 'retain' else tier end t1 from memories m left join up u using (memory_id)),
b as (select *, row_number() over (partition by layer {_ORDER}) r from t where t1 = 'retain' and layer in ('episodic','semantic')),
top as (select memory_id from b where r <= 100 and (coalesce(access_count, 0) >= 5 or coalesce(confidence, 0) >= 0.9)),
f as (select memory_id, tier old_tier, case when p.memory_id is not null then 'curated' when t1 = 'raw' and created_at < {D} - interval 90 day then 'expired' else t1 end new_tier from t left join top p using (memory_id)),
moved as (select * from f where new_tier <> old_tier)"""
_ROLL = """
, g as (select learner_id, target_id, count(*) n, max(assessed_at) last_assessed, arg_max(verdict, (assessed_at, seq)) verdict from assessments group by 1, 2),
roll as (select *, case verdict when 'understood' then 0.9e0 when 'misconception' then 0.15e0 else 0.5e0 end confidence from g)"""
_SKILLS = """(select skill_name, array['run', 'trim'] keywords, 'pur.*ase' pattern, 0.5e0 confidence, 0.4e0 history from (select distinct skill_name from skill_runs))"""


def _calls(s, d):
    return view(s, d, "skill_runs").select("skill_name", "executed_at", "run_id", (~F.col("success")).alias("failed"))


Q = {
    "memory_tagged": (lambda s, d: M.tagged(m(s, d), ["lesson", "insight"]).select("memory_id"), "select memory_id from memories where coalesce(tags, []) && ['lesson', 'insight']"),
    "memory_recent": (lambda s, d: M.recent(m(s, d), AS_OF, 24 * 60).select("memory_id", "created_at"), f"select memory_id, created_at from memories where created_at > {D} - interval 1440 hour and created_at <= {D}"),
    "memory_matching": (lambda s, d: M.matching(m(s, d), layer="semantic", tier=None, session_id=None).select("memory_id", "tier"), "select memory_id, tier from memories where layer = 'semantic'"),
    "memory_listing": (lambda s, d: M.listing(m(s, d), "episodic", "raw").select("memory_id", "last_accessed"), f"select memory_id, last_accessed from memories where layer = 'episodic' and tier = 'raw' {_ORDER} limit 20"),
    "memory_content_search": (lambda s, d: M.content_search(m(s, d), "Phase margin").select("memory_id"), f"select memory_id from memories where {_SEARCH} {_ORDER} limit 20"),
    "memory_session": (lambda s, d: M.session_memories(m(s, d), _hot(s, d)).select("memory_id", "created_at"), f"select memory_id, created_at from memories where session_id = {_HOTSQL} order by created_at desc nulls last, memory_id limit 10"),
    "memory_retrieve": (lambda s, d: M.retrieve(m(s, d), "phase margin", _hot(s, d), 25), f"""
        , u as (select memory_id, 1.0e0 score, 'core memory' reason, 0 p, row_number() over ({_ORDER}) pos from (select * from memories where layer = 'semantic' and tier = 'core' {_ORDER} limit 10)
        union all select memory_id, 0.8e0 * case tier when 'core' then 1.0e0 when 'curated' then 0.8e0 when 'retain' then 0.5e0 else 0.2e0 end, 'content match', 1, row_number() over ({_ORDER}) from (select * from memories where {_SEARCH} {_ORDER} limit 50)
        union all select memory_id, 0.6e0, 'session context', 2, row_number() over (order by created_at desc nulls last, memory_id) from (select * from memories where session_id = {_HOTSQL} order by created_at desc nulls last, memory_id limit 10)
        union all select memory_id, 0.48e0, 'curated memory', 3, row_number() over ({_ORDER}) from (select * from memories where layer = 'semantic' and tier = 'curated' {_ORDER} limit 5)
        union all select memory_id, 0.48e0, 'curated memory', 4, row_number() over ({_ORDER}) from (select * from memories where layer = 'procedural' and tier = 'curated' {_ORDER} limit 5)),
        f as (select *, row_number() over (partition by memory_id order by p, pos) r from u)
        select memory_id, round(score, 6) score, reason from f where r = 1 order by score desc, p, pos limit 25"""),
    "memory_access_bump": (lambda s, d: M.access_bump(m(s, d), M.content_search(m(s, d), "Phase margin"), AS_OF), f"""
        , h as (select memory_id from memories where {_SEARCH} {_ORDER} limit 20)
        select memory_id, coalesce(access_count, 0) + (memory_id in (select memory_id from h))::int access_count, case when memory_id in (select memory_id from h) then {D} else last_accessed end last_accessed from memories"""),
    "memory_stats": (lambda s, d: M.stats(m(s, d)), "select layer, tier, count(*) n from memories group by grouping sets ((), (layer), (tier))"),
    "memory_promotions": (lambda s, d: M.promotions(m(s, d), AS_OF), _PROMO + " select * from moved"),
    "memory_promotion_history": (lambda s, d: M.promotion_history(M.promotions(m(s, d), AS_OF), AS_OF), _PROMO + f" select memory_id, [new_tier || '@{AS_OF}'] history from moved"),
    "memory_injection_text": (lambda s, d: M.injection_text(m(s, d)), f"""
        , t as (select *, case when tier = 'core' then 'core' when layer = 'semantic' then 'knowledge' when layer = 'procedural' then 'skills' else 'session' end section from memories where content is not null and length(content) > 0),
        r as (select *, row_number() over (partition by section {_ORDER}) r from t)
        select section, substr(string_agg('- ' || content, chr(10) order by r), 1, 1600) as text from r group by 1"""),
    "memory_by_tag": (lambda s, d: M.entity_memories(m(s, d)), "select lower(trim(t)) tag, count(distinct memory_id) n, max(last_accessed) latest from (select memory_id, last_accessed, unnest(tags) t from memories) where trim(t) <> '' group by 1"),
    "memory_lessons": (lambda s, d: M.tagged(m(s, d).filter("layer = 'semantic'"), ["lesson"]).orderBy(F.desc_nulls_last("created_at"), "memory_id").limit(15).select("memory_id"), "select memory_id from memories where layer = 'semantic' and coalesce(tags, []) && ['lesson'] order by created_at desc nulls last, memory_id limit 15"),
    "memory_sessions": (lambda s, d: M.sessions(m(s, d)), "select session_id, min(created_at) started_at, max(created_at) ended_at, count(*) event_count from memories where trim(session_id) <> '' group by 1"),
    "memory_half_life": (lambda s, d: m(s, d).select("memory_id", F.round(M.half_life(m(s, d), AS_OF, "created_at"), 6).alias("confidence")), f"""
        select memory_id, round(case when date_diff('day', cast(created_at as date), date '2026-06-01') > 0 then 0.05e0 + (confidence - 0.05e0) * exp(-ln(2e0) * date_diff('day', cast(created_at as date), date '2026-06-01') / 30e0) else confidence end, 6) confidence from memories"""),
    "learner_rollup": (lambda s, d: M.assessment_rollup(view(s, d, "assessments")), _ROLL + " select * from roll"),
    "learner_state": (lambda s, d: M.learner_state(M.assessment_rollup(view(s, d, "assessments")), "2024-02-01 00:00:00"), _ROLL + """
        select learner_id, target_id, verdict, n, row_number() over (partition by learner_id order by last_assessed desc, target_id) as rank,
               round(case when dd > 0 then 0.05e0 + (confidence - 0.05e0) * exp(-ln(2e0) * dd / 30e0) else confidence end, 6) confidence
        from (select *, date_diff('day', cast(last_assessed as date), date '2024-02-01') dd from roll)"""),
    "skill_stats": (lambda s, d: M.skill_stats(view(s, d, "skill_runs")), """
        , e as (select skill_name, string_agg(error, ';' order by executed_at, run_id) errors from (select *, row_number() over (partition by skill_name order by executed_at, run_id) r from skill_runs where not success and error is not null) where r <= 5 group by 1)
        select g.*, errors from (select skill_name, count(*) total, count(*) filter (where success) successes, round(avg(duration_seconds), 6) avg_duration, round(count(*) filter (where success) / count(*), 6) success_rate from skill_runs group by 1) g left join e using (skill_name)"""),
    "skill_confidence": (lambda s, d: M.skill_confidence(M.skill_stats(view(s, d, "skill_runs"))), "select skill_name, round(greatest(0.1e0, least(1e0, 0.3e0 * round(count(*) filter (where success) / count(*), 6) + 0.35e0)), 6) confidence from skill_runs group by 1"),
    "skill_ema": (lambda s, d: M.skill_ema(view(s, d, "skill_runs")), """
        , l as (select skill_name, list(success::int::double order by executed_at, run_id) v from skill_runs group by 1)
        select skill_name, round(list_reduce(list_prepend(0.5e0, v), lambda a, x: greatest(0.1e0, least(1e0, 0.3e0 * x + 0.7e0 * a))), 6) ema from l"""),
    "skill_recent_runs": (lambda s, d: M.recent_runs(view(s, d, "skill_runs"), "purchase").select("run_id", "executed_at"), "select run_id, executed_at from skill_runs where skill_name = 'purchase' order by executed_at desc, run_id desc limit 10"),
    "skill_route": (lambda s, d: M.route(view(s, d, "skill_runs").select("skill_name").distinct().select("skill_name", F.array(F.lit("run"), F.lit("trim")).alias("keywords"), F.lit("pur.*ase").alias("pattern"), F.lit(0.5).alias("confidence"), F.lit(0.4).alias("history")), "Please check the purchase click"), f"""
        select skill_name, round(0.3e0 * (contains('please check the purchase click', lower(skill_name)))::int + 0.3e0 * regexp_matches('please check the purchase click', pattern)::int + 0.1e0 + 0.08e0, 6) score from {_SKILLS} x
        where round(0.3e0 * (contains('please check the purchase click', lower(skill_name)))::int + 0.3e0 * regexp_matches('please check the purchase click', pattern)::int + 0.1e0 + 0.08e0, 6) >= 0.2"""),
    "call_breaker": (lambda s, d: M.breaker(_calls(s, d), "skill_name", ["executed_at", "run_id"], "failed"), """
        , g as (select skill_name, executed_at, run_id, not success f, sum(success::int) over (partition by skill_name order by executed_at, run_id rows unbounded preceding) g from skill_runs),
        h as (select skill_name, executed_at, run_id, sum(f::int) over (partition by skill_name, g order by executed_at, run_id rows unbounded preceding) streak from g)
        select *, streak >= 3 as open from h"""),
    "call_timed_breaker": (lambda s, d: M.timed_breaker(_calls(s, d), "skill_name", "executed_at", "run_id", "failed", 2, 3600.0), None),
    "call_backoff": (lambda s, d: M.backoff(s.range(0, 12).select(F.col("id").alias("attempt"))), "select range attempt, least(30e0, 0.5e0 * pow(2e0, range)) delay from range(0, 12)"),
    "ingest_confidence": (lambda s, d: M.ingest_confidence(view(s, d, "insights").filter("confidence is not null").select("insight_id", "confidence", (F.col("bridge_type") == "within-domain").alias("matched"), F.coalesce("reviewed", F.lit(False)).alias("widened"))).select("insight_id", F.round("confidence", 3).alias("confidence")), """
        select insight_id, round(round(round(confidence * case when bridge_type = 'within-domain' then 1e0 else 0.78e0 end, 4) * case when coalesce(reviewed, false) then 0.8e0 else 1e0 end, 4), 3) confidence from insights where confidence is not null"""),
}


def queries() -> dict:
    """Query name -> (spark, sf_dir) -> DataFrame."""
    return {k: f for k, (f, _) in Q.items()}


def oracle_sql() -> dict[str, str]:
    """The same in DuckDB's SQL."""
    return {k: with_views("with " + q.strip()[2:] if q.strip().startswith(", ") else q) for k, (_, q) in Q.items() if q}
