"""Audit, input/output and streaming queries, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodeweave.operators import audit as A
from lodeweave.operators import text as T
from lodeweave.plans.text import _answers
from lodeweave.session import ensure_checkpoint_dir
from lodeweave.sources import io as I
from lodeweave.sources.views import view, with_views
from lodeweave.streaming import events as S


# The words of these queries, made for the test tables; the SQL states them on its own.
WORDS = A.Wording(trust=("verif", "confirm", "agree"), negations=("not", "no", "without", "only", "nobody"), processes={"fast": "fast", "quick": "fast", "slow": "slow", "skewed": "skewed", "typical": "typical", "nominal": "typical", "cold": "cold", "hot": "hot"}, copulas=("stays", "is"), states=("tested", "checked"))


def _verdicts(s, d):
    n = F.ascii(F.substring("insight_id", -1, 1)) % 4
    return view(s, d, "insights").select("insight_id", F.element_at(F.array(*map(F.lit, ["SUPPORTED", "OVERGENERALIZED", "UNSUPPORTED", "NO_EVIDENCE"])), n + 1).alias("verdict"))


_VD = ", vd as (select insight_id, ['SUPPORTED','OVERGENERALIZED','UNSUPPORTED','NO_EVIDENCE'][ascii(right(insight_id, 1)) % 4 + 1] verdict from insights)"


def _cited(s, d):
    """Chunks as nodes: cards or sources."""
    k = F.ascii(F.substring("chunk_id", -1, 1)) % 3
    return view(s, d, "chunks").select(F.col("chunk_id").alias("node_id"), F.when(k == 0, "ClaimCard").when(k == 1, "Regularity").otherwise("SourceChunk").alias("label"), F.when(k == 0, F.when(F.col("chunk_id") < "chunk_8", "VERIFIED").otherwise("REFUTED")).alias("verdict"), F.when(k == 1, "law").alias("status"), F.when(F.col("chunk_id") < "chunk_4", F.array(F.lit("fast"))).when(F.col("chunk_id") < "chunk_8", F.array(F.lit("slow"), F.lit("fast"))).alias("scope"))


_CI = """, ai as (select insight_id doc_id, list_filter(evidence_chunk_ids, lambda x: x is not null) c from insights where len(evidence_chunk_ids) > 0 and statement is not null),
ct as (select doc_id, i - 1 pos, trim(c[i]) cited_id from (select doc_id, c, unnest(range(1, len(c) + 1)) i from ai) where trim(c[i]) <> ''),
nd as (select chunk_id node_id, case ascii(right(chunk_id, 1)) % 3 when 0 then case when chunk_id < 'chunk_8' then 'certified' else 'uncertified_card' end when 1 then 'certified_law' else 'associative' end tier, case when chunk_id < 'chunk_4' then ['fast'] when chunk_id < 'chunk_8' then ['slow', 'fast'] end scope from chunks),
ti as (select ct.*, coalesce(tier, 'unresolved') tier, scope from ct left join nd on node_id = cited_id)"""


_WORDS = r""", w as (select id, regexp_extract_all(lower(st), '[a-z0-9][a-z0-9_'']*') ws from (select memory_id id, unnest(regexp_split_to_array(coalesce(content, ''), '[.!?]\s')) st from memories))"""
_TRUST = r"""(select id, bool_or(len(list_filter(range(1, len(ws) + 1), lambda i: regexp_matches(ws[i], 'verif|confirm|agree') and not list_has_any(ws[greatest(1, i - 6):i - 1], ['not', 'no', 'without', 'only', 'nobody']))) > 0) trusts
  from (select id, regexp_extract_all(lower(st), '[a-z0-9][a-z0-9_'']*') ws from (select insight_id id, unnest(regexp_split_to_array(coalesce(statement, ''), '[.!?]\s')) st from insights)) group by 1)"""


def _claims(s, d):
    i = view(s, d, "insights").filter("size(evidence_chunk_ids) > 0")
    n = F.ascii(F.substring("insight_id", -1, 1))
    return i.select(F.col("insight_id").alias("claim_id"), F.when(n % 4 == 0, "interpretive").otherwise("certified").alias("tier"), F.trim(F.get("evidence_chunk_ids", F.lit(0))).alias("cites"), F.when(n % 3 == 0, "Gain always rises").when(n % 3 == 1, "Gain is 20 dB").otherwise("Gain rises because of bias").alias("text"))


def _cards(s, d):
    return _cited(s, d).select(F.col("node_id").alias("card_id"), F.coalesce("verdict", F.lit("VERIFIED")).alias("verdict"), F.when(F.col("node_id") < "chunk_5", "direction").otherwise("value").alias("quant_kind"), F.lit("gain").alias("metric"), F.when(F.col("node_id") > "chunk_c", "knock-out").alias("intervention"))


_LF = """, lc as (select insight_id claim_id, case when ascii(right(insight_id, 1)) % 4 = 0 then 'interpretive' else 'certified' end tier, trim(evidence_chunk_ids[1]) cites, ascii(right(insight_id, 1)) % 3 t from insights where len(evidence_chunk_ids) > 0),
cd as (select chunk_id card_id, case when ascii(right(chunk_id, 1)) % 3 = 0 and chunk_id >= 'chunk_8' then 'REFUTED' else 'VERIFIED' end verdict, chunk_id < 'chunk_5' shape, chunk_id > 'chunk_c' itv from chunks),
lf as (select claim_id, tier, case when tier = 'interpretive' then null when cites is null then 'no citation' when verdict is null then 'card not found' when verdict = 'REFUTED' then 'verdict not certified' when shape and t = 1 then 'magnitude on a shape'
  when t = 2 and not itv then 'causal without intervention' when t = 0 then 'over-generalised' end reason from lc left join cd on cites = card_id)"""


def _exported(s, d):
    return I.export_lines(view(s, d, "nodes"), view(s, d, "edges"))


_EX = ", ln as (select * from nodes where not coalesce(retracted, false) and label <> 'Session'), le as (select * from edges where src_id in (select node_id from ln) and dst_id in (select node_id from ln))"


def _runlines(s, d):
    line = F.when(F.col("event_id") % 5 == 0, "{broken").when(F.col("event_id") % 5 == 1, F.concat(F.lit('{"pdk": "p'), "user_id", F.lit('", "ok": true}'))).when(F.col("event_id") % 5 == 2, " ").otherwise(F.concat(F.lit('{"topology_class": "t", "pdk": "p'), "user_id", F.lit('", "ok": true, "verdicts": {"c1": "VERIFIED"}}')))
    return view(s, d, "events").select(F.lit("runs.jsonl").alias("path"), F.col("event_id").alias("n"), line.alias("line"))


def _queue(s, d):
    return view(s, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, "pending").otherwise("done").alias("status"))


def _spot(s, name):
    """A fresh folder for a stream's state and result beside the checkpoints."""
    ensure_checkpoint_dir(s)
    return s.sparkContext._jsc.sc().getCheckpointDir().get() + f"/{name}_{uuid.uuid4().hex[:8]}"


def _stream(s, d):
    batch = view(s, d, "events")
    return s.readStream.schema(batch.schema).parquet(f"{d}/even[t]s.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _run(s, d, name, f, mode):
    return S.run_available(f(_stream(s, d)), _spot(s, name), mode, "key")


Q = {
    "audit_verdict_summary": (lambda s, d: A.verdict_summary(_verdicts(s, d)), _VD + """
        , n as (select count(*) judged, count(*) filter (where verdict = 'SUPPORTED') s, count(*) filter (where verdict = 'OVERGENERALIZED') o, count(*) filter (where verdict = 'UNSUPPORTED') u, count(*) filter (where verdict = 'NO_EVIDENCE') e from vd)
        select judged, s + o + u with_evidence, round(s / (s + o + u), 6) as precision, round(o / (s + o + u), 6) over_rate, round(u / (s + o + u), 6) unsupported_rate, round(e / judged, 6) no_evidence_rate from n"""),
    "audit_verdict_shares": (lambda s, d: A.verdict_shares(_verdicts(s, d)), _VD + " select verdict, count(*) n, round(count(*) / sum(count(*)) over (), 6) share from vd group by 1"),
    "audit_citations": (lambda s, d: A.citations(T.paragraphs(_answers(s, d))), _CI + " select doc_id, 2 para, pos, 'cite' syntax, cited_id from ct"),
    "audit_answer_findings": (lambda s, d: A.answer_findings(_answers(s, d), _cited(s, d), WORDS), _CI + f"""
        , g as (select doc_id, count(*) filter (where tier in ('certified', 'certified_law')) sure, count(*) filter (where tier in ('associative', 'uncertified_card')) weak,
          flatten(list(scope) filter (where tier in ('certified', 'certified_law') and scope is not null)) allowed from ti group by 1),
        k as (select ai.doc_id, case when g.doc_id is null then 'bare_verified_claim' when weak > 0 and sure = 0 then 'tier_misrepresentation' when weak > 0 and sure > 0 then 'mixed_certified_paragraph' end kind from ai left join g on g.doc_id = ai.doc_id)
        select distinct doc_id, 2 para, 'unresolved_citation' kind, cited_id from ti where tier = 'unresolved' union all select doc_id, 2, kind, null from k where kind is not null
        union all select doc_id, 2, 'scope_overstatement', null from g where doc_id > 'insight_4' and allowed is not null and not (list_contains(allowed, 'fast') and list_contains(allowed, 'slow'))
        union all select id, 0, 'bare_verified_claim', null from {_TRUST.replace('STATEMENT', 'statement')} t where trusts and id in (select doc_id from ai)"""),
    "audit_lesson_findings": (lambda s, d: A.lesson_findings(_claims(s, d), _cards(s, d)), _LF + " select claim_id, tier, reason is null ok, reason from lf"),
    "audit_lesson_totals": (lambda s, d: A.lesson_totals(A.lesson_findings(_claims(s, d), _cards(s, d))), _LF + " select count(*) filter (where tier = 'certified') certified_total, count(*) filter (where tier = 'certified' and reason is null) certified_ok, count(*) filter (where tier = 'interpretive') interpretive_total, bool_and(reason is null) passed from lf"),
    "audit_process_keys": (lambda s, d: view(s, d, "insights").select("insight_id", A.process_key(F.regexp_extract("statement", r"(\w+) corner", 1), WORDS).alias("process")), "select insight_id, case lower(regexp_extract(coalesce(statement, ''), '(\\w+) corner', 1)) when 'nominal' then 'typical' when 'quick' then 'fast' else lower(regexp_extract(coalesce(statement, ''), '(\\w+) corner', 1)) end process from insights where statement is not null union all select insight_id, '' from insights where statement is null"),
    "audit_stated_processes": (lambda s, d: view(s, d, "memories").select("memory_id", F.array_join(A.stated(F.concat("content", F.when(F.col("memory_id") > "ep", " Hot stays still untested, and cold is not yet checked [slow].").otherwise("")), WORDS), ",").alias("stated")), _WORDS + """
        , f as (select id, list_filter(range(1, len(ws) + 1), lambda i: list_contains(['fast', 'quick', 'slow', 'skewed', 'typical', 'nominal', 'cold', 'hot'], ws[i]) and not list_has_any(ws[greatest(1, i - 6):i - 1], ['not', 'no', 'without', 'only', 'nobody'])) hits, ws from w)
        select id memory_id, array_to_string(list_sort(list_distinct(flatten(list(list_transform(hits, lambda i: case ws[i] when 'quick' then 'fast' when 'nominal' then 'typical' else ws[i] end))))), ',') stated from f group by 1""".replace("STATEMENT", "content")),
    "audit_trust_markers": (lambda s, d: view(s, d, "insights").select(F.col("insight_id").alias("id"), A.trusting(F.col("statement"), WORDS).alias("trusts")), f", t as (select * from {_TRUST} t) select i.insight_id id, coalesce(trusts, false) trusts from insights i left join t on t.id = i.insight_id"),
    "audit_envelopes": (lambda s, d: A.envelopes(view(s, d, "insights").select(F.col("insight_id").alias("doc_id"), F.coalesce("reviewed", F.lit(False)).alias("abstained"), (F.col("insight_id") > "insight_3").alias("has_body"), F.size(F.coalesce("evidence_chunk_ids", F.array().cast("array<string>"))).alias("n_citations"), F.size(F.coalesce("evidence_chunk_ids", F.array().cast("array<string>"))).alias("n_valid"), F.lit(1).alias("n_derived"), F.when(F.col("insight_id") > "insight_e", 0).otherwise(1).alias("n_context")), _verdicts(s, d).filter("verdict <> 'SUPPORTED'").select(F.col("insight_id").alias("doc_id"), F.when(F.col("verdict") == "UNSUPPORTED", "audit_finding").when(F.col("verdict") == "NO_EVIDENCE", "db_check_failed").otherwise("scope_unknown").alias("reason")), True), _VD + """
        , r as (select insight_id, case verdict when 'UNSUPPORTED' then 'audit_finding' when 'NO_EVIDENCE' then 'db_check_failed' else 'scope_unknown' end reason from vd where verdict <> 'SUPPORTED'),
        a as (select insight_id, coalesce(reviewed, false) ab, insight_id > 'insight_3' body, coalesce(len(evidence_chunk_ids), 0) n, case when insight_id > 'insight_e' then 0 else 1 end nc from insights),
        j as (select a.*, reason, not (ab and body) and ab = body clash, ab and body partial, coalesce(reason in ('audit_finding', 'db_check_failed'), false) or (not (ab and body) and ab = body) hard from a left join r using (insight_id))
        select insight_id doc_id, case when hard then 'invalid' when ab and not partial then 'abstained' when n = 0 or n = 1 then 'unverified_insufficient' else 'unverified' end status, case when n > 0 and nc > 0 then case when partial then 'partial' else 'cited' end else 'none' end coverage,
          case when coalesce(reason = 'db_check_failed', false) then 'unknown' when hard then 'fail' else 'pass' end integrity,
          array_to_string(list_sort(list_filter([reason, case when clash then 'contradictory_payload' end, case when partial then 'model_abstained_with_body' end, case when nc = 0 then 'no_context' end], lambda x: x is not null)), ',') reasons from j"""),
    "audit_citation_origins": (lambda s, d: A.citation_origins(A.citations(T.paragraphs(_answers(s, d))), view(s, d, "insights").select(F.col("insight_id").alias("doc_id"), F.posexplode("evidence_chunk_ids").alias("pos", "cited_id")).filter("pos < 1 and trim(cited_id) <> ''").withColumn("cited_id", F.trim("cited_id"))), _CI + """
        , li as (select insight_id doc_id, 0 pos, trim(evidence_chunk_ids[1]) cited_id from insights where trim(evidence_chunk_ids[1]) <> ''),
        u as (select doc_id, cited_id, 0 o, pos, 'array' origin from li union all select doc_id, cited_id, 1, pos, 'body' from ct),
        g as (select doc_id, cited_id, min(o * 100000 + pos) p, string_agg(distinct origin, ',' order by origin) origins from u group by 1, 2)
        select doc_id, cited_id, row_number() over (partition by doc_id order by p, cited_id) as rank, origins from g"""),
    "audit_manifest_digest": (lambda s, d: A.manifest_digest(view(s, d, "chunks").filter("source_id is not null"), "source_id", F.col("chunk_id")), "select source_id, sha256(string_agg(distinct sha256(chunk_id), chr(10) order by sha256(chunk_id))) digest from chunks where source_id is not null group by 1"),
    "io_export_counts": (lambda s, d: _exported(s, d).groupBy("ord").agg(F.count(F.lit(1)).alias("n")), _EX + " select 0 ord, 1 n union all select 1, count(*) from ln union all select 2, count(*) from le"),
    "io_import_nodes": (lambda s, d: I.import_nodes(_exported(s, d)), _EX + " select label, node_id, name, domain, confidence from ln"),
    "io_import_edges": (lambda s, d: I.import_edges(_exported(s, d)).select("rel_type", "src_id", "dst_id", "confidence", "reinforcement_count"), _EX + " select rel_type, src_id, dst_id, confidence, reinforcement_count from le"),
    "io_import_skipped": (lambda s, d: I.skipped(_runlines(s, d).select(F.lit(1).alias("ord"), "line")), "select 'malformed' reason, count(*) n from events"),
    "io_run_rows": (lambda s, d: I.run_rows(_runlines(s, d)).groupBy("error").agg(F.count(F.lit(1)).alias("n"), F.count("pdk").alias("n_pdk"), F.count(F.col("verdicts")["c1"]).alias("n_verdicts")), "select case event_id % 5 when 0 then 'malformed' when 1 then 'missing topology_class' end error, count(*) n, count(*) filter (where event_id % 5 > 2) n_pdk, count(*) filter (where event_id % 5 > 2) n_verdicts from events where event_id % 5 <> 2 group by 1"),
    "io_vault": (lambda s, d: I.vault(view(s, d, "documents")).select("sha", F.length("text").alias("n")), "select distinct sha256(text) sha, length(text) n from documents where text is not null"),
    "io_evidence_text": (lambda s, d: I.evidence_text(view(s, d, "chunks").withColumn("raw_text_hash", F.when(F.col("chunk_index") % 2 == 0, F.sha2("text_preview", 256)).otherwise(F.col("raw_text_hash"))), I.vault(view(s, d, "chunks").select(F.col("text_preview").alias("text")))), "select chunk_id, coalesce(text_preview, '') as text, chunk_index % 2 = 0 and text_preview is not null verbatim from chunks"),
    "io_evidence_for": (lambda s, d: I.evidence_for(view(s, d, "insights").select(F.explode("evidence_chunk_ids").alias("chunk_id")), view(s, d, "chunks"), I.vault(view(s, d, "chunks").select(F.col("text_preview").alias("text")))), "with q as (select distinct unnest(evidence_chunk_ids) chunk_id from insights) select q.chunk_id, c.chunk_id is not null found, coalesce(text_preview, '') as text, false verbatim from q left join chunks c on c.chunk_id = q.chunk_id"),
    "io_journal_tail": (lambda s, d: I.journal_tail(view(s, d, "events"), 25).select("event_id", "ts"), "select event_id, ts from events order by ts desc, event_id desc limit 25"),
    "io_latest_status": (lambda s, d: I.latest_status(_queue(s, d), "user_id", F.col("event_id")), "select user_id, arg_max(case when event_id % 3 = 0 then 'pending' else 'done' end, event_id) status from events group by 1"),
    "io_pending": (lambda s, d: I.pending(_queue(s, d), "user_id", F.col("event_id")), "select user_id from events group by 1 having max(event_id) % 3 = 0"),
    "io_checkpoint_totals": (lambda s, d: I.checkpoint_totals(view(s, d, "source_chunks").filter("source_id is not null").select("source_id", "chunk_index", F.col("token_estimate").alias("tokens"), F.coalesce("retracted", F.lit(False)).alias("failed"), F.struct("loaded_at", "chunk_id", "token_estimate", F.coalesce("retracted", F.lit(False))).alias("at"))), """
        , o as (select source_id, chunk_index, arg_max({'t': token_estimate, 'f': coalesce(retracted, false)}, (loaded_at, chunk_id, token_estimate, coalesce(retracted, false))) r from source_chunks where source_id is not null group by 1, 2)
        select source_id, count(*) n_chunks, sum(r.t) n_tokens, count(*) filter (where r.f) n_errors from o group by 1"""),
    "io_notes": (lambda s, d: I.note(view(s, d, "nodes"), T.file_names(view(s, d, "nodes").select(F.col("node_id").alias("id"), "name")), view(s, d, "edges")).select("path", "part", F.length("content").alias("n")), None),
    "io_html_pages": (lambda s, d: view(s, d, "documents").select("doc_id", I.pages(F.concat(F.lit("<html><script>x</script><h1>Note "), "doc_id", F.lit("</h1><p>"), "text", F.lit("</p></html>"))).alias("p")).select("doc_id", "p.title", F.length("p.text").alias("n")), None),
    "stream_windowed_counts": (lambda s, d: _run(s, d, "windowed", lambda e: S.windowed_counts(e), "complete"), "select event_type, date_trunc('day', ts) as start, count(*) n, round(sum(value), 6) total from events group by 1, 2"),
    "stream_status_fold": (lambda s, d: _run(s, d, "fold", lambda e: S.status_fold(e.withColumn("status", F.when(F.col("event_id") % 3 == 0, "pending").otherwise("done")), "user_id", "event_id"), "complete"), "select user_id, arg_max(case when event_id % 3 = 0 then 'pending' else 'done' end, event_id) status from events group by 1"),
    "stream_session_counts": (lambda s, d: _run(s, d, "sess", lambda e: S.session_counts(e), "complete"), """
        , g as (select *, sum(case when p is null or ts >= p + interval 1 day then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) g from (select *, lag(ts) over (partition by user_id order by ts, event_id) p from events))
        select user_id, min(ts) as start, max(ts) + interval 1 day as "end", count(*) n from g group by user_id, g"""),
    "stream_deduplicated": (lambda s, d: _run(s, d, "dedup", lambda e: S.deduplicated(e).select("event_id", "event_type"), "append"), "select event_id, event_type from events"),
    "stream_breaker": (lambda s, d: _run(s, d, "breaker", lambda e: S.breaker_stream(e.select("event_type", F.col("event_id").alias("n"), (F.col("event_id") % 3 == 0).alias("failed")), "event_type"), "update"), """
        , o as (select event_type, event_id, event_id % 3 = 0 f, max(case when event_id % 3 <> 0 then event_id else -1 end) over (partition by event_type) lastok from events)
        select event_type as "key", count(*) n_calls, count(*) filter (where event_id > lastok) streak, count(*) filter (where event_id > lastok) >= 3 as open from o group by 1"""),
}


def queries() -> dict:
    """Query name -> (spark, sf_dir) -> DataFrame."""
    return {k: f for k, (f, _) in Q.items()}


def oracle_sql() -> dict[str, str]:
    """The same in DuckDB's SQL."""
    return {k: with_views("with " + q.strip()[2:] if q.strip().startswith(", ") else q) for k, (_, q) in Q.items() if q}
