"""Queries of the general training-data problem (3), with their SQL."""

from __future__ import annotations

from lodeweave.operators import references as R
from lodeweave.session import table

T = ("insight_nodes", "link_requests", "source_chunks", "topology_nodes", "parameter_nodes")


def queries() -> dict:
    """Query name -> (spark, sf_dir) -> DataFrame."""
    return {
        "p3_found": lambda s, d: R.orphan_evidence(*(table(s, d, t) for t in T)),
        "p3_partial": lambda s, d: R.composite_orphans(*(table(s, d, t) for t in T), "partial"),
        "p3_full": lambda s, d: R.composite_orphans(*(table(s, d, t) for t in T), "full"),
        "p3_report": lambda s, d: R.orphan_report(*(table(s, d, t) for t in T)),
    }


_NAME = r"trim(regexp_replace(regexp_replace(lower({}), '[_-]', ' ', 'g'), '\s+', ' ', 'g'))"
_FOUND = rf"""
with chunk as (
  select lower(trim(chunk_id)) k, min(loaded_at) since,
         bool_or(coalesce(retracted, false)) filter (where loaded_at = last) gone
  from (select *, max(loaded_at) over (partition by lower(trim(chunk_id))) last from source_chunks) group by 1),
refs as (
  select distinct 'insight_nodes' ref_table, insight_id record_id, lower(trim(e, E' \t\r\n')) ref_key, loaded_at as seen, 'chunk' kind
  from (select insight_id, loaded_at, unnest(evidence_chunk_ids) e from insight_nodes)
  union
  select distinct 'link_requests', link_id, {_NAME.format('match_text')}, loaded_at, coalesce(target_label, '') from link_requests),
target as (
  select 'chunk' kind, k, since from chunk where not gone
  union all select 'CircuitTopology', {_NAME.format('n')}, loaded_at from (
     select loaded_at, unnest(list_concat([name], coalesce(aliases, []))) n from topology_nodes where not coalesce(retracted, false))
  union all select 'Parameter', {_NAME.format('n')}, loaded_at from (
     select loaded_at, unnest([name, symbol]) n from parameter_nodes where not coalesce(retracted, false))),
good as (select * from refs where ref_key is not null and ref_key <> ''),
lost as (select * from good r where not exists (select 1 from target t where t.kind = r.kind and t.k = r.ref_key and t.since <= r.seen))
"""


_COMPOSITE = rf"""
with refs as (
  select 'insight_nodes' ref_table, insight_id record_id, 'chunk' target_kind, nullif(lower(trim(e, E' \t\r\n')), '') ref_key, nullif(trim(source_id), '') source_id from (select insight_id, source_id, unnest(evidence_chunk_ids) e from insight_nodes)
  union
  select 'link_requests', link_id, nullif(trim(target_label), ''), nullif({_NAME.format('match_text')}, ''), null from link_requests),
target as (
  select 'chunk' k, lower(trim(chunk_id)) r, nullif(trim(source_id), '') s from source_chunks
  union all select 'CircuitTopology', {_NAME.format('name')}, null from topology_nodes
  union all select 'Parameter', {_NAME.format('n')}, null from (select unnest([name, symbol]) n from parameter_nodes)),
t1 as (select distinct k, r, s from target),
hit as (select distinct r.* from refs r join t1 t on t.r = r.ref_key where (r.target_kind is null or t.k = r.target_kind) and (r.source_id is null or t.s = r.source_id)
  union select r.* from refs r where ref_key is null and exists (select 1 from (select distinct k, s from t1) t where (r.target_kind is null or t.k = r.target_kind) and (r.source_id is null or t.s = r.source_id))),
asked as (select * from refs where target_kind is not null or ref_key is not null or source_id is not null)
"""


def oracle_sql() -> dict[str, str]:
    """The same in DuckDB's SQL."""
    return {
        "p3_partial": _COMPOSITE + "select * from asked except select * from hit",
        "p3_full": _COMPOSITE + "select * from asked where target_kind is null or ref_key is null or source_id is null union (select * from asked where target_kind is not null and ref_key is not null and source_id is not null except select * from hit)",
        "p3_found": _FOUND + "select distinct ref_table, record_id, ref_key, strftime(seen, '%Y-%m') ref_period from lost",
        "p3_report": _FOUND + """, a as (select ref_table, ref_period, count(*) n_references from (select distinct ref_table, record_id, ref_key, strftime(seen, '%Y-%m') ref_period from good) group by 1, 2),
b as (select ref_table, ref_period, count(*) n_orphans from (select distinct ref_table, record_id, ref_key, strftime(seen, '%Y-%m') ref_period from lost) group by 1, 2)
select a.ref_table, a.ref_period, n_references, coalesce(n_orphans, 0) n_orphans from a left join b on a.ref_table = b.ref_table and a.ref_period = b.ref_period""",
    }
