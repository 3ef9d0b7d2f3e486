"""Queries of the problems tagged llm, with SQL where DuckDB can state the same."""

from __future__ import annotations

from lodeweave.llm import knn, mixing, neardup, packing, pii, scanrepair, survivorship
from lodeweave.session import table


def _records(s, d):
    return neardup.statements_and_memories(table(s, d, "memory_entries"), table(s, d, "insight_nodes"))


def queries() -> dict:
    """Query name -> (spark, sf_dir) -> DataFrame."""
    return {
        "p1_found": lambda s, d: survivorship.survivors(table(s, d, "memory_entries")).select("memory_id"),
        "p1_golden": lambda s, d: survivorship.survivors(table(s, d, "memory_entries")),
        "p2_found": lambda s, d: scanrepair.noise(table(s, d, "source_chunks"), table(s, d, "source_nodes")),
        "p2_repaired": lambda s, d: scanrepair.repaired(table(s, d, "source_chunks"), table(s, d, "source_nodes")),
        "p4_found": lambda s, d: neardup.near_duplicate_pairs(_records(s, d)),
        "p4_groups": lambda s, d: neardup.near_duplicate_groups(_records(s, d)),
        "p5_found": lambda s, d: knn.neighbour_pairs(knn.nearest(table(s, d, "memory_entries"), table(s, d, "knn_probes"))),
        "p5_neighbours": lambda s, d: knn.all_nearest(table(s, d, "memory_entries")),
        "p6_pack": lambda s, d: packing.pack(table(s, d, "documents"), table(s, d, "pack_capacities")),
        "p6_unused": lambda s, d: packing.pack_summary(table(s, d, "documents"), table(s, d, "pack_capacities")),
        "p7_mixture": lambda s, d: mixing.mixture(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p7_shares": lambda s, d: mixing.mixture_shares(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p8_found": lambda s, d: pii.findings(table(s, d, "documents")),
        "p8_redacted": lambda s, d: pii.redacted(table(s, d, "documents")),
    }


_LATEST = """
latest as (select * from (select *, row_number() over (partition by memory_id order by last_accessed desc nulls last) rn from memory_entries where memory_id is not null) where rn = 1)"""
_GROUPED = f"""
with {_LATEST},
keyed as (select *, array_to_string(regexp_extract_all(lower(content), '[a-z0-9]+'), ' ') w, len(regexp_extract_all(lower(content), '[a-z0-9]+')) n from latest),
kept as (select *, count(*) over (partition by w) copies, (confidence is null)::int + (access_count is null)::int + (created_at is null)::int nulls from keyed where n >= 8)"""


def oracle_sql() -> dict[str, str]:
    """The same in DuckDB's SQL. The near duplicates are stated by counting shared word pairs, which the size of the test data allows."""
    return {
        "p4_found": """
with m as (select 'memory' k, memory_id i, content c from (select *, row_number() over (partition by memory_id order by last_accessed desc nulls last) rn from memory_entries where memory_id is not null) where rn = 1
  union all select 'insight', insight_id, statement from (select *, row_number() over (partition by insight_id order by loaded_at desc nulls last) rn from insight_nodes where insight_id is not null) where rn = 1),
w as (select k, i, regexp_extract_all(lower(c), '[a-z0-9]+') w from m), t as (select k, i, w, unnest(range(1, len(w))) j from w where len(w) >= 8),
b as (select distinct k, i, w[j] || ' ' || w[j + 1] g from t), n as (select k, i, count(*) n from b group by 1, 2),
s as (select x.k, x.i a, y.i b, count(*) c from b x join b y on x.k = y.k and x.g = y.g and x.i < y.i group by 1, 2, 3)
select s.k record_kind, a id_a, b id_b from s join n p on p.k = s.k and p.i = a join n q on q.k = s.k and q.i = b where c >= 0.7 * (p.n + q.n - c)""",
        "p1_golden": _GROUPED + """,
f as (select *, case lower(tier) when 'core' then 4 when 'curated' then 3 when 'retain' then 2 when 'raw' then 1 else 0 end pr, row_number() over (partition by w order by nulls, confidence desc nulls last, access_count desc nulls last, created_at desc nulls last, memory_id) r,
  case when trim(session_id) <> '' then session_id end s2, case when trim(summary) <> '' then summary end s1, case when len(tags) > 0 then tags end t1 from kept where copies > 1)
select min(memory_id) filter (where r = 1) memory_id, sha256(w) group_key, count(*) n_records,
  max({'k': confidence is not null, 'p': pr, 'a': last_accessed, 'v': confidence}).v confidence, max({'k': access_count is not null, 'p': pr, 'a': last_accessed, 'v': access_count}).v access_count,
  max({'k': created_at is not null, 'p': pr, 'a': last_accessed, 'v': created_at}).v created_at, max({'k': s1 is not null, 'p': pr, 'a': last_accessed, 'v': s1}).v summary,
  max({'k': s2 is not null, 'p': pr, 'a': last_accessed, 'v': s2}).v session_id, max({'k': t1 is not null, 'p': pr, 'a': last_accessed, 'v': t1}).v tags from f group by w""",
        "p1_found": _GROUPED + """
select memory_id from (select *, row_number() over (partition by w order by nulls, confidence desc nulls last, access_count desc nulls last, created_at desc nulls last, memory_id) r from kept where copies > 1) where r = 1""",
    }
