"""Graph, memory and evidence views of the test tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lodeweave.session import table

VIEWS = {
    "nodes": """
        select 'Concept' label, 'sup:' || cast(s_suppkey as string) node_id, s_name name, r_name domain, 'supplier in ' || n_name description,
               case when s_suppkey % 13 <> 0 then 0.5e0 + cast(s_suppkey % 10 as double) / 20 end confidence, cast(s_suppkey % 7 as bigint) reinforcement_count, s_suppkey % 11 = 0 retracted
        from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
        union all
        select 'Parameter', 'prt:' || cast(p_partkey as string), p_name, p_brand, p_type, 0.7e0, cast(p_partkey % 5 as bigint), p_partkey % 11 = 0 from part
        union all
        select 'Principle', 'nat:' || cast(n_nationkey as string), n_name, 'nation', cast(null as string), 0.9e0, cast(1 as bigint), false from nation
        union all
        select 'Source', 'reg:' || cast(r_regionkey as string), r_name, cast(null as string), cast(null as string), 1e0, cast(1 as bigint), false from region
        union all
        select 'Session', 'cus:' || cast(c_custkey as string), c_name, c_mktsegment, cast(null as string), cast(null as double), cast(null as bigint), false from customer""",
    "edges": """
        select 'sup:' || cast(l_suppkey as string) src_id, 'DEPENDS_ON' rel_type, 'prt:' || cast(l_partkey as string) dst_id,
               0.5e0 + 0.5e0 * least(1e0, count(*) / 4e0) confidence, count(*) reinforcement_count, max(l_shipdate) last_reinforced
        from lineitem group by l_suppkey, l_partkey
        union all
        select 'sup:' || cast(s_suppkey as string), 'SUB_BLOCK', 'nat:' || cast(s_nationkey as string), 0.8e0, cast(1 as bigint), cast('1998-01-01 00:00:00' as timestamp_ntz) from supplier
        union all
        select 'cus:' || cast(c_custkey as string), 'RECORDED', 'nat:' || cast(c_nationkey as string), cast(null as double), cast(null as bigint), cast('1998-06-01 00:00:00' as timestamp_ntz) from customer
        union all
        select 'nat:' || cast(n_nationkey as string), 'EXTRACTED_FROM', 'reg:' || cast(n_regionkey as string), 1e0, cast(1 as bigint), cast('1999-01-01 00:00:00' as timestamp_ntz) from nation
        union all
        select 'sup:' || cast(a.s_suppkey as string), 'BRIDGES_TO', 'sup:' || cast(b.s_suppkey as string), 0.6e0, cast(1 as bigint), cast('2000-01-01 00:00:00' as timestamp_ntz)
        from supplier a join supplier b on b.s_suppkey = a.s_suppkey + 3""",
    "memories": """
        select * from (select *, row_number() over (partition by memory_id order by last_accessed desc, loaded_at desc) rn from memory_entries where memory_id is not null) x where rn = 1""",
    "chunks": """
        select * from (select *, row_number() over (partition by chunk_id order by loaded_at desc, coalesce(retracted, false) desc, text_preview desc) rn from source_chunks where chunk_id is not null) x where rn = 1""",
    "insights": """
        select * from (select *, row_number() over (partition by insight_id order by loaded_at desc) rn from insight_nodes where insight_id is not null) x where rn = 1""",
    "runs": """
        select 'claim_' || lower(replace(p_brand, '#', '_')) claim_id, r_name pdk, min(l_orderkey) seq, true ok, 'class_' || substr(p_brand, 7, 1) topology_class,
               case when sum(l_quantity) % 5 = 0 then 'REFUTED' when sum(l_quantity) % 5 = 1 then 'VERIFIED_WITH_CAVEAT' when sum(l_quantity) % 5 = 2 and r_name = 'ASIA' then 'FLAGGED' else 'VERIFIED' end verdict
        from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
        group by p_brand, r_name""",
    "series": """
        select 'brand:' || p_brand series_id, cast(p_size as double) x, round(avg(p_retailprice), 6) y from part group by p_brand, p_size
        union all
        select 'sup:' || cast(l_suppkey as string), cast(extract(year from l_shipdate) as double), round(sum(l_quantity), 6) from lineitem group by l_suppkey, extract(year from l_shipdate)""",
    "skill_runs": """
        select event_id run_id, event_type skill_name, event_id % 3 <> 0 success, value duration_seconds, ts executed_at, case when event_id % 3 = 0 then 'error ' || cast(event_id % 5 as string) end error from events""",
    "assessments": """
        select 'learner_' || cast(user_id % 50 as string) learner_id, 'topic_' || cast(event_id % 40 as string) target_id, ts assessed_at, event_id seq,
               case event_type when 'purchase' then 'understood' when 'error' then 'misconception' else 'partial' end verdict from events""",
    "concept_vectors": """
        select p_partkey concept_id, p_name name, p_brand source_id, embedding from part join embeddings on p_partkey = vec_id""",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings memory_entries insight_nodes source_chunks link_requests topology_nodes parameter_nodes source_nodes".split()
AS_OF = "2026-06-01 00:00:00"
_SPARK = [(r"\bextract\(year from (\w+)\)", r"year(\1)")]
_DUCK = [(r"\btimestamp_ntz\b", "timestamp")]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views, or a table."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    text = VIEWS[name]
    for a, b in _SPARK:
        text = re.sub(a, b, text)
    used = {t: table(spark, sf_dir, t) for t in TABLES if re.search(rf"\b(?:from|join)\s+{t}\b", text)}
    for t in used:
        text = re.sub(rf"\b(from|join)\s+{t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **used)


def with_views(sql: str) -> str:
    """DuckDB text with the views it names in front."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    ctes = []
    for v in used:
        text = VIEWS[v]
        for a, b in _DUCK:
            text = re.sub(a, b, text)
        ctes.append(f"{v} as ({text})")
    if not ctes:
        return sql
    head = "with recursive " if "recursive" in sql.lower() else "with "
    body = re.sub(r"^\s*with\s+(recursive\s+)?", ", ", sql, flags=re.I) if re.match(r"\s*with\b", sql, re.I) else " " + sql
    return head + ",\n".join(ctes) + body
