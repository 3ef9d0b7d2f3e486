"""Graph queries over the derived views, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeweave.operators import components as C
from lodeweave.operators import graph as G
from lodeweave.sources.views import view, with_views

RULES = {"DEPENDS_ON": ("Concept", "Parameter"), "SUB_BLOCK": ("Concept", "Parameter")}
_LIVE = "not coalesce(retracted, false)"
_SYM = "(select src_id a, dst_id b, rel_type, '->' direction from edges union all select dst_id, src_id, rel_type, '<-' from edges)"


def _starts(s, d):
    return view(s, d, "nodes").filter("label = 'Principle' and node_id in ('nat:3', 'nat:7')")


def _delta(s, d):
    """Proposals that repeat some edges, add some, and name an end that does not exist."""
    e = view(s, d, "edges").filter("rel_type = 'SUB_BLOCK'")
    again = e.select("src_id", "rel_type", "dst_id", F.lit(0.99).alias("confidence"), F.lit(1).cast("bigint").alias("reinforcement_count"), "last_reinforced")
    lost = e.select("src_id", F.lit("RELATES_TO").alias("rel_type"), F.when(F.col("src_id") < "sup:5", F.lit("nat:0")).otherwise(F.lit("nat:999")).alias("dst_id"), F.lit(0.5).alias("confidence"), F.lit(1).cast("bigint").alias("reinforcement_count"), "last_reinforced")
    return again.unionByName(lost)


_DELTA = """(select src_id, rel_type, dst_id, 0.99e0 confidence, cast(1 as bigint) reinforcement_count, last_reinforced from edges where rel_type = 'SUB_BLOCK'
union all select src_id, 'RELATES_TO', case when src_id < 'sup:5' then 'nat:0' else 'nat:999' end, 0.5e0, cast(1 as bigint), last_reinforced from edges where rel_type = 'SUB_BLOCK')"""


def _chunk_ids(s, d):
    """Chunks as nodes with ids of 16 hex digits after the scheme."""
    return view(s, d, "chunks").select(F.concat("chunk_id", F.substring(F.md5("chunk_id"), 1, 4)).alias("node_id"), "chunk_id", "retracted")


def _requests(s, d):
    n = _chunk_ids(s, d)
    every = [F.col("node_id"), F.col("chunk_id"), F.substring("node_id", 1, 16), F.concat("chunk_id", F.lit("zz")), F.substring("node_id", 1, 19)]
    return n.select(F.explode(F.array(*every)).alias("request"))


_NID = "(select chunk_id || substr(md5(chunk_id), 1, 4) node_id, chunk_id, retracted from chunks)"
_REQ = f"(select unnest([node_id, chunk_id, substr(node_id, 1, 16), chunk_id || 'zz', substr(node_id, 1, 19)]) request from {_NID} i)"


def _new_nodes(s, d):
    n = view(s, d, "nodes").filter("label = 'Concept'")
    return n.select("label", "node_id", F.lit("renamed").alias("name"), F.lit("moved").alias("domain"), F.lit(None).cast("string").alias("description"), F.lit(0.25).alias("confidence")).unionByName(n.select("label", F.concat("node_id", F.lit("_new")).alias("node_id"), F.upper("name").alias("name"), F.lit("moved").alias("domain"), F.lit("new").alias("description"), F.lit(0.5).alias("confidence")))


Q = {
    "graph_get_node": (lambda s, d: G.get_node(view(s, d, "nodes"), "Parameter", "prt:17"), "select * from nodes where label = 'Parameter' and node_id = 'prt:17'"),
    "graph_by_any_id": (lambda s, d: G.by_any_id(view(s, d, "nodes"), "nat:5"), "select * from nodes where node_id = 'nat:5' order by label limit 1"),
    "graph_resolve_prefix": (lambda s, d: G.resolve_prefix(_requests(s, d), _chunk_ids(s, d)), f"""
        , r as (select distinct request from {_REQ} q), n as (select distinct node_id from {_NID} i where {_LIVE}),
        h as (select request, node_id from r join n on substr(request, 1, 18) = substr(node_id, 1, 18) and starts_with(node_id, request))
        select request, coalesce(max(case when node_id = request then node_id end), min(node_id)) node_id from h group by 1 having count(*) = 1 or bool_or(node_id = request)"""),
    "graph_resolution_class": (lambda s, d: G.resolution_class(_requests(s, d), _chunk_ids(s, d)), f"""
        select r.request, case when n is null then 'missing' when n > 1 then 'ambiguous' when gone then 'retracted' else 'active' end resolution
        from (select distinct request from {_REQ} q) r left join (select node_id, count(*) n, bool_and(coalesce(retracted, false)) gone from {_NID} i group by 1) x on x.node_id = r.request"""),
    "graph_text_search": (lambda s, d: G.text_search(view(s, d, "nodes"), "Blue"), f"""
        select node_id, label, name from nodes where {_LIVE} and label in ('Concept','Equation','Principle','CircuitTopology','Parameter') and lower(name) like '%blue%'
        order by case when lower(name) = 'blue' then 0 else 1 end, name, node_id limit 20"""),
    "graph_counts_by_label": (lambda s, d: G.counts_by_label(view(s, d, "nodes")), "select label, count(*) n from nodes group by 1"),
    "graph_counts_by_type": (lambda s, d: G.counts_by_type(view(s, d, "edges"), view(s, d, "nodes")), f"""
        select rel_type, count(*) n from edges where src_id in (select node_id from nodes where {_LIVE} and label <> 'Session') and dst_id in (select node_id from nodes where {_LIVE} and label <> 'Session') group by 1"""),
    "graph_degree": (lambda s, d: G.degree(view(s, d, "nodes"), view(s, d, "edges")), f"select n.node_id, count(a) degree from nodes n left join {_SYM} e on e.a = n.node_id group by 1"),
    "graph_neighbour_set": (lambda s, d: G.neighbour_set(view(s, d, "edges"), view(s, d, "nodes"), "Principle"), f"select distinct a node_id, b neighbour_id from {_SYM} e where b in (select node_id from nodes where label = 'Principle')"),
    "graph_neighbourhood": (lambda s, d: G.neighbourhood(view(s, d, "edges"), _starts(s, d)), f"""
        , sym as {_SYM}, h1 as (select a start_id, b node_id, 1 distance, min({{'rel_type': rel_type, 'via': a, 'direction': direction}}) e from sym where a in ('nat:3','nat:7') and b <> a group by 1, 2),
        h2 as (select h1.start_id, s.b node_id, 2 distance, min({{'rel_type': s.rel_type, 'via': s.a, 'direction': s.direction}}) e from h1 join sym s on s.a = h1.node_id
               where s.b <> h1.start_id and not exists (select 1 from h1 x where x.start_id = h1.start_id and x.node_id = s.b) group by 1, 2)
        select start_id, node_id, distance, e.rel_type, e.direction, e.via from (select * from h1 union all select * from h2)"""),
    "graph_bridges": (lambda s, d: G.bridges(view(s, d, "nodes"), view(s, d, "edges")), """
        , h as (select distinct dst_id, src_id, domain from edges join nodes on src_id = node_id where label = 'Concept' and rel_type in ('DEPENDS_ON','USES_EQUATION','HAS_PARAMETER') and domain is not null),
        l as (select least(src_id, dst_id) a, greatest(src_id, dst_id) b from edges where rel_type in ('BRIDGES_TO','TRADES_OFF')),
        p as (select x.src_id node_a, y.src_id node_b, x.domain domain_a, y.domain domain_b, count(*) shared, list(distinct n.name order by n.name)[1:5] shared_names
              from h x join h y on x.dst_id = y.dst_id and x.src_id < y.src_id and x.domain <> y.domain join nodes n on n.node_id = x.dst_id group by 1, 2, 3, 4 having count(*) >= 2)
        select * from p where not exists (select 1 from l where l.a = node_a and l.b = node_b) order by shared desc, node_a, node_b limit 20"""),
    "graph_source_scoped_edges": (lambda s, d: G.source_scoped_edges(view(s, d, "edges"), view(s, d, "nodes").select(F.coalesce("domain", F.lit("none")).alias("source_id"), "node_id")), """
        select source_id, src_id, rel_type, dst_id from (select coalesce(x.domain, 'none') source_id, src_id, rel_type, dst_id, row_number() over (partition by coalesce(x.domain, 'none') order by src_id, rel_type, dst_id) r
        from edges join nodes x on x.node_id = src_id join nodes y on y.node_id = dst_id and coalesce(x.domain, 'none') = coalesce(y.domain, 'none')) where r <= 50"""),
    "graph_endpoint_violations": (lambda s, d: G.endpoint_violations(view(s, d, "edges"), view(s, d, "nodes"), RULES), """
        select src_id, rel_type, dst_id, x.label src_label, y.label dst_label from edges left join nodes x on x.node_id = src_id left join nodes y on y.node_id = dst_id
        where rel_type in ('DEPENDS_ON', 'SUB_BLOCK') and not (x.label is not distinct from 'Concept' and y.label is not distinct from 'Parameter')"""),
    "graph_duplicate_names": (lambda s, d: G.duplicate_names(view(s, d, "nodes")), "select lower(trim(name)) as key, count(*) n, min(node_id) first_id from nodes where name is not null group by 1 having count(*) > 1"),
    "graph_duplicate_names_scoped": (lambda s, d: G.duplicate_names(view(s, d, "nodes"), "domain"), "select lower(trim(name)) as key, domain, count(*) n, min(node_id) first_id from nodes where name is not null group by 1, 2 having count(*) > 1"),
    "graph_reinforced_nodes": (lambda s, d: G.reinforced_nodes(view(s, d, "nodes"), view(s, d, "edges").filter("rel_type = 'DEPENDS_ON' and reinforcement_count > 1 or rel_type = 'RECORDED' and dst_id < 'nat:15'").select(F.explode(F.array("src_id", "src_id")).alias("node_id"))).withColumn("confidence", F.round("confidence", 6)), """
        , h as (select src_id node_id, 2 * count(*) h from edges where rel_type = 'DEPENDS_ON' and reinforcement_count > 1 or rel_type = 'RECORDED' and dst_id < 'nat:15' group by 1)
        select n.node_id, round(list_reduce(list_prepend(coalesce(confidence, 0.7e0), list_transform(range(h), lambda i: 0e0)), lambda a, x: case when round(a, 9) < 0.95e0 then a + 0.02e0 else 0.95e0 end), 6) confidence, coalesce(reinforcement_count, 1) + h reinforcement_count
        from nodes n join h on h.node_id = n.node_id"""),
    "graph_reinforced_edges": (lambda s, d: G.reinforced_edges(view(s, d, "edges")), "select src_id, rel_type, dst_id, case when coalesce(confidence, 0.7e0) < 0.95e0 then coalesce(confidence, 0.7e0) + 0.03e0 else 0.95e0 end confidence, coalesce(reinforcement_count, 1) + 1 reinforcement_count from edges"),
    "graph_linear_decay": (lambda s, d: G.linear_decay(view(s, d, "edges"), "2002-01-01 00:00:00").select("src_id", "rel_type", "dst_id", F.round("confidence", 6).alias("confidence")), """
        select src_id, rel_type, dst_id, round(case when last_reinforced < timestamp '2002-01-01' - interval 30 day and confidence > 0.3e0 then greatest(confidence - 0.1e0, 0.3e0) else confidence end, 6) confidence from edges"""),
    "graph_reinforcement_stats": (lambda s, d: G.reinforcement_stats(view(s, d, "edges")), "select count(*) n, round(avg(coalesce(confidence, 0.7e0)), 3) avg_confidence, round(avg(coalesce(reinforcement_count, 1)), 1) avg_reinforcement, max(coalesce(reinforcement_count, 1)) max_reinforcement from edges"),
    "graph_merge_nodes": (lambda s, d: G.merge_nodes(view(s, d, "nodes"), _new_nodes(s, d)), """
        select label, node_id, name, 'moved' domain, description, 0.25e0 confidence, reinforcement_count, retracted from nodes where label = 'Concept'
        union all select label, node_id || '_new', upper(name), 'moved', 'new', 0.5e0, null, null from nodes where label = 'Concept' union all select * from nodes where label <> 'Concept'"""),
    "graph_update_nodes": (lambda s, d: G.update_nodes(view(s, d, "nodes"), _new_nodes(s, d)), """
        select label, node_id, name, case when label = 'Concept' then 'moved' else domain end domain, description, case when label = 'Concept' then 0.25e0 else confidence end confidence, reinforcement_count, retracted from nodes"""),
    "graph_merge_edges": (lambda s, d: G.merge_edges(view(s, d, "edges"), _delta(s, d), view(s, d, "nodes"))[0], f"""
        select * from edges where rel_type <> 'SUB_BLOCK' union all select * from {_DELTA} x where dst_id in (select node_id from nodes)"""),
    "graph_merge_edges_rejected": (lambda s, d: G.merge_edges(view(s, d, "edges"), _delta(s, d), view(s, d, "nodes"))[1], f"select * from {_DELTA} x where dst_id not in (select node_id from nodes)"),
    "graph_reinforce_by_delta": (lambda s, d: G.reinforce_by_delta(view(s, d, "edges"), _delta(s, d).withColumnRenamed("last_reinforced", "at")), """
        select src_id, rel_type, dst_id, confidence, coalesce(reinforcement_count, 1) + case when rel_type = 'SUB_BLOCK' then 1 else 0 end reinforcement_count, last_reinforced from edges"""),
    "graph_survivors_of_names": (lambda s, d: G.survivors_of_names(view(s, d, "nodes"), view(s, d, "edges")), f"""
        , dg as (select n.node_id, label, lower(trim(name)) k, coalesce(reinforcement_count, 1) rc, count(a) dg from nodes n left join {_SYM} e on e.a = n.node_id group by 1, 2, 3, 4),
        r as (select *, first_value(node_id) over (partition by label, k order by dg desc, rc desc, node_id) survivor_id from dg where k is not null)
        select node_id, survivor_id from r where node_id <> survivor_id"""),
    "graph_dedupe_rewired": (lambda s, d: G.rewire(view(s, d, "edges"), G.survivors_of_names(view(s, d, "nodes"), view(s, d, "edges"))), f"""
        , dg as (select n.node_id, label, lower(trim(name)) k, coalesce(reinforcement_count, 1) rc, count(a) dg from nodes n left join {_SYM} e on e.a = n.node_id group by 1, 2, 3, 4),
        m as (select node_id, first_value(node_id) over (partition by label, k order by dg desc, rc desc, node_id) survivor_id from dg where k is not null),
        f as (select coalesce(x.survivor_id, src_id) src_id, rel_type, coalesce(y.survivor_id, dst_id) dst_id, confidence, reinforcement_count,
              (coalesce(x.survivor_id, src_id) <> src_id or coalesce(y.survivor_id, dst_id) <> dst_id)::int moved from edges left join m x on x.node_id = src_id left join m y on y.node_id = dst_id)
        select src_id, rel_type, dst_id, confidence, reinforcement_count from (select *, row_number() over (partition by src_id, rel_type, dst_id order by moved, confidence desc, reinforcement_count desc) r from f where src_id <> dst_id) where r = 1"""),
    "graph_delete_nodes": (lambda s, d: G.delete_nodes(view(s, d, "nodes"), view(s, d, "edges"), view(s, d, "nodes").filter("retracted"))[1], "select * from edges where src_id not in (select node_id from nodes where retracted) and dst_id not in (select node_id from nodes where retracted)"),
    "graph_retract": (lambda s, d: G.retract(view(s, d, "nodes"), _starts(s, d), "withdrawn").filter("retracted").select("node_id", "retraction_reason"), "select node_id, case when node_id in ('nat:3','nat:7') then 'withdrawn' end retraction_reason from nodes where retracted or node_id in ('nat:3','nat:7')"),
    "graph_add_aliases": (lambda s, d: G.add_aliases(view(s, d, "topology_nodes").withColumnRenamed("topology_id", "node_id"), view(s, d, "topology_nodes").select(F.col("topology_id").alias("node_id"), F.lower("name").alias("alias"))), """
        select topology_id node_id, list_filter(case when list_contains(coalesce(aliases, []), lower(name)) then coalesce(aliases, []) else list_append(coalesce(aliases, []), lower(name)) end, lambda a: a <> name) aliases from topology_nodes"""),
    "graph_live_export_counts": (lambda s, d: G.counts_by_label(G.live(view(s, d, "nodes")).filter(~F.col("label").isin(*G.PRIVATE_LABELS))), f"select label, count(*) n from nodes where {_LIVE} and label <> 'Session' group by 1"),
    "graph_components": (lambda s, d: C.connected_components(view(s, d, "edges"), "src_id", "dst_id"), None),
    "graph_component_sizes": (lambda s, d: C.connected_components(view(s, d, "edges").filter("rel_type = 'BRIDGES_TO'"), "src_id", "dst_id").groupBy("component").agg(F.count(F.lit(1)).alias("n")), """
        , k as (select node_id, 'sup:' || cast(min(s) over (partition by s % 3) as varchar) from (select node_id, cast(substr(node_id, 5) as bigint) s from nodes where label = 'Concept'))
        select min(node_id) component, count(*) n from (select node_id, cast(substr(node_id, 5) as bigint) % 3 g from nodes where label = 'Concept') group by g"""),
}


def queries() -> dict:
    """Query name -> (spark, sf_dir) -> DataFrame."""
    return {k: f for k, (f, _) in Q.items()}


def oracle_sql() -> dict[str, str]:
    """The same in DuckDB's SQL."""
    return {k: with_views("with " + q.strip()[2:] if q.strip().startswith(", ") else q) for k, (_, q) in Q.items() if q}
