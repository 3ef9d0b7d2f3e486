"""Knowledge composites as queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeweave.operators import graph as G
from lodeweave.operators import knowledge as K
from lodeweave.operators import resolution as R
from lodeweave.plans import evidence as PE
from lodeweave.plans import resolution as PR
from lodeweave.plans import text as PT
from lodeweave.sources.views import view, with_views

_NAMEKEY = r"trim(regexp_replace(regexp_replace(lower({}), '[_-]', ' ', 'g'), '\s+', ' ', 'g'))"


def ins(s, d):
    """Insights with a uniform id."""
    return view(s, d, "insights").withColumn("id", F.col("insight_id"))


def _refs(s, d):
    return ins(s, d).select("id", F.explode("evidence_chunk_ids").alias("ref")).filter("ref is not null")


def _chunk_names(s, d):
    return view(s, d, "chunks").select(F.col("chunk_id").alias("ref"), F.col("section_title").alias("name"))


def _laws_by_target(s, d):
    return view(s, d, "topology_nodes").select(F.lower("name").alias("target"), F.concat(F.lit("law_"), "topology_id").alias("law_id"))


def _targets(s, d):
    return view(s, d, "part").select(F.substring("p_brand", 7, 1).alias("topology_class"), F.col("p_type").alias("metric"), F.col("p_brand").alias("knob"), "p_size", "p_partkey")


def _name_table(s, d):
    from lodeweave.operators.references import name_key

    t = view(s, d, "topology_nodes").select(F.lit("CircuitTopology").alias("target_label"), name_key(F.col("name")).alias("key"), F.col("topology_id").alias("node_id"))
    return t.unionByName(view(s, d, "parameter_nodes").select(F.lit("Parameter"), name_key(F.col("name")), F.col("parameter_id")).toDF("target_label", "key", "node_id"))


_NT = f"(select 'CircuitTopology' target_label, {_NAMEKEY.format('name')} k, topology_id node_id from topology_nodes union all select 'Parameter', {_NAMEKEY.format('name')}, parameter_id from parameter_nodes)"


def _remap(s, d):
    return G.survivors_of_names(view(s, d, "nodes"), view(s, d, "edges"))


_SYM = "(select src_id a from edges union all select dst_id from edges)"
_RM = f""", dg as (select n.node_id, label, lower(trim(name)) k, coalesce(reinforcement_count, 1) rc, count(a) dg from nodes n left join {_SYM} e on e.a = n.node_id group by 1, 2, 3, 4),
rm as (select * from (select node_id, first_value(node_id) over (partition by label, k order by dg desc, rc desc, node_id) survivor_id from dg where k is not null) where node_id <> survivor_id)"""


def _proposals(s, d):
    e = view(s, d, "events")
    rel = F.element_at(F.array(*map(F.lit, ["depends on", "Uses", "RELATES_TO", "??", "part of"])), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select(F.col("event_id").alias("id"), rel.alias("relation"), (F.col("value") / 300).alias("confidence"), F.when(F.col("event_id") % 7 != 0, F.lit("a")).alias("source"), F.when(F.col("event_id") % 11 != 0, F.lit("b")).otherwise(" ").alias("target"))


def _new(s, d):
    return view(s, d, "nodes").filter("label not in ('Parameter', 'Session')").select("label", F.concat("node_id", F.lit("n")).alias("node_id"), "name", "domain", "description", "confidence", "reinforcement_count", "retracted")


def _newedges(s, d):
    return view(s, d, "edges").filter("rel_type = 'SUB_BLOCK'").withColumn("src_id", F.concat("src_id", F.lit("n")))




def _watched(s, d):
    """Blocked pairs of topologies with both names."""
    c = PR._concepts(s, d)
    side = lambda x: c.select(F.col("id").alias(f"id_{x}"), F.col("name").alias(f"name_{x}"))
    return R.blocked_pairs(c, PR.VOCAB).join(side("a"), "id_a").join(side("b"), "id_b").select(F.concat_ws(" ", "id_a", "id_b").alias("id"), "name_a", "name_b")


def _own(name, aliases):
    return f"list_transform(list_filter([{name}] || coalesce({aliases}, []), lambda x: trim(coalesce(x, '')) <> ''), lambda x: {PR._norm('x')})"


Q = {
    "kg_display": (lambda s, d: view(s, d, "nodes").select("node_id", K.display(F.col("label"), F.col("node_id"), F.when(F.col("reinforcement_count") % 2 == 0, F.col("name")), F.col("description")).alias("shown")), "select node_id, case when reinforcement_count % 2 = 0 and trim(name) <> '' then name when trim(description) <> '' then substr(description, 1, 60) else label || ' ' || node_id end shown from nodes"),
    "kg_snake_title": (lambda s, d: view(s, d, "link_requests").select("match_text", K.snake_title(F.col("match_text"), ["ota", "ldo"]).alias("title")).filter("match_text rlike '^[a-z_]+$'").distinct(), "select distinct match_text, array_to_string(list_transform(list_filter(string_split_regex(match_text, '[_ ]+'), lambda w: w <> ''), lambda w: case when w in ('ota','ldo') then upper(w) else upper(w[1]) || w[2:] end), ' ') title from link_requests where regexp_matches(match_text, '^[a-z_]+$')"),
    "kg_citation_level": (lambda s, d: ins(s, d).select("id", K.citation_level(F.col("evidence_chunk_ids"), F.col("source_id"))[0].alias("level"), F.array_join(K.citation_level(F.col("evidence_chunk_ids"), F.col("source_id"))[1], ",").alias("ids")), "select insight_id id, case when len(list_filter(coalesce(evidence_chunk_ids, []), lambda x: trim(coalesce(x, '')) <> '')) > 0 then 'chunk' when coalesce(source_id, '') <> '' then 'source' else 'derived' end as level, array_to_string(list_filter(coalesce(evidence_chunk_ids, []), lambda x: trim(coalesce(x, '')) <> '')[1:3], ',') ids from insights"),
    "kg_proposed_properties": (lambda s, d: view(s, d, "nodes").select("node_id", F.array_join(F.map_keys(K.proposed_properties(F.create_map(F.lit("name"), "name", F.lit("domain"), "domain", F.lit("x_id"), "node_id", F.lit("_p"), "node_id", F.lit("note"), "description"))), ",").alias("keys")), "select node_id, 'domain,note' as keys from nodes"),
    "kg_scalar_text": (lambda s, d: ins(s, d).select("id", K.scalar_text(F.col("evidence_chunk_ids")).alias("text")), "select insight_id id, array_to_string(list_filter(coalesce(evidence_chunk_ids, []), lambda x: trim(coalesce(x, '')) <> ''), ' ; ') as text from insights"),
    "kg_coerced": (lambda s, d: view(s, d, "part").select("p_partkey", K.coerced(F.array(F.lit(None).cast("string"), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, "x").when(F.col("p_partkey") % 3 == 1, "2.5").otherwise("7"))).alias("c")).select("p_partkey", "c.kind", F.size("c.items").cast("long").alias("n")), "select p_partkey, case p_partkey % 3 when 0 then 'string' when 1 then 'double' else 'int' end kind, 2::bigint n from part"),
    "kg_layer": (lambda s, d: K.layered(view(s, d, "part").select("p_partkey", F.upper("p_brand").alias("domain")), view(s, d, "part").filter("p_size > 10").groupBy("p_brand").agg(F.min("p_size").alias("layer")).select(F.concat("p_brand", F.lit(" ")).alias("domain"), "layer")).select("p_partkey", "layer"), "with l as (select p_brand, min(p_size) layer from part where p_size > 10 group by 1) select p_partkey, coalesce(layer, -1) layer from part left join l using (p_brand)"),
    "kg_with_names": (lambda s, d: K.with_names(ins(s, d).filter("not coalesce(reviewed, false)").select("id"), _refs(s, d), _chunk_names(s, d)), "select i.insight_id id, coalesce(n, '') as names from (select insight_id from insights where not coalesce(reviewed, false)) i left join (select insight_id, string_agg(distinct section_title, '; ' order by section_title) n from (select insight_id, unnest(evidence_chunk_ids) chunk_id from insights) join chunks using (chunk_id) where section_title is not null group by 1) g using (insight_id)"),
    "kg_open_items": (lambda s, d: K.open_items(ins(s, d).select("id", "confidence"), _refs(s, d), _chunk_names(s, d).filter("name = 'Noise budget'")), "select insight_id id, confidence from insights where exists (select 1 from chunks where section_title = 'Noise budget' and list_contains(evidence_chunk_ids, chunk_id)) order by confidence desc nulls last, insight_id limit 5"),
    "kg_specimen_evidence": (lambda s, d: K.specimen_evidence(view(s, d, "link_requests").withColumn("target", F.lower("match_text")), _laws_by_target(s, d)), "with l as (select lower(name) target, min('law_' || topology_id) law_id from topology_nodes group by 1) select split_part(source_id_value, ':', 1) spec_id, count(distinct case when contains(source_id_value, ':') then source_id_value end) n_claims, coalesce(string_agg(distinct case when contains(source_id_value, ':') then source_id_value end, ',' order by case when contains(source_id_value, ':') then source_id_value end), '') claims, coalesce(string_agg(distinct law_id, ',' order by law_id), '') laws from link_requests left join l on target = lower(match_text) group by 1"),
    "kg_why_law": (lambda s, d: K.why_law(PE._laws(s, d), view(s, d, "runs")), PE._L + ", cd as (select topology_class, pdk, min(claim_id) card from runs group by 1, 2) select l.claim_id, reason, ag.pdk, verdict, card from laws l left join ag on ag.claim_id = l.claim_id left join cd on cd.topology_class = l.topology_class and cd.pdk = ag.pdk"),
    "kg_phrase_window": (lambda s, d: K.phrase_window(s.createDataFrame([("Almond azure",), ("Blue met",)], "phrase string"), view(s, d, "nodes").filter("label = 'Parameter'"), G.degree(view(s, d, "nodes"), view(s, d, "edges")), 15), f", dg as (select n.node_id, count(a) degree from nodes n left join {_SYM} e on e.a = n.node_id group by 1), w as (select phrase, unnest(list_distinct(regexp_extract_all(lower(phrase), '[a-z0-9]{{3,}}'))) w from (select unnest(['Almond azure', 'Blue met']) phrase)), h as (select distinct phrase, node_id, name from w join nodes n on n.label = 'Parameter' and contains(lower(name), w.w)) select phrase, node_id, r as rank from (select phrase, h.node_id, row_number() over (partition by phrase order by degree desc nulls last, name, h.node_id) r from h join dg on dg.node_id = h.node_id) where r <= 15"),
    "kg_first_evidence": (lambda s, d: K.first_evidence(ins(s, d).select("id", F.col("evidence_chunk_ids").alias("chunk_ids")), view(s, d, "chunks")), ", f as (select insight_id id, list_filter(evidence_chunk_ids, lambda x: x is not null) c from insights), u as (select id, c, list_filter(range(1, len(c) + 1), lambda i: list_position(c, c[i]) = i)[1:3] ix from f), x as (select id, i - 1 pos, c[ix[i]] chunk_id from (select *, unnest(range(1, len(ix) + 1)) i from u)) select id, pos, x.chunk_id, text_preview as text from x left join chunks k on k.chunk_id = x.chunk_id"),
    "kg_coverage": (lambda s, d: K.coverage(_targets(s, d), _targets(s, d).filter("p_size > 40")), "with t as (select distinct substr(p_brand, 7, 1) c, p_type, p_brand from part), k as (select distinct substr(p_brand, 7, 1) c, p_type, p_brand, 1 x from part where p_size > 40) select t.c topology_class, count(*) total, count(x) done, count(*) - count(x) uncovered from t left join k using (c, p_type, p_brand) group by 1"),
    "kg_growth_plan": (lambda s, d: K.growth_plan(_targets(s, d).withColumn("source", F.when(F.col("p_size") > 45, "queue").when(F.col("p_size") > 35, "backlog").otherwise("coverage")), 6, 22), "with o as (select substr(p_brand, 7, 1) topology_class, p_type metric, p_brand knob, min(case when p_size > 45 then 0 when p_size > 35 then 1 else 2 end) p from part group by 1, 2, 3), l as (select *, row_number() over (partition by topology_class order by p, metric, knob) r from o) select topology_class, metric, knob, ['queue','backlog','coverage'][p + 1] source, row_number() over (order by p, topology_class, metric, knob) as rank from (select * from l where r <= 6 order by p, topology_class, metric, knob limit 22)"),
    "kg_growth_routing": (lambda s, d: K.growth_routing(view(s, d, "runs").select(F.col("pdk").alias("target"), F.when(F.col("seq") % 2 == 0, F.col("verdict")).otherwise("FLAGGED").alias("verdict"), "topology_class").withColumnRenamed("topology_class", "stage")), ", r as (select pdk target, case when seq % 2 = 0 then verdict else 'FLAGGED' end v, topology_class stage from runs) select target, case when bool_or(v in ('VERIFIED','VERIFIED_WITH_CAVEAT','REFUTED')) then 'project' else 'triage:' || max(stage) end as action from r group by 1"),
    "kg_top_concepts": (lambda s, d: K.top_concepts(view(s, d, "nodes")), "select node_id, name, reinforcement_count from nodes where not coalesce(retracted, false) order by reinforcement_count desc nulls last, node_id limit 20"),
    "kg_hypothesis_status": (lambda s, d: K.hypothesis_status(ins(s, d).select("id", F.lit("open").alias("status")), _refs(s, d).select("id", F.when(F.col("ref") < "chunk_4", "confirms").when(F.col("ref") < "chunk_8", "falsifies").otherwise("unclear").alias("conclusion"), F.col("ref").alias("at")).unionByName(s.createDataFrame([("none", "confirms", "x")], "id string, conclusion string, at string"))), ", r as (select insight_id, unnest(evidence_chunk_ids) ref from insights), c as (select insight_id, arg_max(case when ref < 'chunk_4' then 'confirmed' else 'falsified' end, ref) c from r where ref < 'chunk_8' group by 1) select insight_id id, coalesce(c, 'open') status from insights left join c using (insight_id)"),
    "kg_merged_concepts": (lambda s, d: K.merged_concepts(view(s, d, "nodes").withColumn("description", F.when(F.col("reinforcement_count") % 2 == 0, F.col("description"))), _remap(s, d)), _RM + ", nn as (select node_id, name, case when reinforcement_count % 2 = 0 then description end description from nodes), g as (select survivor_id, min(description) dd, list_sort(list_distinct(list(name))) ns from rm join nn using (node_id) group by 1) select n.node_id, name, coalesce(description, dd) description, array_to_string(list_filter(coalesce(ns, []), lambda a: a <> name), ';') aliases from nn n left join g on g.survivor_id = n.node_id where n.node_id not in (select node_id from rm)"),
    "kg_filled": (lambda s, d: K.filled(view(s, d, "chunks").select("chunk_id", "section_title"), "section_title", F.lit("Untitled")), "select chunk_id, case when coalesce(trim(section_title), '') = '' then 'Untitled' else section_title end section_title from chunks"),
    "kg_embedding_text": (lambda s, d: K.embedding_text(view(s, d, "nodes"), view(s, d, "nodes").filter("label = 'Parameter'")), "select node_id, concat_ws('. ', case when trim(name) <> '' then name end, case when trim(description) <> '' then description end) as text from nodes where label <> 'Parameter'"),
    "kg_specimen_projection": (lambda s, d: K.specimen_projection(view(s, d, "link_requests"), _name_table(s, d))[0], f", n as (select target_label, k, min(node_id) dst_id from {_NT} z group by 1, 2) select distinct source_id_value src_id, rel_type, dst_id from link_requests l join n on n.target_label = l.target_label and n.k = {_NAMEKEY.format('match_text')}"),
    "kg_specimen_unresolved": (lambda s, d: K.specimen_projection(view(s, d, "link_requests"), _name_table(s, d))[1], f", n as (select target_label, k, min(node_id) dst_id from {_NT} z group by 1, 2) select distinct link_id, l.target_label, match_text from link_requests l left join n on n.target_label = l.target_label and n.k = {_NAMEKEY.format('match_text')} where dst_id is null"),
    "kg_superseded": (lambda s, d: K.superseded(view(s, d, "edges").select("src_id", "rel_type", "dst_id", F.when(F.col("rel_type") == "SUB_BLOCK", "proj").alias("origin")), "proj", view(s, d, "edges").filter("rel_type = 'EXTRACTED_FROM'").select("src_id", "rel_type", "dst_id")).groupBy("rel_type", "origin").agg(F.count(F.lit(1)).alias("n")), "select rel_type, null::varchar origin, count(*) n from edges where rel_type <> 'SUB_BLOCK' group by 1 union all select rel_type, 'proj', count(*) from edges where rel_type = 'EXTRACTED_FROM' group by 1"),
    "kg_normalised_proposals": (lambda s, d: K.normalised_proposals(_proposals(s, d)).withColumn("confidence", F.round("confidence", 6)), "select event_id id, ['DEPENDS_ON', 'USES_EQUATION', 'RELATES_TO', null, 'SUB_BLOCK'][event_id % 5 + 1] relation, round(case when value / 300 between 0 and 1 then value / 300 else 0.7e0 end, 6) confidence, case when event_id % 7 = 0 then 'no source' when event_id % 11 = 0 then 'no target' when event_id % 5 = 3 then 'unknown relation' end problem from events"),
    "kg_rejects_by_kind": (lambda s, d: K.normalised_proposals(_proposals(s, d)).filter("problem is not null").groupBy("problem").agg(F.count(F.lit(1)).alias("n")), "select case when event_id % 7 = 0 then 'no source' when event_id % 11 = 0 then 'no target' else 'unknown relation' end problem, count(*) n from events where event_id % 7 = 0 or event_id % 11 = 0 or event_id % 5 = 3 group by 1"),
    "kg_grounding_filter": (lambda s, d: K.grounding_filter(PT._evidence(s, d).filter("section_title is not null").select("chunk_id", F.col("section_title").alias("name")).distinct(), PT._evidence(s, d).select("chunk_id", F.col("section_title").alias("source_name"), F.col("section_title").alias("target_name")).distinct(), view(s, d, "chunks").select("chunk_id", F.col("text_preview").alias("text")))[0], PT._EV + r", g as (select distinct chunk_id, section_title, lower(section_title) n, lower(coalesce(text_preview, '')) t, list_filter(regexp_split_to_array(lower(section_title), '[\s\-_/]+'), lambda w: length(w) >= 3) ws from ev where section_title is not null) select chunk_id, section_title as name from g where contains(t, n) or len(ws) = 0 or len(list_filter(ws, lambda w: contains(t, w))) >= 0.5 * len(ws)"),
    "kg_audit_candidates": (lambda s, d: K.audit_candidates(view(s, d, "nodes")), "select node_id id, coalesce(name, node_id) as name, description from nodes where coalesce(trim(description), '') <> ''"),
    "kg_relink": (lambda s, d: K.relink(PR._relink(s, d), PR._relink(s, d).select("concept_id", "id", F.when(F.col("id") % 4 == 0, "BANNED").otherwise("RELATES_TO").alias("rel_type"), F.repeat(F.lit("why "), 200).alias("rationale")), PR._relink(s, d).filter("id % 5 = 0").select(F.col("concept_id").alias("a"), F.col("id").alias("b")), ["RELATES_TO"]).select("src_id", "rel_type", "dst_id", F.length("rationale").alias("n")), PR._KNN + " select query_id src_id, 'RELATES_TO' rel_type, id dst_id, 500 n from kr where r <= 12 and id % 4 <> 0 and id % 5 <> 0"),
    "kg_first_sweep": (lambda s, d: K.first_sweep(_targets(s, d).select(F.col("topology_class").alias("id"), "knob", F.when(F.col("p_size") % 2 == 0, "gain_db").otherwise("gbw").alias("metric"), F.col("p_partkey").alias("pos")), _targets(s, d).select(F.col("topology_class").alias("id"), "knob", F.when(F.col("topology_class") == "1", "gbw").alias("want_metric")).distinct()), "with t as (select substr(p_brand, 7, 1) id, p_brand knob, case when p_size % 2 = 0 then 'gain_db' else 'gbw' end metric, p_partkey pos from part), x as (select *, row_number() over (partition by id, knob order by pos) r from t where id <> '1' or metric = 'gbw') select id, knob, pos, case when metric = 'gain_db' then 'ratio' else 'delta' end derive from x where r = 1"),
    "kg_enforced": (lambda s, d: K.enforced(view(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 4 == 0, "OTA").otherwise("odd").alias("template"), F.array(F.col("s_suppkey") * 1.0, F.col("s_suppkey") * 2.0).alias("points")), view(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(0.0).alias("min"), F.lit(60.0).alias("max")), ["ota"]), "select s_suppkey id, s_suppkey % 4 = 0 and s_suppkey <= 60 executable, concat_ws(';', case when s_suppkey % 4 <> 0 then 'unknown template' end, case when s_suppkey > 60 then 'clamped 2' when s_suppkey > 30 then 'clamped 1' end, case when s_suppkey > 60 then 'no points' end) reasons from supplier"),
    "kg_edge_rows": (lambda s, d: K.edge_rows(ins(s, d).select("id", F.col("evidence_chunk_ids").alias("related")), "MOTIVATED_BY", 0.8), "select distinct insight_id src_id, 'MOTIVATED_BY' rel_type, e dst_id, 0.8e0 confidence from (select insight_id, unnest(evidence_chunk_ids) e from insights) where trim(coalesce(e, '')) <> ''"),
    "kg_source_digest": (lambda s, d: K.source_digest(view(s, d, "nodes").select(F.coalesce("domain", F.lit("none")).alias("source_id"), "label", "node_id", "name", "description")), ", r as (select *, coalesce(domain, 'none') source_id, row_number() over (partition by coalesce(domain, 'none'), label order by node_id) r from nodes) select source_id, label, count(*) n, string_agg(concat_ws(': ', name, substr(coalesce(description, ''), 1, 150)), chr(10) order by r) as text from r where r <= 20 group by 1, 2"),
    "kg_match_outcomes": (lambda s, d: K.outcomes(__import__("lodeweave.operators.resolution", fromlist=["x"]).tiered_match(PR._best(s, d), low=0.9)), None),
    "kg_chunk_nodes": (lambda s, d: K.registered_chunks(view(s, d, "chunks"))[0], "select 'SourceChunk' label, chunk_id node_id, substr(coalesce(text_preview, ''), 1, 500) preview from chunks"),
    "kg_chunk_edges": (lambda s, d: K.registered_chunks(view(s, d, "chunks"))[1], "select chunk_id src_id, 'EXTRACTED_FROM' rel_type, source_id dst_id from chunks where source_id is not null"),
    "kg_preamble_stripped": (lambda s, d: view(s, d, "supplier").select("s_suppkey", K.preamble_stripped(F.concat(F.when(F.col("s_suppkey") % 2 == 0, "Here is the text:").otherwise("The text:"), F.lit("\n\n"), "s_name")).alias("t")), "select s_suppkey, case when s_suppkey % 2 = 0 then s_name else 'The text:' || chr(10) || chr(10) || s_name end t from supplier"),
    "kg_gap_rows": (lambda s, d: K.gap_rows(ins(s, d).select(F.col("id").alias("doc_id"), F.col("statement").alias("question"), F.when(F.size("evidence_chunk_ids") > 1, "cited").otherwise("none").alias("coverage"), F.filter(F.coalesce("evidence_chunk_ids", F.array().cast("array<string>")), lambda x: x.isNotNull()).alias("missing"))), "select insight_id doc_id, statement question, array_to_string(list_filter(coalesce(evidence_chunk_ids, []), lambda x: x is not null)[1:5], '; ') missing from insights where not coalesce(len(evidence_chunk_ids) > 1, false)"),
    "kg_skill_search": (lambda s, d: K.skill_search(view(s, d, "skill_runs").groupBy("skill_name").agg(F.round(F.avg("duration_seconds"), 3).alias("confidence")).select("skill_name", "confidence", F.lit(None).cast("string").alias("description"), F.array(F.lit("Trim")).alias("keywords")), "c"), ", k as (select skill_name, round(avg(duration_seconds), 3) c from skill_runs group by 1) select skill_name, row_number() over (order by c desc, skill_name) as rank from k where contains(skill_name, 'c')"),
    "kg_skill_run_memories": (lambda s, d: K.skill_run_rows(view(s, d, "skill_runs"))[2], "select 'proc_' || run_id memory_id, 'procedural' layer, 'raw' tier, skill_name || case when success then ' succeeded' else ' failed' end as content from skill_runs"),
    "kg_skill_run_edges": (lambda s, d: K.skill_run_rows(view(s, d, "skill_runs"))[1], "select skill_name src_id, 'EXECUTED' rel_type, run_id::varchar dst_id from skill_runs"),
    "kg_delta_nodes": (lambda s, d: K.applied_delta(view(s, d, "nodes"), view(s, d, "edges"), _new(s, d), _newedges(s, d), ("Concept", "Principle"))["nodes"].groupBy("label").agg(F.count(F.lit(1)).alias("n")), "select label, count(*) * case when label in ('Concept', 'Principle') then 2 else 1 end n from nodes group by label"),
    "kg_delta_rejected": (lambda s, d: K.applied_delta(view(s, d, "nodes"), view(s, d, "edges"), _new(s, d), _newedges(s, d).unionByName(_newedges(s, d).withColumn("dst_id", F.lit("lost"))), ("Concept", "Principle"))["rejected"], "select node_id || 'n' item, 'label' reason from nodes where label = 'Source' union all select src_id || 'n SUB_BLOCK lost', 'endpoint' from edges where rel_type = 'SUB_BLOCK'"),
    "kg_merge_proposals": (lambda s, d: R.merge_proposals(PR._concepts(s, d), PR.VOCAB), PR._CF + f" select case when (ca, id_a) <= (cb, id_b) then id_a else id_b end id_a, case when (ca, id_a) <= (cb, id_b) then id_b else id_a end id_b, rule from (select r.* from {PR._rules('ap')} r join bk using (id_a, id_b)) where same and not list_has_any({_own('name_a', 'ala')}, {_own('name_b', 'alb')})"),
    "kg_false_merge_watch": (lambda s, d: R.false_merge_watch(_watched(s, d), PR.VOCAB), PR._CF + f" select id_a || ' ' || id_b id, array_to_string(list_sort(list_intersect(entsa, entsb)), ' ') shared, array_to_string(list_sort(resta), ' ') rest_a, array_to_string(list_sort(restb), ' ') rest_b from ap join bk using (id_a, id_b) where len(list_intersect(entsa, entsb)) > 0 and not {PR._SAMESET.format('resta', 'restb')}"),
}


def queries() -> dict:
    """Query name -> (spark, sf_dir) -> DataFrame."""
    return {k: f for k, (f, _) in Q.items()}


def oracle_sql() -> dict[str, str]:
    """The same in DuckDB's SQL."""
    return {k: with_views("with " + q.strip()[2:] if q.strip().startswith(", ") else q) for k, (_, q) in Q.items() if q}
