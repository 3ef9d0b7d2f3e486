"""Retrieval, recording and document queries, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodeweave.operators import evidence as V
from lodeweave.operators import recording as W
from lodeweave.operators import resolution as R
from lodeweave.operators import retrieval as G
from lodeweave.operators import text as T
from lodeweave.plans import resolution as PR
from lodeweave.session import ensure_checkpoint_dir
from lodeweave.sources.views import view, with_views
from lodeweave.streaming import events as S

ABBREVIATIONS = {"gbw": "bandwidth", "ldo": "regulator"}


def _questions(s, d):
    """Questions about suppliers and parts: short ones, and long ones with an abbreviation."""
    p = view(s, d, "part").filter("p_partkey % 40 = 0")
    long = F.concat(F.lit("How does LDO behaviour depend on "), "p_name", F.lit(" parts of "), "p_type")
    return p.select(F.col("p_partkey").alias("query_id"), F.when(F.col("p_partkey") % 80 == 0, F.element_at(F.split("p_name", " "), 1)).otherwise(long).alias("query"))


_TERMS = r"""
, q as (select p_partkey query_id, case when p_partkey % 80 = 0 then string_split(p_name, ' ')[1] else 'How does LDO behaviour depend on ' || p_name || ' parts of ' || p_type end query from part where p_partkey % 40 = 0),
qw as (select query_id, trim(query) query, list_filter(list_transform(regexp_extract_all(trim(query), '[A-Za-z][A-Za-z0-9.\-]+'), lambda w: regexp_replace(w, '^[.\-]+|[.\-]+$', '', 'g')), lambda w: length(w) >= 2) ws from q),
qa as (select query_id, query, case when length(query) <= 40 then [query] else list_filter([case when lower(ws[i]) <> lower(ws[i + 1]) then ws[i] || ' ' || ws[i + 1] end for i in range(1, len(ws))], lambda x: x is not null)
  || flatten(list_transform(ws, lambda w: case lower(w) when 'gbw' then [w, 'bandwidth'] when 'ldo' then [w, 'regulator'] else [w] end)) end al from qw),
qt as (select query_id, unnest(list_transform(list_distinct(al), lambda x: {'p': list_position(al, x), 't': x})) u from qa),
tt as (select query_id, u.p pos, u.t term, lower(trim(regexp_replace(u.t, '[-_]', ' ', 'g'))) ph from qt),
kn as (select node_id, name from nodes where not coalesce(retracted, false) and label in ('Concept', 'Equation', 'Principle', 'CircuitTopology', 'Parameter')),
ht as materialized (select tt.*, node_id, name, row_number() over (partition by query_id, pos order by (lower(name) = ph) desc, name, node_id) r from tt join kn on ph <> '' and contains(lower(name), ph)),
fi as (select * from ht where case when length(replace(ph, ' ', '')) <= 2 then r <= 6 and list_contains(regexp_split_to_array(lower(name), '[\s\-_/().,;:]+'), ph) else r <= 2 end),
f2 as (select * from (select *, row_number() over (partition by query_id, pos order by r) r2 from fi) where r2 <= 2),
f3 as (select * from (select *, row_number() over (partition by query_id, coalesce(nullif(lower(trim(name)), ''), node_id) order by pos, r) o from f2) where o = 1),
cx as materialized (select * from (select query_id, node_id, name, term, row_number() over (partition by query_id order by pos, r) as rank from f3) where rank <= 6)"""


def _card_tables(s, d):
    """Claim cards, specimens, parameters and laws: runs, links and topologies."""
    l = view(s, d, "link_requests").filter("source_id_value like '%:%'")
    cards = l.select(F.col("source_id_value").alias("claim_id"), F.when(F.col("link_id") < "link_8", "VERIFIED").otherwise("REFUTED").alias("verdict"), F.lower("target_label").alias("scope"))
    spec = l.select(F.col("source_id_value").alias("claim_id"), F.split("source_id_value", ":")[0].alias("spec_id"), F.lit("ota").alias("topology_class"))
    p = view(s, d, "parameter_nodes").select(F.lower("symbol").alias("k"), F.col("parameter_id").alias("parameter"))
    grounds = l.withColumn("k", F.lower("match_text")).join(p, "k").select(F.col("source_id_value").alias("claim_id"), "parameter")
    law = l.select(F.col("source_id_value").alias("claim_id"), F.concat(F.lit("law_"), F.substring("link_id", -1, 1)).alias("law_id"), F.when(F.col("link_id") < "link_4", "law").otherwise("candidate").alias("status"))
    return cards, spec, grounds, law


_WHY = """
, l as (select * from link_requests where source_id_value like '%:%'),
c as (select source_id_value id, min({'v': case when link_id < 'link_8' then 'VERIFIED' else 'REFUTED' end, 's': lower(target_label)}) c from l group by 1),
g as (select source_id_value id, min(parameter_id) p from l join parameter_nodes on lower(symbol) = lower(match_text) group by 1),
w as (select source_id_value id, string_agg(distinct 'law_' || right(link_id, 1) || '=' || case when link_id < 'link_4' then 'law' else 'candidate' end, ',' order by 'law_' || right(link_id, 1) || '=' || case when link_id < 'link_4' then 'law' else 'candidate' end) laws from l group by 1),
r as (select distinct unnest([source_id_value, source_id_value || 'x']) claim_id from link_requests where source_id_value is not null)
select claim_id, c.id is not null found, c.c.v verdict, coalesce(c.c.v || '@' || c.c.s, '') scoped, case when c.id is not null then split_part(claim_id, ':', 1) end spec_id, case when c.id is not null then 'ota' end topology_class, g.p "grounds", case when c.id is not null then coalesce(laws, '') end laws
from r left join c on c.id = claim_id left join g on g.id = claim_id left join w on w.id = claim_id"""


def _why(s, d):
    l = view(s, d, "link_requests").filter("source_id_value is not null")
    asked = l.select(F.explode(F.array("source_id_value", F.concat("source_id_value", F.lit("x")))).alias("claim_id"))
    return G.why(asked, *_card_tables(s, d))


def _near_text(s, d):
    m = view(s, d, "nodes").filter("label = 'Source'").select("node_id", F.concat(F.lit("the "), "name").alias("mention"))
    e = view(s, d, "edges").filter("rel_type in ('EXTRACTED_FROM', 'SUB_BLOCK')")
    return G.neighbourhood_text(m, view(s, d, "nodes"), e, 2, 6)


_NEAR = """
, e as (select * from edges where rel_type in ('EXTRACTED_FROM', 'SUB_BLOCK')), y as (select src_id a, dst_id b, rel_type, '->' dir, confidence, reinforcement_count from e union all select dst_id, src_id, rel_type, '<-', confidence, reinforcement_count from e),
st as (select node_id st, 'the ' || name m from nodes where label = 'Source'),
h1 as (select * from (select st, b n, 1 dist, rel_type, a via, dir, confidence, reinforcement_count, row_number() over (partition by st, b order by rel_type, a, dir) o from st join y on a = st where b <> st) where o = 1),
h2 as (select * from (select h1.st, y.b n, 2 dist, y.rel_type, y.a via, y.dir, y.confidence, y.reinforcement_count, row_number() over (partition by h1.st, y.b order by y.rel_type, y.a, y.dir) o from h1 join y on y.a = h1.n where y.b <> h1.st and not exists (select 1 from h1 z where z.st = h1.st and z.n = y.b)) where o = 1),
al as (select * from (select *, row_number() over (partition by st order by dist, rel_type, n) r from (select * from h1 union all select * from h2)) where r <= 6)
select al.st node_id, '### Near ' || any_value(m) || chr(10) || string_agg('- ' || rel_type || ' ' || name || ' (conf ' || format('{:.2f}', al.confidence) || ', reinforced ' || al.reinforcement_count || ')', chr(10) order by dist, rel_type, n) as text
from al join nodes on node_id = n join st on st.st = al.st group by 1"""


def _targets(s, d):
    req = view(s, d, "assessments").select("learner_id", F.explode(F.array("target_id", F.lit("nat:3"), F.lit("cus:7"), F.lit("nowhere"))).alias("target_id"))
    nodes = view(s, d, "nodes").select("node_id", "label").unionByName(view(s, d, "assessments").filter("right(target_id, 1) < '5'").select(F.col("target_id").alias("node_id"), F.lit("Concept").alias("label")).distinct())
    had = view(s, d, "assessments").groupBy("learner_id", "target_id").agg(F.count(F.lit(1)).alias("n"), F.max("assessed_at").alias("last_assessed")).withColumn("confidence", F.lit(0.5))
    return G.assessment_targets(req, nodes, had)


def _facts(s, d):
    return view(s, d, "parameter_nodes").select(F.col("parameter_id").alias("subject_id"), F.lit("unit").alias("fact_type"), F.lit("is measured in").alias("predicate"), F.col("units").alias("value"), F.lit(0.9).alias("confidence")).filter("value is not null")


_FACT = "(select distinct parameter_id, units, 'sem_' || substr(sha256(parameter_id || chr(0) || 'unit' || chr(0) || 'is measured in' || chr(0) || units), 1, 12) id from parameter_nodes where units is not null)"


def _session_events(s, d):
    e = view(s, d, "events")
    kind = F.when(F.col("event_id") % 7 == 0, "start").when((F.col("event_id") % 11 == 0) & (F.col("user_id") % 3 > 0), "end").otherwise("note")
    return e.select(F.concat(F.lit("ses_"), F.col("user_id").cast("string")).alias("session_id"), kind.alias("kind"), F.struct("ts", "event_id").alias("at"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("ended by "), F.col("event_id").cast("string"))).alias("summary"))


_SES = """, se as (select 'ses_' || user_id session_id, case when event_id % 7 = 0 then 'start' when event_id % 11 = 0 and user_id % 3 > 0 then 'end' else 'note' end kind, ts, event_id, case when event_id % 2 = 0 then 'ended by ' || event_id end summary from events)"""


def _batch(s, d):
    """A snapshot of nodes and the smaller edges, and a batch over it, through files."""
    ensure_checkpoint_dir(s)
    root = s.sparkContext._jsc.sc().getCheckpointDir().get() + f"/graph_{uuid.uuid4().hex[:8]}"
    n, e = view(s, d, "nodes"), view(s, d, "edges").filter("rel_type <> 'DEPENDS_ON'")
    W.publish(s, root, n, e)
    new = n.filter("label = 'Principle'").withColumn("node_id", F.concat("node_id", F.lit("b")))
    change = n.filter("label = 'Source'").select("label", "node_id", F.lit("renamed").alias("domain"))
    links = e.filter("rel_type = 'EXTRACTED_FROM'").withColumn("src_id", F.concat("src_id", F.when(F.col("dst_id") < "reg:3", "b").otherwise("c")))
    W.write_batch(s, root, new, change, links)
    nodes, edges = W.snapshot(s, root)
    return nodes, edges


_BATCH_N = """, b as (select * from nodes union all select label, node_id || 'b', name, domain, description, confidence, reinforcement_count, retracted from nodes where label = 'Principle')"""


def _items(s, d):
    """Documents as parsed page elements in JSON."""
    l = T.lines(view(s, d, "documents"))
    n = F.col("pos") % 5
    item = F.when(n == 0, F.to_json(F.struct(F.lit("text").alias("type"), F.col("line").alias("text"), F.floor(F.col("pos") / 10).alias("page_idx"), F.when(F.col("pos") % 10 == 0, 1).otherwise(0).alias("text_level"))))
    item = item.when(n == 1, F.to_json(F.struct(F.lit("image").alias("type"), F.array(F.col("line")).alias("image_caption"), F.floor(F.col("pos") / 10).alias("page_idx")))).when(n == 2, F.to_json(F.struct(F.lit("table").alias("type"), F.col("line").alias("table_body"), F.floor(F.col("pos") / 10).alias("page_idx"))))
    return l.select("doc_id", "pos", item.when(n == 3, F.to_json(F.struct(F.lit("code").alias("type"), F.col("line").alias("code_body"), F.lit("c").alias("guess_lang"), F.floor(F.col("pos") / 10).alias("page_idx")))).otherwise("{no json").alias("item"))


_ITEMS = """, ln as (select doc_id, unnest(l) line, generate_subscripts(l, 1) - 1 pos from (select doc_id, string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)) l from documents)),
cb as (select doc_id, pos, ['text', 'image', 'table', 'code'][pos % 5 + 1] "type", case when pos % 5 in (0, 3) then line else '' end "text", case when pos % 5 = 2 then line else '' end html, case when pos % 5 = 1 then trim(line) else '' end caption, pos // 10 page, case when pos % 10 = 0 then 1 else 0 end "level", case when pos % 5 = 3 then 'c' else '' end "language" from ln where pos % 5 < 4)"""


def _figures(s, d):
    b = T.content_blocks(_items(s, d)).filter("type = 'image' and pos % 2 = 1")
    return b.select("doc_id", "page", F.lit("plot").alias("kind"), "caption", F.lit("").alias("footnote"), F.concat(F.lit("seen "), F.col("pos").cast("string")).alias("description"))


def _sections(s, d):
    return T.section_texts(T.content_blocks(_items(s, d)), _figures(s, d))


def _page_texts(s, d):
    return view(s, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\\. ")).alias("page", "text"))


def _run(s, d, fail=False):
    ensure_checkpoint_dir(s)
    root = s.sparkContext._jsc.sc().getCheckpointDir().get() + f"/ingest_{uuid.uuid4().hex[:8]}"
    stream = s.readStream.schema(view(s, d, "events").schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/even[t]s.parquet")
    work = lambda b: b.select("event_id", F.when(F.col("event_id") % 9 == 0, "failed").otherwise("done").alias("status"), F.length("event_type").alias("size"))
    S.ingest(stream, root, work, "event_id")
    S.ingest(s.readStream.schema(view(s, d, "events").schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/[e]vents.parquet"), root, work, "event_id", run="again")
    return S.ingested(s, root, "event_id")


Q = {
    "read_sql": (lambda s, d: G.read(s, "select label, count(*) n from {nodes} where label like :p group by label having count(*) > :least", {"nodes": view(s, d, "nodes")}, {"p": "%c%", "least": 3}), "select label, count(*) n from nodes where label like '%c%' group by label having count(*) > 3"),
    "graph_context_nodes": (lambda s, d: G.context_nodes(_questions(s, d), view(s, d, "nodes"), abbreviations=ABBREVIATIONS), _TERMS + " select query_id, node_id, name, term, rank from cx"),
    "graph_context_neighbours": (lambda s, d: G.graph_context(_questions(s, d), view(s, d, "nodes"), view(s, d, "edges"), hops=1, abbreviations=ABBREVIATIONS)[1], _TERMS + """
        , y as (select src_id a, dst_id b, rel_type, '->' dir from edges union all select dst_id, src_id, rel_type, '<-' from edges), t3 as (select distinct query_id, node_id st from cx where rank <= 3), ds as (select distinct st from t3),
        h as (select st, b n, min({'r': rel_type, 'v': a, 'd': dir}) x from ds join y on a = st where b <> st group by 1, 2),
        k as (select * from (select *, row_number() over (partition by st order by x.r, n) o from h) where o <= 6)
        select query_id, st start_id, n node_id, 1 distance, x.r rel_type from t3 join k using (st)"""),
    "graph_why": (_why, _WHY),
    "graph_neighbourhood_text": (_near_text, _NEAR),
    "learner_targets": (_targets, """
        , r as (select distinct learner_id, unnest([target_id, 'nat:3', 'cus:7', 'nowhere']) target_id from assessments), n as (select node_id, label from nodes union all select distinct target_id, 'Concept' from assessments where right(target_id, 1) < '5'),
        m as (select node_id, min(label) label from n group by 1), u as (select learner_id, target_id, count(*) n from assessments group by 1, 2)
        select r.learner_id, r.target_id, label, case when label is null then 0 else coalesce(u.n, 0) end prior_count, case when label is not null and u.n is not null then 0.5e0 end prior_confidence from r left join m on node_id = r.target_id left join u on u.learner_id = r.learner_id and u.target_id = r.target_id"""),
    "graph_existing_targets": (lambda s, d: G.existing_targets(view(s, d, "edges"), view(s, d, "nodes"), "sup:3", "DEPENDS_ON", "Parameter"), "select distinct dst_id from edges where src_id = 'sup:3' and rel_type = 'DEPENDS_ON' and dst_id in (select node_id from nodes where label = 'Parameter')"),
    "evidence_recipe_sample": (lambda s, d: G.sampled_recipes(view(s, d, "part").select(F.col("p_brand").alias("topology_class"), "p_partkey"), ["Brand#12", "nothing"], ("Brand#11",)).unionByName(G.sampled_recipes(view(s, d, "part").select(F.col("p_brand").alias("topology_class"), "p_partkey"), ["nominal"], ("Brand#11",))), "select p_brand topology_class, p_partkey from part where p_brand in ('Brand#11', 'Brand#12')"),
    "evidence_class_cards": (lambda s, d: G.class_cards(view(s, d, "runs").select("pdk", F.col("claim_id").alias("spec_id"), "claim_id", "verdict", "topology_class", F.substring("claim_id", -1, 1).alias("claim")), "class_2", "3"), "select pdk, claim_id spec_id, claim_id, verdict from runs where topology_class = 'class_2' and right(claim_id, 1) = '3'"),
    "evidence_law_of_shape": (lambda s, d: G.law_of(view(s, d, "part").select(V.law_id(F.col("p_type"), F.col("p_brand"), F.lit("size"), F.lit("value")).alias("law_id"), "p_brand").distinct(), "PROMO", "Brand#13", "size", "value"), "select distinct sha1(p_type || '|' || p_brand || '|size|value') law_id, p_brand from part where p_type = 'PROMO' and p_brand = 'Brand#13'"),
    "evidence_input_pair": (lambda s, d: V.input_pair(view(s, d, "part").select(F.col("p_partkey").alias("id"), F.lit("20u").alias("iref"), F.concat(F.col("p_size").cast("string"), F.lit("u")).alias("w5"), F.lit("4u").alias("w8"), F.lit("1p").alias("cc"), (F.col("p_retailprice") / 1e9).alias("unit_current")), 15.0), """
        select p_partkey id, round(20e-6 * (p_size / 4e0) / 2 * 1e6, 6) id1_ua, round(20e-6 * (p_size / 4e0) / 2 / (p_retailprice / 1e9), 6) m, round(15 * 20e-6 * (p_size / 4e0) / 2 * 1e6, 6) gm1_us, round(15 * 20e-6 * (p_size / 4e0) / 2 / (2 * pi() * 1e-12) / 1e6, 4) gbw_mhz from part"""),
    "memory_facts": (lambda s, d: W.recorded_facts(_facts(s, d))[0].withColumn("tags", F.array_join("tags", ",")), f"select id memory_id, 'semantic' layer, 'curated' tier, 'is measured in: ' || units as content, 'unit,' || parameter_id tags, 0.9e0 confidence from {_FACT} f"),
    "memory_fact_links": (lambda s, d: W.recorded_facts(_facts(s, d))[1], f"select id src_id, 'RELATES_TO' rel_type, parameter_id dst_id, 'is measured in' rationale, 0.8e0 confidence from {_FACT} f"),
    "memory_recorded_lessons": (lambda s, d: W.recorded_lessons(view(s, d, "insights").select(F.when(F.col("reviewed"), F.col("statement")).alias("lesson"), F.when(F.col("bridge_type") == "within-domain", F.array("bridge_type")).alias("tags")).groupBy("lesson").agg(F.max("tags").alias("tags"))).withColumn("tags", F.array_join("tags", ",")), "select 'lesson_' || substr(sha256(statement), 1, 12) memory_id, 'semantic' layer, 'curated' tier, statement as content, 'lesson' || coalesce(max(case when bridge_type = 'within-domain' then ',within-domain' end), '') tags, 0.9e0 confidence from insights where reviewed and trim(statement) <> '' group by statement"),
    "memory_saved": (lambda s, d: W.saved_memories(view(s, d, "memories").select("memory_id", "layer", "tier", "content", "confidence"), view(s, d, "insights").select(F.when(F.col("insight_id") > "insight_8", F.col("insight_id")).alias("memory_id"), F.lit("semantic").alias("layer"), F.lit("raw").alias("tier"), F.col("statement").alias("content"), F.lit(0.5).alias("confidence")).unionByName(view(s, d, "memories").filter("memory_id > 'sem'").select("memory_id", "layer", F.lit("core").alias("tier"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("double").alias("confidence")))), """
        , nw as (select case when insight_id > 'insight_8' then insight_id else 'mem_' || substr(sha256(concat_ws(chr(0), 'semantic', statement)), 1, 12) end memory_id, statement from insights)
        select memory_id, layer, case when memory_id > 'sem' then 'core' else tier end tier, content, confidence from memories where memory_id not in (select memory_id from nw)
        union all select memory_id, 'semantic', 'raw', max(statement), 0.5e0 from nw group by 1"""),
    "memory_links": (lambda s, d: W.memory_links(view(s, d, "memories").select("memory_id", F.element_at(F.array(*map(F.lit, ["session", "entity", "concept", "other"])), (F.length("content") % 4 + 1).cast("int")).alias("kind"), F.when(F.trim("session_id") != "", F.col("session_id")).alias("other_id"), F.lit("why").alias("rationale"))), """
        , k as (select memory_id, session_id o, length(content) % 4 k from memories where trim(session_id) <> '')
        select case when k = 0 then o else memory_id end src_id, case when k = 0 then 'RECORDED' else 'RELATES_TO' end rel_type, case when k = 0 then memory_id else o end dst_id, case when k = 0 then 'recorded in session' else 'why' end rationale, [1e0, 0.8e0, 0.7e0][k + 1] confidence from k where k < 3"""),
    "memory_session_status": (lambda s, d: W.session_rows(_session_events(s, d))[0].select("session_id", F.col("started_at.event_id").alias("first"), F.col("ended_at.event_id").alias("last"), "status", "event_count"), _SES + """
        select session_id, coalesce(arg_min(event_id, (ts, event_id)) filter (where kind = 'start'), arg_min(event_id, (ts, event_id))) "first", arg_max(event_id, (ts, event_id)) filter (where kind = 'end') "last", case when bool_or(kind = 'end') then 'ended' else 'active' end status, count(*) filter (where kind = 'note') event_count from se group by 1"""),
    "memory_session_summaries": (lambda s, d: W.session_rows(_session_events(s, d))[1].select("memory_id", "session_id", "content", "tier", "confidence"), _SES + """
        , x as (select session_id, arg_max(summary, (ts, event_id)) c from se where kind = 'end' and summary is not null group by 1)
        select 'ep_sum_' || substr(sha256(session_id || chr(0) || c), 1, 12) memory_id, session_id, c as content, 'retain' tier, 0.85e0 confidence from x"""),
    "graph_batch_nodes": (lambda s, d: _batch(s, d)[0], _BATCH_N + " select label, node_id, name, case when label = 'Source' then 'renamed' else domain end domain, description, confidence, reinforcement_count, retracted from b"),
    "graph_batch_edges": (lambda s, d: _batch(s, d)[1].select("src_id", "rel_type", "dst_id", "confidence"), "with e as (select * from edges where rel_type <> 'DEPENDS_ON') select src_id, rel_type, dst_id, confidence from e union all select src_id || 'b', rel_type, dst_id, confidence from e where rel_type = 'EXTRACTED_FROM' and dst_id < 'reg:3'"),
    "graph_merge_undo": (lambda s, d: W.unmerged_edges(W.merge_undo(view(s, d, "nodes"), view(s, d, "edges"), _remap(s, d)), "src_id string, rel_type string, dst_id string, confidence double"), "select distinct src_id, rel_type, dst_id, confidence from edges where src_id in (select node_id from nodes where label = 'Concept' and reinforcement_count = 3) or dst_id in (select node_id from nodes where label = 'Concept' and reinforcement_count = 3)"),
    "er_review_queue": (lambda s, d: W.consolidation(PR._concepts(s, d), _said(s, d), PR.VOCAB)["queue"].select("id_a", "id_b", "band", "status"), PR._CP + """
        , dr as (select cl.id_a, cl.id_b, case when band <> 'verify' then band when bk.id_a is null then 'review' when bk.id_a < 'topo_0080' then 'auto' else 'drop' end band from cl left join bk on bk.id_a = cl.id_a and bk.id_b = cl.id_b)
        select id_a, id_b, band, 'pending' status from dr where band in ('review', 'auto')"""),
    "er_consolidation_remap": (lambda s, d: W.consolidation(PR._concepts(s, d), _said(s, d), PR.VOCAB, auto_merge=True)["remap"], None),
    "text_content_blocks": (lambda s, d: T.content_blocks(_items(s, d)).select("doc_id", "pos", "type", "text", "html", "caption", "page", "level", "language"), _ITEMS + " select * from cb"),
    "text_document_pages": (lambda s, d: T.document_pages(T.content_blocks(_items(s, d))), _ITEMS + """ select doc_id, max(page) + 1 total_pages, count(*) n_blocks, count(*) filter (where "type" = 'image') n_figures from cb group by 1"""),
    "text_section_texts": (lambda s, d: _sections(s, d).select("doc_id", "section", "title", "first_page", "last_page", F.length("text").alias("n"), F.size(F.split("text", T.FIGURE_OPEN)).alias("k")), _ITEMS + """
        , b as (select *, sum("level") over (partition by doc_id order by pos rows unbounded preceding) section from cb),
        md as (select *, case "type" when 'text' then case when "level" > 0 then '# ' || "text" else "text" end when 'code' then '```' || chr(10) || "text" || chr(10) || '```' when 'image' then '[Figure: ' || caption || ']' else html end m from b),
        s as (select doc_id, section, coalesce(max(case when "level" > 0 then "text" end), 'Untitled') title, min(page) first_page, max(page) last_page, string_agg(m, chr(10) || chr(10) order by pos) t from md group by 1, 2),
        f as (select doc_id, page p, '[Figure (plot)' || case when caption <> '' then ': ' || caption else '' end || ']' || chr(10) || '<<figure>>seen ' || pos || '<</figure>>' fig from cb where "type" = 'image' and pos % 2 = 1),
        pl as (select f.doc_id, p, fig, min(section) section from f join s on s.doc_id = f.doc_id and p between first_page and last_page group by 1, 2, 3),
        g as (select doc_id, section, string_agg(fig, chr(10) || chr(10) order by p, fig) figs, count(*) k from pl group by 1, 2)
        select s.doc_id, s.section, title, first_page, last_page, length(t) + coalesce(length(figs) + 2, 0) n, coalesce(k, 0) + 1 k from s left join g on g.doc_id = s.doc_id and g.section = s.section"""),
    "text_structured_chunks": (lambda s, d: T.structured_chunks(_sections(s, d), 200, 10).select("doc_id", "section", "pages", "part", "token_estimate"), None),
    "text_page_chunks": (lambda s, d: T.page_chunks(_page_texts(s, d), 300, 10).select("doc_id", "section", "title", "pages", "part", "token_estimate"), None),
    "stream_ingest": (lambda s, d: _run(s, d), "select event_id, case when event_id % 9 = 0 then 'failed' else 'done' end status, length(event_type) as size from events"),
}


def _remap(s, d):
    n = view(s, d, "nodes").filter("label = 'Concept' and reinforcement_count = 3")
    return n.select("node_id", F.lit("sup:1").alias("survivor_id"))


def _said(s, d):
    return R.blocked_pairs(PR._concepts(s, d), PR.VOCAB).select("id_a", "id_b", F.when(F.col("id_a") < "topo_0080", "SAME").otherwise("DIFFERENT").alias("verdict"))


def queries() -> dict:
    """Query name -> (spark, sf_dir) -> DataFrame."""
    return {k: f for k, (f, _) in Q.items()}


def oracle_sql() -> dict[str, str]:
    """The same in DuckDB's SQL."""
    return {k: with_views("with " + q.strip()[2:] if q.strip().startswith(", ") else q) for k, (_, q) in Q.items() if q}
