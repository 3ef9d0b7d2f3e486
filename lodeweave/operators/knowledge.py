"""Composites over the knowledge graph: displays, evidence listings, proposals, growth plans, registration.

Built from joins and windows; lists are gathered only per item, with their length bounded by a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The names of the id columns.
ID_FIELDS = {"Concept": "concept_id", "Equation": "equation_id", "Principle": "principle_id", "CircuitTopology": "topology_id", "Parameter": "parameter_id", "Source": "source_id", "SourceChunk": "chunk_id", "Insight": "insight_id", "Memory": "memory_id", "ClaimCard": "claim_id", "Specimen": "spec_id", "Regularity": "law_id", "Learner": "learner_id", "Assessment": "assessment_id"}
PROTECTED = ("name", "label", "confidence", "retracted", "created_at")
RELATIONS = {"depends on": "DEPENDS_ON", "depends-on": "DEPENDS_ON", "uses": "USES_EQUATION", "part of": "SUB_BLOCK"}


def display(label: Column, node_id: Column, name: Column, description: Column) -> Column:
    """What a node is shown as: its name, or 60 characters of its description, or its id."""
    return F.coalesce(F.when(F.trim(name) != "", name), F.when(F.trim(description) != "", F.substring(description, 1, 60)), F.concat_ws(" ", label, node_id))


def snake_title(c: Column, upper: list[str]) -> Column:
    """snake_case as title words; words of the list in capitals."""
    ws = F.transform(F.split(F.lower(c), "[_ ]+"), lambda w: F.when(w.isin(*upper), F.upper(w)).otherwise(F.initcap(w)))
    return F.array_join(F.filter(ws, lambda w: w != ""), " ")


def citation_level(chunk_ids: Column, source_id: Column) -> tuple[Column, Column]:
    """chunk, source or derived, and at most three chunk ids."""
    ids = F.slice(F.filter(F.coalesce(chunk_ids, F.array().cast("array<string>")), lambda x: F.coalesce(F.trim(x) != "", F.lit(False))), 1, 3)
    return F.when(F.size(ids) > 0, "chunk").when(F.coalesce(source_id, F.lit("")) != "", "source").otherwise("derived"), ids


def proposed_properties(props: Column) -> Column:
    """A map without protected keys, ids and private keys."""
    return F.map_filter(props, lambda k, v: ~k.isin(*PROTECTED) & ~k.endswith("_id") & ~k.startswith("_"))


def scalar_text(values: Column) -> Column:
    """The non-blank items joined by ' ; '."""
    return F.array_join(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.coalesce(F.trim(x) != "", F.lit(False))), " ; ")


def coerced(values: Column) -> Column:
    """struct(kind, items): nulls dropped; all integers stay, all numbers become doubles, else strings (of an array of JSON scalars)."""
    v = F.filter(values, lambda x: x.isNotNull() & (x != "null"))
    ints, nums = F.forall(v, lambda x: x.rlike(r"^-?\d+$")), F.forall(v, lambda x: x.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"))
    return F.struct(F.when(ints, "int").when(nums, "double").otherwise("string").alias("kind"), F.when(ints | ~nums, v).otherwise(F.transform(v, lambda x: x.try_cast("double").cast("string"))).alias("items"))


def layered(items: DataFrame, layers: DataFrame) -> DataFrame:
    """items(id, domain) with the layer of their domain by the table layers(domain, layer), whatever case and blanks; -1 for unknown ones."""
    key = lambda c: F.lower(F.trim(c))
    of = layers.select(key("domain").alias("__k"), F.col("layer")).groupBy("__k").agg(F.min("layer").alias("layer"))
    return items.withColumn("__k", key("domain")).join(of, "__k", "left").withColumn("layer", F.coalesce("layer", F.lit(-1))).drop("__k")


def with_names(items: DataFrame, refs: DataFrame, names: DataFrame) -> DataFrame:
    """(id, names): left join of items(id) through refs(id, ref) to names(ref, name), sorted distinct names, '' for none."""
    g = refs.join(names.select("ref", "name"), "ref").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("name")), "; ").alias("names"))
    return items.join(g, "id", "left").select("id", F.coalesce("names", F.lit("")).alias("names"))


def open_items(items: DataFrame, refs: DataFrame, wanted: DataFrame, limit: int = 5) -> DataFrame:
    """The most confident items that refer to any wanted ref, each once."""
    hit = refs.join(wanted.select("ref").distinct(), "ref", "left_semi").select("id").distinct()
    return items.join(hit, "id", "left_semi").orderBy(F.desc_nulls_last("confidence"), "id").limit(limit)


def specimen_evidence(links: DataFrame, laws: DataFrame) -> DataFrame:
    """(spec_id, n_claims, claims, laws): claims of link requests per specimen, and the law ids of their targets.

    Laws are aggregated per target before the join, claims per specimen after it."""
    spec = links.select(F.split("source_id_value", ":")[0].alias("spec_id"), F.when(F.col("source_id_value").contains(":"), F.col("source_id_value")).alias("claim_id"), "target")
    per = laws.groupBy("target").agg(F.min("law_id").alias("law_id"))
    j = spec.join(per, "target", "left")
    return j.groupBy("spec_id").agg(F.count_distinct("claim_id").alias("n_claims"), F.array_join(F.array_sort(F.collect_set("claim_id")), ",").alias("claims"), F.array_join(F.array_sort(F.collect_set("law_id")), ",").alias("laws"))


def why_law(laws: DataFrame, runs: DataFrame) -> DataFrame:
    """(claim_id, reason, pdk, verdict, card): a law's members by process, the smallest card of each class and process with them."""
    cards = runs.groupBy("topology_class", "pdk").agg(F.min("claim_id").alias("card"))
    last = runs.groupBy("claim_id", "topology_class", "pdk").agg(F.max_by("verdict", "seq").alias("verdict"))
    return laws.select("claim_id", "topology_class", "reason").join(last, ["claim_id", "topology_class"], "left").join(cards, ["topology_class", "pdk"], "left").select("claim_id", "reason", "pdk", "verdict", "card")


def phrase_window(phrases: DataFrame, nodes: DataFrame, degrees: DataFrame, limit: int = 40) -> DataFrame:
    """(phrase, node_id, rank): nodes whose name holds a word of the phrase (of three letters at least, inside longer words too), by degree, then name.

    Words meet names through an index of pieces of names, so no name is compared with every phrase."""
    from lodeweave.operators.retrieval import containing

    words = phrases.select("phrase", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("phrase"), F.lit("[a-z0-9]{3,}"), F.lit(0)))).alias("w"))
    held = containing(words.select(F.col("w").alias("phrase")), nodes).withColumnRenamed("phrase", "w")
    hit = words.join(held, "w").select("phrase", "node_id", "name").distinct().join(degrees, "node_id", "left")
    w = Window.partitionBy("phrase").orderBy(F.desc_nulls_last("degree"), "name", "node_id")
    return hit.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("phrase", "node_id", "rank")


def first_evidence(items: DataFrame, chunks: DataFrame, n: int = 3) -> DataFrame:
    """(id, pos, chunk_id, text): the first n distinct chunk ids of an item, with the chunk's text if known."""
    e = items.select("id", F.posexplode(F.slice(F.array_distinct(F.filter("chunk_ids", lambda x: x.isNotNull())), 1, n)).alias("pos", "chunk_id"))
    return e.join(chunks.select("chunk_id", F.col("text_preview").alias("text")), "chunk_id", "left").select("id", "pos", "chunk_id", "text")


def coverage(targets: DataFrame, covered: DataFrame) -> DataFrame:
    """(topology_class, total, done, uncovered) of distinct targets(topology_class, metric, knob)."""
    k = ["topology_class", "metric", "knob"]
    t = targets.select(*k).distinct()
    j = t.join(covered.select(*k).distinct().withColumn("c", F.lit(1)), k, "left")
    return j.groupBy("topology_class").agg(F.count(F.lit(1)).alias("total"), F.count("c").alias("done")).withColumn("uncovered", F.col("total") - F.col("done"))


def growth_plan(candidates: DataFrame, per_class: int, cap: int) -> DataFrame:
    """(topology_class, metric, knob, source, rank): queue before backlog before coverage, a budget per class, a cap over all.

    A target wanted by several sources counts for the first; candidates: topology_class, metric, knob, source."""
    pri = F.when(F.col("source") == "queue", 0).when(F.col("source") == "backlog", 1).otherwise(2)
    once = candidates.groupBy("topology_class", "metric", "knob").agg(F.min(pri).alias("p"))
    w = Window.partitionBy("topology_class").orderBy("p", "metric", "knob")
    local = once.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= per_class)
    top = local.orderBy("p", "topology_class", "metric", "knob").limit(cap)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("p", "topology_class", "metric", "knob"))).select("topology_class", "metric", "knob", F.element_at(F.array(*map(F.lit, ["queue", "backlog", "coverage"])), F.col("p") + 1).alias("source"), "rank")


def growth_routing(results: DataFrame) -> DataFrame:
    """(target, action): any affirmed or refuted verdict projects; else triage by the furthest stage."""
    decided = F.bool_or(F.col("verdict").isin("VERIFIED", "VERIFIED_WITH_CAVEAT", "REFUTED"))
    return results.groupBy("target").agg(F.when(decided, "project").otherwise(F.concat(F.lit("triage:"), F.max("stage"))).alias("action"))


def top_concepts(nodes: DataFrame, limit: int = 20) -> DataFrame:
    """Most reinforced first, then by id."""
    return nodes.filter(~F.coalesce("retracted", F.lit(False))).orderBy(F.desc_nulls_last("reinforcement_count"), "node_id").limit(limit).select("node_id", "name", "reinforcement_count")


def hypothesis_status(hypotheses: DataFrame, results: DataFrame) -> DataFrame:
    """(id, status): confirmed or falsified by the latest conclusive result; results of unknown ids change nothing."""
    r = results.filter(F.col("conclusion").isin("confirms", "falsifies")).groupBy("id").agg(F.max_by("conclusion", "at").alias("c"))
    return hypotheses.join(r, "id", "left").select("id", F.when(F.col("c") == "confirms", "confirmed").when(F.col("c") == "falsifies", "falsified").otherwise(F.col("status")).alias("status"))


def merged_concepts(nodes: DataFrame, remap: DataFrame) -> DataFrame:
    """(node_id, name, description, aliases): survivors with gaps filled from their duplicates and the duplicates' names as aliases; duplicates gone."""
    d = remap.join(nodes.select("node_id", F.col("name").alias("dn"), F.col("description").alias("dd")), "node_id")
    g = d.groupBy("survivor_id").agg(F.array_sort(F.collect_set("dn")).alias("names"), F.min("dd").alias("dd"))
    kept = nodes.join(remap.select("node_id"), "node_id", "left_anti").join(g.withColumnRenamed("survivor_id", "node_id"), "node_id", "left")
    al = F.filter(F.coalesce("names", F.array().cast("array<string>")), lambda a: ~a.eqNullSafe(F.col("name")))
    return kept.select("node_id", "name", F.coalesce("description", "dd").alias("description"), F.array_join(al, ";").alias("aliases"))


def filled(rows: DataFrame, column: str, source: Column) -> DataFrame:
    """column filled from source where null or blank."""
    return rows.withColumn(column, F.when(F.coalesce(F.trim(column), F.lit("")) == "", source).otherwise(F.col(column)))


def embedding_text(nodes: DataFrame, have: DataFrame, force: bool = False) -> DataFrame:
    """(node_id, text) 'name. description' of nodes to encode: those without a vector, or all."""
    todo = nodes if force else nodes.join(have.select("node_id"), "node_id", "left_anti")
    return todo.select("node_id", F.concat_ws(". ", F.when(F.trim("name") != "", F.col("name")), F.when(F.trim("description") != "", F.col("description"))).alias("text"))


def embedded(todo: DataFrame, encode, dim: int) -> DataFrame:
    """(node_id, embedding) of todo(node_id, text): ``encode`` takes a list of texts and gives a vector of ``dim`` values for each, batch by batch.

    A text that is null or empty, or whose vector has another length, gets none."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            ids, texts = batch.column("node_id").to_pylist(), batch.column("text").to_pylist()
            at = [i for i, t in enumerate(texts) if t]
            made = encode([texts[i] for i in at]) if at else []
            rows = [(ids[i], [float(x) for x in v]) for i, v in zip(at, made) if v is not None and len(v) == dim]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.float32()))], names=["node_id", "embedding"])

    return todo.select(F.col("node_id").cast("string").alias("node_id"), "text").mapInArrow(run, "node_id string, embedding array<float>")


def specimen_projection(links: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, unresolved): link requests whose text names a target become edges; the others are returned.

    names: target_label, key, node_id, the smallest node for a name."""
    from lodeweave.operators.references import name_key

    n = names.groupBy("target_label", "key").agg(F.min("node_id").alias("dst_id"))
    j = links.withColumn("key", name_key(F.col("match_text"))).join(n, ["target_label", "key"], "left")
    edges = j.filter("dst_id is not null").select(F.col("source_id_value").alias("src_id"), "rel_type", "dst_id").distinct()
    return edges, j.filter("dst_id is null").select("link_id", "target_label", "match_text").distinct()


def superseded(edges: DataFrame, stamp: str, fresh: DataFrame) -> DataFrame:
    """Edges without those stamped by the same projector, plus the fresh ones."""
    return edges.filter(~F.col("origin").eqNullSafe(F.lit(stamp))).unionByName(fresh.withColumn("origin", F.lit(stamp)))


def normalised_proposals(raw: DataFrame) -> DataFrame:
    """(id, relation, confidence, problem): relations by name whatever the spelling, confidence within [0, 1] or .7, and why a row is dropped."""
    m = F.create_map(*(F.lit(x) for kv in RELATIONS.items() for x in kv))
    r = F.lower(F.trim("relation"))
    rel = F.coalesce(m[r], F.when(F.upper("relation").rlike("^[A-Z_]+$"), F.upper("relation")))
    conf = F.coalesce(F.when(F.col("confidence").between(0, 1), F.col("confidence")), F.lit(0.7))
    why = F.when(F.coalesce(F.trim("source"), F.lit("")) == "", "no source").when(F.coalesce(F.trim("target"), F.lit("")) == "", "no target").when(rel.isNull(), "unknown relation")
    return raw.select("id", rel.alias("relation"), conf.alias("confidence"), why.alias("problem"))


def grounding_filter(concepts: DataFrame, edges: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(concepts, edges) that their chunk's text supports: concepts(chunk_id, name), edges(chunk_id, source_name, target_name).

    What stands between figure marks was described from a picture and supports nothing."""
    from lodeweave.operators.text import FIGURE_CLOSE, FIGURE_OPEN, edges_grounded, grounded

    own = F.regexp_replace("text", f"(?s)\\Q{FIGURE_OPEN}\\E.*?(\\Q{FIGURE_CLOSE}\\E|$)", " ")
    kept = concepts.join(texts.select("chunk_id", own.alias("text")), "chunk_id").filter(grounded(F.col("name"), F.col("text"))).select("chunk_id", "name")
    return kept, edges_grounded(edges, kept)


def audit_candidates(nodes: DataFrame) -> DataFrame:
    """Nodes with a description, under the fields an audit shows."""
    return nodes.filter(F.coalesce(F.trim("description"), F.lit("")) != "").select(F.col("node_id").alias("id"), F.coalesce("name", "node_id").alias("name"), "description")


def relink(candidates: DataFrame, decisions: DataFrame, linked: DataFrame, allowed: list[str]) -> DataFrame:
    """Edges of valid decisions: known pair, not itself, allowed type, still unlinked; rationale cut at 500 characters."""
    ok = decisions.filter(F.col("rel_type").isin(*allowed) & (F.col("concept_id") != F.col("id"))).join(candidates.select("concept_id", "id"), ["concept_id", "id"], "left_semi")
    free = ok.join(linked.select(F.col("a").alias("concept_id"), F.col("b").alias("id")), ["concept_id", "id"], "left_anti")
    return free.select(F.col("concept_id").alias("src_id"), "rel_type", F.col("id").alias("dst_id"), F.substring("rationale", 1, 500).alias("rationale"), F.lit("relink").alias("origin"))


def first_sweep(sweeps: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, knob, pos, derive): the first sweep of an id with the wanted knob, and the metric if one is wanted."""
    j = wanted.join(sweeps, ["id", "knob"]).filter(F.col("want_metric").isNull() | (F.col("want_metric") == F.col("metric")))
    w = Window.partitionBy("id", "knob").orderBy("pos")
    return j.withColumn("r", F.row_number().over(w)).filter("r = 1").select("id", "knob", "pos", F.when(F.col("metric").endswith("_db"), "ratio").otherwise("delta").alias("derive"))


def scaled_area(c: Column, factor: float) -> Column:
    """A number with unit suffix, scaled, the suffix kept."""
    n, u = F.regexp_extract(c, r"^([+-]?[0-9.]+)(.*)$", 1), F.regexp_extract(c, r"^([+-]?[0-9.]+)(.*)$", 2)
    return F.concat(F.round(n.try_cast("double") * factor, 6).cast("string"), u)


def enforced(recipes: DataFrame, ranges: DataFrame, templates: list[str]) -> DataFrame:
    """(id, executable, reasons): template snapped to a known one, points clamped, every drop told."""
    from lodeweave.operators.evidence import sweep_clamp

    c = sweep_clamp(recipes.select("id", F.explode("points").alias("point")), ranges)
    known = F.lower("template").isin(*templates)
    j = recipes.join(c, "id", "left")
    why = F.filter(F.array(F.when(~known, "unknown template"), F.when(F.col("n_dropped") > 0, F.concat(F.lit("clamped "), F.col("n_dropped").cast("string"))), F.when(F.coalesce("n_kept", F.lit(0)) == 0, "no points")), lambda x: x.isNotNull())
    return j.select("id", (known & (F.coalesce("n_kept", F.lit(0)) > 0)).alias("executable"), F.array_join(why, ";").alias("reasons"))


def edge_rows(items: DataFrame, rel_type: str, confidence: float) -> DataFrame:
    """(src_id, rel_type, dst_id, confidence): one edge per related id of items(id, related)."""
    return items.select(F.col("id").alias("src_id"), F.lit(rel_type).alias("rel_type"), F.explode(F.array_distinct(F.filter("related", lambda x: F.coalesce(F.trim(x) != "", F.lit(False))))).alias("dst_id"), F.lit(confidence).alias("confidence"))


def source_digest(members: DataFrame, per_label: int = 20) -> DataFrame:
    """(source_id, label, n, text): at most 20 nodes of each label, descriptions cut at 150 characters."""
    w = Window.partitionBy("source_id", "label").orderBy("node_id")
    top = members.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= per_label)
    line = F.concat_ws(": ", "name", F.substring(F.coalesce("description", F.lit("")), 1, 150))
    g = top.groupBy("source_id", "label").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("r", line.alias("l")))).alias("x"))
    return g.select("source_id", "label", "n", F.array_join(F.transform("x", lambda s: s["l"]), "\n").alias("text"))


def outcomes(matches: DataFrame) -> DataFrame:
    """(outcome, n, n_chunks): how the mentions of a batch divide."""
    return matches.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("chunk_id").alias("n_chunks"))


def registered_chunks(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): chunk nodes with 500 characters of text, EXTRACTED_FROM edges of those with a source."""
    n = chunks.select(F.lit("SourceChunk").alias("label"), F.col("chunk_id").alias("node_id"), F.substring(F.coalesce("text_preview", F.lit("")), 1, 500).alias("preview"))
    return n, chunks.filter("source_id is not null").select(F.col("chunk_id").alias("src_id"), F.lit("EXTRACTED_FROM").alias("rel_type"), F.col("source_id").alias("dst_id"))


def preamble_stripped(c: Column) -> Column:
    """A short first paragraph that only leads in goes, if content follows."""
    first, rest = F.substring_index(c, "\n\n", 1), F.regexp_replace(c, r"(?s)^.*?\n\n", "")
    lead = (F.length(first) < 200) & F.lower(first).rlike(r"^(here is|here are|sure|certainly|below is|the following)\b")
    return F.when(c.contains("\n\n") & lead & (F.trim(rest) != ""), F.trim(rest)).otherwise(c)


def gap_rows(answers: DataFrame) -> DataFrame:
    """(doc_id, question, missing): at most five missing items of answers without coverage, for an append sink."""
    return answers.filter("coverage = 'none'").select("doc_id", "question", F.array_join(F.slice("missing", 1, 5), "; ").alias("missing"))


def skill_search(skills: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Skills whose name, description or a keyword holds the query, the ``limit`` most confident by rank."""
    q = query.lower()
    hit = F.lower("skill_name").contains(q) | F.coalesce(F.lower("description").contains(q), F.lit(False)) | F.exists("keywords", lambda k: F.lower(k).contains(q))
    return skills.filter(hit).orderBy(F.desc("confidence"), "skill_name").limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("confidence"), "skill_name"))).select("skill_name", "rank")


def skill_run_rows(runs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, memories) that one recorded run becomes."""
    n = runs.select(F.lit("SkillRun").alias("label"), F.col("run_id").cast("string").alias("node_id"), "skill_name", "success")
    e = runs.select(F.col("skill_name").alias("src_id"), F.lit("EXECUTED").alias("rel_type"), F.col("run_id").cast("string").alias("dst_id"))
    m = runs.select(F.concat(F.lit("proc_"), F.col("run_id").cast("string")).alias("memory_id"), F.lit("procedural").alias("layer"), F.lit("raw").alias("tier"), F.concat_ws(" ", "skill_name", F.when(F.col("success"), "succeeded").otherwise("failed")).alias("content"))
    return n, e, m


def applied_delta(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, allowed: tuple[str, ...]) -> dict[str, DataFrame]:
    """nodes, edges and rejected of one change set: labels outside the list and edges without their ends are rejected, with a reason."""
    from lodeweave.operators.graph import merge_edges, merge_nodes

    ok = new_nodes.filter(F.col("label").isin(*allowed) & F.col("node_id").isNotNull())
    n = merge_nodes(nodes, ok)
    e, lost = merge_edges(edges, new_edges, n)
    bad = new_nodes.filter(~(F.col("label").isin(*allowed) & F.col("node_id").isNotNull())).select(F.coalesce("node_id", F.lit("")).alias("item"), F.lit("label").alias("reason"))
    return {"nodes": n, "edges": e, "rejected": bad.unionByName(lost.select(F.concat_ws(" ", "src_id", "rel_type", "dst_id").alias("item"), F.lit("endpoint").alias("reason")))}
