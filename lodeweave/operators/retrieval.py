"""Reading from the graph: parameterised SQL, context of a question, provenance of a claim, neighbourhoods as text.

Substrings are found through an index of pieces of names, so no question is compared with every name.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.operators.graph import KNOWLEDGE_LABELS, live, neighbourhood
from lodeweave.operators.skew import maybe_in
from lodeweave.operators.text import query_terms
from lodeweave.session import cut

_READS = re.compile(r"\s*(?:select|with|values|from|table)\b", re.I)


def read(spark: SparkSession, text: str, tables: dict[str, DataFrame], args: dict | None = None) -> DataFrame:
    """Any one query over the given tables, named in braces, with :name parameters. Anything but a query is refused."""
    if not _READS.match(text):
        raise ValueError("only queries are read")
    return spark.sql(text, args=args or {}, **tables)


LONG = 6  # letters of the pieces that stand for phrases of as many letters or more


def containing(phrases: DataFrame, names: DataFrame) -> DataFrame:
    """(phrase, node_id, name) of all names(node_id, name) that hold a phrase of phrases(phrase), both compared in small letters.

    A phrase meets the names through its rarest piece of ``LONG`` letters (of three, if it is shorter; a phrase of one or two letters
    is its own piece), then the whole is verified. Pieces of names that no phrase asks for go where they are made; what is
    left is many times the names, which no estimate of sizes sees, so it is never the side that is broadcast."""
    low = names.filter("name is not null").select("node_id", "name", F.lower("name").alias("low"))
    p = phrases.select("phrase").distinct().withColumn("want", F.lower("phrase")).filter("length(want) > 0")
    p = p.withColumn("size", F.when(F.length("want") >= LONG, LONG).otherwise(F.least(F.length("want"), F.lit(3))))
    pieces = lambda df, c: df.withColumn("i", F.explode(F.sequence(F.lit(1), F.length(c) - F.col("size") + 1))).withColumn("gram", F.substring(c, F.col("i"), F.col("size")))
    own = pieces(p, "want").select("phrase", "want", "gram").distinct()
    sizes = F.broadcast(p.select("size").distinct())  # four at most
    index = pieces(low.join(sizes, F.length("low") >= F.col("size")), "low")
    counts = maybe_in(index.select("gram"), own, "gram").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rare = own.join(counts.hint("merge"), "gram", "left")
    rare = rare.groupBy("phrase", "want").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))["gram"].alias("gram"))
    once = maybe_in(index, rare, "gram").filter(F.instr("low", F.col("gram")) == F.col("i")).select("gram", "node_id", "name", "low")
    return rare.join(once.hint("merge"), "gram").filter(F.col("low").contains(F.col("want"))).select("phrase", "node_id", "name")


def context_nodes(questions: DataFrame, nodes: DataFrame, per_term: int = 2, limit: int = 6, abbreviations: dict[str, str] | None = None) -> DataFrame:
    """(query_id, node_id, name, term, rank) of questions(query_id, query): per search term the first ``per_term`` nodes whose name holds it.

    A term of two letters looks at four more and keeps those that have it as a word. Terms come in their
    order, exact names first, then by name and id; a node counts once by id and once by name, ``limit`` per question."""
    t = questions.select("query_id", F.posexplode(query_terms(F.col("query"), abbreviations)).alias("pos", "term"))
    t = t.withColumn("phrase", F.lower(F.trim(F.regexp_replace("term", "[-_]", " ")))).withColumn("short", F.length(F.replace("phrase", F.lit(" "))) <= 2)
    known = live(nodes).filter(F.col("label").isin(*KNOWLEDGE_LABELS)).select("node_id", "name")
    order = [F.when(F.lower("name") == F.col("phrase"), 0).otherwise(1), F.col("name"), F.col("node_id")]
    # The order of its names is a phrase's own, so each is cut to the names that any question can show before the questions meet it.
    hit = containing(t.select("phrase"), known).withColumn("r0", F.row_number().over(Window.partitionBy("phrase").orderBy(*order))).filter(F.col("r0") <= per_term + 4).drop("r0")
    hit = t.join(hit.hint("merge"), "phrase")
    w = Window.partitionBy("query_id", "pos").orderBy(*order)
    first = hit.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= F.when(F.col("short"), per_term + 4).otherwise(per_term))
    whole = F.array_contains(F.split(F.lower("name"), r"[\s\-_/().,;:]+"), F.col("phrase"))
    kept = first.filter(~F.col("short") | whole).withColumn("r2", F.row_number().over(Window.partitionBy("query_id", "pos").orderBy("r"))).filter(F.col("r2") <= per_term)
    once = kept.withColumn("key", F.when(F.trim("name") != "", F.lower(F.trim("name"))).otherwise(F.col("node_id")))
    once = once.groupBy("query_id", "key").agg(F.min(F.struct("pos", "r", "node_id", "name", "term")).alias("x"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("x.pos", "x.r"))).filter(F.col("rank") <= limit)
    return ranked.select("query_id", "x.node_id", "x.name", "x.term", "rank")


def graph_context(questions: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = 6, expand: int = 3, hops: int = 2, abbreviations: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(concepts, neighbours): ``context_nodes`` of each question, and the neighbourhood of its first ``expand``: (query_id, start_id, node_id, distance, rel_type)."""
    found = cut(context_nodes(questions, nodes, limit=limit, abbreviations=abbreviations))  # at most ``limit`` rows a question, read three times
    top = found.filter(F.col("rank") <= expand).select("query_id", F.col("node_id").alias("start_id"))
    near = neighbourhood(edges, top.select(F.col("start_id").alias("node_id")).distinct(), hops, limit)
    return found, top.join(near, "start_id").select("query_id", "start_id", "node_id", "distance", "rel_type")


def why(requests: DataFrame, cards: DataFrame, specimens: DataFrame, grounds: DataFrame, support: DataFrame) -> DataFrame:
    """(claim_id, found, verdict, scoped, spec_id, topology_class, grounds, laws) of requests(claim_id): the evidence behind a claim card.

    cards: claim_id, verdict, scope; specimens: claim_id, spec_id, topology_class; grounds: claim_id, parameter;
    support: claim_id, law_id, status. Of several specimens or parameters the smallest is shown, laws all as
    law=status; each table is reduced to a row per claim before the join. scoped is verdict@scope."""
    c = cards.groupBy("claim_id").agg(F.min(F.struct("verdict", "scope")).alias("c"), F.lit(True).alias("known"))
    s = specimens.groupBy("claim_id").agg(F.min(F.struct("spec_id", "topology_class")).alias("s"))
    g = grounds.groupBy("claim_id").agg(F.min("parameter").alias("grounds"))
    l = support.groupBy("claim_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("=", "law_id", "status"))), ",").alias("laws"))
    j = requests.select("claim_id").distinct().join(c, "claim_id", "left").join(s, "claim_id", "left").join(g, "claim_id", "left").join(l, "claim_id", "left")
    known = F.coalesce("known", F.lit(False))
    shown = lambda x: F.when(known, x)
    return j.select("claim_id", known.alias("found"), F.col("c.verdict").alias("verdict"), F.concat_ws("@", "c.verdict", "c.scope").alias("scoped"), shown(F.col("s.spec_id")).alias("spec_id"), shown(F.col("s.topology_class")).alias("topology_class"), shown(F.col("grounds")).alias("grounds"), shown(F.coalesce("laws", F.lit(""))).alias("laws"))


def neighbourhood_text(matched: DataFrame, nodes: DataFrame, edges: DataFrame, hops: int = 2, limit: int = 6) -> DataFrame:
    """(node_id, text) of matched(node_id, mention): a heading and a line per neighbour: relation, name, confidence and reinforcement of the last edge."""
    m = matched.groupBy("node_id").agg(F.min("mention").alias("mention"))
    near = neighbourhood(edges, m.select("node_id"), hops, limit)
    back = F.col("direction") == "<-"
    ends = near.select("start_id", "node_id", "distance", "rel_type", F.when(back, F.col("node_id")).otherwise(F.col("via")).alias("src_id"), F.when(back, F.col("via")).otherwise(F.col("node_id")).alias("dst_id"))
    e = edges.groupBy("src_id", "rel_type", "dst_id").agg(F.max("confidence").alias("confidence"), F.max("reinforcement_count").alias("reinforcement_count"))
    names = nodes.groupBy("node_id").agg(F.min("name").alias("name"), F.min("label").alias("label"))
    j = ends.join(e, ["src_id", "rel_type", "dst_id"], "left").join(names, "node_id", "left")
    line = F.concat(F.lit("- "), "rel_type", F.lit(" "), F.coalesce(F.when(F.trim("name") != "", F.col("name")), F.col("label"), F.col("node_id")), F.lit(" (conf "), F.coalesce(F.format_number("confidence", 2), F.lit("?")), F.lit(", reinforced "), F.coalesce(F.col("reinforcement_count").cast("string"), F.lit("0")), F.lit(")"))
    g = j.groupBy("start_id").agg(F.array_sort(F.collect_list(F.struct("distance", "rel_type", "node_id", line.alias("l")))).alias("x"))
    return g.join(m, g["start_id"] == m["node_id"]).select("node_id", F.concat(F.lit("### Near "), F.coalesce("mention", "node_id"), F.lit("\n"), F.array_join(F.transform("x", lambda s: s["l"]), "\n")).alias("text"))


def assessment_targets(requests: DataFrame, nodes: DataFrame, understands: DataFrame) -> DataFrame:
    """(learner_id, target_id, label, prior_count, prior_confidence) of requests(learner_id, target_id): the node of any label with the id
    (the first label of several; null for none, so that no edge is invented) and what the learner has on it."""
    n = nodes.groupBy(F.col("node_id").alias("target_id")).agg(F.min("label").alias("label"))
    u = understands.groupBy("learner_id", "target_id").agg(F.sum("n").alias("n"), F.max_by("confidence", "last_assessed").alias("confidence"))
    j = requests.select("learner_id", "target_id").distinct().join(n, "target_id", "left").join(u, ["learner_id", "target_id"], "left")
    known = F.col("label").isNotNull()
    return j.select("learner_id", "target_id", "label", F.when(known, F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("prior_count"), F.when(known, F.col("confidence")).alias("prior_confidence"))


def existing_targets(edges: DataFrame, nodes: DataFrame, src_id: str, rel_type: str, label: str) -> DataFrame:
    """(dst_id): nodes of a label that a source links to already."""
    of = nodes.filter(F.col("label") == label).select(F.col("node_id").alias("dst_id"))
    return edges.filter((F.col("src_id") == src_id) & (F.col("rel_type") == rel_type)).select("dst_id").distinct().join(of, "dst_id", "left_semi")


def sampled_recipes(recipes: DataFrame, values: list[str], nominal: tuple[str, ...]) -> DataFrame:
    """recipes(topology_class, ...): all, the nominal classes, or the named ones; names that match nothing select nothing."""
    if "all" in values:
        return recipes
    wanted = nominal if "nominal" in values else values
    return recipes.filter(F.col("topology_class").isin(*wanted))


def class_cards(cards: DataFrame, topology_class: str, claim: str) -> DataFrame:
    """(pdk, spec_id, claim_id, verdict) of a class and claim, by process."""
    return cards.filter((F.col("topology_class") == topology_class) & (F.col("claim") == claim)).select("pdk", "spec_id", "claim_id", "verdict").orderBy("pdk", "spec_id", "claim_id")


def law_of(laws: DataFrame, topology_class: str, metric: str, knob: str, quant_kind: str) -> DataFrame:
    """The law with the computed id of a shape; no row if it was never promoted."""
    from lodeweave.operators.evidence import law_id

    want = law_id(F.lit(topology_class), F.lit(metric), F.lit(knob), F.lit(quant_kind))
    return laws.filter(F.col("law_id") == want)
