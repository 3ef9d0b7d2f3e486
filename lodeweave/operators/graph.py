"""Operators over a labelled property graph held as nodes(label, node_id, ...) and edges(src_id, rel_type, dst_id, ...).

Every operator is pure: tables in, table out, no clock, a total order before every limit.
Null ids join nothing; repeated edges count as often as they occur unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.operators.skew import maybe_in
from lodeweave.session import cut

# The labels and relation names below.
KNOWLEDGE_LABELS = ("Concept", "Equation", "Principle", "CircuitTopology", "Parameter")
PRIVATE_LABELS = ("Memory", "Session", "SkillRun", "Entity", "Learner", "Assessment")
SHARED_BY = ("DEPENDS_ON", "USES_EQUATION", "HAS_PARAMETER")
BRIDGED_BY = ("BRIDGES_TO", "TRADES_OFF")


def live(nodes: DataFrame) -> DataFrame:
    """Rows not softly deleted; a null flag means alive."""
    return nodes.filter(~F.coalesce("retracted", F.lit(False)))


def get_node(nodes: DataFrame, label: str, node_id: str) -> DataFrame:
    """Point lookup, pushed down to the scan."""
    return nodes.filter((F.col("label") == label) & (F.col("node_id") == node_id))


def by_any_id(nodes: DataFrame, node_id: str) -> DataFrame:
    """The first node of any label with this id."""
    return nodes.filter(F.col("node_id") == node_id).orderBy("label").limit(1)


def resolve_prefix(requests: DataFrame, nodes: DataFrame, digits: int = 12) -> DataFrame:
    """(request, node_id): an exact id wins, else a prefix that starts exactly one live node: a scheme and at least ``digits`` hex digits after it.

    The scheme is what stands before the last of : and _. The prefix is compared by equi-joining on
    scheme and first digits, so this is no cross join.
    """
    rx = rf"^(.*[:_])?([0-9a-f]{{{digits}}})[0-9a-f]*$"
    head = lambda c: F.when(F.col(c).rlike(rx), F.concat(F.regexp_extract(c, rx, 1), F.regexp_extract(c, rx, 2))).otherwise(F.concat(F.lit("="), c))
    known = live(nodes).select("node_id", head("node_id").alias("__p")).distinct()
    req = requests.select("request").filter("request is not null").distinct().withColumn("__p", head("request"))
    hits = req.join(known, "__p").filter(F.col("node_id").startswith(F.col("request")))
    best = hits.groupBy("request").agg(F.max(F.when(F.col("node_id") == F.col("request"), F.col("node_id"))).alias("exact"), F.count(F.lit(1)).alias("n"), F.min("node_id").alias("only"))
    return best.select("request", F.coalesce("exact", F.when(F.col("n") == 1, F.col("only"))).alias("node_id")).filter("node_id is not null")


def resolution_class(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """(request, resolution): missing, ambiguous (several nodes), retracted or active."""
    found = nodes.groupBy(F.col("node_id").alias("request")).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce("retracted", F.lit(False))).alias("gone"))
    kind = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").when(F.col("gone"), "retracted").otherwise("active")
    return requests.select("request").distinct().join(found, "request", "left").select("request", kind.alias("resolution"))


def text_search(nodes: DataFrame, phrase: str, limit: int = 20) -> DataFrame:
    """Live knowledge nodes whose name, or one of whose aliases (if there is that column), holds the phrase, whatever the case: exact names first, then by name and id."""
    p = phrase.lower()
    held = F.coalesce(F.lower("name").contains(p), F.lit(False))
    if "aliases" in nodes.columns:
        held = held | F.coalesce(F.exists("aliases", lambda a: F.lower(a).contains(p)), F.lit(False))
    hits = live(nodes).filter(F.col("label").isin(*KNOWLEDGE_LABELS) & held)
    rank = F.when(F.lower("name") == p, 0).otherwise(1)
    return hits.orderBy(rank, "name", "node_id").limit(limit).select("node_id", "label", "name")


def counts_by_label(nodes: DataFrame) -> DataFrame:
    """(label, n)."""
    return nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def counts_by_type(edges: DataFrame, nodes: DataFrame, exclude: tuple = PRIVATE_LABELS) -> DataFrame:
    """(rel_type, n) of edges between live nodes of labels that are not excluded."""
    ok = live(nodes).filter(~F.col("label").isin(*exclude)).select("node_id").distinct()
    return edges.join(ok.withColumnRenamed("node_id", "src_id"), "src_id", "left_semi").join(ok.withColumnRenamed("node_id", "dst_id"), "dst_id", "left_semi").groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"))


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b, rel_type, forward): each edge from both of its ends."""
    e = edges.filter("src_id is not null and dst_id is not null")
    return e.select(F.col("src_id").alias("a"), F.col("dst_id").alias("b"), "rel_type", F.lit("->").alias("direction")).unionByName(e.select(F.col("dst_id").alias("a"), F.col("src_id").alias("b"), "rel_type", F.lit("<-").alias("direction")))


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, degree): incident edges of either direction, 0 for none; counted before the join."""
    d = both_ways(edges).groupBy(F.col("a").alias("node_id")).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("node_id").join(d, "node_id", "left").select("node_id", F.coalesce("degree", F.lit(0)).alias("degree"))


def neighbour_set(edges: DataFrame, nodes: DataFrame, label: str = "Concept") -> DataFrame:
    """(node_id, neighbour_id): distinct neighbours of one label in either direction."""
    of = nodes.filter(F.col("label") == label).select(F.col("node_id").alias("b")).distinct()
    return both_ways(edges).join(of, "b", "left_semi").select(F.col("a").alias("node_id"), F.col("b").alias("neighbour_id")).distinct()


def neighbourhood(edges: DataFrame, starts: DataFrame, hops: int = 2, limit: int | None = None) -> DataFrame:
    """(start_id, node_id, distance, rel_type, direction, via): each node within ``hops``, once, at its shortest distance.

    The edge shown is the last of a shortest path, the smallest (rel_type, via) of several.
    Each hop is one join with the edges of the nodes reached last, the other edges are not shuffled; nodes seen before are
    dropped by an anti-join, so no path is enumerated twice.
    """
    e = both_ways(edges)
    seen = starts.select(F.col("node_id").alias("start_id")).distinct().withColumn("node_id", F.col("start_id")).withColumn("distance", F.lit(0))
    last, out = seen, None
    for d in range(1, hops + 1):
        ends = last.select("start_id", F.col("node_id").alias("via"))
        step = ends.join(maybe_in(e.withColumnRenamed("a", "via"), ends, "via"), "via").select("start_id", F.col("b").alias("node_id"), F.struct("rel_type", "via", "direction").alias("edge"))
        new = step.join(seen.select("start_id", "node_id"), ["start_id", "node_id"], "left_anti").groupBy("start_id", "node_id").agg(F.min("edge").alias("edge"))
        new = new.withColumn("distance", F.lit(d))
        out = new if out is None else out.unionByName(new)
        seen, last = seen.unionByName(new.drop("edge")), new
    found = out.select("start_id", "node_id", "distance", "edge.rel_type", "edge.direction", "edge.via")
    if limit is None:
        return found
    w = Window.partitionBy("start_id").orderBy("distance", "rel_type", "node_id")
    return found.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= limit).drop("__r")


def bridges(nodes: DataFrame, edges: DataFrame, min_shared: int = 2, limit: int = 20, label: str = "Concept", shared_by: tuple = SHARED_BY, bridged_by: tuple = BRIDGED_BY, block: int = 1000) -> DataFrame:
    """(node_a, node_b, domain_a, domain_b, shared, shared_names): unlinked nodes of different domains that share neighbours.

    A shared neighbour's holders meet on its id only; pairs are aggregated map-side to counts
    before anything else is joined, names are looked up for the pairs kept. A null domain never differs.
    """
    own = nodes.filter((F.col("label") == label) & F.col("domain").isNotNull()).select("node_id", "domain")
    holds = cut(edges.filter(F.col("rel_type").isin(*shared_by)).select("src_id", "dst_id").distinct().join(own, F.col("src_id") == F.col("node_id")).select("dst_id", "src_id", "domain"))
    # A neighbour with many holders is split into parts that meet two by two, so no task has the square of a hub.
    hub = holds.groupBy("dst_id").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"), F.min("domain").alias("d0"), F.max("domain").alias("d1")).filter("d0 <> d1").drop("d0", "d1")
    own_part = holds.join(hub, "dst_id").withColumn("own", F.pmod(F.xxhash64("src_id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    x = own_part.select("dst_id", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", F.col("src_id").alias("node_a"), F.col("domain").alias("domain_a"))
    y = x.select("dst_id", "lo", "hi", F.col("own").alias("own_b"), F.col("node_a").alias("node_b"), F.col("domain_a").alias("domain_b"))
    met = x.join(y, ["dst_id", "lo", "hi"]).filter("node_a < node_b and domain_a <> domain_b and (lo = hi or own <> own_b)")
    pairs = met.groupBy("node_a", "node_b").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= min_shared)
    linked = edges.filter(F.col("rel_type").isin(*bridged_by)).select(F.least("src_id", "dst_id").alias("node_a"), F.greatest("src_id", "dst_id").alias("node_b")).distinct()
    top = pairs.join(linked, ["node_a", "node_b"], "left_anti").orderBy(F.desc("shared"), "node_a", "node_b").limit(limit)
    top = top.join(own.select(F.col("node_id").alias("node_a"), F.col("domain").alias("domain_a")), "node_a").join(own.select(F.col("node_id").alias("node_b"), F.col("domain").alias("domain_b")), "node_b")
    both = top.join(holds.select("dst_id", F.col("src_id").alias("node_a")), "node_a").join(holds.select("dst_id", F.col("src_id").alias("node_b")), ["dst_id", "node_b"])
    named = both.join(nodes.select(F.col("node_id").alias("dst_id"), "name"), "dst_id").groupBy("node_a", "node_b", "domain_a", "domain_b", "shared").agg(F.slice(F.array_sort(F.collect_set("name")), 1, 5).alias("shared_names"))
    return named


def source_scoped_edges(edges: DataFrame, members: DataFrame, limit: int = 50) -> DataFrame:
    """Edges with both ends in one source: members has (source_id, node_id)."""
    m = members.select("source_id", "node_id").distinct()
    both = edges.join(m.withColumnRenamed("node_id", "src_id"), "src_id").join(m.withColumnRenamed("node_id", "dst_id"), ["source_id", "dst_id"])
    w = Window.partitionBy("source_id").orderBy("src_id", "rel_type", "dst_id")
    return both.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= limit).select("source_id", "src_id", "rel_type", "dst_id")


def endpoint_violations(edges: DataFrame, nodes: DataFrame, rules: dict[str, tuple[str, str]]) -> DataFrame:
    """Edges of a ruled type whose ends do not have the labels of the rule (type -> source label, target label)."""
    of = nodes.select("node_id", "label")
    lab = edges.join(of.select(F.col("node_id").alias("src_id"), F.col("label").alias("src_label")), "src_id", "left").join(of.select(F.col("node_id").alias("dst_id"), F.col("label").alias("dst_label")), "dst_id", "left")
    bad = F.lit(False)
    for rel, (s, d) in rules.items():
        bad = bad | ((F.col("rel_type") == rel) & ~(F.col("src_label").eqNullSafe(F.lit(s)) & F.col("dst_label").eqNullSafe(F.lit(d))))
    return lab.filter(bad).select("src_id", "rel_type", "dst_id", "src_label", "dst_label")


def duplicate_names(nodes: DataFrame, scope: str | None = None) -> DataFrame:
    """(key, n, first_id): names equal after lower-casing and trimming; with ``scope`` within each value of that column."""
    keys = [F.lower(F.trim("name")).alias("key"), *([F.col(scope)] if scope else [])]
    out = nodes.filter("name is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("first_id")).filter("n > 1")
    return out


def reinforce(confidence: Column, step: float, cap: float = 0.95) -> Column:
    """Below the cap add the step (which may overshoot it), else exactly the cap; a null starts at 0.7."""
    c = F.coalesce(confidence, F.lit(0.7))
    return F.when(c < cap, c + step).otherwise(F.lit(cap))


def reinforce_times(confidence: Column, step: float, times: Column, cap: float = 0.95) -> Column:
    """``reinforce`` applied ``times`` times: k steps reach or pass the cap, one more returns exactly the cap."""
    c = F.coalesce(confidence, F.lit(0.7))
    needed = F.when(c < cap, F.ceil(F.round((F.lit(cap) - c) / step, 9))).otherwise(F.lit(0))
    return F.when(times <= needed, c + times * step).otherwise(F.lit(cap))


def reinforced_nodes(nodes: DataFrame, hits: DataFrame) -> DataFrame:
    """(node_id, confidence, reinforcement_count): nodes hit at least once, a step for each hit, count + hits."""
    n = hits.groupBy("node_id").agg(F.count(F.lit(1)).alias("hits"))
    return nodes.join(n, "node_id").select("node_id", reinforce_times(F.col("confidence"), 0.02, F.col("hits")).alias("confidence"), (F.coalesce("reinforcement_count", F.lit(1)) + F.col("hits")).alias("reinforcement_count"))


def reinforced_edges(edges: DataFrame) -> DataFrame:
    """Each edge one step stronger."""
    return edges.select("src_id", "rel_type", "dst_id", reinforce(F.col("confidence"), 0.03).alias("confidence"), (F.coalesce("reinforcement_count", F.lit(1)) + 1).alias("reinforcement_count"))


def linear_decay(items: DataFrame, as_of: str, days: int = 30, step: float = 0.1, floor: float = 0.3) -> DataFrame:
    """confidence lowered by a step, not under the floor, where last_reinforced is over ``days`` before as_of."""
    old = F.col("last_reinforced") < F.expr(f"timestamp_ntz '{as_of}' - interval {days} days")
    return items.withColumn("confidence", F.when(old & (F.col("confidence") > floor), F.greatest(F.col("confidence") - step, F.lit(floor))).otherwise(F.col("confidence")))


def reinforcement_stats(edges: DataFrame) -> DataFrame:
    """One row: n, avg_confidence (default .7), avg_reinforcement (default 1), max_reinforcement."""
    return edges.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce("confidence", F.lit(0.7))), 3).alias("avg_confidence"), F.round(F.avg(F.coalesce("reinforcement_count", F.lit(1))), 1).alias("avg_reinforcement"), F.max(F.coalesce("reinforcement_count", F.lit(1))).alias("max_reinforcement"))


PROTECTED = ("node_id", "label", "name")


def merge_nodes(old: DataFrame, new: DataFrame, protected: tuple = PROTECTED) -> DataFrame:
    """Upsert by (label, node_id): a matched node keeps protected columns, other columns take the new value if not null.

    Repeated new rows of one node must be reduced before; a null id is dropped.
    """
    keys = ["label", "node_id"]
    rest = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.lit(True).alias("__old"), *(F.col(c).alias(f"__o_{c}") for c in rest))
    n = new.filter("node_id is not null").select(*keys, *(F.col(c).alias(f"__n_{c}") if c in new.columns else F.lit(None).alias(f"__n_{c}") for c in rest))
    pick = [F.when(F.col("__old"), F.coalesce(f"__o_{c}", f"__n_{c}") if c in protected else F.coalesce(f"__n_{c}", f"__o_{c}")).otherwise(F.col(f"__n_{c}")).alias(c) for c in rest]
    return o.join(n, keys, "full").select(*keys, *pick)


def update_nodes(old: DataFrame, changes: DataFrame, protected: tuple = PROTECTED) -> DataFrame:
    """Change matching nodes only; protected columns stay."""
    cols = [c for c in changes.columns if c not in ("label", "node_id", *protected)]
    c = changes.select("label", "node_id", *(F.col(x).alias(f"__n_{x}") for x in cols))
    return old.join(c, ["label", "node_id"], "left").select(*(F.coalesce(f"__n_{x}", x).alias(x) if x in cols else F.col(x) for x in old.columns))


def merge_edges(old: DataFrame, new: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, rejected): new edges with both ends present replace or join the old ones; the others are rejected."""
    keys = ["src_id", "rel_type", "dst_id"]
    ids = nodes.select("node_id").distinct()
    ok = new.join(ids.withColumnRenamed("node_id", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("node_id", "dst_id"), "dst_id", "left_semi")
    kept = old.join(ok.select(*keys), keys, "left_anti")
    return kept.unionByName(ok.select(*old.columns)), new.join(ok.select(*keys), keys, "left_anti")


def reinforce_by_delta(edges: DataFrame, delta: DataFrame) -> DataFrame:
    """Count + number of proposals, latest proposal time, confidence unchanged; where both have a column evidence (an array of ids),
    the proposals' evidence is appended in the order of their times, duplicates kept."""
    keys = ["src_id", "rel_type", "dst_id"]
    told = "evidence" in edges.columns and "evidence" in delta.columns
    none = F.array().cast("array<string>")
    more = [F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("evidence", none).alias("e")))), lambda x: x["e"])).alias("__e")] if told else []
    d = delta.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.max("at").alias("__at"), *more)
    out = [F.concat(F.coalesce("evidence", none), F.coalesce("__e", none)).alias("evidence")] if told else []
    return edges.join(d, keys, "left").select(*keys, "confidence", (F.coalesce("reinforcement_count", F.lit(1)) + F.coalesce("__n", F.lit(0))).alias("reinforcement_count"), F.greatest("last_reinforced", "__at").alias("last_reinforced"), *out)


def survivors_of_names(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, survivor_id) of nodes with equal name: highest degree, then reinforcement, then the earliest created_at (if there is that column; null last), then the smallest id stays."""
    born = F.col("created_at") if "created_at" in nodes.columns else F.lit(None).cast("timestamp")
    d = nodes.select("label", "node_id", F.lower(F.trim("name")).alias("key"), F.coalesce("reinforcement_count", F.lit(1)).alias("rc"), born.isNull().alias("unborn"), born.alias("born")).join(degree(nodes, edges), "node_id")
    best = d.filter("key is not null").groupBy("label", "key").agg(F.min(F.struct((-F.col("degree")).alias("d"), (-F.col("rc")).alias("r"), "unborn", "born", "node_id"))["node_id"].alias("survivor_id"))
    return d.join(best, ["label", "key"]).filter("node_id <> survivor_id").select("node_id", "survivor_id")


def rewire(edges: DataFrame, remap: DataFrame) -> DataFrame:
    """Edges with merged ids replaced; an edge that becomes a loop goes, of parallel edges one that existed unchanged stays."""
    r = remap.select("node_id", "survivor_id")
    s = edges.join(r.select(F.col("node_id").alias("src_id"), F.col("survivor_id").alias("__s")), "src_id", "left").join(r.select(F.col("node_id").alias("dst_id"), F.col("survivor_id").alias("__d")), "dst_id", "left")
    moved = (F.col("__s").isNotNull() | F.col("__d").isNotNull()).cast("int")
    flat = s.select(F.coalesce("__s", "src_id").alias("src_id"), "rel_type", F.coalesce("__d", "dst_id").alias("dst_id"), F.struct(moved.alias("moved"), (-F.col("confidence")).alias("c"), (-F.col("reinforcement_count")).alias("r")).alias("pick"))
    best = flat.filter("src_id <> dst_id").groupBy("src_id", "rel_type", "dst_id").agg(F.min("pick").alias("p"))
    return best.select("src_id", "rel_type", "dst_id", (-F.col("p.c")).alias("confidence"), (-F.col("p.r")).alias("reinforcement_count"))


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without the nodes of ``gone`` and the edges that touch them."""
    ids = gone.select("node_id").distinct()
    e = edges.join(ids.withColumnRenamed("node_id", "src_id"), "src_id", "left_anti").join(ids.withColumnRenamed("node_id", "dst_id"), "dst_id", "left_anti")
    return nodes.join(ids, "node_id", "left_anti"), e.select(*edges.columns)


def retract(nodes: DataFrame, gone: DataFrame, reason: str) -> DataFrame:
    """nodes with the retraction flag and reason set for ``gone``."""
    g = gone.select("node_id").distinct().withColumn("__g", F.lit(True))
    return nodes.join(g, "node_id", "left").withColumn("retracted", F.coalesce("__g", "retracted", F.lit(False))).withColumn("retraction_reason", F.when(F.col("__g"), F.lit(reason))).drop("__g")


def add_aliases(nodes: DataFrame, aliases: DataFrame, replace: bool = False) -> DataFrame:
    """(node_id, aliases): old aliases, then new ones not held yet, in order; a node's own name is no alias. With ``replace`` the
    new ones take the place of the old where a node has any."""
    extra = aliases.filter("alias is not null").groupBy("node_id").agg(F.array_sort(F.collect_set("alias")).alias("__a"))
    joined = nodes.join(extra, "node_id", "left")
    none = F.array().cast("array<string>")
    both = F.coalesce("__a", "aliases", none) if replace else F.array_distinct(F.concat(F.coalesce("aliases", none), F.coalesce("__a", none)))
    return joined.select("node_id", F.filter(both, lambda a: ~a.eqNullSafe(F.col("name"))).alias("aliases"))
