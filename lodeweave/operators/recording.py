"""Writing: memories and their links, sessions, snapshots of the graph that swap at once, consolidation end to end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.operators import resolution as R
from lodeweave.operators.components import connected_components
from lodeweave.operators.graph import merge_edges, merge_nodes, rewire, update_nodes

# The confidence of a memory's link by what it is linked to.
LINK_CONFIDENCE = {"session": 1.0, "entity": 0.8, "concept": 0.7}
MEMORY = ["memory_id", "layer", "tier", "content", "tags", "confidence"]


def saved_memories(old: DataFrame, new: DataFrame, prefix: str = "mem_") -> DataFrame:
    """old with the rows of new merged by memory_id: a new value wins unless null; a row without id gets one from its content.

    Repeated new rows of one id must agree or be reduced before; ids are digests, so saving twice changes nothing."""
    made = F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\u0000", "layer", "content"), 256), 1, 12))
    n = new.withColumn("memory_id", F.coalesce(F.when(F.trim("memory_id") != "", F.col("memory_id")), made))
    rest = [c for c in old.columns if c != "memory_id"]
    n = n.groupBy("memory_id").agg(*(F.max(c).alias(f"__n_{c}") for c in rest if c in n.columns))
    j = old.join(n, "memory_id", "full")
    return j.select("memory_id", *(F.coalesce(f"__n_{c}", c).alias(c) if f"__n_{c}" in n.columns else F.col(c) for c in rest))


def memory_links(links: DataFrame) -> DataFrame:
    """(src_id, rel_type, dst_id, rationale, confidence) of links(memory_id, kind, other_id, rationale): a session records a memory, a memory
    relates to an entity or a concept. Other kinds and null ends link nothing; a repeated link is one edge."""
    conf = F.create_map(*(F.lit(x) for kv in LINK_CONFIDENCE.items() for x in kv))[F.col("kind")]
    from_session = F.col("kind") == "session"
    e = links.filter(conf.isNotNull() & F.col("memory_id").isNotNull() & F.col("other_id").isNotNull()).select(
        F.when(from_session, F.col("other_id")).otherwise(F.col("memory_id")).alias("src_id"),
        F.when(from_session, "RECORDED").otherwise("RELATES_TO").alias("rel_type"),
        F.when(from_session, F.col("memory_id")).otherwise(F.col("other_id")).alias("dst_id"),
        F.when(from_session, "recorded in session").otherwise(F.col("rationale")).alias("rationale"),
        conf.alias("confidence"),
    )
    return e.groupBy("src_id", "rel_type", "dst_id").agg(F.max("rationale").alias("rationale"), F.max("confidence").alias("confidence"))


def recorded_facts(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(memories, edges) of facts(subject_id, fact_type, predicate, value, confidence): curated semantic memories tagged with type and subject, each linked to its subject."""
    content = F.concat_ws(": ", "predicate", "value")
    m = facts.select(F.concat(F.lit("sem_"), F.substring(F.sha2(F.concat_ws("\u0000", "subject_id", "fact_type", "predicate", "value"), 256), 1, 12)).alias("memory_id"), F.lit("semantic").alias("layer"), F.lit("curated").alias("tier"), content.alias("content"), F.filter(F.array("fact_type", "subject_id"), lambda t: t.isNotNull()).alias("tags"), "confidence", "subject_id", "predicate")
    m = m.dropDuplicates(["memory_id"])
    return m.select(*MEMORY), memory_links(m.select("memory_id", F.lit("entity").alias("kind"), F.col("subject_id").alias("other_id"), F.col("predicate").alias("rationale")))


def recorded_lessons(lessons: DataFrame) -> DataFrame:
    """Curated semantic memories of lessons(lesson, tags), tagged 'lesson' first; blank lessons are none."""
    kept = lessons.filter("trim(lesson) <> ''")
    tags = F.concat(F.array(F.lit("lesson")), F.coalesce("tags", F.array().cast("array<string>")))
    return kept.select(F.concat(F.lit("lesson_"), F.substring(F.sha2("lesson", 256), 1, 12)).alias("memory_id"), F.lit("semantic").alias("layer"), F.lit("curated").alias("tier"), F.col("lesson").alias("content"), tags.alias("tags"), F.lit(0.9).alias("confidence")).dropDuplicates(["memory_id"])


def session_rows(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sessions, summaries) of events(session_id, kind, at, summary) with kinds start, end and others.

    A session is active from its first row and ended by its last 'end'; events after that end belong to it
    but do not reopen it; event_count leaves start and end out. A summary given at the end becomes a retained
    episodic memory. Blank session ids are none."""
    e = events.filter("trim(session_id) <> ''")
    other = ~F.col("kind").isin("start", "end")
    g = e.groupBy("session_id").agg(
        F.coalesce(F.min(F.when(F.col("kind") == "start", F.col("at"))), F.min("at")).alias("started_at"),
        F.max(F.when(F.col("kind") == "end", F.col("at"))).alias("ended_at"),
        F.count_if(other).alias("event_count"),
        F.max_by("summary", F.when((F.col("kind") == "end") & (F.trim("summary") != ""), F.col("at"))).alias("summary"),
    )
    s = g.select("session_id", "started_at", "ended_at", F.when(F.col("ended_at").isNull(), "active").otherwise("ended").alias("status"), "event_count")
    told = g.filter("ended_at is not null and trim(summary) <> ''")
    m = told.select(F.concat(F.lit("ep_sum_"), F.substring(F.sha2(F.concat_ws("\u0000", "session_id", "summary"), 256), 1, 12)).alias("memory_id"), F.lit("episodic").alias("layer"), F.lit("retain").alias("tier"), F.col("summary").alias("content"), "session_id", F.array(F.lit("session_summary")).alias("tags"), F.lit(0.85).alias("confidence"))
    return s, m


def batch_applied(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, updates: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, rejected) after merging nodes, then updates of existing ones, then edges between what is there by then."""
    n = update_nodes(merge_nodes(nodes, new_nodes), updates)
    e, lost = merge_edges(edges, new_edges, n)
    return n, e, lost


_POINTER = "CURRENT"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, root: str) -> int:
    """The number of the snapshot readers see; 0 before the first."""
    _, p, fc = _fs(spark, f"{root}/{_POINTER}")
    if not fc.util().exists(p):
        return 0
    return int(spark.read.text(f"{root}/{_POINTER}").first().value)


def snapshot(spark: SparkSession, root: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a snapshot, the current one by default."""
    v = current_version(spark, root) if version is None else version
    return spark.read.parquet(f"{root}/v{v}/nodes"), spark.read.parquet(f"{root}/v{v}/edges")


def publish(spark: SparkSession, root: str, nodes: DataFrame, edges: DataFrame) -> int:
    """Write both tables as the next snapshot, then swap the pointer in one rename: readers see the old or the new one, never a mixture.

    A run that dies before the rename leaves the old snapshot current; its files are overwritten by the next run.
    Writers must not run at the same time."""
    v = current_version(spark, root) + 1
    nodes.write.mode("overwrite").parquet(f"{root}/v{v}/nodes")
    edges.write.mode("overwrite").parquet(f"{root}/v{v}/edges")
    spark.createDataFrame([(str(v),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/next-{v}")
    jvm, target, fc = _fs(spark, f"{root}/{_POINTER}")
    folder = jvm.org.apache.hadoop.fs.Path(f"{root}/next-{v}")
    part = [f.getPath() for f in fc.util().listStatus(folder) if f.getPath().getName().startswith("part-")][0]
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    fc.rename(part, target, overwrite)
    fc.delete(folder, True)
    return v


def write_batch(spark: SparkSession, root: str, new_nodes: DataFrame, updates: DataFrame, new_edges: DataFrame) -> DataFrame:
    """Apply one batch to the current snapshot and publish the result; the rejected edges are returned."""
    nodes, edges = snapshot(spark, root)
    n, e, lost = batch_applied(nodes, edges, new_nodes, updates, new_edges)
    publish(spark, root, n, e)
    return lost


def merge_undo(nodes: DataFrame, edges: DataFrame, remap: DataFrame) -> DataFrame:
    """(node_id, survivor_id, node, survivor, edges): what a merge of remap(node_id, survivor_id) changes, to take it back:
    both nodes as JSON and the duplicate's edges before the merge, in parts of at most about 1,000 (part 0 has the nodes)."""
    body = F.to_json(F.struct(*nodes.columns))
    n = nodes.select("node_id", body.alias("j"))
    touched = edges.select(F.col("src_id").alias("node_id"), F.to_json(F.struct(*edges.columns)).alias("e")).unionByName(edges.filter("src_id <> dst_id").select(F.col("dst_id").alias("node_id"), F.to_json(F.struct(*edges.columns)).alias("e")))
    t = touched.join(remap.select("node_id"), "node_id", "left_semi")
    many = t.groupBy("node_id").agg(F.ceil(F.count(F.lit(1)) / 1000).cast("int").alias("parts"))
    parted = t.join(many, "node_id").withColumn("part", F.pmod(F.xxhash64("e"), F.col("parts")).cast("int"))
    g = parted.groupBy("node_id", "part").agg(F.array_sort(F.collect_list("e")).alias("edges"))
    r = remap.join(n.withColumnRenamed("j", "node"), "node_id", "left").join(n.select(F.col("node_id").alias("survivor_id"), F.col("j").alias("survivor")), "survivor_id", "left")
    out = r.join(g, "node_id", "left").withColumn("part", F.coalesce("part", F.lit(0)))
    only = lambda c: F.when(F.col("part") == 0, F.col(c)).alias(c)
    return out.select("node_id", "survivor_id", "part", only("node"), only("survivor"), F.coalesce("edges", F.array().cast("array<string>")).alias("edges"))


def unmerged_edges(undo: DataFrame, schema: str) -> DataFrame:
    """The duplicates' edges out of an undo record."""
    return undo.select(F.explode("edges").alias("j")).select(F.from_json("j", schema).alias("e")).select("e.*").distinct()


def review_rows(pairs: DataFrame, auto_merge: bool = False) -> DataFrame:
    """(id_a, id_b, name_a, name_b, cos, sim, band, status) to queue for a person: the review band, and the auto band unless it is merged."""
    bands = ["review"] if auto_merge else ["review", "auto"]
    return pairs.filter(F.col("band").isin(*bands)).select("id_a", "id_b", "name_a", "name_b", "cos", "sim", "band", F.lit("pending").alias("status"))


def queue_append(rows: DataFrame, path: str, at: Column) -> None:
    """Append rows to a queue of JSON lines with the time given."""
    rows.withColumn("ts", at).write.mode("append").json(path)


def consolidation(concepts: DataFrame, verdicts: DataFrame, vocab: R.Vocabulary = R.NONE, auto_merge: bool = False, cap: int = 4) -> dict[str, DataFrame]:
    """One consolidation run over concepts(id, name, embedding): pairs (banded, the verify band drained by verdicts),
    queue (what a person must see), remap (id -> survivor of the auto clusters, empty unless ``auto_merge``). Nothing is written here:
    a dry run looks at the tables, a real one appends the queue and rewires by the remap."""
    full = R.classified_pairs(concepts, vocab)
    band = R.drained(full.select("id_a", "id_b", "band"), verdicts)
    pairs = full.drop("band").join(band, ["id_a", "id_b"])
    clusters = R.capped_clusters(pairs.filter("band = 'auto'").select("id_a", "id_b"), concepts.select("id", "embedding"), cap)
    remap = clusters.filter("cluster <> id").select(F.col("id").alias("node_id"), F.col("cluster").alias("survivor_id"))
    return {"pairs": pairs, "queue": review_rows(pairs, auto_merge), "remap": remap if auto_merge else remap.limit(0)}


def consolidated(nodes: DataFrame, edges: DataFrame, remap: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without the merged duplicates, edges rewired."""
    return nodes.join(remap.select("node_id"), "node_id", "left_anti"), rewire(edges, remap)


def merge_groups(pairs: DataFrame) -> DataFrame:
    """(node_id, survivor_id) of accepted pairs(id_a, id_b): each node of a component and its smallest member."""
    return connected_components(pairs, "id_a", "id_b").filter("node <> component").select(F.col("node").alias("node_id"), F.col("component").alias("survivor_id"))
