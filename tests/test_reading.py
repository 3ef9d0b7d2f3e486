"""Retrieval, recording, snapshots, parsed documents and ingest on small rows, with nulls, repeats and empty tables."""

import pytest
from pyspark.sql import functions as F

from lodeweave.operators import graph as G
from lodeweave.operators import recording as W
from lodeweave.operators import retrieval as R
from lodeweave.operators import text as T
from lodeweave.sources import io as I
from lodeweave.streaming import events as S

NODE = "label string, node_id string, name string, retracted boolean"
EDGE = "src_id string, rel_type string, dst_id string, confidence double, reinforcement_count bigint"


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([("Concept", "1", "Loop gain", None), ("Concept", "2", "loop gain", False), ("Concept", "3", "RC filter", None), ("Concept", "4", "Source follower", None), ("Concept", "5", "Gain of a loop gain stage", None), ("Concept", "6", None, None), ("Concept", "7", "Loop gain gone", True), ("Memory", "8", "Loop gain memory", None)], NODE)


def test_context(spark, nodes):
    q = spark.createDataFrame([(1, "loop gain"), (2, "RC"), (3, None), (4, "How does the loop-gain of an RC filter depend on the source follower?"), (1, "loop gain")], "query_id int, query string")
    got = [tuple(r) for r in R.context_nodes(q, nodes).orderBy("query_id", "rank").select("query_id", "node_id").collect()]
    assert [n for i, n in got if i == 1] == ["1"] and [n for i, n in got if i == 2] == ["3"] and not [n for i, n in got if i == 3]
    assert {"1", "3", "4"} <= {n for i, n in got if i == 4}
    assert R.context_nodes(q.limit(0), nodes).count() == 0 and R.context_nodes(q, nodes.limit(0)).count() == 0


def test_containing_is_every_substring(spark):
    names = ["abcabc", "xABCx", "", None, "a", "bca b", "zz"]
    df = spark.createDataFrame(list(enumerate(names)), "node_id int, name string")
    phrases = ["abc", "A", "bc", "b", "zz", "zzz", "", None, "a b"]
    got = {(r.phrase, r.node_id) for r in R.containing(spark.createDataFrame([(p,) for p in phrases], "phrase string"), df).collect()}
    assert got == {(p, i) for p in phrases if p for i, n in enumerate(names) if n and p.lower() in n.lower()}


def joined_rows(plan):
    """The most rows that leave a join of a plan that ran."""
    while "Adaptive" in plan.nodeName() or "QueryStage" in plan.nodeName():
        plan = plan.executedPlan() if "Adaptive" in plan.nodeName() else plan.plan()
    own = plan.metrics().get("numOutputRows") if "Join" in plan.nodeName() else None
    kids = plan.children()
    return max([own.get().value() if own and own.isDefined() else 0, *(joined_rows(kids.apply(i)) for i in range(kids.size()))])


def test_questions_meet_the_first_names_only(spark):
    names = spark.range(400).selectExpr("'Concept' label", "cast(id as string) node_id", "concat('gain ', id) name", "false retracted")
    df = R.context_nodes(spark.range(60).selectExpr("id query_id", "'gain' query"), names)
    assert {(r.query_id, r.node_id) for r in df.collect()} == {(i, n) for i in range(60) for n in ("0", "1")}
    assert joined_rows(df._jdf.queryExecution().executedPlan()) < 3000  # 24,000 pairs of question and name


def test_pieces_of_names_are_never_broadcast(spark):
    """Their table is many times the names, though its estimate is theirs."""
    names = spark.range(50).selectExpr("id node_id", "concat('name of part ', id) name")
    df = R.containing(spark.range(3).selectExpr("concat('part ', id) phrase"), names)
    assert "BroadcastHashJoin [gram" not in df._jdf.queryExecution().executedPlan().toString()
    assert {(r.phrase, r.node_id) for r in df.collect()} == {(f"part {i}", j) for i in range(3) for j in range(50) if str(j).startswith(str(i))}
    long = spark.range(1).selectExpr("'Of pArt 4' phrase")
    assert {r.node_id for r in R.containing(long, names).collect()} == {4, *range(40, 50)}


def test_edges_of_other_nodes_are_not_shuffled(spark):
    """Of 3,000 edges at nodes that no start has, only those with an equal hash reach the join."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    edges = spark.range(3000).selectExpr("concat('s', id) src_id", "'R' rel_type", "concat('d', id) dst_id")
    df = G.neighbourhood(edges, spark.createDataFrame([("s7",), ("d9",)], "node_id string"), 1)
    try:
        assert {(r.start_id, r.node_id, r.direction) for r in df.collect()} == {("s7", "d7", "->"), ("d9", "s9", "<-")}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

    def shuffled(plan):
        while "Adaptive" in plan.nodeName():
            plan = plan.executedPlan()
        if "QueryStage" in plan.nodeName():
            plan = plan.plan()
        n = plan.metrics().get("shuffleRecordsWritten") if plan.nodeName() == "Exchange" else None
        kids = plan.children()
        return max([n.get().value() if n and n.isDefined() else 0, *(shuffled(kids.apply(i)) for i in range(kids.size()))])

    assert shuffled(df._jdf.queryExecution().executedPlan()) < 600


def test_read_refuses_writes(spark, nodes):
    assert R.read(spark, "select count(*) n from {t} where label = :l", {"t": nodes}, {"l": "Memory"}).first().n == 1
    with pytest.raises(ValueError):
        R.read(spark, "drop table x", {})


def test_why_of_unknown_claims(spark):
    cards = spark.createDataFrame([("c1", "VERIFIED", "tt"), ("c1", "VERIFIED", "tt")], "claim_id string, verdict string, scope string")
    spec = spark.createDataFrame([("c1", "s2", "ota"), ("c1", "s1", "ota")], "claim_id string, spec_id string, topology_class string")
    none = spark.createDataFrame([], "claim_id string, parameter string")
    laws = spark.createDataFrame([("c1", "l2", "law"), ("c1", "l1", "candidate"), ("c1", "l1", "candidate")], "claim_id string, law_id string, status string")
    got = {r.claim_id: r for r in R.why(spark.createDataFrame([("c1",), ("zz",), ("c1",)], "claim_id string"), cards, spec, none, laws).collect()}
    assert got["c1"].laws == "l1=candidate,l2=law" and got["c1"].spec_id == "s1" and got["c1"].scoped == "VERIFIED@tt" and not got["zz"].found and got["zz"].laws is None


def test_snapshots_swap_at_once(spark, tmp_path):
    root = str(tmp_path / "g")
    n = spark.createDataFrame([("Concept", "1", "a", None)], NODE)
    e = spark.createDataFrame([("1", "R", "1", 0.5, 1)], EDGE)
    assert W.current_version(spark, root) == 0 and W.publish(spark, root, n, e) == 1
    lost = W.write_batch(spark, root, spark.createDataFrame([("Concept", "2", "b", None)], NODE), spark.createDataFrame([("Concept", "1", True)], "label string, node_id string, retracted boolean"), spark.createDataFrame([("1", "R", "2", 0.7, 1), ("1", "R", "9", 0.7, 1)], EDGE))
    assert W.current_version(spark, root) == 2 and [r.dst_id for r in lost.collect()] == ["9"]
    nodes, edges = W.snapshot(spark, root)
    assert {r.node_id: r.retracted for r in nodes.collect()} == {"1": True, "2": None} and edges.count() == 2
    assert W.snapshot(spark, root, 1)[0].count() == 1  # readers of the old one are not disturbed


def test_merge_can_be_undone(spark):
    n = spark.createDataFrame([("Concept", x, x, None) for x in "abc"], NODE)
    e = spark.createDataFrame([("a", "R", "b", 0.1, 1), ("b", "R", "c", 0.2, 2), ("b", "S", "b", 0.3, 3), ("a", "R", "c", 0.4, 4)], EDGE)
    remap = spark.createDataFrame([("b", "a")], "node_id string, survivor_id string")
    undo = W.merge_undo(n, e, remap)
    _, after = W.consolidated(n, e, remap)
    touched = G.both_ways(e).limit(0)
    assert touched.count() == 0 and {tuple(r) for r in W.unmerged_edges(undo, EDGE).collect()} == {("a", "R", "b", 0.1, 1), ("b", "R", "c", 0.2, 2), ("b", "S", "b", 0.3, 3)}
    assert {(r.src_id, r.dst_id) for r in after.collect()} == {("a", "c")} and '"node_id":"b"' in undo.first().node


def test_memories_are_saved_once(spark):
    s = "memory_id string, layer string, tier string, content string"
    old = spark.createDataFrame([("m1", "semantic", "raw", "x")], s)
    new = spark.createDataFrame([("m1", "semantic", "core", None), (None, "semantic", "raw", "y"), (" ", "semantic", "raw", "y")], s)
    once = W.saved_memories(old, new)
    twice = W.saved_memories(once, new)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) and once.count() == 2
    assert once.filter("memory_id = 'm1'").first().content == "x" and once.filter("memory_id = 'm1'").first().tier == "core"


def test_links_and_sessions(spark):
    l = spark.createDataFrame([("m", "session", "s", None), ("m", "concept", "c", "why"), ("m", "concept", "c", "why"), ("m", "odd", "c", "x"), (None, "entity", "e", "x"), ("m", "entity", None, "x")], "memory_id string, kind string, other_id string, rationale string")
    assert {(r.src_id, r.rel_type, r.dst_id, r.confidence) for r in W.memory_links(l).collect()} == {("s", "RECORDED", "m", 1.0), ("m", "RELATES_TO", "c", 0.7)}
    e = spark.createDataFrame([("a", "start", 1, None), ("a", "note", 2, None), ("a", "end", 3, "done"), ("a", "note", 4, None), ("b", "note", 1, None), (" ", "note", 1, None), (None, "end", 1, "x")], "session_id string, kind string, at int, summary string")
    rows, memories = W.session_rows(e)
    assert {(r.session_id, r.status, r.event_count) for r in rows.collect()} == {("a", "ended", 2), ("b", "active", 1)}
    assert [(r.content, r.tier) for r in memories.collect()] == [("done", "retain")]


def test_queue_appends(spark, tmp_path):
    p = spark.createDataFrame([("a", "b", "A", "B", 0.9, 0.8, "review"), ("a", "c", "A", "C", 0.9, 0.8, "auto"), ("a", "d", "A", "D", 0.1, 0.1, "drop")], "id_a string, id_b string, name_a string, name_b string, cos double, sim double, band string")
    for _ in range(2):
        W.queue_append(W.review_rows(p, auto_merge=True), str(tmp_path / "q"), F.lit("2026-01-01"))
    assert [r.id_b for r in spark.read.json(str(tmp_path / "q")).collect()] == ["b", "b"] and W.review_rows(p).count() == 2


def test_blocks_sections_chunks(spark):
    rows = [(1, 0, '{"type": "text", "text": "Intro", "text_level": 1}'), (1, 1, '{"type": "image", "image_caption": ["A", null, "plot"], "page_idx": 1}'), (1, 2, '{"type": "table", "table_body": "<t>", "page_idx": 1}'), (1, 3, '{"type": "text", "text": "Next", "text_level": 2, "page_idx": 1}'), (1, 4, '{"type": "video"}'), (1, 5, "no json"), (1, 6, None), (2, 0, '{"text": "  "}')]
    b = T.content_blocks(spark.createDataFrame(rows, "doc_id int, pos int, item string"))
    assert {(r.doc_id, r.pos, r.type, r.caption) for r in b.collect()} == {(1, 0, "text", ""), (1, 1, "image", "A plot"), (1, 2, "table", ""), (1, 3, "text", ""), (2, 0, "text", "")}
    f = spark.createDataFrame([(1, 1, "plot", "A", "", "seen")], "doc_id int, page int, kind string, caption string, footnote string, description string")
    s = {(r.doc_id, r.section): r for r in T.section_texts(b, f).collect()}
    assert s[1, 1].text.count("seen") == 1 and "seen" not in s[1, 2].text and s[2, 0].title == "Untitled"
    c = T.structured_chunks(T.section_texts(b, f), 1500).collect()
    assert {(r.doc_id, r.section, r.pages) for r in c} == {(1, 1, "0-1"), (1, 2, "1")}
    assert T.structured_chunks(T.section_texts(b.limit(0))).count() == 0
    p = spark.createDataFrame([(1, 0, "1. Head\nbody"), (1, 1, "more"), (2, 0, "x"), (2, 1, "y"), (3, 0, None)], "doc_id int, page int, text string")
    assert {(r.doc_id, r.title, r.pages) for r in T.page_chunks(p).collect()} == {(1, "1. Head", "0-1"), (2, "Untitled", "0"), (2, "Untitled", "1")}


def test_lines_are_numbered_over_splits(spark, tmp_path):
    for name in "ab":
        (tmp_path / name).write_text("".join(f"{name} line {i}\n" for i in range(1, 4001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        got = {(r.path[-1], r.n, r.line) for r in I.read_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {(name, i, f"{name} line {i}") for name in "ab" for i in range(1, 4001)}


def test_leading_text_is_cut_by_length_only(spark):
    rows = [("k", i, "ab") for i in range(200)] + [("e", 1, None), ("e", 2, "")]
    got = {r.key: r.text for r in T.leading_text(spark.createDataFrame(rows, "key string, i int, t string"), "key", [F.col("i")], F.col("t"), 100, "!").collect()}
    assert got["k"] == "\n".join(["ab"] * 200)[:100] + "!" and got["e"] == "\n"


def test_ingest_goes_on_and_repeats_nothing(spark, tmp_path):
    root, src = str(tmp_path / "r"), tmp_path / "s"
    schema = "id int, x int"
    spark.createDataFrame([(1, 1), (2, 2), (3, 3)], schema).coalesce(1).write.parquet(str(src / "a"))
    seen = []

    def work(b):
        seen.append(b.count())
        return b.select("id", F.when(F.col("x") == 2, "failed").otherwise("done").alias("status"))

    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(src))
    S.ingest(read(), root, work, "id")
    S.ingest(read(), root, work, "id")
    spark.createDataFrame([(3, 3), (4, 4)], schema).coalesce(1).write.parquet(str(src / "b"))
    S.ingest(read(), root, work, "id")
    S.ingest(read(), root, work, "id", run="again")
    assert {(r.id, r.status) for r in S.ingested(spark, root, "id").collect()} == {(1, "done"), (2, "failed"), (3, "done"), (4, "done")}
    assert sum(seen) == 3 + 1 + 1  # a new run tries the failed one again, finished ones are left out


def test_reinforcing_many_times(spark):
    n = spark.createDataFrame([("a", 0.9), ("b", None), ("c", 0.96), ("d", 0.5)], "node_id string, confidence double").withColumn("reinforcement_count", F.lit(None).cast("bigint"))
    hits = spark.createDataFrame([(x,) for x in ["a"] * 3 + ["b"] + ["c"] + ["d"] * 2 + [None]], "node_id string")
    got = {r.node_id: (round(r.confidence, 6), r.reinforcement_count) for r in G.reinforced_nodes(n, hits).collect()}
    assert got == {"a": (0.96, 4), "b": (0.72, 2), "c": (0.95, 2), "d": (0.54, 3)}


def test_prefixes_of_ids(spark):
    n = spark.createDataFrame([("chunk_0123456789abcd", None), ("chunk_0123456789abff", None), ("chunk_ffff56789abc0", None), ("plain", None), ("chunk_aaaaaaaaaaaa1", True)], "node_id string, retracted boolean")
    q = ["chunk_0123456789ab", "chunk_0123456789abc", "chunk_ffff56789", "chunk_ffff56789abc", "plain", "pla", None, "chunk_aaaaaaaaaaaa", "chunk_0123456789abcd"]
    got = {r.request: r.node_id for r in G.resolve_prefix(spark.createDataFrame([(x,) for x in q], "request string"), n).collect()}
    assert got == {"chunk_0123456789abc": "chunk_0123456789abcd", "chunk_ffff56789abc": "chunk_ffff56789abc0", "plain": "plain", "chunk_0123456789abcd": "chunk_0123456789abcd"}


def test_aliases_are_added_or_replaced(spark):
    n = spark.createDataFrame([("1", "n", ["a", "b"]), ("2", "m", None), ("3", "k", ["x"])], "node_id string, name string, aliases array<string>")
    a = spark.createDataFrame([("1", "b"), ("1", "c"), ("1", "n"), ("2", "z"), ("2", None), ("9", "q")], "node_id string, alias string")
    assert {r.node_id: r.aliases for r in G.add_aliases(n, a).collect()} == {"1": ["a", "b", "c"], "2": ["z"], "3": ["x"]}
    assert {r.node_id: r.aliases for r in G.add_aliases(n, a, replace=True).collect()} == {"1": ["b", "c"], "2": ["z"], "3": ["x"]}


def test_survivors_prefer_the_earliest(spark):
    n = spark.createDataFrame([("C", "1", "x", None), ("C", "2", "X ", "2024-01-02"), ("C", "3", "x", "2024-01-01"), ("D", "4", "x", None), ("C", "5", None, None)], "label string, node_id string, name string, created string").withColumn("created_at", F.col("created").cast("timestamp")).withColumn("reinforcement_count", F.lit(1))
    e = spark.createDataFrame([], EDGE)
    assert {(r.node_id, r.survivor_id) for r in G.survivors_of_names(n, e).collect()} == {("1", "3"), ("2", "3")}


def test_described_figures_ground_nothing(spark):
    from lodeweave.operators import knowledge as K

    c = spark.createDataFrame([("c", "current mirror"), ("c", "bandgap core")], "chunk_id string, name string")
    x = spark.createDataFrame([("c", "The bandgap core. <<figure>>a current mirror<</figure>>")], "chunk_id string, text string")
    e = spark.createDataFrame([], "chunk_id string, source_name string, target_name string")
    assert [r.name for r in K.grounding_filter(c, e, x)[0].collect()] == ["bandgap core"]


def test_encoder_hook(spark):
    from lodeweave.operators import knowledge as K

    todo = spark.createDataFrame([("1", "ab"), ("2", ""), ("3", None), ("4", "odd")], "node_id string, text string")
    got = {r.node_id: r.embedding for r in K.embedded(todo, lambda ts: [[float(len(t)), 1.0] if t != "odd" else [1.0] for t in ts], 2).collect()}
    assert got == {"1": [2.0, 1.0]}


def test_journal(spark, tmp_path):
    p = str(tmp_path / "j")
    for day in ("2026-01-01", "2026-01-02", "2026-01-02"):
        I.journal_append(spark.createDataFrame([(day, "op")], "ts string, op string"), p, F.col("ts"))
    assert I.journal_rotate(spark, p, "2026-01-02") == 1 and spark.read.json(p).count() == 2


def test_timed_breaker(spark):
    from datetime import datetime, timedelta

    from lodeweave.operators.memory import timed_breaker

    t0 = datetime(2026, 1, 1)
    calls = [(0, True), (1, True), (2, True), (3, False), (100, True), (123, True), (124, False), (244, False), (245, True), (246, None)]
    rows = [("a", t0 + timedelta(seconds=s), i, f) for i, (s, f) in enumerate(calls)] + [(None, t0, 1, True), ("b", t0, 1, True)]
    df = spark.createDataFrame(rows, "k string, at timestamp, n int, failed boolean")
    got = {r.n: (r.allowed, r.state, r.streak) for r in timed_breaker(df, "k", "at", "n", "failed").filter("k = 'a'").collect()}
    assert got == {0: (True, "closed", 1), 1: (True, "closed", 2), 2: (True, "open", 3), 3: (False, "open", 3), 4: (False, "open", 3), 5: (True, "open", 4), 6: (False, "open", 4), 7: (True, "closed", 0), 8: (True, "closed", 1), 9: (True, "closed", 0)}
    assert timed_breaker(df, "k", "at", "n", "failed").count() == 12 and timed_breaker(df.limit(0), "k", "at", "n", "failed").count() == 0


def test_delta_appends_evidence(spark):
    e = spark.createDataFrame([("1", "R", "2", 0.5, None, 1, ["x"]), ("1", "R", "3", 0.5, 4, 1, None)], "src_id string, rel_type string, dst_id string, confidence double, reinforcement_count int, last_reinforced int, evidence array<string>")
    d = spark.createDataFrame([("1", "R", "2", 5, ["y", "x"]), ("1", "R", "2", 4, ["z"]), ("1", "R", "2", 6, None)], "src_id string, rel_type string, dst_id string, at int, evidence array<string>")
    got = {r.dst_id: (r.reinforcement_count, r.last_reinforced, r.evidence) for r in G.reinforce_by_delta(e, d).collect()}
    assert got == {"2": (4, 6, ["x", "z", "y", "x"]), "3": (4, 1, [])}


def test_unseeded_drift_is_noise(spark):
    from lodeweave.operators.evidence import drift

    f = spark.createDataFrame([("a", "p", True, "REFUTED", 1.0, "statistical", False), ("b", "p", True, "REFUTED", 1.0, "statistical", True), ("c", "p", True, "REFUTED", 1.0, "value", None), ("d", "p", False, None, None, "elasticity", None)], "claim_id string, pdk string, ok boolean, verdict string, scalar double, kind string, seeded boolean")
    s = spark.createDataFrame([(c, "p", "VERIFIED", 1.0, 0.1) for c in "abcd"], "claim_id string, pdk string, verdict string, scalar double, tolerance double")
    assert {r.claim_id: r.drift for r in drift(s, f).collect()} == {"a": "NOISE", "b": "DRIFTED", "c": "DRIFTED", "d": "ERROR"}
