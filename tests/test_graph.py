"""Graph operators on literal rows."""

import random

import pytest

from lodeweave.operators import graph as G
from lodeweave.operators.components import connected_components

E = "src_id string, rel_type string, dst_id string, confidence double, reinforcement_count bigint"
N = "label string, node_id string, name string, domain string, confidence double, reinforcement_count bigint, retracted boolean"


def test_components_match_union_find(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(7, 7), (500, 500)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = connected_components(spark.createDataFrame([*pairs, (None, 1)], "a int, b int"))
    assert {r.node: r.component for r in got.collect()} == {x: root(x) for p in pairs for x in p}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


@pytest.mark.parametrize("c, want", [(0.5, 0.52), (0.94, 0.96), (0.95, 0.95), (0.99, 0.95), (None, 0.72)])
def test_reinforce_overshoots_then_caps(spark, c, want):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(c,)], "c double").select(G.reinforce(F.col("c"), 0.02).alias("r")).first().r
    assert got == pytest.approx(want) if want is not None else got is None


def test_neighbourhood_keeps_the_shortest(spark):
    e = spark.createDataFrame([("a", "R", "b", 1.0, 1), ("b", "R", "c", 1.0, 1), ("a", "S", "c", 1.0, 1), ("c", "R", "d", 1.0, 1), ("a", "R", "a", 1.0, 1)], E)
    got = {(r.node_id, r.distance, r.direction) for r in G.neighbourhood(e, spark.createDataFrame([("a",)], "node_id string"), 2).collect()}
    assert got == {("b", 1, "->"), ("c", 1, "->"), ("d", 2, "->")}


def test_merge_is_idempotent_and_protects(spark):
    old = spark.createDataFrame([("Concept", "1", "old", None, 0.5, 1, None)], N)
    new = spark.createDataFrame([("Concept", "1", "new", "d", None, None, None), ("Concept", "2", "two", "d", 0.1, 1, False), ("Concept", None, "x", "d", 0.1, 1, False)], N)
    once = G.merge_nodes(old, new)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, G.merge_nodes(once, new).collect()))
    row = {r.node_id: r for r in once.collect()}
    assert set(row) == {"1", "2"} and row["1"].name == "old" and row["1"].domain == "d" and row["1"].confidence == 0.5


def test_rewire_drops_loops_and_keeps_the_unmoved(spark):
    e = spark.createDataFrame([("a", "R", "x", 0.9, 1), ("b", "R", "x", 0.2, 5), ("a", "R", "b", 0.5, 1)], E)
    got = G.rewire(e, spark.createDataFrame([("a", "b")], "node_id string, survivor_id string")).collect()
    assert [(r.src_id, r.dst_id, r.confidence) for r in got] == [("b", "x", 0.2)]


def test_bridges_do_not_depend_on_partitioning(spark):
    n = spark.createDataFrame([("Concept", i, i, "d" + i[-1], 1.0, 1, None) for i in ("c1", "c2", "c3")] + [("Parameter", p, p.upper(), None, 1.0, 1, None) for p in "pqr"], N)
    e = spark.createDataFrame([(c, "DEPENDS_ON", p, 1.0, 1) for c in ("c1", "c2", "c3") for p in "pqr"] + [("c2", "TRADES_OFF", "c1", 1.0, 1)], E)
    a = sorted(map(str, G.bridges(n, e).collect()))
    assert a == sorted(map(str, G.bridges(n.repartition(7), e.repartition(5)).collect())) and len(a) == 2
