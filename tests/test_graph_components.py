"""Components of the whole edges view against plain union-find."""

from lodeweave.plans import graph as P
from lodeweave.sources.views import view


def test_components_cover_every_edge(spark, sf_dir):
    parent: dict = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in view(spark, sf_dir, "edges").select("src_id", "dst_id").collect():
        if a is not None and b is not None:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in P.queries()["graph_components"](spark, sf_dir).collect()}
    assert got == {x: root(x) for x in parent}


def test_rounds_and_one_task_agree(spark):
    """A chain, a hub, loops and null ends: rounds of stars give what one bounded task gives."""
    from lodeweave.operators.components import connected_components

    rows = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(120)] + [("hub", f"x{i}") for i in range(150)] + [("solo", "solo"), (None, "a"), ("b", None)]
    edges = spark.createDataFrame(rows, "a string, b string")
    one, many = ({tuple(r) for r in connected_components(edges, small=n).collect()} for n in (10_000, 0))
    assert one == many and len(one) == 121 + 151 + 1 and ("c120", "c000") in one and ("solo", "solo") in one
    assert connected_components(edges.limit(0)).count() == 0 and connected_components(edges.limit(0), small=-1).count() == 0
