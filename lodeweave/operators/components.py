"""Connected components of an undirected graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.session import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, small: int = 50_000) -> DataFrame:
    """(node, component): component is the smallest node that can be reached.

    Alternating large-star and small-star rounds: each round links every node to the smallest
    node around it, so a chain of n nodes needs about log n rounds and no row ever holds a
    component. A hub's neighbours are never gathered: only the minimum per node is aggregated
    (with map-side combining) and joined back. Each round is cut by checkpoint(). Null ends
    and self-loops link nothing; a node that only loops is its own component. The loop ends
    when a round changes nothing; ``max_rounds`` guards against a defect and raises. A graph of at most ``small``
    distinct edges is united in one task of that bounded size; the result is the same.
    """
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    nodes = ends.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    e = cut(ends.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    kind = dict(e.dtypes)["u"]
    if e.count() <= small:
        found = e.coalesce(1).mapInPandas(_united, f"node {kind}, component {kind}")
        return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    before = None
    for _ in range(max_rounds):
        large = _star(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), True)
        e = cut(_star(large, False))
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not converge")
    found = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _united(batches):
    import pandas as pd

    parent: dict = {}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for pdf in batches:
        for u, v in zip(pdf["u"], pdf["v"]):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    yield pd.DataFrame({"node": list(parent), "component": [root(x) for x in parent]})


def _star(e: DataFrame, large: bool) -> DataFrame:
    """Large star: link each larger neighbour to the smallest of (node, neighbours); small star: the smaller ones and the node."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    m = least.select("u", F.least("u", "m").alias("m"))
    joined = e.join(m, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(m.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()
