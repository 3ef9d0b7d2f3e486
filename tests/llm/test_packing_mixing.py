"""Packing never splits what fits nor overfills; mixing meets its budgets."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodeweave.llm import mixing as M
from lodeweave.llm import packing as P
from lodeweave.llm.tokens import encoding, RANKS

D = "doc_id bigint, text string, source string"
WORDS = "corner sweep margin loop gain bias clock tree output stage".split()


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 5, 5, 5, 40, 90, 700]))), rng.choice(["a_b", "A-b", " a b ", "c", "d", None])) for i in range(600)]
    return spark.createDataFrame([*rows, (900, "", "c"), (901, None, "c"), (902, "x" * 30_000, "d")], D)


@pytest.fixture(scope="module")
def sizes(docs):
    enc = encoding(RANKS)
    return {r.doc_id: len(enc.encode_ordinary(r.text)) if r.text else 0 for r in docs.collect()}


def test_packing(spark, docs, sizes):
    kinds = spark.createDataFrame([("small", 64), ("large", 500), ("small", 64), (None, 5), ("bad", 0), ("none", None)], "pack_name string, capacity_tokens int")
    got = P.pack(docs.withColumn("size", F.lit(1)).withColumn("container", F.lit(1)), kinds).collect()
    for name, cap in (("small", 64), ("large", 500)):
        mine = [r for r in got if r.pack_name == name]
        per, load, left = defaultdict(list), Counter(), {}
        for r in mine:
            per[r.doc_id].append(r.piece_tokens)
            load[r.container] += r.piece_tokens
            if r.piece_tokens:
                left.setdefault(r.container, set()).add(r.unused_tokens)
        assert {d: sum(x) for d, x in per.items()} == sizes
        assert all(len(x) == max(1, -(-sizes[d] // cap)) for d, x in per.items())
        assert max(load.values()) <= cap and all(left[c] == {cap - load[c]} for c in left)
        assert len(left) <= -(-sum(sizes.values()) // cap) * 1.05 + 1
    assert {r.pack_name for r in got} == {"small", "large"}
    assert P.pack(docs.limit(0), kinds).count() == 0 and P.pack(docs, kinds.limit(0)).count() == 0


def test_summary(spark, docs, sizes):
    r = P.pack_summary(docs, spark.createDataFrame([("m", 128)], "pack_name string, capacity_tokens int")).first()
    assert r.used_tokens == sum(sizes.values()) and r.n_containers * 128 == r.used_tokens + r.unused_tokens


def best_fit_decreasing(items, cap):
    gaps = []
    for s in sorted(items, reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - s)
        else:
            gaps.append(cap - s)
    return gaps


@pytest.mark.parametrize("seed", range(20))
def test_sweep_places_each_piece_in_the_smallest_gap_it_meets(seed):
    """Against a sweep over single gaps and pieces: nothing is used twice, what fits a gap left over is placed."""
    rng = random.Random(seed)
    gaps, items = Counter(rng.randrange(1, 60) for _ in range(rng.randrange(0, 40))), Counter(rng.randrange(1, 60) for _ in range(rng.randrange(0, 90)))
    events = [("gap", v, n, 0) for v, n in gaps.items()] + [("item", v, n, 0) for v, n in items.items()]
    placed, left = P.sweep(events)
    units, ranks = Counter(), Counter()
    for gap, u, k, size, each, rank in placed:
        assert 0 < each * size <= gap
        for i in range(k):
            units[gap, u + i] += 1
        for i in range(k * each):
            ranks[size, rank + i] += 1
    assert set(units.values()) <= {1} and set(ranks.values()) <= {1}
    assert all(sum(1 for g, _ in units if g == v) + sum(n - d for k, w, n, d in left if k == "gap" and w == v) == n for v, n in gaps.items())
    assert all(sum(1 for z, _ in ranks if z == v) + sum(n - d for k, w, n, d in left if k == "item" and w == v) == n for v, n in items.items())
    free = [v for k, v, n, d in left if k == "gap" and n > d]
    assert all(v > max(free, default=0) for k, v, n, d in left if k == "item" and n > d)


@pytest.mark.parametrize("seed, cap", [(1, 100), (2, 37)])
def test_placements_against_best_fit_decreasing(spark, seed, cap):
    rng = random.Random(seed)
    items = [rng.randrange(1, cap + 1) if rng.random() < 0.5 else rng.randrange(1, cap // 4) for _ in range(3000)]
    rows = [("a", cap, s, n) for s, n in Counter(items).items()] + [("b", 10, 10, 5), ("b", 10, 0, 7)]
    got = P.placements(spark.createDataFrame(rows, "pack_name string, capacity long, size long, n long")).collect()
    load, seen = Counter(), Counter()
    for r in got:
        for i in range(r.until - r.rank):
            seen[r.pack_name, r["size"], r.rank + i] += 1
            load[r.pack_name, r.container + i // r.each] += r["size"]
    assert set(seen.values()) == {1} and len(seen) == len(items) + 5
    mine = [v for (p, _), v in load.items() if p == "a"]
    assert max(mine) <= cap and len(mine) == 1 + max(c for p, c in load if p == "a")
    assert len(mine) <= len(best_fit_decreasing(items, cap)) * 1.01 + 1
    assert sorted(v for (p, _), v in load.items() if p == "b") == [10] * 5


def test_mixture(spark, docs, sizes):
    t = spark.createDataFrame([("A_B", 0.2, 1), ("c", 0.7, 2), ("missing", 0.1, 3), ("c", None, None), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    got = M.mixture(docs.withColumn("before", F.lit(0)).withColumn("rest", F.lit(0)), t).collect()
    assert len(got) == 603 and {r.doc_id: r.tokens for r in got} == sizes
    total, most = sum(sizes.values()), max(sizes.values())
    have, used, uses = Counter(), Counter(), defaultdict(set)
    for r in got:
        have[r.source] += r.tokens
        used[r.source] += r.tokens * r.uses
        uses[r.source].add(r.uses)
    for s, share, cap in (("a_b", 0.2, 1), ("c", 0.7, 2)):
        budget = min(int(share * total), cap * have[s])
        assert budget - most <= used[s] <= budget and max(uses[s]) <= cap and max(uses[s]) - min(uses[s]) <= 1
    assert used["d"] == 0 and used[None] == 0
    again = {(r.doc_id, r.uses) for r in M.mixture(docs.repartition(7), t).collect()}
    assert again == {(r.doc_id, r.uses) for r in got}


def test_shares(spark, docs):
    t = spark.createDataFrame([("c", 0.3, 1), ("missing", 0.1, 3)], "source string, target_share double, max_repeats int")
    got = {r.source: r for r in M.mixture_shares(docs, t).collect()}
    assert got["missing"].used_tokens == 0 and got["c"].actual_share == pytest.approx(1.0) and got["d"].target_share == 0
    assert M.mixture(docs.limit(0), t).count() == 0 and M.mixture(docs, t.limit(0)).filter("uses > 0").count() == 0


def test_prefix_sums(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("g"), F.xxhash64("id").alias("k"), (F.col("id") % 7).alias("n"))
    rows = M.prefix_sums(df, "g", "k", "n", "id", 16).collect()
    want, run = {}, Counter()
    for r in sorted(rows, key=lambda r: (r.g, r.k, r.id)):
        want[r.id] = run[r.g]
        run[r.g] += r.n
    assert {r.id: r.before for r in rows} == want
