"""Near duplicates against brute force; copies, hot copies, nulls, groups."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodeweave.llm import neardup as N

S = "record_kind string, record_id string, content string, at timestamp_ntz"


def brute(rows, t=0.7):
    import re

    sets = {}
    for k, i, c, _ in rows:
        w = re.findall("[a-z0-9]+", (c or "").lower())
        if len(w) >= 8 and i is not None:
            sets[k, i] = set(zip(w, w[1:]))
    keys = sorted(sets)
    return {(a[0], a[1], b[1]) for x, a in enumerate(keys) for b in keys[x + 1 :] if a[0] == b[0] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    out = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.randrange(8, 90))]
        for j in range(rng.randrange(1, 5)):
            t = base[:]
            for _ in range(rng.randrange(0, 1 + len(t) // 20)):
                t.insert(rng.randrange(len(t)), rng.choice(words))
            out.append(("memory" if i % 2 else "insight", f"r{i}_{j}", " ".join(t), None))
    return [*out, ("memory", "none", None, None), ("memory", "empty", "", None), ("memory", "short", "too short", None), ("memory", None, "a b c d e f g h", None)]


def test_pairs_match_brute_force(spark, rows):
    got = [tuple(r) for r in N.near_duplicate_pairs(spark.createDataFrame(rows, S)).collect()]
    want = brute(rows)
    assert len(got) == len(set(got)) and set(got) <= want and len(want - set(got)) <= 0.02 * len(want)


def test_partitioning_does_not_matter(spark, rows):
    df = spark.createDataFrame(rows, S)
    key = lambda d: sorted(map(tuple, N.near_duplicate_pairs(d).collect()))
    assert key(df.repartition(1)) == key(df.repartition(9))


def test_copies(spark):
    text = "one two three four five six seven eight nine"
    df = spark.createDataFrame([("memory", i, t, None) for i, t in (("b", text), ("a", text.upper()), ("a", text.upper()), ("c", text + "!"), ("d", text + " ten"))], S)
    assert {tuple(r)[1:] for r in N.near_duplicate_pairs(df).collect()} == {("a", "b"), ("a", "c"), ("b", "c"), ("a", "d"), ("b", "d"), ("c", "d")}
    star = {tuple(r)[1:] for r in N.near_duplicate_pairs(df, expand=2).collect()}
    assert star == {("a", "b"), ("a", "c"), ("a", "d")}


def test_groups(spark):
    a = " ".join(f"x{i}" for i in range(30))
    df = spark.createDataFrame([("memory", "1", a, None), ("memory", "2", a + " y", None), ("memory", "3", a + " y z", None), ("insight", "4", a, None), ("memory", "5", " ".join(f"q{i}" for i in range(30)), None)], S)
    got = {r.record_id: r for r in N.near_duplicate_groups(df.withColumn("group_id", F.lit(0)).withColumn("n", F.lit(0))).collect()}
    assert len({got[i].group_id for i in "123"}) == 1 and len({got[i].group_id for i in "1245"}) == 3
    assert [got[i].n_links for i in "12345"] == [2, 2, 2, 0, 0]


def test_latest_state(spark):
    from datetime import datetime as D

    t = "one two three four five six seven eight"
    df = spark.createDataFrame([("memory", "a", t, D(2025, 1, 1)), ("memory", "a", "other words that stand here instead of them all", D(2025, 1, 2)), ("memory", "b", t, None)], S)
    assert N.near_duplicate_pairs(df).count() == 0


def test_empty_and_long(spark):
    df = spark.createDataFrame([], S)
    assert N.near_duplicate_pairs(df).count() == 0 and N.near_duplicate_groups(df).count() == 0
    long = " ".join(f"v{i}" for i in range(100_000))
    df = spark.createDataFrame([("memory", "a", long, None), ("memory", "b", long + " end", None)], S)
    assert N.near_duplicate_pairs(df).count() == 1


def test_streamed_pairs_cross_batches():
    import numpy as np
    import pyarrow as pa

    k = np.repeat(np.arange(1, 6), [1, 3, 1, 4, 2]) << 12 | 50
    c = np.arange(len(k))
    batch = lambda lo, hi: pa.RecordBatch.from_arrays([pa.array(k[lo:hi]), pa.array(c[lo:hi]), pa.array(np.zeros(hi - lo, dtype=np.int64))], names=["k", "class_id", "bits"])
    for cuts in ([0, 11], [0, 2, 3, 6, 11], [0, 5, 5, 8, 11], list(range(12))):
        got = sorted((a, b) for out in N._pairs([batch(x, y) for x, y in zip(cuts, cuts[1:])], 0.7) for a, b in zip(out["a"].to_pylist(), out["b"].to_pylist()))
        assert got == [(1, 2), (1, 3), (2, 3), (5, 6), (5, 7), (5, 8), (6, 7), (6, 8), (7, 8), (9, 10)]


def test_no_pair_at_the_threshold_is_lost(spark):
    """Many pairs a little above or at 0.70, as runs of words cut to a common part; word pairs that all texts share are the last in the order."""
    rng = random.Random(5)
    out = []
    for i in range(1500):
        n = rng.randrange(20, 60)
        part = -(-14 * n // 17)  # the common word pairs of two sets of n at 0.70
        base = [f"s{rng.randrange(40)}" if rng.random() < 0.5 else f"u{rng.randrange(9000)}" for _ in range(n + 1)]
        tail = lambda: [f"t{rng.randrange(9000)}" for _ in range(n - part)]
        out += [("memory", f"p{i}_{j}", " ".join(base[: part + 1] + tail()), None) for j in "ab"]
    sets = {i: set(zip(c.split(), c.split()[1:])) for _, i, c, _ in out}
    want = {(f"p{i}_a", f"p{i}_b") for i in range(1500) if len(sets[f"p{i}_a"] & sets[f"p{i}_b"]) >= 0.7 * len(sets[f"p{i}_a"] | sets[f"p{i}_b"])}
    got = {tuple(r)[1:] for r in N.near_duplicate_pairs(spark.createDataFrame(out, S)).collect()}
    assert len(want) > 1000 and got == want


def test_hot_word_pairs_are_split_without_loss(spark, rows):
    df = spark.createDataFrame(rows, S)
    key = lambda d: sorted(tuple(r)[:2] for r in d.collect())
    whole = key(N.similar_classes(df))
    assert len(whole) > 20 and key(N.similar_classes(df, hot=3)) == whole


def test_further_orders_keep_every_pair_at_the_threshold():
    """Prefixes under each order meet for all pairs that reach the threshold; most others fail under one."""
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(60):
        base = [words[i] for i in rng.integers(0, 400, 40)]
        texts += [" ".join(base)]
        for edits in (1, 3, 5, 9, 20):
            t = list(base)
            for i in rng.integers(0, 40, edits):
                t[i] = words[rng.integers(0, 400)]
            texts.append(" ".join(t))
    sets = [set(zip(t.split(), t.split()[1:])) for t in texts]
    pairs = [(i, j) for i in range(0, 360, 6) for j in range(i + 1, i + 6)] + [(i, i + 6) for i in range(0, 350, 6)]
    batch = pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs]), pa.array([p[1] for p in pairs]), *(pa.array([N._MARK + texts[p[k]] for p in pairs]) for k in (0, 1))], names=["a", "b", "text_a", "text_b"])
    got = {(r["a"], r["b"]): r["similarity"] for out in N._similarity([batch]) for r in out.to_pylist()}
    real = {p: len(sets[p[0]] & sets[p[1]]) / len(sets[p[0]] | sets[p[1]]) for p in pairs}
    assert {p for p, s in real.items() if s >= 0.7} <= set(got) and len(got) < len(pairs)
    assert all(abs(got[p] - real[p]) < 1e-9 for p in got)


def test_counts_come_from_every_text(spark, rows):
    """Each text counts, copies once in a task."""
    df = spark.createDataFrame([*rows, *rows], S).coalesce(1)
    texts = {(k, tuple(w)) for k, i, c, _ in rows if i is not None and len(w := N._WORD.findall((c or "").lower())) >= N.MIN_WORDS}
    _, b = N.pair_sets([" ".join(w) for _, w in texts])
    want = np.bincount((b & np.uint64(N.BUCKETS - 1)).astype(np.int64), minlength=N.BUCKETS)
    assert (N.word_pair_counts(df) == want).all()
    assert N._added(np.zeros(N.BUCKETS, np.int64), N._pieces(want * 70_000)).max() == want.max() * 70_000
