"""Nearest vectors: recall against brute force, unusable vectors, repeated rows, hot buckets."""

import numpy as np
import pytest

from lodeweave.llm import knn as K

S = "memory_id string, last_accessed timestamp_ntz, embedding array<float>"


def truth(ids, v, asked, k):
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = v @ v.T
    np.fill_diagonal(s, -9)
    return {(ids[q], ids[j]) for q in asked for j in np.argsort(-s[q], kind="stable")[:k]}


def test_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 64))
    v = (centres[rng.integers(0, 60, 3000)] + 0.35 * rng.normal(size=(3000, 64))).astype(np.float32)
    ids = [f"m{i:04d}" for i in range(3000)]
    df = spark.createDataFrame([(i, None, x.tolist()) for i, x in zip(ids, v)], S)
    q = spark.createDataFrame([(i,) for i in ids[::100]] + [("absent",), (None,), (ids[0],)], "memory_id string")
    got = K.nearest(df, q, 5).collect()
    want = truth(ids, v, range(0, 3000, 100), 5)
    assert len(got) == len(want) and len({(r.query_id, r.id) for r in got} & want) >= 0.9 * len(want)
    assert all(r.query_id != r.id for r in got)


def test_every_row_as_query_and_hot_bucket(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 50)
    v = [[1.0] * 64] * 400
    df = spark.createDataFrame([(f"s{i:03d}", None, x) for i, x in enumerate(v)], S)
    got = K.nearest(df, None, 3).groupBy("query_id").count().collect()
    assert len(got) == 400 and {r["count"] for r in got} == {3}


def test_every_vector_finds_its_neighbours(spark, monkeypatch):
    """Recall over all vectors, with small buckets, with parts and with probes."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(80, 64))
    v = (centres[rng.integers(0, 80, 2500)] + 0.3 * rng.normal(size=(2500, 64))).astype(np.float32)
    ids = [f"m{i:04d}" for i in range(2500)]
    df = spark.createDataFrame([(i, None, x.tolist()) for i, x in zip(ids, v)], S)
    want = truth(ids, v, range(2500), 5)
    got = K.all_nearest(df, 5).collect()
    assert len({(r.query_id, r.id) for r in got} & want) >= 0.9 * len(want)
    assert all(r.query_id != r.id for r in got) and len({(r.query_id, r.rank) for r in got}) == len(got)
    monkeypatch.setattr(K, "WORK", 5)
    h, ids0, sims0 = np.arange(2500), np.full((2500, 5), K.NONE), np.full((2500, 5), -9.0, dtype=np.float32)
    u = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    for table in range(6):
        ids0, sims0 = K._best_inside(h, u, ids0, sims0, table, 1, 5)
    assert len({(ids[q], ids[j]) for q, row in enumerate(ids0) for j in row if j >= 0} & want) >= 0.5 * len(want)


def test_every_vector_unusable_rows_and_hot_bucket(spark, monkeypatch):
    from datetime import datetime as D

    monkeypatch.setattr(K, "NODE", 64)
    ok = [1.0] + [0.0] * 63
    rows = [(f"s{i:03d}", None, ok) for i in range(200)] + [("c", None, None), ("d", None, [0.0] * 64), ("e", None, [1.0] * 63), ("f", None, [float("nan")] * 64), (None, None, ok), ("s001", None, ok)]
    rows += [("g", D(2025, 1, 1), ok), ("g", D(2025, 1, 2), None)]
    df = spark.createDataFrame(rows, S)
    got = K.all_nearest(df, 3).collect()
    assert {r.query_id for r in got} == {f"s{i:03d}" for i in range(200)} and len(got) == 600 and all(abs(r.similarity - 1) < 0.01 for r in got)
    assert K.all_nearest(df.limit(0), 3).count() == 0


def test_a_large_bucket_meets_itself_whole():
    """Before, a bucket of over 4,096 vectors met about 1,024 of them."""
    v = np.random.default_rng(11).normal(size=(5000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    h = np.arange(5000) * 3
    got, _ = K._best_inside(h, v.astype(np.float32), np.full((5000, 5), K.NONE), np.full((5000, 5), -9.0, dtype=np.float32), 0, 1, 5)
    s = v @ v.T
    np.fill_diagonal(s, -9)
    want = h[np.argsort(-s, axis=1)[:, :5]]
    assert (np.sort(got) == np.sort(want)).all()


@pytest.mark.parametrize("node, sample", [(1 << 17, 1 << 16), (64, 256)])
def test_every_vector_exactly(spark, monkeypatch, node, sample):
    """Regions, vectors near none, equal and opposite ones, ties by the dozen; one part a cell and many."""
    monkeypatch.setattr(K, "NODE", node)
    monkeypatch.setattr(K, "SAMPLE", sample)
    rng = np.random.default_rng(9)
    v = rng.normal(size=(20, 64))[rng.integers(0, 20, 1200)] + 0.35 * rng.normal(size=(1200, 64))
    axes = np.vstack([np.eye(64), -np.eye(64)])
    v = np.vstack([v, rng.normal(size=(300, 64)), axes, np.tile(v[:1], (150, 1)), np.tile(v[1:2], (4, 1)), 2 * v[2:3], np.tile(axes[:1], (9, 1))]).astype(np.float32)
    ids = np.array([f"m{i:04d}" for i in rng.permutation(len(v))])
    got = K.all_nearest(spark.createDataFrame([(i, None, x.tolist()) for i, x in zip(ids, v)], S), 5).collect()
    u = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -9)
    want = {(ids[q], r + 1, ids[j]) for q in range(len(v)) for r, j in enumerate(np.lexsort((ids, -s[q]))[:5])}
    assert {(r.query_id, r["rank"], r.id) for r in got} == want and len(got) == len(want)
    at = {i: n for n, i in enumerate(ids)}
    assert all(abs(r.similarity - s[at[r.query_id], at[r.id]]) < 1e-9 for r in got)


def test_fast_transform_is_a_rotation():
    v = np.random.default_rng(3).normal(size=(4, 64)).astype(np.float32)
    assert np.allclose(np.linalg.norm(K.pseudo_rotated(v, 1, 2), axis=1), np.linalg.norm(v, axis=1), rtol=1e-4)
    assert K.pseudo_rotated(v[:, :50], 0, 0).shape == (4, 64)


def test_unusable(spark):
    from datetime import datetime as D

    ok, back = [1.0] + [0.0] * 63, [0.0] * 63 + [1.0]
    rows = [("a", None, ok), ("b", None, [2.0] + [0.0] * 63), ("c", None, None), ("d", None, [0.0] * 64), ("e", None, [1.0] * 63), ("f", None, [float("nan")] * 64), ("g", None, [None] * 64), ("h", D(2025, 1, 1), ok), ("h", D(2025, 1, 2), back), (None, None, ok), ("a", None, ok), ("i", None, [])]
    df = spark.createDataFrame(rows, S)
    got = {(r.query_id, r.id): r.similarity for r in K.nearest(df.withColumnRenamed("last_accessed", "last_accessed"), None, 5).collect()}
    assert got["a", "b"] == pytest.approx(1.0) and {x for p in got for x in p} <= {"a", "b", "h"}
    assert K.nearest(df.limit(0), None, 5).count() == 0


def test_pairs_are_unordered(spark):
    f = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a")], "query_id string, id string")
    assert {tuple(r) for r in K.neighbour_pairs(f).collect()} == {("a", "b"), ("a", "c")}


def test_quantised_round_trip():
    v = np.random.default_rng(1).normal(size=(5, 64)).astype(np.float32)
    back = K._restored(K._quantised(v).to_pylist())
    assert np.abs(back - v).max() <= np.abs(v).max() / 127


def test_rotations_keep_lengths():
    for m in K.rotations(1, 3, 64):
        assert np.allclose(m @ m.T, np.eye(64), atol=1e-5)
