"""Nearest vectors by cross-polytope hashing with multiprobe tables."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.llm.survivorship import latest_rows

DIM = 64
TABLES = 5
HASHES = 3  # cross-polytopes joined in a table's key
PROBES = 20  # buckets a query visits in each table
BLOCK = 1 << 16


def usable(entries: DataFrame) -> DataFrame:
    """(id, embedding): each memory's latest row; whether the embedding is usable is seen where it is read."""
    return latest_rows(entries, ["embedding"]).filter("embedding is not null").select(F.col("memory_id").alias("id"), "embedding")


def units(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the lists with ``dim`` finite values, not all zero, and their unit vectors."""
    at = np.flatnonzero(pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == dim)
    flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
    v = np.asarray(flat, dtype=np.float64).reshape(-1, dim)
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.sqrt((v * v).sum(axis=1))
    good = np.isfinite(norm) & (norm > 0)
    return at[good], v[good] / norm[good][:, None]


def rotations(tables: int, hashes: int, dim: int) -> list[np.ndarray]:
    """Pseudo-rotations H D3 H D2 H D1 of Walsh-Hadamard matrices and random signs, multiplied out (dim is padded to a power of two)."""
    d = 1 << (dim - 1).bit_length()
    h = np.ones((1, 1))
    while len(h) < d:
        h = np.block([[h, h], [h, -h]])
    h /= np.sqrt(d)
    rng = np.random.default_rng(64)
    out = []
    for _ in range(tables * hashes):
        m = np.eye(d)
        for _ in range(3):
            m = h @ (rng.choice([-1.0, 1.0], d)[:, None] * m)
        out.append(m.T[:dim].astype(np.float32))
    return out


def _quantised(v: np.ndarray) -> pa.Array:
    scale = np.abs(v).max(axis=1, keepdims=True) / 127
    q = np.round(v / scale).astype(np.int8)
    packed = np.hstack([scale.astype(np.float32).view(np.uint8).reshape(len(v), 4), q.view(np.uint8)])
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(packed.shape[1]), len(v), [None, pa.py_buffer(np.ascontiguousarray(packed).tobytes())]).cast(pa.binary())


def _restored(blobs) -> np.ndarray:
    raw = np.frombuffer(b"".join(blobs), dtype=np.uint8).reshape(len(blobs), -1)
    return raw[:, 4:].view(np.int8).astype(np.float32) * np.ascontiguousarray(raw[:, :4]).view(np.float32)


def _hash_base(batches, tables, hashes, dim, with_vector):
    rot = rotations(tables, hashes, dim)
    width = 2 * rot[0].shape[1]
    for batch in batches:
        at, v = units(batch.column("embedding"), dim)
        if not len(at):
            continue
        v = v.astype(np.float32)
        packed = _quantised(v) if with_vector else None
        ids = batch.column("id").take(pa.array(at)) if with_vector else None
        for t in range(tables):
            key = np.full(len(v), t, dtype=np.int64)
            for m in rot[t * hashes : (t + 1) * hashes]:
                a = v @ m
                top = np.argmax(np.abs(a), axis=1)
                key = key * width + 2 * top + (a[np.arange(len(v)), top] < 0)
            if with_vector:
                yield pa.RecordBatch.from_arrays([pa.array(key), ids, packed], names=["bucket", "id", "q"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(key)], names=["bucket"])


def _hash_queries(batches, tables, hashes, dim, probes):
    rot = rotations(tables, hashes, dim)
    width = 2 * rot[0].shape[1]
    near = 4
    combos = np.array(list(product(range(near), repeat=hashes)))
    for batch in batches:
        at, v = units(batch.column("embedding"), dim)
        if not len(at):
            continue
        v = v.astype(np.float32)
        packed = _quantised(v)
        for t in range(tables):
            key, cost = np.full((len(v), len(combos)), t, dtype=np.int64), 0.0
            for j, m in enumerate(rot[t * hashes : (t + 1) * hashes]):
                a = v @ m
                o = np.argpartition(-np.abs(a), near, axis=1)[:, :near]
                s = np.take_along_axis(a, o, 1)
                by = np.argsort(-np.abs(s), axis=1)
                o, s = np.take_along_axis(o, by, 1), np.take_along_axis(s, by, 1)
                code, loss = 2 * o + (s < 0), (np.abs(s[:, :1]) - np.abs(s)) ** 2
                key, cost = key * width + code[:, combos[:, j]], cost + loss[:, combos[:, j]]
            best = np.argsort(cost, axis=1)[:, :probes]
            keys = np.take_along_axis(key, best, 1)
            n = keys.shape[1]
            again = pa.array(np.repeat(np.arange(len(v)), n))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), batch.column("id").take(pa.array(at)).take(again), packed.take(again)], names=["bucket", "id", "q"])


def _score(batches, keep):
    """Stream of rows sorted by (bucket, salt, role): the queries of a bucket come first, then its vectors in any number."""
    at, qid, qv, held, names = None, [], [], None, None
    for batch in batches:
        keys = np.stack([batch.column("bucket").to_numpy(), batch.column("salt").to_numpy().astype(np.int64)])
        role = batch.column("role").to_numpy()
        ids, blobs = batch.column("id").to_pylist(), batch.column("q").to_pylist()
        cuts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(0) | (role[1:] != role[:-1])])
        out_q, out_i, out_s = [], [], []
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(role)]):
            key = (keys[0, lo], keys[1, lo])
            if role[lo] == 0:
                if at != key:
                    at, qid, qv = key, [], []
                qid += ids[lo:hi]
                qv += blobs[lo:hi]
                held = None
            elif at == key:
                if held is None:
                    held, names = _restored(qv), np.array(qid, dtype=object)
                base = _restored(blobs[lo:hi])
                there = np.array(ids[lo:hi], dtype=object)
                for first in range(0, len(qid), 2048):
                    s = held[first : first + 2048] @ base.T
                    if s.shape[1] > keep:
                        best = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
                    else:
                        best = np.tile(np.arange(s.shape[1]), (len(s), 1))
                    out_s.append(np.take_along_axis(s, best, 1).ravel())
                    out_i.append(there[best.ravel()])
                    out_q.append(np.repeat(names[first : first + 2048], best.shape[1]))
        if out_q:
            q, i, x = np.concatenate(out_q), np.concatenate(out_i), np.concatenate(out_s)
            other = q != i
            yield pa.RecordBatch.from_arrays([pa.array(q[other], pa.string()), pa.array(i[other], pa.string()), pa.array(x[other], pa.float32())], names=["query_id", "id", "score"])


def _cosines(batches, dim):
    for batch in batches:
        (_, x), (_, y) = units(batch.column("v"), dim), units(batch.column("w"), dim)
        yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("id"), pa.array((x * y).sum(axis=1))], names=["query_id", "id", "similarity"])


def nearest(entries: DataFrame, queries: DataFrame | None = None, k: int = 5, dim: int = DIM, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES) -> DataFrame:
    """(query_id, id, similarity, rank): the k most similar other memories of each query by cosine.

    entries has memory_id, last_accessed and embedding; every usable embedding is indexed.
    queries is a table with memory_id (all memories if None); one that has no usable
    embedding gives no rows. A table's key joins ``hashes`` cross-polytopes: the nearest
    signed axis after a fast Hadamard pseudo-rotation. Each vector is stored once per table,
    quantised to a byte per value; a query visits the ``probes`` likeliest buckets of each
    table. Buckets are read as a sorted stream, so their size costs no memory; large buckets
    are split into blocks of ``BLOCK`` vectors, their queries repeated for each.
    The best k+5 per query by quantised score are ranked again by the exact cosine, ties by
    id. Recall against brute force is measured in the tests.
    """
    base = usable(entries)
    asked = base if queries is None else base.join(queries.select(F.col("memory_id").alias("id")).filter("id is not null").distinct(), "id", "left_semi")
    stored = base.mapInArrow(lambda it: _hash_base(it, tables, hashes, dim, True), "bucket long, id string, q binary")
    raw = entries.select("embedding").filter("embedding is not null")
    keys = raw.mapInArrow(lambda it: _hash_base(it, tables, hashes, dim, False), "bucket long")
    # At most 2**16 buckets can hold more than that share of all; blocks of them have about BLOCK vectors and as many queries.
    counts = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    hot = F.broadcast(counts.filter((F.col("n") > keys.agg(F.count(F.lit(1))).scalar() / 2**16) & (F.col("n") > BLOCK)).select("bucket", blocks.alias("blocks"), (blocks if queries is None else F.ceil(blocks / 16).cast("int")).alias("groups")))
    one = F.lit(1)
    mine = lambda n: F.pmod(F.xxhash64("id"), F.coalesce(F.col(n), one)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), one) - 1))
    salt = (F.col("group") * F.coalesce(F.col("blocks"), one) + F.col("block")).alias("salt")
    b = stored.join(hot, "bucket", "left").withColumn("block", mine("blocks")).withColumn("group", all_of("groups")).select("bucket", salt, F.lit(1).alias("role"), "id", "q")
    probed = asked.mapInArrow(lambda it: _hash_queries(it, tables, hashes, dim, probes), "bucket long, id string, q binary")
    q = probed.join(hot, "bucket", "left").withColumn("group", mine("groups")).withColumn("block", all_of("blocks")).select("bucket", salt, F.lit(0).alias("role"), "id", "q")
    met = q.unionByName(b).repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "role")
    scored = met.mapInArrow(lambda it: _score(it, k + 1), "query_id string, id string, score float")
    once = scored.repartition("query_id").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    first = once.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter(F.col("r") <= k + 5)
    pairs = first.select("query_id", "id").join(base.withColumnRenamed("embedding", "w"), "id").join(asked.select(F.col("id").alias("query_id"), F.col("embedding").alias("v")), "query_id")
    exact = pairs.select("query_id", "id", "v", "w").mapInArrow(lambda it: _cosines(it, dim), "query_id string, id string, similarity double")
    ranked = exact.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")))
    return ranked.filter(F.col("rank") <= k)


def _fwht(v: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (a power of two wide), orthonormal."""
    n, d = v.shape
    step = 1
    while step < d:
        v = v.reshape(n, d // (2 * step), 2, step)
        v = np.stack([v[:, :, 0] + v[:, :, 1], v[:, :, 0] - v[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return v / np.float32(np.sqrt(d))


def pseudo_rotated(v: np.ndarray, table: int, level: int) -> np.ndarray:
    """H D3 H D2 H D1 v by fast transforms; each table and level has its own random signs; v is padded to a power of two."""
    d = 1 << (v.shape[1] - 1).bit_length()
    if d > v.shape[1]:
        v = np.pad(v, ((0, 0), (0, d - v.shape[1])))
    rng = np.random.default_rng([64, table, level])
    for _ in range(3):
        v = _fwht(v * rng.choice(np.array([-1, 1], dtype=np.float32), d))
    return v


def _axis(a: np.ndarray) -> np.ndarray:
    top = np.argmax(np.abs(a), axis=1)
    return 2 * top + (a[np.arange(len(a)), top] < 0)


NODE = 1 << 17  # vectors that one task holds at once, about 1.5 kB each while it works
BOUND = 1 << 14  # vectors among which the first bound of a k-th best is sought
SAMPLE = 1 << 16  # vectors from which centres of cells are made at once
CELLS = 1 << 13  # centres at most that one sample gives
LINKED = 0.65  # a vector whose best cosine with a centre is below this is near none
SLACK = 8  # neighbours kept beyond k until the exact cosines are known
ROUND = 1e-5  # more than a product of two unit vectors of 32-bit floats can be off
GROUPS = 64  # copies of a part at most, for many visitors
WORK = 1024  # vectors that a block of others is multiplied with at once
NONE = np.int64(-(2**63))


def _blobs(a: np.ndarray) -> pa.Array:
    """Rows as binary values, bytes of equal weight next to each other, so that they compress."""
    n, dim = a.shape
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(n, dim, a.itemsize).transpose(0, 2, 1))
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(dim * a.itemsize), n, [None, pa.py_buffer(planes.tobytes())]).cast(pa.binary())


def _values(column: pa.Array, dim: int, kind: str) -> np.ndarray:
    """The rows that ``_blobs`` packed."""
    n, size = len(column), np.dtype(kind).itemsize
    raw = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(n, size, dim)
    return np.ascontiguousarray(raw.transpose(0, 2, 1)).view(kind).reshape(n, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _hashes(x: np.ndarray) -> np.ndarray:
    """A hash of each row's bytes."""
    words = x.view(np.uint32).astype(np.uint64)
    odd = np.random.default_rng(7).integers(1, 2**63, words.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    h = (words * odd).sum(axis=1, dtype=np.uint64)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _raw(column: pa.Array, at: np.ndarray, dim: int, kind: str) -> np.ndarray:
    """The stated rows, scaled by powers of two to one size, which changes no cosine; zeros have no sign."""
    flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
    x = np.asarray(flat, dtype=kind).reshape(-1, dim)
    return np.ascontiguousarray(np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None]) + np.dtype(kind).type(0))


def _components(v: np.ndarray, least: float) -> np.ndarray:
    """A label for each row: rows with a cosine above ``least`` are linked."""
    lab = np.arange(len(v))
    while True:
        new = lab.copy()
        for lo in range(0, len(v), 512):
            new[lo : lo + 512] = np.where(v[lo : lo + 512] @ v.T > least, lab[None, :], len(v)).min(axis=1, initial=len(v))
        new = np.minimum(new, lab)
        while not np.array_equal(new[new], new):
            new = new[new]
        if np.array_equal(new, lab):
            return lab
        lab = new


def _centres(v: np.ndarray) -> np.ndarray:
    """Centres of the dense regions of unit vectors: leaders further than ``LINKED`` from each other, moved to the means of what is nearest
    to them, those of one region united."""
    v = v.astype(np.float32)
    leaders = np.zeros((0, v.shape[1]), dtype=np.float32)
    for lo in range(0, len(v), 1024):
        block = v[lo : lo + 1024]
        block = block[(block @ leaders.T).max(axis=1, initial=-1) < LINKED]
        while len(block) and len(leaders) < CELLS:
            leaders = np.vstack([leaders, block[:1]])
            block = block[1:][block[1:] @ block[0] < LINKED]
    for turn in range(3):
        if not len(leaders):
            break
        total, count = np.zeros(leaders.shape), np.zeros(len(leaders), dtype=np.int64)
        for rows, s in _products(v, leaders):
            own = s.argmax(axis=1)
            near = s[np.arange(len(own)), own] >= LINKED
            np.add.at(total, own[near], v[rows][near])
            count += np.bincount(own[near], minlength=len(count))
        dense = count >= 4
        leaders = _unit(total[dense]).astype(np.float32)
        if turn == 1:
            lab = _components(leaders, 0.85)
            leaders = _unit(np.array([total[dense][lab == x].sum(axis=0) for x in np.unique(lab)]).reshape(-1, v.shape[1])).astype(np.float32)
    return leaders.astype(np.float64)


def _products(a, b):
    """(rows, their products with all of b) of a few rows at once, in one buffer that stays in the cache."""
    few = max(16, (1 << 20) // max(1, len(b)))
    out = np.empty((few, len(b)), dtype=np.float32)
    for lo in range(0, len(a), few):
        rows = slice(lo, min(len(a), lo + few))
        yield rows, np.matmul(a[rows], b.T, out=out[: rows.stop - lo])


class _Cells:
    """Centres of dense regions; of each cell the vectors and the widest angle. What is near no centre is in the last cell, which all visit."""

    def __init__(self, centres):
        self.centres, self.short = centres, centres.astype(np.float32)
        self.size, self.radius = np.zeros(len(centres) + 1), np.zeros(len(centres))

    def place(self, u, measured):
        """Each vector's cell and its angle to the centre; once the angles are ``measured``, none that is wider than the cell's."""
        n = len(self.centres)
        if not n:
            return np.zeros(len(u), dtype=np.int64), np.zeros(len(u))
        own = np.zeros(len(u), dtype=np.int64)
        for rows, cos in _products(u.astype(np.float32), self.short):
            cos.argmax(axis=1, out=own[rows])
        best = np.einsum("nd,nd->n", u, self.centres[own])
        angle = np.arccos(np.clip(best, -1, 1))
        own = np.where(best < LINKED, n, own)
        if measured:  # another rounding of the products may prefer another centre
            for r in np.flatnonzero((own < n) & (angle > np.append(self.radius, np.pi)[own] + 1e-9)):
                fits = np.flatnonzero(np.arccos(np.clip(self.centres @ u[r], -1, 1)) <= self.radius + 1e-9)
                own[r] = fits[0] if len(fits) else n
        return own, angle

    def visits(self, u, own, least):
        """Whether a cell other than its own may hold one of a vector's k best, of which the last has a cosine of ``least`` or more.

        By the triangle inequality of angles: only if the angle to the centre is at most the cell's plus that of ``least``.
        """
        n = len(self.centres)
        need = np.ones((len(u), n + 1), dtype=bool)
        reach = np.arccos(np.clip(least - ROUND, -1, 1))
        if n:
            q = np.hstack([u, -np.cos(reach)[:, None], np.sin(reach)[:, None]]).astype(np.float32)
            c = np.hstack([self.centres, np.cos(self.radius)[:, None], np.sin(self.radius)[:, None]]).astype(np.float32)
            for rows, over in _products(q, c):
                np.greater_equal(over, -3 * ROUND, out=need[rows, :n])
            need[reach + self.radius.max() > np.pi - 0.01, :n] = True
        need &= self.size > 0
        need[np.arange(len(u)), own] = False
        return need


def _left(batches, cells, dim, kind):
    """Unit vectors that are near no centre."""
    for batch in batches:
        at, u = units(batch.column("embedding"), dim)
        u = u[cells.place(u, False)[0] == len(cells.centres)].astype(np.float32)
        yield pa.RecordBatch.from_arrays([_blobs(u)], names=["x"])


def _census(batches, cells, dim):
    """Of each cell the vectors and the widest angle, by batch."""
    for batch in batches:
        _, u = units(batch.column("embedding"), dim)
        own, angle = cells.place(u, False)
        wide = np.zeros(len(cells.size))
        np.maximum.at(wide, own, angle)
        c, n = np.unique(own, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(n.astype(np.int64)), pa.array(wide[c])], names=["cell", "n", "angle"])


def _cells(entries: DataFrame, dim: int, kind: str) -> _Cells:
    """Centres from a sample, then from a sample of what is near none of them, and so on; sizes and angles are those of all vectors."""
    raw = entries.filter("memory_id is not null and embedding is not null").select("memory_id", "embedding")
    cells, left = _Cells(np.zeros((0, dim))), raw.count()
    for _ in range(3):
        every = max(1, -(-left // SAMPLE))
        some = raw.filter(F.pmod(F.xxhash64("memory_id"), F.lit(every)) == 0) if every > 1 else raw
        x = some.mapInArrow(lambda it, c=cells: _left(it, c, dim, kind), "x binary").toArrow().column("x")
        found = _centres(_values(x, dim, "<f4").astype(np.float64))
        cells = _Cells(np.vstack([cells.centres, found]))
        for r in raw.mapInArrow(lambda it, c=cells: _census(it, c, dim), "cell int, n bigint, angle double").groupBy("cell").agg(F.sum("n").alias("n"), F.max("angle").alias("angle")).collect():
            cells.size[r["cell"]] = r["n"]
            if r["cell"] < len(cells.radius):
                cells.radius[r["cell"]] = r["angle"]
        left = int(cells.size[-1])
        if not len(found) or left <= cells.size.sum() / 500:
            break
    return cells


def _placed(batches, cells, dim, kind):
    """Each vector with its cell, large cells in parts of about ``BOUND`` by the hash of the id."""
    parts = np.maximum(1, -(-cells.size // BOUND)).astype(np.int64)
    for batch in batches:
        at, u = units(batch.column("embedding"), dim)
        own, _ = cells.place(u, True)
        part = batch.column("r").to_numpy()[at] % parts[own]
        yield pa.RecordBatch.from_arrays([pa.array((own << 32) | part), batch.column("id").take(pa.array(at)), _blobs(_raw(batch.column("embedding"), at, dim, kind))], names=["cell", "id", "x"])


def _bound(u, x, k):
    """A cosine that a vector's k-th best has at least, by the vectors given; 2 where more than k equal it: its k best are among them."""
    _, first, same, count = np.unique(x.view(f"V{x.shape[1] * x.itemsize}").ravel(), return_index=True, return_inverse=True, return_counts=True)
    v = u[first].astype(np.float32)
    i = np.arange(len(v))
    _, sims = _best_inside(i, v, np.full((len(v), k), NONE), np.full((len(v), k), -9.0, dtype=np.float32), 0, 0, k)
    return np.where(count > k, 2.0, np.maximum(sims[:, -1], -1.0))[same]


def _sent(batches, cells, k, dim, kind, parts, groups):
    """From rows sorted by cell: each vector to its part of its cell (role 0), and as a visitor (role 1) to every other part that may hold one of its k best."""
    place = lambda c, j, g: ((c << 32) | j) * GROUPS + g
    for cell, ids, blobs in _runs(batches, 2 * BOUND):
        x = _values(blobs, dim, kind)
        u, h, least = _unit(x), _hashes(x), _bound(_unit(x), x, k)
        for first in range(0, len(x), 2048):
            some = slice(first, first + 2048)
            own = np.full(len(x[some]), cell >> 32)
            part = (h[some] % parts[own].astype(np.uint64)).astype(np.int64)
            need = cells.visits(u[some], own, least[some])
            need[:, cell >> 32] = parts[cell >> 32] > 1
            need[least[some] > 1.5] = False
            rows, to = np.divmod(np.flatnonzero(need), need.shape[1])
            times = parts[to]
            rows, to = np.repeat(rows, times), np.repeat(to, times)
            j = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
            away = (to != own[rows]) | (j != part[rows])
            rows, to, j = rows[away], to[away], j[away]
            group = ((h[some][rows] >> np.uint64(12)) % groups[to].astype(np.uint64)).astype(np.int64)
            times = groups[own]
            here = np.repeat(np.arange(len(own)), times)
            copy = np.arange(len(here)) - np.repeat(np.cumsum(times) - times, times)
            item = np.concatenate([place(own[here], part[here], copy), place(to, j, group)])
            role = np.repeat(np.array([0, 1], dtype=np.int8), [len(here), len(rows)])
            who = np.concatenate([here, rows]) + first
            for lo in range(0, len(who), 1 << 15):
                w = pa.array(who[lo : lo + (1 << 15)])
                yield pa.RecordBatch.from_arrays([pa.array(item[lo : lo + (1 << 15)]), pa.array(role[lo : lo + (1 << 15)]), ids.take(w), blobs.take(w)], names=["item", "role", "id", "x"])


def _runs(batches, most):
    """(cell, ids, x) of each cell in a stream sorted by it, of at most ``most`` rows at once."""
    ids, blobs, at, size = [], [], None, 0
    for batch in batches:
        b = batch.column("cell").to_numpy()
        cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(b)]):
            lo, n = int(lo), int(hi - lo)
            if ids and (b[lo] != at or size + n > most):
                yield at, pa.concat_arrays(ids), pa.concat_arrays(blobs)
                ids, blobs, size = [], [], 0
            at, size = int(b[lo]), size + n
            ids.append(batch.column("id").slice(lo, n))
            blobs.append(batch.column("x").slice(lo, n))
    if ids:
        yield at, pa.concat_arrays(ids), pa.concat_arrays(blobs)


def _merged(ids, sims, new_ids, new_sims, k):
    """The k best of two lists of neighbours, each id once."""
    i, s = np.concatenate([ids, new_ids], axis=1), np.concatenate([sims, new_sims], axis=1)
    o = np.lexsort((-s, i), axis=1)
    i, s = np.take_along_axis(i, o, 1), np.take_along_axis(s, o, 1)
    s[:, 1:][i[:, 1:] == i[:, :-1]] = -9.0
    o = np.lexsort((i, -s), axis=1)[:, :k]
    return np.take_along_axis(i, o, 1), np.take_along_axis(s, o, 1)


def _top(q, qh, base, bh, k, start=None):
    """The k best of ``base`` for each row of q, never itself: ids and similarities. Every row meets every other; the first
    ``WORK``, from ``start`` on, give the bound that the products with the others are compared with."""
    ids = np.full((len(q), k), NONE)
    sims = np.full((len(q), k), -9.0, dtype=np.float32)
    n = len(base)
    products, above = np.empty(512 * WORK, dtype=np.float32), np.empty(512 * WORK + 8, dtype=bool)
    for lo in range(0, len(q), 512):
        v, own, best, how = q[lo : lo + 512], qh[lo : lo + 512], ids[lo : lo + 512], sims[lo : lo + 512]
        begin = 0 if start is None else max(0, min(n - WORK, start(lo)))
        blocks = [(begin, min(n, begin + WORK)), *((b, min(begin, b + WORK)) for b in range(0, begin, WORK)), *((b, min(n, b + WORK)) for b in range(begin + WORK, n, WORK))]
        met, waiting = [], 0
        for first, last in blocks:
            many = len(v) * (last - first)
            s = np.matmul(v, base[first:last].T, out=products[:many].reshape(len(v), -1))
            if first == begin:
                keep = min(k + 1, last - first)
                o = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
                found, new = np.take_along_axis(s, o, 1), bh[first:last][o]
                found[new == own[:, None]] = -9.0
                o = np.argsort(-found, axis=1, kind="stable")[:, :k]
                new, found = np.take_along_axis(new, o, 1), np.take_along_axis(found, o, 1)
                best[:, : o.shape[1]], how[:, : o.shape[1]] = np.where(found > -2, new, NONE), found
                continue
            np.greater_equal(s, how[:, -1:], out=above[:many].reshape(s.shape))
            above[many : many + 8] = False
            eights = np.flatnonzero(above[: -(-many // 8) * 8].view(np.uint64))
            if not len(eights):
                continue
            hit = (eights[:, None] * 8 + np.arange(8)).ravel()
            hit = hit[above[hit]]
            r, c = hit // s.shape[1], first + hit % s.shape[1]
            other = own[r] != bh[c]
            met.append((r[other], c[other], products[hit[other]]))
            waiting += len(hit)
            if waiting > 8 * len(v):
                _taken(met, best, how, bh, k)
                met, waiting = [], 0
        if met:
            _taken(met, best, how, bh, k)
    return ids, sims


def _taken(met, best, how, bh, k):
    """Put (row, place, similarity) found since into the lists of the k best."""
    r, c, f = (np.concatenate(x) for x in zip(*met))
    some = np.unique(r)
    r, f = np.concatenate([np.repeat(some, k), r]), np.concatenate([how[some].ravel(), f])
    i = np.concatenate([best[some].ravel(), bh[c]])
    o = np.lexsort((-f, r))
    r, f, i = r[o], f[o], i[o]
    rank = np.arange(len(r)) - np.searchsorted(r, r)
    o = rank < k
    best[r[o], rank[o]], how[r[o], rank[o]] = i[o], f[o]


def _best_inside(h, v, ids, sims, table, level, k):
    """The vectors of one bucket against one another, all of them, however many: the nearest signed axes after a fast Hadamard
    pseudo-rotation only set the order, so that a vector meets its likeliest neighbours first and the rest under their bound."""
    order = np.argsort(_axis(pseudo_rotated(v.astype(np.float32), table, level)), kind="stable")
    w, there = np.ascontiguousarray(v[order]), h[order]
    new, how = _top(w, there, w, there, k, lambda lo: lo + 256 - WORK // 2)
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return _merged(ids, sims, new[back], how[back], k)


def _exact(q, base, base32, name, near, sims, k, inside):
    """(row of q, row of base, cosine) of every vector that may be among a row's k best, ties by the rank of the ``name``: the nearest
    by 32-bit products (``near``) are computed again; a row whose list may lack one of them meets the whole base again."""
    out = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
    for lo in range(0, len(q), 4096):
        n, v = near[lo : lo + 4096], q[lo : lo + 4096]
        exact = np.where(n != NONE, np.einsum("qd,qkd->qk", v, base[np.maximum(n, 0)]), -9.0)
        last = np.sort(exact, axis=1)[:, -k]
        lacking = (n[:, -1] != NONE) & (sims[lo : lo + 4096, -1] >= last - 2 * ROUND)
        r, c = np.nonzero((exact >= last[:, None]) & (n != NONE) & ~lacking[:, None])
        out.append((lo + r, n[r, c], exact[r, c]))
        for r in np.flatnonzero(lacking):
            c = np.flatnonzero(base32 @ v[r].astype(np.float32) >= last[r] - 2 * ROUND)
            c = c[c != lo + r] if inside else c
            s = np.einsum("qd,qkd->qk", v[r : r + 1], base[c][None])[0]
            o = np.lexsort((name[c], -s))[:k]
            c, s = c[o], s[o]
            out.append((np.full(len(c), lo + r), c, s))
    return [np.concatenate(x) for x in zip(*out)]


class _Part:
    """The members of one part: each different vector once, with the k + 1 smallest of its ids."""

    def __init__(self, ids, x, k, dim, kind):
        x = _values(x, dim, kind)
        new = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]).any(axis=1)])
        self.ids, self.k = ids, k
        self.first, self.size = new, np.diff(np.r_[new, len(x)])
        self.v = _unit(x[new])
        self.v32 = self.v.astype(np.float32)
        self.name = pc.rank(ids.take(pa.array(new)), tiebreaker="dense").to_numpy(zero_copy_only=False)

    def rows(self, r, c, s, asking, first, size, same):
        """The k best ids, ties by id, of the members that ask: from (row, vector of the part, cosine), each vector with all its ids."""
        n = self.size[c]
        r, s = np.repeat(r, n), np.repeat(s, n)
        i = np.repeat(self.first[c], n) + np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)
        n = size[r]
        i, s = np.repeat(i, n), np.repeat(s, n)
        q = np.repeat(first[r], n) + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        if same:
            i, s, q = i[i != q], s[i != q], q[i != q]
        name = pc.rank(self.ids.take(pa.array(i)), tiebreaker="dense").to_numpy(zero_copy_only=False) if len(i) else i
        o = np.lexsort((name, -s, q))
        q, i, s = q[o], i[o], s[o]
        o = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        return pa.RecordBatch.from_arrays([asking.take(pa.array(q[o])), self.ids.take(pa.array(i[o])), pa.array(s[o])], names=["query_id", "id", "similarity"])

    def inside(self):
        n, keep = len(self.v), self.k + SLACK
        near, sims = _best_inside(np.arange(n), self.v32, np.full((n, keep), NONE), np.full((n, keep), -9.0, dtype=np.float32), 0, 0, keep)
        r, c, s = _exact(self.v, self.v, self.v32, self.name, near, sims, self.k, True)
        own = np.arange(n)
        r, c, s = np.concatenate([r, own]), np.concatenate([c, own]), np.concatenate([s, np.einsum("qd,qkd->qk", self.v, self.v[:, None])[:, 0]])
        for lo in range(0, n, 1 << 15):
            some = (r >= lo) & (r < lo + (1 << 15))
            yield self.rows(r[some], c[some], s[some], self.ids, self.first, self.size, True)

    def visited(self, ids, x):
        v = _unit(x)
        near, sims = _top(v.astype(np.float32), np.full(len(v), -1), self.v32, np.arange(len(self.v)), self.k + SLACK)
        r, c, s = _exact(v, self.v, self.v32, self.name, near, sims, self.k, False)
        return self.rows(r, c, s, ids, np.arange(len(v)), np.ones(len(v), dtype=np.int64), False)


def _meet(batches, k, dim, kind):
    """Rows sorted by (item, role, x, id): the members of a part, then its visitors in any number. Of more than k + 1 equal
    vectors those beyond are neighbours of nobody and have the first k as theirs, so they are not held."""
    item = part = last = None
    ids, blobs, run, seen = [], [], [], 0

    def built():
        return _Part(pa.concat_arrays(ids), pa.concat_arrays(blobs), k, dim, kind)

    for batch in batches:
        items, role = batch.column("item").to_numpy(), batch.column("role").to_numpy()
        cuts = np.flatnonzero(np.r_[True, (items[1:] != items[:-1]) | (role[1:] != role[:-1])]) if len(items) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(items)]):
            lo, hi = int(lo), int(hi)
            if items[lo] != item:
                if part is None and ids and item % GROUPS == 0:
                    yield from built().inside()
                item, part, last, ids, blobs, run, seen = items[lo], None, None, [], [], [], 0
            there, x = batch.column("id").slice(lo, hi - lo), batch.column("x").slice(lo, hi - lo)
            if role[lo] == 1:
                if part is None and ids:
                    part = built()
                    if item % GROUPS == 0:
                        yield from part.inside()
                for first in range(0, hi - lo, 4096) if part else ():
                    yield part.visited(there.slice(first, 4096), _values(x.slice(first, 4096), dim, kind))
                continue
            v = _values(x, dim, kind)
            new = np.r_[last is None or bool((v[0] != last).any()), (v[1:] != v[:-1]).any(axis=1)]
            begun = np.flatnonzero(new)
            nth = np.arange(len(v)) - np.r_[-seen, begun][np.cumsum(new)]
            for beyond in np.split(np.flatnonzero(nth > k), np.flatnonzero(np.diff(np.flatnonzero(nth > k)) > 1) + 1):
                if len(beyond) and item % GROUPS == 0:
                    at = int(beyond[0] - nth[beyond[0]])  # where the run began; before this batch if negative
                    names = [*run[: max(0, -at)], *there.slice(max(0, at), k).to_pylist()][:k] if at < 0 else there.slice(at, k).to_pylist()
                    u = _unit(v[beyond[:1]])
                    s = float(np.einsum("qd,qkd->qk", u, u[:, None])[0, 0])
                    yield pa.RecordBatch.from_arrays([there.take(pa.array(np.repeat(beyond, k))), pa.array(names * len(beyond), there.type), pa.array(np.full(len(beyond) * k, s))], names=["query_id", "id", "similarity"])
            held = pa.array(np.flatnonzero(nth <= k))
            ids.append(there.take(held))
            blobs.append(x.take(held))
            tail = int(begun[-1]) if len(begun) else 0
            run = [*([] if len(begun) else run), *there.slice(tail, k + 1).to_pylist()][: k + 1]
            last, seen = v[-1], int(nth[-1]) + 1
    if part is None and ids and item % GROUPS == 0:
        yield from built().inside()


def all_nearest(entries: DataFrame, k: int = 5, dim: int = DIM) -> DataFrame:
    """(query_id, id, similarity, rank): for every memory with a usable embedding its k most similar other memories by cosine, exactly; ties by id.

    Cells are dense regions, each with the centre that a sample gives it and, over all vectors, its widest angle. A vector
    goes to the cell of its nearest centre and meets every vector there. Vectors of its cell bound its k-th best from below,
    so by the triangle inequality of angles most other cells cannot hold any of its k best; it visits all that can. What is
    near no centre forms a last cell, which all visit. So the sample changes how much is compared, never what is found:
    vectors without dense regions are compared all with all. A cell of more than ``NODE`` vectors has several parts, each met by
    all that need the cell. Products of 32-bit floats choose ``SLACK`` vectors too many, cosines in double precision
    rank them; where these may be too few, the whole part is computed again.
    Unusable embeddings take no part; fewer than k others give fewer rows.
    """
    kind = "<f8" if dict(entries.dtypes)["embedding"] == "array<double>" else "<f4"
    cells = _cells(entries, dim, kind)
    parts = np.maximum(1, -(-cells.size // NODE)).astype(np.int64)
    groups = np.ones(len(parts), dtype=np.int64)
    groups[-1] = min(GROUPS, max(1, cells.size.sum() // (8 * max(cells.size[-1], NODE // 8))))  # all visit the last one
    placed = usable(entries).withColumn("r", F.xxhash64("id")).mapInArrow(lambda it: _placed(it, cells, dim, kind), "cell bigint, id string, x binary")
    sent = placed.repartition("cell").sortWithinPartitions("cell").mapInArrow(lambda it: _sent(it, cells, k, dim, kind, parts, groups), "item bigint, role tinyint, id string, x binary")
    met = sent.repartition("item").sortWithinPartitions("item", "role", "x", "id")
    found = met.mapInArrow(lambda it: _meet(it, k, dim, kind), "query_id string, id string, similarity double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")))
    return ranked.filter(F.col("rank") <= k)


def neighbour_pairs(found: DataFrame) -> DataFrame:
    """(id_a, id_b): the neighbours as distinct unordered pairs."""
    return found.select(F.least("query_id", "id").alias("id_a"), F.greatest("query_id", "id").alias("id_b")).distinct()
