"""Exact vector search for a stated, bounded set of queries, and vector expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_QUERIES = 4096


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision; the shorter length's rest counts as null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, fallback: float = 0.0, mismatch: float | None = None) -> Column:
    """Cosine; ``fallback`` for empty, null or zero vectors, ``mismatch`` (if given) for different lengths."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    c = F.coalesce(F.when(n > 0, dot(a, b) / n), F.lit(fallback))
    return c if mismatch is None else F.when(F.size(a) != F.size(b), F.lit(mismatch)).otherwise(c)


def truncated(v: Column, d: int) -> Column:
    """The first d values, scaled to unit length; a zero vector stays."""
    s = F.slice(v, 1, d)
    n = F.sqrt(dot(s, s))
    return F.when(n > 0, F.transform(s, lambda x: x.cast("double") / n)).otherwise(F.transform(s, lambda x: x.cast("double")))


def nearest_exact(base: DataFrame, queries: DataFrame, k: int, dim: int) -> DataFrame:
    """(query_id, id, similarity, rank): the k most similar rows of base(id, v) for each of queries(query_id, v), itself excluded.

    A block product per Arrow batch; only k candidates per query and batch leave it. The
    queries are the stated set and travel as one matrix: over MAX_QUERIES of them are refused,
    not cut (the hashing operator serves more). Vectors of another length or of norm zero are left out.
    """
    rows = queries.filter(F.size("v") == dim).select("query_id", "v").limit(MAX_QUERIES + 1).collect()
    if len(rows) > MAX_QUERIES:
        raise ValueError(f"over {MAX_QUERIES} queries")
    ids = [r.query_id for r in rows]
    q = np.array([r.v for r in rows], dtype=np.float64).reshape(-1, dim)
    norm = np.sqrt((q * q).sum(1))
    ids, q = [i for i, n in zip(ids, norm) if n > 0], q[norm > 0] / norm[norm > 0][:, None]
    kind, base_kind = dict(queries.dtypes)["query_id"], dict(base.dtypes)["id"]

    def score(batches):
        for batch in batches:
            col = batch.column("v")
            at = np.flatnonzero(pc.fill_null(pc.list_value_length(col), -1).to_numpy(zero_copy_only=False) == dim)
            v = np.asarray(col.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)
            n = np.sqrt((v * v).sum(1))
            at, v = at[n > 0], v[n > 0] / n[n > 0][:, None]
            if not len(at) or not len(ids):
                continue
            s = q @ v.T
            top = np.argpartition(-s, min(k, s.shape[1] - 1), axis=1)[:, : k + 1]
            who = batch.column("id").take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, dtype=object), top.shape[1]).tolist(), who.type if kind == base_kind else None), who.take(pa.array(top.ravel())), pa.array(np.take_along_axis(s, top, 1).ravel())], names=["query_id", "id", "similarity"])

    found = base.select("id", "v").mapInArrow(score, f"query_id {kind}, id {base_kind}, similarity double").filter("query_id <> id")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
