"""Bulk-synchronous best-fit packing of documents into containers of fixed capacity."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.llm.tokens import RANKS, token_count
from lodeweave.session import cut

BUCKETS = 256  # hash ranges that ranks are cut into
RANGES = 8  # ranges of sizes and gaps that are swept side by side

_ALLOC = "pack_name string, capacity long, kind string, value long, n long, done long, size long, each long, rank long"


def sweep(events: list[tuple[str, int, int, int]]) -> tuple[list[tuple[int, int, int, int, int, int]], list[tuple[str, int, int, int]]]:
    """One successor sweep over classes (kind 'gap' or 'item', value, n, done): from the largest value down, gaps before items of their size.

    Each class of items goes into the smallest gap met so far, as many to a gap as it holds, larger items first: a conflict is
    settled by rank. A gap is used for one class of items in a sweep. Returns allocations
    (gap, first gap used, gaps, size, items per gap, first item) and the classes left over, with how many of each are done."""
    stack: list[list[int]] = []
    placed, left = [], []
    for kind, value, n, done in sorted(events, key=lambda e: (-e[1], e[0] != "gap")):
        if kind == "gap":
            if n > done:
                stack.append([value, n, done])
            continue
        while n > done and stack:
            gap, many, used = stack[-1]
            each = gap // value
            full = min((n - done) // each, many - used)
            if full:
                placed.append((gap, used, full, value, each, done))
                used, done = used + full, done + full * each
            if n > done and used < many:  # the last ones do not fill a gap
                placed.append((gap, used, 1, value, n - done, done))
                used, done = used + 1, n
            stack[-1][2] = used
            if used == many:
                left.append(("gap", *stack.pop()))
        left.append(("item", value, n, done))
    return placed, left + [("gap", *g) for g in stack]


_COLUMNS = ["pack_name", "capacity", "kind", "value", "n", "done", "size", "each", "rank"]


def _swept(pdf: pd.DataFrame) -> pd.DataFrame:
    """The sweep of a group of classes; allocations made before pass through."""
    name, capacity = pdf["pack_name"].iloc[0], int(pdf["capacity"].iloc[0])
    open_ = pdf["kind"] != "put"
    placed, left = sweep([(k, int(v), int(n), int(d)) for k, v, n, d in zip(*(pdf.loc[open_, c] for c in ("kind", "value", "n", "done")))])
    rows = [(name, capacity, "put", g, u, k, s, e, r) for g, u, k, s, e, r in placed]
    rows += [(name, capacity, k, v, n, d, 0, 0, 0) for k, v, n, d in left]
    return pd.concat([pdf.loc[~open_, _COLUMNS], pd.DataFrame(rows, columns=_COLUMNS)]) if not open_.all() else pd.DataFrame(rows, columns=_COLUMNS)


def _swept_whole(pdf: pd.DataFrame) -> pd.DataFrame:
    """The sweep of all that a kind of container has left, and, if pieces remain, how many containers those need in any packing
    that no gap holds: by their size, or one for each piece of more than half of it."""
    out = _swept(pdf)
    rest = out[(out["kind"] == "item") & (out["n"] > out["done"])]
    if not len(rest):
        return out
    name, capacity = pdf["pack_name"].iloc[0], int(pdf["capacity"].iloc[0])
    free = out.loc[(out["kind"] == "gap") & (out["n"] > out["done"]), "value"].max() if len(out) else 0
    put = out[out["kind"] == "put"]
    made = (put["value"] - put["each"] * put["size"]).max() if len(put) else 0
    top = max(0 if pd.isna(free) else int(free), int(made))
    tall = rest[rest["value"] > top]
    many = tall["n"] - tall["done"]
    need = max(-(-int((tall["value"] * many).sum()) // capacity), int(many[2 * tall["value"] > capacity].sum()))
    return pd.concat([out, pd.DataFrame([(name, capacity, "need", need, 0, 0, 0, 0, 0)], columns=_COLUMNS)])


def placements(classes: DataFrame, max_rounds: int = 400) -> DataFrame:
    """(pack_name, size, rank, until, container, each): where the pieces of each size go, from classes(pack_name, capacity, size, n).

    Bulk-synchronous best fit. Pieces of one size are alike and so are containers with one gap, so both are classes, at most the
    capacity of each whatever the number of documents, and the containers of a gap are runs of numbers, rows of a
    table. A round sorts both by range of value; every range is swept on its own, what it leaves over is swept again over all
    ranges, and the gaps used take their new value. Pieces larger than every gap left open the containers they need in any packing.
    Rounds repeat until no piece is left: about as many as a container holds different sizes. Tables are cut in the shared folder each round."""
    spark = classes.sparkSession
    key = ["pack_name", "capacity"]
    zero = F.lit(0).cast("long")
    first = classes.filter("size > 0").select(*key, F.lit("item").alias("kind"), F.col("size").cast("long").alias("value"), F.col("n").cast("long").alias("n"), zero.alias("done"), zero.alias("size"), zero.alias("each"), zero.alias("rank"))
    swept = cut(first.groupBy(*key).applyInPandas(_swept_whole, _ALLOC))
    runs = swept.limit(0).select(*key, F.col("value").alias("gap"), F.col("n").alias("first"), F.col("n").alias("many"))
    opened, out = {}, []
    for _ in range(max_rounds):
        needs = swept.filter("kind = 'need'").select(*key, F.col("value").alias("need")).collect()  # one row a kind of container
        if not needs:
            return reduce(DataFrame.unionByName, out)
        rest = swept.filter("kind = 'item' and n > done")
        fresh = [(r.pack_name, r.capacity, opened.get((r.pack_name, r.capacity), 0), r.need) for r in needs if r.need]
        opened |= {(name, cap): begin + many for name, cap, begin, many in fresh}
        if fresh:
            rows = F.array(*(F.struct(F.lit(name).alias("pack_name"), *(F.lit(x).cast("long").alias(c) for x, c in ((cap, "capacity"), (cap, "gap"), (begin, "first"), (many, "many")))) for name, cap, begin, many in fresh))
            runs = runs.unionByName(spark.range(1).select(F.inline(rows)))
        gaps = runs.groupBy(*key, "gap").agg(F.sum("many").alias("n")).select(*key, F.lit("gap").alias("kind"), F.col("gap").alias("value"), "n", zero.alias("done"), zero.alias("size"), zero.alias("each"), zero.alias("rank"))
        events = gaps.unionByName(rest).withColumn("part", F.floor(F.col("value") * RANGES / (F.col("capacity") + 1)).cast("int"))
        swept = cut(events.groupBy(*key, "part").applyInPandas(_swept, _ALLOC).groupBy(*key).applyInPandas(_swept_whole, _ALLOC))
        # Which containers the allocated gaps are: unit numbers of a gap's class against its runs.
        order = Window.partitionBy(*key, "gap").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
        at = runs.withColumn("off", F.coalesce(F.sum("many").over(order), zero))
        put = F.col("kind") == "put"
        used = swept.filter("kind = 'put' or kind = 'gap' and n > done").select(*key, F.col("value").alias("gap"), F.when(put, F.col("n")).otherwise(F.col("done")).alias("u"), F.when(put, F.col("done")).otherwise(F.col("n") - F.col("done")).alias("k"), "size", "each", "rank")
        both = used.join(at, [*key, "gap"]).filter("u < off + many and off < u + k")
        lo, hi = F.greatest("u", "off"), F.least(F.col("u") + F.col("k"), F.col("off") + F.col("many"))
        parts = cut(both.select(*key, "size", "each", (F.col("rank") + (lo - F.col("u")) * F.col("each")).alias("rank"), (F.col("first") + lo - F.col("off")).alias("container"), (hi - lo).alias("many"), (F.col("gap") - F.col("each") * F.col("size")).alias("gap")))
        out.append(parts.filter("each > 0").select("pack_name", "size", "rank", (F.col("rank") + F.col("many") * F.col("each")).alias("until"), "container", "each"))
        runs = parts.filter("gap > 0").select(*key, "gap", F.col("container").alias("first"), "many")
    raise RuntimeError("packing did not end")


def pieces(documents: DataFrame, capacities: DataFrame, path: str = RANKS) -> DataFrame:
    """(pack_name, capacity, doc_id, piece, size): a document is cut only where it alone exceeds the capacity."""
    docs = cut(documents.select("doc_id", token_count(F.col("text"), path).alias("tokens")))  # two numbers a document, so that texts are read once
    packs = capacities.filter("pack_name is not null and capacity_tokens > 0").select("pack_name", F.col("capacity_tokens").alias("capacity")).distinct().collect()  # the table of container kinds, fixed
    kinds = F.array(*(F.struct(F.lit(p.pack_name).alias("pack_name"), F.lit(p.capacity).alias("capacity")) for p in packs)) if packs else F.array().cast("array<struct<pack_name:string,capacity:int>>")
    each = docs.select("doc_id", "tokens", F.explode(kinds).alias("p")).select("doc_id", "tokens", "p.*")
    n = F.greatest(F.ceil(F.col("tokens") / F.col("capacity")), F.lit(1)).cast("int")
    parts = each.withColumn("piece", F.explode(F.sequence(F.lit(0), n - 1)))
    return parts.select("pack_name", "capacity", "doc_id", "piece", F.least(F.col("capacity"), F.col("tokens") - F.col("piece") * F.col("capacity")).alias("size"))


def pack(documents: DataFrame, capacities: DataFrame, path: str = RANKS) -> DataFrame:
    """(pack_name, doc_id, piece, piece_tokens, container, unused_tokens): the container of every piece.

    Pieces are counted by size (at most one class per token of capacity, counted map-side), the classes are placed by
    ``placements`` in rounds of distributed sweeps, and each piece finds its place by its rank within its size. Ranks come from prefix
    sums over (size, hash range), so a size that a third of all documents share is ranked by many
    tasks; placements are first cut at the same ranges, so a piece meets those of its range only. unused_tokens is the
    space its container leaves free. Texts that are null or empty take no space and go to container 0; an empty table gives no rows.
    """
    items = pieces(documents, capacities, path).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(BUCKETS)).cast("int"))
    per = cut(items.groupBy("pack_name", "capacity", "size", "bucket").agg(F.count(F.lit(1)).alias("n")))
    placed = placements(per.groupBy("pack_name", F.col("capacity").cast("long").alias("capacity"), "size").agg(F.sum("n").alias("n"))) if not per.filter("size > 0").isEmpty() else None
    earlier = Window.partitionBy("pack_name", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("pack_name", "size", "bucket", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("off"))
    inside = Window.partitionBy("pack_name", "size", "bucket").orderBy("doc_id", "piece")
    empty = items.filter("size = 0").select("pack_name", "doc_id", "piece", F.col("size").alias("piece_tokens"), F.lit(0).cast("long").alias("container"))
    if placed is None:
        packs = capacities.select("pack_name", F.col("capacity_tokens").cast("long").alias("unused_tokens")).distinct()
        return empty.join(F.broadcast(packs), "pack_name")
    # Classes and ranges only: each range's ranks against the placements of its size.
    where = offsets.join(placed, ["pack_name", "size"]).filter("rank < off + n and off < until").select("pack_name", "size", "bucket", "off", "rank", "until", "container", "each")
    ranked = items.filter("size > 0").withColumn("r", F.row_number().over(inside) - 1)
    met = ranked.join(where, ["pack_name", "size", "bucket"]).withColumn("at", F.col("off") + F.col("r")).filter("at >= rank and at < until")
    put = met.select("pack_name", "capacity", "doc_id", "piece", F.col("size").alias("piece_tokens"), (F.col("container") + F.floor((F.col("at") - F.col("rank")) / F.col("each"))).cast("long").alias("container"))
    full = put.groupBy("pack_name", "capacity", "container").agg(F.sum("piece_tokens").alias("used")).select("pack_name", "container", (F.col("capacity") - F.col("used")).cast("long").alias("unused_tokens"))
    first = F.broadcast(full.filter("container = 0").drop("container"))  # one row a kind of container
    return put.drop("capacity").join(full, ["pack_name", "container"]).select("pack_name", "doc_id", "piece", "piece_tokens", "container", "unused_tokens").unionByName(empty.join(first, "pack_name").select("pack_name", "doc_id", "piece", "piece_tokens", "container", "unused_tokens"))


def pack_summary(documents: DataFrame, capacities: DataFrame, path: str = RANKS) -> DataFrame:
    """(pack_name, n_containers, used_tokens, unused_tokens) per kind of container, summed over the containers."""
    each = pack(documents, capacities, path).groupBy("pack_name", "container").agg(F.sum("piece_tokens").alias("used"), F.max("unused_tokens").alias("unused"))
    return each.groupBy("pack_name").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("used").alias("used_tokens"), F.sum("unused").alias("unused_tokens"))
