"""Near-duplicate texts: pairs and groups whose word-pair sets are similar."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.operators.components import connected_components
from lodeweave.session import cut

THRESHOLD = 0.7
MIN_WORDS = 8
BUCKETS = 1 << 22  # counts kept of word pairs, by hash
RANGE = 1 << 12  # buckets whose counts are sent in one piece
HOT = 100_000  # texts with one word pair above which they are split
EXPAND = 100  # copies of one text up to which all their pairs are listed

_MARK = "\x1f"  # between kind and text, so that one column serves both uses of the same shuffle
_WORD = re.compile("[a-z0-9]+")
_SIZE = np.uint64(0xFFF)  # the low bits of a key hold the number of word pairs, 4095 at most
_MAP = 116  # bits of a text's parity map: 64 and the upper 52 of ``more``, whose low bits hold a place
_M1, _M2, _STEP = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x = x ^ (x >> np.uint64(33))
    x = x * _M2
    return x ^ (x >> np.uint64(33))


def pair_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 64-bit hash of a word pair), sorted, distinct: the sets of adjacent word pairs of many texts at once."""
    import xxhash

    seen: dict[str, int] = {}
    found = [_WORD.findall(t.lower()) if t else () for t in texts]
    lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    for ws in found:
        for w in ws:
            if w not in seen:
                seen[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter((seen[w] for ws in found for w in ws), dtype=np.uint64, count=int(lengths.sum()))
    doc = np.repeat(np.arange(len(texts)), lengths)
    if len(h) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    same = doc[1:] == doc[:-1]
    b, d = _mix(h[:-1] * np.uint64(31) + h[1:])[same], doc[:-1][same]
    o = np.lexsort((b, d))
    b, d = b[o], d[o]
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != b[:-1]) | (d[1:] != d[:-1])
    return d[keep], b[keep]


def _least(n: np.ndarray, share: float) -> np.ndarray:
    """The smallest whole number that is ``share`` of n."""
    return np.ceil(n * share - 1e-9).astype(np.int64)


def prefixes(texts: list[str | None], common: np.ndarray, threshold: float = THRESHOLD):
    """(text number, word pair, its place, number of word pairs, both halves of the parity map) of every prefix entry.

    All word pairs have one global order, the rarest first by the counts ``common``. Two sets that
    reach the threshold share a word pair among the first n - ceil(threshold n) + 1 of each.
    A word pair flips one bit of the map, so maps differ in no more bits than the sets in word pairs.
    """
    d, b = pair_sets(texts)
    n = np.bincount(d, minlength=len(texts))
    low, high = np.zeros(len(texts), dtype=np.uint64), np.zeros(len(texts), dtype=np.uint64)
    if len(d):
        starts = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        bit = (b >> np.uint64(40)) % np.uint64(_MAP)
        one = np.uint64(1) << (bit & np.uint64(63))
        low[d[starts]] = np.bitwise_xor.reduceat(np.where(bit < 64, one, np.uint64(0)), starts)
        high[d[starts]] = np.bitwise_xor.reduceat(np.where(bit < 64, np.uint64(0), one), starts)
        b = b[np.lexsort((common[b & np.uint64(len(common) - 1)], d))]  # stable: word pairs as common stay in order of their hash
    place = np.arange(len(d)) - (np.cumsum(n) - n)[d]
    keep = place < (n - _least(n, threshold) + 1)[d]
    d, b, place = d[keep], b[keep], place[keep]
    return d, b, place, n[d], low[d], high[d]


def _split(column) -> tuple[tuple, tuple]:
    """Kinds and texts of stored contents."""
    pairs = [c.split(_MARK, 1) for c in column.to_pylist()]
    return tuple(zip(*pairs)) if pairs else ((), ())


def _slices(batches, columns: list[str], budget: int = 1 << 23):
    """The batches in pieces of about ``budget`` characters, so that long texts cost no more memory than short ones."""
    for batch in batches:
        size = np.cumsum(sum(pc.binary_length(batch.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns))
        cuts = np.flatnonzero(np.diff(size // budget)) + 1 if len(size) else []
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(lo, hi - lo)


def _pieces(total):
    """Counts as (range of buckets, packed counts) of the ranges that have any, each in the narrowest numbers that hold them."""
    parts = total.reshape(-1, RANGE)
    at = np.flatnonzero(parts.any(axis=1))
    packed = [zlib.compress(p.astype(np.min_scalar_type(int(p.max()))).tobytes(), 1) for p in parts[at]]
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(packed, pa.binary())], names=["part", "n"])


def _added(total, batch):
    for part, packed in zip(batch["part"].to_pylist(), batch["n"].to_pylist()):
        raw = zlib.decompress(packed)
        total[part * RANGE : (part + 1) * RANGE] += np.frombuffer(raw, dtype=f"u{len(raw) // RANGE}").astype(np.int64)
    return total


def _counted(batches):
    """Counts of word pairs by bucket: of every text, once in a task."""
    total, seen = np.zeros(BUCKETS, dtype=np.int64), set()
    for batch in _slices(batches, ["content"]):
        new = [i for i, c in enumerate(batch.column("class_id").to_pylist()) if not (c in seen or seen.add(c))]
        _, b = pair_sets(list(_split(batch.column("content").take(pa.array(new, pa.int64())))[1]))
        total += np.bincount((b & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
    yield _pieces(total)


def _summed(batches):
    total = np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        total = _added(total, batch)
    yield _pieces(total)


def word_pair_counts(records: DataFrame) -> np.ndarray:
    """In how many texts a word pair of each bucket occurs, over all of them; a text that several tasks read counts once in each."""
    each = prepared(records).select("class_id", "content").mapInArrow(_counted, "part int, n binary")
    return _added(np.zeros(BUCKETS, dtype=np.int64), each.repartition("part").mapInArrow(_summed, "part int, n binary").toArrow())


def _keys(batches, held, threshold, hot):
    import xxhash

    common = held.value
    for batch in _slices(batches, ["content"]):
        kinds, texts = _split(batch.column("content"))
        d, b, place, n, low, high = prefixes(texts, common, threshold)
        cls = batch.column("class_id").to_numpy(zero_copy_only=False).astype(np.int64)[d]
        kind = np.array([xxhash.xxh64_intdigest(k) for k in kinds], dtype=np.uint64)[d]  # kinds never meet
        parts = 1 + common[b & np.uint64(BUCKETS - 1)].astype(np.int64) // hot
        # A hot word pair has groups for every two of its parts; a text is in all that have its own part.
        row = np.repeat(np.arange(len(d)), parts)
        other = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        own = (_mix(cls.view(np.uint64)) % parts.astype(np.uint64)).astype(np.int64)[row]
        group = (np.minimum(own, other) * parts[row] + np.maximum(own, other)).astype(np.uint64)
        key = _mix(_mix(b[row] ^ kind[row]) + group * _STEP)
        k = (key & ~_SIZE) | np.minimum(n[row], int(_SIZE)).astype(np.uint64)
        more = high[row] << np.uint64(12) | np.minimum(place[row], int(_SIZE)).astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(cls[row]), pa.array(low[row].view(np.int64)), pa.array(more.view(np.int64))], names=["k", "class_id", "bits", "more"])


def _pairs(batches, threshold):
    """Candidates of rows sorted by key and size: within a key, each row meets those before it whose sizes, places and parity maps allow the threshold."""
    held = None
    for batch in batches:
        names = [c for c in ("k", "class_id", "bits", "more") if c in batch.schema.names]
        now = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in names])
        now = now if held is None else np.hstack([held, now])
        end = np.searchsorted(now[0] >> 12, now[0, -1] >> 12) if now.shape[1] else 0  # the last key may go on
        held = now[:, end:]
        yield from _within(now[:, :end], threshold)
    if held is not None:
        yield from _within(held, threshold)


def _within(rows, threshold, most: int = 1 << 20):
    """No pair that reaches the threshold is left out: its first common word pair in the global order passes every test."""
    k, n, c, low = rows[0], rows[0] & 0xFFF, rows[1], rows[2].view(np.uint64)
    more = rows[3].view(np.uint64) if len(rows) > 3 else np.zeros(len(k), dtype=np.uint64)
    high, place, whole = more >> np.uint64(12), (more & _SIZE).astype(np.int64), n < 0xFFF
    share = threshold / (1 + threshold)
    # The smaller text of a pair has its first common word pair in a shorter prefix.
    first = np.flatnonzero(~whole | (place <= n - _least(n, 2 * share)))
    lo = np.searchsorted(k[first], (k & ~np.int64(0xFFF)) | _least(n, threshold))
    count = np.maximum(np.searchsorted(first, np.arange(len(k))) - lo, 0)
    ends = np.cumsum(count)
    start = 0
    while start < len(k):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most)))
        many = count[start:stop]
        y = np.repeat(np.arange(start, stop), many)
        x = first[np.arange(len(y)) - np.repeat(np.cumsum(many) - many - lo[start:stop], many)]
        both = n[x] + n[y]
        need = _least(both, share)
        apart = np.bitwise_count(low[x] ^ low[y]).astype(np.int64) + np.bitwise_count(high[x] ^ high[y])
        near = (apart <= both - 2 * need) & (np.minimum(n[x] - place[x], n[y] - place[y]) >= need) | ~whole[y]
        a, b = c[x[near]], c[y[near]]
        a, b = np.minimum(a, b), np.maximum(a, b)
        ab = np.unique(np.stack([a[a != b], b[a != b]]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(ab[0]), pa.array(ab[1])], names=["a", "b"])
        start = stop


ORDERS = (np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93))  # two further global orders of word pairs, each by a hash


def _share_prefix(d, b, n, first, at, size, threshold):
    """Which pairs share a word pair among the first n - ceil(threshold n) + 1 of both under every one of ``ORDERS``."""
    good = np.ones(size, bool)
    for order in ORDERS:
        o = np.lexsort((_mix(b ^ order), d))
        place = np.empty(len(d), np.int64)
        place[o] = np.arange(len(d)) - first[d[o]]
        keep = place < (n - _least(n, threshold) + 1)[d]
        dk, bk = d[keep], b[keep]
        nk = np.bincount(dk, minlength=len(n))
        fk = np.cumsum(nk) - nk
        many = nk[at]
        take = np.repeat(fk[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        pair = np.repeat(np.tile(np.arange(size, dtype=np.uint64), 2), many)
        key = np.sort(pair << np.uint64(44) | bk[take] >> np.uint64(20))
        shared = np.zeros(size, bool)
        shared[(key[1:][key[1:] == key[:-1]] >> np.uint64(44)).astype(np.int64)] = True
        good &= shared
    return good


def _similarity(batches, threshold=THRESHOLD):
    """Candidates of one order with their texts: those whose prefixes meet under the other orders too are verified on the whole sets."""
    for batch in _slices(batches, ["text_a", "text_b"]):
        seen: dict[str, int] = {}  # a text meets many others: it is taken apart once
        at = np.array([seen.setdefault(t, len(seen)) for c in ("text_a", "text_b") for t in batch.column(c).to_pylist()], dtype=np.int64)
        d, b = pair_sets([t.split(_MARK, 1)[1] for t in seen])
        n = np.bincount(d, minlength=len(seen))
        first = np.cumsum(n) - n
        kept = np.flatnonzero(_share_prefix(d, b, n, first, at, batch.num_rows, threshold))
        at = np.concatenate([at[kept], at[batch.num_rows + kept]])
        size = len(kept)
        many = n[at]
        take = np.repeat(first[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        pair = np.repeat(np.tile(np.arange(size, dtype=np.uint64), 2), many)
        key = np.sort(pair << np.uint64(44) | b[take] >> np.uint64(20))  # 44 bits tell the word pairs of two texts apart
        both = np.bincount((key[1:][key[1:] == key[:-1]] >> np.uint64(44)).astype(np.int64), minlength=size)
        union = many[:size] + many[size:] - both
        sim = np.where(union > 0, both / np.maximum(union, 1), 0.0)
        rows = pa.array(kept)
        yield pa.RecordBatch.from_arrays([batch.column("a").take(rows), batch.column("b").take(rows), pa.array(sim)], names=["a", "b", "similarity"])


def prepared(records: DataFrame) -> DataFrame:
    """(record_kind, record_id, class_id, content) of texts with at least 8 words, one row per row of records; content is led by its kind.

    class_id is a 64-bit hash of kind and words: copies that differ in typography only share it
    (two different texts out of a billion share one with probability 0.03).
    """
    norm = F.trim(F.regexp_replace(F.lower("content"), "[^a-z0-9]+", " "))
    out = records.filter("record_id is not null and content is not null").withColumn("w", norm)
    return out.filter(F.size(F.split("w", " ")) >= MIN_WORDS).withColumn("class_id", F.xxhash64("record_kind", "w")).withColumn("content", F.concat(F.coalesce("record_kind", F.lit("")), F.lit(_MARK), "content")).drop("w")


def members(records: DataFrame) -> DataFrame:
    """(record_kind, record_id, class_id) of each record's latest row (column ``at``; rows that tie are equal)."""
    norm = F.trim(F.regexp_replace(F.lower("content"), "[^a-z0-9]+", " "))
    cls = F.when(F.size(F.split(norm, " ")) >= MIN_WORDS, F.xxhash64("record_kind", norm))
    every = records.filter("record_id is not null").select("record_kind", "record_id", F.coalesce("at", F.to_timestamp(F.lit("0001-01-01")).cast(records.schema["at"].dataType)).alias("at"), cls.alias("class_id"))
    return every.groupBy("record_kind", "record_id").agg(F.max_by("class_id", "at").alias("class_id")).filter("class_id is not null")


def similar_classes(records: DataFrame, threshold: float = THRESHOLD, hot: int = HOT) -> DataFrame:
    """(a, b, similarity): classes of equal texts of one kind, a < b, whose sets of word pairs reach the threshold: all of them.

    Copies are first reduced to one text per class where they are read, so a text that a
    third of all rows repeat is one row. Candidates share a word pair in their prefixes, the
    rarest 0.3 n + 1 of n word pairs in one global order, and their sizes, the places of that word pair
    and parity maps of their whole sets allow the threshold. Before a candidate is verified on the whole texts,
    it must also share a word pair of its prefixes under two further global orders; none of these filters can drop a pair
    that reaches the threshold, so their intersection cannot either. The order comes from
    the counts of all texts, which decide how many rows meet and not which pairs are found.
    The rows of a word pair are read as a sorted stream, those of a hot one in parts.
    """
    common = np.minimum(word_pair_counts(records), 2**31 - 1).astype(np.int32)
    held = records.sparkSession.sparkContext.broadcast(common)
    texts = prepared(records).groupBy("class_id").agg(F.first("content").alias("content"))
    keys = texts.select("class_id", "content").mapInArrow(lambda it: _keys(it, held, threshold, hot), "k long, class_id long, bits long, more long")
    met = keys.repartition(F.shiftright("k", 12)).sortWithinPartitions("k")
    candidates = met.mapInArrow(lambda it: _pairs(it, threshold), "a long, b long").distinct()
    side = lambda c: texts.select(F.col("class_id").alias(c), F.col("content").alias(f"text_{c}"))
    full = candidates.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    return full.mapInArrow(lambda it: _similarity(it, threshold), "a long, b long, similarity double").filter(F.col("similarity") >= threshold - 1e-12)


def near_duplicate_pairs(records: DataFrame, threshold: float = THRESHOLD, expand: int = EXPAND) -> DataFrame:
    """(record_kind, id_a, id_b), id_a < id_b: records of one kind whose latest texts are similar or equal.

    records has record_kind, record_id, content and at. All pairs of copies are listed up to
    ``expand`` copies of one text; beyond, each copy is paired with the smallest id of its
    class, which alone stands for it in pairs with other classes. Null, empty and short texts
    make no pair; an empty table gives no rows.
    """
    who = members(records)
    stats = who.groupBy("class_id").agg(F.count(F.lit(1)).alias("copies"), F.min("record_id").alias("first"))
    known = who.join(stats, "class_id")
    shown = known.filter((F.col("copies") <= expand) | (F.col("record_id") == F.col("first")))
    end = lambda c: shown.select(F.col("class_id").alias(c), F.col("record_kind").alias(f"kind_{c}"), F.col("record_id").alias(f"id_{c}"))
    across = similar_classes(records, threshold).join(end("a"), "a").join(end("b"), "b").filter("kind_a = kind_b")
    twin = shown.filter("copies > 1")
    equal = twin.select("class_id", F.col("record_kind").alias("kind_a"), F.col("record_id").alias("id_a")).join(twin.select("class_id", F.col("record_id").alias("id_b")), "class_id").filter("id_a < id_b")
    star = known.filter((F.col("copies") > expand) & (F.col("record_id") != F.col("first"))).select(F.col("record_kind").alias("kind_a"), F.col("first").alias("id_a"), F.col("record_id").alias("id_b"))
    cols = [F.col("kind_a").alias("record_kind"), F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")]
    return across.select(*cols).unionByName(equal.select(*cols)).unionByName(star.select(*cols))


def near_duplicate_groups(records: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(record_kind, record_id, class_id, group_id, n_links): one row per record with at least 8 words.

    class_id names its text, group_id the connected component of similar texts (its own class
    if none), n_links the number of different texts similar to it.
    """
    links = cut(similar_classes(records, threshold).select("a", "b"))
    degree = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    parts = connected_components(links).select(F.col("node").alias("class_id"), F.col("component").alias("group_id"))
    linked = parts.join(degree, "class_id")
    return members(records).join(linked, "class_id", "left").select("record_kind", "record_id", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def statements_and_memories(memories: DataFrame, insights: DataFrame) -> DataFrame:
    """The two kinds of texts as records."""
    m = memories.select(F.lit("memory").alias("record_kind"), F.col("memory_id").alias("record_id"), "content", F.col("last_accessed").alias("at"))
    i = insights.select(F.lit("insight").alias("record_kind"), F.col("insight_id").alias("record_id"), F.col("statement").alias("content"), F.col("loaded_at").alias("at"))
    return m.unionByName(i)
