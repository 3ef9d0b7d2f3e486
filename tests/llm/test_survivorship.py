"""Survivors: order of the rules, nulls, ties, redelivery, empty and odd tables."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodeweave.llm.survivorship import survivors

S = "memory_id string, tier string, content string, summary string, session_id string, tags array<string>, confidence double, created_at timestamp_ntz, last_accessed timestamp_ntz, access_count int"
TEXT = "one two three four five six seven eight"
T = [datetime(2025, 1, d) for d in range(1, 20)]


def row(i, content=TEXT, conf=0.5, created=0, seen=0, count=1, tier="raw", summary=None, session=None, tags=None):
    return (i, tier, content, summary, session, tags, conf, None if created is None else T[created], None if seen is None else T[seen], count)


def pick(spark, *rows):
    return [r.memory_id for r in survivors(spark.createDataFrame(list(rows), S)).collect()]


@pytest.mark.parametrize(
    "a, b, want",
    [
        (row("a", conf=None), row("b", conf=0.1), "b"),
        (row("a", conf=0.4), row("b", conf=0.6), "b"),
        (row("a", count=3), row("b", count=2), "a"),
        (row("a", created=1), row("b", created=2), "b"),
        (row("a", created=None, conf=0.9), row("b", created=None, conf=0.9), "a"),
        (row("a", conf=float("nan")), row("b", conf=0.0), "b"),
        (row("b"), row("a"), "a"),
    ],
)
def test_order(spark, a, b, want):
    assert pick(spark, a, b) == [want]


def test_latest_state_counts(spark):
    other = "nine ten eleven twelve one two three four"
    assert pick(spark, row("a", seen=1), row("a", content=other, seen=2), row("b", seen=1)) == []
    assert pick(spark, row("a", seen=2), row("a", seen=2), row("b", seen=None)) == ["a"]


def test_words_not_typography(spark):
    assert pick(spark, row("a", TEXT), row("b", "ONE, two\nthree - four (five) six seven... Eight!")) == ["a"]
    assert pick(spark, row("a", "too few words"), row("b", "too few words")) == []
    assert pick(spark, row("a", None), row("b", None), row("c", ""), row("d", ""), row(None, TEXT)) == []


def test_fields_come_from_the_best_rows(spark):
    rows = [row("a", conf=0.9, tier="raw", seen=5, summary=None, tags=["x"]), row("b", conf=0.2, tier="core", seen=1, summary="kept", session=" "), row("c", conf=None, tier="core", seen=3, summary="", session="s")]
    r = survivors(spark.createDataFrame(rows, S)).first()
    assert (r.memory_id, r.n_records, r.confidence, r.summary, r.session_id, r.tags) == ("a", 3, 0.2, "kept", "s", ["x"])


def test_odd_tables(spark):
    df = spark.createDataFrame([row("a"), row("b")], S)
    assert survivors(df.limit(0)).count() == 0
    assert survivors(df.withColumn("w", F.lit(1)).withColumn("group_key", F.lit("x")).withColumn("r", F.lit(0)).withColumn("n_records", F.lit(0))).first().memory_id == "a"
    big = spark.createDataFrame([row("a", TEXT + " x" * 200_000), row("b", TEXT + " X" * 200_000)], S)
    assert survivors(big).first().n_records == 2


def test_against_plain_python(spark):
    rng = random.Random(5)
    rows = [row(f"m{i}", " ".join([TEXT, str(rng.randrange(20))]), rng.choice([None, 0.1, 0.5]), rng.choice([None, 1, 2]), 0, rng.choice([None, 1, 2])) for i in range(300)]
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    key = lambda r: (sum(x is None for x in (r[6], r[7], r[9])), -(r[6] if r[6] is not None else -1), -(r[9] if r[9] is not None else -1), -(r[7].timestamp() if r[7] else -1e12), r[0])
    assert sorted(pick(spark, *rows)) == sorted(min(g, key=key)[0] for g in groups.values() if len(g) > 1)
